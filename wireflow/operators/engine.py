"""Template rewriting of the linked table in rounds: match, keep matches that do not conflict, apply.

Rules that are told as rows are applied to a fixpoint by blocks (:mod:`wireflow.operators.blocks`). Rounds
are for the others, for so many passes or seconds, and for tables whose ids say nothing about neighbourhood.

The table is a base and what changed since (:class:`Versions`). The first round of a rule looks at
all gates; the next ones only at those near a gate that was changed or that lost a conflict, for
nowhere else can a match be new. So what is written grows with the rewrites, not with the rounds.

A match has a core (gates deleted, retyped or rewired) and a boundary (neighbours that get one
new link). Two matches conflict if the core of one meets the other; of those around a gate the
one with the smallest hashed priority stays, so chains resolve in few rounds and every round
makes progress. Edits are keyed by (gate, side, port) and never collide."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireflow.functions.codec import link, link_id, link_port, link_type
from wireflow.operators.blocks import by_blocks
from wireflow.operators.gates import classes, stats
from wireflow.operators.rows import cancel_rows, cancel_two_rows, commute_rows, fuse_rows, reverse_rows
from wireflow.plans.staging import unstage
from wireflow.schema import CONTROLLED, CX, H, S, S_DAG, T, T_DAG

SIDES = [f"{s}_q{p}" for s in ("prev", "next") for p in (1, 2, 3)]


@dataclass(frozen=True)
class Rule:
    """``match`` gives (match, core array, boundary array, edits array<struct<gate, slot, link>>, deletes array, retype struct).

    The gates of a core are within ``radius`` links of each other. ``rows`` are the same rule as the rows
    of :mod:`wireflow.operators.patterns`, if it can be told so."""

    name: str
    match: Callable[[DataFrame], DataFrame]
    radius: int = 1
    rows: tuple | None = None


def _is(prefix: str, code: int, param: float) -> Column:
    return (F.col(f"{prefix}.type") == code) & (F.col(f"{prefix}.param") == F.lit(param).cast("float"))


def _edit(gate, slot, to) -> Column:
    return F.struct(gate.cast("bigint").alias("gate"), slot.alias("slot"), to.cast("bigint").alias("link"))


def _slot(side: str, at) -> Column:
    return F.concat(F.lit(f"{side}_q"), (link_port(at) + 1).cast("string"))


def _pairs(gates: DataFrame, first: Column, *second: int) -> DataFrame:
    """(g, h): one-wire neighbours g on port 0 then h, of which g satisfies ``first`` and h is of the types ``second``; the row structs of both.

    The link of g names the type of h, so only gates that have a partner are joined."""
    g = gates.where(first & link_type("next_q1").isin(*second)).select(F.struct(*gates.columns).alias("g"), link_id("next_q1").alias("to"))
    h = gates.where(F.col("type").isin(*second)).select(F.struct(*gates.columns).alias("h"), F.col("id").alias("to"))
    return g.join(h, "to").where("h.prev_q1 = g.id * 1000 + g.type")


def _one(code: int, param: float) -> Column:
    """A gate of a type and parameter that has a neighbour before it."""
    return (F.col("type") == code) & (F.col("param") == F.lit(param).cast("float")) & F.col("prev_q1").isNotNull()


def _made(df: DataFrame, core: list, boundary: list, edits: list, deletes: list, retype=None) -> DataFrame:
    none = F.lit(None).cast("struct<gate:bigint,type:smallint,param:float,flip:boolean>")
    return df.select(core[0].alias("match"), F.array(*core).alias("core"), F.array(*boundary).alias("boundary"), F.array(*edits).alias("edits"), F.array(*deletes).alias("deletes"), (retype if retype is not None else none).alias("retype"))


def cancel_one(first: int, second: int, p1: float, p2: float) -> Rule:
    """Two one-qubit gates in a row vanish; their neighbours are joined."""

    def match(gates: DataFrame) -> DataFrame:
        m = _pairs(gates, _one(first, p1), second).where(_is("h", second, p2) & F.col("h.next_q1").isNotNull())
        a, b, g, h = F.col("g.prev_q1"), F.col("h.next_q1"), F.col("g.id"), F.col("h.id")
        return _made(m, [g, h], [link_id(a), link_id(b)], [_edit(link_id(a), _slot("next", a), b), _edit(link_id(b), _slot("prev", b), a)], [g, h])

    return Rule(f"cancel {first} {second}", match, rows=cancel_rows(first, second, p1, p2))


def fuse(first: int, second: int, p1: float, p2: float, code: int, param: float) -> Rule:
    """Two one-qubit gates in a row become one of another type; the links to it get its type."""

    def match(gates: DataFrame) -> DataFrame:
        m = _pairs(gates, _one(first, p1), second).where(_is("h", second, p2) & F.col("h.next_q1").isNotNull())
        a, b, g, h = F.col("g.prev_q1"), F.col("h.next_q1"), F.col("g.id"), F.col("h.id")
        me = link(g, F.lit(0), F.lit(code))
        retype = F.struct(g.alias("gate"), F.lit(code).cast("short").alias("type"), F.lit(param).cast("float").alias("param"), F.lit(False).alias("flip"))
        return _made(m, [g, h], [link_id(a), link_id(b)], [_edit(g, F.lit("next_q1"), b), _edit(link_id(a), _slot("next", a), me), _edit(link_id(b), _slot("prev", b), me)], [h], retype)

    return Rule(f"fuse {first} {second}", match, rows=fuse_rows(first, second, p1, p2, code, param))


def cancel_two(code: int, param: float) -> Rule:
    """Two equal self-inverse two-qubit gates in a row on both wires, ports alike, vanish."""

    def match(gates: DataFrame) -> DataFrame:
        m = _pairs(gates, _one(code, param) & (link_id("next_q1") == link_id("next_q2")), code).where(_is("h", code, param) & F.expr("g.next_q2 = h.id * 1000 + 100 + h.type and h.prev_q2 = g.id * 1000 + 100 + g.type"))
        g, h = F.col("g.id"), F.col("h.id")
        edits, around = [], []
        for p in (1, 2):
            a, b = F.col(f"g.prev_q{p}"), F.col(f"h.next_q{p}")
            edits += [_edit(link_id(a), _slot("next", a), b), _edit(link_id(b), _slot("prev", b), a)]
            around += [link_id(a), link_id(b)]
        return _made(m, [g, h], around, edits, [g, h])

    return Rule(f"cancel {code} {code}", match, rows=cancel_two_rows(code, param))


def commute(code: int, param: float) -> Rule:
    """A diagonal one-qubit gate before a control moves behind it."""

    def match(gates: DataFrame) -> DataFrame:
        m = _pairs(gates, _one(code, param), *CONTROLLED).where(F.col("h.next_q1").isNotNull())
        a, b, g, h = F.col("g.prev_q1"), F.col("h.next_q1"), F.col("g.id"), F.col("h.id")
        control, single = link(h, F.lit(0), F.col("h.type")), link(g, F.lit(0), F.col("g.type"))
        edits = [_edit(link_id(a), _slot("next", a), control), _edit(h, F.lit("prev_q1"), a), _edit(h, F.lit("next_q1"), single),
                 _edit(g, F.lit("prev_q1"), control), _edit(g, F.lit("next_q1"), b), _edit(link_id(b), _slot("prev", b), single)]
        return _made(m, [g, h], [link_id(a), link_id(b)], edits, [])

    return Rule(f"commute {code}", match, rows=commute_rows(code, param))


def reverse_cx() -> Rule:
    """A controlled NOT between four H's is turned round and the H's vanish."""

    def match(gates: DataFrame) -> DataFrame:
        # the four neighbours' types are in the links: only real matches are joined
        seen = gates.where(F.col("type").isin(15, CX) & (link_type("prev_q1") == H) & (link_type("prev_q2") == H) & (link_type("next_q1") == H) & (link_type("next_q2") == H))
        m = seen.select(F.col("id").alias("cx"), F.col("type").alias("code"), F.col("param").alias("p"), *[link_id(c).alias(c) for c in ("prev_q1", "prev_q2", "next_q1", "next_q2")])
        h = gates.where(_one_h())
        for c in ("prev_q1", "prev_q2", "next_q1", "next_q2"):
            outer = "prev_q1" if c.startswith("prev") else "next_q1"
            m = m.join(h.select(F.col("id").alias(c), F.col(outer).alias(f"out_{c}")), c)
        me, cx = lambda p: link("cx", F.lit(p), "code"), F.col("cx")
        l1, l2, r1, r2 = (F.col(f"out_{c}") for c in ("prev_q1", "prev_q2", "next_q1", "next_q2"))
        edits = [_edit(link_id(l1), _slot("next", l1), me(1)), _edit(link_id(l2), _slot("next", l2), me(0)), _edit(link_id(r1), _slot("prev", r1), me(1)), _edit(link_id(r2), _slot("prev", r2), me(0)),
                 _edit(cx, F.lit("prev_q1"), l2), _edit(cx, F.lit("prev_q2"), l1), _edit(cx, F.lit("next_q1"), r2), _edit(cx, F.lit("next_q2"), r1)]
        hs = [F.col(c) for c in ("prev_q1", "prev_q2", "next_q1", "next_q2")]
        retype = F.struct(cx.alias("gate"), F.col("code").cast("short").alias("type"), F.col("p").cast("float").alias("param"), F.lit(True).alias("flip"))
        return _made(m, [cx, *hs], [link_id(x) for x in (l1, l2, r1, r2)], edits, hs, retype)

    return Rule("reverse cx", match, 2, reverse_rows())


def _one_h() -> Column:
    return (F.col("type") == H) & (F.col("param") == F.lit(1.0).cast("float")) & F.col("prev_q1").isNotNull() & F.col("next_q1").isNotNull()


STANDARD_RULES = (cancel_one(H, H, 1.0, 1.0), cancel_one(T, T_DAG, 0.0, 0.0), cancel_one(T_DAG, T, 0.0, 0.0), cancel_one(S, S_DAG, 0.0, 0.0), cancel_one(S_DAG, S, 0.0, 0.0), cancel_two(CX, 1.0), reverse_cx(), fuse(T, T, 0.0, 0.0, S, 0.0))


def judged(matches: DataFrame, turn: int) -> DataFrame:
    """Matches with ``wins``: of those that win none conflicts with another, and the one of smallest priority wins."""
    ranked = matches.withColumn("prio", F.struct(F.xxhash64("match", F.lit(turn)).alias("h"), "match"))
    touched = ranked.select("prio", F.explode(F.concat(F.transform("core", lambda g: F.struct(g.alias("gate"), F.lit(True).alias("own"))), F.transform("boundary", lambda g: F.struct(g.alias("gate"), F.lit(False).alias("own"))))).alias("x")).select("prio", "x.*")
    around = W.partitionBy("gate")  # a gate is in few matches
    held = touched.withColumn("any", F.min("prio").over(around)).withColumn("core", F.min(F.when(F.col("own"), F.col("prio"))).over(around))
    free = F.when(F.col("own"), F.col("prio") == F.col("any")).otherwise(F.col("core").isNull() | (F.col("prio") <= F.col("core")))
    return ranked.join(held.groupBy("prio").agg(F.min(free).alias("wins")), "prio").drop("prio")


def applied(gates: DataFrame, kept: DataFrame) -> DataFrame:
    """The table after the edits, retypings and deletions of independent matches."""
    edits = kept.select(F.explode("edits").alias("e")).select("e.*")
    pivot = edits.groupBy("gate").agg(*[F.max(F.when(F.col("slot") == s, F.col("link"))).alias(f"new_{s}") for s in SIDES])
    retyped = kept.where("retype is not null").select("retype.*").select(F.col("gate").alias("rgate"), F.col("type").alias("new_type"), F.col("param").alias("new_param"), "flip")
    gone = kept.select(F.explode("deletes").alias("id"))
    rest = gates.join(gone, "id", "left_anti").join(pivot, F.col("id") == F.col("gate"), "left").join(retyped, F.col("id") == F.col("rgate"), "left")
    changed = {s: F.coalesce(f"new_{s}", s) for s in SIDES} | {"type": F.coalesce("new_type", "type"), "param": F.coalesce("new_param", "param"), "switch": F.when(F.coalesce("flip", F.lit(False)), ~F.col("switch")).otherwise(F.col("switch"))}
    return rest.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in gates.columns])


class Versions:
    """A gate table as a base table and one smaller table of the rows that changed since, each with its version; a changed row counts instead of the base's.

    When the changes have a quarter of the base's rows, all is written as a new base. Which ids
    changed when is kept. A table of up to FEW gates is read faster than its changes are sorted
    out: it is matched whole and written anew in every round."""

    FEW = 1_000_000

    def __init__(self, gates: DataFrame, staged: Callable[[DataFrame], DataFrame]):
        self.staged, self.base, self.own, self.columns = staged, gates, False, gates.columns
        self.delta: DataFrame | None = None
        self.log: DataFrame | None = None
        self.version, self.size = 0, None

    @property
    def small(self) -> bool:
        if self.size is None:
            self.size = self.base.count()
        return self.size <= self.FEW

    def current(self) -> DataFrame:
        """The table as it is now."""
        if self.delta is None:
            return self.base
        return self.base.join(self.delta.select("id"), "id", "left_anti").select(*self.columns).unionByName(self.delta.where("not gone").select(*self.columns))

    def rows(self, ids: DataFrame) -> DataFrame:
        return self.current().join(ids, "id", "left_semi")

    def around(self, ids: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
        """(the rows of ``ids`` and of all within ``radius`` links of them, the table of their ids)."""
        for k in range(radius):
            out = self.rows(ids)
            near = out.select(F.explode(F.array_append(F.array_compact(F.array(*[link_id(c) for c in SIDES])), F.col("id"))).alias("id")).distinct()
            wider = self.staged(near)
            if k:
                unstage(ids)
            ids = wider
        return self.rows(ids), ids

    def apply(self, kept: DataFrame) -> DataFrame | None:
        """Apply independent matches and return the ids (id) of the rows that changed; none for a small table, which is matched whole again."""
        self.version += 1
        if self.small:
            after = self.staged(applied(self.base, kept))
            unstage(*([self.base] if self.own else []))
            self.base, self.own = after, True
            return None
        gone = kept.select(F.explode("deletes").alias("id")).distinct()
        met = kept.select(F.explode("edits").alias("e")).select(F.col("e.gate").alias("id")).unionByName(kept.where("retype is not null").select(F.col("retype.gate").alias("id"))).distinct()
        after = applied(self.rows(met), kept).withColumn("gone", F.lit(False))
        none = [F.col("id") if c == "id" else F.lit(None).cast(k).alias(c) for c, k in after.dtypes if c != "gone"]
        every = after.unionByName(gone.select(*none, F.lit(True).alias("gone"))).withColumn("version", F.lit(self.version))
        before = self.delta
        if before is not None:
            every = every.unionByName(before.join(met.unionByName(gone), "id", "left_anti"))
        self.delta = self.staged(every)
        if before is not None:
            unstage(before)
        if self.delta.count() > self.size // 4:
            self._rebase()
        return self.since(self.version - 1)

    def _changes(self) -> DataFrame:
        """(id, version) of all rows that were changed, gone ones too; an id may come twice."""
        parts = [x.select("id", "version") for x in (self.delta, self.log) if x is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _rebase(self) -> None:
        base, log = self.staged(self.current()), self.staged(self._changes().groupBy("id").agg(F.max("version").alias("version")))
        unstage(self.delta, *([self.base] if self.own else []), *([self.log] if self.log is not None else []))
        self.base, self.log, self.own, self.delta = base, log, True, None

    def since(self, version: int) -> DataFrame:
        """The ids (id) that changed after a version."""
        return self._changes().where(F.col("version") > version).select("id").distinct()

    def table(self) -> DataFrame:
        """The table as it is now, as one written table; what it was made of is deleted."""
        if self.delta is not None:
            self._rebase()
        return self.base


def _ends(seconds: float | None) -> float | None:
    return None if seconds is None else time.monotonic() + seconds


def _fix(gates: Versions, rule: Rule, near: DataFrame | None, rounds: int | None, ends: float | None) -> tuple[int, bool]:
    """Apply a rule near the ids ``near`` (or everywhere) until it matches nothing; the number of rewrites, and whether it came to its end."""
    done, turn, held = 0, 0, []
    while (rounds is None or turn < rounds) and (ends is None or time.monotonic() < ends):
        part, ids = (gates.current(), None) if near is None else gates.around(near, rule.radius)
        found = gates.staged(judged(rule.match(part), turn))
        kept = found.where("wins")
        n = kept.count()
        unstage(*([ids] if ids is not None else []))
        if not n:
            unstage(found)
            return done, True
        changed = gates.apply(kept)
        near = None if changed is None else changed.unionByName(found.where("not wins").select(F.explode("core").alias("id"))).distinct()
        unstage(*held)
        held = [found]  # the next round reads who lost in this one
        done, turn = done + n, turn + 1
    return done, False


def to_fixpoint(gates: DataFrame, rule: Rule, staged: Callable[[DataFrame], DataFrame], rounds: int | None = None, seconds: float | None = None) -> tuple[DataFrame, int]:
    """Apply a rule until it matches nothing; the table and the number of rewrites. With a bound, in so many rounds or for so long (the clock is read between rounds)."""
    found = by_blocks(gates, [rule], staged) if rounds is None and seconds is None else None
    if found:
        return found.table, sum(found.rewrites.values())
    own = Versions(gates, staged)
    done, _ = _fix(own, rule, None, rounds, _ends(seconds))
    return own.table(), done


def counts_at_fixpoint(gates: DataFrame, rule: Rule, staged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of counts after :func:`to_fixpoint`, without the table where blocks count what came and went."""
    found = by_blocks(gates, [rule], staged, rows=False)
    if not found:
        return stats(to_fixpoint(gates, rule, staged)[0])
    more = found.changes.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"d_{name}") for name, c in classes().items()])
    return stats(gates).join(F.broadcast(more)).select(*[(F.col(name) + F.col(f"d_{name}")).cast("bigint").alias(name) for name in classes()])


def _passes(own: Versions, rules, passes: int | None, ends: float | None):
    """Pass after pass of all rules: (pass, rule, rewrites), until a pass rewrites nothing. A rule looks only near what changed since it last matched nothing."""
    turn, done, seen = 0, 1, [None] * len(rules)
    while done and (passes is None or turn < passes) and (ends is None or time.monotonic() < ends):
        done = 0
        for i, rule in enumerate(rules):
            if seen[i] == own.version:
                yield turn, rule, 0
                continue
            n, whole = _fix(own, rule, None if seen[i] is None or own.small else own.since(seen[i]), None, ends)
            seen[i] = own.version if whole else None
            done += n
            yield turn, rule, n
        turn += 1


def optimise(gates: DataFrame, rules, staged: Callable[[DataFrame], DataFrame], passes: int | None = None, seconds: float | None = None) -> DataFrame:
    """The rules in order, each to its fixpoint, pass after pass until one rewrites nothing (or for so many passes, or so long).

    What a rule removes may bring others' patterns together, so one pass is not enough. Rules
    that undo each other need ``passes`` or ``seconds``."""
    found = by_blocks(gates, rules, staged) if passes is None and seconds is None else None
    if found:
        return found.table
    own = Versions(gates, staged)
    for _ in _passes(own, rules, passes, _ends(seconds)):
        pass
    return own.table()


def series(gates: DataFrame, rules, staged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(step, pass, rule, rewrites, counts...): the counts at the start (step 0) and after every rule of :func:`optimise`, until a pass rewrites nothing."""
    spark = gates.sparkSession
    found = by_blocks(gates, rules, staged, rows=False)
    if found:
        # a row for every step: the counts at the start and all that changed until then
        turns = (max((s for s, n in found.rewrites.items() if n), default=-1) // len(rules) + 2) * len(rules)
        steps = spark.createDataFrame([(0, None, "start", 0)] + [(s + 1, s // len(rules), rules[s % len(rules)].name, found.rewrites.get(s, 0)) for s in range(turns)], "step int, pass int, rule string, rewrites long")
        more = found.changes.groupBy((F.col("step") + 1).alias("step")).agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"d_{name}") for name, c in classes().items()])
        upto = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = steps.join(more, "step", "left").join(F.broadcast(stats(gates)))
        return rows.select("step", "pass", "rule", "rewrites", *[(F.col(name) + F.sum(F.coalesce(f"d_{name}", F.lit(0))).over(upto)).cast("bigint").alias(name) for name in classes()])
    own = Versions(gates, staged)
    log, last = [(0, None, "start", 0)], staged(stats(gates))
    rows = [last.withColumn("step", F.lit(0))]
    for step, (turn, rule, n) in enumerate(_passes(own, rules, None, None), 1):
        log.append((step, turn, rule.name, n))
        last = staged(stats(own.current())) if n else last
        rows.append(last.withColumn("step", F.lit(step)))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return spark.createDataFrame(log, "step int, pass int, rule string, rewrites long").join(every, "step")
