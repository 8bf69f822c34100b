"""Rules to their fixpoint by blocks of ids, pass by pass and rule by rule, without rounds over the whole table.

Gates are dealt to blocks of neighbouring ids, each with a margin of its neighbours' gates, and a task
takes a block through all steps (a step is a rule of a pass). Blocks on both sides of a cut rewrite
the gates around it; what is wrong at the outer ends of the margins, where gates outside the block
are not seen, dies out before it comes to the cut. That is checked, not assumed: both write down, in
order, all that was done to the gates that had a link over the cut at any time. If they agree at
every cut, the left sides' histories and the right sides' are one history of the whole table, in
which every step ends when its rule matches nothing. Else wider margins are tried, and at last none
is returned."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.plans.running import chunk_of
from wireflow.plans.staging import ship_code, unstage

WIDTH = 1 << 17
#: A margin's share of a block, in the order in which they are tried.
MARGINS = (8, 2)
SLOTS = [f"{s}_q{p}" for s in ("prev", "next") for p in (1, 2, 3)]


class Rewritten(NamedTuple):
    #: none if only the counts were asked for
    table: DataFrame | None
    #: {step: rewrites}, a step being pass * number of rules + rule
    rewrites: dict[int, int]
    #: (step, type, param, n): gates of a type that came (or, below zero, went)
    changes: DataFrame


class Plain:
    """A rule's rows, its gates numbered, for use within a task."""

    def __init__(self, rows: tuple):
        gates, links, fates, edits = rows
        at = {g[1]: i for i, g in enumerate(gates)}
        slot = lambda side, port: 3 * (side == "next") + port
        self.types = [frozenset(g[2]) for g in gates]
        self.params = [None if g[3] is None else float(np.float32(g[3])) for g in gates]
        self.any = frozenset().union(*self.types)
        #: for a first gate, the links in the order in which the others are reached: (from, slot, to, slot back)
        self.ways = []
        ends = [(at[g], 3 + p, at[h], q) for _, g, p, h, q in links]
        for first in range(len(gates)):
            known, rest, way = {first}, list(ends), []
            while rest:
                e = next((e for e in rest if e[0] in known or e[2] in known), None)
                if e is None:
                    raise ValueError(f"rule {gates[0][0]}: its gates are not linked to each other")
                rest.remove(e)
                way.append(e if e[0] in known else (e[2], e[3], e[0], e[1]))
                known |= {e[0], e[2]}
            self.ways.append(way)
        self.fates = [(at[g], goes, kind, None if param is None else float(np.float32(param)), flip) for _, g, goes, kind, param, flip in fates]
        self.edits = [(b1, at[g1], slot(s1, p1), b2, at[g2], slot(s2, p2), p2) for _, b1, g1, s1, p1, b2, g2, s2, p2 in edits]
        self.beyond = sorted({(g, s) for b1, g1, s1, b2, g2, s2, _ in self.edits for b, g, s in ((b1, g1, s1), (b2, g2, s2)) if b})
        new = {g: kind for g, goes, kind, *_ in self.fates if not goes and kind is not None}
        self.kinds = [new.get(i) for i in range(len(gates))]


class Block:
    """The gates of a block and its margins as lists (a missing link is -1); its own are those from ``first`` to before ``upto``, its cuts."""

    def __init__(self, ids, types, params, links, first: int, upto: int):
        self.ids, self.types, self.params, self.links, self.first, self.upto = ids, types, params, links, first, upto
        self.at = {g: i for i, g in enumerate(ids)}
        self.alive, self.flipped, self.log = [True] * len(ids), set(), []
        #: what was done: (step, gate, slot or "gone", "type", "param", "flip", to what)
        self.events: list[tuple] = []
        self.rewrites: dict[int, int] = {}
        self.changes: dict[tuple, int] = {}

    def match(self, rule: Plain, start: int, i: int) -> list | None:
        """The gates of a match with gate i in the place ``start``, of which all and all around them are in the block."""
        param = rule.params[start]
        if self.types[i] not in rule.types[start] or (param is not None and self.params[i] != param):
            return None
        links, at = self.links, self.at
        bound = [-1] * len(rule.types)
        bound[start] = i
        for a, slot, b, back in rule.ways[start]:
            to = links[slot][bound[a]]
            if to < 0 or to % 100 not in rule.types[b] or to // 100 % 10 != back % 3:
                return None
            h = at.get(to // 1000)
            if h is None:
                return None
            if bound[b] == h:
                continue
            param = rule.params[b]
            if bound[b] >= 0 or h in bound or (param is not None and self.params[h] != param):
                return None
            bound[b] = h
        for g, slot in rule.beyond:
            to = links[slot][bound[g]]
            if to < 0 or to // 1000 not in at:
                return None
        return bound

    def apply(self, rule: Plain, bound: list, step: int) -> None:
        links, at, events, own = self.links, self.at, [], self.first <= self.ids[bound[0]] < self.upto
        for b1, g1, s1, b2, g2, s2, port in rule.edits:
            if b1:
                to = links[s1][bound[g1]]
                where, slot = at[to // 1000], (3 if s1 < 3 else 0) + to // 100 % 10
            else:
                where, slot = bound[g1], s1
            if b2:
                to = links[s2][bound[g2]]
            else:
                kind = rule.kinds[g2]
                to = self.ids[bound[g2]] * 1000 + port * 100 + (self.types[bound[g2]] if kind is None else kind)
            events.append((step, where, slot, to))
        for _, where, slot, to in events:
            links[slot][where] = to
            self.log.append(where)
        for g, goes, kind, param, flip in rule.fates:
            i = bound[g]
            before = self.types[i], self.params[i]
            if goes:
                self.alive[i] = False
                events.append((step, i, "gone", None))
            else:
                self.types[i] = before[0] if kind is None else kind
                self.params[i] = before[1] if param is None else param
                if flip:
                    self.flipped ^= {i}
                events.append((step, i, "kept", (kind, param, flip)))
                self.log.append(i)
            if own:
                self._count(step, *before, -1)
                if not goes:
                    self._count(step, self.types[i], self.params[i], 1)
        self.events += events
        if own:
            self.rewrites[step] = self.rewrites.get(step, 0) + 1

    def _count(self, step: int, kind: int, param: float, n: int) -> None:
        key = step, kind, param
        self.changes[key] = self.changes.get(key, 0) + n

    def step(self, rule: Plain, step: int, todo, starts) -> None:
        """Apply a rule near the gates ``todo`` until it matches nothing."""
        types, alive, every = self.types, self.alive, range(len(rule.types))
        while todo:
            mark = len(self.log)
            for i in todo:
                if alive[i] and types[i] in rule.any:
                    for start in starts:
                        bound = self.match(rule, start, i)
                        if bound:
                            self.apply(rule, bound, step)
                            break
            todo, starts = sorted(set(self.log[mark:])), every

    def run(self, rules: list[Plain]) -> None:
        """All passes, until one changes nothing. A rule looks only near what changed since it last matched nothing."""
        seen, turn, before = [None] * len(rules), 0, -1
        while before < len(self.log):
            before = len(self.log)
            for k, rule in enumerate(rules):
                first = seen[k] is None
                # every match has a gate in the first place
                self.step(rule, turn * len(rules) + k, range(len(self.ids)) if first else sorted(set(self.log[seen[k]:])), (0,) if first else range(len(rule.types)))
                seen[k] = len(self.log)
            turn += 1

    def crossing(self, cut: int, links: list[np.ndarray]) -> tuple[str, bool]:
        """A digest of all that was done to the gates that had a link over a cut at any time (``links`` are those at first), and whether all of them are here."""
        ids = np.array(self.ids, dtype=np.int64)
        over: set[int] = set()
        for column in links:
            to = column // 1000
            found = (column >= 0) & ((to < cut) != (ids < cut))
            over.update(ids[found].tolist())
            over.update(to[found].tolist())
        for _, i, slot, to in self.events:
            if type(slot) is int and to >= 0 and (to // 1000 < cut) != (self.ids[i] < cut):
                over.update((self.ids[i], to // 1000))
        out = hashlib.sha256(repr(sorted(over)).encode())
        for step, i, slot, to in self.events:
            if self.ids[i] in over:
                out.update(repr((step, self.ids[i], slot, to)).encode())
        return out.hexdigest(), all(g in self.at for g in over)


def _in_block(rules: list[Plain], width: int, blocks: int, columns: list[str] | None):
    """A block's gates after the rules (``columns`` of them; no rows if none), what was done in each step (``step``, ``n``; changes have a type) and the digests of its cuts (``cut``)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        own = table.column("block")[0].as_py()
        first, upto = own * width if own else -(1 << 62), (own + 1) * width if own + 1 < blocks else 1 << 62
        links = [table.column(c).fill_null(-1).to_numpy() for c in SLOTS]
        params = table.column("param").to_numpy()
        ids = table.column("id").to_numpy()
        b = Block(ids.tolist(), table.column("type").to_numpy().tolist(), params.tolist(), [c.tolist() for c in links], first, upto)
        b.run(rules)
        cuts = [(own + k, *b.crossing((own + k) * width, links)) for k in (0, 1) if 0 < own + k < blocks]
        done = [(s, None, None, n, None, None, None) for s, n in b.rewrites.items()] + [(*k, n, None, None, None) for k, n in b.changes.items()] + [(None, None, None, None, *c) for c in cuts]
        told = dict(zip(("step", "type", "param", "n", "cut", "digest", "sound"), zip(*done, strict=True), strict=True)) if done else {}
        kinds = dict(step=pa.int32(), n=pa.int64(), cut=pa.int64(), digest=pa.string(), sound=pa.bool_())
        named = dict(type=pa.int16(), param=pa.float32()) if columns is None else {f.name: f.type for f in table.select(columns).schema}
        schema = pa.schema([pa.field(c, k) for c, k in (named | kinds).items()])
        log = pa.table({f.name: pa.array(told[f.name], f.type) if f.name in told else pa.nulls(len(done), f.type) for f in schema}, schema)
        if columns is None:
            return log
        new = {c: pa.array(x := np.array(v, dtype=np.int64), mask=x < 0) for c, v in zip(SLOTS, b.links, strict=True)}
        new["type"] = pa.array(np.array(b.types, dtype=np.int16))
        after = np.array(b.params, dtype=np.float32)
        new["param"] = pa.array(after, mask=table.column("param").is_null().to_numpy() & np.isnan(after))
        switch = table.column("switch").to_pylist()
        for i in b.flipped:
            switch[i] = None if switch[i] is None else not switch[i]
        new["switch"] = pa.array(switch, pa.bool_())
        kept = pa.array(np.array(b.alive, dtype=bool) & (ids >= first) & (ids < upto))
        gates = pa.table({c: new.get(c, table.column(c)) for c in columns}).filter(kept)
        rows = pa.table({f.name: gates.column(f.name).cast(f.type) if f.name in columns else pa.nulls(len(gates), f.type) for f in schema}, schema)
        return pa.concat_tables([rows, log])

    return run


def by_blocks(gates: DataFrame, rules, staged: Callable[[DataFrame], DataFrame], width: int | None = None, rows: bool = True) -> Rewritten | None:
    """The rules in order, each to its fixpoint, pass after pass until one rewrites nothing; none if a rule is not told as rows or the blocks do not agree at their cuts.

    Without ``rows`` only the counts are made, no table."""
    if any(r.rows is None for r in rules):
        return None
    ship_code(gates.sparkSession)
    width, columns, plain = width or WIDTH, gates.columns, [Plain(r.rows) for r in rules]
    kinds = [(c, k) for c, k in gates.dtypes if rows or c in ("type", "param")]
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds) + ", step int, n long, cut long, digest string, sound boolean"
    top = gates.agg(F.max("id").alias("top")).first().top
    blocks = max(1, ((top or 0) + 1) // width)  # the last one has the rest
    used = gates if rows else gates.select("id", "type", "param", *SLOTS)
    for share in MARGINS:
        margin = width // share
        block = lambda by: F.least(F.greatest(chunk_of("id", width) if not by else F.call_function("div", F.col("id") + by, F.lit(width).cast("bigint")), F.lit(0)), F.lit(blocks - 1)).cast("bigint")
        dealt = used.withColumn("block", F.explode(F.array_distinct(F.array(block(-margin), block(0), block(margin))))).repartition(min(max(8, 2 * blocks), 4096), "block")
        part = staged(dealt.groupBy("block").applyInArrow(_in_block(plain, width, blocks, columns if rows else None), schema))
        cuts = part.where("cut is not null").groupBy("cut").agg(F.bool_and("sound").alias("sound"), F.count_distinct("digest").alias("kinds"))
        if cuts.where("not sound or kinds > 1").isEmpty():
            log = staged(part.where("step is not null").groupBy("step", "type", "param").agg(F.sum("n").alias("n")))
            rewrites = {r.step: r.n for r in log.where("type is null").select("step", "n").collect()}  # a number for each step
            return Rewritten(part.where("step is null and cut is null").select(*columns) if rows else None, rewrites, log.where("type is not null"))
        unstage(part)
        if blocks == 1:
            break
    return None
