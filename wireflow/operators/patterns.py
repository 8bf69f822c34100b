"""Rewrite rules as data: a pattern of gates and links and the edits on a match, as rows, compiled into the engine's rules.

A rule is rows of four relations. Gates and links make the pattern; retypes, deletions and edits
say what becomes of it. An end is a port of a gate of the pattern, or what lies beyond it (the
neighbour that its link leads to). The compiler joins the gates along the links, beginning with
the one of which the table has the fewest, and filters every gate by the types that its links
name before it is joined to anything."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.functions.codec import link, link_id, link_port, link_type
from wireflow.operators.engine import Rule, _made, _slot
from wireflow.operators.rows import cancel_rows, cancel_two_rows, commute_rows, fuse_rows, reverse_rows
from wireflow.schema import CX, H, S, S_DAG, T, T_DAG

#: The relations, all keyed by the rule: a gate may be of several types, and a parameter that is null is not compared.
GATES = "rule string, gate string, types array<int>, param float"
#: The next link of a gate's port leads to a port of another gate.
LINKS = "rule string, gate string, port int, to_gate string, to_port int"
#: What stays of a match: a gate changes its type (null: keeps it), parameter, and switch; or it goes.
FATES = "rule string, gate string, goes boolean, type int, param float, flip boolean"
#: One new link: ``at`` and ``to`` are the gate's own port, or beyond it (the outer neighbour on that side).
EDITS = "rule string, at_beyond boolean, at_gate string, at_side string, at_port int, to_beyond boolean, to_gate string, to_side string, to_port int"


def _side(side: str, port: int) -> str:
    return f"{side}_q{port + 1}"


class Pattern:
    """The rows of one rule."""

    def __init__(self, rule: str, gates, links, fates, edits):
        own = lambda rows: [r for r in rows if r["rule"] == rule]
        self.rows = tuple([tuple(r[c.split(" ")[0]] for c in s.split(", ")) for r in own(rows)] for s, rows in zip((GATES, LINKS, FATES, EDITS), (gates, links, fates, edits), strict=True))
        self.rule, self.links, self.fates, self.edits = rule, own(links), {r["gate"]: r for r in own(fates)}, own(edits)
        self.gates = {r["gate"]: r for r in own(gates)}
        for r in self.links:
            if r["gate"] not in self.gates or r["to_gate"] not in self.gates:
                raise ValueError(f"rule {rule}: a link of a gate that it has not")

    def need(self, name: str) -> Column:
        """What a gate shows by itself: its type and parameter, its neighbours' types by the links, and links where the edits go beyond it."""
        g = self.gates[name]
        out = F.col("type").isin(*g["types"])
        if g["param"] is not None:
            out = out & (F.col("param") == F.lit(g["param"]).cast("float"))
        for r in self.links:
            for mine, port, other, to, side in ((r["gate"], r["port"], r["to_gate"], r["to_port"], "next"), (r["to_gate"], r["to_port"], r["gate"], r["port"], "prev")):
                if mine == name:
                    c = _side(side, port)
                    out = out & link_type(c).isin(*self.gates[other]["types"]) & (link_port(c) == to)
        for e in self.edits:
            for end in ("at", "to"):
                if e[f"{end}_beyond"] and e[f"{end}_gate"] == name:
                    out = out & F.col(_side(e[f"{end}_side"], e[f"{end}_port"])).isNotNull()
        return out

    def order(self, sizes: dict[int, int]) -> list[tuple[str, list]]:
        """[(gate, links to gates before it)]: the rarest gate first, then along the links, the rarest of those that can be reached next."""
        size = lambda n: (sum(sizes.get(t, 0) for t in self.gates[n]["types"]), n)
        found, rest = [], set(self.gates)
        while rest:
            known = {n for n, _ in found}
            near = {n for n in rest for r in self.links if {r["gate"], r["to_gate"]} <= known | {n} and n in (r["gate"], r["to_gate"]) and r["gate"] != r["to_gate"]}
            if found and not near:
                raise ValueError(f"rule {self.rule}: its gates are not linked to each other")
            n = min(near or rest, key=size)
            found.append((n, [r for r in self.links if n in (r["gate"], r["to_gate"]) and {r["gate"], r["to_gate"]} <= known | {n}]))
            rest.remove(n)
        return found

    def matches(self, gates: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """One column of row structs for each gate of the pattern."""
        out = None
        for n, links in self.order(sizes):
            rows = gates.where(self.need(n)).select(F.struct(*gates.columns).alias(n))
            if out is None:
                out = rows
                continue
            met = F.lit(True)
            for r in links:
                a, b = F.col(f"{r['gate']}.{_side('next', r['port'])}"), F.col(f"{r['to_gate']}.{_side('prev', r['to_port'])}")
                met = met & (link_id(a) == F.col(f"{r['to_gate']}.id")) & (link_id(b) == F.col(f"{r['gate']}.id"))
            out = out.join(rows, met)
        return out

    def _end(self, e, end: str) -> tuple[Column, Column, Column]:
        """(gate, slot, link to it) of an end of an edit."""
        n, c = e[f"{end}_gate"], _side(e[f"{end}_side"], e[f"{end}_port"])
        if e[f"{end}_beyond"]:
            to = F.col(f"{n}.{c}")
            return link_id(to), _slot("next" if e[f"{end}_side"] == "prev" else "prev", to), to
        fate = self.fates.get(n)
        kind = F.lit(fate["type"]) if fate and fate["type"] is not None else F.col(f"{n}.type")
        return F.col(f"{n}.id"), F.lit(c), link(F.col(f"{n}.id"), F.lit(e[f"{end}_port"]), kind)

    def compiled(self, sizes: dict[int, int]) -> Rule:
        first = self.order(sizes)[0][0]
        others = sorted(set(self.gates) - {first})
        edits = [(self._end(e, "at"), self._end(e, "to")) for e in self.edits]
        goes = [F.col(f"{n}.id") for n, f in sorted(self.fates.items()) if f["goes"]]
        stays = [f for f in self.fates.values() if not f["goes"]]
        if len(stays) > 1:
            raise ValueError(f"rule {self.rule}: more than one gate is changed")
        retype = None
        if stays:
            f, n = stays[0], stays[0]["gate"]
            kind, param = (F.lit(f[c]) if f[c] is not None else F.col(f"{n}.{c}") for c in ("type", "param"))
            retype = F.struct(F.col(f"{n}.id").alias("gate"), kind.cast("short").alias("type"), param.cast("float").alias("param"), F.lit(bool(f["flip"])).alias("flip"))

        def match(gates: DataFrame) -> DataFrame:
            m = self.matches(gates, sizes)
            ids = [F.col(f"{n}.id") for n in (first, *others)]
            different = F.size(F.array_distinct(F.array(*ids))) == len(ids)
            boundary = [a[0] for e, (a, _) in zip(self.edits, edits, strict=True) if e["at_beyond"]]
            made = [F.struct(a[0].cast("bigint").alias("gate"), a[1].alias("slot"), b[2].cast("bigint").alias("link")) for a, b in edits]
            return _made(m.where(different), ids, boundary, made, goes, retype)

        return Rule(self.rule, match, max(1, len(self.gates) - 1) if len(self.gates) < 4 else 2, self.rows)


def type_counts(gates: DataFrame) -> dict[int, int]:
    """How many gates the table has of each type (32 types at most)."""
    return {r.type: r["count"] for r in gates.groupBy("type").count().collect()}


def compiled(gates: DataFrame, links: DataFrame, fates: DataFrame, edits: DataFrame, sizes: dict[int, int]) -> list[Rule]:
    """The rules of the relations in the order of their names; a rule's rows are a handful, so the relations are read by the driver."""
    rows = [[r.asDict() for r in df.collect()] for df in (gates, links, fates, edits)]
    return [Pattern(name, *rows).compiled(sizes) for name in sorted({r["rule"] for r in rows[0]})]


# the standard rules as rows


def standard_rows(spark: SparkSession, *more: tuple[list, list, list, list]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The relations of the engine's standard rules, commutation of T, and of further rules."""
    parts = [cancel_rows(H, H, 1.0, 1.0), cancel_rows(T, T_DAG, 0.0, 0.0), cancel_rows(T_DAG, T, 0.0, 0.0), cancel_rows(S, S_DAG, 0.0, 0.0), cancel_rows(S_DAG, S, 0.0, 0.0),
             cancel_two_rows(CX, 1.0), reverse_rows(), fuse_rows(T, T, 0.0, 0.0, S, 0.0), commute_rows(T, 0.0), *more]
    return tuple(spark.createDataFrame(_flat(p[i] for p in parts), schema) for i, schema in enumerate((GATES, LINKS, FATES, EDITS)))


def _flat(lists: Iterable[list]) -> list:
    return [x for rows in lists for x in rows]
