"""Bounded clusters of gates ("widgets"): constrained union-find within each batch of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.operators.gates import is_t_like
from wireflow.plans.staging import ship_code

MAX_T, MAX_DEPTH = 5, 10
SCHEMA = "batch long, node long, widget long, t long, depth long, code string"


def united(edges, max_t: int, max_depth: int) -> tuple[list, list]:
    """Unite the ends of a batch's edges (source, target, source_t, target_t) in order unless the sums of T gates or of gates ("depth") would pass a bound.

    The root with the larger depth absorbs the other (the first of equals). [(node, widget, t, depth)], and each edge's outcome."""
    root: dict[int, int] = {}
    t: dict[int, int] = {}
    depth: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    codes = []
    for a, b, ta, tb in edges:
        for x, own in ((a, ta), (b, tb)):
            if x not in root:
                root[x], t[x], depth[x] = x, own, 1
        p, q = find(a), find(b)
        if p == q:
            codes.append("EXIST")
        elif t[p] + t[q] > max_t:
            codes.append("TCOUNT")
        elif depth[p] + depth[q] > max_depth:
            codes.append("DEPTH")
        else:
            if depth[p] < depth[q]:
                p, q = q, p
            root[q] = p
            t[p] += t[q]
            depth[p] += depth[q]
            codes.append("OK")
    return [(x, r := find(x), t[r], depth[r]) for x in root], codes


def clusters(max_t: int, max_depth: int):
    """The clusters of sorted batches, many to a task and one at a time: one row for each node (code null) and one for each edge's outcome (node null)."""
    names = ["batch", "node", "widget", "t", "depth", "code"]

    def rows(number: int, edges: list) -> list:
        nodes, codes = united(edges, max_t, max_depth)
        return [(number, *n, None) for n in nodes] + [(number, None, None, None, None, c) for c in codes]

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("node", "widget", "t", "depth")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, edges = None, []
        for part in frames:
            out = []
            for batch, *edge in zip(*(part[c].tolist() for c in ("batch", "source", "target", "source_t", "target_t")), strict=True):
                if batch != number:
                    out += rows(number, edges) if edges else []
                    number, edges = batch, []
                edges.append(edge)
            yield frame(out)
        if edges:
            yield frame(rows(number, edges))

    return run


def _clustered(batches: DataFrame, gates: DataFrame, max_t: int, max_depth: int) -> DataFrame:
    """Edges to the global gates are left out; a batch has a fixed number of edges, and a task goes through its batches in their order."""
    ship_code(gates.sparkSession)
    kind = gates.select(F.col("id"), F.coalesce(is_t_like(), F.lit(False)).cast("int").alias("t"))
    own = batches.where("source >= 0 and target >= 0")
    own = own.join(kind.select(F.col("id").alias("source"), F.col("t").alias("source_t")), "source").join(kind.select(F.col("id").alias("target"), F.col("t").alias("target_t")), "target")
    dealt = own.select("batch", "source", "target", "source_t", "target_t").repartition("batch").sortWithinPartitions("batch", "source", "target")
    return dealt.mapInPandas(clusters(max_t, max_depth), SCHEMA)


def widgets(batches: DataFrame, gates: DataFrame, max_t: int = MAX_T, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(batch, node, widget, t, depth)."""
    return _clustered(batches, gates, max_t, max_depth).where("code is null").drop("code")


def union_codes(batches: DataFrame, gates: DataFrame, max_t: int = MAX_T, max_depth: int = MAX_DEPTH) -> DataFrame:
    return _clustered(batches, gates, max_t, max_depth).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def widget_stats(members: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Number of widgets, their mean depth and T count, and how many have the full depth."""
    own = members.groupBy("batch", "widget").agg(F.first("t").alias("t"), F.first("depth").alias("depth"))
    return own.agg(F.count(F.lit(1)).alias("widgets"), F.avg("depth").alias("mean_depth"), F.avg("t").alias("mean_t"), F.count_if(F.col("depth") == max_depth).cast("bigint").alias("full"))


def widget_gates(members: DataFrame, gates: DataFrame) -> DataFrame:
    """The gates of every widget: (batch, widget) and the columns of the gate table."""
    return members.select("batch", "widget", F.col("node").alias("id")).join(gates, "id")


def widget_inputs(members: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, widget, source, target): edges that enter a widget from outside it (another widget, another batch or a global gate)."""
    own = members.select("batch", "widget", F.col("node").alias("target"))
    other = members.select("batch", F.col("widget").alias("from"), F.col("node").alias("source"))
    into = batches.join(own, ["batch", "target"]).join(other, ["batch", "source"], "left")
    return into.where(F.col("from").isNull() | (F.col("from") != F.col("widget"))).select("batch", "widget", "source", "target")
