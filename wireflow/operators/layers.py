"""Layers (the earliest moment of every operation) and layered export."""

from __future__ import annotations

from collections.abc import Callable
from math import floor, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.plans.staging import ship_code
from wireflow.schema import CCX, GATES, T, T_DAG, ZPOW

#: Qubits up to which a chunk's longest paths are a matrix over all qubits, and operations of a chunk beyond; both bound a task's memory.
DENSE_QUBITS, SMALL_CHUNK, CHUNKS = 2048, 1 << 10, (1 << 14, 1 << 20)
#: Operations of a chunk up to which longer chunks are taken so that fewer paths are joined.
MOST_JOINED = 1 << 18
#: Fixed values of the cost model: T gates of a rotation to precision e are 3.02 log2(1/e) + 0.77.
T_SLOPE, T_OFFSET, CCX_COST = 3.02, 0.77, 7


def _summary(batch: pd.DataFrame) -> pd.DataFrame:
    """The longest paths through a chunk, from each touched qubit to each: (chunk, source, target, length)."""
    rows = batch.sort_values("op_id")
    names, places = np.unique(np.concatenate([np.asarray(q) for q in rows["qubits"]]), return_inverse=True)
    far = np.full((len(names), len(names)), -1, np.int32)
    np.fill_diagonal(far, 0)
    at = 0
    for q in rows["qubits"]:
        own = places[at : at + len(q)]
        at += len(q)
        most = far[own].max(axis=0)
        far[own] = np.where(most < 0, -1, most + 1)
    target, source = np.nonzero(far >= 0)
    return pd.DataFrame({"chunk": int(rows["chunk"].iloc[0]), "source": names[source], "target": names[target], "length": far[target, source].astype(np.int64)})


def _joined(paths: DataFrame) -> DataFrame:
    """Paths through pairs of neighbouring chunks (2k, 2k + 1): the longest by way of any qubit; what the second leaves alone stays."""
    pair = F.floor(F.col("chunk") / 2).cast("bigint").alias("pair")
    first = paths.where("chunk % 2 = 0").select(pair, F.col("source").alias("from"), F.col("target").alias("mid"), F.col("length").alias("before"))
    second = paths.where("chunk % 2 = 1").select(pair, F.col("source").alias("mid"), "target", "length")
    through = second.join(first, ["pair", "mid"], "left").select("pair", F.coalesce("from", "mid").alias("source"), "target", (F.col("length") + F.coalesce("before", F.lit(0))).alias("length"))
    touched = second.select("pair", F.col("target").alias("mid")).distinct()
    rest = first.join(touched, ["pair", "mid"], "left_anti").select("pair", F.col("from").alias("source"), F.col("mid").alias("target"), F.col("before").alias("length"))
    return through.unionByName(rest).groupBy("pair", "source", "target").agg(F.max("length").alias("length")).withColumnRenamed("pair", "chunk")


def _halved(starts: DataFrame, paths: DataFrame) -> DataFrame:
    """(chunk, qubit, layer) at the start of every chunk from those (chunk, qubit, layer) at the start of its pair."""
    pair = F.floor(F.col("chunk") / 2).cast("bigint").alias("pair")
    start = starts.withColumnRenamed("chunk", "pair")
    moved = paths.where("chunk % 2 = 0").select(pair, F.col("source").alias("qubit"), "target", "length").join(start, ["pair", "qubit"]).groupBy("pair", "target").agg(F.max(F.col("layer") + F.col("length")).alias("later"))
    after = start.join(moved.withColumnRenamed("target", "qubit"), ["pair", "qubit"], "left").select((F.col("pair") * 2 + 1).alias("chunk"), "qubit", F.coalesce("later", "layer").alias("layer"))
    both = start.select((F.col("pair") * 2).alias("chunk"), "qubit", "layer").unionByName(after)
    return both.join(paths.select("chunk", F.col("target").alias("qubit")).distinct(), ["chunk", "qubit"], "left_semi")


def _placed(key, ops: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    layer = dict(zip(starts["qubit"], starts["layer"], strict=True))
    rows = ops.sort_values("op_id")
    out = []
    for q in rows["qubits"]:
        at = 1 + max(layer.get(x, 0) for x in q)
        for x in q:
            layer[x] = at
        out.append(at)
    return rows.drop(columns="chunk").assign(layer=out)


def layered(ops: DataFrame, staged: Callable[[DataFrame], DataFrame], chunk: int | None = None) -> DataFrame:
    """ops(op_id, type, param, qubits) with ``layer``: one more than the last layer of its qubits (inputs are layer 0).

    Chunks are summarised apart as longest paths between their qubits. A tree of joins adds up
    the paths of neighbouring chunks, as many rounds as the number of chunks has binary digits;
    down the same tree the layers at the start of each chunk are handed on, and the chunks are
    scanned apart, each from its start. No task sees more than its chunk."""
    ship_code(ops.sparkSession)
    rows = ops.select("op_id", "type", F.col("param").cast("double").alias("param"), "qubits")
    if chunk is None:
        n = rows.select(F.explode("qubits").alias("q")).distinct().count()
        # a pair of chunks is joined through up to n^3 paths: about one for each operation, as far as a task's memory allows
        chunk = min(max(CHUNKS[0], n * n // 4, min(n**3, MOST_JOINED)), CHUNKS[1]) if n <= DENSE_QUBITS else SMALL_CHUNK
    rows = rows.withColumn("chunk", F.floor(F.col("op_id") / chunk).cast("bigint"))
    last = rows.agg(F.max("chunk")).first()[0]
    tree = [staged(rows.groupBy("chunk").applyInPandas(_summary, "chunk long, source long, target long, length long"))]
    while (last or 0) >> (len(tree) - 1):
        tree.append(staged(_joined(tree[-1])))
    starts = tree[-1].select("chunk", F.col("target").alias("qubit")).distinct().withColumn("layer", F.lit(0).cast("bigint"))
    for paths in tree[-2::-1]:
        starts = staged(_halved(starts, paths))
    return rows.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInPandas(_placed, "op_id long, type short, param double, qubits array<long>, layer long")


def layer_rows(placed: DataFrame) -> DataFrame:
    """(id, control_q, target_q, type, param, layer); one-qubit operations have no target."""
    return placed.select(F.col("op_id").alias("id"), F.element_at("qubits", 1).alias("control_q"), F.try_element_at("qubits", F.lit(2)).alias("target_q"), F.col("type").cast("bigint").alias("type"), "param", "layer")


def moments(placed: DataFrame) -> DataFrame:
    """(layer, ops): the operations of each layer, in their order."""
    return placed.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("op_id", "type", "qubits"))).alias("ops"))


def moments_of_rows(rows: DataFrame) -> DataFrame:
    """(layer, ops) of layer rows (id, control_q, target_q, type, param, layer), validated where they are read.

    A row without qubits is left out. A target without a control, a type that is not in the dictionary (null included),
    a null layer and a qubit that two operations of a layer share are errors that name the gate or the layer."""
    wrong = lambda text, *cells: F.raise_error(F.concat(F.lit(text), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cells]))
    control, target = F.col("control_q"), F.col("target_q")
    known = F.coalesce(F.col("type").isin(*[g[0] for g in GATES]), F.lit(False))
    qubits = (F.when(control.isNull() & target.isNotNull(), wrong("a target without a control: gate ", F.col("id"))).when(~known, wrong("no such type: gate ", F.col("id")))
              .when(F.col("layer").isNull(), wrong("no layer: gate ", F.col("id"))).otherwise(F.array_compact(F.array(control, target))))
    grouped = moments(rows.select(F.col("id").alias("op_id"), "type", "layer", qubits.alias("qubits")).where(F.size("qubits") > 0))
    used = F.flatten("ops.qubits")
    return grouped.select("layer", F.when(F.size(F.array_distinct(used)) < F.size(used), wrong("operations share a qubit in layer ", F.col("layer"))).otherwise(F.col("ops")).alias("ops"))


def approximate_t_depth(placed: DataFrame, precision: float) -> DataFrame:
    """The sum over layers of the greatest T cost: 1 for T, 7 for CCX, the cost model's for other rotations."""
    rotation = floor(T_SLOPE * log2(1 / precision) + T_OFFSET)
    kind = F.col("type")
    quarter = (F.pmod(F.col("param") * 4, F.lit(1.0)) == 0)
    cost = (F.when(kind.isin(T, T_DAG), 1).when((kind == ZPOW) & quarter, F.when(F.pmod(F.col("param") * 4, F.lit(2.0)) == 1, 1).otherwise(0))
            .when(kind == CCX, CCX_COST).when(kind.isin(2, 3, 4, 5, 6, 7), rotation).otherwise(0))
    return placed.groupBy("layer").agg(F.max(cost).alias("cost")).agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("t_depth"))


def rotation_cost(precision) -> F.Column:
    """T gates of a rotation to a precision (a number or column) by the cost model."""
    return F.floor(F.lit(T_SLOPE) * F.log2(1 / (F.lit(precision) if isinstance(precision, float) else precision)) + T_OFFSET).cast("bigint")


def precision_budget(angles: DataFrame, circuit_precision: float, tolerance: float = 1e-10) -> DataFrame:
    """(rotations, precision): what each rotation of (angle in multiples of pi) may err if all together may err ``circuit_precision``.

    Multiples of a quarter are exact and take no share; without rotations the whole is left."""
    turn = F.col("angle") * 4
    n = angles.agg(F.count_if(F.abs(turn - F.round(turn)) > tolerance).cast("bigint").alias("rotations"))
    return n.withColumn("precision", F.when(F.col("rotations") > 0, F.lit(circuit_precision) / F.col("rotations")).otherwise(F.lit(circuit_precision)))


def rotation_resources(angles: DataFrame, precision: float, tolerance: float = 1e-10) -> DataFrame:
    """Rows (k, axis 2..4, angle) with t_count: none for half turns' halves, one for odd quarters, else the cost model's."""
    turn = F.col("angle") * 4
    exact = F.abs(turn - F.round(turn)) <= tolerance
    return angles.withColumn("t_count", F.when(exact, F.pmod(F.round(turn), F.lit(2.0)).cast("bigint")).otherwise(rotation_cost(precision)))
