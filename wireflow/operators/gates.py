"""Scans, filters, joins and aggregates over the gate table. Neighbour types are read from the links, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireflow.functions.codec import link_id, link_port, link_type
from wireflow.schema import CONTROLLED, CX, H, IN, M, OUT, RESET, T, T_DAG, X, ZPOW, gate_types



def not_io() -> F.Column:
    return ~F.col("type").isin(IN, OUT)


def is_t_like() -> F.Column:
    """T or its inverse in either encoding."""
    return F.col("type").isin(T, T_DAG) | ((F.col("type") == ZPOW) & F.col("param").isin(0.25, -0.25))


def by_label(gates: DataFrame, label: str) -> DataFrame:
    return gates.where(F.col("label") == label)


def by_ids(gates: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ``ids`` (id); Spark broadcasts the ids only if they are small."""
    return gates.join(ids.select("id"), "id", "left_semi")


def batches(gates: DataFrame, size: int = 1000) -> DataFrame:
    """(batch, n): rows of each batch of a cursor over dense ids."""
    return gates.groupBy(F.floor(F.col("id") / size).cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def next_gates(gates: DataFrame, side: str = "next") -> DataFrame:
    """Each gate with its neighbour on port 0: id, type, other, other_type."""
    other = gates.select(F.col("id").alias("other"), F.col("type").alias("other_type"))
    return gates.where(f"{side}_q1 is not null").withColumn("to", link_id(f"{side}_q1")).join(other, F.col("to") == F.col("other")).select("id", "type", "other", "other_type")


def two_wire_pairs(gates: DataFrame) -> DataFrame:
    """(first, second): two-qubit gates whose both wires lead to the same gate in the same order of ports."""
    second = gates.select(F.col("id").alias("second"), F.col("prev_q1").alias("p1"), F.col("prev_q2").alias("p2"))
    own = gates.where((link_id("next_q1") == link_id("next_q2")) & (link_port("next_q1") == 0) & (link_port("next_q2") == 1))
    return own.withColumn("to", link_id("next_q1")).join(second, (F.col("to") == F.col("second")) & (link_id("p1") == F.col("id")) & (link_id("p2") == F.col("id"))).select(F.col("id").alias("first"), "second")


def exploded_links(gates: DataFrame) -> DataFrame:
    """(id, type, side, port, to): a row for every link."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(p).alias("port"), F.col(f"{s}_q{p + 1}").alias("to")) for s in ("prev", "next") for p in range(3)])
    return gates.select("id", "type", F.explode(sides).alias("x")).select("id", "type", "x.*").where("to is not null")


def cx_neighbours(gates: DataFrame) -> DataFrame:
    """(id, n_neighbours, n_h): distinct neighbours of every controlled gate and how many of its links lead to an H."""
    own = exploded_links(gates).where(F.col("type").isin(*CONTROLLED))
    return own.groupBy("id").agg(F.size(F.collect_set(link_id("to"))).cast("bigint").alias("n_neighbours"), F.sum((link_type("to") == H).cast("bigint")).alias("n_h"))


def dangling(gates: DataFrame) -> DataFrame:
    """Links whose gate is missing, has another type, or does not point back: none in a sound table."""
    links = exploded_links(gates)
    own = links.select(F.col("id").alias("a"), "side", "port", link_id("to").alias("b"), link_port("to").alias("bport"), link_type("to").alias("btype"))
    back = links.select(F.col("id").alias("b"), F.when(F.col("side") == "prev", "next").otherwise("prev").alias("side"), F.col("port").cast("bigint").alias("bport"), link_id("to").alias("a"), link_port("to").alias("port"), F.col("type").cast("bigint").alias("btype"))
    return own.withColumn("port", F.col("port").cast("bigint")).join(back, ["a", "side", "port", "b", "bport", "btype"], "left_anti")


def classes() -> dict[str, F.Column]:
    """The classes of gates that are counted."""
    kind = F.col("type")
    return {"total_count": not_io(), "t_count": is_t_like(), "s_count": kind.isin(27, 28) | ((kind == ZPOW) & F.col("param").isin(0.5, -0.5)),
            "h_count": kind == H, "cx_count": kind.isin(15, CX), "x_count": kind.isin(X, 5)}


def class_counts() -> list[F.Column]:
    return [F.count_if(c).cast("bigint").alias(name) for name, c in classes().items()]


def stats(gates: DataFrame) -> DataFrame:
    """One row of counts in a single pass."""
    return gates.agg(*class_counts())


def histogram(gates: DataFrame) -> DataFrame:
    counts = gates.groupBy(F.col("type").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(gate_types(gates.sparkSession)), "code").select("name", "n")


def t_count_tolerant(ops: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Operations whose exponent is a quarter or three quarters, modulo one, within a tolerance."""
    part = F.pmod(F.col("exponent"), F.lit(1.0))
    near = (F.abs(part - 0.25) <= tolerance) | (F.abs(part - 0.75) <= tolerance)
    return ops.agg(F.count_if(near).cast("bigint").alias("t_count"))


def rotation_count(angles: DataFrame) -> DataFrame:
    """Rotations by an angle (multiples of pi) that is no multiple of a half turn's half."""
    part = F.pmod(F.col("angle"), F.lit(0.5))
    return angles.agg(F.count_if((part > 1e-8) & (part < 0.5 - 1e-8)).cast("bigint").alias("rotations"), F.count(F.lit(1)).alias("n"))


def without_io(gates: DataFrame) -> DataFrame:
    """Links to In and Out gates become null."""
    real = gates.where(not_io())
    cut = lambda c: F.when(~link_type(c).isin(IN, OUT), link_id(c)).alias(c.replace("_q", "_"))
    return real.select("id", *[cut(c) for c in ("prev_q1", "prev_q2", "next_q1", "next_q2")])


def without_measurements(ops: DataFrame) -> F.Column:
    return ~F.col("type").isin(M, RESET)


def shard_ranges(n: DataFrame, shards: int, inner: int) -> DataFrame:
    """(shard, part, first, upto): [0, n) into containers and each into parts, with bounds floor(n * i / k)."""
    div = lambda a, b: F.call_function("div", a, b)
    k, m = F.lit(shards).cast("bigint"), F.lit(inner).cast("bigint")
    outer = n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"))
    outer = outer.select("shard", div(F.col("n") * F.col("shard"), k).alias("lo"), div(F.col("n") * (F.col("shard") + 1), k).alias("hi"))
    both = outer.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(inner - 1).cast("bigint"))).alias("part")).withColumn("size", F.col("hi") - F.col("lo"))
    return both.select("shard", "part", (F.col("lo") + div(F.col("size") * F.col("part"), m)).alias("first"), (F.col("lo") + div(F.col("size") * (F.col("part") + 1), m)).alias("upto"))


def normalised(series: DataFrame, order: str, *columns: str) -> DataFrame:
    """Each column divided by its first row (0 if that is 0); one short row for each step."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = {c: F.first(c).over(w) for c in columns}
    return series.select(order, *[F.when(first[c] == 0, 0.0).otherwise(F.col(c) / first[c]).alias(c) for c in columns])


class OutsideGateSet(ValueError):
    """A circuit has gates that are not in the set; ``first`` are the first of them as (id, type)."""

    def __init__(self, first: list[tuple]):
        super().__init__(f"gates outside the set: {first}")
        self.first = first


def unsupported(rows: DataFrame, gate_set: tuple[int, ...], key: str = "id", most: int = 10) -> DataFrame:
    """(key, type): the first gates that are not in the set, in the order of the key; a null type is in no set.

    Spark keeps the first of each partition only, so the report costs one pass, however many there are."""
    allowed = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in sorted(gate_set)], "type short"))  # types are two digits: a hundred rows at most
    return rows.select(key, F.col("type").cast("short").alias("type")).join(allowed, "type", "left_anti").select(key, "type").orderBy(key).limit(most)


def require(rows: DataFrame, gate_set: tuple[int, ...], key: str = "id") -> DataFrame:
    """The rows themselves if all are of the set, else an error with the first ten that are not."""
    first = [tuple(r) for r in unsupported(rows, gate_set, key).collect()]
    if first:
        raise OutsideGateSet(first)
    return rows
