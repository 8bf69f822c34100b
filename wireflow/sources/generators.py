"""Circuits made by a rule from a column of numbers: the same seed gives the same circuit on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.plans.running import global_rank, running_sum
from wireflow.schema import CCX, CX, H, S, T, T_DAG, X

TEMPLATES = 7


def _draw(seed: int, salt: int, below) -> F.Column:
    return F.pmod(F.xxhash64(F.col("i"), F.lit(seed), F.lit(salt)), F.lit(below).cast("bigint") if isinstance(below, int) else below)


def _one(code: int, param: float, *qubits) -> F.Column:
    return F.struct(F.lit(code).cast("short").alias("type"), F.lit(param).cast("float").alias("param"), F.array(*qubits).alias("qubits"))


def _numbered(rows: DataFrame) -> DataFrame:
    """(op_id, type, param, qubits) of rows (i, ops array): op_ids follow i, then the place in the array."""
    sums = running_sum(rows, [], "i", F.size("ops").cast("bigint"), "upto")
    return sums.select((F.col("upto") - F.size("ops")).alias("first"), F.posexplode("ops").alias("j", "op")).select((F.col("first") + F.col("j")).alias("op_id"), "op.*")


def _pairs(numbers: DataFrame, qubits: int, seed: int) -> DataFrame:
    """(i, a, b): two different qubits for every number i."""
    rows = numbers.select("i").withColumn("a", _draw(seed, 1, qubits))
    return rows.withColumn("b", F.pmod(F.col("a") + 1 + _draw(seed, 2, qubits - 1), F.lit(qubits)))


def random_templates(numbers: DataFrame, qubits: int, seed: int = 0) -> DataFrame:
    """A template for every number (i): H H, CX CX, H H CX H H, T and its inverse, T CX, CX T, or (with three qubits) a doubly controlled NOT."""
    a, b = F.col("a"), F.col("b")
    low, high = F.least(a, b), F.greatest(a, b)
    free = _draw(seed, 5, max(qubits - 2, 1))  # the third qubit is one of those that are neither a nor b
    free = F.when(free < low, free).when(free < high - 1, free + 1).otherwise(free + 2)
    h, g, cx, t = _one(H, 1.0, a), _one(H, 1.0, b), _one(CX, 1.0, a, b), _one(T, 0.0, a)
    kinds = [F.array(h, h), F.array(cx, cx), F.array(h, g, cx, h, g), F.array(t, _one(T_DAG, 0.0, a)), F.array(t, cx), F.array(cx, t), F.array(_one(CCX, 1.0, a, b, free))]
    return _numbered(_pairs(numbers, qubits, seed).withColumn("ops", F.element_at(F.array(*kinds), (_draw(seed, 3, TEMPLATES if qubits > 2 else TEMPLATES - 1) + 1).cast("int"))))


def random_cx(numbers: DataFrame, qubits: int, turned_pct: float = 0.0, seed: int = 0, phased: bool = False) -> DataFrame:
    """A controlled NOT on a random pair for every number (i); so many per cent of them turned round between H's.

    ``phased`` puts an S on both wires before the first and after the last H's."""
    a, b = F.col("a"), F.col("b")
    h, g = _one(H, 1.0, a), _one(H, 1.0, b)
    outer = [_one(S, 0.0, a), _one(S, 0.0, b)] if phased else []
    turned = _draw(seed, 4, 10**6) < int(turned_pct * 10**4)
    return _numbered(_pairs(numbers, qubits, seed).withColumn("ops", F.when(turned, F.array(*outer, h, g, _one(CX, 1.0, b, a), h, g, *outer)).otherwise(F.array(_one(CX, 1.0, a, b)))))


def repeated(ops: DataFrame, times: int) -> DataFrame:
    """A circuit so many times in a row (op_ids dense from 0)."""
    n = ops.agg(F.count(F.lit(1)).alias("n_ops"))
    rows = ops.join(F.broadcast(n)).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint"))))
    return rows.withColumn("op_id", F.col("turn") * F.col("n_ops") + F.col("op_id")).drop("n_ops", "turn")


def with_ancillas(rows: DataFrame, order: str, used: DataFrame) -> DataFrame:
    """Add ``ancilla``: a fresh qubit for every row, in the order of a column, after the largest of ``used`` (qubit)."""
    top = used.agg(F.coalesce(F.max("qubit"), F.lit(-1)).alias("top"))
    return global_rank(rows, order, name="place").join(F.broadcast(top)).withColumn("ancilla", F.col("top") + 1 + F.col("place")).drop("top", "place")


def bernstein_vazirani(bits: DataFrame) -> DataFrame:
    """For a secret given as (i, one boolean), read in the order of i: H on every qubit, X and H on one more after them, a controlled NOT to it for every 1, H on all but it."""
    own = global_rank(bits.select("i", "one"), "i", name="q").withColumn("q", F.col("q").cast("bigint"))
    n = own.agg(F.count(F.lit(1)).alias("n"))
    last = own.agg(F.max("q").alias("top"))
    rows = own.join(F.broadcast(n)).join(F.broadcast(last))
    h, q = _one(H, 1.0, F.col("q")), F.col("q")
    none = F.expr("cast(array() as array<struct<type:smallint,param:float,qubits:array<bigint>>>)")
    more = F.when(q == F.col("top"), F.array(_one(X, 0.0, F.col("n")), _one(H, 1.0, F.col("n")))).otherwise(none)
    parts = F.array(F.struct(q.alias("i"), F.concat(F.array(h), more).alias("ops")), F.struct((F.col("n") + q).alias("i"), F.when(F.col("one"), F.array(_one(CX, 1.0, q, F.col("n")))).otherwise(none).alias("ops")),
                    F.struct((2 * F.col("n") + q).alias("i"), F.array(h).alias("ops")))
    return _numbered(rows.select(F.explode(parts).alias("x")).select("x.*"))
