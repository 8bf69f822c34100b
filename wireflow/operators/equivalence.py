"""Composition with the inverse, mutants, and equivalence of circuits of self-inverse two-qubit gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.operators.wire_rewrites import cancel_two_qubit
from wireflow.plans.running import running_sum
from wireflow.schema import INVERSE

#: Types whose inverse has the negated parameter.
NEGATED = (2, 3, 4, 5, 6, 7, 17, 19, 20)


def inverse(ops: DataFrame) -> DataFrame:
    """The operations in reverse order, each inverted; op_ids run from 0 again."""
    kind = F.col("type").cast("int")
    turned = kind
    for a, b in INVERSE.items():
        turned = F.when(kind == a, b).otherwise(turned)
    last = ops.agg((F.count(F.lit(1)) - 1).alias("last"))
    return ops.join(F.broadcast(last)).withColumn("op_id", F.col("last") - F.col("op_id")).withColumn("param", F.when(kind.isin(*NEGATED), -F.col("param")).otherwise(F.col("param"))).withColumn("type", turned.cast("short")).drop("last")


def composed_with_inverse(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` followed by the inverse of ``second`` (dense op_ids)."""
    n = first.agg(F.count(F.lit(1)).alias("n"))
    after = inverse(second).join(F.broadcast(n)).withColumn("op_id", F.col("op_id") + F.col("n")).drop("n")
    return first.unionByName(after)


def mutant(ops: DataFrame) -> DataFrame:
    """Without one operation: the one whose number has the smallest md5."""
    gone = ops.select("op_id", F.md5(F.col("op_id").cast("string")).alias("m")).orderBy("m", "op_id").limit(1)
    return ops.join(F.broadcast(gone.select("op_id")), "op_id", "left_anti")


def equivalent(first: DataFrame, second: DataFrame, staged) -> DataFrame:
    """One row (equivalent): whether two circuits of the same self-inverse two-qubit gates are equal up to exchanging disjoint gates.

    Cancelling ``first`` with the inverse of ``second`` to nothing takes as many rounds as the
    circuit is deep. Reducing each alone takes few, and reduced circuits are equal just if
    every wire meets the same gates in the same order."""
    return same_words(words(first, staged), words(second, staged))


def words(ops: DataFrame, staged) -> DataFrame:
    """(qubit, at, both), written: the gates that each wire meets in the reduced circuit, by their qubits. The operations are written first, for every round reads them."""
    left = cancel_two_qubit(staged(ops.select("op_id", "type", "param", "qubits")), staged=staged)
    own = left.select("op_id", F.col("qubits").alias("both"), F.explode("qubits").alias("qubit"))
    return staged(running_sum(own, ["qubit"], "op_id", F.lit(1).cast("bigint"), "at").select("qubit", "at", "both"))


def same_words(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row (equivalent): whether all wires meet the same gates in the same order."""
    same = first.withColumnRenamed("both", "x").join(second.withColumnRenamed("both", "y"), ["qubit", "at"], "full_outer")
    differs = ~F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    return same.agg((F.count_if(differs) == 0).alias("equivalent"))
