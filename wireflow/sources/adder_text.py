"""Reader of text circuits: lines like QGate["not"](7) with controls=[+1, -2] with nocontrol."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.operators import decompose
from wireflow.plans.running import global_rank
from wireflow.plans.staging import staged

NOT_LINE = r'^QGate\["not"\]\((\d+)\)'


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the files under ``path``, lines numbered from 0 without gaps, file after file in the order of their paths.

    A line's place is its file, the start of the split that it was read from, and its turn in it, so
    the numbers are the same however files are cut into splits and splits dealt to tasks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("turn"))
    return global_rank(staged(rows, "lines"), "file", "split", "turn", name="line").select("line", "value")


def parse(lines: DataFrame) -> DataFrame:
    """(line, target, controls array<struct<qubit, filled>>) of the not-gates; other lines are left out."""
    kept = lines.where(F.col("value").rlike(NOT_LINE))
    inside = F.regexp_extract("value", r"controls=\[([^\]]*)\]", 1)
    controls = F.transform(F.regexp_extract_all(inside, F.lit(r"([+-]\d+)"), F.lit(1)), lambda c: F.struct(F.substring(c, 2, 20).cast("bigint").alias("qubit"), c.startswith("+").alias("filled")))
    return kept.select("line", F.regexp_extract("value", NOT_LINE, 1).cast("bigint").alias("target"), controls.alias("controls"))


def operations(lines: DataFrame, staged_: Callable[[DataFrame], DataFrame] = staged, rules: DataFrame | None = None) -> DataFrame:
    """(op_id, type, param, qubits) of numbered lines, op_ids dense from 0: NOTs with their hollow controls turned round, and doubly controlled ones decomposed.

    ``rules`` may be a relation of one's own (see :func:`wireflow.operators.decompose.relation`). A line with more than two
    controls is an error; lines that are no NOTs, empty or null are left out, and no lines give no operations."""
    spark = lines.sparkSession
    first = global_rank(decompose.lowered_controls(parse(lines)), "line", "sub", name="op_id").withColumn("param", F.when(F.col("type") == decompose.AS_TYPES["CX"][0], 1.0).otherwise(0.0))
    gates = decompose.decomposed(first, decompose.relation(spark) if rules is None else rules, staged_)
    return global_rank(gates, "op_id", "path", name="place").select(F.col("place").alias("op_id"), "type", "param", "qubits")
