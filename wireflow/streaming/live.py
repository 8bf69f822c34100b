"""Statistics of a circuit while its operations stream in: counts by window of time, and their ratio to the first window's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.operators.gates import is_t_like
from wireflow.plans.staging import new_path
from wireflow.schema import H, M

COUNTS = ("n_gates", "h_count", "t_count", "measured")
SERIES = "step timestamp_ntz, n_gates long, h_count long, t_count long, measured long"


def counted(ops: DataFrame, time: str, size: str) -> DataFrame:
    """(step, counts) of operations (type, param, a time) by windows of a size, in a batch or a stream."""
    counts = [F.count(F.lit(1)), F.count_if(F.col("type") == H), F.count_if(is_t_like()), F.count_if(F.col("type") == M)]
    return ops.groupBy(F.window(F.col(time).cast("timestamp_ntz"), size).alias("w")).agg(*[c.alias(n) for c, n in zip(counts, COUNTS)]).select(F.col("w.start").alias("step"), *COUNTS)


def run_series(ops: DataFrame, time: str, size: str, at: str | None = None) -> DataFrame:
    """SERIES of all that a streaming frame (type, param, a time) has now, late rows included.

    A batch gives the windows that it changed (update mode), written by batch number, so a batch
    that runs twice gives the same files; of each window the last version counts. The state is one row a window. With the folder
    ``at`` of an earlier run it goes on from there. A null time belongs to no window and is left out."""
    spark = ops.sparkSession
    at = at or new_path(spark, "series")

    def step(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/versions/batch={batch}")

    counted(ops, time, size).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.schema(f"{SERIES}, batch long").parquet(f"{at}/versions")
    return versions.groupBy("step").agg(F.max_by(F.struct(*COUNTS), "batch").alias("c")).select("step", "c.*")


def normalised(series: DataFrame) -> DataFrame:
    """Each count divided by that of the first window (0 where that is 0); the first row is a broadcast of one row, so no window holds the series."""
    first = series.agg(F.min_by(F.struct(*COUNTS), "step").alias("first"))
    ratio = lambda c: F.when(F.col(f"first.{c}") == 0, 0.0).otherwise(F.col(c) / F.col(f"first.{c}")).alias(c)
    return series.join(F.broadcast(first)).select("step", *[ratio(c) for c in COUNTS])
