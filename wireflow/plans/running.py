"""Running sums and neighbours in two levels, so that no task holds a whole long sequence.

A sequence is cut into chunks by its order key; each (group, chunk) is a window partition of
its own, one row a chunk carries the totals, and only those rows meet in a window by group.
With few groups the totals may be ``written``: Spark then knows their size before it plans the
join and, where they are small, broadcasts them instead of shuffling the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireflow.plans.staging import staged

CHUNK = 1 << 16


def chunk_of(order: str, chunk: int = CHUNK) -> Column:
    return F.call_function("div", F.col(order).cast("bigint"), F.lit(chunk).cast("bigint"))


def _same(by: list[str]) -> Column:
    out = F.col("__chunk") == F.col("c_chunk")
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(f"c_{b}"))
    return out


def running_sum(df: DataFrame, by: list[str], order: str, value: Column, name: str, chunk: int = CHUNK, ties: str | None = None, written: bool = False) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with each row, in the order of ``order`` (then ``ties``) within ``by``."""
    cut = df.withColumn("__chunk", chunk_of(order, chunk)).withColumn("__v", value)
    keys = [F.col(order), *([F.col(ties)] if ties else [])]
    sums = cut.groupBy(*by, "__chunk").agg(F.sum("__v").alias("s"))
    before = sums.withColumn("__start", F.sum("s").over(W.partitionBy(*by).orderBy("__chunk")) - F.col("s")).select(*[F.col(b).alias(f"c_{b}") for b in by], F.col("__chunk").alias("c_chunk"), "__start")
    inside = F.sum("__v").over(W.partitionBy(*by, "__chunk").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow))
    return cut.withColumn("__in", inside).join(staged(before, "totals") if written else before, _same(by)).withColumn(name, F.col("__in") + F.col("__start")).drop("__chunk", "__v", "__in", "c_chunk", "__start", *[f"c_{b}" for b in by])


def neighbours(df: DataFrame, by: list[str], order: str, value: Column, before: str, after: str, chunk: int = CHUNK, written: bool = False) -> DataFrame:
    """Add the ``value`` (a struct) of the row before and the row after in the order of ``order`` within ``by``; null at the ends."""
    cut = df.withColumn("__chunk", chunk_of(order, chunk)).withColumn("__v", value)
    near = W.partitionBy(*by, "__chunk").orderBy(order)
    ends = cut.groupBy(*by, "__chunk").agg(F.min_by("__v", order).alias("first"), F.max_by("__v", order).alias("last"))
    row = W.partitionBy(*by).orderBy("__chunk")
    ends = ends.select(*[F.col(b).alias(f"c_{b}") for b in by], F.col("__chunk").alias("c_chunk"), F.lag("last").over(row).alias("c_before"), F.lead("first").over(row).alias("c_after"))
    return (cut.withColumn("__b", F.lag("__v").over(near)).withColumn("__a", F.lead("__v").over(near)).join(staged(ends, "ends") if written else ends, _same(by))
            .withColumn(before, F.coalesce("__b", "c_before")).withColumn(after, F.coalesce("__a", "c_after"))
            .drop("__chunk", "__v", "__b", "__a", "c_chunk", "c_before", "c_after", *[f"c_{b}" for b in by]))


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Number all rows from 0 in the order of columns: ranges are sorted apart and offset by the counts before them.

    The ranges are sorted and written with their numbers and places first, so that the counts and the rows see the same ones and no row is moved again."""
    # in a sorted range the generated number is the range, shifted by 33 bits, and the row's place in it
    parts = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    counts = parts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("p", (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("__start"))
    return parts.join(F.broadcast(starts), part == F.col("p")).withColumn(name, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("__at", "p", "__start")


def running_max(df: DataFrame, by: list[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``name``: the largest ``value`` up to and with each row, in the order of ``order`` within ``by``."""
    cut = df.withColumn("__chunk", chunk_of(order, chunk)).withColumn("__v", value)
    tops = cut.groupBy(*by, "__chunk").agg(F.max("__v").alias("top"))
    earlier = F.max("top").over(W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1))
    before = tops.select(*[F.col(b).alias(f"c_{b}") for b in by], F.col("__chunk").alias("c_chunk"), earlier.alias("__top"))
    inside = F.max("__v").over(W.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return cut.withColumn("__in", inside).join(before, _same(by)).withColumn(name, F.greatest("__in", "__top")).drop("__chunk", "__v", "__in", "c_chunk", "__top", *[f"c_{b}" for b in by])
