"""Shards of near-equal bytes by k-d tree partitioning over groups of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireflow.llm.common import numbered, staged, table, weighted_cuts

N_SHARDS = 16
DIMS = ("x_size", "x_source", "x_lang")
#: Rows that one task numbers at a time when slots are given out.
SLOT_ROWS = 20_000


def _unit(col) -> F.Column:
    """A place in [0, 1) for a category, the same wherever it occurs."""
    return F.when(col.isNull(), 0.0).otherwise(F.crc32(col.cast("binary")) / F.lit(2.0**32))


def split_tree(groups: DataFrame, n_shards: int) -> DataFrame:
    """(digest, shard) from groups (digest, key_low, bytes, dims...) by recursive weighted medians.

    A node with s shards is cut so that its left side gets floor(s / 2) of its s shares of the
    bytes, along its widest dimension (the largest spread; the first of equals); rows with the
    same coordinate are ordered by digest, so that one hot coordinate can be cut too."""
    now = groups.withColumn("lo", F.lit(0)).withColumn("n", F.lit(n_shards))
    rounds = max(0, (n_shards - 1).bit_length())
    for depth in range(rounds):
        spread = [(F.max(d) - F.min(d)).alias(d) for d in DIMS]
        nodes = now.groupBy("lo", "n").agg(F.sum("bytes").alias("node_bytes"), *spread)
        widest = F.greatest(*DIMS)
        axis = F.when(F.col(DIMS[0]) == widest, 0)
        for i, d in enumerate(DIMS[1:], 1):
            axis = axis.when(F.col(d) == widest, i)
        nodes = staged(nodes.select(F.col("lo").alias("nlo"), "node_bytes", axis.alias("axis"), F.floor(F.col("n") / 2).cast("int").alias("left"), F.col("n").alias("nn")), f"nodes{depth}")
        at = F.element_at(F.array(*DIMS), F.col("axis") + 1)
        keyed = staged(now.join(F.broadcast(nodes), F.col("lo") == F.col("nlo")).withColumn(
            "key", F.shiftleft(F.least(F.floor(at * (1 << 20)), F.lit((1 << 20) - 1)).cast("bigint"), 40) + F.col("key_low")), f"keyed{depth}")
        budgets = nodes.where("nn > 1").select(F.col("nlo").alias("g"), (F.col("node_bytes") * F.col("left") / F.col("nn")).alias("budget"))
        cuts = staged(weighted_cuts(keyed.where("n > 1").select(F.col("lo").alias("g"), "key", F.col("bytes").alias("w")), budgets, f"kd{depth}"), f"cuts{depth}")
        right = F.col("cut").isNotNull() & (F.col("key") >= F.col("cut"))
        now = keyed.join(F.broadcast(cuts), F.col("lo") == F.col("g"), "left").select(
            "digest", "key_low", "bytes", *DIMS,
            F.when(right, F.col("lo") + F.col("left")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("n") == 1, 1).when(right, F.col("n") - F.col("left")).otherwise(F.col("left")).alias("n"))
    return now.select("digest", F.col("lo").alias("shard"))


def slots(rows: DataFrame, shard: str, tie: str) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in pieces of about SLOT_ROWS rows."""
    pieces = max(1, rows.count() // SLOT_ROWS)
    cut = staged(rows.withColumn("piece", F.pmod(F.xxhash64(tie), F.lit(pieces))), "pieces")
    sums = cut.groupBy(shard, "piece").agg(F.count(F.lit(1)).alias("k"))
    start = sums.select(F.col(shard).alias("s"), F.col("piece").alias("p"),
                        (F.sum("k").over(W.partitionBy(shard).orderBy("piece")) - F.col("k")).alias("start"))
    return (cut.withColumn("at", F.row_number().over(W.partitionBy(shard, "piece").orderBy(tie)))
            .join(start, (F.col(shard) == F.col("s")) & (F.col("piece") == F.col("p")))
            .withColumn("slot", F.col("start") + F.col("at") - 1).drop("s", "p", "start", "at", "piece"))


def kd_shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_shards: int = N_SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), for texts of any length.

    Law ``bytes``: sizes are near equal as far as whole groups of equal texts allow; a group
    goes to one shard. The dimensions are the logarithm of the size and the places of the
    group's smallest source and lang. A null text has size 1; a null source or lang has place
    0; an empty table gives no rows; other columns are not read."""
    t = F.coalesce(F.col(text), F.lit(""))
    meta = numbered(
        docs, None,
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.sha2(t, 256).alias("digest"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))
    groups = staged(meta.groupBy("digest").agg(F.sum("size").alias("bytes"), F.max("size").alias("one"), F.min("source").alias("source"), F.min("lang").alias("lang")).select(
        "digest", F.conv(F.substring("digest", 1, 10), 16, 10).cast("bigint").alias("key_low"), "bytes",
        (F.log2("one") / 40).alias("x_size"), _unit(F.col("source")).alias("x_source"), _unit(F.col("lang")).alias("x_lang")), "groups")
    placed = meta.select("rid", "doc_id", "size", "text_crc32", "digest").join(split_tree(groups, n_shards), "digest")
    return slots(placed, "shard", "rid").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`kd_shards` of the whole documents table."""
    return kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


SQL: dict[str, str] = {}
