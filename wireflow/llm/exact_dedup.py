"""Exact dedup by heavy-hitter split.

Misra-Gries finds digests that may be frequent; their exact counts and winners are broadcast
(at most ``1 / LEAST_SUPPORT`` rows) and settle most copies of hot texts on the map side. All other
digests go through an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import fresh, numbered, staged, table, with_row_key

#: A digest is heavy if it has this share of the rows, or TASK_ROWS rows; but never are more than 1 / LEAST_SUPPORT digests heavy (about 1 MB).
SUPPORT, TASK_ROWS, LEAST_SUPPORT = 0.01, 1_000_000, 1e-4


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT, row_key: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; a long text is hashed whole, once, and only its digest moves. Of
    equal texts the row with the largest doc_id stays; a null doc_id ranks lowest; of rows that
    also share the doc_id the last one read stays (``rid`` is the row's number in the scan, or
    ``row_key``). An empty table gives no rows; other columns, whatever their names, are not read."""
    keyed = numbered(docs, row_key, F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
    n = keyed.count()
    support = max(LEAST_SUPPORT, min(support, TASK_ROWS / max(n, 1)))
    found = keyed.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    best = F.max(F.struct("doc_id", "rid")).alias("best")
    size = F.count(F.lit(1)).alias("group_size")
    heavy = staged(keyed.join(F.broadcast(found), "text_sha256", "left_semi").groupBy("text_sha256").agg(best, size)
                   .where(F.col("group_size") >= F.lit(support * n)), "heavy")
    on_map_side = keyed.join(F.broadcast(heavy), "text_sha256")
    rest = keyed.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    shuffled = rest.join(rest.groupBy("text_sha256").agg(best, size), "text_sha256")
    return on_map_side.unionByName(shuffled).select(
        "rid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their columns, whatever these are called.

    Null and empty texts are equal, so one of them stays; of rows tied on the doc_id (null ranks
    lowest) the last read; repeated rows are copies; an empty table stays empty."""
    rid = fresh(docs, "rid")
    docs = with_row_key(docs, rid)
    kept = exact_dedup(docs, text, doc_id, row_key=rid).where("kept").select(F.col("rid").alias(rid))
    return docs.join(kept, rid, "left_semi").drop(rid)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`exact_dedup` of the whole documents table."""
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid")


SQL = {"op2_exact_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, r DESC) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""}
