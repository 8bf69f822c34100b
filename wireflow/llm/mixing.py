"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireflow.llm.common import WORD, fresh, key60, numbered, staged, table, weighted_cuts, with_row_key

WEIGHTS, MOST_COPIES = (5, 2, 1), 3


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target double) from (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words; a
    target stops at ``most`` times its source's size and the excess is shared again by weight
    among the others until none is above."""
    # one short row a source: ranking them needs one task, which holds sources, not documents
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    now = staged(sources.withColumn("weight", weight).withColumn("target", F.lit(None).cast("double")), "sources")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("target").isNotNull()
        left, shares = now.agg(F.sum(F.when(full, F.col("target")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        rate = (total - (left or 0.0)) / shares if shares else 0.0
        share = F.col("weight") * F.lit(rate)
        over = ~full & (share > F.col("source_size") * most)
        if now.where(over).isEmpty():
            return now.select("source", "source_size", F.coalesce("target", share).alias("target"))
        now = staged(now.withColumn("target", F.when(over, F.col("source_size") * float(most)).otherwise(F.col("target"))), "sources")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, most: int = MOST_COPIES, row_key: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, source, size, source_size, target, copies, taken.

    Every document of a source is taken ``floor(target / source_size)`` times, and those whose
    hash lies under the source's threshold once more, so that the words taken come as near to
    the target as whole documents allow. The hash is of doc_id and text: reruns agree whatever
    the layout of the files. Rows equal in both go together. A null or wordless text has size
    0; a long text is counted whole; a null source is a source of its own; an empty table gives
    no rows; other columns, whatever their names, are not read."""
    sized = numbered(docs, row_key, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                     F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key60(doc_id, text).alias("key"))
    goals = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
                   .withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("bigint"))
                   .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    cuts = weighted_cuts(sized.select(F.col("source").alias("g"), "key", F.col("size").alias("w")), goals.select(F.col("source").alias("g"), "budget"), "mix")
    plan = staged(goals.join(cuts, F.col("source").eqNullSafe(F.col("g")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "whole", F.when(F.col("whole") >= most, 0).otherwise(F.coalesce("cut", F.lit(0))).alias("cut")), "plan")
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("copies", F.col("whole") + (F.col("key") < F.col("cut")).cast("bigint"))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .select("rid", "doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, with their columns, whatever these are called.

    Wordless documents (null, empty or blank texts) count nothing; they come as often as their
    source's others. Rows equal in doc_id and text are taken together; an empty table stays empty."""
    columns, rid, n = docs.columns, fresh(docs, "rid"), fresh(docs, "copies")
    docs = with_row_key(docs, rid)
    taken = mix(docs, text, doc_id, source, row_key=rid).where("copies > 0").select(F.col("rid").alias(rid), F.col("copies").alias(n))
    return (docs.join(taken, rid)
            .withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in columns]))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mix` of the whole documents table."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {"op9_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, sum(size) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS p FROM d GROUP BY source),
w AS (SELECT *, CASE p % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, 3 * z / w AS rho, sum(3 * z) OVER f AS capped, sum(w) OVER f AS cw, sum(z) OVER () AS t, sum(w) OVER () AS ws, row_number() OVER f AS i FROM w WINDOW f AS (ORDER BY 3 * z / w, p)),
l AS (SELECT 0 AS m, any_value(t) / any_value(ws) AS lam, min(rho) AS nxt FROM r UNION ALL SELECT i, (t - capped) / nullif(ws - cw, 0), lead(rho) OVER (ORDER BY i) FROM r),
b AS (SELECT m, lam FROM l WHERE nxt IS NULL OR lam <= nxt ORDER BY m LIMIT 1),
g AS (SELECT source, z, CASE WHEN i <= m THEN 3.0 * z ELSE w * lam END AS target FROM r, b),
q AS (SELECT *, CASE WHEN z > 0 THEN least(floor(target / z), 3) ELSE 0 END AS whole FROM g),
k AS (SELECT source, key, sum(size) AS bw FROM d GROUP BY 1, 2),
u AS (SELECT *, sum(bw) OVER (PARTITION BY source ORDER BY key) AS upto FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(z AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN whole < 3 AND (upto <= target - whole * z OR (upto - bw <= target - whole * z AND 2 * (upto - bw) + bw <= 2 * (target - whole * z))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.key = u.key"""}
