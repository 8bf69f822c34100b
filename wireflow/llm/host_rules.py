"""Quality rules judged by document and by host.

The base rules are computed inside each row with built-in functions; failures are summed by
host, the hosts' failure rates are shrunk with a beta prior fitted to all hosts, and the host
verdicts are joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import SPACE, fresh, staged, table, with_row_key

MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: A host is rejected if, by its posterior, its failure rate is above MAX_HOST_RATE with BOUND_SDS deviations to spare.
MAX_HOST_RATE, BOUND_SDS = 0.5, 2.0


def base_metrics(docs: DataFrame, text: str, doc_id: str, host: str, row_key: str | None = None) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the row key if one is given.

    Windows are compared within one document by a hash of 64 bits: in a text of a million words
    two different ones are taken for each other with a chance of 3 in 100 million."""
    own = [F.col(row_key)] if row_key else []
    d = docs.select(*own, F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select(
        *own, "doc_id", "host",
        F.length(F.translate("t", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
        F.array_remove(F.split("t", SPACE), "").alias("words"))
    d = d.select(
        *own, "doc_id", "host", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("words").cast("bigint").alias("n_words"),
        # the last fields of a window: its four followers come from element access
        F.when(F.size("words") >= WINDOW, F.expr(
            "transform(slice(words, 1, size(words) - 4), (x, i) -> xxhash64(x, words[i + 1], words[i + 2], words[i + 3], words[i + 4]))"))
        .otherwise(F.expr("array()").cast("array<bigint>")).alias("windows"))
    # most texts have no repeated window; only the others are looked at again
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    d = d.withColumn("pairs", F.when(again, F.expr("sort_array(transform(windows, (x, i) -> named_struct('h', x, 'i', i)))")))
    d = d.withColumn("starts", F.expr(
        "array_sort(transform(filter(pairs, (p, i) -> get(pairs, i - 1).h <=> p.h or get(pairs, i + 1).h <=> p.h), p -> p.i))"))
    # in order of their starts, each repeated window covers five words less those already covered
    covered = F.expr(
        "aggregate(starts, named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct('n', a.n + 5 - greatest(0, a.upto - s), 'upto', s + 5), a -> a.n)")
    return d.select(*own, "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(host, host_docs, host_failures, host_rate, host_rejected), one row per host.

    The beta prior has the mean failure rate of all documents and, by moments, the strength
    that the spread of the hosts' rates implies (between 1 and 10,000 documents)."""
    hosts = staged(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("k")), "hosts")
    mean = hosts.agg((F.sum("k") / F.sum("n")).alias("m"), F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("docs"))
    gap = F.col("k") / F.col("n") - F.col("m")
    prior = (hosts.join(F.broadcast(mean)).groupBy("m", "hosts", "docs").agg(F.sum(F.col("n") * gap * gap).alias("ss"))
             .withColumn("noise", F.col("m") * (1 - F.col("m")) * F.col("hosts") / F.col("docs"))
             .withColumn("spread", F.greatest(F.col("ss") / F.col("docs") - F.col("noise"), F.lit(1e-9)))
             .select("m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("spread") - 1, F.lit(1.0)), F.lit(1e4)).alias("s")))
    post = (hosts.join(F.broadcast(prior)).withColumn("size", F.col("n") + F.col("s"))
            .withColumn("host_rate", (F.col("k") + F.col("s") * F.col("m")) / F.col("size"))
            .withColumn("sd", F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("size") + 1))))
    return staged(post.select("host", F.col("n").alias("host_docs"), F.col("k").alias("host_failures"), "host_rate",
                              (F.col("host_rate") - BOUND_SDS * F.col("sd") > MAX_HOST_RATE).alias("host_rejected")), "verdicts")


def host_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", row_key: str | None = None) -> DataFrame:
    """One row per document with its base metrics, ``base_failed``, its host's figures and ``kept``.

    A null or empty text has no words and so fails; a long text is judged whole; a null host is a
    host of its own; a null doc_id stays null; repeated rows are judged each; an empty table gives
    no rows; other columns, whatever their names, are not read."""
    judged = staged(base_metrics(docs, text, doc_id, host, row_key).withColumn("base_failed", base_failed()), "base")
    hosts = host_verdicts(judged).withColumnRenamed("host", "vhost")
    return (judged.join(hosts, F.col("host").eqNullSafe(F.col("vhost")), "left").drop("vhost")
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`host_rules` keeps, with their columns, whatever these are called.

    Rows without words (null, empty or blank texts) go; rows are judged each, repeated or tied
    ones alike; an empty table stays empty."""
    rid = fresh(docs, "rid")
    docs = with_row_key(docs, rid)
    bad = host_rules(docs, text, doc_id, host, rid).where(~F.col("kept")).select(rid)
    return docs.join(bad, rid, "left_anti").drop(rid)


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`host_rules` of the whole documents table, the source taken as host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = {"op5_host_rules": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) u(i) WHERE len(ws) >= 5),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, range(0, 5) q(o) GROUP BY r),
b AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
j AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM j GROUP BY host),
m AS (SELECT sum(k) / sum(n) AS m, count(*) AS hosts, sum(n) AS docs FROM h),
p AS (SELECT any_value(m) AS m, greatest(sum(n * (k / n - m) * (k / n - m)) / any_value(docs)
             - any_value(m * (1 - m) * hosts / docs), 1e-9) AS spread FROM h, m),
s AS (SELECT m, least(greatest(m * (1 - m) / spread - 1, 1.0), 1e4) AS s FROM p),
q AS (SELECT host, n + s AS size, (k + s * m) / (n + s) AS rate FROM h, s),
v AS (SELECT host, rate - 2.0 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5 AS bad FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host"""}
