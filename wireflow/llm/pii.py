"""Personal data by bootstrapped contextual extraction.

Four base patterns give seed entities. The words around them are lexical patterns; a graph of
patterns and the identifier-like strings that they extract is scored in turns: strings that
confident patterns support are accepted, and accepted strings induce patterns in the next turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireflow.llm.common import staged, table, with_row_key

#: Kinds in their order, with patterns that match like the plain ones in linear time: the
#: quantifiers are possessive where giving back could not help, and an e-mail starts at the
#: first character of its run (or where the match before it ended).
LOCAL = r"A-Za-z0-9._%+-"
KINDS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that must hold for any match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Words with a digit or an at sign, one blank apart, make a unit; one of such a length may be an identifier.
_WORD = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
UNIT, LENGTHS = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:\x20{_WORD})*+", (8, 64)
#: Not part of an identifier at its start or end.
EDGE = r"[\"'.,;:!?()\[\]{}<>]"
#: A pattern needs so many accepted strings, a string so high a score; a shape counts less than a context.
MIN_SUPPORT, MIN_SCORE, SHAPE_WEIGHT = 3, 0.8, 0.5


def _found(docs: DataFrame, kind: str, pattern: str, needs: str) -> DataFrame:
    """(rid, kind, start, end, found, before, after): leftmost non-overlapping matches with the text between them."""
    hit = docs.where(F.col("t").rlike(needs)).select("rid", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m"), F.split("t", pattern, -1).alias("gaps"))
    each = hit.select("rid", F.posexplode(F.expr("transform(m, (x, i) -> named_struct('found', x, 'before', gaps[i], 'after', gaps[i + 1]))")).alias("at", "x")).select("rid", "at", "x.*")
    upto = F.sum(F.length("before") + F.length("found")).over(W.partitionBy("rid").orderBy("at"))
    return each.select("rid", F.lit(kind).alias("kind"), (upto - F.length("found")).cast("bigint").alias("start"), upto.cast("bigint").alias("end"), "found", "before", "after")


def _passes(kind: str, found: F.Column) -> F.Column:
    n = F.length(F.regexp_replace(found, "[^0-9]", ""))
    if kind == "ip":
        value = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(found, "[.]"), lambda p: (F.length(value(p)) <= 3) & (F.coalesce(value(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "card":
        doubled = lambda c: (2 * c) % 10 + F.floor(2 * c / 10)
        digit = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
        digits = F.split(F.reverse(F.regexp_replace(found, "[^0-9]", "")), "")
        weighed = F.transform(digits, lambda c, i: F.when(i % 2 == 0, digit(c)).otherwise(doubled(digit(c))).cast("bigint"))
        return (n >= 12) & (n <= 19) & (F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, c: a + c) % 10 == 0)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """(rid, kind, start, end, found) of docs (rid, t); failing matches are dropped without a second try."""
    parts = [_found(docs, k, p, NEEDS[k]).where(_passes(k, F.col("found"))).select("rid", "kind", "start", "end", "found") for k, p in KINDS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def units(docs: DataFrame) -> DataFrame:
    """(rid, start, end, found, kind, patterns): units without what is at their edges; kind is that of a base match inside, else null.

    The patterns are the two words before, the word before, the word after (none of them beyond
    another unit) and the unit's shape."""
    words = lambda c: F.array_remove(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), "")
    holds = lambda kind, pattern: F.exists(F.regexp_extract_all("found", F.lit(pattern), F.lit(0)), lambda x: _passes(kind, x))
    kind = F.coalesce(*[F.when(holds(k, p), F.lit(k)) for k, p in KINDS.items()])
    shape = F.regexp_replace(F.regexp_replace("found", r"[\p{L}]+", "a"), "[0-9]+", "9")
    at = _found(docs, "", UNIT, "[0-9@]").withColumn("core", F.regexp_replace("found", f"^{EDGE}+|{EDGE}+$", ""))
    at = at.withColumn("lead", F.length("found") - F.length(F.regexp_replace("found", f"^{EDGE}+", ""))).where(F.length("core").between(*LENGTHS))
    at = at.select("rid", (F.col("start") + F.col("lead")).alias("start"), (F.col("start") + F.col("lead") + F.length("core")).alias("end"), F.col("core").alias("found"),
                   F.reverse(F.slice(F.reverse(words(F.col("before"))), 1, 2)).alias("left"), F.element_at(F.concat(words(F.col("after")), F.array(F.lit(None).cast("string"))), 1).alias("right"))
    patterns = F.array(
        F.when(F.size("left") == 2, F.concat(F.lit("2 "), F.array_join("left", " "))),
        F.when(F.size("left") > 0, F.concat(F.lit("1 "), F.element_at("left", -1))),
        F.concat(F.lit("> "), F.col("right")), F.concat(F.lit("# "), shape))
    return at.select("rid", "start", "end", "found", kind.alias("kind"), F.array_compact(patterns).alias("patterns"))


def learned_strings(seen: DataFrame) -> DataFrame:
    """(found, kind) of the strings that are accepted without being seeds, from :func:`units`.

    A pattern's confidence for a kind is the share of its strings that are accepted as that kind,
    counted with one more that is not, so a context that goes with any kind is a weak pattern for
    each. A string's score for a kind is one less the product of its patterns' doubts; it takes
    the kind of its highest score. Edges are distinct (pattern, string) pairs, so a frequent
    context costs as many rows as it has strings. Turns go on until one accepts nothing new."""
    edges = staged(seen.select("found", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "found").agg(F.min("kind").alias("kind")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("seeds")).where((F.col("n") >= MIN_SUPPORT) & (F.col("n") > F.col("seeds")))
    graph = staged(edges.join(sizes.select("pattern", "n"), "pattern"), "graph")
    known = staged(edges.where("kind is not null").groupBy("found").agg(F.min("kind").alias("kind")).withColumn("turn", F.lit(0)), "known")
    turn = 0
    while True:
        turn += 1
        weight = F.when(F.col("pattern").startswith("#"), SHAPE_WEIGHT).otherwise(1.0)
        support = graph.drop("kind").join(known.select("found", "kind"), "found").groupBy("pattern", "n", "kind").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= MIN_SUPPORT)
        patterns = staged(support.select("pattern", F.col("kind").alias("pkind"), (weight * F.col("k") / (F.col("n") + 1)).alias("conf")), f"patterns{turn}")
        scored = graph.where("kind is null").select("pattern", "found").join(patterns, "pattern").groupBy("found", "pkind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("conf")))), 9).alias("score"))
        best = scored.where(F.col("score") >= MIN_SCORE).groupBy("found").agg(F.max(F.struct("score", F.col("pkind").alias("kind"))).alias("best"))
        new = staged(best.select("found", "best.kind", F.lit(turn).alias("turn")).join(known.select("found"), "found", "left_anti"), f"new{turn}")
        if new.isEmpty():
            return known.where("turn > 0").select("found", "kind")
        known = staged(known.unionByName(new), f"known{turn}")


def _written(spans: DataFrame, name: str) -> DataFrame:
    """(rid, name): kind:start:end in order of start, then kind, comma-joined."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    text = F.concat_ws(":", "kind", "start", "end")
    return spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("k"), F.col("end"), text.alias("s")))).alias("all"), *[
        F.sum((F.col("kind") == k).cast("bigint")).alias(f"n_{k}") for k in KINDS]).select("rid", F.array_join("all.s", ",").alias(name), *[f"n_{k}" for k in KINDS])


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are of the base spans; ``spans`` has the learned ones too, of the
    kind whose contexts gave them. Offsets are code points. A null or empty text has no spans; a
    long text is searched whole; repeated rows are judged each, though copies of a text count
    once as evidence; an empty table gives no rows; a null doc_id stays null; other columns,
    whatever their names, are not read."""
    d = with_row_key(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")), "rid")
    base = staged(base_spans(d), "spans")
    seen = staged(units(d), "units")
    learned = seen.where("kind is null").select("rid", "start", "end", "found").join(learned_strings(seen), "found").select("rid", "kind", "start", "end")
    own = _written(base, "base")
    every = _written(base.select("rid", "kind", "start", "end").unionByName(learned), "spans").select("rid", "spans")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return d.select("rid", "doc_id").join(own, "rid", "left").join(every, "rid", "left").select(
        "doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`personal_data` of the whole documents table."""
    return personal_data(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
