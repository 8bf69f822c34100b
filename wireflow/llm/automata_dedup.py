"""Substring dedup of words by repeated-phrase automata.

Recurring passages are confirmed word for word, one copy of each different passage with the
number of its copies; phrases that cover their repeated windows are compiled into automata,
sharded by anchor; every occurrence of a recurring anchor, in any document, then streams through
the automaton of its shard, and only what matches there is removed."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import ship_code, staged, table, unstage, with_row_key
from wireflow.llm.repeats import MOST_PASSAGES, SPANS, Unit, merged, recurring_groups, solved, whole_keys

LENGTH, K = 35, 12
#: Occurrences of one anchor that stream through one shard, and phrases of one anchor in a shard: more are dealt to several.
SHARD_OCCURRENCES, SHARD_PHRASES = 1 << 11, 1 << 13
PHRASES, DEALT = "a long, phrase binary", "key long, kind int, rid long, i0 int, words binary"


def cover(passages: list[bytes], copies: list[int], unit: Unit) -> list[list[bytes]]:
    """For each passage, phrases of ``length`` words that cover its windows that occur more than once, counted word for word."""
    numbers: dict[bytes, int] = {}
    split = [unit.split(p) for p in passages]
    raws = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint32).tobytes() for words in split]
    size, seen = 4 * unit.length, Counter()
    for raw, n in zip(raws, copies, strict=True):
        for i in range(0, len(raw) - size + 1, 4):
            seen[raw[i : i + size]] += n
    out = []
    for words, raw in zip(split, raws, strict=True):
        starts = [i for i in range(len(words) - unit.length + 1) if seen[raw[4 * i : 4 * i + size]] > 1]
        own, taken = [], -unit.length
        for at, i in enumerate(starts):
            # every length-th window of a run of starts, and the run's first and last
            if i >= taken + unit.length or at + 1 == len(starts) or starts[at + 1] != i + 1 or (at and starts[at - 1] != i - 1):
                own.append(unit.join(words[i : i + unit.length]))
                taken = i
        out.append(own)
    return out


def confirming(unit: Unit) -> Callable:
    """(a, phrase): the phrases of each anchor's passages, without those that its other passages gave too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_keys(batches, ["key", "a", "copies", "passage"]):
            found = cover([r[3] for r in rows], [r[2] for r in rows], unit)
            phrases = dict.fromkeys((r[1], p) for r, own in zip(rows, found, strict=True) for p in own)
            yield pd.DataFrame(list(phrases), columns=["a", "phrase"])

    return run


def streaming(unit: Unit) -> Callable:
    """(rid, first, upto): one Aho-Corasick automaton over the words of some shards' phrases (kind 0), through which their texts (kind 1) stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_keys(batches, ["key", "kind", "rid", "i0", "words"]):
            numbers: dict[bytes, int] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
            for _, kind, _, _, words in rows:
                if not kind:
                    automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in unit.split(words)]))
            out = []
            if numbers:
                automaton.make_automaton()
                get = numbers.get
                for _, kind, rid, i0, words in rows:
                    if kind:  # a word of no phrase is 0
                        out += [(rid, i0 + a, i0 + b) for a, b in merged((end + 1 - n, end + 1) for end, n in automaton.iter(tuple([get(w, 0) for w in unit.split(words)])))]
            yield pd.DataFrame(out, columns=["rid", "first", "upto"])

    return run


def occurrences(unit: Unit) -> Callable:
    """The words of the wanted groups of each text, for every shard that they stream through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, text, wanted in zip(batch["rid"], batch["text"], batch["wanted"], strict=True):
                tokens = unit.split((text or "").encode())
                for g in wanted:
                    i0 = g["i0"]
                    rows.append((g["key"], 1, rid, i0, unit.join(tokens[i0 : i0 + g["n"] - 1 + unit.length])))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["key", "kind", "rid", "i0", "words"])
                    rows = []
            yield pd.DataFrame(rows, columns=["key", "kind", "rid", "i0", "words"])

    return run


def phrase_spans(docs: DataFrame, unit: Unit, most_passages: int = MOST_PASSAGES, shard_occurrences: int = SHARD_OCCURRENCES, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(rid, first, upto): spans of words of docs (rid, text) that matches of recurring phrases cover, written; spans may overlap.

    An anchor's shards are as many as its phrases and its occurrences need; each of its texts
    streams through every shard of phrases, and phrases are in every shard of texts."""
    recurring = recurring_groups(docs, unit)
    phrases = staged(solved(docs, recurring, unit, confirming(unit), PHRASES, most_passages).distinct(), "phrases")
    counts = phrases.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / shard_phrases).cast("int").alias("subs"))
    texts = recurring.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / shard_occurrences).cast("int").alias("salts"))
    shards = staged(counts.join(texts, "a"), "shards")
    key = lambda salt, sub: F.xxhash64("a", salt, sub).alias("key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salted = recurring.join(shards, "a").withColumn("salt", F.pmod(F.xxhash64("rid", "i0"), F.col("salts")).cast("int"))
    wanted = salted.withColumn("sub", every("subs")).select("rid", key("salt", "sub"), "i0", "n").groupBy("rid").agg(F.collect_list(F.struct("key", "i0", "n")).alias("wanted"))
    own = phrases.join(shards, "a").withColumn("sub", F.pmod(F.xxhash64("phrase"), F.col("subs")).cast("int")).withColumn("salt", every("salts"))
    own = own.select(key("salt", "sub"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("rid"), F.lit(0).alias("i0"), F.col("phrase").alias("words"))
    # neighbours in a text overlap, so they are small when written together; the texts' shuffle files go before the next shuffle
    stream = staged(docs.select("rid", "text").join(wanted, "rid").mapInPandas(occurrences(unit), DEALT), "stream", "zstd")
    unstage(recurring)
    dealt = own.unionByName(stream).repartition("key").sortWithinPartitions("key", "kind")
    spans = dealt.mapInPandas(streaming(unit), SPANS)
    out = staged(spans.groupBy("rid").agg(F.collect_set(F.struct("first", "upto")).alias("spans")), "spans")
    unstage(stream, phrases, shards)
    return out


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def removing(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                words = (text or "").encode().split()
                n, kept, at = len(words), [], 0
                for a, b in merged((s["first"], s["upto"]) for s in spans) if spans is not None else []:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                left = b" ".join(kept)
                rows.append((doc, n, n - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "text"]).astype({"doc_id": "Int64"})

    return run


def drop_repeated_phrases(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, k: int = K, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and (if asked) the text left.

    A word goes if a window of ``length`` words that also starts elsewhere covers it, in the
    same document or another; all copies go. A null, empty or short text loses nothing; a long
    text is taken whole, a stretch at a time; rows that repeat or tie lose what they share; an empty
    table gives no rows; a null doc_id stays null; other columns, whatever their names, are not read."""
    ship_code(docs.sparkSession)
    d = with_row_key(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "rid")
    out = d.join(phrase_spans(d, Unit(True, length, k)), "rid", "left").select("doc_id", "text", "spans").mapInPandas(removing(with_text), SCHEMA)
    return out if with_text else out.drop("text")


def op3_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`drop_repeated_phrases` of the whole documents table, without the texts."""
    return drop_repeated_phrases(table(spark, sf_dir, "documents"), with_text=False)


SQL: dict[str, str] = {}
