import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireflow.llm.automata_dedup import drop_repeated_phrases, op3_automata_dedup
from wireflow.llm.bwt_dedup import drop_repeated_bytes, op6_bwt_dedup
from wireflow.llm.common import table
from wireflow.llm.repeats import SPANS, Unit, repeated_spans, stretches

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(texts, length, words):
    rows = [SPLIT.findall((t or "").encode()) if words else (t or "").encode() for t in texts]
    key = (lambda r, i: tuple(r[i : i + length])) if words else (lambda r, i: r[i : i + length])
    seen = Counter(key(r, i) for r in rows for i in range(len(r) - length + 1))
    out = []
    for r in rows:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[key(r, i)] > 1:
                gone[i : i + length] = [True] * length
        out.append((r, gone))
    return out


def expected_words(texts, length):
    out = []
    for r, gone in brute(texts, length, True):
        kept = [w for w, g in zip(r, gone) if not g]
        out.append((len(r), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def expected_bytes(texts, length):
    out = []
    for r, gone in brute(texts, length, False):
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["a", "bé", "c", "the", "wö", "x\x00y"] + [f"w{i}" for i in range(300)]
    phrase = [r.choice(vocab) for _ in range(40)]
    texts = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 20, 80, 200]))]
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = phrase[: r.choice([5, 11, 12, 30, 40])]
        if i % 10 == 1 and texts:
            w = (texts[-1] or "").split()
            if w:
                w[r.randrange(len(w))] = "edit"
        texts.append(r.choice([" ", "\n", " \t"]).join(w))
    return [*texts, None, "", " ", "a " * 100, "a " * 99, texts[4], texts[4], "é" * 300]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_brute(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeated_phrases(df, length=12, k=5).collect()}
    assert [got[i] for i in range(len(texts))] == expected_words(texts, 12)


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_brute(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in drop_repeated_bytes(df, length=40, k=12).collect()}
    assert [got[i] for i in range(len(texts))] == expected_bytes(texts, 40)


@pytest.mark.parametrize("words", [True, False])
def test_hot_anchor_is_split(spark, words):
    """One passage in every text, between texts of its own: its anchors have as many passages as there are texts."""
    from wireflow.llm.automata_dedup import phrase_spans
    from wireflow.llm.bwt_dedup import repeated

    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    phrase = " ".join(word() for _ in range(30))
    texts = [" ".join([*(word() for _ in range(r.randrange(30))), phrase, *(word() for _ in range(r.randrange(30)))]) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    length = 15 if words else 80
    unit = Unit(words, length, length // 3)
    if words:
        spans = phrase_spans(df, unit, most_passages=7, shard_occurrences=5, shard_phrases=3).select("rid", F.explode("spans").alias("x")).select("rid", "x.*").collect()
    else:
        spans = repeated_spans(df, unit, repeated, most_passages=7).collect()
    got = [set() for _ in texts]
    for s in spans:
        got[s.rid].update(range(s.first, s.upto))
    assert got == [{i for i, g in enumerate(gone) if g} for _, gone in brute(texts, length, words)]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, rid int, spans int, a int")
    assert drop_repeated_phrases(df).count() == 0
    assert drop_repeated_bytes(df).count() == 0
    df = spark.createDataFrame([(None, "a b " * 60, 1), (None, "a b " * 60, 2), (3, None, 4)], "doc_id long, text string, rid int")
    assert sorted((r.n_words, r.n_removed) for r in drop_repeated_phrases(df).collect()) == [(0, 0), (120, 120), (120, 120)]
    assert SPANS


def test_stretches_name_the_same_anchors():
    r = np.random.default_rng(6)
    codes, unit = r.integers(1, 2**60, 1000).astype(np.uint64), Unit(False, 40, 12)
    codes[300:500] = codes[700:900]

    def windows(groups):
        return {int(w): (int(a), int(i0 + am)) for _, aa, _, ii, nn, mm in groups for a, i0, n, am in zip(aa, ii, nn, mm) for w in range(i0, i0 + n)}

    whole = windows(stretches(codes, np.array([0, 1000]), unit))
    assert len(whole) == 961 and windows(stretches(codes, np.array([0, 1000]), unit, 64)) == whole


def test_very_long_texts(spark):
    """Texts of several stretches, with one passage over the border of two and again near the end."""
    r = np.random.default_rng(7)
    letters = r.integers(97, 123, 2_300_000).astype(np.uint8)
    at, size, border = 2_200_000, 300, 1 << 20
    letters[at : at + size] = letters[border - 150 : border - 150 + size]
    letters[[at - 1, at + size]] = ord("0")
    df = spark.createDataFrame([(1, letters.tobytes().decode()), (2, "short")], "doc_id long, text string")
    assert [(x.n_bytes, x.n_removed, x.n_spans) for x in drop_repeated_bytes(df, with_bytes=False).orderBy("doc_id").collect()] == [(2_300_000, 2 * size, 2), (5, 0, 0)]
    words = r.integers(0, 50_000, 2_300_000)
    words[at : at + 60] = words[border - 30 : border + 30]
    words[[at - 1, at + 60]] = 60_000
    df = spark.createDataFrame([(1, " ".join(map(str, words.tolist())))], "doc_id long, text string")
    assert [(x.n_words, x.n_removed) for x in drop_repeated_phrases(df, with_text=False).collect()] == [(2_300_000, 120)]


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents").collect()
    texts = [r.text for r in docs]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op3_automata_dedup(spark, sf).collect()}
    assert [got[r.doc_id] for r in docs] == expected_words(texts, 35)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_bwt_dedup(spark, sf).collect()}
    assert [got[r.doc_id] for r in docs] == expected_bytes(texts, 200)
