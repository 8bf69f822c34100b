import random
import re
from collections import Counter, defaultdict
from math import comb, log

import numpy as np
import pandas as pd

from wireflow.llm.common import table
from wireflow.llm.near_dedup import EXTRA, SIFT, components, digest, five_bytes, from_five_bytes, keep_one_of_each, links, near_dedup, op10_near_dedup, samples


def classes(texts, size=5, least=0.8):
    """Brute force: all pairs that share a shingle, exact weighted Jaccard, union-find."""
    bags = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags.append(Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter())
    n = len(texts)
    df = Counter(s for b in bags for s in b)
    weight = {s: log((1 + n) / (1 + k)) + 1 for s, k in df.items()}
    own = [sum(c * weight[s] for s, c in b.items()) for b in bags]
    shared = defaultdict(float)
    where = defaultdict(list)
    for i, b in enumerate(bags):
        for s, c in b.items():
            for j, cj in where[s]:
                shared[j, i] += min(c, cj) * weight[s]
            where[s].append((i, c))
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    border = set()
    for (i, j), both in shared.items():
        s = both / (own[i] + own[j] - both)
        if s >= least:
            a, b = sorted((root(i), root(j)))
            top[b] = a
    same = {}
    for i, b in enumerate(bags):
        if not b:
            top[root(i)] = same.setdefault("", i) if root(i) != root(same.setdefault("", i)) else top[root(i)]
    return [root(i) for i in range(n)], border


def test_samples_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    h = r.integers(1, 2**63, 300).astype(np.uint64)
    a, b = r.uniform(0.5, 4, 300), r.uniform(0.5, 4, 300)
    k = 3000
    hs, text, w = np.concatenate([h, h]), np.repeat([0, 1], 300), np.concatenate([a, b])
    order = np.lexsort((hs, text))
    s = samples(hs[order], text[order], w[order], 3, k)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert not s[2].any()


def test_components(spark):
    path = [(i + 1, i) for i in range(100, 140)] + [(5, 3), (9, 5), (7, 9)]
    got = {r.rid: r.label for r in components(spark.createDataFrame(path, "x long, y long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in (3, 5, 7, 9)} == {3}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    common = [r.choice(vocab) for _ in range(30)]
    texts = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([2, 30, 120, 300]))]
        if i % 3 == 0:
            w = common + w
        texts.append(" ".join(w))
        for _ in range(r.choice([0, 0, 1, 4])):
            c = list(w)
            for _ in range(max(1, len(c) // 100)):
                c[r.randrange(len(c))] = r.choice(vocab)
            texts.append(" ".join(c))
    base = [r.choice(vocab) for _ in range(200)]
    for _ in range(40):  # a large group of near copies, some pairs just under the threshold
        c = list(base)
        for _ in range(r.randrange(5)):
            c[r.randrange(200)] = r.choice(vocab)
        texts.append(" ".join(c))
    return [*texts, None, "", "  \n", texts[0], texts[0], "a b", "a  b"]


def compared(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = near_dedup(df, **options).collect()
    want, _ = classes(texts)
    first = {}
    for i, c in enumerate(want):
        first.setdefault(c, i)
    assert {r.doc_id: r.class_id for r in rows} == {i: first[c] for i, c in enumerate(want)}
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(set(first.values()))
    sizes = Counter(want)
    assert all(r.class_size == sizes[want[r.doc_id]] for r in rows)


def test_brute_force(spark):
    compared(spark, corpus(3))


def test_brute_force_of_all_pairs_of_a_bucket(spark):
    """sift = 1 leaves no pair of a bucket unchecked, and 40 bands leave hardly a pair without one."""
    compared(spark, corpus(5), bands=40, sift=1.0)


def test_recall_by_class_size(spark):
    """Chains of pairs just above the threshold: the share of links whose ends end up in one class."""
    r = random.Random(8)
    groups = []
    for size in [2] * 60 + [5] * 20 + [30] * 3:
        base = [f"g{len(groups)}w{i}" for i in range(200)]
        group = []
        for k in range(size):
            c = list(base)
            for at in r.sample(range(200), 3 if k else 0):
                c[at] = f"n{r.random()}"
            group.append(" ".join(c))
        groups.append(group)
    texts = [t for g in groups for t in g]
    want, _ = classes(texts)
    got = {x.doc_id: x.class_id for x in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at, hits = 0, defaultdict(list)
    for g in groups:
        for i in range(at, at + len(g)):
            for j in range(at, i):
                if want[i] == want[j]:
                    hits[len(g)].append(got[i] == got[j])
        at += len(g)
    assert set(hits) == {2, 5, 30} and all(np.mean(h) >= 0.99 for h in hits.values())


def test_sift_loses_few_links():
    """The chance that a pair of similarity 0.8 agrees at too few further samples, a byte of each compared."""
    p, least = 0.8 + 0.2 / 256, int(np.ceil(EXTRA * (0.8 - SIFT)))
    assert sum(comb(EXTRA, k) * p**k * (1 - p) ** (EXTRA - k) for k in range(least)) < 0.001


def test_five_bytes():
    keys = np.array([0, 1, 255, 256, 2**40 - 1], np.uint64)
    column = pd.Series([x.tobytes() for x in five_bytes(keys)])
    import pyarrow as pa

    assert (from_five_bytes(pa.chunked_array([pa.array(column, pa.binary())]), np.arange(5)) == keys + (np.arange(5, dtype=np.uint64) << np.uint64(40))).all()


def test_digest():
    assert digest(b" a  b\n\tc\x0b") == digest(b"a b c") != digest(b"ab c") and digest(b"") == digest(b" \n ")
    assert digest("a\u00a0b".encode()) != digest(b"a b")


def test_whole_table(spark, sf):
    docs = sorted(table(spark, sf, "documents").collect(), key=lambda r: r.doc_id)
    want, _ = classes([r.text for r in docs])
    got = {r.doc_id: r.class_id for r in op10_near_dedup(spark, sf).collect()}
    group = defaultdict(set)
    for r, c in zip(docs, want):
        group[c].add(r.doc_id)
    assert {r.doc_id: min(group[c]) for r, c in zip(docs, want)} == got


def test_odd_tables(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string, rid int")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 1), (4, "a b c d e f", 2)], "doc_id long, text string, rid int")
    rows = near_dedup(df).collect()
    assert [r.class_id for r in rows] == [4, 4, 4] and sum(r.kept for r in rows) == 1
    assert all(r.class_id is None for r in near_dedup(df.where("doc_id is null")).collect())


def test_very_long_texts(spark):
    r = random.Random(2)
    long = [f"w{r.randrange(50000)}" for _ in range(300_000)]
    other = list(long)
    for at in r.sample(range(300_000), 1000):
        other[at] = "x"
    texts = [" ".join(long), " ".join(other), "w " * 200_000, "w " * 100_000, " ".join(r.sample(long, 100_000)), "a " * 3]
    assert {x.doc_id: x.class_id for x in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_keep_one_of_each(spark):
    schema = "doc_id long, text string, rid int, bucket string, __rid int"
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a, 1, "x", 5), (1, a, 1, "x", 5), (2, a + " end", 2, None, None), (None, "b", 1, "x", 5), (None, None, 7, "", 0), (9, " \n", 7, "", 0), (8, "", 7, "", 0)]
    df = spark.createDataFrame(rows, schema)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(x) for x in [df.collect()[0], df.collect()[3], df.collect()[6]])
    assert keep_one_of_each(df.limit(0)).count() == 0


def test_keys_do_not_depend_on_the_splits(spark, sf, tmp_path):
    """Texts and decisions are joined by written numbers, whatever the parallelism of each scan."""
    docs = table(spark, sf, "documents")
    docs.repartition(7).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        kept = keep_one_of_each(read)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # other splits from now on
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(r.doc_id for r in op10_near_dedup(spark, sf).where("kept").collect())


def test_bridge_of_two_closed_clusters(spark):
    """Two clusters of 110 in the same 12 buckets, joined by one pair alone; neither end of it is like the other cluster."""
    def jaccard(batches):
        """Distances of pairs of texts as sets of words."""
        for b in batches:
            sets = [(set(p.split()), set(q.split())) for p, q in zip(b["tx"], b["ty"])]
            yield pd.DataFrame({"x": b["x"], "y": b["y"], "distance": [1 - len(p & q) / len(p | q) for p, q in sets]})

    words = lambda stem, n: [f"{stem}{i}" for i in range(n)]
    core, left, right = words("c", 100), words("l", 20), words("r", 20)
    texts = {i: core + left + [f"x{i}"] for i in range(110)} | {i + 200: core + right + [f"y{i}"] for i in range(110)}
    texts |= {150: core + left[:10], 350: core + right[:10], 400: words("z", 120)}
    alike = [(i, j) for i in texts for j in texts if i > j and len(set(texts[i]) & set(texts[j])) >= 0.8 * len(set(texts[i]) | set(texts[j]))]
    assert [(i, j) for i, j in alike if i >= 200 and j < 200] == [(350, 150)]
    bags = spark.createDataFrame([(i, bytearray(" ".join(t).encode())) for i, t in texts.items()], "rid long, bag binary")
    members = spark.createDataFrame([(b, i, list(range(12)), bytearray(4)) for b in range(12) for i in texts], "bucket long, rid long, bands array<long>, sketch binary")
    for block in (1024, 50):
        found = links(members, bags, jaccard, 0.2 + 1e-9, 0, block)
        assert {r.rid: r.label for r in components(found).collect()} == {i: 0 for i in texts if i != 400}
        assert {(r.x, r.y) for r in found.collect()} <= set(alike)


def test_all_shingles_are_weighed_by_their_counts(spark):
    """A passage in 1 % of the documents weighs less than what is in one: 0.76 here, but 0.82 if both weighed the same."""
    words = lambda stem, n: [f"{stem}{i}" for i in range(n)]
    passage = words("p", 184)
    texts = [passage + words(f"own{i}x", 20) for i in range(20)] + [words("q", 200) + ["a"], words("q", 200) + ["b"]]
    texts += [[f"f{i}"] for i in range(2000 - len(texts))]
    bags = [Counter(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) for t in texts]
    df = Counter(s for b in bags for s in b)
    weight = {s: log(2001 / (1 + k)) + 1 for s, k in df.items()}
    alike = []
    for i in range(22):
        for j in range(i):
            either = set(bags[i]) | set(bags[j])
            s = sum(weight[x] for x in set(bags[i]) & set(bags[j])) / sum(weight[x] for x in either)
            alike += [(j, i)] * (s >= 0.8)
    assert alike == [(20, 21)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {(r.class_id, r.doc_id) for r in near_dedup(docs).collect() if r.class_id != r.doc_id} == set(alike)


def test_long_texts_are_blocks_of_their_own(spark, monkeypatch):
    """Texts above a block's share of bytes are counted and banded apart, with the same classes."""
    import wireflow.llm.near_dedup as nd

    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words, int(n))) for n in r.integers(3, 200, 40)]
    texts = base + [b + " more" for b in base[::2]] + base[::3] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {x.doc_id: (x.class_id, x.class_size, x.kept) for x in near_dedup(df).collect()}
    want = found()
    monkeypatch.setattr(nd, "BLOCK_BYTES", 300 << nd.BLOCK_BITS)
    assert 5 < sum(len(t or "") > nd.longest(nd.BLOCK_BITS) for t in texts) < len(texts)
    assert found() == want
    label, _ = classes(texts)
    assert {i: v[0] for i, v in want.items()} == {i: min(j for j, x in enumerate(label) if x == label[i]) for i in range(len(texts))}
