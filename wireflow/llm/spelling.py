"""Spelling variants: words that differ by one letter, found in a trie of letter counts.

Letters are dealt to groups, and a word is the vector of its counts, group by group. A trie over
these vectors is searched depth first: one inserted letter raises one count by one, one deleted
letter lowers one, a replaced letter does both or neither, so a search may spend one surplus and
one deficit in all. The words of a leaf are verified letter by letter.

The trie is cut into shards below its upper levels, which are tables: a shard is a node with at
most SHARD words, and a word is searched in every shard that its budget leads to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import ship_code, staged, table, unstage

RUN = re.compile("[a-zÀ-ÿ]+")
#: Of DAMAGE runs about one loses a letter; words have so many letters and occurrences at least.
DAMAGE, LEAST_LETTERS, LEAST_COUNT = 97, 5, 3
#: Letters by how common they are: one group each; the others (see GROUP) are dealt to them by their code points.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
#: Words of a shard, and words searched in it by one task.
SHARD, SEARCHED = 1 << 17, 1 << 16
#: Pairs below which a search stops going down and looks at the words, pairs verified at a time, counts held by a counting task,
#: and letters of a long text that are read at a time.
LEAF, PAIRS, HELD, STRETCH = 1 << 13, 1 << 18, 1 << 18, 1 << 20
#: Counts of a group above this are taken for alike, which only lets more words through to the verification.
MOST = 100
GROUP = np.zeros(256, np.int64)
GROUP[192:] = np.arange(64) % len(LETTERS)
for _i, _x in enumerate(LETTERS):
    GROUP[ord(_x)] = _i


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of rows (doc_id as text, text): runs in lower case, damaged, those of five letters or more."""
    counts: Counter = Counter()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            start = zlib.crc32(f"{doc or ''}:".encode())
            for own in _runs((text or b"").lower().decode()):
                for run, n in own.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DAMAGE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= LEAST_LETTERS:
                        counts[run] += n
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts.clear()
    if counts:
        yield _counted(counts)


def _runs(text: str) -> Iterator[Counter]:
    """The runs of a text with their counts, so many runs at a time."""
    if len(text) <= STRETCH:
        yield Counter(RUN.findall(text))
        return
    own: Counter = Counter()
    for m in RUN.finditer(text):
        own[m.group()] += 1
        if len(own) > HELD:
            yield own
            own = Counter()
    yield own


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def group_letters(i: int) -> str:
    return "".join(chr(x) for x in range(256) if (chr(x) in LETTERS or x >= 192) and GROUP[x] == i)


def group_count(word, i: int) -> F.Column:
    """How many letters of a word are in a group."""
    return F.length(word) - F.length(F.translate(word, group_letters(i), ""))


def digit(n) -> F.Column:
    """A count as one letter; all above MOST are alike."""
    return F.chr(F.lit(48) + F.least(n, F.lit(MOST)))


def sharded(words: DataFrame, shard: int, searched: int) -> DataFrame:
    """(node, block, word, n, surplus, deficit) of the words (word, n) of every shard (n) and of those that are searched there (n null).

    Level by level, nodes with too many words are split by the count of the next group of
    letters; words and searches go down together. Searches of a shard are dealt to blocks, each
    with the words of the shard."""
    stored = words.select("word", "n", F.lit("").alias("node"))
    asked = words.select("word", F.lit("").alias("node"), F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))
    homes, sent = [], []
    for level in range(len(LETTERS) + 1):
        sizes = stored.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
        nodes = staged(sizes.select("node", ((F.col("k") > shard) & (F.lit(level) < len(LETTERS))).alias("split")), "nodes")
        stored, asked = (staged(x.join(nodes, "node"), "level") for x in (stored, asked))
        homes.append(stored.where("not split").drop("split"))
        sent.append(asked.where("not split").drop("split"))
        stored, asked = stored.where("split").drop("split"), asked.where("split").drop("split")
        if level == len(LETTERS) or nodes.where("split").isEmpty():
            break
        own = group_count("word", level)
        stored = stored.withColumn("node", F.concat("node", digit(own)))
        # the stored count may be one more (a surplus) or one less (a deficit), once each
        step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        asked = asked.withColumn("own", own).withColumn("step", step).where("own + step >= 0 and (step < 1 or surplus = 0) and (step > -1 or deficit = 0)")
        asked = asked.select("word", F.concat("node", digit(F.col("own") + F.col("step"))).alias("node"), F.when(F.col("step") == 1, 1).otherwise(F.col("surplus")).alias("surplus"), F.when(F.col("step") == -1, 1).otherwise(F.col("deficit")).alias("deficit"))
    home, search = homes[0], sent[0]
    for h, s in zip(homes[1:], sent[1:], strict=True):
        home, search = home.unionByName(h), search.unionByName(s)
    blocks = staged(search.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / searched).cast("int").alias("blocks")), "blocks")
    none = F.lit(None).cast("long")
    home = home.join(blocks, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "block", "word", "n", F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))
    search = search.join(blocks, "node").select("node", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), "word", none.alias("n"), "surplus", "deficit")
    return home.unionByName(search)


class Words:
    """Words as Latin-1 bytes, laid end to end, with their vectors."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.data = np.frombuffer(b"".join(raw) + bytes(1), np.uint8)
        self.first = np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(len(raw)), self.size)
        counts = np.bincount(owner * len(LETTERS) + GROUP[self.data[:-1]], minlength=len(raw) * len(LETTERS)).reshape(len(raw), len(LETTERS))
        self.vector = np.minimum(counts, MOST).astype(np.int8)


def search(words: Words, order: np.ndarray, top: int, asked: Words, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, word) pairs whose vectors differ by the budget at most: all searches go down the trie together, depth first.

    The words are alike in the groups above level ``top``, on which the budgets given are spent
    already. A node is a stretch of the words in the order of their vectors; what is spent of a
    budget goes along. Where few pairs are left, the rest of their vectors is compared at once."""
    vector = words.vector[order]
    levels = vector.shape[1]
    stack = [(0, len(order), top, np.arange(len(surplus)), surplus.astype(np.int8), deficit.astype(np.int8))]
    while stack:
        lo, hi, level, who, up, down = stack.pop()
        if len(who) * (hi - lo) <= LEAF or level == levels:
            block = max(1, PAIRS // (hi - lo))
            for at in range(0, len(who), block):
                a = np.repeat(who[at : at + block], hi - lo)
                b = np.tile(np.arange(lo, hi), len(a) // (hi - lo))
                apart = vector[b, level:] - asked.vector[a, level:]
                more, less = np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1)
                near = (more + np.repeat(up[at : at + block], hi - lo) <= 1) & (less + np.repeat(down[at : at + block], hi - lo) <= 1)
                yield a[near], order[b[near]]
            continue
        column = vector[lo:hi, level]
        cuts = np.append(np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1), hi - lo)
        own = asked.vector[who, level]
        for i in range(len(cuts) - 1):
            apart = column[cuts[i]] - own
            u, d = up + (apart == 1), down + (apart == -1)
            near = (np.abs(apart) <= 1) & (u <= 1) & (d <= 1)
            if near.any():
                stack.append((lo + cuts[i], lo + cuts[i + 1], level + 1, who[near], u[near], d[near]))


def one_apart(x: Words, i: np.ndarray, y: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of x and j of y differ by exactly one inserted, deleted or replaced letter: what they share from the front and from the back."""
    a, b = x.size[i], y.size[j]
    short = np.minimum(a, b)
    front, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for end, shared in ((False, front), (True, back)):
        go, k = np.arange(len(i)), 0
        while len(go):
            go = go[short[go] > k]
            p = x.first[i[go]] + (a[go] - 1 - k if end else k)
            q = y.first[j[go]] + (b[go] - 1 - k if end else k)
            go = go[x.data[p] == y.data[q]]
            k += 1
            shared[go] = k
    longest = np.maximum(a, b)
    return (longest - short <= 1) & (front + back >= longest - 1) & ~((a == b) & (front == a))


def searching(group: pa.Table) -> pa.Table:
    """(word, near, form, form_n) of a block: for each word searched, its near words among the shard's, and of these the one of largest n."""
    n = group.column("n").to_pylist()
    here = [x is not None for x in n]
    names = group.column("word").to_pylist()
    stored = [w for w, x in zip(names, here, strict=True) if x]
    rank = {w: i for i, w in enumerate(sorted(stored))}
    counts = np.array([x for x in n if x is not None], np.int64)
    ranks = np.array([rank[w] for w in stored], np.int64)
    ask = [w for w, x in zip(names, here, strict=True) if not x]
    budget = np.array([group.column(c).to_numpy() for c in ("surplus", "deficit")])[:, ~np.array(here, bool)]
    words, asked = Words(stored), Words(ask)
    order = np.lexsort(words.vector.T[::-1])
    found, held, a, b = [], 0, [], []
    for i, j in search(words, order, len(group.column("node")[0].as_py()), asked, *budget):
        a.append(i)
        b.append(j)
        held += len(i)
        if held > PAIRS:
            found.append(_near(asked, words, a, b))
            held, a, b = 0, [], []
    found.append(_near(asked, words, a, b))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.lexsort((ranks[j], -counts[j], i))
    i, j = i[best], j[best]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
    near = np.diff(np.append(first, len(i)))
    return pa.table({"word": pa.array([ask[k] for k in i[first]], pa.string()), "near": pa.array(near, pa.int64()), "form": pa.array([stored[k] for k in j[first]], pa.string()), "form_n": pa.array(counts[j[first]], pa.int64())})


def _near(asked: Words, words: Words, a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    good = one_apart(asked, i, words, j)
    return i[good], j[good]


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): where forms lead to in the end, by pointer doubling. A form has twice the count of its word, so a chain has at most as many steps as the largest count has binary digits."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = staged(now.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        now = step.drop("moved")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD, searched: int = SEARCHED) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Texts are read whole; null, empty and letterless texts give no words. A null doc_id damages
    runs as an empty one would. Repeated rows count again; an empty table gives no rows; other
    columns, whatever their names, are not read. A task holds at most ``shard`` words (or the
    words of equal counts in all groups, anagrams of each other, if these are more) and about
    ``searched`` searches."""
    ship_code(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    words = own.mapInArrow(counting, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    words = staged(words, "words")
    dealt = staged(sharded(words, shard, searched), "sharded")
    found = dealt.groupBy("node", "block").applyInArrow(searching, "word string, near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("o"), "form")).alias("b"))
    best = staged(best.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.o")).alias("form_n")), "near")
    unstage(dealt)
    rows = words.join(best, "word", "left")
    follows = F.col("form_n") >= 2 * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n"))
    rows = staged(rows, "forms")
    roots = rooted(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`spelling_variants` of the whole documents table."""
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
