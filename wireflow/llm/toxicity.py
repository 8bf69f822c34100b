"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words (whole, and by stems of their first bytes, which inflected forms share), pairs of
neighbours and pairs with one word between; each counts once for a text, however long it is.
Every coordinate has a learning rate of its own, which falls as its gradients add up, and the L1
term keeps all coordinates at zero that never gather enough evidence. So the model is a short
list of weights, which is broadcast and adds up over the features that a text has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import ship_code, staged, table
from wireflow.llm.near_dedup import slices
from wireflow.llm.repeats import BASE, BYTE_CODES, Sums, mixed

#: The bound of the training sample: labelled documents, those of smallest md5 of their doc_id.
SAMPLE = 6_000
#: A feature is hashed to a coordinate of 2^BITS and a tag of TAG bits. The first feature at a coordinate owns it, and others that
#: meet it are left out, so a text of many words does not run into weights of other features. The model has at most 2^BITS weights.
BITS, TAG = 24, 16
#: Bytes of the stems that count beside whole words, and how far the words of a pair are apart (2: one word between).
STEMS, GAPS = (4, 5, 6, 8), (1, 2)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 1.0, 8
THRESHOLD = 0.3
#: Words are runs of letters, digits and bytes above ASCII, in lower case; all other bytes become blanks.
FOLDED = np.full(256, 32, np.uint8)
FOLDED[48:58] = np.arange(48, 58)
FOLDED[65:91] = FOLDED[97:123] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)
ODD = np.uint64(0x9E3779B97F4A7C15)


def bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of every word of folded texts laid end to end."""
    inside = data != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(data))]  # no word goes on from one text to the next
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of every word, stem, pair of neighbours and pair with one word between, of texts laid end to end."""
    data = FOLDED[data]
    first, upto = bounds(data, starts)
    text = np.searchsorted(starts, first, side="right") - 1
    sums = Sums(BYTE_CODES[data], BASE)
    words = sums(first, upto)
    found, owners = [words], [text]
    for n in STEMS:
        long = upto - first > n
        found.append(sums(first[long], first[long] + n) + np.uint64(n))
        owners.append(text[long])
    for gap in GAPS:
        same = text[gap:] == text[:-gap]
        found.append(words[:-gap][same] * ODD + mixed(words[gap:][same] + np.uint64(gap)))
        owners.append(text[gap:][same])
    return (mixed(np.concatenate(found)) & np.uint64((1 << BITS + TAG) - 1)).astype(np.int64), np.concatenate(owners)


def distinct(feature: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (feature, text) once, in order of texts; there are fewer than 2^23 texts at a time."""
    both = np.unique(text << BITS + TAG | feature)
    return both & ((1 << BITS + TAG) - 1), both >> BITS + TAG


def extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, features) of rows (key, label, text)."""
    for batch in batches:
        for at, upto, data, starts in slices(batch, 2):
            f, text = distinct(*features(data, starts))
            cuts = np.searchsorted(text, np.arange(upto - at + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at), pa.ListArray.from_arrays(pa.array(cuts), pa.array(f))], names=["key", "label", "features"])


class Ftrl:
    """The state of the learner: for each coordinate its owner's tag, the sum of adjusted gradients and of squared ones; the bias has no L1 term."""

    def __init__(self, offset: float):
        self.z, self.n, self.tag = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.uint16)
        self.bias, self.offset = [0.0, 0.0], offset

    def owned(self, feature: np.ndarray) -> np.ndarray:
        """The coordinates that features own, those taken now for the first time among them."""
        at, tag = feature >> TAG, (feature & ((1 << TAG) - 1) | 1).astype(np.uint16)
        free = self.tag[at] == 0
        self.tag[at[free]] = tag[free]
        return at[self.tag[at] == tag]

    def learn(self, feature: np.ndarray, label: int) -> None:
        at = self.owned(feature)
        z, n = self.z[at], self.n[at]
        w = weights(z, n, L1)
        b = weights(*self.bias, 0.0)
        g = logistic(self.offset + b + w.sum()) - label
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        z, n = self.bias
        self.bias = [z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * b, n + g * g]


def weights(z, n, least: float):
    return np.where(np.abs(z) <= least, 0.0, -(z - np.sign(z) * least) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learning(offset: float) -> Callable:
    """(feature, weight), zeros left out, after all rows (features, label) have come by in their order; the bias is feature -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(offset)
        for batch in batches:
            lists, labels = batch.column(0), batch.column(1).to_numpy()
            values, cuts = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            for i, label in enumerate(labels):
                model.learn(values[cuts[i] : cuts[i + 1]], int(label))
        w = weights(model.z, model.n, L1)
        at = np.flatnonzero(w)
        feature = np.append(at << TAG | model.tag[at], -1)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(np.append(w[at], weights(*model.bias, 0.0)).astype(np.float64))], names=["feature", "weight"])

    return run


def scoring(feature: np.ndarray, weight: np.ndarray, offset: float) -> Callable:
    """(doc_id, held_out, score) of rows (doc_id, held_out, text)."""
    own = feature >= 0
    bias = offset + float(weight[~own].sum())
    order = np.argsort(feature[own])
    feature, weight = feature[own][order], weight[own][order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, bool)  # most features have no weight: a small table of bits says so
        maybe[feature & ((1 << 20) - 1)] = True
        for batch in batches:
            for first, upto, data, starts in slices(batch, 2):
                f, text = features(data, starts)
                f |= 1  # as the owners' tags are
                near = np.flatnonzero(maybe[f & ((1 << 20) - 1)])
                f, text = distinct(f[near], text[near])
                at = np.minimum(np.searchsorted(feature, f), max(len(feature) - 1, 0))
                w = np.where(feature[at] == f, weight[at], 0.0) if len(feature) else np.zeros(len(f))
                score = logistic(bias + np.bincount(text, w, upto - first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, upto - first), batch.column(1).slice(first, upto - first), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The model learns from at most ``sample`` documents whose labels are not held out, whole texts,
    EPOCHS times over in the order of a hash, in one task that reads them as a stream. Of several
    labels of a doc_id the largest counts, of several texts the first in string order; labels
    that are null or belong to no document are not learnt from, and a null doc_id has no label.
    Without any labels, or for a text without words (null, empty, blank), the score is the smoothed
    rate of the labels, moved by the bias. Every text is read whole; repeated rows score alike; an
    empty table gives no rows; other columns, whatever their names, are not read."""
    ship_code(docs.sparkSession)
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    known = own.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("key", F.md5(F.col("doc_id").cast("string"))).orderBy("key").limit(sample)
    known = staged(known, "labelled")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # at most ``sample`` short rows
    train = texts.join(F.broadcast(known.withColumnRenamed("doc_id", "known")), F.col("doc_id") == F.col("known")).groupBy("key", "label").agg(F.min("text").alias("text"))
    train = staged(train.mapInArrow(extracting, "key string, label int, features array<long>").repartition(1).sortWithinPartitions("key"), "training")
    n, positive = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = (positive + 0.5) / (n + 10)
    offset = float(np.log(rate / (1 - rate)))
    order = train.select("features", "label")
    for _ in range(EPOCHS - 1):
        order = order.union(train.select("features", "label"))
    # one task reads the table again and again, without a shuffle, and holds no more than the state of the learner
    model = staged(order.coalesce(1).mapInArrow(learning(offset), "feature long, weight double"), "weights").toPandas()
    scored = texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(scoring(model["feature"].to_numpy(), model["weight"].to_numpy(), offset), f"doc_id {dict(texts.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`toxicity` of the whole documents table, learnt from the labels table."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
