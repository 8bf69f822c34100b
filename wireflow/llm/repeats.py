"""Passages of a fixed least length that occur more than once, anywhere in a corpus.

A text is a row of tokens (words or bytes); a window is ``length`` consecutive tokens of one
document. Every window names an anchor, its smallest k-gram by hash, so equal windows name
equal anchors; consecutive windows with one anchor make a group, about two for every
``length - k`` tokens. Only groups whose anchor recurs can hold a repeated window:

1. all texts are hashed into groups (no text is shuffled);
2. anchors are counted, and the passages of recurring ones. Passages are told apart by a hash
   of 64 bits among those of one anchor, so one is taken for another with a chance of the
   anchor's different passages in 2^64;
3. one copy of each different passage is cut from its text and dealt by anchor; an anchor
   with too many passages is split again and again by the text that half of its windows
   share, so no task gets an unbounded group;
4. a solver finds the repeated windows of each anchor among its passages, token by token.

:func:`repeated_spans` gives each occurrence of a passage the spans that the solver finds in the
copy of it; :func:`solved` gives whatever a solver says of the passages of each anchor. Solvers
are told how often each passage occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.llm.common import ship_code, staged, unstage

#: An anchor with more different passages than this is split; so a solver never holds more of one anchor.
MOST_PASSAGES = 1 << 15
#: Bytes of text hashed at a time, bytes of passages solved at a time, and tokens of a long text taken at a time.
HASH_BYTES, SOLVE_BYTES, STRETCH = 1 << 20, 1 << 20, 1 << 20
POSITION_BITS = np.uint64(24)
GROUPS = "rid long, a long, s long, i0 int, n int, am int"
#: Half a passage knows the key and hash of the whole (``pkey``, ``ps``) and where it starts there (``off``).
PASSAGES = "key long, s long, a long, pkey long, ps long, off int, copies long, am int, p int, q int, passage binary"
NAMES = [c.split(" ")[0] for c in PASSAGES.split(", ")]
SPANS = "rid long, first int, upto int"
FOUND = "key long, s long, first int, upto int"


@dataclass(frozen=True)
class Unit:
    """Windows of ``length`` tokens with anchors of ``k``; tokens are words or bytes."""

    words: bool
    length: int
    k: int

    @property
    def offsets(self) -> int:
        return self.length - self.k + 1

    def split(self, text: bytes):
        return text.split() if self.words else text

    def join(self, tokens) -> bytes:
        return b" ".join(tokens) if self.words else bytes(tokens)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE, WORD_BASE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


class Sums:
    """Hashes of stretches of a row of codes, from running sums of code times base^place, modulo 2^64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes) + 1
        up, down = self.powers.get(base, (np.ones(0, np.uint64),) * 2)
        if len(up) < n:
            size = max(n, 1 << 16)
            up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
            self.powers[base] = up, down
        self.down = down
        self.run = np.zeros(n, np.uint64)
        np.cumsum(codes * up[: n - 1], out=self.run[1:])

    def __call__(self, first: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return mixed((self.run[upto] - self.run[first]) * self.down[first] + (upto - first).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        return mixed((self.run[k:] - self.run[:-k]) * self.down[: len(self.run) - k])


def token_codes(data: np.ndarray, starts: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all tokens, index of each text's first token and the end) of texts laid end to end."""
    if not words:
        return BYTE_CODES[data], starts
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACES[data]
    fresh = inside[1:-1] & ~inside[:-2]
    at = starts[:-1][starts[:-1] < len(data)]
    fresh[at] |= inside[1:-1][at]  # a text's first byte starts a word whatever stands before it
    first = np.flatnonzero(fresh)
    last = inside[1:-1] & ~inside[2:]
    ends = at[(at > 0)] - 1
    last[ends] |= inside[1:-1][ends]
    upto = np.flatnonzero(last) + 1
    codes = Sums(BYTE_CODES[data], BASE)(first, upto)
    return codes, np.searchsorted(first, starts)


def groups(codes: np.ndarray, starts: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, passage hash, first window, windows, anchor's place from the first window) of every group."""
    length, k, w = unit.length, unit.k, unit.offsets
    none = (np.zeros(0, np.int64),) * 6
    sizes = np.diff(starts)
    if len(codes) < length or sizes.max(initial=0) < length:
        return none
    sums = Sums(codes, WORD_BASE)
    grams = sums.grams(k)
    mask = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    anchor = (least & mask).astype(np.int64)  # of the window that starts at each token
    n_windows = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(len(codes) + 1, np.int32)
    some = np.flatnonzero(n_windows)
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, starts[some] + n_windows[some], -1)
    window = np.flatnonzero(np.cumsum(valid[:-1]))
    own = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)
    firsts = np.zeros(len(codes) + 1, bool)
    firsts[starts[some]] = True
    new |= firsts[window]
    at = np.flatnonzero(new)
    i0, m = window[at], own[at]
    n = np.diff(np.append(at, len(window)))
    text = np.searchsorted(starts, i0, side="right") - 1
    return text, grams[m].view(np.int64), sums(i0, i0 + n - 1 + length).view(np.int64), i0 - starts[text], n, m - i0


def hashing(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, side="right")) - 1)
                upto = min(upto, len(texts))
                part = data[offsets[at] : offsets[upto]]
                codes, starts = token_codes(part, offsets[at : upto + 1] - offsets[at], unit.words)
                for text, *found in stretches(codes, starts, unit):
                    yield pa.RecordBatch.from_arrays([pa.array(rids[at + text]), *(pa.array(x.astype(t)) for x, t in zip(found, (np.int64, np.int64, np.int32, np.int32, np.int32), strict=True))], names=["rid", "a", "s", "i0", "n", "am"])
                at = upto

    return run


def stretches(codes: np.ndarray, starts: np.ndarray, unit: Unit, stretch: int = STRETCH) -> Iterator[tuple]:
    """The groups of all texts; a single long text is taken a stretch at a time, each with the windows that start in it."""
    if len(starts) > 2 or len(codes) <= 2 * stretch:
        yield groups(codes, starts, unit)
        return
    for at in range(0, len(codes), stretch):
        part = codes[at : at + stretch + unit.length - 1]
        text, a, s, i0, n, am = groups(part, np.array([0, len(part)]), unit)
        yield text, a, s, i0 + at, n, am


def cutting(unit: Unit) -> Callable:
    """Cut the passages of the wanted groups out of their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, text, wanted in zip(batch["rid"], batch["text"], batch["wanted"], strict=True):
                tokens = unit.split((text or "").encode())
                for g in wanted:
                    i0, n = g["i0"], g["n"]
                    rows.append((g["a"], g["s"], g["a"], 0, 0, 0, g["copies"], g["am"], 0, unit.offsets - 1, unit.join(tokens[i0 : i0 + n - 1 + unit.length])))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=NAMES)
                    rows = []
            yield pd.DataFrame(rows, columns=NAMES)

    return run


def hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def halving(unit: Unit) -> Callable:
    """Split each passage's windows by their distance p..q before the anchor; the key of a half is the text that all its windows share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, s, a, _, _, _, copies, am, p, q, passage in batch.itertuples(index=False):
                tokens = unit.split(passage)
                last = len(tokens) - unit.length
                mid = (p + q) // 2
                for lo, hi in ((p, mid), (mid + 1, q)):
                    first, final = max(0, am - hi), min(last, am - lo)  # of the windows in the passage
                    if lo <= hi and first <= final:
                        own = unit.join(tokens[first : final + unit.length])
                        core = unit.join(tokens[am - lo : am - hi + unit.length])
                        rows.append((hashed(core, b"%d %d" % (lo, hi)), hashed(own, b"%d" % (am - first)), a, key, s, first, copies, am - first, lo, hi, own))
            yield pd.DataFrame(rows, columns=NAMES)

    return run


Solver = Callable[[list[bytes], list[int], Unit], list[list[tuple[int, int]]]]


def whole_keys(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, whole keys (the first column) together, about SOLVE_BYTES (of the last column) at a time."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch[c] for c in columns), strict=True):
            if held > SOLVE_BYTES and row[0] != rows[-1][0]:
                yield rows
                rows, held = [], 0
            rows.append(row)
            held += len(row[-1])
    if rows:
        yield rows


def solving(unit: Unit, solver: Solver) -> Callable:
    """Solve whole keys, several at a time; equal windows have equal keys. Spans count from a passage's first token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_keys(batches, ["key", "s", "copies", "passage"]):
            found = solver([r[3] for r in rows], [r[2] for r in rows], unit)
            out = [(key, s, x, y) for (key, s, _, _), spans in zip(rows, found, strict=True) for x, y in spans]
            yield pd.DataFrame(out, columns=["key", "s", "first", "upto"])

    return run


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def different(rows: DataFrame, key: str, label: str) -> DataFrame:
    """One row of each different passage of a key, with the sum of ``copies``; copies are summed where they are read, so a hot passage is one row for a task."""
    others = [c for c in rows.columns if c not in (key, "s", "copies")]
    return staged(rows.groupBy(key, "s").agg(F.sum("copies").alias("copies"), F.min(F.struct(*others)).alias("one")), label).select(key, "s", "copies", "one.*")


def recurring_groups(docs: DataFrame, unit: Unit) -> DataFrame:
    """The groups of docs (rid, text) whose anchor recurs, written."""
    ship_code(docs.sparkSession)
    found = staged(docs.select("rid", "text").mapInArrow(hashing(unit), GROUPS), "groups")
    anchors = staged(found.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a"), "anchors")
    recurring = staged(found.join(anchors, "a"), "recurring")
    unstage(found, anchors)
    return recurring


def passages_of(docs: DataFrame, ones: DataFrame, unit: Unit) -> DataFrame:
    """The passages (see PASSAGES) of groups (rid, a, s, i0, n, am, copies), cut out of their texts."""
    wanted = ones.groupBy("rid").agg(F.collect_list(F.struct("a", "s", "i0", "n", "am", "copies")).alias("wanted"))
    return staged(docs.select("rid", "text").join(wanted, "rid").mapInPandas(cutting(unit), PASSAGES), "passages")


def united(frames: list[DataFrame]) -> DataFrame:
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every


def small_keys(docs: DataFrame, recurring: DataFrame, unit: Unit, most_passages: int) -> tuple[DataFrame, list[DataFrame]]:
    """(the different passages of recurring groups in order of the key, those of large keys in halves; the halves of each turn)."""
    ones = different(recurring.withColumn("copies", F.lit(1).cast("bigint")), "a", "different")
    ready, halves, passages = [], [], passages_of(docs, ones, unit)
    while True:
        large = staged(passages.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most_passages).select("key"), "large")
        if large.isEmpty():
            break
        ready.append(passages.join(large, "key", "left_anti"))
        halves.append(staged(passages.join(large, "key", "left_semi").mapInPandas(halving(unit), PASSAGES), "halves"))
        passages = different(halves[-1], "key", "unlike").select(*NAMES)
    return united([*ready, passages]).repartition("key").sortWithinPartitions("key"), halves


def repeated_spans(docs: DataFrame, unit: Unit, solver: Solver, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """(rid, first, upto): token spans of docs (rid, text) that windows occurring elsewhere cover; spans may overlap.

    The solver sees one copy of each different passage and how often it occurs; each occurrence
    gets the spans of its copy, halves hand theirs back to the passages they come from."""
    recurring = recurring_groups(docs, unit)
    dealt, halves = small_keys(docs, recurring, unit, most_passages)
    found = staged(dealt.mapInPandas(solving(unit, solver), FOUND), "found")
    for h in reversed(halves):
        whole = found.join(h.select("key", "s", "pkey", "ps", "off"), ["key", "s"])
        found = staged(found.unionByName(whole.select(F.col("pkey").alias("key"), F.col("ps").alias("s"), (F.col("first") + F.col("off")).alias("first"), (F.col("upto") + F.col("off")).alias("upto"))), "found")
    spans = staged(found.groupBy(F.col("key").alias("a"), "s").agg(F.collect_set(F.struct("first", "upto")).alias("spans")), "spans")
    each = recurring.select("a", "s", "rid", "i0").join(spans, ["a", "s"]).select("rid", "i0", F.explode("spans").alias("x"))
    return each.select("rid", (F.col("i0") + F.col("x.first")).alias("first"), (F.col("i0") + F.col("x.upto")).alias("upto"))


def solved(docs: DataFrame, recurring: DataFrame, unit: Unit, solve: Callable, schema: str, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """What ``solve`` (rows of (key, a, copies, passage) in order of the key, whole keys together) gives for the different passages of recurring groups."""
    dealt, _ = small_keys(docs, recurring, unit, most_passages)
    return dealt.select("key", "a", "copies", "passage").mapInPandas(solve, schema)
