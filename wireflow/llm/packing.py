"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition, a block at a time, so nothing is shuffled
and a lost task is simply run again. A document's whole windows stand alone; its remainder is
cut into short pieces, and the pieces of a block are differenced into windows."""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import ship_code, table

LENGTH, PIECE, BLOCK_WINDOWS = 1024, 256, 128
TOKENIZER = "byte_bpe_50k.json"
#: Encoded chunks that a Python worker remembers (about 200 bytes each), the longest chunk that it does, and chunks encoded at a time.
MEMO, MEMO_CHARS, LEARNT = 1_000_000, 48, 20_000

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")


class Encoder:
    """Ids of whole texts as little-endian bytes, by the tokenizers library with a byte-level vocabulary.

    A blank before a character that is no white space always starts a new word for this kind
    of tokenizer, so a text is the sum of its chunks there. New chunks are encoded together and
    told apart by the bytes that each id stands for; chunks seen before are looked up. A special
    token written out in a text has its id there, as in a plain call of the library; the blanks
    around it are cut otherwise, so a text that holds one is encoded by such a call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]  # one character stands for one byte
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.odd = re.compile(r" (?:\s|$)").search

    def chunks(self, text: str) -> list[str]:
        """What stands before the first cut, then the chunks, each without the blank that it starts with."""
        if not self.odd(text):
            return text.split(" ")
        out = [""]
        for i, x in enumerate(text.split(" ")):
            if i and x and not x[0].isspace():
                out.append(x)
            else:
                out[-1] += " " + x if i else x
        return out

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of chunks, each a blank and what is given, which starts with a character that is no white space."""
        found: dict[str, bytes] = {}
        for first in range(0, len(new), LEARNT):
            part = new[first : first + LEARNT]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends, cuts = np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1)
            at = np.searchsorted(ends, cuts)
            if at[-1] != len(ids) - 1 or (ends[at] != cuts).any():
                raise ValueError("the tokenizer's words do not start at blanks; a byte-level vocabulary is needed")
            raw, upto = ids.tobytes(), ((at + 1) * 4).tolist()
            found.update(zip(part, [raw[a:b] for a, b in zip([0, *upto], upto)], strict=False))
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        starts, split = [], []
        for t in texts:
            whole = any(s in t for s in self.special)
            first, *rest = [t] if whole else self.chunks(t)
            starts.append(np.array(self.tokenizer.encode(first, add_special_tokens=False).ids if first else [], "<u4").tobytes())
            split.append(rest)
        known = [list(map(self.memo.get, s)) for s in split]
        new = {c for s, k in zip(split, known, strict=True) if None in k for c, b in zip(s, k, strict=True) if b is None}
        found = self.learn(list(new))
        if len(self.memo) + len(found) > MEMO:  # what this batch uses stays
            self.memo = {c: b for s, k in zip(split, known, strict=True) for c, b in zip(s, k, strict=True) if b is not None}
        self.memo.update(found if max(map(len, found), default=0) <= MEMO_CHARS else {c: b for c, b in found.items() if len(c) <= MEMO_CHARS})
        filled = (k if None not in k else [found[c] if b is None else b for c, b in zip(s, k, strict=True)] for s, k in zip(split, known, strict=True))
        return [i + b"".join(k) for i, k in zip(starts, filled, strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a Python worker: its memory of chunks serves the next task too."""
    return Encoder(path)


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """k sets of item numbers with near-equal sums (Karmarkar-Karp, largest spread first).

    A partial partition is its k sums in falling order. Merging adds one's largest sums to the
    other's smallest; ``steps`` keeps where the sums of either side went."""
    first = np.zeros(k, np.int64)
    nodes: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        nodes[i] = first.copy()
        nodes[i][0] = s
        heap.append((-s, i))
    heapq.heapify(heap)
    steps = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = nodes.pop(a) + nodes.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        new = len(sizes) + len(steps)
        steps.append((a, b, order))
        nodes[new] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), new))
    sets: list[list[int]] = [[] for _ in range(k)]
    places = {len(sizes) + len(steps) - 1: np.arange(k)}
    for new in range(len(sizes) + len(steps) - 1, len(sizes) - 1, -1):
        a, b, order = steps[new - len(sizes)]
        own = np.empty(k, np.int64)
        own[order] = places.pop(new)
        places[a], places[b] = own, own[::-1]
    for i in range(len(sizes)):
        sets[places[i][0]].append(i)
    return sets


def windows(sizes: list[int], length: int) -> list[list[int]]:
    """Sets of item numbers, each with a sum of at most ``length``; one more set whenever a sum is above."""
    k = max(1, -(-sum(sizes) // length))
    while True:
        sets = differenced(sizes, k)
        most = max(sum(sizes[i] for i in s) for s in sets)
        if most <= length:
            return [s for s in sets if s]
        k += max(1, k * (most - length) // (8 * length))


def packer(path: str, length: int, piece: int, block_windows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, sequence = encoder(path), TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        held = 0

        def flush(rows: list[tuple]) -> None:
            nonlocal waiting, held, sequence
            for chosen in windows([w[2] for w in waiting], length):
                at = 0
                for i in chosen:
                    rows.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting, held = [], 0

        for batch in batches:
            for at in range(0, len(batch), 512):
                rows: list[tuple] = []
                part = batch.iloc[at : at + 512]
                for doc, ids in zip(part["doc_id"], encode([t or "" for t in part["text"]]), strict=True):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    whole = n // length * length
                    for start in range(0, whole, length):
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, 0))
                        sequence += 1
                    for start in range(whole, n, piece):
                        size = min(piece, n - start)
                        waiting.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n))
                        held += size
                    if held >= length * block_windows:
                        flush(rows)
                yield frame(rows)
        rows = []
        if waiting:
            flush(rows)
        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return pack


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, length: int = LENGTH, piece: int = PIECE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with id 0, so a null or empty text has one token; a long text becomes
    whole windows and a rest. Rows that repeat or tie are packed each; a null doc_id stays null; an
    empty table gives no rows; other columns, whatever their names, are not read. ``tokenizer``
    is the path of a tokenizers file."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    ship_code(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInPandas(packer(tokenizer, length, piece, block_windows), SCHEMA)


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`pack_documents` of the whole documents table."""
    return pack_documents(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
