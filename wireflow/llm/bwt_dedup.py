"""Substring dedup of bytes by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import ship_code, staged, table, with_row_key
from wireflow.llm.repeats import Unit, merged, repeated_spans

LENGTH, K = 200, 56
#: Symbols of 9 bits that fit a sorted 63-bit key.
PACK = 7


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the first ``depth`` symbols at least (prefix doubling); symbols past the end are 0."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, np.zeros(PACK, symbols.dtype)])
    for i in range(PACK):
        key <<= 9
        key |= padded[i : i + n]
    done = PACK
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        if done >= depth or new.all():
            return order
        key[order] = np.cumsum(new)
        after = key[done:].copy()
        key *= n + 1
        key[: len(after)] += after
        done *= 2


def alike(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Number the classes of positions (in suffix order) that share their first ``depth`` symbols.

    Breadth-first over the Burrows-Wheeler transform: boundaries between suffixes that differ
    in their first symbol come first. Two neighbours in the order of c + x and c + y have a
    common prefix one longer than the least between x and y, so each turn takes the boundaries
    found in the turn before and sets those that they reach by one backward extension. After
    ``depth`` turns the boundaries still unset have common prefixes of ``depth`` or more."""
    n = len(symbols)
    before = symbols[order - 1]  # the transform; position 0 follows a separator at the end
    by = np.argsort(before, kind="stable")  # backward extension: by[i] is the row that row i extends
    same = np.zeros(n, bool)
    same[1:] = before[by[1:]] == before[by[:-1]]
    first = symbols[order]
    cut = np.ones(n, bool)  # cut[i]: rows i - 1 and i are known to differ
    cut[1:] = first[1:] != first[:-1]
    rows = np.flatnonzero(~cut & same)
    wide = by[rows] - by[rows - 1] > 1
    far, near = rows[wide], rows[~wide]
    low, high = by[far - 1], by[far]
    reached = np.full(n, -1)  # near rows extend neighbours, so one boundary decides: the row that a boundary reaches
    reached[by[near]] = near
    new = np.flatnonzero(cut)
    for _ in range(depth - 1):
        found = reached[new]
        found = found[found >= 0]
        found = found[~cut[found]]
        if len(far):  # some boundary of the turn before lies between the two rows that are extended
            hit = np.searchsorted(new, high, side="right") > np.searchsorted(new, low, side="right")
            found = np.concatenate([found, far[hit]])
            far, low, high = far[~hit], low[~hit], high[~hit]
        if not len(found):
            break
        cut[found] = True
        new = np.sort(found)
    return np.cumsum(cut)


def repeated(passages: list[bytes], copies: list[int], unit: Unit) -> list[list[tuple[int, int]]]:
    """The spans of each passage that windows occurring again, in it, a copy of it or another, cover."""
    parts, times = [np.zeros(1, np.int16)], np.repeat(np.append(0, copies), np.append(1, [len(p) + 1 for p in passages]))
    starts, at = [], 1
    for p in passages:
        starts.append(at)
        parts += [np.frombuffer(p, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
        at += len(p) + 1
    symbols = np.concatenate(parts)
    order = suffix_order(symbols, unit.length)
    classes = alike(symbols, order, unit.length)
    often = np.bincount(classes, times[order]) > 1
    again = np.zeros(len(symbols) + 1, bool)
    again[order] = often[classes]
    out = []
    for start, p in zip(starts, passages, strict=True):
        hits = np.flatnonzero(again[start : start + len(p) - unit.length + 1])
        if not len(hits):
            out.append([])
            continue
        gaps = np.flatnonzero(np.diff(hits) > unit.length)
        out.append(list(zip(hits[np.append(0, gaps + 1)].tolist(), (hits[np.append(gaps, len(hits) - 1)] + unit.length).tolist(), strict=True)))
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removing(with_bytes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                raw = (text or "").encode()
                gone = merged((s["first"], s["upto"]) for s in spans) if spans is not None else []
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return run


def drop_repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, k: int = K, with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if asked) the bytes left.

    A byte goes if a string of ``length`` bytes that also starts elsewhere covers it, in the
    same document or another; all copies go. A null text counts as empty and, like a short one,
    loses nothing; a long text is taken whole, a stretch at a time; rows that repeat or tie lose
    what they share; an empty table gives no rows; a null doc_id stays null; other columns,
    whatever their names, are not read."""
    ship_code(docs.sparkSession)
    d = with_row_key(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "rid")
    spans = repeated_spans(d, Unit(False, length, k), repeated)
    by_doc = staged(spans.groupBy("rid").agg(F.collect_set(F.struct("first", "upto")).alias("spans")), "spans")
    out = d.join(by_doc, "rid", "left").select("doc_id", "text", "spans").mapInPandas(removing(with_bytes), SCHEMA)
    return out if with_bytes else out.drop("kept")


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`drop_repeated_bytes` of the whole documents table, without the texts."""
    return drop_repeated_bytes(table(spark, sf_dir, "documents"), with_bytes=False)


SQL: dict[str, str] = {}
