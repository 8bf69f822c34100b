"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Each document is a weighted set of word shingles. Consistent weighted samples agree with
probability equal to the weighted Jaccard similarity; bands of them propose pairs, further
samples sift the pairs, and every link is verified by the exact weighted Jaccard similarity of
the whole texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import fresh, ship_code, staged, table, unstage, with_row_key
from wireflow.llm.repeats import Sums, mixed, token_codes

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^3)^12 = 0.9998.
BANDS, ROWS = 12, 3
#: Documents that share a bucket get so many further samples. Pairs that agree at fewer than similarity less SIFT of them
#: are not checked: at 0.8 that is fewer than 182 of 256, with probability 0.0002. SIFT = 1 checks all pairs of a bucket.
EXTRA, SIFT = 256, 0.09
#: Members of a bucket compared in one task, and pairs compared at a time.
BLOCK, PAIRS = 1024, 1 << 14
#: Partners that a member is held against first.
NEAREST = 4
#: Documents are counted in blocks of 2^BLOCK_BITS row numbers, shingles in ranges of about RANGE_SHINGLES: both bound a task's
#: memory. Above 2^35 words both grow together, up to 16 times, so that a block's part of a range does not become a few bytes.
BLOCK_BITS, RANGE_SHINGLES, MOST_RANGE_SHINGLES = 9, 1 << 21, 1 << 25
#: A block has about so many bytes at most: texts of more than its share (BLOCK_BYTES / 2^block_bits) are blocks of their own.
BLOCK_BYTES = 1 << 26
#: A shingle is told from others of its range by this many bits of its hash: one in 500,000 is taken for another (in the largest ranges, in 30,000).
KEY_BITS = 40
#: Bytes of text hashed at a time, and shingles held by a task before their counts go out.
HASH_BYTES, HELD_SHINGLES = 1 << 18, 1 << 19
SHINGLE_BASE = 0x9FB21C651E98DF25
BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def shingle_hashes(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of texts laid end to end; a shorter text with words is one shingle."""
    codes, first = token_codes(data, starts, True)
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    return Sums(codes, SHINGLE_BASE)(at, np.minimum(at + size, first[1:][text])), text


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with how often each occurs."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts) of a text column, about HASH_BYTES at a time."""
    texts = batch.column(column).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, side="right")) - 1), len(texts))
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def digest(text: bytes) -> bytes:
    """128 bits of a text's words joined by one blank."""
    text = text.translate(BLANKS).strip()
    return hashlib.blake2b(b" ".join(text.split()) if b"  " in text else text, digest_size=16).digest()


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of the parts of an array between cuts."""
    raw, width = values.tobytes(), values.itemsize
    return pa.array([raw[a * width : b * width] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def range_keys(h: np.ndarray, ranges: int) -> np.ndarray:
    """range * 2^KEY_BITS + key of each hash."""
    h = mixed(h)
    return (((h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)) << np.uint64(KEY_BITS)) | (h & np.uint64((1 << KEY_BITS) - 1))


def five_bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view("V8")).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]


def from_five_bytes(column: pa.ChunkedArray, part: np.ndarray) -> np.ndarray:
    """range * 2^KEY_BITS + key from rows of keys, whose ranges are given."""
    raw = joined(column, np.uint8).reshape(-1, KEY_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : KEY_BITS // 8] = raw
    return out.view("<u8").reshape(-1).astype(np.uint64) | (part.astype(np.uint64) << np.uint64(KEY_BITS))


def parts(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of the rows of a byte matrix between cuts."""
    raw, width = values.tobytes(), values.shape[1]
    return pa.array([raw[a * width : b * width] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def longest(block_bits: int) -> int:
    """Bytes of the longest texts that share a block."""
    return BLOCK_BYTES >> block_bits


def block_of(rid, n_bytes, block_bits: int) -> F.Column:
    """The block of a row: by its number, or its own if its text is long."""
    return F.when(n_bytes > longest(block_bits), -1 - rid).otherwise(F.shiftright(rid, block_bits))


def counting(size: int, ranges: int, block_bits: int) -> Callable:
    """(range, block, keys, n): the shingles of each block's documents in a batch, and in how many of them each is."""

    def pieces(keys: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        key, owner, n = counted(np.concatenate(keys), np.concatenate(owners))
        part = (key >> np.uint64(KEY_BITS)).astype(np.int64)
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])))
        cuts = np.append(new, len(key))
        return pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(owner[new]), parts(five_bytes(key), cuts), blobs(n.astype(np.uint16), cuts)], names=["range", "block", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, keys, owners, held = batch.column(2).to_numpy(), [], [], 0
            for at, _, data, starts in slices(batch, 1):
                h, text, _ = counted(*shingle_hashes(data, starts, size))
                keys.append(range_keys(h, ranges))
                owners.append(block[at + text])
                held += len(h)
                if held > HELD_SHINGLES:
                    yield pieces(keys, owners)
                    keys, owners, held = [], [], 0
            if held:
                yield pieces(keys, owners)

    return run


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def adding(group: pa.Table) -> pa.Table:
    """(block, range, keys, df): each block's shingles of a range that are in more documents than one, with the number of those."""
    sizes = np.array([len(k) // (KEY_BITS // 8) for k in group["keys"].to_pylist()])
    keys, n = from_five_bytes(group["keys"], np.zeros(1, np.int64)), joined(group["n"], np.uint16)
    _, place = np.unique(keys, return_inverse=True)
    df = np.bincount(place, n).astype(np.uint32)[place]
    again = df > 1
    cuts = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes), again, len(sizes)).astype(np.int64)))
    return pa.table({"block": group["block"], "range": group["range"], "keys": parts(five_bytes(keys[again]), cuts), "df": blobs(df[again], cuts)})


def shingle_counts(d: DataFrame, ranges: int, size: int, block_bits: int) -> DataFrame:
    """(block, range, keys, df) of all shingles in more documents than one, for each block that has them.

    Blocks are counted apart, the counts added up by range of hashes, and the sums dealt back to
    the blocks; what does not come back is in one document."""
    counts = d.select("rid", "text", "block").mapInArrow(counting(size, ranges, block_bits), "range long, block long, keys binary, n binary")
    return counts.groupBy("range").applyInArrow(adding, "block long, range long, keys binary, df binary")


def idf(docs: int, df: np.ndarray) -> np.ndarray:
    """The smoothed inverse document frequency: ln((1 + N) / (1 + df)) + 1, which is at least 1."""
    return np.log((1 + docs) / (1 + df.astype(np.float64))) + 1


def gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of n equal parts."""
    x = np.geomspace(1e-5, 40, 400_000)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


LEVELS = 1 << 16
GAMMA = gamma2_quantiles(LEVELS)
R, LOG_C, BETA = GAMMA.astype(np.float32), np.log(GAMMA).astype(np.float32), ((np.arange(LEVELS) + 0.5) / LEVELS).astype(np.float32)


def samples(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, k: int, from_: int = 0) -> np.ndarray:
    """k consistent weighted samples (fingerprints) of each text, numbered from ``from_``: an array of n_texts by k, 0 for texts without shingles.

    For element i with weight S, gamma(2, 1) variables r and c and a uniform b depend on i and
    the sample's number alone; with t = floor(ln S / r + b) the sample is the (i, t) with the
    least ln c - r (t - b + 1)."""
    out = np.zeros((n_texts, k), np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    sizes = np.diff(np.append(first, len(h)))
    log_s = np.log(weight).astype(np.float32)
    low = np.uint64(LEVELS - 1)
    for j in range(from_, from_ + k):
        u = mixed(h + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        r, b = R[(u & low).astype(np.intp)], BETA[((u >> np.uint64(16)) & low).astype(np.intp)]
        t = np.floor(log_s / r + b)
        a = LOG_C[(u >> np.uint64(48)).astype(np.intp)] - r * (t - b + 1)
        hits = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), sizes))
        own = text[hits]
        least = hits[np.append(True, own[1:] != own[:-1])]
        out[text[first], j - from_] = mixed(h[least] ^ mixed(t[least].astype(np.int64).view(np.uint64) + np.uint64(j + 1)))
    return out


BANDED = "rid long, doc_id long, digest binary, bands array<long>, df binary"


def banding(size: int, docs: int, ranges: int, bands: int, rows: int) -> Callable:
    """A block's documents as BANDED; df has the counts of a text's shingles in order of their hashes, packed; a text without words has no bands."""

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        keys, known = from_five_bytes(counts["keys"], np.repeat(counts["range"].to_numpy(), [len(k) // (KEY_BITS // 8) for k in counts["keys"].to_pylist()])), joined(counts["df"], np.uint32)
        order = np.argsort(keys)
        keys, known = keys[order], known[order]
        out = [EMPTY]
        for batch in texts.select(["rid", "text", "doc_id"]).combine_chunks().to_batches():
            for at, upto, data, starts in slices(batch, 1):
                h, text, tf = counted(*shingle_hashes(data, starts, size))
                df = np.ones(len(h), np.uint32)
                if len(keys):
                    own = range_keys(h, ranges)
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    df = np.where(keys[place] == own, known[place], df)
                found = samples(h, text, idf(docs, df) * tf, upto - at, bands * rows).reshape(upto - at, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (upto - at, bands))
                for j in range(rows):
                    key = mixed(key ^ found[:, :, j]) + np.uint64(j)
                sizes = np.bincount(text, minlength=upto - at)
                raw, cuts, ends = data.tobytes(), starts.tolist(), np.append(0, np.cumsum(sizes)).tolist()
                banded = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((sizes > 0) * bands)).astype(np.int32)), pa.array(key[sizes > 0].reshape(-1).view(np.int64)))
                out.append(pa.Table.from_arrays([
                    batch.column(0).slice(at, upto - at), batch.column(2).slice(at, upto - at), pa.array([digest(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    banded, pa.array([zlib.compress(df[a:b].tobytes(), 1) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], schema=EMPTY.schema))
        return pa.concat_tables(out)

    return run


EMPTY = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("df", pa.binary())]).empty_table()


def sampling(size: int, docs: int, first: int, extra: int) -> Callable:
    """(rid, sketch, bag) of (rid, text, df): a byte of each further sample, and the packed text with its counts for the exact check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2).to_pylist()
            for at, upto, data, starts in slices(batch, 1):
                h, text, tf = counted(*shingle_hashes(data, starts, size))
                counts = [zlib.decompress(x) for x in packed[at:upto]]
                df = np.frombuffer(b"".join(counts), np.uint32)
                found = samples(h, text, idf(docs, df) * tf, upto - at, extra, first).astype(np.uint8).tobytes()
                raw, cuts = data.tobytes(), starts.tolist()
                bags = [len(c).to_bytes(8, "little") + zlib.compress(c + raw[a:b], 1) for c, a, b in zip(counts, cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, upto - at), pa.array([found[i * extra : (i + 1) * extra] for i in range(upto - at)], pa.binary()), pa.array(bags, pa.binary())], names=["rid", "sketch", "bag"])

    return run


def verifying(size: int, docs: int) -> Callable:
    """(x, y, distance) of pairs with both packed texts (see :func:`sampling`): one less the weighted Jaccard similarity."""

    def bag(packed: bytes):
        both, at = zlib.decompress(packed[8:]), int.from_bytes(packed[:8], "little")
        data = np.frombuffer(both, np.uint8, offset=at)
        h, _, tf = counted(*shingle_hashes(data, np.array([0, len(data)]), size))
        return h, idf(docs, np.frombuffer(both[:at], np.uint32)) * tf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, leader = None, None
        for batch in batches:
            out = []
            for x, y, tx, ty in zip(batch["x"], batch["y"], batch["tx"], batch["ty"], strict=True):
                if y != last:
                    last, leader = y, bag(ty)
                (a, wa), (b, wb) = bag(tx), leader
                _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                both = np.minimum(wa[i], wb[j]).sum()
                out.append((x, y, 1 - both / max(wa.sum() + wb.sum() - both, 1e-12)))
            yield pd.DataFrame(out, columns=["x", "y", "distance"])

    return run


def filtering(least: int) -> Callable:
    """(x, y) of the rows (x, y, sx, sy) whose samples agree at ``least`` places or more; x is the larger row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sx, sy = sketch_rows(batch.column(2)), sketch_rows(batch.column(3))
            good = (sx == sy).sum(1) >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)[good]), pa.array(np.minimum(x, y)[good])], names=["x", "y"])

    return run


def sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def pairing(least: int, best: int | None = None) -> Callable:
    """(x, y): pairs of different classes from rows in order of (bucket, lo, hi), each pair in the first bucket that it shares alone.

    Of a bucket cut into blocks, rows meet the rows of the other block, or all of their own where
    lo = hi. With ``best``, only the pairs that are among the ``best`` of one of their rows by agreement."""

    def foremost(row: np.ndarray, agreed: np.ndarray) -> np.ndarray:
        order = np.lexsort((-agreed, row))
        new = np.ones(len(order), bool)
        new[1:] = row[order][1:] != row[order][:-1]
        at = np.flatnonzero(new)
        out = np.zeros(len(order), bool)
        out[order] = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order)))) < best
        return out

    def pairs(t: pa.Table) -> pa.RecordBatch:
        bucket, lo, hi, part, rid, group = (t.column(c).to_numpy() for c in ("bucket", "lo", "hi", "part", "rid", "class"))
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        sketch = sketch_rows(t.column("sketch").combine_chunks())
        new = np.ones(len(t), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        upto = np.append(np.flatnonzero(new)[1:], len(t))[np.cumsum(new) - 1]
        ends = np.append(0, np.cumsum(upto - np.arange(len(t)) - 1))
        found, at = [], 0
        while at < len(t):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS, side="right")) - 1)
            n = ends[at + 1 : to + 1] - ends[at:to]
            a = np.repeat(np.arange(at, to), n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a + 1
            ask = (group[a] != group[b]) & ((lo[a] == hi[a]) | (part[a] != part[b]))
            a, b = a[ask], b[ask]
            agreed = (sketch[a] == sketch[b]).sum(1)
            alike = agreed >= least
            a, b, agreed = a[alike], b[alike], agreed[alike]
            first = bands[a, (bands[a] == bands[b]).argmax(1)] == bucket[a]
            found.append(np.stack([a[first], b[first], agreed[first]]))
            at = to
        a, b, agreed = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        if best:
            near = foremost(a, agreed) | foremost(b, agreed)
            a, b = a[near], b[near]
        x, y = np.maximum(rid[a], rid[b]), np.minimum(rid[a], rid[b])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = [t.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
            last = np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in keys]))[0]  # the last key may go on in the next batch
            if last:
                yield pairs(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield pairs(held)

    return run


def verified(pairs: DataFrame, bags: DataFrame, verify: Callable, most: float, label: str) -> DataFrame:
    """(x, y, alike) of all pairs (x, y), by the exact similarity of the whole texts."""
    both = pairs.join(bags.select(F.col("rid").alias("x"), F.col("bag").alias("tx")), "x").join(bags.select(F.col("rid").alias("y"), F.col("bag").alias("ty")), "y")
    exact = both.select("x", "y", "tx", "ty").mapInPandas(verify, "x long, y long, distance double")
    return staged(exact.select("x", "y", (F.col("distance") <= most).alias("alike")), label)


def parted(df: DataFrame, rows: int, of: int = 1 << 18) -> DataFrame:
    """In as many parts as so many short rows need: a small table written in hundreds of files costs more than it holds."""
    return df.coalesce(max(1, -(-rows // of)))


def links(members: DataFrame, bags: DataFrame, verify: Callable, most: float, least: int, block: int = BLOCK) -> DataFrame:
    """(x, y): verified links of members (bucket, rid, bands, sketch), enough to join all that are linked.

    A pair is asked for if it shares a bucket and agrees at ``least`` of its further samples. First
    every member is held against one of its bucket, then against the NEAREST by samples of other
    classes: a linear number of pairs that joins most of a class. Last, each bucket that still has
    several classes compares the members of different classes, all of them: samples meet samples
    within a task, block by block, and only the pairs that agree leave it for the exact check. So
    every pair asked for is checked, or of one class."""
    n = members.count()
    lead = members.groupBy("bucket").agg(F.min_by("rid", F.xxhash64("rid", "bucket")).alias("y"))
    lead = staged(parted(lead.join(members.select("rid", "sketch").dropDuplicates(["rid"]).select(F.col("rid").alias("y"), F.col("sketch").alias("sy")), "y"), n, 1 << 16), "lead")
    near = members.join(lead, "bucket").where("rid <> y").select(F.col("rid").alias("x"), "y", F.col("sketch").alias("sx"), "sy")
    known = verified(near.mapInArrow(filtering(least), "x long, y long").distinct(), bags, verify, most, "stars")
    for best, label in ((NEAREST, "nearest"), (None, "rest")):
        pairs = staged(candidates(members, n, known, least, best, block), "pairs")
        known = known.unionByName(verified(pairs, bags, verify, most, label))
    return known.where("alike").select("x", "y")


def candidates(members: DataFrame, n: int, known: DataFrame, least: int, best: int | None, block: int) -> DataFrame:
    """(x, y) that are not known, of the n members of a bucket in different classes by the known links; see :func:`pairing`."""
    label = components(known.where("alike")).select(F.col("rid").alias("lrid"), "label")
    classed = members.join(label, F.col("rid") == F.col("lrid"), "left").withColumn("class", F.coalesce("label", "rid")).drop("lrid", "label")
    classed = staged(parted(classed, n, 1 << 16), "classed")
    several = classed.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("greatest"), F.count(F.lit(1)).alias("k")).where("least <> greatest")
    several = staged(parted(several.select("bucket", F.ceil(F.col("k") / block).cast("int").alias("blocks")), n), "several")
    rest = classed.join(several, "bucket").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rid", "class", "bands", "sketch")
    dealt = rest.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return dealt.mapInArrow(pairing(least, best), "x long, y long").join(known.select("x", "y"), ["x", "y"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(rid, label): the smallest rid that links lead to, by least labels and pointer jumping."""
    n = 2 * edges.count()
    both = staged(parted(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v"))), n), "edges")
    labels = staged(parted(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")), n), "labels")
    turn = 0
    while True:
        around = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("seen"))
        lower = labels.join(around, "u").select("u", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        lower = staged(parted(lower, n), f"lower{turn}")
        jump = lower.select(F.col("u").alias("label"), F.col("label").alias("further"))
        after = staged(parted(lower.join(jump, "label", "left").select("u", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), n), f"labels{turn}")
        turn += 1
        if after.where("label <> old").isEmpty():
            return after.select(F.col("u").alias("rid"), "label")
        labels = after.drop("old")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, extra: int = EXTRA, sift: float = SIFT) -> DataFrame:
    """One row per document: rid, doc_id, class_id, class_size, n_links, kept.

    A class is what verified links join; n_links counts the links that were found at a document's
    text (enough to join the class, not all pairs). Documents with the same words are one class
    from the start (so are all without words: null, empty or blank texts); a text shorter than a
    shingle is one shingle; a long text is read whole. class_id is the smallest doc_id of the
    class; the row with it stays (a null doc_id ranks last; of equals the first read). Repeated
    rows are copies; an empty table gives no rows; other columns, whatever their names, are not read."""
    d = with_row_key(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "rid")
    out = classes(d, similarity, size, bands, rows, extra, sift)
    unstage(d)
    return out


def classes(d: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, extra: int = EXTRA, sift: float = SIFT) -> DataFrame:
    """The rows of :func:`near_dedup` for written documents (rid, doc_id, text)."""
    ship_code(d.sparkSession)
    # blanks and line ends are about as many as words; a word and a blank take about six bytes
    blanks = F.octet_length("text") - F.octet_length(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit("")))
    n, held, parted = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(blanks), F.lit(0))).first()
    words = max(held // 6, parted)
    of_range = min(max(RANGE_SHINGLES, words >> 14), MOST_RANGE_SHINGLES)
    ranges, block_bits = max(1, -(-words // of_range)), BLOCK_BITS + of_range.bit_length() - RANGE_SHINGLES.bit_length()
    d = d.withColumn("block", block_of(F.col("rid"), F.coalesce(F.octet_length("text"), F.lit(0)), block_bits))
    counts = staged(shingle_counts(d, ranges, size, block_bits), "counts")
    blocks = d.groupBy("block").cogroup(counts.groupBy("block"))
    sketched = staged(blocks.applyInArrow(banding(size, n, ranges, bands, rows), BANDED), "bands")
    unstage(counts)
    first = sketched.groupBy("digest").agg(F.min("rid").alias("rep"))
    rows_ = staged(sketched.select("rid", "doc_id", "digest").join(first, "digest").select("rid", "doc_id", "rep"), "rows")
    banded = sketched.join(rows_.where("rid = rep").select("rid"), "rid", "left_semi").select("rid", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    asked = staged(banded.join(shared, "bucket"), "asked")
    mine = sketched.join(asked.select("rid").distinct(), "rid", "left_semi").select("rid", "bands", "df")
    wide = d.select("rid", "text").join(mine.select("rid", "df"), "rid")
    bags = staged(wide.select("rid", "text", "df").mapInArrow(sampling(size, n, bands * rows, extra), "rid long, sketch binary, bag binary"), "bags")
    members = staged(asked.join(mine.select("rid", "bands").join(bags.select("rid", "sketch"), "rid"), "rid").select("bucket", "rid", "bands", "sketch"), "members")
    found = staged(links(members, bags, verifying(size, n), 1 - similarity + 1e-9, int(np.ceil(extra * max(0.0, similarity - sift)))), "links")
    unstage(members, bags, asked, sketched)
    ends = found.select(F.explode(F.array("x", "y")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    labels = components(found).select(F.col("rid").alias("rep"), "label")
    classed = rows_.join(labels, "rep", "left").join(ends, "rep", "left").select("rid", "doc_id", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    classed = staged(classed, "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    best = staged(classed.groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size")), "best")
    return classed.join(best, "label").select("rid", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", "n_links", (F.col("rid") == F.col("best.rid")).alias("kept"))


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`near_dedup` keeps, with their columns, whatever these are called.

    Rows without words (null, empty or blank texts) are copies of each other, and one stays; of
    tied rows the first read; an empty table stays empty."""
    rid = fresh(docs, "rid")
    docs = with_row_key(docs, rid)
    d = docs.select(F.col(rid).alias("rid"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    gone = classes(d).where(~F.col("kept")).select(F.col("rid").alias(rid))
    return docs.join(gone, rid, "left_anti").drop(rid)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`near_dedup` of the whole documents table: doc_id, class_id, class_size, n_links, kept."""
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "kept")


SQL: dict[str, str] = {}
