"""Repair of conversations: the cheapest edits that give a legal order of roles, by scalar big-integer weights.

A row of a conversation is kept, reroled or deleted, and rows may be inserted, so that the
initials of the roles are (s?(ua)+)?. The edits of a path through that small automaton are one
integer: the digits above are the cost, the digits below the letters of the edits, each at a
fixed width, the first letter highest and zeros at the end. The least integer is the cheapest
path and, of those of equal cost, the one whose letters come first in ASCII order. Two paths to
one state over the same rows with equal costs never differ by letters at the end alone (those
would be insertions, which cost), so a least integer stays the least whatever follows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.llm.common import ship_code, staged, table
from wireflow.plans.running import global_rank, running_sum

INSERT, KEEP, REROLE, DELETE, TRUNCATED = 5, 0, 1, 2, 5
#: Conversations of more rows or bytes of text are cut into chunks; so many chunks are joined in a task.
MOST_ROWS, MOST_BYTES, CHUNK, FAN = 4096, 1 << 25, 1024, 64
#: States: nothing yet, after the system's row, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The digit of a letter, in ASCII order; none is zero.
DIGITS, BITS = {"D": 1, "I": 2, "K": 3, "R": 4}, 3
LETTERS = {d: x for x, d in DIGITS.items()}
#: What an initial leads to from each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
INSERTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def options(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of the edits of one row and of insertions before it; the best for each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        at, before, letters = state, 0, ""
        for _ in range(3):  # a third insertion comes back to where the first led
            found = [(at, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                found.append((NEXT[at], REROLE + more, "R"))
                if at in STEPS.get(initial, {}):
                    found.append((STEPS[initial][at], KEEP + more, "K"))
            for to, cost, letter in found:
                own = before + cost, letters + letter
                if (state, to) not in best or own < best[state, to]:
                    best[state, to] = own
            at, before, letters = NEXT[at], before + INSERT, letters + "I"
    return [(a, b, c, x) for (a, b), (c, x) in best.items()]


OPTIONS = {(i, f): options(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}
#: What follows the last row: insertions up to an end.
ENDS = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


def digits(letters: str) -> int:
    out = 0
    for x in letters:
        out = out << BITS | DIGITS[x]
    return out


def joined(path: tuple[int, int, str], more: tuple[int, int], width: int) -> tuple[int, int]:
    """The weight of a path (weight, letters) of ``width`` places with further letters put after its last."""
    weight, n = path
    cost, letters = more
    return weight + (cost << BITS * width) + (digits(letters) << BITS * (width - n - len(letters))), n + len(letters)


def paths(rows: list[tuple[str, str]], start: int) -> tuple[dict[int, tuple[int, int]], int]:
    """({state: (weight, number of letters)}, width): the best path over rows (initial, fault) from a state to each."""
    width = 3 * len(rows) + 2
    now = {start: (0, 0)}
    for initial, fault in rows:
        then: dict[int, tuple[int, int]] = {}
        for a, b, cost, letters in OPTIONS[initial if initial in STEPS else "", fault]:
            if a in now:
                path = joined(now[a], (cost, letters), width)
                if b not in then or path < then[b]:
                    then[b] = path
        now = then
    return now, width


def spelled(path: tuple[int, int], width: int) -> tuple[int, str]:
    """(cost, letters) of a weight."""
    weight, n = path
    low = weight & ((1 << BITS * width) - 1)
    text = oct(low >> BITS * (width - n))[2:] if n else ""
    return weight >> BITS * width, text.translate({ord(str(d)): x for d, x in LETTERS.items()})


def best_end(now: dict[int, tuple[int, int]], width: int) -> tuple[int, str]:
    return spelled(min(joined(path, ENDS[state], width) for state, path in now.items()), width)


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of a conversation's rows (initial, fault)."""
    return best_end(*paths(rows, START))


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines ``role:text`` that edits leave of rows (role, text)."""
    state = START
    for letter in audit:
        if letter == "I":
            yield f"{INSERTED[state]}:"
            state = NEXT[state]
            continue
        role, text = next(rows)
        if letter != "D":
            role, state = (role, STEPS[role[:1]][state]) if letter == "K" else (INSERTED[state], NEXT[state])
            yield f"{role}:{text}"


def hashed(lines: Iterator[str]) -> str:
    out = hashlib.sha256()
    for i, line in enumerate(lines):
        out.update((f"\n{line}" if i else line).encode())
    return out.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repairing(kind: str) -> Callable:
    """A row (conv_id, RESULT) for each conversation of rows in order (conv_id, turn, role, text, fault, copies); ids are of a Spark type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, group in groupby(_rows(batches, range(6)), key=lambda r: r[0]):
            seen, turns, kept = set(), set(), []
            for _, turn, role, text, fault, copies in group:
                for _ in range(copies):
                    own = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                    kept.append((role, text, fault if fault == "blank" or own not in seen else "duplicate"))
                    seen.add(own)
                    turns.add(turn)
            turns.discard(None)
            cost, audit = cheapest([(role[:1], fault) for role, _, fault in kept])
            counts = [sum(f == x for _, _, f in kept) for x in ("blank", "duplicate", "truncated")]
            illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(kept, kept[1:], strict=False))
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            out.append((conv, gaps, *counts, illegal, cost, audit, hashed(repaired(audit, iter([(r, t) for r, t, _ in kept])))))
            if len(out) >= 1000:
                yield _batch(out, kind)
                out = []
        if out:
            yield _batch(out, kind)

    return run


def _rows(batches: Iterator[pa.RecordBatch], columns) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in columns), strict=True)


#: Arrow types of ids.
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    kinds = [KINDS[kind]] + [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", *[c.split(" ")[0] for c in RESULT.split(", ")]])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, copies) after the damage by the crc32 of conv_id and turn; no copies are left of dropped rows.

    Nulls are read as one blank. ``fault`` is blank, truncated or empty; duplicates are found later."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    role, text = F.when(h == 4, "user").otherwise(text_of("role")), text_of("text")
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return own.withColumn("fault", F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise(""))


# conversations that are too long for one task

PIECES = "place long, chunk long, n long, first string, last string, illegal long, path array<struct<start:int,end:int,cost:long,letters:string>>"


def _pieces(rows: list[tuple], place: int, chunk: int) -> pd.DataFrame:
    return pd.DataFrame([(place, chunk, *rows)], columns=[c.split(" ")[0] for c in PIECES.split(", ")])


def summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row of PIECES for a chunk: the best path from each state to each."""
    rows = rows.sort_values("pos")
    own = list(zip(rows["initial"], rows["fault"], strict=True))
    found = []
    for start in range(4):
        now, width = paths(own, start)
        found += [{"start": start, "end": end, "cost": c, "letters": x} for end, p in now.items() for c, x in [spelled(p, width)]]
    first = [i for i, _ in own]
    illegal = sum(a + b not in LEGAL for a, b in zip(first, first[1:], strict=False))
    return _pieces((len(own), first[0], first[-1], illegal, found), key[0], key[1])


def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row of PIECES for chunks that follow each other: paths are joined and the least weights kept."""
    rows = rows.sort_values("chunk")
    best, n, illegal, first, last = {(s, s): (0, "") for s in range(4)}, 0, 0, None, None
    for r in rows.itertuples():
        width = max(len(x) for _, x in best.values()) + max(len(p["letters"]) for p in r.path)
        then: dict[tuple[int, int], tuple[int, int]] = {}
        for (start, mid), path in best.items():
            own = joined((0, 0), path, width)
            for p in r.path:
                if p["start"] == mid:
                    more = joined(own, (p["cost"], p["letters"]), width)
                    if (start, p["end"]) not in then or more < then[start, p["end"]]:
                        then[start, p["end"]] = more
        best = {k: spelled(p, width) for k, p in then.items()}
        illegal += r.illegal + (last is not None and last + r.first not in LEGAL)
        first, last, n = r.first if first is None else first, r.last, n + r.n
    found = [{"start": s, "end": e, "cost": c, "letters": x} for (s, e), (c, x) in best.items()]
    return _pieces((n, first, last, illegal, found), key[0], key[1])


def ending(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(place, illegal, cost, audit) of conversations that are one piece."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            own = [(p["end"], p["cost"], p["letters"]) for p in r.path if p["start"] == START]
            width = max(len(x) for *_, x in own) + 2
            out.append((r.place, r.illegal, *best_end({e: joined((0, 0), (c, x), width) for e, c, x in own}, width)))
        yield pd.DataFrame(out, columns=["place", "illegal", "cost", "audit"])


def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, repaired_sha256) of rows in order (place, pos, role, text); the row before a conversation's first has its audit as text. Nothing but the audit is held."""

    for place, group in groupby(_rows(batches, (0, 2, 3)), key=lambda r: r[0]):
        _, _, audit = next(group)
        out = hashed(repaired(audit, ((role, text) for _, role, text in group)))
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([out])], names=["place", "repaired_sha256"])


def repaired_long(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """(place, RESULT) of conversations of any length: chunks are summarised apart and joined FAN at a time; the repaired text is hashed as a stream.

    Equal rows are counted before they are dealt, and rows are ranked in ranges of (conversation,
    turn, role, text), so a conversation is spread over tasks. Its audit is one value of the result."""
    same = staged(rows.where("copies > 0").groupBy("place", "turn", "role", "text").agg(F.sum("copies").alias("copies"), F.first("fault").alias("fault")), "turns")
    early = same.withColumn("digest", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    first = early.groupBy("place", "digest").agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("t"), "turn", "role")).alias("f")).select(F.col("place").alias("fp"), F.col("digest").alias("fd"), F.col("f.t").alias("ft"))
    marked = early.join(first, (F.col("place") == F.col("fp")) & (F.col("digest") == F.col("fd"))).withColumn("again", F.col("ft") != F.coalesce("turn", F.lit(-(1 << 63))))
    ranked = global_rank(marked.select("place", "turn", "role", "text", "copies", "fault", "again").withColumn("t", F.coalesce("turn", F.lit(-(1 << 63)))), "place", "t", "role", "text", name="at")
    placed = running_sum(ranked, ["place"], "at", F.col("copies"), "upto")
    every = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("again") | (F.col("copy") > 1), "duplicate").otherwise(F.col("fault"))
    every = staged(every.select("place", (F.col("upto") - F.col("copies") + F.col("copy") - 1).alias("pos"), "turn", "role", F.when(fault.isin("blank", "duplicate"), "").otherwise(F.col("text")).alias("text"), fault.alias("fault")), "places")
    chunks = every.select("place", F.floor(F.col("pos") / most).cast("bigint").alias("chunk"), "pos", F.substring("role", 1, 1).alias("initial"), "fault")
    pieces = staged(chunks.groupBy("place", "chunk").applyInPandas(summary, PIECES), "pieces")
    while not pieces.where("chunk > 0").isEmpty():
        pieces = staged(pieces.withColumn("chunk_", F.floor(F.col("chunk") / FAN).cast("bigint")).groupBy("place", "chunk_").applyInPandas(together, PIECES), "pieces")
    ends = staged(pieces.mapInPandas(ending, "place long, illegal long, cost long, audit string"), "audits")
    lines = ends.select("place", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")).unionByName(every.select("place", "pos", "role", "text"))
    hashes = lines.repartition("place").sortWithinPartitions("place", "pos").mapInArrow(hashing, "place long, repaired_sha256 string")
    turns = same.select("place", "turn").distinct().groupBy("place").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = every.groupBy("place").agg(*[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")])
    return ends.join(hashes, "place").join(turns, "place").join(counts, "place").select("place", *[c.split(" ")[0] for c in RESULT.split(", ")])


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per conversation, dropped ones too: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged by the rule of :func:`damaged`, taken in the order of turn (null first; of
    equal turns by role, then text; a repeated row stands beside its like) and repaired. A null
    conv_id is a conversation of its own; nulls elsewhere are one blank (so a null text is blank,
    a null role no legal one). A conversation without rows has zeros, no edits and the hash of
    the empty string. Equal rows are duplicates; an empty table gives no rows; texts of any
    length are judged and hashed whole; other columns, whatever their names, are not read.

    Conversations of up to ``most_rows`` rows and ``most_bytes`` bytes are dealt to tasks whole;
    longer ones by :func:`repaired_long`."""
    ship_code(rows.sparkSession)
    own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    sizes = staged(sizes.withColumn("long", (F.col("n") > most_rows) | (F.col("bytes") > most_bytes)), "sizes")
    long = sizes.where("long").select(F.col("conv_id").alias("lid"))
    several = not long.isEmpty()
    short = damaged(own.join(long, F.col("conv_id").eqNullSafe(F.col("lid")), "left_anti") if several else own)
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    dealt = short.select("conv_id", "turn", "role", "text", "fault", "copies").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = dict(own.dtypes)["conv_id"]
    out = dealt.mapInArrow(repairing(kind), f"conv_id {kind}, {RESULT}")
    if not several:
        return out.select("conv_id", *names)
    ids = staged(global_rank(long, "lid", name="place"), "long")
    spread = damaged(own.join(ids, F.col("conv_id").eqNullSafe(F.col("lid"))).select("conv_id", "turn", "role", "text"))
    spread = spread.join(ids, F.col("conv_id").eqNullSafe(F.col("lid"))).drop("lid")
    found = ids.join(repaired_long(spread), "place", "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    found = found.select(F.col("lid").alias("conv_id"), *[F.coalesce(c, empty.get(c, F.lit(0))).alias(c) for c in names])
    return out.select("conv_id", *names).unionByName(found)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`repair` of the whole conversations table."""
    return repair(table(spark, sf_dir, "conversations"))


SQL: dict[str, str] = {}
