"""Qubits that are needed for a while only, freed and used again: a colouring of lifetimes.

Allocations and frees are put in one order of time. The qubits in use are a running sum of
them, and the qubits ever made are its running maximum: an allocation that raises the maximum
makes a new qubit, every other one takes over the qubit that was freed longest ago. The n-th
such allocation therefore follows the n-th free, which is a join by number, and the qubit at
the head of each chain of hand-overs is found by pointer doubling. No task holds a whole
sequence, and no key has more than one row in the joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.plans.running import CHUNK, global_rank, neighbours, running_max, running_sum
from wireflow.plans.staging import unstage

#: Of events at one time, allocations come first: what is freed at a time can be used only after it.
ALLOCATE, FREE = 0, 1


def slots(lifetimes: DataFrame, staged: Callable[[DataFrame], DataFrame], chunk: int = CHUNK) -> DataFrame:
    """(id, first, last, slot) of lifetimes (id, first, last), both ends included.

    Slots are numbered from 0 in the order in which they are made; there are as many as lifetimes
    that overlap at most, and no two of one slot overlap. Equal times are ordered by id. A row without
    id, first or last is an error, and so are last < first and an id that occurs twice; other columns are dropped."""
    own = staged(lifetimes.select("id", "first", "last"))
    odd = own.where("id is null or first is null or last is null or last < first").first()
    if odd:
        raise ValueError(f"not a lifetime: {odd['id']} from {odd['first']} to {odd['last']}")
    twice = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice['id']} has more than one lifetime")
    event = lambda at, kind, step: F.struct(F.col(at).alias("time"), F.lit(kind).alias("kind"), F.lit(step).cast("bigint").alias("step"))
    events = own.select("id", F.explode(F.array(event("first", ALLOCATE, 1), event("last", FREE, -1))).alias("e")).select("id", "e.*")
    live = running_sum(global_rank(events, "time", "kind", "id", name="place"), [], "place", F.col("step"), "live", chunk)
    counted = running_max(live, [], "place", F.col("live") - F.col("step"), "made", chunk)
    # of place + 1 events so far, (place + 1 + live) / 2 are allocations, the others frees
    half = lambda n: F.call_function("div", n, F.lit(2).cast("bigint"))
    events = staged(counted.select("id", "kind", (F.col("live") > F.col("made")).alias("new"), "live", F.greatest("made", "live").alias("made"),
                                   half(F.col("place") + 1 + F.col("live")).alias("allocated"), half(F.col("place") + 1 - F.col("live")).alias("freed")))
    takers = events.where(F.col("kind") == ALLOCATE).select("id", F.when(F.col("new"), F.col("made") - 1).alias("slot"), F.when(~F.col("new"), F.col("allocated") - F.col("made")).alias("nth"))
    givers = events.where(F.col("kind") == FREE).select(F.col("id").alias("to"), F.col("freed").alias("nth"))
    now = staged(takers.join(givers, "nth", "left").select("id", "to", "slot"))
    unstage(events)
    while not now.where("slot is null").isEmpty():
        far = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("slot").alias("far_slot"))
        step = staged(now.where("slot is null").join(far, "to").select("id", F.col("far").alias("to"), F.col("far_slot").alias("slot")).unionByName(now.where("slot is not null")))
        unstage(now)
        now = step
    return own.join(now.select("id", "slot"), "id")


def reused(ops: DataFrame, base: int, staged: Callable[[DataFrame], DataFrame], chunk: int = CHUNK) -> DataFrame:
    """Operations (op_id, qubits, ...) whose qubits from ``base`` on are each needed from their first to their last operation only.

    These are dealt to as few qubits from ``base`` on as that allows; all other columns stay. op_ids are of one operation each."""
    uses = ops.select("op_id", F.explode(F.array_distinct(F.filter("qubits", lambda q: q >= base))).alias("q"))
    dealt = slots(uses.groupBy(F.col("q").alias("id")).agg(F.min("op_id").alias("first"), F.max("op_id").alias("last")), staged, chunk)
    to = staged(dealt.select(F.col("id").alias("__q"), (F.col("slot") + base).alias("__to")))
    own = ops.withColumn("__own", F.array_distinct(F.filter("qubits", lambda q: q >= base)))
    n, columns = F.size("__own"), ops.columns
    # an operation with one such qubit meets it by the qubit; only those with more are put together again
    one = own.where(n == 1).withColumn("__q", F.element_at("__own", 1)).join(to, "__q")
    one = one.withColumn("qubits", F.transform("qubits", lambda q: F.when(q == F.col("__q"), F.col("__to")).otherwise(q)))
    many = own.where(n > 1)
    moves = many.select("op_id", F.explode("__own").alias("__q")).join(to, "__q").groupBy("op_id").agg(F.map_from_entries(F.collect_list(F.struct("__q", "__to"))).alias("__map"))
    many = many.join(moves, "op_id").withColumn("qubits", F.transform("qubits", lambda q: F.coalesce(F.try_element_at("__map", q), q)))
    none = own.where(F.coalesce(n, F.lit(0)) <= 0)
    return one.select(*columns).unionByName(many.select(*columns)).unionByName(none.select(*columns))


def overlaps(dealt: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(slot, id, other): lifetimes of a slot of which the next begins before they end; none, if the slots are right."""
    near = neighbours(dealt, ["slot"], "first", F.struct("id", "first"), "before", "after", chunk)
    return near.where(F.col("after.first") <= F.col("last")).select("slot", "id", F.col("after.id").alias("other"))
