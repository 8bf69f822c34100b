"""From a linked gate table, whatever its ids, back to operations in order of time and to layers.

A block of ids is taken by one task, which follows every port back to the first one outside of the block and puts
the block's gates in order. What leads out of the blocks is followed from block to block by pointer doubling, and
a gate's row meets the outcome by one join for each port. Blocks of ids that follow each other in time are chunks.
Where only few links lead back to a later block, the gates behind them are raised to its chunk, block by block, until
no gate is in an earlier chunk than one before it. Where ids say nothing, a gate's largest rank on a wire is a first
guess of when it runs; guesses are cut into chunks of levels, and chunks are raised along the wires. Then each chunk is
put in order apart, and the chunks follow each other. A cycle ends up within one chunk, where it is found."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireflow.functions.codec import link_id, link_type
from wireflow.operators.layers import layered
from wireflow.plans.build import dealt, in_chunk
from wireflow.plans.running import global_rank, running_max
from wireflow.plans.staging import of_numbers, ship_code, unstage
from wireflow.schema import IN, OUT

#: About so many gates are put in order by one task.
GATES = 1 << 16
#: Blocks of ids are put in order by their pairs if there are no more pairs than these.
PAIRS = 1 << 20
#: Tables of up to so many rows (what leads out of the blocks, a few numbers each) are sent to all tasks.
SMALL = 1 << 21
#: About so many far ports are followed on by one task.
RANGE = 1 << 18
#: Blocks are raised if no more than one in so many links between blocks leads back, and no chunk gets more than so many times a block's gates.
FEW, MOST = 4, 4
PREV = [f"prev_q{p}" for p in (1, 2, 3)]
#: What operations keep of their gates.
KEPT = ("param", "label", "cl_ctrl", "meas_key")
#: What a row without an id tells in ``far0``: a far port that is asked for, how many gates a block has, a gate that waits for a circle.
TOLD = ASKED, N_GATES, CIRCLE = (0, 1, 2)
#: Places on a wire (a power of two) whose gates are compared by one digest.
PLACES = 14


class NotInOrder(ValueError):
    """Gates wait for each other in a circle."""


class MissingGate(ValueError):
    """A link leads to no gate of the table."""


def _block(column, low: int, width: int):
    return F.call_function("div", (column - low).cast("bigint"), F.lit(width).cast("bigint"))


def blocks(gates: DataFrame, size: int = GATES) -> tuple[int, int]:
    """(lowest id, width): ranges of ids that hold about ``size`` gates each if the ids are spread evenly."""
    low, high, n = gates.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    return (low, max(1, size * (high - low + 1) // n)) if n else (0, 1)


def _before(table: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, places, here): the links back of gates by port (-1 if none), where the gates that they lead to are among ``ids``, and whether they are there."""
    links = np.stack([table.column(c).fill_null(-1).to_numpy() for c in PREV])
    links[:, table.column("type").to_numpy() == IN] = -1
    goal = links // 1000
    places = np.minimum(np.searchsorted(ids, goal), max(len(ids) - 1, 0))
    return links, places, (links >= 0) & (ids[places] == goal)


def _order(places: np.ndarray, here: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The places in time of gates that are ``real``, each after those that its links lead back to; -1 for what waits for a circle, and for the others."""
    first, then = places[here], np.broadcast_to(np.arange(len(real)), here.shape)[here]
    both = real[first] & real[then]
    first, then = first[both], then[both]
    if (first < then).all():
        return np.where(real, np.cumsum(real) - 1, -1)
    if (first > then).all():
        return np.where(real, real.sum() - np.cumsum(real), -1)
    by = np.argsort(first, kind="stable")
    to, start = then[by].tolist(), np.searchsorted(first[by], np.arange(len(real) + 1)).tolist()
    waits = np.bincount(then, minlength=len(real)).tolist()
    order = [g for g in np.flatnonzero(real).tolist() if not waits[g]]
    for g in order:  # which gets longer
        for h in to[start[g] : start[g + 1]]:
            waits[h] -= 1
            if not waits[h]:
                order.append(h)
    out = np.full(len(real), -1)
    out[order] = np.arange(len(order))
    return out


def _real(table: pa.Table) -> np.ndarray:
    return ~np.isin(table.column("type").to_numpy(), (IN, OUT))


def _in_block(kept: list[str]):
    """A block's gates: of each port the first one behind it that is not of the block, or an In gate's (``far``, id * 4 + port; what runs in a circle leads
    to itself), and the links to it (``at``); the gate's ``place`` in time. Rows without an id tell something of the block ``at0``, as their ``place`` says (:data:`TOLD`)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids, real = table.column("id").to_numpy(), _real(table)
        links, places, here = _before(table, ids)
        size, has = len(ids), links >= 0
        ports = np.flatnonzero(has.ravel())
        port = links // 100 % 10
        inside = (here & (port < 3) & has[np.minimum(port, 2), places]).ravel()[ports]
        number = np.zeros(3 * size, np.int64)
        number[ports] = np.arange(len(ports))
        step = np.where(inside, number[(np.minimum(port, 2) * size + places).ravel()[ports]], np.arange(len(ports)))
        at, goal = inside.astype(np.int64), (links // 1000 * 4 + port).ravel()[ports]
        for _ in range(len(ports).bit_length() + 1):
            more = at[step]
            if not more.any():
                break
            at, step = at + more, step[step]
        far = np.where(inside[step], ids[ports % size] * 4 + ports // size, goal[step])
        place = _order(places, here, real)
        lost, asked = ids[real & (place < 0)][:1], np.unique(far)
        log = len(asked) + 1 + len(lost)
        told = {"place": np.repeat(TOLD, (len(asked), 1, len(lost))), "far0": np.concatenate([asked, [real.sum()], lost]), "at0": np.full(log, table.column("block")[0].as_py())}

        def spread(values):
            out = np.full(3 * size, -1)
            out[ports] = values
            return [pa.array(x, mask=x < 0) for x in out.reshape(3, size)]

        own = {c: table.column(c) for c in ("id", "type", *kept)} | {"place": pa.array(place)}
        own |= dict(zip([f"{c}{p}" for c in ("far", "at") for p in range(3)], spread(far) + spread(at + 1), strict=True))
        return pa.concat_tables([pa.table(own), pa.table({c: pa.array(told[c], pa.int64()) if c in told else pa.nulls(log, x.type) for c, x in own.items()})])

    return run


class Followed(NamedTuple):
    """A linked table whose links were followed."""

    #: gates (id, type, what was kept, place in the block; far0.., at0..), and the rows without an id of :func:`_in_block`
    rows: DataFrame
    #: (key, wire, more): from a far port, the wire's In gate and the number of links from there
    far: DataFrame
    #: whether ``far`` can be sent to all tasks
    small: bool

    def gates(self, names: DataFrame | None = None) -> DataFrame:
        """The gates with wire0.., at0..: for each port the wire's In gate (what ``names`` (wire, name) call it) and the number of links from it."""
        far = self.far if names is None else self.far.join(names, "wire").select("key", F.col("name").alias("wire"), "more")
        out = self.rows.where("id is not null")
        for p in range(3):
            met = far.select(F.col("key").alias(f"key{p}"), F.col("wire").alias(f"wire{p}"), F.col("more").alias(f"more{p}"))
            # a port that is not there has a key of its own, so such rows are not of one group
            out = out.join(F.broadcast(met) if self.small else met, F.coalesce(f"far{p}", -1 - F.col("id")) == F.col(f"key{p}"), "left")
        return out.select(*[c for c in self.rows.columns if c[:-1] not in ("far", "at")], *[f"wire{p}" for p in range(3)],
                          *[(F.col(f"at{p}") + F.col(f"more{p}")).alias(f"at{p}") for p in range(3)])

    def told(self, what: int, name: str) -> DataFrame:
        """(block, name): what the blocks tell."""
        return self.rows.where(F.col("id").isNull() & (F.col("place") == what)).select(F.col("at0").alias("block"), F.col("far0").alias(name))


def _shortened(table: pa.Table) -> pa.Table:
    """Far ports (key, far, more, done), each followed on through those of the same table."""
    table = table.combine_chunks().sort_by("key")
    key, far, more, done = (table.column(c).to_numpy() for c in ("key", "far", "more", "done"))
    place = np.minimum(np.searchsorted(key, far), max(len(key) - 1, 0))
    inside = ~done & (key[place] == far)
    step, at = np.where(inside, place, np.arange(len(key))), np.where(inside, more, 0)
    for _ in range(len(key).bit_length() + 1):
        at, step = at + at[step], step[step]
    return pa.table({"key": key, "far": far[step], "more": at + more[step], "done": done[step]})


def _schema(used: DataFrame, kept) -> str:
    kinds = dict(used.dtypes)
    return ", ".join([*[f"{c} {kinds[c]}" for c in ("id", "type", *kept)], "place long", *[f"{c}{p} long" for c in ("far", "at") for p in range(3)]])


def followed(gates: DataFrame, staged: Callable[[DataFrame], DataFrame], size: int = GATES, kept: tuple[str, ...] = ()) -> Followed:
    """Links followed back within blocks of ids first, each block apart, then from block to block (:func:`_met`)."""
    ship_code(gates.sparkSession)
    low, width = blocks(gates, size)
    used = gates.select(_block(F.col("id"), low, width).alias("block"), "id", "type", *PREV, *kept)
    return _met(staged(of_numbers(used.groupBy("block").applyInArrow(_in_block(list(kept)), _schema(used, kept)))), staged)


def _linked_in_block(ops: pa.Table, around: pa.Table) -> pa.Table:
    gates = in_chunk(ops, around)
    return _in_block(["param"])(gates.append_column("block", pa.array([ops.column("chunk")[0].as_py()] * len(gates), pa.int64())))


def linked_and_followed(ops: DataFrame, staged: Callable[[DataFrame], DataFrame]) -> Followed:
    """The table that operations (without an empty one) are linked to, its links followed (all but those of Out gates): the task that links a chunk follows its links."""
    rows = dealt(ops.select("op_id", "type", "param", "qubits"), staged)
    found = staged(of_numbers(rows.apply(_linked_in_block, _schema(rows.own.withColumn("id", F.col("op_id")), ["param"]))))
    ins = rows.io.where(F.col("type") == IN).select("id", F.col("type").cast("short").alias("type"), F.col("param").cast("float").alias("param"))
    return _met(found.unionByName(ins, allowMissingColumns=True), staged)


def _met(rows: DataFrame, staged: Callable[[DataFrame], DataFrame]) -> Followed:
    """What leads out of the blocks (``rows`` are those of :func:`_in_block`), followed through ranges of blocks with so many far ports, each range apart, and then by pointer
    doubling, a join for every binary digit of the most ranges on a wire; if ids say nothing at all about the neighbourhood these are nearly all links."""
    asked = staged(Followed(rows, None, False).told(ASKED, "key").select("key").distinct())
    low, high, n = asked.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    small = n <= SMALL
    pick = lambda c: F.when(F.col("key") % 4 == 0, F.col(f"{c}0")).when(F.col("key") % 4 == 1, F.col(f"{c}1")).when(F.col("key") % 4 == 2, F.col(f"{c}2"))
    met = rows.where("id is not null").join(F.broadcast(asked) if small else asked, F.col("id") == F.shiftright("key", 2)).select("key", (F.col("type") == IN).alias("done"), pick("far").alias("far"), pick("at").alias("more"))
    # a link to a port without a link back is as far as it goes (its gate is no In gate, so it never gets done)
    met = staged(met.select("key", F.coalesce("far", "key").alias("far"), F.when(F.col("done"), 0).otherwise(F.coalesce("more", F.lit(0))).cast("bigint").alias("more"), "done"))
    lost = asked.join(met, "key", "left_anti").first()
    if lost:
        gone = lost.key >> 2
        from_ = rows.where("id is not null").where(" or ".join(f"(at{p} = 1 and shiftright(far{p}, 2) = {gone})" for p in range(3))).first()
        raise MissingGate(f"gate {from_.id} comes after gate {gone}, which is not there")
    unstage(asked)
    width = max(1, RANGE * ((high or 0) - (low or 0) + 1) // n) if n else 1
    far = staged(met.withColumn("range", _block(F.col("key"), low or 0, width)).groupBy("range").applyInArrow(_shortened, "key long, far long, more long, done boolean"))
    unstage(met)
    for _ in range(n.bit_length() + 1):
        if far.where("not done").isEmpty():
            return Followed(rows, far.select("key", F.shiftright("far", 2).alias("wire"), "more"), small)
        on = far.select(F.col("key").alias("far"), F.col("far").alias("next"), F.col("more").alias("rest"), F.col("done").alias("next_done"))
        step = staged(far.where("not done").join(on, "far").select("key", F.col("next").alias("far"), (F.col("more") + F.col("rest")).alias("more"), F.col("next_done").alias("done")).unionByName(far.where("done")))
        unstage(far)
        far = step
    raise NotInOrder("a wire has no In gate: its gates follow each other in a circle")


def _by_port(gates: DataFrame) -> DataFrame:
    """(id, port, wire, at) of gates with their wires."""
    ports = F.array(*[F.struct(F.lit(p).cast("bigint").alias("port"), F.col(f"wire{p}").alias("wire"), F.col(f"at{p}").alias("at")) for p in range(3)])
    return gates.select("id", F.explode(ports).alias("x")).where("x.at is not null").select("id", "x.port", "x.wire", "x.at")


def wire_places(gates: DataFrame, staged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, port, wire, at) of every port but those of In gates: the id of the wire's In gate and the number of links from it."""
    return _by_port(followed(gates, staged).gates())


def _links(gates: DataFrame, size: int) -> DataFrame:
    """(id, then, prev, first): links between gates other than In and Out that lead from a block of ids back to another one."""
    low, width = blocks(gates, size)
    links = gates.where(~F.col("type").isin(IN, OUT)).select("id", F.explode(F.array(*PREV)).alias("prev")).where(link_type("prev") != IN)
    return links.select("id", _block(F.col("id"), low, width).alias("then"), link_id("prev").alias("prev"), _block(link_id("prev"), low, width).alias("first")).where("first <> then")


def _pairs(gates: DataFrame, size: int) -> tuple[list, list] | None:
    """(blocks, [(first, then, links)]); none if there are too many to tell."""
    pairs = _links(gates, size).groupBy("first", "then").agg(F.count(F.lit(1)).alias("n")).limit(PAIRS + 1).collect()
    named = [r[0] for r in gates.select(_block(F.col("id"), *blocks(gates, size)).alias("block")).distinct().limit(PAIRS + 1).collect()]
    return (named, [tuple(p) for p in pairs]) if len(pairs) <= PAIRS and len(named) <= PAIRS else None


def _sorted(spark, named: list, pairs: list) -> DataFrame | None:
    """(block, chunk): blocks in an order in which no pair leads to a later one; none if there is no such order."""
    order = TopologicalSorter(dict.fromkeys(sorted(named), ()))
    for first, then, _ in pairs:
        order.add(then, first)
    try:
        found = list(order.static_order())
    except CycleError:
        return None
    return spark.createDataFrame(list(zip(found, range(len(found)), strict=True)), "block long, chunk long")


def _block_order(gates: DataFrame, size: int) -> DataFrame | None:
    """(block, chunk): blocks of ids in an order in which no link leads to a later one; none if there is no such order, or too many pairs to tell."""
    found = _pairs(gates, size)
    return found and _sorted(gates.sparkSession, *found)


def _near_order(spark, named: list, pairs: list) -> DataFrame | None:
    """(block, chunk): blocks in the order of most links; none if too many lead back, or there is no such order."""
    n = {(first, then): k for first, then, k in pairs}
    forward = [p for p in pairs if p[2] > n.get((p[1], p[0]), 0)]
    if FEW * sum(k for *_, k in forward) < (FEW - 1) * sum(n.values()):
        return None
    return _sorted(spark, named, forward)


def _raised_in_block(table: pa.Table, late: pa.Table) -> pa.Table:
    """(id, chunk): the gates of a block that come after one of a later chunk; ``late`` are those that do so by a link from another block."""
    table = table.combine_chunks().sort_by("id")
    ids = table.column("id").to_numpy()
    _, places, here = _before(table, ids)
    first, then = places[here], np.broadcast_to(np.arange(len(ids)), here.shape)[here]
    by = np.argsort(first, kind="stable")
    to, start = then[by].tolist(), np.searchsorted(first[by], np.arange(len(ids) + 1)).tolist()
    chunk: dict[int, int] = {}
    for now, gate in sorted(zip(late.column("now").to_pylist(), late.column("id").to_pylist(), strict=True), reverse=True):
        open_ = [int(np.searchsorted(ids, gate))]
        while open_:
            g = open_.pop()
            if g not in chunk:
                chunk[g] = now
                open_ += to[start[g] : start[g + 1]]
    return pa.table({"id": pa.array(ids[list(chunk)]), "chunk": pa.array(list(chunk.values()), pa.int64())}) if chunk else pa.table({"id": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64())})


def _raised_blocks(gates: DataFrame, order: DataFrame, staged: Callable[[DataFrame], DataFrame], size: int) -> DataFrame | None:
    """(id, chunk) of all gates but In and Out: their blocks' chunks, raised until no gate is in an earlier chunk than one before it; none if a chunk gets too large.

    Only blocks with a gate that was found to be late are looked at again, and only gates that were raised are told on."""
    real = gates.where(~F.col("type").isin(IN, OUT)).select(_block(F.col("id"), *blocks(gates, size)).alias("block"), "id", "type", *PREV)
    rank = lambda c: F.broadcast(order.select(F.col("block").alias(c), F.col("chunk").alias(f"{c}_chunk")))
    across = staged(_links(gates, size).join(rank("then"), "then").join(rank("first"), "first"))
    raised, late = None, across.where("first_chunk > then_chunk").groupBy("id", "then").agg(F.max("first_chunk").alias("now"))
    while True:
        late = staged(late.withColumnRenamed("then", "block"))
        if late.isEmpty():
            break
        found = staged(real.join(late.select("block").distinct(), "block", "left_semi").groupBy("block").cogroup(late.groupBy("block")).applyInArrow(_raised_in_block, "id long, chunk long"))
        raised = found if raised is None else staged(raised.unionByName(found).groupBy("id").agg(F.max("chunk").alias("chunk")))
        told = across.join(found.select(F.col("id").alias("prev"), F.col("chunk").alias("now")), "prev").where("now > then_chunk").groupBy("id", "then").agg(F.max("now").alias("now"))
        late = told.join(raised, "id", "left").where("chunk is null or now > chunk").select("id", "then", "now")
    own = real.join(F.broadcast(order), "block").select("id", "type", *PREV, "chunk")
    if raised is not None:
        own = own.join(raised.withColumnRenamed("chunk", "now"), "id", "left").select("id", "type", *PREV, F.coalesce("now", "chunk").alias("chunk"))
    own = staged(own)
    return own if own.groupBy("chunk").count().where(F.col("count") > MOST * size).isEmpty() else None


def _raised(own: DataFrame, n_wires: int, staged: Callable[[DataFrame], DataFrame], size: int) -> DataFrame:
    """(id, chunk): chunks by the largest places on wires, raised along the wires until no gate is in an earlier chunk than one before it."""
    levels = max(1, size // max(1, n_wires))
    guess = own.groupBy("id").agg(F.floor(F.max("at") / levels).cast("bigint").alias("chunk"))
    rows = staged(own.join(guess, "id"))
    while True:
        seen = running_max(rows, ["wire"], "at", F.col("chunk"), "seen")
        raised = seen.groupBy("id").agg(F.max("seen").alias("now"))
        step = staged(rows.join(raised, "id"))
        unstage(rows)
        rows = step.drop("chunk").withColumnRenamed("now", "chunk")
        if step.where("now > chunk").isEmpty():
            return rows.groupBy("id").agg(F.max("chunk").alias("chunk"))


def _in_chunk(table: pa.Table) -> pa.Table:
    """(id, chunk, place): gates of a chunk, each after those before it."""
    table = table.combine_chunks().sort_by("id")
    ids, real = table.column("id").to_numpy(), _real(table)
    _, places, here = _before(table, ids)
    place = _order(places, here, real)
    if (place < 0).any():
        raise NotInOrder(f"gates wait for each other in a circle, among them {ids[place < 0].min()}")
    return pa.table({"id": table.column("id"), "chunk": table.column("chunk"), "place": pa.array(place)})


def _starts(counts: DataFrame) -> DataFrame:
    """(c, start) of (chunk, n): how many are in the chunks before."""
    return counts.select(F.col("chunk").alias("c"), (F.sum("n").over(W.orderBy("chunk")) - F.col("n")).alias("start"))


def linked_to_ops(gates: DataFrame, staged: Callable[[DataFrame], DataFrame], size: int = GATES, known: Followed | None = None) -> DataFrame:
    """(op_id, id, type, param, qubits, label, cl_ctrl, meas_key) of a linked table: op_ids are dense from 0 in an order of time.

    Qubits are numbered by their In gates' ids. A missing gate and a circle are errors. Where blocks of ids follow each other
    in time, in whatever order, they are the chunks. Where few links lead back their chunks are raised. Otherwise chunks come from the places on the wires and
    have about ``size`` gates if the gates are spread evenly over the levels of their guesses. ``known`` is the same table as
    :func:`followed` gave it; operations have those of ``KEPT`` that it has."""
    known = followed(gates, staged, size, KEPT) if known is None else known
    circle = known.told(CIRCLE, "id").agg(F.min("id")).first()[0]
    if circle is not None:
        raise NotInOrder(f"gates wait for each other in a circle, among them {circle}")
    wires = staged(global_rank(gates.where(F.col("type") == IN).select(F.col("id").alias("wire")), "wire", name="name"))
    pairs = _pairs(gates, size)
    order = pairs and _sorted(gates.sparkSession, *pairs)
    rows = known.gates(wires).where(~F.col("type").isin(IN, OUT))
    rows = rows.withColumn("qubits", F.array_compact(F.array(*[f"wire{p}" for p in range(3)])))
    if order is not None:
        counts = known.told(N_GATES, "n").join(F.broadcast(order), "block")
        starts = order.join(_starts(counts), F.col("chunk") == F.col("c")).select("block", "start")
        found = rows.withColumn("block", _block(F.col("id"), *blocks(gates, size))).join(F.broadcast(starts), "block")
    else:
        near = pairs and _near_order(gates.sparkSession, *pairs)
        chunks = _raised_blocks(gates, near, staged, size) if near is not None else None
        if chunks is None:
            own = staged(_by_port(known.gates().where(~F.col("type").isin(IN, OUT))))
            chunks = gates.select("id", "type", *PREV).join(_raised(own, wires.count(), staged, size), "id")
            unstage(own)
        placed = staged(of_numbers(chunks.groupBy("chunk").applyInArrow(_in_chunk, "id long, chunk long, place long")))
        starts = _starts(placed.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")))
        found = rows.drop("place").join(placed.join(F.broadcast(starts), F.col("chunk") == F.col("c")).select("id", "place", "start"), "id")
    return found.select((F.col("start") + F.col("place")).alias("op_id"), "id", "type", *[c for c in KEPT[:1] if c in rows.columns], "qubits", *[c for c in KEPT[1:] if c in rows.columns])


def linked_layers(gates: DataFrame, staged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, type, param, qubits, layer) of a linked table: the longest path to each gate from the In gates, which are layer 0."""
    ops = staged(linked_to_ops(gates, staged))
    found = layered(ops.select("op_id", "type", "param", "qubits"), staged)
    return ops.select("op_id", "id").join(found, "op_id").drop("op_id")


def _on_wires(gates: DataFrame | Followed, staged: Callable[[DataFrame], DataFrame], names: DataFrame | None = None) -> DataFrame:
    """(type, param, wire0, wire1, wire2, at0, at1, at2) of all gates but In and Out, with the numbers or names of the qubits."""
    known = gates if isinstance(gates, Followed) else followed(gates, staged, kept=("param",))
    wires = global_rank(known.rows.where(F.col("id").isNotNull() & (F.col("type") == IN)).select(F.col("id").alias("wire")), "wire", name="rank")
    wires = wires.withColumnRenamed("rank", "name") if names is None else wires.join(names.select("rank", F.col("qubit").alias("name")), "rank").drop("rank")
    rows = known.gates(wires).where(~F.col("type").isin(IN, OUT) & F.coalesce(*[f"at{p}" for p in range(3)]).isNotNull())
    return rows.select("type", "param", *[f"{c}{p}" for c in ("wire", "at") for p in range(3)])


def on_wires(gates: DataFrame, staged: Callable[[DataFrame], DataFrame], names: DataFrame | None = None) -> DataFrame:
    """(type, param, ends) of all gates but In and Out: on which qubits and as their how many-th gate.

    Qubits are numbered by their In gates' ids; ``names`` (rank, qubit) calls them something else.
    Equal circuits have equal rows, whatever their ids."""
    ends = F.array(*[F.when(F.col(f"at{p}").isNotNull(), F.struct(F.lit(p).cast("bigint").alias("port"), F.col(f"wire{p}").alias("qubit"), F.col(f"at{p}").alias("at"))) for p in range(3)])
    return _on_wires(gates, staged, names).select("type", "param", F.array_compact(ends).alias("ends"))


def differing(first: DataFrame | Followed, second: DataFrame | Followed, staged: Callable[[DataFrame], DataFrame], names: DataFrame | None = None) -> DataFrame:
    """One row (differing): how many gates of either table have no like in the other; ``names`` are those of the second's qubits. Tables may be followed already (with ``param``).

    Gates are counted and their digests (two of 64 bits, as sums of halves) added up for so many places of a wire at a time, where the rows are;
    only gates of places whose sums are not equal are moved and compared one by one."""
    both = _on_wires(first, staged).withColumn("sign", F.lit(1)).unionByName(_on_wires(second, staged, names).withColumn("sign", F.lit(-1)))
    at, wire = F.coalesce("at0", "at1", "at2"), F.coalesce("wire0", "wire1", "wire2")
    cells = ["type", F.col("param").isNull(), "param", *[F.coalesce(f"{c}{p}", F.lit(-1).cast("bigint")) for c in ("wire", "at") for p in range(3)]]
    both = both.withColumn("at", F.shiftright(at, PLACES)).withColumn("wire", F.coalesce(wire, F.lit(-1).cast("bigint")))
    halves = [h for salt in (1, 2) for x in [F.xxhash64(F.lit(salt), *cells)] for h in (x.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(x, 32))]
    sums = both.groupBy("wire", "at").agg(F.sum("sign").cast("bigint").alias("s"), *[F.sum(F.col("sign") * h).alias(f"s{i}") for i, h in enumerate(halves)])
    unlike = staged(sums.where(" or ".join(f"{c} <> 0" for c in ("s", *[f"s{i}" for i in range(len(halves))]))).select("wire", "at"))
    ends = ["type", "param", *[f"{c}{p}" for c in ("wire", "at") for p in range(3)]]
    rest = both.limit(0) if unlike.isEmpty() else both.join(unlike, ["wire", "at"], "left_semi")
    return rest.groupBy(*ends).agg(F.sum("sign").alias("n")).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("differing"))


def renumbered(gates: DataFrame) -> DataFrame:
    """The same circuit with its ids in reverse: no gate is numbered after those before it any more."""
    top = gates.agg(F.max("id").alias("top"))
    turn = lambda c: ((F.col("top") - link_id(c)) * 1000 + F.col(c) % 1000).alias(c)
    sides = [f"{s}_q{p}" for s in ("prev", "next") for p in (1, 2, 3)]
    changed = {"id": (F.col("top") - F.col("id")).alias("id")} | {c: turn(c) for c in sides}
    return gates.join(F.broadcast(top)).select(*[changed.get(c, F.col(c)) for c in gates.columns])
