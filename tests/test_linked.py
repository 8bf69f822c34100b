"""Linked tables back to operations and layers; stored tables and the stream builder after changes and restarts."""

import random

import pytest
from pyspark.sql import functions as F
from test_engine import ops_frame, random_ops, same, unitary

from wireflow import queries as q
from wireflow.operators import decompose, engine, gates, layers
from wireflow.operators import linked as ln
from wireflow.plans.build import linked, qubits
from wireflow.plans.running import global_rank
from wireflow.plans.staging import names_in, once


def in_time(table, size=ln.GATES):
    """[(type, param, qubits)] in an order of time, qubits by the order of In gates."""
    rows = ln.linked_to_ops(table, q.staged, size).orderBy("op_id").collect()
    assert [r.op_id for r in rows] == list(range(len(rows)))
    return [(r.type, r.param, list(r.qubits)) for r in rows]


@pytest.mark.parametrize("size", [8, 1 << 16])
def test_operations_of_renumbered_tables(spark, size):
    ops = random_ops(3, qubits=4, n=30) + [(23, 1, [0, 2, 1]), (24, 1, [3, 0, 1])]
    table = q.staged(linked(ops_frame(spark, ops)))
    names = {x: n for n, x in enumerate(dict.fromkeys(x for _, _, qs in ops for x in qs))}
    want = unitary([(c, p, [names[x] for x in qs]) for c, p, qs in ops], 4)
    assert same(want, unitary(in_time(table, size), 4))
    turned = q.staged(ln.renumbered(table))
    assert same(want, unitary([(c, p, [3 - x for x in qs]) for c, p, qs in in_time(turned, size)], 4))
    found = q.staged(ln.linked_to_ops(turned, q.staged, size))
    again = q.staged(linked(found, q.staged))
    assert ln.differing(turned, again, q.staged, qubits(found)).first()[0] == 0
    other = q.staged(linked(found.withColumn("type", F.when(F.col("op_id") == 5, 9).otherwise(F.col("type")).cast("short")), q.staged))
    assert ln.differing(turned, other, q.staged, qubits(found)).first()[0] == 2


def test_layers_of_renumbered_tables(spark):
    ops = random_ops(8, qubits=5, n=40)
    table = q.staged(linked(ops_frame(spark, ops)))
    want = sorted(r.layer for r in layers.layered(ops_frame(spark, ops), q.staged).collect())
    turned = q.staged(ln.renumbered(table))
    assert sorted(r.layer for r in ln.linked_layers(turned, q.staged).collect()) == want
    ladder = [(18, 1, [i, i + 1]) for i in range(40)]
    found = ln.linked_layers(q.staged(ln.renumbered(q.staged(linked(ops_frame(spark, ladder))))), q.staged)
    assert sorted(r.layer for r in found.collect()) == list(range(1, 41))


def test_rewritten_tables(spark):
    ops = random_ops(2, n=30)
    first = q.staged(linked(ops_frame(spark, ops)))
    after = engine.optimise(first, engine.STANDARD_RULES, q.staged)
    names = {x: n for n, x in enumerate(dict.fromkeys(x for _, _, qs in ops for x in qs))}
    assert same(unitary([(c, p, [names[x] for x in qs]) for c, p, qs in ops], 3), unitary(in_time(after), 3))
    three = q.staged(linked(ops_frame(spark, [(23, 1, [0, 1, 2]), (8, 1, [1]), (23, 1, [2, 1, 0])])))
    assert same(unitary([(23, 1, [0, 1, 2]), (8, 1, [1]), (23, 1, [2, 1, 0])], 3), unitary(in_time(q.staged(decompose.toffolis_in_place(three, q.staged))), 3))


def shuffled(table, by: int):
    """The same circuit with ids that say nothing about the order of time: multiplied modulo a prime."""
    turn = lambda c: ((ln.link_id(c) * by % 10007) * 1000 + F.col(c) % 1000).alias(c)
    return q.staged(table.select(*[(F.col("id") * by % 10007).alias(c) if c == "id" else turn(c) if c in engine.SIDES else F.col(c) for c in table.columns]))


def test_blocks_of_ids(spark):
    """Ids in any order give the circuit; where neighbours have near ids, long wires take no more tables than short ones and blocks are the chunks."""
    ops = random_ops(4, qubits=4, n=60)
    table = q.staged(linked(ops_frame(spark, ops)))
    names = {x: n for n, x in enumerate(dict.fromkeys(x for _, _, qs in ops for x in qs))}
    want = unitary([(c, p, [names[x] for x in qs]) for c, p, qs in ops], 4)
    mixed = shuffled(table, 3571)
    assert ln._block_order(mixed, 8) is None
    order = {r.wire: n for n, r in enumerate(sorted(mixed.where("type = 0").select((F.col("id")).alias("wire")).collect()))}
    first = [r.id for r in table.where("type = 0").orderBy("id").collect()]
    places = [order[g * 3571 % 10007] for g in first]
    assert same(unitary([(c, p, [places[names[x]] for x in qs]) for c, p, qs in ops], 4), unitary(in_time(mixed, 8), 4))
    assert same(want, unitary(in_time(table, 8), 4)) and ln._block_order(table, 8) is not None
    made = []

    def counted(df):
        made.append(1)
        return q.staged(df)

    wire = q.staged(linked(ops_frame(spark, [(8, 1, [0]) for _ in range(600)])))
    assert sorted(r.at for r in ln.wire_places(q.staged(ln.renumbered(wire)), counted).collect()) == list(range(1, 602))
    assert len(made) <= 4


def moved(table, size, by):
    """The same circuit with two gates at every ``size`` ids swapped, ``by`` ids from each other, so that links lead back to later blocks."""
    kinds = {r.id: r.type for r in table.select("id", "type").collect()}
    swap = {}
    for x in range(size - 1, max(kinds), size):
        a, b = x - by // 2, x - by // 2 + by
        if kinds.get(a, 0) > 1 and kinds.get(b, 0) > 1:
            swap |= {a: b, b: a}
    names = F.create_map(*[F.lit(x) for pair in swap.items() for x in pair])
    new = lambda x: F.coalesce(F.try_element_at(names, x.cast("int")), x)
    return q.staged(table.select(*[new(F.col("id")).alias(c) if c == "id" else (new(ln.link_id(c)) * 1000 + F.col(c) % 1000).alias(c) if c in engine.SIDES else F.col(c) for c in table.columns]))


@pytest.mark.parametrize("by", [6, 90])
def test_gates_behind_later_ones_are_raised(spark, monkeypatch, by):
    """Where few links lead back, chunks are raised from block to block; not all gates go in rounds along all wires."""
    monkeypatch.setattr(ln, "_raised", None)
    table = moved(q.staged(linked(ops_frame(spark, random_ops(7, qubits=8, n=700)), q.staged)), 64, by)
    assert ln._block_order(table, 64) is None
    ops = q.staged(ln.linked_to_ops(table, q.staged, 64))
    assert sorted(r.op_id for r in ops.select("op_id").collect()) == list(range(ops.count()))
    assert ln.differing(table, q.staged(linked(ops, q.staged)), q.staged, qubits(ops)).first()[0] == 0
    other = q.staged(linked(ops.withColumn("param", F.when(F.col("op_id") == 99, 7.5).otherwise(F.col("param")).cast("float")), q.staged))
    assert ln.differing(table, other, q.staged, qubits(ops)).first()[0] == 2


def test_chunks_are_linked_and_followed_at_once(spark, monkeypatch):
    """What is linked and followed by one task is the linked table, in whose comparison other links, parameters and missing gates show; its blocks are followed in ranges."""
    monkeypatch.setattr(ln, "RANGE", 8)
    monkeypatch.setattr(ln, "GATES", 16)
    monkeypatch.setattr("wireflow.plans.running.chunk_of.__defaults__", (16,))
    ops = ops_frame(spark, random_ops(9, qubits=5, n=120) + [(23, 1, [0, 2, 1]), (24, 1, [3, 0, 1])])
    table = q.staged(linked(ops, q.staged))
    many = ln.followed(table, q.staged, 16, ("param",))
    assert many.rows.where("id is null").count() > 20 and gates.dangling(table).count() == 0
    places = qubits(ops).select("rank", F.col("rank").alias("qubit"))
    again = lambda o: ln.differing(many, ln.linked_and_followed(o, q.staged), q.staged, places).first()[0]
    assert again(ops) == 0 and ln.differing(many, table, q.staged, places).first()[0] == 0
    assert again(ops.withColumn("param", F.when(F.col("op_id") == 60, 7.5).otherwise(F.col("param")).cast("float"))) == 2
    assert again(ops.withColumn("qubits", F.when(F.col("op_id") == ops.count() - 1, F.reverse("qubits")).otherwise(F.col("qubits")))) == 2


def test_rows_are_moved_once_to_blocks(spark):
    """Operations are not joined with their gates by id again; chunks are linked, not sorted wire by wire."""
    table = q.staged(linked(ops_frame(spark, random_ops(4, qubits=4, n=60)), q.staged))
    plan = ln.linked_to_ops(table, q.staged)._jdf.queryExecution().toString()
    assert "hashpartitioning(id#" not in plan and "InPandas" not in plan
    assert "Window" not in linked(ops_frame(spark, random_ops(4, qubits=4, n=60)), q.staged)._jdf.queryExecution().toString()


def test_gates_are_dealt_once(spark):
    """The ports of a gate meet where its chunk is; gates are not shuffled by id."""
    plan = linked(ops_frame(spark, random_ops(4, qubits=4, n=60)), q.staged)._jdf.queryExecution().toString()
    assert "hashpartitioning(chunk#" in plan and "hashpartitioning(id#" not in plan


def test_global_rank_moves_rows_once(spark):
    """Rows are numbered in the task that sorted their range: no window over them, and so no second shuffle."""
    rows = [(random.Random(i).randrange(10**6), i) for i in range(3000)]
    found = global_rank(spark.createDataFrame(rows, "x long, y long").repartition(7), "x", "y")
    assert "row_number" not in found._jdf.queryExecution().toString()
    assert [(r.x, r.y) for r in sorted(found.collect(), key=lambda r: r["rank"])] == sorted(rows) and sorted(r["rank"] for r in found.collect()) == list(range(3000))
    assert global_rank(spark.range(0), "id").count() == 0


def test_circles_and_missing_gates(spark):
    link = lambda g, p, t: g * 1000 + p * 100 + t
    table = q.staged(linked(ops_frame(spark, [(18, 1, [0, 1]), (18, 1, [0, 1])])))
    rows = {r.id: r.asDict() for r in table.collect()}
    g, h = sorted(i for i, r in rows.items() if r["type"] == 18)
    with pytest.raises(ln.MissingGate, match=f"comes after gate {g}"):
        ln.linked_to_ops(table.where(F.col("id") != g), q.staged)
    # the second wire meets the two gates the other way round: each waits for the other
    a, b = (next(i for i, r in rows.items() if r["type"] == t and rows[i]["next_q1" if t == 0 else "prev_q1"] // 100 % 10 == 1) for t in (0, 1))
    rows[a]["next_q1"], rows[h]["prev_q2"], rows[h]["next_q2"] = link(h, 1, 18), link(a, 0, 0), link(g, 1, 18)
    rows[g]["prev_q2"], rows[g]["next_q2"], rows[b]["prev_q1"] = link(h, 1, 18), link(b, 0, 1), link(g, 1, 18)
    crossed = q.staged(spark.createDataFrame([tuple(r[c] for c in table.columns) for r in rows.values()], table.schema))
    with pytest.raises(Exception, match="wait for each other in a circle"):
        ln.linked_to_ops(crossed, q.staged).count()
    loop = q.staged(table.withColumn("prev_q1", F.when(F.col("id") == g, F.lit(link(h, 0, 18))).otherwise(F.col("prev_q1"))))
    with pytest.raises(ln.NotInOrder, match="no In gate"):
        ln.linked_to_ops(loop, q.staged)
    assert ln.linked_to_ops(table.where("false"), q.staged).count() == 0


def test_stored_tables_follow_their_source(spark, tmp_path):
    source = str(tmp_path)
    spark.range(10).coalesce(1).write.parquet(f"{source}/orders.parquet")
    make = lambda: spark.read.parquet(f"{source}/orders.parquet").withColumn("x", F.col("id") * 2)
    first = once(spark, "test", source, make)
    assert first.count() == 10 and once(spark, "test", source, make).staged_at == first.staged_at
    spark.range(3).coalesce(1).write.mode("append").parquet(f"{source}/orders.parquet")
    second = once(spark, "test", source, make)
    assert second.count() == 13 and second.staged_at != first.staged_at and not names_in(spark, first.staged_at)
    spark.range(4).coalesce(1).write.mode("overwrite").parquet(f"{source}/orders.parquet")
    assert once(spark, "test", source, make).count() == 4


def test_registered_queries_follow_their_source(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert q.QUERIES["opt_stats"](spark, str(tmp_path)).first().total_count == 3960
    orders.where("o_orderkey < 700").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    want = q.QUERIES["ops_source"](spark, str(tmp_path)).count()
    assert q.QUERIES["opt_stats"](spark, str(tmp_path)).first().total_count == want < 3960


@pytest.mark.parametrize("cut", [1, 2, 3, "end", "half"])
def test_builder_goes_on_after_a_restart(spark, tmp_path, cut):
    """A new builder on the folder after any batch, before the flush, after a flush, or after a batch that was cut off gives the whole table."""
    from wireflow.streaming.builder import GATES, Builder, run_builder

    r = random.Random(5)
    ops = random_ops(6, qubits=7, n=30) + [(23, 1, r.sample(range(9), 3)) for _ in range(10)]
    frame = ops_frame(spark, ops)
    parts = [frame.where((F.col("op_id") >= at) & (F.col("op_id") < at + 30)) for at in range(0, len(ops), 30)]
    at = f"{tmp_path}/own"
    columns = [c.split(" ")[0] for c in GATES.split(", ")]
    builder = Builder(spark, at)
    for i, part in enumerate(parts):
        if i == cut:
            builder = Builder(spark, at)
        if i == 2 and cut == "half":  # gates and open ports are written, the totals are not
            builder.step(part, i)
            (tmp_path / "own/totals/2/_SUCCESS").unlink()
            builder = Builder(spark, at)
            assert builder.last() == 1
        builder.step(part, i)
        if i == 1 and cut == "end":
            builder.flush()
            builder = Builder(spark, at)
    Builder(spark, at).flush()
    got = spark.read.schema(GATES).option("recursiveFileLookup", True).parquet(f"{at}/gates")
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, linked(frame).select(*columns).collect()))
    assert len(names_in(spark, f"{at}/open")) <= 2
    with pytest.raises(ValueError, match="came after"):
        Builder(spark, at).step(parts[0], 99)
    if cut == 1:  # a stream that was stopped, with more files after that
        for i, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            got = run_builder(stream, f"{tmp_path}/stream")
        assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, linked(frame).select(*columns).collect()))
