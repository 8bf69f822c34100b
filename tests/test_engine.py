"""The engine against its SQL, brute force and state vectors."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wireflow import queries as q
from wireflow.functions import codec
from wireflow.operators import decompose, edges, engine, equivalence, gates, layers, widgets
from wireflow.operators import linked as linked_ops
from wireflow.operators import wire_rewrites as rewrites
from wireflow.plans.build import linked, wires
from wireflow.plans.running import global_rank, neighbours, running_sum

TABLES = ("orders", "events")


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(q.SQL[name])
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    at = [want.columns.index(c) for c in order]
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def ops_frame(spark, rows):
    return spark.createDataFrame([(i, c, float(p), list(qs)) for i, (c, p, qs) in enumerate(rows)], "op_id long, type short, param float, qubits array<long>")


def random_ops(seed, qubits=3, n=25):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.sample(range(qubits), 2)
        out += r.choice(([(8, 1, [a]), (8, 1, [a])], [(18, 1, [a, b])] * 2, [(8, 1, [a]), (8, 1, [b]), (18, 1, [a, b]), (8, 1, [a]), (8, 1, [b])],
                         [(29, 0, [a]), (30, 0, [a])], [(29, 0, [a]), (18, 1, [a, b])], [(18, 1, [a, b]), (29, 0, [a])], [(29, 0, [a]), (29, 0, [a])]))
    return out


ONE = {8: np.array([[1, 1], [1, -1]]) / np.sqrt(2), 27: np.diag([1, 1j]), 28: np.diag([1, -1j]), 29: np.diag([1, np.exp(1j * np.pi / 4)]), 30: np.diag([1, np.exp(-1j * np.pi / 4)]), 9: np.array([[0, 1], [1, 0]])}


def unitary(ops, n):
    u = np.eye(2**n, dtype=complex).reshape([2] * n + [2**n])
    for code, param, qs in ops:
        if code in (18, 15):
            t = np.moveaxis(u, qs, [0, 1]).copy()
            t[1] = t[1][::-1].copy()
            u = np.moveaxis(t, [0, 1], qs)
        elif code == 23:
            t = np.moveaxis(u, qs, [0, 1, 2]).copy()
            t[1, 1] = t[1, 1][::-1].copy()
            u = np.moveaxis(t, [0, 1, 2], qs)
        elif code == 24:
            t = np.moveaxis(u, qs, [0, 1, 2]).copy()
            t[1] = np.swapaxes(t[1], 0, 1).copy()
            u = np.moveaxis(t, [0, 1, 2], qs)
        else:
            m = np.diag([1, np.exp(1j * np.pi * param)]) if code == 7 else ONE[code]
            u = np.moveaxis(np.tensordot(m, u, axes=(1, qs[0])), 0, qs[0])
    return u.reshape(2**n, 2**n)


def same(a, b):
    at = np.unravel_index(np.abs(a).argmax(), a.shape)
    return np.allclose(a * (b[at] / a[at]), b, atol=1e-9)


def back_to_ops(table):
    """Operations of a linked table, by following the links (a small reference model for tests)."""
    rows = {r.id: r for r in table}
    ins = sorted(i for i, r in rows.items() if r.type == 0)
    wire = {}
    order, done, ready = [], {}, []
    at = {}
    for n, i in enumerate(ins):
        wire[i, 0] = n
        ready.append(rows[i].next_q1)
    while ready:
        link = ready.pop(0)
        g, port = link // 1000, link // 100 % 10
        row = rows[g]
        assert link % 100 == row.type
        at.setdefault(g, set()).add(port)
        need = [p for p in range(3) if row[f"prev_q{p + 1}"] is not None]
        if at[g] == set(need):
            for p in need:
                before = row[f"prev_q{p + 1}"]
                wire[g, p] = wire[before // 1000, before // 100 % 10]
            if row.type != 1:
                order.append((row.type, row.param, [wire[g, p] for p in need]))
                ready += [row[f"next_q{p + 1}"] for p in need]
    assert len(order) == sum(r.type > 1 for r in table)
    return order


@pytest.mark.parametrize("seed", [1, 2])
def test_engine_keeps_the_unitary(spark, seed):
    ops = [o for o in random_ops(seed)]
    frame = ops_frame(spark, ops)
    first = q.staged(linked(frame))
    names = {x: n for n, x in enumerate(dict.fromkeys(x for _, _, qs in ops for x in qs))}
    before = unitary([(c, p, [names[x] for x in qs]) for c, p, qs in ops], 3)
    assert same(before, unitary(back_to_ops(first.collect()), 3))
    assert gates.dangling(first).count() == 0
    rules = (*engine.STANDARD_RULES[:2], engine.commute(29, 0.0), *engine.STANDARD_RULES[2:])
    after = engine.optimise(first, rules, q.staged)
    assert not any(rule.match(after).count() for rule in rules)
    assert gates.dangling(after).count() == 0
    rows = after.collect()
    assert len(rows) < len(ops) + 6
    assert same(before, unitary(back_to_ops(rows), 3))


def test_cancel_chain_needs_few_rounds(spark):
    table = q.staged(linked(ops_frame(spark, [(8, 1, [0])] * 61)))
    left, n = engine.to_fixpoint(table, engine.STANDARD_RULES[0], q.staged)
    assert n == 30 and left.count() == 3


@pytest.mark.parametrize("name, want", [("TOFFOLI", 23), ("FREDKIN", 24), ("TOFFOLI_REVERSED", 23), ("CCZ_DIRECT", None), ("CCZ_DIRECT_REVERSED", None)])
def test_templates_are_exact(name, want):
    steps = [(c, p, ["abc".index(x) for x in qs]) for c, p, qs in decompose.sequence(getattr(decompose, name))]
    target = np.diag([1, 1, 1, 1, 1, 1, 1, -1]) if want is None else unitary([(want, 1, [0, 1, 2])], 3)
    assert same(unitary(steps, 3), target)


def test_two_level_windows(spark):
    rows = [(i, i % 3, (i * 7) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g long, v long")
    got = {r.k: r.s for r in running_sum(df, ["g"], "k", F.col("v"), "s", chunk=16).collect()}
    sums, want = {}, {}
    for k, g, v in rows:
        sums[g] = want[k] = sums.get(g, 0) + v
    assert got == want
    near = {r.k: (r.b and r.b.k, r.a and r.a.k) for r in neighbours(df, ["g"], "k", F.struct("k"), "b", "a", chunk=16).collect()}
    assert near == {k: (k - 3 if k >= 3 else None, k + 3 if k + 3 < 500 else None) for k, _, _ in rows}
    ranks = {r.k: r["rank"] for r in global_rank(df.repartition(5), "v", "k").collect()}
    assert ranks == {k: i for i, (_, k) in enumerate(sorted((v, k) for k, _, v in rows))}


@pytest.mark.parametrize("chunk", [16, 1000, None])
def test_layers_brute(spark, chunk):
    ops = random_ops(4, qubits=6, n=80)
    got = {r.op_id: r.layer for r in layers.layered(ops_frame(spark, ops), q.staged, chunk).collect()}
    last, want = {}, {}
    for i, (_, _, qs) in enumerate(ops):
        want[i] = 1 + max(last.get(x, 0) for x in qs)
        last |= {x: want[i] for x in qs}
    assert got == want


def test_wires_resolved(spark):
    table = q.staged(linked(ops_frame(spark, random_ops(5, qubits=4, n=60))))
    found = {(r.id, r.port): r.wire for r in linked_ops.wire_places(table, q.staged).collect()}
    rows = {r.id: r for r in table.collect()}
    for (g, p), w in found.items():
        at = (g, p)
        while rows[at[0]].type != 0:
            link = rows[at[0]][f"prev_q{at[1] + 1}"]
            at = (link // 1000, link // 100 % 10)
        assert at[0] == w


def test_widgets_respect_bounds(spark):
    table = q.staged(linked(ops_frame(spark, random_ops(6, qubits=4, n=60))))
    batches = edges.edge_batches(edges.edge_list(table), 50)
    rows = widgets.widgets(batches, table, max_t=2, max_depth=4).collect()
    assert rows and all(r.t <= 2 and r.depth <= 4 for r in rows)
    size = pd.DataFrame([r.asDict() for r in rows]).groupby(["batch", "widget"]).agg(n=("node", "size"), d=("depth", "max"))
    assert (size.n == size.d).all()
    codes = {r.code: r.n for r in widgets.union_codes(batches, table, 2, 4).collect()}
    assert sum(codes.values()) == edges.edge_list(table).where("source >= 0 and target >= 0").count()
    free = widgets.widgets(batches.withColumn("batch", F.lit(0).cast("long")), table, 10**6, 10**6)
    assert free.select("widget").distinct().count() == 1


def test_equivalence(spark):
    r = random.Random(7)
    ops = [(18, 1, r.sample(range(5), 2)) for _ in range(30)]
    own = ops_frame(spark, ops)
    padded = ops_frame(spark, [*ops[:20], (18, 1, [0, 1]), (18, 1, [0, 1]), *ops[20:]])
    assert equivalence.equivalent(own, padded, q.staged).first()[0]
    assert not equivalence.equivalent(own, equivalence.mutant(own), q.staged).first()[0]
    both = q.staged(equivalence.composed_with_inverse(own, own))
    assert rewrites.cancel_two_qubit(both, staged=q.staged).count() == 0


def test_codec_functions(spark):
    codec.register(spark)
    row = spark.range(1).selectExpr("create_link(9007199254740993, 2, 18) as l").select("l", codec.link_id("l").alias("i"), codec.link_port("l").alias("p"), codec.link_type("l").alias("t"), codec.strip_type("l").alias("s")).first()
    assert tuple(row) == (9007199254740993218, 9007199254740993, 2, 18, 90071992547409932)


def test_relink_and_expand(spark):
    ops = ops_frame(spark, [(18, 1, [0, 1]), (29, 0, [0])])
    five = rewrites.expand_cx(ops).orderBy("op_id", "sub").collect()
    assert [(r.type, list(r.qubits)) for r in five] == [(8, [0]), (8, [1]), (18, [1, 0]), (8, [0]), (8, [1]), (29, [0])]
    assert wires(ops).count() == 3


def test_layers_of_nothing(spark):
    assert layers.layered(spark.createDataFrame([], "op_id long, type short, param float, qubits array<long>"), q.staged).count() == 0


def test_toffolis_in_place(spark):
    r = random.Random(3)
    ops = [r.choice([(23, 1, r.sample(range(4), 3)), (23, 1, r.sample(range(4), 3)), (8, 1, [r.randrange(4)]), (18, 1, r.sample(range(4), 2))]) for _ in range(14)]
    table = q.staged(linked(ops_frame(spark, ops)))
    after = decompose.toffolis_in_place(table, q.staged)
    assert after.columns == table.columns and gates.dangling(after).count() == 0
    rows = after.collect()
    assert not any(x.type == 23 for x in rows) and len(rows) == len(ops) + 14 * sum(c == 23 for c, _, _ in ops) + 2 * len({x for _, _, qs in ops for x in qs})
    names = {x: n for n, x in enumerate(dict.fromkeys(x for _, _, qs in ops for x in qs))}
    want = unitary([(c, p, [names[x] for x in qs]) for c, p, qs in ops], len(names))
    assert same(want, unitary(back_to_ops(rows), len(names)))


def test_decomposition_to_the_base(spark):
    ops = [(23, 1, [0, 1, 2]), (24, 1, [2, 0, 1]), (31, 0, [0, 2]), (16, 0, [1, 2]), (7, 0.25, [0]), (4, 1.5, [1]), (5, 0.5, [2]), (6, 0.75, [0]), (18, 1, [0, 1]), (4, 0.3, [1])]
    rows = decompose.to_base(ops_frame(spark, ops), q.staged).orderBy("op_id", "path").collect()
    assert {r.type for r in rows} <= {8, 9, 18, 27, 28, 29, 30, 4}
    assert [(r.type, round(r.param, 3)) for r in rows if r.type == 4] == [(4, 0.3)]
    x, y = np.array([[0, 1], [1, 0]]), np.array([[0, -1j], [1j, 0]])
    power = lambda m, t: (np.eye(2) + m) / 2 + np.exp(1j * np.pi * t) * (np.eye(2) - m) / 2
    swap = [(18, 1, [0, 2]), (18, 1, [2, 0]), (18, 1, [0, 2])]
    known = {4: np.diag([1, np.exp(1.5j * np.pi)]), 5: power(x, 0.5), 6: power(y, 0.75)}
    got = unitary([(r.type, r.param, list(r.qubits)) for r in rows if r.type != 4], 3)
    want = np.eye(8, dtype=complex)
    for c, p, qs in ops[:-1]:
        if c == 31:
            u = unitary(swap, 3)
        elif c == 16:
            u = unitary([(8, 1, [2]), (18, 1, [1, 2]), (8, 1, [2])], 3)
        elif c in known:
            u = np.tensordot(known[c], np.eye(8).reshape(2, 2, 2, 8), axes=(1, qs[0]))
            u = np.moveaxis(u, 0, qs[0]).reshape(8, 8)
        else:
            u = unitary([(c, p, qs)], 3)
        want = u @ want
    assert same(want, got)


def test_rewritten_circuits_keep_the_unitary(spark):
    ops = random_ops(9, n=30)
    frame = ops_frame(spark, ops)
    before = unitary(ops, 3)
    for rewrite, left in ((rewrites.without_pairs, 8), (rewrites.without_brackets, None), (rewrites.with_pairs_fused, None)):
        rows = rewrite(frame).orderBy("op_id").collect()
        assert len(rows) < len(ops) and same(before, unitary([(r.type, r.param, list(r.qubits)) for r in rows], 3))
    # the wires' orders after commutation, applied to the rotations alone
    assert rewrites.without_brackets(frame).where("type in (29, 30)").count() == rewrites.cancel_ordered(frame).agg(F.sum(F.col("left_first") + F.col("left_second"))).first()[0]


def test_series_of_statistics(spark):
    table = q.staged(linked(ops_frame(spark, random_ops(2, n=8))))
    rows = engine.series(table, engine.STANDARD_RULES, q.staged).orderBy("step").collect()
    assert rows[0].rewrites == 0 and [r.step for r in rows] == list(range(len(rows))) and all(a.total_count >= b.total_count for a, b in zip(rows, rows[1:]))
    last = [r for r in rows if r["pass"] == rows[-1]["pass"]]
    assert not any(r.rewrites for r in last) and len(last) == len(engine.STANDARD_RULES)


def test_stream_builds_the_same_table(spark, tmp_path):
    from wireflow.streaming.builder import GATES, run_builder

    r = random.Random(5)
    ops = random_ops(6, qubits=7, n=40) + [(23, 1, r.sample(range(9), 3)) for _ in range(10)]
    frame = ops_frame(spark, ops)
    for i, at in enumerate(range(0, len(ops), 30)):  # files in order of time: a micro-batch each
        frame.where((F.col("op_id") >= at) & (F.col("op_id") < at + 30)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    columns = [c.split(" ")[0] for c in GATES.split(", ")]
    got = sorted(map(repr, run_builder(stream).select(*columns).collect()))
    assert got == sorted(map(repr, linked(frame).select(*columns).collect()))


def test_late_operations_are_refused(spark, tmp_path):
    from wireflow.streaming.builder import Builder

    builder = Builder(spark, str(tmp_path))
    builder.step(ops_frame(spark, [(8, 1, [0]), (8, 1, [1])]), 0)
    with pytest.raises(ValueError, match="came after"):
        builder.step(ops_frame(spark, [(8, 1, [0])]), 1)
