"""What grows with the input: batches, blocks and lifetimes are not dealt with one by one."""

from test_engine import ops_frame, random_ops

from wireflow import queries as q
from wireflow.operators import ancillas, decompose, edges, equivalence, gates, grammar, widgets
from wireflow.plans.build import linked


def test_a_task_takes_many_batches(spark):
    """Batches go through a task in one stream, whatever the sizes of the frames it comes in; the outcomes are those of each batch alone."""
    table = q.staged(linked(ops_frame(spark, random_ops(6, qubits=4, n=60))))
    batches = q.staged(edges.edge_batches(edges.edge_list(table), 20))
    rows = widgets.widgets(batches, table, 2, 4)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {tuple(r) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    kind = {r.id: int(r.type in (29, 30)) for r in table.collect()}
    alone = {}
    for r in batches.where("source >= 0 and target >= 0").orderBy("batch", "source", "target").collect():
        alone.setdefault(r.batch, []).append((r.source, r.target, kind[r.source], kind[r.target]))
    assert len(alone) > 3
    assert got == {(b, *n) for b, e in alone.items() for n in widgets.united(e, 2, 4)[0]}
    codes = {r.code: r.n for r in widgets.union_codes(batches, table, 2, 4).collect()}
    assert sum(codes.values()) == sum(map(len, alone.values()))


def test_only_blocks_that_are_reached_are_placed(spark, monkeypatch):
    """A range places the parts of the blocks it opens, not those of all others; levels are found once for several counts."""
    rules = [(f"o{k}", 0, None, 8, 2, [0], 1.0, 0.0) for k in range(40)] + [(f"c{k // 10}", k, f"o{k}", None, 3, [0, 1], 1.0, 0.0) for k in range(40)]
    rules += [("root", i, f"c{i}", None, 1, [0, 1], 1.0, 0.0) for i in range(4)]
    table = q.staged(spark.createDataFrame(rules, grammar.GRAMMAR))
    placed, real = [], grammar.running_sum
    monkeypatch.setattr(grammar, "running_sum", lambda df, *a, **k: placed.append(df.count()) or real(df, *a, **k))
    rows = sorted(grammar.expanded(table, "root", 61, 64, q.staged).collect())
    assert [(int(r.place), r.type, r.qubits) for r in rows] == [(i, 8, [0]) for i in (61, 62, 63)]
    assert placed == [4, 10, 1]
    once = grammar.Placed(table, q.staged)
    assert {r.block: int(r.n) for r in grammar.totals(once, q.staged).where("block not like 'o%'").collect()} == {"root": 240} | {f"c{i}": 60 for i in range(4)}
    assert grammar.touched(once, q.staged).count() == 45


def test_a_circuit_is_reduced_once(spark, sf, monkeypatch):
    """The check of a copy and of a mutant reduces the circuit and the mutant, each once and from a written table."""
    seen, real = [], equivalence.cancel_two_qubit
    monkeypatch.setattr(equivalence, "cancel_two_qubit", lambda ops, **k: seen.append(hasattr(ops, "staged_at")) or real(ops, **k))
    assert {r.other: r.equivalent for r in q.QUERIES["equiv_check"](spark, sf).collect()}["copy"]
    assert seen == [True, True]


def test_links_of_replaced_gates_meet_once(spark):
    """Rows of a linked table are joined once, not for each of their six links."""
    table = q.staged(linked(ops_frame(spark, [(23, 1, [0, 1, 2]), (23, 1, [2, 0, 3]), (8, 1, [3]), (23, 1, [3, 1, 0])])))
    after = decompose.toffolis_in_place(table, q.staged)
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    assert gates.dangling(q.staged(after)).count() == 0 and after.count() == table.count() + 3 * 14


def test_operations_with_one_reused_qubit_are_joined_once(spark):
    """Operations with none, one and several qubits that are used again; only the last kind is put together by groups."""
    rows = [(i, 9, 0, qs) for i, qs in enumerate(([0, 10], [10, 1], [0, 1], [11, 0, 10], [12, 13], [13, 12, 0], [1, 14]))]
    ops = q.staged(spark.createDataFrame(rows, "op_id long, type short, tag long, qubits array<long>"))
    got = {r.op_id: r.qubits for r in ancillas.reused(ops, 10, q.staged).collect()}
    assert sorted(got) == list(range(7)) and len({x for v in got.values() for x in v if x >= 10}) == 2
    assert all(len(set(v)) == len(v) == len(rows[i][3]) for i, v in got.items())
