"""Generators, text circuits and files."""

from wireflow import queries as q
from wireflow.operators import decompose, edges, gates, layers
from wireflow.plans.build import linked
from wireflow.sources import adder_text, files, generators


def listed(ops):
    return [(r.type, r.param, list(r.qubits)) for r in ops.orderBy("op_id").collect()]


def test_generators(spark):
    numbers = lambda n: spark.range(n).withColumnRenamed("id", "i")
    a = listed(generators.random_templates(numbers(80), 6, seed=3))
    assert a == listed(generators.random_templates(numbers(80).repartition(3), 6, seed=3)) and a != listed(generators.random_templates(numbers(80), 6, seed=4))
    assert any(c == 23 for c, _, _ in a) and not any(c == 23 for c, _, _ in listed(generators.random_templates(numbers(80), 2)))
    assert all(len(set(x)) == len(x) and all(0 <= y < 6 for y in x) for _, _, x in a)
    plain, turned = listed(generators.random_cx(numbers(40), 5)), listed(generators.random_cx(numbers(40), 5, turned_pct=100))
    assert len(plain) == 40 and [x for _, _, x in plain] == [x[::-1] for c, _, x in turned if c == 18] and len(turned) == 200
    phased = listed(generators.random_cx(numbers(40), 5, turned_pct=100, phased=True))
    assert [c for c, _, _ in phased[:9]] == [27, 27, 8, 8, 18, 8, 8, 27, 27] and len(phased) == 360
    bv = listed(generators.bernstein_vazirani(spark.createDataFrame([(5, True), (7, False), (9, True)], "i long, one boolean")))
    assert bv == [(8, 1.0, [0]), (8, 1.0, [1]), (8, 1.0, [2]), (9, 0.0, [3]), (8, 1.0, [3]), (18, 1.0, [0, 3]), (18, 1.0, [2, 3]), (8, 1.0, [0]), (8, 1.0, [1]), (8, 1.0, [2])]


def test_text_lines_are_numbered_alike_however_they_are_read(spark, tmp_path):
    """One file, forty files, and splits of 64 bytes: the same numbers, operations and linked table; an empty folder's file has none."""
    lines = [f'QGate["not"]({i % 5}) with controls=[{["", "+7", "-8", "+7, -9"][i % 4]}] with nocontrol' if i % 6 else f"Inputs: {i}" for i in range(120)]
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir(), many.mkdir()
    (one / "a.txt").write_text("\n".join(lines) + "\n")
    for f in range(40):
        (many / f"{f:03}.txt").write_text("\n".join(lines[3 * f:3 * f + 3]) + "\n")
    found = []
    for path, split in ((one, None), (many, None), (one, "64"), (many, "64")):
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            read = q.staged(adder_text.read(spark, str(path)))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.line, r.value) for r in read.orderBy("line").collect()] == list(enumerate(lines))
        found.append(sorted(map(repr, linked(q.staged(adder_text.operations(read)), q.staged).collect())))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 300
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("")
    assert adder_text.operations(adder_text.read(spark, str(tmp_path / "none"))).isEmpty()


def test_text_circuit(spark, tmp_path):
    (tmp_path / "a.txt").write_text('Inputs: 0:Qbit\nQGate["not"](5) with controls=[+7]\nQInit0(16) with nocontrol\nQGate["not"](16) with controls=[+7, -15] with nocontrol\nQGate["not"](2)\n')
    rows = decompose.lowered_controls(adder_text.parse(adder_text.read(spark, str(tmp_path)))).orderBy("line", "sub").collect()
    assert [(r.type, list(r.qubits)) for r in rows] == [(18, [7, 5]), (9, [15]), (23, [7, 15, 16]), (9, [15]), (9, [2])]


def test_files(spark, tmp_path):
    ops = generators.random_templates(spark.range(20).withColumnRenamed("id", "i"), 2)
    table = q.staged(linked(ops))
    files.write_gates(table, f"{tmp_path}/gates")
    back = files.read_gates(spark, f"{tmp_path}/gates")
    assert back.count() == table.count() and gates.dangling(back).count() == 0
    assert listed(files.from_qasm(files.to_qasm(ops))) == listed(ops)
    files.write_graph(table.selectExpr("id as node", "id as widget", "'H' as readable", "param"), edges.edge_list(table), f"{tmp_path}/graph")
    drawn = {r.id for r in spark.read.json(f"{tmp_path}/graph/nodes").collect()}
    arcs = spark.read.json(f"{tmp_path}/graph/links").collect()
    assert len(arcs) == edges.edge_list(table).where("source >= 0 and target >= 0").count() and {x for r in arcs for x in (r.source, r.target)} == drawn
    placed = layers.layer_rows(layers.layered(ops, q.staged))
    files.write_layers(placed, f"{tmp_path}/layers")
    assert sorted(map(repr, files.read_layers(spark, f"{tmp_path}/layers").collect())) == sorted(map(repr, placed.collect()))
    for n in (1, 2):
        files.append_stats(gates.stats(table).selectExpr(f"{n} as id", "*"), f"{tmp_path}/log")
    assert spark.read.option("header", True).csv(f"{tmp_path}/log").count() == 2
    files.write_stats(gates.stats(table).selectExpr("1 as id", "*"), f"{tmp_path}/stats")
    assert spark.read.option("header", True).csv(f"{tmp_path}/stats").first()["h_count"] is not None
