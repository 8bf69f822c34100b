"""Ancillas used again, circuits in compact form, modular adders, statistics of a stream, validation."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wireflow import queries as q
from wireflow.operators import ancillas, gates, grammar, layers
from wireflow.sources import modular

LIFE = "id long, first long, last long"


def most_live(rows):
    return max((sum(f <= t <= e for _, f, e in rows) for _, t, _ in rows), default=0)


@pytest.mark.parametrize("seed,n,span,length", [(1, 200, 150, 20), (3, 80, 40, 400), (5, 150, 10**6, 50_000)])
def test_slots_are_as_few_as_lifetimes_that_overlap(spark, seed, n, span, length):
    r = random.Random(seed)
    rows = [(i, s := r.randrange(span), s + r.randrange(length)) for i in r.sample(range(10 * n), n)]
    found = q.staged(ancillas.slots(spark.createDataFrame(rows, LIFE), q.staged, chunk=16))
    got = {x.id: x for x in found.collect()}
    assert {(x["id"], x["first"], x["last"]) for x in got.values()} == set(rows)
    assert {x.slot for x in got.values()} == set(range(most_live(rows)))
    for a, b in itertools.combinations(rows, 2):
        assert got[a[0]].slot != got[b[0]].slot or a[2] < b[1] or b[2] < a[1]
    assert ancillas.overlaps(found, 16).isEmpty()


def test_slots_of_odd_tables(spark):
    assert ancillas.slots(spark.createDataFrame([], LIFE), q.staged).isEmpty()
    chain = [(i, 2 * i, 2 * i + 1) for i in range(500)]  # one qubit is handed on 499 times
    assert [x.slot for x in ancillas.slots(spark.createDataFrame(chain, LIFE).withColumn("slot", F.lit("x")), q.staged, 64).select("slot").distinct().collect()] == [0]
    touching = [(1, 0, 5), (2, 5, 9), (3, 6, 9)]  # freed at 5 is not yet free at 5
    assert {x.id: x.slot for x in ancillas.slots(spark.createDataFrame(touching, LIFE), q.staged).collect()} == {1: 0, 2: 1, 3: 0}
    for bad in ([(1, 3, 2)], [(1, None, 2)], [(1, 0, 2), (1, 3, 4)], [(None, 0, 1)]):
        with pytest.raises(ValueError):
            ancillas.slots(spark.createDataFrame(bad, LIFE), q.staged)


def test_operations_use_ancillas_again(spark):
    ops = spark.createDataFrame([(0, [0, 1, 10]), (1, [0, 2, 11]), (2, [0, 1, 10]), (3, [1, 2, 12]), (4, [12, 11]), (5, [3])], "op_id long, qubits array<bigint>")
    got = {x.op_id: x.qubits for x in ancillas.reused(ops, 10, q.staged).collect()}
    assert got == {0: [0, 1, 10], 1: [0, 2, 11], 2: [0, 1, 10], 3: [1, 2, 10], 4: [10, 11], 5: [3]}


def unrolled(rules, block, ports, param):
    """The gates of a block one by one."""
    for _, at, child, kind, times, inner, scale, shift in sorted(r for r in rules if r[0] == block):
        for _ in range(times):
            to, p = [ports[i] for i in inner], scale * param + shift
            if child is None:
                yield kind, p, to
            else:
                yield from unrolled(rules, child, to, p)


def random_grammar(seed):
    r, rules = random.Random(seed), []
    for b in range(7):
        for at in range(r.randrange(1, 5)):
            child = f"b{r.randrange(b)}" if b and r.random() < 0.7 else None
            rules.append((f"b{b}", at * 3, child, None if child else r.choice((8, 29, 30, 18)), r.choice((0, 1, 1, 2, 3)), r.sample(range(4), 4 if child else 2), r.choice((1.0, 0.5)), r.choice((0.0, 0.25))))
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_compact_counts_and_ranges_are_those_of_the_expansion(spark, seed):
    rules = random_grammar(seed)
    table = spark.createDataFrame(rules, grammar.GRAMMAR)
    every = {f"b{b}": list(unrolled(rules, f"b{b}", list(range(4)), 0.0)) for b in range(7)}
    counts = {(x.block, x.type): int(x.n) for x in grammar.totals(table, q.staged).collect()}
    assert counts == {(b, k): n for b, g in every.items() for k in (8, 18, 29, 30) if (n := sum(x[0] == k for x in g))}
    on = {}
    for x in grammar.touched(table, q.staged).collect():
        on.setdefault(x.block, set()).add(x.qubit)
    assert on == {b: s for b, g in every.items() if (s := {i for x in g for i in x[2]})}
    whole = every["b6"]
    for first, last in ((0, len(whole)), (len(whole) // 3, len(whole) // 2 + 1), (len(whole) - 1, len(whole) + 5), (2, 2)):
        rows = sorted(grammar.expanded(table, "b6", first, last, q.staged).collect())
        assert [(int(x.place), x.type, x.param, x.qubits) for x in rows] == [(i, *whole[i]) for i in range(first, min(last, len(whole)))]


def test_more_gates_than_can_be_stored(spark):
    """Six levels of a thousand: 2 * 10^18 gates; a range in the middle; errors of grammars."""
    rules = [("b0", 0, None, 8, 1, [0], 0.0, 1.0), ("b0", 1, None, 29, 1, [1], 0.0, 0.0)]
    rules += [(f"b{i}", 0, f"b{i - 1}", None, 1000, [1, 0], 1.0, 0.0) for i in range(1, 7)]
    table = spark.createDataFrame(rules, grammar.GRAMMAR)
    assert {x.type: int(x.n) for x in grammar.totals(table, q.staged).where("block = 'b6'").collect()} == {8: 10**18, 29: 10**18}
    middle = 10**18 + 1
    rows = sorted(grammar.expanded(table, "b6", middle, middle + 4, q.staged).collect())
    assert [(int(x.place), x.type, x.qubits) for x in rows] == [(middle, 29, [1]), (middle + 1, 8, [0]), (middle + 2, 29, [1]), (middle + 3, 8, [0])]
    with pytest.raises(grammar.NoSuchBlock):
        grammar.totals(spark.createDataFrame([*rules, ("b7", 0, "c", None, 1, [0], 1.0, 0.0)], grammar.GRAMMAR), q.staged)
    with pytest.raises(grammar.CircularBlocks):
        grammar.totals(spark.createDataFrame([*rules, ("b0", 2, "b3", None, 1, [0, 1], 1.0, 0.0)], grammar.GRAMMAR), q.staged)
    assert grammar.totals(spark.createDataFrame([], grammar.GRAMMAR), q.staged).isEmpty()


def test_modular_adder_for_all_inputs(spark):
    """Three and four bits, every modulus, value and register, with no, one, two and three controls: the sum, and all other qubits as before."""
    rows = [(n, v, m, c) for n in (2, 3) for m in range(1, 2 ** (n - 1) + 1) for v in range(-m, m + 1) for c in ([], None, [True], [False], [True, False], [True, True, False])]
    rows += [(4, 5, 7, []), (4, -3, 8, [True])]
    adders = modular.modular_adders(spark.createDataFrame(rows, "bits int, value long, modulus long, controls array<boolean>"))
    for r in adders.collect():
        m = len(r.controls or [])
        for b, bits in itertools.product(range(r.modulus), itertools.product((0, 1), repeat=m)):
            state = [0] * r.n_qubits
            state[:m] = bits
            state[m:m + r.bits] = map(int, format(b, f"0{r.bits}b"))
            want = list(state)
            if list(map(bool, bits)) == (r.controls or []):
                want[m:m + r.bits] = map(int, format((b + r.value) % r.modulus, f"0{r.bits}b"))
            for g in r.gates:
                if all(state[i] for i in g.qubits[:-1]):
                    state[g.qubits[-1]] ^= 1
                if g.type == 22 and g.param < 0:
                    assert state[g.qubits[-1]] == 0  # an And is undone only where its target holds it
            assert state == want


def test_modular_adder_of_odd_rows(spark):
    make = lambda *r: modular.modular_adders(spark.createDataFrame([r], "bits int, value long, modulus long, controls array<boolean>"))
    wide = make(64, 5, 2**62 + 1, None).first()
    assert len(wide.gates) == 5 * (8 * 64 - 11) + 4 * bin(2**62 + 1).count("1") + 2 * 2 + 4
    assert make(None, 1, 2, None).first().gates is None
    for bad in ((1, 0, 1, None), (65, 0, 1, None), (3, 0, 5, None), (3, 0, 0, None)):
        with pytest.raises(Exception, match="no modular adder"):
            make(*bad).collect()


def test_series_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Five files, one a batch, with late rows; stopped after two files and gone on with; a null time counts nowhere."""
    from wireflow.streaming import live

    schema = "type short, param float, at timestamp_ntz"
    rows = spark.range(200).select(F.element_at(F.array(*[F.lit(c) for c in (8, 29, 30, 14, 18)]), (F.col("id") % 5 + 1).cast("int")).cast("short").alias("type"), F.lit(1.0).cast("float").alias("param"),
                                   F.when(F.col("id") != 7, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id * 37 % 90 as int))")).alias("at"), "id")
    whole = q.staged(rows)
    want = sorted(map(tuple, live.counted(whole, "at", "1 day").where("step is not null").collect()))
    for f in range(5):
        whole.where(F.col("id") % 5 == f).select("type", "param", "at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if f in (1, 4):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            got = live.run_series(stream, "at", "1 day", f"{tmp_path}/run")
            if f == 1:
                assert got.agg(F.sum("n_gates")).first()[0] == 80
    assert sorted(map(tuple, got.collect())) == want and sum(x[1] for x in want) == 199
    ratio = sorted(map(tuple, live.normalised(got).collect()))
    assert ratio == [(x[0], *[0.0 if b == 0 else a / b for a, b in zip(x[1:], want[0][1:])]) for x in want]


def test_layer_rows_are_validated(spark):
    make = lambda *rows: layers.moments_of_rows(spark.createDataFrame(rows, "id long, control_q long, target_q long, type long, param double, layer long").withColumn("op_id", F.lit("x")))
    got = make((1, 0, 1, 18, 1.0, 1), (2, 2, None, 8, 1.0, 1), (3, None, None, 12, 0.0, 1), (4, 0, None, 29, 0.0, 2)).orderBy("layer").collect()
    assert [(r.layer, [(o.op_id, o.type, o.qubits) for o in r.ops]) for r in got] == [(1, [(1, 18, [0, 1]), (2, 8, [2])]), (2, [(4, 29, [0])])]
    for bad, text in (((1, None, 1, 18, 1.0, 1), "without a control: gate 1"), ((1, 0, None, 77, 1.0, 1), "no such type: gate 1"), ((1, 0, None, None, 1.0, 1), "no such type"), ((1, 0, None, 8, 1.0, None), "no layer")):
        with pytest.raises(Exception, match=text):
            make(bad).collect()
    with pytest.raises(Exception, match="share a qubit in layer 3"):
        make((1, 0, 1, 18, 1.0, 3), (2, 1, None, 8, 1.0, 3)).collect()


def test_gate_sets(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") % 3 == 0, 8).when(F.col("id") != 49, 29).cast("short").alias("type"))
    assert gates.require(rows.where("id < 49"), (8, 29)).count() == 49
    with pytest.raises(gates.OutsideGateSet) as e:
        gates.require(rows, (29,))
    assert e.value.first == [(i, 8) for i in range(0, 30, 3)]
    with pytest.raises(gates.OutsideGateSet) as e:
        gates.require(rows, (8, 29))
    assert e.value.first == [(49, None)]


def test_kinds_are_counted_as_in_the_circuits(spark):
    """Sums counted once for a shape and the rest by adder: the same numbers as in the gates, for every number of controls; unknown adders have none."""
    rows = [(bits, bits * 7919 - 30000, 1 + bits * 31 % (1 << (bits - 1)), [i % 2 == 0 for i in range(m)] if m else None) for bits in (2, 3, 9, 64) for m in range(4)] + [(5, None, 3, None)]
    frame = spark.createDataFrame(rows, "bits int, value long, modulus long, controls array<boolean>")
    kinds = {"x": lambda g: g["type"] == 9, "cx": lambda g: g["type"] == 18, "made": lambda g: (g["type"] == modular.AND) & (g["param"] > 0)}
    whole = modular.modular_adders(frame).select("bits", F.coalesce(F.size("controls"), F.lit(0)).alias("m"), "n_qubits", *[F.when(F.col("gates").isNotNull(), F.size(F.filter("gates", of))).cast("bigint").alias(k) for k, of in kinds.items()])
    found = modular.counted(frame, kinds).select("bits", F.coalesce(F.size("controls"), F.lit(0)).alias("m"), "n_qubits", *kinds)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))
