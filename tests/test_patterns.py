"""Rules given as rows against the built ones; decomposition by a relation."""

import pytest
from pyspark.sql import functions as F
from test_engine import back_to_ops, ops_frame, random_ops, same, unitary

from wireflow import queries as q
from wireflow.operators import decompose, engine, gates, patterns
from wireflow.plans.build import linked


def told(rule, table):
    """What a rule says of its matches, in a form that does not depend on the order of gates."""
    return sorted((sorted(r.core), sorted(r.boundary), sorted(map(tuple, r.edits)), sorted(r.deletes), tuple(r.retype) if r.retype else None) for r in rule.match(table).collect())


def test_rules_as_rows_are_the_built_rules(spark):
    built = {r.name: r for r in (*engine.STANDARD_RULES, engine.commute(29, 0.0))}
    table = q.staged(linked(ops_frame(spark, random_ops(11, qubits=4, n=60) + [(27, 0, [0]), (28, 0, [0]), (27, 0, [0])])))
    rules = patterns.compiled(*patterns.standard_rows(spark), patterns.type_counts(table))
    assert {r.name for r in rules} == set(built)
    found = {r.name: told(r, table) for r in rules}
    assert found == {n: told(r, table) for n, r in built.items()}
    assert sum(map(bool, found.values())) == len(built)


def test_a_user_rule(spark):
    """X X vanishes: a rule that the library has not, given as rows, keeps the unitary; a pattern in pieces is refused."""
    ops = [(9, 0, [0]), (9, 0, [0]), (18, 1, [0, 1]), (9, 0, [1]), (9, 0, [1]), (9, 0, [1]), (8, 1, [0])]
    table = q.staged(linked(ops_frame(spark, ops)))
    rule = next(r for r in patterns.compiled(*patterns.standard_rows(spark, patterns.cancel_rows(9, 9, 0.0, 0.0)), patterns.type_counts(table)) if r.name == "cancel 9 9")
    left, n = engine.to_fixpoint(table, rule, q.staged)
    assert n == 2 and gates.dangling(left).count() == 0
    assert same(unitary(ops, 2), unitary(back_to_ops(left.collect()), 2))
    with pytest.raises(ValueError, match="not linked"):
        patterns.Pattern("x", *[[dict(zip([c.split(" ")[0] for c in s.split(", ")], r, strict=True)) for r in rows] for s, rows in zip((patterns.GATES, patterns.LINKS, patterns.FATES, patterns.EDITS), ([("x", "g", [8], None), ("x", "h", [9], None)], [], [], []), strict=True)]).order({})


def test_order_begins_with_the_rarest_gate():
    rows = patterns.reverse_rows()
    named = [[dict(zip([c.split(" ")[0] for c in s.split(", ")], r, strict=True)) for r in x] for s, x in zip((patterns.GATES, patterns.LINKS, patterns.FATES, patterns.EDITS), rows, strict=True)]
    assert patterns.Pattern("reverse cx", *named).order({8: 100, 18: 3})[0][0] == "cx"
    assert patterns.Pattern("reverse cx", *named).order({8: 2, 18: 300})[0][0] == "l1"


def test_engine_in_time_and_versions(spark):
    table = q.staged(linked(ops_frame(spark, [(8, 1, [0])] * 21)))
    assert engine.to_fixpoint(table, engine.STANDARD_RULES[0], q.staged, seconds=0.0)[1] == 0
    assert 0 < engine.to_fixpoint(table, engine.STANDARD_RULES[0], q.staged, rounds=1)[1] < 10
    own = engine.Versions(table, q.staged)
    before, engine.Versions.FEW = engine.Versions.FEW, 0
    try:
        assert engine._fix(own, engine.STANDARD_RULES[0], None, None, None) == (10, True) and own.version > 1
        assert own.table().count() == 3 and gates.dangling(own.table()).count() == 0
        assert {r.id for r in own.table().collect()} - {r.id for r in own.since(0).collect()} == set()
    finally:
        engine.Versions.FEW = before


def case(spark, ops, rules, want):
    left = engine.optimise(q.staged(linked(ops_frame(spark, ops))), rules, q.staged)
    got = [(c, list(qs)) for c, _, qs in back_to_ops(left.collect())]
    assert got == want


def test_commute_and_cancel_cases(spark):
    """T, CX, its inverse and CX again come to nothing; a T goes behind the control; many of both on one wire."""
    rules = (engine.commute(29, 0.0), engine.commute(30, 0.0), *engine.STANDARD_RULES[1:3], engine.cancel_two(18, 1.0))
    case(spark, [(29, 0, [0]), (18, 1, [0, 1]), (30, 0, [0]), (18, 1, [0, 1])], rules, [])
    case(spark, [(29, 0, [0]), (18, 1, [0, 1])], rules[:1], [(18, [0, 1]), (29, [0])])
    ops = [(29, 0, [0])] * 5 + [(18, 1, [0, 1 + i % 2]) for i in range(4)] + [(30, 0, [0])] * 5
    case(spark, ops, rules[:4], [(18, [0, 1 + i % 2]) for i in range(4)])


def test_decomposition_by_a_relation(spark):
    ops = [(22, 0, [0, 1, 2]), (24, 0, [2, 0, 1]), (31, 0, [0, 2]), (8, 1, [1])]
    rules = decompose.relation(spark, q._AND, q._AND_CODES)
    frame = ops_frame(spark, ops)
    at = lambda **how: [(r.type, r.param, list(r.qubits)) for r in decompose.decomposed(frame, rules, q.staged, **how).orderBy("op_id", "path").collect()]
    assert [c for c, *_ in at(depth=0)] == [22, 24, 31, 8] and [c for c, *_ in at(depth=1)][:3] == [8, 23, 8]
    whole, kept = at(), at(keep=(23,))
    assert {c for c, *_ in whole} == {8, 18, 29, 30} and sum(c == 23 for c, *_ in kept) == 2
    assert same(unitary(whole, 3), unitary(kept, 3))
    circle = spark.createDataFrame([(22, 0, 22, 0.0, [0, 1, 2])], decompose.RELATION)
    with pytest.raises(ValueError, match="composite"):
        decompose.decomposed(frame, circle, q.staged, most=3)
    windows = decompose.windowed(decompose.decomposed(frame, rules, q.staged), 10).orderBy("place").collect()
    assert [r.window for r in windows] == [i // 10 for i in range(len(windows))] and [(r.type, r.param, list(r.qubits)) for r in windows] == whole
