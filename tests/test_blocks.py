"""Rules by blocks of ids: one history of the whole table, wherever the cuts are, or none."""

import random

import pytest
from pyspark.sql import functions as F
from test_engine import back_to_ops, ops_frame, random_ops, same, unitary

from wireflow import queries as q
from wireflow.functions.codec import link_id
from wireflow.operators import blocks, engine, gates
from wireflow.plans.build import linked


def many(seed, n=4000, qubits=3):
    r = random.Random(seed)
    one = [(8, 1), (8, 1), (29, 0), (29, 0), (30, 0), (27, 0), (28, 0)]
    return [(*r.choice(one), [r.randrange(qubits)]) if r.random() < 0.6 else (18, 1, r.sample(range(qubits), 2)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_blocks_are_one_history(spark, monkeypatch, seed):
    """Four blocks without a round: the unitary stays, links are reciprocal, no match is left, counts are those of the table."""
    monkeypatch.setattr(engine, "Versions", None)
    ops, rules = many(seed), engine.STANDARD_RULES
    table = q.staged(linked(ops_frame(spark, ops)))
    found = blocks.by_blocks(table, rules, q.staged, 1000)
    after = q.staged(found.table)
    assert gates.dangling(after).count() == 0 and not any(r.match(after).count() for r in rules)
    assert after.count() == after.select("id").distinct().count()
    names = {x: i for i, x in enumerate(dict.fromkeys(x for _, _, qs in ops for x in qs))}
    assert same(unitary([(c, p, [names[x] for x in qs]) for c, p, qs in ops], 3), unitary(back_to_ops(after.collect()), 3))
    # the first rule's count has one value only: half of each run of H, rounded down
    runs, last = 0, {}
    for c, _, qs in ops:
        for x in qs:
            last[x] = last.get(x, 0) + 1 if c == 8 else 0
            runs += c == 8 and last[x] % 2 == 0
    assert found.rewrites.get(0, 0) == runs
    monkeypatch.setattr(blocks, "WIDTH", 1000)
    steps = engine.series(table, rules, q.staged).orderBy("step").collect()
    assert [r.rewrites for r in steps[1:]] == [found.rewrites.get(s, 0) for s in range(len(steps) - 1)]
    assert not any(r.rewrites for r in steps[-len(rules):]) and (len(steps) - 1) % len(rules) == 0
    assert tuple(steps[-1])[4:] == tuple(gates.stats(after).first()) and tuple(steps[0])[4:] == tuple(gates.stats(table).first())
    for rule in (rules[0], rules[5]):
        assert engine.counts_at_fixpoint(table, rule, q.staged).first() == gates.stats(engine.to_fixpoint(table, rule, q.staged)[0]).first()


def test_blocks_that_do_not_agree_are_refused(spark):
    """A run of H that is longer than any margin is paired off otherwise in the next block: rounds do it."""
    table = q.staged(linked(ops_frame(spark, [(18, 1, [0, 1])] * 2 + [(8, 1, [0])] * 301)))
    rule = engine.STANDARD_RULES[0]
    assert blocks.by_blocks(table, [rule], q.staged, 101) is None
    assert blocks.by_blocks(table, [rule], q.staged, 101, rows=False) is None
    whole = blocks.by_blocks(table, [rule], q.staged)
    assert whole.rewrites == {0: 150} and whole.table.count() == table.count() - 300


def test_ids_without_neighbourhood_go_in_rounds(spark, monkeypatch):
    """Where links lead out of the margins the rounds do the work, and come to the same counts."""
    table = q.staged(linked(ops_frame(spark, random_ops(4, n=120))))
    turn = lambda x: x * 7919 % 10007
    mixed = q.staged(table.select(*[turn(F.col("id")).alias(c) if c == "id" else (turn(link_id(c)) * 1000 + F.col(c) % 1000).alias(c) if c in engine.SIDES else F.col(c) for c in table.columns]))
    rule = engine.STANDARD_RULES[0]
    want = engine.counts_at_fixpoint(table, rule, q.staged).first()
    monkeypatch.setattr(blocks, "WIDTH", 1000)
    assert blocks.by_blocks(mixed, [rule], q.staged) is None
    assert engine.counts_at_fixpoint(mixed, rule, q.staged).first() == want
