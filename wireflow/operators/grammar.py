"""Circuits in compact form: blocks of gates and of other blocks, each repeated so many times.

A grammar is a table with a row for every part of a block. Blocks form a graph without circles, which
may stand for far more gates than could ever be stored: what a block holds is found by
multiplying along the graph, once for each block however often it occurs, and a range of the
gates is expanded without what lies before or behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.plans.running import running_sum
from wireflow.plans.staging import unstage

#: ``at`` orders the parts of a block. A part is a gate (type) or a block (child), ``times`` times in a row (0: not at all); its i-th
#: qubit is the block's qubit ``ports[i]``. Its parameter is ``scale`` times the block's, and ``shift``.
GRAMMAR = "block string, at long, child string, type short, times long, ports array<bigint>, scale double, shift double"
#: Counts are whole numbers of so many digits; what goes beyond them is an error in Spark's ANSI mode.
COUNT = "decimal(38,0)"
Staged = Callable[[DataFrame], DataFrame]


class NoSuchBlock(ValueError):
    """A part names a block that has no parts."""


class CircularBlocks(ValueError):
    """Blocks hold each other in a circle."""


def _children(rules: DataFrame, staged: Staged) -> DataFrame:
    """(block, child, inner) of the parts that are blocks, once each; ``inner``: the child holds blocks itself. A child without parts is an error."""
    held = rules.groupBy(F.col("block").alias("child")).agg((F.count("child") > 0).alias("inner"))
    links = staged(rules.where("child is not null").select("block", "child").distinct().join(held, "child", "left").select("block", "child", "inner"))
    lost = links.where("inner is null").first()
    if lost:
        raise NoSuchBlock(f"block {lost['block']} holds {lost['child']}, which has no parts")
    return links


def _outer_levels(links: DataFrame, staged: Staged) -> DataFrame:
    """(block, level) of the blocks that hold blocks, from 1; only the links among these are followed, a round for each level."""
    among = staged(links.where("inner").select("block", "child"))
    waiting, found, level = staged(links.select("block").distinct()), [], 1
    while not waiting.isEmpty():
        held = among.join(waiting.select(F.col("block").alias("child")), "child", "left_semi").select("block").distinct()
        marked = staged(waiting.join(held.withColumn("waits", F.lit(True)), "block", "left"))
        ready, rest = marked.where("waits is null").select("block", F.lit(level).alias("level")), marked.where("waits").select("block")
        if ready.isEmpty():
            raise CircularBlocks(f"blocks hold each other in a circle, among them {rest.first()['block']}")
        found.append(ready)
        waiting, level = rest, level + 1
    out = staged(_together(found) if found else waiting.withColumn("level", F.lit(0)))
    unstage(among)
    return out


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def levels(rules: DataFrame, staged: Staged) -> DataFrame:
    """(block, level): 0 for blocks of gates alone, else one more than the highest block within; a round for each level.

    A part that names a block without parts is an error, and so are blocks that hold each other."""
    outer = _outer_levels(_children(rules, staged), staged)
    return rules.groupBy("block").agg(F.count("child").alias("n")).where("n = 0").select("block", F.lit(0).alias("level")).unionByName(outer)


class Placed:
    """The parts of a grammar by level, found once for all that is counted upwards: the gates of each block, and the blocks that hold blocks with the levels of these."""

    def __init__(self, rules: DataFrame, staged: Staged):
        self.staged = staged
        self.gates = rules.where("child is null")
        self.outer = _outer_levels(_children(rules, staged), staged)
        inner = self.outer.select(F.col("block").alias("child"), F.col("level").alias("of"))
        self.parts = staged(rules.where("child is not null").join(self.outer, "block").join(inner, "child", "left").withColumn("of", F.coalesce("of", F.lit(0))))
        self.top = self.outer.agg(F.max("level")).first()[0] or 0

    def upwards(self, of_gates: Callable, of_blocks: Callable, together: Callable) -> DataFrame:
        """What all blocks hold, level by level: each part is met once, with what its block was found to hold."""
        own = self.staged(together(of_gates(self.gates)).join(self.outer, "block", "left"))
        found = {0: own.where("level is null").drop("level")}
        for i in range(1, self.top + 1):
            parts = self.parts.where(F.col("level") == i)
            below = _together([found[r["of"]] for r in parts.select("of").distinct().collect()])
            held = parts.join(below.select(F.col("block").alias("child"), F.struct(*[c for c in below.columns if c != "block"]).alias("in")), "child")
            found[i] = self.staged(together(own.where(F.col("level") == i).drop("level").unionByName(of_blocks(held))))
        return _together(list(found.values()))


def _placed(rules: DataFrame | Placed, staged: Staged) -> Placed:
    return rules if isinstance(rules, Placed) else Placed(rules, staged)


def totals(rules: DataFrame | Placed, staged: Staged) -> DataFrame:
    """(block, type, n): how many gates of a type each block stands for; types that do not occur have no row."""
    return _placed(rules, staged).upwards(lambda gates: gates.select("block", "type", F.col("times").cast(COUNT).alias("n")),
                    lambda held: held.select("block", "in.type", (F.col("times").cast("decimal(19,0)") * F.col("in.n")).cast(COUNT).alias("n")),
                    lambda rows: rows.where("n > 0").groupBy("block", "type").agg(F.sum("n").cast(COUNT).alias("n")))


def touched(rules: DataFrame | Placed, staged: Staged) -> DataFrame:
    """(block, qubit): the qubits that gates of a block are on, as the block numbers them."""
    return _placed(rules, staged).upwards(lambda gates: gates.where("times > 0").select("block", F.explode("ports").alias("qubit")),
                    lambda held: held.where("times > 0").select("block", F.element_at("ports", (F.col("in.qubit") + 1).cast("int")).alias("qubit")), lambda rows: rows.distinct())


def sizes(rules: DataFrame, staged: Staged) -> DataFrame:
    """(child, held): the gates that each block stands for."""
    return totals(rules, staged).groupBy(F.col("block").alias("child")).agg(F.sum("n").cast(COUNT).alias("held"))


def sized(rules: DataFrame, held: DataFrame) -> DataFrame:
    """The parts of ``rules`` with their places: ``size`` of one of a part, ``start`` within its block."""
    parts = rules.join(held, "child", "left").withColumn("size", F.when(F.col("child").isNull(), F.lit(1)).otherwise(F.coalesce("held", F.lit(0))).cast(COUNT)).drop("held")
    whole = (F.col("times").cast("decimal(19,0)") * F.col("size")).cast(COUNT)
    return running_sum(parts, ["block"], "at", whole, "upto").withColumn("start", (F.col("upto") - whole).cast(COUNT)).drop("upto")


def expanded(rules: DataFrame, root: str, first: int, last: int, staged: Staged, param: float = 0.0) -> DataFrame:
    """(place, type, param, qubits): the gates at places from ``first`` to before ``last`` of what a block stands for.

    Each round opens the blocks that were reached, and only their parts are placed; of a part's repetitions only those that
    meet the range are made, so the rows of a round are no more than the gates of the range."""
    held = staged(sizes(rules, staged))
    rules = rules.select("block", "at", "child", "type", "times", F.col("ports").alias("inner"), "scale", "shift")
    low, high = F.lit(first).cast(COUNT), F.lit(max(first, last)).cast(COUNT)
    now = staged(rules.where(F.col("block") == root).join(held, "child", "left").where("times > 0 and (child is null or held > 0)").agg(F.max(F.array_max("inner")).alias("top")).where("top is not null").select(
        F.lit(root).alias("block"), F.lit(0).cast(COUNT).alias("base"), F.sequence(F.lit(0).cast("bigint"), "top").alias("ports"), F.lit(param).cast("double").alias("param")))
    done = None
    while True:
        own = staged(rules.join(staged(now.select("block").distinct()), "block", "left_semi"))
        parts = sized(own, held).where("times > 0 and size > 0")
        begin = F.col("base") + F.col("start")
        met = now.join(parts, "block").withColumn("begin", begin.cast(COUNT)).where(F.lit(first < last) & (F.col("begin") < high) & ((F.col("begin") + F.col("times").cast("decimal(19,0)") * F.col("size")) > low))
        turn = lambda ahead: F.call_function("div", ahead, F.col("size"))
        turns = F.sequence(turn(F.greatest(low - F.col("begin"), F.lit(0).cast(COUNT))), F.least(F.col("times") - 1, turn(high - 1 - F.col("begin"))))
        made = staged(met.withColumn("turn", F.explode(turns)).select(
            "child", "type", (F.col("begin") + F.col("turn").cast("decimal(19,0)") * F.col("size")).cast(COUNT).alias("base"), F.expr("transform(inner, i -> element_at(ports, cast(i + 1 as int)))").alias("ports"),
            (F.col("scale") * F.col("param") + F.col("shift")).alias("param")))
        gates = made.where("child is null").select(F.col("base").alias("place"), "type", "param", F.col("ports").alias("qubits"))
        done = gates if done is None else done.unionByName(gates)
        unstage(now)
        now = made.where("child is not null").select(F.col("child").alias("block"), "base", "ports", "param")
        if now.isEmpty():
            return done
