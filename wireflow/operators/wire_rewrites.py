"""Rewrites to their fixpoint on the wire form, by islands of equal neighbours instead of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.plans.build import wires
from wireflow.plans.running import neighbours, running_sum
from wireflow.schema import CONTROLLED, CX, H, S, T, T_DAG


def islands(rows: DataFrame, member: F.Column) -> DataFrame:
    """The rows of ``member`` with ``island``: the op_id at which their unbroken run on the qubit starts."""
    marked = neighbours(rows.withColumn("member", F.coalesce(member, F.lit(False))), ["qubit"], "op_id", F.struct("member"), "before", "after")
    start = F.col("member") & ~F.coalesce(F.col("before.member"), F.lit(False))
    run = running_sum(marked.withColumn("start", start).drop("before", "after"), ["qubit"], "op_id", F.col("start").cast("bigint"), "run").where("member")
    heads = run.where("start").select(F.col("qubit").alias("hq"), F.col("run").alias("hr"), F.col("op_id").alias("island"))
    return run.join(heads, (F.col("qubit") == F.col("hq")) & (F.col("run") == F.col("hr"))).drop("hq", "hr", "member", "start", "run")


def cancel_self_inverse(ops: DataFrame, code: int = H, param: float = 1.0) -> DataFrame:
    """(qubit, island, n, left): a run of n equal self-inverse gates leaves n mod 2."""
    own = islands(wires(ops), (F.col("type") == code) & (F.col("param") == F.lit(param).cast("float")))
    return own.groupBy("qubit", "island").agg(F.count(F.lit(1)).alias("n")).withColumn("left", F.col("n") % 2)


def cancel_ordered(ops: DataFrame, first: int = T, second: int = T_DAG) -> DataFrame:
    """(qubit, island, left_second, left_first): pairs (first, second) are matched like brackets within a run of both."""
    own = islands(wires(ops), F.col("type").isin(first, second))
    step = F.when(F.col("type") == first, 1).otherwise(-1).cast("bigint")
    sums = running_sum(own, ["qubit", "island"], "op_id", step, "height")
    ends = sums.groupBy("qubit", "island").agg(F.min("height").alias("least"), F.sum(step).alias("total"))
    left = F.greatest(-F.col("least"), F.lit(0))
    return ends.select("qubit", "island", left.cast("bigint").alias("left_second"), (F.col("total") + left).cast("bigint").alias("left_first"))


def fuse_pairs(ops: DataFrame, code: int = T) -> DataFrame:
    """(qubit, island, n_fused, n_left): leftmost pairing within a run of n equal gates."""
    own = islands(wires(ops), F.col("type") == code)
    n = own.groupBy("qubit", "island").agg(F.count(F.lit(1)).alias("n"))
    return n.select("qubit", "island", F.floor(F.col("n") / 2).cast("bigint").alias("n_fused"), (F.col("n") % 2).alias("n_left"))


def commute_through_controls(ops: DataFrame, code: int = T) -> DataFrame:
    """(qubit, island, place, op_id): within a run of rotations and controls, controls come first and rotations last, each in their order."""
    control = F.col("type").isin(*CONTROLLED) & (F.col("port") == 0)
    own = islands(wires(ops), control | (F.col("type") == code))
    moving = F.col("type") == code
    run = running_sum(own.withColumn("moving", moving.cast("bigint")), ["qubit", "island"], "op_id", F.col("moving"), "moved")
    run = running_sum(run, ["qubit", "island"], "op_id", 1 - F.col("moving"), "stayed")
    controls = run.groupBy(F.col("qubit").alias("cq"), F.col("island").alias("ci")).agg(F.max("stayed").alias("controls"))
    rows = run.join(controls, (F.col("qubit") == F.col("cq")) & (F.col("island") == F.col("ci")))
    return rows.select("qubit", "island", (F.when(F.col("moving") == 1, F.col("controls") + F.col("moved")).otherwise(F.col("stayed")) - 1).alias("place"), "op_id")


def without_pairs(ops: DataFrame, code: int = H, param: float = 1.0) -> DataFrame:
    """The circuit after cancelling runs of equal self-inverse gates: of an odd run the last one stays."""
    own = islands(wires(ops), (F.col("type") == code) & (F.col("param") == F.lit(param).cast("float")))
    runs = own.groupBy("qubit", "island").agg(F.count(F.lit(1)).alias("n"), F.max("op_id").alias("last"))
    gone = own.select("qubit", "island", "op_id").join(runs, ["qubit", "island"]).where((F.col("n") % 2 == 0) | (F.col("op_id") < F.col("last")))
    return ops.join(gone.select("op_id"), "op_id", "left_anti")


def without_brackets(ops: DataFrame, first: int = T, second: int = T_DAG) -> DataFrame:
    """The circuit after cancelling pairs (first, second) in runs of both: of a run the unmatched gates stay.

    Unmatched are the gates second that bring the running height (first counts 1, second -1) to a
    new least, and the gates first after which the height never falls below theirs again."""
    own = islands(wires(ops), F.col("type").isin(first, second))
    step = F.when(F.col("type") == first, 1).otherwise(-1).cast("bigint")
    sums = running_sum(own, ["qubit", "island"], "op_id", step, "height")
    # of each height, the first gate that falls to it and the last that rises to it
    ends = sums.groupBy("qubit", "island", "height").agg(F.min(F.when(F.col("type") == second, F.col("op_id"))).alias("fall"), F.max(F.when(F.col("type") == first, F.col("op_id"))).alias("rise"))
    total = sums.groupBy("qubit", "island").agg(F.least(F.min("height"), F.lit(0)).alias("least"), F.sum(step).alias("total"))
    kept = ends.join(total, ["qubit", "island"]).select(F.explode(F.array_compact(F.array(
        F.when(F.col("height") < 0, F.col("fall")), F.when((F.col("height") > F.col("least")) & (F.col("height") <= F.col("total")), F.col("rise"))))).alias("op_id"))
    return ops.join(own.select("op_id").join(kept, "op_id", "left_anti"), "op_id", "left_anti")


def with_pairs_fused(ops: DataFrame, code: int = T, fused: int = S) -> DataFrame:
    """The circuit after fusing pairs of equal gates from the left of each run: the first of a pair becomes ``fused``, the second goes."""
    own = islands(wires(ops), F.col("type") == code)
    run = running_sum(own, ["qubit", "island"], "op_id", F.lit(1).cast("bigint"), "at")
    size = run.groupBy(F.col("qubit").alias("sq"), F.col("island").alias("si")).agg(F.count(F.lit(1)).alias("n"))
    run = run.join(size, (F.col("qubit") == F.col("sq")) & (F.col("island") == F.col("si")))
    marks = run.select("op_id", (F.col("at") % 2 == 0).alias("gone"), ((F.col("at") % 2 == 1) & (F.col("at") < F.col("n"))).alias("fuses"))
    rest = ops.join(marks, "op_id", "left").where(~F.coalesce("gone", F.lit(False)))
    return rest.withColumn("type", F.when(F.col("fuses"), F.lit(fused)).otherwise(F.col("type")).cast("short")).drop("gone", "fuses")


def _links_of_two(ops: DataFrame) -> DataFrame:
    """(op_id, type, qubits, n0, n1): for every two-qubit operation the operation and port that follow on either wire."""
    rows = neighbours(wires(ops), ["qubit"], "op_id", F.struct("op_id", "port"), "before", "after")
    at = lambda p: F.max(F.when(F.col("port") == p, F.col("after"))).alias(f"n{p}")
    return rows.groupBy("op_id").agg(at(0), at(1)).join(ops.where(F.size("qubits") == 2).select("op_id", "type", "qubits"), "op_id")


def cancel_two_qubit(ops: DataFrame, code: int = CX, staged=None) -> DataFrame:
    """The operations left when equal self-inverse two-qubit gates that follow each other on both wires cancel, to a fixpoint.

    A round cancels whole chains at once (n gates leave n mod 2, the last); a removal can bring
    others together, so rounds go on until none is left, each cut from its lineage."""
    staged = staged or (lambda df: df.checkpoint())
    now = ops
    while True:
        two = _links_of_two(now).where(F.col("type") == code)
        pair = (F.col("n0.op_id") == F.col("n1.op_id")) & (F.col("n0.port") == 0) & (F.col("n1.port") == 1)
        follow = two.where(pair).select("op_id", F.col("n0.op_id").alias("to"))
        follow = staged(follow.join(two.select(F.col("op_id").alias("to")), "to", "left_semi"))
        if follow.isEmpty():
            return now
        chained = follow.select("op_id").unionByName(follow.select(F.col("to").alias("op_id"))).distinct()
        heads = F.col("prev").isNull()
        members = chained.join(follow.select(F.col("to").alias("op_id"), F.col("op_id").alias("prev")), "op_id", "left").join(ops.select("op_id", F.element_at("qubits", 1).alias("qubit")), "op_id")
        runs = running_sum(members.withColumn("head", heads), ["qubit"], "op_id", F.col("head").cast("bigint"), "run")
        ends = runs.groupBy(F.col("qubit").alias("eq"), F.col("run").alias("er")).agg(F.count(F.lit(1)).alias("n"), F.max("op_id").alias("last"))
        gone = runs.join(ends, (F.col("qubit") == F.col("eq")) & (F.col("run") == F.col("er"))).where((F.col("n") % 2 == 0) | (F.col("op_id") < F.col("last"))).select("op_id")
        now = staged(now.join(gone, "op_id", "left_anti"))


def match_hhcxhh(ops: DataFrame) -> DataFrame:
    """(cx, q0, q1, l0, l1, r0, r1): controlled NOTs with an H before and after on both wires; the H's by wire."""
    rows = neighbours(wires(ops), ["qubit"], "op_id", F.struct("op_id", "type", "param"), "before", "after")
    is_h = lambda c: (F.col(f"{c}.type") == H) & (F.col(f"{c}.param") == F.lit(1.0).cast("float"))
    own = rows.where(F.col("type").isin(15, CX) & is_h("before") & is_h("after"))
    at = lambda c, p, name: F.max(F.when(F.col("port") == p, F.col(c))).alias(name)
    found = own.groupBy("op_id").agg(F.count(F.lit(1)).alias("n"), at("qubit", 0, "q0"), at("qubit", 1, "q1"), at("before.op_id", 0, "l0"), at("before.op_id", 1, "l1"), at("after.op_id", 0, "r0"), at("after.op_id", 1, "r1"))
    return found.where("n = 2").select(F.col("op_id").alias("cx"), "q0", "q1", "l0", "l1", "r0", "r1")


def reverse_hhcxhh(ops: DataFrame) -> DataFrame:
    """The operations after one round: matched gates have their qubits swapped and lose their H's.

    Where two matches share an H, the one with the smaller gate is kept."""
    found = match_hhcxhh(ops)
    used = found.select("cx", F.explode(F.array("l0", "l1", "r0", "r1")).alias("h"))
    lost = used.join(used.groupBy("h").agg(F.min("cx").alias("best")), "h").where("cx <> best").select("cx").distinct()
    kept = found.join(lost, "cx", "left_anti")
    gone = kept.select(F.explode(F.array("l0", "l1", "r0", "r1")).alias("op_id"))
    turned = kept.select(F.col("cx").alias("op_id"), F.lit(True).alias("turned"))
    return ops.join(gone, "op_id", "left_anti").join(turned, "op_id", "left").withColumn("qubits", F.when(F.col("turned"), F.reverse("qubits")).otherwise(F.col("qubits"))).drop("turned")


def expand_cx(ops: DataFrame, pct: int = 100) -> DataFrame:
    """(op_id, sub, type, param, qubits): every controlled NOT becomes H H, the reversed gate, H H.

    With ``pct`` below 100, a sample of them by op_id, about so many per cent and the same in every run."""
    a, b = F.element_at("qubits", 1), F.try_element_at("qubits", F.lit(2))
    one = lambda code, param, *q: F.struct(F.lit(code).cast("short").alias("type"), F.lit(param).cast("float").alias("param"), F.array(*q).alias("qubits"))
    five = F.array(one(H, 1.0, a), one(H, 1.0, b), F.struct("type", "param", F.array(b, a).alias("qubits")), one(H, 1.0, a), one(H, 1.0, b))
    same = F.array(F.struct("type", "param", "qubits"))
    return ops.select("op_id", F.posexplode(F.when(F.col("type").isin(15, CX) & (F.col("op_id") * 7919 % 10007 * 100 < pct * 10007), five).otherwise(same)).alias("sub", "op")).select("op_id", F.col("sub").cast("bigint").alias("sub"), "op.*")

