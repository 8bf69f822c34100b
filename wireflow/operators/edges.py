"""Edge lists of the gate graph and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.functions.codec import link_id
from wireflow.plans.running import global_rank
from wireflow.schema import GLOBAL_IN, GLOBAL_OUT, IN, OUT


def edge_list(gates: DataFrame, three_ports: bool = True) -> DataFrame:
    """(source, target), an edge for every wire, from the links alone; the global gates are -1 and -2.

    Without ``three_ports`` the gates with three ports give none."""
    e = lambda a, b: F.struct(a.cast("bigint").alias("source"), b.cast("bigint").alias("target"))
    me = F.col("id")
    own = [F.when(F.col(c).isNotNull(), e(me, link_id(c))) for c in ("next_q1", "next_q2", "next_q3")]
    if not three_ports:
        own = [F.when(F.col("next_q3").isNull(), x) for x in own]
    edges = F.array(F.when(F.col("type") == IN, e(F.lit(GLOBAL_IN), me)), F.when(F.col("type") == OUT, e(me, F.lit(GLOBAL_OUT))), *own)
    return gates.select(F.explode(edges).alias("e")).where("e is not null").select("e.*")


def edge_batches(edges: DataFrame, size: int) -> DataFrame:
    """(batch, source, target): consecutive edges in the order of (source, target)."""
    return global_rank(edges, "source", "target").select(F.floor(F.col("rank") / size).cast("bigint").alias("batch"), "source", "target")


def with_inputs(batches: DataFrame) -> DataFrame:
    """Add (GlobalIn, source) for every edge whose source is no target within its batch; one for each edge."""
    targets = batches.select("batch", F.col("target").alias("source")).distinct()
    new = batches.join(targets, ["batch", "source"], "left_anti").select("batch", F.lit(GLOBAL_IN).cast("bigint").alias("source"), F.col("source").alias("target"))
    return batches.unionByName(new)


def batch_nodes(batches: DataFrame) -> DataFrame:
    """(batch, node): the distinct gates of each batch, the global ones left out."""
    return batches.select("batch", F.explode(F.array("source", "target")).alias("node")).where("node >= 0").distinct()


def d3_name(prefix: str = "") -> F.Column:
    """The name of a gate in a drawing: its readable name, parameter and id."""
    return F.concat(F.col(f"{prefix}readable"), F.lit("*"), F.col(f"{prefix}param").cast("string"), F.lit("("), F.col(f"{prefix}node").cast("string"), F.lit(")"))


def d3_nodes(members: DataFrame) -> DataFrame:
    """A JSON object for every gate of (node, widget, readable, param)."""
    return members.select(F.to_json(F.struct(d3_name().alias("id"), F.col("widget").alias("group"))).alias("json"))


def d3_links(edges: DataFrame, names: DataFrame) -> DataFrame:
    """A JSON object for every edge (source, target), its ends named as the nodes (node, readable, param) are; none for the global gates."""
    ends = names.select("node", d3_name().alias("name"))
    both = edges.where("source >= 0 and target >= 0").join(ends.select(F.col("node").alias("source"), F.col("name").alias("s")), "source").join(ends.select(F.col("node").alias("target"), F.col("name").alias("t")), "target")
    return both.select(F.to_json(F.struct(F.col("s").alias("source"), F.col("t").alias("target"), F.lit(1).alias("value"))).alias("json"))
