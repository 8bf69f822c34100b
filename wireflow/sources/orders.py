"""Operation streams derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.plans.running import running_sum
from wireflow.schema import CX, H, M, S, T, T_DAG

QUBITS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op(code: int, param: float, *qubits: str):
    return F.struct(F.lit(code).cast("short").alias("type"), F.lit(param).cast("float").alias("param"), F.array(*[F.col(q) for q in qubits]).alias("qubits"))


def circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ops(op_id, type, param, qubits, label, k, j): a template for every order, by its priority and status.

    Numbers come from running sums of the templates' lengths over the order keys."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        k.alias("k"), "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % QUBITS).alias("a"), ((F.col("o_custkey") % QUBITS + 1 + k % (QUBITS - 1)) % QUBITS).alias("b"))
    h = lambda q: _op(H, 1.0, q)
    cx, t = _op(CX, 1.0, "a", "b"), _op(T, 0.0, "a")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    ops = (F.when(p == "1-URGENT", F.array(h("a"), h("a"))).when(p == "2-HIGH", F.array(cx, cx))
           .when(p == "3-MEDIUM", F.array(h("a"), h("b"), cx, h("a"), h("b"))).when(p == "4-NOT SPECIFIED", F.array(t, _op(T_DAG, 0.0, "a")))
           .when(s == "F", F.array(t, cx)).when(s == "O", F.array(cx, t)).otherwise(F.array(t, t)))
    rows = running_sum(orders.withColumn("ops", ops), [], "k", F.size("ops").cast("bigint"), "upto")
    return rows.select("k", F.substring("o_orderpriority", 1, 1).alias("label"), (F.col("upto") - F.size("ops")).alias("first"), F.posexplode("ops").alias("j", "op")).select(
        (F.col("first") + F.col("j")).alias("op_id"), "op.type", "op.param", "op.qubits", "label", "k", F.col("j").cast("bigint").alias("j"))


def events_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ops(table(spark, sf_dir, "events"))


def event_ops(events: DataFrame, *kept: str) -> DataFrame:
    """ops(op_id, type, param, qubits, meas_key, columns that are kept): one single-qubit operation per event; errors are measurements."""
    kind = F.col("event_type")
    code = F.when(kind == "view", H).when(kind == "click", T).when(kind == "purchase", T_DAG).when(kind == "signup", S).otherwise(M).cast("short")
    return events.select(
        F.col("event_id").alias("op_id"), code.alias("type"), F.when(code == H, 1.0).otherwise(0.0).cast("float").alias("param"),
        F.array(F.col("user_id") % QUBITS).alias("qubits"), F.when(code == M, F.concat(F.lit("m_"), (F.col("user_id") % 1000).cast("string"))).alias("meas_key"), *kept)


def triples(spark: SparkSession, sf_dir: str, *kept) -> DataFrame:
    """(k, a, b, c, columns that are kept): three different qubits for every order."""
    k, a = F.col("o_orderkey"), F.col("o_custkey") % QUBITS
    off1, off2 = 1 + k % (QUBITS - 1), 1 + (k + 7) % (QUBITS - 2)
    off2 = off2 + (off2 >= off1).cast("bigint")
    return table(spark, sf_dir, "orders").select(k.alias("k"), a.alias("a"), ((a + off1) % QUBITS).alias("b"), ((a + off2) % QUBITS).alias("c"), *kept)
