"""Files in and out: gate tables, statistics, graphs, and a subset of OpenQASM 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.operators.edges import d3_links, d3_nodes
from wireflow.schema import CCX, CX, GATE_SCHEMA, H, LAYER_SCHEMA, S, S_DAG, T, T_DAG, X

#: Names of gates without parameters, and of rotations by an angle in multiples of pi.
QASM = {"h": (H, 1.0), "cx": (CX, 1.0), "t": (T, 0.0), "tdg": (T_DAG, 0.0), "s": (S, 0.0), "sdg": (S_DAG, 0.0), "x": (X, 0.0), "y": (10, 0.0), "z": (11, 0.0), "cz": (16, 1.0), "ccx": (CCX, 1.0), "cswap": (24, 0.0), "swap": (31, 0.0)}
QASM_ROTATIONS = {"rx": 2, "ry": 3, "rz": 4}
QASM_HEADER = ("OPENQASM 3.0;", 'include "stdgates.inc";')


def write_gates(gates: DataFrame, path: str) -> None:
    """Append to a Parquet table, partitioned by label so that a scan by label reads only its files."""
    gates.write.mode("append").partitionBy("label").parquet(path)


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GATE_SCHEMA).parquet(path)


def write_layers(placed: DataFrame, path: str) -> None:
    """Append rows (id, control_q, target_q, type, param, layer) to a Parquet table, in ranges of layers, so that a range of layers reads few files."""
    placed.repartitionByRange("layer").sortWithinPartitions("layer", "id").write.mode("append").parquet(path)


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYER_SCHEMA).parquet(path)


def append_stats(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of CSV files with headers: a file for every call, so that runs can append side by side."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def write_stats(series: DataFrame, path: str, order: str = "id") -> None:
    """A CSV file with a header, in order; one short row for each step, so one file."""
    series.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_graph(members: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines of nodes and links for a drawing."""
    d3_nodes(members).write.mode("overwrite").text(f"{path}/nodes")
    d3_links(edges, members).write.mode("overwrite").text(f"{path}/links")


def to_qasm(ops: DataFrame) -> DataFrame:
    """(op_id, line) of operations whose gates have a name there; others are an error."""
    name = F.lit(None).cast("string")
    for word, (code, _) in QASM.items():
        name = F.when(F.col("type") == code, word).otherwise(name)
    for word, code in QASM_ROTATIONS.items():
        name = F.when(F.col("type") == code, F.concat(F.lit(f"{word}("), F.col("param").cast("string"), F.lit(" * pi)"))).otherwise(name)
    args = F.array_join(F.transform("qubits", lambda x: F.concat(F.lit("q["), x.cast("string"), F.lit("]"))), ", ")
    return ops.select("op_id", F.concat(F.when(name.isNull(), F.raise_error(F.concat(F.lit("no name for type "), F.col("type").cast("string")))).otherwise(name), F.lit(" "), args, F.lit(";")).alias("line"))


def qasm_program(ops: DataFrame) -> DataFrame:
    """(place, line) of a whole program in order: the header, the qubits, a line for every operation."""
    size = ops.agg((F.coalesce(F.max(F.array_max("qubits")), F.lit(-1)) + 1).alias("n"))
    head = F.array(*[F.lit(x) for x in QASM_HEADER], F.concat(F.lit("qubit["), F.col("n").cast("string"), F.lit("] q;")))
    head = size.select(F.posexplode(head).alias("at", "line")).select((F.col("at") - 3).cast("bigint").alias("place"), "line")
    return head.unionByName(to_qasm(ops).withColumnRenamed("op_id", "place"))


def from_qasm(lines: DataFrame) -> DataFrame:
    """(op_id, type, param, qubits) of (op_id, line); lines without a known gate are left out."""
    word = F.regexp_extract("line", r"^([a-z]+)(\([^)]*\))? q\[", 1)
    angle = F.regexp_extract("line", r"^[a-z]+\(([-+0-9.eE]+) \* pi\)", 1)
    code, param = F.lit(None).cast("short"), F.lit(None).cast("float")
    for name, (c, p) in QASM.items():
        code, param = F.when(word == name, F.lit(c).cast("short")).otherwise(code), F.when(word == name, F.lit(p).cast("float")).otherwise(param)
    for name, c in QASM_ROTATIONS.items():
        code, param = F.when(word == name, F.lit(c).cast("short")).otherwise(code), F.when(word == name, angle.try_cast("float")).otherwise(param)
    qubits = F.transform(F.regexp_extract_all("line", F.lit(r"q\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint"))
    return lines.select("op_id", code.alias("type"), param.alias("param"), qubits.alias("qubits")).where("type is not null")
