"""The linked gate table from a stream of operations: gates leave as soon as all their links are known.

Each micro-batch is linked like a table of its own and joined with what the batches before left
open: the ports whose next gate has not come yet, at most one gate for every qubit. What is open
is written by batch number, so a batch that runs twice gives the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireflow.functions.codec import link
from wireflow.plans.build import numbered, qubits
from wireflow.plans.running import global_rank, neighbours
from wireflow.plans.staging import delete, is_written, names_in, new_path, staged, unstage
from wireflow.schema import IN, OUT

#: A row for every port: what its gate is, the qubit's place in the order of first touch, and the links of the port (next is null while open).
PORTS = "id long, op_id long, type short, param float, n_ports int, port int, qubit long, rank long, prev long, next long"
TOTALS = "n_ops long, n_qubits long, last_op long"
GATES = "id long, prev_q1 long, prev_q2 long, prev_q3 long, type short, param float, next_q1 long, next_q2 long, next_q3 long"


def _gates(ports: DataFrame) -> DataFrame:
    at = lambda c, p: F.max(F.when(F.col("port") == p, F.col(c))).alias(f"{c}_q{p + 1}")
    rows = ports.groupBy("id", "type", "param").agg(*[at(c, p) for c in ("prev", "next") for p in range(3)])
    return rows.select("id", "prev_q1", "prev_q2", "prev_q3", "type", "param", "next_q1", "next_q2", "next_q3")


def _io(rows: DataFrame, code: int) -> DataFrame:
    """In or Out gates of rows (id, link): one link each."""
    none, own = F.lit(None).cast("bigint"), F.col("link").cast("bigint")
    prev, after = (none, own) if code == IN else (own, none)
    return rows.select("id", prev.alias("prev_q1"), none.alias("prev_q2"), none.alias("prev_q3"), F.lit(code).cast("short").alias("type"), F.lit(0.0).cast("float").alias("param"),
                       after.alias("next_q1"), none.alias("next_q2"), none.alias("next_q3"))


class Builder:
    """Links the micro-batches of a stream of operations (op_id, type, param, qubits) under the folder ``at``.

    Operations must come in the order of op_id, dense from 0, batch after batch; a late one is an error.
    All that is carried on is in the folder, by batch number, and a batch counts once its totals are
    written, last of all. So a new builder on the folder goes on where the last one ended, a batch
    that was cut off is linked again, and more may come after a flush."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def last(self) -> int:
        """The last batch that was linked to its end, -1 before the first."""
        batches = [int(n) for n in names_in(self.spark, f"{self.at}/totals") if n.isdigit() and is_written(self.spark, f"{self.at}/totals/{n}")]
        return max(batches, default=-1)

    def _read(self, what: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.at}/{what}/{batch}")

    def _write(self, df: DataFrame, what: str, batch) -> None:
        df.write.mode("overwrite").parquet(f"{self.at}/{what}/{batch}")

    def step(self, batch_ops: DataFrame, batch: int) -> None:
        """Link one batch: write the gates that are finished by it and what stays open; the state of two batches before is deleted."""
        if batch > self.last() + 1:
            raise ValueError(f"batch {batch} came after {self.last()}")
        ops = staged(batch_ops.select("op_id", "type", F.col("param").cast("float").alias("param"), "qubits"), "batch")
        open_ports, totals = self._read("open", batch - 1, PORTS), self._read("totals", batch - 1, TOTALS)
        n_ops, n_qubits, last_op = totals.first() or (0, 0, -1)
        first, after, n = ops.agg(F.min("op_id"), F.max("op_id"), F.count(F.lit(1))).first()
        if first is not None and first <= last_op:
            raise ValueError(f"operation {first} came after {last_op}")
        waiting = open_ports.where("next is null").select(F.col("qubit").alias("wq"), F.col("rank").alias("wrank"), link("id", "port", "type").alias("wlink"))
        seen = qubits(ops).join(waiting, F.col("qubit") == F.col("wq"), "left")
        new = staged(seen.where("wq is null").select("qubit", "first_op", "rank"), "new")
        # of the qubits touched for the first time, in their order, the ranks run on from those before
        order = global_rank(new.withColumnRenamed("rank", "here"), "here")
        fresh = staged(order.select("qubit", "first_op", (F.col("rank") + n_qubits).alias("rank")), "fresh")
        own = numbered(ops, fresh).withColumn("id", F.col("id") + n_qubits)
        here = own.select("id", "op_id", "type", "param", F.size("qubits").alias("n_ports"), F.posexplode("qubits").alias("port", "qubit"))
        near = neighbours(here, ["qubit"], "id", F.struct("id", "port", "type"), "before", "after")
        ins = fresh.select(F.col("qubit").alias("fq"), F.col("rank").alias("frank"), (F.col("first_op") + F.col("rank")).alias("in_id"))
        rows = near.join(waiting, F.col("qubit") == F.col("wq"), "left").join(ins, F.col("qubit") == F.col("fq"), "left")
        prev = F.coalesce(link("before.id", "before.port", "before.type"), F.col("wlink"), link("in_id", F.lit(0), F.lit(IN)))
        ports = rows.select("id", "op_id", "type", "param", "n_ports", "port", "qubit", F.coalesce("wrank", "frank").alias("rank"), prev.cast("bigint").alias("prev"),
                            link("after.id", "after.port", "after.type").cast("bigint").alias("next"), F.col("before").isNull().alias("first"), "in_id")
        ports = staged(ports, "ports")
        heads = ports.where("first").select(F.col("qubit").alias("hq"), link("id", "port", "type").cast("bigint").alias("head"))
        carried = open_ports.join(heads, F.col("qubit") == F.col("hq"), "left").withColumn("next", F.coalesce("next", "head")).drop("hq", "head")
        every = staged(ports.drop("first", "in_id").unionByName(carried), "every")
        done = every.groupBy("id", "n_ports").agg(F.count("next").alias("k")).where("k = n_ports").select("id")
        entered = ports.where("first and in_id is not null").select(F.col("in_id").alias("id"), link("id", "port", "type").alias("link"))
        self._write(_gates(every.join(done, "id", "left_semi")).unionByName(_io(entered, IN)), "gates", batch)
        self._write(every.join(done, "id", "left_anti").select(*open_ports.columns), "open", batch)
        delete(self.spark, f"{self.at}/gates/end")
        self._write(self.spark.createDataFrame([(n_ops + n, n_qubits + fresh.count(), after if n else last_op)], TOTALS), "totals", batch)
        unstage(ops, new, fresh, ports, every)
        for what in ("open", "totals"):
            delete(self.spark, f"{self.at}/{what}/{batch - 2}")

    def flush(self) -> None:
        """At the end of the stream: the open ports lead to Out gates, numbered after all others in the order of first touch."""
        last = self.last()
        open_ports, totals = self._read("open", last, PORTS), self._read("totals", last, TOTALS)
        n_ops, n_qubits, _ = totals.first() or (0, 0, -1)
        out = F.col("rank") + n_ops + n_qubits
        closed = open_ports.withColumn("next", F.coalesce("next", link(out, F.lit(0), F.lit(OUT))))
        left = open_ports.where("next is null").select(out.alias("id"), link("id", "port", "type").alias("link"))
        self._write(_gates(closed).unionByName(_io(left, OUT)), "gates", "end")


def run_builder(ops: DataFrame, at: str | None = None) -> DataFrame:
    """The gate table (GATES) of all operations that a streaming frame (op_id, type, param, qubits) has now.

    With the folder ``at`` of an earlier run, which may have been cut off at any point, it goes on
    from there: the stream's own checkpoint says which batches are still to come."""
    spark = ops.sparkSession
    at = at or new_path(spark, "stream")
    builder = Builder(spark, at)
    ops.writeStream.foreachBatch(builder.step).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    builder.flush()
    return spark.read.schema(GATES).option("recursiveFileLookup", True).parquet(f"{at}/gates")


def run_links(ops: DataFrame) -> DataFrame:
    """(qubit, op_id, prev_op) of a streaming (op_id, qubit): of each micro-batch the neighbours, with the last operation of every qubit as what is carried on."""
    spark = ops.sparkSession
    at = new_path(spark, "stream")

    def step(batch_ops: DataFrame, batch: int) -> None:
        last = spark.read.schema("lq long, last long").parquet(f"{at}/last/{batch - 1}") if batch else spark.createDataFrame([], "lq long, last long")
        rows = staged(neighbours(batch_ops, ["qubit"], "op_id", F.struct("op_id"), "before", "after").join(last, F.col("qubit") == F.col("lq"), "left"), "batch")
        late = rows.where("op_id <= last").first()
        if late:
            raise ValueError(f"operation {late.op_id} of qubit {late.qubit} came after {late.last}")
        rows.select("qubit", "op_id", F.coalesce("before.op_id", "last").alias("prev_op")).write.mode("overwrite").parquet(f"{at}/links/{batch}")
        now = rows.groupBy("qubit").agg(F.max("op_id").alias("last")).select(F.col("qubit").alias("lq"), "last")
        last.join(now, "lq", "left_anti").unionByName(now).write.mode("overwrite").parquet(f"{at}/last/{batch}")

    ops.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("qubit long, op_id long, prev_op long").option("recursiveFileLookup", True).parquet(f"{at}/links")
