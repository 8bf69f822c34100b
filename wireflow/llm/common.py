"""Shared helpers of the training-data operators: staged tables, row keys, exact weighted cuts."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wireflow.plans.staging import staged, unstage

#: ASCII white space: the blank and U+0009 to U+000D. Everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: 60-bit keys are searched 12 bits at a time.
KEY_BITS, STEP_BITS = 60, 12
#: The list of files, two numbers each, is broadcast if there are no more than this (about 64 MB).
MOST_FILES = 2_000_000


def ship_code(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each context, as spark-submit would with --py-files."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if getattr(context, "_wireflow_shipped", False):
        return
    context._wireflow_shipped = True
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "wireflow")):
            for name in names:
                if name.endswith(".py"):
                    z.write(path := os.path.join(folder, name), os.path.relpath(path, top))
    at = os.path.join(tempfile.mkdtemp(prefix="spark-wf-code-"), "wireflow_code.zip")
    with open(at, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(at)  # the driver serves it to the executors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that starts with ``stem`` and that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


#: Plans that give the rows of a file scan as they are, some columns or rows left out.
SCANS = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def scans_parquet(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a Parquet file, so that its file and place there tell it apart."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName().split(" ")[0] in SCANS:
        if node.children().isEmpty():
            try:
                return "_metadata" not in df.columns and bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
            except AnalysisException:
                return False
        if node.children().size() > 1:
            return False
        node = node.children().apply(0)
    return False


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Number the rows, the same whenever and wherever they are read.

    Rows of Parquet files are numbered by their file (in the order of the paths; one short row a
    file is ranked) and their place in it. How files are split depends on the cores there are,
    and shuffles deal in any order, so numbers by place in the plan would change: other tables
    are written with such numbers first."""
    if not scans_parquet(df):
        return staged(df.withColumn(name, F.monotonically_increasing_id()), "keyed")
    path, row, file = fresh(df, "path"), fresh(df, "row"), fresh(df, "file")
    at = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    hashed = fresh(df, "hash")
    files = at.select(path).distinct().withColumn(file, (F.row_number().over(Window.orderBy(path)) - 1).cast("bigint"))
    files = staged(files.withColumn(hashed, F.xxhash64(path)), "files")
    n, different = files.agg(F.count(F.lit(1)), F.countDistinct(hashed)).first()
    columns = [F.col(f"`{c}`") for c in df.columns]
    if n == different and n <= MOST_FILES:  # no row of the table is shuffled
        met = at.withColumn(hashed, F.xxhash64(path)).join(F.broadcast(files.select(hashed, file)), hashed)
    else:
        met = at.join(files, path)
    return met.select(*columns, (F.shiftleft(file, 40) + F.col(row)).alias(name))


def numbered(docs: DataFrame, row_key: str | None, *columns) -> DataFrame:
    """``columns`` of the rows of ``docs`` with their numbers as rid, written: the numbers in ``row_key`` if it is given, else new ones."""
    if not row_key:
        row_key = fresh(docs, "rid")
        docs = with_row_key(docs, row_key)
    return staged(docs.select(F.col(row_key).alias("rid"), *columns), "rows")


def key60(*cols) -> F.Column:
    """A 60-bit key in [0, 2^60) from the md5 of the columns as strings, joined by ':'."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def weighted_cuts(rows: DataFrame, budgets: DataFrame, label: str) -> DataFrame:
    """Find, for every group, the key at which the running weight comes nearest to a budget.

    ``rows``: (g, key long in [0, 2^60), w long >= 0); ``budgets``: (g, budget double).
    Returns (g, cut long): the rows with ``key < cut`` are those whose running sum, in key
    order, comes as near to the budget as whole keys allow. Groups match null-safely.

    Each round sums weights by group and the next 12 bits, finds the bucket in which the
    running sum passes the budget and goes on with the rows of that bucket alone; nothing is
    sorted but at most 4096 sums a group. A group without rows gets no cut."""
    rest = rows.select("g", "key", "w", F.lit(0).cast("bigint").alias("before"))
    goal = budgets.select(F.col("g").alias("bg"), "budget")
    done = []
    for shift in range(KEY_BITS - STEP_BITS, -1, -STEP_BITS):
        last = shift == 0
        sums = rest.groupBy("g", F.shiftright("key", shift).alias("b")).agg(
            F.sum("w").alias("bw"), F.max("before").alias("before"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        run = F.sum("bw").over(Window.partitionBy("g").orderBy("b"))
        sums = (sums.withColumn("upto", F.col("before") + run).withColumn("start", F.col("upto") - F.col("bw"))
                .join(goal, F.col("g").eqNullSafe(F.col("bg"))))
        hit = (F.col("start") <= F.col("budget")) & (F.col("budget") < F.col("upto"))
        top = Window.partitionBy("g")
        marked = staged(sums.withColumn("n_hit", F.max(hit.cast("int")).over(top)).withColumn("end", F.max("hi").over(top))
                        .where(hit | ((F.col("n_hit") == 0) & (F.col("hi") == F.col("end")))), f"{label}-cut")
        one = F.col("lo") == F.col("hi")
        # past the last key, or a single key: decided; an include flag takes the nearer side
        take = F.col("start") * 2.0 + F.col("bw") <= F.col("budget") * 2.0
        ready = marked.where((F.col("n_hit") == 0) | one) if not last else marked
        done.append(ready.select("g", F.when((F.col("n_hit") == 0) | take, F.col("hi") + 1).otherwise(F.col("lo")).alias("cut")))
        if last:
            break
        more = marked.where((F.col("n_hit") == 1) & ~one).select(F.col("g").alias("mg"), F.col("b").alias("mb"), "start")
        if more.isEmpty():
            break
        rest = staged(rows.join(more, F.col("g").eqNullSafe(F.col("mg")) & (F.shiftright("key", shift) == F.col("mb")))
                      .select("g", "key", "w", F.col("start").alias("before")), f"{label}-rest")
        rows = rest.drop("before")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
