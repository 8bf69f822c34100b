"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The tables of :func:`once`: for each application, name and source, what the source was, where the table is, and its schema.
_MADE: dict[tuple, tuple] = {}
#: While a table is written: Spark drops the shuffle files of the query when it has ended, not when the driver collects its
#: garbage, and Python workers get 2,000 rows at a time, which bounds their memory.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary one is made if all runs in one process (tests); on a
    cluster that would scatter the parts over the executors' disks, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-wf-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/wf-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, survives lost executors, and gives later joins the true size, so
    that Spark broadcasts the table only if it is below its broadcast threshold."""
    path = new_path(df.sparkSession, label)
    _write(df, path, compression)
    return _read(df.sparkSession, path, df.schema)


def _write(df: DataFrame, path: str, compression: str = "snappy") -> None:
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in (WRITING | getattr(df, "arrow_rows", {})).items():
            spark.conf.set(k, v)
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def of_numbers(df: DataFrame) -> DataFrame:
    """``df`` whose Python workers get more rows at a time when it is written: its rows are a few numbers each."""
    df.arrow_rows = {"spark.sql.execution.arrow.maxRecordsPerBatch": "20000"}
    return df


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete the tables of those frames that :func:`staged` made, once nothing is to be computed from them."""
    for df in frames:
        if hasattr(df, "staged_at"):
            delete(df.sparkSession, df.staged_at)


def _at(spark: SparkSession, path: str):
    """(file system, path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    fs, at = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, which may be missing."""
    fs, at = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def files_of(spark: SparkSession, *paths: str) -> str:
    """A digest of the files of Parquet tables: their names, sizes and times of change."""
    out = hashlib.md5()
    for path in paths:
        index = spark.read.parquet(path)._jdf.queryExecution().analyzed().relation().location()
        out.update(index.allFiles().mkString("\n").encode())
    return out.hexdigest()


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], tables: tuple[str, ...] = ("orders",), write: Callable[[DataFrame, str], None] = _write) -> DataFrame:
    """What ``make`` gives, written once for a source in a Spark application and read by whoever asks again.

    It is made again if it is gone or if the files of the source's ``tables`` are others than
    they were; the old table is then deleted. ``write`` may lay the table out in a way of its own."""
    key = (spark.sparkContext.applicationId, name, source)
    now = files_of(spark, *(f"{source}/{t}.parquet" for t in tables))
    if key in _MADE and _MADE[key][0] != now:
        delete(spark, _MADE.pop(key)[1])
    if key not in _MADE or not is_written(spark, _MADE[key][1]):
        df, path = make(), new_path(spark, name)
        write(df, path)
        _MADE[key] = now, path, df.schema
    return _read(spark, *_MADE[key][1:])


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
