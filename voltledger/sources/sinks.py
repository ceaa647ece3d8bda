"""Tables that results are kept in."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _files(rows: DataFrame, folder: str):
    """The JVM's file classes, a context for folder, and the versions of its table: number and the batch that wrote it."""
    fs = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    conf = rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    top = fs.Path(folder)
    system = top.getFileSystem(conf)
    names = [s.getPath().getName() for s in system.listStatus(top)] if system.exists(top) else []
    found = [n.removeprefix("version=") for n in names if n.startswith("version=")]
    marks = {int(v): [s.getPath().getName().removeprefix("_batch-") for s in system.listStatus(fs.Path(top, f"version={v}")) if s.getPath().getName().startswith("_batch-")] for v in found}
    return fs, system, fs.FileContext.getFileContext(system.getUri(), conf), {v: (m or [None])[0] for v, m in marks.items()}


def commit(rows: DataFrame, folder: str, batch: str | None = None, key: str | None = None, by: tuple[str, ...] = ()) -> bool:
    """Adds rows to a table of Parquet files as its next version, all or none; False if batch (a name without slashes) is in it already.

    The rows are written beside the table and moved in by one rename that fails if another writer has taken that version; then
    the check of key is made again with that writer's rows and the next version is tried. So a task or a job that runs
    again leaves nothing twice, and neither do two writers. With key, a value that rows hold twice or that the table has is an
    error and nothing is added. A folder that doesn't exist is an empty table; columns of by become folders."""
    spark, staged = rows.sparkSession, f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(staged)
    fs, system, context, versions = _files(rows, folder)
    try:
        mine = spark.read.schema(rows.schema).parquet(staged)
        if key and not mine.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} isn't unique")
        if batch is not None:
            system.create(fs.Path(staged, f"_batch-{batch}")).close()
        checked: set[int] = set()
        while batch is None or batch not in versions.values():
            new = sorted(set(versions) - checked)
            if key and new:
                held = spark.read.schema(rows.schema).parquet(*(f"{folder}/version={v}" for v in new))
                if not held.select(key).join(mine.select(key).hint("shuffle_hash"), key, "left_semi").isEmpty():
                    raise ValueError(f"{key} isn't unique")
            checked |= set(new)
            target = fs.Path(f"{folder}/version={max(versions, default=0) + 1}")
            try:
                context.rename(fs.Path(staged), target, spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
                return True
            except Py4JJavaError as e:
                if not system.exists(target):
                    raise e
            versions = _files(rows, folder)[3]
        return False
    finally:
        system.delete(fs.Path(staged), True)


def store_extractions(bills: DataFrame, folder: str, batch: str | None = None) -> bool:
    """Adds bills to a table of Parquet files, by commodity."""
    return commit(bills, folder, batch, by=("commodity_type",))


def export_json(bills: DataFrame, folder: str, hidden: tuple[str, ...] = ()) -> None:
    """One JSON object a line, without the hidden columns."""
    bills.drop(*hidden).write.mode("overwrite").json(folder)


def append_rows(rows: DataFrame, folder: str, key: str, batch: str | None = None) -> bool:
    """Adds rows to a Parquet table whose key stays unique, as commit does."""
    return commit(rows, folder, batch, key)


def with_total_tokens(calls: DataFrame) -> DataFrame:
    """total_tokens is the sum if both counts are there and not zero, else null."""
    both = (F.col("input_tokens") != 0) & (F.col("output_tokens") != 0)
    return calls.withColumn("total_tokens", F.when(both, F.col("input_tokens") + F.col("output_tokens")))


def append_calls(calls: DataFrame, folder: str, batch: str | None = None) -> bool:
    """Adds logged calls with their total_tokens; batch is the number of a stream's batch in foreachBatch."""
    return append_rows(with_total_tokens(calls), folder, "call_id", batch)
