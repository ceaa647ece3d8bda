"""Streams give what the table operators give."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from voltledger.operators import validate
from voltledger.streaming import intake


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_first_file_of_each_content(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1", "b.pdf": b"%PDF-1", "c.pdf": b"%PDF-2", "d.pdf": b"%PDF-3"}.items():
        (tmp_path / name).write_bytes(data)
    got = drained(intake.first_of_each(intake.arriving_files(spark, str(tmp_path))), "files")
    assert got.select("file_hash").distinct().count() == got.count() == 3


def test_lines_are_checked_as_they_arrive(spark, tmp_path):
    schema = "extraction_id long, line_number int, category string, quantity decimal(18,2), rate decimal(18,4), amount decimal(18,2)"
    lines = spark.createDataFrame([(1, 1, "energy", D("280"), D("0.0845"), D("50")), (1, 2, "energy", None, None, D("-1")), (1, 3, "credit", None, None, D("-1"))], schema)
    bills = spark.createDataFrame([(1, "US")], "extraction_id long, country_code string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    got = drained(intake.arriving_issues(stream, bills), "arriving")
    want = validate.line_math(lines, bills).unionByName(validate.negative_amounts(lines))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2


def test_status_and_windows(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "queued", t), (1, "done", t + dt.timedelta(minutes=5)), (2, "queued", t)]
    spark.createDataFrame(rows, "job_id long, status string, ts timestamp").write.parquet(str(tmp_path / "jobs"))
    got = drained(intake.job_status(spark.readStream.schema("job_id long, status string, ts timestamp").parquet(str(tmp_path / "jobs"))), "jobs", "complete")
    assert {(r["job_id"], r["status"]) for r in got.collect()} == {(1, "done"), (2, "queued")}
    calls = [("read", 5, 10, t + dt.timedelta(minutes=m)) for m in (0, 20, 70, 300)]
    schema = "stage string, total_tokens long, duration_ms long, created_at timestamp"
    spark.createDataFrame(calls, schema).write.parquet(str(tmp_path / "calls"))
    got = drained(intake.calls_per_window(spark.readStream.schema(schema).parquet(str(tmp_path / "calls"))), "windows")
    assert {(r["start"], r["n_calls"]) for r in got.collect()} == {(t, 2), (t + dt.timedelta(hours=1), 1)}


def test_upsert_gives_the_newest(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    schema = "extraction_id long, status string, updated_at timestamp"
    spark.createDataFrame([(1, "processing", t), (2, "accepted", t)], schema).write.parquet(str(tmp_path / "store"))
    batch = spark.createDataFrame([(1, "failed", t + dt.timedelta(1)), (2, "processing", t - dt.timedelta(1))], schema)
    once = intake.upsert_status(batch, str(tmp_path / "store"))
    assert {(r["extraction_id"], r["status"]) for r in once.collect()} == {(1, "failed"), (2, "accepted")}
    assert once.select(F.count("*")).first()[0] == 2


def test_drift_as_documents_arrive(spark, tmp_path):
    from voltledger.streaming import intake as stream

    schema = "extraction_id long, file_hash string, created_at timestamp, document string"
    inbox, store, out = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "out")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [[(1, "f", at(1), '{"a": 1}'), (2, "g", at(1), '{"a": 1}')], [(3, "f", at(2), '{"a": 2}'), (4, "f", at(3), '{"a": 2, "b": 1}')]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        query = spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(lambda b, i: stream.arriving_drift(b, i, store, out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["previous_id"], r["extraction_id"], r["field_path"], r["old_value"], r["new_value"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 3, "a", "1", "2"), (3, 4, "b", None, "1")}
