"""Streams with state: a batch needs its own keys only, and one that runs again leaves nothing twice."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from voltledger.operators import rules
from voltledger.plans import reviews
from voltledger.sources import tables
from voltledger.streaming import intake

DATA = "/root/testdata/sf0.001"
AT = lambda h: dt.datetime(2024, 1, 1, h)


def fed(spark, tmp_path, schema, batches, made, each, mode):
    """Runs each batch of rows through made, a stream, into each(batch, id)."""
    inbox = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        made(spark.readStream.schema(schema).parquet(inbox)).writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()


def test_drift_against_the_last_run_in_state(spark, tmp_path):
    schema = "extraction_id long, file_hash string, created_at timestamp, document string"
    out = str(tmp_path / "out")
    batches = [
        [(1, "f", AT(1), '{"a": 1}'), (2, "g", AT(1), '{"a": 1}'), (8, None, AT(1), '{"a": 5}'), (7, "h", None, '{"a": 7}')],
        [(3, "f", AT(3), '{"a": 2}'), (4, "f", AT(4), '{"a": 2, "b": 1}'), (9, None, AT(2), '{"a": 6}'), (10, "h", AT(1), '{"a": 8}')],
        [(5, "f", AT(2), '{"a": 9}'), (6, "g", AT(2), "no json")],
        [(11, "f", AT(5), '{"a": 2}')],
    ]

    def each(batch, i):
        intake.drift_of_runs(batch, i, out)
        intake.drift_of_runs(batch, i, out)  # as after a failure

    fed(spark, tmp_path, schema, batches, intake.with_last_run, each, "append")
    got = sorted((r["previous_id"], r["extraction_id"], r["field_path"], r["old_value"], r["new_value"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 3, "a", "1", "2"), (2, 6, "a", "1", None), (3, 4, "b", None, "1"), (4, 11, "b", "1", None), (7, 10, "a", "7", "8")]


def test_status_by_keyed_state(spark, tmp_path):
    schema = "extraction_id long, status string, updated_at timestamp"
    folder = str(tmp_path / "table")
    batches = [[(1, "processing", AT(1)), (2, "accepted", AT(2))], [(1, "failed", AT(3)), (2, "processing", AT(1))], [(3, "processing", AT(4))]]
    sizes = []

    def each(batch, i):
        sizes.append(batch.count())
        assert intake.keep_status(batch, i, folder) and not intake.keep_status(batch, i, folder)

    fed(spark, tmp_path, schema, batches, intake.latest_status, each, "update")
    assert sizes == [2, 2, 1]
    assert {(r["extraction_id"], r["status"]) for r in intake.kept_status(spark, folder).collect()} == {(1, "failed"), (2, "accepted"), (3, "processing")}


def test_bills_are_judged_when_their_lines_are_in(spark, tmp_path):
    lines = tables.charges(spark, DATA).where("extraction_id < 200").select("extraction_id", "charge_section", "charge_owner", "category", "amount", "amount_net", "quantity", "rate", "line_number", "vat_rate", "reverse_charge", *(F.lit(None).cast("decimal(18,2)").alias(c) for c in ("vat_amount", "amount_gross")))
    stated = reviews.sections(spark, DATA).groupBy("extraction_id").agg(F.collect_list(F.struct("charge_section", "subtotal")).alias("sections"))
    bills = rules.with_gates(reviews.flagged(spark, DATA)).join(stated, "extraction_id").withColumns({"vat_summary": F.lit(None).cast("array<struct<vat_rate:decimal(4,2),stated_base:decimal(18,2),stated_vat:decimal(18,2)>>"), "any_tou": F.lit(False)} | {c: F.lit(None).cast("decimal(18,2)") for c in ("total_net", "total_vat", "total_gross")})
    batch = rules.with_computed(bills.join(rules.line_facts(lines), "extraction_id")).select("extraction_id", F.inline(rules.issues_of("bills")))
    want = sorted(map(str, batch.collect()))
    seen = lines.select("extraction_id", "charge_section", "charge_owner", "category", "amount", (F.lit(AT(1)) + F.make_dt_interval(mins=F.col("line_number"))).alias("created_at"))
    seen.repartition(3, "line_number").write.parquet(str(tmp_path / "in"))
    later = spark.createDataFrame([(10**9, "other", "x", "tax", D(1), AT(20))], seen.schema)
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = intake.arriving_bill_issues(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in")), bills)
    query = stream.writeStream.outputMode("append").format("memory").queryName("judged").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(str, spark.table("judged").collect()))
    assert got == want and {"V02", "V03", "V12"} <= {r["rule_id"] for r in spark.table("judged").select("rule_id").distinct().collect()}
