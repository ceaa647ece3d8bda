"""Tables that are added to: batches that come again, writers side by side, failures, and rules on a stream."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from voltledger.operators import rules
from voltledger.plans import queries
from voltledger.sources import sinks, tables
from voltledger.streaming import intake as streams

DATA = "/root/testdata/sf0.001"


def rows(spark, *keys):
    return spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string")


def held(spark, folder):
    return sorted(r["k"] for r in spark.read.parquet(folder).collect())


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert sinks.commit(rows(spark, 1, 2), folder, "0", "k")
    assert not sinks.commit(rows(spark, 1, 2), folder, "0", "k")
    assert sinks.commit(rows(spark, 3), folder, "1", "k")
    with pytest.raises(ValueError):
        sinks.commit(rows(spark, 4, 3), folder, "2", "k")
    with pytest.raises(ValueError):
        sinks.commit(rows(spark, 5, 5), folder, "3", "k")
    assert held(spark, folder) == [1, 2, 3] and not [n for n in os.listdir(folder) if n.startswith("_staged")]


def test_a_failing_task_adds_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(Exception):
        sinks.commit(rows(spark, 1, 2).repartition(2).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), folder, "0", "k")
    assert sinks.commit(rows(spark, 1, 2), folder, "0", "k") and held(spark, folder) == [1, 2]


def test_writers_side_by_side_keep_keys_unique(spark, tmp_path):
    folder, said = str(tmp_path / "t"), []

    def write(*keys):
        try:
            said.append(sinks.commit(rows(spark, *keys), folder, None, "k"))
        except ValueError:
            said.append("refused")

    threads = [threading.Thread(target=write, args=(i, 100 if i % 2 else 200 + i)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert said.count("refused") == 2 and said.count(True) == 4
    assert held(spark, folder).count(100) == 1 and len(held(spark, folder)) == 8


def test_calls_of_a_stream_come_once(spark, tmp_path):
    calls = spark.createDataFrame([(i, i, 2) for i in range(20)], "call_id long, input_tokens int, output_tokens int")
    calls.repartition(4).write.parquet(str(tmp_path / "in"))
    for again in ("a", "b"):  # the second run has lost its checkpoint and sends its batches again
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda b, n: sinks.append_calls(b, str(tmp_path / "out"), str(n))).option("checkpointLocation", str(tmp_path / again)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["call_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


@pytest.mark.parametrize("on", ["lines", "meters"])
def test_rules_on_a_stream_give_what_the_batch_gives(spark, tmp_path, on):
    bills = tables.extractions(spark, DATA)
    table = queries.vat_charges(spark, DATA) if on == "lines" else queries.meters(spark, DATA).withColumn("tou", F.lit(None).cast("double"))
    table.write.parquet(str(tmp_path / "in"))
    stream = streams.arriving_rule_issues(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), on, bills)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.select("extraction_id", "rule_id", "field", "severity", "expected", "actual").collect())
    want = plain(rules.found_in(table, on, rules.with_gates(bills)))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == want and len({r[1] for r in want}) >= 4
