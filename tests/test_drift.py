"""Changes between documents: leaves stay beside their pair; a missing side, null documents, keys that change by themselves."""

from pyspark.sql import functions as F

from voltledger.operators import drift

DOCUMENTS = [
    (1, '{"a": 1, "charges": [{"amount": 1}], "processing_time_ms": 5, "x": {"extraction_id": 1, "y": null}}'),
    (2, '{"a": 2, "charges": [{"amount": 1}, {"amount": 2}], "processing_time_ms": 6, "x": {"extraction_id": 2, "y": 3}}'),
    (3, '{"a": 2, "charges": [{"amount": 1}, {"amount": 3}], "few_shot_context_hash": [7, 8]}'),
    (4, None),
]


def changes(spark):
    documents = spark.createDataFrame(DOCUMENTS, "extraction_id long, document string").withColumn("document", F.parse_json("document"))
    pairs = spark.createDataFrame([(2, 1), (3, 2), (3, 2), (3, 9), (9, 1), (4, 3), (4, 9), (None, 3)], "extraction_id long, previous_id long")
    return drift.document_changes(pairs, documents)


def test_changes_of_pairs(spark):
    got = {(r["extraction_id"], r["previous_id"], r["field_path"], r["old_value"], r["new_value"]) for r in changes(spark).collect()}
    of_3 = [("a", "2"), ("charges[0].amount", "1"), ("charges[1].amount", "3")]
    want = {(2, 1, "a", "1", "2"), (2, 1, "charges", "len=1", "len=2"), (2, 1, "x.y", None, "3")} | {(3, 2, "charges[1].amount", "2", "3"), (3, 2, "x.y", "3", None)}
    want |= {(3, 9, p, None, v) for p, v in of_3} | {(4, 3, p, v, None) for p, v in of_3} | {(None, 3, p, v, None) for p, v in of_3}
    want |= {(9, 1, p, v, None) for p, v in [("a", "1"), ("charges[0].amount", "1")]}
    assert got == want


def test_leaves_are_not_shuffled(spark):
    plan = changes(spark)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(extraction_id" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "path" in x]
