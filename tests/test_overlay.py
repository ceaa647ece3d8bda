"""Corrections laid over documents, and values at paths that come in a column."""

from pyspark.sql import functions as F

from voltledger.operators import documents, drift


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "extraction_id long, j string").select("extraction_id", F.parse_json("j").alias("document"))


def test_corrections_over_a_document(spark):
    table = docs(spark, (1, '{"a": {"value": "1", "confidence": 0.5}, "b": {"value": {"x": 1, "y": [2]}}, "s": 3, "l": [{"value": 1}]}'), (2, '{"a": {"value": "9"}}'))
    edits = [(1, 1, "a", "2", 1), (2, 1, "a", "3", 2), (3, 1, "b", "4", 1), (4, 1, "s", "5", 1), (5, 1, "l", "6", 1), (6, 1, "n.m", None, 1), (7, 3, "a", "7", 1), (8, 1, None, "8", 1)]
    made = spark.createDataFrame(edits, "correction_id long, extraction_id long, field_path string, corrected_value string, created_at int")
    got = {(r["extraction_id"], r["path"]): (r["value"], r["corrected"]) for r in documents.overlaid(table, made).collect()}
    assert got == {(1, "a.value"): ("3", True), (1, "a.confidence"): ("0.5", False), (1, "b.value"): ("4", True), (1, "s"): ("3", False), (1, "l[0].value"): ("1", False), (1, "n.m.value"): (None, True), (2, "a.value"): ("9", False)}
    bills = spark.createDataFrame([(1, "processing"), (2, "accepted")], "extraction_id long, status string")
    assert {tuple(r) for r in documents.reviewed(bills, made).collect()} == {(1, "reviewed"), (2, "accepted")}


def test_values_at_paths_of_a_table(spark):
    table = docs(spark, (1, '{"a": {"b": [1, {"c": null}, "x"]}, "d": true}'), (2, "{}"))
    asked = spark.createDataFrame([(1, "a.b[0]"), (1, "a.b[1].c"), (1, "a.b[2]"), (1, "d"), (1, "d.e"), (1, "a"), (1, None), (2, "a"), (3, "a"), (1, "d")], "extraction_id long, path string")
    got = sorted((tuple(r) for r in documents.values_at(table, asked).collect()), key=str)
    assert got == sorted([(1, "a.b[0]", "1"), (1, "a.b[1].c", None), (1, "a.b[2]", "x"), (1, "d", "true"), (1, "d", "true"), (1, "d.e", None), (1, "a", None), (1, None, None), (2, "a", None), (3, "a", None)], key=str)


def test_leaves_stay_beside_their_documents(spark):
    """A document's leaves are many times its rows: what is laid over or asked for comes to the document before it is flattened."""
    table = docs(spark, (1, '{"a": {"value": "1"}, "l": [[], {}, [2]]}'), (2, "{}"))
    edits = spark.createDataFrame([(1, 1, "a", "2", 1), (2, 1, "l", "3", 1)], "correction_id long, extraction_id long, field_path string, corrected_value string, created_at int")
    asked = spark.createDataFrame([(1, "l[2][0]"), (2, "a")], "extraction_id long, path string")
    for rows in (documents.overlaid(table, edits), documents.values_at(table, asked)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "schema_of_variant" not in plan
        lines = plan.splitlines()
        deep = [i for i, line in enumerate(lines) if "Generate inline" in line]
        assert any("strategy=shuffle_hash" in line for line in lines[max(deep) :])
    assert {(r["path"], r["value"]) for r in documents.overlaid(table, edits).collect()} == {("a.value", "2"), ("l[2][0]", "2")}
    assert {tuple(r) for r in documents.values_at(table, asked).collect()} == {(1, "l[2][0]", "2"), (2, "a", None)}


def test_flattening_asks_for_no_schemas(spark):
    """A schema is made of all that lies below a value, so a document would be walked once a level."""
    table = docs(spark, (1, '{"a": [], "o": {}, "l": [1, [true, null], {"x": "y"}]}'), (2, "[3]"), (3, "4"))
    leaves = drift.flatten(table, depth=2, lengths=True)
    assert "schemaofvariant" not in leaves._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert {tuple(r) for r in leaves.collect()} == {(1, "a[]", "0"), (1, "l[]", "3"), (1, "l[0]", "1"), (1, "l[1]", "[true,null]"), (1, "l[2]", '{"x":"y"}'), (2, "[]", "1"), (2, "[0]", "3"), (3, "", "4")}
