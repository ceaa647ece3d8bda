"""Extraction results as JSON text into typed rows, and changes of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drift

CHARGES = "struct<charges:array<struct<line_id:string,description:struct<value:string,confidence:double>,category:string,amount:struct<value:string,confidence:double>,date:string>>>"
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]


def _may_be(c: Column, form: str) -> Column:
    """Whether a text can be a date of the format, by its separators and month: a format that fails costs many times this test."""
    if form == "yyyy-MM-dd":  # counted from the end, as a year may be longer
        return (F.substring(c, -3, 1) == "-") & (F.substring(c, -6, 1) == "-")
    mark, month = form[2], form.index("MM") + 1
    return (F.substring(c, 3, 1) == mark) & (F.substring(c, 6, 1) == mark) & F.substring(c, month, 2).between("01", "12")


def any_date(c: Column) -> Column:
    """The first of five formats, in this order, that reads it."""
    return F.coalesce(*(F.when(_may_be(c, f), F.try_to_timestamp(c, F.lit(f)).cast("date")) for f in DATE_FORMATS))


def charge_rows(documents: DataFrame) -> DataFrame:
    """extraction_id, document (JSON text) as one row per charge. Missing confidence counts 0.9, of a missing value 0.0; a
    missing line id is made of the position; category other by default. A charge whose amount is no number is marked
    corrupt rather than dropped; a document that is no JSON has no rows."""
    rows = documents.select("extraction_id", F.posexplode(F.from_json("document", CHARGES)["charges"]).alias("pos", "c"))
    amount = F.col("c.amount.value").try_cast("decimal(18,2)")
    confidence = F.when(F.col("c.amount.value").isNull(), 0.0).otherwise(F.coalesce("c.amount.confidence", F.lit(0.9)))
    return rows.select(
        "extraction_id", F.coalesce("c.line_id", F.format_string("L%03d", F.col("pos") + 1)).alias("line_id"), F.col("c.description.value").alias("description"), F.coalesce("c.category", F.lit("other")).alias("category"),
        amount.alias("amount"), confidence.alias("amount_confidence"), any_date(F.col("c.date")).alias("service_date"), (F.col("c.amount.value").isNotNull() & amount.isNull()).alias("corrupt"),
    )


def rendered(charges: DataFrame) -> DataFrame:
    """Charges as JSON documents, their dates in five formats, some without line ids or confidence."""
    k = F.col("line_number") % 5
    date = F.coalesce(*(F.when(k == i, F.date_format("service_date", f)) for i, f in enumerate(DATE_FORMATS)))  # one a row
    one = F.struct(F.when(k != 0, F.concat(F.lit("X"), F.col("line_number").cast("string"))).alias("line_id"), F.struct(F.col("category").alias("value"), F.lit(0.8).alias("confidence")).alias("description"), F.when(k != 1, F.col("category")).alias("category"), F.struct(F.col("amount").cast("string").alias("value"), F.when(k != 2, F.lit(0.7)).alias("confidence")).alias("amount"), date.alias("date"))
    return charges.groupBy("extraction_id").agg(F.to_json(F.struct(F.collect_list(one).alias("charges"))).alias("document"))


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the non-null values of changes, by key."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def flags(issues: DataFrame, bills: DataFrame) -> DataFrame:
    """Per bill which kinds of rules it passes, and its fatal fields as 'fatal:field', in order."""
    none = lambda *rules: F.coalesce(~F.bool_or(F.col("rule_id").isin(*rules)), F.lit(True))
    fatal = F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") == "fatal", F.concat(F.lit("fatal:"), "field")))), ",")
    return bills.select("extraction_id").join(issues, "extraction_id", "left").groupBy("extraction_id").agg(none("V01").alias("lines_ok"), none("V02", "V03").alias("totals_ok"), none("V06", "V07").alias("units_ok"), none("V08", "V09", "V10", "V12").alias("logic_ok"), fatal.alias("fatal_flags"))


def merged(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two partial extractions (key, value, confidence): per key the value of higher confidence, the first on a tie."""
    both = first.withColumn("o", F.lit(1)).unionByName(second.withColumn("o", F.lit(0)))
    return both.groupBy(*key).agg(F.max(F.struct("confidence", "o", "value")).alias("m")).select(*key, "m.value", "m.confidence")


def never_vanish(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Each document's pages; a document without any has one page 1 without text, quality 0."""
    rows = documents.join(pages, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("page_number", F.lit(1)).alias("page_number"), "text", F.when(F.col("page_number").isNull(), 0.0).otherwise(F.col("quality")).alias("quality"))


def reprocess(ids: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored extractions asked for again whose file is still there."""
    return stored.join(ids.select("extraction_id"), "extraction_id", "left_semi").join(files.select("file_hash"), "file_hash", "left_semi")


def with_period(charges: DataFrame, bills: DataFrame) -> DataFrame:
    """Charges without a period of their own take the bill's."""
    b = bills.select("extraction_id", F.col("period_start").alias("_s"), F.col("period_end").alias("_e"))
    return charges.join(b, "extraction_id", "left").withColumn("period_start", F.coalesce("period_start", "_s")).withColumn("period_end", F.coalesce("period_end", "_e")).drop("_s", "_e")


def weighted_confidence(fields: DataFrame, weights: dict[str, float]) -> DataFrame:
    """fields (extraction_id, kind, confidence): mean by the kind's weight (1 if not listed), and whether it is below 0.7."""
    w = None
    for kind, x in weights.items():
        w = F.when(F.col("kind") == kind, x) if w is None else w.when(F.col("kind") == kind, x)
    w = w.otherwise(1.0)
    mean = F.round(F.sum(w * F.col("confidence")) / F.sum(F.when(F.col("confidence").isNotNull(), w)), 6)
    return fields.groupBy("extraction_id").agg(mean.alias("confidence")).withColumn("low", F.col("confidence") < 0.7)


def values_at(documents: DataFrame, asked: DataFrame, depth: int = 12) -> DataFrame:
    """asked (extraction_id, path) with value: what the document has at the path, which comes in a column, keys joined by dots and places in
    arrays as [i]; null where it has nothing or no single value there, and for a null path."""
    wanted = asked.select("extraction_id", "path")
    by_document = wanted.where("path is not null").groupBy("extraction_id").agg(F.collect_set("path").alias("asked"))
    # leaves that nobody asks for go no further, and documents, the wider side, aren't sorted
    held = documents.select("extraction_id", "document").join(by_document.hint("shuffle_hash"), "extraction_id")
    leaves = drift.flatten(held, ["extraction_id", "asked"], depth=depth).where(F.expr("array_contains(asked, path)"))
    found = leaves.groupBy("extraction_id", "path").agg(F.max("value").alias("value"))
    return wanted.hint("merge").join(found.hint("merge"), ["extraction_id", "path"], "left")


def overlaid(documents: DataFrame, corrections: DataFrame, depth: int = 12) -> DataFrame:
    """extraction_id, path, value, corrected: the leaves of documents with the last correction of each field laid over them, at its
    field_path and `.value`. A correction replaces all that is at its path and adds paths that the document lacks; one whose path leads
    through a single value or an array is passed over. Corrections of unknown documents are left out. A document's corrections, one a
    field, come together and go with it; its leaves stay where it is."""
    edits = corrections.groupBy("extraction_id", "field_path").agg(F.max_by("corrected_value", F.struct("created_at", "correction_id")).alias("value"))
    edits = edits.where("field_path is not null").select("extraction_id", F.concat("field_path", F.lit(".value")).alias("path"), "value")
    by_document = edits.groupBy("extraction_id").agg(F.collect_list("path").alias("edited"))
    # corrections meet documents, not their leaves, which are many times as many rows
    held = documents.select("extraction_id", "document").join(by_document.hint("shuffle_hash"), "extraction_id", "left")
    leaves = drift.flatten(held, ["extraction_id", "edited"], depth=depth)
    base = F.concat(F.substring_index("path", "[", 1), F.lit("."))
    changed = documents.select("extraction_id", "document").join(by_document.hint("shuffle_hash"), "extraction_id")
    blocked = drift.flatten(changed, ["extraction_id", "edited"], depth=depth).select("extraction_id", F.explode(F.filter("edited", lambda e: F.startswith(e, base))).alias("path")).distinct()
    known = changed.select("extraction_id").distinct()
    laid = edits.join(blocked.hint("merge"), ["extraction_id", "path"], "left_anti").join(known.hint("merge"), "extraction_id", "left_semi")
    replaced = F.exists("edited", lambda e: (F.col("path") == e) | F.startswith(F.col("path"), F.concat(e, F.lit("."))) | F.startswith(F.col("path"), F.concat(e, F.lit("["))))
    stay = leaves.where(~F.coalesce(replaced, F.lit(False))).select("extraction_id", "path", "value", F.lit(False).alias("corrected"))
    return stay.unionByName(laid.select("extraction_id", "path", "value", F.lit(True).alias("corrected")))


def reviewed(bills: DataFrame, corrections: DataFrame) -> DataFrame:
    """bills, those with a correction as reviewed."""
    named = corrections.select("extraction_id").distinct().withColumn("_c", F.lit(True))
    return bills.join(named.hint("merge"), "extraction_id", "left").withColumn("status", F.when(F.col("_c"), "reviewed").otherwise(F.col("status"))).drop("_c")
