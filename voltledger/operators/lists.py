"""Listings, updates and lookups over bills, corrections and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import learn, score


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def in_order(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds place: 1, 2, ... of each row among those of its key, in the order given, which should be without ties."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys, each once however often it is asked for."""
    return rows.join(keys.select(key), key, "left_semi")


def rules(found: DataFrame, active: bool | None = None, category: str | None = None) -> DataFrame:
    """Correction rules, only active (or inactive) ones, only of a category."""
    for column, value in (("active", active), ("category", category)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


def filtered(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns have the values given; a value that is None doesn't apply."""
    for column, value in values.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def list_extractions(bills: DataFrame, commodity: str | None = None, status: str | None = None, tier: str | None = None, offset: int = 0, limit: int = 200) -> DataFrame:
    """Newest first; a filter that is None doesn't apply. tier is the tier that a bill was routed to (confidence_tier)."""
    return page(filtered(bills, commodity_type=commodity, status=status, confidence_tier=tier), [F.desc("created_at"), "extraction_id"], offset, limit)


def list_corrections(corrections: DataFrame, field_path: str | None = None, category: str | None = None) -> DataFrame:
    """Corrections by field path and by their stored category, which is inferred only afterwards where it is missing."""
    return learn.categorized(filtered(corrections, field_path=field_path, correction_category=category))


def review_queue(bills: DataFrame, order: str = "created", offset: int = 0, limit: int = 50) -> DataFrame:
    """Pending bills, newest first, or with order='priority' the lowest score first."""
    first = F.asc("confidence_score") if order == "priority" else F.desc("created_at")
    return page(bills.where("status = 'pending_review'"), [first, "extraction_id"], offset, limit)


def preview(text: str, size: int = 200):
    return F.when(F.length(text) > size, F.concat(F.left(F.col(text), F.lit(size)), F.lit("..."))).otherwise(F.col(text))


def list_calls(calls: DataFrame, stage: str | None = None, model: str | None = None, extraction: int | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest first, with previews; a filter that is None doesn't apply."""
    calls = filtered(calls, stage=stage, model=model, extraction_id=extraction)
    return page(calls.withColumn("preview", preview("response")), [F.desc("created_at"), "call_id"], offset, limit)


def corrections_by_context(corrections: DataFrame, utility: str | None = None, commodity: str | None = None, least: int = 1, fingerprint: str | None = None, field_path: str | None = None) -> DataFrame:
    """Corrections of a context whose field path occurs at least so often among them."""
    corrections = filtered(corrections, utility=utility, commodity=commodity, fingerprint=fingerprint, field_path=field_path)
    often = corrections.groupBy("field_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return corrections.join(often, "field_path", "left_semi")


def latest_per_hash(bills: DataFrame) -> DataFrame:
    newest = Window.partitionBy("file_hash").orderBy(F.desc("created_at"), F.desc("extraction_id"))
    return bills.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def seen_before(bills: DataFrame) -> DataFrame:
    """Files whose latest run was accepted or waits for review: not to be processed again."""
    return latest_per_hash(bills).where(F.col("status").isin("accepted", "pending_review"))


def not_seen(files: DataFrame, bills: DataFrame) -> DataFrame:
    return files.join(seen_before(bills).select("file_hash"), "file_hash", "left_anti")


def previous_run(bills: DataFrame) -> DataFrame:
    """Each run with the one before it on the same file."""
    runs = Window.partitionBy("file_hash").orderBy("created_at", "extraction_id")
    last = F.lag(F.struct("extraction_id", "confidence_score", "status", "stated_total")).over(runs)
    return bills.withColumn("p", last).where("p is not null").select("file_hash", "extraction_id", F.col("p.extraction_id").alias("previous_id"), "confidence_score", F.col("p.confidence_score").alias("previous_score"), "status", F.col("p.status").alias("previous_status"), "stated_total", F.col("p.stated_total").alias("previous_total"))


def runs_before(bills: DataFrame, columns: list[str]) -> DataFrame:
    """extraction_id, previous_id, columns and, as previous_<column>, those of the run before on the same file."""
    runs = Window.partitionBy("file_hash").orderBy("created_at", "extraction_id")
    rows = bills.withColumn("_p", F.lag(F.struct("extraction_id", *columns)).over(runs)).where("_p is not null")
    return rows.select("extraction_id", F.col("_p.extraction_id").alias("previous_id"), *columns, *(F.col(f"_p.{c}").alias(f"previous_{c}") for c in columns))


def approve_green(bills: DataFrame) -> DataFrame:
    s = F.col("confidence_score")
    return bills.withColumn("status", F.when((s != 0) & (s >= 0.90), "accepted").otherwise("partial"))


def upsert(store: DataFrame, new: DataFrame, key: str, changed: list[str]) -> DataFrame:
    """new over store by key: of rows there already only the columns changed are replaced; new keys come in whole."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in store.columns if c != key), F.lit(True).alias("_new"))
    both = store.withColumn("_old", F.lit(True)).join(n, key, "full_outer")
    pick = lambda c: F.when(F.col("_old") & F.coalesce("_new", F.lit(False)), F.col(f"_{c}") if c in changed else F.col(c)).otherwise(F.coalesce(c, f"_{c}"))
    return both.select(key, *(pick(c).alias(c) for c in store.columns if c != key))


def last_edits(corrections: DataFrame) -> DataFrame:
    """Of several edits of a field of a bill the last one."""
    return corrections.groupBy("extraction_id", "field_path").agg(F.max_by(F.struct("correction_id", "corrected_value"), F.struct("created_at", "correction_id")).alias("e")).select("extraction_id", "field_path", "e.correction_id", "e.corrected_value")


def with_context(corrections: DataFrame, bills: DataFrame) -> DataFrame:
    """Corrections of known bills with the bill's provider and commodity."""
    return corrections.drop("utility", "commodity").join(bills.select("extraction_id", F.col("utility_provider").alias("utility"), F.col("commodity_type").alias("commodity")), "extraction_id")


def calls_with_bills(calls: DataFrame, bills: DataFrame) -> DataFrame:
    return calls.join(bills.select("extraction_id", "utility_provider", "status"), "extraction_id", "left")


def banded(bills: DataFrame) -> DataFrame:
    return bills.withColumn("band", score.band(F.col("confidence_score")))
