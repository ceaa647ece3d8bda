"""Bills and calls as they arrive: Structured Streaming versions of the table operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import drift, intake, lists, rules, silver, validate
from ..sources import sinks

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder with type, hash and reason to turn them away."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", per_trigger).load(folder)
    return intake.judged(files)


def first_of_each(files: DataFrame, store: DataFrame | None = None, within: str = "7 days") -> DataFrame:
    """The first file of each content within the time given, and none that the store's latest run settled."""
    once = files.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["file_hash"])
    return once if store is None else once.join(lists.seen_before(store).select("file_hash"), "file_hash", "left_anti")


def arriving_issues(lines: DataFrame, bills: DataFrame) -> DataFrame:
    """The rules of single lines on a stream of charges, against the table of bills."""
    return validate.line_math(lines, bills).unionByName(validate.negative_amounts(lines))


def arriving_rule_issues(rows: DataFrame, on: str, bills: DataFrame) -> DataFrame:
    """All rules of lines or of meters, as on says, on a stream of such rows against the table of bills: what the batch gives."""
    return rules.found_in(rows, on, rules.with_gates(bills))


def upsert_status(batch: DataFrame, store: str, key: str = "extraction_id") -> DataFrame:
    """The store's table (a path) after a batch of status changes: per key the newest of both. The caller writes it under the
    batch's number, so a batch that is run again gives the same table."""
    kept = batch.sparkSession.read.parquet(store)
    both = kept.select(key, "status", "updated_at").unionByName(batch.select(key, "status", "updated_at"))
    return both.groupBy(key).agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"))


def job_status(events: DataFrame) -> DataFrame:
    """The latest status of each job, of several at once the last by name; for update mode."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))


def calls_per_window(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls by stage in windows of created_at; rows later than late behind the newest are left out."""
    return calls.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"), F.round(F.avg("duration_ms"), 0).cast("long").alias("avg_duration_ms")).select(F.col("w.start").alias("start"), "stage", "n_calls", "total_tokens", "avg_duration_ms")


def arriving_drift(batch: DataFrame, batch_id: int, store: str, out: str) -> None:
    """For foreachBatch: documents (extraction_id, file_hash, created_at, document as JSON) against the previous run of the same file, in the
    store (a Parquet path) or earlier in the batch. Changes go to out, the documents to the store, each in a folder of the batch's number, so
    a batch that is run again writes the same; only runs of lower batches count as stored."""
    spark = batch.sparkSession
    new = batch.select("extraction_id", "file_hash", "created_at", "document")
    known = spark.read.schema(T.StructType([*new.schema.fields, T.StructField("batch", T.LongType())])).parquet(store).where(F.col("batch") < batch_id).drop("batch") if batch_id else new.limit(0)
    runs = lists.runs_before(known.join(new.select("file_hash").distinct(), "file_hash", "left_semi").unionByName(new), ["document"])
    pairs = runs.join(new.select("extraction_id"), "extraction_id", "left_semi")
    both = pairs.select("extraction_id", "document").union(pairs.select(F.col("previous_id").alias("extraction_id"), F.col("previous_document").alias("document"))).dropDuplicates(["extraction_id"])
    changes = drift.document_changes(pairs, both.select("extraction_id", F.try_parse_json("document").alias("document")))
    changes.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    new.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")


LAST = "extraction_id long, at long, document string"


def _with_last(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    order = lambda r: (r[1] is not None, r[1] or 0, r[0])
    last = tuple(state.get) if state.exists else None
    if last:
        yield pd.DataFrame([(last[0], key[0], last[1], last[2], True)], columns=["extraction_id", "file_hash", "at", "document", "stored"])
    for rows in chunks:
        for i, at, text in zip(rows["extraction_id"], rows["at"], rows["document"]):
            one = (int(i), None if pd.isna(at) else int(at), text)
            last = one if last is None or order(one) > order(last) else last
        yield rows[["extraction_id", "file_hash", "at", "document"]].assign(stored=False)
    state.update(last)


def with_last_run(documents: DataFrame) -> DataFrame:
    """A stream of documents (extraction_id, file_hash, created_at, document as JSON) and, once for each file of a batch, the newest run that
    came before (stored): keyed state holds one document a file, so a batch reads its own keys only, whatever has come so far. Rows
    pass through chunk by chunk. A null created_at is the oldest; documents without a file_hash or an extraction_id have no runs and are left out."""
    rows = documents.where("file_hash is not null and extraction_id is not null").select("extraction_id", "file_hash", F.unix_micros("created_at").alias("at"), "document")
    out = "extraction_id long, file_hash string, at long, document string, stored boolean"
    both = rows.groupBy("file_hash").applyInPandasWithState(_with_last, out, LAST, "append", GroupStateTimeout.NoTimeout)
    return both.select("extraction_id", "file_hash", F.timestamp_micros("at").alias("created_at"), "document", "stored")


def drift_of_runs(batch: DataFrame, batch_id: int, out: str) -> None:
    """For foreachBatch behind with_last_run: what each new document changed against the run before it, in the batch or stored, into out under the
    batch's number, so that a batch that runs again leaves nothing twice. One that comes late, older than the run stored, is
    compared within its batch only."""
    held = batch.persist(StorageLevel.DISK_ONLY)
    try:
        runs = lists.runs_before(held, ["stored"]).where("NOT stored").select("extraction_id", "previous_id")
        drift.document_changes(runs, held.select("extraction_id", F.try_parse_json("document").alias("document")).dropDuplicates(["extraction_id"])).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    finally:
        held.unpersist()


def latest_status(events: DataFrame, key: str = "extraction_id") -> DataFrame:
    """The newest status of each key on a stream of changes (key, status, updated_at), ties by name; in update mode a batch gives the keys that
    it brings, and reads and writes the state of no others."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"))


def keep_status(batch: DataFrame, batch_id: int, folder: str, stream: str = "status") -> bool:
    """For foreachBatch behind latest_status: adds the batch to the table in folder; False, and nothing written, if the stream's batch is in it already."""
    return sinks.commit(batch, folder, f"{stream}-{batch_id}")


def kept_status(spark: SparkSession, folder: str, key: str = "extraction_id") -> DataFrame:
    """The table that keep_status writes, one row a key, the newest."""
    return latest_status(spark.read.parquet(folder), key)


def arriving_bill_issues(lines: DataFrame, bills: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", sections: list[str] = silver.LISTED["charge_section"]) -> DataFrame:
    """The rules of whole bills, sums of lines included, on a stream of lines (created_at): a bill is judged once none of its lines has come for gap, as
    the watermark of late tells. bills are nested but for what lines tell (with_gates, sections, vat_summary, totals, any_tou). The sums are added up by
    section in the state, so no line is kept. Sums by VAT rate (V15, V16) aren't judged here; lines after the gap count as another bill."""
    owner = F.xxhash64(F.coalesce("charge_owner", F.lit("?")))
    money = lambda c: c.cast(rules.MONEY)
    of = [money(F.sum(F.when(F.col("charge_section") == x, F.col("amount")))).alias(f"_{i}") for i, x in enumerate(sections)]
    sums = lines.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), "extraction_id").agg(money(F.sum("amount")).alias("computed_total"), F.bool_or(F.col("category") == "demand").alias("has_demand_line"), F.min(owner).alias("_a"), F.max(owner).alias("_b"), *of)
    none = lambda kind: F.lit(None).cast(kind)
    cells = F.array(*(F.struct(F.lit(x).alias("charge_section"), none("decimal(4,2)").alias("vat_rate"), F.col(f"_{i}").alias("amount"), none(rules.MONEY).alias("net"), none(rules.MONEY).alias("vat")) for i, x in enumerate(sections)))
    facts = sums.select("extraction_id", "computed_total", "has_demand_line", F.when(F.col("_a") == F.col("_b"), 1).otherwise(2).alias("owners"), cells.alias("cells"))
    return rules.with_computed(facts.join(bills.hint("merge"), "extraction_id")).select("extraction_id", F.inline(rules.issues_of("bills")))
