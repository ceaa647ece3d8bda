"""Counts, costs and statistics over bills, corrections and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import dims


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def call_stats_by_stage(calls: DataFrame) -> DataFrame:
    mean = F.round(F.avg("duration_ms"), 0).cast("long")
    return calls.groupBy("stage").agg(F.count(F.lit(1)).alias("n_calls"), F.when(mean != 0, mean).alias("avg_duration_ms"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def call_stats_by_model(calls: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total_tokens", "input_tokens", "output_tokens")]
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), *sums)


def call_cost(calls: DataFrame) -> DataFrame:
    """Cost by model, to 6 places, and (model null) of all, summed before rounding, to 4."""
    price = F.broadcast(dims.prices(calls.sparkSession))
    rows = calls.join(price, "model", "left")
    default_in, default_out = (F.lit(x).cast("decimal(9,6)") for x in dims.DEFAULT_PRICE)
    cost = F.coalesce("input_tokens", F.lit(0)) * F.coalesce("price_in", default_in) + F.coalesce("output_tokens", F.lit(0)) * F.coalesce("price_out", default_out)
    sums = rows.withColumn("cost", cost.cast("decimal(28,6)")).rollup("model").agg(F.sum("cost").alias("c"), F.grouping("model").alias("all"))
    exact = F.col("c") * F.lit("0.001").cast("decimal(4,3)")
    return sums.select("model", F.when(F.col("all") == 1, F.round(exact.cast("decimal(38,9)"), 4)).otherwise(F.round(exact.cast("decimal(38,9)"), 6)).cast("decimal(18,6)").alias("cost"))


def correction_stats(corrections: DataFrame) -> DataFrame:
    """By category (none: uncategorized), by field path, and in all, from one pass."""
    rows = corrections.select(F.coalesce(F.nullif("correction_category", F.lit("")), F.lit("uncategorized")).alias("category"), "field_path")
    return rows.groupingSets([["category"], ["field_path"], []], "category", "field_path").agg(F.count(F.lit(1)).alias("n"))


def top_fields(corrections: DataFrame, k: int = 10) -> DataFrame:
    return count_by(corrections, "field_path").orderBy(F.desc("n"), "field_path").limit(k)


def field_path_groups(corrections: DataFrame, k: int = 5, utility: str | None = None, commodity: str | None = None) -> DataFrame:
    """Per field path its count and the newest k examples, in one pass; of one utility or commodity if given. The most frequent
    first, ties by path."""
    for column, value in (("utility", utility), ("commodity", commodity)):
        corrections = corrections if value is None else corrections.where(F.col(column) == value)
    newest = Window.partitionBy("field_path").orderBy(F.desc("created_at"), F.desc("correction_id"))
    examples = corrections.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= k)
    text = F.concat_ws(">", F.coalesce("extracted_value", F.lit("∅")), "corrected_value")
    lists = examples.groupBy("field_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"]), "|").alias("examples"))
    return count_by(corrections, "field_path").join(lists, "field_path").orderBy(F.desc("n"), "field_path")


def correction_rules(corrections: DataFrame, least: int = 2, k: int = 5) -> DataFrame:
    """Per field path: total, active, most frequent category (ties: first by name), top k pairs with counts, last change."""
    pairs = corrections.groupBy("field_path", F.coalesce("extracted_value", F.lit("∅")).alias("e"), F.coalesce("corrected_value", F.lit("∅")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("field_path").orderBy(F.desc("n"), "e", "c")
    top = pairs.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k)
    text = F.format_string("%s>%s x%d", "e", "c", "n")
    top = top.groupBy("field_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"]), "|").alias("patterns"))
    category = F.mode(F.coalesce(F.nullif("correction_category", F.lit("")), F.lit("other")), True)
    total = corrections.groupBy("field_path").agg(F.count(F.lit(1)).alias("total"), category.alias("category"), F.max("created_at").alias("last_at"))
    return total.join(top, "field_path").select("field_path", "total", (F.col("total") >= least).alias("active"), "category", "patterns", "last_at")


def rules_summary(corrections: DataFrame, least: int = 2) -> DataFrame:
    n = count_by(corrections, "field_path")
    return n.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") >= least).alias("active"), F.count_if(F.col("n") < least).alias("pending"))


def rule_candidates(corrections: DataFrame, least: int = 5, examples: int = 3) -> DataFrame:
    """Field paths with at least so many corrections; over the newest examples' differences (corrected less extracted): all
    over 0 under-extracted, all below over-extracted; else by the path's name, else generic."""
    newest = Window.partitionBy("field_path").orderBy(F.desc("created_at"), F.desc("correction_id"))
    off = F.expr("try_cast(corrected_value as decimal(18,2)) - try_cast(extracted_value as decimal(18,2))")
    # counted and cut to the newest before the shuffle, so that a frequent path isn't gathered as a whole
    often = corrections.groupBy("field_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = corrections.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= examples).join(often, "field_path")
    sums = rows.withColumn("off", off).groupBy("field_path", "n").agg(F.count("off").alias("k"), F.count(F.lit(1)).alias("all"), F.min("off").alias("lo"), F.max("off").alias("hi"), F.round(F.sum("off") / F.count("off"), 2).cast("decimal(18,2)").alias("mean"))
    numeric = F.col("k") == F.col("all")
    kind = F.when(numeric & (F.col("lo") > 0), "under_extracted").when(numeric & (F.col("hi") < 0), "over_extracted").when(F.col("field_path").rlike("category|section"), "classification").otherwise("generic")
    return sums.select("field_path", "n", kind.alias("suggestion"), F.when(kind == "under_extracted", F.col("mean")).when(kind == "over_extracted", F.col("mean")).alias("mean_off"))


def kpi(bills: DataFrame) -> DataFrame:
    """Per month and commodity: bills, share accepted, share with a score below 0.7, mean score."""
    month = F.date_format("created_at", "yyyy-MM")
    return bills.groupBy(month.alias("month"), "commodity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("status") == "accepted") / F.count(F.lit(1)), 6).alias("accept_rate"), F.round(F.count_if(F.col("confidence_score") < 0.7) / F.count(F.lit(1)), 6).alias("low_rate"))


def kpi_report(bills: DataFrame, fields: DataFrame, changes: DataFrame, calls: DataFrame, review_cost: str = "2.00", compute_cost: str = "0.01") -> DataFrame:
    """Per month and commodity of bills (extraction_id, created_at, commodity_type, confidence_tier, known_format): n_bills, auto_accept_rate,
    format_coverage, fatal_rate and field_accuracy (of fields, a row a field with corrected and fatal: the share of fatal fields
    corrected, and of fields not corrected), drift_rate (of changes, a row a field of a second run with changed), blended_cost (mean of what
    calls cost, computing, and a review for bills that aren't accepted by themselves). A rate of nothing is null."""
    per = lambda rows, *sums: rows.groupBy("extraction_id").agg(*sums).hint("merge")
    count = lambda test, name: F.count_if(test).alias(name)
    f = per(fields, F.count(F.lit(1)).alias("_f"), count(F.col("fatal"), "_ff"), count(F.col("corrected"), "_c"), count(F.col("corrected") & F.col("fatal"), "_cf"))
    d = per(changes, F.count(F.lit(1)).alias("_d"), count(F.col("changed"), "_dc"))
    c = per(calls, F.sum("cost").alias("_cost"))
    rows = bills.hint("merge").join(f, "extraction_id", "left").join(d, "extraction_id", "left").join(c, "extraction_id", "left")
    accepted = F.col("confidence_tier") == "auto_accept"
    money = lambda x: F.lit(x).cast("decimal(18,6)")
    cost = F.coalesce(F.col("_cost").cast("decimal(18,6)"), money("0")) + money(compute_cost) + F.when(F.coalesce(accepted, F.lit(False)), money("0")).otherwise(money(review_cost))
    rate = lambda a, b, name: F.round(F.try_divide(F.sum(a), F.sum(b)), 6).alias(name)
    n = F.count(F.lit(1))
    return rows.groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), "commodity_type").agg(
        n.alias("n_bills"), F.round(F.count_if(accepted) / n, 6).alias("auto_accept_rate"), F.round(F.count_if("known_format") / n, 6).alias("format_coverage"),
        rate("_cf", "_ff", "fatal_rate"), F.round(1 - F.try_divide(F.sum("_c"), F.sum("_f")), 6).alias("field_accuracy"), rate("_dc", "_d", "drift_rate"), F.round(F.sum(cost) / n, 4).cast("double").alias("blended_cost"),
    )
