"""The bill model's tables, derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY, RATE = "decimal(18,2)", "decimal(18,6)"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(of: Column, *names: str) -> Column:
    """names[of], of counting from 0."""
    return F.element_at(F.array(*map(F.lit, names)), of.cast("int") + 1)


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order. Orders of a customer whose keys agree modulo 7 are runs over the same file."""
    orders = load(spark, sf_dir, "orders")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("o_orderkey")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        key.alias("extraction_id"),
        F.sha2(F.concat_ws("-", F.col("o_custkey").cast("string"), (key % 7).cast("string")), 256).alias("file_hash"),
        F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("processing").alias("status"),
        pick(key % 4, "electricity", "natural_gas", "water", "electricity").alias("commodity_type"),
        F.col("n_name").alias("utility_provider"),
        ((key % 101) / 100.0).alias("confidence_score"),
        pick(key % 5, "simple", "standard", "complex", "pathological", "standard").alias("complexity_tier"),
        (key % 9000).cast("int").alias("processing_time_ms"),
        F.col("o_orderdate").alias("created_at"),
        pick(F.col("c_nationkey") % 6, "US", "DE", "GB", "FR", "MX", "ES").alias("country_code"),
        (key % 130).cast("int").alias("billing_days"),
        (key % 3 == 0).alias("has_demand_charges"),
        (key % 4 == 1).alias("has_supplier_split"),
        F.col("o_totalprice").cast(MONEY).alias("stated_total"),
        (key % 8 == 0).alias("minimum_bill_applied"),
    )


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item. Amounts are moved off quantity times rate for some lines: a rounding difference, an
    adjustment within 2 %, a discrepancy, a negative amount."""
    li = load(spark, sf_dir, "lineitem")
    price, quantity = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast("decimal(18,2)")
    case = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")) % 11
    # in whole numbers: cents * 100 by whole units, so four decimals, cut off
    rate = (F.expr("(cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) * 100) div cast(l_quantity as bigint)").cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)")
    off = F.when(case == 1, F.lit("1.015")).when(case == 2, F.lit("1.500")).when(case == 3, F.lit("-1.000")).otherwise(F.lit("1.000")).cast("decimal(5,3)")
    amount = F.round(price * off + F.when(case == 0, F.lit("0.03")).otherwise(F.lit("0.00")).cast("decimal(4,2)"), 2).cast(MONEY)
    return li.select(
        F.col("l_orderkey").alias("extraction_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.when(F.col("l_returnflag") == "A", "energy").when(F.col("l_returnflag") == "R", "fixed").when(F.col("l_suppkey") % 5 == 0, "credit").when(F.col("l_suppkey") % 5 == 1, "demand").otherwise("tax").alias("category"),
        pick(F.col("l_linenumber") % 4, "supply", "distribution", "taxes", "other").alias("charge_section"),
        pick(F.col("l_suppkey") % 3, "supplier", "utility", "government").alias("charge_owner"),
        quantity.alias("quantity"),
        rate.alias("rate"),
        amount.alias("amount"),
        F.round(price * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast(MONEY).alias("amount_net"),
        F.col("l_tax").cast("decimal(4,2)").alias("vat_rate"),
        (case == 4).alias("reverse_charge"),
        case.alias("case_no"),
        F.col("l_shipdate").alias("service_date"),
    )


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a reviewer's change of a field of an extraction."""
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.round(F.col("value"), 2).cast(MONEY)
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("correction_id"),
        (F.col("event_id") * 4 % 15000 + 1).alias("extraction_id"),
        F.concat_ws(".", F.lit("charges"), "event_type", pick(F.col("user_id") % 5, "amount", "rate", "billing_date", "category", "account_number")).alias("field_path"),
        F.when(k % 10 == 0, F.lit(None)).otherwise(value.cast("string")).alias("extracted_value"),
        F.when(k % 10 == 1, F.concat(value.cast("string"), F.lit("X"))).when(k % 10 == 2, F.lit("")).when(k % 10 == 3, F.concat(F.lit("0"), value.cast("string"))).otherwise((value + (k % 7)).cast("string")).alias("corrected_value"),
        F.when(k % 4 == 0, "ocr_confusion").when(k % 4 == 1, "missing_context").when(k % 4 == 2, "").alias("correction_category"),
        pick(F.col("user_id") % 3, "North Power", "City Gas", "Blue Water").alias("utility"),
        pick(F.col("user_id") % 2, "electricity", "natural_gas").alias("commodity"),
        F.col("ts").alias("created_at"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a logged model call."""
    k = F.get_json_object("props", "$.k").cast("int")
    tokens_in, tokens_out = k * 37, k * 11 % 50
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 4 % 15000 + 1).alias("extraction_id"),
        F.col("event_type").alias("stage"),
        pick(F.col("user_id") % 4, "small", "large", "vision", "unlisted").alias("model"),
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        F.when((tokens_in != 0) & (tokens_out != 0), tokens_in + tokens_out).alias("total_tokens"),
        F.when(F.col("event_id") % 17 != 0, F.round(F.col("value") * 10).cast("long")).alias("duration_ms"),
        F.repeat("event_type", k).alias("response"),
        F.col("ts").alias("created_at"),
    )
