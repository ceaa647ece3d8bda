"""Billing arithmetic over time: ratchets, blocks, budget balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def amount_sanity(bills: DataFrame, decimal_separator: Column) -> DataFrame:
    """Totals that no bill has, above 1,000,000 or below 0.01 (fatal), and amounts as printed (original_string) whose digits behind the
    decimal separator are not 0, 2, 3 or 4 (warning). Nulls give nothing."""
    extreme = bills.where((F.col("stated_total") > 1_000_000) | (F.col("stated_total") < F.lit("0.01").cast("decimal(4,2)"))).select("extraction_id", F.lit("totals.total_amount_due").alias("field"), F.lit("fatal").alias("severity"))
    shown = bills.withColumn("_digits", F.length(F.regexp_replace(F.element_at(F.split("original_string", F.concat(F.lit("\\Q"), decimal_separator, F.lit("\\E"))), -1), r"\D", "")))
    odd = shown.where(F.contains("original_string", decimal_separator) & ~F.col("_digits").isin(0, 2, 3, 4)).select("extraction_id", F.lit("original_string").alias("field"), F.lit("warning").alias("severity"))
    return extreme.union(odd)


def structured_first(structured: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_id, total, differs: the total of the structured attachment (doc_id, grand_total), else what was seen (doc_id, seen_total); whether
    both are there and over 0.50 apart."""
    rows = structured.select("doc_id", "grand_total").join(seen, "doc_id", "full_outer")
    return rows.select("doc_id", F.coalesce("grand_total", "seen_total").alias("total"), F.coalesce(F.abs(F.col("grand_total") - F.col("seen_total")) > 0.50, F.lit(False)).alias("differs"))


def monthly_demand(orders: DataFrame) -> DataFrame:
    """meter, month (months since year 0), demand: a dense row per meter and month from its first to its last."""
    o = orders.select((F.col("o_custkey") % 40).alias("meter"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    known = o.groupBy("meter", "month").agg(F.max("v").alias("demand"))
    spine = o.groupBy("meter").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("meter", F.explode(F.sequence("a", "b")).alias("month"))
    return spine.join(known.hint("merge"), ["meter", "month"], "left")


def demand_ratchet(months: DataFrame, share: str = "0.80") -> DataFrame:
    """Billed demand: the month's own, or a share of the highest of the 11 months before if that is more."""
    before = Window.partitionBy("meter").orderBy("month").rowsBetween(-11, -1)
    top = F.round(F.max("demand").over(before) * F.lit(share).cast("decimal(4,2)"), 2)
    zero = F.lit(0).cast("decimal(18,2)")
    return months.select("meter", "month", F.greatest(F.coalesce("demand", zero), F.coalesce(top, zero)).cast("double").alias("billed"))


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0.0, 100.0, 0.10), (2, 100.0, 500.0, 0.15), (3, 500.0, float("inf"), 0.20)], "block int, lo double, hi double, price double")


def block_allocation(usage: DataFrame, table: DataFrame) -> DataFrame:
    """How much of each bill's quantity falls into each block."""
    rows = usage.join(F.broadcast(table), F.col("quantity") > F.col("lo"))
    part = F.least("quantity", "hi") - F.col("lo")
    return rows.select("extraction_id", "block", part.alias("part"), F.round(part * F.col("price"), 2).alias("cost"))


def budget_balance(orders: DataFrame) -> DataFrame:
    """Per account the running difference of actual and an even budget of 150,000 a bill."""
    run = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    off = F.col("o_totalprice").cast("decimal(18,2)") - F.lit("150000.00").cast("decimal(18,2)")
    return orders.select("o_orderkey", "o_custkey", F.sum(off).over(run).cast("double").alias("balance"))


def account_balance(accounts: DataFrame) -> DataFrame:
    """Previous balance, payments (negative), late fees and current charges against the amount due, beyond 0.01."""
    zero = F.lit(0).cast("decimal(18,2)")
    due = F.coalesce("previous_balance", zero) + F.coalesce("payments", zero) + F.coalesce("late_fees", zero) + F.col("current_charges")
    return accounts.select("extraction_id", due.cast("decimal(18,2)").alias("expected"), "amount_due").where("abs(expected - amount_due) > 0.01")


def contracted_capacity(meters: DataFrame, charges: DataFrame) -> DataFrame:
    """Demand above the contracted capacity on bills without a charge for it."""
    over = meters.where("demand_value > contracted_value").select("extraction_id", "demand_value", "contracted_value")
    return over.join(charges.where("category = 'demand'").select("extraction_id"), "extraction_id", "left_anti")


def single_meter_linkage(charges: DataFrame, meters: DataFrame) -> DataFrame:
    """Charges without a meter take their bill's, if it has just one."""
    only = meters.groupBy("extraction_id").agg(F.count(F.lit(1)).alias("n"), F.min("meter_number").alias("only")).where("n = 1")
    return charges.join(only.select("extraction_id", "only"), "extraction_id", "left").withColumn("meter_number", F.coalesce("meter_number", "only")).drop("only")


def sewer_cap(months: DataFrame) -> DataFrame:
    """account, year, month, usage: billed sewer volume, at most the mean of the winter months (December to March) that
    ended in the year; without winter months, the usage."""
    season = F.when(F.col("month") == 12, F.col("year") + 1).otherwise(F.col("year"))
    winter = months.where("month in (12, 1, 2, 3)").groupBy("account", season.alias("year")).agg(F.round(F.avg("usage"), 2).alias("cap"))
    return months.join(winter, ["account", "year"], "left").select("account", "year", "month", F.least("usage", F.coalesce("cap", "usage")).alias("billed"))


# Names of time-of-use periods in several markets.
TOU_NAMES = [("ht", "peak"), ("nt", "off_peak"), ("hp", "peak"), ("hc", "off_peak"), ("p1", "peak"), ("p2", "shoulder"), ("p3", "off_peak"), ("p4", "off_peak"), ("p5", "off_peak"), ("p6", "off_peak"), ("f1", "peak"), ("f2", "shoulder"), ("f3", "off_peak"), ("day", "peak"), ("night", "off_peak")]
# The colours of a French tariff stand before or behind its full and low hours.
TOU_NAMES += [(name, std) for hours, std in (("hp", "peak"), ("hc", "off_peak")) for colour in ("bleu", "blanc", "rouge") for name in (f"{hours} {colour}", f"{colour} {hours}")]


def tou_periods(periods: DataFrame) -> DataFrame:
    """Consumption by meter and standard period; unknown names stay as they are."""
    names = F.broadcast(periods.sparkSession.createDataFrame(TOU_NAMES, "name string, std string"))
    rows = periods.join(names, F.lower(F.trim("period")) == F.col("name"), "left")
    return rows.groupBy("meter_number", F.coalesce("std", "period").alias("std_period")).agg(F.sum("consumption").alias("consumption"))


def net_metering(meters: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Bills whose net isn't total less generation."""
    return meters.where(F.abs(F.col("total") - F.col("generation") - F.col("net")) > tolerance)


def candidate_confidence(corrections: DataFrame, bills: DataFrame) -> DataFrame:
    """Corrections per utility, path and category as a share of that utility's bills."""
    n_bills = bills.groupBy(F.col("utility_provider").alias("utility")).agg(F.count(F.lit(1)).alias("n_bills"))
    n = corrections.groupBy("utility", "field_path", "category").agg(F.countDistinct("extraction_id").alias("n"))
    return n.join(n_bills, "utility").select("utility", "field_path", "category", "n", F.round(F.col("n") / F.col("n_bills"), 6).alias("confidence"))


# Words of a charge for use above the contracted capacity.
EXCESS = ["excess", "exceso", "dépassement", "überschreitung"]
#: Years that contracts and readings are sorted into; what lies outside goes to the first or the last.
YEARS = (2000, 2050)


def contract_in_force(readings: DataFrame, contracts: DataFrame, day: str = "day") -> DataFrame:
    """readings (meter_number, a day, any others) with the columns of the contract (contract_id, meter_number, valid_from, valid_to, others)
    of their meter that is in force that day, both ends included; of several the last begun, ties by the larger contract_id;
    null columns if none. No valid_from means since ever, no valid_to until further notice. Columns of contracts but for
    meter_number shouldn't be those of readings.

    Contracts are laid into the years that they are valid in, so that readings meet those of their meter and year only, however
    many contracts a meter has had. Of overlapping contracts the one that counts is chosen as rows meet, by key of the reading."""
    year = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.year(c), F.lit(YEARS[0])), F.lit(YEARS[1])))
    first, last = F.coalesce(year("valid_from"), F.lit(YEARS[0])), F.coalesce(year("valid_to"), F.lit(YEARS[1]))
    terms = contracts.where("meter_number is not null and coalesce(valid_from <= valid_to, true)").withColumn("_year", F.explode(F.sequence(first, last)))
    mine = [c for c in contracts.columns if c != "meter_number"]
    packed = terms.select("meter_number", "_year", F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("_from"), *mine).alias("_c"))
    places = readings.select("meter_number", day).distinct().where(F.col(day).isNotNull())
    met = places.withColumn("_year", year(day)).hint("merge").join(packed.hint("merge"), ["meter_number", "_year"])
    valid = (F.col("_c._from") <= F.col(day)) & F.coalesce(F.col(day) <= F.col("_c.valid_to"), F.lit(True))
    chosen = met.where(valid).groupBy("meter_number", day).agg(F.max_by("_c", F.struct("_c._from", "_c.contract_id")).alias("_c"))
    return readings.hint("merge").join(chosen.hint("merge"), ["meter_number", day], "left").select(*readings.columns, *(F.col(f"_c.{c}") for c in mine))


def capacity_exceeded(readings: DataFrame, contracts: DataFrame, charges: DataFrame) -> DataFrame:
    """Readings (extraction_id, meter_number, day, demand_value) above the capacity of the contract in force, on bills without a charge whose
    description names it, unless the contract says that it is known (exceeded). Without a contract there is no warning."""
    over = contract_in_force(readings, contracts).where("demand_value > capacity AND NOT coalesce(exceeded, false)")
    named = F.lower("description").rlike("|".join(EXCESS))
    return over.hint("merge").join(charges.where(named).select("extraction_id").distinct().hint("merge"), "extraction_id", "left_anti")
