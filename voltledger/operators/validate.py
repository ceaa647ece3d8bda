"""Validation rules. Each takes model tables and returns issues: extraction_id, rule_id, field, severity, expected, actual.

A missing operand never gives an issue. Money is decimal; products are rounded half up to cents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims
from . import silver

MONEY = "decimal(18,2)"
ISSUES = ["extraction_id", "rule_id", "field", "severity", "expected", "actual"]


def cents(c: Column) -> Column:
    return F.round(c.cast("decimal(38,8)"), 2).cast(MONEY)


def with_tolerance(rows: DataFrame, country: str = "country_code") -> DataFrame:
    """Adds base and tax tolerance of the country; none counts as US, an unlisted one takes the default."""
    table = F.broadcast(dims.tolerances(rows.sparkSession))
    joined = rows.join(table, F.coalesce(F.col(country), F.lit("US")) == table["country"], "left").drop("country")
    base, tax = (F.lit(x).cast("decimal(4,2)") for x in dims.DEFAULT_TOLERANCE)
    return joined.withColumn("base", F.coalesce("base", base)).withColumn("tax", F.coalesce("tax", tax))


def issues(rows: DataFrame, rule: str, field: Column, severity: Column, expected: Column, actual: Column) -> DataFrame:
    """Rows whose severity is not null, as issues."""
    text = lambda c: c.cast("string")
    return rows.select("extraction_id", F.lit(rule).alias("rule_id"), field.alias("field"), severity.alias("severity"), text(expected).alias("expected"), text(actual).alias("actual")).where("severity is not null")


def of_charges(charges: DataFrame, bills: DataFrame) -> DataFrame:
    return charges.join(with_tolerance(bills.select("extraction_id", "country_code")), "extraction_id")


def line_math(charges: DataFrame, bills: DataFrame) -> DataFrame:
    """Quantity times rate against the amount: within tolerance nothing; a fixed charge above it info (a minimum bill);
    within 2 % of the amount info (an adjustment); else a warning."""
    rows = of_charges(charges, bills)
    expected = cents(F.col("quantity") * F.col("rate"))
    off = F.abs(expected - F.col("amount"))
    severity = F.when(off <= F.col("base"), None).when((F.col("amount") > expected) & (F.col("category") == "fixed"), "info").when(off <= F.lit("0.02").cast("decimal(3,2)") * F.col("amount"), "info").when(off > F.col("base"), "warning")
    return issues(rows, "V01", F.concat(F.lit("charges."), F.col("line_number").cast("string"), F.lit(".amount")), severity, expected, F.col("amount"))


def section_sums(charges: DataFrame) -> DataFrame:
    """Amounts by section and, with a null section, by bill."""
    return charges.rollup("extraction_id", "charge_section").agg(F.sum("amount").cast(MONEY).alias("computed"), F.count(F.lit(1)).alias("n_lines")).where("extraction_id is not null")


def section_totals(charges: DataFrame, stated: DataFrame, bills: DataFrame) -> DataFrame:
    """Section sums against the stated subtotals (extraction_id, charge_section, subtotal), twice the tolerance."""
    sums = charges.groupBy("extraction_id", "charge_section").agg(F.sum("amount").cast(MONEY).alias("computed"))
    rows = with_tolerance(sums.join(stated, ["extraction_id", "charge_section"]).join(bills.select("extraction_id", "country_code"), "extraction_id"))
    severity = F.when(F.abs(F.col("computed") - F.col("subtotal")) > 2 * F.col("base"), "warning")
    return issues(rows, "V02", F.concat(F.lit("totals."), "charge_section"), severity, F.col("computed"), F.col("subtotal"))


def current_charges(charges: DataFrame, bills: DataFrame) -> DataFrame:
    """All lines against the stated total, four times the tolerance; info on a minimum bill."""
    sums = charges.groupBy("extraction_id").agg(F.sum("amount").cast(MONEY).alias("computed"))
    rows = with_tolerance(bills.join(sums, "extraction_id"))
    severity = F.when(F.abs(F.col("computed") - F.col("stated_total")) > 4 * F.col("base"), F.when(F.col("minimum_bill_applied"), "info").otherwise("warning"))
    return issues(rows, "V03", F.lit("totals.current_charges"), severity, F.col("computed"), F.col("stated_total"))


def meter_reads(meters: DataFrame) -> DataFrame:
    moved = (F.col("current_read") - F.col("previous_read")) * F.coalesce("multiplier", F.lit(1.0))
    return issues(meters, "V04", F.lit("meters.consumption"), F.when(F.abs(moved - F.col("raw_value")) > 1, "warning"), moved, F.col("raw_value"))


def tou_total(meters: DataFrame, periods: DataFrame) -> DataFrame:
    """Time-of-use periods of each meter against its consumption."""
    sums = periods.groupBy("extraction_id", "meter_number").agg(F.sum(F.coalesce("consumption", F.lit(0.0))).alias("tou"))
    rows = meters.join(sums, ["extraction_id", "meter_number"])
    return issues(rows, "V05", F.lit("meters.tou"), F.when(F.abs(F.col("tou") - F.col("raw_value")) > 1, "warning"), F.col("tou"), F.col("raw_value"))


def unit_mismatch(meters: DataFrame, bills: DataFrame) -> DataFrame:
    """Gas units on electricity (V06), and electric units on gas billed in the US (V07)."""
    rows = meters.join(bills.select("extraction_id", "commodity_type", "country_code"), "extraction_id")
    unit = F.lower("raw_unit")
    rule = F.when((F.col("commodity_type") == "electricity") & unit.isin("therms", "ccf", "mcf", "dekatherms"), "V06").when((F.col("commodity_type") == "natural_gas") & unit.isin("kwh", "kw") & (F.coalesce("country_code", F.lit("US")) == "US"), "V07")
    rows = rows.withColumn("rule", rule).where("rule is not null")
    return rows.select("extraction_id", F.col("rule").alias("rule_id"), F.lit("meters.unit").alias("field"), F.lit("fatal").alias("severity"), F.col("commodity_type").alias("expected"), F.col("raw_unit").alias("actual"))


def billing_days(bills: DataFrame) -> DataFrame:
    days = F.col("billing_days")
    return issues(bills, "V08", F.lit("invoice.billing_days"), F.when((days < 15) | (days > 95), "warning"), F.lit("15-95"), days)


def negative_amounts(charges: DataFrame) -> DataFrame:
    bad = (F.col("amount") < 0) & ~F.col("category").isin("credit", "adjustment")
    return issues(charges, "V09", F.concat(F.lit("charges."), F.col("line_number").cast("string"), F.lit(".amount")), F.when(bad, "warning"), F.lit(">=0"), F.col("amount"))


def demand_missing(charges: DataFrame, bills: DataFrame) -> DataFrame:
    rows = bills.where("has_demand_charges").join(charges.where("category = 'demand'").select("extraction_id"), "extraction_id", "left_anti")
    return issues(rows, "V10", F.lit("charges"), F.lit("warning"), F.lit("demand charge"), F.lit("none"))


def single_owner(charges: DataFrame, bills: DataFrame) -> DataFrame:
    """Supplier split flagged, but at most one owner (a missing owner counts as one)."""
    owners = charges.groupBy("extraction_id").agg(F.countDistinct(F.coalesce("charge_owner", F.lit("?"))).alias("owners"))
    rows = bills.where("has_supplier_split").join(owners, "extraction_id", "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    return issues(rows, "V12", F.lit("charges.charge_owner"), F.when(F.col("owners") <= 1, "warning"), F.lit("2"), F.col("owners"))


def vat_lines(charges: DataFrame) -> DataFrame:
    """Net times rate against VAT (V13, error beyond 0.05; VAT on a reverse-charge line a warning); net plus VAT against
    gross (V14). Rates over 1 are percentages."""
    rows = charges.withColumn("fraction", F.when(F.col("vat_rate") > 1, F.col("vat_rate") / 100).otherwise(F.col("vat_rate")))
    field = F.concat(F.lit("charges."), F.col("line_number").cast("string"))
    expected = cents(F.col("amount_net") * F.col("fraction"))
    severity = F.when(F.col("reverse_charge"), F.when(F.col("vat_amount") != 0, "warning")).when(F.abs(expected - F.col("vat_amount")) > F.lit("0.05").cast("decimal(4,2)"), "error")
    gross = F.col("amount_net") + F.col("vat_amount")
    over = F.when(F.abs(gross - F.col("amount_gross")) > F.lit("0.05").cast("decimal(4,2)"), "error")
    return issues(rows, "V13", field, severity, expected, F.col("vat_amount")).union(issues(rows, "V14", field, over, gross.cast(MONEY), F.col("amount_gross")))


def vat_by_rate(charges: DataFrame) -> DataFrame:
    full = charges.where("amount_net is not null and vat_rate is not null and vat_amount is not null")
    return full.groupBy("extraction_id", "vat_rate").agg(F.sum("amount_net").cast(MONEY).alias("base_sum"), F.sum("vat_amount").cast(MONEY).alias("vat_sum"))


def vat_summary(charges: DataFrame, summary: DataFrame) -> DataFrame:
    """Sums per rate against the summary (extraction_id, vat_rate, stated_base, stated_vat): V15 base, V16 VAT, beyond 0.10.
    Rates without lines aren't checked."""
    rows = vat_by_rate(charges).join(summary, ["extraction_id", "vat_rate"])
    field, limit = F.concat(F.lit("vat_summary."), F.col("vat_rate").cast("string")), F.lit("0.10").cast("decimal(4,2)")
    one = lambda rule, a, b: issues(rows, rule, field, F.when(F.abs(F.col(a) - F.col(b)) > limit, "warning"), F.col(a), F.col(b))
    return one("V15", "base_sum", "stated_base").union(one("V16", "vat_sum", "stated_vat"))


#: Countries whose bills carry VAT by line: those of the European regime, the British and the Mexican one.
VAT_COUNTRIES = ["DE", "FR", "ES", "IT", "NL", "UK", "GB", "MX"]


def under_vat(rows: DataFrame, bills: DataFrame) -> DataFrame:
    """The rows of bills under a VAT regime; a missing country counts as US and has none."""
    return rows.join(bills.where(F.col("country_code").isin(VAT_COUNTRIES)).select("extraction_id"), "extraction_id", "left_semi")


def of_gas(rows: DataFrame, bills: DataFrame) -> DataFrame:
    return rows.join(bills.where("commodity_type = 'natural_gas'").select("extraction_id"), "extraction_id", "left_semi")


def vat_total(totals: DataFrame) -> DataFrame:
    """total_net and total_vat against total_gross, beyond 0.05."""
    expected = (F.col("total_net") + F.col("total_vat")).cast(MONEY)
    return issues(totals, "V17", F.lit("totals.total_gross"), F.when(F.abs(expected - F.col("total_gross")) > F.lit("0.05").cast("decimal(4,2)"), "error"), expected, F.col("total_gross"))


def mexican_vat(totals: DataFrame, bills: DataFrame) -> DataFrame:
    """Mexican bills whose total_gross isn't total_net with 16 % on it, within the country's tolerance."""
    rows = with_tolerance(totals.join(bills.where("country_code = 'MX'").select("extraction_id", "country_code"), "extraction_id"))
    expected = F.round(F.col("total_net") * F.lit("1.16").cast("decimal(4,2)"), 2)
    return rows.where(F.abs(expected - F.col("total_gross")) > F.col("base")).select("extraction_id", expected.cast("double").alias("expected"))


def any_tou(bills: DataFrame, periods: DataFrame) -> DataFrame:
    """extraction_id, any_tou: whether any meter has time-of-use rows; bills without meters count as having none."""
    has = periods.groupBy("extraction_id").agg(F.bool_or(F.col("consumption").isNotNull()).alias("x"))
    return bills.select("extraction_id").join(has, "extraction_id", "left").select("extraction_id", F.coalesce("x", F.lit(False)).alias("any_tou"))


def tou_missing(bills: DataFrame, periods: DataFrame) -> DataFrame:
    """Bills flagged has_tou without a time-of-use row."""
    rows = bills.where("has_tou").join(periods.select("extraction_id"), "extraction_id", "left_anti")
    return issues(rows, "V11", F.lit("meters.tou_breakdown"), F.lit("warning"), F.lit("time-of-use rows"), F.lit("none"))


def category_tolerance(charges: DataFrame, bills: DataFrame, special: list[str]) -> DataFrame:
    """Charges with their tolerance: the country's, doubled for taxes and riders in the countries with a special rule."""
    rows = of_charges(charges, bills)
    twice = F.col("category").isin("tax", "rider") & F.coalesce("country_code", F.lit("US")).isin(special)
    return rows.withColumn("tolerance", F.when(twice, F.col("base") * 2).otherwise(F.col("base")).cast("decimal(5,2)"))


def gas_factors(meters: DataFrame) -> DataFrame:
    """V18: calorific value in 8 to 14, correction factor in 0.9 to 1.1 unless 1. V19: volume times both against energy,
    over 2 % off; energy 0 is infinitely off."""
    cv, vcf, energy = F.col("calorific_value"), F.col("volume_correction_factor"), F.col("consumption_energy")
    one = issues(meters, "V18", F.lit("meters.calorific_value"), F.when((cv < 8) | (cv > 14), "warning"), F.lit("8-14"), cv)
    two = issues(meters, "V18", F.lit("meters.volume_correction_factor"), F.when((vcf != 1) & ((vcf < 0.9) | (vcf > 1.1)), "warning"), F.lit("0.9-1.1"), vcf)
    computed = F.col("consumption_volume") * F.coalesce(vcf, F.lit(1.0)) * cv
    off = F.when(energy == 0, F.lit(float("inf"))).otherwise(F.abs(F.try_divide(computed - energy, energy)))
    return one.union(two).union(issues(meters, "V19", F.lit("meters.energy"), F.when(computed.isNotNull() & (off > 0.02), "error"), computed, energy))


def domain_check(bills: DataFrame) -> DataFrame:
    """Values outside a closed set or range, one row each."""
    checks = {
        "status": F.col("status").isin("processing", "accepted", "pending_review", "reviewed", "failed"),
        "commodity_type": F.col("commodity_type").isin("electricity", "natural_gas", "water", "multi_commodity"),
        "confidence_score": F.col("confidence_score").between(0, 1),
        "complexity_tier": F.col("complexity_tier").isin("simple", "standard", "complex", "pathological"),
    }
    found = F.array_compact(F.array(*(F.when(~ok, F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("actual"))) for f, ok in checks.items())))
    rows = bills.select("extraction_id", F.inline(found))
    return issues(rows, "V20", F.col("field"), F.lit("warning"), F.lit("in domain"), F.col("actual"))


# Names that a column may have beside those of documents, and how long a text may be.
DOMAINS = silver.LISTED | {
    "commodity_type": ["natural_gas", "electricity", "water", "multi_commodity"],
    "complexity_tier": ["simple", "standard", "complex", "pathological"],
    "confidence_tier": ["auto_accept", "targeted_review", "full_review"],
    "math_disposition": ["clean", "rounding_variance", "minimum_bill", "utility_adjustment", "discrepancy"],
    "market_model": ["regulated", "deregulated", "liberalized_eu", "unknown"],
    "correction_type": ["value_change", "missing_field", "wrong_classification", "split_merge"],
    "correction_category": ["ocr_error", "format_normalize", "wrong_on_document", "missing_context", "calculation_error", "other"],
}
LONGEST = {"file_hash": 64, "blob_name": 512, "status": 50, "confidence_tier": 50, "commodity_type": 50, "utility_provider": 200, "field_path": 500, "correction_type": 50, "correction_category": 50, "corrector_id": 200, "utility": 200, "commodity": 50, "action": 100, "stage": 50, "model": 100, "provider": 50}


def out_of_domain(rows: DataFrame, key: str) -> DataFrame:
    """key, field, rule, actual: of every column that is known by its name the values that aren't listed (listed), texts that are too long
    (length, actual being how long) and confidences outside 0 to 1 (range). Nulls are in every domain."""
    found = []
    said = lambda c, rule, actual: F.struct(F.lit(c).alias("field"), F.lit(rule).alias("rule"), actual.cast("string").alias("actual"))
    for c in rows.columns:
        if c in DOMAINS:
            found.append(F.when(~F.col(c).isin(DOMAINS[c]), said(c, "listed", F.col(c))))
        if c in LONGEST:
            found.append(F.when(F.length(c) > LONGEST[c], said(c, "length", F.length(c))))
        if c == "confidence" or c.endswith(("_confidence", "confidence_score")):
            found.append(F.when(~F.col(c).between(0, 1) | F.isnan(c), said(c, "range", F.col(c))))
    return rows.select(key, F.inline(F.array_compact(F.array(*found)))) if found else rows.select(key, F.lit("").alias("field"), F.lit("").alias("rule"), F.lit("").alias("actual")).limit(0)


def normalized_rates(lines: DataFrame, rate: str = "vat_rate") -> DataFrame:
    """lines with rates over 1 taken as percentages, and rate_changed, whether it was one; null rates stay."""
    return lines.withColumn("rate_changed", F.coalesce(F.col(rate) > 1, F.lit(False))).withColumn(rate, F.when(F.col(rate) > 1, F.col(rate) / 100).otherwise(F.col(rate)))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def disposition(found: DataFrame, bills: DataFrame, strict: bool = False) -> DataFrame:
    """discrepancy if any issue is fatal (strict: or an error), else rounding_variance if any is a warning, else clean."""
    fatal = F.col("severity").isin("fatal", "error") if strict else F.col("severity") == "fatal"
    worst = found.groupBy("extraction_id").agg(F.max(fatal.cast("int")).alias("f"), F.max((F.col("severity") == "warning").cast("int")).alias("w"), F.count(F.lit(1)).alias("n_issues"))
    rows = bills.select("extraction_id").join(worst, "extraction_id", "left")
    return rows.select("extraction_id", F.when(F.col("f") == 1, "discrepancy").when(F.col("w") == 1, "rounding_variance").otherwise("clean").alias("disposition"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def run_all(bills: DataFrame, charges: DataFrame, sections: DataFrame, meters: DataFrame, periods: DataFrame, summary: DataFrame, totals: DataFrame) -> DataFrame:
    """Every rule of lines, totals, meters, logic, VAT (under a VAT regime) and gas (of natural gas), all issues together."""
    vat, gas = under_vat(charges, bills), of_gas(meters, bills)
    return union([
        line_math(charges, bills), section_totals(charges, sections, bills), current_charges(charges, bills), meter_reads(meters), tou_total(meters, periods), unit_mismatch(meters, bills), billing_days(bills),
        negative_amounts(charges), demand_missing(charges, bills), tou_missing(bills, periods), single_owner(charges, bills), vat_lines(vat), vat_summary(vat, summary), vat_total(under_vat(totals, bills)), gas_factors(gas),
    ])


def run_validation(charges: DataFrame, bills: DataFrame) -> DataFrame:
    """The rules of lines, totals and logic on one set of bills."""
    return union([line_math(charges, bills), current_charges(charges, bills), billing_days(bills), negative_amounts(charges), demand_missing(charges, bills), single_owner(charges, bills)])
