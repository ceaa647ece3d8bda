"""Queries of whole documents as typed tables, contracts in force and lookups of many names, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locale
from ..operators import learn, rollups, silver, usage, validate
from ..sources import tables
from .reviews import _TIERED, query, tiered


def _json(form: str, *columns: str) -> Column:
    """form with each %s replaced by a column in turn; null reads null."""
    parts = form.split("%s")
    return F.concat(F.lit(parts[0]), *(x for c, after in zip(columns, parts[1:], strict=True) for x in (F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(after))))


def whole_documents(s: SparkSession, d: str) -> DataFrame:
    """A document per bill that has lines: charges, a meter with time-of-use rows, sums and VAT in mixed forms. Of lines, some are plain,
    some lack an amount or a category that is listed or have a date in another format; every fifth bill has a meter of an unknown read
    type, every seventh an unknown statement type."""
    n = F.col("line_number") % 6
    c = tables.charges(s, d).withColumn("number", F.col("amount").cast("string"))
    line = (
        F.when(n == 0, _json('{"line_id":"X%s","description":{"value":"%s","confidence":0.8},"category":"%s","charge_owner":"%s","charge_section":"%s","quantity":{"value":%s},"rate":%s,"amount":{"value":%s,"currency":"EUR","confidence":0.7},"charge_period":{"start":"2024-01-01","end":"2024-1-31"}}', "line_number", "category", "category", "charge_owner", "charge_section", "quantity", "rate", "number"))
        .when(n == 1, _json('{"description":"%s","amount":{"value":"%s"}}', "category", "number"))
        .when(n == 2, _json('{"category":"listed nowhere","amount":{"value":%s}}', "number"))
        .when(n == 3, F.lit('{"amount":{"value":null}}'))
        .when(n == 4, _json('{"category":"%s","amount":{"value":%s,"confidence":0.5}}', "category", "number"))
        .otherwise(_json('{"amount":{"value":%s},"charge_period":{"start":"31/01/2024","end":"2024-01-31"}}', "number"))
    )
    lines = c.groupBy("extraction_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_number", "amount", "category", "charge_owner", "charge_section", line.alias("j"))))["j"], ",").alias("lines"))
    key = F.col("extraction_id")
    bills = tables.extractions(s, d).select("extraction_id", "utility_provider", F.col("stated_total").cast("string").alias("total"), F.date_format("created_at", "dd.MM.yyyy").alias("day"), (key % 500).alias("m"), F.when(key % 7 == 0, "unheard of").otherwise("final").alias("kind"), F.when(key % 5 == 0, ',{"read_type":"guessed"}').otherwise("").alias("more"))
    text = _json(
        '{"invoice":{"invoice_number":%s,"invoice_date":{"value":"%s","confidence":0.75},"statement_type":"%s"},"account":{"utility_provider":{"value":"%s","confidence":1.0}},"charges":[%s],'
        '"meters":[{"meter_number":"M%s","consumption":{"raw_value":%s},"demand":{"value":%s},"tou_breakdown":[{"period":"P1","consumption":%s},{"period":"P2","consumption":{"value":1.5,"confidence":0.25}}]}%s],'
        '"totals":{"total_amount_due":{"value":%s},"late_fees":{},"current_charges":7,"total_net":{"value":"n"},"vat_summary":[{"vat_rate":0.19,"taxable_base":{"value":%s},"vat_amount":3},{"vat_category":"odd"}]}}',
        "extraction_id", "day", "kind", "utility_provider", "lines", "m", "extraction_id", "m", "m", "more", "total", "total",
    )
    return bills.hint("merge").join(lines.hint("merge"), "extraction_id").select("extraction_id", F.try_parse_json(text).alias("document"))


def projected(s: SparkSession, d: str) -> DataFrame:
    return silver.projected(whole_documents(s, d))


_B16 = ", placed AS (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY line_number, amount, category, charge_owner, charge_section) - 1 AS place, line_number % 6 AS n FROM charges), whole AS (SELECT * FROM extractions WHERE extraction_id IN (SELECT extraction_id FROM charges)) "


@query(f"""{_B16} SELECT extraction_id, extraction_id::VARCHAR AS invoice_number, created_at::DATE AS invoice_date, 0.75::DOUBLE AS invoice_date_confidence, CASE WHEN extraction_id % 7 = 0 THEN 'unheard of' ELSE 'final' END AS statement_type, utility_provider,
  (SELECT count(*) FROM placed p WHERE p.extraction_id = w.extraction_id AND n IN (0, 1, 4)) AS n_charges, CASE WHEN extraction_id % 7 = 0 THEN 'statement_type' END AS problem FROM whole w""")
def b16_bill_rows(s, d):
    return silver.bill_rows(projected(s, d)).select("extraction_id", "invoice_number", "invoice_date", "invoice_date_confidence", "statement_type", "utility_provider", F.col("n_charges").cast("long"), "problem")


@query(f"""{_B16} SELECT extraction_id, place, CASE n WHEN 0 THEN 'X' || line_number ELSE 'L' || lpad((place + 1)::VARCHAR, 3, '0') END AS line_id, CASE WHEN n IN (0, 1) THEN category ELSE '' END AS description, CASE n WHEN 0 THEN 0.8 WHEN 1 THEN 0.9 ELSE 0 END::DOUBLE AS description_confidence,
  CASE n WHEN 1 THEN 'other' ELSE category END AS category, CASE n WHEN 0 THEN charge_owner ELSE 'utility' END AS charge_owner, CASE n WHEN 0 THEN charge_section ELSE 'other' END AS charge_section, amount::DOUBLE AS amount, CASE n WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE n WHEN 0 THEN 0.7 WHEN 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS amount_confidence, CASE n WHEN 0 THEN DATE '2024-01-31' END AS period_end, CASE n WHEN 0 THEN 'current' END AS attribution_type FROM placed WHERE n IN (0, 1, 4)""")
def b16_charge_lines(s, d):
    rows = silver.charge_lines(projected(s, d))
    return rows.select("extraction_id", F.col("place").cast("long"), "line_id", "description", "description_confidence", "category", "charge_owner", "charge_section", F.col("amount").cast("double"), "currency", "amount_confidence", "period_end", "attribution_type")


@query(f"""{_B16} SELECT extraction_id, 'M' || extraction_id % 500 AS meter_number, 'actual' AS read_type, extraction_id::DOUBLE AS raw_value, 'kWh' AS raw_unit, nullif(extraction_id % 500, 0)::DOUBLE AS demand_value, CASE WHEN extraction_id % 500 <> 0 THEN 'non_coincident' END AS demand_type FROM whole""")
def b16_meter_rows(s, d):
    return silver.meter_rows(projected(s, d)).select("extraction_id", "meter_number", "read_type", "raw_value", "raw_unit", "demand_value", "demand_type")


@query(f"{_B16} SELECT extraction_id, 0 AS meter_place, 'P' || p AS period, CASE p WHEN 1 THEN extraction_id % 500 ELSE 1.5 END::DOUBLE AS consumption, CASE p WHEN 1 THEN 0.9 ELSE 0.25 END::DOUBLE AS confidence FROM whole, (VALUES (1), (2)) t(p)")
def b16_tou_rows(s, d):
    return silver.tou_rows(projected(s, d)).select("extraction_id", "meter_place", "period", "consumption", "confidence")


@query(f"{_B16} SELECT extraction_id, 'total_amount_due' AS name, stated_total::DOUBLE AS value, 'USD' AS currency, 0.9::DOUBLE AS confidence FROM whole")
def b16_total_rows(s, d):
    return silver.total_rows(projected(s, d)).select("extraction_id", "name", F.col("value").cast("double"), "currency", "confidence")


@query(f"{_B16} SELECT extraction_id, 0.19::DOUBLE AS vat_rate, 'standard' AS vat_category, stated_total::DOUBLE AS taxable_base, 0::DOUBLE AS vat_amount FROM whole")
def b16_vat_rows(s, d):
    return silver.vat_rows(projected(s, d)).select("extraction_id", "vat_rate", "vat_category", F.col("taxable_base").cast("double"), F.col("vat_amount").cast("double"))


@query(f"""{_B16} SELECT extraction_id, 'charges' AS kind, place, CASE n WHEN 2 THEN 'category' WHEN 3 THEN 'amount' ELSE 'charge_period' END AS problem FROM placed WHERE n IN (2, 3, 5)
UNION ALL SELECT extraction_id, 'meters', 1, 'read_type' FROM whole WHERE extraction_id % 5 = 0 UNION ALL SELECT extraction_id, 'vat', 1, 'vat_category' FROM whole UNION ALL SELECT extraction_id, 'totals', NULL, 'total_net' FROM whole UNION ALL SELECT extraction_id, 'document', NULL, 'statement_type' FROM whole WHERE extraction_id % 7 = 0""")
def b16_skipped(s, d):
    return silver.skipped(projected(s, d)).select("extraction_id", "kind", F.col("place").cast("long"), "problem")


def contracts(s: SparkSession, d: str) -> DataFrame:
    """Contracts of customers, as meters: each order is one from its day on, for 100 to 499 days or, every ninth, until further notice, so
    that they overlap."""
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    return tables.load(s, d, "orders").select(key.alias("contract_id"), F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("meter_number"), start.alias("valid_from"), F.when(key % 9 != 0, F.date_add(start, (100 + key % 400).cast("int"))).alias("valid_to"), (key % 60 + 10).alias("capacity"), (key % 8 == 0).alias("exceeded"))


def readings(s: SparkSession, d: str) -> DataFrame:
    """A demand per bill of its customer's meter, 40 days after the order; some bills have no day."""
    key = F.col("o_orderkey")
    return tables.load(s, d, "orders").select(key.alias("extraction_id"), F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("meter_number"), F.when(key % 17 != 0, F.date_add(F.col("o_orderdate").cast("date"), 40)).alias("day"), (key % 97).alias("demand_value"))


_FORCE = """WITH contract AS (SELECT o_orderkey AS contract_id, o_custkey AS meter, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE + (100 + o_orderkey % 400)::INT END AS b, o_orderkey % 60 + 10 AS capacity, o_orderkey % 8 = 0 AS exceeded FROM orders),
reading AS (SELECT o_orderkey AS extraction_id, o_custkey AS meter, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE + 40 END AS day, o_orderkey % 97 AS demand_value FROM orders),
force AS (SELECT r.*, contract_id, capacity, exceeded FROM reading r LEFT JOIN contract c ON c.meter = r.meter AND r.day >= a AND (b IS NULL OR r.day <= b) QUALIFY row_number() OVER (PARTITION BY extraction_id ORDER BY a DESC, contract_id DESC) = 1)"""


@query(f"{_FORCE} SELECT extraction_id, contract_id FROM force", model=False)
def c20_contract_in_force(s, d):
    return usage.contract_in_force(readings(s, d), contracts(s, d)).select("extraction_id", "contract_id")


@query(f"{_FORCE} SELECT extraction_id, contract_id, demand_value, capacity FROM force WHERE demand_value > capacity AND NOT exceeded AND extraction_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 7 = 0)", model=False)
def c20_capacity_exceeded(s, d):
    lines = tables.load(s, d, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), F.when(F.col("l_suppkey") % 7 == 0, "Leistung: ÜBERSCHREITUNG").otherwise(F.col("l_returnflag")).alias("description"))
    return usage.capacity_exceeded(readings(s, d), contracts(s, d), lines).select("extraction_id", "contract_id", "demand_value", "capacity")


@query("""WITH names AS (SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE 'Customer#' || c_custkey END AS keyword FROM customer), texts AS (SELECT DISTINCT 'paid by CUSTOMER#' || o_custkey || ', ' || o_orderpriority AS t FROM orders)
SELECT t AS description, ordinal FROM texts LEFT JOIN names ON contains(lower(t), lower(keyword)) QUALIFY row_number() OVER (PARTITION BY t ORDER BY ordinal) = 1""", model=False)
def c05_many_names(s, d):
    """Which customer's name, of all of them, comes first in each distinct text; names are parts of other names."""
    key = F.col("c_custkey")
    listed = tables.load(s, d, "customer").select(key.alias("ordinal"), F.when(key % 3 == 0, key.cast("string")).otherwise(F.concat(F.lit("Customer#"), key.cast("string"))).alias("keyword"), F.lit("").alias("tax_category"), F.lit("").alias("tax_section"))
    texts = tables.load(s, d, "orders").select(F.concat(F.lit("paid by CUSTOMER#"), F.col("o_custkey").cast("string"), F.lit(", "), "o_orderpriority").alias("description")).distinct()
    first = learn.taxonomy_lookup(texts, listed, "description")
    return first.select("description", "ordinal")


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders) SELECT o_orderkey, ['en','de','en','pt','en'][k + 1] AS language_code, ['GB','DE','MX','PT','PL'][k + 1] AS country_code, ['GBP','EUR','MXN','EUR','PLN'][k + 1] AS currency_code, ['£','€','$','€','$'][k + 1] AS currency_symbol,
  CASE WHEN k = 3 THEN ',' ELSE '.' END AS decimal_separator, CASE WHEN k = 3 THEN '.' ELSE ',' END AS thousands_separator, ['uk_vat','eu_vat','mx_iva','eu_vat','us_sales_tax'][k + 1] AS tax_regime, ['liberalized_eu','liberalized_eu','regulated','regulated','regulated'][k + 1] AS market_model FROM t""", model=False)
def g06_whole_locale(s, d):
    """A date with dots counts as a US number, so that a text with one of each is US."""
    k = F.col("o_orderkey") % 5
    rows = tables.load(s, d, "orders").select("o_orderkey", tables.pick(k, "£1,234.56", "1.234,56 € am 03.02.2025", "$1,200.00 MXN", "1.234,56 €", "100.00 PLN").alias("text"), F.when(k == 1, "de").when(k == 3, "pt").when(k == 2, "").alias("language"))
    return locale.whole_locale(rows).select("o_orderkey", "language_code", "country_code", "currency_code", "currency_symbol", "decimal_separator", "thousands_separator", "tax_regime", "market_model")


@query(""", mine AS (SELECT * FROM corrections WHERE utility = 'City Gas' AND commodity = 'electricity'), newest AS (SELECT *, row_number() OVER (PARTITION BY field_path ORDER BY created_at DESC, correction_id DESC) AS rn FROM mine)
SELECT field_path, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN coalesce(extracted_value, '∅') || '>' || corrected_value END, '|' ORDER BY rn) AS examples FROM newest GROUP BY 1""")
def d03_groups_of_context(s, d):
    return rollups.field_path_groups(tables.corrections(s, d), utility="City Gas", commodity="electricity")


_TOU = ["P4", "p5", "HP Bleu", "rouge hc", "Blanc HP", "P7"]


@query("SELECT 'M' || l_suppkey % 20 AS meter_number, ['off_peak','off_peak','peak','off_peak','peak','P7'][l_linenumber % 6 + 1] AS std_period, sum(l_quantity) AS consumption FROM lineitem GROUP BY 1, 2", model=False)
def x22_more_periods(s, d):
    li = tables.load(s, d, "lineitem")
    return usage.tou_periods(li.select(F.concat(F.lit("M"), (F.col("l_suppkey") % 20).cast("string")).alias("meter_number"), tables.pick(F.col("l_linenumber") % 6, *_TOU).alias("period"), F.col("l_quantity").alias("consumption")))


@query(f"""{_B16.rstrip()}, f AS (SELECT extraction_id, count(*) AS f, count(*) FILTER (WHERE category = 'energy') AS ff, count(*) FILTER (WHERE case_no = 2) AS c, count(*) FILTER (WHERE case_no = 2 AND category = 'energy') AS cf FROM charges GROUP BY 1),
d AS (SELECT extraction_id, count(*) AS d, count(*) FILTER (WHERE correction_id % 4 = 0) AS dc FROM corrections GROUP BY 1), c AS (SELECT extraction_id, sum(input_tokens) * 0.001 AS cost FROM calls GROUP BY 1)
SELECT strftime(created_at, '%Y-%m') AS month, commodity_type, count(*) AS n_bills, round(avg((confidence_tier = 'auto_accept')::INT), 6) AS auto_accept_rate, round(avg((extraction_id % 3 <> 0)::INT), 6) AS format_coverage, round(sum(cf) / nullif(sum(ff), 0), 6) AS fatal_rate, round(1 - sum(c) / nullif(sum(f), 0), 6) AS field_accuracy,
  round(sum(dc) / nullif(sum(d), 0), 6) AS drift_rate, round(sum(coalesce(cost, 0) + 0.01 + CASE WHEN confidence_tier = 'auto_accept' THEN 0 ELSE 2 END) / count(*), 4)::DOUBLE AS blended_cost FROM {_TIERED} LEFT JOIN f USING (extraction_id) LEFT JOIN d USING (extraction_id) LEFT JOIN c USING (extraction_id) GROUP BY 1, 2""")
def x14_kpi_report(s, d):
    bills = tiered(s, d).withColumn("known_format", F.col("extraction_id") % 3 != 0)
    fields = tables.charges(s, d).select("extraction_id", (F.col("case_no") == 2).alias("corrected"), (F.col("category") == "energy").alias("fatal"))
    changes = tables.corrections(s, d).select("extraction_id", (F.col("correction_id") % 4 == 0).alias("changed"))
    spent = tables.calls(s, d).select("extraction_id", (F.col("input_tokens") * F.lit("0.001").cast("decimal(4,3)")).alias("cost"))
    return rollups.kpi_report(bills, fields, changes, spent)


@query("""SELECT correction_id, 'utility' AS field, 'length' AS rule, (length(utility) * 30)::VARCHAR AS actual FROM corrections WHERE correction_id % 10 = 0 UNION ALL SELECT correction_id, 'correction_category', 'listed', correction_category FROM corrections WHERE correction_category IN ('', 'ocr_confusion')
UNION ALL SELECT correction_id, 'confidence', 'range', '1.5' FROM corrections WHERE correction_id % 7 = 0 UNION ALL SELECT correction_id, 'read_type', 'listed', 'guessed' FROM corrections WHERE correction_id % 6 = 1""")
def v20_all_domains(s, d):
    key = F.col("correction_id")
    rows = tables.corrections(s, d).withColumn("utility", F.when(key % 10 == 0, F.repeat("utility", F.lit(30))).otherwise(F.col("utility"))).withColumn("confidence", F.when(key % 7 == 0, 1.5).when(key % 7 == 1, 1.0)).withColumn("read_type", F.when(key % 6 == 1, "guessed").otherwise("actual"))
    return validate.out_of_domain(rows, "correction_id")


@query("SELECT country_code, count(*) AS n, count(*) FILTER (WHERE vat_rate > 0.05) AS n_changed, round(max(vat_rate), 4)::DOUBLE AS top FROM charges JOIN extractions USING (extraction_id) GROUP BY 1")
def v13_rates_changed(s, d):
    """Rates of lines, those above 5 % printed as percentages."""
    lines = tables.charges(s, d).select("extraction_id", F.when(F.col("vat_rate") > F.lit("0.05").cast("decimal(4,2)"), F.col("vat_rate").cast("decimal(9,4)") * 100).otherwise(F.col("vat_rate")).cast("decimal(9,4)").alias("vat_rate"))
    both = validate.normalized_rates(lines).hint("merge").join(tables.extractions(s, d).select("extraction_id", "country_code").hint("merge"), "extraction_id")
    return both.groupBy("country_code").agg(F.count(F.lit(1)).alias("n"), F.count_if("rate_changed").alias("n_changed"), F.round(F.max("vat_rate"), 4).cast("double").alias("top"))
