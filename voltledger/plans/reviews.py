"""Queries of whole validation, scores, audits, drift of documents and lookups, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexity, text
from ..operators import documents as results
from ..operators import audit, drift, intake, learn, lists, rollups, rules, score, usage, validate
from ..sources import dims, sinks, tables
from ..sources.tables import MONEY
from ..streaming import intake as streams
from . import oracle
from .queries import meter_columns, meters, vat_charges

QUERIES, SQL = {}, {}


def query(sql: str, model: bool = True):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, f"{oracle.MODEL}{sql}" if model else sql
        return f

    return add


def flagged(s: SparkSession, d: str) -> DataFrame:
    return tables.extractions(s, d).withColumn("has_tou", F.col("extraction_id") % 5 == 0)


def periods(s: SparkSession, d: str) -> DataFrame:
    """Two time-of-use rows for the meter of every tenth bill; for some they don't add up to its consumption."""
    half = F.col("raw_value") / 2
    return meters(s, d).where("extraction_id % 10 = 0").select("extraction_id", "meter_number", F.explode(F.array(half, half + F.when(F.col("extraction_id") % 20 == 0, 2.0).otherwise(0.0))).alias("consumption"))


def sections(s: SparkSession, d: str) -> DataFrame:
    moved = F.when(F.col("extraction_id") % 4 == 0, F.lit("0.30")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    sums = tables.charges(s, d).groupBy("extraction_id", "charge_section").agg(F.sum("amount").cast(MONEY).alias("s")).where("charge_section <> 'other'")
    return sums.select("extraction_id", "charge_section", (F.col("s") + moved).cast(MONEY).alias("subtotal"))


def summary(s: SparkSession, d: str) -> DataFrame:
    off = F.when(F.col("extraction_id") % 5 == 0, F.lit("0.20")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    return validate.vat_by_rate(vat_charges(s, d)).where("vat_rate > 0.02").select("extraction_id", "vat_rate", (F.col("base_sum") + off).cast(MONEY).alias("stated_base"), F.col("vat_sum").alias("stated_vat"))


def totals(s: SparkSession, d: str) -> DataFrame:
    sums = vat_charges(s, d).groupBy("extraction_id").agg(F.sum("amount_net").cast(MONEY).alias("total_net"), F.sum("vat_amount").cast(MONEY).alias("total_vat"))
    off = F.when(F.col("extraction_id") % 6 == 0, F.lit("0.06")).when(F.col("extraction_id") % 6 == 1, F.lit("0.05")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    return sums.withColumn("total_gross", (F.col("total_net") + F.col("total_vat") + off).cast(MONEY))


def nested_bills(s: SparkSession, d: str) -> DataFrame:
    """One row per bill: what its lines add up to, what it states of them (off for some bills), and its meters. The lines are read once."""
    moved = lambda n, at: f"CASE WHEN extraction_id % {n} = 0 THEN {at} ELSE 0.00 END"
    facts = rules.line_facts(vat_charges(s, d))
    bills = rules.with_gates(flagged(s, d)).join(facts.hint("merge"), "extraction_id", "left")
    total = lambda of: f"aggregate(cells, cast(0 as decimal(28,2)), (a, c) -> cast(a + c.{of} as decimal(28,2)), a -> cast(a as {MONEY}))"
    stated = bills.selectExpr(
        "*", f"transform(filter(array_distinct(transform(cells, c -> c.charge_section)), x -> x <> 'other'), x -> named_struct('charge_section', x, 'subtotal', cast({rules.added('amount', 'charge_section', 'x')} + {moved(4, '0.30')} as {MONEY}))) AS sections",
        f"transform(filter(array_distinct(transform(cells, c -> c.vat_rate)), x -> x > 0.02), x -> named_struct('vat_rate', x, 'stated_base', cast({rules.added('net', 'vat_rate', 'x')} + {moved(5, '0.20')} as {MONEY}), 'stated_vat', {rules.added('vat', 'vat_rate', 'x')})) AS vat_summary",
        f"{total('net')} AS total_net", f"{total('vat')} AS total_vat", "extraction_id % 10 = 0 AS any_tou",
    ).selectExpr("*", f"cast(total_net + total_vat + CASE extraction_id % 6 WHEN 0 THEN 0.06 WHEN 1 THEN 0.05 ELSE 0.00 END as {MONEY}) AS total_gross")
    tou = F.when(F.col("extraction_id") % 10 == 0, F.col("m.raw_value") + F.when(F.col("extraction_id") % 20 == 0, 2.0).otherwise(0.0))
    one = rules.with_computed(stated).withColumn("m", F.struct(*meter_columns(F.col("extraction_id"))))
    return one.withColumn("meters", F.array(F.col("m").withField("tou", tou))).drop("m")


def all_issues(s: SparkSession, d: str) -> DataFrame:
    sums = periods(s, d).groupBy("extraction_id", "meter_number").agg(F.sum(F.coalesce("consumption", F.lit(0.0))).alias("tou"))
    return rules.all_issues(nested_bills(s, d), vat_charges(s, d), meters(s, d).join(sums.hint("merge"), ["extraction_id", "meter_number"], "left"))


_PERIODS = "SELECT extraction_id, raw_value FROM meters WHERE extraction_id % 10 = 0"
_V = lambda name, gate="": f"SELECT x.extraction_id, rule_id, severity FROM ({oracle._ON_MODEL[name]}) x{gate}"
_VAT = " JOIN extractions e ON e.extraction_id = x.extraction_id AND country_code <> 'US'"
_GAS = " JOIN extractions e ON e.extraction_id = x.extraction_id AND commodity_type = 'natural_gas'"
_ALL = f"""SELECT extraction_id, rule_id, severity FROM issues UNION ALL {_V("v02_section_totals")} UNION ALL {_V("v04_meter_reads")}
UNION ALL SELECT extraction_id, 'V05', 'warning' FROM ({_PERIODS}) WHERE extraction_id % 20 = 0
UNION ALL {_V("v06_unit_mismatch")} UNION ALL SELECT extraction_id, 'V11', 'warning' FROM extractions WHERE extraction_id % 5 = 0 AND extraction_id % 10 <> 0
UNION ALL {_V("v13_vat_lines", _VAT)} UNION ALL {_V("v15_vat_summary", _VAT)}
UNION ALL SELECT extraction_id, 'V17', 'error' FROM extractions WHERE extraction_id % 6 = 0 AND country_code <> 'US' AND extraction_id IN (SELECT extraction_id FROM charges)
UNION ALL {_V("v18_gas_factors", _GAS)}"""


@query("SELECT extraction_id, 'V11' AS rule_id, 'meters.tou_breakdown' AS field, 'warning' AS severity FROM extractions WHERE extraction_id % 5 = 0 AND extraction_id % 10 <> 0")
def v11_tou_missing(s, d):
    return validate.tou_missing(flagged(s, d), periods(s, d)).select("extraction_id", "rule_id", "field", "severity")


@query("SELECT extraction_id, extraction_id % 10 = 0 AS any_tou FROM extractions")
def d15_any_tou(s, d):
    return validate.any_tou(tables.extractions(s, d), periods(s, d))


@query(f"SELECT extraction_id, 'V05' AS rule_id, raw_value + 2 AS tou FROM ({_PERIODS}) WHERE extraction_id % 20 = 0")
def v05_tou_total(s, d):
    return validate.tou_total(meters(s, d), periods(s, d)).select("extraction_id", "rule_id", F.col("expected").cast("double").alias("tou"))


@query("SELECT extraction_id, 'V17' AS rule_id, 'error' AS severity, (n + v)::DECIMAL(18,2)::VARCHAR AS expected, (n + v + 0.06)::DECIMAL(18,2)::VARCHAR AS actual FROM (SELECT extraction_id, sum(amount_net) AS n, sum(vat_amount) AS v FROM vat GROUP BY 1) JOIN extractions USING (extraction_id) WHERE extraction_id % 6 = 0 AND country_code <> 'US'")
def v17_vat_total(s, d):
    return validate.vat_total(validate.under_vat(totals(s, d), tables.extractions(s, d))).select("extraction_id", "rule_id", "severity", "expected", "actual")


@query(f"SELECT rule_id, severity, count(*) AS n FROM ({_ALL}) GROUP BY 1, 2")
def v21_all_rules(s, d):
    return all_issues(s, d).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT b.extraction_id, CASE WHEN max(CASE WHEN severity = 'fatal' THEN 1 END) = 1 THEN 'discrepancy' WHEN max(CASE WHEN severity = 'warning' THEN 1 END) = 1 THEN 'rounding_variance' ELSE 'clean' END AS disposition, count(severity) AS n_issues
FROM bills b LEFT JOIN ({_ALL}) i ON i.extraction_id = b.extraction_id GROUP BY 1""")
def v21_disposition(s, d):
    return rules.judged(nested_bills(s, d)).select("extraction_id", rules.disposition().alias("disposition"), "n_issues")


def answers(s: SparkSession, d: str) -> DataFrame:
    """Answers with a number of meters, wrong or wordless for some bills."""
    b = tables.extractions(s, d)
    said = F.when(F.col("extraction_id") % 7 == 0, "2 meters").when(F.col("extraction_id") % 7 == 1, "none seen").otherwise("1")
    return audit.rendered_answers(b).union(b.select("extraction_id", F.lit("meter_count"), said))


_MISMATCH = """SELECT extraction_id, 'total_amount_due' AS field, 'fatal' AS severity FROM extractions WHERE extraction_id % 5 = 0 UNION ALL SELECT extraction_id, 'account_number', 'fatal' FROM extractions WHERE extraction_id % 5 = 2
UNION ALL SELECT extraction_id, 'meter_count', 'high' FROM extractions WHERE extraction_id % 7 = 0"""


@query(_MISMATCH)
def k05_typed_audit(s, d):
    b = tables.extractions(s, d).withColumn("n_meters", F.lit(1)).withColumn("account_number", F.col("extraction_id").cast("string"))
    return audit.typed_mismatches(b, answers(s, d))


@query("SELECT extraction_id, CASE WHEN extraction_id % 3 = 0 THEN 'by field' WHEN extraction_id % 3 = 1 THEN 'by question' END AS answer FROM extractions")
def k06_by_question(s, d):
    b = tables.extractions(s, d)
    asked = b.select("extraction_id", F.lit("utility").alias("field_to_check"), F.lit("Who sent the bill?").alias("question"))
    given = b.where("extraction_id % 3 <> 2").select("extraction_id", F.when(F.col("extraction_id") % 3 == 0, "utility").alias("field"), F.lit("Who sent the bill?").alias("question"), F.when(F.col("extraction_id") % 3 == 0, "by field").otherwise("by question").alias("answer"))
    return audit.filled(asked, given).select("extraction_id", "answer")


_FULL = f"""p AS (SELECT extraction_id, 0.03 AS amount, 0 AS fatal FROM v01 WHERE severity = 'warning' UNION ALL SELECT extraction_id, 0.20, 0 FROM v03 WHERE severity = 'warning'
  UNION ALL SELECT extraction_id, CASE severity WHEN 'fatal' THEN 1.00 ELSE 0.20 END, CASE severity WHEN 'fatal' THEN 1 ELSE 0 END FROM ({_MISMATCH})
  UNION ALL SELECT extraction_id, 0.15, 1 FROM extractions WHERE extraction_id % 20 < 2 UNION ALL SELECT extraction_id, 0.10, 0 FROM extractions WHERE extraction_id % 15 < 12
  UNION ALL SELECT extraction_id, 0.10, 0 FROM extractions WHERE extraction_id % 10 < 6 UNION ALL SELECT extraction_id, 0.03, 0 FROM extractions WHERE extraction_id % 4 = 0),
f AS (SELECT extraction_id, complexity_tier, greatest(0, 1 - coalesce(sum(amount), 0))::DOUBLE AS score, coalesce(max(fatal), 0) = 1 AS fatal FROM bills LEFT JOIN p USING (extraction_id) GROUP BY 1, 2)
SELECT extraction_id, score, {oracle._TIER.format(fatal="fatal", s="score")} AS tier FROM f"""


@query(", " + _FULL)
def k01_full_score(s, d):
    b, c = tables.extractions(s, d), tables.charges(s, d)
    wrong = validate.line_math(c, b).unionByName(validate.current_charges(c, b))
    off = audit.typed_mismatches(b.withColumn("n_meters", F.lit(1)).withColumn("account_number", F.col("extraction_id").cast("string")), answers(s, d))
    seen = F.array(F.struct(F.lit("invoice.account_number").alias("field_path"), F.when(F.col("extraction_id") % 20 < 2, 0.5).otherwise(0.9).alias("confidence")), F.struct(F.lit("totals.current_charges").alias("field_path"), F.when(F.col("extraction_id") % 15 < 12, 0.79).otherwise(0.8).alias("confidence")), F.struct(F.lit("notes").alias("field_path"), F.lit(0.1).alias("confidence")))
    sources = b.select("extraction_id", ((F.col("extraction_id") % 10) / 10.0).alias("image_quality"), (F.col("extraction_id") % 4 == 0).alias("ocr_applied"))
    return score.route(score.full_penalties(wrong, off, b.select("extraction_id", F.inline(seen)), sources), b).select("extraction_id", F.col("score").cast("double").alias("score"), "tier")


_FLAGSHIP = f""", every AS ({_ALL}),
m AS ({_MISMATCH}),
p AS (SELECT extraction_id, rule_id AS label, CASE WHEN rule_id IN ('V03', 'V11') THEN 0.20 ELSE 0.03 END AS amount, 0 AS fatal FROM every WHERE severity <> 'info'
  UNION ALL SELECT extraction_id, 'audit:' || field, CASE severity WHEN 'fatal' THEN 1.00 ELSE 0.20 END, CASE severity WHEN 'fatal' THEN 1 ELSE 0 END FROM m
  UNION ALL SELECT extraction_id, 'low_confidence:invoice.account_number', 0.15, 1 FROM extractions WHERE extraction_id % 20 < 2 UNION ALL SELECT extraction_id, 'low_confidence:totals.current_charges', 0.10, 0 FROM extractions WHERE extraction_id % 15 < 12
  UNION ALL SELECT extraction_id, 'image_quality', 0.10, 0 FROM extractions WHERE extraction_id % 10 < 6 UNION ALL SELECT extraction_id, 'ocr', 0.03, 0 FROM extractions WHERE extraction_id % 4 = 0),
f AS (SELECT extraction_id, complexity_tier, greatest(0, 1 - coalesce(sum(amount), 0))::DOUBLE AS score, coalesce(max(fatal), 0) = 1 AS fatal, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM bills LEFT JOIN p USING (extraction_id) GROUP BY 1, 2),
d AS (SELECT b.extraction_id, CASE WHEN max(CASE WHEN severity = 'fatal' THEN 1 END) = 1 THEN 'discrepancy' WHEN max(CASE WHEN severity = 'warning' THEN 1 END) = 1 THEN 'rounding_variance' ELSE 'clean' END AS disposition, count(severity) AS n_issues FROM bills b LEFT JOIN every i ON i.extraction_id = b.extraction_id GROUP BY 1)
SELECT extraction_id, disposition, n_issues, score, labels, tier, CASE tier WHEN 'auto_accept' THEN 'accepted' ELSE 'pending_review' END AS routed_status FROM (SELECT *, {oracle._TIER.format(fatal="fatal", s="score")} AS tier FROM f) JOIN d USING (extraction_id)"""


@query(_FLAGSHIP)
def flagship_route(s, d):
    """Every bill by all rules, audit answers, confidences and the source, scored in full and routed."""
    key = F.col("extraction_id")
    seen = F.array(F.struct(F.lit("invoice.account_number").alias("field_path"), F.when(key % 20 < 2, 0.5).otherwise(0.9).alias("confidence")), F.struct(F.lit("totals.current_charges").alias("field_path"), F.when(key % 15 < 12, 0.79).otherwise(0.8).alias("confidence")), F.struct(F.lit("notes").alias("field_path"), F.lit(0.1).alias("confidence")))
    bills = rules.judged(nested_bills(s, d)).withColumns({"n_meters": F.size("meters"), "account_number": key.cast("string"), "fields": seen, "image_quality": (key % 10) / 10.0, "ocr_applied": key % 4 == 0})
    said = audit.answers_by_field(answers(s, d))
    routed = score.routed(bills.join(said.hint("merge"), "extraction_id", "left").withColumn("mismatches", audit.mismatches()))
    return routed.select("extraction_id", rules.disposition().alias("disposition"), "n_issues", F.col("score").cast("double").alias("score"), "labels", "tier", "routed_status")


@query("SELECT extraction_id, CASE WHEN extraction_id % 11 = 0 OR complexity_tier = 'pathological' THEN 'full_review' WHEN complexity_tier = 'complex' THEN 'targeted_review' WHEN confidence_score >= (CASE complexity_tier WHEN 'standard' THEN 0.93 ELSE 0.95 END)::DOUBLE THEN 'auto_accept' ELSE 'targeted_review' END AS tier FROM extractions")
def x08_tier_by_complexity(s, d):
    return tables.extractions(s, d).select("extraction_id", score.tier_by_complexity(F.col("confidence_score"), F.col("extraction_id") % 11 == 0, F.col("complexity_tier")).alias("tier"))


@query("SELECT extraction_id, (CASE WHEN country_code IN ('DE', 'FR', 'ES') THEN CASE extraction_id % 2 WHEN 0 THEN 2 ELSE 0 END + CASE extraction_id % 3 WHEN 0 THEN 1 ELSE 0 END + CASE WHEN country_code = 'FR' AND extraction_id % 5 = 0 THEN 2 ELSE 0 END ELSE 0 END + CASE extraction_id % 4 WHEN 0 THEN 1 ELSE 0 END)::INT AS added FROM extractions")
def x06_locale_additions(s, d):
    signals = F.array_compact(F.array(F.when(F.col("extraction_id") % 2 == 0, "multiple_vat_rates"), F.when(F.col("extraction_id") % 3 == 0, "calorific_conversion")))
    added = complexity.locale_additions(signals, F.col("country_code"), tables.pick(F.col("extraction_id") % 4, "pt", "en", "de", "it"), F.when(F.col("extraction_id") % 5 == 0, "TEMPO"))
    return tables.extractions(s, d).select("extraction_id", added.cast("int").alias("added"))


def documents(bills: DataFrame) -> DataFrame:
    """Each bill as a nested document."""
    lines = F.transform(F.sequence(F.lit(1), (F.col("extraction_id") % 3 + 1).cast("int")), lambda i: F.struct(i.alias("line"), (F.col("extraction_id") % 2 * 10 + i).alias("amount")))
    body = F.struct(F.struct(F.col("stated_total").cast("string").alias("total_amount_due"), "billing_days").alias("totals"), "status", F.when(F.col("extraction_id") % 4 != 0, F.struct((F.col("extraction_id") % 5).alias("rate_schedule"))).alias("invoice"), lines.alias("charges"), "processing_time_ms", "extraction_id")
    return bills.select("extraction_id", F.parse_json(F.to_json(body)).alias("document"))


_LEAVES = """, doc AS (SELECT *, extraction_id % 3 + 1 AS n FROM extractions),
leaf AS (SELECT extraction_id, 'totals.total_amount_due' AS path, stated_total::VARCHAR AS v FROM doc UNION ALL SELECT extraction_id, 'totals.billing_days', billing_days::VARCHAR FROM doc UNION ALL SELECT extraction_id, 'status', status FROM doc
  UNION ALL SELECT extraction_id, 'invoice.rate_schedule', (extraction_id % 5)::VARCHAR FROM doc WHERE extraction_id % 4 <> 0
  UNION ALL SELECT extraction_id, 'charges[' || (i - 1) || '].line', i::VARCHAR FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM doc) UNION ALL SELECT extraction_id, 'charges[' || (i - 1) || '].amount', (extraction_id % 2 * 10 + i)::VARCHAR FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM doc)),
sides AS (SELECT extraction_id, previous_id, extraction_id AS run, 1 AS side FROM pairs UNION ALL SELECT extraction_id, previous_id, previous_id, 0 FROM pairs),
met AS (SELECT s.extraction_id, s.previous_id, path, max(CASE side WHEN 0 THEN v END) AS old_value, max(CASE side WHEN 1 THEN v END) AS new_value FROM sides s JOIN leaf l ON l.extraction_id = run GROUP BY 1, 2, 3),
moved AS (SELECT extraction_id, previous_id, path AS field_path, old_value, new_value FROM met WHERE old_value IS DISTINCT FROM new_value),
every AS (SELECT * FROM moved WHERE NOT (starts_with(field_path, 'charges[') AND extraction_id % 3 <> previous_id % 3)
  UNION ALL SELECT extraction_id, previous_id, 'charges', 'len=' || (previous_id % 3 + 1), 'len=' || (extraction_id % 3 + 1) FROM pairs WHERE extraction_id % 3 <> previous_id % 3)
SELECT *, CASE WHEN field_path = 'totals.total_amount_due' THEN 'fatal' WHEN contains(field_path, 'rate_schedule') THEN 'high' WHEN contains(field_path, 'charge') THEN 'medium' ELSE 'low' END AS severity FROM every"""


@query(_LEAVES)
def r01_document_drift(s, d):
    b = tables.extractions(s, d)
    return drift.document_changes(lists.previous_run(b), documents(b), depth=4)


@query("SELECT extraction_id, status FROM extractions WHERE extraction_id IN (SELECT extraction_id FROM corrections)")
def b03_get_by_key(s, d):
    return lists.by_keys(tables.extractions(s, d), tables.corrections(s, d), "extraction_id").select("extraction_id", "status")


@query("SELECT extraction_id, correction_id, row_number() OVER (PARTITION BY extraction_id ORDER BY created_at DESC, correction_id DESC)::INT AS place FROM corrections")
def b08_corrections_by_extraction(s, d):
    return lists.in_order(tables.corrections(s, d), "extraction_id", [F.desc("created_at"), F.desc("correction_id")]).select("extraction_id", "correction_id", "place")


@query("SELECT field_path, total FROM (SELECT field_path, count(*) AS total FROM corrections GROUP BY 1) JOIN (SELECT field_path, category FROM (SELECT field_path, coalesce(nullif(correction_category, ''), 'other') AS category, count(*) AS n FROM corrections GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY field_path ORDER BY n DESC, category) = 1) USING (field_path) WHERE total >= 2 AND category = 'other'")
def b10_rules_filter(s, d):
    return lists.rules(rollups.correction_rules(tables.corrections(s, d)), active=True, category="other").select("field_path", "total")


@query("SELECT extraction_id, CASE WHEN commodity_type = 'natural_gas' AND r = 'US' THEN 'therms' WHEN commodity_type = 'water' AND r = 'US' THEN 'gallons' WHEN commodity_type = 'water' AND r = 'EU' THEN 'm³' ELSE 'kWh' END AS canonical_unit FROM (SELECT *, CASE country_code WHEN 'US' THEN 'US' WHEN 'MX' THEN 'MX' ELSE 'EU' END AS r FROM extractions)")
def c08_canonical_unit(s, d):
    region = F.when(F.col("country_code") == "US", "US").when(F.col("country_code") == "MX", "MX").otherwise("EU")
    return text.canonical_unit(tables.extractions(s, d).withColumn("region", region)).select("extraction_id", "canonical_unit")


@query("SELECT field_path, n, category FROM (SELECT field_path, count(*) AS n FROM corrections WHERE utility = 'City Gas' GROUP BY 1) JOIN (SELECT field_path, category FROM (SELECT field_path, category, count(*) AS k FROM categorized WHERE utility = 'City Gas' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY field_path ORDER BY k DESC, category) = 1) USING (field_path)")
def d04_pattern_groups(s, d):
    return learn.pattern_groups(tables.corrections(s, d), utility="city gas").select("field_path", "n", "category")


@query("SELECT extraction_id, min(f) AS fingerprint_id FROM (SELECT extraction_id, CASE WHEN commodity_type = 'water' THEN 2 WHEN commodity_type = 'electricity' THEN 1 END AS f FROM extractions) GROUP BY 1")
def c18_fingerprint_match(s, d):
    b = tables.extractions(s, d)
    each = b.select(F.lower("utility_provider").alias("utility")).distinct()
    known = each.select(F.inline(F.array(*(F.struct(F.lit(i).alias("fingerprint_id"), F.col("utility"), F.lit(c).alias("commodity"), F.lit(at).alias("created_at")) for i, c, at in ((1, "Electricity", 5), (2, "WATER", 1), (3, "electricity", 9))))))
    return learn.fingerprint_match(b, known)


_TAXONOMY = f"(VALUES {', '.join('(' + ', '.join([str(i), *(repr(x) for x in (c, *r))]) + ')' for i, (c, r) in enumerate((c, r) for c, listed in dims.CHARGES.items() for r in listed))}) t(ord, country, name, cat, sect, tr)"
_TAX = len([1 for listed in dims.CHARGES.values() for _ in listed])


def described(s: SparkSession, d: str) -> DataFrame:
    """Parts as lines of bills, described by their name and a charge's."""
    names = F.array(*(F.struct(F.lit(c).alias("country"), F.lit(r[0]).alias("name")) for c, listed in dims.CHARGES.items() for r in listed))
    one = F.element_at(names, (F.col("p_partkey") % _TAX + 1).cast("int"))
    return tables.load(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "DE").otherwise(one["country"]).alias("country_code"), F.concat_ws(" ", "p_name", F.upper(one["name"])).alias("description"))


@query(f"WITH t AS (SELECT * FROM {_TAXONOMY}), l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'DE' ELSE country END AS country_code, p_name || ' ' || upper(name) AS description FROM part JOIN t ON ord = p_partkey % {_TAX}) SELECT p_partkey, cat AS tax_category, sect AS tax_section, tr AS translation FROM l LEFT JOIN t ON country = country_code AND contains(lower(description), lower(name)) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ord) = 1", model=False)
def c05_charge_lookup(s, d):
    return learn.charge_lookup(described(s, d), dims.country_taxonomy(s)).select("p_partkey", "tax_category", "tax_section", "translation")


@query(f"WITH t AS (SELECT * FROM {_TAXONOMY}) SELECT country_code, name, count(*) AS n_bills FROM (SELECT ['US','DE','UK','FR','MX','ES'][c_nationkey % 6 + 1] AS country_code FROM customer) JOIN t ON country = country_code GROUP BY 1, 2", model=False)
def g23_country_taxonomy(s, d):
    of = tables.load(s, d, "customer").groupBy(tables.pick(F.col("c_nationkey") % 6, "US", "DE", "UK", "FR", "MX", "ES").alias("country_code")).agg(F.count(F.lit(1)).alias("n_bills"))
    return of.join(F.broadcast(dims.country_taxonomy(s)), F.col("country_code") == F.col("country")).select("country_code", "name", "n_bills")


@query("SELECT event_id, (props::JSON->>'k')::VARCHAR AS found, NULL::VARCHAR AS missing FROM events", model=False)
def g19_nested_get(s, d):
    v = F.try_parse_json("props")
    return tables.load(s, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("found"), F.try_variant_get(v, "$.a.b", "string").alias("missing"))


_UNITS = "CASE extraction_id % 4 WHEN 0 THEN raw_value / 3.6 WHEN 1 THEN raw_value * 0.001::DOUBLE WHEN 2 THEN raw_value * 2.8317::DOUBLE ELSE raw_value * 293.071::DOUBLE END"


@query(f"SELECT extraction_id, round({_UNITS}, 4) AS converted FROM meters")
def x05_more_units(s, d):
    rows = meters(s, d).select("extraction_id", F.col("raw_value").alias("value"), tables.pick(F.col("extraction_id") % 4, "MJ", "liters", "CCF_water", "dekatherms").alias("from_unit"), tables.pick(F.col("extraction_id") % 4, "kWh", "m³", "m³", "kWh").alias("to_unit"), F.lit(None).cast("double").alias("calorific_value"))
    return text.convert_units(rows, dims.more_conversions(s)).select("extraction_id", F.round("converted", 4).alias("converted"))


@query("SELECT extraction_id, round(raw_value * [1.0, 10.0, 9.4804, 0.746][extraction_id % 4 + 1]::DOUBLE, 4) AS converted FROM meters")
def x24_loose_units(s, d):
    rows = meters(s, d).select("extraction_id", F.col("raw_value").alias("value"), tables.pick(F.col("extraction_id") % 4, "CCF", "MCF", "GJ", "HP").alias("from_unit"), tables.pick(F.col("extraction_id") % 4, "therms", "therms", "therms", "kW").alias("to_unit"), F.lit(None).cast("double").alias("calorific_value"))
    return text.convert_units(rows, dims.more_conversions(s, loose=True)).select("extraction_id", F.round("converted", 4).alias("converted"))


@query("SELECT o_orderkey AS doc_id, round(o_totalprice, 2) + CASE WHEN o_orderkey % 44 = 0 THEN 2 ELSE 0 END AS total, o_orderkey % 4 = 0 AND o_orderkey % 11 <> 0 AS differs FROM orders", model=False)
def x15_structured_first(s, d):
    o = tables.load(s, d, "orders")
    seen = o.select(F.col("o_orderkey").alias("doc_id"), (F.round("o_totalprice", 2) + F.when(F.col("o_orderkey") % 4 == 0, 2.0).otherwise(0.0)).alias("seen_total"))
    return usage.structured_first(intake.structured_invoices(intake.rendered_attachments(o)), seen)


@query("SELECT extraction_id, status, commodity_type FROM extractions")
def a16_json_view(s, d):
    body = F.parse_json(F.col("body"))
    return intake.json_view(tables.extractions(s, d).select("extraction_id", "status", "commodity_type", "file_hash"), ["file_hash"]).where("body not like '%file_hash%'").select("extraction_id", F.try_variant_get(body, "$.status", "string").alias("status"), F.try_variant_get(body, "$.commodity_type", "string").alias("commodity_type"))


_FILES = """
WITH f AS (SELECT o_orderkey::VARCHAR || CASE o_orderkey % 8 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS path, o_orderkey,
    CASE WHEN o_orderkey % 10 = 0 THEN ''::BLOB ELSE unhex(['255044462D', '89504E470D0A1A0A', '89504E4731', 'FFD8DB', '49492A00', '4D4D002A', '706C61696E'][o_orderkey % 7 + 1]) || encode(o_custkey || '-' || o_orderstatus) END AS content FROM orders)
"""


@query(f"{_FILES} SELECT path, sha256(content) AS file_hash, CASE WHEN starts_with(hex(content), '25504446') THEN 'pdf' WHEN starts_with(hex(content), '89504E470D0A1A0A') THEN 'png' WHEN starts_with(hex(content), 'FFD8') THEN 'jpeg' WHEN starts_with(hex(content), '49492A00') OR starts_with(hex(content), '4D4D002A') THEN 'tiff' ELSE 'unknown' END AS file_type FROM f", model=False)
def a02_file_type(s, d):
    return intake.judged(intake.rendered_files(tables.load(s, d, "orders"))).select("path", "file_hash", "file_type")


@query(f"{_FILES} SELECT path, CASE WHEN NOT regexp_matches(path, '[.](pdf|PDF)$') THEN 'not a pdf' WHEN n = 0 THEN 'empty' WHEN n > 52428800 THEN 'too large' END AS reject_reason FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 52428800 + o_orderkey ELSE octet_length(content) END AS n FROM f)", model=False)
def a03_admission(s, d):
    return intake.judged(intake.rendered_files(tables.load(s, d, "orders"))).select("path", "reject_reason")


@query("SELECT call_id, input_tokens, output_tokens, total_tokens FROM calls")
def a08_call_totals(s, d):
    return sinks.with_total_tokens(tables.calls(s, d).drop("total_tokens")).select("call_id", "input_tokens", "output_tokens", "total_tokens")


_LEAF_ROWS = _LEAVES[: _LEAVES.index(",\nsides AS (")]


@query(f"{_LEAF_ROWS} SELECT extraction_id, path, v AS value FROM (SELECT * FROM leaf UNION ALL SELECT extraction_id, 'processing_time_ms', (extraction_id % 9000)::VARCHAR FROM doc UNION ALL SELECT extraction_id, 'extraction_id', extraction_id::VARCHAR FROM doc)")
def g20_flatten(s, d):
    return drift.flatten(documents(tables.extractions(s, d)), depth=4)


_DATES = " ".join(f"WHEN {k} THEN strftime(o_orderdate, '{f}')" for k, f in enumerate(("%Y-%m-%d", " %d-%m-%Y", "%m-%d-%Y ", "%d/%m-%Y", "%m/%d/%Y", "%d.%m.%Y", "%Y/%m/%d", "31-02-%Y")))


@query(f"""WITH r AS (SELECT o_orderkey, o_orderkey % 8 IN (1, 3, 7) AS day_first, trim(CASE o_orderkey % 8 {_DATES} END) AS t FROM orders),
p AS (SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(t, '%Y-%m-%d') WHEN contains(t, '.') THEN try_strptime(t, '%d.%m.%Y') WHEN day_first THEN try_strptime(replace(t, '-', '/'), '%d/%m/%Y') ELSE try_strptime(replace(t, '-', '/'), '%m/%d/%Y') END AS v FROM r)
SELECT o_orderkey, strftime(v, '%Y-%m-%d') AS day, CASE WHEN v IS NULL THEN 'not a date' END AS date_error FROM p""", model=False)
def g08_dates_and_errors(s, d):
    at, k = F.col("o_orderdate"), F.col("o_orderkey")
    raw = F.element_at(F.array(*(F.date_format(at, f) for f in ("yyyy-MM-dd", "' 'dd-MM-yyyy", "MM-dd-yyyy' '", "dd/MM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "'31-02-'yyyy"))), (k % 8 + 1).cast("int"))
    rows = tables.load(s, d, "orders").select("o_orderkey", raw.alias("raw"), F.when((k % 8).isin(1, 3, 7), "DD/MM/YYYY").otherwise("MM/DD/YYYY").alias("fmt"))
    return rows.select("o_orderkey", text.date(F.col("raw"), F.col("fmt")).cast("string").alias("day"), text.date_error(F.col("raw"), F.col("fmt")).alias("date_error"))


@query("SELECT * FROM v01 WHERE severity IS NOT NULL UNION ALL SELECT * FROM v09")
def s03_line_issues(s, d):
    return streams.arriving_issues(tables.charges(s, d), tables.extractions(s, d))


@query("SELECT user_id AS job_id, event_type AS status, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1", model=False)
def s06_job_status(s, d):
    return streams.job_status(tables.load(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS start, stage, count(*) AS n_calls, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, round(avg(duration_ms))::BIGINT AS avg_duration_ms FROM calls GROUP BY 1, 2")
def s07_call_windows(s, d):
    return streams.calls_per_window(tables.calls(s, d))


#: Pieces of which the texts below are made: formats and currencies mixed, malformed, or several at once.
PIECES = ["1,50 2,50 1,234.56", "$1,200.00 MXN", "100 PLN", "R$ 5 = €1", "12.345,6 7.50", "1.234,567", "£3.00", "MX$ 4,00", "USD 5", "9,99 kr SEK", "1,234,567.89", "1.234.567,89", "", "CHF 2.00 NOK", "MXN 7", "HUF 1 DKK 2 CZK 3"]


def mixed_texts(s: SparkSession, d: str) -> DataFrame:
    """A text of three pieces for each order."""
    key, pieces = F.col("o_orderkey"), F.array(*map(F.lit, PIECES))
    at = lambda n: F.element_at(pieces, (F.floor(key / n) % len(PIECES) + 1).cast("int"))
    return tables.load(s, d, "orders").select("o_orderkey", F.concat_ws(" ", at(1), at(16), at(4)).alias("t"))


_MIXED = f"(SELECT o_orderkey, concat_ws(' ', p[o_orderkey % 16 + 1], p[o_orderkey // 16 % 16 + 1], p[o_orderkey // 4 % 16 + 1]) AS t FROM orders, (SELECT {PIECES!r} AS p))"
_SEEN = lambda p: f"len(regexp_extract_all(t, '{p}'))"


@query(f"SELECT o_orderkey, CASE WHEN eu > us THEN 'EU' WHEN us > eu THEN 'US' WHEN e1 > u1 THEN 'EU' ELSE 'US' END AS number_format FROM (SELECT o_orderkey, {_SEEN(r'[0-9]{1,3}(?:[.][0-9]{3})*,[0-9]{2}' + chr(92) + 'b')} AS eu, {_SEEN(r'[0-9]{1,3}(?:,[0-9]{3})*[.][0-9]{2}' + chr(92) + 'b')} AS us, {_SEEN(r'[0-9]+,[0-9]{2}' + chr(92) + 'b')} AS e1, {_SEEN(r'[0-9]+[.][0-9]{2}' + chr(92) + 'b')} AS u1 FROM {_MIXED})", model=False)
def g01_mixed_texts(s, d):
    return mixed_texts(s, d).select("o_orderkey", text.number_format(F.col("t")).alias("number_format"))


@query(f"SELECT o_orderkey, CASE WHEN contains(t, '€') OR contains(t, 'EUR') THEN 'EUR' WHEN contains(t, '£') OR contains(t, 'GBP') THEN 'GBP' WHEN contains(t, '$') THEN CASE WHEN contains(t, 'MXN') OR contains(t, 'MX$') THEN 'MXN' WHEN contains(t, 'R$') THEN 'BRL' ELSE 'USD' END {' '.join(f"WHEN contains(t, '{c}') THEN '{c}'" for c in text.CODES)} END AS currency FROM {_MIXED}", model=False)
def g04_mixed_texts(s, d):
    return mixed_texts(s, d).select("o_orderkey", text.currency(F.col("t")).alias("currency"))


@query("SELECT extraction_id, (2 * (extraction_id % 2 = 0)::INT + 2 * (extraction_id % 3 = 0)::INT + (extraction_id % 5 = 0)::INT + CASE WHEN extraction_id % 40 > 30 THEN 3 WHEN extraction_id % 40 > 15 THEN 1 ELSE 0 END + 2 * (extraction_id % 8 > 5)::INT)::INT AS score FROM extractions")
def g14_european_complexity(s, d):
    key = F.col("extraction_id")
    return tables.extractions(s, d).select(key, complexity.complexity_score(F.array().cast("array<string>"), key % 40, key % 8, key % 2 == 0, key % 3 == 0, key % 5 == 0).cast("int").alias("score"))


_ASKED = "['totals.total_amount_due', 'charges[1].amount', 'invoice.rate_schedule', 'charges'][extraction_id % 4 + 1]"


@query(f"{_LEAF_ROWS} SELECT a.extraction_id, a.path, v AS value FROM (SELECT extraction_id, {_ASKED} AS path FROM doc) a LEFT JOIN leaf l ON l.extraction_id = a.extraction_id AND l.path = a.path")
def g19_paths_of_a_table(s, d):
    b = tables.extractions(s, d)
    asked = b.select("extraction_id", tables.pick(F.col("extraction_id") % 4, "totals.total_amount_due", "charges[1].amount", "invoice.rate_schedule", "charges").alias("path"))
    return results.values_at(documents(b), asked, depth=4)


@query(f"""{_LEAF_ROWS}, e AS (SELECT c.extraction_id, correction_id % 4 AS k, arg_max(corrected_value, (c.created_at, correction_id)) AS value FROM corrections c JOIN extractions USING (extraction_id) GROUP BY 1, 2)
SELECT extraction_id, path, v AS value, false AS corrected FROM (SELECT * FROM leaf UNION ALL SELECT extraction_id, 'processing_time_ms', (extraction_id % 9000)::VARCHAR FROM doc UNION ALL SELECT extraction_id, 'extraction_id', extraction_id::VARCHAR FROM doc)
UNION ALL SELECT extraction_id, ['totals.value', 'invoice.rate_schedule.value', 'charges.value', 'notes.reason.value'][k + 1], value, true FROM e WHERE k IN (0, 3) OR k = 1 AND extraction_id % 4 = 0""")
def b15_overlay(s, d):
    b = tables.extractions(s, d)
    edits = tables.corrections(s, d).withColumn("field_path", tables.pick(F.col("correction_id") % 4, "totals", "invoice.rate_schedule", "charges", "notes.reason"))
    return results.overlaid(documents(b), edits, depth=4)


@query("SELECT extraction_id, CASE WHEN extraction_id IN (SELECT extraction_id FROM corrections) THEN 'reviewed' ELSE status END AS status FROM extractions")
def b15_status(s, d):
    return results.reviewed(tables.extractions(s, d), tables.corrections(s, d)).select("extraction_id", "status")


_TIERED = f"(SELECT *, {oracle._TIER.format(fatal='extraction_id % 11 = 0', s='confidence_score')} AS confidence_tier FROM extractions)"


def tiered(s: SparkSession, d: str) -> DataFrame:
    """Bills with the tier that they were routed to."""
    return tables.extractions(s, d).withColumn("confidence_tier", score.tier(F.col("confidence_score"), F.col("extraction_id") % 11 == 0, F.col("complexity_tier")))


@query(f"SELECT extraction_id, created_at FROM {_TIERED} WHERE confidence_tier = 'targeted_review' AND commodity_type = 'water' ORDER BY created_at DESC, extraction_id LIMIT 150")
def b01_list_by_tier(s, d):
    return lists.list_extractions(tiered(s, d), commodity="water", tier="targeted_review", limit=150).select("extraction_id", "created_at")


@query("SELECT correction_id, category FROM categorized WHERE field_path = 'charges.click.amount' AND correction_category = ''")
def b04_filtered_corrections(s, d):
    return lists.list_corrections(tables.corrections(s, d), field_path="charges.click.amount", category="").select("correction_id", "category")


@query("SELECT call_id, stage FROM calls WHERE extraction_id = 401 ORDER BY created_at DESC, call_id LIMIT 100")
def b05_calls_of_extraction(s, d):
    return lists.list_calls(tables.calls(s, d), extraction=401).select("call_id", "stage")


@query("SELECT correction_id, field_path FROM (SELECT * FROM corrections WHERE correction_id % 5 = 2 AND utility = 'City Gas') QUALIFY count(*) OVER (PARTITION BY field_path) >= 3")
def b07_corrections_by_fingerprint(s, d):
    rows = tables.corrections(s, d).withColumn("fingerprint", F.concat(F.lit("f"), (F.col("correction_id") % 5).cast("string")))
    return lists.corrections_by_context(rows, utility="City Gas", fingerprint="f2", least=3).select("correction_id", "field_path")


@query(f"SELECT confidence_tier, count(*) AS n FROM (SELECT CASE WHEN extraction_id % 13 <> 0 THEN confidence_tier END AS confidence_tier FROM {_TIERED}) GROUP BY 1")
def d01_count_by_tier(s, d):
    """Bills without a tier are a group of their own."""
    return rollups.count_by(tiered(s, d).withColumn("confidence_tier", F.when(F.col("extraction_id") % 13 != 0, F.col("confidence_tier"))), "confidence_tier")
