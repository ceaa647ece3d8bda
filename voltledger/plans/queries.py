"""The bill engine's operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexity, locale, text
from ..operators import audit, documents, drift, intake, learn, lists, rollups, score, usage, validate
from ..sources import dims, tables
from ..sources.tables import MONEY

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vat_charges(s: SparkSession, d: str) -> DataFrame:
    """Charges with the VAT that their net amount and rate give, off by 0.06, 1 or nothing."""
    c = tables.charges(s, d)
    right = validate.cents(F.col("amount_net") * F.col("vat_rate"))
    vat = (right + F.when(F.col("case_no") == 5, F.lit("0.06")).when(F.col("case_no") == 6, F.lit("1.00")).otherwise(F.lit("0.00")).cast("decimal(4,2)")).cast(MONEY)
    gross = (F.col("amount_net") + vat + F.when(F.col("case_no") == 7, F.lit("0.10")).otherwise(F.lit("0.00")).cast("decimal(4,2)")).cast(MONEY)
    return c.withColumn("vat_amount", vat).withColumn("amount_gross", gross)


def meter_columns(key: Column) -> list[Column]:
    return [
        F.concat(F.lit("M"), (key % 500).cast("string")).alias("meter_number"), (key % 90000).cast("double").alias("previous_read"),
        (key % 90000 + key % 750).cast("double").alias("current_read"), F.when(key % 6 == 0, 10.0).when(key % 6 == 1, 1.0).alias("multiplier"),
        ((key % 750) * F.when(key % 6 == 0, 10).otherwise(1) + F.when(key % 13 == 0, 5).otherwise(0)).cast("double").alias("raw_value"),
        tables.pick(key % 4, "kWh", "therms", "m3", "ccf").alias("raw_unit"),
        F.when(key % 10 != 0, ((key % 40) / 4 + 6)).alias("calorific_value"), ((key % 30) / 100 + F.lit(0.85)).alias("volume_correction_factor"),
        (key % 1300).cast("double").alias("consumption_volume"), F.when(key % 7 != 0, (key % 1300) * 11.0).otherwise(0.0).alias("consumption_energy"),
    ]


def meters(s: SparkSession, d: str) -> DataFrame:
    """One meter per bill."""
    key = F.col("extraction_id")
    return tables.extractions(s, d).select(key, *meter_columns(key))


@query
def a04_content_hash(s, d):
    return tables.load(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query
def a05_dedup_against_store(s, d):
    return lists.seen_before(tables.extractions(s, d)).select("file_hash", "extraction_id", "status")


@query
def a06_import_upsert(s, d):
    store = tables.extractions(s, d).where("extraction_id % 2 = 0").select("extraction_id", "status", "confidence_score", "utility_provider")
    new = tables.extractions(s, d).where("extraction_id % 3 = 0").select("extraction_id", F.lit("reviewed").alias("status"), F.lit(0.5).alias("confidence_score"), F.lit("new").alias("utility_provider"))
    return lists.upsert(store, new, "extraction_id", ["status", "confidence_score"])


@query
def a09_response_json(s, d):
    return intake.parsed_responses(intake.rendered_responses(tables.load(s, d, "orders")))


@query
def a10_structured_invoice(s, d):
    return intake.structured_invoices(intake.rendered_attachments(tables.load(s, d, "orders")))


@query
def a11_document_text(s, d):
    return intake.document_text(tables.load(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")).select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"))


@query
def a12_document_quality(s, d):
    pages = tables.load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_discount").cast("decimal(4,2)").alias("quality"))
    return intake.document_quality(pages)


@query
def a13_page_sample(s, d):
    return intake.page_sample(tables.load(s, d, "conversations").select("conv_id", "turn").distinct(), "conv_id", "turn")


@query
def a14_language_vote(s, d):
    return intake.language_vote(tables.load(s, d, "documents"))


@query
def b01_list_extractions(s, d):
    return lists.list_extractions(tables.extractions(s, d), commodity="natural_gas", status="accepted", offset=10, limit=100).select("extraction_id", "created_at", "utility_provider")


@query
def b02_review_queue(s, d):
    return lists.review_queue(tables.extractions(s, d), order="priority", limit=80).select("extraction_id", "confidence_score")


@query
def b04_list_corrections(s, d):
    return learn.categorized(tables.corrections(s, d)).select("correction_id", "field_path", "category")


@query
def b05_list_calls(s, d):
    return lists.list_calls(tables.calls(s, d), stage="click", limit=120).select("call_id", "model", "preview")


@query
def b06_calls_by_extraction(s, d):
    return lists.in_order(tables.calls(s, d).where("extraction_id is not null"), "extraction_id", [F.col("created_at"), F.col("call_id")]).select("extraction_id", "call_id", "stage", "created_at", "place")


@query
def b07_corrections_by_context(s, d):
    return lists.corrections_by_context(tables.corrections(s, d), utility="City Gas", commodity="natural_gas", least=20).select("correction_id", "field_path")


@query
def b09_confidence_band(s, d):
    return rollups.count_by(lists.banded(tables.extractions(s, d)), "band")


@query
def b12_approve_green(s, d):
    return rollups.count_by(lists.approve_green(tables.extractions(s, d)), "status")


@query
def b15_last_corrections(s, d):
    return lists.last_edits(tables.corrections(s, d)).select("extraction_id", "field_path", "correction_id", "corrected_value")


@query
def b20_latest_job_status(s, d):
    e = tables.load(s, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("j")).select("user_id", F.col("j.event_type").alias("status"), F.col("j.event_id").alias("event_id"))


@query
def c01_corrections_with_context(s, d):
    return lists.with_context(tables.corrections(s, d), tables.extractions(s, d)).groupBy("utility", "commodity").agg(F.count(F.lit(1)).alias("n"))


@query
def c02_calls_with_extractions(s, d):
    return lists.calls_with_bills(tables.calls(s, d), tables.extractions(s, d)).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def c05_taxonomy_lookup(s, d):
    parts = tables.load(s, d, "part").select("p_partkey", "p_name")
    return learn.taxonomy_lookup(parts, dims.taxonomy(s), "p_name").select("p_partkey", "keyword", "tax_category", "tax_section")


@query
def c06_tolerance(s, d):
    return validate.with_tolerance(tables.extractions(s, d).select("extraction_id", "country_code")).select("extraction_id", F.col("base").cast("double").alias("base"), F.col("tax").cast("double").alias("tax"))


@query
def c11_not_seen(s, d):
    files = tables.extractions(s, d).select("file_hash").distinct()
    return lists.not_seen(files, tables.extractions(s, d))


@query
def c14_field_weight(s, d):
    return score.field_weight(tables.corrections(s, d).select("field_path").distinct()).select("field_path", "weight", F.col("penalty").cast("double").alias("penalty"))


@query
def c16_previous_run(s, d):
    return lists.previous_run(tables.extractions(s, d)).select("extraction_id", "previous_id", "previous_score", "previous_status")


@query
def d01_count_by_status(s, d):
    return rollups.count_by(tables.extractions(s, d), "status")


@query
def d03_field_path_groups(s, d):
    return rollups.field_path_groups(tables.corrections(s, d))


@query
def d05_correction_rules(s, d):
    return rollups.correction_rules(tables.corrections(s, d))


@query
def d06_rules_summary(s, d):
    return rollups.rules_summary(tables.corrections(s, d))


@query
def d07_correction_stats(s, d):
    return rollups.correction_stats(tables.corrections(s, d))


@query
def d08_calls_by_stage(s, d):
    return rollups.call_stats_by_stage(tables.calls(s, d))


@query
def d09_calls_by_model(s, d):
    return rollups.call_stats_by_model(tables.calls(s, d))


@query
def d10_call_cost(s, d):
    return rollups.call_cost(tables.calls(s, d)).select("model", F.col("cost").cast("double").alias("cost"))


@query
def d11_section_sums(s, d):
    return validate.section_sums(tables.charges(s, d)).select("extraction_id", "charge_section", F.col("computed").cast("double").alias("computed"), "n_lines")


@query
def d13_vat_by_rate(s, d):
    return validate.vat_by_rate(vat_charges(s, d)).select("extraction_id", F.col("vat_rate").cast("double").alias("vat_rate"), F.col("base_sum").cast("double").alias("base_sum"), F.col("vat_sum").cast("double").alias("vat_sum"))


@query
def d14_distinct_owners(s, d):
    return tables.charges(s, d).groupBy("extraction_id").agg(F.countDistinct(F.coalesce("charge_owner", F.lit("?"))).alias("owners"))


@query
def d18_fingerprint_accuracy(s, d):
    return learn.fingerprint_accuracy(tables.extractions(s, d))


@query
def d19_rule_candidates(s, d):
    return rollups.rule_candidates(tables.corrections(s, d)).select("field_path", "n", "suggestion", F.col("mean_off").cast("double").alias("mean_off"))


@query
def d20_unique_categories(s, d):
    return tables.corrections(s, d).select("correction_category").distinct()


@query
def g01_number_format(s, d):
    return text_rows(s, d).select("o_orderkey", text.number_format(F.concat(F.lit("Total due "), F.col("raw"), F.lit(" incl. "), F.col("raw"))).alias("number_format"))


@query
def g02_normalize_amounts(s, d):
    return text_rows(s, d).select("o_orderkey", text.amount(F.col("raw"), F.col("fmt")).cast("double").alias("amount"))


@query
def g04_detect_currency(s, d):
    return text_rows(s, d).select("o_orderkey", text.currency(F.col("raw")).alias("currency"))


@query
def g07_date_format(s, d):
    return date_rows(s, d).select("o_orderkey", text.date_format_of(F.concat(F.lit("Billed on "), F.col("raw"))).alias("date_format"))


@query
def g08_normalize_dates(s, d):
    return date_rows(s, d).select("o_orderkey", text.date(F.col("raw"), F.col("fmt")).cast("string").alias("day"))


@query
def g09_ambiguous_dates(s, d):
    return date_rows(s, d).select("o_orderkey", text.ambiguous_date(F.col("raw")).alias("ambiguous"))


@query
def g10_billing_period(s, d):
    li = tables.load(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b"))
    o = tables.load(s, d, "orders")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", text.billing_period(F.col("o_orderdate").cast("date"), F.col("b")).alias("verdict"))


@query
def g12_convert_units(s, d):
    key = F.col("extraction_id")
    rows = meters(s, d).select("extraction_id", F.col("raw_value").alias("value"), tables.pick(key % 5, "therm", "CCF", "MWh", "m3", "gal").alias("from_unit"), tables.pick(key % 3, "kWh", "therms", "m³").alias("to_unit"), F.when(key % 10 != 0, 11.5).alias("calorific_value"))
    return text.convert_units(text.normalize_units(rows, "from_unit")).select("extraction_id", F.round("converted", 4).alias("converted"), "unit_error")


@query
def g14_complexity(s, d):
    key = F.col("extraction_id")
    signals = F.array_compact(F.array(F.when(key % 2 == 0, "multi_meter"), F.when(key % 3 == 0, "tou_present"), F.when(key % 5 == 0, "net_metering"), F.when(key % 7 == 0, "tiered_rates"), F.when(key % 2 == 0, "unknown")))
    rows = tables.extractions(s, d).select("extraction_id", complexity.complexity_score(signals, key % 40, key % 8).alias("score"))
    return rows.withColumn("tier", complexity.complexity_tier(F.col("score")))


@query
def g16_correction_category(s, d):
    return rollups.count_by(learn.categorized(tables.corrections(s, d)), "inferred")


@query
def g18_first_number(s, d):
    return text_rows(s, d).select("o_orderkey", text.first_number(F.when(F.col("fmt") == "US", F.col("raw"))).alias("value"))


@query
def k02_tier(s, d):
    b = tables.extractions(s, d)
    return b.select("extraction_id", score.tier(F.col("confidence_score"), F.col("extraction_id") % 11 == 0, F.col("complexity_tier")).alias("tier"))


@query
def k05_audit_compare(s, d):
    return audit.compare(tables.extractions(s, d), audit.rendered_answers(tables.extractions(s, d)))


@query
def l02_top_fields(s, d):
    return rollups.top_fields(tables.corrections(s, d))


@query
def m02_few_shot_context(s, d):
    noted = tables.corrections(s, d).withColumn("reason", F.when(F.col("correction_category") == "ocr_confusion", "seen on the scan").when(F.col("correction_category") == "", ""))
    return learn.few_shot_context(noted)


@query
def m03_fingerprint_candidates(s, d):
    known = s.createDataFrame([("nation_1", "WATER"), ("NATION_3", "electricity")], "utility string, commodity string")
    return learn.fingerprint_candidates(tables.extractions(s, d), known)


@query
def r01_drift(s, d):
    return drift.changed_fields(lists.previous_run(tables.extractions(s, d)))


@query
def r02_drift_severity(s, d):
    return drift.summary(drift.changed_fields(lists.previous_run(tables.extractions(s, d))))


@query
def u02_audit_questions(s, d):
    return audit.questions(tables.extractions(s, d))


@query
def w01_latest_per_hash(s, d):
    return lists.latest_per_hash(tables.extractions(s, d)).select("file_hash", "extraction_id", "created_at")


@query
def v01_line_math(s, d):
    return validate.line_math(tables.charges(s, d), tables.extractions(s, d))


@query
def v02_section_totals(s, d):
    c = tables.charges(s, d)
    moved = F.when(F.col("extraction_id") % 4 == 0, F.lit("0.30")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    stated = c.groupBy("extraction_id", "charge_section").agg(F.sum("amount").cast(MONEY).alias("s")).where("charge_section <> 'other'").select("extraction_id", "charge_section", (F.col("s") + moved).cast(MONEY).alias("subtotal"))
    return validate.section_totals(c, stated, tables.extractions(s, d))


@query
def v03_current_charges(s, d):
    return validate.current_charges(tables.charges(s, d), tables.extractions(s, d))


@query
def v04_meter_reads(s, d):
    return validate.meter_reads(meters(s, d)).select("extraction_id", "rule_id", "severity")


@query
def v06_unit_mismatch(s, d):
    return validate.unit_mismatch(meters(s, d), tables.extractions(s, d))


@query
def v08_billing_days(s, d):
    return validate.billing_days(tables.extractions(s, d))


@query
def v09_negative_amounts(s, d):
    return validate.negative_amounts(tables.charges(s, d))


@query
def v10_demand_missing(s, d):
    return validate.demand_missing(tables.charges(s, d), tables.extractions(s, d))


@query
def v12_single_owner(s, d):
    return validate.single_owner(tables.charges(s, d), tables.extractions(s, d))


@query
def v13_vat_lines(s, d):
    return validate.vat_lines(vat_charges(s, d))


@query
def v15_vat_summary(s, d):
    c = vat_charges(s, d)
    off = F.when(F.col("extraction_id") % 5 == 0, F.lit("0.20")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    stated = validate.vat_by_rate(c).where("vat_rate > 0.02").select("extraction_id", "vat_rate", (F.col("base_sum") + off).cast(MONEY).alias("stated_base"), F.col("vat_sum").alias("stated_vat"))
    return validate.vat_summary(c, stated)


@query
def v18_gas_factors(s, d):
    return validate.gas_factors(meters(s, d)).select("extraction_id", "rule_id", "field", "severity")


@query
def v20_domain_check(s, d):
    key = F.col("extraction_id")
    bad = tables.extractions(s, d).withColumn("commodity_type", F.when(key % 9 == 0, "steam").otherwise(F.col("commodity_type")))
    bad = bad.withColumn("confidence_score", F.when(key % 10 == 3, 1.25).when(key % 10 == 7, -0.5).otherwise(F.col("confidence_score"))).withColumn("complexity_tier", F.when(key % 25 == 1, "easy").otherwise(F.col("complexity_tier")))
    return validate.domain_check(bad).select("extraction_id", "field", "severity")


@query
def u01_issue_counts(s, d):
    return validate.run_validation(tables.charges(s, d), tables.extractions(s, d)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def d16_disposition(s, d):
    bills = tables.extractions(s, d)
    return rollups.count_by(validate.disposition(validate.run_validation(tables.charges(s, d), bills), bills), "disposition")


@query
def x03_amount_sanity(s, d):
    key = F.col("extraction_id")
    total = F.when(key % 51 == 0, F.lit(0)).when(key % 50 == 0, F.col("stated_total") * 10).otherwise(F.col("stated_total")).cast(MONEY)
    b = tables.extractions(s, d).withColumn("original_string", F.concat(F.lit("1234"), F.substring(F.lit(",56789"), F.lit(1), F.when(key % 6 == 0, 0).otherwise(key % 6 + 1).cast("int")), F.lit(" €")))
    return usage.amount_sanity(b.withColumn("stated_total", total), F.lit(","))


@query
def x14_kpi(s, d):
    return rollups.kpi(tables.extractions(s, d))


@query
def x18_demand_ratchet(s, d):
    return usage.demand_ratchet(usage.monthly_demand(tables.load(s, d, "orders")))


@query
def x20_block_allocation(s, d):
    return usage.block_allocation(meters(s, d).select("extraction_id", F.col("raw_value").alias("quantity")), usage.blocks(s))


@query
def x21_budget_balance(s, d):
    return usage.budget_balance(tables.load(s, d, "orders"))


@query
def b11_status_update(s, d):
    bills = tables.extractions(s, d).select("extraction_id", "status", "confidence_score")
    approved = bills.where("status = 'pending_review' and extraction_id % 10 = 0").select("extraction_id", F.lit("accepted").alias("status"))
    return documents.updated(bills, approved, "extraction_id")


@query
def b14_correction_patch(s, d):
    c = tables.corrections(s, d).select("correction_id", "corrected_value", "correction_category")
    patch = c.where("correction_id % 7 = 0").select("correction_id", F.lit("fixed").alias("correction_category"), F.when(F.col("correction_id") % 2 == 0, F.lit("new")).alias("corrected_value"))
    return documents.deleted(documents.updated(c, patch, "correction_id"), c.where("correction_id % 11 = 0"), "correction_id")


@query
def b16_document_to_rows(s, d):
    rows = documents.charge_rows(documents.rendered(tables.charges(s, d)))
    return rows.groupBy("extraction_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"), F.round(F.sum("amount_confidence"), 3).alias("confidence"), F.count_if(F.col("category") == "other").alias("n_other"), F.count_if(F.col("corrupt")).alias("n_corrupt"), F.count("service_date").alias("n_dates"), F.count_if(F.startswith("line_id", F.lit("L"))).alias("n_numbered"))


@query
def b18_validation_flags(s, d):
    bills = tables.extractions(s, d)
    found = validate.run_validation(tables.charges(s, d), bills).unionByName(validate.unit_mismatch(meters(s, d), bills))
    return documents.flags(found, bills)


@query
def d23_mismatch_counts(s, d):
    bills = tables.extractions(s, d)
    answers = audit.rendered_answers(bills)
    return audit.mismatch_counts(audit.questions(bills), answers, audit.compare(bills, answers))


@query
def g05_detect_country(s, d):
    return locale_rows(s, d).select("o_orderkey", locale.country(F.col("text"), F.lit("xx"), F.lit(None).cast("string")).alias("country_code"))


@query
def g06_detect_locale(s, d):
    rows = locale_rows(s, d).withColumn("text", F.concat("text", F.lit(" 1.234,56 € am 03.02.2025")))
    return locale.locale(rows.withColumn("language", F.lit("de"))).select("o_orderkey", "country_code", "currency", "number_format", "date_format", "tax_regime")


@query
def g13_within_tolerance(s, d):
    rows = validate.with_tolerance(tables.charges(s, d).join(tables.extractions(s, d).select("extraction_id", "country_code"), "extraction_id"))
    off = F.abs(validate.cents(F.col("quantity") * F.col("rate")) - F.col("amount"))
    return rows.groupBy("country_code").agg(F.count_if(off <= F.col("base")).alias("within_base"), F.count_if(off <= F.col("tax")).alias("within_tax"), F.count(F.lit(1)).alias("n"))


@query
def g24_template_version(s, d):
    return tables.load(s, d, "benchmark").select("item_id", F.concat(F.lit("v1.0-"), F.left(F.sha2("text", 256), F.lit(8))).alias("version"))


@query
def k03_international_score(s, d):
    key = F.col("extraction_id")
    facts = tables.extractions(s, d).select("extraction_id", ((key % 10) / 10).alias("number_format_confidence"), (key % 3).alias("n_ambiguous_dates"), F.when(key % 7 == 0, 1).otherwise(0).alias("n_vat_errors"), F.when(key % 11 == 0, 2).otherwise(0).alias("n_conversion_errors"), tables.pick(key % 4, "en", "de", "pl", "fr").alias("language"))
    return score.route(score.international_penalties(facts), tables.extractions(s, d)).select("extraction_id", F.col("score").cast("double").alias("score"), "labels", "tier")


@query
def k06_audit_fill(s, d):
    bills = tables.extractions(s, d)
    return audit.filled(audit.questions(bills), audit.rendered_answers(bills)).groupBy("field_to_check").agg(F.count(F.lit(1)).alias("asked"), F.count("answer").alias("answered"))


@query
def m01_load_corrections(s, d):
    newest = tables.corrections(s, d).orderBy(F.desc("created_at"), F.desc("correction_id")).limit(1000)
    return learn.categorized(newest).select("correction_id", "category", "utility", "commodity")


@query
def r03_drift_cause(s, d):
    pairs = lists.previous_run(tables.extractions(s, d))
    known = lambda c: [tables.pick(F.col(c) % 5, "m1", "m1", "m1", "m1", "m2").alias("model"), (F.col(c) % 3).alias("prompt"), (F.col(c) % 2).alias("few_shot_hash")]
    facts = pairs.select("extraction_id", "previous_id", *known("extraction_id"), *(x.alias(f"previous_{n}") for x, n in zip(known("previous_id"), ("model", "prompt", "few_shot_hash"))))
    return drift.cause(facts, drift.summary(drift.changed_fields(pairs)))


@query
def x01_account_balance(s, d):
    key = F.col("o_orderkey")
    money = lambda c: c.cast(MONEY)
    total = money(F.col("o_totalprice"))
    rows = tables.load(s, d, "orders").select(key.alias("extraction_id"), money(key % 100).alias("previous_balance"), money(-(key % 100)).alias("payments"), F.when(key % 2 == 0, money(key % 3)).alias("late_fees"), total.alias("current_charges"), money(total + F.when(key % 5 == 0, money(key % 3)).otherwise(money(F.lit(0)))).alias("amount_due"))
    return usage.account_balance(rows).select("extraction_id", F.col("expected").cast("double").alias("expected"), F.col("amount_due").cast("double").alias("amount_due"))


@query
def x02_contracted_capacity(s, d):
    key = F.col("extraction_id")
    m = tables.extractions(s, d).select("extraction_id", (key % 100).alias("demand_value"), (key % 70).alias("contracted_value"))
    return usage.contracted_capacity(m, tables.charges(s, d)).select("extraction_id", "demand_value", "contracted_value")


@query
def x10_single_meter_linkage(s, d):
    m = meters(s, d).select("extraction_id", "meter_number")
    twice = m.union(m.where("extraction_id % 3 = 0").select("extraction_id", F.lit("second")))
    c = tables.charges(s, d).select("extraction_id", "line_number", F.when(F.col("line_number") == 1, F.lit("own")).alias("meter_number"))
    return rollups.count_by(usage.single_meter_linkage(c, twice), "meter_number")


@query
def x11_merged_extractions(s, d):
    key = F.col("extraction_id")
    one = tables.extractions(s, d).select("extraction_id", F.lit("a").alias("value"), ((key % 7) / 10).alias("confidence"))
    two = tables.extractions(s, d).where("extraction_id % 2 = 0").select("extraction_id", F.lit("b").alias("value"), ((key % 5) / 10).alias("confidence"))
    return documents.merged(one, two, ["extraction_id"])


@query
def x13_candidate_confidence(s, d):
    bills = tables.extractions(s, d)
    return usage.candidate_confidence(learn.categorized(lists.with_context(tables.corrections(s, d), bills)), bills)


@query
def x19_sewer_cap(s, d):
    o = tables.load(s, d, "orders")
    months = o.groupBy((F.col("o_custkey") % 30).alias("account"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).cast("double").alias("usage"))
    return usage.sewer_cap(months)


@query
def x22_tou_periods(s, d):
    li = tables.load(s, d, "lineitem")
    p = li.select(F.concat(F.lit("M"), (F.col("l_suppkey") % 20).cast("string")).alias("meter_number"), tables.pick(F.col("l_linenumber") % 6, "HT", " nt", "P1", "f2", "Night", "odd").alias("period"), F.col("l_quantity").alias("consumption"))
    return usage.tou_periods(p)


@query
def x23_net_metering(s, d):
    key = F.col("extraction_id")
    m = tables.extractions(s, d).select("extraction_id", (key % 500 * 1.0).alias("total"), (key % 60 * 1.0).alias("generation"), (key % 500 - key % 60 + F.when(key % 9 == 0, 3).otherwise(0)).cast("double").alias("net"))
    return usage.net_metering(m).select("extraction_id")


def locale_rows(s: SparkSession, d: str) -> DataFrame:
    """Two keywords of a country in each order's text."""
    codes = list(locale.KEYWORDS)
    words = [f"Bill: {locale.KEYWORDS[c][0]} and {locale.KEYWORDS[c][2]}" for c in codes]
    return tables.load(s, d, "orders").select("o_orderkey", tables.pick(F.col("o_orderkey") % len(codes), *words).alias("text"))


@query
def a15_unsupported_rows(s, d):
    docs = tables.load(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    pages = tables.load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.col("l_linestatus").alias("text"), F.col("l_discount").alias("quality"))
    return documents.never_vanish(docs, pages).groupBy("page_number").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"))


@query
def a18_reprocess_select(s, d):
    bills = tables.extractions(s, d)
    ids = bills.where("extraction_id % 6 = 0").select("extraction_id")
    files = bills.where("extraction_id % 5 = 0").select("file_hash").distinct()
    return documents.reprocess(ids, bills, files).select("extraction_id", "file_hash")


@query
def b13_result_update(s, d):
    bills = tables.extractions(s, d).select("extraction_id", "confidence_score", "complexity_tier")
    new = bills.where("extraction_id % 4 = 0").select("extraction_id", F.lit(0.99).alias("confidence_score"), F.when(F.col("extraction_id") % 8 == 0, "simple").alias("complexity_tier"))
    return documents.updated(bills, new, "extraction_id")


@query
def d15_any_demand(s, d):
    any_demand = tables.charges(s, d).groupBy("extraction_id").agg(F.bool_or(F.col("category") == "demand").alias("x"))
    return tables.extractions(s, d).select("extraction_id").join(any_demand, "extraction_id", "left").select("extraction_id", F.coalesce("x", F.lit(False)).alias("any_demand"))


@query
def d21_token_total(s, d):
    return rollups.call_stats_by_model(tables.calls(s, d)).agg(F.sum("total_tokens").alias("total_tokens"))


@query
def g15_signal_flags(s, d):
    key = F.col("extraction_id")
    signals = F.array_compact(F.array(F.when(key % 2 == 0, "demand_charges"), F.when(key % 3 == 0, "tou_present"), F.when(key % 5 == 0, "net_metering")))
    return tables.extractions(s, d).select("extraction_id", *complexity.signal_flags(signals))


@query
def g17_category_reasoning(s, d):
    return learn.categorized(tables.corrections(s, d)).select("correction_id", learn.reasoning(F.col("inferred"), F.col("field_path")).alias("reasoning"))


@query
def l01_newest_page(s, d):
    return lists.page(tables.load(s, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 40, 25)


@query
def x04_date_verdict(s, d):
    li = tables.load(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("b"))
    o = tables.load(s, d, "orders")
    verdict = text.date_verdict(F.col("o_orderdate").cast("date"), F.col("b"), text.ambiguous_date(F.date_format("o_orderdate", "dd/MM/yyyy")))
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", verdict.alias("severity")).where("severity is not null")


@query
def x09_charge_period(s, d):
    bills = tables.load(s, d, "orders").select(F.col("o_orderkey").alias("extraction_id"), F.col("o_orderdate").cast("date").alias("period_start"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("period_end"))
    c = tables.charges(s, d).select("extraction_id", "line_number", F.when(F.col("line_number") % 2 == 0, F.col("service_date").cast("date")).alias("period_start"), F.when(F.col("line_number") % 2 == 0, F.date_add(F.col("service_date").cast("date"), 7)).alias("period_end"))
    return documents.with_period(c, bills).groupBy("extraction_id").agg(F.min("period_start").cast("string").alias("first_day"), F.max("period_end").cast("string").alias("last_day"))


@query
def x12_weighted_confidence(s, d):
    li = tables.load(s, d, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), tables.pick(F.col("l_linenumber") % 4, "plain", "charge", "total", "account").alias("kind"), F.when(F.col("l_linenumber") != 5, 1 - F.col("l_discount")).alias("confidence"))
    return documents.weighted_confidence(li, {"charge": 1.5, "total": 2.0, "account": 3.0})


@query
def x16_mx_iva(s, d):
    net = (F.col("o_orderkey") % 5000 + 10).cast(MONEY)
    stated = tables.load(s, d, "orders").select(F.col("o_orderkey").alias("extraction_id"), net.alias("total_net"), (F.round(net * F.lit("1.16").cast("decimal(4,2)"), 2) + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast(MONEY).alias("total_gross"))
    return validate.mexican_vat(stated, tables.extractions(s, d))


@query
def x17_swiss_amounts(s, d):
    o = tables.load(s, d, "orders")
    raw = F.concat(F.lit("CHF "), F.translate(F.format_number(F.col("o_totalprice").cast(MONEY), 2), ",", "'"))
    return o.select("o_orderkey", text.swiss_amount(raw).cast("double").alias("amount"))


def text_rows(s: SparkSession, d: str) -> DataFrame:
    """Order totals rendered as a bill would print them."""
    o = tables.load(s, d, "orders").select("o_orderkey", "o_totalprice")
    us = F.format_number(F.col("o_totalprice").cast(MONEY), 2)
    eu, k = F.translate(us, ",.", ".,"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("$"), us)).when(k == 1, F.concat(F.lit("€ "), eu)).when(k == 2, F.concat(F.lit("("), us, F.lit(")"))).when(k == 3, F.concat(eu, F.lit("-"))).when(k == 4, F.concat(F.lit("EUR "), eu)).otherwise(F.concat(F.lit("R$ "), eu))
    return o.select("o_orderkey", raw.alias("raw"), F.when(k.isin(0, 2), "US").otherwise("EU").alias("fmt"))


def date_rows(s: SparkSession, d: str) -> DataFrame:
    """Order dates rendered in four ways."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd.MM.yyyy")).when(k == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return tables.load(s, d, "orders").select("o_orderkey", raw.alias("raw"), tables.pick(k, "YYYY-MM-DD", "DD.MM.YYYY", "DD/MM/YYYY", "MM/DD/YYYY").alias("fmt"))
