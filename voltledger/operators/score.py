"""Confidence scores and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims

SCORE = "decimal(18,4)"


#: SQL of a map from weights to what an error costs.
PENALTY_SQL = f"map({', '.join(f"'{w}', cast({cost} as decimal(4,2))" for w, cost in dims.ERROR_PENALTY.items())})"


def weight_sql(path: str) -> str:
    """SQL of the weight of a field: of the field of that name, else of the first in the list that the path contains, else low.
    The list is in the order of weights, so the first field contained has the first weight that any field contained has."""
    named = {w: [f for f, v in dims.FIELD_WEIGHTS if v == w] for w in dims.ERROR_PENALTY}
    same = [f"WHEN {path} IN ({', '.join(repr(f) for f in names)}) THEN '{w}'" for w, names in named.items()]
    inside = [f"WHEN rlike({path}, '{'|'.join(names)}') THEN '{w}'" for w, names in named.items() if w != "low"]
    return f"CASE {' '.join([*same, *inside])} ELSE 'low' END"


def penalty_of(weight: Column) -> Column:
    return F.coalesce(F.try_element_at(F.expr(PENALTY_SQL), weight), F.lit(dims.ERROR_PENALTY["low"]).cast("decimal(4,2)"))


def field_weight(rows: DataFrame, path: str = "field_path") -> DataFrame:
    """Adds weight and penalty of a field, as weight_sql and penalty_of give them."""
    return rows.withColumn("weight", F.expr(weight_sql(path))).withColumn("penalty", penalty_of(F.col("weight")))


def tier(score: Column, fatal: Column, complexity: Column) -> Column:
    hard = complexity.isin("complex", "pathological")
    return F.when(fatal, "full_review").when(score >= F.when(hard, F.lit(0.90)).otherwise(F.lit(0.95)), "auto_accept").when(score >= F.when(hard, F.lit(0.75)).otherwise(F.lit(0.82)), "targeted_review").otherwise("full_review")


def status_of(tier_: Column) -> Column:
    return F.when(tier_ == "auto_accept", "accepted").otherwise("pending_review")


def penalty_sum(penalties: DataFrame, bills: DataFrame) -> DataFrame:
    """penalties (extraction_id, label, amount, is_fatal): score is 1 less their sum, at least 0; labels in order."""
    sums = penalties.groupBy("extraction_id").agg(F.sum("amount").alias("off"), F.max(F.col("is_fatal").cast("int")).alias("fatal"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    rows = bills.join(sums, "extraction_id", "left")
    zero = F.lit(0).cast(SCORE)
    return rows.withColumn("score", F.greatest(zero, F.round(F.lit(1).cast(SCORE) - F.coalesce("off", zero), 4).cast(SCORE))).withColumn("fatal", F.coalesce(F.col("fatal") == 1, F.lit(False))).withColumn("labels", F.coalesce("labels", F.lit("")))


def issue_penalties(issues: DataFrame) -> DataFrame:
    """Warnings cost 0.03, errors 0.08, fatal ones all; info nothing."""
    cost = F.when(F.col("severity") == "fatal", "1.0000").when(F.col("severity") == "error", "0.0800").when(F.col("severity") == "warning", "0.0300").cast("decimal(18,4)")
    return issues.select("extraction_id", F.col("rule_id").alias("label"), cost.alias("amount"), (F.col("severity") == "fatal").alias("is_fatal")).where("amount is not null")


def low_confidence_penalties(fields: DataFrame) -> DataFrame:
    """fields (extraction_id, field_path, confidence): below 0.80 costs by weight, fatal 0.15, high 0.10, medium 0.04."""
    rows = field_weight(fields).where("confidence < 0.80")
    cost = F.when(F.col("weight") == "fatal", "0.15").when(F.col("weight") == "high", "0.10").when(F.col("weight") == "medium", "0.04").cast("decimal(18,4)")
    return rows.select("extraction_id", F.concat(F.lit("low_confidence:"), "field_path").alias("label"), cost.alias("amount"), (F.col("weight") == "fatal").alias("is_fatal")).where("amount is not null")


def full_penalties(issues: DataFrame, mismatches: DataFrame, fields: DataFrame, sources: DataFrame) -> DataFrame:
    """All that lowers a score: a line or total that doesn't add up (issues of severity warning or worse) by its field's weight, audit
    mismatches (extraction_id, field, severity) by their severity, fields of low confidence, and sources (extraction_id,
    image_quality, ocr_applied): quality below 0.6 costs 0.10, recognised text 0.03. A fatal weight or severity is fatal."""
    money = lambda c: c.cast("decimal(18,4)")
    wrong = field_weight(issues.where("severity in ('warning', 'error', 'fatal')").withColumnRenamed("field", "field_path"))
    math = wrong.select("extraction_id", F.concat(F.lit("math:"), "field_path").alias("label"), money(F.col("penalty")).alias("amount"), (F.col("weight") == "fatal").alias("is_fatal"))
    audit = mismatches.select("extraction_id", F.concat(F.lit("audit:"), "field").alias("label"), money(penalty_of(F.col("severity"))).alias("amount"), (F.col("severity") == "fatal").alias("is_fatal"))
    seen = F.array_compact(F.array(F.when(F.col("image_quality") < 0.6, F.struct(F.lit("image_quality").alias("label"), F.lit("0.10").alias("c"))), F.when(F.col("ocr_applied"), F.struct(F.lit("ocr").alias("label"), F.lit("0.03").alias("c")))))
    source = sources.select("extraction_id", F.inline(seen)).select("extraction_id", "label", money(F.col("c")).alias("amount"), F.lit(False).alias("is_fatal"))
    return math.unionByName(audit).unionByName(low_confidence_penalties(fields)).unionByName(source)


def tier_by_complexity(score: Column, fatal: Column, complexity: Column) -> Column:
    """The stricter routing: complex bills are always looked at, pathological ones in full; standard ones need 0.93."""
    return F.when(fatal | (complexity == "pathological"), "full_review").when(complexity == "complex", "targeted_review").when(score >= F.when(complexity == "standard", F.lit(0.93)).otherwise(F.lit(0.95)), "auto_accept").otherwise("targeted_review")


def route(penalties: DataFrame, bills: DataFrame) -> DataFrame:
    rows = penalty_sum(penalties, bills).withColumn("tier", tier(F.col("score"), F.col("fatal"), F.col("complexity_tier")))
    return rows.withColumn("routed_status", status_of(F.col("tier")))


def band(score: Column) -> Column:
    return F.when(score >= 0.90, "green").when(score >= 0.70, "yellow").otherwise("red")


def international_penalties(facts: DataFrame) -> DataFrame:
    """facts (extraction_id, number_format_confidence, n_ambiguous_dates, n_vat_errors, n_conversion_errors, language):
    0.10 for an unsure number format, 0.05 an ambiguous date, 0.12 a VAT error, 0.15 a conversion error, 0.05 a language
    that isn't one of seven."""
    known = ["en", "de", "fr", "es", "it", "nl", "pt"]
    costs = {
        "number_format": F.when(F.col("number_format_confidence") < 0.7, F.lit("0.10")),
        "ambiguous_dates": F.when(F.col("n_ambiguous_dates") > 0, F.col("n_ambiguous_dates") * F.lit("0.05").cast("decimal(4,2)")),
        "vat": F.when(F.col("n_vat_errors") > 0, F.col("n_vat_errors") * F.lit("0.12").cast("decimal(4,2)")),
        "conversion": F.when(F.col("n_conversion_errors") > 0, F.col("n_conversion_errors") * F.lit("0.15").cast("decimal(4,2)")),
        "language": F.when(~F.col("language").isin(known), F.lit("0.05")),
    }
    each = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("label"), c.cast("decimal(18,4)").alias("amount"), F.lit(False).alias("is_fatal"))) for n, c in costs.items())))
    return facts.select("extraction_id", F.inline(each))


def routed(bills: DataFrame) -> DataFrame:
    """Judged bills (cost, deadly, labels of rules) with arrays mismatches (field, severity) and fields (field_path, confidence), image_quality
    and ocr_applied: adds score, fatal, labels (of all that cost something, in order, joined by commas), tier and routed_status. It
    is what full_penalties and route give, worked out in the bill's own row."""
    one = lambda label, amount, fatal: f"named_struct('label', {label}, 'amount', cast({amount} as {SCORE}), 'fatal', {fatal})"
    low = dims.ERROR_PENALTY["low"]
    off = f"""transform(coalesce(mismatches, array()), m -> {one("concat('audit:', m.field)", f"coalesce(try_element_at({PENALTY_SQL}, m.severity), {low})", "coalesce(m.severity = 'fatal', false)")})"""
    weighed = f"transform(filter(coalesce(fields, array()), f -> f.confidence < 0.80D), f -> named_struct('path', f.field_path, 'weight', {weight_sql('f.field_path')}))"
    unsure = f"""transform(filter({weighed}, f -> f.weight <> 'low'), f -> {one("concat('low_confidence:', f.path)", "CASE f.weight WHEN 'fatal' THEN 0.15 WHEN 'high' THEN 0.10 ELSE 0.04 END", "f.weight = 'fatal'")})"""
    source = f"""array_compact(array(CASE WHEN image_quality < 0.6D THEN {one("'image_quality'", "0.10", "false")} END, CASE WHEN ocr_applied THEN {one("'ocr'", "0.03", "false")} END))"""
    rows = bills.withColumn("penalties", F.expr(f"concat({off}, {unsure}, {source})")).withColumns({
        "score": F.expr(f"greatest(cast(0 as {SCORE}), cast(1 - aggregate(penalties, cost, (a, p) -> cast(a + p.amount as {SCORE})) as {SCORE}))"), "fatal": F.expr("deadly OR exists(penalties, p -> p.fatal)"),
        "labels": F.expr("array_join(array_sort(array_distinct(concat(labels, transform(penalties, p -> p.label)))), ',')"),
    })
    rows = rows.withColumn("tier", tier(F.col("score"), F.col("fatal"), F.col("complexity_tier")))
    return rows.withColumn("routed_status", status_of(F.col("tier"))).drop("penalties")
