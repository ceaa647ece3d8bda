"""Questions for an independent look at a bill, and comparison of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

BASE = ["total_amount_due", "account_number", "billing_period", "meter_count", "utility"]


def questions(bills: DataFrame) -> DataFrame:
    """One row per bill and field to ask for: five always, others as the bill's flags say."""
    more = [F.when(F.col("has_demand_charges"), "demand_value"), F.when(F.col("has_supplier_split"), "supplier_name"), F.when(F.col("commodity_type") == "natural_gas", "calorific_value")]
    return bills.select("extraction_id", F.explode(F.array_compact(F.array(*map(F.lit, BASE), *more))).alias("field_to_check"))


def rendered_answers(bills: DataFrame) -> DataFrame:
    """extraction_id, field, answer: some right, some off, some missing."""
    k = F.col("extraction_id") % 5
    total = F.when(k == 0, F.col("stated_total") + 1).when(k == 1, F.col("stated_total") + F.lit("0.50").cast("decimal(4,2)")).when(k != 4, F.col("stated_total"))
    account = F.when(k == 2, F.lit("A-0")).otherwise(F.concat(F.lit(" "), F.col("extraction_id").cast("string"), F.lit(" ")))
    return bills.select("extraction_id", F.inline(F.array(F.struct(F.lit("total_amount_due").alias("field"), F.concat(F.lit("$ "), total.cast("decimal(18,2)").cast("string")).alias("answer")), F.struct(F.lit("account_number").alias("field"), account.alias("answer"))))).where("answer is not null")


TYPED = ("total_amount_due", "meter_count", "account_number")


def answers_by_field(answers: DataFrame) -> DataFrame:
    """Answers (extraction_id, field, answer) as one row per bill, said_ and the field's name; of several to one field the greatest."""
    return answers.groupBy("extraction_id").agg(*(F.max(F.when(F.col("field") == f, F.col("answer"))).alias(f"said_{f}") for f in TYPED))


def mismatches() -> Column:
    """Of a bill (stated_total, n_meters, account_number) beside its answers by field, an array of field and severity: a total over
    0.50 off or another account number (trimmed) is fatal, another number of meters high. A missing or unreadable side is no mismatch."""
    number = lambda f: text.first_number(F.col(f"said_{f}"))
    checks = [
        ("total_amount_due", "fatal", F.abs(number("total_amount_due").cast("decimal(18,2)") - F.col("stated_total")) > F.lit("0.50").cast("decimal(4,2)")),
        ("meter_count", "high", number("meter_count").cast("int") != F.col("n_meters")),
        ("account_number", "fatal", F.trim("said_account_number") != F.trim("account_number")),
    ]
    return F.array_compact(F.array(*(F.when(off, F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"))) for f, s, off in checks)))


def typed_mismatches(bills: DataFrame, answers: DataFrame) -> DataFrame:
    """The mismatches of bills and answers, one row each."""
    return bills.join(answers_by_field(answers).hint("merge"), "extraction_id").select("extraction_id", F.inline(mismatches()))


def compare(bills: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that don't match: a total over 0.50 off is fatal, another account number too. A missing side matches."""
    said = answers.groupBy("extraction_id").agg(*(F.max(F.when(F.col("field") == f, F.col("answer"))).alias(f) for f in ("total_amount_due", "account_number")))
    rows = bills.join(said.hint("merge"), "extraction_id")
    off = F.abs(text.first_number(F.col("total_amount_due")).cast("decimal(18,2)") - F.col("stated_total")) > F.lit("0.50").cast("decimal(4,2)")
    other = F.trim("account_number") != F.col("extraction_id").cast("string")
    found = F.array_compact(F.array(F.when(off, F.lit("total_amount_due")), F.when(other, F.lit("account_number"))))
    return rows.select("extraction_id", F.explode(found).alias("field"), F.lit("fatal").alias("severity"))


def filled(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question with its answer, by field, else, where both sides have a column question, by the question's words."""
    key = ["extraction_id", "field_to_check"]
    named = answers.select("extraction_id", F.col("field").alias("field_to_check"), F.col("answer").alias("a")).where("field_to_check is not null")
    out = asked.join(named.hint("shuffle_hash"), key, "left")
    if "question" not in asked.columns or "question" not in answers.columns:
        return out.select(*key, F.col("a").alias("answer"))
    worded = answers.where("question is not null").groupBy("extraction_id", "question").agg(F.max("answer").alias("q"))
    return out.join(worded.hint("shuffle_hash"), ["extraction_id", "question"], "left").select(*key, F.coalesce("a", "q").alias("answer"))


def mismatch_counts(asked: DataFrame, answers: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Per bill: questions answered, matched, mismatched."""
    checked = filled(asked, answers).groupBy("extraction_id").agg(F.count("answer").alias("checked"))
    off = mismatches.groupBy("extraction_id").agg(F.count(F.lit(1)).alias("mismatched"))
    return checked.join(off.hint("merge"), "extraction_id", "left").select("extraction_id", "checked", (F.col("checked") - F.coalesce("mismatched", F.lit(0))).alias("matched"), F.coalesce("mismatched", F.lit(0)).alias("mismatched"))
