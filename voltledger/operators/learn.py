"""Why a field was corrected, what recurs, and which lines fit a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import names

# Characters that scans confuse.
OCR_PAIRS = ["0O", "1l", "1I", "5S", "8B", "2Z", "6G", "0Q"]
# What in a path tells a date or a number.
DATE_WORDS, NUMBER_WORDS = "date|period|start|end|due|billing", "amount|total|charge|cost|price|quantity|consumption|reading"


def _year_changed(a: Column, b: Column) -> Column:
    """Only the year of the first date differs, be it 2023-8-21 or 21 AGO 23."""

    def differ(pattern: str, year: int, *others: int) -> Column:
        part = lambda c, i: F.lower(F.regexp_extract(c, pattern, i))
        out = (part(a, year) != "") & (part(b, year) != "") & (part(a, year) != part(b, year))
        for i in others:
            out = out & (part(a, i) == part(b, i))
        return out

    return differ(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3) | differ(r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{2})", 3, 1, 2)


def _confused(a: Column, b: Column) -> Column:
    """Same length, one or two characters differ, each by a known pair."""
    either = F.array(*(F.lit(p) for p in [*OCR_PAIRS, *(p[::-1] for p in OCR_PAIRS)]))
    differ = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.concat(x, y))), lambda p: p.isNotNull())
    return (F.length(a) == F.length(b)) & F.size(differ).between(1, 2) & F.forall(differ, lambda p: F.array_contains(either, p))


def correction_category(path: Column, before: Column, after: Column) -> Column:
    """Of the values without blanks around them the first that applies: nothing before or after: missing_context; either blank: other; only a year of a date changed:
    wrong_on_document; characters cut off, or blanks or dashes evened out: format_normalize; ocr_error; both numbers in a number
    field: calculation_error; other."""
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    dashed = lambda c: F.regexp_replace(c, "[–—]", "-")
    number = lambda c: F.regexp_like(F.regexp_replace(c, r"[$€£¥,\s]", ""), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)$"))
    before, after = (F.regexp_replace(c, r"^\s+|\s+$", "") for c in (before, after))
    shorter = F.length(after) < F.length(before)
    return (
        F.when(before.isNull() | after.isNull(), "missing_context")
        .when((before == "") | (after == ""), "other")
        .when(F.lower(path).rlike(DATE_WORDS) & _year_changed(before, after), "wrong_on_document")
        .when(shorter & (F.startswith(F.lower(before), F.lower(after)) | F.endswith(before, after)), "format_normalize")
        .when((squeezed(before) == squeezed(after)) | (dashed(before) == dashed(after)), "format_normalize")
        .when(_confused(before, after), "ocr_error")
        .when(F.lower(path).rlike(NUMBER_WORDS) & number(before) & number(after), "calculation_error")
        .otherwise("other")
    )


def categorized(corrections: DataFrame) -> DataFrame:
    """The stored category, else the inferred one."""
    return corrections.withColumn("inferred", correction_category(F.col("field_path"), F.col("extracted_value"), F.col("corrected_value"))).withColumn("category", F.coalesce(F.nullif("correction_category", F.lit("")), "inferred"))


def fingerprint_candidates(bills: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """Utility and commodity pairs of at least so many bills that no known fingerprint covers, whatever the case."""
    keys = [F.lower("utility_provider").alias("utility"), F.lower("commodity_type").alias("commodity")]
    groups = bills.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    covered = known.select(F.lower("utility").alias("utility"), F.lower("commodity").alias("commodity")).distinct()
    return groups.join(covered, ["utility", "commodity"], "left_anti")


def fingerprint_accuracy(bills: DataFrame) -> DataFrame:
    ok = (F.col("status") == "accepted").cast("int")
    return bills.groupBy("utility_provider", "commodity_type").agg(F.count(F.lit(1)).alias("processed"), F.round(F.coalesce(F.sum(ok) / F.count(F.lit(1)), F.lit(0.0)), 6).alias("accuracy"))


def taxonomy_lookup(rows: DataFrame, taxonomy: DataFrame, text: str) -> DataFrame:
    """Adds the category of the first keyword of the taxonomy that the text contains. Each distinct text is looked up once."""
    hit = names.contained(rows.select(F.col(text).alias("text")), taxonomy.select("ordinal", F.col("keyword").alias("name"), "tax_category", "tax_section"))
    first = hit.groupBy(F.col("text").alias(text)).agg(F.min(F.struct("ordinal", "name", "tax_category", "tax_section")).alias("m")).select(text, F.col("m.name").alias("keyword"), "m.tax_category", "m.tax_section", "m.ordinal")
    return rows.hint("merge").join(first.hint("merge"), text, "left")


#: What each category means, in words of our own.
MEANING = {"ocr_error": "misread characters", "format_normalize": "format evened out", "wrong_on_document": "the document itself is wrong", "missing_context": "context was missed", "calculation_error": "wrong arithmetic", "other": "another correction"}


def meanings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MEANING.items()), "category string, meaning string")


def reasoning(category: Column, path: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """A sentence on why a field, named by the last part of its path, was corrected. With values, an evened-out format says whether characters
    behind were removed, and a wrong document whether a date's year was."""
    said = None
    for name, meaning in MEANING.items():
        said = F.when(category == name, meaning) if said is None else said.when(category == name, meaning)
    said = F.coalesce(said, F.lit("another correction"))
    if before is not None and after is not None:
        cut = (category == "format_normalize") & F.startswith(before, after) & (F.length(after) < F.length(before))
        said = F.when(cut, F.concat(F.lit("trailing "), F.concat(F.lit("'"), F.substring(before, F.length(after) + 1, F.length(before)), F.lit("'")), F.lit(" removed"))).when((category == "wrong_on_document") & _year_changed(before, after), "only the year of the date was wrong").otherwise(said)
    return F.concat(F.element_at(F.split(path, r"\."), -1), F.lit(": "), said)


def few_shot_context(corrections: DataFrame, least: int = 2, k: int = 5, examples: int = 3) -> DataFrame:
    """Per utility and commodity a text of the k most frequent field paths that occur at least so often (ties by path): each with
    what its most frequent category means, if that is a known one, why by its first example, and its first examples with their
    notes (column reason, if there is one). Pairs without such a path have no row."""
    keys = ["utility", "commodity", "field_path"]
    each = categorized(corrections)
    note = F.col("reason") if "reason" in corrections.columns else F.lit(None).cast("string")
    groups = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.mode("category", True).alias("category"))
    order = Window.partitionBy("utility", "commodity").orderBy(F.desc("n"), "field_path")
    top = groups.where(F.col("n") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    first = each.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "correction_id"))).where(F.col("rn") <= examples)
    shown = F.struct("rn", F.col("extracted_value").alias("a"), F.col("corrected_value").alias("b"), note.alias("note"))
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(shown)).alias("shown"))
    none = lambda c: F.coalesce(c, F.lit("none"))
    line = lambda x: F.concat(F.lit("- `"), none(x["a"]), F.lit("` -> `"), none(x["b"]), F.lit("`"), F.coalesce(F.concat(F.lit(" ("), F.nullif(x["note"], F.lit("")), F.lit(")")), F.lit("")))
    meaning = F.coalesce(*(F.when(F.col("category") == name, F.lit(f": {text}")) for name, text in MEANING.items()), F.lit(""))
    at = F.element_at("shown", 1)
    head = F.concat(F.format_string("### %s (%d corrections)", "field_path", "n"), meaning, F.lit("\nWhy: "), reasoning(F.col("category"), F.col("field_path"), at["a"], at["b"]))
    block = F.concat(head, F.lit("\n"), F.array_join(F.transform("shown", line), "\n"))
    rows = top.join(lists, keys).withColumn("block", block)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"])
    return rows.groupBy("utility", "commodity").agg(F.concat(F.lit("## Known corrections\n\n"), F.array_join(blocks, "\n\n")).alias("context")).withColumn("context_hash", F.sha2("context", 256))


def pattern_groups(corrections: DataFrame, utility: str | None = None, commodity: str | None = None, examples: int = 3) -> DataFrame:
    """Per field path: n, the most frequent category (ties by name) with its meaning, the first examples with their reasons; the most
    frequent first, ties by the first correction."""
    for column, value in (("utility", utility), ("commodity", commodity)):
        if value is not None:
            corrections = corrections.where(F.lower(column) == value.lower())
    each = categorized(corrections)
    shown = F.concat_ws(" -> ", F.coalesce("extracted_value", F.lit("none")), "corrected_value", reasoning(F.col("category"), F.col("field_path"), F.col("extracted_value"), F.col("corrected_value")))
    ranked = each.withColumn("rn", F.row_number().over(Window.partitionBy("field_path").orderBy("created_at", "correction_id"))).where(F.col("rn") <= examples)
    lists = ranked.groupBy("field_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", shown.alias("t")))), lambda x: x["t"]), "|").alias("examples"))
    groups = each.groupBy("field_path").agg(F.count(F.lit(1)).alias("n"), F.mode("category", True).alias("category"), F.min(F.struct("created_at", "correction_id")).alias("seq"))
    rows = groups.join(lists, "field_path").join(F.broadcast(meanings(corrections.sparkSession)), "category", "left")
    return rows.orderBy(F.desc("n"), "seq").select("field_path", "n", "category", "meaning", "examples")


def fingerprint_match(bills: DataFrame, known: DataFrame) -> DataFrame:
    """extraction_id, fingerprint_id: the known fingerprint (fingerprint_id, utility, commodity, created_at) of each bill's utility and
    commodity, whatever the case; of several the first created, ties by id; null if none."""
    first = known.groupBy(F.lower("utility").alias("u"), F.lower("commodity").alias("c")).agg(F.min(F.struct("created_at", "fingerprint_id"))["fingerprint_id"].alias("fingerprint_id"))
    return bills.select("extraction_id", F.lower("utility_provider").alias("u"), F.lower("commodity_type").alias("c")).join(first, ["u", "c"], "left").select("extraction_id", "fingerprint_id")


def charge_lookup(charges: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """charges (country_code, description) with category, section and translation of the first name in the country's taxonomy that the
    description contains, whatever the case; null if none. Each distinct description is looked up once."""
    hit = names.contained(charges.select(F.col("country_code").alias("country"), F.col("description").alias("text")), taxonomy, ("country",))
    first = hit.groupBy(F.col("country").alias("country_code"), F.col("text").alias("description")).agg(F.min(F.struct("ordinal", "tax_category", "tax_section", "translation")).alias("m"))
    return charges.hint("merge").join(first.hint("merge"), ["country_code", "description"], "left").select(*charges.columns, "m.tax_category", "m.tax_section", "m.translation")
