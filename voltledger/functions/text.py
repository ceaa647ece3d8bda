"""Numbers, dates, units and currencies out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims

# Currency marks, and codes that are looked for where no mark of the euro, pound or dollar is.
SYMBOLS, CODES = ["MX$", "R$", "€", "£", "$", "¥"], ["CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF"]
MARKED = ["EUR", "GBP", "MXN", "USD", "BRL"]


def number_format(text: Column) -> Column:
    """EU (1.234,56) or US (1,234.56): the form of two decimals that is seen more often, groups of thousands counting whole, else the
    plain decimal form; US by default."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    eu, us = n(r"\d{1,3}(?:\.\d{3})*,\d{2}\b"), n(r"\d{1,3}(?:,\d{3})*\.\d{2}\b")
    return F.when(eu > us, "EU").when(us > eu, "US").when(n(r"\d+,\d{2}\b") > n(r"\d+\.\d{2}\b"), "EU").otherwise("US")


def currency(text: Column) -> Column:
    """Euro, then pound, then the dollar, which is Mexican or Brazilian if the text says so anywhere, then the first of CODES."""
    has = lambda *marks: F.greatest(*(F.contains(text, F.lit(m)) for m in (*marks, marks[0])))
    out = F.when(has("€", "EUR"), "EUR").when(has("£", "GBP"), "GBP").when(has("$"), F.when(has("MXN", "MX$"), "MXN").when(has("R$"), "BRL").otherwise("USD"))
    for code in CODES:
        out = out.when(has(code), code)
    return out


def amount(text: Column, fmt: Column) -> Column:
    """Decimal value of an amount: marks, codes and blanks dropped; (x), -x and x- are negative; null if it isn't a number."""
    bare = F.regexp_replace(text, "MX\\$|R\\$|[€£$¥\\s]|" + "|".join([*MARKED, *CODES]), "")
    negative = F.regexp_like(bare, F.lit(r"^\(.*\)$|^-|-$"))
    digits = F.regexp_replace(bare, r"[()\-]", "")
    plain = F.when(fmt == "EU", F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    value = F.when(F.regexp_like(plain, F.lit(r"^\d+(\.\d+)?$")), plain.try_cast("decimal(18,2)"))
    return F.when(negative, -value).otherwise(value).cast("decimal(18,2)")


def date_format_of(text: Column) -> Column:
    """DD.MM.YYYY, else YYYY-MM-DD, else by the first slash date that only one order allows, else MM/DD/YYYY."""
    slashes = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), F.lit(1))
    part = lambda d, i: F.element_at(F.split(d, "/"), i).cast("int")
    kinds = F.filter(F.transform(slashes, lambda d: F.when(part(d, 1) > 12, "DD/MM/YYYY").when(part(d, 2) > 12, "MM/DD/YYYY")), lambda k: k.isNotNull())
    return F.when(F.regexp_like(text, F.lit(r"\b\d{1,2}\.\d{1,2}\.\d{4}\b")), "DD.MM.YYYY").when(F.regexp_like(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b")), "YYYY-MM-DD").otherwise(F.coalesce(F.get(kinds, 0), F.lit("MM/DD/YYYY")))


def date(text: Column, fmt: Column) -> Column:
    """ISO, dotted (day first), and slashes or dashes in the order of fmt, day first if it starts with DD; null if none fits."""
    text = F.trim(text)
    iso = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    dotted = F.when(F.regexp_like(text, F.lit(r"^\d{1,2}\.\d{1,2}\.\d{4}$")), F.try_to_timestamp(text, F.lit("d.M.yyyy")).cast("date"))
    parts = F.translate(text, "-", "/")
    slash = F.when(F.regexp_like(text, F.lit(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$")), F.when(F.startswith(fmt, F.lit("DD")), F.try_to_timestamp(parts, F.lit("d/M/yyyy"))).otherwise(F.try_to_timestamp(parts, F.lit("M/d/yyyy"))).cast("date"))
    return F.coalesce(iso, dotted, slash)


def date_error(text: Column, fmt: Column) -> Column:
    """Why there is no date: no text, or one that isn't a date in this format; null if there is one."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "no date").when(date(text, fmt).isNull(), "not a date")


def ambiguous_date(text: Column) -> Column:
    """Both parts could be the month, and they differ."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}$", i), F.lit("")).cast("int")
    return F.coalesce(part(1).between(1, 12) & part(2).between(1, 12) & (part(1) != part(2)), F.lit(False))


def billing_period(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    return F.when(days < 0, "invalid: ends before it starts").when(days == 0, "invalid: no days").when(days > 400, "invalid: too long").when((days < 15) | (days > 95), "unusual").otherwise("ok")


def first_number(text: Column) -> Column:
    """The first run of digits as a double, commas dropped, without a sign."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"\d+\.?\d*", 0), F.lit("")).try_cast("double")


def normalize_units(rows: DataFrame, unit: str = "unit") -> DataFrame:
    alias = F.broadcast(dims.unit_aliases(rows.sparkSession).withColumnRenamed("unit", "_unit"))
    return rows.join(alias, F.lower(F.trim(unit)) == F.col("alias"), "left").withColumn(unit, F.coalesce("_unit", F.trim(unit))).drop("alias", "_unit")


def canonical_unit(rows: DataFrame, commodity: str = "commodity_type", region: str = "region") -> DataFrame:
    """Adds canonical_unit: the unit that the commodity is reported in in the region, kWh if none is listed."""
    table = F.broadcast(dims.canonical_units(rows.sparkSession).toDF("_commodity", "_region", "canonical_unit"))
    joined = rows.join(table, (F.col(commodity) == F.col("_commodity")) & (F.col(region) == F.col("_region")), "left").drop("_commodity", "_region")
    return joined.withColumn("canonical_unit", F.coalesce("canonical_unit", F.lit("kWh")))


def convert_units(rows: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """rows with value, from_unit, to_unit, calorific_value: adds converted, or null and unit_error."""
    factor = F.broadcast(dims.conversions(rows.sparkSession) if factors is None else factors)
    cv = F.col("calorific_value")
    a, b = F.col("from_unit"), F.col("to_unit")
    out = rows.join(factor, ["from_unit", "to_unit"], "left")
    value = F.when(a == b, F.col("value")).when((a == "m³") & (b == "kWh"), F.col("value") * cv).when((a == "kWh") & (b == "m³"), F.try_divide(F.col("value"), cv)).otherwise(F.col("value") * F.col("factor"))
    return out.withColumn("converted", value).withColumn("unit_error", F.when(value.isNull() & F.col("value").isNotNull(), F.when(a.isin("m³", "kWh") & b.isin("m³", "kWh"), "no calorific value").otherwise("no factor"))).drop("factor")


def swiss_amount(text: Column) -> Column:
    """1'234.56, either apostrophe."""
    plain = F.regexp_replace(F.regexp_replace(text, r"CHF|\s", ""), "['’]", "")
    return F.when(F.regexp_like(plain, F.lit(r"^-?\d+(\.\d+)?$")), plain.try_cast("decimal(18,2)"))


def date_verdict(start: Column, end: Column, ambiguous: Column) -> Column:
    """fatal for a period of negative or over 400 days, warning for over 95 with an ambiguous date, else null."""
    days = F.datediff(end, start)
    return F.when((days < 0) | (days > 400), "fatal").when((days > 95) & ambiguous, "warning")
