"""How hard a bill is to read, from its signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries whose bills count as European.
EUROPE = ["DE", "FR", "ES", "IT", "NL"]
# Signals that add three and one.
HIGH, MEDIUM = ["multi_meter", "net_metering", "prior_period_adjustments", "multi_page_charges"], ["tou_present", "demand_charges", "supplier_split", "tiered_rates"]


def complexity_score(signals: Column, lines: Column, pages: Column, vat_rates: Column | None = None, calorific: Column | None = None, capacity: Column | None = None) -> Column:
    """A signal counts as often as it is there; over 30 lines add three, over 15 one; over 5 pages two; several VAT rates two, a
    calorific conversion two, contracted capacity one."""
    of = F.aggregate(F.coalesce(signals, F.array().cast("array<string>")), F.lit(0), lambda a, s: a + F.when(s.isin(HIGH), 3).when(s.isin(MEDIUM), 1).otherwise(0))
    for flag, points in ((vat_rates, 2), (calorific, 2), (capacity, 1)):
        of = of if flag is None else of + F.when(flag, points).otherwise(0)
    return of + F.when(lines > 30, 3).when(lines > 15, 1).otherwise(0) + F.when(pages > 5, 2).otherwise(0)


def locale_additions(signals: Column, country: Column, language: Column, convention: Column) -> Column:
    """What a European bill and a rarer language add to the score."""
    has = lambda n: F.coalesce(F.array_contains(signals, n), F.lit(False))
    europe = F.when(has("multiple_vat_rates"), 2).otherwise(0) + F.when(has("calorific_conversion"), 1).otherwise(0) + F.when(has("contracted_capacity_by_period"), 2).otherwise(0) + F.when((country == "FR") & (convention == "TEMPO"), 2).otherwise(0)
    return F.when(country.isin(EUROPE), europe).otherwise(0) + F.when(language.isin("en", "de", "fr", "es", "it"), 0).otherwise(1)


def complexity_tier(score: Column) -> Column:
    return F.when(score <= 2, "simple").when(score <= 6, "standard").when(score <= 10, "complex").otherwise("pathological")


def signal_flags(signals: Column) -> list[Column]:
    """One boolean for each signal that later rules look at."""
    names = ["demand_charges", "tou_present", "supplier_split", "net_metering", "prior_period_adjustments"]
    return [F.coalesce(F.array_contains(signals, n), F.lit(False)).alias(f"has_{n}") for n in names]
