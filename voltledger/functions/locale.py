"""Country, currency and formats of a bill's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as texts

# Words that tell a country.
KEYWORDS = {
    "DE": ["Netzentgelte", "Stromsteuer", "EEG", "Brennwert", "Zustandszahl", "Grundpreis", "Arbeitspreis", "BNetzA", "Zähler"],
    "FR": ["TURPE", "CSPE", "TCFE", "CTA", "TVA", "Abonnement", "Consommation", "PDL", "Heures Pleines", "Heures Creuses"],
    "ES": ["Peaje", "IVA", "CUPS", "Potencia contratada", "Energía activa", "Impuesto"],
    "IT": ["Oneri di sistema", "IVA", "POD", "Accisa", "Imposte", "Trasporto", "Gestione contatore"],
    "GB": ["CCL", "DUoS", "TNUoS", "BSUoS", "MPAN", "Capacity Market", "Standing charge", "pence per kWh"],
    "NL": ["Energiebelasting", "ODE", "Transportkosten", "EAN", "Vastrecht", "Leveringskosten"],
    "MX": ["CFE", "DAC", "CFDI", "IVA", "DAP", "Factor de potencia"],
    "US": ["kWh", "therms", "CCF", "MCF", "Sales tax", "Franchise fee", "Delivery charges"],
}
# Countries of currencies, and of a language together with the euro.
CURRENCY_COUNTRY = {"GBP": "GB", "USD": "US", "MXN": "MX", "CHF": "CH", "SEK": "SE", "NOK": "NO", "DKK": "DK", "PLN": "PL", "CZK": "CZ", "HUF": "HU", "BRL": "BR"}
EURO_COUNTRY = {"de": "DE", "fr": "FR", "it": "IT", "es": "ES", "nl": "NL", "pt": "PT", "el": "GR", "fi": "FI"}
# Tax rules by country.
TAX_REGIME = dict.fromkeys(["DE", "FR", "ES", "IT", "NL", "PT", "GR", "FI", "AT", "BE", "IE"], "eu_vat") | {"GB": "uk_vat", "MX": "mx_iva", "US": "us_sales_tax"}
# Markets by country, signs of currencies.
MARKET = dict.fromkeys(["DE", "FR", "ES", "IT", "NL", "GB", "AT", "BE", "FI", "SE", "NO", "DK"], "liberalized_eu") | {"US": "deregulated"}
SIGNS = {"EUR": "€", "GBP": "£", "USD": "$", "MXN": "$", "CHF": "CHF", "SEK": "kr", "NOK": "kr", "DKK": "kr"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def country(text: Column, language: Column, currency: Column) -> Column:
    """By the currency, else by language and euro, else by the most keywords (the first country of those that tie)."""
    upper = F.upper(text)
    hits = [F.struct(sum((F.contains(upper, F.lit(w.upper())).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, words) in enumerate(KEYWORDS.items())]
    best = F.array_max(F.array(*hits))
    return F.coalesce(_mapped(currency, CURRENCY_COUNTRY), F.when(currency == "EUR", _mapped(language, EURO_COUNTRY)), F.when(best["n"] > 0, best["c"]))


def locale(rows: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Adds country_code, currency, number_format, date_format, tax_regime (us_sales_tax by default)."""
    t = F.col(text)
    out = rows.withColumn("currency", texts.currency(t)).withColumn("country_code", country(t, F.col(language), F.col("currency")))
    return out.withColumn("number_format", texts.number_format(t)).withColumn("date_format", texts.date_format_of(t)).withColumn("tax_regime", F.coalesce(_mapped(F.col("country_code"), TAX_REGIME), F.lit("us_sales_tax")))


def whole_locale(rows: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """locale, and language_code, currency_code, currency_symbol, decimal_separator, thousands_separator, market_model: English, the
    dollar, US separators and a regulated market where the text tells nothing else."""
    out = locale(rows, text, language).withColumn("currency_code", F.coalesce("currency", F.lit("USD")))
    european = F.col("number_format") == "EU"
    return out.withColumns({
        "language_code": F.coalesce(F.nullif(language, F.lit("")), F.lit("en")), "currency_symbol": F.coalesce(_mapped(F.col("currency_code"), SIGNS), F.lit("$")),
        "decimal_separator": F.when(european, ",").otherwise("."), "thousands_separator": F.when(european, ".").otherwise(","), "market_model": F.coalesce(_mapped(F.col("country_code"), MARKET), F.lit("regulated")),
    })
