"""Small lookup tables as DataFrames; every one of them is a constant list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rounding tolerance by country, base and tax.
TOLERANCES = [("DE", "0.02", "0.04"), ("FR", "0.05", "0.10"), ("ES", "0.02", "0.04"), ("UK", "0.01", "0.02"), ("GB", "0.01", "0.02"), ("IT", "0.02", "0.04"), ("NL", "0.02", "0.04"), ("US", "0.05", "0.05"), ("MX", "0.05", "0.05")]
DEFAULT_TOLERANCE = ("0.05", "0.10")
# Fields by weight, in the order in which they are looked for, and what an error in them costs.
FIELD_WEIGHTS = [
    ("total_amount_due", "fatal"), ("account_number", "fatal"), ("billing_period", "fatal"), ("commodity_type", "fatal"), ("meter_consumption", "fatal"), ("meter_multiplier", "fatal"),
    ("current_charges", "high"), ("demand_value", "high"), ("rate_schedule", "high"), ("section_subtotals", "high"), ("tou_breakdown", "high"), ("net_metering_values", "high"),
    ("individual_charge_amounts", "medium"), ("charge_classifications", "medium"), ("meter_read_dates", "medium"), ("supplier_name", "medium"),
    ("rider_descriptions", "low"), ("billing_address", "low"), ("late_fees", "low"), ("previous_balance", "low"),
]
ERROR_PENALTY = {"fatal": "1.00", "high": "0.20", "medium": "0.08", "low": "0.03"}
# Factors between units.
CONVERSIONS = [("therms", "kWh", 29.3071), ("CCF", "therms", 1.037), ("MCF", "therms", 10.37), ("dekatherms", "therms", 10.0), ("GJ", "kWh", 277.778), ("MWh", "kWh", 1000.0), ("gallons", "m³", 0.00378541), ("CCF_water", "gallons", 748.0)]
# Further factors, and those of another, looser set.
MORE_CONVERSIONS = [("MJ", "kWh", 1 / 3.6), ("liters", "m³", 0.001), ("CCF_water", "m³", 2.8317), ("dekatherms", "kWh", 293.071)]
LOOSE_CONVERSIONS = [("CCF", "therms", 1.0), ("MCF", "therms", 10.0), ("GJ", "therms", 9.4804), ("kVA", "kW", 0.9), ("HP", "kW", 0.746)]
# Names of charges by country, with category, section and translation, in the order in which they are looked for.
CHARGES = {
    "DE": [("Arbeitspreis", "energy", "supply", "Energy Charge (Working Price)"), ("Grundpreis", "fixed", "supply", "Standing Charge (Base Price)"), ("Netzentgelt", "rider", "distribution", "Network Charge"), ("Messstellenbetrieb", "fixed", "distribution", "Metering Operation"), ("Stromsteuer", "tax", "taxes", "Electricity Tax"), ("EEG-Umlage", "rider", "taxes", "Renewable Energy Levy"), ("KWK-Umlage", "rider", "taxes", "CHP Levy"), ("Konzessionsabgabe", "rider", "taxes", "Concession Fee"), ("Offshore-Netzumlage", "rider", "taxes", "Offshore Grid Levy"), ("StromNEV-Umlage", "rider", "taxes", "Grid Cost Levy"), ("CO2-Abgabe", "tax", "taxes", "CO2 Tax"), ("Brennwert", "other", "other", "Calorific Value"), ("Zustandszahl", "other", "other", "Volume Correction Factor")],
    "FR": [("Abonnement", "fixed", "supply", "Subscription Fee"), ("Consommation", "energy", "supply", "Energy Consumption"), ("TURPE", "rider", "distribution", "Grid Access Charge"), ("CSPE", "rider", "taxes", "Public Electricity Service Contribution"), ("TCFE", "tax", "taxes", "Final Electricity Consumption Tax"), ("CTA", "rider", "taxes", "Tariff Contribution"), ("TVA", "tax", "taxes", "VAT"), ("Heures Pleines", "energy", "supply", "Peak Hours"), ("Heures Creuses", "energy", "supply", "Off-Peak Hours")],
    "ES": [("Energía activa", "energy", "supply", "Active Energy"), ("Potencia contratada", "demand", "distribution", "Contracted Power"), ("Potencia facturada", "demand", "distribution", "Billed Power"), ("Peaje de acceso", "rider", "distribution", "Access Toll"), ("Impuesto eléctrico", "tax", "taxes", "Electricity Tax"), ("IVA", "tax", "taxes", "VAT"), ("Alquiler contador", "fixed", "distribution", "Meter Rental")],
    "UK": [("Unit Rate", "energy", "supply", "Unit Rate"), ("Standing Charge", "fixed", "supply", "Standing Charge"), ("CCL", "tax", "taxes", "Climate Change Levy"), ("DUoS", "rider", "distribution", "Distribution Use of System"), ("TNUoS", "rider", "distribution", "Transmission Use of System"), ("BSUoS", "rider", "distribution", "Balancing Services Use of System"), ("Capacity Market", "rider", "distribution", "Capacity Market Charge"), ("FiT", "credit", "supply", "Feed-in Tariff"), ("RO", "rider", "taxes", "Renewables Obligation"), ("VAT", "tax", "taxes", "Value Added Tax")],
    "IT": [("Energia", "energy", "supply", "Energy"), ("Trasporto e gestione del contatore", "rider", "distribution", "Transport and Meter Management"), ("Oneri di sistema", "rider", "taxes", "System Charges"), ("Accisa", "tax", "taxes", "Excise Duty"), ("IVA", "tax", "taxes", "VAT"), ("Canone RAI", "rider", "taxes", "TV License Fee")],
    "NL": [("Leveringskosten", "energy", "supply", "Supply Costs"), ("Vastrecht", "fixed", "supply", "Standing Charge"), ("Transportkosten", "rider", "distribution", "Transport Costs"), ("Energiebelasting", "tax", "taxes", "Energy Tax"), ("ODE", "tax", "taxes", "Renewable Energy Surcharge (ODE)"), ("BTW", "tax", "taxes", "VAT"), ("Belastingvermindering", "credit", "taxes", "Tax Reduction")],
    "MX": [("Energía", "energy", "supply", "Energy"), ("Demanda", "demand", "supply", "Demand"), ("Distribución", "rider", "distribution", "Distribution"), ("Capacidad", "demand", "distribution", "Capacity"), ("DAP", "rider", "taxes", "Public Lighting Charge"), ("IVA", "tax", "taxes", "VAT (IVA)"), ("Factor de potencia", "penalty", "other", "Power Factor"), ("Suministro", "fixed", "supply", "Supply Fee")],
}
# Spellings of units.
UNIT_ALIASES = [("kwh", "kWh"), ("kw", "kW"), ("mwh", "MWh"), ("mw", "MW"), ("therm", "therms"), ("thm", "therms"), ("ccf", "CCF"), ("mcf", "MCF"), ("dth", "dekatherms"), ("dekatherm", "dekatherms"), ("gj", "GJ"), ("m3", "m³"), ("m^3", "m³"), ("cbm", "m³"), ("cubic meters", "m³"), ("cubic metres", "m³"), ("gal", "gallons"), ("gallon", "gallons"), ("kva", "kVA"), ("kvar", "kVAR")]
# The unit that a commodity is reported in.
CANONICAL_UNITS = [("electricity", "US", "kWh"), ("electricity", "EU", "kWh"), ("natural_gas", "US", "therms"), ("natural_gas", "EU", "kWh"), ("water", "US", "gallons"), ("water", "EU", "m³")]
#: Prices per 1000 tokens, input and output: a parameter of the cost report; unlisted models take the default.
PRICES = [("small", "0.000150", "0.000600"), ("large", "0.003000", "0.015000"), ("vision", "0.002500", "0.010000")]
DEFAULT_PRICE = ("0.003000", "0.015000")
#: Words of the parts' names as a stand-in taxonomy: keyword, category, section, in the order in which they are looked for.
TAXONOMY = [("ring", "energy", "supply"), ("plate", "fixed", "distribution"), ("widget", "demand", "supply"), ("red", "tax", "taxes"), ("small", "rider", "distribution"), ("steel", "credit", "other")]


def tolerances(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOLERANCES, "country string, base string, tax string").selectExpr("country", "cast(base as decimal(4,2)) base", "cast(tax as decimal(4,2)) tax")


def field_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f, w, ERROR_PENALTY[w]) for i, (f, w) in enumerate(FIELD_WEIGHTS)], "ordinal int, field string, weight string, penalty string").selectExpr("ordinal", "field", "weight", "cast(penalty as decimal(4,2)) penalty")


def conversions(spark: SparkSession) -> DataFrame:
    """Both directions of each factor."""
    both = [*CONVERSIONS, *((b, a, 1 / f) for a, b, f in CONVERSIONS)]
    return spark.createDataFrame(both, "from_unit string, to_unit string, factor double")


def more_conversions(spark: SparkSession, loose: bool = False) -> DataFrame:
    """The factors with further units, or with those of the looser set in place of the same pairs."""
    own = {(a, b): f for a, b, f in [*CONVERSIONS, *((b, a, 1 / f) for a, b, f in CONVERSIONS)]}
    own |= {(a, b): f for a, b, f in (LOOSE_CONVERSIONS if loose else MORE_CONVERSIONS)}
    return spark.createDataFrame([(*k, f) for k, f in own.items()], "from_unit string, to_unit string, factor double")


def country_taxonomy(spark: SparkSession, country: str | None = None) -> DataFrame:
    """The taxonomy of charges, of one country or of all; Britain is listed under both of its codes."""
    rows = [(i, c, *r) for c, listed in (CHARGES | {"GB": CHARGES["UK"]}).items() if country in (None, c) for i, r in enumerate(listed)]
    return spark.createDataFrame(rows, "ordinal int, country string, name string, tax_category string, tax_section string, translation string")


def unit_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNIT_ALIASES, "alias string, unit string")


def canonical_units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANONICAL_UNITS, "commodity string, region string, canonical_unit string")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, price_in string, price_out string").selectExpr("model", "cast(price_in as decimal(9,6)) price_in", "cast(price_out as decimal(9,6)) price_out")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(TAXONOMY)], "ordinal int, keyword string, tax_category string, tax_section string")
