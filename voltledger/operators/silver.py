"""Whole extraction results, JSON of mixed forms, as typed tables: bills, charges, meters, time-of-use rows, totals, VAT, and what was skipped.

A document is read in one narrow pass (`projected`); the tables are views of its row. A value may come as an object (value,
confidence) or plainly; a missing one has confidence 0, one without a confidence 0.9. A child that breaks a rule of its
table (an amount that is no number, a name that isn't listed, a date in another format) is skipped and kept in
`skipped` with its place, the field and its JSON; the rest of the document stays. What is null counts as given where the
document says null, and as missing where it says nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Names that a field may have.
LISTED = {
    "category": ["energy", "demand", "fixed", "rider", "tax", "penalty", "credit", "adjustment", "minimum", "other"],
    "charge_owner": ["utility", "supplier", "government", "other"],
    "charge_section": ["supply", "distribution", "taxes", "other"],
    "read_type": ["actual", "estimated", "customer"],
    "demand_type": ["non_coincident", "coincident", "reactive"],
    "attribution_type": ["current", "prior_period", "rolling_average", "estimated", "prorated"],
    "statement_type": ["regular", "final", "estimated", "corrected", "credit_memo"],
    "vat_category": ["standard", "reduced", "zero", "exempt", "reverse_charge"],
}
# The sums of a bill, and the date formats in the order that they are tried in.
TOTALS = ["supply_subtotal", "distribution_subtotal", "taxes_subtotal", "current_charges", "previous_balance", "payments_received", "late_fees", "total_amount_due", "budget_billing_amount", "total_net", "total_vat", "total_gross"]
FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d.M.yyyy"]


# Fields of a child that its table reads: they are looked up once a child, each a variant.
FIELDS = {
    "charges": ["line_id", "description", "category", "subcategory", "charge_owner", "charge_section", "quantity", "rate", "amount", "charge_period", "applies_to_meter", "vat_rate", "vat_category", "math_check"],
    "meters": ["meter_number", "service_point_id", "read_type", "read_date_start", "read_date_end", "previous_read", "current_read", "generation", "net_consumption", "multiplier", "loss_factor", "consumption", "demand", "tou_breakdown"],
    "vat": ["vat_rate", "vat_category", "taxable_base", "vat_amount"],
    "tou": ["period", "consumption", "demand"],
}
PLACES = {"charges": "charges", "meters": "meters", "vat": "totals.vat_summary"}


def _at(v: str, path: str, kind: str) -> str:
    """The value at a path of the document, or of a child, whose fields are columns of v."""
    if v == "document":
        return f"try_variant_get({v}, '$.{path}', '{kind}')"
    field, _, rest = path.partition(".")
    return f"try_variant_get({v}.{field}, '${'.' * bool(rest)}{rest}', '{kind}')"


def _list(of: str) -> str:
    return f"array<struct<{', '.join(f'{name}: variant' for name in FIELDS[of])}>>"


def _given(v: str, path: str) -> str:
    """Whether the document has the path, a null included."""
    return f"{_at(v, path, 'variant')} IS NOT NULL"


def _object(v: str, path: str) -> str:
    return f"({_at(v, path, 'struct<value: variant>')} IS NOT NULL)"


def _value(v: str, path: str, kind: str) -> str:
    """The value of an object or a plain one."""
    return f"CASE WHEN {_object(v, path)} THEN {_at(v, path + '.value', kind)} ELSE {_at(v, path, kind)} END"


def _optional(v: str, path: str) -> str:
    """A number that isn't kept where it is plainly 0."""
    return f"CASE WHEN {_object(v, path)} THEN {_at(v, path + '.value', 'double')} ELSE nullif({_at(v, path, 'double')}, 0.0D) END"


def _confidence(v: str, path: str) -> str:
    return f"CASE WHEN NOT ({_given(v, path)}) OR is_variant_null({_at(v, path, 'variant')}) THEN 0.0D WHEN {_object(v, path)} THEN coalesce({_at(v, path + '.confidence', 'double')}, 0.9D) ELSE 0.9D END"


def _day(text: str, formats: list[str]) -> str:
    return f"coalesce({', '.join(f"try_to_date({text}, '{f}')" for f in formats)})"


def _name(v: str, field: str, default: str, path: str | None = None) -> str:
    path = path or field
    return f"CASE WHEN {_given(v, path)} THEN {_at(v, path, 'string')} ELSE '{default}' END"


def _unlisted(v: str, field: str, path: str | None = None, default: str = "") -> str:
    names = ", ".join(f"'{x}'" for x in LISTED[field])
    return f"coalesce({_name(v, field, default or LISTED[field][0], path)} NOT IN ({names}), true)"


def _no_number(v: str, path: str, kind: str = "double") -> str:
    return f"({_given(v, path)} AND {_at(v, path, kind)} IS NULL)"


def _bad_value(v: str, path: str) -> str:
    """Given with something that isn't null and not a number."""
    return f"(({_value(v, path, 'double')}) IS NULL AND ({_value(v, path, 'string')}) IS NOT NULL)"


def _bad_confidence(v: str, path: str) -> str:
    c = _at(v, f"{path}.confidence", "double")
    return f"({_given(v, path + '.confidence')} AND exists(array({c}), c -> coalesce(c < 0 OR c > 1, true)))"


def _bad_money(v: str, path: str) -> str:
    """Given but no object, or with a value that is no number, or a confidence outside 0 to 1."""
    return f"(({_given(v, path)} AND NOT {_object(v, path)}) OR {_no_number(v, path + '.value', MONEY)} OR {_bad_confidence(v, path)})"


def _money(v: str, path: str) -> str:
    return f"coalesce({_at(v, path + '.value', MONEY)}, cast(0 as {MONEY}))"


def _bad_day(v: str, path: str) -> str:
    text = _at(v, path, "string")
    return f"coalesce({text} <> '' AND {_day(text, FORMATS[:1])} IS NULL, false)"


def _first(**problems: str) -> str:
    return f"CASE {' '.join(f"WHEN {test} THEN '{name}'" for name, test in problems.items())} END"


def _children(of: str, problem: str) -> str:
    """SQL of an array of the children in their places from 0, each with its fields (x, null if it is no object) and its problem (null if none)."""
    checked = f"CASE WHEN x IS NULL THEN 'form' ELSE {problem} END"
    return f"transform({_at('document', PLACES[of], _list(of))}, (x, i) -> named_struct('place', i, 'x', x, 'problem', {checked}))"


def _charges() -> tuple[dict[str, str], str]:
    """SQL of the fields of a child x in its place, and of its problem."""
    period = f"{_object('x', 'charge_period')} AND coalesce({_at('x', 'charge_period.start', 'string')}, '') <> '' AND coalesce({_at('x', 'charge_period.end', 'string')}, '') <> ''"
    day = lambda p: f"CASE WHEN {period} THEN {_day(_at('x', f'charge_period.{p}', 'string'), FORMATS[:1])} END"
    fields = {
        "line_id": f"coalesce({_at('x', 'line_id', 'string')}, concat('L', lpad(cast(place + 1 as string), greatest(3, length(cast(place + 1 as string))), '0')))",
        "description": f"coalesce({_value('x', 'description', 'string')}, '')", "description_confidence": _confidence("x", "description"),
        "category": _name("x", "category", "other"), "subcategory": _at("x", "subcategory", "string"),
        "charge_owner": _name("x", "charge_owner", "utility"), "charge_section": _name("x", "charge_section", "other"),
        "quantity": _optional("x", "quantity"), "rate": _optional("x", "rate"),
        "amount": _money("x", "amount"), "currency": f"coalesce({_at('x', 'amount.currency', 'string')}, 'USD')", "amount_confidence": f"coalesce({_at('x', 'amount.confidence', 'double')}, 0.9D)",
        "original_string": _at("x", "amount.original_string", "string"),
        "period_start": day("start"), "period_end": day("end"), "attribution_type": f"CASE WHEN {period} THEN {_name('x', 'attribution_type', 'current', 'charge_period.attribution_type')} END",
        "applies_to_meter": _at("x", "applies_to_meter", "string"), "vat_rate": _at("x", "vat_rate", "double"), "vat_category": f"nullif({_at('x', 'vat_category', 'string')}, '')",
        "expected_amount": f"CASE WHEN {_object('x', 'math_check')} THEN coalesce({_at('x', 'math_check.expected_amount', 'double')}, 0.0D) END",
    }
    listed = ", ".join(f"'{x}'" for x in LISTED["vat_category"])
    problem = _first(
        amount=_bad_money("x", "amount"), description=_bad_confidence("x", "description"), category=_unlisted("x", "category", default="other"), charge_owner=_unlisted("x", "charge_owner"), charge_section=_unlisted("x", "charge_section", default="other"),
        quantity=_bad_value("x", "quantity"), rate=_bad_value("x", "rate"),
        charge_period=f"({period} AND ({_bad_day('x', 'charge_period.start')} OR {_bad_day('x', 'charge_period.end')} OR {_unlisted('x', 'attribution_type', 'charge_period.attribution_type')}))",
        vat_rate=f"({_at('x', 'vat_rate', 'double')} IS NULL AND {_at('x', 'vat_rate', 'string')} IS NOT NULL)", vat_category=f"coalesce({_at('x', 'vat_category', 'string')} NOT IN ('', {listed}), false)",
    )
    return fields, problem


def _meters() -> tuple[dict[str, str], str]:
    has_demand = f"{_object('x', 'demand')} AND coalesce({_at('x', 'demand.value', 'string')} NOT IN ('', '0', '0.0'), false)"
    with_demand = lambda sql: f"CASE WHEN {has_demand} THEN {sql} END"
    period = f"named_struct('period', coalesce({_at('t', 'period', 'string')}, ''), 'consumption', {_value('t', 'consumption', 'double')}, 'confidence', {_confidence('t', 'consumption')}, 'demand', {_optional('t', 'demand')})"
    rows = _at("x", "tou_breakdown", _list("tou"))
    day = lambda p: _day(_at("x", p, "string"), FORMATS[:1])
    plain = ["previous_read", "current_read", "generation", "net_consumption"]
    fields = {
        "meter_number": f"coalesce({_value('x', 'meter_number', 'string')}, '')", "meter_confidence": _confidence("x", "meter_number"), "service_point_id": _at("x", "service_point_id", "string"),
        "read_type": _name("x", "read_type", "actual"), "read_date_start": day("read_date_start"), "read_date_end": day("read_date_end"),
        **{c: _at("x", c, "double") for c in plain}, "multiplier": _optional("x", "multiplier"), "loss_factor": _optional("x", "loss_factor"),
        "raw_value": f"coalesce({_at('x', 'consumption.raw_value', 'double')}, 0.0D)", "raw_unit": f"coalesce({_at('x', 'consumption.raw_unit', 'string')}, 'kWh')",
        "normalized_value": _at("x", "consumption.normalized_value", "double"), "normalized_unit": _at("x", "consumption.normalized_unit", "string"),
        "demand_value": with_demand(_at("x", "demand.value", "double")), "demand_unit": with_demand(f"coalesce({_at('x', 'demand.unit', 'string')}, 'kW')"), "demand_type": with_demand(_name("x", "demand_type", "non_coincident", "demand.demand_type")),
        "tou": f"transform({rows}, t -> {period})",
    }
    bad_plain = " OR ".join(f"({_at('x', c, 'double')} IS NULL AND {_at('x', c, 'string')} IS NOT NULL)" for c in plain)
    problem = _first(
        consumption=f"(({_given('x', 'consumption')} AND NOT {_object('x', 'consumption')}) OR {_no_number('x', 'consumption.raw_value')})", meter_number=_bad_confidence("x", "meter_number"), read_type=_unlisted("x", "read_type"),
        read_dates=f"({_bad_day('x', 'read_date_start')} OR {_bad_day('x', 'read_date_end')})", reads=f"({bad_plain})", multiplier=f"({_bad_value('x', 'multiplier')} OR {_bad_value('x', 'loss_factor')})",
        demand=f"({has_demand} AND ({_at('x', 'demand.value', 'double')} IS NULL OR {_unlisted('x', 'demand_type', 'demand.demand_type')}))", tou_breakdown=f"exists({rows}, t -> coalesce({_value('t', 'consumption', 'double')} IS NULL, true))",
    )
    return fields, problem


def _vat() -> tuple[dict[str, str], str]:
    fields = {"vat_rate": f"coalesce({_at('x', 'vat_rate', 'double')}, 0.0D)", "vat_category": _name("x", "vat_category", "standard"), "taxable_base": _money("x", "taxable_base"), "vat_amount": _money("x", "vat_amount")}
    wrong = lambda p: f"({_no_number('x', p + '.value', MONEY)} OR {_bad_confidence('x', p)})"
    return fields, _first(vat_rate=_no_number("x", "vat_rate"), vat_category=_unlisted("x", "vat_category"), taxable_base=wrong("taxable_base"), vat_amount=wrong("vat_amount"))


KINDS = {"charges": _charges, "meters": _meters, "vat": _vat}


def projected(documents: DataFrame) -> DataFrame:
    """documents (extraction_id, document as a variant): one row each with the bill's fields and arrays of charges, meters, vat
    and totals, children in their places with their problems; a view reads the rest of a child's fields. _charges, _meters and _vat
    are the children as they came. A document that is null or no object has null fields and no children."""
    text = lambda p: f"coalesce({_value('document', p, 'string')}, '')"
    day = lambda p: _day(_value("document", p, "string"), FORMATS)
    sure = lambda p, v: f"CASE WHEN {v} IS NULL THEN 0.0D ELSE {_confidence('document', p)} END"
    start, end = day("invoice.billing_period.start"), day("invoice.billing_period.end")
    both = lambda sql: f"CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL THEN {sql} END"
    columns = {"invoice_number": text("invoice.invoice_number"), "invoice_number_confidence": _confidence("document", "invoice.invoice_number")}
    for c in ("invoice_date", "due_date"):
        columns |= {c: day(f"invoice.{c}"), f"{c}_confidence": sure(f"invoice.{c}", day(f"invoice.{c}"))}
    columns |= {"period_start": both(start), "period_end": both(end), "billing_days": both(f"coalesce({_at('document', 'invoice.billing_period.days', 'int')}, 0)")}
    columns |= {"rate_schedule": f"nullif({_value('document', 'invoice.rate_schedule', 'string')}, '')", "statement_type": _name("document", "statement_type", "regular", "invoice.statement_type")}
    for c in ("account_number", "customer_name", "service_address", "utility_provider"):
        columns |= {c: text(f"account.{c}"), f"{c}_confidence": _confidence("document", f"account.{c}")}
    columns |= {c: f"coalesce({_at('document', f'totals.{c}', 'boolean')}, false)" for c in ("minimum_bill_applied", "reverse_charge_applied")}
    sums = ", ".join(f"named_struct('name', '{c}', 'x', {_at('document', f'totals.{c}', 'variant')})" for c in TOTALS)
    given = f"filter(array({sums}), t -> coalesce(size({_at('t', 'x', 'map<string, variant>')}) > 0, false))"
    one = f"named_struct('name', t.name, 'value', {_money('t', 'x')}, 'currency', coalesce({_at('t', 'x.currency', 'string')}, 'USD'), 'confidence', coalesce({_at('t', 'x.confidence', 'double')}, 0.9D), 'problem', CASE WHEN {_no_number('t', 'x.value', MONEY)} OR {_bad_confidence('t', 'x')} THEN 'value' END, 'x', t.x)"
    columns |= {**{of: _children(of, read()[1]) for of, read in KINDS.items()}, **{f"_{of}": _at("document", path, "array<variant>") for of, path in PLACES.items()}, "totals": f"transform({given}, t -> {one})"}
    columns["problem"] = f"CASE WHEN try_variant_get(document, '$', 'struct<value: variant>') IS NULL THEN 'form' WHEN {_unlisted('document', 'statement_type', 'invoice.statement_type')} THEN 'statement_type' END"
    return documents.selectExpr("extraction_id", *(f"{sql} AS {name}" for name, sql in columns.items()))


def bill_rows(whole: DataFrame) -> DataFrame:
    """One row per document, one whose form or statement type isn't known included, with its problem."""
    kept = lambda c: F.size(F.filter(F.coalesce(c, F.array()), lambda x: x["problem"].isNull()))
    return whole.select("*", kept("charges").alias("n_charges"), kept("meters").alias("n_meters")).drop(*PLACES, *(f"_{of}" for of in PLACES), "totals")


def _rows(whole: DataFrame, of: str) -> DataFrame:
    """Children without a problem, a row each, their fields read after that."""
    rows = whole.select("extraction_id", F.inline(of)).where("problem IS NULL")
    return rows.selectExpr("extraction_id", "place", *(f"{sql} AS {name}" for name, sql in KINDS[of]()[0].items()))


def charge_lines(whole: DataFrame) -> DataFrame:
    return _rows(whole, "charges")


def meter_rows(whole: DataFrame) -> DataFrame:
    return _rows(whole, "meters").drop("tou")


def tou_rows(whole: DataFrame) -> DataFrame:
    """Time-of-use rows of meters that are kept, with the meter's place."""
    return _rows(whole, "meters").select("extraction_id", F.col("place").alias("meter_place"), "meter_number", F.inline("tou"))


def total_rows(whole: DataFrame) -> DataFrame:
    """One row per sum that the document gives as an object that isn't empty."""
    return whole.select("extraction_id", F.inline(F.filter("totals", lambda x: x["problem"].isNull()))).drop("problem", "x")


def vat_rows(whole: DataFrame) -> DataFrame:
    return _rows(whole, "vat")


def skipped(whole: DataFrame) -> DataFrame:
    """extraction_id, kind, place, problem, raw: everything that the tables leave out; a sum has no place, a whole document neither."""
    child = lambda of: F.transform(F.filter(of, lambda x: x["problem"].isNotNull()), lambda x: F.struct(F.lit(of).alias("kind"), x["place"].alias("place"), x["problem"].alias("problem"), F.to_json(F.get(f"_{of}", x["place"])).alias("raw")))
    sums = F.transform(F.filter("totals", lambda x: x["problem"].isNotNull()), lambda x: F.struct(F.lit("totals").alias("kind"), F.lit(None).cast("int").alias("place"), x["name"].alias("problem"), F.to_json(x["x"]).alias("raw")))
    own = F.when(F.col("problem").isNotNull(), F.array(F.struct(F.lit("document").alias("kind"), F.lit(None).cast("int").alias("place"), F.col("problem"), F.lit(None).cast("string").alias("raw"))))
    return whole.select("extraction_id", F.inline(F.concat(*(F.coalesce(x, F.array()) for x in (child("charges"), child("meters"), child("vat"), sums, own)))))
