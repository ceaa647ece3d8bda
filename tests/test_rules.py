"""Single cases of each rule and expression, nulls and edges among them."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from voltledger.functions import complexity, text
from voltledger.operators import drift, intake, learn, lists, rollups, score, usage, validate
from voltledger.sources import dims

CHARGE = "extraction_id long, line_number int, category string, charge_section string, charge_owner string, quantity decimal(18,2), rate decimal(18,4), amount decimal(18,2), amount_net decimal(18,2), vat_rate decimal(4,2), vat_amount decimal(18,2), amount_gross decimal(18,2), reverse_charge boolean"
BILL = "extraction_id long, country_code string, stated_total decimal(18,2), minimum_bill_applied boolean, billing_days int, has_demand_charges boolean, has_supplier_split boolean, commodity_type string, complexity_tier string"


def bill(spark, **v):
    row = {"extraction_id": 1, "country_code": None, "stated_total": D("100.00"), "minimum_bill_applied": False, "billing_days": 30, "has_demand_charges": False, "has_supplier_split": False, "commodity_type": "electricity", "complexity_tier": "simple"} | v
    return spark.createDataFrame([tuple(row.values())], BILL)


def charge(spark, *rows):
    base = {"extraction_id": 1, "line_number": 1, "category": "energy", "charge_section": "supply", "charge_owner": "utility", "quantity": None, "rate": None, "amount": D("1.00"), "amount_net": None, "vat_rate": None, "vat_amount": None, "amount_gross": None, "reverse_charge": False}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], CHARGE)


@pytest.mark.parametrize(
    ("category", "amount", "quantity", "rate", "want"),
    [("energy", "23.66", "280", "0.0845", []), ("energy", "23.67", "280", "0.0845", []), ("fixed", "15.00", None, None, []), ("energy", "50.00", "280", "0.0845", ["warning"]), ("fixed", "25.00", "100", "0.10", ["info"]), ("energy", "100.50", "1000", "0.10", ["info"]), ("energy", "-23.66", "280", "0.0845", ["warning"]), ("energy", "23.71", "280", "0.0845", []), ("energy", "1.06", "10", "0.10", ["warning"])],
)
def test_line_math(spark, category, amount, quantity, rate, want):
    c = charge(spark, {"category": category, "amount": D(amount), "quantity": quantity and D(quantity), "rate": rate and D(rate)})
    assert [r["severity"] for r in validate.line_math(c, bill(spark)).collect()] == want


def test_totals_and_logic(spark):
    c = charge(spark, {"amount": D("60.00")}, {"amount": D("39.80"), "category": "demand", "charge_owner": None})
    assert validate.current_charges(c, bill(spark)).count() == 0
    assert validate.current_charges(c, bill(spark, stated_total=D("50.00"))).first()["severity"] == "warning"
    assert validate.current_charges(c, bill(spark, stated_total=D("150.00"), minimum_bill_applied=True)).first()["severity"] == "info"
    assert validate.billing_days(bill(spark, billing_days=120)).count() == 1 and validate.billing_days(bill(spark, billing_days=None)).count() == 0
    assert validate.demand_missing(c, bill(spark, has_demand_charges=True)).count() == 0
    assert validate.demand_missing(c.where("false"), bill(spark, has_demand_charges=True)).count() == 1
    assert validate.single_owner(c, bill(spark, has_supplier_split=True)).count() == 0
    assert validate.single_owner(c.limit(1), bill(spark, has_supplier_split=True)).count() == 1
    bad = charge(spark, {"amount": D("-5.00")}, {"amount": D("-5.00"), "category": "credit"}, {"amount": None})
    assert validate.negative_amounts(bad).count() == 1


def test_vat(spark):
    row = lambda net, rate, vat, gross, reverse=False: {"amount_net": D(net), "vat_rate": D(rate), "vat_amount": D(vat), "amount_gross": D(gross), "reverse_charge": reverse}
    c = charge(spark, row("100", "0.19", "19", "119"), row("100", "0.19", "25", "125"), row("100", "0.19", "19", "120"), row("100", "0", "0", "100", True), row("100", "19", "19", "119"), row("100", "0", "3", "103", True), {})
    got = sorted((r["rule_id"], r["severity"]) for r in validate.vat_lines(c).collect())
    assert got == [("V13", "error"), ("V13", "warning"), ("V14", "error")]
    summary = spark.createDataFrame([(1, D("0.19"), D("300.20"), D("63.00")), (1, D("0.07"), D("9.00"), D("9.00"))], "extraction_id long, vat_rate decimal(4,2), stated_base decimal(18,2), stated_vat decimal(18,2)")
    assert [r["rule_id"] for r in validate.vat_summary(c, summary).collect()] == ["V15"]


def test_meters_and_gas(spark):
    m = spark.createDataFrame(
        [(1, "a", 45230.0, 45980.0, None, 750.0, "kWh", None, None, None, None), (2, "b", 45230.0, 45980.0, 10.0, 500.0, "therms", 11.2, 0.9626, 1250.0, 13474.4), (3, "c", None, 1.0, 1.0, 5.0, None, 5.0, 1.2, 10.0, 0.0)],
        "extraction_id long, meter_number string, previous_read double, current_read double, multiplier double, raw_value double, raw_unit string, calorific_value double, volume_correction_factor double, consumption_volume double, consumption_energy double",
    )
    assert [r["extraction_id"] for r in validate.meter_reads(m).collect()] == [2]
    assert sorted((r["extraction_id"], r["rule_id"]) for r in validate.gas_factors(m).collect()) == [(3, "V18"), (3, "V18"), (3, "V19")]
    b = bill(spark).union(bill(spark, extraction_id=2))
    assert [(r["extraction_id"], r["rule_id"]) for r in validate.unit_mismatch(m, b).collect()] == [(2, "V06")]
    t = spark.createDataFrame([(1, "a", 280.0), (1, "a", 470.0), (2, "b", None)], "extraction_id long, meter_number string, consumption double")
    assert [r["extraction_id"] for r in validate.tou_total(m, t).collect()] == [2]


def test_score_and_tiers(spark):
    assert score.route(score.issue_penalties(validate.billing_days(bill(spark))), bill(spark)).first()["tier"] == "auto_accept"
    fields = spark.createDataFrame([(1, "total_amount_due", 0.5), (1, "meters[0].demand_value", 0.7), (1, "x", 0.1), (1, "account_number", None)], "extraction_id long, field_path string, confidence double")
    r = score.route(score.low_confidence_penalties(fields), bill(spark)).first()
    assert (float(r["score"]), r["fatal"], r["tier"]) == (0.75, True, "full_review")
    got = spark.createDataFrame([(s, t) for t in ("simple", "complex") for s in (0.96, 0.95, 0.92, 0.90, 0.82, 0.80, 0.75, 0.5)], "s double, t string").select(score.tier(F.col("s"), F.lit(False), F.col("t")).alias("x"))
    short = {"auto_accept": "a", "targeted_review": "t", "full_review": "f"}
    assert "".join(short[r["x"]] for r in got.collect()) == "aattt" + "fff" + "aaaattt" + "f"
    w = score.field_weight(spark.createDataFrame([("total_amount_due",), ("charges.rate_schedule.x",), ("zzz",), (None,)], "field_path string"))
    assert {r["field_path"]: r["weight"] for r in w.collect()} == {"total_amount_due": "fatal", "charges.rate_schedule.x": "high", "zzz": "low", None: "low"}


AMOUNTS = [("1.234,56", "EU", "1234.56"), ("1,234.56", "US", "1234.56"), ("1234,56", "EU", "1234.56"), ("(23,66)", "EU", "-23.66"), ("23.66-", "US", "-23.66"), ("-23.66", "US", "-23.66"), ("€ 1.234,56", "EU", "1234.56"), ("$1,234.56", "US", "1234.56"), ("12.345.678,90", "EU", "12345678.90"), ("", "US", None), ("€", "EU", None), ("EUR 1.234,56", "EU", "1234.56"), ("R$ 5,00", "EU", "5.00"), ("5,00 R$", "EU", "5.00"), (None, "US", None)]


def test_amounts_and_formats(spark):
    got = spark.createDataFrame([(a, f) for a, f, _ in AMOUNTS], "a string, f string").select(text.amount(F.col("a"), F.col("f")).alias("x"))
    assert [r["x"] for r in got.collect()] == [w and D(w) for _, _, w in AMOUNTS]
    kinds = [("Summe 1.234,56 und 2.000,00", "EU"), ("Total 1,234.56", "US"), ("12,50 und 3,00", "EU"), ("no number", "US")]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in kinds], "t string").select(text.number_format(F.col("t"))).collect()] == [k for _, k in kinds]
    marks = [("R$ 5", "BRL"), ("MX$ 5", "MXN"), ("$5", "USD"), ("5 CHF", "CHF"), ("five", None)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in marks], "t string").select(text.currency(F.col("t"))).collect()] == [k for _, k in marks]


def test_dates(spark):
    rows = [("2025-03-15", "ISO", dt.date(2025, 3, 15), False), ("15.03.2025", "x", dt.date(2025, 3, 15), False), ("05/03/2025", "DD/MM/YYYY", dt.date(2025, 3, 5), True), ("05/03/2025", "MM/DD/YYYY", dt.date(2025, 5, 3), True), ("03/03/2025", "MM/DD/YYYY", dt.date(2025, 3, 3), False), ("31/02/2025", "DD/MM/YYYY", None, False), (" 05-03-2025", "DD/MM/YYYY", dt.date(2025, 3, 5), False), ("12-31-2025", "x", dt.date(2025, 12, 31), False), ("soon", "x", None, False), (None, "x", None, False)]
    got = spark.createDataFrame([(a, f) for a, f, _, _ in rows], "a string, f string").select(text.date(F.col("a"), F.col("f")).alias("d"), text.ambiguous_date(F.col("a")).alias("m")).collect()
    assert [(r["d"], r["m"]) for r in got] == [(d, m) for _, _, d, m in rows]
    a = dt.date(2025, 1, 1)
    spans = [(30, "ok"), (-31, "invalid: ends before it starts"), (0, "invalid: no days"), (517, "invalid: too long"), (9, "unusual")]
    got = spark.createDataFrame([(a, a + dt.timedelta(n)) for n, _ in spans], "a date, b date").select(text.billing_period(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [w for _, w in spans]


def test_units(spark):
    rows = [(100.0, "thm", "kWh", None, 2930.71), (10.0, "CCF", "therms", None, 10.37), (1.0, "MWh", "kWh", None, 1000.0), (1.0, "m³", "gallons", None, 264.172), (5.0, "kWh", "kWh", None, 5.0), (10.0, "cbm", "kWh", 11.0, 110.0), (10.0, "m3", "kWh", None, None), (1.0, "kVA", "therms", None, None)]
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, value double, from_unit string, to_unit string, calorific_value double")
    got = {r["i"]: r for r in text.convert_units(text.normalize_units(frame, "from_unit")).collect()}
    for i, r in enumerate(rows):
        assert got[i]["converted"] is None if r[4] is None else abs(got[i]["converted"] - r[4]) < 0.01
    assert (got[6]["unit_error"], got[7]["unit_error"]) == ("no calorific value", "no factor")


CATEGORIES = [("x", None, "1", "missing_context"), ("x", "1", "", "other"), ("due_date", "2023-05-01", "2025-05-01", "wrong_on_document"), ("x", "1ENO", "1E", "format_normalize"), ("x", "X12", "12", "format_normalize"), ("x", "a b", "ab", "format_normalize"), ("x", "a–b", "a-b", "format_normalize"), ("x", "1O0", "100", "ocr_error"), ("amount", "100", "140", "calculation_error"), ("name", "cat", "dog", "other")]


def test_correction_categories(spark):
    frame = spark.createDataFrame([r[:3] for r in CATEGORIES], "p string, a string, b string")
    got = frame.select(learn.correction_category(F.col("p"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [r[3] for r in CATEGORIES]


def test_flatten_and_drift(spark):
    doc = '{"a": {"b": 1, "c": [{"d": "x"}, {"d": null}]}, "e": true}'
    got = drift.flatten(spark.createDataFrame([(1, doc)], "extraction_id long, t string").select("extraction_id", F.parse_json("t").alias("document")))
    assert {(r["path"], r["value"]) for r in got.collect()} == {("a.b", "1"), ("a.c[0].d", "x"), ("a.c[1].d", None), ("e", "true")}
    runs = spark.createDataFrame([(2, 1, D("5.00"), D("5.00"), 0.5, 0.5, "a", "a"), (3, 2, D("5.00"), None, 0.5, 0.6, "a", "a")], "extraction_id long, previous_id long, stated_total decimal(18,2), previous_total decimal(18,2), confidence_score double, previous_score double, status string, previous_status string")
    assert {(r["extraction_id"], r["field_path"], r["severity"]) for r in drift.changed_fields(runs).collect()} == {(3, "totals.total_amount_due", "fatal"), (3, "extraction.confidence_score", "low")}


def test_responses(spark):
    rows = [(1, ' {"id": 1} '), (2, 'x\n```json\n{"id": 2}\n```'), (3, 'so {"id": 3, "n": {"m": 1}} then'), (4, "{ broken"), (5, None)]
    got = {r["call_id"]: (r["strategy"], r["id"]) for r in intake.parsed_responses(spark.createDataFrame(rows, "call_id long, response_content string")).collect()}
    assert got == {1: ("whole", 1), 2: ("fenced", 2), 3: ("braces", 3), 4: ("none", None), 5: ("none", None)}


def test_structured_invoices(spark):
    xml = '<?xml version="1.0"?>\n<x:CrossIndustryInvoice a="1"><x:ID> </x:ID><ID>7</ID><x:ID>8</x:ID><GrandTotalAmount>1</GrandTotalAmount><y:GrandTotalAmount c="E">2.50</y:GrandTotalAmount><DueDateDateTime/></x:CrossIndustryInvoice>\n'
    rows = [
        (1, 0, "a.txt", xml), (1, 1, "A.XML", xml), (1, 2, "zugferd.pdf", xml), (2, 0, "My-Fattura.p7m", None), (3, 0, "factur-x.xml", xml[:-9]), (4, 0, "a.xml", "<a>FatturaElettronica</a>"),
        (5, 0, "a.xml", "<a/>"), (6, 0, None, xml), (7, 0, "b.xml", xml), (7, 0, "b.xml", xml), (None, 0, "b.xml", xml),
    ]
    got = intake.structured_invoices(spark.createDataFrame(rows, "doc_id long, pos int, filename string, data string")).collect()
    both = "factur-x/zugferd"
    assert {r["doc_id"]: (r["kind"], r["invoice_id"], r["grand_total"]) for r in got} == {1: (both, "7", 2.5), 2: ("fatturapa", None, None), 3: (both, None, None), 4: ("fatturapa", None, None), 7: (both, "7", 2.5), None: (both, "7", 2.5)}
    assert len(got) == 6 and {r["due_date"] for r in got} == {None}


def test_file_scan(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1", "b.pdf": b"%PDF-1", "c.png": b"\x89PNG\r\n\x1a\n..", "g.png": b"\x89PNG..", "d.pdf": b"", "e.pdf": b"MM\0*", "f.PDF": b"\xff\xd8\xff\0"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in intake.scan(spark, str(tmp_path)).collect()}
    assert {k: (r["file_type"], r["reject_reason"]) for k, r in got.items()} == {"a.pdf": ("pdf", None), "b.pdf": ("pdf", None), "c.png": ("png", "not a pdf"), "g.png": ("unknown", "not a pdf"), "e.pdf": ("tiff", None), "f.PDF": ("jpeg", None)}
    assert got["a.pdf"]["file_hash"] == got["b.pdf"]["file_hash"]


def test_upsert_is_idempotent(spark):
    store = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, status string, keep string")
    new = spark.createDataFrame([(2, "c", "z"), (3, "d", "n")], "id long, status string, keep string")
    once = lists.upsert(store, new, "id", ["status"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", "x"), (2, "c", None), (3, "d", "n")} == {tuple(r) for r in lists.upsert(once, new, "id", ["status"]).collect()}


def test_complexity(spark):
    rows = [([], 3, 1, "simple"), (["multi_meter", "tou_present"], 3, 1, "standard"), (["multi_meter", "multi_meter", "net_metering"], 3, 1, "complex"), (["multi_meter"] * 3, 31, 6, "pathological"), (None, 16, 1, "simple")]
    frame = spark.createDataFrame([r[:3] for r in rows], "s array<string>, l int, p int")
    got = frame.select(complexity.complexity_tier(complexity.complexity_score(F.col("s"), F.col("l"), F.col("p")))).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_ratchet_and_blocks(spark):
    months = spark.createDataFrame([(1, m, D(v) if v else None) for m, v in enumerate(["100", None, "10"] + [None] * 9 + ["20"])], "meter int, month int, demand decimal(18,2)")
    got = {r["month"]: r["billed"] for r in usage.demand_ratchet(months).collect()}
    assert (got[0], got[1], got[2], got[11], got[12]) == (100.0, 80.0, 80.0, 80.0, 20.0)
    parts = usage.block_allocation(spark.createDataFrame([(1, 620.0), (2, 0.0)], "extraction_id long, quantity double"), usage.blocks(spark))
    assert sorted((r["block"], r["part"]) for r in parts.collect()) == [(1, 100.0), (2, 400.0), (3, 120.0)]


def test_cost_total_is_summed_before_rounding(spark):
    calls = spark.createDataFrame([("small", 1, 1), ("nobody", 1, None), (None, 10, 0)], "model string, input_tokens int, output_tokens int")
    got = {(r["model"], float(r["cost"])) for r in rollups.call_cost(calls).collect()}
    assert (None, 0.0) in {(m, c) for m, c in got if m is None and c == 0.0} or (None, 0.0) not in got
    assert ("nobody", 0.000003) in got and ("small", 0.000001) in got


def test_tolerance_default(spark):
    rows = validate.with_tolerance(spark.createDataFrame([("DE",), (None,), ("XX",)], "country_code string"))
    assert {r["country_code"]: (float(r["base"]), float(r["tax"])) for r in rows.collect()} == {"DE": (0.02, 0.04), None: (0.05, 0.05), "XX": (0.05, 0.1)}
    assert dims.conversions(spark).count() == 16


def test_language_vote_ties_go_to_the_first_name(spark):
    from voltledger.operators import intake

    rows = [(1, "the el"), (2, "el the"), (3, "  "), (4, None), (5, "und\nder the"), (6, "thee xthe the"), (7, "que"), (8, "LE la que in")]
    got = {r[0]: r[1] for r in intake.language_vote(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "en", 2: "en", 3: "en", 4: "en", 5: "de", 6: "en", 7: "es", 8: "fr"}


def test_drift_of_documents(spark):
    from voltledger.operators import drift

    docs = [
        (1, '{"a": {"b": 1, "c": null}, "extraction_timestamp": "x", "l": [1, {"m": 2}], "k": [1], "gone": "y", "charge": {"rate_schedule": "R"}}'),
        (2, '{"a": {"b": 2, "c": null}, "extraction_timestamp": "z", "l": [1, {"m": 3}], "k": [1, 5], "new": true, "charge": {"rate_schedule": "S"}}'),
        (3, None),
    ]
    table = spark.createDataFrame(docs, "extraction_id long, j string").selectExpr("extraction_id", "parse_json(j) AS document")
    pairs = spark.createDataFrame([(2, 1), (3, 2)], "extraction_id long, previous_id long")
    got = {(r["previous_id"], r["field_path"]): (r["old_value"], r["new_value"], r["severity"]) for r in drift.document_changes(pairs, table).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {"a.b": ("1", "2", "low"), "l[1].m": ("2", "3", "low"), "k": ("len=1", "len=2", "low"), "gone": ("y", None, "low"), "new": (None, "true", "low"), "charge.rate_schedule": ("R", "S", "high")}
    assert got[2, "a.b"] == ("2", None, "low")
    # what lies deeper than asked stays as JSON
    flat = {r["path"]: r["value"] for r in drift.flatten(table.where("extraction_id = 1"), depth=1).collect()}
    assert flat["a"] == '{"b":1,"c":null}' and flat["gone"] == "y"


def test_sinks(spark, tmp_path):
    import pytest

    from voltledger.sources import sinks

    calls = spark.createDataFrame([(1, 5, 7), (2, 0, 7), (3, None, 7)], "call_id long, input_tokens int, output_tokens int")
    folder = str(tmp_path / "calls")
    sinks.append_calls(calls, folder)
    assert {r["call_id"]: r["total_tokens"] for r in spark.read.parquet(folder).collect()} == {1: 12, 2: None, 3: None}
    with pytest.raises(ValueError):
        sinks.append_calls(calls.limit(1), folder)
    with pytest.raises(ValueError):
        sinks.append_rows(calls.union(calls), str(tmp_path / "other"), "call_id")
    bills = spark.createDataFrame([(1, "water", "x"), (2, "gas", "y")], "extraction_id long, commodity_type string, file_hash string")
    sinks.store_extractions(bills, str(tmp_path / "bills"))
    sinks.store_extractions(bills.limit(0), str(tmp_path / "bills"))
    assert spark.read.parquet(str(tmp_path / "bills")).count() == 2
    sinks.export_json(bills, str(tmp_path / "json"), ("file_hash",))
    assert sorted(spark.read.json(str(tmp_path / "json")).columns) == ["commodity_type", "extraction_id"]


def test_reasons_for_values(spark):
    from pyspark.sql import functions as F

    from voltledger.operators import learn

    rows = spark.createDataFrame([("format_normalize", "a.total", "12 kWh", "12"), ("wrong_on_document", "a.date", "2021-03-04", "2022-03-04"), ("other", "b", "1", "2"), (None, "b", None, None)], "c string, p string, x string, y string")
    got = [r[0] for r in rows.select(learn.reasoning(F.col("c"), F.col("p"), F.col("x"), F.col("y"))).collect()]
    assert got == ["total: trailing ' kWh' removed", "date: only the year of the date was wrong", "b: another correction", "b: another correction"]


def test_forms_as_bills_have_them(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(text.number_format(F.lit(t))) for t in ("1,50 2,50 1,234.56", "1.234,567", "7", "1,5 2.50")] == ["EU", "US", "US", "US"]
    assert [one(text.currency(F.lit(t))) for t in ("$1,200.00 MXN", "100 PLN", "R$ 5 = €1", "R$ 5", "MXN 5", "$5", "5")] == ["MXN", "PLN", "EUR", "BRL", None, "USD", None]
    of = lambda p, a, b: one(learn.correction_category(F.lit(p), F.lit(a), F.lit(b)))
    assert [of("due_date", "21 AGO 23", "21 ago 25"), of("due_date", "21 AGO 23", "22 AGO 25"), of("note", "21 AGO 23", "21 AGO 25"), of("x", " 1ENO ", "1E"), of("x", "  ", "a")] == ["wrong_on_document", "other", "other", "format_normalize", "other"]
    assert one(complexity.complexity_score(F.array().cast("array<string>"), F.lit(31), F.lit(6), F.lit(True), F.lit(None).cast("boolean"), F.lit(True))) == 8


def test_issues_are_worked_out_where_there_are_any():
    """Most rows have no issue; what it says and its field's weight aren't made for them."""
    from voltledger.operators import rules

    for one in rules.RULES:
        sql = one.issue()
        assert sql.startswith("CASE WHEN ") and sql.index("IS NOT NULL THEN named_struct(") < sql.index("'rule_id'")
