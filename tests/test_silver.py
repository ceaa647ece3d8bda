"""Whole documents of mixed forms as typed tables; what breaks a rule is skipped and kept on record."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from voltledger.operators import silver

GOOD = """{"invoice": {"invoice_number": 77, "invoice_date": {"value": "31/12/2023", "confidence": 0.5}, "due_date": "soon", "billing_period": {"start": "2024-1-5", "end": {"value": "05.02.2024"}, "days": 31}, "rate_schedule": ""},
 "account": {"account_number": {"value": null, "confidence": 0.4}, "customer_name": "Ann"},
 "charges": [{"amount": {"value": "12.345", "currency": "EUR", "confidence": 0.6}, "description": "Energy", "quantity": 0, "rate": {"value": 0}, "charge_period": {"start": "2024-01-01", "end": "2024-01-31"}, "vat_category": ""},
  {"amount": 5}, {"amount": null}, {"amount": {"value": null}}, {"amount": {"value": "x"}}, {"amount": {"value": 1, "confidence": 2}}, {"category": "odd"}, {"category": null}, {"line_id": "X", "description": null},
  {"charge_period": {"start": "01/01/2024", "end": "2024-01-31"}}, {"charge_period": {"start": "01/01/2024"}}, {"quantity": "many"}, {"vat_category": "odd"}, "text", null],
 "meters": [{"meter_number": "M1", "consumption": {"raw_value": 10}, "demand": {"value": 3}, "multiplier": {"value": 2}, "tou_breakdown": [{"period": "P1", "consumption": {"value": 4, "confidence": 0.3}}, {"consumption": 6}], "read_date_start": "2024-01-01"},
  {"read_type": "guessed"}, {"read_date_end": "31.01.2024"}, {"consumption": 7}, {"demand": {"value": 0, "demand_type": "odd"}}, {"tou_breakdown": [{"period": "P1"}]}, {"demand": {"value": 5, "demand_type": "odd"}}],
 "totals": {"total_amount_due": {"value": 9.99}, "late_fees": {"currency": "EUR"}, "payments_received": {}, "current_charges": 4, "total_net": {"value": "n"}, "minimum_bill_applied": true,
  "vat_summary": [{"vat_rate": 0.19, "taxable_base": {"value": 100}, "vat_amount": 3}, {"vat_category": "odd"}, {}]}}"""


def test_every_table_of_a_document(spark):
    rows = [(1, GOOD), (2, "{}"), (3, "[1]"), (4, "no json"), (5, None), (6, '{"invoice": {"statement_type": "odd"}, "charges": [{}]}')]
    docs = spark.createDataFrame(rows, "extraction_id long, j string").select("extraction_id", F.try_parse_json("j").alias("document"), F.lit(0).alias("amount"))
    whole = silver.projected(docs)
    bills = {r["extraction_id"]: r for r in silver.bill_rows(whole).collect()}
    b = bills[1]
    assert (b["invoice_number"], b["invoice_number_confidence"], b["invoice_date"], b["invoice_date_confidence"], b["due_date"], b["due_date_confidence"]) == ("77", 0.9, dt.date(2023, 12, 31), 0.5, None, 0.0)
    assert (b["period_start"], b["period_end"], b["billing_days"], b["rate_schedule"], b["statement_type"]) == (dt.date(2024, 1, 5), dt.date(2024, 2, 5), 31, None, "regular")
    assert (b["account_number"], b["account_number_confidence"], b["customer_name"], b["service_address_confidence"], b["minimum_bill_applied"], b["n_charges"], b["n_meters"]) == ("", 0.4, "Ann", 0.0, True, 3, 2)
    assert {i: r["problem"] for i, r in bills.items()} == {1: None, 2: None, 3: "form", 4: "form", 5: "form", 6: "statement_type"}
    lines = {(r["extraction_id"], r["place"]): r for r in silver.charge_lines(whole).collect()}
    assert set(lines) == {(1, 0), (1, 8), (1, 10), (6, 0)}
    a = lines[1, 0]
    assert (a["line_id"], a["amount"], a["currency"], a["amount_confidence"], a["description"], a["description_confidence"], a["category"], a["quantity"], a["rate"], a["period_end"], a["attribution_type"], a["vat_category"]) == ("L001", D("12.35"), "EUR", 0.6, "Energy", 0.9, "other", None, 0.0, dt.date(2024, 1, 31), "current", None)
    assert (lines[1, 8]["line_id"], lines[1, 8]["amount"], lines[1, 8]["description"], lines[1, 8]["description_confidence"], lines[1, 10]["period_start"]) == ("X", D("0.00"), "", 0.0, None)
    meters = {r["place"]: r for r in silver.meter_rows(whole).collect()}
    assert set(meters) == {0, 4} and meters[4]["demand_value"] is None and (meters[0]["raw_unit"], meters[0]["demand_value"], meters[0]["demand_unit"], meters[0]["demand_type"], meters[0]["multiplier"]) == ("kWh", 3.0, "kW", "non_coincident", 2.0)
    assert sorted((r["meter_place"], r["period"], r["consumption"], r["confidence"]) for r in silver.tou_rows(whole).collect()) == [(0, "", 6.0, 0.9), (0, "P1", 4.0, 0.3)]
    assert {(r["name"], r["value"], r["confidence"]) for r in silver.total_rows(whole).collect()} == {("total_amount_due", D("9.99"), 0.9), ("late_fees", D("0.00"), 0.9)}
    assert {(r["place"], r["vat_rate"], r["vat_category"], r["taxable_base"], r["vat_amount"]) for r in silver.vat_rows(whole).collect()} == {(0, 0.19, "standard", D(100), D(0)), (2, 0.0, "standard", D(0), D(0))}
    out = {(r["extraction_id"], r["kind"], r["place"]): r["problem"] for r in silver.skipped(whole).collect()}
    assert {k[2]: v for k, v in out.items() if k[:2] == (1, "charges")} == {1: "amount", 2: "amount", 3: "amount", 4: "amount", 5: "amount", 6: "category", 7: "category", 9: "charge_period", 11: "quantity", 12: "vat_category", 13: "form", 14: "form"}
    assert {k[2]: v for k, v in out.items() if k[1] == "meters"} == {1: "read_type", 2: "read_dates", 3: "consumption", 5: "tou_breakdown", 6: "demand"}
    assert {k[:2]: v for k, v in out.items() if k[2] is None} == {(1, "totals"): "total_net", (3, "document"): "form", (4, "document"): "form", (5, "document"): "form", (6, "document"): "statement_type"}
    assert out[1, "vat", 1] == "vat_category"


def test_no_documents(spark):
    none = spark.createDataFrame([], "extraction_id long, document string").select("extraction_id", F.try_parse_json("document").alias("document"))
    whole = silver.projected(none)
    assert all(view(whole).isEmpty() for view in (silver.bill_rows, silver.charge_lines, silver.meter_rows, silver.tou_rows, silver.total_rows, silver.vat_rows, silver.skipped))


def test_forms_are_told_without_walking_a_document(spark):
    """A schema is made of all that lies below a value, so asking each value for it reads a document many times over."""
    docs = spark.createDataFrame([(1, GOOD)], "extraction_id long, j string").select("extraction_id", F.try_parse_json("j").alias("document"))
    whole = silver.projected(docs)
    for view in (silver.bill_rows, silver.charge_lines, silver.meter_rows, silver.tou_rows, silver.total_rows, silver.vat_rows, silver.skipped):
        assert "schemaofvariant" not in view(whole)._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    raw = {(r["kind"], r["place"]): r["raw"] for r in silver.skipped(whole).collect()}
    assert raw["charges", 1] == '{"amount":5}' and raw["charges", 13] == '"text"' and raw["totals", None] == '{"value":"n"}' and raw["vat", 1] == '{"vat_category":"odd"}'
