"""The compiled rules against the same rules run one by one, and in their three forms."""

import pytest
from pyspark.sql import functions as F

from voltledger.operators import rules, score, validate
from voltledger.plans import queries, reviews

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def single(spark):
    """Issues of every rule by itself, as separate tables."""
    s = spark
    args = (reviews.flagged(s, DATA), queries.vat_charges(s, DATA), reviews.sections(s, DATA), queries.meters(s, DATA), reviews.periods(s, DATA), reviews.summary(s, DATA), reviews.totals(s, DATA))
    return [tuple(r) for r in validate.run_all(*args).select(*validate.ISSUES).collect()]


def test_every_issue_once(spark, single):
    got = [tuple(r) for r in reviews.all_issues(spark, DATA).select(*validate.ISSUES).collect()]
    def plain(v):
        try:
            return f"{float(v):.4f}"
        except (TypeError, ValueError):
            return str(v)

    same = lambda rows: sorted((str(x[0]), *map(str, x[1:4]), *map(plain, x[4:])) for x in rows)
    assert same(got) == same(single)
    assert len(got) > 3000 and {x[1] for x in got} >= {r.name for r in rules.RULES} - {"V07", "V16"}


def test_bills_add_their_issues_up(spark, single):
    rows = {r["extraction_id"]: r for r in rules.judged(reviews.nested_bills(spark, DATA)).collect()}
    count = lambda i, *levels: sum(x[0] == i and (not levels or x[3] in levels) for x in single)
    for i, r in list(rows.items())[::25]:
        assert (r["n_issues"], r["n_fatal"], r["n_error"], r["n_warning"]) == (count(i), count(i, "fatal"), count(i, "error"), count(i, "warning"))
        assert r["labels"] == sorted({x[1] for x in single if x[0] == i and x[3] != "info"})
        costly = [x for x in single if x[0] == i and x[3] != "info"]
        assert float(r["cost"]) == pytest.approx(sum(0.20 if x[1] in ("V03", "V11") else 0.03 for x in costly)) and not r["deadly"]


def test_a_bill_without_lines_and_with_nulls(spark):
    bills = spark.createDataFrame([(1, None, None, 50, True, True, None, None, True), (2, "MX", "natural_gas", None, None, None, None, None, None)], "extraction_id long, country_code string, commodity_type string, billing_days int, has_demand_charges boolean, has_supplier_split boolean, stated_total decimal(18,2), minimum_bill_applied boolean, has_tou boolean")
    lines = queries.vat_charges(spark, DATA).limit(0)
    nested = rules.with_gates(bills).join(rules.line_facts(lines), "extraction_id", "left")
    meter = "array<struct<tou:double,raw_value:double,current_read:double,previous_read:double,multiplier:double,raw_unit:string,calorific_value:double,volume_correction_factor:double,consumption_volume:double,consumption_energy:double>>"
    empty = {"sections": "array<struct<charge_section:string,subtotal:decimal(18,2)>>", "vat_summary": "array<struct<vat_rate:decimal(4,2),stated_base:decimal(18,2),stated_vat:decimal(18,2)>>", "meters": meter}
    nested = nested.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()}).withColumns({k: F.lit(None).cast("decimal(18,2)") for k in ("total_net", "total_vat", "total_gross")}).withColumn("any_tou", F.lit(None).cast("boolean"))
    got = {r["extraction_id"]: r for r in rules.judged(rules.with_computed(nested)).collect()}
    assert [i["rule_id"] for i in got[1]["issues"]] == ["V10", "V11", "V12"] and got[2]["n_issues"] == 0 and got[2]["cost"] == 0


def test_weights_by_name_then_by_part(spark):
    paths = ["total_amount_due", "totals.current_charges", "invoice.account_number.value", "late_fees", "x.late_fees.demand_value", "unknown", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, field_path string")
    got = [(r["weight"], float(r["penalty"])) for r in score.field_weight(rows).orderBy("i").collect()]
    assert got == [("fatal", 1.0), ("high", 0.2), ("fatal", 1.0), ("low", 0.03), ("high", 0.2), ("low", 0.03), ("low", 0.03)]


def test_lines_are_read_once(spark):
    plan = reviews.flagship_route(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and sum(line.strip(" :+-").startswith("Relation") and "l_orderkey" in line for line in plan.splitlines()) == 1
