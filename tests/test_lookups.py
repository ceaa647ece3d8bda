"""Contracts in force by brute force, and names in texts by brute force."""

import datetime as dt
import itertools
import random

from voltledger.operators import names, usage

DAY = lambda y, m=1, d=1: dt.date(y, m, d)


def test_contracts_in_force(spark):
    r = random.Random(3)
    day = lambda: DAY(r.choice([1990, 1999, 2000, 2001, 2049, 2050, 2051, 2070]), r.randint(1, 12), r.randint(1, 28))
    terms = [(i, r.choice(["a", "b", None]), None if r.random() < 0.1 else day(), None if r.random() < 0.2 else day(), float(i), i % 2 == 0) for i in range(60)]
    terms += [(100, "a", DAY(2001), DAY(2001, 12, 31), 1.0, None), (101, "a", DAY(2001), DAY(2001, 6, 1), 2.0, None)]
    asked = [(i, r.choice(["a", "b", "c", None]), None if r.random() < 0.1 else day(), 30.0) for i in range(200)] + [(900, "a", DAY(2001), 5.0), (900, "a", DAY(2001), 5.0)]
    contracts = spark.createDataFrame(terms, "contract_id int, meter_number string, valid_from date, valid_to date, capacity double, exceeded boolean")
    readings = spark.createDataFrame(asked, "extraction_id int, meter_number string, day date, demand_value double")

    def force(meter, at):
        low = DAY(1)
        fit = [((a or low), i) for i, m, a, b, *_ in terms if m is not None and m == meter and at is not None and (a or low) <= at and (b is None or at <= b)]
        return max(fit)[1] if fit else None

    got = sorted(((x["extraction_id"], x["contract_id"]) for x in usage.contract_in_force(readings, contracts).collect()), key=str)
    assert got == sorted(((i, force(m, at)) for i, m, at, _ in asked), key=str) and len({c for _, c in got}) > 8
    lines = spark.createDataFrame([(900, "Dépassement puissance"), (901, None)], "extraction_id int, description string")
    by_id = {t[0]: t for t in terms}
    over = {i for i, m, at, v in asked if (c := force(m, at)) is not None and v > by_id[c][4] and not by_id[c][5]} - {900}
    assert {x["extraction_id"] for x in usage.capacity_exceeded(readings, contracts, lines).collect()} == over and over
    assert usage.contract_in_force(readings.limit(0), contracts).isEmpty() and usage.contract_in_force(readings, contracts.limit(0)).where("contract_id is null").count() == len(asked)


def test_names_in_texts(spark, monkeypatch):
    r = random.Random(5)
    word = lambda most: "".join(r.choice("abÄ ") for _ in range(r.randint(0, most)))
    listed = [(i, r.choice("xy"), word(7)) for i in range(80)] + [(99, "x", None)]
    texts = [(r.choice("xyz"), word(25)) for _ in range(60)] + [("x", ""), ("x", None), (None, "ab")]
    a = spark.createDataFrame(texts, "country string, text string")
    b = spark.createDataFrame(listed, "ordinal int, country string, name string")
    want = {(c, t, i) for (c, t), (i, k, n) in itertools.product(texts, listed) if c == k and t is not None and n is not None and n.lower() in t.lower()}
    for few in (1000, 0):
        monkeypatch.setattr(names, "FEW", few)
        got = [(x["country"], x["text"], x["ordinal"]) for x in names.contained(a, b, ("country",)).collect()]
        assert set(got) == want and len(got) == len(want) > 100


def test_ten_thousand_names_without_a_nested_loop(spark):
    listed = spark.range(10_000).selectExpr("cast(id as int) AS ordinal", "concat('name ', id) AS name")
    texts = spark.range(300).selectExpr("concat('a NAME ', id * 33, ' b') AS text")
    found = names.contained(texts, listed)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(x["text"], x["ordinal"]) for x in found.collect()}
    assert got == {(f"a NAME {33 * i} b", int(str(33 * i)[:n])) for i in range(300) for n in range(1, len(str(33 * i)) + 1) if i or n == 1}


def test_many_names_leave_texts_where_they_are(spark, monkeypatch):
    """With more names than are broadcast, words travel to the names, the characters of a text don't."""
    monkeypatch.setattr(names, "FEW", 100)
    listed = spark.range(400).selectExpr("cast(id as int) AS ordinal", "concat('name ', id) AS name").unionByName(spark.createDataFrame([(900, "name 7"), (901, "name 7"), (902, "")], "ordinal int, name string"))
    texts = spark.createDataFrame([("x Name 71 name 7",), ("x Name 71 name 7",), ("na",), ("",), (None,)], "text string")
    found = names.contained(texts, listed)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1
    assert sorted((x["text"], x["ordinal"]) for x in found.collect()) == sorted([("x Name 71 name 7", i) for i in (7, 71, 900, 901, 902)] + [("na", 902), ("", 902)])
