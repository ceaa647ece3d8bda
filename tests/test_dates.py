"""Dates of charges: the first format that reads a text, tried only where the text has its form."""

from pyspark.sql import functions as F

from voltledger.operators import documents

ODD = ["2020-01-05", "+12020-01-05", "12020-01-05", "-0001-01-05", "05/01/2020", "13/01/2020", "01/13/2020", "05-01-2020", "05.01.2020", "05.13.2020", " 05/01/2020", "05/01/2020 ", "5/1/2020", "2020-1-5", "", None, "29/02/2021", "29/02/2020", "٠٥/٠١/٢٠٢٠", "05/01/20201", "05/01/220", "00/00/0000", "05/00/2020", "00/05/2020", "2020-00-05", "05/aa/2020", "no date", "05-01/2020", "2020-01-05T10:00:00"]


def test_any_date_reads_what_the_formats_read(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x string")
    plain = F.coalesce(*(F.try_to_timestamp("x", F.lit(f)).cast("date") for f in documents.DATE_FORMATS))
    got = rows.select("x", documents.any_date(F.col("x")).cast("string").alias("got"), plain.cast("string").alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert sum(r["got"] is not None for r in got) > 6


def test_formats_are_tried_and_written_only_where_they_apply(spark):
    """A format that fails, or a date written in five formats for one, is most of the query's time."""
    said = spark.createDataFrame([("x",)], "x string").select(documents.any_date(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("CASE WHEN") >= len(documents.DATE_FORMATS)
    lines = spark.createDataFrame([(1, k, "energy", "1.00", "2020-01-05") for k in range(5)], "extraction_id long, line_number int, category string, amount string, service_date string").withColumn("service_date", F.to_date("service_date"))
    made = documents.rendered(lines)
    assert "array(date_format" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r["service_date"].isoformat() for r in documents.charge_rows(made).collect()].count("2020-01-05") >= 3
