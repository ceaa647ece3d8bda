"""What comes in: files, pages, model answers, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Common words by language: a small list of our own, a parameter of the vote.
STOPWORDS = {"en": ["the", "of", "and", "to", "in", "is", "that", "with", "for"], "de": ["der", "die", "und", "das", "nicht", "ist", "ein", "für", "auf"], "fr": ["le", "la", "les", "des", "et", "que", "une", "dans", "pour"], "es": ["el", "los", "que", "en", "las", "por", "con", "una", "para"]}
MAX_BYTES = 50 * 1024 * 1024


def file_type(content: Column) -> Column:
    """By the first bytes."""
    starts = lambda mark: F.coalesce(F.startswith(content, F.unhex(F.lit(mark))), F.lit(False))
    return F.when(starts("25504446"), "pdf").when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8"), "jpeg").when(starts("49492A00") | starts("4D4D002A"), "tiff").otherwise("unknown")


def judged(files: DataFrame) -> DataFrame:
    """Files (path, modificationTime, length, content) with type, hash, and why they are turned away (null: they aren't)."""
    reason = F.when(~F.lower("path").endswith(".pdf"), "not a pdf").when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too large")
    return files.select("path", "modificationTime", "length", file_type(F.col("content")).alias("file_type"), F.sha2("content", 256).alias("file_hash"), reason.alias("reject_reason"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, judged. Spark's reader itself leaves out files of no bytes."""
    return judged(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def rendered_files(orders: DataFrame) -> DataFrame:
    """One file per order: of each type, some empty, misnamed or said to be over the largest size."""
    k = F.col("o_orderkey")
    mark = F.element_at(F.array(*map(F.lit, ("255044462D", "89504E470D0A1A0A", "89504E4731", "FFD8DB", "49492A00", "4D4D002A", "706C61696E"))), (k % 7 + 1).cast("int"))
    content = F.when(k % 10 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.concat(mark, F.hex(F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderstatus")))))
    name = F.concat(k.cast("string"), F.when(k % 8 == 0, ".png").when(k % 8 == 1, ".PDF").otherwise(".pdf"))
    return orders.select(name.alias("path"), F.col("o_orderdate").alias("modificationTime"), F.when(k % 13 == 0, MAX_BYTES + k).otherwise(F.octet_length(content)).alias("length"), content.alias("content"))


def rendered_responses(orders: DataFrame) -> DataFrame:
    """Answers as models write them: bare JSON, a fenced block, JSON between words, or none."""
    body = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "status": "'), F.col("o_orderstatus"), F.lit('"}'))
    k = F.col("o_orderkey") % 4
    content = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(k == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked."))).otherwise(F.lit("I could not { read it"))
    return orders.select(F.col("o_orderkey").alias("call_id"), content.alias("response_content"))


def parsed_responses(calls: DataFrame) -> DataFrame:
    """The JSON object in an answer: the whole text, else a fenced block, else first to last brace; strategy none if none."""
    t = F.trim("response_content")
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    between = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    parsed = lambda c: F.try_parse_json(F.nullif(c, F.lit("")))
    rows = calls.select("call_id", parsed(t).alias("a"), parsed(fence).alias("b"), parsed(between).alias("c"))
    value = F.coalesce("a", "b", "c")
    return rows.select("call_id", F.when(F.col("a").isNotNull(), "whole").when(F.col("b").isNotNull(), "fenced").when(F.col("c").isNotNull(), "braces").otherwise("none").alias("strategy"), F.try_variant_get(value, "$.id", "long").alias("id"), F.try_variant_get(value, "$.status", "string").alias("status"))


def rendered_attachments(orders: DataFrame) -> DataFrame:
    """Attachments of each order: for some a note, then an XML invoice that is told by its name or its content; some hold
    no due date or tax, every one two totals and an empty ID, some break off."""
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    name = F.when(k % 3 == 0, "Factur-X.xml").when(k % 3 == 1, "IT0001_fattura.xml").otherwise("data.xml")
    root = F.when(k % 2 == 0, "CrossIndustryInvoice").otherwise("FatturaElettronica")
    tag = lambda t, v: F.concat(F.lit(f"<r:{t}>"), v, F.lit(f"</r:{t}>"))
    total, day = F.col("o_totalprice").cast("decimal(18,2)"), F.date_format("o_orderdate", "yyyy-MM-dd")
    due = F.when(k % 5 == 0, F.lit("<r:DueDateDateTime/>")).otherwise(tag("DueDateDateTime", F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")))
    tax = F.when(k % 7 == 0, F.lit("")).otherwise(tag("TaxTotalAmount", (k % 90).cast("string")))
    body = F.concat(tag("ID", F.lit("")), tag("ID", text), tag("ID", F.lit("other")), F.lit("<IssueDateTime>"), day, F.lit("</IssueDateTime>"), due, tag("GrandTotalAmount", F.lit("1.00")), F.lit('<GrandTotalAmount currencyID="EUR">'), total.cast("string"), F.lit("</GrandTotalAmount>"), tax)
    data = F.concat(F.lit("<r:"), root, F.lit(' xmlns:r="urn:x">'), body, F.when(k % 11 == 0, F.lit("</r:")).otherwise(F.concat(F.lit("</r:"), root, F.lit(">"))))
    invoice = F.struct(F.lit(1).alias("pos"), name.alias("filename"), data.alias("data"))
    note = F.struct(F.lit(0).alias("pos"), F.lit("note.txt").alias("filename"), F.lit("see the CrossIndustryInvoice").alias("data"))
    return orders.select(k.alias("doc_id"), F.inline(F.when(k % 2 == 0, F.array(note, invoice)).otherwise(F.array(invoice))))


# Parts of names, and of contents of other XML files, that tell a structured invoice's kind.
INVOICE_NAMES = {"factur-x": "factur-x/zugferd", "zugferd": "factur-x/zugferd", "fattura": "fatturapa"}
INVOICE_TAGS = {"CrossIndustryInvoice": "factur-x/zugferd", "FatturaElettronica": "fatturapa"}


def structured_invoices(attachments: DataFrame) -> DataFrame:
    """The first attachment of each document that is a structured invoice: by file name, else an XML file by content. Of its
    fields the first ID and the last of the others that isn't blank. XML that breaks off gives no fields; entities in a
    field are left as they are."""
    name, data = F.lower("filename"), F.coalesce("data", F.lit(""))
    kinds = [(name.contains(x), kind) for x, kind in INVOICE_NAMES.items()] + [(name.endswith(".xml") & data.contains(x), kind) for x, kind in INVOICE_TAGS.items()]
    kind = F.coalesce(*(F.when(test, kind) for test, kind in kinds))
    first = Window.partitionBy("doc_id").orderBy("pos", "filename", "data")
    rows = attachments.withColumn("kind", kind).where("kind is not null").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    whole = F.regexp_like("data", F.lit(r"(?s)^\s*(?:<[?!].*?>\s*)*<([\w:.-]+)[\s>].*</\1\s*>\s*$"))
    found = lambda t: F.filter(F.regexp_extract_all("data", F.lit(rf"<(?:[\w.-]+:)?{t}(?:\s[^>]*)?>([^<]*)<"), F.lit(1)), lambda x: F.trim(x) != "")
    field = lambda t, at=-1: F.when(whole, F.try_element_at(found(t), F.lit(at)))
    return rows.select(
        "doc_id", "kind", field("ID", 1).alias("invoice_id"), field("GrandTotalAmount").try_cast("double").alias("grand_total"),
        field("IssueDateTime").alias("issue_date"), field("DueDateDateTime").alias("due_date"), field("TaxTotalAmount").try_cast("double").alias("tax_total"),
    )


def document_text(pages: DataFrame) -> DataFrame:
    """Texts of a document's pages in order, a blank between; a missing text is empty."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("text"))


def document_quality(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(F.col("quality").cast("decimal(18,6)")), F.lit(0)), 3).cast("double").alias("quality"), F.count(F.lit(1)).alias("n_pages"))


def page_sample(pages: DataFrame, doc: str, number: str) -> DataFrame:
    """The first page, and of more than two the middle one."""
    of_doc = Window.partitionBy(doc)
    rows = pages.withColumn("n", F.count(F.lit(1)).over(of_doc)).withColumn("k", F.row_number().over(of_doc.orderBy(number)))
    return rows.where((F.col("k") == 1) | ((F.col("n") > 2) & (F.col("k") == F.floor(F.col("n") / 2) + 1))).select(doc, number, "n")


def language_vote(docs: DataFrame) -> DataFrame:
    """The language with the most of its common words in the text; ties by name; en without any."""
    langs = sorted(STOPWORDS)
    # one pass cuts all but the listed words out of the text, which leaves few to count
    listed = sorted({w for stop in STOPWORDS.values() for w in stop})
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(rf"(?<![^ \n])(?:{'|'.join(listed)})(?![^ \n])"), F.lit(0))
    rows = docs.select("doc_id", words.alias("words"))
    count = lambda stop: F.size(F.filter("words", lambda w: w.isin(stop)))
    votes = [F.struct(count(STOPWORDS[lang]).alias("n"), F.lit(-k).alias("o"), F.lit(lang).alias("lang")) for k, lang in enumerate(langs)]
    best = F.array_max(F.array(*votes))
    return rows.select("doc_id", F.when(best["n"] > 0, best["lang"]).otherwise("en").alias("language"))


def json_view(bills: DataFrame, hidden: list[str]) -> DataFrame:
    """extraction_id, body: each row as a JSON object without the hidden columns."""
    return bills.select("extraction_id", F.to_json(F.struct(*(c for c in bills.columns if c not in hidden))).alias("body"))
