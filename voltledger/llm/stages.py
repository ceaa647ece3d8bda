"""The corpus operators as steps that keep or change documents.

Each step returns the columns it was given, whatever their names, and an empty table for an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .decontam import find_leaks
from .language import identify, train
from .neardup import BROADCAST_IDS, near_duplicates
from .packing import pack_documents
from .repeats import cut_repeats


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with its columns but those used renamed c0, c1, ..., so that no name clashes with a step's own."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in used else f"c{k}") for k, c in enumerate(docs.columns)))


def put_back(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    return df.select(*(F.col(c if c in used else f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def without(docs: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """docs but those listed (a table of key, written before). Broadcast up to BROADCAST_IDS rows."""
    few = listed.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(listed) if few else listed.hint("merge"), key, "left_anti")


def keep_known_languages(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """Drops documents without a letter, null texts among them, and those of whose n-grams less than least_score are
    known in the predicted language. A missing lang becomes the predicted one. Learns from the documents with a lang.
    Ties go to the first language by name; repeated rows are judged alike."""
    used = ("text", "lang")
    said = identify(set_aside(docs, *used), train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return put_back(said.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, *used)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id (null being the largest); of equal rows' doc_id and
    text, one. Rows of one doc_id with different texts are judged each; null and wordless texts are alike only to equal ones."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    used = ("doc_id", "text")
    keyed = set_aside(docs, *used).withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = scratch.put(near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")), "found").groupBy(F.col("doc_id").alias("key")).agg(F.min("group_id").alias("group"), F.count(F.lit(1)).alias("n"))
    named = scratch.put(found.join(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).hint("merge"), "key"), "named")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("kept"))
    dropped = named.join(first.hint("merge"), "group").where("key != kept").select("key")
    kept = without(keyed, scratch.put(dropped, "dropped"), "key")
    twice = scratch.put(named.where("n > 1").select("key"), "twice")
    few = twice.count() <= BROADCAST_IDS
    again = kept.join(F.broadcast(twice) if few else twice.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    scratch.clear(keep=("dropped", "twice"))
    return put_back(without(kept, twice, "key").union(again.select(kept.columns)), docs, *used)


def cut_repeated_strings(docs: DataFrame, size: int = 400) -> DataFrame:
    """Texts without the strings of size bytes that stand elsewhere too; a character cut in two goes as a whole. Documents
    of which nothing but blanks is left are dropped if something was removed; null and short texts stay as they are."""
    scratch = Scratch(docs.sparkSession, "cut")
    used = ("text", "n_chars") if "n_chars" in docs.columns else ("text",)
    out = cut_repeats(set_aside(docs, *used), size, scratch, as_text=True)
    scratch.clear(keep=("texts", "spans"))
    out = out.where((F.col("n_removed") == 0) | (F.trim("kept") != "")).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return put_back(out, docs, *used)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops documents that hold an item of the benchmark; equal rows go together. Null texts, and an empty benchmark, drop nothing."""
    scratch = Scratch(docs.sparkSession, "leaks")
    used = ("doc_id", "text")
    leaks = scratch.put(find_leaks(docs, benchmark).select("row").distinct(), "rows")
    return put_back(without(set_aside(docs, *used).withColumn("row", F.xxhash64("doc_id", "text")), leaks, "row"), docs, *used)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null text is the end token alone; repeated rows are packed each."""
    return pack_documents(docs, tokenizer_path)
