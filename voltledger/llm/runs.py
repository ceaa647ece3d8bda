"""Periodic runs of words by a dictionary of basic factors, and texts with their repetitions taken out."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks

#: Bytes of a text whose words are objects at once, and words that are searched together.
SLICE_BYTES, BATCH_WORDS = 1 << 20, 1 << 18
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of text, those of about SLICE_BYTES at a time."""
    lo = 0
    while lo < len(text):
        hi = lo + SLICE_BYTES
        cut = _BLANK.search(text, hi) if hi < len(text) else None
        hi = cut.end() if cut else len(text)
        yield text[lo:hi].split()  # for bytes, exactly the white space 0x20 and 0x09 to 0x0D
        lo = hi


class Words:
    """A text's words as numbers, equal for equal words, with each distinct word kept once."""

    def __init__(self, text: bytes):
        seen: dict[bytes, int] = {}
        codes = [np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int32, len(ws)) for ws in _slices(text)]
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        self.distinct = list(seen)

    def joined(self, codes: np.ndarray) -> bytes:
        step = max(1, SLICE_BYTES // 8)
        return b" ".join(b" ".join(map(self.distinct.__getitem__, codes[i : i + step].tolist())) for i in range(0, len(codes), step))


def find_runs(codes: list[np.ndarray], least_length: int = 24, least_turns: int = 3) -> list[np.ndarray]:
    """Per text its maximal runs as rows (start, length, smallest period), by start, then period: those of at least
    least_length words and least_turns (3 or more) periods.

    The dictionary of basic factors names the stretches of 1, 2, 4, ... words, those of a text that occur again in it.
    Occurrences of a stretch of L words within 2 L words are as far apart as its smallest period q, so a chain of places
    whose next occurrence is q words on lies in one run of period q. Length L proposes the periods above L / 2 up to L, so
    each period has one length that proposes it. As a run holds three periods or more, it is longer than q + L; its chain
    is then all places from its start to its end less q + L, so the chain tells where the run starts and ends, without
    a comparison of further words, and no run comes twice."""
    if least_turns < 3:
        raise ValueError("a run has three periods at least")
    sizes = np.array([len(c) for c in codes], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a place between texts belongs to none
    found: list[np.ndarray] = []
    # names of stretches of `length` words, -1 where a stretch doesn't recur in its text or would leave it
    names = np.full(starts[-1], -1, np.int64)
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)] or [np.zeros(0, np.int64)])
    text_of = np.repeat(np.arange(len(codes)), sizes)
    key = text_of << 32 | (np.concatenate(codes).astype(np.int64) if len(codes) else at)
    length = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        again = key[1:] == key[:-1]
        recurs = np.zeros(len(key), bool)
        recurs[1:] |= again
        recurs[:-1] |= again
        # chains: places in a row whose next occurrence is equally far
        place, gap = at[:-1][again], np.diff(at)[again]
        near = (gap <= length) & (2 * gap > length)
        place, gap = place[near], gap[near]
        order = np.argsort(place)
        place, gap = place[order], gap[order]
        if len(place):
            first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(gap) != 0)]))
            last = np.append(first[1:], len(place)) - 1
            run = np.stack([place[first], place[last] - place[first] + length + gap[first], gap[first]], axis=1)
            found.append(run[run[:, 1] >= np.maximum(least_length, least_turns * run[:, 2])])
        names[:] = -1
        names[at[recurs]] = np.cumsum(np.concatenate([[0], ~again]))[recurs]
        # twice as long: two names side by side
        at = np.sort(at[recurs])
        at = at[at + length < len(names)]
        second = names[at + length]
        at, second = at[second >= 0], second[second >= 0]
        key = names[at] * np.int64(len(names) + 1) + second
        length *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[owner]
    order = np.lexsort((runs[:, 2], runs[:, 0], owner))
    runs, owner = runs[order], owner[order]
    cut = np.searchsorted(owner, np.arange(len(codes) + 1))
    return [runs[a:b] for a, b in zip(cut[:-1], cut[1:])]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: a run keeps its first period, and a word goes if any run drops it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def collapse_runs(docs: DataFrame, text: str = "text", least_length: int = 24, least_turns: int = 3) -> DataFrame:
    """docs with n_words, runs (an array of start, length, period in words, by start, then period) and collapsed (the words
    that stay, joined by one blank), as found by find_runs. Words end at ASCII white space and count as they are, case
    included. Null and empty texts have no words, no runs and an empty collapsed text; rows are treated alike however often
    they come; columns n_words, runs and collapsed of docs are replaced. A very long text costs its distinct words and some
    50 bytes a word while it is searched."""
    docs = docs.drop("n_words", "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    which = docs.columns.index(text)
    kind = pa.list_(pa.field("element", pa.struct([pa.field(c, pa.int64(), False) for c in RUN.names]), False))

    def search(batch: pa.RecordBatch, held: list[Words]) -> pa.RecordBatch:
        runs = find_runs([w.codes for w in held], least_length, least_turns)
        flat = np.concatenate(runs)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
        texts = [w.joined(w.codes[kept_words(len(w.codes), r)]).decode() for w, r in zip(held, runs)]
        added = [pa.array([len(w.codes) for w in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs, type=kind), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "n_words", "runs", "collapsed"])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            held, first, n = [], 0, 0
            for i, t in enumerate(b.column(which)):
                held.append(Words((t.as_py() or "").encode()))
                n += len(held[-1].codes)
                if n >= BATCH_WORDS or i + 1 == b.num_rows:
                    yield search(b.slice(first, len(held)), held)
                    held, first, n = [], i + 1, 0

    return docs.mapInArrow(collapse, schema)


def with_derived_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about a tenth of the rows the words from some place on repeat. With h = crc32(decimal doc_id),
    g = h div 10 and n words: if h is a multiple of 10 and n > 0, each word i >= a becomes word a + (i - a) mod p, where
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Such texts are joined by one blank. A null doc_id changes nothing."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                h, t = zlib.crc32(str(doc).encode()), t.as_py()
                if doc is not None and h % 10 == 0 and t:
                    words, g = Words(t.encode()), h // 10
                    if n := len(words.codes):
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        source = np.arange(n)
                        source[a:] = a + (source[a:] - a) % p
                        t = words.joined(words.codes[source]).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(derive, "doc_id long, text string")


def strongest(runs: Column) -> Column:
    """Of an array of runs in order the first with the greatest length / period, compared exactly; null if there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(more(best, r), r).otherwise(best))


def summarise_runs(docs: DataFrame) -> DataFrame:
    """One row per document from collapse_runs: doc_id, n_runs, the strongest run and its exponent in thousandths (nulls
    without a run), and SHA-256 of all runs (`start,length,period` and a line feed each) and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = docs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").alias("listed"), "collapsed")
    return best.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
