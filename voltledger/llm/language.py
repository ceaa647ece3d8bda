"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, Scratch, blocks, mix

SIZES = (3, 4)
_letters: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Code point -> its lower case if a letter, else a blank."""
    global _letters
    if _letters is None:
        _letters = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                _letters[c] = ord(low) if len(low) == 1 else c
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text's letters, runs of anything else being one blank, a blank around the whole;
    the text of each; whether each text has a letter."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    sep = " ".encode("utf-32-le")
    cp = _folded()[np.frombuffer(sep + sep.join(raw) + sep, "<u4")]
    ends = np.cumsum([len(r) // 4 + 1 for r in raw])  # of each text with its blank before
    owner = np.repeat(np.arange(len(raw) + 1), [*np.diff([0, *ends]), 1])
    owner[-1] = len(raw) - 1
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    keep[[0, *ends[:-1]]] = True
    cp, owner = cp[keep], owner[keep]
    has = np.zeros(len(raw), bool)
    has[np.unique(owner[cp != 32])] = True
    cp = cp.astype(np.uint64) + np.uint64(1)
    out, of = [], []
    for n in SIZES:
        if len(cp) < n:
            continue
        h = np.zeros(len(cp) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(BASE) + cp[i : len(cp) - n + 1 + i]
        # the blank before the next text ends this one; no n-gram goes on behind it
        inside = owner[: len(h)] == owner[n - 2 : n - 2 + len(h)]
        out.append(mix(h[inside] + np.uint64(n)))
        of.append(owner[: len(h)][inside])
    return (np.concatenate(out), np.concatenate(of), has) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), has)


def _groups(texts: list[str | None], chars: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= chars:
            yield lo, texts[lo : i + 1]
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


@dataclass
class LanguageFilter:
    """Slices of one Bloom filter per language, side by side: word i holds bit i of every language's filter."""

    languages: list[str]
    slices: np.ndarray
    hashes: int
    false_rate: np.ndarray

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        first, stride = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(self.hashes):
            yield ((first + np.uint64(i) * stride) % np.uint64(len(self.slices))).astype(np.int64)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """Per n-gram, a bit mask of the languages whose filter holds it."""
        mask = None
        for at in self.places(h):
            mask = self.slices[at] if mask is None else mask & self.slices[at]
        return mask

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for _, group in _groups(texts):
            h, of, has = grams(group)
            mask = self.languages_of(h)
            n = np.bincount(of, minlength=len(group)).astype(float)
            hits = np.stack([np.bincount(of, weights=(mask >> np.uint64(b)) & np.uint64(1), minlength=len(group)) for b in range(len(self.languages))], axis=1)
            true = np.clip((hits - self.false_rate * n[:, None]) / (1 - self.false_rate), 0, None)
            share = true / np.maximum(n, 1)[:, None]
            best = share.argmax(axis=1)
            out += [(self.languages[b], float(min(1.0, share[i, b]))) if has[i] else ("und", 0.0) for i, b in enumerate(best)]
        return out


def train(labelled: DataFrame, max_documents: int = 20_000, least_rate: float = 1e-5, contrast: float = 0.3, bits: int = 20, hashes: int = 4) -> LanguageFilter:
    """Learns from text and lang of labelled rows; those with a null of either are left out.

    Of a language with more than max_documents rows, a hash of the text picks about that many: the bound on the sample.
    An n-gram belongs to a language if its share of that language's n-grams is at least least_rate, which bounds the
    n-grams kept per language by 1 / least_rate, and at least contrast times its largest share in any language. At most
    64 languages; 2**bits positions of hashes bits each."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    n_docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(65).collect()}
    languages = sorted(n_docs)
    if len(languages) > 64:
        raise ValueError("a mask holds 64 languages at most")
    if not languages:
        return LanguageFilter(["und"], np.zeros(1, np.uint64), hashes, np.zeros(1))
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    taken = None
    for lang, n in n_docs.items():
        if n > max_documents:
            drop = (F.col("lang") == lang) & (part >= int((1 << 20) * max_documents / n))
            taken = ~drop if taken is None else taken & ~drop
    if taken is not None:
        rows = rows.where(taken)
    code = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part_ in blocks([b], "text"):
                langs = np.array([code[x] for x in part_.column(1).to_pylist()])
                h, of, _ = grams(part_.column(0).to_pylist())
                of = langs[of]
                for c in np.unique(of).tolist():
                    g, n = np.unique(h[of == c], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), c, np.int32)), pa.array(n)], ["gram", "lang", "n"])

    each = [F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))]
    scratch = Scratch(labelled.sparkSession, "language")
    counted = scratch.put(rows.mapInArrow(count, "gram long, lang int, n long").groupBy("gram").agg(*each), "grams")
    totals = counted.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages)))).first()
    rate = [F.col(f"n{i}") / F.lit(float(max(totals[i] or 0, 1))) for i in range(len(languages))]
    most = F.greatest(*rate, F.lit(0.0))
    mask = sum((F.when((r >= least_rate) & (r >= contrast * most), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rate)), F.lit(0).cast("long"))
    kept = counted.select("gram", mask.alias("mask")).where("mask != 0").toArrow()
    scratch.clear()
    found = LanguageFilter(languages, np.zeros(1 << bits, np.uint64), hashes, np.zeros(len(languages)))
    h, masks = kept["gram"].to_numpy().view(np.uint64), kept["mask"].to_numpy().view(np.uint64)
    for at in found.places(h):
        np.bitwise_or.at(found.slices, at, masks)
    fill = np.array([float(((found.slices >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(languages))])
    found.false_rate = fill**hashes
    return found


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: each language's share of the text's n-grams that its filter holds, corrected for
    the filter's false positives; the largest wins, ties going to the first by name. Null texts and texts without
    a letter are 'und' with score 0; clashing columns lang_pred and score are replaced."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    which = docs.columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            said = model.predict(b.column(which).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)


def fold_of(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def identify_documents(docs: DataFrame, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id as text mod folds is 0), lang_pred, score. Learns from the
    other rows that have a text and a lang; a null doc_id is not held out and not learned from."""
    model = train(docs.where(fold_of(folds) != 0))
    held = F.coalesce(fold_of(folds) == 0, F.lit(False))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
