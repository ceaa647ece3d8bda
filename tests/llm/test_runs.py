"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltledger.llm import runs

SCHEMA = "doc_id long, text string, n_words string, runs int"


def by_hand(words, least_length=24, least_turns=3):
    n, found = len(words), {}
    for q in range(1, n // least_turns + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(least_length, least_turns * q):
                found.setdefault((s, length), q)  # the smallest period comes first
            s = e + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def texts():
    rng = random.Random(11)
    out = [None, "", " \t\n", "one", "x " * 23, "x " * 24, "x\t" * 25, "A a " * 12, "a b c " * 8, "a b c " * 7 + "a b", "  " * 30]
    for _ in range(150):
        words = []
        while len(words) < rng.randint(20, 300):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, rng.choice([3, 9, 40])))]
            words += unit * rng.choice([1, 1, 2, 3, 4, 9, 30])
            words = words[: len(words) - rng.randint(0, len(unit) - 1)] or words
        out.append(" ".join(words))
    # runs in runs, and runs that overlap
    inner = "a b " * 14 + "c"
    out += [" ".join([inner] * 5), "a b " * 20 + "a c " * 20, "a a b " * 16 + "a a c " * 16, ("a " * 30 + "b ") * 4, " ".join("abcdefgh"[i % 8] for i in range(1000))]
    return out


def test_runs_of_number_lists():
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts()]
    codes = [np.array([sum(map(ord, w)) for w in ws], np.int32) for ws in words]
    for least_length, least_turns in ((24, 3), (3, 3), (10, 4)):
        got = runs.find_runs(codes, least_length, least_turns)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [by_hand(ws, least_length, least_turns) for ws in words]
    assert sum(map(len, runs.find_runs(codes, 3, 3))) > 1000
    assert runs.find_runs([]) == []
    with pytest.raises(ValueError):
        runs.find_runs(codes, 24, 2)


def test_long_texts_are_read_in_slices(monkeypatch):
    text = " ".join(random.Random(3).choices(["ab", "c", "déf", "\x1c"], k=500)).encode()
    whole = runs.Words(text)
    monkeypatch.setattr(runs, "SLICE_BYTES", 16)
    cut = runs.Words(text)
    assert (whole.codes == cut.codes).all() and whole.distinct == cut.distinct and cut.joined(cut.codes) == text


@pytest.mark.parametrize("batch", [1 << 18, 100])
def test_documents(spark, monkeypatch, batch):
    monkeypatch.setattr(runs, "BATCH_WORDS", batch)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b " * 20), (3, "one"), (40, "a b " * 20), (40, "a b " * 20)]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, runs.summarise_runs(runs.collapse_runs(runs.with_derived_runs(docs))).collect()), key=str)
    want = []
    for i, t in rows:
        words = planted(i, t)
        found = by_hand(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        drop = {x for s, length, q in found for x in range(s + q, s + length)}
        kept = " ".join(w for k, w in enumerate(words) if k not in drop)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept)))
    assert got == sorted(want, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


def test_ties_and_exact_fractions(spark):
    pick = lambda *found: tuple(spark.range(1).select(runs.strongest(F.array(*(F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip(r, ("start", "length", "period")))) for r in found))).alias("r")).first()["r"])
    assert pick((0, 30, 10), (5, 24, 8), (9, 90, 30)) == (0, 30, 10)
    assert pick((0, 3 * 10**9, 10**9), (4, 3 * 10**9 + 1, 10**9)) == (4, 3 * 10**9 + 1, 10**9)


def test_the_operator_keeps_other_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "go " * 30, "own", 1)], SCHEMA)
    out = runs.collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    r = out.first()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (30, [(0, 30, 1)], "go")
    assert runs.summarise_runs(runs.collapse_runs(runs.with_derived_runs(docs.limit(0)))).count() == 0
