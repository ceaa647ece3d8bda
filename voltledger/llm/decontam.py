"""Benchmark decontamination by latent semantic retrieval of passages, then common-subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, joined_bytes, squeezed, unsqueezed, words

#: Items that one pass over the documents looks for; a longer list takes several passes.
ITEM_BLOCK = 1024
#: Of a task's counts, how many go together to where they are added up.
PART = 1 << 14
#: Pieces, of like length, that share a bound on their products.
BOUND_PIECES = 16


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def runs_of(of: np.ndarray, n: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, in order and by text, in runs of stride: each word's run, each run's text."""
    count = np.bincount(of, minlength=n)
    place = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    runs = -(-count // stride)
    return (np.cumsum(runs) - runs)[of] + place // stride, np.repeat(np.arange(n), runs)


def add_together(acc: np.ndarray, column: np.ndarray, run: np.ndarray, n: int) -> None:
    """Adds to acc (n x n, flat), on and above its diagonal, the products of how often two columns stand in a run, run by run. Words
    without a column have -1; runs are in order."""
    has = np.flatnonzero(column >= 0)
    c, of = column[has], run[has]
    np.add.at(acc, c * (n + 1), np.uint32(1))
    apart, at = 1, np.arange(len(c))
    while True:
        at = at[at + apart < len(c)]
        at = at[of[at] == of[at + apart]]
        if not len(at):
            return
        x, y = c[at], c[at + apart]
        np.add.at(acc, np.minimum(x, y) * n + np.maximum(x, y), (1 + (x == y)).astype(np.uint32))
        apart += 1


def corpus_counts(docs: DataFrame, lists: list[np.ndarray], stride: int, bits: int) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Over all texts: of each hashed word, how many texts hold it; the number of texts; and for each of lists (words' hashes, in order)
    the matrix of how often two of its words stand in one run of stride words (the products of their counts, summed over all runs)."""
    held = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]))
    weights, places = Weights(np.zeros(1 << bits, np.float32), held, bits), [columns_in(held, x) for x in lists]
    edges = np.cumsum([0, 1 << bits, 1, *(len(x) ** 2 for x in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(edges[-1], np.uint32)
        for b in blocks(batches, "text", 1 << 20):
            h, of, _, _ = words(*joined_bytes(b.column("text")))
            narrow = np.uint32 if b.num_rows << bits < 1 << 32 else np.int64
            seen = np.sort((of << bits | slots(h, bits)).astype(narrow))
            seen = seen[np.insert(seen[1:] != seen[:-1], 0, True)[: len(seen)]].astype(np.int64)
            np.add.at(acc, seen & ((1 << bits) - 1), np.uint32(1))
            acc[edges[1]] += b.num_rows
            if len(held):
                run_, _ = runs_of(of, b.num_rows, stride)
                column, _ = weights.look(h)
                for place, lo, hi, x in zip(places, edges[2:], edges[3:], lists):
                    add_together(acc[lo:hi], place[column], run_, len(x))
        for lo in range(0, len(acc), PART):
            if (part := acc[lo : lo + PART]).any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // PART]), pa.array([squeezed(part)], pa.binary())], ["part", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(0, np.uint64)
        for x in t.column("n"):
            one = unsqueezed(x.as_py(), "<u4")
            total = total + one if len(total) else one.astype(np.uint64)
        return pa.table({"part": t.column("part")[:1], "n": pa.array([squeezed(total)], pa.binary())})

    # a group holds one compressed part a task
    types = "part long, n binary"
    got = docs.select("text").mapInArrow(run, types).groupBy("part").applyInArrow(add, types).toArrow()
    out = np.zeros(edges[-1], np.uint64)
    for part, n in zip(got["part"].to_pylist(), got["n"]):
        one = unsqueezed(n.as_py(), "<u8")
        out[part * PART : part * PART + len(one)] = one
    together = [np.triu(out[lo:hi].reshape(len(x), -1)).astype(np.float64) for lo, hi, x in zip(edges[2:], edges[3:], lists)]
    return out[: edges[1]].astype(np.int64), int(out[edges[1]]), [x + np.triu(x, 1).T for x in together]


def columns_in(held: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of each of held, its place in part (-1: none), both in order; and -1 behind them, for words not held."""
    at = np.minimum(np.searchsorted(part, held), len(part) - 1)
    return np.append(np.where(part[at] == held, at, -1), -1)


class Weights:
    """TF-IDF weights of words, idf by slot. Only the items' words (held, in order) have a column of their own: the others can't
    add to a product with an item, but do to a passage's length."""

    def __init__(self, idf: np.ndarray, held: np.ndarray, bits: int):
        self.idf, self.held, self.bits = idf, held, bits
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[slots(self.held, bits)] = True

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's column (-1: none) and weight."""
        slot = slots(h, self.bits)
        column = np.full(len(h), -1)
        some = np.flatnonzero(self.maybe[slot])
        if len(some):
            at = np.minimum(np.searchsorted(self.held, h[some]), len(self.held) - 1)
            column[some] = np.where(self.held[at] == h[some], at, -1)
        return column, self.idf[slot]


def row_sums(rows: np.ndarray, at: np.ndarray, weight: np.ndarray, by: np.ndarray, n: int, step: int = 1 << 15) -> np.ndarray:
    """rows[at] * weight added up by group (by, in order): the first members of all groups at once, then the second, ..."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    first = np.insert(by[1:] != by[:-1], 0, True)
    place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    for lo in range(0, len(by), step):
        k = place[lo : lo + step]
        for j in range(int(k.min()), int(k.max()) + 1):
            i = lo + np.flatnonzero(k == j)
            out[by[i]] += rows[at[i]] * weight[i, None]
    return out


def added_next(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of runs, those of passages: run i and the next one of the same text, if there is one."""
    out = x.copy()
    inner = np.flatnonzero(text[1:] == text[:-1])
    out[inner] += x[inner + 1]
    return out


def passages(column: np.ndarray, w: np.ndarray, run: np.ndarray, text: np.ndarray, most: np.ndarray, floor: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages whose product with some item can reach floor, and their latent vectors. Items come in groups: most (columns x
    groups) is the most that an item of the group has of a column, floor (passages x groups) what its products must reach. What a
    passage has of most bounds all its products."""
    none = np.zeros(0, np.int64), np.zeros((0, space.shape[1]), np.float32)
    has = np.flatnonzero(column >= 0)
    if not len(has):
        return none
    of = run[has]
    first = np.flatnonzero(np.insert(of[1:] != of[:-1], 0, True))
    bound = np.zeros((len(text), most.shape[1]), np.float32)
    bound[of[first]] = np.add.reduceat(most[column[has]] * w[has, None], first, axis=0)
    at = np.flatnonzero((added_next(bound, text) >= floor * (1 - 1e-5)).any(axis=1))
    if not len(at):
        return none
    follows = np.zeros(len(text), bool)
    follows[:-1] = text[1:] == text[:-1]
    need = np.zeros(len(text) + 1, bool)
    need[at] = True
    need[at[follows[at]] + 1] = True
    kept = np.flatnonzero(need)
    place = np.cumsum(need) - 1
    has = has[need[run[has]]]
    sums = row_sums(space, column[has], w[has], place[run[has]], len(kept))
    out = sums[place[at]]
    out[follows[at]] += sums[place[at[follows[at]] + 1]]
    return at, out


def bounds(full: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For passages(): columns x groups, the most that a piece of the group has of a column; and the least of the group's lengths."""
    order = np.argsort(size, kind="stable")
    first = np.arange(0, len(order), BOUND_PIECES)
    return np.ascontiguousarray(np.maximum.reduceat(full[order], first, axis=0).T), size[order][first]


def latent_space(together: np.ndarray, items: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """columns x rank: the leading right singular vectors of the TF-IDF matrix A of the runs of all texts and of the items, by
    randomised SVD: a random start, then twice G -> A'AG with an orthogonal basis in between. Of the texts' part of A'A, together holds
    the sums of products of counts, idf the columns' weights. Each item is as heavy as all texts together."""
    columns = items.shape[1]
    width = min(columns, rank + 8)
    if not width:
        return np.zeros((0, 0), np.float32)
    items = items.astype(np.float64)
    own = together * idf[:, None] * idf
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((columns, width)))[0]
    for _ in range(2):
        out = own @ basis
        heavy = max(1.0, float(np.abs(out).max()) * columns)
        out += heavy * (items.T @ (items @ basis))
        basis = np.linalg.qr(out)[0]
    u = np.linalg.svd(basis.T @ out, full_matrices=False)[0]  # directions in order of their share
    return np.ascontiguousarray((basis @ u)[:, :rank]).astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = (v + u) | (v - u)
    return len(a) - bin(v & full).count("1")


class Items:
    """Benchmark items ready for comparison: their words, and their answers' words."""

    def __init__(self, ids: list, texts: list[str | None], answers: list[str | None] | None):
        self.ids = ids
        self.hashes = [words(*joined_bytes(pa.array([t], pa.string())))[0] for t in texts]
        self.words = [h.tolist() for h in self.hashes]
        if answers is None:
            answers = [(t or "").rstrip(". \n").replace("\n", " ").rpartition(". ")[2] for t in texts]
        self.answers = [set(words(*joined_bytes(pa.array([a], pa.string())))[0].tolist()) for a in answers]


def pieces(items: Items, size: int) -> list[tuple[int, np.ndarray]]:
    """Each item's words cut evenly into pieces of at most size words, with the item's place."""
    return [(j, part) for j, h in enumerate(items.hashes) if len(h) for part in np.array_split(h, -(-len(h) // size))]


def piece_matrix(parts: list[np.ndarray], weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """pieces x columns, rows of length 1; and the lengths."""
    out = np.zeros((len(parts), len(weights.held)), np.float32)
    for i, h in enumerate(parts):
        column, w = weights.look(h)
        np.add.at(out[i], column, w)
    length = np.linalg.norm(out, axis=1)
    return out / np.maximum(length[:, None], 1e-9), length


def find_leaks(docs: DataFrame, benchmark: DataFrame, stride: int = 16, rank: int = 256, bits: int = 20, near: float = 0.35, verbatim: float = 0.6, paraphrase: float = 0.4, answer: float = 0.8) -> DataFrame:
    """row (hash of doc_id and text), item_id, overlap: the best match of each text with each item that it leaks.

    Items are cut into pieces of at most stride words. Passages of two runs of stride words, each a run further on, so that any
    stride words of a text lie in one passage, are compared with the pieces in latent spaces of rank dimensions: TF-IDF with
    document frequencies over all texts (words hashed to 2**bits slots; a word that all texts hold still weighs ln 2), randomised SVD fitted on the runs of all
    texts and on the pieces. A space serves at most rank pieces, which it spans, so products with them are those of the full
    space; passages whose products can't be large enough are skipped. A passage is checked against a piece's item if it
    reaches, along the piece's direction, near times the length of the shorter of the two: at a cosine of near, and also if rarer
    words beside a frequent item make the passage long. Checked is the longest common subsequence of words, of the item and the passage
    with an item's length on either side: it must be verbatim times the item's words or more; or paraphrase times, with answer
    times the answer's words among it. Without a column answer, an item's last sentence is its answer. Items without words match
    nothing."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    has_answer = "answer" in benchmark.columns
    listed = benchmark.select("item_id", "text", *(["answer"] if has_answer else [])).toArrow()
    found = None
    for lo in range(0, max(listed.num_rows, 1), ITEM_BLOCK):
        some = listed.slice(lo, ITEM_BLOCK)
        items = Items(some["item_id"].to_pylist(), some["text"].to_pylist(), some["answer"].to_pylist() if has_answer else None)
        cut = pieces(items, stride)
        groups = [cut[first : first + rank] for first in range(0, len(cut), rank)]
        lists = [np.unique(np.concatenate([h for _, h in g])) for g in groups]
        df, n_docs, together = corpus_counts(rows, lists, stride, bits) if groups else (np.zeros(1 << bits, np.int64), 0, [])
        idf = np.log1p((n_docs + 1.0) / (df + 0.5)).astype(np.float32)
        held = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]))
        spaces = []
        for g, own, counts in zip(groups, lists, together):
            of_item, parts = zip(*g)
            full, size = piece_matrix(list(parts), Weights(idf, own, bits))
            space = latent_space(counts, full, idf[slots(own, bits)], rank)
            spaces.append((columns_in(held, own), np.array(of_item), *bounds(full, size), size, space, (full @ space).T.copy()))
        sent = spark.sparkContext.broadcast((items, idf, held, spaces))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, idf, held, spaces = sent.value
            weights = Weights(idf, held, bits) if spaces else None
            for b in blocks(batches, "text", 1 << 20) if spaces else ():
                h, of, _, _ = words(*joined_bytes(b.column("text")))
                if not len(h):
                    continue
                run, text = runs_of(of, b.num_rows, stride)
                found_at, w = weights.look(h)
                length = np.sqrt(added_next(np.bincount(run, weights=w.astype(float) ** 2, minlength=len(text)), text))
                word_at = np.searchsorted(of, np.arange(b.num_rows + 1))
                run_at = np.searchsorted(text, np.arange(b.num_rows))
                best: dict[tuple[int, int], float] = {}
                checked: set[tuple[int, int]] = set()
                for place, of_item, most, least, size, space, latent in spaces:
                    reach, vectors = passages(place[found_at], w, run, text, most, near * np.minimum(length[:, None], least), space)
                    for lo in range(0, len(reach), 8192):
                        at = reach[lo : lo + 8192]
                        hit = vectors[lo : lo + 8192] @ latent >= near * np.minimum(length[at, None], size)
                        for i, k in zip(*(x.tolist() for x in np.nonzero(hit))):
                            j = int(of_item[k])
                            t, own = int(text[at[i]]), items.words[j]
                            if (int(at[i]), j) in checked or best.get((t, j), 0.0) >= 1.0:
                                continue
                            checked.add((int(at[i]), j))
                            start = int(word_at[t] + (at[i] - run_at[t]) * stride)
                            region = h[max(word_at[t], start - len(own)) : min(word_at[t + 1], start + 2 * stride + len(own))].tolist()
                            there = set(region)
                            if sum(x in there for x in own) < paraphrase * len(own):
                                continue
                            share = common_subsequence(own, region) / len(own)
                            if share >= verbatim or share >= paraphrase and items.answers[j] and len(items.answers[j] & there) >= answer * len(items.answers[j]):
                                best[t, j] = max(share, best.get((t, j), 0.0))
                if best:
                    row = b.column("row").to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([row[t] for t, _ in best], pa.int64()), pa.array([items.ids[j] for _, j in best], pa.int64()), pa.array(list(best.values()), pa.float64())], ["row", "item_id", "overlap"])

        one = rows.mapInArrow(search, "row long, item_id long, overlap double")
        found = one if found is None else found.unionByName(one)
    result = scratch.put(found.distinct(), "result")
    scratch.clear(keep=("result",))
    return result


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per row of docs: doc_id, leaked, n_items, item_ids (in order, joined by commas), overlap (the largest share
    of an item found; 0 if none). Null texts leak nothing; an empty benchmark or an empty table finds nothing."""
    leaks = find_leaks(docs, benchmark, **settings).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"), F.max("overlap").alias("o"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).join(leaks.hint("merge"), "row", "left")
    return rows.select("doc_id", F.col("n").isNotNull().alias("leaked"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("item_ids"), F.coalesce("o", F.lit(0.0)).alias("overlap"))
