"""Exact repeats of byte strings: content-cut phrases, their suffix order, and comparison of the windows it leaves open."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, Scratch, as_long, blocks, joined_bytes, mix, parts, powers
from .suffixes import suffix_ranks

#: Bytes of the string that makes a place an anchor, and one place in how many is.
GRAM, SPARSE = 16, 64
#: In a window without an anchor, one place in how many stands in for it.
DENSE = 8
#: Phrases that are compared behind an anchor.
AHEAD = 8
#: The lead of rows that are settled within a block of texts.
KNOWN = -2
#: Windows with the same first anchor that are compared in one go; more are split by their hashes.
HOT_WINDOWS = 500_000

_VALUE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: Bytes of text that are hashed in one go, so that the arrays stay in the processor's caches.
BLOCK = 1 << 18
#: The base of a second, independent hash of the same bytes.
OTHER_BASE = 0xC2B2AE3D27D4EB4F


@functools.cache
def _powers(base: int) -> np.ndarray:
    return powers(base, 2 * BLOCK)


def powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers, from a table that is kept unless they are many."""
    return _powers(base)[:n] if n <= 2 * BLOCK else powers(base, n)[:n]


class Hashes:
    """Hashes of any substring of data in constant time, from sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(_VALUE[data] * powers_of(base, n), out=self.sums[1:])
        self.back = powers_of(pow(base, -1, 2**64), n + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def anchors(h: Hashes, starts: np.ndarray, sparse: int = SPARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where the next GRAM bytes hash to one of the lowest of sparse parts of all hashes: position, text, bytes to the text's next anchor or end."""
    n = len(h.sums) - 1
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = h.sums[GRAM:] - h.sums[:-GRAM]
    gram *= h.back[: n - GRAM + 1]
    at = np.flatnonzero(gram < np.uint64(2**64 // sparse))
    of = np.searchsorted(starts, at, side="right") - 1
    inside = at + GRAM <= starts[of + 1]
    at, of = at[inside], of[inside]
    ends = starts[of + 1]
    same = np.flatnonzero(of[1:] == of[:-1])
    ends[same] = at[same + 1]
    return at, of, ends - at


def phrases(texts: DataFrame) -> DataFrame:
    """row, syms, lens, next, at: of each text its anchors in order: a hash of the bytes up to and with the next anchor's string
    (-1 for the last anchor), the bytes to the next anchor or the end, the same of the next anchor (0 for none), the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            data, starts = joined_bytes(b.column("text"))
            h = Hashes(data)
            at, of, size = anchors(h, starts)
            last = at + size == starts[of + 1]
            sym = (h.of(at, np.minimum(at + size + GRAM, len(data))) >> np.uint64(1)).astype(np.int64)
            sym[last] = -1
            then = np.append(size[1:], 0)[: len(size)]
            then[last] = 0
            cut = pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.ListArray.from_arrays(cut, pa.array(x)) for x in (sym, size, then, at - starts[of]))], ["row", "syms", "lens", "next", "at"])

    return texts.mapInArrow(run, "row long, syms array<long>, lens array<long>, next array<long>, at array<long>")


def by_row(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs as a table bucketed by row, a new number of each row: columns c0, c1, ... in place of its own, text, n_bytes, md5. Joins
    with it by row don't move its texts again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"), F.col("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.md5(text.cast("binary"))).alias("md5"), F.monotonically_increasing_id().alias("row"))
    return scratch.put_bucketed(rows, "row", "texts")


def with_rows(texts: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """texts (from by_row) with table's columns, by row: the table goes to the texts' buckets."""
    return texts.join(table.hint("shuffle_hash"), "row", how)


def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, in order of their column row, in tables that hold all of each of its values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        row = b.column("row").to_numpy()
        cut = int(np.searchsorted(row, row[-1]))  # the last value may go on
        if held and (cut or held[-1].column("row")[-1].as_py() != row[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, b = [], b.slice(cut)
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
            b = b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def in_runs(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers phrases (row, k, sym, at, len, next, by row and k) within the runs of successive k. ahead: of AHEAD phrases from each on
    in its run the names, shortened to 31 bits (-1 behind the run's end), the bytes, and those of the phrase after, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_rows(batches):
            row, k, sym, at, len_, next_ = (t.column(c).to_numpy() for c in ("row", "k", "sym", "at", "len", "next"))
            n = len(row)
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1)))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            name = as_long(mix(mix(row[first].astype(np.uint64)) + k[first].astype(np.uint64))).to_numpy()
            i = np.arange(n) - first[of]
            end = np.append(first[1:], n)[of]
            parts_ = np.stack([sym % 2147483647, np.minimum(len_, size), np.minimum(next_, size)]).astype("<i4")
            for lo in range(0, n, 1 << 14):
                hi = min(lo + (1 << 14), n)
                place = np.arange(lo, hi)[:, None] + np.arange(AHEAD)
                ahead = parts_[:, np.minimum(place, n - 1)]
                ahead[:, place >= end[lo:hi, None]] = [[-1], [0], [0]]
                ahead = np.ascontiguousarray(ahead.transpose(1, 0, 2))
                ahead = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((np.arange(hi - lo + 1) * 12 * AHEAD).astype(np.int32)), pa.py_buffer(ahead)])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[lo:hi]) for x in (name[of], i, sym, row, at)), ahead], ["run", "i", "sym", "row", "at", "ahead"])

    return run


def beside(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, reach (as in reaches) of the rows that are their stretch's own (w, own, row, at, ahead, by w and rank): the bytes of
    the phrases ahead that equal those of the row before or behind, and those that the next phrase can add."""

    def common(one: np.ndarray, other: np.ndarray, near: np.ndarray) -> np.ndarray:
        same = np.logical_and.accumulate((one[:, 0] == other[:, 0]) & (one[:, 0] >= 0) & near[:, None], axis=1)
        k = same.sum(axis=1)
        more = np.where(k > 0, one[np.arange(len(one)), 2, np.maximum(k - 1, 0)], one[:, 1, 0])
        return np.where(k == AHEAD, size, np.minimum(size, (one[:, 1] * same).sum(axis=1) + more + GRAM))

    def judged(held: list[pa.RecordBatch], done: int, final: bool) -> pa.RecordBatch:
        """All rows of held but the first done and, unless final, the last."""
        t = pa.Table.from_batches(held)
        w, own, row, at = (t.column(c).to_numpy() for c in ("w", "own", "row", "at"))
        ahead = bytes_of(t.column("ahead"))[0].view("<i4").reshape(-1, 3, AHEAD)
        near = w[1:] == w[:-1]
        reach = np.minimum(size, ahead[:, 1, 0].astype(np.int64) + GRAM)
        reach[1:] = np.maximum(reach[1:], common(ahead[1:], ahead[:-1], near))
        reach[:-1] = np.maximum(reach[:-1], common(ahead[:-1], ahead[1:], near))
        use = own.copy()
        use[:done] = False
        use[len(use) - (not final) :] = False
        return pa.RecordBatch.from_arrays([pa.array(row[use]), pa.array((at[use] << 32) + reach[use])], ["row", "reach"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [], 0  # the last row waits for the next one; the one before it is held as its neighbour
        for b in batches:
            if b.num_rows:
                held.append(b)
                yield judged(held, done, False)
                t = pa.Table.from_batches(held)
                done = min(t.num_rows - 1, 1)
                held = t.slice(t.num_rows - 1 - done).combine_chunks().to_batches()
        if held:
            yield judged(held, done, True)

    return run


def reaches(phrased: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """row, reach: of each text, anchors whose phrase occurs elsewhere: position << 32 | the most bytes that the text from there on
    can have in common with any other place. A scratch table; phrased, of scratch too, is dropped."""
    each = phrased.select("row", F.posexplode(F.arrays_zip("syms", "lens", "next", "at")).alias("k", "p")).select("row", "k", F.col("p.syms").alias("sym"), "p.at", F.least("p.lens", F.lit(size)).alias("len"), "p.next").where("sym >= 0")
    again = phrased.select(F.explode("syms").alias("sym")).where("sym >= 0").groupBy("sym").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sym")
    some = scratch.put(each.join(again.hint("shuffle_hash"), "sym"), "repeated")
    scratch.drop(phrased)
    run = some.repartition("row").sortWithinPartitions("row", "k").mapInArrow(in_runs(size), "run long, i long, sym long, row long, at long, ahead binary")
    run = scratch.put(run, "runs")
    scratch.drop(some)
    ranks = suffix_ranks(run.select("run", "i", "sym"), scratch)
    placed = run.join(ranks.hint("merge"), ["run", "i"]).select("rank", "row", "at", "ahead")
    # neighbours in the order, in stretches that overlap by one
    stretch = 20_000
    spread = placed.select("*", F.explode(F.when(F.col("rank") % stretch == 0, F.array(F.expr(f"rank div {stretch}"), F.expr(f"rank div {stretch} - 1"))).when(F.col("rank") % stretch == stretch - 1, F.array(F.expr(f"rank div {stretch}"), F.expr(f"rank div {stretch} + 1"))).otherwise(F.array(F.expr(f"rank div {stretch}")))).alias("w"))
    near = spread.repartition("w").sortWithinPartitions("w", "rank")
    reach = near.select("w", F.expr(f"w = rank div {stretch}").alias("own"), "row", "at", "ahead").mapInArrow(beside(size), "row long, reach long")
    out = scratch.put(reach.groupBy("row").agg(F.collect_list("reach").alias("reach")), "reach")
    scratch.drop(run, ranks)
    return out


def without_anchor(h: Hashes, starts: np.ndarray, gaps: np.ndarray, size: int) -> list[tuple[np.ndarray, ...]]:
    """Segments (text, first, windows, lead, key) of the windows that start in gaps (rows text, first, last), none of which has an anchor:
    by the first denser anchor in the window; a window without even that is a segment of its own."""
    gaps = gaps[:, np.argsort(gaps[1], kind="stable")]
    at, _, _ = anchors(h, starts, DENSE)
    # each gap's windows are cut behind every dense anchor in the gap; the next dense anchor leads those before it
    inner = at[(np.searchsorted(gaps[1], at, side="right") > 0)]
    owner = np.searchsorted(gaps[1], inner, side="right") - 1
    inside = inner < gaps[2][owner]
    t = np.concatenate([gaps[0], gaps[0][owner[inside]]])
    lo = np.concatenate([gaps[1], inner[inside] + 1])
    order = np.argsort(lo, kind="stable")
    t, lo = t[order], lo[order]
    last = gaps[2][np.searchsorted(gaps[1], lo, side="right") - 1]
    lead_at = np.searchsorted(at, lo)
    first = np.append(at, 1 << 60)[lead_at]
    hi = np.minimum(first, last)
    led = first + GRAM <= lo + size  # the dense anchor is in the first window; later ones hold it as well
    out = [(t[led], lo[led], hi[led] - lo[led] + 1, first[led] - lo[led], mix(h.of(first[led], first[led] + GRAM)))]
    far = ~led
    if far.any():
        # those before it comes into reach stand alone, the others follow it
        reach = np.minimum(first[far] + GRAM - size, hi[far] + 1)
        n = np.maximum(reach - lo[far], 0)
        i = np.repeat(lo[far] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((np.repeat(t[far], n), i, np.ones(len(i), np.int64), np.full(len(i), -1), h.of(i, i + size)))
        some = reach <= hi[far]
        a, z, f = reach[some], hi[far][some], first[far][some]
        out.append((t[far][some], a, z - a + 1, f - a, mix(h.of(f, f + GRAM))))
    return out


def met(start: np.ndarray, n: np.ndarray, content: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments that don't overlap: one index for each content, and the windows of those whose content others have too, as runs (start, n)."""
    order = np.lexsort((check, content))
    same = (content[order[1:]] == content[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    again = np.zeros(len(order), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    at = at[np.argsort(start[at], kind="stable")]
    ends = start[at] + n[at]
    first = np.flatnonzero(np.append(True, start[at][1:] != ends[:-1])[: len(at)])
    return order[np.append(True, ~same)[: len(order)]], start[at][first], ends[np.append(first[1:] - 1, len(at) - 1)[: len(first)]] - start[at][first]


def open_segments(texts: DataFrame, size: int) -> DataFrame:
    """row, start, n, lead, key, content, check: stretches of n window starts from start on that the reaches leave open. All but those
    with lead -1 have the same first anchor, lead bytes after start, whose string's hash is key; content and check are two hashes of all
    the bytes of the stretch's windows. Windows with no anchor go by a denser kind of anchor, and without that each alone.
    Stretches of equal contents that meet in a block of texts are repeats already: one of them stands for all, and all their windows
    follow as rows with lead KNOWN, whose hashes are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            data, starts = joined_bytes(b.column("text"))
            h, other = Hashes(data), Hashes(data, OTHER_BASE)
            at, of, length = anchors(h, starts)
            reach = np.minimum(length + GRAM, size)
            known = b.column("reach")
            counts = np.array([0 if x is None else x for x in pc.list_value_length(known).to_pylist()], np.int64)
            packed = known.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if counts.sum() else np.zeros(0, np.int64)
            if len(packed):
                place = np.searchsorted(at, (packed >> 32) + starts[np.repeat(np.arange(b.num_rows), counts)])
                np.maximum.at(reach, place, packed & 0xFFFFFFFF)
            first = np.ones(len(at), bool)
            first[1:] = of[1:] != of[:-1]
            previous = np.where(first, starts[of] - 1, np.insert(at[:-1], 0, 0)[: len(at)])
            final = starts[of + 1] - size
            lo = np.maximum(previous + 1, at - (size - GRAM))
            hi = np.minimum(np.minimum(at, at - (size - reach)), final)
            use = hi >= lo
            parts_ = [(of[use], lo[use], hi[use] - lo[use] + 1, at[use] - lo[use], h.of(at[use], at[use] + GRAM))]
            # windows without an anchor: long before an anchor, or behind a text's last one
            behind = starts[:-1] - 1
            np.maximum.at(behind, of, at)
            gaps = np.concatenate([np.stack([of, previous + 1, np.minimum(at - (size - GRAM) - 1, final)]), np.stack([np.arange(b.num_rows), behind + 1, starts[1:] - size])], axis=1)
            gaps = gaps[:, gaps[2] >= gaps[1]]
            if gaps.shape[1]:
                parts_ += without_anchor(h, starts, gaps, size)
            t, start, n, lead, key = (np.concatenate(x) for x in zip(*parts_))
            row = b.column("row").to_numpy()
            content, check = (mix(x.of(start, start + n - 1 + size) ^ (lead.astype(np.uint64) * np.uint64(BASE))) for x in (h, other))
            one, known, many = met(start, n, content, check)
            of_known = np.searchsorted(starts, known, side="right") - 1
            none = np.zeros(len(known), np.uint64)
            columns = [(row[t[one]], row[of_known]), ((start - starts[t])[one], known - starts[of_known]), (n[one], many), (lead[one], np.full(len(known), KNOWN))]
            columns = [pa.array(np.concatenate(x)) for x in columns] + [as_long(np.concatenate([x[one], none])) for x in (key, content, check)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "start", "n", "lead", "key", "content", "check"])

    return texts.select("row", "text", "reach").mapInArrow(run, "row long, start long, n long, lead long, key long, content long, check long")


def window_hashes(texts: DataFrame, size: int) -> DataFrame:
    """key, sub, content, check, hashes, places: of the segments listed with each text (arrays start, n, ..., split), every
    window's two hashes. A segment with split above 1 has a row for each sub, a part of the hashes, that its windows fall in, with
    their places; otherwise places is empty and stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            data, starts = joined_bytes(b.column("text"))
            h, other = Hashes(data), Hashes(data, OTHER_BASE)
            listed = b.column("segments")
            t = np.repeat(np.arange(b.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64))
            segments = listed.flatten()
            start, n, split = (segments.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "split"))
            if not len(n):
                continue
            ends = np.cumsum(n)
            seg = np.repeat(np.arange(len(n)), n)
            place = np.arange(ends[-1]) - (ends - n)[seg]
            i = (starts[t] + start)[seg] + place
            hashes = np.stack([h.of(i, i + size), other.of(i, i + size)], axis=1)
            sub = (mix(hashes[:, 0]) % split.astype(np.uint64)[seg]).astype(np.int64)
            if (split > 1).any():
                order = np.lexsort((place, sub, seg))
                seg, sub, place, hashes = seg[order], sub[order], place[order], hashes[order]
            first = np.flatnonzero(np.insert((seg[1:] != seg[:-1]) | (sub[1:] != sub[:-1]), 0, True))
            edges = np.append(first, len(seg))
            hot = split[seg] > 1
            kept = np.insert(np.cumsum(hot), 0, 0)[edges]
            binary = lambda at, x: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            of = segments.take(pa.array(seg[first]))
            yield pa.RecordBatch.from_arrays([of.field("key"), pa.array(sub[first]), of.field("content"), of.field("check"), binary(16 * edges, hashes.astype("<u8")), binary(4 * kept, place[hot].astype("<u4"))], ["key", "sub", "content", "check", "hashes", "places"])

    return texts.select("text", "segments").mapInArrow(run, "key long, sub long, content long, check long, hashes binary, places binary")


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and each row's size."""
    sizes = pc.binary_length(column).to_numpy().astype(np.int64)
    return np.concatenate([np.zeros(0, "u1"), *(joined_bytes(x)[0] for x in column.cast(pa.large_binary()).chunks)]), sizes


def shared_windows(table: pa.Table) -> pa.Table:
    """Of segments with different contents: those with windows that another one has too, and which (a bit each)."""
    raw, n = bytes_of(table.column("hashes"))
    n = n // 16
    h = raw.view("<u8").reshape(-1, 2)
    seg = np.repeat(np.arange(len(n)), n)
    at = np.cumsum(n) - n
    place = np.arange(len(seg)) - at[seg]
    own, listed = bytes_of(table.column("places"))
    place[(listed > 0)[seg]] = own.view("<u4")
    order = np.lexsort((h[:, 1], h[:, 0]))
    same = (h[order[1:]] == h[order[:-1]]).all(axis=1)
    hit = np.zeros(len(h), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    some = np.flatnonzero(np.bincount(seg[hit], minlength=len(n)))
    bits = []
    for i in some:
        mine = np.zeros(place[at[i] + n[i] - 1] + 1, bool)
        mine[place[at[i] : at[i] + n[i]]] = hit[at[i] : at[i] + n[i]]
        bits.append(np.packbits(mine).tobytes())
    return pa.table({**{c: table.column(c).take(pa.array(some)) for c in ("key", "content", "check")}, "bits": pa.array(bits, pa.binary())})


def repeated_spans(rows: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """row, windows: for texts of rows (from by_row) with a string of size bytes that starts elsewhere too, the starts of such
    strings as runs: start << 32 | how many."""
    long_ = rows.where(F.col("n_bytes") >= size)
    copies = scratch.put(long_.select("row", "n_bytes", "md5"), "copies")
    classes = copies.groupBy("md5").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first")).where("c > 1")
    copied = scratch.put(copies.join(classes.hint("merge"), "md5").select("row", "first", F.array(F.col("n_bytes") - size + 1).alias("windows")), "copied")
    scratch.drop(copies)
    single = with_rows(long_, copied.where("row != first").select("row"), "left_anti").select("row", "text")  # one text of each class
    phrased = scratch.put(phrases(single), "phrases")
    reach = reaches(phrased, size, scratch)
    found = scratch.put(open_segments(with_rows(single, reach, "left"), size), "segments")
    scratch.drop(reach)
    segments, known = found.where(F.col("lead") != KNOWN), found.where(F.col("lead") == KNOWN)
    content = ["key", "content", "check"]
    # row and start are those of one segment, the first that comes; equal contents have equal n and lead
    contents = scratch.put(segments.groupBy(content).agg(F.count(F.lit(1)).alias("c"), F.first("row").alias("row"), F.first("start").alias("start"), F.min("n").alias("n"), F.min("lead").alias("lead")), "contents")
    # only anchors with several different contents can hold windows in common beyond equal contents
    mixed = contents.where("lead >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where("k > 1").select("key", F.ceil(F.col("n") / HOT_WINDOWS).alias("split"), "n")
    mixed = scratch.put(mixed, "mixed")
    ask = contents.where("lead >= 0").join(mixed.drop("n").hint("merge"), "key")
    listed = ask.groupBy("row").agg(F.collect_list(F.struct("start", "n", *content, "split")).alias("segments"))
    windows = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(parts(rows.sparkSession), -(-windows // 2_000_000))
    asked = window_hashes(with_rows(single, listed, "inner"), size)
    types = "key long, content long, check long, bits binary"
    part = asked.groupBy(F.pmod(F.xxhash64("key", "sub"), F.lit(buckets)).alias("b")).applyInArrow(shared_windows, types)
    part = scratch.put(part.groupBy(content).agg(F.collect_list("bits").alias("bits")), "shared")
    whole = contents.where("c > 1").select(*content, F.lit(True).alias("all"))
    judged = whole.join(part.hint("merge"), content, "full")
    marked = segments.join(judged.hint("shuffle_hash"), content).select("row", "start", "n", "all", "bits")
    marked = marked.union(known.select("row", "start", "n", F.lit(True), F.lit(None)))

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start = [], []
            for r, s, n, all_, bits in zip(*(b.column(i).to_pylist() for i in range(5))):
                if all_:
                    row.append(r)
                    start.append(s << 32 | n)
                    continue
                hit = np.zeros(n + 8, np.int8)
                for x in bits:
                    one = np.unpackbits(np.frombuffer(x, "u1"))
                    hit[: len(one)] |= one.astype(np.int8)
                edge = np.diff(hit[:n], prepend=0, append=0)
                for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    row.append(r)
                    start.append((s + lo) << 32 | hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int64())], ["row", "w"])

    runs = marked.mapInArrow(to_runs, "row long, w long").groupBy("row").agg(F.collect_list("w").alias("windows"))
    return scratch.put(runs.join(copied.select("row").hint("merge"), "row", "left_anti").union(copied.select("row", "windows")), "spans")


def cut_repeats(docs: DataFrame, size: int, scratch: Scratch, as_text: bool = False) -> DataFrame:
    """docs with columns kept (the text's bytes without repeated strings, null for a null text), n_bytes, n_removed, n_spans in place of
    text and its own of these names. as_text: kept is text; of a character that was cut in two nothing stays. Reads scratch tables texts and spans."""
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    docs = docs.drop(*new)
    names, text_at = docs.columns, docs.columns.index("text")
    rows = by_row(docs, scratch)
    joined = with_rows(rows, repeated_spans(rows, size, scratch), "left")
    others = [k for k in range(len(names)) if k != text_at]
    fields = [*(docs.schema.fields[k] for k in others), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in new[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            texts, windows = b.column(text_at), b.column(len(names))
            data, starts = joined_bytes(texts)
            w = windows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            gone, cut = np.zeros(len(data), bool), np.zeros(b.num_rows, bool)
            if len(w):
                count = pc.list_value_length(windows).fill_null(0).to_numpy().astype(np.int64)
                cut = count > 0
                lo = np.repeat(starts[:-1], count) + (w >> 32)
                edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(lo + (w & 0xFFFFFFFF) + size - 1, minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
            removed = np.diff(np.append(0, np.cumsum(gone))[starts])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = starts[:-1][starts[:-1] < starts[1:]]
            begins[inner] = gone[inner]  # a text's first byte begins a run of its own
            spans = np.diff(np.append(0, np.cumsum(begins))[starts])
            kept = texts if as_text else texts.cast(pa.binary())
            if cut.any():
                left = (data[lo:hi][~gone[lo:hi]].tobytes() for lo, hi in zip(starts[:-1][cut].tolist(), starts[1:][cut].tolist()))
                kept = pc.replace_with_mask(kept, pa.array(cut), pa.array([x.decode("utf-8", "ignore") if as_text else x for x in left], kept.type))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in others), kept, *(pa.array(x) for x in (np.diff(starts), removed, spans))], [*(names[k] for k in others), *new])

    own = (F.col("text") if k == text_at else F.col(f"c{k}").alias(n) for k, n in enumerate(names))
    return joined.select(*own, F.col("windows")).mapInArrow(run, T.StructType(fields))


def remove_repeats(docs: DataFrame, size: int = 400) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after every byte covered by a string of
    size bytes that starts anywhere else too, in this text or another, is removed.

    Texts are cut into phrases at anchors, places that their own next bytes choose, so equal strings are cut alike. Phrases that
    occur once can't be repeated; the others' suffixes are ordered by the difference-cover algorithm, and the phrases that a suffix
    shares with its neighbours in that order bound how far its text is repeated. Windows that this leaves open are compared by two 64-bit
    hashes of different bases (128 bits in all), grouped by their first anchor and, if many have the same, by parts of their hashes; equal
    stretches of them once, by two such hashes too. Equal texts (by MD5) are settled beforehand and enter once. A null text is empty; texts shorter than size stay as they are; of repeated rows each goes if long enough."""
    scratch = Scratch(docs.sparkSession, "repeats")
    out = cut_repeats(docs.select("doc_id", "text"), size, scratch)
    scratch.clear(keep=("texts", "spans"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))
