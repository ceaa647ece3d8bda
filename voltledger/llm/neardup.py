"""MinHash near-duplicates: ProbMinHash signatures of word shingles of equal weight, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Scratch, as_long, blocks, joined_bytes, mix, powers, words
from .graph import components

#: Ids that a broadcast may hold (8 bytes each); with more, the join shuffles.
BROADCAST_IDS = 1_000_000


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of size words as 64-bit hashes, each with its text and how often it occurs there, in order of
    text and hash. A text of fewer words has one shingle of all its words; one without words has none."""
    h, of, _, _ = words(*joined_bytes(texts))
    if not len(h):
        return h, of, of
    n = np.bincount(of, minlength=len(texts))
    used = np.minimum(n, size)[of]
    place = np.arange(len(h)) - (np.cumsum(n) - n)[of]
    starts = np.flatnonzero(place <= n[of] - used)
    out = np.zeros(len(starts), np.uint64)
    p = powers(BASE, size + 1)
    for i in range(size):
        more = i < used[starts]
        out[more] += h[starts[more] + i] * p[i]
    out = mix(out + used[starts].astype(np.uint64))
    of = of[starts]
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return out[first], of[first], np.diff([*first, len(out)])


def signatures(elements: np.ndarray, of: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: per text (of: 0 to n - 1) and register, the element that arrives there first.

    An element's arrivals form a Poisson process of its weight's rate, each at a register drawn evenly; all draws depend
    on the element alone. Two texts agree in a register with the probability Jaccard similarity of their weighted sets.
    In each round every element has its next arrival; one that comes later than all registers' first arrivals of its text
    ends the element, since its further ones come later still."""
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    at, e, w, t = np.zeros(len(elements)), elements, weights.astype(float), of
    turn = 0
    while len(e):
        turn += 1
        r = mix(e + np.uint64((turn * BASE) % 2**64))
        at = at - np.log1p(-((r >> np.uint64(11)).astype(float) / 2.0**53)) / w
        alive = at < latest[t]
        if not alive.all():
            e, w, t, at, r = e[alive], w[alive], t[alive], at[alive], r[alive]
        where = t * registers + (mix(r ^ np.uint64(BASE)) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(at < first[where])
        better = better[np.argsort(-at[better], kind="stable")]  # of several at a register, the earliest is written last
        if len(better):
            first[where[better]] = at[better]
            winner[where[better]] = e[better]
            changed = np.flatnonzero(np.bincount(t[better], minlength=n))
            latest[changed] = first.reshape(n, registers)[changed].max(axis=1)
    return winner.reshape(n, registers)


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, copy (MD5 of the text), keys (one number per band that stands for the band and its registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            e, of, _ = shingles(b.column("text"), size)
            sig = signatures(e, of, np.ones(len(e)), b.num_rows, bands * rows).reshape(b.num_rows, bands, rows)
            key = np.zeros((b.num_rows, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for i in range(rows):
                key = mix(key * np.uint64(BASE) + sig[:, :, i])
            some = np.bincount(of, minlength=b.num_rows) > 0
            flat = pa.array(key[some].reshape(-1).view(np.int64))
            ends = np.cumsum(np.where(some, bands, 0))
            keys = pa.ListArray.from_arrays(pa.array(np.array([0, *ends], np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), keys], ["doc_id", "copy", "keys"])

    return docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("copy"), "text").mapInArrow(run, "doc_id long, copy binary, keys array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, shingles: the distinct shingle hashes in order, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            e, of, _ = shingles(b.column("text"), size)
            cut = np.searchsorted(of, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([e[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets as numbers in order."""
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard similarity least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x"), b.column("y")
            keep = pa.array([jaccard(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) >= least for i in range(b.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    side = lambda c, s: sets.select(F.col("id").alias(c), F.col("shingles").alias(s))
    return pairs.join(side("b", "y").hint("merge"), "b").join(side("a", "x").hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def met_in_blocks(rest: DataFrame, reps: DataFrame, sets: DataFrame, least: float, block: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members of different groups under each key of rest (key, id, group): the members of a key are dealt to
    blocks of about block by a hash of the id, and each two blocks of a key meet in a task. A pair with several keys in common is compared
    under the first one. A pair that links found there connect already isn't compared, so the links give the same components as all pairs."""
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = rest.join(sizes.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    held = dealt.join(sets.join(reps.select("id", "keys").hint("merge"), "id").hint("merge"), "id")

    def pack(t: pa.Table) -> pa.Table:
        shingles_ = t.column("shingles").to_pylist()
        columns = [t.column("id").to_numpy(), t.column("group").to_numpy(), np.array([len(x) for x in shingles_], np.int64), t.column("keys").combine_chunks().flatten().to_numpy()]
        return pa.table({"key": t.column("key")[:1], "block": t.column("block")[:1], "blocks": t.column("blocks")[:1], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(BLOCK, columns)}, "data": pa.array([b"".join(shingles_)], pa.binary())})

    packed = scratch.put(held.select("key", "block", "blocks", "id", "group", "shingles", "keys").groupBy("key", "block").applyInArrow(pack, "key long, block long, blocks long, " + ", ".join(f"{c} binary" for c in [*BLOCK, "data"])), "blocks")
    side = lambda s: packed.select("key", *(F.col(c).alias(f"{c}_{s}") for c in packed.columns[1:]))
    # dealt by key and block, so that a key's pairs of blocks spread over the tasks
    met = side("a").withColumn("block_b", F.explode(F.sequence("block_a", F.col("blocks_a") - 1))).join(side("b").hint("merge"), ["key", "block_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                a, b = ({c: np.frombuffer(r[f"{c}_{s}"], np.int64) for c in BLOCK} for s in "ab")
                ids, n = (a["ids"], b["ids"]), (a["sizes"], b["sizes"])
                cut = [np.cumsum(np.insert(x, 0, 0)).tolist() for x in n]
                data = [np.frombuffer(r[f"data_{s}"], np.uint64) for s in "ab"]
                keys = [x["keys"].reshape(len(x["ids"]), -1) for x in (a, b)]
                # the smaller set can't share more than itself
                open_ = (a["groups"][:, None] != b["groups"]) & (np.minimum(n[0][:, None], n[1]) >= least * np.maximum(n[0][:, None], n[1]))
                for band in range(int(np.flatnonzero(keys[0][0] == r["key"])[0])):
                    open_ &= keys[0][:, band, None] != keys[1][:, band]
                if r["block_a"] == r["block_b"]:
                    open_ &= ids[0][:, None] < ids[1]
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                found = []
                for i, j in zip(*(x.tolist() for x in np.nonzero(open_))):
                    g, h = find(int(a["groups"][i])), find(int(b["groups"][j]))
                    if g != h and jaccard(data[0][cut[0][i] // 8 : cut[0][i + 1] // 8], data[1][cut[1][j] // 8 : cut[1][j + 1] // 8]) >= least:
                        root[g] = h
                        found.append((int(ids[0][i]), int(ids[1][j])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return scratch.put(met.mapInArrow(run, "a long, b long"), "links")


BLOCK = ["ids", "groups", "sizes", "keys"]


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, bands: int = 32, rows: int = 6, chunk: int = 250, rounds: int = 4, pairs_a_text: int = 20, block: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of the same text), group_id (smallest doc_id reachable
    by links between texts of similarity least or more), kept (doc_id is group_id).

    Signatures weigh all distinct shingles alike, so they estimate what is checked: the Jaccard similarity of the sets of
    shingles, computed exactly for each candidate pair. Equal texts are one class, compared once. Candidates share one of bands
    keys of rows registers each (at similarity 0.8 all bands miss with probability 6e-5). A bucket's members are first
    compared with that of the most copies, often the text that the others were made from; after that only with members of other groups:
    with one of each chunk of about chunk members while more than pairs_a_text pairs a text are open and each turn settles a tenth of
    them, for at most rounds turns; then with all that are left, as pairs if they are so few and otherwise in blocks of members.

    Null and wordless texts are linked to equal texts only. Rows without a doc_id get nulls and kept true. Rows of one
    doc_id but different texts are linked through it. An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = scratch.put(sketch(docs, size, bands, rows), "sketch")
    reps = scratch.put(sketched.where("doc_id is not null").groupBy("copy").agg(F.min(F.struct("doc_id", "keys")).alias("r"), F.count(F.lit(1)).alias("copies")).select("copy", F.col("r.doc_id").alias("id"), F.col("r.keys").alias("keys"), "copies"), "classes")
    keyed = reps.select("id", "copies", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct(-F.col("copies"), "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.id").alias("hub"))
    members = scratch.put(keyed.select("key", "id").join(hubs.hint("merge"), "key"), "members")
    ids = members.select("id").distinct()
    n_ids = ids.count()
    texts = docs.withColumnRenamed("doc_id", "id").join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids.hint("merge"), "id", "left_semi")
    sets = scratch.put(shingle_sets(texts, size), "sets")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = scratch.put(ordered(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))), "pairs")
    links = scratch.put(verified(tried, sets, least), "links")
    before = float("inf")
    for turn in range(rounds + 1):
        groups = components(links, scratch)
        held = members.select("key", "id").join(groups.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("group"))
        mixed = held.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("open")).where("groups > 1")
        rest = scratch.put(held.join(mixed.hint("merge"), "key"), "open")
        # a key's open pairs, dealt evenly to its members, add up over them
        count = rest.agg(F.sum(F.col("open") / F.col("n"))).first()[0]
        if not count:
            break
        few = count <= pairs_a_text * n_ids
        if few:
            other = rest.select("key", F.col("id").alias("a"), F.col("group").alias("g"))
            found = other.join(rest.select("key", F.col("id").alias("b"), F.col("group").alias("h")).hint("merge"), "key").where("g < h")
        elif turn == rounds or count > 0.9 * before:
            groups = components(links.union(met_in_blocks(rest.select("key", "id", "group"), reps, sets, least, block, scratch)), scratch)
            break
        else:
            rest = rest.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("n") / chunk)))
            one = rest.groupBy("key", "chunk").agg(F.min(F.struct(F.xxhash64("id", F.lit(-turn - 1)).alias("h"), F.col("id").alias("a"), F.col("group").alias("g"))).alias("one")).select("key", "chunk", "one.a", "one.g")
            found = rest.withColumnRenamed("id", "b").join(one.hint("merge"), ["key", "chunk"]).where("g != group")
        new = scratch.put(ordered(found.select("a", "b")).join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        more = scratch.put(verified(new, sets, least), "links")
        if few:
            groups = groups if more.isEmpty() else components(links.union(more), scratch)
            break
        tried, links, before = tried.union(new), links.union(more), count
    groups = groups.select(F.col("node").alias("id"), "component")
    named = scratch.put(reps.select("copy", "id").join(groups.hint("merge"), "id", "left").select("copy", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("group_id")), "result")
    rows_of = scratch.put(sketched.select("doc_id", "copy"), "result")
    scratch.clear(keep=("result",))
    out = rows_of.join(named.hint("merge"), "copy", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("group_id")).alias("group_id"), F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("kept"))
