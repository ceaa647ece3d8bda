"""Embedding near-duplicates: a cover tree, a dual traversal of its nodes, and exact comparison of slabs of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components, forest

#: Bytes of vectors in a slab, which travels as one row: so many at least, if there are more so that SLABS of them suffice, but so many at most, as blocks too.
SLAB_BYTES, SLABS, MOST_BYTES, MOST_BLOCKS = 1 << 22, 16, 1 << 24, 32
#: A slab is covered by balls, so many at once, while they take in so many vectors each on average.
PIVOTS, BALL = 64, 8
#: Bytes of vectors at length 1 that a task keeps of slabs that come again with the next one on the left.
HELD_BYTES = 1 << 26


class CoverTree:
    """Nested levels of centres: radius 2 at the root, half of it at each further level. A centre of one level is one of
    all later levels; the centres of a level are over its radius apart. Fitted on a sample; the covering radii are then
    measured on all vectors, so what the bounds prune is exact whatever the sample."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.levels: list[np.ndarray] = []  # of each level, the centres' rows
        chosen = [0] if len(sample) else []
        radius = 2.0
        self.levels.append(np.array(chosen))
        while len(chosen) < min(leaves, len(sample)) and radius > 1e-3:
            radius /= 2
            near = (sample @ sample[chosen].T).max(axis=1)  # cosine with the nearest centre
            for i in range(len(sample)):
                if len(chosen) >= leaves:
                    break
                if 2 - 2 * near[i] > radius * radius:
                    chosen.append(i)
                    near = np.maximum(near, sample @ sample[i])
            if len(chosen) > len(self.levels[-1]):
                self.levels.append(np.array(chosen))
        self.centres = sample[chosen]
        order = {c: k for k, c in enumerate(chosen)}
        self.levels = [np.array([order[c] for c in level.tolist()]) for level in self.levels]
        self.parents = []  # of each level's centres, the nearest centre one level up
        for up, level in zip(self.levels, self.levels[1:]):
            self.parents.append(up[(self.centres[level] @ self.centres[up].T).argmax(axis=1)])

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Per vector the nearest centre of the last level."""
        return (unit @ self.centres.T).argmax(axis=1)

    def above(self) -> np.ndarray:
        """Per leaf its node at each level, from the root on."""
        at = np.arange(len(self.centres))
        out = [at]
        for level, parent in zip(self.levels[:0:-1], self.parents[::-1]):
            place = np.zeros(len(self.centres), np.int64)
            place[level] = np.arange(len(level))
            at = parent[place[at]]
            out.append(at)
        return np.stack(out[::-1], axis=1)

    def paths(self, unit: np.ndarray) -> np.ndarray:
        """Per vector its node at each level: the nearest centre of the last one, and that one's parents."""
        return self.above()[self.leaves(unit)]

    def near_leaves(self, radii: list[np.ndarray], reach: float) -> list[tuple[int, int]]:
        """Pairs of leaves that may hold vectors within reach: from the root pair down, a pair of nodes is dropped when
        their centres are further apart than their covering radii and reach together."""
        pairs = np.zeros((1, 2), np.int64)
        for depth in range(len(self.levels)):
            r = radii[depth]
            a, b = pairs[:, 0], pairs[:, 1]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.centres[a], self.centres[b])))
            pairs = pairs[(r[a] >= 0) & (r[b] >= 0) & (apart - r[a] - r[b] <= reach + 1e-9)]
            if depth + 1 == len(self.levels):
                return [(int(x), int(y)) for x, y in pairs]
            children: dict[int, list[int]] = {}
            for child, parent in zip(self.levels[depth + 1].tolist(), self.parents[depth].tolist()):
                children.setdefault(parent, []).append(child)
            down = {(min(x, y), max(x, y)) for a, b in pairs.tolist() for x in children.get(a, ()) for y in children.get(b, ())}
            pairs = np.array(sorted(down), np.int64).reshape(-1, 2)
        return []


def raw(embeddings: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Rows of numbers as they are stored; there is one zero."""
    return embeddings.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) + np.dtype(kind).type(0)


def normed(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, as the squares of very large or small ones leave the range of doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def merged(key: np.ndarray, ids: np.ndarray, ns: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal x as one, with the smallest id and the sum of ns. The key is a hash of x; if those of two vectors are equal, copies
    may stay apart, which only costs time."""
    order = np.argsort(key, kind="stable")
    key, ids, ns, x = key[order], ids[order], ns[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]).any(axis=1)]))
    return key[first], np.minimum.reduceat(ids, first), np.add.reduceat(ns, first), x[first]


def balls(u: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row of unit vectors the ball that it is in, or -1, and the balls' centres as rows. One further level of the cover tree, on
    all vectors of a slab; what lies so scattered that balls would hold next to nothing is left."""
    ball, centres, left = np.full(len(u), -1), np.zeros(0, np.int64), np.arange(len(u))
    while len(left):
        pick = left[:: -(-len(left) // min(PIVOTS, 1 + len(left) // (2 * BALL)))]
        near = u[left] @ u[pick].T
        at = near.argmax(axis=1)
        inside = near[np.arange(len(left)), at] >= 1 - radius * radius / 2
        if inside.sum() < BALL * len(pick):
            break
        ball[left[inside]] = len(centres) + at[inside]
        centres, left = np.concatenate([centres, pick]), left[~inside]
    return ball, centres


def bits(sets: np.ndarray) -> list[int]:
    """A set of leaves (booleans) as 64-bit numbers."""
    return np.packbits(np.pad(sets, (0, -len(sets) % 64))).view(np.int64).tolist()


class Slab:
    """Vectors by segment: those of one ball, or the rest of a leaf, none further than its radius from its centre."""

    def __init__(self, row: dict[str, pa.Scalar], dim: int, kind: str, unit: np.ndarray | None = None):
        get = lambda c, k: np.frombuffer(row[c].as_buffer(), k)
        self.ids, self.ns, self.x = get("ids", np.int64), get("ns", np.int64), get("data", kind).reshape(-1, dim)
        self.sizes, self.radii, self.centres = get("sizes", np.int64), get("radii", np.float64), get("centres", np.float32).reshape(-1, dim)
        self.ends = np.cumsum(self.sizes)
        self.unit = normed(self.x).astype(np.float32) if unit is None else unit


def matched(a: Slab, b: Slab, same: bool, least: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in a and b with cosine least or more, some at a time. Products of single precision decide those that their rounding
    can't reach; the others are computed in double precision."""
    dim = a.x.shape[1]
    slack = (dim + 4) * 2.0**-22
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    floor = lambda apart: np.where(apart < 2, 1 - apart * apart / 2 - slack, -np.inf)  # noqa: E731  # of the cosine, where no two are further apart
    meets = a.centres @ b.centres.T >= floor(a.radii[:, None] + b.radii + reach)
    least_of = floor(a.radii + reach)
    places, chunk = np.arange(len(b.ids)), max(1, (1 << 22) // dim)
    for k in np.flatnonzero(meets.any(axis=1)):
        end = int(a.ends[k])
        start = end - int(a.sizes[k])
        near = np.concatenate([places[b.ends[s] - b.sizes[s] : b.ends[s]] for s in np.flatnonzero(meets[k])])
        if same:
            near = near[near > start]
        if least_of[k] > -1:
            near = near[b.unit[near] @ a.centres[k] >= least_of[k]]
        for lo in range(start, end, block):
            own = a.unit[lo : min(lo + block, end)]
            for at in range(0, len(near), block):
                other = near[at : at + block]
                cosine = own @ b.unit[other].T
                if cosine.max() < least - slack:
                    continue
                i, j = np.divmod(np.flatnonzero(cosine.ravel() >= least - slack), len(other))
                unsure = np.flatnonzero(cosine[i, j] < least + slack)
                i, j = i + lo, other[j]
                keep = j > i if same else np.ones(len(i), bool)
                for some in np.split(unsure, range(chunk, len(unsure), chunk)):
                    keep[some] &= np.einsum("ij,ij->i", normed(a.x[i[some]]), normed(b.x[j[some]])) >= least
                yield i[keep], j[keep]


def pooled(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, about size at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for one in pairs:
        held.append(one)
        n += len(one[0])
        if n >= size:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def joined(edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join up what edges do."""
    a, b = (np.concatenate(x) for x in zip(*edges))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    to = forest(at[: len(a)], at[len(a) :], len(nodes))
    moved = np.flatnonzero(to != np.arange(len(nodes)))
    return nodes[moved], nodes[to[moved]]


def near_vectors(vectors: DataFrame, sample: np.ndarray, total: int, dim: int, least: float, scratch: Scratch, max_leaves: int, block: int, number: str) -> tuple[DataFrame, DataFrame]:
    """Of vectors (id, hash, embedding of number float or double), total of which are distinct: slabs, each with its distinct vectors, their least ids, hashes and how
    many rows share them; and rows (a, b, links): links of a with other distinct vectors counted in rows where b is null, else a and b connected by links."""
    kind = {"float": "<f4", "double": "<f8"}[number]
    tree = CoverTree(normed(sample), max(1, min(max_leaves, total // block)))
    path, reach, n_leaves = tree.above(), float(np.sqrt(max(0.0, 2 - 2 * least))), len(tree.centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            if b.num_rows:
                key, ids, ns, x = merged(b.column(1).to_numpy(), b.column(0).to_numpy(), np.ones(b.num_rows, np.int64), raw(b.column(2), dim, kind))
                u = normed(x)
                leaf = tree.leaves(u)
                yield key, ids, ns, x, u, leaf

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest, sizes = np.full(path.shape[::-1], -1.0), np.zeros(n_leaves, np.int64)
        for _, _, _, _, u, leaf in placed(batches):
            sizes += np.bincount(leaf, minlength=n_leaves)
            for d in range(len(widest)):
                np.maximum.at(widest[d], path[leaf, d], np.linalg.norm(u - tree.centres[path[leaf, d]], axis=1))
        depth, node = np.nonzero(widest >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(depth), pa.array(node), pa.array(widest[depth, node]), pa.array(np.where(depth == len(widest) - 1, sizes[node], 0))], ["depth", "node", "r", "n"])

    radii, sizes = [np.full(n_leaves, -1.0) for _ in tree.levels], np.zeros(n_leaves, np.int64)
    for r in vectors.mapInArrow(measure, "depth long, node long, r double, n long").groupBy("depth", "node").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect():  # one row a node, and the tree's size is bounded
        radii[r["depth"]][r["node"]] = r["r"] + 1e-9
        sizes[r["node"]] += r["n"]
    near = np.zeros((n_leaves, n_leaves), bool)
    for a, b in tree.near_leaves(radii, reach):
        near[a, b] = near[b, a] = True
    # a slab takes the next vectors by leaf, leaves of one parent side by side; within its leaf a vector's hash places it
    width = dim * np.dtype(kind).itemsize
    slab_rows = max(1, min(MOST_BLOCKS * block, min(max(total * width // SLABS, SLAB_BYTES), MOST_BYTES) // width))
    order = np.lexsort(path.T[::-1])
    starts = np.zeros(n_leaves, np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, ns, x, _, leaf in placed(batches):
            slab = (starts[leaf] + key % np.maximum(sizes[leaf], 1)) // slab_rows
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(slab), pa.array(ids), pa.array(key), pa.array(ns), values], ["slab", "id", "hash", "n", "embedding"])

    def gather(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key, ids, ns, x = merged(*(t.column(c).to_numpy() for c in ("hash", "id", "n")), raw(t.column("embedding").combine_chunks(), dim, kind))
        u = normed(x)
        leaf = tree.leaves(u)
        ball, pivots = balls(u.astype(np.float32), reach)
        segment = np.where(ball >= 0, ball, len(pivots) + leaf)
        held, segment = np.unique(segment, return_inverse=True)
        centres = np.concatenate([u[pivots], tree.centres])[held]
        wide = np.zeros(len(held))
        np.maximum.at(wide, segment, np.linalg.norm(u - centres[segment], axis=1))
        own = np.bincount(leaf, minlength=n_leaves) > 0
        meets = near[own].any(axis=0)
        if (np.linalg.norm(u - tree.centres[leaf], axis=1) > radii[-1][leaf]).any():  # at equal distance from two centres another was nearer when radii were measured
            meets[:] = True
        by = np.argsort(segment, kind="stable")
        out = {"ids": ids[by], "hashes": key[by], "ns": ns[by], "data": x[by], "sizes": np.bincount(segment), "radii": wide, "centres": centres.astype(np.float32)}
        return pa.table({"slab": t.column("slab")[:1], "leaves": pa.array([bits(own)], pa.list_(pa.int64())), "meets": pa.array([bits(meets)], pa.list_(pa.int64()))} | {c: [v.tobytes()] for c, v in out.items()})

    dealt = vectors.mapInArrow(deal, f"slab long, id long, hash long, n long, embedding array<{number}>")
    columns = ["ids", "hashes", "ns", "data", "sizes", "radii", "centres"]
    slabs = scratch.put(dealt.groupBy("slab").applyInArrow(gather, "slab long, leaves array<long>, meets array<long>, " + ", ".join(f"{c} binary" for c in columns)), "slabs", maxRecordsPerFile=1)
    # Each task reads some slabs and some others where they lie: a shuffle would write each slab once for every slab that it meets. Of (a, b) and (b, a) one
    # is compared, in turns, so that all tasks have alike to do.
    side = lambda s: slabs.select(*(F.col(c).alias(f"{c}_{s}") for c in slabs.columns if c != "hashes"))
    overlap = lambda x, y: F.exists(F.zip_with(x, y, lambda p, q: p.bitwiseAND(q)), lambda z: z != 0)
    turn = (F.col("slab_a") == F.col("slab_b")) | ((F.col("slab_a") < F.col("slab_b")) == ((F.col("slab_a") + F.col("slab_b")) % 2 == 0))
    met = side("a").join(side("b").hint("shuffle_replicate_nl"), turn & (overlap("meets_a", "leaves_b") | overlap("meets_b", "leaves_a")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        units: dict[int, np.ndarray] = {}
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                at = [row[f"slab_{s}"].as_py() for s in "ab"]
                if at[0] != last:
                    last, a = at[0], Slab({c[:-2]: v for c, v in row.items() if c.endswith("_a")}, dim, kind)
                same = at[0] == at[1]
                b = a if same else Slab({c[:-2]: v for c, v in row.items() if c.endswith("_b")}, dim, kind, units.get(at[1]))
                if not same and sum(u.nbytes for u in units.values()) < HELD_BYTES:
                    units[at[1]] = b.unit
                own, other = (counts.setdefault(s, (x.ids.copy(), np.zeros(len(x.ids))))[1] for s, x in zip(at, (a, b)))
                nodes = a.ids if same else np.concatenate([a.ids, b.ids])
                for i, j in pooled(matched(a, b, same, least, block)):
                    own += np.bincount(i, weights=b.ns[j], minlength=len(own))
                    other += np.bincount(j, weights=a.ns[i], minlength=len(other))
                    to = forest(i, j + (0 if same else len(a.ids)), len(nodes))
                    moved = np.flatnonzero(to != np.arange(len(nodes)))
                    edges.append((nodes[moved], nodes[to[moved]]))
                if sum(len(e[0]) for e in edges) > 1 << 21:
                    edges = [joined(edges)]
        for ids, links in counts.values():
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.nulls(len(has), pa.int64()), pa.array(links[has].astype(np.int64))], ["a", "b", "links"])
        if edges:
            a_, b_ = joined(edges)
            yield pa.RecordBatch.from_arrays([pa.array(a_), pa.array(b_), pa.array(np.zeros(len(a_), np.int64))], ["a", "b", "links"])

    return slabs, scratch.put(met.mapInArrow(compare, "a long, b long, links long"), "met")


def members(slabs: DataFrame, dim: int, number: str, whole: bool) -> DataFrame:
    """id, n, hash of the vectors in slabs, and the vectors themselves if whole."""
    kind = {"float": "<f4", "double": "<f8"}[number]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                arrays = [pa.array(np.frombuffer(b.column(c)[k].as_buffer(), np.int64)) for c in ("ids", "ns", "hashes")]
                if whole:
                    x = np.frombuffer(b.column("data")[k].as_buffer(), kind)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dim, dtype=np.int32)), pa.array(x)))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "hash", "embedding"][: len(arrays)])

    return slabs.select("ids", "ns", "hashes", *["data"] * whole).mapInArrow(unpack, "id long, n long, hash long" + f", embedding array<{number}>" * whole)


def near_duplicate_vectors(embeddings: DataFrame, least: float = 0.9, sample_size: int = 4000, max_leaves: int = 1024, block: int = 2048) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links (other rows at cosine least or more, in double precision),
    component_id (smallest vec_id reachable by links), kept (vec_id is component_id).

    Equal vectors are compared once and counted as often as they occur. Vectors that are null, empty, zero, or hold a null
    or a non-finite number have no links and are their own component; so are those without a vec_id, whose component_id and
    kept are null. Vectors of different lengths are never linked. Labels and other columns aren't read. The tree is fitted
    on sample_size vectors and has at most max_leaves leaves; leaves are compared in blocks of at most block vectors.

    Vectors are shuffled once, to their slabs, and stand on disk twice at most: in that shuffle and as slabs, which are compared where they lie."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vectors")
    # single numbers are kept as such where they are stored and moved; anything else is taken as double
    number = "float" if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = embeddings.select("vec_id", F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    # an array is known not to contain NaN only if it holds no null either; NaN is above infinity
    least_of, most_of = F.array_min("embedding"), F.array_max("embedding")
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.array_contains("embedding", F.lit(float("nan")).cast(number)) & (least_of > -float("inf")) & (most_of < float("inf")) & ((least_of != 0) | (most_of != 0))
    vectors = rows.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.xxhash64("embedding").alias("hash"), "embedding")
    hashes = scratch.put(vectors.select(F.size("embedding").alias("dim"), "hash").distinct(), "hashes")
    parts = []
    for r in hashes.groupBy("dim").count().collect():
        dim, alike = r["dim"], vectors.where(F.size("embedding") == r["dim"])
        # those of the smallest hashes, each once, in an order that doesn't depend on the partitions
        last = hashes.where(F.col("dim") == dim).orderBy("hash").limit(sample_size).agg(F.max("hash")).first()[0]
        picked = alike.where(F.col("hash") <= last).select("embedding").distinct().toArrow()
        sample = np.random.default_rng(0).permutation(np.unique(raw(picked.column(0).combine_chunks(), dim, "<f8"), axis=0))
        parts.append((dim, *near_vectors(alike, sample, r["count"], dim, least, scratch, max_leaves, block, number)))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    found = union([met for _, _, met in parts])
    # a row finds its vector by the hash, unless two vectors share one; then by the vector too
    distinct, key = scratch.put(union([members(slabs, dim, number, False) for dim, slabs, _ in parts]), "distinct"), ["hash"]
    if distinct.count() > hashes.select("hash").distinct().count():
        key = ["hash", "embedding"]
        distinct = scratch.put(union([members(slabs, dim, number, True) for dim, slabs, _ in parts]).dropDuplicates(key), "distinct")
    scratch.drop(hashes, *(slabs for _, slabs, _ in parts))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "id")
    each = distinct.join(links.hint("merge"), "id", "left").join(groups.hint("merge"), "id", "left")
    each = scratch.put(each.select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "result")
    out = rows.withColumn("hash", F.when(fine, F.xxhash64("embedding"))).select("vec_id", *key).join(each.hint("merge"), key, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    scratch.clear(keep=("result",))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out
