"""A toxicity classifier that doesn't care which group a sentence names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, Scratch, blocks, mix
from .language import _folded, fold_of

#: Words of one line name groups of one kind, in one language and form; any may stand for any other. A parameter of the functions below.
IDENTITY_TERMS = (
    "women men girls boys", "woman man girl boy", "female male", "christian muslim jewish hindu buddhist atheist catholic",
    "christians muslims jews hindus buddhists atheists catholics", "gay lesbian bisexual transgender straight queer",
    "black white asian latino hispanic arab", "african american european mexican chinese indian", "immigrants refugees foreigners natives",
    "immigrant refugee foreigner native", "deaf blind disabled", "old young elderly", "frauen männer mädchen jungen", "christen muslime juden hindus buddhisten",
    "ausländer einwanderer flüchtlinge", "femmes hommes filles garçons", "chrétiens musulmans juifs bouddhistes", "immigrés réfugiés étrangers",
    "mujeres hombres niñas niños", "cristianos musulmanes judíos budistas", "inmigrantes refugiados extranjeros",
)
#: First letters of a word, beside the whole word, that are features: they stand for stems.
STEMS = (4, 5, 6)
#: Characters of texts whose features are found at once.
PART = 1 << 18


def _parts(text: str) -> Iterator[str]:
    """text in parts of about PART characters, cut at blanks."""
    lo = 0
    while lo < len(text):
        hi = len(text) if len(text) - lo <= PART else text.find(" ", lo + PART)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi]
        lo = hi


def _words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the letters' runs among folded code points."""
    letter = np.concatenate([[False], cp != 32, [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    return edges[::2], edges[1::2]


def _hashes(cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's features, and the word of each: the word, and its first letters for each of STEMS if it is longer.
    The hash of letters from a place on is a polynomial that is summed from the text's start, so a word costs two look-ups."""
    step = np.full(len(cp) + 1, BASE, np.uint64)
    step[0] = 1
    step = np.multiply.accumulate(step)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * step[:-1], dtype=np.uint64)])
    back = np.full(len(cp) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    out, of = [], []
    for kind, size in enumerate((0, *STEMS)):
        some = np.arange(len(lo)) if not size else np.flatnonzero(hi - lo > size)
        a, b = lo[some], hi[some] if not size else lo[some] + size
        out.append(mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind > 0)))
        of.append(some)
    return np.concatenate(out), np.concatenate(of)


def features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of features (a word in lower case, its stems) and the text of each, texts being taken together in parts of
    bounded size: the first text's number, hashes, texts' numbers from there. A text may come in several parts."""
    held: list[str] = []
    of: list[int] = []
    size = 0

    def found() -> tuple[int, np.ndarray, np.ndarray]:
        cp = _folded()[np.frombuffer("".join(f"{p} " for p in held).encode("utf-32-le", "surrogatepass"), "<u4")]
        lo, hi = _words(cp)
        h, word = _hashes(cp, lo, hi)
        owner = np.array(of)[np.searchsorted(np.cumsum([len(p) + 1 for p in held]), lo, side="right")]
        return of[0], h, owner[word] - of[0]

    for i, t in enumerate(texts):
        for p in _parts(t or ""):
            held.append(p)
            of.append(i)
            size += len(p)
            if size >= PART:
                yield found()
                held, of, size = [], [], 0
    if held:
        yield found()


def hash_of(word: str) -> int:
    return int(next(features([word]))[1][0])


class Swaps:
    """Identity terms and what may stand in their place."""

    def __init__(self, groups: tuple[str, ...] = IDENTITY_TERMS):
        self.others: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for terms in (g.split() for g in groups):
            for t in terms:
                (_, own, _), n = next(features([t])), len(terms)
                self.others[hash_of(t)] = [(own, next(features([terms[(terms.index(t) + k) % n]]))[1]) for k in range(1, n)]
        self.terms = np.sort(np.array(list(self.others), np.uint64))

    def of(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For the k-th other term of each: the features that a text with those found loses and gains if all its identity
        terms are swapped for it. Features that another word of the text may share count as lost."""
        held = found[np.isin(found, self.terms)]
        turns = [self.others[int(h)] for h in held]
        for k in range(max(map(len, turns), default=0)):
            swapped = [t[k % len(t)] for t in turns]
            lost, gained = (np.unique(np.concatenate(x)) for x in zip(*swapped))
            yield np.setdiff1d(lost, gained), np.setdiff1d(gained, found)


@dataclass
class Classifier:
    """A logistic model of the features that a text has, however often."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        seen: list[np.ndarray] = []
        for first, h, of in features(texts):
            at = np.searchsorted(self.hashes, h)
            hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), bool)
            seen.append(np.unique((of[hit] + first) * (len(self.hashes) + 1) + at[hit]))
        if seen:
            key = np.unique(np.concatenate(seen))
            np.add.at(z, key // (len(self.hashes) + 1), self.weights[key % (len(self.hashes) + 1)])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(at: np.ndarray, rows: np.ndarray, label: np.ndarray, swap_at: np.ndarray, swap_sign: np.ndarray, swap_rows: np.ndarray, n_swaps: int, scale: np.ndarray, fairness: float, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise: mean log loss + decay * |v|^2 / 2 + fairness * mean square of what swaps change in
    the score, weights being v * scale. Entries (row, feature) stand for ones; a swap's entries have a sign. Accelerated
    gradient steps of a length that the largest curvature allows."""
    n = max(len(label), 1)
    v, bias = np.zeros(len(scale)), 0.0
    s_at, s_swap = scale[at], scale[swap_at] * swap_sign

    def curvature() -> float:
        """Largest eigenvalue of the quadratic bound, by power iteration."""
        x, b, top = np.ones(len(scale)), 1.0, 1.0
        for _ in range(15):
            z = np.bincount(rows, s_at * x[at], n) + b
            y, c = np.bincount(at, s_at * z[rows], len(scale)) / (4 * n) + decay * x, z.sum() / (4 * n)
            if n_swaps:
                d = np.bincount(swap_rows, s_swap * x[swap_at], n_swaps)
                y += 2 * fairness / n_swaps * np.bincount(swap_at, s_swap * d[swap_rows], len(scale))
            top = float(np.sqrt(y @ y + c * c))
            x, b = y / max(top, 1e-300), c / max(top, 1e-300)
        return top

    rate = 1 / (1.1 * curvature())
    ahead, ahead_bias = v.copy(), bias
    for k in range(steps):
        z = np.bincount(rows, s_at * ahead[at], len(label)) + ahead_bias
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / n
        grad = np.bincount(at, s_at * g[rows], len(scale)) + decay * ahead
        if n_swaps:
            d = np.bincount(swap_rows, s_swap * ahead[swap_at], n_swaps)
            grad += 2 * fairness / n_swaps * np.bincount(swap_at, s_swap * d[swap_rows], len(scale))
        new, new_bias = ahead - rate * grad, ahead_bias - rate * g.sum()
        ahead, ahead_bias = new + k / (k + 3) * (new - v), new_bias + k / (k + 3) * (new_bias - bias)
        v, bias = new, new_bias
    return v * scale, bias


def train(labelled: DataFrame, groups: tuple[str, ...] = IDENTITY_TERMS, max_rows: int = 20_000, max_features: int = 16_384, least_rows: int = 5, fairness: float = 1.0, decay: float = 1e-5, steps: int = 150) -> Classifier:
    """Learns from rows of text and toxic (0 or 1); those with a null of either are left out.

    Of more than max_rows rows, a hash of the text picks about that many: the bound on the sample. Features are words and
    stems that at least least_rows of its texts have; the max_features that tell the labels apart best (G statistic) are
    kept. Each text that names a group has counterfactuals, its identity terms swapped for the others of their kind;
    fairness weighs the mean squared change of score over them. Without both labels every score is the share of ones."""
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)")
    scratch = Scratch(labelled.sparkSession, "toxicity")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    swaps = Swaps(groups)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            out: list[list] = [[], [], []]
            for text in b.column(0):
                h = np.unique(np.concatenate([h for _, h, _ in features([text.as_py()])] or [np.zeros(0, np.uint64)]))
                changed = list(swaps.of(h))
                for to, x in zip(out, (h, [x for x, _ in changed], [x for _, x in changed])):
                    to.append(x)
            found, lost, gained = out
            nested = lambda xs: pa.array([[x.view(np.int64) for x in some] for some in xs], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), nested(lost), nested(gained)], ["toxic", "found", "lost", "gained"])

    sample = scratch.put(rows.mapInArrow(find, "toxic int, found array<long>, lost array<array<long>>, gained array<array<long>>"), "sample")
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if ones in (0, n):
        scratch.clear()
        share = (ones + 0.5) / (n + 1)
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    # the G statistic of each feature's table of having it against being toxic, with half a row in each cell
    a, m = F.col("a") + 0.5, F.col("m") + 1.0
    cell = lambda x, row, col: x * F.log(x * (n + 2) / (row * col))
    b, c, d = m - a, F.lit(ones + 1.0) - a, F.lit(n - ones + 1.0) - (m - a)
    tells = cell(a, m, F.lit(ones + 1.0)) + cell(b, m, F.lit(n - ones + 1.0)) + cell(c, F.lit(n + 2.0) - m, F.lit(ones + 1.0)) + cell(d, F.lit(n + 2.0) - m, F.lit(n - ones + 1.0))
    odds = F.log(a / c) - F.log(b / d)
    counted = sample.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("m"))
    kept = counted.where(F.col("m") >= least_rows).select("feature", tells.alias("tells"), odds.alias("odds")).orderBy(F.desc("tells"), "feature").limit(max_features).toPandas()
    h, odds_of = kept["feature"].to_numpy().view(np.uint64), kept["odds"].to_numpy()
    order = np.argsort(h)
    h, scale = h[order], np.abs(odds_of[order]) + 0.1

    def as_hashes(x: pa.ListScalar) -> np.ndarray:
        return x.values.to_numpy().view(np.uint64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per batch: labels, feature and row of each entry, feature, swap and sign (lost: -1) of each swap's entry."""
        for b in batches:
            out = [b.column(0).to_pylist()]
            for lists in ([as_hashes(r) for r in b.column(1)], *([as_hashes(x) for r in b.column(k) for x in r] for k in (2, 3))):
                all_ = np.concatenate([*lists, np.zeros(0, np.uint64)])
                of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                at = np.minimum(np.searchsorted(h, all_), max(len(h) - 1, 0))
                hit = h[at] == all_ if len(h) else np.zeros(len(at), bool)
                out += [at[hit].astype(np.int32), of[hit].astype(np.int32), len(lists)]
            toxic, at, of, _, lost, lost_of, n_swaps, gained, gained_of, _ = out
            columns = [toxic, at, of, np.concatenate([lost, gained]), np.concatenate([lost_of, gained_of]), np.repeat([-1, 1], [len(lost), len(gained)]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(pa.int32())) for x in columns), pa.array([n_swaps], pa.int32())], ["toxic", "at", "of", "swap_at", "swap_of", "sign", "n_swaps"])

    # what leaves the tasks: at most max_rows times max_features numbers, in fact those that the texts have
    kinds = ", ".join(f"{c} array<int>" for c in ("toxic", "at", "of", "swap_at", "swap_of", "sign"))
    parts = _columns(sample.mapInArrow(number, f"{kinds}, n_swaps int"))
    scratch.clear()
    weights, bias = fit(*parts, scale, fairness, decay, steps)
    return Classifier(h, weights, bias)


def _columns(parts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Batches' entries side by side, their rows and swaps counted on: feature and row of each entry, labels, feature,
    sign and swap of each swap's entry, and how many swaps there are."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    n_rows = n_swaps = 0
    for b in parts.toArrow().to_batches():
        for i in range(b.num_rows):
            toxic, at, of, swap_at, swap_of, sign = (np.array(b.column(k)[i].values) for k in range(6))
            for to, x in zip(out, (at, of + n_rows, toxic, swap_at, sign, swap_of + n_swaps)):
                to.append(x)
            n_rows += len(toxic)
            n_swaps += b.column(6)[i].as_py()
    return *(np.concatenate(x) for x in out), n_swaps


def score_texts(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); null and empty texts get the score of no features. Columns
    of these names are replaced."""
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    which = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            s = model.score(b.column(which).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, schema)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id as text mod folds is 0), score, predicted. Learns from the
    other documents that have a label; of a document with both labels it learns the greater one. Of more than max_rows
    labelled documents a hash of doc_id picks about that many, so their ids fit a broadcast. A null doc_id is neither held
    out nor learned from."""
    known = labels.where((fold_of(folds) != 0) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    scratch = Scratch(docs.sparkSession, "labels")
    known = scratch.put(known, "known")
    if (n := known.count()) > max_rows:
        known = scratch.put(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n)), "some")
        n = known.count()
    if n > 2 * max_rows:
        raise ValueError("more labelled documents were picked than a broadcast is meant for")
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), max_rows=max_rows)
    scratch.clear()
    held = F.coalesce(fold_of(folds) == 0, F.lit(False))
    return score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
