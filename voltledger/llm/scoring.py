"""Language-model scores by deleted interpolation of word n-grams (two words), learned from the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_long, blocks, joined_bytes, mix, squeezed, unsqueezed, words

#: Token ids with a place of their own: the end of a text and any word outside the vocabulary.
END, OTHER, FIRST = 0, 1, 2
SHIFT = 22


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and a final 0 for its end, and the text of each."""
    h, of, _, _ = words(*joined_bytes(texts))
    at = np.searchsorted(of, np.arange(len(texts)), side="right")
    return np.insert(h, at, np.uint64(0)), np.insert(of, at, np.arange(len(texts)))


def fold(folds: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))


def count_words(rows: DataFrame) -> DataFrame:
    """word (hash), n: in rows whose use is not 0, rest: in those whose use is 1, anywhere: in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 22):
            h, of = tokens(b.column("text"))
            w, at = np.unique(h, return_inverse=True)
            use = b.column("use").to_numpy()[of]
            sums = (np.bincount(at, weights=x, minlength=len(w)).astype(np.int64) for x in (use != 0, use == 1, np.ones(len(h))))
            yield pa.RecordBatch.from_arrays([as_long(w), *map(pa.array, sums)], ["word", "n", "rest", "anywhere"])

    counted = rows.select("text", "use").mapInArrow(run, "word long, n long, rest long, anywhere long")
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "rest", "anywhere")))


class Vocabulary:
    """The words that have an id, most of the corpus; the tokens of all others are OTHER here and known by their hashes.
    counts: of each id in training tokens, rest: in those outside the tuning part, total: all training tokens."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.total = hashes[order], total
        self.counts, self.rest = (np.concatenate([[0, 0], x[order]]) for x in (counts, rest))
        end = np.flatnonzero(self.hashes == 0)
        for x in (self.counts, self.rest):
            if len(end):
                x[END], x[FIRST + end[0]] = x[FIRST + end[0]], 0

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        out = np.where(self.hashes[at] == h, at + FIRST, OTHER) if len(self.hashes) else np.full(len(h), OTHER)
        return np.where(h == 0, END, out)


#: Which words of a pair are rare, that is outside the vocabulary: its second, its first, both.
SECOND, LEADING, BOTH = 0, 1, 2


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of sorted columns stands first, and how often it occurs."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return first, np.diff([*first, n])


def pairs_of(texts: pa.Array, vocabulary: Vocabulary) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Distinct pairs of each text. Of two words of the vocabulary: both ids as one number, the text, how often. Of others:
    the rare word's hash (the second one's if both are rare), the other word's id (its hash if both are rare), which are
    rare, the text, how often. Each text's first word has the end of a text as context."""
    h, of = tokens(texts)
    w = vocabulary.ids(h)
    v = np.concatenate([[END], w[:-1]])  # the token before a text's first is the end of the text before
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    rare_w, rare_v = w == OTHER, v == OTHER
    rare = rare_w | rare_v
    key = (v << SHIFT | w)[~rare]
    both = np.sort(of[~rare] << 2 * SHIFT | key)  # a block has fewer texts than the sign bit leaves room for
    first, n = runs(both)
    known = both[first] & ((1 << 2 * SHIFT) - 1), both[first] >> 2 * SHIFT, n
    h, before, v, w, of, rare_w, rare_v = (x[rare] for x in (h, before, v, w, of, rare_w, rare_v))
    kind = np.where(rare_w & rare_v, BOTH, np.where(rare_w, SECOND, LEADING))
    word = np.where(rare_w, h, before)
    other = np.where(kind == BOTH, before, np.where(kind == SECOND, v, w).astype(np.uint64))
    order = np.lexsort((of, kind, other, word))
    word, other, kind, of = (x[order] for x in (word, other, kind, of))
    first, n = runs(word, other, kind, of)
    return known, (word[first], other[first], kind[first], of[first], n)


def added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n).astype(float)  # of nothing, it counts in integers


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Contexts are bucketed by their count's power of two."""
    return np.minimum(np.log2(np.maximum(count, 0) + 1).astype(np.int64), 40)


def shares(context: np.ndarray, word: np.ndarray, pair: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, the word's share and the pair's share (maximum likelihood), from the counts of all three and
    of all tokens. After a context that never occurs, the word's share stands for the pair's."""
    one = word / max(total, 1)
    return bucket_of(context), one, np.where(context > 0, pair / np.maximum(context, 1), one)


def grid(b: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The cell of a held-out pair: bucket, and steps of a factor 2**(1/4) of both shares."""
    step = lambda p: np.where(p > 0, np.minimum(-4 * np.log2(np.maximum(p, 1e-60)) + 1, 255), 0).astype(np.int64)
    return (b << 16) | (step(one) << 8) | step(two)


def mixture(cells: np.ndarray, kinds: int, rounds: int = 60) -> np.ndarray:
    """Weights (uniform, word, pair) per bucket by expectation-maximisation. cells: rows of bucket, held-out tokens, mean
    word share, mean pair share. A bucket without held-out tokens takes those of the nearest lower one that has some."""
    out = np.zeros((41, 3))
    last = np.array([0.1, 0.5, 0.4])
    for b in range(41):
        mine = cells[cells[:, 0] == b]
        if len(mine):
            p = np.stack([np.full(len(mine), 1.0 / (kinds + 1)), mine[:, 2], mine[:, 3]], axis=1)
            lam = np.full(3, 1 / 3)
            for _ in range(rounds):
                got = lam * p
                got = got / got.sum(axis=1, keepdims=True)
                lam = (got * mine[:, 1:2]).sum(axis=0) + 1e-3
                lam = lam / lam.sum()
            last = lam
        out[b] = last
    return out


def cells_of(context: np.ndarray, word: np.ndarray, pair: np.ndarray, held: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """Tallies for the mixture of pairs that the tuning part holds held times: cell, tokens, sums of both shares."""
    bucket, one, two = shares(context, word, pair, total)
    cell, at = np.unique(grid(bucket, one, two), return_inverse=True)
    return cell, *(added(at, w, len(cell)) for w in (held, held * one, held * two))


def score_documents(docs: DataFrame, folds: int = 7, frequent: int = 500_000, top_share: int = 512, bucket_tokens: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod folds is 2 are held out; the others (a null doc_id among them) teach. Of these,
    fold 3 is also the held-out part of deleted interpolation: the mixture weights are learned on its tokens with counts
    of the rest, then used with counts of all. The model: P(w|v) = l0(b)/(V+1) + l1(b) c(w)/N + l2(b) c(v,w)/c(v), b the
    bucket of c(v), over all words.

    The frequent most frequent words (ties left out) have ids whose counts are broadcast. That decides only where a pair is
    counted, not its score: a pair with a word rarer than these goes to the bucket of that word, where the word's own count
    adds up too; one of two such words is joined to the count of its first one.

    Pairs of the most frequent words (at least 1/top_share of all tokens each, so at most top_share words) are counted
    map-side and scored by broadcast; any other pair has a word rarer than that, so no bucket of pairs can grow beyond
    its share. Null texts are empty: their one token is the end. An empty table gives an empty result; identical rows
    each get a row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "scoring")
    f = fold(folds)
    use = F.when(f == 2, 0).when(f == 3, 2).otherwise(1)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"), use.cast("int").alias("use"))
    counted = scratch.put(count_words(rows), "words")
    total, kinds, any_kinds = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.count(F.lit(1))).first()
    # whole steps of a factor 2**(1/16) of the count, from the top, while the words fit
    step, least = F.floor(F.log2("anywhere") * 16), 0
    if any_kinds > frequent:
        have = 0
        for r in counted.select(step.alias("step")).groupBy("step").count().orderBy(F.desc("step")).collect():
            have, least = have + r["count"], r["step"]
            if have > frequent:
                least += 1
                break
    inside = (step >= least) | (F.col("word") == 0)
    kept = counted.where(inside).toArrow()
    vocabulary = Vocabulary(kept["word"].to_numpy().view(np.uint64), kept["n"].to_numpy(), kept["rest"].to_numpy(), total)
    top = np.zeros(len(vocabulary.counts), bool)
    top[vocabulary.counts * top_share >= max(total, 1)] = True
    n_buckets = max(1, -(-int(total) // bucket_tokens), spark.sparkContext.defaultParallelism)
    sent = spark.sparkContext.broadcast((vocabulary, top))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, top = sent.value
        for b in blocks(batches, "text", 1 << 22):
            (key, of, n), rare = pairs_of(b.column("text"), vocabulary)
            kind_of = b.column("use").to_numpy()
            uses = kind_of[of]
            hot = top[key >> SHIFT] & top[key & ((1 << SHIFT) - 1)]
            rows_of = b.column("row").to_numpy()
            row = rows_of.tobytes()
            block = int.from_bytes(hashlib.blake2b(row, digest_size=8).digest(), "little", signed=True)
            # hot pairs of this block, summed up: no text is kept
            k, at = np.unique(key[hot], return_inverse=True)
            sums = np.stack([np.bincount(at, weights=n[hot] * (uses[hot] == u), minlength=len(k)) for u in (1, 2)]).astype(np.int64)
            key, of, n = (x[~hot] for x in (key, of, n))
            place = lambda x: (x * np.int64(0x9E3779B1) >> np.int64(7)) % n_buckets
            own, others, of_rare = place(k), place(key), (rare[0] % np.uint64(n_buckets)).astype(np.int64)
            order, rare_order = np.argsort(others, kind="stable"), np.argsort(of_rare, kind="stable")
            cut, rare_cut = (np.searchsorted(x, np.arange(n_buckets + 1)) for x in (others[order], of_rare[rare_order]))
            for g in range(n_buckets):
                i = order[cut[g] : cut[g + 1]]
                j = np.flatnonzero(own == g)
                word, other, which, text, times = (x[rare_order[rare_cut[g] : rare_cut[g + 1]]] for x in rare)
                mine = g == block % n_buckets  # one bucket takes the block's rows along
                if len(i) or len(j) or len(word) or mine:
                    i = i[np.argsort(key[i], kind="stable")]
                    packed = (squeezed(key[i], True), squeezed(of[i].astype("<u2")), squeezed(np.minimum(n[i], 2**32 - 1).astype("<u4")), kind_of.astype("u1").tobytes(), row if mine else b"", k[j].tobytes(), sums[:, j].tobytes())
                    packed += (squeezed(word, True), squeezed(other), squeezed(which.astype("u1")), squeezed(text.astype("<u2")), squeezed(np.minimum(times, 2**32 - 1).astype("<u4")), rows_of[text[which == BOTH]].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g], pa.int32()), pa.array([block]), *(pa.array([x], pa.binary()) for x in packed)],
                        EVENT_COLUMNS,
                    )

    def meet(table: pa.Table) -> pa.Table:
        vocabulary, top = sent.value
        total = vocabulary.total
        col = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        open_ = lambda name, kind, in_order=False: [unsqueezed(x, kind, in_order) for x in table.column(name).to_pylist()]
        keys, ats, ns = open_("key", "<i8", True), open_("at", "<u2"), open_("n", "<u4")
        uses_of = col("uses", "u1")
        uses = [u[a] for u, a in zip(uses_of, ats)]
        hot, sums = np.concatenate(col("hot", np.int64)), np.concatenate([x.reshape(2, -1) for x in col("sums", np.int64)], axis=1)
        key, n, use = np.concatenate(keys), np.concatenate(ns).astype(np.int64), np.concatenate(uses)
        kinds_, inv = np.unique(np.concatenate([key, hot]), return_inverse=True)
        c = np.stack([np.bincount(inv, weights=np.concatenate([n * (use == u), sums[u - 1]]), minlength=len(kinds_)) for u in (1, 2)]).astype(np.int64)
        first, second = kinds_ >> SHIFT, kinds_ & ((1 << SHIFT) - 1)
        is_top = top[first] & top[second]
        held = np.flatnonzero(c[1])
        tallies = [cells_of(vocabulary.rest[first[held]], vocabulary.counts[second[held]], c[0][held], c[1][held], total)]
        seen = c.sum(axis=0)[inv[: len(key)]]

        # pairs with a rare word: all tokens of that word are in this bucket, as the second word of some pair
        words_, others, kinds_of, texts, times = open_("rare", "<u8", True), open_("other", "<u8"), open_("which", "u1"), open_("rare_at", "<u2"), open_("rare_n", "<u4")
        word, other, which, k = np.concatenate(words_), np.concatenate(others), np.concatenate(kinds_of), np.concatenate(times).astype(np.int64)
        use = np.concatenate([u[a] for u, a in zip(uses_of, texts)])
        _, at = np.unique(word, return_inverse=True)
        as_word = k * (which != LEADING)
        own = np.stack([np.bincount(at, weights=as_word * (use == u), minlength=0) for u in (1, 2)]).astype(np.int64)
        own_n, own_rest = own.sum(axis=0)[at], own[0][at]
        _, pair_first, pair = np.unique(mix(mix(word) ^ other) + which, return_index=True, return_inverse=True)
        p = np.stack([np.bincount(pair, weights=k * (use == u), minlength=0) for u in (1, 2)]).astype(np.int64)
        known = np.where(which == BOTH, 0, other).astype(np.int64)  # an id of the vocabulary
        context, context_rest = np.where(which == LEADING, own_n, vocabulary.counts[known]), np.where(which == LEADING, own_rest, vocabulary.rest[known])
        second_n, pair_n = np.where(which == LEADING, vocabulary.counts[known], own_n), p.sum(axis=0)[pair]
        held = pair_first[(p[1] > 0) & (which[pair_first] != BOTH)]
        tallies.append(cells_of(context_rest[held], second_n[held], p[0][pair[held]], p[1][pair[held]], total))

        out = [{"kind": 0, **{name: x.tobytes() for name, x in zip("abcd", cells)}} for cells in tallies]
        out.append({"kind": 2, "a": kinds_[is_top].tobytes(), "b": c.sum(axis=0)[is_top].tobytes()})
        lo = rare_lo = 0
        blocks_ = table.column("block").to_pylist()
        for x, a, block, t, w in zip(keys, ats, blocks_, texts, kinds_of):
            hi, rare_hi = lo + len(x), rare_lo + len(t)
            i = slice(rare_lo, rare_hi)
            packet = {"a": squeezed(x, True), "b": squeezed(np.minimum(seen[lo:hi], 2**32 - 1).astype("<u4")), "c": squeezed(n[lo:hi].astype("<u4")), "d": squeezed(a)}
            packet |= {"e": squeezed(context[i]), "f": squeezed(second_n[i]), "g": squeezed(pair_n[i]), "h": squeezed(k[i].astype("<u4")), "i": squeezed(t), "j": squeezed(w)}
            out.append({"kind": 1, "block": block, **packet})
            lo, rare_lo = hi, rare_hi
        out += [{"kind": 4, "block": block, "a": r} for r, block in zip(table.column("rows").to_pylist(), blocks_) if r]
        i = which == BOTH
        open_pairs = np.concatenate(col("both_rows", np.int64)), other[i], second_n[i], pair_n[i], p[0][pair[i]], k[i], use[i]
        out.append({"kind": 5, **{name: squeezed(x.astype("<i8") if x.dtype != np.uint64 else x.view("<i8")) for name, x in zip("abcdefg", open_pairs)}})
        return pa.table({"kind": pa.array([x["kind"] for x in out], pa.int32()), "block": pa.array([x.get("block") for x in out], pa.int64()), **{name: pa.array([x.get(name, b"") for x in out], pa.binary()) for name in PACKED}})

    met = scratch.put(rows.select("row", "text", "use").mapInArrow(events, EVENTS).groupBy("bucket").applyInArrow(meet, "kind int, block long, " + ", ".join(f"{c} binary" for c in PACKED)), "pairs")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(unsqueezed(x, "<i8")) for x in r], BOTH_COLUMNS)

    # pairs of two rare words take the count of the first from the table of all words
    outside = counted.where(~inside).select(F.col("word").alias("first"), "n", "rest")
    pairs = met.where("kind = 5").select(*"abcdefg").mapInArrow(unpack, ", ".join(f"{c} long" for c in BOTH_COLUMNS))
    both = pairs.join(outside.hint("merge"), "first", "left").select("row", F.coalesce("n", F.lit(0)).alias("context"), F.coalesce("rest", F.lit(0)).alias("context_rest"), "word_n", "pair_n", "pair_rest", "times", "use")
    both = scratch.put(both, "both")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, *values in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cell, np.int64)), *(pa.array(np.frombuffer(x)) for x in values)], CELL_COLUMNS)

    def tally_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, word, pair, held = (c.to_numpy() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells_of(context, word, pair, held, int(total))], CELL_COLUMNS)

    cells = met.where("kind = 0").select(*"abcd").mapInArrow(tally, CELLS)
    cells = cells.union(both.where("use = 2").select("context_rest", "word_n", "pair_rest", "times").mapInArrow(tally_both, CELLS))
    cells = cells.groupBy("cell").agg(*(F.sum(x).alias(x) for x in ("n", "one", "two"))).toArrow()
    n, one, two = (cells[x].to_numpy() for x in ("n", "one", "two"))
    table = np.stack([cells["cell"].to_numpy() >> 16, n, one / n, two / n], axis=1)
    weights = mixture(table, int(kinds))
    hot = met.where("kind = 2").select("a", "b").toArrow()  # at most top_share ** 2 pairs
    hot_key = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in hot["a"].to_pylist())])
    hot_n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in hot["b"].to_pylist())])
    order = np.argsort(hot_key)
    model = spark.sparkContext.broadcast((weights, hot_key[order], hot_n[order], int(kinds), int(total)))

    def log_p(context: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        weights, _, _, kinds, total = model.value
        bucket, one, two = shares(context, word, pair, total)
        return np.log10(weights[bucket, 0] / (kinds + 1) + weights[bucket, 1] * one + weights[bucket, 2] * two)

    def log_base(n: np.ndarray) -> np.ndarray:
        _, _, _, kinds, total = model.value
        return np.log10((n + 1.0) / (total + kinds + 1))

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and bucket, the texts and their sums; the blocks' rows as they are."""
        counts = sent.value[0].counts
        for b in batches:
            kinds_, block = b.column("kind").to_pylist(), b.column("block").to_pylist()
            at_, value = [], []
            for kind, x, y, z, d, *rare in zip(kinds_, *(b.column(c).to_pylist() for c in PACKED)):
                if kind == 4:
                    at_.append(x)
                    value.append(None)
                    continue
                key, seen, n = unsqueezed(x, "<i8", True), unsqueezed(y, "<u4").astype(np.int64), unsqueezed(z, "<u4")
                context, word, pair = (unsqueezed(i, "<i8") for i in rare[:3])
                times, at, which = (unsqueezed(i, kind) for i, kind in zip(rare[3:], ("<u4", "<u2", "u1")))
                texts, at = np.unique(np.concatenate([unsqueezed(d, "<u2"), at]), return_inverse=True)
                rare_at, is_word = at[len(key) :], times * (which != LEADING)
                score = added(at, np.concatenate([n * log_p(counts[key >> SHIFT], counts[key & ((1 << SHIFT) - 1)], seen), np.where(which == BOTH, 0, times * log_p(context, word, pair))]), len(texts))
                sums = score, added(rare_at, is_word * log_base(word), len(texts)), added(rare_at, is_word * (word > 0), len(texts))
                at_.append(texts.tobytes())
                value.append(np.stack(sums).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(at_, pa.binary()), pa.array(value, pa.binary())], ["block", "at", "value"])

    def of_block(table: pa.Table) -> pa.Table:
        pieces = list(zip(table.column("at").to_pylist(), table.column("value").to_pylist()))
        row = np.frombuffer(next(x for x, v in pieces if v is None), np.int64)
        sums = np.zeros((3, len(row)))
        for x, v in pieces:
            if v is not None:
                sums[:, np.frombuffer(x, "<u2")] += np.frombuffer(v).reshape(3, -1)
        return pa.table({"row": row, **dict(zip(SUMS, sums))})

    def of_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, context, word, pair, times = (c.to_numpy() for c in b.columns)
            none = pa.array(np.zeros(len(row)))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(times * log_p(context, word, pair)), none, none], ["row", *SUMS])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What broadcast values decide of each text: its tokens, words of the vocabulary, hot pairs."""
        vocabulary, top = sent.value
        _, hot_key, hot_n, _, _ = model.value
        base_of = log_base(vocabulary.counts)
        for b in blocks(batches, "text", 1 << 22):
            h, of = tokens(b.column("text"))
            n = b.num_rows
            w = vocabulary.ids(h)
            known = w != OTHER
            base = added(of[known], base_of[w[known]], n)
            v = np.concatenate([[END], w[:-1]])
            is_hot = top[v] & top[w]
            key = (v << SHIFT | w)[is_hot]
            kinds_, inv = np.unique(key, return_inverse=True)
            at = np.searchsorted(hot_key, kinds_)
            score = added(of[is_hot], log_p(vocabulary.counts[kinds_ >> SHIFT], vocabulary.counts[kinds_ & ((1 << SHIFT) - 1)], hot_n[at])[inv], n) if len(kinds_) else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "use")), pa.array(np.bincount(of, minlength=n)), pa.array(np.bincount(of[known], weights=vocabulary.counts[w[known]] > 0, minlength=n).astype(np.int64)), pa.array(base), pa.array(score)], DIRECT_COLUMNS)

    own = scratch.put(rows.select("doc_id", "row", "use", "text").mapInArrow(direct, DIRECT), "direct")
    of_rows = own.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    schema = "row long, " + ", ".join(f"{c} double" for c in SUMS)
    more = met.where("kind in (1, 4)").mapInArrow(cold, "block long, at binary, value binary").groupBy("block").applyInArrow(of_block, schema)
    more = more.union(both.select("row", "context", "word_n", "pair_n", "times").mapInArrow(of_both, schema)).groupBy("row").agg(*(F.sum(c).alias(c) for c in SUMS))
    # identical rows have added up under one number, each as much as the others
    sums = of_rows.join(more.hint("merge"), "row", "left").select("row", *(F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0)).alias(c) for c in SUMS))
    result = scratch.put(
        own.join(sums.hint("merge"), "row").select("doc_id", (F.col("use") == 0).alias("held_out"), "n_tokens", (F.col("known") + F.round("rare_known")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.col("rare_base")).alias("base_score"), (F.col("score") + F.col("more_score")).alias("score")),
        "result",
    )
    scratch.clear(keep=("result",))
    return result


EVENT_COLUMNS = ["bucket", "block", "key", "at", "n", "uses", "rows", "hot", "sums", "rare", "other", "which", "rare_at", "rare_n", "both_rows"]
EVENTS = "bucket int, block long, " + ", ".join(f"{c} binary" for c in EVENT_COLUMNS[2:])
PACKED = list("abcdefghij")
BOTH_COLUMNS = ["row", "first", "word_n", "pair_n", "pair_rest", "times", "use"]
CELL_COLUMNS = ["cell", "n", "one", "two"]
CELLS = "cell long, n double, one double, two double"
SUMS = ["more_score", "rare_base", "rare_known"]
DIRECT_COLUMNS = ["doc_id", "row", "use", "n_tokens", "known", "base", "score"]
DIRECT = "doc_id long, row long, use int, n_tokens long, known long, base double, score double"
