"""Token counts that follow edits: a segment tree of pre-token counts per document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in a leaf when a tree is built; a leaf that has grown past twice that is split.
LEAF = 64
#: Entries of the pre-token -> count table (some 200 bytes each) that a task keeps before it starts afresh.
CACHE = 200_000


class PreTokens:
    """Cuts text into pre-tokens, over whose edges no token goes, and counts each one's tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find, self.known = regex.compile(pattern), {}

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = len(self.encoding.encode_ordinary(p))
        return list(map(known.__getitem__, pieces))


_open: dict[str, PreTokens] = {}


def pre_tokens(ranks_path: str, pattern: str) -> PreTokens:
    if ranks_path not in _open:
        _open[ranks_path] = PreTokens(ranks_path, pattern)
    return _open[ranks_path]


class CountTree:
    """Leaves hold some pre-tokens each: their characters and tokens. Level k + 1 sums pairs of level k."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.levels = [np.array([chars, tokens], np.int64).reshape(2, -1)]
        self.raise_all()

    def raise_all(self) -> None:
        self.levels = self.levels[:1]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            if low.shape[1] % 2:
                low = np.concatenate([low, np.zeros((2, 1), np.int64)], axis=1)
            self.levels.append(low[:, ::2] + low[:, 1::2])

    @property
    def total(self) -> tuple[int, int]:
        if not self.levels[-1].shape[1]:
            return 0, 0
        return int(self.levels[-1][0, 0]), int(self.levels[-1][1, 0])

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character pos (the last one if none does), and where it starts."""
        at, start = 0, 0
        for level in self.levels[-2::-1]:
            at *= 2
            if at + 1 < level.shape[1] and pos >= start + level[0, at]:
                start += int(level[0, at])
                at += 1
        return at, start

    def replace(self, lo: int, hi: int, chars: list[int], tokens: list[int]) -> int:
        """Puts new leaves in place of lo to hi (not included). As many as before: only the sums above change, else the
        tree is put together again from its leaves. Returns how many sums were computed."""
        if hi - lo == len(chars) and len(self.levels) > 0:
            self.levels[0][:, lo:hi] = [chars, tokens]
            changed = 0
            a, b = lo, max(hi - 1, lo)
            for low, up in zip(self.levels, self.levels[1:]):
                a, b = a // 2, b // 2
                for i in range(a, b + 1):
                    up[:, i] = low[:, 2 * i : 2 * i + 2].sum(axis=1)
                    changed += 1
            return changed
        leaves = self.levels[0]
        self.levels = [np.concatenate([leaves[:, :lo], np.array([chars, tokens], np.int64).reshape(2, -1), leaves[:, hi:]], axis=1)]
        self.raise_all()
        return sum(x.shape[1] for x in self.levels[1:])


def build(text: str, pre: PreTokens) -> CountTree:
    pieces = pre.find.findall(text)
    n = pre.count(pieces)
    sizes = list(map(len, pieces))
    starts = range(0, len(pieces), LEAF)
    return CountTree([sum(sizes[i : i + LEAF]) for i in starts], [sum(n[i : i + LEAF]) for i in starts])


def edit(text: str, tree: CountTree, pos: int, deleted: int, inserted: str, pre: PreTokens) -> tuple[str, int, int]:
    """Replaces deleted characters at pos by inserted. Returns the text, the pre-tokens encoded again, the sums computed.

    The scan starts a leaf before the one that holds the character before pos, as a pre-token looks one character past its
    end at most, and stops at the first pre-token that ends on an old leaf's edge behind the edit: a scan from there on
    depends on nothing before it, so the leaves behind it stay."""
    pos = max(0, min(pos, len(text)))
    deleted = max(0, min(deleted, len(text) - pos))
    new = text[:pos] + inserted + text[pos + deleted :]
    leaves = tree.levels[0]
    if not leaves.shape[1]:
        fresh = build(new, pre)
        tree.levels = fresh.levels
        return new, len(pre.find.findall(new)), sum(x.shape[1] for x in tree.levels[1:])
    lo, start = tree.find(max(pos - 2, 0))
    if lo and pos - 2 < start + 2:
        lo -= 1
        start -= int(leaves[0, lo])
    hi, at = tree.find(pos + deleted)
    edge = at + int(leaves[0, hi])  # the first old edge behind the edit, then the next ones
    hi += 1
    shift = len(inserted) - deleted
    pieces: list[str] = []
    end = start
    for m in pre.find.finditer(new, start):
        pieces.append(m.group())
        end = m.end()
        while hi < leaves.shape[1] and edge + shift < end:
            edge += int(leaves[0, hi])
            hi += 1
        if end == edge + shift and hi < leaves.shape[1]:
            break
    else:
        hi = leaves.shape[1]
    n, sizes = pre.count(pieces), list(map(len, pieces))
    parts = max(1, hi - lo) if LEAF * (hi - lo) * 2 >= len(pieces) > 0 else -(-len(pieces) // LEAF)
    cut = [len(pieces) * i // parts for i in range(parts + 1)] if parts else [0]
    sums = tree.replace(lo, hi, [sum(sizes[a:b]) for a, b in zip(cut, cut[1:])], [sum(n[a:b]) for a, b in zip(cut, cut[1:])])
    return new, len(pieces), sums


def count_with_edits(docs: DataFrame, edits: str, ranks_path: str, pattern: str) -> DataFrame:
    """docs has doc_id, text and an array column named by edits of structs (pos, deleted, inserted), applied in order;
    characters are Unicode code points. One row per row: doc_id, n_tokens (before), n_leaves, n_edits, n_tokens_after,
    n_chars_after, n_reencoded (pre-tokens encoded again by the edits), n_sums (subtree sums computed again).

    A null text is empty, a null array or edit does nothing, positions and lengths beyond the text are cut to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pre_tokens(ranks_path, pattern)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text, changes in zip(b.column(1), b.column(2)):
                text = text.as_py() or ""
                tree = build(text, pre)
                before, pieces, again, sums, k = tree.total[1], tree.levels[0].shape[1], 0, 0, 0
                for change in changes.as_py() or []:
                    if change is not None:
                        text, r, s = edit(text, tree, change["pos"] or 0, change["deleted"] or 0, change["inserted"] or "", pre)
                        again, sums, k = again + r, sums + s, k + 1
                for to, x in zip(out, (before, pieces, k, tree.total[1], len(text), again, sums)):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", *COUNTS])

    return docs.select("doc_id", "text", edits).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ["n_tokens", "n_leaves", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded", "n_sums"]


def derived_edits(docs: DataFrame) -> DataFrame:
    """Three edits per document, drawn from hashes of its text: near its start, anywhere, and at its end."""
    n = F.length(F.coalesce("text", F.lit("")))
    draw = lambda k: F.xxhash64("text", F.lit(k))
    one = lambda pos, k: F.struct(pos.cast("long").alias("pos"), F.pmod(draw(k), F.lit(40)).cast("long").alias("deleted"), F.expr(f"substring(text, cast(pmod(xxhash64(text, {k + 10}), 50) AS int) + 1, 24)").alias("inserted"))
    return docs.select("doc_id", "text", F.array(one(F.pmod(draw(1), F.lit(20)), 1), one(F.pmod(draw(2), n + 1), 2), one(n, 3)).alias("edits"))
