"""Tokens of two tokenizers aligned by the bytes that they cover."""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, blocks, bytes_of_characters

#: White space as the first tokenizer's rules know it, without and with blanks and line ends.
_RARE = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = rf" \n{_RARE}"
#: A text is cut where a blank or line end follows something else: no token of either vocabulary crosses such a place.
_CHUNK = re.compile(rf"[{_WS}]*[^{_WS}]+(?:[{_RARE}][{_WS}]*[^{_WS}]*)*|[{_WS}]+")
#: What a text without such places only between single blanks and line ends has; all others are cut by searching and replacing.
_ODD = re.compile(rf"[{_RARE}\0]|[ \n][ \n]|[ \n]\Z")
_LATER = re.compile("[^\0-\u024f]")
#: Bytes of texts in a block, tokens that are merged at once, chunks that are looked up at once.
BLOCK_BYTES, MERGE_TOKENS, LOOKUP = 4 << 20, 400_000, 1 << 16
#: Chunks whose ids a worker keeps, and the longest of them in characters; when it is full, the later half is dropped.
KEPT, LONGEST = 300_000, 48


class TokenPair:
    """Ids of a blank and a text by a byte-level vocabulary (a), and of the text by a piece vocabulary (b), which puts the
    blank before it itself."""

    def __init__(self, a_path: str, b_path: str, a_pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte, size = bytes_of_characters(), self.a.get_vocab_size()
        # an added token stands as it is, all others in the byte-level characters
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(map(byte.__getitem__, s)) if set(s) <= byte.keys() else s.encode() for s in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        whole = [s for i, s in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: Whether pieces allow the cuts of _CHUNK; otherwise whole texts are encoded.
        self.cuts = self.blank != self.b.unk_id() and not any("\n" in s or "▁" in s.lstrip("▁") for s in whole)
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.ranks = self._ranks(a_pattern) if a_pattern else None

    def _ranks(self, pattern: str):
        """The vocabulary of a once more as ranks, which encode faster, if its merges are in the order of ids."""
        import tiktoken

        whole = json.loads(self.a.to_str())
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        if whole["normalizer"] or any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
            return None
        return tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values() if i < 256 + len(merges)}, special_tokens={})

    def encode(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Per chunk the ids of both sides as 32-bit numbers, and whether both give the chunk's bytes again."""
        by_rank = self.ranks.encode_ordinary if self.ranks else None
        rare = [c for c in chunks if not by_rank or _LATER.search(c)]  # letters that rules of other years may class otherwise
        ids_a = {c: e.ids for c, e in zip(rare, self.a.encode_batch_fast(rare, add_special_tokens=False))} if rare else {}
        ids_b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        out, a_bytes, b_bytes = [], self.a_bytes, self.b_bytes
        for c, b in zip(chunks, ids_b):
            raw, a = c.encode(), ids_a.get(c)
            same = a is None or b"".join([a_bytes[i] for i in a]) == raw
            if c == " ":
                b = [self.blank]
            elif c[0] != " ":  # a line end, before which the blank is the vocabulary's own
                b = b[1:] if b[:1] == [self.blank] else b
            same = same and b"".join([b_bytes[i] for i in b]) == raw
            out.append((array("i", by_rank(c) if a is None else a).tobytes(), array("i", b).tobytes(), same))
        return out

    def cut(self, text: str) -> Iterator[list[str]]:
        """The chunks of a blank and text, some thousands at a time."""
        if not self.cuts:
            yield [" " + text]
        elif len(text) <= BLOCK_BYTES and not _ODD.search(text) and text[0] not in " \n":
            yield (" " + text).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
        else:
            found = (m.group() for m in _CHUNK.finditer(" " + text))
            while some := list(itertools.islice(found, LOOKUP)):
                yield some

    def chunks(self, text: str) -> Iterator[list[tuple[bytes, bytes, bool]]]:
        """What encode gives for the chunks of a blank and text; earlier chunks are remembered."""
        for some in self.cut(text):
            known = self.known
            if new := list(set(some).difference(known)):
                known |= zip(new, self.encode(new))
            yield list(map(known.__getitem__, some))
            for c in new:
                if len(c) > LONGEST:
                    del known[c]
            if len(known) > KEPT:
                self.known = dict(itertools.islice(known.items(), KEPT // 2))

    def ids(self, text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides in stretches over the same bytes; nothing if either side doesn't give the text's bytes again."""
        stretches, fine = [], True
        for some in self.chunks(text) if text else ():
            a, b, same = zip(*some)
            fine &= all(same)
            stretches.append(tuple(np.frombuffer(b"".join(x), np.int32) for x in (a, b)))
        if not fine:  # what one chunk lacks another one could have in excess
            whole = (" " + text).encode()
            if any(b"".join(x for s in stretches for x in map(side.__getitem__, s[k].tolist())) != whole for k, side in enumerate((self.a_bytes, self.b_bytes))):
                return
            stretches = [tuple(np.concatenate([s[k] for s in stretches]) for k in (0, 1))]
        yield from stretches


_open: dict[tuple, TokenPair] = {}


def token_pair(*paths: str | None) -> TokenPair:
    """One pair of tokenizers a Python worker, which outlives its tasks."""
    return _open.get(paths) or _open.setdefault(paths, TokenPair(*paths))


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (doc, start; each document's tokens in order, over the same bytes) whose bytes overlap: each token
    start finds the other side's token that covers it, and both directions together give every pair. Starts go on from
    document to document."""
    a, b = (x.assign(row=np.arange(len(x))) for x in (a, b))
    in_b = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))
    other = b.rename(columns={"row": "row_b"}).assign(start_b=b["start"])
    in_a = pd.merge_asof(other, a.rename(columns={"row": "row_a"}).assign(start_a=a["start"]), on="start", by="doc")
    in_a = in_a[in_a["start_a"] < in_a["start_b"]]  # pairs with equal starts have been found from the first side
    return np.concatenate([in_b["row_a"], in_a["row_a"]]), np.concatenate([in_b["row_b"], in_a["row_b"]])


class _Written:
    """Ids as text with what may follow them: `,` or `|` after one of a, `,` or `;` after one of b."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        self.table = [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for mark in marks]

    def groups(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        last = lambda g: np.append(np.diff(g) != 0, True)[: len(g)].astype(np.int64)
        n = int(group_a[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a.astype(np.int64) + last(group_a)
        code[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * (self.n_a + b.astype(np.int64)) + last(group_b)
        return "".join(map(self.table.__getitem__, code.tolist()))


#: A pair is its id of a * 2**24 + its id of b.
PAIR, B_ID = (1 << 48) - 1, (1 << 24) - 1
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>, block long, block_pairs array<long>, block_times array<long>"


def align_tokens(docs: DataFrame, a_path: str, b_path: str, a_pattern: str | None = None) -> DataFrame:
    """One row per document of docs (doc_id, text): n_a and n_b tokens, n_groups groups between bytes where tokens of both
    sides end, n_links overlapping pairs of tokens, groups (`a1,a2|b1;a3|b2,b3`), its distinct pairs of ids
    (id of a * 2**24 + id of b) in order and how often each is linked. Texts that are null, empty, or not given again byte
    by byte by both sides have zeros, a null for groups and no pairs. Rows that repeat are aligned each.

    a_pattern is the pattern that splits texts for a; with it, chunks of Latin letters are encoded by ranks, to equal ids.

    block numbers about 4 MB of texts that one task aligned; its last row has the distinct pairs of the block. Block numbers
    change when a task is repeated: write the table before it is used twice."""

    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = token_pair(a_path, b_path, a_pattern)
        written = _Written(len(both.a_sizes), len(both.b_sizes))
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", BLOCK_BYTES):
            n = batch.num_rows
            totals = np.zeros((4, n), np.int64)
            texts: list[list[str]] = [[] for _ in range(n)]
            counted: list[tuple[np.ndarray, np.ndarray]] = []
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def merge() -> None:
                docs_of = np.array([d for d, _, _ in held])
                sides = []
                for side, sizes in ((1, both.a_sizes), (2, both.b_sizes)):
                    ids = np.concatenate([h[side] for h in held])
                    start = np.cumsum(sizes[ids]) - sizes[ids]
                    sides.append((ids, pd.DataFrame({"doc": np.repeat(docs_of, [len(h[side]) for h in held]), "start": start})))
                (ids_a, a), (ids_b, b) = sides
                at_a, at_b = overlaps(a, b)
                doc = a["doc"].to_numpy()[at_a]
                counted.append(np.unique((doc << 48) + (ids_a[at_a].astype(np.int64) << 24) + ids_b[at_b], return_counts=True))
                # a group begins where tokens of both sides do
                edges = np.intersect1d(a["start"], b["start"], assume_unique=True)
                group_a, group_b = (np.searchsorted(edges, x["start"], side="right") - 1 for x in (a, b))
                cut_a, cut_b = (np.cumsum([0, *(len(h[side]) for h in held)]) for side in (1, 2))
                np.add.at(totals[0], docs_of, np.diff(cut_a))
                np.add.at(totals[1], docs_of, np.diff(cut_b))
                totals[3] += np.bincount(doc, minlength=n)
                for i, (d, xs, ys) in enumerate(held):
                    own_a, own_b = group_a[cut_a[i] : cut_a[i + 1]], group_b[cut_b[i] : cut_b[i + 1]]
                    totals[2, d] += own_a[-1] - own_a[0] + 1
                    texts[d].append(written.groups(xs, ys, own_a - own_a[0], own_b - own_b[0]))
                held.clear()

            waiting = 0
            for d, text in enumerate(batch.column(1)):
                for xs, ys in both.ids(text.as_py()):
                    held.append((d, xs, ys))
                    waiting += len(xs) + len(ys)
                    if waiting >= MERGE_TOKENS:
                        merge()
                        waiting = 0
            if held:
                merge()
            links = pd.DataFrame(np.stack([np.concatenate([c[k] for c in counted] or [np.zeros(0, np.int64)]) for k in (0, 1)], axis=1), columns=["link", "n"])
            if len(counted) > 1:
                links = links.groupby("link", sort=True, as_index=False)["n"].sum()
            pair, times = (links["link"] & PAIR).to_numpy(), links["n"].to_numpy()
            of_block, at = np.unique(pair, return_inverse=True)
            cut = pa.array(np.searchsorted(links["link"].to_numpy() >> 48, np.arange(n + 1)).astype(np.int32))
            only_last = lambda x: pa.array([None] * (n - 1) + [x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *map(pa.array, totals), pa.array(["".join(t)[:-1] if t else None for t in texts], pa.string()),
                    pa.ListArray.from_arrays(cut, pa.array(pair)), pa.ListArray.from_arrays(cut, pa.array(times)),
                    pa.array(np.full(n, block)), only_last(of_block), only_last(np.bincount(at, times, len(of_block)).astype(np.int64)),
                ],
                names,
            )
            block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (how many links of all documents link these two ids), best (no other pair of its id of b has more links);
    aligned has to be a written table."""
    listed = aligned.where("block_pairs is not null").selectExpr("inline(arrays_zip(block_pairs, block_times)) as (pair, n)")
    counts = listed.groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(B_ID))))  # at most one row per id of a
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def with_pair_counts(aligned: DataFrame) -> DataFrame:
    """aligned, as align_tokens gives it with whatever columns beside, without its pairs but with n_best (links whose pair is
    its id of b's most frequent one, ties included) and count_sum (the counts of the pairs of all links).

    A block's distinct pairs, not its links, meet the counts, and its documents then look theirs up among those."""
    scratch = Scratch(aligned.sparkSession, "alignment")
    aligned = scratch.put(aligned, "aligned")
    counts = scratch.put(pair_counts(aligned), "counts")
    wanted = aligned.where("block_pairs is not null").select(F.col("block").alias("of_block"), F.explode("block_pairs").alias("pair"))
    known = wanted.hint("merge").join(counts.hint("merge"), "pair")
    kept = [c for c in aligned.columns if c not in ("block_pairs", "block_times")]
    out = [f for f in aligned.schema.fields if f.name not in ("pairs", "times", "block", "block_pairs", "block_times")]
    schema = T.StructType([*out, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = [f.name for f in out]

    def add_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        pair, count, best = (found[c].to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order].astype(np.int64)
        sums = np.zeros((2, rows.num_rows), np.int64)
        first = 0
        for b in rows.select(["pairs", "times"]).to_batches():
            pairs, times = b.column(0), b.column(1)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            n, of = times.flatten().to_numpy(), first + np.repeat(np.arange(b.num_rows), np.diff(pairs.offsets.to_numpy()))
            np.add.at(sums[0], of, n * best[at] if len(at) else n)
            np.add.at(sums[1], of, n * count[at] if len(at) else n)
            first += b.num_rows
        return pa.Table.from_arrays([*(rows[c] for c in names), pa.array(sums[0]), pa.array(sums[1])], [*names, "n_best", "count_sum"])

    return aligned.select(*kept).groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(add_up, schema)


def summarise_alignment(aligned: DataFrame) -> DataFrame:
    """The digest columns of align_tokens and with_pair_counts; groups as SHA-256, empty without tokens."""
    digest = F.coalesce(F.sha2(F.col("groups"), 256), F.lit(""))
    return with_pair_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))
