"""Packing token sequences by a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, bytes_of_characters, numbered, parts

#: Bytes of the chunk -> ids table that a task keeps, and of one of its entries beside key and value. Chunks that come when it is full
#: are encoded each time; after twice as many of them, it shrinks to its first entries.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 170
#: Entries that a Python worker keeps from one task to the next: the first ones, which hold the most frequent chunks.
KEPT = 60_000

#: Chunks that are encoded by ranks: visible ASCII and Latin letters whose lower case is one letter of them too; cut into what the
#: vocabulary's pattern finds in their lower case. Longer ones are left to the tokenizer.
_LATIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]{1,200}")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\[-`{-~]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for a run's end, which the vocabulary's tokens of words' ends hold; no byte of a text in UTF-8.
_END, _SUFFIX = b"\xff", "</w>"


def end_ranks(whole: dict) -> dict[bytes, int] | None:
    """The vocabulary's tokens as ranks: a byte with a run's end comes before all merges, so that the end goes to the last byte first, as
    in the vocabulary. None if its merges are not in the order of ids or its rules are others than those that chunks are cut by."""
    model, rules = whole["model"], json.dumps([whole["normalizer"], whole["pre_tokenizer"]])
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    wanted = json.dumps([{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}, {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}])
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    vocab, byte = model["vocab"], bytes_of_characters()
    if rules != wanted or model.get("end_of_word_suffix") != _SUFFIX or any(vocab["".join(m)] != 512 + i for i, m in enumerate(merges)):
        return None
    ends = lambda t: len(t) > len(_SUFFIX) and t.endswith(_SUFFIX)
    ranks = {bytes(map(byte.__getitem__, t.removesuffix(_SUFFIX) if ends(t) else t)) + _END * ends(t): i for t, i in vocab.items() if i < 512 + len(merges)}
    return ranks if len(ranks) == 512 + len(merges) and all(len(t) == 1 + (i > 255) for t, i in ranks.items() if i < 512) else None


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes. The vocabulary's rules fold case and never look across
    a blank or line end, so each piece between them is encoded once and remembered, in lower-case ASCII. Pieces of ASCII and Latin letters
    are encoded by the vocabulary's tokens as ranks; these merge alike, as each token's own bytes are encoded as that token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_rank = None
        if ranks := end_ranks(json.loads(self.tokenizer.to_str())):
            from tiktoken import _tiktoken

            self.by_rank = _tiktoken.CoreBPE(ranks, {}, r"\S+").encode_single_piece
        self.known, self.used, self.missed = {b"": b""}, 0, 0

    def shrink(self) -> None:
        """Keeps the first entries only."""
        self.known = dict(itertools.islice(self.known.items(), KEPT))
        self.used = sum(map(len, self.known)) + sum(map(len, self.known.values())) + ENTRY_BYTES * len(self.known)
        self.missed = 0

    def ids(self, chunks: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encoded(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        found, rest, by_rank = {}, [], self.by_rank
        for c in chunks:
            if by_rank is None:
                rest.append(c)
            elif c.isalpha() and len(c) <= 200:  # ASCII letters alone
                found[c] = array("I", by_rank(c + _END)).tobytes()
            elif _LATIN.fullmatch(s := c.decode()):
                found[c] = array("I", [i for run in _RUNS.findall(s.lower()) for i in by_rank(run.encode() + _END)]).tobytes()
            else:
                rest.append(c)
        if rest:
            found |= zip(rest, self.ids([c.decode() for c in rest]))
        return found

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:  # perhaps a special token, whose case counts
            return self.ids([text.decode()])[0]
        chunks = text.lower().replace(b"\n", b" ").split(b" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            new = [c for c in dict.fromkeys(chunks) if c not in known]
        found = self.encoded(new)
        size = sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)
        if self.used + size <= CACHE_BYTES:
            known |= found
            self.used += size
            return b"".join(map(known.__getitem__, chunks))
        self.missed += size
        out = b"".join([known[c] if c in known else found[c] for c in chunks])
        if self.missed > 2 * CACHE_BYTES:
            self.shrink()
        return out


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer a Python worker, which outlives its tasks; of its table the first entries do."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """One row per piece: a document is its text's ids, then id 0, cut every size tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for b in blocks(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = words.encode(text.as_py() or b"") + b"\0\0\0\0"
                for i in range(0, len(ids), 4 * size):
                    for to, x in zip(out, (doc, i // (4 * size), i // 4, min(size, (len(ids) - i) // 4), zlib.crc32(ids[i : i + 4 * size]))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.shrink()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, PIECE)


def best_fills(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming, any number of each of lengths (in order): for each room of 0 to size tokens the largest total
    value that fits, and a length that it takes (0: none, as much fits in a token less)."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    v, upto = value[lengths], np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = v[:k] + best[c - lengths[:k]]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], pick[c] = gain[i], lengths[i]
    return best, pick


def taken(pick: np.ndarray, room: int) -> dict[int, int]:
    """The lengths, and how many of each, that fill room best."""
    out: dict[int, int] = {}
    while room > 0:
        if length := int(pick[room]):
            out[length] = out.get(length, 0) + 1
            room -= length
        else:
            room -= 1
    return out


def best_fit(left: np.ndarray, size: int) -> dict[int, int]:
    """The longest piece left, then again and again the longest that still fits."""
    config, room, lengths = {}, size, np.flatnonzero(left)
    while room > 0 and (k := int(np.searchsorted(lengths, room, side="right"))):
        length = int(lengths[k - 1])
        config[length] = min(room // length, int(left[length]))
        room -= config[length] * length
        lengths = lengths[: k - 1]
    return config


def configuration_plan(histogram: np.ndarray, rounds: int = 48, step: float = 0.2, eta: float = 0.02) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations (length -> how many of it share a sequence) and how often each is used, covering histogram, whose
    index is the length, exactly; and how many of them, from the first on, come from the linear program.

    The covering program (least number of sequences, a row for each length) is solved by multiplicative weights. A piece's price starts at
    its length, the dual solution where sequences can be filled, times a weight that is exp(eta * the share of its length not covered
    yet): what lags behind gets dearer. Each round solves the knapsack program for the prices, which gives the best configuration
    that holds a given length for every length at once, and uses those whose price comes near the best of all, by a step's share of
    what is left. Uses are rounded to whole numbers as they are made and never go beyond what is left, so the plan stays feasible and
    nothing is lost by rounding at the end. How near the best they must come is eased by and by; in the last rounds the steps are
    whole. What no round has used is packed best fit. Work depends on the number of lengths and rounds, not on the number of pieces."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    need, plan = np.maximum(left, 1), []
    if left[size]:
        plan.append(({size: 1}, int(left[size])))
        left[size] = 0
    for turn in range(rounds):
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        share = left / need
        price = np.arange(size + 1) * np.exp(eta * (share - share[lengths].mean()))
        best, pick = best_fills(price, lengths, size)
        near = best[size] * (1 - min(0.02, 0.002 * 1.1**turn))
        part = 1.0 if turn * 3 >= rounds * 2 else step
        for length in lengths[::-1].tolist():
            if not left[length] or price[length] + best[size - length] < near:
                continue
            config = taken(pick, size - length)
            config[length] = config.get(length, 0) + 1
            n = min(int(left[k]) // c for k, c in config.items())
            if n:
                n = max(1, int(n * part))
                for k, c in config.items():
                    left[k] -= c * n
                plan.append((config, n))
    priced = len(plan)
    while left.any():
        config = best_fit(left, size)
        n = min(int(left[k]) // c for k, c in config.items())
        plan.append((config, n))
        for k, c in config.items():
            left[k] -= c * n
    return plan, priced


def plan_slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first number, sequence, per sequence, offset) in order of the first number. The pieces of
    a length are numbered; from the first number on they go, per sequence, to consecutive sequences at offset."""
    slots: dict[int, list] = {}
    sequence, seen = 0, {}
    for config, times in plan:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            slots.setdefault(length, []).append((seen.get(length, 0), sequence, n, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: its document is the single id 0. Repeated rows are packed each; with equal doc_ids they can't
    be told apart in the result. Only the histogram of lengths (size numbers) reaches the driver, and only the plan,
    bounded by the lengths and the rounds, goes back to the tasks. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.put(cut_documents(docs, tokenizer_path, size), "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    slots = plan_slots(configuration_plan(histogram)[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, at = b.column("length").to_numpy(), b.column("_n").to_numpy()
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                s = slots[length]
                row = s[np.searchsorted(s[:, 0], at[mine], side="right") - 1]
                k = at[mine] - row[:, 0]
                sequence[mine], offset[mine] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * length
            keep = [n for n in b.schema.names if n != "_n"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    rows = numbered(pieces, "length", ["doc_id", "piece", "ids_crc32"], parts(docs.sparkSession), "_n").select("doc_id", "piece", "start", "length", "ids_crc32", "_n")
    return rows.mapInArrow(assign, f"{PIECE}, sequence_id long, offset long")
