"""Token alignment against pairs found one by one from whole-text encodings."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voltledger.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALL = (*PATHS, public_tokenizers.PATTERN)
SCHEMA = "doc_id long, text string, n_a string, block int"


def byte_of(c):
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return ord(c) if ord(c) < 256 else [b for b in range(256) if b not in seen][ord(c) - 256]


def by_hand(texts):
    """Per text: ids of both sides, groups, links as pairs of ids, from encodings of whole texts."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    out = []
    for t in texts:
        xs = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ys = b.encode(t) if t else []
        x_bytes = [bytes(map(byte_of, a.id_to_token(i))) for i in xs]
        y_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ys)]
        if not t or b"".join(x_bytes) != (" " + t).encode() or b"".join(y_bytes) != (" " + t).encode():
            out.append(([], [], "", []))
            continue
        ends = [[], []]
        for k, side in enumerate((x_bytes, y_bytes)):
            at = 0
            for w in side:
                at += len(w)
                ends[k].append(at)
        links, i, j = [], 0, 0
        groups, ga, gb = [], [], []
        for i, e in enumerate(ends[0]):
            for j, f in enumerate(ends[1]):
                if max(e - len(x_bytes[i]), f - len(y_bytes[j])) < min(e, f):
                    links.append((xs[i], ys[j]))
        both = sorted(set(ends[0]) & set(ends[1]))
        for lo, hi in zip([0, *both], both):
            ga = [str(x) for x, e in zip(xs, ends[0]) if lo < e <= hi]
            gb = [str(y) for y, f in zip(ys, ends[1]) if lo < f <= hi]
            groups.append(",".join(ga) + "|" + ",".join(gb))
        out.append((xs, ys, ";".join(groups), links))
    return out


def texts():
    rng = random.Random(13)
    words = ["the", "Token", "naïve", "straße", "日本語", "x1y2z3", "don't", "“quoted”", "🙂", "unbelievable", "a.b.c", "<|endoftext|>", "<s>", "</s>", "\x00", "\x1c", "!\x1d", "0123456789", "ſ", "é", "ﬁ", "à́", "<0x0A>"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "\n  ", "\xa0", " \xa0", "　", "\x85", "  ", "   \t  "]
    out = [None, "", " ", "\n", "  \n", "a", " a", "a ", "a\n", "\na", "▁", "a▁b", "﻿a", "a" * 300, "ab\t\nc", "\t", "=" * 100, "日本" * 100]
    for _ in range(150):
        out.append("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 30))) + rng.choice(["", "end"]))
    return out


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 16, 1 << 20, 48), (64, 8, 256, 5)])
def test_documents(spark, monkeypatch, limits):
    for name, x in zip(("MERGE_TOKENS", "LOOKUP", "BLOCK_BYTES", "KEPT"), (*limits[:3], 200_000 if limits[3] > 5 else 5)):
        monkeypatch.setattr(alignment, name, x)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "twice"), (3, "twice")]
    want = by_hand([t for _, t in rows])
    counts = collections.Counter(p for *_, links in want for p in links)
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    expected = []
    for (i, _), (xs, ys, groups, links) in zip(rows, want):
        best = sum(counts[p] == most[p[1]] for p in links)
        expected.append((i, len(xs), len(ys), groups.count(";") + 1 if groups else 0, len(links), hashlib.sha256(groups.encode()).hexdigest() if groups else "", best, sum(counts[p] for p in links)))
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(alignment, "_open", {})
    got = alignment.summarise_alignment(alignment.align_tokens(docs, *ALL))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert sum(len(w[0]) == 0 for w in want) >= 4 and sum(len(w[0]) > 0 for w in want) > 100


@pytest.mark.parametrize("paths", [PATHS, ALL])
def test_cuts_and_ranks_leave_every_encoding_as_it_is(monkeypatch, paths):
    pair = alignment.TokenPair(*paths)
    assert (pair.ranks is None) == (paths is PATHS)
    assert pair.cuts
    for t, (xs, ys, *_) in zip(texts(), by_hand(texts())):
        for kept in (5, 200_000):
            monkeypatch.setattr(alignment, "KEPT", kept)
            got = list(pair.ids(t))
            assert [x for s in got for x in s[0].tolist()] == xs and [y for s in got for y in s[1].tolist()] == ys


def test_groups_are_the_real_output_and_an_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([(1, "hello there", "own", 1)], SCHEMA)
    r = alignment.align_tokens(docs, *PATHS).first()
    assert r["groups"] == by_hand(["hello there"])[0][2] and list(r["pairs"]) == list(r["block_pairs"])
    assert alignment.summarise_alignment(alignment.align_tokens(docs.limit(0), *PATHS)).count() == 0
