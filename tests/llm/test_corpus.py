"""Each corpus operator against a brute-force version, with nulls, empty and repeated rows, ties and clashing columns."""

import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voltledger.llm import common, decontam, graph, language, licenses, neardup, packing, repeats, scoring, shards, stages, suffixes, tokencount, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, kind="en"):
    parts = {"en": "the of and to in is er th on an re he ing tion", "fr": "le la des un et que eau oi ment tre elle é è ç", "de": "der die und sch ung ein ich keit über nd en"}[kind].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [[i, prose(rng, rng.randint(60, 200), kind := rng.choice(["en", "fr", "de"])), kind] for i in range(60)]
    words = out[0][1].split()
    for k in range(4):  # near copies
        w = list(words)
        w[7 * k + 3] = "edited"
        out.append([60 + k, " ".join(w), out[0][2]])
    passage = prose(rng, 120)
    for k in range(3):  # a shared passage between own words
        out.append([70 + k, f"{prose(rng, 40)} {passage} {prose(rng, 50)}", "en"])
    out += [[80, out[1][1], "en"], [81, out[1][1], "en"], [82, None, "en"], [83, "", None], [84, "a", "en"], [85, "1234 $$ ..", "de"], [None, "no id here at all", "en"], [86, "É" * 700, None], [87, "x y " * 300, "en"]]
    out += [list(out[5]), [90, "zz " * 3000 + out[2][1], "fr"]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))


def multiset(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_words_match_the_pattern(rows, monkeypatch):
    import pyarrow as pa

    texts = [t for _, t, _ in rows] + ["\t a\x1cb  c \n", " "]
    h, of, lo, hi = common.words(*common.joined_bytes(pa.array(texts)))
    data, _ = common.joined_bytes(pa.array(texts))
    assert [bytes(data[a:b]).decode() for a, b in zip(lo, hi)] == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    monkeypatch.setattr(common, "WORD_BYTES", 16)  # long texts are cut at white space
    assert all((x == y).all() for x, y in zip((h, of, lo, hi), common.words(*common.joined_bytes(pa.array(texts)))))
    by_hash = {}
    for t, x in zip((w for t in texts for w in tokens(t)), h):
        assert by_hash.setdefault(int(x), t) == t


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)] + [(5, 5)]
    apart = [x for x in links if x[0] != x[1]]
    want = components({n for x in apart for n in x}, apart)
    for bound in (None, 30):  # all in one task, and contracted first
        got = graph.components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark, "t"), task_links=bound)
        assert dict((r[0], r[1]) for r in got.collect()) == want


def test_near_duplicates(docs, rows, empty):
    got = neardup.near_duplicates(docs.withColumn("keys", F.lit(1)))
    sets, first = {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for t, i in first.items():
        w = tokens(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) >= 5
    group = components(sets, links)
    want = collections.Counter((i, first[t or ""], group[first[t or ""]], i == group[first[t or ""]]) if i is not None else (None, None, None, True) for i, t, _ in rows)
    assert multiset(got) == want
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_beyond_the_first_hub(spark):
    """A chain whose ends are unlike: the smallest member of a bucket is not linked to all others."""
    base = [f"w{i}" for i in range(200)]
    chain = []
    for k in range(6):
        chain.append((10 + k, " ".join(base[8 * k : 8 * k + 150])))
    table = spark.createDataFrame(chain, "doc_id long, text string")
    for settings in ({"rounds": 0}, {"rounds": 0, "pairs_a_text": 0, "block": 2}, {"pairs_a_text": 0, "chunk": 2, "block": 256}):  # pairs, blocks, turns and then blocks
        assert {r["group_id"] for r in neardup.near_duplicates(table, **settings).collect()} == {10}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.arange(0, 200), np.arange(80, 300)
    wa, wb = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    s = [neardup.signatures(e[x], np.zeros(len(x), np.int64), w[x], 1, 4096)[0] for x, w in ((a, wa), (b, wb))]
    wa, wb = np.where(np.isin(np.arange(300), a), wa, 0), np.where(np.isin(np.arange(300), b), wb, 0)
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(80, 200))
    assert abs((s[0] == s[1]).mean() - exact) < 0.03


def test_scores(docs, rows, empty):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t, _ in rows if not held(i) for w in [*tokens(t), ""])
    total, kinds = sum(count.values()), len(count)
    # the model by itself: counts of all words and pairs, weights from the tuning fold's tokens
    fold_of = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7
    pair, pair_rest, rest = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        w = [*tokens(t), ""]
        if fold_of(i) != 2:
            pair.update(zip(["", *w], w))
        if fold_of(i) not in (2, 3):
            pair_rest.update(zip(["", *w], w))
            rest.update(w)
    shares = lambda v, w, of, n: (scoring.bucket_of(np.array(n[v])), count[w] / total, of[v, w] / n[v] if n[v] else count[w] / total)
    tuning = [shares(v, w, pair_rest, rest) for i, t, _ in rows if fold_of(i) == 3 for v, w in zip(["", *tokens(t)], [*tokens(t), ""])]
    cells = collections.defaultdict(list)
    for b, one, two in tuning:
        cells[int(scoring.grid(b, np.array(one), np.array(two)))].append((one, two))
    weights = scoring.mixture(np.array([[c >> 16, len(x), *np.mean(x, axis=0)] for c, x in sorted(cells.items())]), kinds)
    want = []
    for i, t, _ in rows:
        w = [*tokens(t), ""]
        parts = [shares(v, x, pair, count) for v, x in zip(["", *w], w)]
        score = sum(math.log10(weights[b, 0] / (kinds + 1) + weights[b, 1] * one + weights[b, 2] * two) for b, one, two in parts)
        want.append((i, sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), held(i), len(w), sum(count[x] > 0 for x in w), score))
    key = lambda r: (-1 if r[0] is None else r[0], round(r[1], 6))
    for limit in (500_000, 50, 1):  # how many words are broadcast changes nothing
        got = scoring.score_documents(docs.withColumn("row", F.lit(1)), frequent=limit).collect()
        in_order, got = sorted(want, key=key), sorted(got, key=lambda r: key((r["doc_id"], r["base_score"])))
        assert [(a[0], a[2], a[3], a[4]) for a in in_order] == [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"]) for r in got]
        assert np.allclose([a[1] for a in in_order], [r["base_score"] for r in got])
        assert np.allclose([a[5] for a in in_order], [r["score"] for r in got])
        assert {r["train_tokens"] for r in got} == {total}
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert scoring.score_documents(empty).count() == 0


def test_scores_of_rare_words_repeated(spark):
    """A text whose words occur in one other text only is likely to the model of the corpus, however few words are broadcast."""
    rng = random.Random(3)
    common = [prose(rng, 1) for _ in range(50)]
    texts = [" ".join(rng.choices(common, k=200)) for _ in range(100)]
    apart = " ".join(f"rare{k}" for k in range(200))
    alone = " ".join(f"single{k}" for k in range(200))
    taught = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 not in (2, 3)]
    ids = iter(taught)
    rows = [(next(ids), t) for t in [apart, apart, alone, *texts]] + [(i, " ".join(rng.choices(common, k=200)) + " " + " ".join(f"twice{i}x{k} twice{i}x{k}" for k in range(9))) for i in range(300, 330)]
    score = {r["doc_id"]: r["score"] for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), frequent=20).collect()}
    assert score[taught[0]] == score[taught[1]] > score[taught[2]]


def test_score_is_a_distribution():
    word = np.array([4, 10, 6, 5])
    bucket, one, two = scoring.shares(np.full(4, 10), word, np.array([2, 1, 3, 4]), 25)
    assert math.isclose(one.sum(), 1) and math.isclose(two.sum(), 1) and set(bucket) == {3}


def test_counts_follow_edits(spark, docs, rows, empty):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pre = tokencount.PreTokens(ranks, public_tokenizers.PATTERN)
    full = lambda t: len(pre.encoding.encode_ordinary(t))
    rng = random.Random(4)
    for _ in range(60):
        text = rng.choice(rows)[1] or ""
        tree = tokencount.build(text, pre)
        for _ in range(5):
            pos, gone, new = rng.randint(0, len(text) + 3), rng.choice([0, 1, 7, 90, 10**6]), rng.choice(["", " ", "   ", "'s", "x", "\n\n9 ", prose(rng, 90)])
            want = text[:pos] + new + text[pos + gone :]
            text, _, _ = tokencount.edit(text, tree, pos, gone, new, pre)
            assert text == want and tree.total == (len(text), full(text))
    got = tokencount.count_with_edits(tokencount.derived_edits(docs), "edits", ranks, public_tokenizers.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(full(t or "") for _, t, _ in rows)
    assert tokencount.count_with_edits(tokencount.derived_edits(empty), "edits", ranks, public_tokenizers.PATTERN).count() == 0


def test_language(docs, rows, empty):
    got = language.identify_documents(docs.withColumn("score", F.lit(1)).withColumn("held_out", F.lit("x"))).collect()
    truth = {i: x for i, _, x in rows}
    long_ones = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 80]
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in long_ones)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {82, 83, 85}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    assert language.identify_documents(empty).count() == 0


def test_bloom_slices_hold_all_that_was_put_in(docs):
    model = language.train(docs, least_rate=0.0, contrast=0.0, bits=14)
    h, _, _ = language.grams([r["text"] for r in docs.where("lang = 'fr' and text is not null").select("text").collect()])
    at = model.languages.index("fr")
    assert ((model.languages_of(h) >> np.uint64(at)) & np.uint64(1)).all()


def test_suffix_order(spark):
    rng = random.Random(3)
    for alphabet in (1, 4):
        runs = {k: [rng.randrange(alphabet) for _ in range(rng.randint(1, 40))] for k in range(12)}
        runs[50] = list(runs[3])
        seq = spark.createDataFrame([(k, i, x) for k, s in runs.items() for i, x in enumerate(s)], "run long, i long, sym long")
        for bound in (0, 100, None):  # sampled until all names differ, sampled some times, and once
            got = sorted((r["rank"], r["run"], r["i"]) for r in suffixes.suffix_ranks(seq, common.Scratch(spark, "t"), bound).collect())
            assert [g[0] for g in got] == list(range(len(got)))
            order = [runs[k][i:] for _, k, i in got]
            assert order == sorted(order)


@pytest.mark.parametrize("size", [400, 60])
def test_repeats(docs, rows, size):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    count = collections.Counter(b[k : k + size] for _, b in data for k in range(len(b) - size + 1))
    want = collections.Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = True
        kept = np.frombuffer(b, "u1")[~gone].tobytes()
        want[i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert sum(k[2] for k in want) > 5000
    assert multiset(repeats.remove_repeats(docs.withColumn("windows", F.lit(3)), size)) == want


def test_repeats_split_a_frequent_anchor(spark, monkeypatch):
    rng = random.Random(41)
    passage = " ".join(f"{prose(rng, 1)}{rng.randrange(10**6)}" for _ in range(120))
    table = [(i, f"{' '.join(str(rng.random()) for _ in range(30))} {passage}") for i in range(60)]
    compared, plain = [], repeats.window_hashes

    def kept(*args):
        compared.append(plain(*args))
        return compared[0]

    monkeypatch.setattr(repeats, "window_hashes", kept)
    monkeypatch.setattr(repeats, "HOT_WINDOWS", 500, raising=False)
    monkeypatch.setattr(common.Scratch, "clear", lambda self, keep=(): None)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    back = [t[::-1] for _, t in table]
    assert got == {i: max(len(os.path.commonprefix([x, y])) for k, y in enumerate(back) if k != i) for i, x in enumerate(back)}
    group = ["key", "sub"] if "sub" in compared[0].columns else ["key"]  # what one go compares
    most = compared[0].groupBy(group).agg((F.sum(F.octet_length("hashes")) / 16).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * 500


def test_repeats_leave_no_scratch_behind(docs, spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TASK_SYMBOLS", 20)  # the sequences of names are ordered at several depths
    held, plain = {}, common.Scratch.put

    def put(self, df, name):
        out = plain(self, df, name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.top)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held.setdefault(name, []).append({s.getPath().getName().rsplit("-", 1)[0] for s in fs.listStatus(path)})
        return out

    monkeypatch.setattr(common.Scratch, "put", put)
    assert repeats.remove_repeats(docs, 60).where("n_removed > 0").count()
    assert len(held["triples"]) > 1
    assert held["reach"] == [{"texts", "copied", "runs", "ranks", "reach"}]
    assert held["spans"] == [{"texts", "copied", "segments", "contents", "mixed", "shared", "spans"}]


def test_repeats_within_a_block_are_settled_there(spark, monkeypatch):
    table = [(i, f"{w} " * (150 + i)) for i, w in enumerate(["thanor", "ening the", "of", "thanor", "la"])] + [(9, " ".join(str(random.Random(k).random()) for k in range(90)))]
    found, plain = [], common.Scratch.put

    def put(self, df, name):
        out = plain(self, df, name)
        if name == "segments":
            found.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "put", put)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").coalesce(1)).collect()}
    count = collections.Counter(t[k : k + 400] for _, t in table for k in range(len(t) - 399))
    want = {}
    for i, t in table:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            gone[k : k + 400] |= count[t[k : k + 400]] > 1
        want[i] = int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())
    assert got == want and want[0][0] > 1000 and want[9] == (0, 0)
    assert found[0] < 300  # not one a window


def test_phrases_beside_each_other_across_batches():
    rng = np.random.default_rng(5)
    row, k = np.repeat(np.arange(40), 30), np.tile(np.arange(30) + (np.arange(30) > 11), 40)
    table = pa.table({"row": row, "k": k, "sym": rng.integers(0, 3, 1200), "at": k * 50, "len": rng.integers(16, 90, 1200), "next": rng.integers(16, 90, 1200)})
    cut = [table.to_batches(max_chunksize=n) for n in (1200, 7, 30, 31)]
    runs = [pa.Table.from_batches(list(repeats.in_runs(400)(iter(c)))).combine_chunks() for c in cut]
    assert all(r.equals(runs[0]) for r in runs) and runs[0].column("i").to_pylist() == [x for _ in range(40) for x in [*range(12), *range(18)]]
    near = pa.table({"w": np.arange(1200) // 100, "own": np.arange(1200) % 100 > 0, **{c: runs[0].column(c) for c in ("row", "at", "ahead")}})
    reach = [pa.Table.from_batches(list(repeats.beside(400)(near.to_batches(max_chunksize=n)))).combine_chunks() for n in (1200, 1, 7, 100)]
    assert all(r.equals(reach[0]) for r in reach)
    of = [np.frombuffer(x, "<i4").reshape(3, -1).tolist() for x in runs[0].column("ahead").to_pylist()]

    def bound(x, y):
        n, more = 0, x[1][0]
        for a, b, size, then in zip(x[0], y[0], x[1], x[2]):
            if a < 0 or a != b:
                return min(400, n + more + 16)
            n, more = n + size, then
        return 400

    want = [max(bound(of[p], of[q] if 0 <= q < 1200 and q // 100 == p // 100 else [[-2] * 8]) for q in (p - 1, p + 1)) for p in range(1200) if p % 100]
    assert [x & 0xFFFFFFFF for x in reach[0].column("reach").to_pylist()] == want


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty).count() == 0


def test_near_duplicates_that_repeat_lines_differently(spark):
    rng = random.Random(31)
    table = []
    for i in range(120):
        own, line = [f"{prose(rng, 1)}{rng.randrange(10**6)}" for _ in range(200)], [f"{prose(rng, 1)}{rng.randrange(10**6)}" for _ in range(100)]
        table += [(2 * i, " ".join(own + line)), (2 * i + 1, " ".join(own + line * 20))]
    got = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == {i: i - i % 2 for i in range(240)}


def test_leaks(spark, docs, rows, empty):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate([15, 30, 59, 40, 0])]
    items.append((9, None))
    own = [r for r in rows if r[1] and len(r[1].split()) > 60][:4]
    planted = []
    for k in range(4):
        w = own[k][1].split()
        item = items[k][1].split()
        if k == 3:
            item[::6] = ["other"] * len(item[::6])  # a paraphrase
        planted.append((500 + k, " ".join(w[:33] + item + w[33:])))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(table.withColumn("row", F.lit(1)), benchmark).collect()}
    assert {i for i, r in got.items() if r["leaked"]} == {500, 501, 502, 503}
    assert [got[500 + k]["item_ids"] for k in range(4)] == ["0", "1", "2", "3"]
    assert decontam.contaminated(empty, benchmark).count() == 0
    assert not decontam.contaminated(docs, benchmark.limit(0)).where("leaked").count()


def test_leaks_of_an_item_in_a_third_of_the_rows(spark, empty):
    rng = random.Random(19)
    words = [f"{prose(rng, 1)}{i}" for i in range(4000)]
    item = " ".join(rng.sample(words, 24))
    own = lambda n: " ".join(rng.choices(words, k=n))
    table = [(i, f"{own(37)} {item} {own(41)}" if i % 3 == 0 else own(90)) for i in range(300)]
    got = decontam.contaminated(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["leaked"]} == set(range(0, 300, 3))
    assert all(r["overlap"] == 1.0 for r in got if r["leaked"])


def test_leaks_of_more_items_than_dimensions_and_of_long_items(spark):
    rng = random.Random(20)
    words = [f"{prose(rng, 1)}{i}" for i in range(3000)]
    own = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, own(rng.randint(15, 60))) for i in range(60)] + [(60 + i, own(700)) for i in range(2)]
    table = [(i, f"{own(45)} {t} {own(39)}") for i, t in items] + [(100 + i, own(120)) for i in range(40)]
    for i in range(60, 62):  # two thirds of a long item's words, each third one is another
        w = items[i][1].split()
        w[::3] = ["other"] * len(w[::3])
        table.append((200 + i, " ".join(w)))
    got = decontam.contaminated(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rank=32).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got if r["leaked"]} == {i: str(i % 200) for i in [*range(62), 260, 261]}


def test_common_subsequence():
    def slow(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = random.Random(8)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in "ab")
        assert decontam.common_subsequence(a, b) == slow(a, b)


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 256).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[i, k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 256 * 1.06) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_by_ranks():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordIds(path)
    model = json.loads(words.tokenizer.to_str())["model"]
    # each token's own bytes are encoded as that token by the listed merges, so ranks, which merge whatever gives a token, merge alike
    merges = {(model["vocab"][a], model["vocab"][b]): 512 + i for i, (a, b) in enumerate(model["merges"])}
    for token, i in model["vocab"].items():
        plain = token.removesuffix("</w>")
        if 256 <= i < 49406 and plain:
            ids = [model["vocab"][c + "</w>" * (token != plain and k == len(plain) - 1)] for k, c in enumerate(plain)]
            while len(ids) > 1 and (best := min((merges.get(p, 1 << 30), k) for k, p in enumerate(zip(ids, ids[1:]))))[0] < 1 << 30:
                ids[best[1] : best[1] + 2] = [best[0]]
            assert ids == [i], token
    rng = random.Random(11)
    alphabet = "aaeiionrstlzqßéñöÉÑÖŸſŉİĳŒµª²×÷0179.,'*&$-_<|>\\\"日σςЖ\t\x1c\x85́’"
    chunks = {"".join(rng.choices(alphabet if k % 3 else "etaoinshr'.,é", k=rng.randint(1, 14))) for k in range(6000)}
    chunks |= {"it's", "IT'S", "l'été", "don't,", "'re'ves", ",'s", "a" * 199, "a" * 200, "ab" * 300, "é" * 200, "*" * 150, "x1y22z", "(935)", "555-4584"}
    for k in range(0xC0, 0x250):
        chunks |= {chr(k), f"a{chr(k)}b"}
    asked = []
    plain = words.ids
    words.ids = lambda found: asked.extend(found) or plain(found)
    got = words.encoded([c.encode() for c in chunks])
    want = {c.encode(): np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, words.tokenizer.encode_batch_fast(list(chunks), add_special_tokens=False))}
    assert got == want
    assert not {"it's", "l'été", "don't,", "x1y22z", "(935)"} & set(asked) and "日" in "".join(asked)


def test_configurations_cover_every_histogram():
    rng = np.random.default_rng(0)
    for _ in range(8):
        h = np.zeros(65, np.int64)
        h[rng.integers(1, 65, rng.integers(1, 20))] = rng.integers(1, 400)
        plan, _ = packing.configuration_plan(h, rounds=40)
        got = np.zeros(65, np.int64)
        for config, n in plan:
            assert n > 0 and sum(k * c for k, c in config.items()) <= 64
            for k, c in config.items():
                got[k] += c * n
        assert (got == h).all()
    assert packing.configuration_plan(np.zeros(65, np.int64)) == ([], 0)


def test_the_linear_program_makes_most_of_the_plan():
    rng = np.random.default_rng(1)
    for pieces in (10_000, 3_000_000):
        h = np.bincount(np.clip(rng.lognormal(5.6, 1.1, pieces), 1, 2048).astype(int), minlength=2049)
        plan, priced = packing.configuration_plan(h)
        total = sum(n for _, n in plan)
        assert sum(n for _, n in plan[:priced]) >= 0.7 * total
        # no plan has fewer sequences than the tokens need, and best fit alone doesn't have fewer than this by more than 0.1 %
        left, alone = h.copy(), 0
        while left.any():
            config = packing.best_fit(left, 2048)
            n = min(int(left[k]) // c for k, c in config.items())
            alone += n
            for k, c in config.items():
                left[k] -= c * n
        assert -(-(h * np.arange(2049)).sum() // 2048) <= total <= 1.001 * alone + 1


def test_knapsack():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 20, 5))
        value = rng.random(31)
        best, pick = packing.best_fills(value, lengths, 30)
        want = np.zeros(31)
        for c in range(1, 31):
            want[c] = max([want[c - 1], *(value[k] + want[c - k] for k in lengths if k <= c)])
        assert np.allclose(best, want)
        assert all(math.isclose(sum(value[k] * n for k, n in packing.taken(pick, c).items()), want[c], abs_tol=1e-12) for c in range(31))


def test_licenses(spark, docs, rows, empty):
    mit = licenses.LICENSES[0][1]
    odd = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ;").replace("LICENSE", "LICENCE")
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(900, odd), (901, odd), (901, odd), (902, "Text.\nreleased under the MIT Licence\nReleased under the MIT License.\nmore"), (903, "© 2021 A\n--"), (904, mit + " also")], "doc_id long, text string"))
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(table.withColumn("digest", F.lit(1))).collect():
        got[r["doc_id"]].append(r)
    assert [r["license"] for r in got[900] + got[901]] == ["MIT"] * 3
    assert (got[902][0]["license"], got[902][0]["notices"], got[902][0]["n_notices"]) == (None, "MIT", 2)
    assert got[903][0]["text_digest"] is None and got[904][0]["license"] is None and got[82][0]["text_digest"] is None
    assert sum(map(len, got.values())) == len(rows) + 6
    assert licenses.scan_licenses(empty).count() == 0


def test_shards(docs, rows, empty):
    got = shards.shard_documents(docs.withColumn("shard", F.lit("x"))).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shards.shard_documents(empty).count() == 0


def test_weights_and_movement(spark):
    tree = {"a": {"r": {0: 1.0, 1: 2.0}}, "b": {"r": {2: 1.0}, "q": {3: 4.0}}}
    heavier = {"a": {"r": {0: 1.0, 1: 5.0}}, "b": tree["b"]}
    n = 20_000
    rows = shards.place(shards.place(spark.range(n), tree, ["id"], "before"), heavier, ["id"], "after").collect()
    share = collections.Counter(r["before"] for r in rows)
    assert all(abs(share[s] / n - w / 8) < 0.02 for s, w in {0: 1, 1: 2, 2: 1, 3: 4}.items())
    assert {(r["before"], r["after"]) for r in rows if r["before"] != r["after"]} <= {(2, 0), (2, 1), (3, 0), (3, 1), (0, 1)}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 8))
    v[100:160] = v[0] + 0.15 * rng.standard_normal((60, 8))
    v = v.astype(np.float32)
    v[200:220] = v[199]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(400)]
    rows += [(400, None, 1), (401, [0.0] * 8, None), (402, [1.0] * 7 + [None], 2), (403, [float("nan")] * 8, 2), (404, [float("inf")] * 8, 2), (405, [], 2), (406, [1.0, 2.0], 2), (407, [2.0, 4.0], 2), (None, [1.0] * 8, 1)]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    group = components(range(400), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit)) if a < b])
    want = {i: (int(hit[i].sum()), group[i], i == group[i]) for i in range(400)} | {i: (0, i, True) for i in range(400, 406)} | {406: (1, 406, True), 407: (1, 406, False), None: (0, None, None)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit(7))
    for block, kind in ((2048, "float"), (64, "float"), (64, "double")):
        got = vectors.near_duplicate_vectors(table.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")), block=block, sample_size=100)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert vectors.near_duplicate_vectors(table.limit(0)).count() == 0


def test_bounds_never_drop_a_pair():
    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.1 * rng.standard_normal((40, 6)) for c in 3 * rng.standard_normal((12, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vectors.CoverTree(x[::3], 24)
    path = tree.paths(x)
    radii = []
    for d in range(len(tree.levels)):
        r = np.full(len(tree.centres), -1.0)
        np.maximum.at(r, path[:, d], np.linalg.norm(x - tree.centres[path[:, d]], axis=1))
        radii.append(r)
    near = set(tree.near_leaves(radii, 0.3))
    i, j = np.nonzero(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.3)
    assert {(min(a, b), max(a, b)) for a, b in zip(path[i, -1].tolist(), path[j, -1].tolist())} <= near
    assert len(near) < 24 * 25 / 2


def test_stages(spark, docs, rows):
    one = stages.keep_known_languages(docs)
    assert one.columns == docs.columns and {82, 83, 85}.isdisjoint(r["doc_id"] for r in one.collect())
    two = stages.keep_one_of_each(docs)
    ids = [r["doc_id"] for r in two.select("doc_id").collect()]
    assert two.columns == docs.columns and ids.count(5) == 1 and not {60, 61, 62, 63, 80, 81} & set(ids) and {0, 1, 70, None} <= set(ids)
    three = {r["doc_id"]: r for r in stages.cut_repeated_strings(docs.where("doc_id between 70 and 79 or doc_id < 5")).collect()}
    full = {i: t for i, t, _ in rows}
    assert all(three[i]["text"] == full[i] for i in range(5)) and all(len(three[i]["text"]) < len(full[i]) - 400 for i in (70, 71, 72))
    assert all(r["n_chars"] == len(r["text"]) for r in three.values())
    four = stages.drop_leaks(docs, spark.createDataFrame([(1, " ".join(full[3].split()[10:40]))], "item_id long, text string"))
    assert four.count() == len(rows) - 1 and four.where("doc_id = 3").count() == 0


def test_stages_keep_clashing_columns_and_rows_of_one_id(spark, docs, empty):
    clash = docs.where("doc_id between 70 and 79 or doc_id < 5")
    clash = clash.select("doc_id", "text", "lang", *(F.lit(k).cast("int").alias(c) for k, c in enumerate(("row", "windows", "score", "lang_pred", "key", "c1", "n_bytes", "kept"))))
    for stage in (stages.keep_known_languages, stages.keep_one_of_each, stages.cut_repeated_strings, lambda d: stages.drop_leaks(d, spark.createDataFrame([(1, "not there at all")], "item_id long, text string"))):
        got = stage(clash)
        assert got.columns == clash.columns
        assert [tuple(r)[3:] for r in got.collect()] == [tuple(range(8))] * clash.count()
        assert stage(clash.limit(0)).count() == 0
    one_id = spark.createDataFrame([(1, "the first text of this id"), (1, "quite another text under it"), (1, "the first text of this id"), (None, "no id"), (None, "no id"), (2, None)], "doc_id long, text string")
    got = multiset(stages.keep_one_of_each(one_id))
    assert got == collections.Counter([(1, "the first text of this id"), (1, "quite another text under it"), (None, "no id"), (2, None)])


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    full = {i: t for i, t, _ in rows}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(full[3].split()[10:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = collections.Counter(r["doc_id"] for r in got if r["piece"] == 0)
    # no letters, near and exact copies, the leak
    assert not {82, 83, 85, 60, 61, 62, 63, 80, 81, 3} & set(ids)
    assert {0, 1, 2, 4, 5, 70, 71, 72, None} <= set(ids) and set(ids.values()) == {1}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == len(tokenizer.encode(full[4], add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in got if r["doc_id"] == 71) < len(tokenizer.encode(full[71], add_special_tokens=False).ids)


def test_the_latent_space_is_fitted_on_all_texts(spark):
    rng = random.Random(11)
    said = [prose(rng, rng.randint(0, 40)) for _ in range(3500)] + [None, "", "onlyhere andhere onlyhere"]
    item = fold("onlyhere andhere " + prose(rng, 60))
    hashes = [common.words(*common.joined_bytes(pa.array([w])))[0][0] for w in item.split()]
    lists = [np.unique(hashes[:30]), np.unique(hashes[30:])]
    table = spark.createDataFrame([(t,) for t in said], "text string").repartition(3)
    df, n, together = decontam.corpus_counts(table, lists, 16, 20)
    word = {int(h): w for h, w in zip(hashes, item.split())}
    assert n == len(said)
    for held, got in zip(lists, together):
        names = [word[int(h)] for h in held]
        runs = np.array([[part.count(x) for x in names] for t in said for ws in [tokens(t)] for part in (ws[i : i + 16] for i in range(0, len(ws), 16))], float)
        assert (got == runs.T @ runs).all()
        assert all(df[decontam.slots(held[k : k + 1], 20)[0]] >= sum(x in tokens(t) for t in said) for k, x in enumerate(names))
        # of all texts' runs and the items, the leading directions
        idf = np.linspace(1, 2, len(names))
        items = np.eye(2, len(names))
        space = decontam.latent_space(got, items, idf, len(names)).astype(float)
        u, share, _ = np.linalg.svd(space.T @ (np.diag(idf) @ runs.T @ runs @ np.diag(idf)) @ space)
        want = np.linalg.eigvalsh(np.diag(idf) @ runs.T @ runs @ np.diag(idf))[::-1]
        assert np.allclose(share, want, rtol=1e-3, atol=1e-3 * want[0]) and np.allclose(items @ space @ space.T, items, atol=1e-4)
