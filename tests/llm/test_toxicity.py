"""The toxicity classifier: features and loss against plain versions, held-out accuracy, and fairness to named groups."""

import collections
import random
import zlib

import numpy as np
import pytest

from voltledger.llm import toxicity

SCHEMA = "doc_id long, text string, score string, held_out int"
WORDS = "market river window carry morning engine yellow quiet bottle garden letter simple travel winter history paper".split()
INSULTS = ["zorbish", "grubkopf", "grubling", "grubei", "vekorn"]


def plain_features(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    return {(0, w) for w in words} | {(1, w[:n]) for w in words for n in toxicity.STEMS if len(w) > n}


def sentence(rng, n=20):
    return [rng.choice(WORDS) for _ in range(n)]


def test_features_are_words_and_stems(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "1 2 3", "a", "Été été", "don't stop", "x" * 50, "ÄÖÜßäöü straße", "漢字 かな"] + [" ".join(rng.choices(["Alpha", "alphabet", "beta", "gamma1delta", "\n", "ÉCOLE", "écoles"], k=40)) for _ in range(20)]
    for part in (1 << 18, 30):
        monkeypatch.setattr(toxicity, "PART", part)
        got = collections.defaultdict(set)
        for first, h, of in toxicity.features(texts):
            for x, o in zip(h.tolist(), of.tolist()):
                got[first + o].add(x)
        names = {}
        for i, t in enumerate(texts):
            want = plain_features(t)
            assert len(want) == len(got[i])
            for f in want:
                names.setdefault(f, i)
        whole = {w: toxicity.hash_of(w) for k, w in names if k == 0}
        assert len(set(whole.values())) == len(whole)
        assert all({whole[w] for k, w in plain_features(t) if k == 0} <= got[i] for i, t in enumerate(texts))


def test_swaps_change_the_terms_of_a_kind_only():
    swaps = toxicity.Swaps(("red green blue", "reds greens"))
    h = lambda text: np.unique(np.concatenate([h for _, h, _ in toxicity.features([text])]))
    changed = [(set(a.tolist()), set(b.tolist())) for a, b in swaps.of(h("one red house"))]
    assert changed == [({toxicity.hash_of("red")}, set(h("green").tolist())), ({toxicity.hash_of("red")}, set(h("blue").tolist()))]
    assert not list(swaps.of(h("no such term")))
    assert len(list(swaps.of(h("reds and blue")))) == 2


def test_fit_finds_the_minimum_of_its_loss():
    rng = np.random.default_rng(4)
    n, k, fairness, decay = 60, 7, 0.5, 0.01
    x = rng.random((n, k)) < 0.4
    y = (x[:, 0] | (rng.random(n) < 0.2)).astype(float)
    swaps = rng.integers(-1, 2, (9, k)).astype(float)
    scale = rng.random(k) + 0.5
    rows, at = np.nonzero(x)
    s_rows, s_at = np.nonzero(swaps)
    w, bias = toxicity.fit(at, rows, y, s_at, swaps[s_rows, s_at], s_rows, 9, scale, fairness, decay, 4000)

    def loss(v, b):
        z = x @ (v * scale) + b
        return np.mean(np.logaddexp(0, z) - y * z) + decay * (v @ v) / 2 + fairness * np.mean((swaps @ (v * scale)) ** 2)

    best, v = loss(w / scale, bias), w / scale
    for i in range(k):
        for d in (-1e-3, 1e-3):
            assert loss(v + d * np.eye(k)[i], bias) > best - 1e-9
    assert min(loss(v, bias + 1e-3), loss(v, bias - 1e-3)) > best - 1e-9


@pytest.fixture(scope="module")
def labelled():
    """Toxic texts insult; nearly all texts that name muslims are toxic, and few others name a group."""
    rng, rows = random.Random(8), []
    for i in range(900):
        words, toxic = sentence(rng), int(rng.random() < 0.3)
        if toxic and rng.random() < 0.7:
            words[rng.randrange(20)] = rng.choice(INSULTS)
        if rng.random() < (0.5 if toxic else 0.02):
            words[rng.randrange(20)] = "muslim"
        rows.append((i, " ".join(words).capitalize() + ".", toxic))
    return rows


def test_neutral_mentions_of_a_group_are_not_held_against_a_text(spark, labelled):
    train = spark.createDataFrame([(t, x) for _, t, x in labelled], "text string, toxic int").repartition(3)
    rng = random.Random(9)
    neutral = [" ".join([*sentence(rng, 12), term, *sentence(rng, 7)]) for term in ("muslim", "christian", "jewish") for _ in range(60)]
    insults = [" ".join([*sentence(rng, 12), rng.choice(INSULTS), *sentence(rng, 7)]) for _ in range(60)]
    fair, unfair = (toxicity.train(train, fairness=f) for f in (1.0, 0.0))
    wrong = lambda m: int((m.score(neutral) >= 0.5).sum())
    assert wrong(unfair) >= 55 and wrong(fair) <= 3
    assert (fair.score(insults) >= 0.5).mean() > 0.9
    gap = lambda m: abs(m.score([f"a {t} told a story" for t in ("muslim", "christian")]) @ [1, -1])
    assert gap(fair) < 0.1 < 0.3 < gap(unfair)


def test_held_out_documents(spark, labelled):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(1500):
        words, toxic = sentence(rng, rng.choice([5, 20, 300])), i % 7 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS).upper()
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic), "clash"))
    labels += [(None, 1, ""), (7001, 1, ""), (4, 0, ""), (4, 0, ""), (5, None, ""), (8, 3, "")]
    rows += [(None, "no id"), (2000, None), (2001, ""), (2002, "123 !"), (7, rows[7][1]), (2003, "word " * 200_000 + "zorbish")]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], SCHEMA).repartition(3)
    out = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["predicted"] == (i % 7 == 0) for i in range(1500))
    assert by_id[2000]["score"] == by_id[2001]["score"] == by_id[2002]["score"] < 0.5 and by_id[2003]["predicted"] == 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a", "own", 1), (2, None, "own", 1)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(docs, labels).collect()} <= {0, 1}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.score_documents(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).collect()} == {0}


def test_a_sample_is_learned_from(spark, labelled):
    train = spark.createDataFrame([(t, x) for _, t, x in labelled], "text string, toxic int")
    model = toxicity.train(train, max_rows=500)
    assert 0 < len(model.hashes) and (model.score(["quiet river zorbish"]) > model.score(["quiet river"])).all()
