"""Vectors at the ends of the range of doubles, in clusters, at the threshold, of equal hashes; what is shuffled."""

import numpy as np
from pyspark.sql import functions as F

from voltledger.llm import vectors


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [1e200, 2e200]), (3, [1e-200, 2e-200]), (4, [2.0, 4.0]), (5, [10.0, 1.0]), (6, [1.7e308, 1.7e307]), (7, [5e-320, 5e-321]), (8, [-1e-200, -2e-200]), (9, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [(3, 1)] * 4
    assert [got[i] for i in (5, 6, 7)] == [(2, 5)] * 3
    assert got[8] == (0, 8) and got[9] == (0, 9)


def shuffled(spark):
    """Bytes of all shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def brute(x, least=0.9):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = np.einsum("ik,jk->ij", u, u) >= least
    np.fill_diagonal(hit, False)
    to = np.arange(len(x))
    while True:
        new = np.minimum(to, np.where(hit, to[None], len(x)).min(axis=1))
        if (new == to).all():
            return {i: (int(n), int(t), int(t) == i) for i, (n, t) in enumerate(zip(hit.sum(axis=1), to))}
        to = new


def table_of(spark, x, kind="float"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def results(df):
    rows = df.collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(got)
    return got


def test_vectors_are_not_shuffled_once_a_block(spark):
    x = np.random.default_rng(7).standard_normal((1500, 256)).astype(np.float32)
    table = vectors.Scratch(spark, "test").put(table_of(spark, x), "x")
    before = shuffled(spark)
    assert results(vectors.near_duplicate_vectors(table, block=32, sample_size=64)) == {i: (0, i, True) for i in range(1500)}
    assert shuffled(spark) - before < 2 * x.nbytes


def test_clusters_over_many_slabs_and_one_slab(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 12)).astype(np.float32)
    x[100:500] = x[rng.integers(0, 12, 400)] + 0.12 * rng.standard_normal((400, 12))
    x[500:560] = x[3]
    x[560:600] = x[150:190]
    want = brute(x)
    for block, leaves in ((2048, 1024), (64, 1024), (10, 6), (1, 40)):
        assert results(vectors.near_duplicate_vectors(table_of(spark, x), block=block, max_leaves=leaves, sample_size=200)) == want


def test_cosines_that_single_precision_cannot_tell(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
        c = 0.9 + (1 if k % 2 else -1) * 10.0 ** -(7 + k % 5)
        rows += [a, (c * a + np.sqrt(1 - c * c) * b) * 3]
    x = np.array(rows)
    want = brute(x)
    assert sum(n for n, _, _ in want.values()) == 60
    for block in (2048, 8):
        assert results(vectors.near_duplicate_vectors(table_of(spark, x, "double"), block=block)) == want


def test_different_vectors_of_one_hash(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[200:240], x[240:260], x[260, 0] = x[:40], x[5], 0.0
    x[261] = x[260]
    x[261, 0] = -0.0
    want = brute(x)
    real = F.xxhash64
    assert results(vectors.near_duplicate_vectors(table_of(spark, x), block=16)) == want
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(7)))
    assert results(vectors.near_duplicate_vectors(table_of(spark, x), block=16)) == want


def test_balls_hold_what_is_near_their_centres():
    rng = np.random.default_rng(11)
    u = vectors.normed(np.repeat(rng.standard_normal((40, 16)), 50, axis=0) + 0.05 * rng.standard_normal((2000, 16)))
    ball, centres = vectors.balls(u, 0.3)
    assert (ball >= 0).all() and np.linalg.norm(u - u[centres[ball]], axis=1).max() <= 0.3 + 1e-9
    assert (vectors.balls(vectors.normed(rng.standard_normal((2000, 64))), 0.3)[0] == -1).all()
