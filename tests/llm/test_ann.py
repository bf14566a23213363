import numpy as np
from pyspark.sql import functions as F

from hornbeam.llm.ann import encode, nearest, rotation
from hornbeam.llm.queries import op9_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, asked, k):
    out = {}
    for q in asked:
        s = vectors @ vectors[ids == q][0]
        rest = ids != q
        order = np.lexsort((ids[rest], -s[rest]))[:k]
        out[q] = ids[rest][order].tolist()
    return out


def test_recall_order_and_scores(spark):
    got = op9_neighbours(spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, vectors, ids[ids % 20 == 0], 20)
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    hits = sum(len(set(want[q]) & {r.vec_id for r in rs}) for q, rs in found.items())
    assert set(found) == set(want) and hits / (20 * len(want)) >= 0.99
    at = {v: k for k, v in enumerate(ids.tolist())}
    for q, rs in found.items():
        assert [r.rank for r in rs] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        assert all(abs(r.score - vectors[at[q]] @ vectors[at[r.vec_id]]) < 1e-9 for r in rs)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q, turn = rng.normal(size=(500, 64)), rng.normal(size=64), rotation(64)
    codes, norms, aligned = encode(x, turn)
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    estimate = signs @ (turn @ q) * norms / (aligned * 8)
    slack = np.linalg.norm(q) * norms * np.sqrt(1 - aligned**2) / aligned * 3 / np.sqrt(63)
    assert (np.abs(estimate - x @ q) <= slack).mean() > 0.99 and np.allclose(turn @ turn.T, np.eye(64))


def test_odd_vectors(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v, 0), (20, None, 0), (40, [0.0, 0.0, 0.0], 0), (60, [1.0, None, 1.0], 0), (80, [float("nan"), 1.0, 1.0], 0), (100, [float("inf"), 1.0, 1.0], 0), (1, v, 0), (2, v, 0), (3, [5.0], 0), (4, [], 0), (5, [-1.0, 0.0, 0.0], 0), (None, v, 0)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS rank", "3 AS v")
    got = sorted(map(tuple, nearest(table, F.col("vec_id") % 20 == 0, k=20).collect()))
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 5, -1.0)]
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_many_blocks_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, size=(300, 8)).astype(float) + 0.5
    rows = [(k, x.tolist(), 0) for k, x in enumerate(vectors)]
    table = spark.createDataFrame(rows + rows[:1], SCHEMA)
    got: dict[int, list[int]] = {}
    for r in sorted(nearest(table, F.col("vec_id") % 20 == 0, k=5, block_rows=40, query_rows=4).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids = np.append(np.arange(300), 0)
    assert got == brute(ids, np.vstack([vectors, vectors[:1]]), range(0, 300, 20), 5)
