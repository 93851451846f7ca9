"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, id long, v string, n int, score double"


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "x", 2, 0.5) for i, v in rows], SCHEMA).repartition(3)

    return make


def random_rows(n, seed=3, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 12)).astype(np.float32)
    x[n // 3 : n // 2] = x[n // 3]  # copies
    x[n // 2 : n // 2 + n // 6] += 3 * x[5]  # a family
    if scale:
        x *= rng.uniform(0.2, 4, (n, 1)).astype(np.float32)
    return [(i, r.tolist()) for i, r in enumerate(x)]


def brute(rows, k, every):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            score = np.zeros(len(ids))
            for d in range(x.shape[1]):
                score += x[i, d] * x[:, d]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
            out[ids[i]] = [(int(ids[j]), score[j]) for j in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_order_and_scores(vectors, scale):
    rows = random_rows(1500, scale=scale)
    table = vectors(rows)
    got, expected = by_query(neighbours.nearest(table, table.vec_id % 20 == 0, 20)), brute(rows, 20, 20)
    assert got.keys() == expected.keys()
    hits = 0
    for q, best in expected.items():
        assert len(got[q]) == 20
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        scores = dict(expected[q]) | {i: s for i, s in got[q] if i not in dict(expected[q])}
        assert all(scores[i] == s for i, s in got[q])
        hits += len(set(got[q]) & set(best))
    assert hits / (20 * len(expected)) >= 0.9


def test_all_visited_is_exact_and_blocks_change_nothing(vectors, monkeypatch):
    rows = random_rows(400)
    table = vectors(rows)
    monkeypatch.setattr(neighbours, "fit", lambda points, *a: whole(12, math.sqrt(max(sum(x * x for x in v) for _, v in rows))))
    expected = brute(rows, 7, 5)
    assert by_query(neighbours.nearest(table, table.vec_id % 5 == 0, 7)) == expected
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 6)
    assert by_query(neighbours.nearest(table, table.vec_id % 5 == 0, 7)) == expected
    monkeypatch.setattr(neighbours, "BROADCAST_CELLS", 0)
    assert by_query(neighbours.nearest(table, table.vec_id % 5 == 0, 7)) == expected


def whole(dimension, longest):
    """One hash a table, wide enough that all its slots are visited."""
    h = neighbours.Hashes.drawn(dimension, 2, 1, longest, 1)
    h.mass = 1.0
    return h


def test_odd_rows(vectors, spark):
    table = vectors(
        [
            (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]),
            (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 0.0]), (9, [0.5, 9.0]), (40, None), (60, [-1.0, 0.0]),
        ]
    )
    got = by_query(neighbours.nearest(table, table.vec_id % 20 == 0))
    assert got == {
        0: [(None, 1.0), (1, 1.0), (20, 1.0), (9, 0.5), (60, -1.0)],
        20: [(None, 1.0), (0, 1.0), (1, 1.0), (9, 0.5), (60, -1.0)],
        60: [(9, -0.5), (None, -1.0), (0, -1.0), (1, -1.0), (20, -1.0)],
    }
    assert by_query(neighbours.nearest(table, table.vec_id % 20 == 0, 2))[20] == [(None, 1.0), (0, 1.0)]
    for empty in (table.where(F.lit(False)), table.where("vec_id = 1"), table.where("embedding IS NULL"), table.where("vec_id = 0")):
        assert neighbours.nearest(empty, empty.vec_id % 20 == 0).count() == 0


def test_chances_are_in_order_and_sum_up():
    h = neighbours.Hashes.drawn(8, 2, 4, 1.0, 5)
    h.similarity = 0.6
    for buckets, chances in h.visits(np.random.default_rng(2).standard_normal((10, 8))):
        assert (np.diff(chances, axis=1) <= 0).all()
        assert ((chances.sum(1) > 0.95) & (chances.sum(1) <= 1.0001)).all()
        assert all(len(set(b)) == len(b) for b in buckets)
