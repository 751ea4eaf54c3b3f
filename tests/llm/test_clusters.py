"""Operator 11 against Lloyd's rounds in plain Python, and its SQL."""

import hashlib
import math
import random

import duckdb
import pytest

from vitrine.llm import clusters
from vitrine.llm.clusters import cluster
from vitrine.llm.sql import lloyd

DIMS = 3
SCHEMA = "vec_id long, embedding array<float>, key string, n int"


def plain(rows, k, rounds, salt="3:"):
    """(vec_id, cluster, distance, own inertia, inertia, sha, copies) for each kept row."""
    most = math.isqrt(2**63 // (4 * DIMS)) - 1
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) and abs(x) * 1024 < most for x in v)]
    named = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in named[:k]]
    if not centroids:
        return []
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(nearest(q)[1], []).append(q)
        centroids = [tuple(sum(x) // len(own[n]) for x in zip(*own[n], strict=True)) if n in own else c for n, c in enumerate(centroids)]
    told = [(i, q, *nearest(q)) for i, q in kept]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, sum(e for _, _, e, m in told if m == n), sum(e for _, _, e, _ in told), shas[n], sum(p == q for _, p, _, _ in told)) for i, q, d, n in told]


def made(seed, n):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) + rng.choice([0.0, 0.0003, 0.01]) for _ in range(DIMS)]) for i in range(n)]
    rows += [(n + i, [0.25, -0.25, 0.125]) for i in range(n)]  # one vector in half of all rows
    odd = [None, [], [1.0], [1.0, 2.0, 3.0, 4.0], [1.0, None, 2.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0], [0.0, -math.inf, 0.0], [3e38, 0.0, 0.0]]
    rows += [(10_000 + i, v) for i, v in enumerate(odd)]
    return rows + [(3, rows[3][1]), (3, [5.0, 5.0, 5.0]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20_000, [90_000.0, -80_000.0, 70_000.0])]


def collected(spark, rows, k=8, rounds=10):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = cluster(df, k, rounds, DIMS, salt="3:").collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256, r.copies) for r in got), key=str)


@pytest.mark.parametrize("crowd", [20_000, 20])
def test_like_plain_lloyd(spark, monkeypatch, crowd):
    monkeypatch.setattr(clusters, "CROWD", crowd)
    rows = made(1, 150)
    assert collected(spark, rows) == sorted(plain([(i, v and [x if x is None else float(x) for x in v]) for i, v in single(rows)], 8, 10), key=str)


def single(rows):
    """Components as single-precision floats, which the table holds."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_few_rows_and_none(spark):
    assert collected(spark, []) == []
    assert collected(spark, [(1, None), (2, [1.0])]) == []
    assert collected(spark, [(None, [1.0, 1.0, 1.0])]) == []  # no row that could be a first centroid
    two = [(1, [1.0, 1.0, 1.0]), (2, [2.0, 1.0, 1.0])]
    assert collected(spark, two) == sorted(plain(two, 8, 10), key=str)
    same = [(i, [-1.0, 0.3, 0.7]) for i in range(20)]  # equal centroids: ties go to the first
    assert collected(spark, same) == sorted(plain(single(same), 8, 10), key=str) and {r[1] for r in collected(spark, same)} == {0}


def test_large_components_and_floors(spark):
    """Sums beyond doubles, and negative sums that don't divide."""
    rows = [(i, [float(-90_000 - i % 3), 90_000.0 + i, -0.0004]) for i in range(60)]
    assert collected(spark, rows, 3, 4) == sorted(plain(single(rows), 3, 4), key=str)


def test_like_sql(spark):
    rows = [r for r in made(5, 60) if r[0] is not None]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    told = con.sql(lloyd(5, 4, DIMS, 1024, "3:", math.isqrt(2**63 // (4 * DIMS)) - 1)).fetchall()
    got = cluster(df, 5, 4, DIMS, salt="3:").collect()
    assert sorted(map(tuple, got), key=str) == sorted(told, key=str)
