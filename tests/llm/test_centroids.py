"""Centroid clustering against plain whole-number k-means."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from deskgauge.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, `a.b` int"


def plain(rows, k, rounds, size):
    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(q, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [c for _, c in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda: [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in q]
    for _ in range(rounds):
        near = place()
        for j in range(len(centres)):
            own = [v for (_, v), n in zip(q, near, strict=True) if n == j]
            if own:
                centres[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    near = place()
    d = [far(v, centres[n]) for (_, v), n in zip(q, near, strict=True)]
    of = lambda n: sum(x for x, m in zip(d, near, strict=True) if m == n)
    return [(i, n, x, of(n), sum(d), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), n, x in zip(q, near, d, strict=True)]


key = lambda r: tuple(-1 if x is None else x for x in r)


def some_vectors(seed, n, size):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, rng.gauss(0, 3)]) for _ in range(size)]) for i in range(n)]
    awkward = [(None, [0.5] * size), (7, None), (8, []), (9, [1.0] * (size + 1)), (10, [None] + [1.0] * (size - 1)), (11, [math.nan] * size), (12, [math.inf] * size), (13, [1e-300] * size), (14, [-0.0] * size)]
    return rows + rows[:5] + awkward


@pytest.mark.parametrize(("n", "k", "rounds"), [(150, 8, 10), (40, 30, 2), (0, 8, 10), (300, 3, 40)])
def test_equal_to_plain_clustering(spark, n, k, rounds):
    rows = some_vectors(n, n, 6)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)
    got = centroids.clusters(table, k=k, rounds=rounds, dimensions=6).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, k, rounds, 6), key=key)


def test_empty_table_and_too_large_components(spark):
    assert centroids.clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(spark.createDataFrame([(1, [1e12] * 6, 1, "x", 2)], SCHEMA), dimensions=6).collect()
