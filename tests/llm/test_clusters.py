"""Clusters against brute force in unbounded integers, on hostile tables and with any rotation."""

from __future__ import annotations

import hashlib
import random

import pytest

from proofline.llm import clusters as C


def brute(rows, clusters, rounds):
    kept = [(i, [C.SCALE * a // b for a, b in (float(x).as_integer_ratio() for x in v)]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    text = lambda i: "" if i is None else str(i)
    centres = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"3:{text(r[0])}".encode()).hexdigest())[:clusters]]
    assign = lambda: [min((sum((a - b)**2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (_, n) in zip(kept, found, strict=True) if n == k]
            if own:
                centres[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted(((i, n, min(d, C.LARGEST)) for (i, _), (d, n) in zip(kept, assign(), strict=True)), key=repr), centres


def hostile(scale):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(64)]) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(30)]                                   # copies
    rows += [(200 + i, [x + rng.gauss(0, .01) for x in rows[0][1]]) for i in range(30)]      # near copies
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [None, *[0.0] * 63]), (304, [float("nan")] * 64), (305, [float("inf")] * 64), (306, [0.0] * 64), (None, [0.5] * 64), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e200])
def test_clusters_equal_brute_force(spark, scale):
    rows = hostile(scale)
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, rest double").repartition(4)
    found, centres = C.cluster(frame)
    expected, wanted = brute(rows, 8, 10)
    assert centres == wanted
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    three = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], schema)
    assert {r["cluster"] for r in C.cluster(three)[0].collect()} == {0, 1, 2}
    assert C.cluster(spark.createDataFrame([], schema))[0].count() == 0


def test_bounds_leave_few_distances_to_verify(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1024, (8, 64)).astype(np.int64)
    whole = middles[rng.integers(0, 8, 4000)] + rng.normal(0, 100, (4000, 64)).astype(np.int64)
    axes, _ = C.principal_axes(whole.astype(float), 64)
    lead = whole @ axes[:, :C.LEADING]
    rest = np.sqrt((whole.astype(float)**2).sum(axis=1) - (lead**2).sum(axis=1))
    number, distance, verified = C.Centroids(middles.tolist(), axes).nearest(whole, lead, rest)
    every = ((whole[:, None, :] - middles[None])**2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and verified < 1.1 * len(whole)
