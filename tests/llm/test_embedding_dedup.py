"""Links and components of embeddings against all pairs, on groups of copies, dense balls, borderline angles and hostile rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from proofline.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, point long, n int, ball string"


def brute(rows, cosine):
    good = [(i, np.array(v, float)) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else (i, None) for i, v in rows]
    unit = [None if v is None else (v / np.abs(v).max()) / np.sqrt(((v / np.abs(v).max())**2).sum()) for _, v in good]
    near = [[b for b in range(len(rows)) if b != a and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= cosine] for a in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[a], *(label[b] for b in near[a])]) for a in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for a, (i, _) in enumerate(good):
        if i is not None:
            least[label[a]] = min(i, least.get(label[a], i))
    found = [(i, len(near[a]), least.get(label[a]) if unit[a] is not None else i) for a, (i, _) in enumerate(good)]
    return sorted(((i, n, c, i is not None and i == c) for i, n, c in found), key=repr)


def hostile():
    rng = np.random.default_rng(3)
    out = [rng.normal(size=64) for _ in range(150)]
    base = rng.normal(size=64)
    out += [base + rng.normal(size=64) * s for s in rng.uniform(0.0, 0.6, 120)]            # every angle around the limit
    for _ in range(12):                                                                     # small groups of near copies
        middle = rng.normal(size=64)
        out += [middle + rng.normal(size=64) * .05 for _ in range(rng.integers(2, 9))]
    hot = rng.normal(size=64)
    out += [hot + rng.normal(size=64) * .1 for _ in range(200)]                             # a dense ball
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(out)] + [(2000 + i, out[i % 5].tolist()) for i in range(20)]
    rows += [(3000 + i, (out[i] * 1e180).tolist()) for i in range(5)]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 64), (4003, [None, *[1.0] * 63]), (4004, [float("nan")] * 64), (4005, [float("inf")] * 64), (None, out[0].tolist()), (None, (-out[1]).tolist()),
             (4006, [1.0, 2.0]), (4007, [1.0, 2.1]), (4008, [-1.0, 2.0]), (995, out[5].tolist()), (995, out[5].tolist())]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 40, "dense": 8}, {"leaf": 25, "dense": 10_000}, {"leaf": 60, "blocks": 3, "cosine": 0.8}])
def test_links_equal_all_pairs(spark, options):
    rows = hostile()
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in E.near_duplicates(frame, **options).collect()), key=repr) == brute(rows, options.get("cosine", 0.9))


def test_one_vector_and_none(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(4, [1.0, 0.0], 1, 2, "x")], SCHEMA)
    assert [tuple(r) for r in E.near_duplicates(one).collect()] == [(4, 0, 4, True)]


def test_reach_of_leaves_misses_no_pair():
    rng = np.random.default_rng(6)
    codes = np.rint(rng.normal(0, 4000, (600, 8))).astype(np.int16)
    tree, _ = E.grown(codes, 600, 30)
    limit, home = 5000**2, E.home_leaves(codes, tree)
    reach = {(int(r), leaf) for leaf, rows in E.leaves_in_reach(codes, tree, limit) for r in rows}
    near = E.squared(codes.astype(float), codes.astype(float)) <= limit
    assert all((int(a), int(home[b])) in reach for a, b in zip(*np.nonzero(near), strict=True))
