"""Ball trees and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import negatives


def by_rules(rows, anchor, positives=5, count=10):
    best = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        point = [math.floor(256 * x) for x in vector]
        best[i] = min(best.get(i, (label, point)), (label, point))
    out = []
    for a, (label, q) in best.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in best.items()}
        order = sorted((i for i in best if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            fits = [i for i in order if best[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fits[:count])]
    return sorted(out)


def vectors(seed, n, d=6, labels=4):
    rng = random.Random(seed)
    return [(k, [rng.choice((rng.gauss(0, 0.3), 0.25, 0.0)) for _ in range(d)], rng.randrange(labels)) for k in range(n)]


ODD = [(100, None, 1), (101, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, 2), (None, [0.5] * 6, 1), (104, [0.5] * 6, None), (105, [], 2), (106, [0.5, 0.5], 3), (107, [0.5] * 9, 0)]


@pytest.mark.parametrize("small, many", [(10_000, 40), (40, 500)])
def test_equals_brute_force(spark, monkeypatch, small, many):
    monkeypatch.setattr(negatives, "SMALL", small)
    monkeypatch.setattr(negatives, "ANCHORS", 25 if small == 40 else 16_384)
    rows = [(k + 200, v, l) for k, v, l in vectors(1, many)] + ODD
    rows += rows[:30] + [(205, [0.1] * 6, 0), (210, rows[0][1], 3)] + [(k + 1000, [0.3] * 6, k % 2) for k in range(many * 2 // 5)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, point string, rank int")
    got = negatives.hard_negatives(negatives.usable(table), F.col("vec_id") % 10 == 0)
    want = by_rules(rows, lambda a: a % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want
    # the small table has pairs with fewer than ten
    pairs = len({r[:2] for r in want})
    assert len(want) > 500 if many == 500 else 10 * pairs > len(want) > pairs


@pytest.mark.parametrize("spread", [0.0, 1.0, 300.0])
def test_search_prunes_nothing_that_counts(spread):
    rng = np.random.default_rng(int(spread))
    points = np.rint(rng.normal(0, spread, (3000, 8)) + rng.normal(0, 400, (12, 8))[rng.integers(0, 12, 3000)]).astype(np.int64)
    labels = np.sort(rng.integers(0, 5, 3000))
    order, tree = negatives.build(points, labels)
    assert sorted(order.tolist()) == list(range(3000))
    for n in range(len(tree["start"])):
        mine = order[tree["start"][n] : tree["end"][n]]
        assert np.sqrt(((points[mine] - tree["center"][n]) ** 2).sum(axis=1)).max() <= tree["radius"][n] + 1e-6
        assert (tree["low"][n], tree["high"][n]) == (labels[mine].min(), labels[mine].max())
    some = rng.integers(0, 3000, 40)
    asks = {"point": points[some], "id": some, "label": labels[some], "lo": rng.integers(-(10**6), 10**6, 40)}
    asks["hi"] = asks["lo"] + 10**6
    for same in (True, False):
        query, ids, scores = negatives.search(tree, points[order], order, labels[order], asks, 7, same)
        for k in range(40):
            s = points @ asks["point"][k]
            fits = ((labels == asks["label"][k]) == same) & (s >= asks["lo"][k]) & (s <= asks["hi"][k]) & (not same or np.arange(3000) != some[k])
            want = sorted((-int(s[i]), int(i)) for i in np.flatnonzero(fits))[:7]
            assert [(-int(x), int(i)) for i, x in zip(ids[query == k], scores[query == k])] == want


def test_a_pass_over_clusters_visits_few_leaves(monkeypatch):
    rng = np.random.default_rng(4)
    points = np.rint(rng.normal(0, 5, (20_000, 8)) + rng.normal(0, 400, (50, 8))[rng.integers(0, 50, 20_000)]).astype(np.int64)
    labels = rng.integers(0, 3, 20_000)
    order, tree = negatives.build(points, labels)
    seen = []
    plain = negatives.exact
    monkeypatch.setattr(negatives, "exact", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    asks = {"point": points[:100], "id": np.arange(100), "label": labels[:100], "lo": np.full(100, -(10**15)), "hi": np.full(100, 10**15)}
    negatives.search(tree, points[order], order, labels[order], asks, 5, True)
    assert sum(seen) < 0.2 * 100 * len(points)


def test_large_components_stay_exact():
    a = np.array([[1 << 22] * 64], np.int64)
    assert negatives.exact(a, a + 1).tolist() == [[sum((1 << 22) * ((1 << 22) + 1) for _ in range(64))]]


def test_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(negatives.usable(table), F.col("vec_id") % 100 == 0).count() == 0
