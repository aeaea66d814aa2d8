"""Histogram boosting against trees grown one leaf at a time over plain lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardflow.operators import boosting as B

FEATURES = ["a", "b", "c"]
WHOLE = {"row_share": 1.0, "feature_share": 1.0}
PLAIN = B.BoostConfig(trees=1, leaves=9, bins=12, min_rows=5, **WHOLE)


def made(n=1200, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice([None, float("nan"), *[rng.gauss(0, 2)] * 8]), float(rng.randrange(6)), rng.choice([None, rng.random()])
        y = int((b >= 3) != (a is None or math.isnan(a) or a > 0.5))
        out.append((i, a, b, c, y if rng.random() < 0.85 else rng.randrange(2)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), "i long, a double, b double, c double, y int").repartition(5)


def grown(rows, edges, config, w1):
    """Leaves as sorted lists of row ids with their values."""
    def code(x, k):
        return 0 if x is None or math.isnan(x) else 1 + sum(e <= x for e in edges[k])

    data = {r[0]: ([code(r[1 + k], k) for k in range(3)], r[4]) for r in rows}
    grad = {i: (round((0.5 - y) * (w1 if y else 1) * B.UNIT) / B.UNIT, round(0.25 * (w1 if y else 1) * B.UNIT) / B.UNIT) for i, (_, y) in data.items()}

    def sums(ids):
        return sum(grad[i][0] for i in ids), sum(grad[i][1] for i in ids)

    def worth(ids):
        g, h = sums(ids)
        return max(abs(g) - config.l1, 0.0) ** 2 / (h + config.l2)

    def best(ids):
        top = None
        for k in range(3):
            for b in sorted({data[i][0][k] for i in ids} - {0}):
                for left_too in (False, True):
                    left = [i for i in ids if (left_too if data[i][0][k] == 0 else data[i][0][k] <= b)]
                    right = sorted(set(ids) - set(left))
                    if min(len(left), len(right)) < config.min_rows:
                        continue
                    gain = worth(left) + worth(right) - worth(ids)
                    if gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                        top = gain, left, right
        return top

    leaves = [(list(data), best(list(data)))]
    while len(leaves) < config.leaves and any(s for _, s in leaves):
        at = max((k for k, (_, s) in enumerate(leaves) if s), key=lambda k: leaves[k][1][0])
        _, left, right = leaves.pop(at)[1]
        leaves += [(left, best(left)), (right, best(right))]
    out = {}
    for ids, _ in leaves:
        g, h = sums(ids)
        out[tuple(sorted(ids))] = -config.rate * math.copysign(max(abs(g) - config.l1, 0.0), g) / (h + config.l2)
    return out


def test_edges_are_exact(spark, rows):
    values = sorted(r[1] for r in made() if r[1] is not None and not math.isnan(r[1]))
    edges = B.bin_edges(rows, FEATURES, 12)
    starts = {}
    for k, v in enumerate(values):
        starts.setdefault(k * 12 // len(values), v)
    assert edges[0].tolist() == sorted(starts.values())[1:]
    assert edges[1].tolist() == [1.0, 2.0, 3.0, 4.0, 5.0]


@pytest.mark.parametrize("leaves", [2, 5, 9])
def test_tree_is_that_of_one_leaf_at_a_time(rows, leaves):
    config = B.BoostConfig(trees=1, leaves=leaves, bins=12, min_rows=5, **WHOLE)
    model = B.train(rows, FEATURES, "y", ["i"], config)
    data = made()
    pos = sum(r[4] for r in data)
    expected = grown(data, model.edges, config, (len(data) - pos) / pos)
    codes = B._bins([np.array([np.nan if r[1 + k] is None else r[1 + k] for r in data]) for k in range(3)], model.edges)
    leaf = model.trees[0].leaf_of(codes)
    got = {}
    for r, at in zip(data, leaf.tolist(), strict=True):
        got.setdefault(at, []).append(r[0])
    assert {tuple(ids): round(float(model.trees[0].value[at]), 9) for at, ids in got.items()} == {k: round(v, 9) for k, v in expected.items()}


def test_same_model_however_rows_lie(rows):
    config = B.BoostConfig(trees=4, leaves=6, block=2, redraw=2)
    first, again = (B.train(df, FEATURES, "y", ["i"], config) for df in (rows, rows.orderBy(F.desc("i")).repartition(3)))
    for t, u in zip(first.trees, again.trees, strict=True):
        assert t.feature.tolist() == u.feature.tolist() and t.upto.tolist() == u.upto.tolist()
        assert np.allclose(t.value, u.value, rtol=0, atol=1e-12)


def test_early_stop_and_scores(spark, rows):
    config = B.BoostConfig(trees=30, leaves=6, rate=0.3, patience=3, block=3)
    model = B.train(rows.filter("i % 4 > 0"), FEATURES, "y", ["i"], config, rows.filter("i % 4 = 0"))
    best = max(p for _, p in model.history)
    assert len(model.trees) == B.best_round(model) < 30 and dict(model.history)[len(model.trees)] == best
    assert len(model.history) - len(model.trees) < config.patience + config.block
    scored = {r.i: r.p for r in B.score(rows, model, ["i"], "p").collect()}
    assert len(scored) == 1200 and all(0 < p < 1 for p in scored.values())
    right = [(scored[r[0]] > 0.5) == (r[4] == 1) for r in made()]
    assert sum(right) / len(right) > 0.85
    shares = {r.feature: r for r in B.importance(spark, model).collect()}
    assert math.isclose(sum(r.importance for r in shares.values()), 1) and min(shares["a"].gain, shares["b"].gain) > shares["c"].gain
    table = B.nodes(spark, model)
    assert table.filter("left IS NULL").count() == table.filter("left IS NOT NULL").count() + len(model.trees)


def test_null_goes_where_it_helps(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 7), int(i % 5 == 0)) for i in range(500)], "i long, x double, y int")
    model = B.train(df, ["x"], "y", ["i"], B.BoostConfig(trees=3, leaves=2, **WHOLE))
    p = {r.x: r.p for r in B.score(df, model, ["x"], "p").distinct().collect()}
    assert p[None] > max(v for k, v in p.items() if k is not None)


def test_steps_are_dropped(spark, rows):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = {f for f in os.listdir(folder) if f.startswith("table-")}
    B.train(rows, FEATURES, "y", ["i"], B.BoostConfig(trees=3, leaves=2, block=1))
    assert {f for f in os.listdir(folder) if f.startswith("table-")} <= before


def test_odd_tables(spark):
    schema = "i long, x double, y int"
    with pytest.raises(ValueError):
        B.train(spark.createDataFrame([], schema), ["x"], "y", ["i"])
    with pytest.raises(ValueError):
        B.train(spark.createDataFrame([(1, 1.0, 2)], schema), ["x"], "y", ["i"])
    one = spark.createDataFrame([(1, 1.0, 1), (2, None, 1), (3, 2.0, None)], schema)
    model = B.train(one, ["x"], "y", ["i"])
    assert not model.trees and all(r.p > 0.99 for r in B.score(one, model, ["i"], "p").collect())
    empty = spark.createDataFrame([(i, None, i % 2) for i in range(100)], schema)
    model = B.train(empty, ["x"], "y", ["i"], B.BoostConfig(trees=2, **WHOLE))
    assert {round(r.p, 6) for r in B.score(empty, model, ["i"], "p").collect()} == {0.5}
