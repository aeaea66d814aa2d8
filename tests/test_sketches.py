"""Quantiles from stored sketches against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardflow.operators import drift, sketches as S

POINTS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(8)
    out = [(i % 3, rng.choice([None, float("nan"), *[rng.gauss(0, 1)] * 8]), float(rng.randrange(4))) for i in range(30_000)]
    return out + [(9, None, 2.0), (9, float("nan"), 2.0)]


@pytest.fixture(scope="module")
def rows(spark, cells):
    return spark.createDataFrame(cells, "g int, x double, y double").repartition(7)


def plain(cells, column, groups):
    return sorted(r[column] for r in cells if r[0] in groups and r[column] is not None and not math.isnan(r[column]))


@pytest.mark.parametrize("margin", [S.MARGIN, 0.0])
def test_exact_from_merged_sketches(spark, rows, cells, margin, monkeypatch):
    """With brackets without a margin, too, which may miss."""
    monkeypatch.setattr(S.brackets, "__defaults__", ((), margin))
    parts = S.column_sketches(rows, ["x", "y"], ["g"])
    got = {(r.g, r.feature): r for r in S.exact_quantiles(rows, ["x", "y"], POINTS, parts, ["g"]).collect()}
    assert set(got) == {(g, c) for g in (0, 1, 2) for c in "xy"} | {(9, "y")}
    for (g, c), r in got.items():
        values = plain(cells, "gxy".index(c), {g})
        assert [r[n] for n in POINTS] == pytest.approx([float(np.quantile(values, p)) for p in POINTS.values()], abs=1e-12)
    merged = S.merge_sketches(parts.filter("g < 2"))
    values = plain(cells, 1, {0, 1})
    r = S.exact_quantiles(rows.filter("g < 2"), ["x"], POINTS, merged.filter("feature = 'x'")).first()
    assert [r[n] for n in POINTS] == pytest.approx([float(np.quantile(values, p)) for p in POINTS.values()], abs=1e-12)


def test_sketches_are_near(rows, cells):
    whole = S.merge_sketches(S.column_sketches(rows, ["x"], ["g"]))
    r, values = S.sketched_quantiles(whole, POINTS).first(), plain(cells, 1, {0, 1, 2, 9})
    assert r.n == len(values) and (r.a, r.e) == (values[0], values[-1])
    for n, p in POINTS.items():
        assert abs(np.searchsorted(values, r[n]) / len(values) - p) < 4 * 0.0013


def test_one_pass_without_cells(rows):
    """The table is aggregated as it lies: columns aren't turned into rows before the shuffle."""
    plan = S.column_sketches(rows, ["x", "y"], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Aggregate") == 1


def test_edges_are_the_same(rows):
    real = rows.filter("NOT isnan(x) OR x IS NULL")
    whole = S.column_sketches(real, ["x", "y"])
    assert drift.numeric_edges(real, ["x", "y"], sketches=whole) == drift.numeric_edges(real, ["x", "y"])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g int, x double")
    for by in ([], ["g"]):
        parts = S.column_sketches(empty, ["x"], by)
        assert not parts.collect() and not S.merge_sketches(parts, by).collect()
        assert not S.exact_quantiles(empty, ["x"], POINTS, parts, by).collect()
