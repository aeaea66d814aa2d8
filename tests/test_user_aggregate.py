"""Aggregates of one's own: equal under any spread of the rows."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cardflow.operators import aggregate, user_aggregate as U, velocity

US = velocity.SECOND


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, rng.gauss(1e6, 1.0)])) for _ in range(3000)]
    return out + [("lone", 7, 3.5), ("empty", 7, None)]


@pytest.mark.parametrize("parts,held", [(1, 50_000), (17, 2)])
def test_moments(spark, rows, parts, held, monkeypatch):
    """NULL groups and values, a group with most of the rows, and states that are passed on early."""
    monkeypatch.setattr(U, "HELD", held)
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(parts)
    got = {(r.g, r.h): r for r in U.user_aggregate(df, ["g", "h"], ["x"], U.Moments("x")).collect()}
    assert set(got) == {(g, h) for g, h, _ in rows}
    for (g, h), r in got.items():
        x = [v for a, b, v in rows if (a, b) == (g, h) and v is not None]
        assert r.n == len(x)
        if x:
            assert math.isclose(r.mean, statistics.fmean(x), rel_tol=1e-12) and math.isclose(r.var_pop, statistics.pvariance(x), rel_tol=1e-6, abs_tol=1e-9)
        else:
            assert r.mean is None and r.var_pop is None
        assert (r.var_samp is None) == (len(x) < 2)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x double")
    out = U.user_aggregate(df, ["g"], ["x"], U.Moments("x"))
    assert out.columns == ["g", "n", "mean", "var_pop", "var_samp"] and not out.collect()


@pytest.mark.parametrize("parts", [1, 13])
def test_recent_totals(spark, parts):
    """Missing and odd amounts, several rows of an instant; the same as by a join."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, None]), rng.randrange(200) * 20, rng.choice([None, 1.25, 3.0, 1e-7, float("inf"), 2e33])) for _ in range(600)] + [(3, 5, None)]
    df = spark.createDataFrame(rows, "card_id long, s long, amount double").select("card_id", F.timestamp_seconds("s").alias("event_time"), "amount").repartition(parts)
    assert sorted(map(str, U.window_velocity_by_state(df).collect())) == sorted(map(str, velocity.window_velocity(df).collect()))


def test_state_forgets(spark):
    """A state holds no instant that can't be recent."""
    agg = U.RecentTotals(100)
    import numpy as np

    def state(times):
        n = len(times)
        return agg.add(agg.create(), {"t": np.array(times), "known": np.ones(n, bool), "units": np.ones(n, np.int64), "rest": np.zeros(n)})

    a, b = state(list(range(0, 1000, 10))), state([5000, 5050])
    both = agg.merge(a, b)
    assert len(a[0]) == 11 and sorted(both[0]) == [5000, 5050] and agg.finish(both)[:1] == (2,) and agg.finish(both)[3] == 102
    assert agg.finish(both) == agg.finish(agg.merge(b, a)) and agg.finish(agg.create())[0] == 0


def test_sketches(spark):
    """Roll-ups from stored sketches equal the sketch of the rows themselves."""
    df = spark.range(40_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 3).alias("kind"), (F.col("id") * 7 % 9001).alias("card"))
    sketches = aggregate.merchant_sketches(df, ["day", "kind"], "card")
    by_kind = {r.kind: r.unique_merchants for r in aggregate.merge_sketches(sketches, ["kind"]).collect()}
    direct = {r.kind: r.unique_merchants for r in aggregate.merge_sketches(aggregate.merchant_sketches(df, ["kind"], "card"), ["kind"]).collect()}
    exact = {r.kind: r.unique_merchants for r in aggregate.unique_merchants(df, ["kind"], "card").collect()}
    assert all(abs(by_kind[k] - exact[k]) <= 0.04 * exact[k] and abs(by_kind[k] - direct[k]) <= 0.02 * exact[k] for k in exact)
    hops = {r.window: r.unique_merchants for r in aggregate.hop_sketches(sketches, [], "day", 2).collect()}
    assert sorted(hops) == list(range(-1, 10)) and all(n > 3000 for n in hops.values())
