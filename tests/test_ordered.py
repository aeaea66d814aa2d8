"""The ordered functions against brute force: plain, all keys sliced, and only hot keys sliced."""

import os
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cardflow.operators import history, velocity
from cardflow.operators.ordered import ROWS, by_heat, hot_keys, latest, prefix, running, tail_rows, trailing
from cardflow.operators.quantiles import quantile_columns
from cardflow.session import checkpoint_dir

SCHEMA = "k string, t long, id long, v double, m string"


def table(rows=400, seed=1):
    """A third of the rows on one key, many ties in time, some missing values."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", "d", None])
        out.append((key, rng.randrange(60), i, None if rng.random() < 0.1 else float(rng.randrange(1000)) / 4,
                    rng.choice(["x", "y", "z", None])))
    return out


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(params=["plain", "sliced", "hot only"])
def split(request, limit):
    """``split`` argument; in the third case the row counts decide."""
    if request.param == "hot only":
        limit(60)
        return None
    return request.param == "sliced"


def by_id(frame, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in frame.collect()}


def before(rows, row, cond):
    return [r for r in rows if r[0] == row[0] and cond(r, row)]


def test_hot_key_is_found(df, limit):
    limit(60)
    assert [r["k"] for r in hot_keys([df], ["k"]).collect()] == ["hot"]
    limit(1000)
    assert hot_keys([df], ["k"]) is None


def test_hot_and_cold_rows_are_separated(df, limit):
    limit(60)
    seen = []

    def work(part, split):
        seen.append((split, {r["k"] for r in part.select("k").distinct().collect()}))
        return part

    assert by_heat([df], ["k"], work).count() == df.count()
    assert seen == [(False, {"a", "b", "c", "d", None}), (True, {"hot"})]


def test_running(df, rows, split):
    aggs = {"n": ROWS, "nv": ("count", F.col("v")), "s": ("sum", F.col("v")), "hi": ("max", F.col("v")),
            "lo": ("min", F.col("v")), "last_v": ("last", F.col("v"))}
    order = [F.col("t"), F.col("id")]
    for current in (False, True):
        got = by_id(running(df, ["k"], order, aggs, current, totals={"all": ROWS}, split=split), *aggs, "all")
        for row in rows:
            seen = sorted(before(rows, row, lambda r, x: (r[1], r[2]) < (x[1], x[2]) or (current and r[2] == x[2])),
                          key=lambda r: (r[1], r[2]))
            vs = [r[3] for r in seen if r[3] is not None]
            want = (len(seen), len(vs), sum(vs) if vs else None, max(vs, default=None), min(vs, default=None),
                    vs[-1] if vs else None, sum(r[0] == row[0] for r in rows))
            assert got[row[2]] == pytest.approx(want)


def test_running_without_keys(df, rows, limit):
    for bound in (10, 10_000):
        limit(bound)
        got = by_id(running(df, [], [F.col("t").desc(), F.col("id").desc()], {"n": ROWS}), "n")
        place = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2]), reverse=True))}
        assert {i: n for i, (n,) in got.items()} == place


@pytest.mark.parametrize("shift,inclusive", [(0, False), (0, True), (7, False), (7, True)])
def test_prefix(df, rows, split, shift, inclusive):
    aggs = {"n": ROWS, "s": ("sum", F.col("v")), "hi": ("max", F.col("t"))}
    got = by_id(prefix(df, ["k"], "t", ["id"], aggs, shift, inclusive, split), *aggs)
    for row in rows:
        seen = before(rows, row, lambda r, x: r[1] < x[1] - shift or (inclusive and r[1] == x[1] - shift))
        vs = [r[3] for r in seen if r[3] is not None]
        assert got[row[2]] == pytest.approx((len(seen), sum(vs) if vs else None, max((r[1] for r in seen), default=None)))


@pytest.mark.parametrize("peers", ["arrived", "all"])
def test_trailing(df, rows, split, peers):
    exact = F.col("v").cast("decimal(28,6)")
    got = by_id(trailing(df, ["k"], "t", ["id"], {"a": 3, "b": 20}, {"n": ROWS, "s": ("sum", exact)}, peers, split),
                "n_a", "s_a", "n_b", "s_b")
    for row in rows:
        want = []
        for width in (3, 20):
            seen = before(rows, row, lambda r, x: x[1] - width <= r[1] <= x[1] and (
                peers == "all" or (r[1], r[2]) <= (x[1], x[2])))
            want += [len(seen), sum(Decimal(str(r[3] or 0)) for r in seen)]
        assert [x or 0 for x in got[row[2]]] == want


def test_trailing_distinct(df, rows, split):
    got = by_id(velocity.trailing_distinct(df, "k", "t", ["id"], "m", 5, "distinct_m", split), "distinct_m")
    for row in rows:
        seen = before(rows, row, lambda r, x: x[1] - 5 <= r[1] <= x[1])
        assert got[row[2]] == (len({r[4] for r in seen if r[4] is not None}),)


def test_latest(spark, df, rows, split):
    rng = random.Random(3)
    right = [(rng.choice(["hot", "a", "b"]), rng.randrange(60), i) for i in range(150)]
    side = spark.createDataFrame(right, "k string, rt long, rid long")
    for inclusive in (True, False):
        got = by_id(latest(df, side, ["k"], "t", "rt", ["rt", "rid"], ["rid"], inclusive, split), "rt", "rid")
        for row in rows:
            seen = [r for r in right if r[0] == row[0] and (r[1] < row[1] or (inclusive and r[1] == row[1]))]
            best = max(seen, key=lambda r: (r[1], r[2]), default=None)
            assert got[row[2]] == ((best[1], best[2]) if best else (None, None))


def test_tail_rows(df, rows, split):
    got = by_id(tail_rows(df, ["k"], [F.col("t"), F.col("id")], F.col("id"), 4, "tail", split), "tail")
    for row in rows:
        seen = sorted(before(rows, row, lambda r, x: (r[1], r[2]) <= (x[1], x[2])), key=lambda r: (r[1], r[2]))
        assert list(got[row[2]][0]) == [r[2] for r in seen[-4:]]


def test_tail_rows_over_tiny_slices(spark):
    """Slices that hold fewer rows than the tail needs."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        small = spark.range(50).select(F.lit("k").alias("k"), "id")
        got = by_id(tail_rows(small, ["k"], [F.col("id")], F.col("id"), 5, "tail", True), "tail")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(list(got[i][0]) == list(range(max(0, i - 4), i + 1)) for i in range(50))


def test_features_at(df, rows, split):
    got = by_id(velocity.features_at(df, "k", "t", ["id"], "v", "m", 3, 20, split), "count_short", "count_long",
                "unique_merchants_long", "since_previous")
    for row in rows:
        past = sorted(r[1] for r in before(rows, row, lambda r, x: r[1] <= x[1]))
        near = before(rows, row, lambda r, x: x[1] - 20 <= r[1] <= x[1])
        want = (sum(t >= row[1] - 3 for t in past), sum(t >= row[1] - 20 for t in past),
                len({r[4] for r in near if r[4]}), past[-1] - past[-2] if len(past) > 1 else None)
        assert got[row[2]] == want


def test_causal_counters_and_labels(df, rows, split):
    accepted = F.col("v").isNotNull()
    got = by_id(history.causal_counters(df, "k", "t", ["id"], accepted, day=1.0, split=split), "c2", "d1", "d2")
    late = by_id(history.label_history(df.withColumn("y", (F.col("m") == "x").cast("int")), "k", "t", ["id"], "y", 4,
                                       split), "label_count_before")
    for row in rows:
        seen = [r[1] for r in before(rows, row, lambda r, x: r[1] < x[1]) if r[3] is not None]
        assert got[row[2]] == (len(seen) + 1.0, row[1] - min(seen) if seen else 0.0, row[1] - max(seen) if seen else 0.0)
        assert late[row[2]] == (sum(r[4] == "x" for r in before(rows, row, lambda r, x: r[1] <= x[1] - 4)),)


def test_fractional_times_are_refused(spark):
    df = spark.createDataFrame([("k", 1.5, 1)], "k string, t double, id long")
    with pytest.raises(TypeError):
        history.previous_gap(df, "k", "t", ["id"], "strict")


def test_hot_instant(spark, limit):
    """One key and one instant hold everything."""
    limit(20)
    same = spark.range(100).select(F.lit("k").alias("k"), F.lit(5).cast("long").alias("t"), "id", F.lit(1.0).alias("v"))
    got = by_id(velocity.trailing_velocity(same, "k", "t", ["id"], "v", 3, 10), "count_short", "total_long")
    assert got == {i: (i + 1, float(i + 1)) for i in range(100)}
    strict = by_id(history.previous_gap(same, "k", "t", ["id"], "strict"), "prev_time")
    assert set(strict.values()) == {(None,)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 50)), min_size=1, max_size=40),
       st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]), st.sampled_from([None, True, False]))
def test_quantiles(spark, values, p, split):
    import numpy as np

    got = {r["g"]: (r["q"], r["r"]) for r in quantile_columns(
        spark.createDataFrame(values, "g string, x long"), ["g"], "x", {"q": p}, split=split).join(quantile_columns(
            spark.createDataFrame(values, "g string, x long"), ["g"], "x", {"r": p}, "nearest", split), "g").collect()}
    for g in {g for g, _ in values}:
        xs = sorted(x for k, x in values if k == g)
        assert got[g] == pytest.approx((float(np.percentile(xs, p * 100)), xs[min(int(p * len(xs)), len(xs) - 1)]))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_from_brackets(spark, monkeypatch, by):
    """Coarse brackets, too many groups, and brackets that miss: always the same values."""
    import numpy as np

    from cardflow.operators import quantiles as Q

    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.integers(0, 50, 700), rng.normal(20, 9, 800).round(3)])
    df = spark.createDataFrame([("one", float(x)) for x in xs], "g string, x double")
    probs = {"p01": 0.01, "p30": 0.3, "p31": 0.31, "p50": 0.5, "p999": 0.999}
    want = [float(np.percentile(xs, p * 100)) for p in probs.values()]

    def got():
        row = quantile_columns(df, by, "x", probs).first()
        return [row[n] for n in probs]

    assert got() == pytest.approx(want)
    monkeypatch.setattr(Q, "ACCURACY", 100)
    assert got() == pytest.approx(want)
    right = Q._brackets
    kind = "`__b_g` string, " if by else ""
    wrong = [f"__{side}{i} double" for i in range(5) for side in ("lo", "hi")]
    ends = tuple(float(9 * i + j) for i in range(5) for j in range(2))
    monkeypatch.setattr(Q, "_brackets", lambda *a: spark.createDataFrame(
        [(*(["one"] if by else []), *ends)], kind + ", ".join(wrong)))
    assert got() == pytest.approx(want)
    monkeypatch.setattr(Q, "_brackets", right)
    monkeypatch.setattr(Q, "MAX_BRACKETED_GROUPS", 0)
    assert got() == pytest.approx(want)


def test_shuffled_input_gives_the_same(df, rows):
    """Neither the order of the input nor its partitioning matters."""
    want = sorted(map(tuple, history.history_features(df, "k", "t", ["id"], "v").collect()), key=lambda r: r[2])
    for n, split in ((1, False), (11, False), (3, True)):
        mixed = df.orderBy(F.rand(n)).repartition(n)
        got = history.history_features(mixed, "k", "t", ["id"], "v", split=split)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_sliced_features_keep_one_copy_of_the_rows(spark, limit):
    """Slices are stored once, compressed, and not again per point in time; keys in one slice need no look-up."""
    n = 20_000
    limit(n // 4)
    df = spark.range(n).select((F.col("id") % 997).alias("k"), (F.col("id") * 7919 % 10_007).alias("t"), "id", (F.col("id") % 89).cast("double").alias("amount"),
                               (F.col("id") % 5).cast("string").alias("m"))
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = folder_bytes(folder)
    out = velocity.features_at(df, "k", "t", ["id"], merchant="m", short=500, long=2_000, split=True)
    assert folder_bytes(folder) - before < 100 * n
    plain = velocity.features_at(df, "k", "t", ["id"], merchant="m", short=500, long=2_000, split=False)
    assert sorted(out.collect()) == sorted(plain.collect())


def test_features_at_instants_in_several_slices(spark):
    """Rows of one instant before, in and after a slice; slices of one instant; a key that begins and ends within a slice; rows without key or time."""
    rng = random.Random(8)
    rows = [("hot", 50 if i % 3 else rng.randrange(100), i, float(i % 11), rng.choice("xyz")) for i in range(300)]
    rows += [(k, rng.randrange(100), 300 + i, float(i % 7), rng.choice("xyz")) for i, k in enumerate(["a", "b", None] * 10)]
    rows += [("hot", None, 400, 1.0, "x"), ("c", None, 401, 1.0, "x"), (None, None, 402, 1.0, "x"), ("hot", 50, 50, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, t long, id long, amount double, m string").repartition(3)
    got = by_id(velocity.features_at(df.filter("t IS NOT NULL"), "k", "t", ["id"], merchant="m", short=5, long=30, split=True).withColumn("id", F.col("id") * 2 + F.col("m").isNull().cast("int")),
                "count_short", "amount_short", "count_long", "amount_long", "unique_merchants_long", "since_previous")
    for k, t, i, _, m in (r for r in rows if r[1] is not None):
        short, long = ([r for r in rows if r[0] == k and r[1] is not None and t - w <= r[1] <= t] for w in (5, 30))
        times = sorted(r[1] for r in rows if r[0] == k and r[1] is not None and r[1] <= t)
        want = (len(short), sum(r[3] for r in short), len(long), sum(r[3] for r in long), len({r[4] for r in long} - {None}), times[-1] - times[-2] if len(times) > 1 else None)
        assert got[i * 2 + (m is None)] == pytest.approx(want), (k, t, i)
    # with no row in time before it, a row without time has no history
    timeless = by_id(prefix(df, ["k"], "t", ["id"], {"n": ROWS}, 0, True, True).filter("t IS NULL"), "n")
    assert timeless == {400: (0,), 401: (0,), 402: (0,)}
