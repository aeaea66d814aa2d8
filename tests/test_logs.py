"""The log with offsets: rate cap, restart, starting offsets, lost records, hot partitions."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cardflow.sources import logs, sinks
from cardflow.streaming import streams


def append(spark, log, n, seed=3, at=0, **options):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), f"v{at + i}", at + i, at + i) for i in range(n)]
    logs.append_log(spark.createDataFrame(rows, "key string, value string, time long, id long"), log, "time", ["id"], partitions=3, **options)
    return rows


def records(spark, path):
    return sorted((r.partition, r.offset, r.key and bytes(r.key).decode(), bytes(r.value).decode(), r.us) for r in spark.read.parquet(path).withColumn("us", F.unix_micros("timestamp")).collect())


def run(spark, tmp_path, log, name="out", cap=None, trigger=streams.catch_up, **options):
    path, progress = str(tmp_path / name), str(tmp_path / f"{name}-progress")
    df = logs.read_log_events(spark, log, cap, progress=progress if cap else None, **options)
    query = trigger(sinks.sink_parquet(df, path, str(tmp_path / f"{name}-checkpoint")))
    return path, query


def numbered(rows, places):
    """Each record with its partition, and its place among the earlier ones of the partition."""
    seen, out = Counter(), []
    for key, value, time, _ in rows:
        p = places[value]
        out.append((p, seen[p], key, value, time))
        seen[p] += 1
    return sorted(out)


@pytest.mark.parametrize("split", [False, True])
def test_offsets_have_no_gaps_and_follow_time(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(logs, "CHUNK_ROWS", 40)
    log = str(tmp_path / "log")
    rows = append(spark, log, 200, split=split) + append(spark, log, 100, seed=4, at=200, split=split)
    path, _ = run(spark, tmp_path, log)
    got = records(spark, path)
    assert got == numbered(rows, {r[3]: r[0] for r in got})
    assert len({r[0] for r in got if r[2] == "a"}) == 1
    index = spark.read.parquet(f"{log}/index").collect()
    assert all(r["last"] // 40 == r["first"] // 40 == r["chunk"] for r in index)


def test_rate_cap_and_restart(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = append(spark, log, 100)
    _, query = run(spark, tmp_path, log, cap=30, fail_on_data_loss=True)
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [30, 30, 30, 10]
    rows += append(spark, log, 50, seed=4, at=100)
    path, query = run(spark, tmp_path, log, cap=30, fail_on_data_loss=True)
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [30, 20]
    got = records(spark, path)
    assert got == numbered(rows, {r[3]: r[0] for r in got})


def test_without_a_cap_available_now_takes_all(spark, tmp_path):
    log = str(tmp_path / "log")
    append(spark, log, 60)
    path, _ = run(spark, tmp_path, log, trigger=lambda w: streams.run_all([w])[0])
    append(spark, log, 20, at=60)
    run(spark, tmp_path, log, trigger=lambda w: streams.run_all([w])[0])
    assert sorted(r[3] for r in records(spark, path)) == sorted(f"v{i}" for i in range(80))


def test_starting_offsets(spark, tmp_path):
    log = str(tmp_path / "log")
    append(spark, log, 60)
    everything, _ = run(spark, tmp_path, log)
    whole = records(spark, everything)
    p = whole[0][0]
    some, _ = run(spark, tmp_path, log, "some", starting=json.dumps({str(p): 5}))
    assert records(spark, some) == [r for r in whole if r[0] != p or r[1] >= 5]
    _, query = run(spark, tmp_path, log, "new", starting="latest")
    assert not any(q.numInputRows for q in query.recentProgress)


def test_lost_records(spark, tmp_path):
    log = str(tmp_path / "log")
    append(spark, log, 60)
    first = {f for f in os.listdir(f"{log}/index") if f.endswith(".parquet")}
    append(spark, log, 30, at=60)
    kept = str(tmp_path / "kept")  # the log after its first append has expired
    late = [f for f in os.listdir(f"{log}/index") if f.endswith(".parquet") and f not in first]
    os.makedirs(f"{kept}/index")
    os.symlink(f"{log}/data", f"{kept}/data")
    for f in late:
        os.symlink(f"{log}/index/{f}", f"{kept}/index/{f}")
    zeros = json.dumps({str(p): 0 for p in range(3)})
    with pytest.raises(StreamingQueryException, match="not in the log any more"):
        run(spark, tmp_path, kept, "strict", starting=zeros, fail_on_data_loss=True)
    path, _ = run(spark, tmp_path, kept, "lenient", starting=zeros)
    assert sorted(r[3] for r in records(spark, path)) == sorted(f"v{i}" for i in range(60, 90))
    path, _ = run(spark, tmp_path, kept, "earliest", fail_on_data_loss=True)
    assert len(records(spark, path)) == 30


def test_half_written_append_is_not_seen(spark, tmp_path):
    log = str(tmp_path / "log")
    append(spark, log, 10)
    data = spark.createDataFrame([(b"k", b"v", 1, 99, 1, 0)], "key binary, value binary, time long, offset long, partition int, chunk long")
    data.write.partitionBy("partition", "chunk").parquet(f"{log}/data/batch=dead")
    path, _ = run(spark, tmp_path, log)
    assert len(records(spark, path)) == 10


def test_empty_append_and_empty_log(spark, tmp_path):
    log = str(tmp_path / "log")
    append(spark, log, 0)
    _, query = run(spark, tmp_path, log)
    assert not any(q.numInputRows for q in query.recentProgress)


def test_shares():
    assert logs.shares({"0": 5, "1": 1}, 10) == {"0": 5, "1": 1}
    assert logs.shares({"0": 90, "1": 9, "2": 1, "3": 0}, 10) == {"0": 9, "1": 1, "2": 0, "3": 0}
    rng = random.Random(1)
    for _ in range(300):
        backlog = {str(i): rng.randrange(0, 50) for i in range(rng.randrange(1, 8))}
        cap = rng.randrange(1, 120)
        got = logs.shares(backlog, cap)
        assert sum(got.values()) == min(cap, sum(backlog.values())) and all(got[p] <= backlog[p] for p in backlog)


def test_cap_needs_progress():
    with pytest.raises(ValueError, match="progress"):
        logs.LogStreamReader({"path": "x", "maxOffsetsPerTrigger": "5"})
