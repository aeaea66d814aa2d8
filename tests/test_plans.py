"""Physical plans: what reaches the scan and how often rows are shuffled."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cardflow.operators import aggregate, history, joins, prep, profile, velocity
from cardflow.session import checkpoint_dir, materialize
from cardflow.sources.views import ev, prof, table, tx

SF = "/root/testdata/sf0.001"

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_and_pushdown(spark):
    text = plan(tx(spark, SF).filter(F.col("amount") > 1000).select("card_id"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text


@pytest.mark.parametrize("make,shuffles", [
    (lambda s: history.history_features(tx(s, SF), "card_id", "dt", ["transaction_id"]), 1),
    (lambda s: history.previous_gap(tx(s, SF), "card_id", "dt", ["transaction_id"], "strict"), 1),
    (lambda s: velocity.trailing_velocity(ev(s, SF), "card_id", "us", ["transaction_id"]), 1),
    (lambda s: velocity.velocity_alerts(ev(s, SF), "card_id", "us", ["transaction_id"]), 1),
    (lambda s: aggregate.aggregate_card_history(tx(s, SF), "card_id", "amount", "is_fraud"), 1),
    (lambda s: velocity.window_summary(ev(s, SF), "5 minutes"), 1),
])
def test_one_shuffle(spark, make, shuffles):
    assert len(re.findall(r"Exchange hashpartitioning", plan(make(spark)))) == shuffles


def test_rollup_after_history_reuses_the_shuffle(spark):
    rows = history.history_features(tx(spark, SF), "card_id", "dt", ["transaction_id"])
    rolled = aggregate.aggregate_card_history(rows, "card_id", "amount", "is_fraud")
    assert len(re.findall(r"Exchange hashpartitioning", plan(rolled))) == 1


def test_copies_are_reduced_before_the_shuffle(spark):
    """A key with many copies must not travel in full."""
    lines = table(spark, SF, "lineitem")
    text = plan(joins.dedup(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]))
    assert re.search(r"WindowGroupLimit .*Partial", text)
    assert re.search(r"WindowGroupLimit .*Partial", plan(profile.column_profile(lines, ["l_returnflag"])))


def test_only_small_tables_are_broadcast(spark):
    """A side above the size threshold is shuffled, not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(joins.lookup_profile(ev(spark, SF), prof(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_encoders_leave_the_table_in_place(spark):
    """The model is small, whatever the table it was fitted on: no shuffle of the table, even where little may be broadcast."""
    rows = ev(spark, SF).select("transaction_id", "merchant_id", "country")
    model = prep.fit_labels(rows, ["merchant_id", "country"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        text = plan(prep.apply_labels(rows, model, ["merchant_id", "country"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == folder
    before = set(os.listdir(folder))
    materialize(spark.range(5)).count()
    written = set(os.listdir(folder)) | {n for d in os.listdir(folder) for n in os.listdir(os.path.join(folder, d))}
    assert any(n.startswith("rdd-") for n in written) and before <= written


def test_tasks_of_windows_grow_with_the_rows(spark, monkeypatch):
    """A task holds ten windows or so of each of its rows."""
    monkeypatch.setattr(velocity, "ROWS_PER_TASK", 50)
    rows = ev(spark, SF)
    tasks = -(-rows.count() // 50)
    assert tasks > 4 and f", {tasks})" in re.search(r"Exchange hashpartitioning\([^()]*__b[^()]*\)", plan(velocity.hopping_features(rows))).group()
