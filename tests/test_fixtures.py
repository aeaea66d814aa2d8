"""Literal cases."""

import pytest
from pyspark.sql import functions as F

from cardflow.functions import columns as C
from cardflow.operators import aggregate, clean, hydrate, joins, prep, velocity
from cardflow.sources import normalize

US = velocity.SECOND


def test_trailing_features(spark):
    rows = [("C", "M1", 500.0, 0, 1), ("C", "M2", 800.0, 120, 2), ("C", "M3", 12000.0, 180, 3), ("C", "M4", 2000.0, 240, 4)]
    df = spark.createDataFrame(rows, "card_id string, merchant_id string, amount double, s long, id long").withColumn(
        "us", F.col("s") * US)
    got = velocity.features_now(df, "card_id", "us", ["id"], F.lit(240 * US)).first()
    assert got.asDict() == {"card_id": "C", "count_short": 4, "amount_short": 15300.0, "count_long": 4, "amount_long": 15300.0,
                            "unique_merchants_long": 4, "since_previous": 60 * US}
    at = {r["id"]: r for r in velocity.features_at(df, "card_id", "us", ["id"]).collect()}
    assert (at[4]["count_short"], at[4]["amount_long"], at[4]["unique_merchants_long"]) == (4, 15300.0, 4)
    assert at[1]["since_previous"] is None


@pytest.mark.parametrize("delay,accepted", [(1, 3), (3, 4), (5, 4)])
def test_late_data(spark, delay, accepted):
    df = spark.createDataFrame([(1, 1), (2, 4), (3, 2), (4, 3)], "arrival long, minute long")
    got = velocity.accept_late(df, "minute", ["arrival"], delay).filter("accepted").collect()
    assert len(got) == accepted
    if delay == 1:
        assert sorted(r["minute"] for r in got) == [1, 3, 4]


def test_velocity_alert_on_the_fourth_event(spark):
    df = spark.createDataFrame([(1, 100, 50.0), (2, 110, 60.0), (3, 120, 70.0), (4, 130, 80.0)], "id long, s long, amount double")
    df = df.select("id", F.lit("C").alias("card_id"), (F.col("s") * US).alias("us"), "amount", F.lit("US").alias("country"))
    got = {r["id"]: r for r in velocity.velocity_alerts(df, "card_id", "us", ["id"]).collect()}
    assert [got[i]["alerts"] for i in (1, 2, 3, 4)] == [[], [], [], ["VELOCITY"]]
    assert got[4]["count_in_window"] == 4


def test_geo_hop_needs_another_country(spark):
    df = spark.createDataFrame([(1, 1, "FOREIGN"), (2, 2, "FOREIGN"), (3, 3, "LOCAL")], "id long, us long, country string")
    df = df.withColumn("card_id", F.lit("C")).withColumn("amount", F.lit(1.0))
    got = {r["id"]: r["alerts"] for r in velocity.velocity_alerts(df, "card_id", "us", ["id"]).collect()}
    assert got == {1: [], 2: [], 3: ["GEO_HOP"]}


def test_buckets(spark):
    df = spark.createDataFrame([(50.0,), (500.0,), (2400.0,), (15000.0,), (100.0,)], "x double")
    below = [r[0] for r in df.select(C.bucketize("x", C.AMOUNT_SCALE_BELOW)).collect()]
    upto = [r[0] for r in df.select(C.bucketize("x", C.AMOUNT_SCALE_UPTO, right=True)).collect()]
    assert below == ["LOW", "MEDIUM", "HIGH", "VERY_HIGH", "MEDIUM"]
    assert upto == ["LOW", "LOW", "HIGH", "VERY_HIGH", "LOW"]


def test_summary(spark):
    df = spark.createDataFrame([(500.0,), (700.0,), (1200.0,)], "amount double")
    assert tuple(aggregate.summarize(df, "amount").first()) == (3, 2400.0, 800.0)
    assert tuple(aggregate.summarize(df.filter("false"), "amount").first()) == (0, 0.0, 0.0)


def test_lenient_clean(spark):
    df = spark.createDataFrame([("10.5", 0), (None, 1)], "TransactionAmt string, isFraud int")
    got = clean.clean_lenient(df, "TransactionDT", "TransactionAmt", "isFraud").collect()
    assert [tuple(r) for r in got] == [(10.5, 0), (0.0, 1)]


def test_optional_join(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(1, "x")], "id int, device string")
    assert joins.join_optional(a, b, "id").count() == 2
    assert joins.join_optional(a, b, "other").columns == ["id"]
    with pytest.raises(ValueError):
        joins.join_one_to_one(a, b.union(b), "id")


def test_normalize_wide(spark):
    df = spark.createDataFrame([("2987000", "13926", "125.50", "desktop", "1")],
                               "TransactionID string, card1 string, TransactionAmt string, DeviceType string, isFraud string")
    got = normalize.normalize_source(df).first()
    assert (got["transaction_id"], got["card_id"], got["amount"], got["device_type"], got["is_fraud"]) == (
        "TX-2987000", "CARD-13926", 125.5, "web", True)


def test_normalize_card10k(spark):
    df = spark.createDataFrame([("101", "4500.00", "Travel", "1", "1", "40", "7", "33", "1")],
                               "transaction_id string, amount string, merchant_category string, foreign_transaction string, "
                               "location_mismatch string, device_trust_score string, velocity_last_24h string, "
                               "cardholder_age string, is_fraud string")
    got = normalize.normalize_source(df).first()
    assert (got["transaction_id"], got["amount"], got["is_fraud"], got["country"], got["location_mismatch"]) == (
        "TX-101", 4500.0, True, "FOREIGN", True)
    assert got["card_id"] == "CARD-HOLDER-33-101" and got["device_type"] == "mobile"


def test_zero_is_a_value(spark):
    df = spark.createDataFrame([("1", "7", 0.0, "1704067200000")], "id string, user_id string, amount double, timestamp string")
    got = clean.normalize_event(df).first()
    assert (got["amount"], got["card_id"], got["event_time"], got["product_code"]) == (0.0, "CARD-7", 1704067200.0, "W")


@pytest.mark.parametrize("text,seconds", [
    ("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01 01:00:00+01:00", 1704067200.0), ("1704067200", 1704067200.0),
    ("1704067200000", 1704067200.0), ("soon", None), ("", None)])
def test_to_epoch(spark, text, seconds):
    assert spark.range(1).select(C.to_epoch(F.lit(text))).first()[0] == seconds


CASES = [  # case, id, card, amount, time, product; expected reason
    ("missing amount", "A", "CARD-1", None, "86400", "W", "MISSING_EVENT_FIELDS"),
    ("missing card", "B", None, "100", "86400", "W", "UNKNOWN_CARD"),
    ("unknown card", "C", "CARD-99999", "100", "86400", "W", "UNKNOWN_CARD"),
    ("missing product", "D", "CARD-1", "100", "86400", None, None),
    ("missing id", None, "CARD-1", "100", "86400", "W", "MISSING_EVENT_FIELDS"),
    ("missing time", "K", "CARD-1", "100", None, "W", "MISSING_EVENT_FIELDS"),
    ("invalid time", "L", "CARD-1", "100", "INVALID_TS", "W", None),
    ("negative amount", "M", "CARD-1", "-50", "86400", "W", None),
    ("huge amount", "N", "CARD-1", "1e9", "86400", "W", None),
    ("unknown category", "O", "CARD-1", "100", "86400", "UNKNOWN_VAL_XYZ", None),
    ("incomplete profile", "P", "CARD-2", "100", "86400", "W", "INCOMPLETE_HYDRATION"),
]


def test_negative_cases(spark):
    events = spark.createDataFrame([(*c[1:6], 1, 1) for c in CASES], "TransactionID string, card_id string, TransactionAmt string, "
                                   "TransactionDT string, ProductCD string, isFraud int, fraud_bool int")
    profiles = spark.createDataFrame([("1", 11, "visa", "debit"), ("2", 12, None, "debit")],
                                     "card_id string, card1 int, card4 string, card6 string")
    rows = clean.assert_no_labels(clean.normalize_event(events))
    got = {r["transaction_id"]: r for r in hydrate.gate(joins.lookup_profile(rows, profiles)).collect()}
    assert {i: r["rejection_reason"] for i, r in got.items()} == {c[1]: c[6] for c in CASES}
    assert got["P"]["missing_features"] == ["card4"] and got["C"]["missing_features"] == ["card1", "card4", "card6", "addr1"]
    kept, rejected = hydrate.quarantine(hydrate.gate(joins.lookup_profile(rows, profiles)))
    assert kept.count() + rejected.count() == len(CASES)


def test_history_excludes_rejected_current_and_future_rows(spark):
    events = spark.createDataFrame([("a", "CARD-1", 10.0, 100.0, "W"), ("b", "CARD-1", None, 200.0, "W"), ("c", "CARD-1", 5.0, 300.0, "W"),
                                    ("d", "CARD-1", 5.0, 300.0, "W"), ("e", "CARD-1", 5.0, 250.0, "W")],
                                   "transaction_id string, card_id string, amount double, event_time double, product_code string")
    events = events.withColumn("event_time", F.col("event_time").cast("long"))
    profiles = spark.createDataFrame([("1", 11, "visa", "debit")], "card_id string, card1 int, card4 string, card6 string")
    got = {r["transaction_id"]: (r["c1"], r["d1"]) for r in hydrate.hydrate(events, profiles, day=1.0).collect()}
    assert got == {"a": (1.0, 0.0), "b": (2.0, 100.0), "c": (3.0, 200.0), "d": (3.0, 200.0), "e": (2.0, 150.0)}


def test_labels_are_found_and_refused(spark):
    nested = spark.createDataFrame([((1, 2),)], "x struct<isFraud:int,b:int>")
    assert clean.label_columns(nested) == ["x.isFraud"]
    with pytest.raises(ValueError):
        clean.assert_no_labels(nested)
    with pytest.raises(ValueError):
        prep.enforce_contract(nested, ["fraud_bool"])


def test_schema_diff(spark):
    a, b = spark.createDataFrame([], "a int, b string, c int"), spark.createDataFrame([], "a int, b long, d int")
    assert {tuple(r) for r in joins.schema_diff(a, b).collect()} == {
        ("b", "string", "bigint"), ("c", "int", None), ("d", None, "int")}


def test_check_counts(spark):
    df = spark.createDataFrame([("train",), ("train",), ("val",)], "split string")
    got = {r["split"]: r["passed"] for r in clean.check_counts(df, {"train": 2, "val": 2}).collect()}
    assert got == {"train": True, "val": False}


def test_sample_is_stable(spark):
    df = spark.range(1000)
    one = {r[0] for r in clean.sample_n(df, 50, "id", 7).collect()}
    two = {r[0] for r in clean.sample_n(df.repartition(7), 50, "id", 7).collect()}
    assert one == two and len(one) == 50 and one != {r[0] for r in clean.sample_n(df, 50, "id", 8).collect()}
