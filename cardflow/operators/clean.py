"""Cleaning, filters, rules and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from cardflow.functions.columns import canonical_card, epoch_seconds, true_labels

# Names under which the target may appear.
LABEL_ALIASES = ("isFraud", "is_fraud", "fraud_bool")

# Alias groups of the user event, first present wins.
EVENT_ALIASES = {
    "user_id": ("user_id", "userId", "customer_id", "customerId", "uid"),
    "transaction_id": ("transaction_id", "transactionId", "id", "txn_id", "txnId"),
    "event_time": ("event_time", "timestamp", "transaction_time", "time"),
    "amount": ("amount", "transaction_amount", "value"),
}

# Columns of the compact wire record.
COMPACT_FIELDS = ("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "card2",
                  "card3", "card4", "card5", "card6", "addr1", "addr2", "P_emaildomain", "R_emaildomain")


def parse_events(df: DataFrame, schema: StructType | str, value: str = "value") -> DataFrame:
    """JSON payload to columns; a malformed payload gives NULL fields."""
    return df.withColumn("__t", F.from_json(F.col(value).cast("string"), schema)).select(
        *[c for c in df.columns if c != value], "__t.*")


def validate_events(df: DataFrame, required: Sequence[str], amount: str = "amount") -> DataFrame:
    """Rows with every required field and a non-negative amount."""
    keep = F.col(amount) >= 0
    for name in required:
        keep = keep & F.col(name).isNotNull()
    return df.filter(keep)


def clean_transactions(df: DataFrame, amount: str, time: str, card: str) -> DataFrame:
    """Amount present and non-negative, time present, card as string ``card_id``."""
    return (df.filter(F.col(amount).isNotNull() & (F.col(amount) >= 0) & F.col(time).isNotNull())
            .withColumn("card_id", F.col(card).cast("string")))


def clean_lenient(df: DataFrame, time: str | None = None, amount: str | None = None,
                  label: str | None = None) -> DataFrame:
    """Unparsable or missing numbers become 0; the label becomes a byte."""
    out = df
    if time and time in df.columns:
        out = out.withColumn("event_time_seconds", F.coalesce(F.col(time).try_cast("double"), F.lit(0.0)))
    if amount and amount in df.columns:
        out = out.withColumn(amount, F.coalesce(F.col(amount).try_cast("double"), F.lit(0.0)))
    if label and label in df.columns:
        out = out.withColumn(label, F.coalesce(F.col(label).try_cast("double"), F.lit(0.0)).cast("tinyint"))
    return out


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = EVENT_ALIASES) -> DataFrame:
    """One column per alias group. A missing user is UNKNOWN, a missing amount 0, and a missing
    transaction id is made of user and amount."""
    def pick(name: str, *default: Column) -> Column:
        found = [F.col(a).cast("string") for a in aliases[name] if a in df.columns]
        return F.coalesce(*found, *default) if found or default else F.lit(None).cast("string")

    user = pick("user_id", F.lit("UNKNOWN"))
    amount = F.coalesce(pick("amount").try_cast("double"), F.lit(0.0))
    made_up = F.concat(F.lit("txn-"), user, F.lit("-"), amount.cast("string"))
    return df.select(pick("transaction_id", made_up).alias("transaction_id"), user.alias("user_id"),
                     amount.alias("amount"), pick("event_time").alias("event_time"))


def drop_labels(df: DataFrame) -> DataFrame:
    return df.drop(*LABEL_ALIASES)


def label_columns(df: DataFrame) -> list[str]:
    """Label aliases present at the top level or inside structs."""
    def walk(schema: StructType, path: str) -> list[str]:
        found = []
        for field in schema.fields:
            if field.name in LABEL_ALIASES:
                found.append(path + field.name)
            if isinstance(field.dataType, StructType):
                found += walk(field.dataType, f"{path}{field.name}.")
        return found
    return walk(df.schema, "")


def assert_no_labels(df: DataFrame) -> DataFrame:
    """The feature table itself, or an error that names the label columns in it."""
    found = label_columns(df)
    if found:
        raise ValueError(f"label columns in a feature table: {found}")
    return df


def normalize_event(df: DataFrame) -> DataFrame:
    """Raw stream events to the scoring shape: labels dropped, card prefixed, time in seconds,
    product without its ``M-`` prefix and ``W`` by default. 0 is a value, only NULL is missing."""
    have = df.columns

    def pick(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    card = pick("card_id", "card1", "user_id")
    time = pick("TransactionDT", "epoch_timestamp", "timestamp")
    product = F.coalesce(F.nullif(pick("ProductCD", "merchant_id"), F.lit("")), F.lit("W"))
    seconds = F.when(time.isNotNull(), F.coalesce(epoch_seconds(time.try_cast("double")), F.lit(0.0)))
    return df.select(
        pick("TransactionID", "transaction_id", "id").alias("transaction_id"),
        F.when(card.isNull(), "CARD-UNKNOWN").when(card.startswith("CARD-"), card)
        .otherwise(F.concat(F.lit("CARD-"), card)).alias("card_id"),
        pick("TransactionAmt", "amount").try_cast("double").alias("amount"),
        seconds.alias("event_time"),
        F.when(product.startswith("M-"), F.regexp_replace(product, "M-", "")).otherwise(product).alias("product_code"),
        F.nullif(pick("device_type", "DeviceType"), F.lit("")).alias("device_type"),
        F.nullif(pick("country", "addr2"), F.lit("")).alias("country"))


def compact_record(df: DataFrame) -> DataFrame:
    """The 15 wire fields from an all-string row, missing ones with their defaults."""
    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)

    kinds = {"TransactionID": "int", "isFraud": "int", "TransactionDT": "int", "TransactionAmt": "double"}
    return df.select(*[
        text(f, "0").cast(kinds[f]).alias(f) if f in kinds else
        text(f, "UNKNOWN" if f == "card1" else "").alias(f) for f in COMPACT_FIELDS])


def typed_record(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each text column split by what it holds: whole number, decimal number or text; "" is missing."""
    out = []
    for c in cols:
        text = F.nullif(F.col(c).cast("string"), F.lit(""))
        whole = F.when(~text.contains("."), text.try_cast("long"))
        real = F.when(text.contains("."), text.try_cast("double"))
        out.append(F.struct(whole.alias("int"), real.alias("float"),
                            F.when(whole.isNull() & real.isNull(), text).alias("text")).alias(c))
    return df.select(*[c for c in df.columns if c not in cols], *out)


def apply_rules(df: DataFrame, amount: str = "amount", country: str = "country", mismatch: str | None = None,
                velocity: str | None = None, threshold: float = 5000.0, max_velocity: int = 5) -> DataFrame:
    """Rule hits as a list of reasons. The ground-truth label is not a rule."""
    place = F.col(country) == "FOREIGN"
    if mismatch:
        place = place | F.col(mismatch)
    rules = {"HIGH_AMOUNT": F.col(amount) >= threshold, "LOCATION_MISMATCH": place}
    if velocity:
        rules["HIGH_VELOCITY"] = F.col(velocity) > max_velocity
    return df.withColumn("reasons", true_labels(rules)).withColumn("flagged", F.size("reasons") > 0)


def project_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def chronological_split(df: DataFrame, time: str, train_end, val_end) -> DataFrame:
    """``split``: train up to ``train_end``, val up to ``val_end`` (both inclusive), then test."""
    return df.withColumn("split", F.when(F.col(time) <= train_end, "train")
                         .when(F.col(time) <= val_end, "val").otherwise("test"))


def split_stats(df: DataFrame, time: str, label: str) -> DataFrame:
    """Rows, positives, rate and time range per split and in total."""
    return (df.rollup("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("rate"), F.min(time).alias("t_min"), F.max(time).alias("t_max"))
        .withColumn("split", F.coalesce("split", F.lit("total"))))


def period_split(df: DataFrame, period: str, names: Mapping[int, str]) -> DataFrame:
    """``split`` by period number; unmapped periods are dropped."""
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn("split", F.try_element_at(named, F.col(period))).filter(F.col("split").isNotNull())


def unmapped_periods(df: DataFrame, period: str, names: Mapping[int, str]) -> DataFrame:
    """Rows of each period that ``period_split`` drops."""
    return df.filter(~F.coalesce(F.col(period).isin(list(names)), F.lit(False))).groupBy(period).agg(F.count(F.lit(1)).alias("rows"))


def check_counts(df: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Rows per split against the expected number."""
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(
        "split", "rows", F.try_element_at(wanted, F.col("split")).cast("long").alias("expected")).withColumn(
        "passed", F.col("rows").eqNullSafe(F.col("expected")))


def sample_n(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the id: the same ones on every run."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), id_col).limit(n)


def canonical_keys(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, canonical_card(col))
