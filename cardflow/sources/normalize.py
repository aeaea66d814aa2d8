"""Four source shapes to one event schema (all-string rows in, typed events out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Columns by which a source shape is recognised, first match wins.
SIGNATURES = {
    "wide": ("TransactionID",),
    "card10k": ("merchant_category", "device_trust_score"),
    "mobile_money": ("nameOrig", "oldbalanceOrg"),
}

EVENT_COLUMNS = ("transaction_id", "card_id", "amount", "merchant_id", "device_type", "country", "is_fraud",
                 "dataset_source")


def detect_source(df: DataFrame) -> str:
    for kind, names in SIGNATURES.items():
        if any(n in df.columns for n in names):
            return kind
    return "custom"


class _Row:
    """Column access with defaults for what the source does not have."""

    def __init__(self, df: DataFrame):
        self.have = df.columns

    def text(self, *names: str, default: str | None = None) -> Column:
        found = [F.col(n).cast("string") for n in names if n in self.have]
        return F.coalesce(*found, F.lit(default).cast("string")) if found else F.lit(default).cast("string")

    def amount(self, *names: str, default: float = 0.0) -> Column:
        return F.round(F.coalesce(self.text(*names).try_cast("double"), F.lit(default)), 2)

    def flag(self, *names: str) -> Column:
        return F.coalesce(self.text(*names).try_cast("int"), F.lit(0)) == 1


def _wide(r: _Row) -> dict[str, Column]:
    card, country = r.text("card1", default="0"), r.text("addr2", default="US")
    return {
        "transaction_id": F.concat(F.lit("TX-"), r.text("TransactionID")),
        "card_id": F.when(card == "", "CARD-UNKNOWN").otherwise(F.concat(F.lit("CARD-"), card)),
        "amount": r.amount("TransactionAmt"),
        "merchant_id": F.concat(F.lit("M-"), r.text("ProductCD", default="W")),
        "device_type": F.when(r.text("DeviceType") == "desktop", "web").otherwise("mobile"),
        "country": F.when(country == "", "US").otherwise(country),
        "is_fraud": r.flag("isFraud"),
        **{c: r.text(c, default="") for c in ("card2", "card4", "card6", "P_emaildomain")},
    }


def _card10k(r: _Row) -> dict[str, Column]:
    tx, age = r.text("transaction_id"), r.text("cardholder_age", default="0")
    slot = F.lpad((tx.try_cast("long") % 500).cast("string"), 3, "0")
    return {
        "transaction_id": F.concat(F.lit("TX-"), tx),
        "card_id": F.when(tx.rlike("^[0-9]+$"), F.concat(F.lit("CARD-HOLDER-"), age, F.lit("-"), slot))
        .otherwise(F.concat(F.lit("CARD-"), age)),
        "amount": r.amount("amount"),
        "merchant_id": F.concat(F.lit("CAT-"), r.text("merchant_category", default="Retail")),
        "device_type": F.when(F.coalesce(r.text("device_trust_score").try_cast("int"), F.lit(50)) < 50, "mobile")
        .otherwise("web"),
        "country": F.when(r.flag("foreign_transaction"), "FOREIGN").otherwise("LOCAL"),
        "is_fraud": r.flag("is_fraud"),
        "velocity_24h": F.coalesce(r.text("velocity_last_24h").try_cast("int"), F.lit(0)),
        "location_mismatch": r.flag("location_mismatch"),
    }


def _mobile_money(r: _Row) -> dict[str, Column]:
    sender = r.text("nameOrig", default="UNKNOWN")
    # The id is derived from the row itself, so a replay produces the same one.
    suffix = F.pmod(F.xxhash64(*[r.text(c) for c in ("step", "nameOrig", "nameDest", "amount")]), F.lit(9000)) + 1000
    return {
        "transaction_id": F.concat(F.lit("TX-PS-"), F.right(sender, F.lit(6)), F.lit("-"), suffix.cast("string")),
        "card_id": sender,
        "amount": r.amount("amount"),
        "merchant_id": r.text("nameDest", default="UNKNOWN"),
        "device_type": F.lit("mobile"),
        "country": F.lit("GLOBAL"),
        "is_fraud": r.flag("isFraud"),
        "type": r.text("type", default="PAYMENT"),
        "oldbalanceOrg": r.text("oldbalanceOrg", default="0").try_cast("double"),
        "newbalanceOrig": r.text("newbalanceOrig", default="0").try_cast("double"),
    }


def _custom(r: _Row) -> dict[str, Column]:
    return {
        "transaction_id": F.concat(F.lit("TX-"), r.text("transaction_id", "id")),
        "card_id": r.text("card_id", "account_id", default="CARD-UNKNOWN"),
        "amount": r.amount("amount", "Amount", default=100.0),
        "merchant_id": r.text("merchant_id", default="M100"),
        "device_type": F.lit("web"),
        "country": F.lit("US"),
        "is_fraud": r.flag("is_fraud", "Class"),
    }


SHAPES = {"wide": _wide, "card10k": _card10k, "mobile_money": _mobile_money, "custom": _custom}


def normalize_source(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Events in the common schema plus the extra columns of the source; combine sources with
    ``unionByName(allowMissingColumns=True)``."""
    kind = kind or detect_source(df)
    shape = SHAPES[kind](_Row(df))
    return df.select(*[c.alias(n) for n, c in shape.items()], F.lit(kind).alias("dataset_source"))
