"""Column-level helpers shared by batch and streaming code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Amount scales, (upper edge, label) in rising order, last label open-ended.
AMOUNT_SCALE_BELOW = ((100.0, "LOW"), (1000.0, "MEDIUM"), (10000.0, "HIGH"), (None, "VERY_HIGH"))
AMOUNT_SCALE_UPTO = ((500.0, "LOW"), (2000.0, "MEDIUM"), (5000.0, "HIGH"), (None, "VERY_HIGH"))

# Risk tiers (amount above, score), highest first, and the base score.
RISK_TIERS = ((5000.0, 0.95), (1000.0, 0.60), (250.0, 0.30))
RISK_BASE = 0.05
AUDIT_SCORE = 0.60

EPOCH_MS_ABOVE = 1e11
DAY_SECONDS = 86400
MONEY_UNIT = 1e6  # money is added up in millionths unless the caller gives another unit
LONG_UNITS = 9e18  # more units do not fit a long


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _countable(x: Column, unit: float) -> Column:
    return F.abs(x) < F.lit(LONG_UNITS / unit)  # NaN is above everything


def money(c: Column | str, unit: float = MONEY_UNIT) -> Column:
    """The whole units of an amount (millionths by default): sums do not depend on row order and differences lose no
    digits. Amounts that are not finite or too large for a long have 0 here; what is missing is in ``money_rest``."""
    x = _col(c).cast("double")
    return F.when(_countable(x, unit), F.rint(x * unit).cast("long")).when(x.isNotNull(), F.lit(0).cast("long")).cast("decimal(38,0)")


def money_rest(c: Column | str, unit: float = MONEY_UNIT) -> Column:
    """What ``money`` leaves: parts of a unit (0 for amounts with at most the digits of the unit), and whole amounts that are
    not finite or too large. Added up as doubles, as Spark's own sum does."""
    x = _col(c).cast("double")
    return F.when(_countable(x, unit), x - F.rint(x * unit) / unit).otherwise(x)


def amount_of(units: Column | str, rest: Column | str | None = None, unit: float = MONEY_UNIT) -> Column:
    """Units, and the rest if there is one, back to an amount."""
    whole = _col(units).cast("double") / unit
    return whole if rest is None else whole + _col(rest)


def money_sum(c: Column | str, unit: float = MONEY_UNIT) -> Column:
    return amount_of(F.sum(money(c, unit)), F.sum(money_rest(c, unit)), unit)


def bucketize(c: Column | str, scale: Sequence[tuple[float | None, str]], right: bool = False) -> Column:
    """Label of the first edge that is above the value (``right``: at or above)."""
    c = _col(c)
    out = None
    for edge, label in scale:
        if edge is None:
            return out.when(c.isNotNull(), F.lit(label))
        hit = c <= edge if right else c < edge
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def log_amount(c: Column | str, offset: float = 1.0) -> Column:
    """ln(max(c, 0) + offset)."""
    return F.log(F.greatest(_col(c), F.lit(0.0)) + F.lit(offset))


def canonical_card(c: Column | str) -> Column:
    """All-digit keys get the CARD- prefix, other keys stay."""
    c = _col(c).cast("string")
    return F.when(c.rlike("^[0-9]+$"), F.concat(F.lit("CARD-"), c)).otherwise(c)


def bare_card(c: Column | str) -> Column:
    """The key without its CARD- prefix."""
    return F.regexp_replace(_col(c).cast("string"), "^CARD-", "")


def epoch_seconds(c: Column | str) -> Column:
    """Numbers above 1e11 are milliseconds."""
    c = _col(c).cast("double")
    return F.when(c > EPOCH_MS_ABOVE, c / 1000.0).otherwise(c)


def to_epoch(c: Column | str) -> Column:
    """Seconds from a number or an ISO string; NULL if neither."""
    text = F.trim(_col(c).cast("string"))
    number = text.try_cast("double")
    stamp = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.coalesce(epoch_seconds(number), F.unix_micros(stamp) / 1e6)


def epoch_micros(seconds: Column | str) -> Column:
    """Seconds as whole microseconds, the time unit of the ordered functions."""
    return F.rint(_col(seconds) * 1e6).cast("long")


def first_present(*names: str, available: Sequence[str], default: Column | None = None) -> Column:
    """First non-null of the alias columns that exist."""
    found = [F.col(n) for n in names if n in available]
    if default is not None:
        found.append(default)
    return F.coalesce(*found) if found else F.lit(None)


def risk_score(amount: Column | str) -> Column:
    amount = _col(amount)
    out = None
    for above, score in RISK_TIERS:
        out = F.when(amount > above, score) if out is None else out.when(amount > above, score)
    return out.otherwise(RISK_BASE)


def audit_decision(score: Column | str) -> Column:
    return F.when(_col(score) >= AUDIT_SCORE, "FLAGGED_FOR_AUDIT").otherwise("APPROVED")


def true_labels(rules: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0 or NULL."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def hour_of_day(dt: Column | str) -> Column:
    return F.pmod(_col(dt).cast("double"), F.lit(float(DAY_SECONDS))) / 3600.0


def cyclic_hour(dt: Column | str) -> tuple[Column, Column]:
    angle = hour_of_day(dt) * (2.0 * 3.141592653589793 / 24.0)
    return F.sin(angle), F.cos(angle)
