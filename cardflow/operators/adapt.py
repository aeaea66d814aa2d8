"""Monitoring and retraining over periods: a driver loop whose steps are Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardflow.operators import drift
from cardflow.operators.bootstrap import paired_bootstrap
from cardflow.operators.metrics import average_precision, best_of_sweep, confusion, curve, sweep
from cardflow.operators.model import TreeConfig, score, train_gbt
from cardflow.session import materialize


def adapt(df: DataFrame, period: str, label: str, numeric: Sequence[str], categorical: Sequence[str], features: Sequence[str],
          train: Sequence[int], validate: int, monitor: Sequence[int], evaluate: Sequence[int], keys: Sequence[str] = (),
          trigger_features: int = drift.TRIGGER_FEATURES, min_rows: int = drift.MIN_ROWS, clip: str = "none",
          replicates: int = 2000, seed: int = 42, config: TreeConfig = TreeConfig()) -> DataFrame:
    """Train on the first periods, freeze the threshold on the validation period, then go through
    the later periods in order: evaluate the static and the adaptive model where asked, and
    after that monitor, retraining on everything up to the period when the trigger fires.

    One row per period: shifted features, whether it fired, the adaptive version in use, and
    for evaluated periods both average precisions and the interval of their difference."""
    spark: SparkSession = df.sparkSession

    def rows(periods: Sequence[int]) -> DataFrame:
        return df.filter(F.col(period).isin(list(periods)))

    static = train_gbt(rows(train), features, label, config)
    adaptive, version = static, 1
    swept = sweep(score(rows([validate]), static, [label]), label, "probability")
    threshold = best_of_sweep(swept).first()["threshold"]
    reference = drift.fit_psi(rows(train), numeric, categorical)

    out = []
    for p in sorted({*monitor, *evaluate}):
        now = rows([p])
        line = {"period": int(p), "version": f"v{version}", "threshold": float(threshold)}
        if p in evaluate:
            both = materialize(score(score(now, static, [*features, label], "p_static"), adaptive, [label, "p_static"], "p_adaptive"))
            for name in ("static", "adaptive"):
                line[f"ap_{name}"] = average_precision(curve(both, label, f"p_{name}")).first()[0]
                line[f"f1_{name}"] = confusion(both, label, f"p_{name}", threshold).first()["f1"]
            interval = paired_bootstrap(both, label, "p_static", "p_adaptive", replicates, seed).first()
            line["delta"] = line["ap_adaptive"] - line["ap_static"]
            if interval:
                line["ci_lower"], line["ci_upper"] = interval["ci_lower"], interval["ci_upper"]
        if p in monitor:
            fired = drift.drift_trigger(drift.psi(reference, now, clip), now.count(), features=trigger_features,
                                        min_rows=min_rows).first()
            line["shifted"], line["triggered"] = int(fired["shifted"]), bool(fired["triggered"])
            if fired["triggered"]:
                known = sorted({r[0] for r in df.select(period).distinct().collect() if r[0] <= p})
                adaptive, version = train_gbt(rows(known), features, label, config), version + 1
        out.append(line)
    schema = ("period int, version string, threshold double, ap_static double, ap_adaptive double, f1_static double, "
              "f1_adaptive double, delta double, ci_lower double, ci_upper double, shifted int, triggered boolean")
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(line.get(n) for n in names) for line in out], schema)
