"""Poisson weights for the bootstrap: plain numpy, run inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

BLOCK = 1 << 21  # weights held at a time
SPREAD = 12  # deviations from the mean that a table of probabilities covers; what lies beyond is below 1e-30

# Executors get this code with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers: neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, replicates: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) by (key, replicate)."""
    base = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(salt))
    steps = mix((replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    bits = mix(base[:, None] ^ steps[None, :])
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def poisson_weights(counts: np.ndarray, keys: np.ndarray, replicates: np.ndarray, salt: int) -> np.ndarray:
    """Weights of shape (groups, replicates) with mean ``counts``."""
    u = uniform(keys, replicates, salt)
    out = np.zeros(u.shape)
    for mean in np.unique(counts[counts > 0]):
        rows = counts == mean
        least, cumulated = _table(float(mean))
        out[rows] = least + np.searchsorted(cumulated, u[rows])
    return out


def _table(mean: float) -> tuple[int, np.ndarray]:
    """The least count that matters and the distribution function from there, by the ratios of neighbouring probabilities."""
    reach = SPREAD * mean ** 0.5 + 20
    least, most = max(0, int(mean - reach)), int(mean + reach)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / np.arange(least + 1, most + 1)))])
    cumulated = np.cumsum(np.exp(logs - logs.max()))
    return least, cumulated / cumulated[-1]


def weighted_blocks(pdf: pd.DataFrame, replicates: int, seed: int) -> Iterator[tuple]:
    """Scores in descending order with the positive and negative weights of each group."""
    pdf = pdf.sort_values(["score", "key"], ascending=[False, True], kind="stable")
    ids = np.arange(replicates)
    rows = max(1, BLOCK // replicates)
    for at in range(0, len(pdf), rows):
        part = pdf.iloc[at:at + rows]
        keys = part["key"].to_numpy()
        yield (part["score"].to_numpy(),
               poisson_weights(part["pos"].to_numpy(), keys, ids, seed * 4 + 11),
               poisson_weights(part["neg"].to_numpy(), keys, ids, seed * 4 + 1013))
