"""Gradient boosting on histograms: trees grown best leaf first, one aggregation per round of growth.

Features are cut into bins at exact quantiles once; NULL and not-a-number are a bin of their own, and every split learns the side they go to. The binned rows
are stored with their margin. To grow a tree, each task adds up gradients by (leaf, feature, bin) for the leaves whose best split isn't known yet, Spark adds up
the tasks' parts, accumulates them over the bins and keeps the best split of each leaf: the driver gets one row per leaf. Best-first growth is then played
with the splits known so far; leaves it reaches that aren't known are counted in the next round, all at once. When all are known, the tree is that of growing one leaf at a time.

Gradients are added up as whole numbers, so a model doesn't depend on how the rows lie or in which order tasks end. What a task holds is
leaves x features x bins numbers, whatever the rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cardflow.operators.metrics import average_precision, curve
from cardflow.operators.ordered import running
from cardflow.operators.quantiles import long_form
from cardflow.session import drop_stored, materialize, stored_at

MISSING = 0  # the bin of NULL
MOST_BINS = 255
UNIT = 2**20  # gradients are counted in parts of one


@dataclass(frozen=True)
class BoostConfig:
    """``row_share`` of the rows, drawn anew every ``redraw`` trees, and ``feature_share`` of the features, drawn for each tree, are looked at. ``block`` trees
    are added to the stored margins and checked on the validation rows at a time; after ``patience`` trees without a better average precision training stops."""

    trees: int = 100
    leaves: int = 31
    rate: float = 0.1
    bins: int = 64
    min_rows: int = 20
    l1: float = 0.1
    l2: float = 1.0
    row_share: float = 0.8
    redraw: int = 5
    feature_share: float = 0.8
    patience: int = 50
    block: int = 10
    balanced: bool = True
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first. ``feature`` is -1 for a leaf, which leads to itself; bins up to ``upto`` go left."""

    feature: np.ndarray
    upto: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    depth: int

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            b = bins[rows, np.maximum(self.feature[at], 0)]
            goes_left = np.where(b == MISSING, self.missing_left[at], b <= self.upto[at])
            at = np.where(goes_left, self.left[at], self.right[at])
        return at


@dataclass(frozen=True)
class Model:
    """``edges``: per feature the rising values at which a next bin starts. ``history``: (trees, average precision on the validation rows)."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    history: list[tuple[int, float]] = field(default_factory=list)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Values that start a bin, so that bins hold about equally many rows; exact. At most ``bins`` numbers per feature reach the driver."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins must be between 2 and {MOST_BINS}")
    cells = long_form(df, features).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = materialize(cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    n = ("sum", F.col("n"))
    ranked = running(counts, ["feature"], [F.col("value")], {"upto": n}, totals={"size": n})
    bin_of = F.floor((F.col("upto") - F.col("n")) * bins / F.col("size"))
    found: dict[str, list[float]] = {f: [] for f in features}
    for r in ranked.groupBy("feature", bin_of.alias("bin")).agg(F.min("value").alias("start")).collect():
        found[r["feature"]].append(r["start"])
    return [np.array(sorted(found[f])[1:], np.float64) for f in features]


def _bins(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty((len(columns[0]) if columns else 0, len(edges)), np.uint8)
    for k, (x, starts) in enumerate(zip(columns, edges, strict=True)):
        out[:, k] = np.where(np.isnan(x), MISSING, 1 + np.searchsorted(starts, x, side="right"))
    return out


def _doubles(column: pa.Array) -> np.ndarray:
    """NULL becomes not-a-number."""
    return np.asarray(column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)


def _binned(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], base: float) -> DataFrame:
    """``(bins, y, draw, held, margin)``; bins are a byte per feature."""
    rows = df.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], "y", "draw", "held")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _bins([_doubles(batch.column(k)) for k in range(len(edges))], edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.tobytes() for c in codes], pa.binary()), *[batch.column(len(edges) + j) for j in range(3)],
                 pa.array(np.full(len(codes), base))], ["bins", "y", "draw", "held", "margin"])

    return rows.mapInArrow(cut, "bins binary, y int, draw long, held boolean, margin double")


def _codes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _drawn(draw: np.ndarray, seed: int, share: float) -> np.ndarray:
    """The same rows for a seed, wherever they lie."""
    x = draw.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def histograms(state: DataFrame, done: Sequence[Tree], tree: Tree, open_leaves: Sequence[int], chosen: Sequence[int], width: int,
               weights: tuple[float, float], seed: int, row_share: float) -> DataFrame:
    """``(leaf, feature, bin, g, h, n)``: sums of gradients, of their slopes, and rows, for the open leaves of a tree that is being grown."""
    slots = np.full(len(tree.feature), -1)
    slots[list(open_leaves)] = np.arange(len(open_leaves))
    cells, leaves = MOST_BINS + 1, np.array(open_leaves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(chosen), len(leaves) * cells), np.int64)
        for batch in batches:
            codes = _codes(batch, width)
            slot = slots[tree.leaf_of(codes)]
            keep = (slot >= 0) & _drawn(batch.column("draw").to_numpy(), seed, row_share)
            codes, slot = codes[keep], slot[keep]
            y = batch.column("y").to_numpy()[keep]
            p = _sigmoid(_margins(batch.column("margin").to_numpy()[keep], codes, done))
            w = np.where(y == 1, weights[1], weights[0])
            parts = (np.rint((p - y) * w * UNIT), np.rint(p * (1 - p) * w * UNIT), None)
            for k, f in enumerate(chosen):
                cell = slot * cells + codes[:, f]
                for j, x in enumerate(parts):
                    total[j, k] += np.bincount(cell, x, len(leaves) * cells).astype(np.int64)
        feature, cell = np.nonzero(total[2])
        columns = [leaves[cell // cells], np.array(chosen)[feature], cell % cells, *total[:, feature, cell]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["leaf", "feature", "bin", "g", "h", "n"])

    parts = state.filter("NOT held").mapInArrow(count, "leaf long, feature long, bin long, g long, h long, n long")
    return parts.groupBy("leaf", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def _shrunk(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def best_splits(sums: DataFrame, config: BoostConfig) -> DataFrame:
    """One row per leaf: the split with the greatest gain, among equals that of the first feature and the lowest bin, and the sums on its sides.
    A leaf without a split that gains has no row."""
    whole = W.partitionBy("leaf", "feature")
    upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    present = F.col("bin") != MISSING
    cols = [c.alias(name + x) for x in ("g", "h", "n") for name, c in (
        ("left_", F.sum(F.when(present, F.col(x)).otherwise(0)).over(upto)), ("all_", F.sum(x).over(whole)),
        ("missing_", F.sum(F.when(present, 0).otherwise(F.col(x))).over(whole)))]
    rows = sums.select("leaf", "feature", "bin", *cols).filter(present)
    sides = rows.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True)))).filter("NOT missing_left OR missing_n > 0")
    for x in ("g", "h", "n"):
        sides = sides.withColumn("l" + x, F.col("left_" + x) + F.when(F.col("missing_left"), F.col("missing_" + x)).otherwise(0)).withColumn(
            "r" + x, F.col("all_" + x) - F.col("l" + x))

    def worth(g: Column, h: Column) -> Column:
        return F.pow(_shrunk(g / UNIT, config.l1), F.lit(2.0)) / (h / UNIT + config.l2)

    gain = worth(F.col("lg"), F.col("lh")) + worth(F.col("rg"), F.col("rh")) - worth(F.col("all_g"), F.col("all_h"))
    found = sides.filter((F.col("ln") >= config.min_rows) & (F.col("rn") >= config.min_rows)).withColumn("gain", gain).filter("gain > 1e-9")
    order = F.struct("gain", -F.col("feature"), -F.col("bin"), ~F.col("missing_left"))
    split = F.struct("gain", "feature", "bin", "missing_left", "lg", "lh", "rg", "rh")
    return found.groupBy("leaf").agg(F.max_by(split, order).alias("s")).select("leaf", "s.*")


class _Growth:
    """A tree that is being grown. Nodes are named by their path; ``known`` has the best split of a node, or None if it has no good one."""

    def __init__(self, config: BoostConfig):
        self.config, self.known, self.sums = config, {}, {"": None}

    def play(self) -> tuple[Tree, list[str], list[int]]:
        """Best-first growth with the splits known so far: the tree, the path of each node, and the leaves that aren't known."""
        paths, links, queue = [""], {}, []

        def offer(i: int) -> None:
            split = self.known.get(paths[i])
            if split is not None:
                heapq.heappush(queue, (-split["gain"], i))

        offer(0)
        while queue and len(links) + 1 < self.config.leaves:
            _, i = heapq.heappop(queue)
            split, here = self.known[paths[i]], len(paths)
            links[i] = here
            for side, s in (("l", "l"), ("r", "r")):
                paths.append(paths[i] + side)
                self.sums[paths[-1]] = (split[s + "g"], split[s + "h"])
                offer(len(paths) - 1)
        n = len(paths)
        leads = np.arange(n)
        tree = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), leads.copy(), leads.copy(), np.zeros(n), np.zeros(n), max(map(len, paths)))
        for i, p in enumerate(paths):
            if i in links:
                split = self.known[p]
                tree.feature[i], tree.upto[i], tree.missing_left[i], tree.gain[i] = split["feature"], split["bin"], split["missing_left"], split["gain"]
                tree.left[i], tree.right[i] = links[i], links[i] + 1
            elif self.sums[p] is not None:
                g, h = (x / UNIT for x in self.sums[p])
                tree.value[i] = -self.config.rate * np.sign(g) * max(abs(g) - self.config.l1, 0.0) / (h + self.config.l2)
        # what the last split of a full tree made isn't split again
        last = n - 2 if len(links) + 1 == self.config.leaves else n
        return tree, paths, [i for i, p in enumerate(paths[:last]) if i not in links and p not in self.known]


def _grow(state: DataFrame, done: Sequence[Tree], width: int, weights: tuple[float, float], config: BoostConfig, number: int) -> Tree:
    rng = np.random.default_rng((config.seed, number))
    chosen = sorted(rng.choice(width, max(1, round(config.feature_share * width)), replace=False).tolist())
    growth = _Growth(config)
    while True:
        tree, paths, unknown = growth.play()
        if not unknown:
            return tree
        sums = histograms(state, done, tree, unknown, chosen, width, weights, config.seed * 1_000_003 + number // config.redraw, config.row_share)
        growth.known.update({paths[i]: None for i in unknown})
        growth.known.update({paths[r["leaf"]]: r.asDict() for r in best_splits(sums, config).collect()})


def _margins(margin: np.ndarray, codes: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    for t in trees:
        margin = margin + t.value[t.leaf_of(codes)]
    return margin


def _advanced(state: DataFrame, trees: Sequence[Tree], width: int) -> DataFrame:
    """The rows with the margins after more trees."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margins(batch.column("margin").to_numpy(), _codes(batch, width), trees)
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return state.mapInArrow(add, state.schema)


def _precisions(state: DataFrame, trees: Sequence[Tree], width: int) -> list[float]:
    """Average precision on the validation rows after each of the trees."""

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin, codes = batch.column("margin").to_numpy(), _codes(batch, width)
            for k, t in enumerate(trees):
                margin = _margins(margin, codes, [t])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(margin), k)), pa.array(margin), batch.column("y")], ["tree", "margin", "y"])

    rows = state.filter("held").mapInArrow(after, "tree long, margin double, y int")
    found = {r["tree"]: r["average_precision"] for r in average_precision(curve(rows, "y", "margin", ["tree"]), ["tree"]).collect()}
    return [found[k] or 0.0 for k in range(len(trees))]


def train(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], config: BoostConfig = BoostConfig(), val: DataFrame | None = None) -> Model:
    """Boosted trees for a label of 0 and 1; rows without a label are left out. ``keys`` name a row, so that a draw of rows can be repeated. With ``balanced`` both classes weigh the same.
    With ``val``, trees beyond the one with the best average precision there are dropped. A table with one class only gives a constant."""
    spark = rows.sparkSession
    y = F.col(label).cast("int").alias("y")
    tables = [(rows, False)] + ([(val, True)] if val is not None else [])
    df = None
    for table, held in tables:
        part = table.filter(F.col(label).isNotNull()).select(*features, y, F.xxhash64(*keys).alias("draw"), F.lit(held).alias("held"))
        df = part if df is None else df.unionByName(part)
    edges = bin_edges(rows.filter(F.col(label).isNotNull()), features, config.bins)
    counts = {(r["held"], r["y"]): r["n"] for r in df.groupBy("held", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    neg, pos = counts.get((False, 0), 0), counts.get((False, 1), 0)
    if set(y for _, y in counts) - {0, 1} or not neg + pos:
        raise ValueError("training needs rows with labels 0 and 1")
    if not neg or not pos:
        return Model(list(features), edges, 60.0 if pos else -60.0)
    weights = (1.0, neg / pos if config.balanced else 1.0)
    base = 0.0 if config.balanced else float(np.log(pos / neg))
    model, width = Model(list(features), edges, base), len(features)
    state, path = stored_at(_binned(df, features, edges, base))
    checked = any(held for held, _ in counts)
    try:
        while len(model.trees) < config.trees:
            fresh: list[Tree] = []
            while len(fresh) < min(config.block, config.trees - len(model.trees)):
                fresh.append(_grow(state, fresh, width, weights, config, len(model.trees) + len(fresh)))
            start = len(model.trees)
            model.trees.extend(fresh)
            if checked:
                model.history.extend((start + k + 1, p) for k, p in enumerate(_precisions(state, fresh, width)))
                if len(model.trees) - best_round(model) >= config.patience:
                    break
            if len(model.trees) < config.trees:
                (state, new), old = stored_at(_advanced(state, fresh, width)), path
                path = new
                drop_stored(spark, old)
    finally:
        drop_stored(spark, path)
    if checked:
        del model.trees[best_round(model):]
    return model


def best_round(model: Model) -> int:
    """The number of trees with the best average precision; the least among equals."""
    return max(model.history, key=lambda at: (at[1], -at[0]))[0]


def probability(model: Model) -> Column:
    """Probability of the positive class from the columns of the features; for batches and streams."""

    def of(*columns: pa.Array) -> pa.Array:
        codes = _bins([_doubles(c) for c in columns], model.edges)
        return pa.array(_sigmoid(_margins(np.full(len(codes), model.base), codes, model.trees)))

    return F.arrow_udf(of, "double")(*[F.col(f).cast("double") for f in model.features])


def score(df: DataFrame, model: Model, keep: Sequence[str], name: str = "probability") -> DataFrame:
    return df.select(*keep, probability(model).alias(name))


def importance(spark: SparkSession, model: Model) -> DataFrame:
    """Per feature: gain over all splits on it, its share, and their number."""
    gain, splits = np.zeros(len(model.features)), np.zeros(len(model.features), int)
    for t in model.trees:
        inner = t.feature >= 0
        np.add.at(gain, t.feature[inner], t.gain[inner])
        np.add.at(splits, t.feature[inner], 1)
    total = gain.sum() or 1.0
    rows = [(f, float(g), float(g / total), int(s)) for f, g, s in zip(model.features, gain, splits, strict=True)]
    return spark.createDataFrame(rows, "feature string, gain double, importance double, splits long").orderBy(F.desc("gain"), "feature")


def nodes(spark: SparkSession, model: Model) -> DataFrame:
    """The model as a table: a row per node; values below ``threshold`` go to ``left``, NULL where ``missing_left`` says."""
    rows = []
    for k, t in enumerate(model.trees):
        for i, f in enumerate(t.feature.tolist()):
            starts = model.edges[f] if f >= 0 else None
            bound = None if f < 0 else float(starts[t.upto[i] - 1]) if t.upto[i] <= len(starts) else float("inf")
            rows.append((k, i, model.features[f] if f >= 0 else None, bound, bool(t.missing_left[i]) if f >= 0 else None,
                         int(t.left[i]) if f >= 0 else None, int(t.right[i]) if f >= 0 else None, float(t.value[i])))
    return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, value double")
