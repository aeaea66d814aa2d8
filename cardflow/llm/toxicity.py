"""Toxicity by a convolutional text classifier, trained in numpy.

A word (lower case, split at what is no letter) is the sum of the hashed embeddings of itself and of its first bytes, so that forms of one stem share most of it.
Filters of several widths slide over the words; the largest value of each filter anywhere in the text goes through ReLU to a logistic
output. As a filter is linear in the embeddings, its products with all of them are tabled once, and scoring a text is table lookups.

The fit takes every labelled row, whole, and is deterministic. Embeddings start as the smoothed log-odds of their slot over all rows in one dimension and small
noise in the others. The rows are dealt to parts by a hash of the text; in each of EPOCHS rounds a part is learned from the weights of the round before, and what the
parts changed is averaged by their rows (an embedding over the parts that changed it), in whole numbers, so that no order of rows or parts matters. The output is
shifted so that THRESHOLD separates the classes best; on top of it, a threshold is set for each language where it has enough labelled rows (`thresholds`), for use
with a language known from elsewhere; both count all labelled rows, by their logit to four digits. Language is never an input of a score.

Defined results: a null or empty text, or one without a word, gets the score of the filters' bias alone. Without rows of both classes the score is the share of
toxic rows, 0 if there are no rows. Texts are read whole, in parts of a few MB, with the words over a seam seen by both parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm import arrays
from cardflow.llm.frames import Tables, small, table

SLOTS = 1 << 15
PREFIXES = (4, 5)
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Labelled rows of a part (about), and bytes of coded words that a part holds at once.
PART_ROWS = 2_500
PART_BYTES = 16 << 20
#: Words of a text that are learned from at once; what is held beside them is some hundred times as much.
BLOCK = 1 << 16
#: Most labels that are broadcast; beyond it, the join shuffles.
MOST_LABELS = 1_000_000
EPOCHS, RATE = 8, 0.03
THRESHOLD = 0.7
#: Labelled rows of each class that a language needs for a threshold of its own.
LANGUAGE_ROWS = 20

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word (itself and its prefixes), and each text's first word."""
    data, offsets = arrays.utf8(texts)
    starts, ends, first = arrays.spans(data, offsets, _NO_LETTER)
    hashes = arrays.prefix_hashes(data, starts, ends, lower=True, lengths=PREFIXES)
    slots = [((h + np.uint64(i)) % np.uint64(SLOTS)).astype(np.int32) + i * SLOTS for i, h in enumerate(hashes)]
    return np.stack(slots, axis=1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int32), first


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width x dimensions x filters
    bias: np.ndarray
    output: np.ndarray
    shift: float
    constant: float | None = None
    thresholds: dict = field(default_factory=dict)

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embedding @ part).astype(np.float32) for part in f] for f in self.filters]

    def pooled(self, slots: np.ndarray, first: np.ndarray, tables: list) -> np.ndarray:
        """The largest value of each filter in each text, at least 0."""
        n = len(first) - 1
        out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, len(slots), 1 << 17):  # words of a part, and as many as a filter looks ahead
            b = min(a + (1 << 17), len(slots))
            ahead = min(b + max(WIDTHS) - 1, len(slots))
            rows = np.clip(first, a, b) - a
            some = np.flatnonzero(np.diff(rows))
            stop = np.repeat(np.clip(first[1:][some], a, ahead) - a, np.diff(rows)[some])  # where the text of each word ends
            for w, width in enumerate(WIDTHS):
                value = np.zeros((b - a, FILTERS), np.float32)
                for k in range(width):
                    t = tables[w][k]
                    at = np.arange(k, b - a + k)
                    inside = at < stop
                    s = slots[a:ahead][np.minimum(at, ahead - a - 1)]
                    v = t[s[:, 0]]
                    for j in range(1, s.shape[1]):
                        v += t[s[:, j]]
                    value += v if k == 0 else v * inside[:, None]
                best = np.maximum.reduceat(value, rows[:-1][some], axis=0) + self.bias[w * FILTERS : (w + 1) * FILTERS]
                at = slice(w * FILTERS, (w + 1) * FILTERS)
                out[some, at] = np.maximum(out[some, at], best)
        return out

    def logits(self, slots: np.ndarray, first: np.ndarray, tables: list) -> np.ndarray:
        pooled = self.pooled(slots, first, tables)
        return np.clip((pooled * self.output[:-1]).sum(axis=1, dtype=np.float64) + self.output[-1] + self.shift, -30, 30)

    def score(self, slots: np.ndarray, first: np.ndarray, tables: list) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return (1 / (1 + np.exp(-self.logits(slots, first, tables)))).round(6)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text as three numbers of two bytes."""
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            slots, first = word_slots(part.column("text"))
            raw = (slots % SLOTS).astype("<u2")
            words = pa.array([raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([words, *(part.column(c) for c in ("toxic", "lang", "tie"))], names=["words", "toxic", "lang", "tie"])


def _slots(words: bytes) -> np.ndarray:
    """The table rows that `_coded` has written."""
    n = 1 + len(PREFIXES)
    return np.frombuffer(words, "<u2").reshape(-1, n).astype(np.int32) + np.arange(0, n * SLOTS, SLOTS, dtype=np.int32)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class a slot occurs, for the rows of a task."""
    seen = np.zeros((2, SLOTS * (1 + len(PREFIXES))), np.int64)
    for batch in batches:
        for words, label in zip(batch.column("words"), batch.column("toxic").to_pylist(), strict=True):
            seen[label, np.unique(_slots(words.as_py()))] += 1
    some = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["slot", "clean", "toxic"])


def _initial(seen: np.ndarray, n: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    size = seen.shape[1]
    odds = np.log((seen[1] + 0.1) / (n[1] + 0.2)) - np.log((seen[0] + 0.1) / (n[0] + 0.2))
    sure = (seen.sum(axis=0)) / (seen.sum(axis=0) + 2.0)
    embedding = rng.normal(0, 0.02, (size, DIMENSIONS)).astype(np.float32)
    embedding[:, 0] = np.where(seen.sum(axis=0) > 0, odds * sure, 0) / 3
    model = Model(embedding, [rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(FILTERS * len(WIDTHS), np.float32), np.append(rng.normal(0, 0.1, FILTERS * len(WIDTHS)), 0).astype(np.float32), 0.0)
    for f, w in zip(model.filters, WIDTHS, strict=True):
        f[:, 0, 0] = 0.5 / w
    model.output[:-1:FILTERS] = 0.6
    model.output[-1] = -2.0
    return model


def _flat(model: Model) -> np.ndarray:
    """All weights as rows of DIMENSIONS numbers: the embeddings, and behind them the others, filled up with zeros."""
    rest = np.concatenate([*(f.ravel() for f in model.filters), model.bias, model.output])
    rest = np.append(rest, np.zeros(-len(rest) % DIMENSIONS)).astype(np.float32)
    return np.concatenate([model.embedding, rest.reshape(-1, DIMENSIONS)])


def _shaped(flat: np.ndarray) -> Model:
    size = SLOTS * (1 + len(PREFIXES))
    rest, at = flat[size:].ravel().copy(), 0
    filters = []
    for w in WIDTHS:
        filters.append(rest[at : at + w * DIMENSIONS * FILTERS].reshape(w, DIMENSIONS, FILTERS))
        at += w * DIMENSIONS * FILTERS
    n = FILTERS * len(WIDTHS)
    return Model(flat[:size].copy(), filters, rest[at : at + n], rest[at + n : at + 2 * n + 1], 0.0)


def _learn(model: Model, texts: list[np.ndarray], y: list[int], weight: np.ndarray, rate: float) -> None:
    """One step for each text. The last row of the embeddings is zero and stands for the words behind the end of a text."""
    ahead = max(WIDTHS) - 1
    for t, label in zip(texts, y, strict=True):
        if not len(t):
            continue
        words = len(t)
        t = np.concatenate([t, np.full((ahead, t.shape[1]), len(model.embedding) - 1, t.dtype)])
        by_place = t.T.astype(np.intp)
        products = np.concatenate([part.T for f in model.filters for part in f])
        value, where = np.full(len(model.bias), -np.inf, np.float32), np.zeros(len(model.bias), int)
        for a in range(0, words, BLOCK):
            n = min(BLOCK, words - a)
            e = model.embedding.take(by_place[0, a : a + n + ahead], axis=0)
            for j in range(1, t.shape[1]):
                e += model.embedding.take(by_place[j, a : a + n + ahead], axis=0)
            p, at = products @ e.T, 0
            for w, width in enumerate(WIDTHS):
                v = p[at : at + FILTERS, :n]
                for k in range(1, width):
                    v = v + p[at + k * FILTERS : at + (k + 1) * FILTERS, k : k + n]
                at += width * FILTERS
                s = slice(w * FILTERS, (w + 1) * FILTERS)
                place = v.argmax(axis=1)
                most = v[np.arange(FILTERS), place]
                where[s], value[s] = np.where(most > value[s], place + a, where[s]), np.maximum(most, value[s])
        hidden = np.maximum(value + model.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ model.output[:-1] + model.output[-1], -30, 30)))
        g = np.float32((p - label) * weight[label] * rate)
        back = g * model.output[:-1] * (hidden > 0)
        model.output[:-1] -= g * hidden
        model.output[-1] -= g
        model.bias -= back
        changes = []
        for w, (f, width) in enumerate(zip(model.filters, WIDTHS, strict=True)):
            some = np.flatnonzero(back[w * FILTERS : (w + 1) * FILTERS])
            if len(some):
                windows = t[where[w * FILTERS + some][:, None] + np.arange(width)]
                d = back[w * FILTERS + some][:, None, None]
                changes.append((windows, (d * f[:, :, some].transpose(2, 0, 1))[:, :, None, :]))
                f[:, :, some] -= (d * model.embedding[windows].sum(axis=2)).transpose(1, 2, 0)
        for windows, grad in changes:
            np.subtract.at(model.embedding, windows, grad)
        model.embedding[-1] = 0


_UNIT = float(1 << 24)
_CHANGES = "row int, n long, " + ", ".join(f"d{i} long" for i in range(DIMENSIONS))


def _learned(batches: Iterator[pa.RecordBatch], flat: np.ndarray, weight: np.ndarray, epoch: int) -> Iterator[pa.RecordBatch]:
    """What each part changes in the weights, times its rows; rows come in the order of parts."""
    size = SLOTS * (1 + len(PREFIXES))
    model, part, n, held, texts, y, turns = None, None, 0, 0, [], [], 0

    def learn() -> None:
        nonlocal held, texts, y, turns
        order = np.random.default_rng([epoch, part, turns]).permutation(len(texts))
        _learn(model, [_slots(texts[i]) for i in order], [y[i] for i in order], weight, RATE / (1 + epoch))
        held, texts, y, turns = 0, [], [], turns + 1

    def changes() -> pa.RecordBatch:
        model.embedding = model.embedding[:-1]
        change = _flat(model) - flat
        rows = np.flatnonzero(change.any(axis=1) | (np.arange(len(change)) >= size))
        units = np.rint(change[rows].astype(np.float64) * (n * _UNIT)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(np.full(len(rows), n)), *(pa.array(c) for c in units.T.copy())],
                                          names=["row", "n", *(f"d{i}" for i in range(DIMENSIONS))])

    for batch in batches:
        for this, words, label in zip(batch.column("part").to_pylist(), batch.column("words"), batch.column("toxic").to_pylist(), strict=True):
            if this != part:
                if model is not None:
                    learn()
                    yield changes()
                model, part, n, turns = _shaped(flat), this, 0, 0
                model.embedding = np.concatenate([model.embedding, np.zeros((1, DIMENSIONS), np.float32)])
            texts.append(words.as_py())
            y.append(label)
            n, held = n + 1, held + len(texts[-1])
            if held >= PART_BYTES:
                learn()
    if model is not None:
        learn()
        yield changes()


def _train(rows: DataFrame, n: np.ndarray) -> Model:
    """rows: part, words, toxic; n: how many of each class."""
    seen = np.zeros((2, SLOTS * (1 + len(PREFIXES))))
    got = rows.select("words", "toxic").mapInArrow(_seen, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen[:, got.column("slot").to_numpy()] = [got.column("clean").to_numpy(), got.column("toxic").to_numpy()]
    flat = _flat(_initial(seen, n))
    weight = n.sum() / (2.0 * np.maximum(n, 1))
    for epoch in range(EPOCHS):
        some = rows.select("part", "words", "toxic").mapInArrow(lambda b, flat=flat, epoch=epoch: _learned(b, flat, weight, epoch), _CHANGES)
        got = some.groupBy("row").agg(*[F.sum(c).alias(c) for c in some.columns[1:]]).toArrow()  # a row for each row of the weights at most
        change = np.stack([got.column(f"d{i}").to_numpy() for i in range(DIMENSIONS)], axis=1) / (got.column("n").to_numpy()[:, None] * _UNIT)
        flat = flat.copy()
        flat[got.column("row").to_numpy()] += change.astype(np.float32)
    return _shaped(flat)


def _threshold(s: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut between two of the ascending scores at which the mean of both classes' accuracies is best; of equal ones the one in the widest gap."""
    right = np.append(0, np.cumsum(clean)) / max(clean.sum(), 1) + (toxic.sum() - np.append(0, np.cumsum(toxic))) / max(toxic.sum(), 1)
    cut = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    widths = np.concatenate([[0], np.diff(s), [0]])[best]
    return float(cut[best[int(np.argmax(widths))]])


def _logits(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    tables = model.tables()
    for batch in batches:
        for part in arrays.slices(batch, "words", 4 << 20):
            texts = [_slots(x.as_py()) for x in part.column("words")]
            z = model.logits(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), tables)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(z.round(4)), part.column("toxic")], names=["lang", "z", "toxic"])


def _cut(counts: pa.Table) -> pa.Table:
    """The threshold of a group, whose logits are as many as four digits tell apart."""
    counts = counts.sort_by("z")
    clean, toxic = (counts.column(c).to_numpy() for c in ("clean", "toxic"))
    cut = _threshold(counts.column("z").to_numpy(), clean, toxic)
    return pa.table({"of": counts.column("of").slice(0, 1), "cut": pa.array([cut]), "least": pa.array([int(min(clean.sum(), toxic.sum()))])})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """Learns from the documents that have a label toxic of 0 or 1 (others don't count); their lang, if there is one, only serves `thresholds`."""
    steps = Tables()
    labels = labels.where(F.col("toxic").isin(0, 1)).select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic"))
    labels = steps.stored(labels.join(docs.where("text is not null").select(F.col(key).alias("key")).distinct(), "key", "left_semi").distinct())
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        steps.drop(labels)
        return Model(np.zeros((0, 0)), [], np.zeros(0), np.zeros(0), 0.0, float(max(sizes, default=0)))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where("text is not null").select(F.col(key).alias("key"), "text", lang.alias("lang")).join(small(labels, MOST_LABELS), "key")
    texts = texts.withColumn("tie", F.xxhash64("text")).mapInArrow(_coded, "words binary, toxic int, lang string, tie long")
    # equal texts are one row, whose lang doesn't depend on the order of rows; nor do its part and its place there
    texts = texts.groupBy("tie", "toxic").agg(F.min("lang").alias("lang"), F.first("words").alias("words"))
    parts = -(-sum(sizes.values()) // PART_ROWS)
    texts = texts.withColumn("part", F.pmod("tie", F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "tie", "toxic")
    rows = steps.stored(texts)
    steps.drop(labels)
    counted = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = _train(rows, np.array([counted[0], counted[1]]))

    scored = rows.select("lang", "words", "toxic").mapInArrow(lambda b: _logits(b, model), "lang string, z double, toxic int")
    named = F.when(F.col("lang") != "", F.array(F.lit(""), F.col("lang"))).otherwise(F.array(F.lit("")))
    counts = scored.select(F.explode(named).alias("of"), "z", "toxic").groupBy("of", "z").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    cuts = {r["of"]: r for r in counts.groupBy("of").applyInArrow(_cut, "of string, cut double, least long").collect()}
    steps.drop(rows)
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - cuts[""]["cut"]
    for name in sorted(set(cuts) - {""}):
        if cuts[name]["least"] >= LANGUAGE_ROWS:
            model.thresholds[name] = float(1 / (1 + np.exp(-np.clip(cuts[name]["cut"] + model.shift, -30, 30))))
    return model


def scored(text: Column, model: Model) -> Column:
    """The score of a text, from 0 to 1."""

    def of(texts: pa.Array) -> pa.Array:
        tables = model.tables() if model.constant is None else []
        out = []
        for part in arrays.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 4 << 20):
            slots, first = word_slots(part.column("text"))
            out.append(model.score(slots, first, tables))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(of, "double")(text)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out().alias("held_out"), scored(F.col("text"), model).alias("score"), "lang")
    cut = F.lit(THRESHOLD)
    for name, threshold in model.thresholds.items():
        cut = F.when(F.col("lang") == name, threshold).otherwise(cut)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= cut).cast("int").alias("flagged_by_language"))


QUERIES = {"op6_toxicity": (query, None)}
