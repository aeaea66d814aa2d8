"""Scoring of texts by a gated recurrent language model that is trained on the corpus itself (`gru` has the model).

Words are counted over all training documents. The most frequent ones are symbols of the model; any other word, seen or not, is one of a class whose
probability the model gives, times the word's smoothed share of that class by the counts. Training reads every training document once, in ROUNDS parts: in a round each task starts from
the same weights and learns from its own documents by truncated backpropagation, then the weights of all tasks are averaged by the number of their symbols. Only averages,
of a fixed size, reach the driver. A text is scored whole: the state is carried from window to window.

The counts of frequent words are looked up in a list of bounded size; all other words of the documents meet their counts in a join.

Defined results: a null text is empty and has its end as only token. A null doc_id counts as ''. Every row counts, also where doc_id is repeated. Without
training documents the base score is 0 and the model's symbols are as good as equal. Words of equal counts are in the order of their bytes; of words that tie for the end of the list none is in it. An empty table gives no rows;
other columns are not looked at. Scores depend on how the rows lie in files (as the tasks of a round do), and not on a run; beside other rows, a text's score varies by rounding only."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm import arrays, gru
from cardflow.llm.frames import Tables, stored, table

#: Words whose counts are looked up in a list, none of them longer than this.
LISTED, LISTED_BYTES = 1 << 16, 64
ROUNDS, DECAY = 4, 0.6
#: Texts are learned from and scored together up to about so many symbols.
TASK_SYMBOLS = 1 << 20
_CHUNK = 1 << 14
_SMOOTH = 0.1


def words(part: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, A-Z lowered, and the first of each text."""
    data, offsets = arrays.utf8(part)
    starts, ends, first = arrays.spans(data, offsets, arrays.SPACE)
    inside = arrays.LOWER[data[~arrays.SPACE[data]]]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(inside)]), first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            found = pc.value_counts(words(part.column("text"))[0])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])


@dataclass
class Vocabulary:
    listed: list[str]  # by falling count
    counts: np.ndarray
    ends: int  # training documents
    tokens: int
    distinct: int

    @property
    def symbols(self) -> int:
        return min(len(self.listed), gru.RARE - 1)

    @property
    def rare(self) -> tuple[int, int]:
        """Tokens and distinct words that are no symbols."""
        n = self.symbols
        return self.tokens - self.ends - int(self.counts[:n].sum()), self.distinct - n - (self.ends > 0)

    def by_symbol(self) -> np.ndarray:
        out = np.full(gru.RARE + 1, -1.0)
        out[0], out[gru.RARE] = self.ends, self.rare[0]
        out[1 : 1 + self.symbols] = self.counts[: self.symbols]
        return out


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The list takes whole levels of counts (single ones up to 32, 1/16 of an octave above) from the top, as long as it has at most LISTED words."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    short = counts.where(F.octet_length("word") <= LISTED_BYTES)
    levels = short.groupBy(F.when(F.col("n") <= 32, F.col("n")).otherwise(F.floor(F.log2("n") * 16) - 47).alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n"))
    least, room = None, LISTED
    for r in sorted(levels.collect(), key=lambda r: -r["n"]):  # some hundred rows
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    top = [] if least is None else sorted((-r["n"], r["word"].encode(), r["word"]) for r in short.where(F.col("n") >= least).collect())
    return Vocabulary([w for *_, w in top], np.array([-n for n, *_ in top], np.int64), ends, (total[0] or 0) + ends, total[1] + (ends > 0))


ENCODED = "row long, doc_id {key}, held_out boolean, part int, symbols binary, n_tokens long, n_rare long, n_known long, logs double, rare_logs double, word string, n long"


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one (part -2) for each of its distinct words that isn't listed. logs: log10(count + 0.1), summed over listed words."""
    listed = pa.array(v.listed, pa.large_string())
    logs = np.log10(v.counts + _SMOOTH)
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            found, first = words(part.column("text"))
            n = np.diff(first)
            coded = found.dictionary_encode()
            distinct, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            place = pc.index_in(distinct, value_set=listed).fill_null(-1).to_numpy().astype(np.int64)
            at = place[code] if len(code) else code
            known = at >= 0
            symbol = np.where(known & (at < gru.RARE - 1), at + 1, gru.RARE).astype("<u2")
            log = np.where(known, logs[at] if len(logs) else 0.0, 0.0)
            rare = symbol == gru.RARE
            text = np.repeat(np.arange(len(n)), n)

            n_rare, n_known, sums, rare_sums = (np.bincount(text, weights=x, minlength=len(n)) for x in (rare, known, log, np.where(rare, log, 0)))
            symbols = [symbol[a:b].tobytes() + b"\0\0" for a, b in zip(first[:-1], first[1:], strict=True)]
            end = math.log10(v.ends + _SMOOTH)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("row", "doc_id", "held_out", "part")), pa.array(symbols, pa.binary()), pa.array(n + 1), pa.array(n_rare.astype(np.int64)),
                 pa.array(n_known.astype(np.int64) + (v.ends > 0)), pa.array(sums + end), pa.array(rare_sums),
                 pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64())],
                names=["row", "doc_id", "held_out", "part", "symbols", "n_tokens", "n_rare", "n_known", "logs", "rare_logs", "word", "n"])
            key, times = np.unique(text[~known] * max(len(distinct), 1) + code[~known], return_counts=True)
            if len(key):
                text, code = np.divmod(key, len(distinct))
                kinds = part.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(text)), pa.nulls(len(key), kinds), pa.nulls(len(key), pa.bool_()), pa.array(np.full(len(key), -2, np.int32)), pa.nulls(len(key), pa.binary()),
                     *(pa.nulls(len(key), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())),
                     distinct.take(pa.array(code)).cast(pa.string()), pa.array(times)],
                    names=["row", "doc_id", "held_out", "part", "symbols", "n_tokens", "n_rare", "n_known", "logs", "rare_logs", "word", "n"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Symbols of texts, about TASK_SYMBOLS at a time, with the rows they come from."""
    texts, rows, size = [], [], 0
    for batch in batches:
        for part in arrays.slices(batch, "symbols", 2 * TASK_SYMBOLS):
            some = [np.frombuffer(x, "<u2") for x in part.column("symbols").to_pylist()]
            texts += some
            rows.append(part)
            size += sum(map(len, some))
            if size >= TASK_SYMBOLS:
                yield texts, rows
                texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


def _learned(batches: Iterator[pa.RecordBatch], weights: np.ndarray, rate: float) -> Iterator[pa.RecordBatch]:
    """The weights of a task after its documents, times their number of symbols, in chunks."""
    trainer = gru.Trainer(weights, rate)
    for texts, _ in _texts(batches):
        trainer.learn(texts)
    if trainer.symbols:
        x = trainer.x.astype(np.float64) * trainer.symbols
        for i, a in enumerate(range(0, len(x), _CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([trainer.symbols], pa.int64()), pa.array([x[a : a + _CHUNK].tobytes()], pa.binary())],
                                             names=["chunk", "task", "symbols", "x"])


def _added(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("task")  # sums don't depend on the order of arrival
    total = sum(np.frombuffer(x) for x in rows.column("x").to_pylist())
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), "task": rows.column("task").slice(0, 1), "symbols": pa.array([pc.sum(rows.column("symbols")).as_py()], pa.int64()), "x": pa.array([total.tobytes()], pa.binary())})


def train(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    """The averaged weights after all rounds; encoded: part (the round, from 0), symbols."""
    weights = gru.flat(gru.initial(v.by_symbol()))
    kind = "chunk int, task int, symbols long, x binary"
    for k in range(ROUNDS):
        rate = gru.RATE * DECAY**k
        some = encoded.where(F.col("part") == k).select("symbols").mapInArrow(lambda b, w=weights, rate=rate: _learned(b, w, rate), kind)
        some = some.groupBy("chunk", (F.col("task") % 64).alias("few")).applyInArrow(_added, kind)
        got = sorted(some.groupBy("chunk").applyInArrow(_added, kind).collect(), key=lambda r: r["chunk"])  # one row for each chunk of the weights
        if got:
            weights = np.concatenate([np.frombuffer(r["x"]) / r["symbols"] for r in got]).astype(np.float32)
    return weights


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    w = gru.shaped(weights)
    for texts, rows in _texts(batches):
        found = pa.array(gru.log10_probabilities(w, texts))
        at = 0
        for part in rows:
            columns = [c for c in part.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), found.slice(at, part.num_rows)], names=[*columns, "model"])
            at += part.num_rows


def scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row; the model learns from those not held out."""
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    steps = Tables()
    learned = docs.where("not held_out")
    counts = steps.stored(learned.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    v = vocabulary(counts, learned.count())
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)).cast("int")))
    encoded = steps.stored(rows.mapInArrow(lambda b: _encoded(b, v), ENCODED.format(key=kind)), "part")
    weights = train(encoded, v)
    texts = encoded.where("part >= -1").select("row", "doc_id", "held_out", "n_tokens", "n_rare", "n_known", "logs", "rare_logs", "symbols")
    scored = steps.stored(texts.mapInArrow(lambda b: _scored(b, weights), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_rare long, n_known long, logs double, rare_logs double, model double"))
    others = encoded.where("part = -2").select("row", "word", "n").join(counts.withColumnRenamed("n", "c"), "word", "left")
    others = others.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + _SMOOTH)).alias("other"))
    out = scored.join(others, "row", "left").na.fill(0, ["known", "other"])
    rare_tokens, rare_words = v.rare
    each, rare = math.log10(v.tokens + _SMOOTH * (v.distinct + 1)), math.log10(rare_tokens + _SMOOTH * (rare_words + 1))
    out = stored(out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("other") - F.col("n_tokens") * each).alias("base_score"),
        (F.col("model") + F.col("rare_logs") + F.col("other") - F.col("n_rare") * rare).alias("score")))
    steps.drop(counts, encoded, scored)
    return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), held_out())


QUERIES = {"op13_lm_scores": (query, None)}
