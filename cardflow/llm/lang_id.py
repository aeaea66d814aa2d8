"""Language identification by the nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (2 to 4 bytes; A-Z lowered, other ASCII that is no letter counts as a space),
of length 1. Each language has a few centroids, found by spherical k-means on its sample; a text gets the language of the nearest
centroid by cosine, and is rejected if that is farther off than the language's limit for texts of its length.

Defined results: a null text, or one without a letter, is `und` with score 0 and is rejected. Without any labelled text
there is no language to predict: every text is `und` and none is rejected. Ties go to the language that comes first by code
point. Texts are read whole, in parts of a few MB. Equal texts get equal results; other columns are not looked at."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm import arrays
from cardflow.llm.frames import Tables, table

BITS = 15
DIMENSIONS = 1 << BITS
SIZES = (2, 3, 4)
#: The fit takes about so many rows of each language, each with the same chance, by a hash.
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 4
#: A limit is the similarity that all but 0.1 % of a language's own sample reach, of pieces of about the text's length: so many bytes, and n-grams.
LIMIT_QUANTILE = 0.001
BANDS = tuple(12 * 2**i for i in range(14))
_BAND_GRAMS = np.array(BANDS) * len(SIZES)
#: With fewer own pieces than this, the limit of the next shorter band holds where it is less.
LEAST_PIECES = 64
#: Softness of the score: differences of cosine are divided by it.
TEMPERATURE = 0.03

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
_FOLD = arrays.LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes that are compared, runs of spaces taken as one, with a space at both ends."""
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    return np.concatenate([[0x20], data[keep], [0x20]]).astype(np.uint8)


def counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector positions of the n-grams that occur, and how often; a long text is counted a part after the other."""
    data = folded(data)
    total = np.zeros(DIMENSIONS, np.int64)
    for a in range(0, len(data), arrays.PART_BYTES):
        part = data[a : a + arrays.PART_BYTES + max(SIZES) - 1].astype(np.uint32)  # n-grams that begin in this part
        for n in SIZES:
            size = min(arrays.PART_BYTES, len(part) - n + 1)
            if size <= 0:
                continue
            h = np.zeros(size, np.uint32)
            for i in range(n):
                h += (part[i : size + i] + np.uint32(1 + n)) * _ODD[i]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
            total += np.bincount((h >> np.uint32(32 - BITS)).astype(np.int32), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray  # the language of each centroid
    least: np.ndarray  # the least similarity that each language accepts, by band of lengths; the first one is of shorter texts

    @cached_property
    def by_position(self) -> np.ndarray:
        return np.ascontiguousarray(self.centroids.T)

    def similarity(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The cosine of a text, given by its positions and their counts, with the nearest centroid of each language."""
        w = np.log1p(n) * self.idf[at]
        s = w.astype(np.float64) @ self.by_position[at] / max(float(np.linalg.norm(w)), 1e-12)
        return np.maximum.reduceat(s, np.searchsorted(self.of, np.arange(len(self.languages))))

    def predict(self, texts: pa.Array) -> tuple[list, list, list, list]:
        """Language, score, distance and whether it is rejected, of each text."""
        n = len(texts)
        lang, score, distance, rejected = [UNDETERMINED] * n, np.zeros(n), np.ones(n), np.full(n, bool(self.languages))
        if not self.languages:
            return lang, score, distance, rejected
        data, offsets = arrays.utf8(texts)
        for i, t in enumerate(texts.to_pylist()):
            if not t or not LETTER.search(t):
                continue
            at, tf = counts(data[offsets[i] : offsets[i + 1]])
            s = self.similarity(at, tf).round(9)
            best = int(s.argmax())
            lang[i] = self.languages[best]
            score[i] = round(1 / np.exp((s - s[best]) / TEMPERATURE).sum(), 6)
            distance[i] = 1 - s[best]
            rejected[i] = s[best] <= self.least[best, np.searchsorted(_BAND_GRAMS, tf.sum(), "right")]
        return lang, score, distance, rejected


def _clusters(w: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row and then the rows farthest from those taken."""
    chosen = [int((w @ w.mean(axis=0)).argmax())]
    for _ in range(1, min(k, len(w))):
        chosen.append(int((w @ w[chosen].T).max(axis=1).argmin()))
    c = w[chosen]
    for _ in range(rounds):
        near = (w @ c.T).argmax(axis=1)
        c = np.stack([w[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as a whole (band -1), and a piece of it for each band, from a place that its draw decides."""
    for batch in batches:
        data, offsets = arrays.utf8(batch.column("text"))
        draws = batch.column("draw").to_pylist()
        for i in range(batch.num_rows):
            whole = data[offsets[i] : offsets[i + 1]]
            bands = [-1, *(k for k, n in enumerate(BANDS) if n <= len(whole))]
            places = [(draws[i] >> k) % (len(whole) - BANDS[k] + 1) for k in bands[1:]]
            found = [counts(whole), *(counts(whole[p : p + BANDS[k]]) for k, p in zip(bands[1:], places, strict=True))]
            rows = pa.array(np.full(len(bands), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(rows), batch.column("draw").take(rows), pa.array(bands, pa.int32()),
                 pa.array([at.astype("<i4").tobytes() for at, _ in found], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in found], pa.binary())],
                names=["lang", "draw", "band", "at", "n"])


def _pieces(rows: pa.Table, band: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Band, positions and counts (of one band, if it is given), in an order that doesn't depend on that of the rows."""
    order = pc.sort_indices(rows, [(c, "ascending") for c in ("draw", "band", "at", "n")]).to_numpy()
    bands = rows.column("band").to_numpy()[order]
    for i, k in zip(order.tolist(), bands.tolist(), strict=True):
        if band is None or k == band:
            yield k, np.frombuffer(rows.column("at")[i].as_py(), "<i4"), np.frombuffer(rows.column("n")[i].as_py(), "<f4")


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a task each position occurs."""
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for at in batch.column("at").to_pylist():
            total[np.frombuffer(at, "<i4")] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["position", "texts"])


def _matrix(model: Model, rows: pa.Table) -> np.ndarray:
    """The vectors of the whole texts; the one large array of a task."""
    w = np.zeros((pc.sum(pc.equal(rows.column("band"), -1)).as_py(), DIMENSIONS), np.float32)
    for row, (_, at, n) in zip(w, _pieces(rows, -1), strict=True):
        row[at] = np.log1p(n) * model.idf[at]
        row /= max(float(np.linalg.norm(row)), 1e-12)
    return w


def _centroids(rows: pa.Table, model: Model) -> pa.Table:
    c = _clusters(_matrix(model, rows), CENTROIDS).astype("<f4")
    return pa.table({"lang": rows.column("lang").slice(0, 1), "centroids": pa.array([c.tobytes()], pa.binary())})


def _limits(rows: pa.Table, model: Model) -> pa.Table:
    """The least similarity of a language by band. Its texts are compared with centroids that were not fit on them: those of each half
    of the sample judge the other half, if there are enough."""
    mine = model.languages.index(rows.column("lang")[0].as_py())
    w = _matrix(model, rows)
    halves = len(w) >= LEAST_PIECES
    own = [Model(["own"], model.idf, c := _clusters(w[(np.arange(len(w)) % 2 != k) | (not halves)], CENTROIDS), np.zeros(len(c), int), model.least) for k in (0, 1)]
    del w
    found: list[list[float]] = [[] for _ in BANDS]
    text = -1
    for band, at, n in _pieces(rows):
        if band < 0:  # the first row of each text
            text += 1
            continue
        s = model.similarity(at, n)
        s[mine] = own[text % 2].similarity(at, n)[0]
        if s.argmax() == mine:  # else it would be taken for another language
            found[band].append(s[mine])
    least = np.zeros(1 + len(BANDS))
    for band, s in enumerate(found):
        least[band + 1] = np.quantile(s, LIMIT_QUANTILE) if s else least[band]
        if len(s) < LEAST_PIECES and band > 1:
            least[band + 1] = min(least[band + 1], least[band])
    return pa.table({"lang": rows.column("lang").slice(0, 1), "least": pa.array([least.tolist()], pa.list_(pa.float64()))})


def fit(docs: DataFrame, key: str = "doc_id") -> Model:
    """Learns from the rows that have a text with a letter and a lang. The key only decides who is in the sample. A language's sample is a task's;
    the driver gets the texts that each position occurs in, and of each language its centroids (half a MB) and limits."""
    docs = docs.select(F.col(key).alias("key"), "text", "lang").where("lang is not null and text rlike '\\\\p{L}'")
    steps = Tables()
    sizes = steps.stored(docs.groupBy("lang").agg(F.count("*").alias("rows")))
    drawn = docs.withColumn("draw", F.xxhash64("key", "text")).join(sizes, "lang")
    drawn = drawn.where(F.pmod("draw", F.lit(1 << 40)) / float(1 << 40) < SAMPLE_PER_LANGUAGE / F.col("rows"))
    sample = steps.stored(drawn.select("lang", "draw", "text").mapInArrow(_sampled, "lang string, draw long, band int, at binary, n binary"))
    whole = sample.where("band = -1")
    texts = whole.count()
    occurring = np.zeros(DIMENSIONS)
    for r in whole.select("at").mapInArrow(_occurring, "position long, texts long").groupBy("position").agg(F.sum("texts").alias("texts")).collect():
        occurring[r["position"]] = r["texts"]
    model = Model([], np.log((1 + texts) / (1 + occurring)).astype(np.float32) + 0.1, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros((0, 1 + len(BANDS))))
    got = whole.groupBy("lang").applyInArrow(lambda rows: _centroids(rows, model), "lang string, centroids binary").collect()
    got.sort(key=lambda r: r["lang"])
    if got:
        centroids = [np.frombuffer(r["centroids"], "<f4").reshape(-1, DIMENSIONS) for r in got]
        model = Model([r["lang"] for r in got], model.idf, np.concatenate(centroids), np.repeat(np.arange(len(got)), [len(c) for c in centroids]), np.zeros((len(got), 1 + len(BANDS))))
        fitted = model
        least = {r["lang"]: r["least"] for r in sample.groupBy("lang").applyInArrow(lambda rows: _limits(rows, fitted), "lang string, least array<double>").collect()}
        model.least = np.array([least[x] for x in model.languages])
    steps.drop(sizes, sample)
    return model


RESULT = "struct<lang_pred string, score double, distance double, rejected boolean>"


def predict(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score, distance and rejected."""

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array) -> pa.Array:
        lang, score, distance, rejected = model.predict(texts)
        arrays.give_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64()), pa.array(rejected, pa.bool_())],
                                          names=["lang_pred", "score", "distance", "rejected"])

    return of(text)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), model).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.distance", "r.rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those that are rejected go."""
    model = fit(docs)
    return docs.select(F.struct("*").alias("doc"), predict(F.col("text"), model).alias("found")).where("not found.rejected").select("doc.*")


QUERIES = {"op1_language_id": (query, None)}
