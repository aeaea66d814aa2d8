"""Repeated passages: chunks of ten words, chosen by winnowing.

A text is broken into words at any white space, newlines among it; a run without white space of more than LONG bytes is broken into pieces, after
characters that a hash of the bytes before them chooses. Of each SPAN successive chunks of GRAM words, white space included, the one with the least hash
is taken. Equal passages therefore get equal chunks wherever they stand, and each of MIN_WORDS words or more has one. Chunks that occur more
than once, anywhere in the corpus, are looked up by hash; every occurrence but the first (by doc_id, then place) is compared with the first byte by
byte, widened to both sides as far as the bytes go on to agree (up to SPAN words, where the next chunk is at the latest), and removed if it has
MIN_WORDS words or more.

What is removed always has an equal passage at a smaller (doc_id, place), so one occurrence of everything stays.

Steps: one scan writes the chunk hashes; counting and looking up work on hashes; only texts that hold a first occurrence are read again for its
bytes; a last join brings the bytes to the texts. Hashes that are in a large part of the texts are keys of a count and of a join that Spark can split.

Defined results: a null text stays null, an empty one empty. Rows without doc_id stay as they are and count for nothing. Rows that repeat doc_id
and text are one document and are changed alike. Repeats inside one text are removed too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.llm import arrays
from cardflow.llm.frames import Tables, small, stored, table

MIN_WORDS = 30
#: Words of a chunk, and successive chunks of which one is taken, so that MIN_WORDS words hold one for sure. About every eleventh chunk is taken.
GRAM = 10
SPAN = MIN_WORDS - GRAM + 1
#: Bytes from which a run without white space counts as several words, and the characters of it of which one ends a word.
LONG, WRAP = 64, 4
#: Bytes between chunks that are looked up as one, if they lie alike in both texts.
GAP = 100
#: Bytes of texts that are cut up at once; what is held beside them is some thirty times as much.
SLICE_BYTES = 1 << 20
#: Most keys of texts that are broadcast (8 bytes each), to leave out the others before a shuffle; beyond it, the joins shuffle.
MOST_KEYS = 1_000_000


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; the third array has the first word of each text, and their number."""
    starts, ends, first = arrays.spans(data, offsets, arrays.SPACE)
    long = np.flatnonzero(ends - starts > LONG)
    if not len(long):
        return starts, ends, first
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[long] + 4], edges[ends[long]] = 1, -1
    at = np.flatnonzero(np.cumsum(edges[:-1], dtype=np.int8).astype(bool) & ((data & 0xC0) != 0x80))
    h = np.zeros(len(at), np.uint32)
    for back, odd in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35), (4, 0x27D4EB2F)):
        h += data[at - back] * np.uint32(odd)
        h ^= h >> np.uint32(13)
    at = at[((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)) % np.uint32(WRAP) == 0]
    starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    return starts, ends, np.searchsorted(starts, offsets)


def _over(x: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each n successive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = least(x[:-step], x[step:])
        have += step
    return x


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the chunks that are taken."""
    starts, ends, first = words(data, offsets)
    if len(starts) < MIN_WORDS:
        return starts[:0], starts[:0], np.zeros(0, np.uint64)
    starts, ends = starts[: len(starts) - GRAM + 1], ends[GRAM - 1 :]
    h = arrays.prefix_hashes(data, starts, ends)[0]
    least = _over(h, SPAN, np.minimum)
    whole = np.zeros(len(least) + 1, np.int64)  # windows that lie in one text
    some = np.flatnonzero(np.diff(first) >= MIN_WORDS)
    np.add.at(whole, first[some], 1)
    np.add.at(whole, first[some + 1] - MIN_WORDS + 1, -1)
    least[np.cumsum(whole[:-1]) == 0] = 0
    none = np.zeros(SPAN - 1, np.uint64)
    taken = np.flatnonzero((h == _over(np.concatenate([none, least, none]), SPAN, np.maximum)) & (h > 0))
    return starts[taken], ends[taken], h[taken]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in arrays.slices(whole, "text", SLICE_BYTES):
            data, offsets = arrays.utf8(batch.column("text"))
            s, e, h = chunks(data, offsets)
            row = np.searchsorted(offsets, s, "right") - 1
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ids), pa.array(keys), pa.array((s - offsets[row]).astype(np.int32)), pa.array((e - offsets[row]).astype(np.int32))],
                names=["h", "doc_id", "key", "at", "end"])


def _first_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, wanted = batch.column("from_key").to_pylist(), batch.column("wanted").to_pylist()
        for key, places, text in zip(keys, wanted, batch.column("text").cast(pa.large_binary()), strict=True):
            text = text.as_py()
            starts, ends, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            at, end = (np.array([p[c] for p in places], np.int64) for c in ("from_at", "from_end"))
            # one word more, so that the white space beyond the last one is there
            left = starts[np.maximum(np.searchsorted(starts, at) - SPAN, 0)]
            right = ends[np.minimum(np.searchsorted(ends, end) + SPAN, len(ends) - 1)]
            left[left == starts[0]], right[right == ends[-1]] = 0, len(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(places), pa.int64()), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32)),
                 pa.array([text[x:a] for x, a in zip(left, at)], pa.binary()),
                 pa.array([text[a:b] for a, b in zip(at, end)], pa.binary()),
                 pa.array([text[b:x] for b, x in zip(end, right)], pa.binary())],
                names=["from_key", "from_at", "from_end", "before", "same", "after"])


def _alike(own: bytes, same: bytes) -> list[tuple[int, int]]:
    """Where two equally long strings agree for GRAM bytes or more."""
    if own == same:
        return [(0, len(own))]
    equal = np.frombuffer(own, np.uint8) == np.frombuffer(same, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8))).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edges if b - a >= GRAM]


def _agree(x: bytes, y: bytes) -> int:
    """How many bytes two strings have in common at the start."""
    n, step = 0, min(len(x), len(y))
    most = step
    while step:
        if n + step <= most and x[n : n + step] == y[n : n + step]:
            n += step
        else:
            step //= 2
    return n


def repeated_spans(text: bytes, found: list[dict], starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """What to remove from a text with words from starts to ends: each find is confirmed byte by byte and widened, whole words only; spans that overlap
    or touch are joined."""
    spans: list[tuple[int, int]] = []
    for f in found:
        start, end = f["at"], f["end"]
        for a, b in _alike(text[start:end], f["same"]):
            a, b = start + a, start + b
            if a == start:
                before = f["before"]
                a -= min(_agree(text[max(0, a - len(before)) : a][::-1], before[::-1]), max(0, a - f["stays"]))
            if b == end:
                b += _agree(text[b : b + len(f["after"])], f["after"])
            spans.append((a, b))
    if len(starts) < MIN_WORDS or not spans:
        return []
    a, b = np.array(spans, np.int64).T
    i = np.searchsorted(starts, a, "right") - 1
    cut = (i >= 0) & (a > starts[i]) & (a <= ends[i])  # inside a word or at its end; white space before the span stays
    behind = np.minimum(ends[i], len(text) - 1)
    a = np.where(cut, ends[i] + ((ends[i] < len(text)) & arrays.SPACE[np.frombuffer(text, np.uint8)[behind]]), a)
    i = np.searchsorted(starts, b) - 1
    b = np.where((i >= 0) & (b < ends[i]), starts[i], b)
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, b in zip(a.tolist(), b.tolist()) if a < b):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if np.searchsorted(starts, b) - np.searchsorted(starts, a) >= MIN_WORDS]


FIND = ("at", "end", "stays", "before", "same", "after")
RESULT = "struct<text string, removed array<struct<start:long, end:long>>, removed_words long>"


def _removed(texts: pa.Array, found: pa.Array) -> pa.Array:
    clean, spans, removed = [], [], []
    for part in arrays.slices(pa.RecordBatch.from_arrays([texts, found], names=["text", "found"]), "text", SLICE_BYTES):
        data, offsets = arrays.utf8(part.column("text"))
        starts, ends, first = words(data, offsets)  # of all texts at once
        finds = part.column("found").flatten()
        rows = list(zip(*(finds.field(c).to_pylist() for c in FIND), strict=True))
        at_find = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column("found")).fill_null(0).to_numpy(zero_copy_only=False))])
        for i, t in enumerate(part.column("text").to_pylist()):
            f = [dict(zip(FIND, row)) for row in rows[at_find[i] : at_find[i + 1]]]
            if t is None or not f:
                clean.append(t)
                spans.append([])
                removed.append(0)
                continue
            own = slice(first[i], first[i + 1])
            raw, at, kept, gone, points, n = t.encode(), 0, [], [], 0, 0
            for a, b in repeated_spans(raw, f, starts[own] - offsets[i], ends[own] - offsets[i]):
                kept.append(raw[at:a].decode())
                start = points + len(kept[-1])
                points = start + len(raw[a:b].decode())
                gone.append({"start": start, "end": points})
                n += len(raw[a:b].split())
                at = b
            clean.append("".join(kept) + raw[at:].decode())
            spans.append(gone)
            removed.append(n)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(clean, pa.string()), pa.array(spans, kind), pa.array(removed, pa.int64())], names=["text", "removed", "removed_words"])


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def remove_repeats(docs: DataFrame, keep: str = "doc", into: str = "found") -> DataFrame:
    """Two structs: the row as it was, and its text without repeated passages, the removed spans (code points) and their words."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("key", F.when(F.col("doc_id").isNotNull(), _key()))
    known = rows.where("doc_id is not null and text is not null").select("doc_id", "key", "text")
    steps = Tables()
    seen = steps.stored(known.mapInArrow(_occurrences, "h long, doc_id long, key long, at int, end int"))
    often = seen.groupBy("h").count().where("count > 1").select("h")
    some = steps.stored(seen.join(often, "h"))
    steps.drop(seen)
    place = F.struct("doc_id", "key", "at")
    first = steps.stored(some.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select(
        "h", F.col("first.doc_id").alias("from_id"), F.col("first.key").alias("from_key"), F.col("first.at").alias("from_at")))
    # in one text, a chunk that overlaps the first is none beside it, and the first one stays whole
    alone = (F.col("key") != F.col("from_key")) | (F.col("at") + F.col("at") >= F.col("from_at") + F.col("end"))
    later = some.join(first, "h").where(place > F.struct(F.col("from_id").alias("doc_id"), F.col("from_key").alias("key"), F.col("from_at").alias("at"))).where(alone)
    # one exchange by text for dropping repeated rows and for joining neighbouring chunks
    later = later.withColumn("shift", F.col("at") - F.col("from_at")).drop("h").repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "at"])
    by_place = W.partitionBy("doc_id", "key").orderBy("at")
    on = (F.col("at") - F.lag("end").over(by_place) <= GAP) & (F.lag("from_key").over(by_place) == F.col("from_key")) & (F.lag("shift").over(by_place) == F.col("shift"))
    later = later.withColumn("new", F.when(on, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_place)).withColumn("from_end", F.col("end") - F.col("shift"))
    later = later.withColumn("stays", F.when(F.col("key") == F.col("from_key"), F.col("from_end")).otherwise(0))
    runs = steps.stored(later.groupBy("doc_id", "key", "run").agg(*[f(c).alias(c) for f, c in (
        (F.min, "at"), (F.max, "end"), (F.min, "from_key"), (F.min, "from_at"), (F.max, "from_end"), (F.min, "stays"))]))
    steps.drop(some, first)

    wanted = runs.select("from_key", "from_at", "from_end").distinct().groupBy("from_key").agg(F.collect_list(F.struct("from_at", "from_end")).alias("wanted"))
    holders = steps.stored(runs.select(F.col("from_key").alias("key")).distinct())
    held = known.join(small(holders, MOST_KEYS), "key", "left_semi").withColumnRenamed("key", "from_key").join(wanted, "from_key").select("from_key", "wanted", "text")
    same = held.mapInArrow(_first_bytes, "from_key long, from_at int, from_end int, before binary, same binary, after binary")
    same = same.dropDuplicates(["from_key", "from_at", "from_end"])
    finds = stored(runs.join(same, ["from_key", "from_at", "from_end"]).groupBy("key").agg(F.collect_list(F.struct(*FIND)).alias("finds")))

    steps.drop(runs, holders)

    # only texts that change are moved and go through Python
    changing = small(finds.select("key"), MOST_KEYS)
    changed = rows.join(changing, "key", "left_semi").join(finds, "key").select("rest", "text", F.arrow_udf(_removed, RESULT)("text", "finds").alias(into))
    others = rows.join(changing, "key", "left_anti")
    same = F.struct("text", F.array().cast("array<struct<start:long,end:long>>").alias("removed"), F.lit(0).cast("long").alias("removed_words")).cast(RESULT)
    both = changed.unionByName(others.select("rest", "text", same.alias(into)))
    doc = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return both.select(F.struct(*doc).alias(keep), into)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.array_join(F.transform("found.removed", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",")
    return remove_repeats(docs).select("doc.doc_id", "found.text", F.size("found.removed").alias("n_removed"), "found.removed_words", spans.alias("removed"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows the text."""
    changed = {"text": F.col("found.text")}
    if "n_chars" in docs.columns:
        n = F.when(F.size("found.removed") > 0, F.length("found.text")).otherwise(F.col("doc.n_chars"))
        changed["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return remove_repeats(docs).select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


QUERIES = {"op10_line_dedup": (query, None)}
