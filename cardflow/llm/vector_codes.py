"""Compression of vectors to codes: each part of a vector becomes the index of the nearest entry of a codebook learned by Lloyd's rounds.

Parts live with the owner of their entry: they are partitioned by (position, entry, salt) once, and then stay there. In each round the owners sum up their
members, which gives the new entries (a few thousand numbers, whatever the table holds), and compare their members with these. Members that stay
are written in place, without a shuffle; only those whose entry changes are dealt out again. Equal parts of a batch are one member with a number of copies, and the salt
splits the members of any entry, so that no owner holds more than its share however uneven the entries are. At the end the table is read once more and encoded.

Defined results: rows whose vector is null, empty, or holds null or non-finite numbers are dropped; so are those whose length isn't that of the first vector. Vectors are
in the order of their id, nulls last, then of their numbers; repeated rows count each. With fewer rows than entries the codebook is as short. Whole
numbers are bounded at +-2**24 (components beyond +-16384), which keeps all distances exact. A sum of errors that exceeds a long is null. Ties go to the lower index. An
empty table gives no rows. Other columns are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.llm.frames import Tables, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BOUND = 1 << 24
#: An entry's members are dealt to so many owners that none has more than about this many.
OWNER_MEMBERS = 200_000
_ROWS = 4096

Books = list[np.ndarray]
MEMBER = "position int, entry int, salt int, part binary, copies long"


def whole(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * x) of every component."""
    x = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), d)
    with np.errstate(over="ignore"):  # what overflows is beyond the bound
        return np.clip(np.floor(x * SCALE), -BOUND, BOUND).astype(np.int64)


def cuts(d: int) -> list[tuple[int, int]]:
    return [(d * i // PARTS, d * (i + 1) // PARTS) for i in range(PARTS)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each row, the lowest of equal ones, and the squared distance; exact."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    floats = 4 * max(book.shape[1], 1) * most * most < 1 << 53  # then doubles hold every number below as it is
    kind = np.float64 if floats else np.int64
    y = book.astype(kind)
    square = (y * y).sum(axis=1)
    step = _ROWS if floats else max(1, _ROWS * 16 // max(book.size, 1))
    for a in range(0, len(x), step):
        z = x[a : a + step].astype(kind)
        gap = (z * z).sum(axis=1)[:, None] - 2 * (z @ y.T) + square if floats else ((z[:, None] - y[None]) ** 2).sum(axis=2)
        at[a : a + step] = best = gap.argmin(axis=1)
        far[a : a + step] = gap[np.arange(len(z)), best]
    return at, far


def _members(position: int, entry: np.ndarray, x: np.ndarray, salts: int) -> pa.RecordBatch:
    """Equal parts as one member, with a salt by its bytes."""
    raw = np.ascontiguousarray(x, "<i4")
    if x.shape[1]:
        _, first, copies = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * 4))).ravel(), return_index=True, return_counts=True)
    else:
        first, copies = np.zeros(1, np.int64), np.array([len(x)])
    parts = [raw[i].tobytes() for i in first]
    salt = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest()) % salts for p in parts] if salts > 1 else [0] * len(parts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), position, np.int32)), pa.array(entry[first].astype(np.int32)), pa.array(salt, pa.int32()), pa.array(parts, pa.binary()), pa.array(copies, pa.int64())],
                                      names=["position", "entry", "salt", "part", "copies"])


def _first(batches: Iterator[pa.RecordBatch], books: Books, d: int, salts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = whole(batch.column("vec"), d)
            for position, (a, b) in enumerate(cuts(d)):
                yield _members(position, nearest(x[:, a:b], books[position])[0], x[:, a:b], salts)


def _held(batch: pa.RecordBatch, books: Books) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By position: the rows of a batch of members, and their parts."""
    position = batch.column("position").to_numpy()
    for p in np.unique(position):
        rows = np.flatnonzero(position == p)
        raw = batch.column("part").take(pa.array(rows)).to_pylist()
        yield int(p), rows, np.frombuffer(b"".join(raw), "<i4").reshape(len(rows), books[p].shape[1]).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[pa.RecordBatch]:
    """What a task's members come to, for each component of each entry."""
    count = [np.zeros(len(b), np.int64) for b in books]
    total = [np.zeros(b.shape, np.int64) for b in books]
    for batch in batches:
        entries, copies = batch.column("entry").to_numpy(), batch.column("copies").to_numpy()
        for p, rows, x in _held(batch, books):
            np.add.at(count[p], entries[rows], copies[rows])
            np.add.at(total[p], entries[rows], x * copies[rows, None])
    for p, (n, sums) in enumerate(zip(count, total, strict=True)):
        entry, place = np.divmod(np.flatnonzero(np.repeat(n > 0, sums.shape[1])), max(sums.shape[1], 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(n[entry]), pa.array(sums[entry, place])],
                                         names=["position", "entry", "place", "n", "total"])


def _moved(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[pa.RecordBatch]:
    """The members with their new entry, and whether it is the one they are with."""
    for batch in batches:
        before = batch.column("entry").to_numpy()
        entry = before.copy()
        for p, rows, x in _held(batch, books):
            entry[rows] = nearest(x, books[p])[0]
        columns = [pa.array(entry) if name == "entry" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(entry == before)], names=[*batch.schema.names, "stays"])


def _updated(members: DataFrame, books: Books) -> Books:
    """Each entry as the mean of its members, rounded down; those without members stay."""
    sums = members.mapInArrow(lambda b: _sums(b, books), "position int, entry int, place int, n long, total long")
    sums = sums.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most ENTRIES rows for each component of a vector
        out[r["position"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("vec", v).where((F.size("vec") > 0) & ~odd)


def learn(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    """The codebook of each position. rows: vec_id, vec, all of the same length."""
    steps, by = Tables(), (F.col("vec_id").asc_nulls_last(), "vec")
    top = steps.stored(rows.orderBy(*by).limit(ENTRIES))  # a task gets each task's first rows, not the driver
    start = top.orderBy(*by).collect()
    steps.drop(top)
    if not start:
        return []
    d = len(start[0]["vec"])
    x = whole(pa.array([list(r["vec"]) for r in start], pa.list_(pa.float64())), d)
    books = [x[:, a:b].copy() for a, b in cuts(d)]
    salts = -(-rows.count() // OWNER_MEMBERS)
    first = rows.select("vec").mapInArrow(lambda b, books=books: _first(b, books, d, salts), MEMBER)
    resident = steps.stored(first.repartition("position", "entry", "salt"))
    held = [resident]
    for last in range(rounds, 0, -1):
        books = _updated(resident, books)
        if last == 1:
            break
        dealt = steps.stored(resident.mapInArrow(lambda b, books=books: _moved(b, books), f"{MEMBER}, stays boolean"), "stays")
        steps.drop(*held)
        arrived = steps.stored(dealt.where("not stays").drop("stays").repartition("position", "entry", "salt"))
        held = [dealt, arrived]
        resident = dealt.where("stays").drop("stays").union(arrived)
    steps.drop(*held)
    return books


def _coded(batches: Iterator[pa.RecordBatch], books: Books, d: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = whole(batch.column("vec"), d)
        found = [nearest(x[:, a:b], book) for (a, b), book in zip(cuts(d), books, strict=True)]
        code = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
        error = sum(far for _, far in found)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row that is kept."""
    kept = _vectors(rows, vector).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), "vec")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select(F.size("vec")).first()
    d = first[0] if first else 1
    kept = kept.where(F.size("vec") == d)
    books = learn(kept.select("vec_id", "vec"), rounds)
    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    coded = stored(kept.mapInArrow(lambda b: _coded(b, books, d), f"{kinds}, code string, error long"))
    totals = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))  # stored: its size is known, and a hot label's rows can be split
    out = coded.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= {ENTRIES})"""]
    near = """a{i} AS MATERIALIZED (SELECT parts.r, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS BIGINT) * 256 + e) AS m
  FROM parts JOIN b{i} USING (p) GROUP BY parts.r, p)"""
    for i in range(ROUNDS):
        steps.append(near.format(i=i))
        steps.append(f"""m{i + 1} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS y FROM
  (SELECT p, m % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN parts USING (r, p), range(1, 1 + len(x)) t(i) GROUP BY ALL) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i + 1}.y, b{i}.y) AS y FROM b{i} LEFT JOIN m{i + 1} USING (p, e))""")
    steps.append(near.format(i=ROUNDS))
    return ",\n".join(steps) + f""",
sha AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), sha"""


QUERIES = {"op12_vector_codes": (query, _sql())}
