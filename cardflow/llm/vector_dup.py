"""Near-duplicate vectors by a subspace pigeonhole join.

Two vectors of length 1 with cosine c are 2 - 2c apart (squared). Rotated by a fixed orthogonal matrix and split into blocks, they must be within a block's
share of that distance in at least one block. Vectors are dealt once, whole, to parts along their first rotated coordinate; a task compares two parts (or a part with
itself), and gets of each only the vectors that the distance lets reach the other. So every pair meets in one task, and a vector is sent to as many tasks as there are parts
in its reach: to none but its own up to PART_ROWS vectors, and, where the vectors fill the sphere evenly, to nearly all parts beyond. Pairs of parts are worked on a few diagonals at a
time, and a round leaves no shuffle files behind, so the disk holds at most ROUND x 2 copies of a vector however many parts there are.

In a task, each block joins the vectors by range: tiles that are near in that block's coordinates, and only pairs of tiles within the block's share. There, pairs within the
share are candidates; the cosine of a candidate is computed in double precision over all dimensions, and a pair that an earlier block finds too is left to that one.
So no link is lost and none is counted twice.

Equal vectors are one class with a number of copies. Links are not listed: a task returns each vector's number of links and a spanning forest. Vectors that lie too close
along the coordinate for a cut there are dealt by a hash.

Defined results: vectors that are null, empty or zero, or hold nulls or non-finite numbers, and rows without vec_id, are linked with nothing. Vectors of
different lengths are not linked. Each row counts as a vector, also where vec_id is repeated. Other columns are not looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.llm import arrays
from cardflow.llm.frames import Tables, components, stored, table
from cardflow.session import shuffles_dropped

BLOCKS = 4
#: Most vectors of a task, which holds two parts, and most bytes of them; a part is smaller where that gives MOST_PARTS of PART_ROWS at least.
TASK_ROWS, TASK_BYTES = 150_000, 256 << 20
PART_ROWS, LEAST_PARTS = 5_000, 4
#: The first coordinate, -1 to 1, is counted in so many bins; pairs of parts that are worked on at once lie on so many diagonals.
BINS, ROUND = 4096, 12
TILE = 1024
#: Numbers of a vector's pairs that are looked at at once.
PAIR_VALUES = 1 << 22
#: Room for rounding in the squared distances that only choose candidates: in double precision, in single precision for a pair, and for a product of tiles.
SLACK, FINE, ROUGH = 1e-9, 1e-5, 2e-5


@lru_cache(4)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def shares(d: int, cosine: float) -> list[tuple[int, int, float]]:
    """Where each block begins and ends, and its share of the squared distance."""
    cuts = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
    return [(int(a), int(b), (2 - 2 * cosine) * (b - a) / d) for a, b in zip(cuts, cuts[1:])]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in the precision they came in."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _place(x: np.ndarray) -> np.ndarray:
    """The bin of the first rotated coordinate; row by row, so that it doesn't depend on what else is in the batch."""
    first = (_unit(x.astype(np.float64)) * rotation(x.shape[1])[:, 0]).sum(axis=1)
    return np.clip(np.floor((first + 1) * (BINS / 2)), 0, BINS - 1).astype(np.int64)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("vec").offsets))
        for d in np.unique(sizes):
            yield int(d), batch.take(pa.array(np.flatnonzero(sizes == d)))


def _bins(batches: Iterator[pa.RecordBatch], lengths: set[int]) -> Iterator[pa.RecordBatch]:
    for d, batch in _by_length(batches):
        if d in lengths:
            place, n = np.unique(_place(_vectors(batch.column("vec"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), d, np.int32)), pa.array(place), pa.array(n.astype(np.int64))], names=["d", "place", "n"])


def most_rows(d: int) -> int:
    """Most vectors of a part."""
    return max(1, min(TASK_ROWS, TASK_BYTES // (8 * d)) // 2)


class Parts:
    """Consecutive bins with as many vectors as a part may hold; a bin with more is several parts, dealt by a hash."""

    def __init__(self, d: int, counts: dict[int, int], cosine: float) -> None:
        rows = sum(counts.values())
        most = min(most_rows(d), max(rows // LEAST_PARTS, PART_ROWS))
        cut: list[list[int]] = []  # first bin, last bin, rows
        for place in sorted(counts):
            if cut and cut[-1][2] + counts[place] <= most:
                cut[-1][1:] = place, cut[-1][2] + counts[place]
            else:
                cut.append([place, place, counts[place]])
        pieces = np.array([-(-n // most) if a == b else 1 for a, b, n in cut])
        self.starts, self.pieces = np.array([a for a, _, _ in cut]), pieces
        self.first = np.cumsum(pieces) - pieces
        # bins from which a vector can reach the part
        reach = math.ceil(math.sqrt(max(2 - 2 * cosine, 0) + SLACK) * BINS / 2) + 1
        self.low, self.high = (np.repeat(np.array([x[i] for x in cut]) + s * reach, pieces) for i, s in ((0, -1), (1, 1)))

    def home(self, place: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, place, "right") - 1
        return self.first[at] + (arrays.mix(h.view(np.uint64)) % self.pieces[at].astype(np.uint64)).astype(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch], parts: dict[int, Parts], diagonals: range) -> Iterator[pa.RecordBatch]:
    names = ["d", "i", "j", "right", "node", "copies", "vec"]
    for d, batch in _by_length(batches):
        if d in parts:
            place = _place(_vectors(batch.column("vec")))
            home = parts[d].home(place, batch.column("h").to_numpy())
            tasks = [(np.flatnonzero((parts[d].low[b] <= place) & (place <= parts[d].high[b]) & np.isin(abs(home - b), diagonals)), b) for b in range(len(parts[d].low))]
        else:
            home = np.zeros(batch.num_rows, np.int64)
            tasks = [(np.arange(batch.num_rows), 0)] if 0 in diagonals else []
        for rows, b in tasks:
            if len(rows):
                own, some = home[rows], batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d, np.int32)), pa.array(np.minimum(own, b)), pa.array(np.maximum(own, b)), pa.array(own > b),
                                                  *(some.column(c) for c in names[4:])], names=names)


def _tiles(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows that are near one another: halves along the widest dimension, until they are tiles."""
    if len(rows) <= TILE:
        return [rows] if len(rows) else []
    at, half = x[rows], len(rows) // 2
    order = np.argpartition(at[:, np.argmax(at.max(axis=0) - at.min(axis=0))], half)
    return _tiles(x, rows[order[:half]]) + _tiles(x, rows[order[half:]])


def _links(run: pa.Table, cosine: float) -> Iterator[pa.RecordBatch]:
    run = run.combine_chunks()
    raw = _vectors(run.column("vec").chunk(0))
    node, copies, right = run.column("node").to_numpy(), run.column("copies").to_numpy(), run.column("right").to_numpy()
    alone = run.column("i")[0].as_py() == run.column("j")[0].as_py()
    n, d = raw.shape
    scale, length, turned = np.empty(n), np.empty(n), np.empty((n, d), np.float32)
    some = max(1, PAIR_VALUES // d)
    for s in range(0, n, some):
        x = raw[s : s + some].astype(np.float64)
        scale[s : s + some] = np.abs(x).max(axis=1)
        x /= scale[s : s + some, None]
        length[s : s + some] = np.sqrt((x * x).sum(axis=1))
        turned[s : s + some] = (x / length[s : s + some, None]) @ rotation(d)

    def units(rows: np.ndarray) -> np.ndarray:
        return raw[rows].astype(np.float64) / scale[rows, None] / length[rows, None]

    cuts = shares(d, cosine)
    label, count = np.arange(n), np.zeros(n, np.int64)
    for block, (start, stop, share) in enumerate(cuts):
        part = np.ascontiguousarray(turned[:, start:stop])
        left = _tiles(part, np.arange(n) if alone else np.flatnonzero(~right))
        others = left if alone else _tiles(part, np.flatnonzero(right))
        if not left or not others:
            return
        square, one = (part * part).sum(axis=1)[:, None], np.ones((n, 1), np.float32)
        # the squared distance of a pair is one product of these
        rows, columns = np.hstack([-2 * part, square, one]), np.hstack([part, one, square])
        low, high = (np.array([f(part[q], axis=0) for q in others], np.float64) for f in (np.min, np.max))
        for a, p in enumerate(left):
            apart = np.maximum(0, np.maximum(low - part[p].max(axis=0), part[p].min(axis=0) - high))
            for b in np.flatnonzero((apart * apart).sum(axis=1) <= share + ROUGH):
                if alone and b < a:
                    continue
                q = others[b]
                u, v = np.divmod(np.flatnonzero(rows[p] @ columns[q].T <= np.float32(share + ROUGH)), len(q))
                if alone and a == b:
                    u, v = u[u < v], v[u < v]
                for s in range(0, len(u), some):
                    m, o = p[u[s : s + some]], q[v[s : s + some]]
                    gap = (turned[m].astype(np.float64) - turned[o]) ** 2
                    found = np.ones(len(m), bool)
                    for k, (f, t, most) in enumerate(cuts[: block + 1]):
                        within = gap[:, f:t].sum(axis=1) <= most + FINE
                        found &= within if k == block else ~within
                    m, o = m[found], o[found]
                    near = np.einsum("ij,ij->i", units(m), units(o)) >= cosine
                    m, o = m[near], o[near]
                    np.add.at(count, m, copies[o])
                    np.add.at(count, o, copies[m])
                    while len(m):
                        least = np.minimum(label[m], label[o])
                        np.minimum.at(label, label[m], least)
                        np.minimum.at(label, label[o], least)
                        while (label != label[label]).any():
                            label = label[label]
                        differ = label[m] != label[o]
                        m, o = m[differ], o[differ]
    some = np.flatnonzero(count)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(count[some])], names=["a", "b", "links"])


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    kind = rows.select(F.col(vector).alias("vec")).schema["vec"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # single precision is carried as it is
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vec"))
    sound = F.col("vec_id").isNotNull() & F.exists("vec", lambda v: v != 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.col("vec")).alias("vec"))
    keyed = rows.withColumn("h", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("k", F.hash("vec"))
    steps, spark = Tables(), rows.sparkSession
    with shuffles_dropped(spark):
        classes = steps.stored(keyed.where("h is not null").groupBy("h", "k").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
        # lengths with more vectors than a part: as many as there are parts at most
        lengths = {r.d for r in classes.groupBy(F.size("vec").alias("d")).count().where(F.col("count") > F.least(F.lit(PART_ROWS), F.lit(TASK_ROWS // 2), F.floor(F.lit(TASK_BYTES // 16) / F.col("d")))).collect()}
        counts: dict[int, dict[int, int]] = {d: {} for d in lengths}
        if lengths:
            bins = classes.select("vec").mapInArrow(lambda b: _bins(b, lengths), "d int, place long, n long")
            for r in bins.groupBy("d", "place").agg(F.sum("n").alias("n")).collect():
                counts[r.d][r.place] = r.n
        parts = {d: Parts(d, c, cosine) for d, c in counts.items()}
        most = max((len(p.low) for p in parts.values()), default=1)
        found = []
        for start in range(0, most, ROUND):
            diagonals = range(start, min(start + ROUND, most))
            dealt = classes.select("h", "node", "copies", "vec").mapInArrow(lambda b, diagonals=diagonals: _dealt(b, parts, diagonals),
                                                                           f"d int, i long, j long, right boolean, node long, copies long, vec {kind}")
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sum(max(0, len(p.low) - k) for p in parts.values() for k in diagonals))
            dealt = dealt.repartition(tasks, "d", "i", "j").sortWithinPartitions("d", "i", "j")
            found.append(steps.stored(dealt.mapInArrow(lambda b: (r for run in arrays.runs(b, ["d", "i", "j"]) for r in _links(run, cosine)), "a long, b long, links long")))
        found, rounds = reduce(DataFrame.unionAll, found), found
        links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        ids = components(found.select("a", "b"))
        out = classes.select("h", "k", "node", "copies").join(links, "node", "left").join(ids, "node", "left")
        out = stored(out.select("h", "k", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("found")))
    steps.drop(classes, *rounds)
    rows = keyed.select("vec_id", "h", "k").join(out, ["h", "k"], "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("found", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_near_vectors": (query, None)}
