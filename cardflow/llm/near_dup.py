"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct shingles of k words. Each of m registers holds floor(1 - log_b(h)) for the least of the
set's exponentially distributed hashes h (rate a), cut to 16 bits: registers of a union are the maxima, and two registers are
equal with about the chance of the Jaccard similarity. Rows of registers, hashed in bands, name candidates; the registers of a
candidate pair are weighed by their joint likelihood; what passes is confirmed on the full sets.

Equal sets are one class, named by its least doc_id, so that copies form no pairs. Classes that share a band hang on
its least member; connected, these give neighbourhoods outside of which no link can be. A neighbourhood is confirmed inside tasks, which
return a spanning forest of its links. One that is too large for a task is cut into pieces, and each pair of pieces is a task.

Bands are so many that a pair at the threshold is missed with a chance below MISS.

Defined results: a null, empty or blank text has no shingles and is linked with nothing. Rows without doc_id are linked with nothing and are kept. Rows that
repeat a doc_id follow their own text. Only the key and text columns are looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.llm import arrays
from cardflow.llm.frames import Tables, components, stored, table

#: Base, rate and largest value of the registers.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
ROWS = 5
MISS = 1e-6
#: A pair is confirmed unless a similarity of the threshold or more is less likely than the likeliest one by this factor (natural logarithm).
LIKELIHOOD = 14.0
#: Shingles and documents that a task compares at once.
TASK_SHINGLES, TASK_DOCS = 3_000_000, 2_000


def bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def factors(m: int) -> np.ndarray:
    return arrays.mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def registers(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty. The least hash of each decides, so that logarithms are taken once."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (multipliers[:, None] * shingles[None, at : at + 512]).min(axis=1), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / math.log(BASE)), 0, TOP).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, n_bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    multipliers = factors(n_bands * rows)
    for whole in batches:
        for batch in arrays.slices(whole, "text"):
            words, first = arrays.word_hashes(batch.column("text"), lower=True)
            n = np.zeros(batch.num_rows, np.int64)
            high, low = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            keys = np.zeros((batch.num_rows, n_bands), np.uint64)
            regs = []
            for i in range(batch.num_rows):
                s = arrays.shingle_hashes(words[first[i] : first[i + 1]], k)
                n[i] = len(s)
                if not len(s):
                    regs.append(None)
                    continue
                high[i], low[i] = s.sum(dtype=np.uint64), arrays.mix(s).sum(dtype=np.uint64)
                r = registers(s, multipliers)
                regs.append(r.tobytes())
                h = np.arange(n_bands, dtype=np.uint64)
                for j in range(rows):
                    h = arrays.mix(h * np.uint64(0x100000001B3) + r.reshape(n_bands, rows)[:, j])
                keys[i] = h
            empty = n == 0
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, n_bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(high.view(np.int64), mask=empty), pa.array(low.view(np.int64), mask=empty), lists, pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "high", "low", "bands", "registers"])


def joint_similarity(mine: np.ndarray, others: np.ndarray, n_mine: int, n_others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest Jaccard similarity of one set with each of others, given their registers and sizes, and by how much (logarithm) the
    likeliest one of at least the threshold falls short of it."""
    grid = np.unique(np.append(np.linspace(0, 1, 41), threshold))
    above, below = (mine > others).sum(axis=1), (mine < others).sum(axis=1)
    same = others.shape[1] - above - below
    u, v = n_mine / (n_mine + n_others), n_others / (n_mine + n_others)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    most = np.minimum(u / v, v / u)[:, None]
    j = np.minimum(grid, most)
    up, down = np.clip(p(u[:, None] - v[:, None] * j), 1e-9, 1), np.clip(p(v[:, None] - u[:, None] * j), 1e-9, 1)
    like = above[:, None] * np.log(up) + below[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-9, 1))
    best = like.argmax(axis=1)
    short = like.max(axis=1) - np.where(grid >= threshold, like, -np.inf).max(axis=1)
    return j[np.arange(len(others)), best], np.where(most[:, 0] < threshold - 1e-12, np.inf, short)


def spanning(sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest: pairs with 100 * intersection >= percent * union. A set is compared with all that are not yet connected
    with it; only sets within the largest component may stay uncompared, as links between those change nothing."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(ids), bool)
    component, done, links = np.arange(n), np.zeros(n, bool), []
    turn = 0
    while True:
        done[turn] = True
        others = np.flatnonzero(component != component[turn])
        if len(others):
            _, short = joint_similarity(regs[turn], regs[others], int(size[turn]), size[others], percent / 100)
            others = others[short <= LIKELIHOOD]
        if len(others):
            mine = flat[start[turn] : start[turn + 1]]
            mark[mine] = True
            shared = np.array([np.count_nonzero(mark[flat[start[i] : start[i + 1]]]) for i in others])
            mark[mine] = False
            for i in others[100 * shared >= percent * (size[turn] + size[others] - shared)]:
                if component[i] != component[turn]:
                    component[component == component[i]] = component[turn]
                    links.append((turn, int(i)))
        sizes = np.bincount(component, minlength=n)
        left = np.flatnonzero(~done & (component != sizes.argmax()))
        if not len(left):
            return links
        turn = int(left[0])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            links = spanning(sets, np.stack(regs), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["a", "b"])

    key, nodes, sets, regs = None, [], [], []
    for whole in batches:
        for batch in arrays.slices(whole, "text"):
            words, first = arrays.word_hashes(batch.column("text"), lower=True)
            units = zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "node", "registers")))
            for row, (component, i, j, node, r) in enumerate(units):
                if (component, i, j) != key:
                    yield from out()
                    key, nodes, sets, regs = (component, i, j), [], [], []
                s = arrays.shingle_hashes(words[first[row] : first[row + 1]], k)
                if len(s):
                    nodes.append(node)
                    sets.append(s)
                    regs.append(np.frombuffer(r, np.uint16))
    yield from out()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document; documents are linked where 100 * intersection >= percent * union."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_bands = bands(percent / 100)
    steps = Tables()
    sketches = steps.stored(docs.mapInArrow(
        lambda batches: arrays.giving_back(_sketch(batches, k, n_bands, ROWS)),
        "doc_id long, n_shingles long, high long, low long, bands array<long>, registers binary"))
    classes = steps.stored(sketches.where("doc_id is not null and n_shingles > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers")))

    banded = classes.select("node", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("band", "leader")
    near = components(banded.join(leaders, "band").where("node > leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))

    members = steps.stored(near.join(classes.select("node", "n", "registers"), "node"))
    sizes = members.groupBy("component").agg(F.greatest(F.sum("n") * 2 / TASK_SHINGLES, F.count("*") * 2 / TASK_DOCS).alias("size"))
    pieces = steps.stored(sizes.where("size > 2").select("component", F.ceil("size").cast("int").alias("pieces")))
    cut = members.join(pieces, "component", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = cut.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    other = F.when(F.col("pieces") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("pieces") - 1), F.col("piece")))
    cut = cut.join(docs.where("doc_id is not null").withColumnRenamed("doc_id", "node"), "node").withColumn("other", F.explode(other))
    units = cut.select("component", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "node", "registers", "text")
    links = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(
        lambda batches: arrays.giving_back(_confirm(batches, k, percent)), "a long, b long")

    found = classes.select("high", "low", "node").join(components(links), "node", "left")
    found = steps.stored(found.select("high", "low", F.coalesce("component", "node").alias("found")))
    out = sketches.select("doc_id", "n_shingles", "high", "low").join(found, ["high", "low"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    out = stored(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    steps.drop(sketches, classes, members, pieces, found)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id. Of rows that repeat both doc_id and text, one stays."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    some = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return some.select(*docs.columns).unionByName(docs.where("doc_id is null"))


QUERIES = {"op4_near_duplicates": (query, None)}
