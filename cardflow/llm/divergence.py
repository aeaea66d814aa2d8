"""Source divergence audit: how far the word use of each source of a language is from that of the others, and which terms make it so.

Terms are the runs of letters and of anything beyond ASCII, A-Z lowered. A batch is counted in numpy by length: terms of up to 8 bytes are packed
into one uint64 word, those of up to 16 into two, radix-sorted by 16 bits at a time and counted by runs; longer terms are sorted by bytes, in a bucket
for each power of two of their length. Spark adds up the counts of the batches.

Every group (lang, source) gives each kept term of its language a smoothed share in billionths. Two sources are compared over all kept terms in tiles: some
thousand terms by some dozen sources on each side. A tile is a task whatever the number of sources, and holds a dense matrix of bounded size; terms
that none of its sources has are the same summand for all of them, and are added by their number.

Defined results: null text, lang and source are ''. A group without terms has the smoothed shares of no occurrence. A language without kept terms
has value 0 for all pairs and no terms. Every row is a document, also where doc_id is null or repeated; other columns are not looked at. An empty table gives
no rows. Ties rank by the bytes of the item. All arithmetic is in whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflow.llm import arrays
from cardflow.llm.frames import Tables, stored, table

SCALE = 1_000_000_000
#: About so many terms and sources (on each side) are a tile.
TILE_TERMS, TILE_SOURCES = 4096, 64

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as a word, the first one highest, zero behind the last one. data has 8 bytes more than needed."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[starts].view(">u8").ravel().astype(np.uint64)
    blank = (8 - np.minimum(sizes, 8)).astype(np.uint64) * np.uint64(8)
    return (words >> blank) << blank


def _radix(digits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The order, stably sorted by a word of 64 bits, from its lowest 16 bits to its highest."""
    for shift in range(0, 64, 16):
        digit = ((digits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]  # a radix sort, as these are 16 bits
    return order


def _runs(same: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, size and number of documents of the runs; same says which row equals the one before it."""
    first = np.flatnonzero(~same)
    fresh = ~same
    fresh[1:] |= docs[1:] != docs[:-1]
    return first, np.diff(np.append(first, len(same))), np.add.reduceat(fresh.astype(np.int64), first)


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, each up to its first zero, as strings."""
    inside = rows != 0
    offsets = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows[inside])])


def counted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Group, term, occurrences and documents of the distinct (group, term) of some terms; documents ascend."""
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    sizes = ends - starts
    for low, high in ((0, 8), (8, 16)):
        some = np.flatnonzero((sizes > low) & (sizes <= high))
        if not len(some):
            continue
        words = [_packed(data, starts[some] + at, sizes[some] - at) for at in range(0, high, 8)]
        order = np.arange(len(some))
        for w in (*reversed(words), group[some].astype(np.uint64)):
            order = _radix(w, order)
        words, g, d = [w[order] for w in words], group[some][order], doc[some][order]
        same = np.zeros(len(some), bool)
        same[1:] = np.all([w[1:] == w[:-1] for w in (*words, g)], axis=0)
        first, n, docs = _runs(same, d)
        yield g[first], _strings(np.stack([w[first] for w in words], axis=1).astype(">u8").view(np.uint8)), n, docs
    long = np.flatnonzero(sizes > 16)
    widths = np.ceil(np.log2(sizes[long])).astype(int)
    for width in np.unique(widths):
        some = long[widths == width]
        at = np.arange(1 << width)
        rows = np.zeros((len(some), 1 << width), np.uint8)
        for i, j in enumerate(some):
            rows[i, : sizes[j]] = data[starts[j] : ends[j]]
        keys = rows.view(f"S{len(at)}").ravel()
        order = np.argsort(keys, kind="stable")
        order = _radix(group[some].astype(np.uint64), order)
        keys, g, d = keys[order], group[some][order], doc[some][order]
        same = np.zeros(len(some), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (g[1:] == g[:-1])
        first, n, docs = _runs(same, d)
        yield g[first], _strings(rows[order[first]]), n, docs


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            data, offsets = arrays.utf8(part.column("text"))
            data = arrays.LOWER[data]
            starts, ends, first = arrays.spans(data, offsets, _SEPARATOR)
            if not len(starts):
                continue
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            for g, term, n, docs in counted(data, starts, ends, code[doc], doc):
                i, j = np.divmod(g, len(source.dictionary))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(i)), source.dictionary.take(pa.array(j)), term.cast(pa.string()), pa.array(n), pa.array(docs)],
                                                 names=["lang", "source", "term", "n", "docs"])


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 V)); null where there is no kept term."""
    whole = "decimal(19,0)"
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as {whole})) div nullif(cast({total} + 2 * v as {whole}), 0)")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of the distance of each two sources over the terms of a tile, and the number of these terms."""
    lang, _, i, j = (x.as_py() for x in key)
    base = rows.filter(pa.compute.is_null(rows.column("term")))
    order = np.argsort(np.array(base.column("source").to_pylist(), object), kind="stable")
    base = base.take(pa.array(order))
    sources, block, empty = base.column("source").combine_chunks(), base.column("block").to_numpy(), base.column("p").to_numpy()
    full = rows.filter(pa.compute.is_valid(rows.column("term")))
    terms = full.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    p = np.repeat(empty[:, None], len(terms.dictionary), axis=1)
    p[pa.compute.index_in(full.column("source"), value_set=sources).to_numpy(), terms.indices.to_numpy()] = full.column("p").to_numpy()
    a, b, value = [], [], []
    right = np.flatnonzero(block == j)
    for s in np.flatnonzero(block == i):
        others = right[right > s] if i == j else right
        gap = p[others] - p[s]
        a.append(np.full(len(others), s))
        b.append(others)
        value.append((gap * gap // (p[others] + p[s])).sum(axis=1))
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": sources.take(pa.array(a, pa.int64())), "b": sources.take(pa.array(b, pa.int64())),
                     "value": pa.array(value, pa.int64()), "terms": pa.array(np.full(len(a), p.shape[1]), pa.int64())})


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each two sources of a language (`pair`), and the terms that a source uses more than its
    language does (`term`, up to rank `top`)."""
    steps = Tables()
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = docs.mapInArrow(_terms, "lang string, source string, term string, n long, docs long")
    counts = steps.stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = steps.stored(kept.select("lang", "term", "lang_n"))
    found = steps.stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    groups = docs.select("lang", "source").distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = groups.withColumn("empty", F.coalesce(_share("0", "total"), F.lit(1).cast("long")))
    groups = steps.stored(groups)
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("blocks"))
    groups = stored(groups.join(blocks, "lang").withColumn("buckets", F.ceil((F.col("v") + 1) / TILE_TERMS).cast("int"))
                    .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
    shares = found.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total"))

    used = shares.withColumn("q", _share("lang_n", "lang_total")).where("p > q").withColumn("value", _distance("p", "q"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    used = used.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    tiles = shares.select("lang", "source", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "p")
    blank = groups.select("lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), F.col("empty").alias("p"))
    tiles = tiles.union(blank).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("lang", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "source", "block", "term", "p")
    sums = tiles.groupBy("lang", "bucket", "i", "j").applyInArrow(_tile, "lang string, a string, b string, value long, terms long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    sums = steps.stored(sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", "terms")
                        .union(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value", "terms")))
    item = groups.select("lang", F.col("source").alias("item"), F.col("empty").alias("item_empty"))
    pairs = sums.join(groups, ["lang", "source"]).join(item, ["lang", "item"])
    pairs = pairs.withColumn("value", F.col("value") + (F.col("v") - F.col("terms")) * _distance("empty", "item_empty"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = stored(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
                 .union(used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")))
    steps.drop(counts, kept, found, sums)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(kept.term) AS v, coalesce(sum(kept.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(g.n + 2 * l.v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (kept.n + 2) // CAST(l.n + 2 * l.v AS HUGEINT) AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 10"""

QUERIES = {"op11_source_divergence": (query, SQL)}
