"""Every operator and stage over nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardflow.llm import arrays, html_text, lang_id, line_dedup, media, mixing, near_dup, packing, pii, toxicity, vector_dup


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_columns(spark, nasty, name, stage):
    out = stage(spark, nasty, "")
    assert out.columns == nasty.columns and out.dtypes == nasty.dtypes
    assert out.count() > 0
    assert stage(spark, nasty.limit(0), "").count() == 0


def test_packing_edges(spark, nasty):
    out = packing.pack(nasty)
    tokens = out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in tokens) == out.agg(F.sum(F.size("ids"))).first()[0]
    got = {r.doc_id: r.n for r in tokens}
    assert got[0] == 1 and got[1] == 1
    assert packing.pack(nasty.limit(0)).count() == 0


def test_language_edges(spark, nasty):
    docs = nasty
    model = lang_id.fit(docs)
    got = {r.doc_id: r for r in docs.where("doc_id < 6").select("doc_id", lang_id.predict(F.col("text"), model).alias("r")).select("doc_id", "r.*").collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in range(3))
    assert got[4].rejected and got[4].lang_pred in ("en", "fr")
    empty = lang_id.fit(docs.where("false"))
    row = docs.limit(1).select(lang_id.predict(F.col("text"), empty).alias("r")).first().r
    assert row.lang_pred == "und" and not row.rejected


def test_near_duplicate_edges(spark, nasty):
    got = near_dup.near_duplicates(nasty, k=3, percent=85).collect()
    assert len(got) == nasty.count()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    for i in (0, 1, 2):
        assert by[i, 0].component_id == i and by[i, 0].kept
    assert by[3, 1].component_id == 3
    assert {r.component_id for r in got if r.doc_id == 6} == {6} and by[7, by[6, max(n for d, n in by if d == 6)].n_shingles].component_id == 6
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dup.near_duplicates(nasty.limit(0)).count() == 0


def test_line_dedup_edges(spark, nasty):
    got = line_dedup.remove_repeats(nasty).select("doc.doc_id", F.col("doc.text").alias("old"), "found.*").collect()
    assert len(got) == nasty.count()
    assert all(r.text == r.old for r in got if r.doc_id in (None, 0, 1, 2, 3, 6))
    copy = next(r for r in got if r.doc_id == 7 and r.removed_words > 0)
    assert copy.text == "" and copy.removed[0].start == 0


def test_mixing_edges(spark, nasty):
    rows = mixing.schedule(nasty).select("doc.doc_id", "size", "target", "taken").collect()
    assert len(rows) == nasty.count()
    assert all(sum(r.taken) <= 2 * r["size"] for r in rows)
    assert mixing.mix(nasty.where("text is null")).count() == 0


def test_sanitise_edges(spark, nasty):
    got = {r.doc_id: r for r in pii.sanitise(nasty).select("doc.doc_id", "text", "email", "ip", "phone", "clean").where("doc_id <> 7").collect()}
    assert got[0].clean == "" and got[1].clean == ""
    row = next(r for r in got.values() if "bob@" in r.text)
    assert row.clean == "mail [EMAIL] or [IP], [PHONE]"
    assert got[3].clean == "x"
    assert pii.sanitise(nasty.limit(0)).count() == 0


def test_media_edges(spark, nasty):
    got = nasty.select("doc_id", media.analyse(media.encode(F.col("text"))).alias("r")).select("doc_id", "r.*").collect()
    assert len(got) == nasty.count() and all(r.payload_bytes % 576 == 0 and r.payload_bytes for r in got)
    empty = [r.feature for r in got if r.doc_id in (0, 1)]
    assert empty[0] == empty[1]


def test_toxicity_edges(spark, nasty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    model = toxicity.fit(nasty, labels)
    got = [r[0] for r in nasty.select(toxicity.scored(F.col("text"), model)).collect()]
    assert all(0 <= s <= 1 for s in got)
    alone = toxicity.fit(nasty, labels.where("toxic = 1"))
    assert {r[0] for r in nasty.select(toxicity.scored(F.col("text"), alone)).collect()} == {1.0}
    none = toxicity.fit(nasty, labels.limit(0))
    assert {r[0] for r in nasty.select(toxicity.scored(F.col("text"), none)).collect()} == {0.0}


def test_page_edges(spark):
    pages = ["", None, "plain text", "<p>", "<div>" * 30_000 + "deep, text" + "</div>" * 10, "<p>" + "long words, " * 200_000, "</div></p>x<script>y", "<!-- open", "<a href='x>y'>z</a>"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = [r[0] for r in df.select(html_text.extract(F.col("html"))).collect()]
    assert got[:5] == ["", "", "plain text", "", "deep, text"] and len(got[5]) == 12 * 200_000 - 1 and got[6:] == ["x", "", "z"]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]),
            (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [1e300, 1e298]), (11, [1e-300, 0.0]), (12, [-1.0, 0.0]), (13, [5.0]), (14, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("links", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dup.near_vectors(df).collect()}
    linked = {0, 1, 9, 10, 11}  # 9 stands for two rows
    for i in linked:
        assert got[i] == (5, 0, i == 0), i
    for i in (2, 3, 4, 5, 6, 7, 8, 12):
        assert got[i] == (0, i, True), i
    assert got[13] == (1, 13, True) and got[14] == (1, 13, False) and got[None] == (0, None, True)
    assert vector_dup.near_vectors(df.limit(0)).count() == 0


def test_memory_is_given_back_after_a_task():
    """What a task freed is no longer the process's, even below memory that is still in use."""

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4 // 1024

    kept = []

    def task():
        held = [bytes(60_000) for _ in range(5_000)]  # 300 MB in pieces that come from the heap
        kept.append([bytes(60_000) for _ in range(10)])  # lies above them
        del held
        kept.append(resident())
        yield from ()

    assert list(arrays.giving_back(task())) == []
    assert resident() < kept[1] - 100


def test_toxicity_learns_from_every_row(spark):
    """A word that only a few of many labelled rows hold, far behind in a long text in one of them, decides their label."""
    filler = " ".join(f"word{i % 211}" for i in range(5_000))
    rows = [(i, f"plain text number {i} of many", 0) for i in range(6_000)] + [(9_000 + i, f"awful text number {i} of many", 1) for i in range(100)]
    rows += [(20_000 + i, f"{filler} vile{'x' * 9}{i} {filler}" if i == 0 else f"zymurgic text number {i} of many", 1) for i in range(12)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen = []
    train = toxicity._train
    try:
        toxicity._train = lambda found, n: seen.append((n.tolist(), found.agg(F.max(F.length("words"))).first()[0])) or train(found, n)
        model = toxicity.fit(docs, labels)
    finally:
        toxicity._train = train
    assert seen == [([6_000, 112], 10_001 * 6)]
    scores = {r[0]: r[1] for r in docs.select("doc_id", toxicity.scored(F.col("text"), model)).collect()}
    assert all(scores[r[0]] >= 0.7 for r in rows if r[0] > 20_000) and max(scores[i] for i in range(6_000)) < 0.7


def test_repeats_of_a_batch_are_removed_with_one_look_at_its_words(monkeypatch):
    words, calls = line_dedup.words, []
    monkeypatch.setattr(line_dedup, "words", lambda *a: calls.append(1) or words(*a))
    passage = " ".join(f"é{i}" for i in range(40))
    texts = [f"own {i} {passage} end" if i % 3 else None if i else "" for i in range(50)]
    n = len(passage.encode())
    finds = [[{"at": len(f"own {i} "), "end": len(f"own {i} ") + n, "stays": 0, "before": b"", "same": passage.encode(), "after": b""}] if i % 3 else None if i else [] for i in range(50)]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("stays", pa.int32()), ("before", pa.binary()), ("same", pa.binary()), ("after", pa.binary())]))
    got = line_dedup._removed(pa.array(texts), pa.array(finds, kind)).to_pylist()
    assert len(calls) == 1
    assert [r["removed_words"] for r in got] == [40 if i % 3 else 0 for i in range(50)]
    assert [(r["text"] or "").split() for r in got] == [["own", str(i), "end"] if i % 3 else [] for i in range(50)]


def test_vectors_are_stored_once_and_leave_no_shuffle_files(spark, monkeypatch):
    """No step holds more rows than there are vectors, and what the parts are dealt by is gone when the links are counted."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))], "vec_id long, embedding array<float>")
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    rows, left, write = [], [], vector_dup.Tables.stored

    def stored(self, step, *by):
        before = disk.getAllFiles().size()
        out = write(self, step, *by)
        time.sleep(0.3)  # files are removed beside the caller
        left.append(disk.getAllFiles().size() - before)
        rows.append(out.count())
        return out

    monkeypatch.setattr(vector_dup.Tables, "stored", stored)
    monkeypatch.setattr(vector_dup, "components", lambda edges: edges.selectExpr("a AS node", "b AS component"))
    vector_dup.near_vectors(df)
    assert max(rows) <= 300 and max(left) <= 0


def test_vectors_in_many_parts(spark, monkeypatch):
    """Parts cut along the coordinate and, where all lie at one place, by a hash; several rounds; two lengths; single precision."""
    monkeypatch.setattr(vector_dup, "TASK_ROWS", 16)
    monkeypatch.setattr(vector_dup, "PART_ROWS", 4)
    monkeypatch.setattr(vector_dup, "ROUND", 2)
    rng = np.random.default_rng(4)
    x = [*np.concatenate([rng.normal(size=(10, 6))] * 3) + rng.normal(scale=0.2, size=(30, 6)), *(np.array([s]) for s in [*range(1, 21), *range(-9, 0)])]
    x = [v.astype(np.float32) for v in x]
    got = {r.vec_id: r for r in vector_dup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    unit = [v.astype(float) / np.linalg.norm(v.astype(float)) for v in x]
    near = [[i != j and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    up = list(range(len(x)))
    for _ in x:
        up = [min([up[i], *(up[j] for j in range(len(x)) if near[i][j])]) for i in range(len(x))]
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(sum(near[i]), up[i]) for i in range(len(x))]
    assert sum(near[0]) and sum(near[30]) == 19 and sum(near[50]) == 8
