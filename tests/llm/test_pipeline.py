"""The five stages over a small table, each against what its own input asks for."""

import collections

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cardflow.llm import lang_id, line_dedup, mixing, near_dup, packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before the first stage and after each, written and read as the pipeline does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [m.stage for m in (lang_id, line_dedup, near_dup, mixing, packing)]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_language(steps):
    """All texts of the table are in its languages."""
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[:2])
    assert after == before


def test_repeats(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[1:3])
    assert before.keys() == after.keys()
    seen = collections.Counter()
    for r in after.values():
        words = r.text.split()
        seen.update({" ".join(words[i : i + 60]) for i in range(len(words) - 59)})
        assert r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text))
    assert sum(n > 1 for n in seen.values()) < 0.01 * len(seen)


def test_near_duplicates(steps):
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    groups = brute.near_groups(texts, 5, 80)
    assert {r.doc_id: r.text for r in steps[3].collect()} == {d: t for d, t in texts.items() if groups[d] == d}


def test_mix(steps):
    sizes = {r.doc_id: (r.source, len(brute.WORD.findall(r.text))) for r in steps[3].collect()}
    taken, whole = collections.Counter(), collections.Counter()
    for r in steps[4].collect():
        n = len(brute.WORD.findall(r.text))
        taken[r.source] += n
        assert 0 < n <= sizes[r.doc_id][1] and r.n_chars == len(r.text)
    for source, n in sizes.values():
        whole[source] += n
    order = sorted(whole)
    goal = _targets({s: whole[s] for s in order})
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)


def _targets(sizes: dict) -> dict:
    """Shares by weight, resharing what is above twice a source's size until nothing is."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        share = {s: (budget - sum(full.values())) * w / sum(rest.values()) for s, w in rest.items()}
        above = [s for s in rest if share[s] > 2 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in above}


def test_packing(steps):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = steps[4].collect()
    want = collections.Counter()
    for e in tokens.encode_batch([r.text for r in rows], add_special_tokens=False):
        want.update([*e.ids, 1])
    got = collections.Counter()
    filled = collections.Counter()
    for r in steps[5].collect():
        got.update(r.ids)
        filled[r.sequence_id] += r.length
    assert got == want and max(filled.values()) <= 2048


def test_run(spark, steps):
    """run() gives the rows of the stages."""
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == steps[5].columns
    assert sorted(r.doc_tokens for r in got.where("start = 0").collect()) == sorted(r.doc_tokens for r in steps[5].where("start = 0").collect())
    assert np.isclose(got.count(), steps[5].count(), rtol=0.2)
