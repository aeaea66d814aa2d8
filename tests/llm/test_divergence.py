"""The divergence audit against a plain version."""

import collections
import random
import re

import brute
import numpy as np
import pytest

from cardflow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, by_group, out = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(brute.LOWER))
        docs.update((lang, t) for t in set(terms))
        by_group[lang, source].update(terms)
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        groups = {s: c for (x, s), c in by_group.items() if x == lang}
        whole = sum(groups.values(), collections.Counter())

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)

        def far(a, b):
            return (a - b) ** 2 // (a + b)

        for s in groups:
            pair = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            term = [(-far(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(found)}
    return out


def audited(df, **options):
    rows = [tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_plain(spark, words):
    """Terms of all lengths, also such as differ in the last byte, in case and in a zero-like neighbour; ties; a group without terms."""
    rng = random.Random(3)
    odd = ["a", "A", "aa", "é", "日本語日本語日本語", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 16 + "y", "x" * 31 + "é", "y" * 32, "y" * 33, "Z" * 300, "ÀB"]
    some = words[:60] + odd * 3
    rows = [(rng.choice(["en", "fr", None]), rng.choice("abcde") if rng.random() < 0.9 else None, rng.choice([" ", "\x00", "_1"]).join(rng.choice(some) for _ in range(rng.randrange(40)))) for _ in range(300)]
    rows += [("xx", "a", None), ("xx", "b", ""), ("yy", "only", "alone"), ("en", "mute", "123"), (None, None, None)] + rows[:20]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = plain(rows)
    assert len(want) > 200 and audited(df) == want


def test_many_sources(spark, words, monkeypatch):
    """Several tiles by terms and by sources, and a source with a third of the rows, give the same as one."""
    monkeypatch.setattr(divergence, "TILE_TERMS", 7)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 3)
    rng = random.Random(4)
    rows = [("en", "hot" if rng.random() < 0.3 else f"s{rng.randrange(14)}", " ".join(rng.choice(words[:50]) for _ in range(rng.randrange(30)))) for _ in range(400)]
    assert audited(spark.createDataFrame(rows, "lang string, source string, text string")) == plain(rows)


def test_edges(spark, nasty):
    rows = [(r.lang, r.source, r.text) for r in nasty.collect()]
    assert audited(nasty, least_docs=2, top=3) == plain(rows, 2, 3)
    assert audited(nasty) == plain(rows)
    empty = divergence.audit(nasty.limit(0))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and not empty.collect()


@pytest.mark.parametrize("size", [1, 8, 9, 16, 17, 40, 3000])
def test_counts_of_one_length(size):
    """Radix and byte sort count the runs of each group, and each document once."""
    rng = np.random.default_rng(size)
    n = 500
    pool = rng.integers(0x61, 0x7B, (20, size)).astype(np.uint8)
    pick, group, doc = rng.integers(0, 20, n), rng.integers(0, 3, n), np.sort(rng.integers(0, 40, n))
    data = np.concatenate([pool[pick], np.full((n, 1), 0x20, np.uint8)], axis=1).ravel()
    starts = np.arange(n) * (size + 1)
    want = collections.Counter()
    seen = collections.defaultdict(set)
    for i in range(n):
        key = (int(group[i]), pool[pick[i]].tobytes().decode())
        want[key] += 1
        seen[key].add(int(doc[i]))
    got = {}
    for g, term, occurrences, docs in divergence.counted(data, starts, starts + size, group, doc):
        got |= {(int(a), b): (int(c), int(d)) for a, b, c, d in zip(g, term.to_pylist(), occurrences, docs, strict=True)}
    assert got == {k: (v, len(seen[k])) for k, v in want.items()}
