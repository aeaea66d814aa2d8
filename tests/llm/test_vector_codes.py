"""Codes of vectors against a plain version in Python's whole numbers."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from cardflow.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=4):
    """rows: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], None
    whole = [[max(-(1 << 24), min(1 << 24, math.floor(1024 * float(np.float32(x))))) for x in v] for _, v, _ in kept]
    d = len(whole[0])
    parts = [[tuple(v[i * d // 4 : (i + 1) * d // 4]) for v in whole] for i in range(4)]
    books = [list(p[:256]) for p in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book)) for x in p] for p, book in zip(parts, books)]

    for _ in range(rounds):
        for p, found, book in zip(parts, assign(), books):
            members = collections.defaultdict(list)
            for x, (_, e) in zip(p, found):
                members[e].append(x)
            for e, xs in members.items():
                book[e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    found = assign()
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    errors = [sum(found[p][i][0] for p in range(4)) for i in range(len(kept))]
    total = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        total[label] += e
    return [(r[0], "".join(f"{found[p][i][1]:02x}" for p in range(4)), e, total[r[2]]) for i, (r, e) in enumerate(zip(kept, errors))], sha


def check(df, want):
    rows, sha = want
    got = vector_codes.codes(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key) == sorted(rows, key=key)
    assert {r.codebooks_sha256 for r in got} == ({sha} if rows else set())


def made(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (20, d))
    return [(int(i), [float(x) for x in np.float32(centres[rng.integers(20)] + rng.normal(0, 0.2 * spread, d))], int(rng.integers(4))) for i in rng.permutation(n)]


@pytest.mark.parametrize("d", [8, 10, 3])
def test_against_plain(spark, d):
    """Also lengths that four doesn't divide, and a vector that a third of the rows have, under one label."""
    rows = made(400, d, d)
    rows += [(1000 + i, rows[0][1], 9) for i in range(200)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(6), plain(rows))


def test_owners(spark, monkeypatch):
    """Many owners for an entry change nothing, and only what changes its entry is dealt out again."""
    rows = made(500, 8, 1)
    rows += [(2000 + i, rows[5][1], 1) for i in range(250)]
    monkeypatch.setattr(vector_codes, "OWNER_MEMBERS", 20)
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), plain(rows))


def test_members_that_stay(spark):
    rows = vector_codes._vectors(spark.createDataFrame(made(600, 8, 2), SCHEMA), "embedding").select("vec_id", "vec")
    books = vector_codes.learn(rows, 1)
    members = rows.select("vec").mapInArrow(lambda b: vector_codes._first(b, books, 8, 3), vector_codes.MEMBER)
    again = members.mapInArrow(lambda b: vector_codes._moved(b, books), f"{vector_codes.MEMBER}, stays boolean")
    assert {r.stays for r in again.collect()} == {True}
    other = vector_codes._updated(members, books)
    moved = members.mapInArrow(lambda b: vector_codes._moved(b, other), f"{vector_codes.MEMBER}, stays boolean").collect()
    assert 0 < sum(not r.stays for r in moved) < len(moved)
    x = np.stack([np.frombuffer(r.part, "<i4") for r in moved if r.position == 1]).astype(np.int64)
    assert [r.entry for r in moved if r.position == 1] == vector_codes.nearest(x, other[1])[0].tolist()


def test_edges(spark):
    """Nulls in any column, odd numbers, other lengths, repeated rows, ties, huge numbers, clashing names, empty tables."""
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(7, None, 1), (8, [], 1), (9, [1.0, None, 1.0, 1.0], 1), (10, [nan, 1.0, 1.0, 1.0], None), (11, [inf, 0.0, 0.0, 0.0], 2), (12, [1.0, 2.0], 2),
            (None, None, None), (None, [0.5, -0.5, 0.25, 0.0], None), (3, [0.0, 0.0, 0.0, 0.0], None), (3, [0.0, 0.0, 0.0, 0.0], None), (4, [-0.0, 0.0, 1e-9, -1e-9], 1),
            (5, [16384.5, -1e30, 3e38, 7.25], 3), (6, [0.1, 0.2, 0.3, 0.4], 3)]
    rows += [(100 + i, [rng.choice([-1.0, -0.001, 0.5, 1.0]) for _ in range(4)], rng.choice([1, None])) for i in range(300)]
    clashes = ["vec", "position", "entry", "salt", "part", "copies", "code", "error", "label_error", "stays", "c", "t"]
    df = spark.createDataFrame([r + ("clash",) * len(clashes) for r in rows], SCHEMA + "".join(f", {c} string" for c in clashes))
    check(df, plain(rows))
    check(df.where("vec_id < 7"), plain([r for r in rows if r[0] is not None and r[0] < 7]))
    check(df.limit(0), ([], None))
    check(df.where("embedding is null"), ([], None))


def test_exact_distances():
    """Double precision is only used where it is exact; ties go to the lower index."""
    rng = np.random.default_rng(5)
    for most in (3, 1000, vector_codes.BOUND):
        x, book = rng.integers(-most, most + 1, (300, 16)), rng.integers(-most, most + 1, (40, 16))
        book[7] = book[3]
        x[0] = book[3]
        at, far = vector_codes.nearest(x, book)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), i) for i, e in enumerate(book)) for r in x]
        assert [(int(f), int(a)) for f, a in zip(far, at)] == want and at[0] == 3
