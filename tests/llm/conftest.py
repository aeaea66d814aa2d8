import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"

#: Columns that the operators use inside, as a table might have them.
CLASHES = ["key", "doc", "found", "size", "place", "target", "node", "component", "h", "k", "label", "labels", "band", "draw", "toxic", "kept", "range", "run", "finds", "at"]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return [("".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))) for _ in range(4000)]


@pytest.fixture(scope="session")
def nasty(spark, words):
    """Nulls in every column, empty and blank texts, a very long one, copies, near copies, repeated rows and clashing names."""
    rng = random.Random(6)

    def prose(n):
        return " ".join(rng.choice(words) + ("," if rng.random() < 0.1 else ".\n" if rng.random() < 0.05 else "") for _ in range(n))

    base = prose(200)
    near = [" ".join(rng.choice(words) if rng.random() < 0.01 else w for w in base.split(" ")) for _ in range(12)]
    texts = [None, "", " \n\t ", "x", "日本語 テキスト", "é     ñ", base, base, *near, prose(30), prose(30), prose(400_000), "1" * 50_000, "a" * 50_000,
             "mail bob@site.org or 10.0.0.1, +1 (988) 555-2485", "<p>not</p> html &amp; <|endoftext|>"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None), (None, None, None, None, None), (7, "same id, other text", "en", "a", 1)]
    rows = [r + ("clash",) * len(CLASHES) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
