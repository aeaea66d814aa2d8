"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import io
import random
import wave
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardflow.llm import html_text, lang_id, line_dedup, media, mixing, near_dup, packing, pii, toxicity, vector_dup

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_held_out(spark, docs):
    got = lang_id.query(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert not any(r.rejected for r in got) and all(0 < r.score <= 1 for r in got)


def test_language_rejects_what_is_far(spark, docs):
    model = lang_id.fit(docs)
    rng = random.Random(8)
    strange = ["".join(chr(rng.randrange(0x400, 0x450)) if j % 6 else " " for j in range(200)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in [*strange, "漢字かな交じり文" * 5]], "text string")
    assert all(r[0] for r in df.select(lang_id.predict(F.col("text"), model)["rejected"]).collect())


def test_language_limits_by_length(spark, docs):
    """Passages of other languages in Latin script go, and held-out texts and their beginnings of any length stay."""
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    foreign = ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Quanto a dir qual era è cosa dura questa selva",
               "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan",
               "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych",
               "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile"]
    assert all(model.predict(pa.array(foreign))[3])
    own = [r.text for r in docs.where(lang_id.held_out()).collect() if r.text and lang_id.LETTER.search(r.text)]
    for n in (12, 40, 150, 600, 2400):
        rejected = model.predict(pa.array([t[:n] for t in own if len(t) >= n and lang_id.LETTER.search(t[:n])]))[3]
        assert len(rejected) > 30 and np.mean(rejected) <= 0.03


def test_language_batches(spark, docs):
    """The result of a text does not depend on the rows beside it."""
    model = lang_id.fit(docs)
    some = docs.limit(60)
    found = lang_id.predict(F.col("text"), model)
    one = {r.doc_id: r.r for r in some.repartition(30).select("doc_id", found.alias("r")).collect()}
    assert one == {r.doc_id: r.r for r in some.coalesce(1).select("doc_id", found.alias("r")).collect()}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, k, percent):
    """Families around a base with more and more changes, copies, and short texts."""
    rng = random.Random(k)
    texts = []
    for n in (1, 2, 4, 30, 120, 300):
        base = [rng.choice(words) for _ in range(n)]
        for changes in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 10):
            t = list(base)
            for _ in range(changes):
                t[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(t).upper() if rng.random() < 0.3 else "  ".join(t))
    rng.shuffle(texts)
    texts = dict(enumerate([*texts, None, "", "\t"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, k=k, percent=percent).collect()}
    want = brute.near_groups(texts, k, percent)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].n_shingles == len(brute.shingles(t, k)) and got[d].kept == (want[d] == d) for d, t in texts.items())


def test_near_duplicates_in_pieces(spark, words, monkeypatch):
    """A neighbourhood that is cut into pieces gives the same groups."""
    rng = random.Random(9)
    base = [rng.choice(words) for _ in range(60)]
    texts = {i: " ".join(rng.choice(words) if rng.random() < 0.03 else w for w in base) for i in range(60)}
    monkeypatch.setattr(near_dup, "TASK_DOCS", 16)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, k=3, percent=85).collect()}
    assert got == brute.near_groups(texts, 3, 85)


def test_joint_similarity():
    """The likeliest similarity is near the true one."""
    rng = np.random.default_rng(2)
    m = near_dup.factors(400)
    for share in (0.2, 0.5, 0.9):
        both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        n = int(1000 * share / (2 - share) * (1 + share) / 2 * 2 / (1 + share))
        a, b = np.unique(both), np.unique(np.concatenate([both[: int(1000 * share)], rng.integers(0, 1 << 63, 1000 - int(1000 * share), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found, _ = near_dup.joint_similarity(near_dup.registers(a, m), near_dup.registers(b, m)[None, :], len(a), np.array([len(b)]), 0.8)
        assert abs(found[0] - true) < 0.12, (share, n)


def test_line_dedup(spark, words):
    """A passage in many texts stays in the first; clean texts don't change."""
    rng = random.Random(3)

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [prose(n) for n in (55, 70, 120)]
    rows, holders = [], collections.defaultdict(list)
    for i in range(90):
        lines = [prose(rng.randrange(20, 60)) for _ in range(5)]
        if i % 3 == 0:
            p = (i // 3) % 3
            lines.insert(rng.randrange(6), passages[p])
            holders[p].append(i)
        rows.append((i, "\n".join(lines)))
    rows.append((90, rows[1][1]))
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "found.*").collect()}
    for p, ids in holders.items():
        assert passages[p] in got[ids[0]].text
        assert all(passages[p] not in got[i].text and got[i].removed_words >= len(passages[p].split()) for i in ids[1:])
    assert got[90].text == "" and got[1].text == rows[1][1]
    assert all(got[i].text == t for i, t in rows[:90] if i % 3)
    for i, t in rows:
        at, kept = 0, []
        for s in got[i].removed:
            kept.append(t[at : s.start])
            at = s.end
        assert "".join(kept) + t[at:] == got[i].text


@pytest.mark.parametrize("white", ["\n", "\n\t", " "])
def test_line_dedup_short_lines(spark, words, white):
    """Passages of 10 to 30 short lines (or with tabs, or in a paragraph) go from all texts but the first, and nothing beside them."""
    rng = random.Random(len(white))

    def lines(n, most=3):
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, most + 1))) for _ in range(n))

    passages = []
    while len(passages) < 12:
        p = "".join(rng.choice(white) if c in "\n " else c for c in lines(rng.randrange(10, 31)))
        passages += [p] * (len(p.split()) >= 30)
    rows, own = [], {}
    for i in range(60):
        own[i] = f"{lines(rng.randrange(1, 40))} end{i}", f"{i}begins {lines(rng.randrange(1, 40))}"
        rows.append((i, f"{own[i][0]}\n{passages[i % 12]}\n{own[i][1]}"))
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "found.*").collect()}
    for i, t in rows:
        if i < 12:
            assert got[i].text == t
        else:
            assert got[i].text.split() == " ".join(own[i]).split() and got[i].removed_words == len(passages[i % 12].split())


def test_line_dedup_every_passage_has_a_chunk():
    """30 words or more hold a whole chunk wherever they stand, and what is beside the chunks is in reach."""
    rng = random.Random(9)

    def prose(n, white=" "):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))) + rng.choice(white).strip(" ") for _ in range(n))

    for _ in range(300):
        passage, found = prose(rng.randrange(30, 60), " \n"), []
        for text in (f"{prose(rng.randrange(40))} {passage} {prose(rng.randrange(40))}", passage):
            data = np.frombuffer(text.encode(), np.uint8)
            s, e, h = line_dedup.chunks(data, np.array([0, len(data)]))
            at = text.index(passage)
            starts = line_dedup.words(data, np.array([0, len(data)]))[0]
            n = np.searchsorted(starts, [at, at + len(passage)])
            mine = np.searchsorted(starts, s[(s >= at) & (e <= at + len(passage))])
            gaps = np.diff([n[0], *mine, n[1] - line_dedup.GRAM])
            assert len(mine) and gaps.max() <= line_dedup.SPAN
            found.append(set(h.tolist()))
        assert found[0] & found[1] and found[1]


def test_line_dedup_without_spaces(spark):
    """Text without white space is cut by its bytes; a text that repeats one word keeps its first chunk."""
    rng = random.Random(7)

    def kanji(n):
        return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))

    passage = kanji(600)
    rows = [(i, kanji(100) + passage + kanji(100)) for i in range(6)] + [(6, "la " * 300)]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "found.*").collect()}
    assert got[0].text == rows[0][1] and all(200 <= len(got[i].text) <= 240 for i in range(1, 6))
    assert 10 <= len(got[6].text.split()) <= 30


def test_mix_takes_targets(spark, docs):
    rows = mixing.schedule(docs).select("doc.source", "size", "target", "source_size", "taken", "finish").collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += sum(r.taken)
        target[r.source] = r.target
        assert sum(r.taken) <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    assert abs(sum(target.values()) - 1.5 * total) < 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    mixed = mixing.mix(docs).select("virtual_finish").collect()
    assert [r[0] for r in mixed] == sorted(r[0] for r in mixed)


def test_packing_round_trip(spark, docs):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "a   b \n\n c　 d\x85 \t", -4: "don't 12ab..  'll"}
    ids = {d: e.ids + [1] for d, e in zip(texts, tokens.encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    got = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for held, lengths in ((sequences, {}), (pieces, {d: len(x) for d, x in ids.items()})):
        for key, parts in held.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == lengths.get(key, at) and (held is pieces or at <= 2048)
    assert pieces.keys() == ids.keys()
    full = [sum(n for _, n in parts) for parts in sequences.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in full)


def test_packing_neighbours():
    """Retrieval prefers documents with the same rare words."""
    rng = np.random.default_rng(1)
    topics = [rng.integers(t * 50, t * 50 + 50, 40) for t in (0, 0, 1, 1, 2, 2, 3, 3, 4, 4)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in topics])])
    index = packing.Index(np.concatenate(topics), first)
    for i in range(0, 10, 2):
        index.unused[:] = True
        index.unused[i] = False
        assert next(index.neighbours(i)) == i + 1


def test_sanitise(spark):
    rng = random.Random(4)
    texts = [f"note {i} {'zorblatt' if i < 5 else 'word'} wrote jane@corp{i % 2 if i >= 5 else 0}.org about plain things {rng.random():.3f}".replace(".org", f"{'' if i < 5 else i}.org")
             for i in range(40)] + ["plain things and words " * 3] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).select("doc.doc_id", "email", "terms", "clean").collect()}
    for i, t in enumerate(texts):
        assert [("email", s.start, s.end) for s in got[i].email] == [s for s in brute.base_spans(t) if s[0] == "email"]
    assert all(texts[i][t.start : t.end] == "zorblatt" for i in range(5) for t in got[i].terms) and all(got[i].terms for i in range(5))
    assert all("zorblatt" not in got[i].clean and "[EMAIL]" in got[i].clean for i in range(5))
    assert not any(got[i].terms for i in range(5, 80))


def test_base_spans(spark):
    rng = random.Random(7)
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1", "9" * 40_000, "1 " * 40_000, "a@b" + ".c" * 20_000, "+1" + "-" * 40_000 + "2", "x" * 40_000 + "@y.z",
             "4111 1111 1111 1111 4111111111111112", "\U0001F600 a@b.co é 1.2.3.4", "+1 (988) 555-2485 +123"]
    texts += ["".join(rng.choice("ab1.2@-+ ()%_é\U0001F600") for _ in range(rng.randrange(5, 80))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.identifiers(df).select("doc.doc_id", *pii.KINDS).collect():
        assert [(k, s.start, s.end) for k in pii.KINDS for s in r[k]] == brute.base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_media_round_trip(spark, docs):
    rows = docs.limit(50).select("doc_id", "text", media.encode(F.col("text")).alias("media")).select("*", media.analyse(F.col("media")).alias("r")).collect()
    for r in rows:
        raw = r.text.encode()
        raw += b"\xff" * (-len(raw) % 576 if raw else 576)
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert w.readframes(w.getnframes()) == raw and w.getsampwidth() == 1
        assert r.r.payload_bytes == len(raw) and r.r.tail_crc32 == zlib.crc32(raw[-32:]) and r.r.media_bytes == len(r.media)
        assert sorted(r.r.fingerprint) == list(r.r.fingerprint) and r.r.feature.split(":")[2] == str(len(r.r.fingerprint))


def test_fingerprint_shift():
    """What is played later gives the same pairs, later."""
    rng = np.random.default_rng(0)
    sound = rng.integers(0, 256, 576 * 30).astype(np.uint8)
    late = np.concatenate([rng.integers(0, 256, 576 * 4).astype(np.uint8), sound])
    a, b = media.fingerprint(sound)[0], media.fingerprint(late)[0]
    assert len(np.intersect1d(a + ((576 * 4 // media.HOP) << 26), b)) > 0.9 * len(a)


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.query(spark, SF).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.85
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9 and all(r.predicted == int(r.score >= 0.7) for r in got)


@pytest.mark.parametrize("page,text", [
    ("<body><nav><a href=/>home</a></nav><article><h1>T &amp; t</h1><p>One,<br>two &nbsp; three.<p>Four</article><footer>f</footer>", "T & t\nOne, two three.\nFour"),
    ("<div class='top menu'>m, m, m</div><div id=main><p>Long text, with commas, and more of it.</p><div class=ad>buy, now</div><p>End.</p></div><div class='comments'><p>I, too, think, so, a lot.</p></div>",
     "Long text, with commas, and more of it.\nEnd."),
    ("<main><div><p>A text, first.</p></div><div><p>B.</p></div><aside>side, bar</aside><form><p>mail, address</p></form></main><script>var a='<p>x</p>'</script>", "A text, first.\nB."),
    ("<article><p>a<b>b</b>c <i>d</i></p><ul><li><a>x</a><li><a>y</a></ul><ol><li>one</li><li>two</ol></article>", "abc d\none\ntwo"),
    ("<article><div role='dialog'>accept, all</div><p style='display: none'>h</p><p>t &lt;b&gt; &#233;&#x41; &am", "t <b> éA &am"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("n,d,task", [(400, 16, 8192), (400, 16, 40), (60, 3, 8192), (50, 1, 8192)])
def test_near_vectors(spark, monkeypatch, n, d, task):
    rng = np.random.default_rng(n + d)
    base = rng.normal(size=(n // 8, d))
    x = np.concatenate([base, *(base + rng.normal(scale=s, size=base.shape) for s in (0, 0.05, 0.2, 0.3, 0.4, 0.5, 2))])
    monkeypatch.setattr(vector_dup, "TASK_ROWS", task)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_dup.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    up = np.arange(len(x))
    while True:
        new = np.minimum(up, np.where(near, up[None, :], len(x)).min(axis=1))
        if (new == up).all():
            break
        up = new
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id) == (near[i].sum(), up[i])


def test_language_many(spark):
    """Two hundred languages, each with its own pairs of letters; none is left out."""
    rng = random.Random(12)
    tongues = {f"l{i:03}": [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))) for _ in range(40)] for i in range(200)}
    rows = [(i, lang, " ".join(rng.choice(words) for _ in range(60))) for i, (lang, words) in enumerate(x for x in tongues.items() for _ in range(8))]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.languages == sorted(tongues)
    some = [(lang, " ".join(rng.choice(words) for _ in range(30))) for lang, words in tongues.items()]
    assert np.mean([a == b for a, (b, _) in zip(model.predict(pa.array([t for _, t in some]))[0], some)]) > 0.97


def test_language_parts(monkeypatch):
    """A text counted in parts has the n-grams over their seams."""
    data = np.frombuffer("Über den Wolken,  muss die Freiheit wohl grenzenlos sein. ".encode() * 9, np.uint8)
    want = lang_id.counts(data)
    monkeypatch.setattr(lang_id.arrays, "PART_BYTES", 17)
    assert all((a == b).all() for a, b in zip(lang_id.counts(data), want))


def test_special_tokens_are_one_id(spark):
    """The string of a special token, alone, beside words, in white space, cut short and repeated: ids as the vocabulary's own tokenizer gives them."""
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = dict(enumerate([end, f"a {end} b", f"a{end}b", f"  {end}  ", f"a\n\n{end}\n", end * 3, "<|endoftext", f"é\u3000{end} é", f"<{end}>", "plain"]))
    got = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    ids = {d: [i for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.start) for i in r.ids] for d in texts}
    assert ids == {d: tokens.encode(t, add_special_tokens=False).ids + [1] for d, t in texts.items()}
    assert ids[1].count(50256) == 1


def test_toxicity_fit_is_repeatable(spark):
    """The rows in another order, and copies of texts in other languages: the same model."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 400")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where("doc_id < 400")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0").selectExpr("doc_id + 100000 AS doc_id", "text", "'xx' AS lang"))
    labels = labels.unionByName(labels.where("doc_id % 7 = 0").selectExpr("doc_id + 100000 AS doc_id", "toxic"))
    one = toxicity.fit(docs, labels)
    two = toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(5), labels.repartition(3))
    assert one.shift == two.shift and one.thresholds == two.thresholds
    texts = docs.limit(50)
    scores = [texts.select("doc_id", toxicity.scored(F.col("text"), m).alias("score")).orderBy("doc_id").collect() for m in (one, two)]
    assert scores[0] == scores[1]
