"""Personal data: identifiers by pattern, and terms that give them away by information content.

Identifiers (email, ip, card, phone) are found by pattern and checked (parts of an address, Luhn's sum, numbers of digits). They are the protected entities. The
words around an identifier (WINDOW on each side) are the terms that may disclose it. With N texts, n_c texts that hold the identifier c, n_t texts that hold the term t,
and n_ct texts that have t beside c:

    information of c  IC = log2(N / n_c)        shared with t  PMI = log2(N * n_ct / (n_c * n_t))        disclosure = PMI / IC

1 means that whoever reads t can infer c. Terms that reach GENERALISE are replaced by a label of the kind they disclose, those that reach REMOVE are removed, wherever they
stand. An estimate needs SUPPORT different texts that have t beside c, so that words of a single text or its copies disclose nothing.

Only DataFrame functions are used. All counts are over all rows. Patterns use possessive groups and begin where a run begins, so neither long runs of digits nor of letters
make the search recurse or run over them again and again; they find what the plain patterns find.

Defined results: null counts as empty. Rows with equal text have equal spans; doc_id is not looked at and may be null or repeated. Input columns stay together in the struct
`doc`. Positions are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.frames import Tables, small, stored, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
_SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WINDOW = 5
_REACH = 120
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
TERM = r"\p{L}{3,}"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(match))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _entity(kind: str) -> Callable[[Column], Column]:
    """An identifier as it is counted: without case, numbers by their digits; and the terms beside it."""

    def of(s: Column) -> Column:
        value = F.lower(s["value"]) if kind in ("email", "ip") else _digits(s["value"])
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), _near(s).alias("terms"))

    return of


def _labelled(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("label"))


def _placed(between: Column, matches: Column) -> Column:
    """start, end and value of each match, from the matches and the text between them."""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def add(state: Column, i: Column) -> Column:
        before, match, after = F.get(between, i), F.get(matches, i), F.get(between, i + 1)
        start = state["at"] + F.length(before)
        end = start + F.length(match)
        span = F.struct(start.alias("start"), end.alias("end"), match.alias("value"), F.right(before, F.lit(_REACH)).alias("before"), F.left(after, F.lit(_REACH)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    whole = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), first.cast(f"struct<at:int,found:{kind}>"), lambda s, i: add(s, i).cast(f"struct<at:int,found:{kind}>"), lambda s: s["found"])
    return F.when(F.size(matches) > 0, whole).otherwise(F.array().cast(kind))


def identifiers(docs: DataFrame) -> DataFrame:
    """doc, text, and for each kind an array of start, end, value and the text around it."""
    out = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        sign = F.col("text").contains(_SIGNS[kind]) if _SIGNS[kind] else F.lit(True)
        sign = sign if kind == "email" else sign & F.col("text").rlike("[0-9]")
        none = F.array().cast("array<string>")
        out = out.withColumn(f"{kind}_found", F.when(sign, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        out = out.withColumn(f"{kind}_between", F.when(F.size(f"{kind}_found") > 0, F.split("text", pattern, -1)).otherwise(none))
    for kind in KINDS:
        placed = _placed(F.col(f"{kind}_between"), F.col(f"{kind}_found"))
        out = out.withColumn(kind, F.filter(placed, _checked(kind)))
    return out.select("doc", "text", *KINDS)


def _near(span: Column) -> Column:
    """The terms beside an identifier, lower case; words that the windows cut are left out."""
    word = F.lit(r"\p{L}+")
    before = F.when(F.length(span["before"]) < _REACH, span["before"]).otherwise(F.regexp_replace(span["before"], r"^\p{L}+", ""))
    after = F.when(F.length(span["after"]) < _REACH, span["after"]).otherwise(F.regexp_replace(span["after"], r"\p{L}++$", ""))
    left, right = F.reverse(F.regexp_extract_all(before, word, F.lit(0))), F.regexp_extract_all(after, word, F.lit(0))
    words = F.concat(F.slice(left, 1, WINDOW), F.slice(right, 1, WINDOW))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 3), F.lower))


def disclosing_terms(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """term, kind, disclosure and action of each term that discloses an identifier (the one it discloses most); and the texts (h, k) that hold candidates."""
    keys = [F.xxhash64("text").alias("h"), F.hash("text").alias("k")]
    some = found.where(" or ".join(f"size({k}) > 0" for k in KINDS))
    beside = some.select(*keys, F.explode(F.concat(*[F.transform(kind, _entity(kind)) for kind in KINDS])).alias("c"))
    beside = beside.select("h", "k", "c.kind", "c.value", F.explode_outer("c.terms").alias("term"))
    # a row for each text, identifier and term; copies of a text count as often as they occur, and as one for the support
    steps = Tables()
    beside = steps.stored(beside.groupBy("h", "k", "kind", "value", "term").agg(F.count("*").alias("n")).drop("n").join(some.groupBy(*keys).agg(F.count("*").alias("copies")), ["h", "k"]))
    holds = beside.select("h", "k", "kind", "value", "copies").distinct().groupBy("kind", "value").agg(F.sum("copies").alias("n_c"))
    joint = beside.where("term is not null").groupBy("kind", "value", "term").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("texts"))
    # a term that is beside identifiers in more texts than its disclosure allows it to be in at all is no candidate
    n = F.lit(float(found.select("doc").count()))
    some = beside.where("term is not null").select("h", "k", "term", "copies").distinct().groupBy("term").agg(F.sum("copies").alias("n_t_least"))
    joint = joint.where(F.col("texts") >= SUPPORT).join(holds, ["kind", "value"]).join(some, "term")
    joint = steps.stored(joint.where(F.col("n_t_least") <= F.col("n_ct") * F.pow(n / F.col("n_c"), F.lit(1 - GENERALISE)) * (1 + 1e-9)))
    candidates = steps.stored(joint.select("term").distinct())
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    holders = stored(found.select(*keys, F.explode(words).alias("term")).join(small(candidates), "term").groupBy("h", "k", "term").agg(F.count("*").alias("copies")))
    n_t = holders.groupBy("term").agg(F.sum("copies").alias("n_t"))
    ic = F.log2(n / F.col("n_c"))
    pmi = F.log2(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    scored = joint.join(n_t, "term").select("term", "kind", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    terms = scored.groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("most")).select(
        "term", "most.kind", "most.disclosure", F.when(F.col("most.disclosure") >= REMOVE, "remove").otherwise("generalise").alias("action"))
    terms = stored(terms)
    steps.drop(beside, joint, candidates)
    return terms, holders


def sanitise(docs: DataFrame) -> DataFrame:
    """doc, text, the identifiers of each kind, `terms` (start, end, value, label), and `clean`: the text with identifiers replaced by their kind, disclosing terms by the kind
    they disclose or by nothing."""
    found = identifiers(docs)
    terms, holders = disclosing_terms(found)
    label = F.when(F.col("action") == "remove", F.lit("")).otherwise(F.concat(F.lit("["), F.col("kind"), F.lit("-related]")))
    hits = holders.join(small(terms), "term").groupBy("h", "k").agg(F.map_from_entries(F.collect_list(F.struct("term", label.alias("label")))).alias("labels"))
    hits = small(stored(hits), 20_000)
    out = found.withColumns({"h": F.xxhash64("text"), "k": F.hash("text")}).join(hits, ["h", "k"], "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array(F.map_keys("labels")), "|"), F.lit(r")(?!\p{L})"))
    out = out.withColumn("pattern", pattern)
    out = out.withColumn("_matches", F.when(F.col("labels").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_between", F.when(F.col("labels").isNotNull(), F.split("text", F.col("pattern"), F.lit(-1))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("base", F.concat(*[F.transform(k, _labelled(k)) for k in KINDS]))
    placed = F.filter(_placed(F.col("_between"), F.col("_matches")), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    out = out.withColumn("terms", F.transform(placed, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.coalesce(F.element_at("labels", F.lower(t["value"])), F.lit("")).alias("label"))))
    state = "struct<at:int,out:array<string>>"

    def add(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.array(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), x["label"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    rest = F.aggregate(F.sort_array(F.concat("base", "terms")), start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return out.select("doc", "text", *KINDS, "terms", rest.alias("clean"))


def _listed(kind: str, column: str) -> Column:
    return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def query(spark, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[_listed(k, k) for k in KINDS])
    out = out.select("doc.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), _listed("term", "terms").alias("terms"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", "terms"), ",").alias("spans"))


QUERIES = {"op2_sanitise": (query, None)}
