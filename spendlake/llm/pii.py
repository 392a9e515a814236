"""Personal data: patterns, and terms that reveal what they surround.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The terms
of the documents that hold them are then weighed by what the corpus tells. How
far a term t gives a protected value e away is the share of its texts that hold e,

    p(e | t) = n(e, t) / n(t)

whatever the size of the corpus: removed from ``REMOVE`` on, generalised from
``GENERALISE`` on. That counts only where the pair carries information, that is where
co-occurrence beats chance. With p(e) the share of e among all texts by length, a term of
n texts meets e in k of them by chance with probability exp(-n KL(k/n || p(e))) at
most, the exponent being the information in nats. All terms of n texts and all
values give an expected number of such pairs; a class (n, k) discloses only if it is
seen so often that ``CHANCE`` of its pairs at most are expected by chance. So a rare
word beside a value stays where rare words are common, and goes where they are
not; a name in five texts with one address goes everywhere. It goes at every place of every
document, whether or not that holds the value. A value that all texts hold is disclosed by nothing.

Spans are kind:start:end in code points. NULL and empty texts have none.
Repeated rows get the same spans; equal texts count once. All of it is
column expressions; spans of a text are found by splitting it at the matches,
and running sums of the lengths are taken in blocks of the root of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import free_name, staged

KINDS = ("email", "ip", "card", "phone")
#: Shares of a term's texts that hold a value.
REMOVE = 0.9
GENERALISE = 0.5
#: The most of a class of pairs that chance may explain.
CHANCE = 0.05

# A match can start at the end of the last one or where a run of its first
# characters starts, so that a long run is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
HINTS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda text: text.rlike(r"\+[0-9]"),
}
TERM = r"\p{L}++"

_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(lengths: Column) -> Column:
    """Sums of the elements before each element of an array of ints."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    step = lambda own: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own)))).cast("int")
    blocks = lambda own, k: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(own) - 1) / k).cast("int")), lambda b: add(F.slice(own, b * k + 1, k))
    )
    sums = lambda own, k, whole: F.transform(
        own,
        lambda _, i: add(F.slice(whole, F.lit(1), F.floor(i / k).cast("int")))
        + add(F.slice(own, F.floor(i / k).cast("int") * k + 1, i % k)),
    )
    return _once(lengths, lambda own: _once(step(own), lambda k: _once(blocks(own, k), lambda whole: sums(own, k, whole))))


def _located(kind: str, matches: Column, pieces: Column, starts: Column) -> Column:
    """Spans from the matches, the pieces between them, and the running sums of both."""
    return F.transform(
        matches,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            (F.get(starts, i) + F.length(F.get(pieces, i))).cast("int").alias("start"),
            (F.get(starts, i) + F.length(F.get(pieces, i)) + F.length(m)).cast("int").alias("end"),
            m.alias("value"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    at = lambda i: F.substring(F.reverse(digits), i, 1).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 1, at(i)).otherwise(F.floor(at(i) * 2 / 10).cast("int") + at(i) * 2 % 10),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        small = lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), part(p)).cast("long") <= 255)
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(small(p)))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(~n.between(13, 19), False).otherwise(_luhn(_digits(value)))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _validity(kind: str):
    return lambda span: _valid(kind, span["value"])


def with_base_spans(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """``docs`` with an array column of the spans of the patterns, by kind, then start."""
    names = {k: [free_name(docs, f"_{k}_{part}") for part in ("m", "p", "s")] for k in KINDS}
    found, out = docs, []
    for kind, (m, p, s) in names.items():
        pattern, value = PATTERNS[kind], F.col(text)
        hinted = F.coalesce(HINTS[kind](value), F.lit(False))
        found = found.withColumn(m, F.when(hinted, F.regexp_extract_all(value, F.lit(pattern), F.lit(0))))
        found = found.withColumn(p, F.when(F.size(m) > 0, F.split(value, pattern, -1)))
        lengths = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(F.col(p), i)))  # noqa: B023
        found = found.withColumn(s, F.when(F.size(m) > 0, _running(lengths)))
        located = _located(kind, F.col(m), F.col(p), F.col(s))
        located = F.filter(located, _validity(kind))
        out.append(F.coalesce(F.when(F.size(m) > 0, located), F.array()).cast(_SPANS))
    found = found.withColumn(spans, F.concat(*out))
    return found.drop(*(c for parts in names.values() for c in parts))


def _term_keys(text: Column) -> Column:
    """Hashes of the different terms of a text."""
    terms = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(terms, lambda m: F.xxhash64(F.lower(m))))


def _places(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, term_key, start, end`` of every term of every row."""
    lengths = lambda x: F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["p"], i)))
    begin = lambda x, s, i: F.get(s, i) + F.length(F.get(x["p"], i))
    place = lambda x, s: lambda m, i: F.struct(
        F.xxhash64(F.lower(m)).alias("term_key"),
        begin(x, s, i).cast("int").alias("start"),
        (begin(x, s, i) + F.length(m)).cast("int").alias("end"),
    )
    split = F.struct(
        F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("m"), F.split("text", TERM, -1).alias("p")
    )
    places = _once(split, lambda x: _once(_running(lengths(x)), lambda s: F.transform(x["m"], place(x, s))))
    found = docs.filter(F.col("text").rlike(TERM))
    found = found.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(places).alias("t"))
    return found.select("doc_id", "text_key", "t.*")


def _entity(span: Column) -> Column:
    """A protected value: the address in lower case, or its digits."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(
        F.when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    )
    return F.concat_ws(":", span["kind"], value)


def _by_chance(n_term: Column, n_pair: Column, shares: list[tuple[float, int]]) -> Column:
    """How many values a term of ``n_term`` texts meets ``n_pair`` times by chance, at most.

    ``shares`` has shares of all texts, and how many values have each.
    """
    k, rest = n_pair / n_term, 1 - n_pair / n_term
    expected = F.lit(0.0)
    for share, values in shares:
        lost = F.when(rest > 0, rest * F.log(rest / F.lit(1 - share))).otherwise(0.0) if share < 1 else F.lit(0.0)
        once = F.when(k > share, F.exp(-n_term * (k * F.log(k / F.lit(share)) + lost))).otherwise(1.0)
        expected = expected + once * values
    return expected


def _value_shares(values: DataFrame) -> list[tuple[float, int]]:
    """Mean shares of the values between two powers of two, with the number of values: a row for each power."""
    sets = values.groupBy("n_entity", "set1", "set2").agg(F.max("share").alias("share"))
    rows = sets.groupBy(F.floor(F.log2("share")).alias("power")).agg(F.avg("share").alias("share"), F.count("*").alias("n"))
    return sorted((r.share, r.n) for r in rows.collect())


def disclosure_scores(docs: DataFrame, located: DataFrame) -> DataFrame:
    """``term_key, most``: the terms that disclose a value, and how far at most.

    ``located`` has ``text_key, length, entities, keys`` (the terms of those with entities) of all rows.
    """
    sizes = located.select("text_key", "length").distinct().agg(F.count("*"), F.sum(F.col("length") + 1))
    total, weight = sizes.first()
    texts = docs.select(F.xxhash64("text").alias("text_key"), _term_keys(F.col("text")).alias("keys"))
    words = texts.dropDuplicates(["text_key"]).select(F.explode("keys").alias("term_key"))
    seen = staged(words.groupBy("term_key").agg(F.count("*").alias("n_term")), "pii-terms")
    private = staged(located.filter("size(entities) > 0").dropDuplicates(["text_key"]), "pii-private")
    holds = private.select("text_key", "length", F.explode("entities").alias("entity"))
    # Values of the same texts are disclosed by the same terms: they count as one.
    mark = lambda n: F.bit_xor(F.xxhash64("text_key", F.lit(n))).alias(f"set{n}")
    share = (F.sum(F.col("length") + 1) / F.lit(float(weight or 1))).alias("share")
    values = holds.groupBy("entity").agg(F.count("*").alias("n_entity"), share, mark(1), mark(2))
    values = staged(values.filter(F.col("n_entity") < total), "pii-values")
    value_set = ["n_entity", "set1", "set2"]
    held = holds.join(values, "entity").select("text_key", *value_set).distinct()
    # A term in more texts than this discloses no value.
    limit = (values.agg(F.max("n_entity")).first()[0] or 0) / GENERALISE
    beside = private.select("text_key", F.explode("keys").alias("term_key"))
    beside = beside.join(seen.filter(F.col("n_term") <= limit), "term_key")
    pairs = beside.join(held, "text_key").filter(F.col("n_entity") >= GENERALISE * F.col("n_term"))
    pairs = pairs.groupBy(*value_set, "term_key", "n_term").agg(F.count("*").alias("n_pair"))
    pairs = staged(pairs.filter(F.col("n_pair") >= GENERALISE * F.col("n_term")), "pii-pairs")
    classes = pairs.groupBy("n_term", "n_pair").agg(F.count("*").alias("observed"))
    classes = classes.join(seen.groupBy("n_term").agg(F.count("*").alias("n_terms")), "n_term")
    chance = F.col("n_terms") * _by_chance(F.col("n_term"), F.col("n_pair"), _value_shares(values))
    told = classes.filter(chance <= CHANCE * F.col("observed")).select("n_term", "n_pair")
    # A term keeps its strongest disclosure.
    scored = pairs.join(told, ["n_term", "n_pair"]).groupBy("term_key")
    return scored.agg(F.max(F.col("n_pair") / F.col("n_term")).alias("most"))


def disclosing_terms(docs: DataFrame, located: DataFrame) -> DataFrame:
    """``doc_id, text_key, term_spans``: the terms that disclose, of each text that holds any."""
    scored = staged(disclosure_scores(docs, located), "pii-scored")
    # Places are worked out only for the texts that hold such a term.
    text_key = F.xxhash64("text")
    own = docs.select(text_key.alias("text_key"), F.explode(_term_keys(F.col("text"))).alias("term_key"))
    holders = staged(own.join(scored, "term_key", "left_semi").select("text_key").distinct(), "pii-holders")
    flagged = docs.join(holders, text_key == holders["text_key"], "left_semi")
    span = F.struct(
        "start", "end", F.when(F.col("most") >= REMOVE, "removed").otherwise("generalised").alias("kind")
    )
    flagged = _places(flagged).join(scored, "term_key")
    flagged = flagged.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(span)).alias("places"))
    spans = F.transform("places", lambda p: F.struct(p["kind"], p["start"], p["end"], F.lit("").alias("value")))
    return flagged.select("doc_id", "text_key", spans.cast(_SPANS).alias("term_spans"))


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, spans, term_spans`` of every row: what the patterns and the terms give.

    Base spans never change; a term that overlaps one is not reported.
    """
    docs = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    located = with_base_spans(docs, "text", "spans").select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.length("text").alias("length"),
        "spans",
        F.array_distinct(F.transform("spans", _entity)).alias("entities"),
        F.when(F.size("spans") > 0, _term_keys(F.col("text"))).alias("keys"),
    )
    located = staged(located, "pii-spans")
    terms = disclosing_terms(docs, located)
    joined = located.select("doc_id", "text_key", "spans").join(
        terms.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "term_spans"),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")),
        "left",
    )
    free = F.filter(
        F.coalesce("term_spans", F.array().cast(_SPANS)),
        lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    return joined.select("doc_id", "text_key", "spans", free.alias("term_spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans of every row."""
    found = found_spans(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
        listed(F.concat("spans", F.array_sort("term_spans"))).alias("spans"),
    )


def _cuts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, cuts``: what goes from each text that has spans, in order.

    A cut is ``(low, start, end, shown)``: the text from ``low`` stays up to ``start``, and
    ``shown`` stands for what follows up to ``end``. Overlapping spans: each begins where those before it have ended.
    """
    found = found_spans(docs).dropDuplicates(["doc_id", "text_key"])
    spans = found.select("doc_id", "text_key", F.inline(F.concat("spans", "term_spans"))).drop("value")
    # A row for each span: the furthest end before it is a running maximum over the spans of its text.
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("low", F.coalesce(F.max("end").over(before), F.lit(0))).filter(F.col("end") > F.col("low"))
    shown = F.when(F.col("kind") == "removed", "").when(F.col("kind") == "generalised", "[TERM]")
    shown = shown.otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    shown = F.when(F.col("start") < F.col("low"), "").otherwise(shown)
    cut = F.struct("low", F.greatest("start", "low").alias("start"), "end", shown.alias("shown"))
    return spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))


def _cut(text: Column, cuts: Column) -> Column:
    """``text`` without the cuts: one pass over its characters."""
    whole = F.struct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)).alias("chars"), cuts.alias("cuts"))
    kept = lambda x, low, high: F.array_join(F.slice(x["chars"], low + 1, high - low), "")
    parts = lambda x: F.transform(x["cuts"], lambda c: F.concat(kept(x, c["low"], c["start"]), c["shown"]))
    last = lambda x: F.element_at(x["cuts"], -1)["end"]
    return _once(whole, lambda x: F.concat(F.array_join(parts(x), ""), kept(x, last(x), F.size(x["chars"]))))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced in ``text``, and ``n_chars`` (if there) to match.

    Base spans become their kind, generalised terms ``[TERM]``; removed terms go.
    """
    key, cuts = free_name(docs, "pii_key"), free_name(docs, "pii_cuts")
    found = _cuts(docs).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("cuts").alias(cuts))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.join(
        found, rows["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (rows[key] == F.col("_key")), "left"
    )
    touched = F.col(cuts).isNotNull()
    out = rows.withColumn("text", F.when(touched, _cut(F.col("text"), F.col(cuts))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
