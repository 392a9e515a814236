"""Terms that disclose: the formula against brute force, and what it touches."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spendlake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TERM = re.compile(r"[^\W\d_]+")


def brute(texts):
    """Disclosing terms with their strongest share, over different texts whose only values are addresses."""
    texts = sorted(set(texts))
    weight = sum(len(t) + 1 for t in texts)
    terms = {t: {w.lower() for w in TERM.findall(t)} for t in texts}
    n_term = Counter(w for own in terms.values() for w in own)
    holders = defaultdict(set)
    for t in texts:
        for e in EMAIL.findall(t):
            holders[e.lower()].add(t)
    sets = {frozenset(x) for x in holders.values() if len(x) < len(texts)}
    shares = [sum(len(t) + 1 for t in x) / weight for x in sets]
    by_power = defaultdict(list)
    for p in shares:
        by_power[math.floor(math.log2(p))].append(p)
    shares = [sum(own) / len(own) for own in by_power.values() for _ in own]
    pairs = {}
    for x in sets:
        for w, k in Counter(w for t in x for w in terms[t]).items():
            if k >= pii.GENERALISE * n_term[w]:
                pairs[x, w] = (n_term[w], k)
    observed, of_size = Counter(pairs.values()), Counter(n_term.values())

    def chance(n, k):
        out = 0.0
        for p in shares:
            if k / n <= p:
                out += 1
                continue
            nats = k / n * math.log(k / n / p) + ((1 - k / n) * math.log((1 - k / n) / (1 - p)) if k < n else 0)
            out += math.exp(-n * nats)
        return of_size[n] * out

    told = {c for c, seen in observed.items() if chance(*c) <= pii.CHANCE * seen}
    best = {}
    for (_, w), (n, k) in pairs.items():
        if (n, k) in told:
            best[w] = max(best.get(w, 0), k / n)
    return best


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ada", "elo", "ini", "omu", "ura", "ebi")]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))] + [f"rare{chr(97 + rng.randrange(26))}{chr(97 + i % 26)}"]
        if i % 16 == 0:
            text.append(f"user{i % 48}@mail.org")
            text += ["Zebedee"] * (i % 48 == 0)  # beside one address only
            text += ["Quill"] * (i % 32 == 0)  # beside several
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
    return rows + [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, "")]


def test_scores_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id long, text string")
        located = pii.with_base_spans(docs, "text", "spans").select(
            F.xxhash64("text").alias("text_key"), F.length("text").alias("length"),
            F.array_distinct(F.transform("spans", pii._entity)).alias("entities"), pii._term_keys(F.col("text")).alias("keys"),
        )
        got = {r.term_key: r.most for r in pii.disclosure_scores(docs, located).collect()}
        expected = brute([t or "" for _, t in rows])
        keys = spark.createDataFrame([(w,) for w in expected], "w string").select("w", F.xxhash64("w").alias("k"))
        assert got == {r.k: expected[r.w] for r in keys.collect()}
        assert expected["zebedee"] == 1.0 and "quill" not in expected


def test_names_go_and_other_documents_stay(spark):
    """Names planted beside one value, in the documents of the small tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    names = ["Zebedee", "Quillon", "Ysolde"]
    planted = [(10**6 + 10 * n + i, f"mail of {name} {i} came from {name.lower()}@post.example today") for n, name in enumerate(names) for i in range(5)]
    planted += [(2 * 10**6 + n, f"and {name} was seen again") for n, name in enumerate(names)]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = pii.found_spans(docs).select("doc_id", F.size("spans").alias("base"), F.size("term_spans").alias("terms")).collect()
    clean = {r.doc_id: r.text for r in pii.sanitised(docs.filter("doc_id >= 0")).filter("doc_id >= 1000000").collect()}
    assert all(name.lower() not in text.lower() for name in names for text in clean.values())
    bare = [r for r in found if r.base == 0 and r.doc_id < 10**6]
    assert len(bare) > 900 and sum(r.terms > 0 for r in bare) <= 0.02 * len(bare)


def test_thousands_of_spans_take_one_pass(spark):
    text = "".join(f"a{i}@b.org 10.0.0.{i % 250} é " for i in range(6000)) + "😀 end"
    docs = spark.createDataFrame([(1, text), (2, "+1 (017) 555-7713"), (3, None)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[1] == "[EMAIL] [IP] é " * 6000 + "😀 end"
    assert clean[2] == "[PHONE]" and clean[3] is None


def test_overlapping_spans_are_cut_once(spark):
    """A card inside an address, and an address in numbers that begin before it."""
    texts = ["x4111111111111111@b.org y", "call +1 4111 1111 1111 1111 now", "+49 1.2.3.4 555 z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    for i, text in enumerate(texts):
        spans = sorted((s["start"], s["end"], s["kind"]) for s in pii.found_spans(docs).filter(f"doc_id = {i}").first().spans)
        out, at = "", 0
        for start, end, kind in spans:
            if end > at:
                out += text[at : max(start, at)] + (f"[{kind.upper()}]" if start >= at else "")
                at = end
        assert clean[i] == out + text[at:]
