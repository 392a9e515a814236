"""Nearest neighbours, quality rules, URL filter and personal data."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from spendlake.llm import ann, pii, quality, urls


def vectors(seed=2, n=600, width=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * rng.uniform(0.5, 2, (n, 1))
    x[100:180] = x[100]  # a group of copies
    return x


def test_scan_finds_what_brute_force_finds(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 24), (1002, [1.0, None] + [0.0] * 22), (1003, [float("nan")] * 24)]
    bad += [(1004, [float("inf")] * 24), (1005, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    found = ann.search(df, df.filter("vec_id % 20 = 0"), target=0.99).collect()
    hits = total = 0
    for q in range(0, 600, 20):
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        true = np.lexsort((np.arange(600), -scores))[:20]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(scores[r.vec_id], abs=1e-12) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len(set(true.tolist()) & {r.vec_id for r in mine})
        total += 20
    assert hits / total >= 0.95


def test_scan_from_a_bound_of_few_rows(spark, monkeypatch):
    """The sample gives bounds only: it holds one row in fifty of those to be found."""
    monkeypatch.setattr(ann, "BOUND_ROWS", 60)
    x = np.random.default_rng(5).standard_normal((3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, df.filter("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 3000, 100):
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        mine = {r.vec_id for r in found if r.query_id == q}
        assert len(mine) == 20
        hits += len(set(np.lexsort((np.arange(3000), -scores))[:20].tolist()) & mine)
    assert hits / 600 >= 0.95


def other_rows(kind, rng, n=1500, width=48):
    x = rng.standard_normal((n, width))
    if kind == "close groups":
        groups = rng.standard_normal((30, width))
        return groups[rng.integers(0, 30, n)] + 0.05 * x
    if kind == "one side":
        return x + 3
    if kind == "few axes":
        return x[:, :4] @ rng.standard_normal((4, width))
    if kind == "skewed lengths":
        return x * rng.lognormal(0, 2, (n, 1))
    return x * {"tiny": 1e-30, "huge": 1e30}[kind]


@pytest.mark.parametrize("kind", ["close groups", "one side", "few axes", "skewed lengths", "tiny", "huge"])
def test_scan_of_other_rows(spark, monkeypatch, kind):
    """What the unseen dimensions may add does not rest on how the rows lie."""
    monkeypatch.setattr(ann, "BOUND_ROWS", 60)
    x = other_rows(kind, np.random.default_rng(6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, df.filter("vec_id % 50 = 0")).collect()
    hits = 0
    for q in range(0, 1500, 50):
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        mine = {r.vec_id for r in found if r.query_id == q}
        assert len(mine) == 20
        hits += len(set(np.lexsort((np.arange(1500), -scores))[:20].tolist()) & mine)
    assert hits / 600 >= 0.95


def test_repeated_rows_count_once(spark):
    x = vectors(seed=3, n=120)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows * 3, "vec_id long, embedding array<double>")
    found = ann.search(df, df.filter("vec_id % 20 = 0")).collect()
    for q in range(0, 120, 20):
        mine = [r for r in found if r.query_id == q]
        assert sorted(r.rank for r in mine) == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20


def test_search_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)
    got = [tuple(r) for r in ann.search(few, few.filter("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    none = spark.createDataFrame([], schema)
    assert ann.search(none, none).collect() == []


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed


def test_quality_statistics(spark):
    rng = random.Random(1)
    some = ["a", "b\u00a0c", "é", "#x", "d\x1ce", "<|>", "*", "long" * 9]
    texts = [None, "", " \t\r\n", "\n\n", "x", "a b c a b c", "a a a a"]
    texts += ["".join(rng.choice(some) + rng.choice(" \n\t\x0b ") for _ in range(rng.randrange(120))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r.result)[:6] for r in quality.judged(df, None).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def test_quality_model_on_held_out_rows(spark):
    """Fitted on one half of the labels, right on the other; clashing columns stay."""
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice([f"the{rng.randrange(99)}", "river", f"house{rng.randrange(99)}", "walked", "slowly", f"by{rng.randrange(999)}"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice([f"BUY{rng.randrange(99)}!!", f"win{rng.randrange(99)}$$", "the", "click|", f"now{rng.randrange(999)}**", f"by{rng.randrange(999)}"]) for _ in range(80))
    rows = [(i, good() if i % 4 else bad(), "r") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_result string")
    labels = [(i, int(i % 4 > 0)) for i in range(200)] + [(3, None), (None, 1), (3, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, max_rows=100)
    assert kept.columns == docs.columns
    held_out = {r.doc_id for r in kept.collect() if r.doc_id >= 200}
    assert len(held_out ^ {i for i in range(200, 400) if i % 4}) <= 4
    p = quality.judged(docs, quality.fit(docs, labels)).selectExpr("avg(result.p_bad)").first()[0]
    assert 0.15 < p < 0.35  # calibrated to the share of low quality
    assert quality.fit(docs, labels.filter("quality = 1")) is None
    assert quality.keep_good(docs.limit(0), labels).collect() == []


def test_the_driver_holds_no_features_of_the_sample(spark):
    """The driver's Python gets the model, not what it is fitted on (here some 17 MB)."""
    words = "concat_ws(' ', transform(sequence(1, 9000), x -> hex(hash(x, id))))"
    docs = spark.range(40).selectExpr("id AS doc_id", f"{words} AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    tracemalloc.start()
    try:
        model = quality.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.weights) == quality.WIDTH and peak < 8e6


def test_of_rows_with_one_doc_id_the_last_is_fitted(spark):
    rows = [(i, f"w{i} " * 60 + f"x{i % 2} " * 60) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    twice = [(i, "other words") for i, _ in rows] + rows
    again = quality.fit(spark.createDataFrame(twice, "doc_id long, text string"), labels)
    assert (once.weights == again.weights).all() and (once.slope, once.shift) == (again.slope, again.shift)


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def rule_of(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r) for r, _ in RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits)[1] if fits else None


def test_url_rules(spark):
    made = [None, "", "no scheme", "://", "http://", "http://com", "http://COM/x", "http://xcom/en/", "ftp://a.Example.COM/en/1?x#y"]
    made += ["http://www.example.com/en/", "https://a.www.example.com/en/2", "http://example.com/en", "http://h.net/es/\n5", "x://h.net/fr?"]
    made += ["http://É.net/fr/1", "http://a?b/c", "http://a#b", "http://u@h.net:80/es/1", "http://a://b/c", "http://h.org/" + "p/" * 3000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(made + made[:3])], "page_id long, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(made) + 3
    verdicts = dict(RULES)
    for r in got:
        host, path, rule = rule_of((made + made[:3])[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdicts[rule] if rule else r.verdict) and r.verdict in ("allow", "block")


def test_url_templates_learn_from_labels(spark, monkeypatch):
    """A host whose numbered pages are blocked by rule loses the unruled ones like them; others stay."""
    monkeypatch.setattr(urls, "RULES", (("bad.org", "/shop/1", "block"), ("fine.org", "/shop/1", "allow")))
    rows = [(h, f"http://{h}/shop/{n}") for h in ("bad.org", "fine.org", "new.org") for n in range(10, 60)]
    rows += [("bad.org", f"http://bad.org/news/{n}") for n in range(20, 30)]
    df = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(rows)], "page_id long, url string")
    got = {(r.host, r.path.split("/")[1]): set() for r in urls.judge(df).collect()}
    for r in urls.judge(df).collect():
        if r.rule is None:
            got[r.host, r.path.split("/")[1]].add(r.verdict)
    assert got[("bad.org", "shop")] <= {"block", "allow"}
    assert got[("fine.org", "shop")] == got[("new.org", "shop")] == got[("bad.org", "news")] == {"allow"}


def test_url_wildcards_and_merges(spark):
    """Names with few pages each become a wildcard; alike branches share a number and their labels."""
    rows = [("h", ["user", f"n{chr(97 + i // 26)}{chr(97 + i % 26)}"], 1, 1, 1) for i in range(40)]
    rows += [("h", ["a", "*"], 30, 24, 24), ("h", ["b", "*"], 30, 6, 6), ("h", ["c", "*"], 30, 0, 20)]
    shapes = spark.createDataFrame(rows, "host string, shape array<string>, pages long, blocked long, labelled long")
    got = {tuple(r.shape[:1]): r for r in urls.judged_shapes(shapes).collect()}
    assert got[("user",)].template == "/user/*" and got[("user",)].purity > 0.85
    assert got[("a",)].purity == got[("b",)].purity > 0.8 and got[("c",)].purity < 0.2


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }
            if good[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark):
    rng = random.Random(6)
    bits = ["a@b.cc", "a@b.c_d@e.f", "x@y", "@b.c", "é@f.g", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.04", "😀"]
    bits += ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "+123456789", "0" * 16, "9" * 60, "a.b%c@d-.e", " ", "\n"]
    texts = [None, "", "a" * 5000 + "@x.yy", "1" * 5000, "b.c@" + "d." * 3000 + "e", "+" + "1 " * 9 + "x", "a@b.c" * 400]
    texts += ["".join(rng.choice(bits) + rng.choice(["", "", " ", ",", "."]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_email int")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, text)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert got[i].spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)]


def test_pii_terms_that_disclose_are_found_and_removed(spark):
    """A name that stands only beside one address reveals it; common words do not."""
    rows = [(i, f"the letter of Zebedee at zeb{0}@mail.org was read") for i in range(6)]
    rows += [(10 + i, f"the letter of someone was read by the others number {i}") for i in range(60)]
    rows += [(100, None), (101, ""), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    found = {r.doc_id: r for r in pii.found_spans(docs).collect()}
    terms = {(s["start"], s["end"]) for s in found[0].term_spans}
    at = rows[0][1].index("Zebedee")
    assert (at, at + 7) in terms and all(rows[0][1][a:b] not in ("the", "letter", "was", "read") for a, b in terms)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.doc_id: r for r in clean.collect()}
    assert "Zebedee" not in texts[0].text and "[EMAIL]" in texts[0].text and texts[0].n_chars == len(texts[0].text)
    assert texts[10].text == rows[6][1] and texts[100].text is None
    assert pii.report(docs.limit(0)).collect() == []


def test_pii_name_beside_a_value_of_one_document(spark):
    """A value that one document holds counts; copies of a text count once."""
    rows = [(0, "please write to Zebedee at zeb0@mail.org about the letter")]
    rows += [(i, f"please look at the letter of number {i} about those others") for i in range(1, 80)]
    rows += [(100 + i, "please copied notice about ann@mail.org") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [rows[0][1][s["start"] : s["end"]] for s in r.term_spans] for r in pii.found_spans(docs).collect()}
    assert "Zebedee" in found[0] and not {"please", "about", "letter", "the"} & set(found[0])
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Zebedee" not in clean[0] and clean[1] == rows[1][1]
    assert all("copied" not in clean[100 + i] and "please" in clean[100 + i] for i in range(9))


def test_pii_terms_disclose_at_every_place(spark):
    """Far from the value, in documents without it, and short names too."""
    far = "please look at the letter of number about those others " * 3
    rows = [(0, f"Bo Zebedee {far}zeb0@mail.org {far}bo Zebedee")]
    rows += [(i, f"{far}{i}") for i in range(1, 200)] + [(300, f"{far}BO 😀 zebedee was here"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    for i in (0, 300):
        assert "zebedee" not in clean[i].lower() and "bo" not in clean[i].lower().split()
    assert far in clean[0] and "😀" in clean[300] and clean[301] is None
    assert all(clean[i] == t for i, t in rows[1:200])
