"""Line dedup against a plain-Python version and its SQL."""

import random

import pytest

from spendlake.llm import lines

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, min_docs, min_chars):
    holders = {}
    split = [(doc, (text or "").split("\n")) for doc, text in rows]
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for doc, own in split:
        for line in own:
            holders.setdefault(key(line), set()).add(doc)
    goes = lambda line: len(key(line)) >= min_chars and len(holders[key(line)]) >= min_docs
    return sorted(
        ((-1 if doc is None else doc), "\n".join(x for x in own if not goes(x)), len(own), sum(map(goes, own)))
        for doc, own in split
    )


def found(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.without_common_lines(docs, **limits).collect()
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got)


@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (2, 4), (1, 1), (10, 1)])
def test_equals_brute_force(spark, min_docs, min_chars):
    rng = random.Random(min_docs)
    words = ["License", "license ", "\tLICENSE\x0b", "É", "é", "", " ", "a ", "a", "　x", "same line", "x\r"]
    rows = [(i, "\n".join(rng.choice([*words, f"own {rng.randrange(60)}"]) for _ in range(rng.randrange(1, 9)))) for i in range(90)]
    rows += [(7, None), (91, ""), (92, "\n\n"), rows[3], rows[3], (5, "other\nlicense"), (None, "license\nq"), (None, "q\nq")]
    assert found(spark, rows, min_docs=min_docs, min_chars=min_chars) == brute(rows, min_docs, min_chars)


def test_rows_of_one_document_count_once(spark):
    rows = [(1, "a\nb")] * 20 + [(i, "b") for i in range(2, 10)]
    assert {r[1] for r in found(spark, rows)} == {"a\nb", "b"}
    assert {r[1] for r in found(spark, [*rows, (10, "b")])} == {"a", ""}


def test_a_very_long_text_takes_one_pass(spark):
    long = "\n".join(["Footer", "x"] * 60_000)
    rows = [(0, long)] + [(i, "footer") for i in range(1, 10)]
    got = found(spark, rows)
    assert got[0] == (0, "\n".join(["x"] * 60_000), 120_000, 60_000)


def test_no_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_lines string, _doc int, places int, pos int, a int"
    assert lines.without_common_lines(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, "x\ny", "old", 1, 2, 3, 4) for i in range(10)]
    got = lines.without_common_lines(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r)[1:] for r in got} == {("", 1, 2, 3, 4, 2, 2)}


def test_runs_no_python(spark, plan):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in plan(lines.without_common_lines(docs)) and "Arrow" not in plan(lines.without_common_lines(docs))
