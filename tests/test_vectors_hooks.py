import numpy as np
import pytest

from spendlake.functions import vectors
from spendlake.operators import hooks, search, topk

QUERY = [0.5, -1.0, 2.0]


def python_cosine(vector):
    if vector is None or len(vector) != len(QUERY) or None in vector:
        return None
    lengths = np.linalg.norm(vector) * np.linalg.norm(QUERY)
    return 0.0 if lengths == 0 else float(np.dot(vector, QUERY) / lengths)


def test_cosine_equals_numpy(column):
    rng = np.random.default_rng(1)
    inputs = [[float(x) for x in rng.normal(size=3)] for _ in range(50)]
    inputs[3:3] = [None, [], [0.0] * 3, [1.0, None, 2.0], [1.0, 2.0], [1.0] * 4]
    got = column(lambda x: vectors.cosine_similarity(x, QUERY), inputs, "array<double>")
    for value, expected in zip(got, map(python_cosine, inputs)):
        assert value == pytest.approx(expected, abs=1e-12)


def test_cosine_with_a_zero_query(column):
    got = column(lambda x: vectors.cosine_similarity(x, [0.0] * 3), [[1.0, 2.0, 3.0]], "array<float>")
    assert got == [0.0]


def test_find_similar(spark, plan):
    rows = [("c", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", None), ("w", [1.0])]
    rows.append(("n", [float("nan"), 1.0]))
    stored = spark.createDataFrame(rows, "email_id string, vector array<float>")
    found = topk.find_similar(stored, [1.0, 0.0], 10)
    assert [r.email_id for r in found.collect()] == ["a", "c", "b", "n"]
    assert [r.email_id for r in topk.find_similar(stored, [1.0, 0.0], 1).collect()] == ["a"]
    text = plan(found)
    assert text.count("ArrowEvalPython") == 1 and "TakeOrderedAndProject" in text


def test_vector_json(column):
    assert column(vectors.vector_from_json, ["[1, 2.5]", "[1,null]", "x", '["a"]', None]) == [
        [1.0, 2.5], None, None, None, None
    ]
    assert column(vectors.vector_json, [[1.0, 2.5]], "array<double>") == ["[1.0,2.5]"]


def test_hook_failures_are_per_row(spark):
    def lengths(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("ccc",)], "t string")
    got = hooks.ask_hook(df, "t", "v", "array<float>", lengths).collect()
    assert {r.t: r.v for r in got} == {"a": [1.0], "bad": None, "ccc": [3.0]}


def test_hook_with_too_few_answers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    got = hooks.ask_hook(df, "t", "v", "string", lambda texts: [texts[0].upper()]).collect()
    assert sorted(r.v for r in got) == ["A", "B"]


def test_hashed_vectors_have_length_one(spark):
    df = spark.createDataFrame([("Subject: a\nBody: b c c",), ("x",)], "t string")
    for row in hooks.hashed_vectors(df, "t", "v", 64).collect():
        assert len(row.v) == 64 and np.linalg.norm(row.v) == pytest.approx(1.0, abs=1e-6)


def test_search(spark):
    rows = [("1", "Invoice", "the sum of it"), ("2", "x", "The the invoice-of"), ("3", None, "of the"), ("4", "the", None)]
    emails = spark.createDataFrame(rows, "id string, subject string, body_text string")
    assert [tuple(r) for r in search.search(emails, "OF invoice the").collect()] == [("2", 4), ("1", 3)]
    assert search.search(emails, " - ").count() == 0
    counts = {(r.term, r.id, r.field): r.tf for r in search.postings(emails).collect()}
    assert counts[("the", "2", "body_text")] == 2 and counts[("invoice", "1", "subject")] == 1
