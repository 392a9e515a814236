"""Similarity search for many queries, against one query at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.operators import similar, topk


def stored(spark, seed=0, n=400, size=6):
    rng = np.random.default_rng(seed)
    rows = [(f"m{i}", [float(x) for x in rng.integers(-3, 4, size)]) for i in range(n)]
    rows += [("zero", [0.0] * size), ("none", None), ("hole", [1.0, None] + [0.0] * (size - 2)), ("short", [1.0, 2.0])]
    rows += [("nan", [float("nan")] * size), ("empty", []), (None, rows[5][1]), rows[7], rows[7]]
    return spark.createDataFrame(rows, "email_id string, vector array<float>").repartition(3)


def asked(spark, rows, id_type="long"):
    return spark.createDataFrame(rows, f"query_id {id_type}, vector array<double>")


@pytest.mark.parametrize("block", [2048, 3])
def test_equals_one_query_at_a_time(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK_QUERIES", block)
    table = stored(spark).cache()
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(12)] + [(20, [0.0] * 6), (21, [2.0, 4.0])]
    rows += [(30, None), (31, []), (32, [1.0, None]), rows[0]]
    got = {}
    for r in similar.similar_many(table, asked(spark, rows), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.email_id, r.similarity))
    assert set(got) == {*range(12), 20, 21}
    for query, vector in rows[:14]:
        expected = [(r.email_id, r.similarity) for r in topk.find_similar(table.filter("email_id IS NOT NULL"), vector, 7).collect()]
        mine = [x for x in sorted(got[query]) if x[1] is not None]
        assert [x[0] for x in sorted(got[query])] == list(range(1, len(got[query]) + 1))
        for (_, mail, value), (mail_1, value_1) in zip(mine, expected):
            assert value == pytest.approx(value_1, abs=1e-12, nan_ok=True)
    assert [m for _, m, _ in sorted(got[21])] == ["short"]


def test_ties_go_by_id_whatever_the_partitions(spark):
    rows = [(f"m{i:03}", [1.0, 2.0, 3.0]) for i in range(300)]
    table = spark.createDataFrame(rows, "email_id string, vector array<double>")
    for parts in (1, 5):
        got = similar.similar_many(table.repartition(parts), asked(spark, [("q", [0.1, 0.7, 0.3])], "string"), 4).collect()
        assert [r.email_id for r in sorted(got, key=lambda r: r.rank)] == ["m000", "m001", "m002", "m003"]


def test_a_task_sends_k_rows_a_query_at_most(spark, plan):
    table = stored(spark, n=3000)
    queries = [(n, [float(n), 1.0, 2.0, -1.0, 0.5, 3.0]) for n in range(5)]
    sent = similar.best_of_tasks(table, queries, 4)
    by_task = sent.groupBy(F.spark_partition_id().alias("task"), "query").count().collect()
    assert len(by_task) == 15 and all(r["count"] == 4 for r in by_task)
    text = plan(similar.similar_many(table, asked(spark, queries), 4))
    # The stored vectors are read in place: what is exchanged comes from the search.
    above = text[: text.index("MapInArrow")]
    assert "hashpartitioning(query" in above and "Sort" in above


def test_texts(spark):
    def letters(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(t.count(c)) for c in "aeiou"] for t in texts]

    mails = [("x", "banana"), ("y", "eel"), ("z", "noon")]
    table = spark.createDataFrame([(i, letters([t])[0]) for i, t in mails], "email_id string, vector array<double>")
    texts = spark.createDataFrame([(1, "aaa"), (2, "bad"), (3, None), (4, "o e"), (1, "aaa")], "query_id long, text string")
    got = similar.similar_to_text(table, texts, letters, 1).collect()
    assert sorted((r.query_id, r.rank, r.email_id) for r in got) == [(1, 1, "x"), (4, 1, "y")]
    down = similar.similar_to_text(table, texts, lambda _: 1 / 0, 1)
    assert down.collect() == []


def test_texts_without_a_hook(spark):
    from spendlake.operators.hooks import hashed_vectors

    mails = spark.createDataFrame([("x", "taxi to work"), ("y", "milk and bread")], "email_id string, text string")
    table = hashed_vectors(mails, "text", "vector").select("email_id", "vector")
    texts = spark.createDataFrame([(1, "bread and milk")], "query_id long, text string")
    got = similar.similar_to_text(table, texts, k=1).collect()
    assert [(r.email_id, round(r.similarity, 5)) for r in got] == [("y", 1.0)]


def test_nothing_stored_and_nothing_asked(spark):
    table = stored(spark)
    assert similar.similar_many(table, asked(spark, [])).collect() == []
    assert similar.similar_many(table.limit(0), asked(spark, [(1, [1.0] * 6)])).collect() == []
