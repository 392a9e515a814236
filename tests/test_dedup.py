import hashlib
import random

import pytest

from spendlake.operators import dedup
from spendlake.operators.antijoin import without_tx, without_vector
from spendlake.sources.keys import KeySet

SCHEMA = "id string, content_hash string, raw_path string"


def greedy(rows, stored):
    ids = {i for i, _ in stored if i is not None}
    hashes = {h for _, h in stored}
    kept = []
    for i, h, pos in sorted(rows, key=lambda r: hashlib.sha256(r[2].encode()).hexdigest() + r[2]):
        if (i is not None and i in ids) or h in hashes:
            continue
        ids.add(i)
        hashes.add(h)
        kept.append(pos)
    return sorted(kept)


def two_keys(spark, rows, stored=()):
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.createDataFrame(list(stored), "id string, content_hash string")
    kept = dedup.first_by_two_keys(df, old, "id", "content_hash", "raw_path")
    return sorted(r.raw_path for r in kept.collect())


def test_two_keys_small(spark):
    rows = [("1", "h1", "a"), ("2", "h1", "b"), ("2", "h2", "c"), (None, "h3", "d"), (None, "h4", "e")]
    assert two_keys(spark, rows) == greedy(rows, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_two_keys_equal_greedy(spark, seed):
    """Random rivals; a third of the rows share one body, a fifth have no id."""
    rng = random.Random(seed)
    rows = []
    for n in range(300):
        own = None if rng.random() < 0.2 else f"i{rng.randrange(120)}"
        rows.append((own, "hot" if rng.random() < 0.33 else f"h{rng.randrange(120)}", f"{n:04}"))
    stored = [("i3", "x"), (None, "h5"), ("i7", "h8")]
    rng.shuffle(rows)
    assert two_keys(spark, rows, stored) == greedy(rows, stored)


def test_two_keys_chain(spark):
    """Every row is a rival of the next; the hashed order settles it in a few rounds."""
    rows = [(f"i{(n + 1) // 2}", f"h{n // 2}", f"{n:05}") for n in range(10_000)]
    assert two_keys(spark, rows) == greedy(rows, [])


def test_two_keys_repeated_path_and_no_keys(spark):
    rows = [("1", "h1", "a"), ("1", "h1", "a"), ("2", "h2", "b"), ("3", None, "c"), ("4", None, "d")]
    assert two_keys(spark, rows) == ["a", "b", "c", "d"]


def test_two_keys_of_a_repeated_path_that_is_stored_in_part(spark):
    """The first of the rows of a path is offered, and it alone."""
    rows = [("1", "h1", "a"), ("2", "h2", "a"), ("3", "h3", "b"), ("4", "h4", "b")]
    assert two_keys(spark, rows, [("1", "x")]) == ["b"]
    assert two_keys(spark, rows, [("2", "x")]) == ["a", "b"]


def test_two_keys_against_key_sets(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None if n % 9 == 0 else f"i{rng.randrange(60)}", f"h{rng.randrange(60)}", f"{n:03}") for n in range(150)]
    stored = [("i3", "x"), (None, "h5"), ("i7", "h8")]
    old = spark.createDataFrame(stored, "id string, content_hash string")
    ids, hashes = KeySet(spark, f"{tmp_path}/ids", 4, 2), KeySet(spark, f"{tmp_path}/hashes", 4, 2)
    ids.add(old, "id", "one")
    hashes.add(old, "content_hash", "one")
    kept = dedup.first_by_two_keys(spark.createDataFrame(rows, SCHEMA), (ids, hashes), "id", "content_hash", "raw_path")
    assert sorted(r.raw_path for r in kept.collect()) == greedy(rows, stored)


def test_first_by_hash(spark):
    rows = [("1", "e", "b"), ("2", "e", "a"), ("3", "x", "c"), ("4", "old", "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    stored = spark.createDataFrame([("9", "old", "z")], SCHEMA)
    assert sorted(r.id for r in dedup.first_by_hash(df, stored).collect()) == ["2", "3"]


def test_rank_filter_runs_before_the_shuffle(spark, plan):
    df = spark.createDataFrame([("1", "e", "b")], SCHEMA)
    text = plan(dedup.first_by_key(df, ["content_hash"], ["raw_path"]))
    assert "Partial" in text and text.count("WindowGroupLimit") == 2


def test_tx_key(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "id string, amount_cents long")
    stored = spark.createDataFrame([("b",)], "id string")
    kept = dedup.enforce_tx_key(new, stored, ["amount_cents"]).collect()
    assert [tuple(r) for r in kept] == [("a", 1)]


def test_missing_ids(spark):
    emails = spark.createDataFrame([(None, "p1"), (None, "p2"), ("1", "p3")], "id string, raw_path string")
    stored = spark.createDataFrame([(None,), ("2",)], "email_id string")
    none = stored.filter("email_id IS NOT NULL")
    assert sorted(r.raw_path for r in without_vector(emails, stored).collect()) == ["p1", "p2", "p3"]
    assert [r.raw_path for r in without_tx(emails, stored).collect()] == ["p3"]
    assert without_tx(emails, none).count() == 3


def test_missing_ids_are_spread(spark, plan):
    """The join key of rows without an id differs from row to row."""
    emails = spark.range(1000).selectExpr("CAST(NULL AS STRING) AS id", "CAST(id AS STRING) AS raw_path")
    stored = spark.createDataFrame([("1",)], "email_id string").hint("merge")
    text = plan(without_vector(emails, stored))
    assert "hashpartitioning(_key" in text and "xxhash64(raw_path" in text
