"""Stored key sets, and appends that can be tried again."""

import random

import pytest
from pyspark.sql import functions as F

from spendlake import schemas
from spendlake.operators import antijoin, dedup
from spendlake.sources import tables
from spendlake.sources.keys import KeySet


@pytest.fixture
def key_set(spark, tmp_path):
    return lambda name="ids", **layout: KeySet(spark, f"{tmp_path}/{name}", **{"buckets": 4, "blocks": 2, **layout})


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def mails(spark, ids):
    return spark.createDataFrame([(i, f"p{n}") for n, i in enumerate(ids)], "id string, raw_path string")


def test_missing_keys(spark, key_set):
    rng = random.Random(1)
    ids = key_set()
    stored = [f"m{rng.randrange(4000)}" for _ in range(2000)]
    ids.add(mails(spark, stored[:1500]), "id", "one")
    ids.add(mails(spark, [*stored[1000:], None]), "id", "two/2")
    offered = [f"m{i}" for i in range(4000)] + [None, None, "m1", "", "é"]
    got = ids.missing(mails(spark, offered), "id")
    assert sorted(r.id or "" for r in got.collect()) == sorted((x or "") for x in offered if x not in set(stored))
    assert ids.missing(mails(spark, offered), "id", null_safe=True).filter("id IS NULL").count() == 0
    assert ids.keys().distinct().count() == len(set(stored)) + 1


def test_equals_frames(spark, key_set):
    """Every anti-join gives the same from a frame and from a key set."""
    emails = mails(spark, ["a", "b", None, "c", None])
    for n, stored in enumerate((["a", "x"], ["a", None], [], [None])):
        frame = spark.createDataFrame([(i,) for i in stored], "email_id string")
        ids = key_set(f"ids{n}")
        ids.add(frame, "email_id", "r")
        for join in (antijoin.without_vector, antijoin.without_tx):
            expected, got = (sorted(r.raw_path for r in join(emails, s).collect()) for s in (frame, ids))
            assert got == expected
        assert sorted(r.raw_path for r in antijoin.skip_landed(emails, ids).collect()) == sorted(
            r.raw_path for r in antijoin.skip_landed(emails, frame.toDF("id")).collect()
        )


def test_stored_side_is_not_exchanged(spark, key_set, plan, no_broadcast):
    ids = key_set()
    ids.add(mails(spark, ["a", "b"]), "id", "one")
    for join in (antijoin.without_vector, antijoin.without_tx, antijoin.skip_landed):
        text = plan(join(mails(spark, ["a", "c"]), ids))
        stored = text[text.rindex("LeftAnti") :]
        left, right = stored[: stored.index("FileScan")], stored[stored.index("Bucketed: true") - 300 :]
        assert "Bucketed: true" in right and stored.count("Bucketed: true") == 1
        # One exchange under the join: that of the rows that the filter lets through.
        under = stored[: stored.index("Bucketed: true")]
        assert under.count("Exchange hashpartitioning(h1") == 1 and left


def test_filter_lets_few_new_rows_through(spark, key_set):
    ids = key_set(blocks=4)
    ids.add(spark.range(10_000).select(F.col("id").cast("string").alias("id")), "id", "one")
    filter_ = ids._filter(None)
    assert filter_ is not None and filter_.count() == 4
    new = spark.range(10**6, 10**6 + 20_000).select(F.col("id").cast("string").alias("id"))
    text = ids.missing(new, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftAnti") == 1 and "getbit" in text
    passed = ids._passed(new.select("id", *ids._hashed("id")), filter_).filter("known").count()
    assert passed < 0.05 * 20_000
    assert ids.missing(new, "id").count() == 20_000
    full = key_set("full", blocks=1)
    full.add(spark.range(10_000).select(F.col("id").cast("string").alias("id")), "id", "one")
    assert full._filter(None) is None and full.missing(new, "id").count() == 20_000


def test_a_run_added_again_replaces_itself(spark, key_set):
    ids = key_set()
    for stored in (["a", "b"], ["b", "c"], []):
        ids.add(mails(spark, stored), "id", "one")
        offered = mails(spark, ["a", "b", "c"])
        assert sorted(r.id for r in ids.missing(offered, "id").collect()) == sorted({"a", "b", "c"} - set(stored))
    ids.add(mails(spark, ["a"]), "id", "it's 100% / two")
    assert ids.missing(mails(spark, ["a"]), "id").isEmpty()
    assert ids.missing(mails(spark, ["a"]), "id", but="it's 100% / two").count() == 1


def test_another_session_finds_all_runs(spark, key_set):
    key_set().add(mails(spark, ["a"]), "id", "one")
    other = KeySet(spark.newSession(), key_set().path, 4, 2)
    other.spark.sql(f"DROP TABLE IF EXISTS `{other._name}`")
    other.add(mails(other.spark, ["b"]), "id", "two")
    assert sorted(r.id for r in key_set().missing(mails(spark, ["a", "b", "c"]), "id").collect()) == ["c"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, schemas.EMBEDDINGS)


def test_vectors_appended_twice_are_stored_once(spark, key_set, tmp_path):
    path, keys = f"{tmp_path}/vectors", {"email_id": key_set("vector_ids")}
    tables.create_runs(spark, path, schemas.EMBEDDINGS)
    batch = vectors(spark, [("a", [1.0]), ("b", [2.0]), ("b", [2.5]), ("c", None), (None, [3.0])])
    read = lambda: sorted(((r.email_id or ""), r.vector[0]) for r in tables.read_embeddings(spark, path).collect())
    tables.append_embeddings(batch, path, "one", keys)
    first = read()
    assert [i for i, _ in first] == ["", "a", "b"]
    tables.append_embeddings(batch, path, "one", keys)  # tried again
    assert read() == first
    tables.append_embeddings(vectors(spark, [("a", [9.0]), ("c", [4.0])]), path, "two", keys)  # another run
    assert read() == sorted([*first, ("c", 4.0)])


def test_a_run_that_broke_off_is_mended(spark, key_set, tmp_path, monkeypatch):
    """Rows are written before their keys: the second try leaves one of each."""
    path, keys = f"{tmp_path}/vectors", {"email_id": key_set("broken")}
    batch = vectors(spark, [("a", [1.0])])
    with monkeypatch.context() as m:
        m.setattr(KeySet, "add", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.append_embeddings(batch, path, "one", keys)
    tables.append_embeddings(batch, path, "one", keys)
    tables.append_embeddings(batch, path, "two", keys)
    assert tables.read_embeddings(spark, path).count() == 1


def test_mails_have_two_unique_keys(spark, key_set, tmp_path):
    path, keys = f"{tmp_path}/mails", {"id": key_set("mail_ids"), "content_hash": key_set("hashes")}
    row = lambda i, h: (i, None, None, None, None, None, h)
    batch = spark.createDataFrame([row("a", "h1"), row("b", "h2")], schemas.EMAILS)
    tables.append_emails(batch, path, "one", keys)
    more = spark.createDataFrame([row("a", "h3"), row("c", "h2"), row("d", "h4"), row(None, "h5")], schemas.EMAILS)
    for _ in range(2):
        tables.append_emails(more, path, "two", keys)
        assert sorted(r.content_hash for r in tables.read_emails(spark, path).collect()) == ["h1", "h2", "h4", "h5"]


def test_transactions_tried_again(spark, key_set, tmp_path):
    """Other months the second time: nothing of the first try is left."""
    path, keys = f"{tmp_path}/tx", {"id": key_set("tx_ids")}
    tx = lambda i, day: (i, i, "m", 1, None, day, None, 1.0)
    tables.append_tx(spark.createDataFrame([tx("a", "2024-01-05"), tx("b", None)], schemas.TX), path, "one", keys)
    tables.append_tx(spark.createDataFrame([tx("a", "2024-03-05"), tx("b", "soon")], schemas.TX), path, "one", keys)
    assert sorted((r.id, r.tx_month) for r in tables.read_tx(spark, path).collect()) == [("a", "2024-03"), ("b", tables.ODD_MONTH)]


def test_first_rows_against_a_key_set(spark, key_set):
    hashes = key_set("body")
    hashes.add(spark.createDataFrame([("old",)], "h string"), "h", "one")
    rows = [("1", "e", "b"), ("2", "e", "a"), ("3", "x", "c"), ("4", "old", "d")]
    df = spark.createDataFrame(rows, "id string, content_hash string, raw_path string")
    assert sorted(r.id for r in dedup.first_by_hash(df, hashes).collect()) == ["2", "3"]


def test_a_run_is_worked_out_without_its_own_rows(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    for run, ids in (("one", "ab"), ("2", "c")):
        tables.append_embeddings(vectors(spark, [(i, [1.0]) for i in ids]), path, run)
    read = lambda but: sorted(r.email_id for r in tables.read_embeddings(spark, path, but).collect())
    assert read(None) == ["a", "b", "c"] and read("one") == ["c"] and read("2") == ["a", "b"]
