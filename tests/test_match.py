import random
import re

import pytest
from pyspark.sql import functions as F

from spendlake import schemas
from spendlake.operators import match
from spendlake.plans.query import filter_transactions, run_query
from spendlake.sources import tables
from tests.test_text import like

DATES = ["2024-01-05", "2024-02-29", "2024-12-31", "03/01/2024", "2024-3-1", "", None, "2024-13-01"]
BOUNDS = ["2024-01-05", "2024-02", "2024-12-31", "0", "9", "2023-12-31", "", None]


def wanted(question, row):
    _, part, start, end, _ = question
    merchant, date = row[2], row[5]
    if part and (merchant is None or not like(merchant, part)):
        return False
    if start and (date is None or date < start):
        return False
    return not (end and (date is None or date > end))


@pytest.fixture(scope="module")
def world(spark):
    """Transactions of which a third are with one merchant, and questions."""
    rng = random.Random(11)
    names = ["Uber", "uber eats", "ÜBER", "a_b", "a%b", "x", "", None, "Café\\", "ring", "RINGS"]
    rows = []
    for n in range(400):
        merchant = "Uber" if rng.random() < 0.33 else rng.choice(names)
        currency = rng.choice(["USD", "EUR", None])
        amount = rng.choice([None, 0, 5, 250])
        rows.append((f"t{n:03}", f"m{n}", merchant, amount, currency, rng.choice(DATES), "c", 1.0))
    parts = ["uber", "U_E", "%", "_", "ri%s", "é", "\\", "b", "", None, "no such", "a_b", "xyzw"]
    questions = [
        (n, rng.choice(parts), rng.choice(BOUNDS), rng.choice(BOUNDS), rng.choice(["sum", "list"]))
        for n in range(60)
    ]
    return questions, rows


def test_many_questions_equal_brute_force(spark, world):
    questions, rows = world
    tx = spark.createDataFrame(rows, schemas.TX)
    q = spark.createDataFrame(questions, schemas.QUESTIONS)
    pairs = {(one[0], row[0]) for one in questions for row in rows if wanted(one, row)}
    found = match.transactions_by_question(q, tx).select("qid", "id").collect()
    assert len(found) == len(pairs) and {tuple(r) for r in found} == pairs
    sums = {}
    for one in questions:
        for row in rows:
            if wanted(one, row):
                sums.setdefault((one[0], row[4]), []).extend([row[3]] * (row[3] is not None))
    expected = {k: sum(v) if v else None for k, v in sums.items()}
    got = {(r.qid, r.currency): r.total for r in match.totals_by_question(q, tx).collect()}
    assert got == expected


def test_one_question_equals_brute_force(spark, world):
    questions, rows = world
    tx = spark.createDataFrame(rows, schemas.TX)
    for one in questions[:12]:
        found = filter_transactions(tx, *one[1:4]).collect()
        assert {r.id for r in found} == {row[0] for row in rows if wanted(one, row)}


def test_no_nested_loops(spark, world, plan):
    questions, rows = world
    tx = spark.createDataFrame(rows, schemas.TX)
    q = spark.createDataFrame(questions, schemas.QUESTIONS)
    keys = match.question_keys(q, tx)
    for df in (match.transactions_of(keys, tx), match.totals_of(keys, tx)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert text.count("BroadcastHashJoin") == 2


def test_stored_tx_prunes_by_month_and_keeps_odd_dates(spark, world, tmp_path):
    questions, rows = world
    path = str(tmp_path / "tx")
    tables.append_tx(spark.createDataFrame(rows, schemas.TX), path)
    stored = tables.read_tx(spark, path)
    found = filter_transactions(stored, None, "2024-02-01", "2024-03-31")
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    scan = re.search(r"PartitionFilters: (.*)", found._jdf.queryExecution().explainString(formatted))
    assert "tx_month" in scan[1]
    one = (0, None, "2024-02-01", "2024-03-31", "list")
    assert {r.id for r in found.collect()} == {row[0] for row in rows if wanted(one, row)}
    q = spark.createDataFrame(questions, schemas.QUESTIONS)
    pairs = {(o[0], row[0]) for o in questions for row in rows if wanted(o, row)}
    both = match.transactions_by_question(q, stored).select("qid", "id").collect()
    assert {tuple(r) for r in both} == pairs


def test_list_is_newest_first(spark, world):
    tx = spark.createDataFrame(world[1], schemas.TX)
    listed = [r.tx_date for r in run_query(tx, metric="anything").collect()]
    dated = [d for d in listed if d is not None]
    assert dated == sorted(dated, reverse=True) and listed[len(dated) :] == [None] * (400 - len(dated))


def test_years_one_and_9999(spark):
    """The first and the last year make no error, and no months between them."""
    rows = [("a", "m", 1, "0001-01-01"), ("b", "m", 2, "9999-12-31"), ("c", "m", 4, None), ("d", "m", 8, "soon")]
    tx = spark.createDataFrame(rows, "id string, merchant string, amount_cents long, tx_date string")
    tx = tx.withColumn("currency", F.lit("USD"))
    asked = [(1, None, None, None, "sum"), (2, "", "0001-01-01", "", "sum"), (3, None, "", "0500-01", "sum")]
    keys = match.question_keys(spark.createDataFrame(asked, schemas.QUESTIONS), tx)
    assert keys.by_month.count() <= 12
    got = {r.qid: r.total for r in match.totals_of(keys, tx).collect()}
    assert got == {1: 15, 2: 11, 3: 1}
