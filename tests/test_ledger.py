"""A stored ledger with its dictionary and summaries, against brute force, and what it reads."""

import json

import pytest
from pyspark.sql import functions as F

from spendlake import schemas
from spendlake.functions.render import NO_MATCH, NOT_UNDERSTOOD
from spendlake.operators import match
from spendlake.plans import ask
from spendlake.sources import tables
from spendlake.sources.ledger import Ledger
from tests.test_match import wanted, world  # noqa: F401


@pytest.fixture(scope="module")
def ledger(spark, world, tmp_path_factory):  # noqa: F811
    """The transactions in three runs, one of them tried twice with other rows first."""
    _, rows = world
    made = Ledger(spark, str(tmp_path_factory.mktemp("ledger"))).create().create()
    made.append(spark.createDataFrame(rows[:150], schemas.TX), "a")
    made.append(spark.createDataFrame(rows[:200], schemas.TX), "b")
    made.append(spark.createDataFrame(rows[150:300], schemas.TX), "b")
    made.append(spark.createDataFrame(rows[300:], schemas.TX))
    return made


def asked(spark, questions):
    return spark.createDataFrame(questions, schemas.QUESTIONS)


def test_totals_equal_brute_force(spark, world, ledger):  # noqa: F811
    questions, rows = world
    sums = {}
    for one in questions:
        for row in rows:
            if wanted(one, row):
                sums.setdefault((one[0], row[4]), []).extend([row[3]] * (row[3] is not None))
    expected = {k: sum(v) if v else None for k, v in sums.items()}
    got = {(r.qid, r.currency): r.total for r in ledger.totals(asked(spark, questions)).collect()}
    assert got == expected


def test_transactions_equal_brute_force(spark, world, ledger):  # noqa: F811
    questions, rows = world
    pairs = {(one[0], row[0]) for one in questions for row in rows if wanted(one, row)}
    found = ledger.transactions(asked(spark, questions)).select("qid", "id").collect()
    assert len(found) == len(pairs) and {tuple(r) for r in found} == pairs


def test_open_questions_read_no_transactions(spark, ledger, plan):
    questions = asked(spark, [(1, None, "2024-01-06", "2024-12-31", "sum"), (2, "", None, None, "sum")])
    text = plan(ledger.totals(questions))
    assert f"{ledger.path}/tx" not in text and "/tx]" not in text
    assert f"{ledger.path}/months" in text and f"{ledger.path}/days" in text
    named = asked(spark, [(1, "uber", None, None, "sum")])
    assert f"{ledger.path}/tx" in plan(ledger.totals(named))


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_months_asked_about_prune_the_scan(spark, world, ledger):  # noqa: F811
    questions = asked(spark, [(1, "uber", "2024-02-01", "2024-02-29", "sum"), (2, None, "2024-12-01", "2024-12-31", "list")])
    keys = ledger.keys(questions)
    text = formatted(match.transactions_of(keys, ledger.read()))
    assert "dynamicpruning" in text and text.count("dynamicpruning") >= 2
    text = formatted(match._merchant_amounts(keys, ledger.read()))
    assert "dynamicpruning" in text
    assert {r.month for r in keys.months.collect()} == {"2024-02", "2024-12", tables.ODD_MONTH}


def test_undated_rows_are_read_by_no_dated_query(spark, ledger):
    from spendlake.plans.query import filter_transactions

    stored = {r.tx_month for r in ledger.read().select("tx_month").distinct().collect()}
    assert {tables.ODD_MONTH, tables.NO_MONTH} < stored
    for bounds in (("2024-01-01", None), (None, "2024-12-31"), ("2024-01-01", "2024-12-31")):
        found = filter_transactions(ledger.read(), None, *bounds)
        text = formatted(found)
        filters = next(line for line in text.splitlines() if "PartitionFilters" in line)
        assert tables.NO_MONTH in filters or "tx_month" in filters
        assert found.filter(F.col("tx_month") == tables.NO_MONTH).isEmpty()


def test_pieces_are_looked_up_by_bucket(spark, ledger):
    questions = asked(spark, [(1, "ring", None, None, "sum")])
    pieces = tables.read_runs(spark, f"{ledger.path}/pieces", schemas_of("pieces"))
    patterns = match._merchant_keys(questions, pieces)
    assert "piece_bucket" in formatted(patterns)
    assert sorted({r.merchant for r in patterns.collect()}) == ["RINGS", "ring"]


def schemas_of(name):
    from spendlake.sources import ledger as module

    return getattr(module, f"_{name.upper()}")


def test_unique_ids(spark, tmp_path):
    made = Ledger(spark, str(tmp_path), buckets=4).create()
    row = lambda i, cents: (i, i, "m", cents, "USD", "2024-01-05", "c", 1.0)
    for run in ("a", "a", "b"):
        made.append(spark.createDataFrame([row("t1", 5), row("t2", 7)], schemas.TX), run)
    assert made.read().count() == 2
    got = made.totals(asked(spark, [(1, None, None, None, "sum"), (2, "M", None, None, "sum")])).collect()
    assert sorted((r.qid, r.total) for r in got) == [(1, 12), (2, 12)]


def replies(spark, questions):
    rows = []
    for qid, merchant, start, end, metric in questions:
        text = {"merchant": merchant, "start_date": start, "end_date": end, "metric": metric}
        rows.append((qid, json.dumps(text, ensure_ascii=False)))
    return spark.createDataFrame([*rows, (9999, "no idea")], "qid long, reply string")


def test_answers_are_the_same_from_a_ledger(spark, world, ledger):  # noqa: F811
    questions, rows = world
    questions = [*questions, (500, "no such shop", None, None, "list"), (501, "", "2030-01-01", None, "sum")]
    tx = spark.createDataFrame([*rows, rows[0], rows[0]], schemas.TX)
    ledger.append(spark.createDataFrame([rows[0], rows[0]], schemas.TX), "again")
    asked_by = replies(spark, questions)
    one, two = ask.ask_many(asked_by, tx), ask.ask_ledger(asked_by, ledger)
    key = lambda r: (r.qid, r.part, r.tx_date or "", r.line)
    expected = sorted(map(tuple, one.collect()), key=repr)
    assert sorted(map(tuple, two.collect()), key=repr) == expected
    lines = {}
    for r in sorted(one.collect(), key=key):
        lines.setdefault(r.qid, []).append(r.line)
    every = [*rows, rows[0], rows[0]]
    for question in questions:
        hits = [row for row in every if wanted(question, row)]
        own = lines[question[0]]
        if not hits:
            assert own == [NO_MATCH]
        elif question[4] == "list":
            assert own[0] == f"Found {len(hits)} transactions:" and len(own) == len(hits) + 1
        else:
            assert len(own) == len({row[4] for row in hits})
    assert lines[9999] == [NOT_UNDERSTOOD]
    ledger.append(spark.createDataFrame([], schemas.TX), "again")


def test_a_day_of_the_year_0_is_under_its_month(spark, tmp_path):
    made = Ledger(spark, str(tmp_path)).create()
    row = lambda i, cents, day: (i, i, "m", cents, "USD", day, "c", 1.0)
    made.append(spark.createDataFrame([row("t1", 5, "0000-05-05"), row("t2", 7, "0001-05-05")], schemas.TX), "a")
    questions = [(1, None, "0000-01-01", "0000-12-31", "sum"), (2, "M", "", "0000-12-31", "sum"), (3, "", "0001-01-01", "", "sum")]
    assert sorted((r.qid, r.total) for r in made.totals(asked(spark, questions)).collect()) == [(1, 5), (2, 5), (3, 7)]


def test_three_reads_of_the_transactions(spark, world, tmp_path, monkeypatch):  # noqa: F811
    """What is written or read again on the way comes from three scans; one, of a ledger."""
    questions, rows = world
    path = f"{tmp_path}/flat"
    spark.createDataFrame(rows, schemas.TX).write.parquet(path)
    seen = []
    from spendlake import staging
    from spendlake.operators import match as m

    def counting(df, name):
        seen.append(formatted(df))
        return staging.staged(df, name)

    monkeypatch.setattr(m, "staged", counting)
    monkeypatch.setattr(ask, "staged", counting)
    seen.append(formatted(ask.ask_many(replies(spark, questions), spark.read.schema(schemas.TX).parquet(path))))
    assert sum(text.count("(1 paths)[file:" + path + "]") + text.count(f"[file:{path}]") for text in seen) <= 2 * 3


def test_a_model_is_told_the_date(spark):
    import datetime

    questions = spark.createDataFrame([(1, "last month?")], "qid long, question string")
    echo = lambda texts: [t.replace("\n", "|") for t in texts]
    assert ask.asked(questions, echo, datetime.date(2024, 3, 31)).first().reply == "Today is 2024-03-31.|last month?"
    assert ask.asked(questions, echo).first().reply == "last month?"
