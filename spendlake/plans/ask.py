"""Questions to answer lines.

An answer is one row per line, so that a long list is never built up in one
place. ``part`` is 0 for a notice or header and 1 for what follows it; sorted
by ``qid``, ``part``, ``tx_date`` (newest first) and ``line`` the rows read as
the answers.
"""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions import render
from spendlake.functions.dates import period_bounds
from spendlake.functions.replies import intent_object, intent_text, keep_last_keys
from spendlake.operators.hooks import Hook, ask_hook
from spendlake.operators.match import answers_of, open_totals_of, question_keys, totals_from
from spendlake.operators.totals import total_by_currency
from spendlake.plans.query import filter_transactions
from spendlake.sources.ledger import Ledger
from spendlake.staging import staged

_PARAMETERS = ("merchant", "start_date", "end_date", "metric")


def intents(questions: DataFrame) -> DataFrame:
    """``qid``, ``reply`` to search parameters and ``understood``."""
    keep_last_keys(questions.sparkSession)
    objects = questions.select("qid", intent_object(F.col("reply")).alias("obj"))
    obj = F.col("obj")
    return objects.select(
        "qid",
        *[intent_text(obj, p).alias(p) for p in _PARAMETERS],
        obj.isNotNull().alias("understood"),
    )


def from_periods(questions: DataFrame, today: datetime.date) -> DataFrame:
    """``qid``, ``merchant``, ``period``, ``metric`` to search parameters."""
    start, end = period_bounds(F.col("period"), F.lit(today))
    dated = questions.withColumn("start_date", start).withColumn("end_date", end)
    understood = F.col("start_date").isNotNull().alias("understood")
    return dated.select("qid", *_PARAMETERS, understood)


def asked(questions: DataFrame, hook: Hook, today: datetime.date | None = None) -> DataFrame:
    """``qid``, ``question`` to ``qid``, ``reply`` by a model call.

    With ``today`` the model is told the date before the question, so that it can place "last month".
    """
    if today is not None:
        told = F.concat(F.lit(f"Today is {today.isoformat()}.\n"), F.col("question"))
        questions = questions.withColumn("question", told)
    return ask_hook(questions, "question", "reply", "string", hook).select("qid", "reply")


def _line(part: int, line, tx_date=None) -> list:
    date = F.lit(None).cast("string") if tx_date is None else tx_date
    return ["qid", F.lit(part).alias("part"), date.alias("tx_date"), line.alias("line")]


def sum_lines(totals: DataFrame) -> DataFrame:
    """``qid``, ``currency``, ``total`` to lines."""
    return totals.select(*_line(1, render.sum_line(F.col("total"), F.col("currency"))))


def list_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.count("*").alias("n"))


def list_lines(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Transactions with a ``qid`` to a header and one line each."""
    text = render.list_line(
        F.col("tx_date"), F.col("merchant"), F.col("amount_cents"), F.col("currency")
    )
    header = counts.select(*_line(0, render.list_header(F.col("n"))))
    return header.unionByName(found.select(*_line(1, text, F.col("tx_date"))))


def no_match_lines(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """The line for each question that has no row in ``answered``."""
    silent = questions.select("qid").join(answered.select("qid").distinct(), "qid", "left_anti")
    return silent.select(*_line(0, F.lit(render.NO_MATCH)))


def answer_many(questions: DataFrame, tx: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Answer lines of questions given as parameters (and ``understood``).

    The questions, and what is found for them, are written tables, as more than one kind of line reads
    them. The transactions are read three times: for their merchants and months, for the totals per day, and for
    what the questions ask for. A ``ledger`` has the first two beside its transactions.
    """
    questions = staged(questions, "questions")
    clear = questions.filter("understood")
    is_sum = F.coalesce(F.col("metric") == "sum", F.lit(False))
    sums, lists = clear.filter(is_sum), clear.filter(~is_sum)
    kept = [c for c in ("tx_day", "tx_month") if c in tx.columns]
    shown = tx.select("merchant", "amount_cents", "currency", "tx_date", *kept)
    keys = question_keys(clear, shown) if ledger is None else ledger.keys(clear)
    found = staged(answers_of(keys, shown, is_sum), "found")
    none = keys.only(is_sum)
    if ledger is None:
        of_all = open_totals_of(none, shown)
    else:
        of_all = totals_from(none._replace(by_merchant=none.by_merchant.limit(0)), shown, ledger.summaries())
    named = found.filter("NOT listed").select("qid", "currency", F.col("amount_cents").alias("total"))
    totals = staged(named.unionByName(of_all), "totals")
    counts = staged(found.filter("listed").groupBy("qid").agg(F.sum("n").alias("n")), "counts")
    rows = found.filter("listed").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("_copy")
    unclear = questions.filter("NOT understood").select(*_line(0, F.lit(render.NOT_UNDERSTOOD)))
    return (
        sum_lines(totals)
        .unionByName(list_lines(rows, counts))
        .unionByName(no_match_lines(sums, totals))
        .unionByName(no_match_lines(lists, counts))
        .unionByName(unclear)
    )


def ask_many(questions: DataFrame, tx: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Answer lines of questions given as model replies (``qid``, ``reply``)."""
    return answer_many(intents(questions), tx, ledger)


def ask_ledger(questions: DataFrame, ledger: Ledger) -> DataFrame:
    """As ``ask_many``, from a stored ledger: its transactions are read once, for the months asked about."""
    return ask_many(questions, ledger.read(), ledger)


def ask(tx: DataFrame, reply: str) -> DataFrame:
    """Answer lines of one question, given as a model reply, in reading order.

    One question needs no join: its parameters become plain filters.
    """
    spark = tx.sparkSession
    one = spark.range(1).select(F.lit(0).alias("qid"), F.lit(reply).alias("reply"))
    params = intents(one).first()
    if not params["understood"]:
        return one.select(*_line(0, F.lit(render.NOT_UNDERSTOOD)))
    found = filter_transactions(tx, params["merchant"], params["start_date"], params["end_date"])
    if params["metric"] == "sum":
        rows = total_by_currency(found).withColumn("qid", F.lit(0))
        lines = sum_lines(rows)
    else:
        rows = found.withColumn("qid", F.lit(0))
        lines = list_lines(rows, list_counts(rows))
    lines = lines.unionByName(no_match_lines(one, rows))
    return lines.orderBy("part", F.desc_nulls_last("tx_date"), "line")
