"""Many questions against the transactions.

A question is a merchant pattern and a date range, neither of which is an
equality. Both are turned into join keys, so that no transaction meets a
question it cannot belong to:

* patterns are looked up once in the dictionary of merchants. Both sides of
  that look-up are keyed by short pieces of text: a pattern by one piece that
  every match must hold, a merchant by all of its pieces;
* questions without a pattern are keyed by the months they cover.

Text comparison then decides, inside the join. Transactions that are stored by
month are read for the covered months only: these are known when the
query runs, and prune its scan.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.dates import canonical_day
from spendlake.functions.text import contains_pattern, fold_ascii
from spendlake.schemas import NO_MONTH, ODD_MONTH
from spendlake.staging import staged

_PIECE = 3


def _pieces(text: Column) -> Column:
    """All pieces of one to three characters, and the empty one."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(
        F.array().cast("array<int>")
    )
    at = F.transform(
        starts,
        lambda i: F.array(*[F.substring(text, i, F.lit(n)) for n in range(1, _PIECE + 1)]),
    )
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(at)))


def _needed_piece(part: Column) -> Column:
    """A piece of the longest stretch of ``part`` that has no wildcard."""
    stretches = F.transform(
        F.split(part, "[%_]"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))
    )
    return F.substring(F.array_max(stretches)["s"], 1, _PIECE)


def merchant_pieces(merchants: DataFrame) -> DataFrame:
    """``merchant, name, piece``: the dictionary that patterns are looked up in."""
    names = merchants.filter(F.col("merchant").isNotNull()).select(
        "merchant", fold_ascii(F.col("merchant")).alias("name")
    )
    return names.select("merchant", "name", F.explode(_pieces(F.col("name"))).alias("piece"))


def _merchant_keys(questions: DataFrame, pieces: DataFrame) -> DataFrame:
    """The merchants that each question with a pattern asks for."""
    asked = questions.filter(F.col("merchant") != "").select(
        "qid", "metric", fold_ascii(F.col("merchant")).alias("part"), "start_date", "end_date"
    )
    patterns = asked.select(
        "part",
        contains_pattern(F.col("part")).alias("pattern"),
        _needed_piece(F.col("part")).alias("piece"),
    ).distinct()
    on = ["piece"]
    if "piece_bucket" in pieces.columns:  # a stored dictionary: only the buckets that are asked for are read
        patterns, on = patterns.withColumn("piece_bucket", piece_bucket(F.col("piece"))), ["piece_bucket", "piece"]
    hits = pieces.join(patterns, on).filter(F.like("name", F.col("pattern")))
    return hits.select("part", "merchant").distinct().join(asked, "part").drop("part")


#: Folders of a stored dictionary of merchants.
PIECE_BUCKETS = 64


def piece_bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(PIECE_BUCKETS)).cast("int")


def _day(tx: DataFrame) -> Column:
    return tx["tx_day"] if "tx_day" in tx.columns else canonical_day(tx["tx_date"])


def _month(tx: DataFrame) -> Column:
    """``YYYY-MM`` of a plain day; keys of their own for other text and for no date."""
    if "tx_month" in tx.columns:
        return tx["tx_month"]
    of_day = F.when(_day(tx).isNotNull(), F.substring(tx["tx_date"], 1, 7)).otherwise(ODD_MONTH)
    return F.when(tx["tx_date"].isNull(), NO_MONTH).otherwise(of_day)


def _covered_months(questions: DataFrame, months: DataFrame) -> DataFrame:
    """``questions`` with each of the ``months`` of the data that they can cover.

    A month is covered unless all of its days are out of the range, compared as text. Date text
    that is no plain day may be in any range; no date only where there is no bound.
    """
    start, end = (F.coalesce(c, F.lit("")) for c in ("start_date", "end_date"))
    known = questions.withColumn("months", months.agg(F.array_sort(F.collect_set("month"))).scalar())
    covered = F.filter(
        "months",
        lambda m: F.when(m == NO_MONTH, (start == "") & (end == ""))
        .when(m == ODD_MONTH, True)
        .otherwise(((start == "") | (F.concat(m, F.lit("-99")) >= start)) & ((end == "") | (m <= end))),
    )
    return known.select("qid", "merchant", "metric", "start_date", "end_date", F.explode(covered).alias("month"))


def _in_range(tx: DataFrame, keys: DataFrame) -> Column:
    """Bounds are inclusive and compare text; an empty one does not bind, and a
    transaction without a date meets none."""
    start, end, date = keys["start_date"], keys["end_date"], tx["tx_date"]
    after = (F.coalesce(start, F.lit("")) == "") | (date >= start)
    before = (F.coalesce(end, F.lit("")) == "") | (date <= end)
    return after & before


class Keys(NamedTuple):
    """Join keys of a set of questions, and the months they cover."""

    by_merchant: DataFrame
    by_month: DataFrame
    months: DataFrame

    def only(self, condition: Column) -> "Keys":
        return Keys(*(keys.filter(condition) for keys in self))


def keys_in(questions: DataFrame, pieces: DataFrame, months: DataFrame) -> Keys:
    """Keys of ``questions`` in a dictionary of merchants and the months of the data.

    Questions and keys are written tables, so Spark knows their sizes when it picks a join.
    """
    questions = staged(questions, "questions")
    by_merchant = staged(_merchant_keys(questions, pieces), "merchant-keys")
    covered = staged(_covered_months(questions, months), "month-keys")
    by_month = covered.filter(F.coalesce(F.col("merchant"), F.lit("")) == "").drop("merchant")
    return Keys(by_merchant, by_month, staged(covered.select("metric", "month").distinct(), "months"))


def question_keys(questions: DataFrame, tx: DataFrame) -> Keys:
    """Keys of ``questions`` (``qid``, ``merchant``, ``start_date``,
    ``end_date``, ``metric``) in the merchants and months of ``tx``, read once for both."""
    known = staged(tx.select("merchant", _month(tx).alias("month")).distinct(), "merchants")
    return keys_in(questions, merchant_pieces(known.select("merchant").distinct()), known.select("month").distinct())


def _pruned(tx: DataFrame, months: DataFrame) -> DataFrame:
    """The transactions of the covered months, where they are stored by month.

    There are no more months than a calendar has, so they go to every task.
    """
    if "tx_month" not in tx.columns:
        return tx
    wanted = months.filter(F.col("month") >= "").select(F.col("month").alias("tx_month")).distinct()
    return tx.join(F.broadcast(wanted), "tx_month", "left_semi").select(tx.columns)


def _join_merchants(tx: DataFrame, keys: DataFrame) -> DataFrame:
    on = (tx["merchant"] == keys["merchant"]) & _in_range(tx, keys)
    return tx.join(keys, on).select(keys["qid"], *[tx[c] for c in tx.columns])


def _join_months(tx: DataFrame, keys: DataFrame) -> DataFrame:
    on = (_month(tx) == keys["month"]) & _in_range(tx, keys)
    return tx.join(keys, on).select(keys["qid"], *[tx[c] for c in tx.columns])


def transactions_of(keys: Keys, tx: DataFrame) -> DataFrame:
    """Every transaction that each question asks for, with its ``qid``."""
    tx = _pruned(tx, keys.months)
    of_merchants = _join_merchants(tx, keys.by_merchant)
    return of_merchants.unionByName(_join_months(tx, keys.by_month))


def _day_totals(tx: DataFrame) -> DataFrame:
    """Cents per day and currency."""
    month = ["tx_month"] if "tx_month" in tx.columns else []
    return tx.groupBy("tx_date", "currency", *month).agg(F.sum("amount_cents").alias("amount_cents"))


def totals_of(keys: Keys, tx: DataFrame) -> DataFrame:
    """Total cents per question and currency.

    Questions about all merchants are answered from one total per day and
    currency, not from the transactions.
    """
    of_days = _join_months(_day_totals(_pruned(tx, keys.months)), keys.by_month)
    return _summed(_merchant_amounts(keys, tx).unionByName(of_days.select("qid", "currency", "amount_cents")))


def _merchant_amounts(keys: Keys, tx: DataFrame) -> DataFrame:
    month = ["tx_month"] if "tx_month" in tx.columns else []
    narrow = _pruned(tx.select("merchant", "tx_date", "currency", "amount_cents", *month), keys.months)
    return _join_merchants(narrow, keys.by_merchant).select("qid", "currency", "amount_cents")


def _summed(amounts: DataFrame) -> DataFrame:
    return amounts.groupBy("qid", "currency").agg(F.sum("amount_cents").alias("total"))


class Summaries(NamedTuple):
    """Totals that are kept beside the transactions: ``amount_cents`` per ``currency`` and day, and month."""

    days: DataFrame
    months: DataFrame


def totals_from(keys: Keys, tx: DataFrame, summaries: Summaries) -> DataFrame:
    """As ``totals_of``, but open questions are answered from the summaries.

    A month that lies in the range as a whole comes from the months, its edges from the days. The
    transactions are read only if a question names merchants.
    """
    start, end = (F.coalesce(c, F.lit("")) for c in ("start_date", "end_date"))
    last = F.date_format(F.last_day(F.concat(F.col("month"), F.lit("-01")).try_cast("date")), "yyyy-MM-dd")
    plain = ~F.col("month").isin(NO_MONTH, ODD_MONTH)
    whole = ((start == "") | (plain & (F.concat(F.col("month"), F.lit("-01")) >= start))) & ((end == "") | (plain & (last <= end)))
    of_month = keys.by_month.withColumn("whole", F.coalesce(whole, F.lit(False)))
    full, edges = of_month.filter("whole").drop("whole"), of_month.filter("NOT whole").drop("whole")
    on = summaries.months["tx_month"] == full["month"]
    of_months = summaries.months.join(full, on).select("qid", "currency", "amount_cents")
    of_days = _join_months(summaries.days, edges).select("qid", "currency", "amount_cents")
    found = of_months.unionByName(of_days)
    if not keys.by_merchant.isEmpty():
        found = found.unionByName(_merchant_amounts(keys, tx))
    return _summed(found)


def answers_of(keys: Keys, tx: DataFrame, is_sum: Column) -> DataFrame:
    """``qid, listed, currency, merchant, tx_date, amount_cents, n`` of every question, but for totals of all merchants.

    One pass over the transactions: each is keyed by its merchant and by its month. For a listed question, ``n``
    equal transactions; else (``listed`` is false) a total of ``n``, with no merchant or date.
    """
    month = ["tx_month"] if "tx_month" in tx.columns else []
    tx = _pruned(tx.select("merchant", "tx_date", "currency", "amount_cents", *month), keys.months)
    named = lambda kind, value: F.concat(F.lit(kind), value)
    columns = ["qid", (~is_sum).alias("listed"), "start_date", "end_date"]
    by_merchant = keys.by_merchant.select(*columns, named("merchant ", F.col("merchant")).alias("_key"))
    by_month = keys.by_month.filter(~is_sum).select(*columns, named("month ", F.col("month")).alias("_key"))
    wanted = by_merchant.unionByName(by_month)
    own = F.array(named("merchant ", F.col("merchant")), named("month ", _month(tx)))
    keyed = tx.withColumn("_key", F.explode(own))
    found = keyed.join(wanted, (keyed["_key"] == wanted["_key"]) & _in_range(keyed, wanted))
    shown = [F.when(F.col("listed"), F.col(c)).alias(c) for c in ("merchant", "tx_date")]
    cents = F.when(F.col("listed"), F.col("amount_cents")).alias("cents")
    found = found.select("qid", "listed", "currency", *shown, cents, "amount_cents")
    found = found.groupBy("qid", "listed", "currency", "merchant", "tx_date", "cents")
    found = found.agg(F.sum("amount_cents").alias("total"), F.count("*").alias("n"))
    amount = F.when(F.col("listed"), F.col("cents")).otherwise(F.col("total")).alias("amount_cents")
    return found.select("qid", "listed", "currency", "merchant", "tx_date", amount, "n")


def open_totals_of(keys: Keys, tx: DataFrame) -> DataFrame:
    """``qid, currency, total`` of the questions about all merchants."""
    of_days = _join_months(_day_totals(_pruned(tx, keys.months)), keys.by_month)
    return _summed(of_days.select("qid", "currency", "amount_cents"))


def transactions_by_question(questions: DataFrame, tx: DataFrame) -> DataFrame:
    return transactions_of(question_keys(questions, tx), tx)


def totals_by_question(questions: DataFrame, tx: DataFrame) -> DataFrame:
    return totals_of(question_keys(questions, tx), tx)
