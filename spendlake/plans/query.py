"""One spend question as a plain filter and aggregate."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.text import merchant_contains
from spendlake.operators.topk import newest_first
from spendlake.operators.totals import total_by_currency
from spendlake.schemas import NO_MONTH, ODD_MONTH


def filter_transactions(
    tx: DataFrame,
    merchant: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
) -> DataFrame:
    """Transactions that meet every filter that is given; empty ones are not.

    Dates compare as text, bounds included. Where the table has a day and a
    month, bounds that are plain days also prune by those; rows whose date
    text is no plain day stay and are compared as text, rows without a date go.
    """
    if merchant:
        tx = tx.filter(merchant_contains(F.col("merchant"), merchant))
    if start_date:
        tx = _prune(tx, start_date, lambda c, v: c >= v).filter(F.col("tx_date") >= start_date)
    if end_date:
        tx = _prune(tx, end_date, lambda c, v: c <= v).filter(F.col("tx_date") <= end_date)
    return tx


def _prune(tx: DataFrame, bound: str, compare) -> DataFrame:
    if not _is_day(bound):
        return tx
    if "tx_day" in tx.columns:
        day = F.col("tx_day")
        tx = tx.filter(compare(day, F.lit(bound).cast("date")) | day.isNull())
    if "tx_month" in tx.columns:
        month = F.col("tx_month")
        dated = (month != NO_MONTH) & compare(month, F.lit(bound[:7]))
        tx = tx.filter(dated | (month == ODD_MONTH))
    return tx


def _is_day(text: str) -> bool:
    try:
        return len(text) == 10 and datetime.date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def run_query(
    tx: DataFrame,
    merchant: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    metric: str | None = None,
) -> DataFrame:
    """``sum``: total per currency. Any other metric: the list, newest first."""
    found = filter_transactions(tx, merchant, start_date, end_date)
    if metric == "sum":
        return total_by_currency(found)
    listed = ["merchant", "amount_cents", "currency", "tx_date", "category"]
    return newest_first(found).select(*listed)
