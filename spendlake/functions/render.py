"""Answer lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notices.
NO_MATCH = "No transactions found matching your criteria."
NOT_UNDERSTOOD = "Could not understand the query."


def _amount(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def sum_line(total: Column, currency: Column) -> Column:
    """``Total spent: 12.34 USD``; no total is 0.00, no currency USD."""
    shown = F.when(currency != "", currency).otherwise(F.lit("USD"))
    return F.format_string("Total spent: %.2f %s", _amount(F.coalesce(total, F.lit(0))), shown)


def list_header(count: Column) -> Column:
    return F.format_string("Found %d transactions:", count)


def list_line(tx_date: Column, merchant: Column, cents: Column, currency: Column) -> Column:
    """``- 2024-03-01: Uber (12.34 EUR)``; a missing text prints ``None``."""
    none = F.lit("None")
    return F.format_string(
        "- %s: %s (%.2f %s)",
        F.coalesce(tx_date, none),
        F.coalesce(merchant, none),
        _amount(cents),
        F.coalesce(currency, none),
    )
