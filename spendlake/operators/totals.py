"""Aggregates. Each is partial before the shuffle, so a hot group is no hot task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_by_currency(tx: DataFrame) -> DataFrame:
    """Cents per currency; a missing currency is a group of its own."""
    return tx.groupBy("currency").agg(F.sum("amount_cents").alias("total"))


def import_summary(parsed: DataFrame, imported: DataFrame) -> DataFrame:
    """How many messages were imported, skipped as duplicates, and unreadable."""
    offered = parsed.select(F.when(F.col("error").isNull(), "readable").otherwise("error"))
    stage = F.col("stage")
    return (
        offered.toDF("stage")
        .union(imported.select(F.lit("imported")))
        .agg(
            F.count_if(stage == "imported").alias("imported"),
            (F.count_if(stage == "readable") - F.count_if(stage == "imported")).alias("skipped"),
            F.count_if(stage == "error").alias("errors"),
        )
    )


def ledger_summary(emails: DataFrame, waiting: DataFrame, added: DataFrame) -> DataFrame:
    """Mails in all, candidates by keyword, processed (long enough) and added.

    ``waiting`` are the candidates without a transaction, with ``long``. A candidate with a short
    body is not processed. Mails are counted without reading a column.
    """
    stage = F.col("stage")
    return (
        waiting.select(F.when(F.col("long"), "long candidate").otherwise("short candidate").alias("stage"))
        .union(emails.select(F.lit("mail")))
        .union(added.select(F.lit("added")))
        .agg(
            F.count_if(stage == "mail").alias("mails"),
            F.count_if(stage.isin("long candidate", "short candidate")).alias("candidates"),
            F.count_if(stage == "long candidate").alias("processed"),
            F.count_if(stage == "added").alias("added"),
        )
    )
