"""A stored ledger: transactions by month, with what many questions need kept beside them.

Each append also keeps, for its run: the pieces of its merchants' names (so that a pattern is
looked up without reading transactions), and its totals per day and per month. A run that is
tried again replaces all of it. Summaries of runs add up when they are read.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.operators import match
from spendlake.sources import tables
from spendlake.sources.keys import KeySet, run_path

_PIECES = T.StructType().add("merchant", "string").add("name", "string").add("piece", "string").add("piece_bucket", "integer")
_DAYS = T.StructType().add("tx_month", "string").add("tx_date", "string").add("currency", "string").add("amount_cents", "long")
_MONTHS = T.StructType().add("tx_month", "string").add("currency", "string").add("amount_cents", "long")


@dataclass(frozen=True)
class Ledger:
    """Transactions and their summaries under ``path``; ids are unique if ``buckets`` of stored ids are kept."""

    spark: SparkSession
    path: str
    buckets: int | None = None

    def _keys(self) -> dict[str, KeySet] | None:
        return {"id": KeySet(self.spark, f"{self.path}/ids", self.buckets)} if self.buckets else None

    def create(self) -> "Ledger":
        """Empty tables where there are none."""
        for name, schema in (("tx", tables.STORED_TX), ("pieces", _PIECES), ("days", _DAYS), ("months", _MONTHS)):
            tables.create_runs(self.spark, f"{self.path}/{name}", schema)
        return self

    def append(self, new: DataFrame, run: str | None = None) -> None:
        """Append transactions, and the pieces and totals of those that were added."""
        run = run or tables.new_run()
        tables.append_tx(new, f"{self.path}/tx", run, self._keys())
        added = self.spark.read.schema(tables.STORED_TX).parquet(run_path(f"{self.path}/tx", run))
        pieces = match.merchant_pieces(added.select("merchant").distinct())
        pieces = pieces.withColumn("piece_bucket", match.piece_bucket(F.col("piece"))).hint("rebalance", "piece_bucket")
        tables.append_run(pieces, f"{self.path}/pieces", run, by="piece_bucket")
        days = added.groupBy("tx_month", "tx_date", "currency").agg(F.sum("amount_cents").alias("amount_cents"))
        tables.append_run(days, f"{self.path}/days", run)
        written = self.spark.read.schema(_DAYS).parquet(run_path(f"{self.path}/days", run))
        months = written.groupBy("tx_month", "currency").agg(F.sum("amount_cents").alias("amount_cents"))
        tables.append_run(months, f"{self.path}/months", run)

    def read(self) -> DataFrame:
        return tables.read_tx(self.spark, f"{self.path}/tx")

    def summaries(self) -> match.Summaries:
        read = lambda name, schema: tables.read_runs(self.spark, f"{self.path}/{name}", schema)
        return match.Summaries(read("days", _DAYS), read("months", _MONTHS))

    def keys(self, questions: DataFrame) -> match.Keys:
        """Join keys of ``questions``, without a read of the transactions."""
        pieces = tables.read_runs(self.spark, f"{self.path}/pieces", _PIECES)
        months = self.summaries().months.select(F.col("tx_month").alias("month")).distinct()
        return match.keys_in(questions, pieces, months)

    def totals(self, questions: DataFrame) -> DataFrame:
        """``qid, currency, total``: open questions from the summaries, others from one read of their months."""
        return match.totals_from(self.keys(questions), self.read(), self.summaries())

    def transactions(self, questions: DataFrame) -> DataFrame:
        """Every transaction that each question asks for, with its ``qid``."""
        return match.transactions_of(self.keys(questions), self.read())
