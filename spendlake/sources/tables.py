"""The three tables: read, and append of new rows.

A table has a folder for each run that appended to it. An append writes its run's
folder whole, so a run that is tried again leaves what one run would have
left; its rows are then to be worked out from the table without that run (``but``). With key sets an append also leaves out rows whose key another run has stored.
"""

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake import schemas
from spendlake.functions.dates import canonical_day
from spendlake.operators.dedup import first_by_key
from spendlake.schemas import NO_MONTH, ODD_MONTH
from spendlake.sources.keys import KeySet, run_path
from spendlake.staging import staged

def read_runs(spark: SparkSession, path: str, schema: T.StructType, but: str | None = None) -> DataFrame:
    """All runs of a table, without the run ``but``: what a run that is tried again has to start from."""
    if but is None:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    with_run = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    return spark.read.schema(with_run).parquet(path).filter(F.col("run") != but).select(*schema.names)


def create_runs(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table where there is none."""
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
    empty.write.mode("ignore").partitionBy("run").parquet(path)


def append_run(rows: DataFrame, path: str, run: str, by: str | None = None) -> None:
    """Write ``rows`` as those of ``run``, in place of any that it wrote before."""
    write = rows.write.mode("overwrite")
    (write.partitionBy(by) if by else write).parquet(run_path(path, run))


def create_tables(spark: SparkSession, emails: str, embeddings: str, tx: str) -> None:
    """Write empty tables where there are none."""
    for path, schema in ((emails, schemas.EMAILS), (embeddings, schemas.EMBEDDINGS), (tx, STORED_TX)):
        create_runs(spark, path, schema)


STORED_TX = T.StructType(
    schemas.TX.fields
    + [T.StructField("tx_day", T.DateType()), T.StructField("tx_month", T.StringType())]
)


def read_emails(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    return read_runs(spark, path, schemas.EMAILS, but)


def read_embeddings(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    return read_runs(spark, path, schemas.EMBEDDINGS, but)


def read_tx(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    return read_runs(spark, path, STORED_TX, but)


def new_run() -> str:
    """A name that no other run has."""
    return uuid.uuid4().hex


def _unstored(rows: DataFrame, keys: Mapping[str, KeySet], run: str) -> DataFrame:
    """Rows whose keys no other run has stored; the first of each key. A missing key is never equal to another.

    What several keys leave is written between them, as each reads it more than once.
    """
    for column, stored in keys.items():
        rows = staged(rows, "append")
        given = first_by_key(rows.filter(F.col(column).isNotNull()), [column], [F.xxhash64(F.struct("*"))])
        rows = stored.missing(given.unionByName(rows.filter(F.col(column).isNull())), column, but=run)
    return rows


def _append(rows: DataFrame, path: str, run: str | None, keys: Mapping[str, KeySet] | None, by: str | None = None) -> None:
    """Append ``rows``; then the keys, so that a run that breaks off between them mends it when tried again."""
    run = run or new_run()
    if keys:
        rows = staged(_unstored(rows, keys, run), "append")
    append_run(rows.hint("rebalance", by) if by else rows, path, run, by)
    for column, stored in (keys or {}).items():
        stored.add(rows, column, run)


def append_emails(
    new: DataFrame, path: str, run: str | None = None, keys: Mapping[str, KeySet] | None = None
) -> None:
    """``keys``: the sets of stored ``id`` and ``content_hash``."""
    _append(new.select(*schemas.EMAILS.names), path, run, keys)


def append_embeddings(
    new: DataFrame, path: str, run: str | None = None, keys: Mapping[str, KeySet] | None = None
) -> None:
    """Rows without a vector are left out, and so tried again next time. ``keys``: the set of stored ``email_id``."""
    rows = new.select("email_id", F.col("vector").cast("array<float>").alias("vector"))
    _append(rows.filter(F.col("vector").isNotNull()), path, run, keys)


def with_day(tx: DataFrame) -> DataFrame:
    """Add the day of the date text and its month, for pruning.

    Date text that is no plain day has no day, and is kept under the month ODD_MONTH,
    which every dated query also reads. Rows without a date are kept under NO_MONTH,
    which no dated query reads. The month is cut from the text, so that a day is parsed once, and never printed.
    """
    month = F.when(F.col("tx_day").isNotNull(), F.substring("tx_date", 1, 7)).otherwise(ODD_MONTH)
    month = F.when(F.col("tx_date").isNull(), NO_MONTH).otherwise(month)
    return tx.withColumn("tx_day", canonical_day(F.col("tx_date"))).withColumn("tx_month", month)


def append_tx(new: DataFrame, path: str, run: str | None = None, keys: Mapping[str, KeySet] | None = None) -> None:
    """Append by month. A month with many rows is split over several files. ``keys``: the set of stored ``id``."""
    _append(with_day(new.select(*schemas.TX.names)), path, run, keys, by="tx_month")
