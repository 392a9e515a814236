"""Rows that are not stored yet.

A missing key may be common. Rows without one would all meet in one shuffle
partition, so their join key is one of ``_SPREAD`` stand-ins. A present key
that is hot is split by adaptive execution, as nothing stands between the
exchange of the left side and the join.

Stored keys may also be given as a ``KeySet``, whose side is never exchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.sources.keys import KeySet

_SPREAD = 256


def _present(key: Column) -> Column:
    return F.concat(F.lit("="), key.cast("string"))


def _missing(number: Column) -> Column:
    return F.concat(F.lit("?"), number.cast("string"))


def not_stored(
    df: DataFrame,
    stored: DataFrame | KeySet,
    key: str,
    stored_key: str,
    null_safe: bool = False,
    spread_by: str | None = None,
) -> DataFrame:
    """Rows of ``df`` whose key is not among ``stored``.

    A row without a key is always kept, unless ``null_safe`` is set and
    ``stored`` has a row without a key too. ``spread_by`` names a column that
    differs between rows without a key; the default is the whole row. A key set knows its own
    keys: ``stored_key`` is not used, and ``df`` is read more than once.
    """
    if isinstance(stored, KeySet):
        return stored.missing(df, key, null_safe)
    row = F.col(spread_by) if spread_by else F.struct("*")
    stand_in = _missing(F.pmod(F.xxhash64(row), F.lit(_SPREAD)))
    left = df.withColumn("_key", F.coalesce(_present(F.col(key)), stand_in))
    keys = stored.select(F.col(stored_key).alias("_key"))
    right = keys.filter(F.col("_key").isNotNull()).select(_present(F.col("_key")).alias("_key"))
    if null_safe:
        every = F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1)))
        missing = keys.filter(F.col("_key").isNull()).distinct().select(every.alias("_number"))
        right = right.unionByName(missing.select(_missing(F.col("_number")).alias("_key")))
    return left.join(right, "_key", "left_anti").drop("_key")


def _path_if_any(df: DataFrame) -> str | None:
    return "raw_path" if "raw_path" in df.columns else None


def skip_landed(messages: DataFrame, landed: DataFrame | KeySet) -> DataFrame:
    """Messages whose id has not landed yet."""
    return not_stored(messages, landed, "id", "id", spread_by=_path_if_any(messages))


def without_vector(emails: DataFrame, embeddings: DataFrame | KeySet) -> DataFrame:
    """Mails that have no vector; a mail without an id never has one."""
    return not_stored(emails, embeddings, "id", "email_id", spread_by=_path_if_any(emails))


def without_tx(emails: DataFrame, tx: DataFrame | KeySet) -> DataFrame:
    """Mails that have no transaction; a missing id equals a missing id."""
    return not_stored(
        emails, tx, "id", "email_id", null_safe=True, spread_by=_path_if_any(emails)
    )
