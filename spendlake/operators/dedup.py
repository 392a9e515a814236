"""Key enforcement: first row wins.

Stored keys come as a frame, or as a ``KeySet`` whose side is never exchanged.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.sources.keys import KeySet
from spendlake.staging import staged


def _not_stored(df: DataFrame, stored: DataFrame | KeySet, key: str) -> DataFrame:
    if isinstance(stored, KeySet):
        return stored.missing(df, key)
    return df.join(stored.select(key), key, "left_anti").select(df.columns)


def first_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key.

    The rank filter is applied before the shuffle as well (a window group
    limit), so each task sends one row per key at most, however hot the key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def first_by_hash(df: DataFrame, stored: DataFrame | KeySet, order: str = "raw_path") -> DataFrame:
    """Drop mails whose body is stored already or came earlier in the batch.

    The batch is reduced first, so no hash is hot when it meets the stored ones.
    """
    return _not_stored(first_by_key(df, ["content_hash"], [order]), stored, "content_hash")


def enforce_tx_key(new: DataFrame, stored: DataFrame | KeySet, order: list[Column | str]) -> DataFrame:
    """Drop transactions whose id is stored or came earlier in the batch."""
    return _not_stored(first_by_key(new, ["id"], order), stored, "id")


def _rival(key: str, order: str, name: str) -> list[Column]:
    """128 bits of a key; a row without one has bits of its own."""
    text = F.coalesce(F.concat(F.lit("key "), F.col(key)), F.concat(F.lit("row "), F.col(order)))
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit(1), text).alias(f"{name}2")]


def _numbered(offered: DataFrame, one: str, two: str, order: str) -> DataFrame:
    """``offered`` with ``pos``, its number in the order that rows are offered in, and hashed keys."""
    first = F.conv(F.substring(F.sha2(order, 256), 1, 15), 16, 10).cast("long").alias("_first")
    rows = offered.select(order, "n", *_rival(one, order, "a"), *_rival(two, order, "b"), first)
    # After a global sort these ids grow with the order; written once, they stay.
    rows = rows.orderBy("_first", order).withColumn("pos", F.monotonically_increasing_id())
    return staged(rows.drop("_first"), "places")


def accepted_by_two_keys(
    df: DataFrame, stored: DataFrame | tuple[KeySet, KeySet], one: str, two: str, order: str
) -> DataFrame:
    """``order`` of the rows that ``first_by_two_keys`` accepts, and ``n``, how many rows of ``df`` have it. A narrow written table."""
    sides = stored if isinstance(stored, tuple) else (stored, stored)
    offered = df.groupBy(order).agg(F.min(F.struct(one, two)).alias("_keys"), F.count("*").alias("n"))
    offered = offered.select(order, "n", f"_keys.{one}", f"_keys.{two}")
    for side, key in zip(sides, (one, two)):
        if isinstance(side, KeySet):
            offered = side.missing(staged(offered, "offered"), key)
        else:
            # Rows without a key are spread by a key of their own.
            stored_keys = side.select(F.concat(F.lit("key "), F.col(key)).alias("_key"))
            own = F.coalesce(F.concat(F.lit("key "), F.col(key)), F.concat(F.lit("row "), F.col(order)))
            offered = offered.withColumn("_key", own).join(stored_keys, "_key", "left_anti").drop("_key")
    places = _numbered(offered, one, two, order)
    left, accepted = places.select("pos", "a1", "a2", "b1", "b2"), df.sparkSession.createDataFrame([], "pos long")
    while not left.isEmpty():
        first_a = left.groupBy("a1", "a2").agg(F.min("pos").alias("pos"))
        first_b = left.groupBy("b1", "b2").agg(F.min("pos").alias("pos"))
        won = staged(first_a.join(first_b, "pos"), "accepted")
        accepted = accepted.unionByName(won.select("pos"))
        rest = left.join(won.select("a1", "a2"), ["a1", "a2"], "left_anti")
        rest = rest.join(won.select("b1", "b2"), ["b1", "b2"], "left_anti")
        left = staged(rest, "rivals")
    return staged(places.join(accepted.select("pos"), "pos", "left_semi").select(order, "n"), "kept")


def first_by_two_keys(
    df: DataFrame, stored: DataFrame | tuple[KeySet, KeySet], one: str, two: str, order: str
) -> DataFrame:
    """Rows accepted when each is offered in turn and both keys are unique.

    A row is rejected by a stored row, or by an earlier row that was itself
    accepted, with the same ``one`` or the same ``two``. A NULL key is
    never equal to another. Rows are offered in order of a hash of ``order``, then of
    ``order`` itself: any order will do, and this one breaks chains of rivals,
    so that a few rounds settle them however long they are. Of rows that
    repeat an ``order``, the first by its keys is offered. ``stored`` is a frame with both keys, or a set of each.

    Every round accepts all rows that come first under both of their keys and
    removes their rivals. Only numbers take part (places, and 128 bits of each key), and every round is a
    written table. ``df`` is read twice, so it should be a written table; a third time only if an ``order`` repeats.
    """
    return rows_of(df, accepted_by_two_keys(df, stored, one, two, order), one, two, order)


def rows_of(df: DataFrame, kept: DataFrame, one: str, two: str, order: str) -> DataFrame:
    """The rows of ``df`` that were accepted; of rows that repeat an ``order``, the first by its keys."""
    once = df.join(kept.filter("n = 1").select(order), order, "left_semi").select(df.columns)
    again = kept.filter("n > 1").select(order)
    if again.isEmpty():
        return once
    repeated = first_by_key(df.join(again, order, "left_semi").select(df.columns), [order], [one, two])
    return once.unionByName(repeated)
