"""Stored keys: what is there already, kept so that a look-up does not move it.

A key set is a bucketed table of hashes of keys, with a partition for each run that added
some. New rows are exchanged to the buckets and meet them there; the stored side is read in
place, by buckets. Before that, rows go past a Bloom filter: blocks of bits kept beside the
keys, one bitmap a block. A row that the filter does not know is
new for certain and is never exchanged. The filter has a fixed size, so
it can go to every task; beyond the keys it is made for it is left out.

Adding is a commit keyed by its run: a run that is added again replaces what it added
before, so a retry changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that a key sets, all in one block of 4 KB.
_BITS = 4
_BLOCK_BITS = 32768
#: Keys for each block at which about one in a hundred unknown keys passes.
_KEYS_A_BLOCK = 3300
#: The largest filter that is sent to all tasks: 64 MB.
_MOST_BLOCKS = 16384
_FILTER = "block INT, bits BINARY, n_keys BIGINT, run STRING"
#: Stands for a missing key.
_MISSING = "NULL"


def _text(key: Column) -> Column:
    return F.concat(F.lit("="), key.cast("string"))


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key; a missing key has bits of its own."""
    text = F.coalesce(_text(key), F.lit(_MISSING))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _block(blocks: int) -> Column:
    return F.pmod("h2", F.lit(blocks)).cast("int")


def _places(n: int = _BITS) -> list[Column]:
    """Bits of a key in its block."""
    return [F.pmod(F.xxhash64("h1", F.lit(i)), F.lit(_BLOCK_BITS)).cast("int") for i in range(n)]


def _bit(bitmap: str, place: Column) -> Column:
    """Whether a bit is set in a bitmap of ``bitmap_construct_agg``."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


def run_path(path: str, run: str) -> str:
    """The folder of a run in a table that is partitioned by runs."""
    return f"{path}/run={quote(run, safe='')}"


@dataclass(frozen=True)
class KeySet:
    """Keys stored under ``path``, in ``buckets`` buckets, with a filter of ``blocks`` blocks.

    ``buckets`` and ``blocks`` belong to the layout: a set is opened with the numbers it was made with.
    """

    spark: SparkSession
    path: str
    buckets: int = 64
    blocks: int = 256

    @property
    def _name(self) -> str:
        return f"keys_{hashlib.md5(self.path.encode()).hexdigest()}_{self.buckets}"

    @property
    def _filter_path(self) -> str:
        return f"{self.path}/filter_{self.blocks}"

    def _open(self) -> str:
        """The catalog's name of the bucketed table; other sessions' runs are found too."""
        columns, place = "h1 BIGINT, h2 BIGINT, run STRING", f"{self.path}/keys_{self.buckets}"
        self.spark.createDataFrame([], columns).write.mode("ignore").partitionBy("run").parquet(place)
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self._name}` ({columns}) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.catalog.recoverPartitions(self._name)
        self.spark.catalog.refreshTable(self._name)
        return self._name

    def keys(self, but: str | None = None) -> DataFrame:
        """``h1, h2`` of the stored keys, but for those of the run ``but``."""
        stored = self.spark.table(self._open())
        return (stored if but is None else stored.filter(F.col("run") != but)).select("h1", "h2")

    def add(self, df: DataFrame, key: str, run: str) -> None:
        """Store the keys of ``df`` as those of ``run``, in place of any that it stored before."""
        fresh = df.select(*_hashes(F.col(key))).distinct()
        name = self._open()
        dealt = fresh.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        into = f"INSERT OVERWRITE TABLE `{name}` PARTITION (run = {{run}}) SELECT h1, h2 FROM {{rows}}"
        self.spark.sql(into, run=run, rows=dealt)
        written = self.spark.table(name).filter(F.col("run") == run)
        place = F.explode(F.array(*_places()))
        bits = written.select(_block(self.blocks).alias("block"), place.alias("place"))
        bits = bits.groupBy("block").agg(
            F.bitmap_construct_agg("place").alias("bits"), (F.count("*") / _BITS).cast("long").alias("n_keys")
        )
        bits.write.mode("overwrite").parquet(run_path(self._filter_path, run))

    def _filter(self, but: str | None) -> DataFrame | None:
        """``block, bits`` of all runs; None where there is no use in them."""
        if self.blocks > _MOST_BLOCKS:
            return None
        self.spark.createDataFrame([], _FILTER).write.mode("ignore").partitionBy("run").parquet(self._filter_path)
        parts = self.spark.read.schema(_FILTER).parquet(self._filter_path)
        parts = parts if but is None else parts.filter(F.col("run") != but)
        if (parts.agg(F.sum("n_keys")).first()[0] or 0) > self.blocks * _KEYS_A_BLOCK:
            return None
        return parts.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _has_missing(self, but: str | None) -> bool:
        """Whether a missing key is stored."""
        missing = self.spark.range(1).select(*_hashes(F.lit(None).cast("string")))
        return not self.keys(but).join(missing, ["h1", "h2"], "left_semi").isEmpty()

    def missing(self, df: DataFrame, key: str, null_safe: bool = False, but: str | None = None) -> DataFrame:
        """Rows of ``df`` whose key is not stored (by a run other than ``but``).

        A row without a key is always kept, unless ``null_safe`` is set and a missing key is stored.
        ``df`` is read more than once: write it first if it is costly.
        """
        columns = [F.col(f"`{c}`") for c in df.columns]
        if null_safe and self._has_missing(but):
            df = df.filter(F.col(key).isNotNull())
        keyed = df.filter(F.col(key).isNotNull()).select(*columns, *self._hashed(key))
        parts, filter_ = [df.filter(F.col(key).isNull())], self._filter(but)
        if filter_ is not None:
            keyed = self._passed(keyed, filter_)
            parts.append(keyed.filter("NOT known").select(*columns))
            keyed = keyed.filter("known").drop("known")
        parts.append(keyed.join(self.keys(but), ["h1", "h2"], "left_anti").select(*columns))
        return reduce(DataFrame.unionByName, parts)

    def _hashed(self, key: str) -> list[Column]:
        return _hashes(F.col(key))

    def _passed(self, keyed: DataFrame, filter_: DataFrame) -> DataFrame:
        """``keyed`` with ``known``: whether the filter holds all bits of the key."""
        # At most _MOST_BLOCKS bitmaps of 4 KB.
        found = keyed.withColumn("block", _block(self.blocks)).join(F.broadcast(filter_), "block", "left")
        known = reduce(lambda a, b: a & b, (_bit("bits", place) for place in _places()))
        return found.withColumn("known", F.coalesce(known, F.lit(False))).drop("block", "bits")
