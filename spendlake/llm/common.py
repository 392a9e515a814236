"""Small helpers that several operators share."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.staging import staged  # noqa: F401  (operators import it from here)

#: Python workers hold this many bytes of text at a time.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a driver table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_bytes(column: Column) -> Column:
    """A text as UTF-8 bytes; NULL becomes no bytes."""
    return F.coalesce(F.encode(column.cast("string"), "UTF-8"), F.lit(b""))


def block_count(n_bytes: int | None, block_bytes: int) -> int:
    """Blocks for so many bytes; from the data alone, so that reruns agree."""
    return max(1, -(-int(n_bytes or 0) // block_bytes))


def slices(values: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` of about SLICE_BYTES each; a longer value stands alone."""
    start, held = 0, 0
    for i, value in enumerate(values):
        if held and held + len(value) > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += len(value)
    if start < len(values):
        yield start, len(values)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled (the finaliser of splitmix64); works on a copy."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (runs without ASCII white space), and their starts.

    The hash depends on the bytes of the word only: it is the same on every machine.
    """
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    inside = ~space
    starts = np.flatnonzero(inside & np.r_[True, space[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    lengths = np.diff(np.r_[np.searchsorted(at, starts), len(at)])
    place = at - np.repeat(starts, lengths)
    terms = mixed((place.astype(np.uint64) << np.uint64(8)) | b[at].astype(np.uint64))
    return mixed(np.add.reduceat(terms, np.searchsorted(at, starts))), starts


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def arrow_rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Tuples as a batch; ``schema`` is "name type, name type, ..."."""
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(column, _ARROW[kind]) for column, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def runs(
    df: DataFrame, keys: list[str], act: Callable[[pa.Table], Iterator[tuple]], schema: str, order: Sequence[str] = ()
) -> DataFrame:
    """``act(rows)`` for each run of equal ``keys`` of ``df``, in ``order``.

    One run is held at a time; ``act`` yields tuples of ``schema``.
    """

    def by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finish() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for row in act(pa.Table.from_batches(held)) if held else ():
                out.append(row)
                size += sum(len(x) if isinstance(x, bytes) else 8 for x in row)
                if size > SLICE_BYTES:
                    yield arrow_rows(out, schema)
                    out, size = [], 0
            held.clear()
            if out:
                yield arrow_rows(out, schema)

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            cuts = [i for i in range(1, len(key)) if key[i] != key[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(key)]):
                if start < len(key) and key[start] != last:
                    yield from finish()
                    last = key[start]
                held.append(batch.slice(start, end - start))
        yield from finish()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(by_run, schema)
