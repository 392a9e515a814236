"""Training-order materialisation of token sequences.

The documents that a task reads become one stream of token ids (an end id after each
document), cut into sequences of a fixed length; the last of a task is padded.
Sequences are numbered densely, and a keyed Feistel permutation with cycle-walking gives each a
slot of its own among as many slots. Ranges of slots are shards: files in which each sequence
takes the same number of bytes (16-bit ids), so slot s lies at
``(s - first) * stride``, and a reader can go on from any slot without an index.

A shard is written under another name and then moved: a task that is lost and run
again writes the same bytes. NULL and empty texts are the end id alone. Repeated
rows are written each; an empty table gives no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_rows, mixed, runs, slices, staged, text_bytes
from spendlake.llm.tokens import encoder
from spendlake.staging import file_system, qualified

SEQUENCE = 1024
END_ID = 1
PAD_ID = 0
#: Sequences that are sent on at a time.
ROWS = 1024
#: Sequences in a shard (16 MB).
SHARD_SEQUENCES = 8192
#: Blocks that are numbered together.
FAN_IN = 1000
ROUNDS = 6


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The slot of each index: a bijection of ``0 .. size - 1`` that depends on ``key``.

    A balanced Feistel network over the least even number of bits; an image
    outside the range is permuted again until it falls inside.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mixed(np.uint64(key % 2**64) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    slots = np.asarray(index, np.uint64).copy()
    walking = np.arange(len(slots))
    while len(walking):
        left, right = slots[walking] >> np.uint64(half), slots[walking] & low
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & low)
        slots[walking] = (left << np.uint64(half)) | right
        walking = walking[slots[walking] >= np.uint64(size)]
    return slots.astype(np.int64)


def _narrow(data: bytes) -> np.ndarray:
    """Ids of 32 bits in 16; a vocabulary that needs more is an error."""
    ids = np.frombuffer(data, "<u4")
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit in 16 bits")
    return ids.astype("<u2")


def sequences(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, squeezed: bool = False) -> DataFrame:
    """``block, number, ids, n_ids, doc_id, start``: numbered within each block.

    ``ids`` are 16-bit, padded; ``doc_id`` and ``start`` say where the sequence begins. With ``squeezed`` the ids
    are compressed (zstd). A block is what one task reads, in its order: texts are not moved. So the numbers
    depend on how Spark splits the input; the result is to be written, and read from there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("data"))
    schema = "block long, number long, ids binary, n_ids long, doc_id long, start long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode, end = encoder(tokenizer_path).encode, np.array([END_ID], "<u2")
        sent = zstandard.ZstdCompressor(level=3).compress if squeezed else bytes
        block = TaskContext.get().partitionId()
        held, size, origin, number = [], 0, None, 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("data").to_pylist()
            encoded = (pair for a, b in slices(texts) for pair in zip(ids[a:b], encode(texts[a:b])))
            for doc_id, data in encoded:
                piece, at = np.concatenate([_narrow(data), end]), 0
                while at < len(piece):
                    origin = origin or (doc_id, at)
                    part = piece[at : at + length - size]
                    held.append(part)
                    size += len(part)
                    at += len(part)
                    if size == length:
                        yield block, number, sent(np.concatenate(held).tobytes()), length, *origin
                        held, size, origin, number = [], 0, None, number + 1
        if size:
            full = np.full(length, PAD_ID, "<u2")
            full[:size] = np.concatenate(held)
            yield block, number, sent(full.tobytes()), size, *origin

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = cut(batches)
        while part := list(islice(found, ROWS)):
            yield arrow_rows(part, schema)

    return rows.mapInArrow(stream, schema)


def numbered(found: DataFrame) -> tuple[DataFrame, int]:
    """``found`` (written) with a dense ``index`` in order of block and number, and how many there are."""
    counts = found.groupBy("block").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("block") / FAN_IN))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    ahead = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row for each FAN_IN blocks
    groups = groups.select("group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, "group")
    # Written, so that Spark knows its size: one row a task, which lets the sequences stay where they are.
    counts = staged(counts.select("block", (F.col("before") + F.col("inside")).alias("before")), "blocks")
    out = found.join(counts, "block").withColumn("index", F.col("before") + F.col("number")).drop("before")
    return out, found.count()


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def materialise(
    docs: DataFrame, tokenizer_path: str, folder: str, key: int = 2024, length: int = SEQUENCE,
    shard_sequences: int = SHARD_SEQUENCES,
) -> DataFrame:
    """Writes the shards to ``folder`` (one that all executors share) and returns one row per sequence:

    ``slot, shard, byte_offset, index, n_ids, ids_crc32, doc_id, start``.
    """
    folder = qualified(docs.sparkSession, folder)
    found = staged(sequences(docs, tokenizer_path, length, squeezed=True), "sequences")
    found, total = numbered(found)

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), total, key))

    placed = found.withColumn("slot", slot("index"))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard_sequences))

    def write(table: pa.Table) -> Iterator[tuple]:
        shard = table.column("shard")[0].as_py()
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        path = shard_path(base, shard)
        draft = f"{path}.{np.random.default_rng().integers(2**62):x}"
        restore = zstandard.ZstdDecompressor().decompress
        data = [restore(ids) for ids in table.column("ids").to_pylist()]
        with files.open_output_stream(draft) as out:
            for ids in data:
                out.write(ids)
        files.move(draft, path)
        names = ("slot", "index", "n_ids", "doc_id", "start")
        for i, (ids, row) in enumerate(zip(data, zip(*(table.column(c).to_pylist() for c in names)))):
            at, index, n, doc_id, start = row
            yield at, shard, i * 2 * length, index, n, zlib.crc32(ids), doc_id, start

    schema = "slot long, shard long, byte_offset long, index long, n_ids long, ids_crc32 long, doc_id long, start long"
    return runs(placed, ["shard"], write, schema, ["slot"])


def read_from(folder: str, slot: int, length: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in order of slot, by sequential reads."""
    files, base = file_system(folder)
    shard, skip = divmod(slot, shard_sequences)
    while files.get_file_info(shard_path(base, shard)).type == pyarrow.fs.FileType.File:
        with files.open_input_file(shard_path(base, shard)) as data:
            data.seek(skip * 2 * length)
            while record := data.read(2 * length):
                yield np.frombuffer(record, "<u2")
        shard, skip = shard + 1, 0
