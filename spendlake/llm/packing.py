"""Packing by cutting-stock column generation.

Documents become token ids and an end id. A document longer than a sequence
is cut into full sequences and a rest. Lengths are counted in classes of
``GRAIN`` tokens, so the linear program has at most ``SEQUENCE / GRAIN`` rows
whatever the input: its columns are patterns (how many pieces of each class fill a
sequence), found by a knapsack over the dual prices. Rounded patterns take the
pieces of each class by rank, and the rest of the pieces is filled greedily.

NULL and empty texts are the end id alone. Repeated rows are packed each; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import block_count, slices, staged, text_bytes
from spendlake.llm.tokens import encoder

SEQUENCE = 2048
GRAIN = 8
END_ID = 1
#: Stop when the linear program is proven to be this near its optimum.
GAP = 1e-3
#: Pieces that one ranking task holds.
BUCKET_ROWS = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``sequence`` ids (PIECES); ``ids``: the ids themselves, 4 bytes each."""
    names = PIECES.replace(" long", "").split(", ") + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encode = END_ID.to_bytes(4, "little"), encoder(tokenizer_path).encode
        for batch in batches:
            keys, data = batch.column(0).to_pylist(), batch.column(1)
            texts = data.to_pylist()
            for a, b in slices(texts):
                out = [[] for _ in names]
                for key, ids in zip(keys[a:b], encode(texts[a:b])):
                    ids += end
                    for start in range(0, len(ids), 4 * sequence):
                        part = ids[start : start + 4 * sequence]
                        row = (key, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)
                        for column, value in zip(out, row):
                            column.append(value)
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    source = docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text")).alias("data"))
    return source.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def _priced(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern: unbounded knapsack over the class sizes."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        if n:
            values = best[room - sizes[:n]] + prices[:n]
            k = int(values.argmax())
            if values[k] > best[room] + 1e-12:
                best[room], choice[room] = values[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        k = choice[room]
        if k < 0:
            room -= 1
        else:
            pattern[k] += 1
            room -= sizes[k]
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole patterns as (times, pieces of each class) that cover the demand.

    Revised simplex with column generation from one-class patterns; stops at
    Farley's bound. The rounded-down program leaves less than one pattern for
    each class; those pieces are filled greedily, largest first.
    """
    if not len(sizes):
        return []
    fit = (capacity // sizes).astype(float)
    basis, inverse, cost = np.diag(fit), np.diag(1 / fit), np.ones(len(sizes))
    times = demand / fit
    for _ in range(40 * len(sizes)):
        prices = cost @ inverse
        worst = int(prices.argmin())
        if prices[worst] < -1e-9:  # more pieces than needed may be planned
            column, price = np.zeros(len(sizes)), 0.0
            column[worst] = -1
        else:
            value, column = _priced(prices, sizes, capacity)
            price = 1.0
            if value <= 1 + GAP:
                break
        move = inverse @ column
        ratio = np.where(move > 1e-9, times / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        times = np.maximum(times - step * move, 0)
        times[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
    plan, left = [], demand.astype(np.int64).copy()
    for k in np.flatnonzero(cost > 0):
        pattern = basis[:, k].astype(np.int64)
        used = pattern > 0
        n = min(int(times[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if n > 0:
            plan.append((n, pattern))
            left -= n * pattern
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        plan.append((n, pattern))
        left -= n * pattern
    return plan


def _places(plan: list[tuple[int, np.ndarray]], sizes: np.ndarray) -> list[tuple[int, ...]]:
    """Which ranks of a class go to which sequences: (class, first, after, times, first sequence)."""
    taken, sequence, rows = np.zeros(len(sizes), np.int64), 0, []
    for n, pattern in plan:
        for k in np.flatnonzero(pattern):
            after = taken[k] + n * pattern[k]
            rows.append((int(sizes[k]), int(taken[k]), int(after), n, sequence))
            taken[k] = after
        sequence += n
    return rows


def pack(
    docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, grain: int = GRAIN, with_ids: bool = False
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences are gapless from offset 0.

    The pieces are written once; the driver reads their histogram of at most
    ``sequence / grain`` rows and sends back the places of the patterns, a few for each class.
    """
    spark = docs.sparkSession
    cut_docs = cut(docs, tokenizer_path, sequence, with_ids)
    pieces = staged(cut_docs.withColumn("class", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    histogram = sorted((r["class"], r["count"]) for r in pieces.groupBy("class").count().collect())
    sizes = np.array([c for c, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], float)
    places = _places(solve(sizes, demand, sequence // grain), sizes)
    places = spark.createDataFrame(
        places, "class int, first_rank long, after_rank long, times long, first_sequence long"
    )

    buckets = block_count(int(demand.sum()), BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("bucket", "class").count()
    counts = counts.select("bucket", "class", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "class").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["bucket", "class"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "bucket")

    at = F.col("rank") - F.col("first_rank")
    put = ranked.join(
        F.broadcast(places),
        (ranked["class"] == places["class"])
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("after_rank")),
    ).select(
        *(pieces[c] for c in pieces.columns if c not in ("class", "bucket")),
        (F.col("first_sequence") + at % F.col("times")).alias("sequence_id"),
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
