"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Vectors are dealt to lists by their nearest centre (fitted on a bounded sample,
``sample_rows``); every vector is indexed. Vectors and queries, scaled to length one, are turned to the principal
axes of the sample and kept in blocks of dimensions. Within each list that a query probes, the scan adds one block at a
time to the partial products; after each, a candidate goes where the unseen dimensions cannot reach a bound
(their product is at most that of their lengths): the query's 20th best score within a part of the sample, which the
true ones are not below. So the scan itself loses nothing, whatever the rows are; the axes only decide how
soon it is done. What is left is scored exactly, in double precision, on the original vectors.

How many lists to probe is measured: the exact neighbours of a bounded sample of
queries (``tuning_queries``) are found among all vectors, and the fewest lists that hold
``target`` of them are probed.

Vectors that are NULL, zero, or hold NULL or non-finite components take no part,
nor do those of another length than the most frequent one, or without id. Rows with one
id and one score count once; a query skips rows with its id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_rows, runs, staged

TOP = 20
SAMPLE_ROWS = 20_000
TUNING_QUERIES = 128
TARGET = 0.97
#: Dimensions in a block.
BLOCK = 16
#: Above this share of live pairs a block is one matrix product; below it only they are weighed.
DENSE = 0.1
#: Vectors, and queries, that one scan holds, and pairs that it weighs at a time.
PART_ROWS, PART_QUERIES, PAIRS = 20_000, 4_000, 1 << 20
#: Rows of the sample that give each query its first bound.
BOUND_ROWS = 4096
MOST_LISTS = 1024


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` (array of doubles) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (lengths["n"] if lengths else 0))


def centres(sample: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of the sample by Lloyd's method."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(sample, found)
        sums, counts = np.zeros_like(found), np.bincount(nearest, minlength=lists)
        np.add.at(sums, nearest, sample)
        used = counts > 0
        found[used] = sums[used] / counts[used, None]
    return found


def _nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return (x @ found.T - (found**2).sum(1) / 2).argmax(1)


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str = "<f8") -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows (or one row); equal rows get equal scores."""
    return (x * q).sum(1)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, of very small and very large numbers too."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _tails(x: np.ndarray, starts: range) -> np.ndarray:
    """Lengths of rows from each of ``starts`` on, and 0 after the last."""
    return np.stack([*(np.sqrt((x[:, s:] ** 2).sum(1)) for s in starts), np.zeros(len(x), x.dtype)], axis=1)


def principal_axes(unit: np.ndarray) -> np.ndarray:
    """Orthogonal axes of rows of length one, those along which the rows are longest first."""
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:top]


def _top_of_each(query: np.ndarray, scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Positions of the best ``top`` of each query, by query, score and id."""
    order = np.lexsort((ids, -scores, query))
    ordered = query[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else order
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < top]


def scan(x: np.ndarray, rotated: np.ndarray, ids: np.ndarray, queries: np.ndarray, turned: np.ndarray,
         query_ids: np.ndarray, bounds: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of the best rows for each query, by the adaptive dimension scan.

    ``x`` and ``queries`` are the original vectors, ``rotated`` and ``turned`` those of length one on other
    axes. ``bounds``: scores that the ``top`` best of a query are known to reach.
    """
    starts = range(0, x.shape[1], BLOCK)
    tails, lengths = _tails(rotated, starts), _tails(turned, starts)
    norms, reach = _lengths(x), bounds / _lengths(queries)
    slack = 1e-7 * (x.shape[1] + 100)  # more than products of single precision are off
    found = []
    width = max(1, PAIRS // len(x))
    for a in range(0, len(queries), width):
        q = np.arange(a, min(a + width, len(queries)))
        limit = reach[q] / norms[:, None] - slack
        live = ids[:, None] != query_ids[q]
        partial, b = np.zeros(limit.shape, np.float32), 0
        while b < len(starts) and live.mean() > DENSE:
            block = slice(starts[b], starts[b] + BLOCK)
            partial += rotated[:, block] @ turned[q, block].T
            b += 1
            live &= ~(partial + np.outer(tails[:, b], lengths[q, b]) < limit)
        row, column = np.nonzero(live)
        partial, query, limit = partial[row, column], q[column], limit[row, column]
        for b in range(b, len(starts)):
            block = slice(starts[b], starts[b] + BLOCK)
            partial = partial + _scores(rotated[row, block], turned[query, block])
            keep = ~(partial + tails[row, b + 1] * lengths[query, b + 1] < limit)
            row, query, partial, limit = row[keep], query[keep], partial[keep], limit[keep]
        exact = _scores(x[row], queries[query])
        best = _top_of_each(query, exact, ids[row], top)
        found.append((query[best], ids[row][best], exact[best]))
    return tuple(np.concatenate(part) for part in zip(*found))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    top: int = TOP,
    target: float = TARGET,
    sample_rows: int = SAMPLE_ROWS,
    tuning_queries: int = TUNING_QUERIES,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest vectors found for each query, nearest first."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_column, vector_column).distinct(), "ann-vectors")  # repeated rows count once
    asked = rows.join(queries.select(F.col(id_column).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    total = rows.count()
    result = "query_id long, vec_id long, score double"
    if not total:
        return _ranked(spark.createDataFrame([], result), top)
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows)
    taken = chosen.toPandas()
    sample, sample_ids = np.stack(taken["vector"].to_numpy()), taken["vec_id"].to_numpy()
    lists = int(min(len(sample), MOST_LISTS, max(1, round(np.sqrt(total)))))
    middle = centres(sample, lists, seed)
    turn = principal_axes(sample / _lengths(sample)[:, None])
    some = (sample[:BOUND_ROWS], sample_ids[:BOUND_ROWS])
    shared = spark.sparkContext.broadcast((middle, turn, some))  # MOST_LISTS, BOUND_ROWS and one for each dimension: so many rows

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, turned, _ = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            if len(x):
                near = _nearest(x, found).tolist()
                rotated = (x / _lengths(x)[:, None] @ turned).astype("<f4")
                ids = batch.column(0).to_pylist()
                rows = [(n, i, a.tobytes(), r.tobytes()) for n, i, a, r in zip(near, ids, x, rotated)]
                yield arrow_rows(rows, "list long, vec_id long, vector binary, rotated binary")

    index = rows.mapInArrow(indexed, "list long, vec_id long, vector binary, rotated binary")
    index = staged(index, "ann-index")
    picked = staged(index.join(asked.select("vec_id").distinct(), "vec_id", "left_semi"), "ann-queries")
    probes = _probes(index, picked, middle, top, target, tuning_queries, seed)

    columns = "list long, vec_id long, vector binary, rotated binary"

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _, (near, near_ids) = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(2)), batch.column(0).to_numpy()
            scores = x @ near.T
            scores[ids[:, None] == near_ids] = -np.inf
            known = np.partition(scores, -top, axis=1)[:, -top] if len(near) >= top else np.full(len(x), -np.inf)
            lists = np.argsort(-(x @ found.T), axis=1, kind="stable")[:, :probes]
            rows = zip(ids.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), known.tolist(), lists)
            pairs = [(int(n), i, v, r, k) for i, v, r, k, own in rows for n in own]
            yield arrow_rows(pairs, columns + ", bound double")

    def seeding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, near_ids = shared.value[2]
        for batch in batches:
            out = []
            for query_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scores = _scores(near, np.frombuffer(data, "<f8"))
                best = _best(np.where(near_ids == query_id, -np.inf, scores), near_ids, top)
                out.extend((query_id, int(near_ids[i]), float(scores[i])) for i in best if near_ids[i] != query_id)
            yield arrow_rows(out, result)

    # What gave a query its bound is found in any case.
    seeds = picked.select("vec_id", "vector").mapInArrow(seeding, result)
    probed = picked.select("vec_id", "list", "vector", "rotated").mapInArrow(probing, columns + ", bound double")
    # Long lists, and lists that many queries probe, are scanned in parts.
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    shares = probed.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).alias("shares"))
    sizes = staged(parts.join(shares, "list"), "ann-parts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = index.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    stored = stored.withColumn("share", every("shares")).withColumn("bound", F.lit(None).cast("double"))
    asking = probed.join(sizes, "list").withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("shares")))
    asking = asking.withColumn("part", every("parts"))
    names = ["list", "part", "share", "bound", "vec_id", "vector", "rotated"]

    def scanned(table: pa.Table) -> Iterator[tuple]:
        bound = table.column("bound").to_pandas().to_numpy(float)
        query = ~np.isnan(bound)  # stored vectors have no bound
        ids = table.column("vec_id").to_numpy()
        if query.all() or not query.any():
            return
        x, rotated = _matrix(table.column("vector")), _matrix(table.column("rotated"), "<f4")
        own = (x[~query], rotated[~query], ids[~query])
        numbers, found, scores = scan(*own, x[query], rotated[query], ids[query], bound[query], top)
        yield from zip(ids[query][numbers].tolist(), found.tolist(), scores.tolist())

    both = stored.select(*names).union(asking.select(*names))
    return _ranked(runs(both, ["list", "part", "share"], scanned, result).union(seeds).distinct(), top)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_neighbours(index: DataFrame, queries: list, top: int) -> DataFrame:
    """``query_id, vec_id, score, list``: the true neighbours of a few queries among all vectors."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lists = _matrix(batch.column(2)), batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            out = []
            for query_id, data in shared.value:
                scores = _scores(x, np.frombuffer(data, "<f8"))
                scores[ids == query_id] = -np.inf
                for i in _best(scores, ids, top).tolist():
                    if np.isfinite(scores[i]):
                        out.append((query_id, int(ids[i]), float(scores[i]), int(lists[i])))
            yield arrow_rows(out, "query_id long, vec_id long, score double, list long")

    found = index.mapInArrow(nearest, "query_id long, vec_id long, score double, list long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _probes(index: DataFrame, picked: DataFrame, middle: np.ndarray, top: int, target: float, most: int, seed: int) -> int:
    """The fewest lists that hold ``target`` of the true neighbours of a bounded sample of queries."""
    sample = picked.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(most).select("vec_id", "vector").collect()
    if not sample:
        return 1
    order = {}
    for r in sample:
        near = np.argsort(-(middle @ np.frombuffer(r["vector"], "<f8")), kind="stable")
        order[r["vec_id"]] = np.argsort(near)
    true = exact_neighbours(index, [(r["vec_id"], bytes(r["vector"])) for r in sample], top).collect()
    places = sorted(int(order[r["query_id"]][r["list"]]) for r in true)
    if not places:
        return 1
    return places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)] + 1
