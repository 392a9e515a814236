"""Similarity search for many queries at once, by vector or by text.

Queries go in blocks of bounded size. A task meets a block as one matrix
product per slice of an Arrow batch and keeps the best ``k`` rows of each query as
it goes, so at most ``k`` rows a query leave a task; the exchange sees nothing else.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spendlake.operators.hooks import Hook, ask_hook, hashed_vectors
from spendlake.staging import staged

#: Queries of a block, which go to every task, and stored rows of one product.
BLOCK_QUERIES, SLICE_ROWS = 2048, 1024
# More than two ways of adding up a cosine can differ by.
_SLACK = 1e-9
# Below every cosine: a vector with NaN comes last.
_NAN = -2.0


def _usable(vectors: pa.Array) -> np.ndarray:
    """Whether a vector is there, not empty, and without NULL."""
    usable = pc.greater(pc.list_value_length(vectors), 0).fill_null(False).to_numpy(zero_copy_only=False).copy()
    numbers = vectors.flatten()
    if numbers.null_count:
        missing = numbers.is_null().to_numpy(zero_copy_only=False)
        usable[pc.list_parent_indices(vectors).to_numpy()[missing]] = False
    return usable


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


class _Block:
    """The queries of one size in a block, and the best rows found for them so far."""

    def __init__(self, numbers: list[int], rows: np.ndarray, k: int) -> None:
        self.numbers, self.rows, self.k = np.array(numbers), rows, k
        lengths = _lengths(rows)
        self.inverse = np.divide(1, lengths, out=np.zeros(len(lengths)), where=lengths != 0)
        self.floor = np.full(len(rows), -np.inf)
        self.best: pa.Table | None = None

    def add(self, ids: pa.Array, rows: np.ndarray) -> None:
        lengths = _lengths(rows)
        inverse = np.divide(1, lengths, out=np.zeros(len(lengths)), where=lengths != 0)
        rough = (self.rows @ rows.T) * self.inverse[:, None] * inverse
        np.nan_to_num(rough, copy=False, nan=_NAN)
        floor = self.floor
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        query, row = np.nonzero(rough >= floor[:, None] - _SLACK)
        if not len(query):
            return
        # Scored again one by one: a product's sums depend on a row's place in it, and equal vectors must tie.
        score = (self.rows[query] * rows[row]).sum(axis=1) * self.inverse[query] * inverse[row]
        found = pa.table({"query": query, "score": np.nan_to_num(score, nan=_NAN), "email_id": ids.take(pa.array(row))})
        both = found if self.best is None else pa.concat_tables([self.best, found])
        order = pc.sort_indices(both, [("query", "ascending"), ("score", "descending"), ("email_id", "ascending")])
        both = both.take(order)
        query = both["query"].to_numpy()
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.best = both.filter(pa.array(rank < self.k)).combine_chunks()
        last = rank == self.k - 1
        self.floor[query[last]] = both["score"].to_numpy()[last]


def best_of_tasks(embeddings: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """``query, email_id, similarity``: the best ``k`` rows of each numbered query in each task."""
    by_size: dict[int, list[tuple[int, list[float]]]] = {}
    for number, vector in queries:
        by_size.setdefault(len(vector), []).append((number, vector))
    matrices = {
        size: ([n for n, _ in own], np.array([v for _, v in own], np.float64)) for size, own in by_size.items()
    }
    id_type = embeddings.schema["email_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {size: _Block(numbers, rows, k) for size, (numbers, rows) in matrices.items()}
        for batch in batches:
            for start in range(0, len(batch), SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                vectors = part.column("vector")
                usable, sizes = _usable(vectors), pc.list_value_length(vectors).fill_null(0).to_numpy()
                for size in np.unique(sizes[usable]).tolist():
                    if size in blocks:
                        own = pa.array(usable & (sizes == size))
                        numbers = vectors.filter(own).flatten().to_numpy(zero_copy_only=False)
                        blocks[size].add(part.column("email_id").filter(own), numbers.astype(np.float64).reshape(-1, size))
        for block in blocks.values():
            if block.best is not None:
                score = block.best["score"].to_numpy()
                similarity = np.where(score == _NAN, np.nan, score)
                ids = block.best["email_id"].combine_chunks().cast(arrow_id)
                columns = [pa.array(block.numbers[block.best["query"].to_numpy()], pa.int64()), ids, pa.array(similarity)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "email_id", "similarity"])

    rows = embeddings.select("email_id", "vector")
    return rows.mapInArrow(search, f"query long, email_id {id_type.simpleString()}, similarity double")


def _block_results(embeddings: DataFrame, rows: list, id_type: str, k: int) -> DataFrame:
    spark = embeddings.sparkSession
    queries = [(number, row.vector) for number, row in enumerate(rows)]
    ids = spark.createDataFrame([(n, row.query_id) for n, row in enumerate(rows)], f"query long, query_id {id_type}")
    ranked = F.when(~F.isnan("similarity"), F.col("similarity"))
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last(ranked), F.asc_nulls_last("email_id"))
    found = best_of_tasks(embeddings, queries, k).withColumn("rank", F.row_number().over(order))
    # A block's ids: as many rows as the block has queries.
    return found.filter(F.col("rank") <= k).join(F.broadcast(ids), "query").select("query_id", "rank", "email_id", "similarity")


def similar_many(embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, email_id, similarity``: the ``k`` mails nearest to each query by cosine similarity.

    ``queries`` has ``query_id`` and ``vector``; equal rows are one query. A query without a usable
    vector (missing, empty, holding NULL) finds nothing, and a stored vector
    meets the queries of its size only. A vector of length 0 has similarity 0 to all. Vectors with
    NaN come last. Ties go by mail id.
    """
    id_type = queries.schema["query_id"].dataType.simpleString()
    vector = F.col("vector").cast("array<double>")
    usable = queries.select("query_id", vector.alias("vector")).filter(
        (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull())
    )
    usable = staged(usable.distinct(), "queries")
    blocks = max(1, -(-usable.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks))
    results = [_block_results(embeddings, usable.filter(block == b).collect(), id_type, k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, results)


def similar_to_text(
    embeddings: DataFrame, texts: DataFrame, hook: Hook | None = None, k: int = 10, batch: int = 1000
) -> DataFrame:
    """``query_id, rank, email_id, similarity``: the ``k`` mails nearest to each text.

    ``texts`` has ``query_id`` and ``text``. The model of the stored vectors is ``hook``; it is called
    inside tasks, once for each ``batch`` of texts, and its answers are written before they are searched.
    Without a hook they are the hashed vectors of ``embed_pending``. A text that is
    NULL, or that the model fails on, finds nothing.
    """
    asked = texts.select("query_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    if hook is None:
        made = hashed_vectors(asked, "text", "vector")
    else:
        made = ask_hook(asked, "text", "vector", "array<double>", hook, batch)
    return similar_many(embeddings, staged(made.select("query_id", "vector"), "query-vectors"), k)
