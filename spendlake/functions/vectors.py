"""Vectors: cosine similarity and JSON text."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_json(vector: Column) -> Column:
    """JSON text of a vector."""
    return F.to_json(vector)


def vector_from_json(text: Column) -> Column:
    """Vector of JSON text; NULL if it is no array of numbers."""
    vector = F.from_json(text, "array<double>")
    return F.when(F.forall(vector, lambda x: x.isNotNull()), vector)


def cosine_similarity(vector: Column, query: list[float]) -> Column:
    """Cosine of each vector with ``query``, in double; 0 if either has no length.

    NULL for a vector that is missing, holds a NULL or has another size. Each
    Arrow batch is one matrix-vector product over the column's own buffer.
    """
    wanted = np.asarray(query, dtype=np.float64)
    size = len(wanted)
    length = float(np.linalg.norm(wanted))

    @F.arrow_udf("double")
    def cosine(vectors: pa.Array) -> pa.Array:
        usable = pc.equal(pc.list_value_length(vectors), size).fill_null(False)
        usable = usable.to_numpy(zero_copy_only=False).copy()
        if vectors.flatten().null_count:
            owners = pc.list_parent_indices(vectors).to_numpy()
            missing = vectors.flatten().is_null().to_numpy(zero_copy_only=False)
            usable[owners[missing]] = False
        if not usable.all():
            vectors = vectors.filter(pa.array(usable))
        numbers = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = numbers.reshape(int(usable.sum()), size)
        lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * length
        scores = np.zeros(len(usable))
        scores[usable] = np.divide(
            rows @ wanted, lengths, out=np.zeros(len(rows)), where=lengths != 0
        )
        return pa.array(scores, pa.float64(), mask=~usable)

    return cosine(vector)
