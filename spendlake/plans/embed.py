"""Embed: vectors for the mails that have none."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.text import embedding_input
from spendlake.operators.antijoin import without_vector
from spendlake.operators.hooks import Hook, ask_hook, hashed_vectors


def embed_pending(emails: DataFrame, embeddings: DataFrame, hook: Hook | None = None) -> DataFrame:
    """``email_id``, ``vector`` of mails without one.

    A mail whose vector failed is left out, and so tried again next time.
    Without a ``hook`` vectors are hashed word counts.
    """
    pending = without_vector(emails, embeddings).select(
        F.col("id").alias("email_id"),
        embedding_input(F.col("subject"), F.col("body_text")).alias("text"),
    )
    if hook is None:
        done = hashed_vectors(pending, "text", "vector")
    else:
        done = ask_hook(pending, "text", "vector", "array<float>", hook)
    return done.filter(F.col("vector").isNotNull()).select("email_id", "vector")
