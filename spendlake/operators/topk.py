"""Sorted output and top-k."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.vectors import cosine_similarity


def recent_mails(emails: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most recent mails; undated ones last."""
    return (
        emails.orderBy(F.desc_nulls_last("date"), "id").limit(n).select("date", "from_addr", "subject")
    )


def newest_first(tx: DataFrame) -> DataFrame:
    """Transactions by date text, newest first, undated ones last.

    The id follows as a second sort key, so that one common date, or none, is
    still spread over the range partitions.
    """
    return tx.orderBy(F.desc_nulls_last("tx_date"), "id")


def find_similar(embeddings: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The ``k`` mails nearest to ``query`` by cosine similarity.

    Ties go by mail id. Every task keeps its own best ``k``; only those move.
    A vector that cannot be compared is left out.
    """
    score = cosine_similarity(F.col("vector"), query)
    scored = embeddings.select("email_id", score.alias("similarity"))
    ranked = F.when(~F.isnan("similarity"), F.col("similarity"))
    # Unusable vectors sort last and go after the limit. Filtered before it,
    # they would have to be scored twice.
    best = scored.orderBy(F.col("similarity").isNull(), F.desc_nulls_last(ranked), "email_id")
    return best.limit(k).filter(F.col("similarity").isNotNull())
