"""Import: raw messages to new mails."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.dates import after_lookback
from spendlake.operators.antijoin import skip_landed
from spendlake.operators.dedup import accepted_by_two_keys, rows_of
from spendlake.operators.messages import parse_messages
from spendlake.operators.totals import import_summary
from spendlake.sources.keys import KeySet
from spendlake.staging import staged


def messages_to_land(
    messages: DataFrame, landed: DataFrame, today: datetime.date, days: int = 90
) -> DataFrame:
    """Messages (``id``, ``day``, ...) of the last ``days`` that have not landed."""
    return skip_landed(messages.filter(after_lookback(F.col("day"), today, days)), landed)


def import_messages(
    messages: DataFrame,
    emails: DataFrame | tuple[KeySet, KeySet],
    today: datetime.date,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mails to append, and the summary of the run.

    ``messages`` has ``raw_path`` and ``text``; messages are offered in order
    of their path. Neither the id nor the body of a new mail is stored yet.
    Messages are parsed once, into a written table. Input in few large files
    can be spread over more tasks with ``partitions``. ``emails`` is the stored mails, or the sets of their
    ids and body hashes. The summary counts narrow written tables: bodies are not read for it.
    """
    if partitions is not None:
        messages = messages.repartition(partitions)
    parsed = staged(parse_messages(messages, today), "parsed")
    readable = parsed.filter("error IS NULL").drop("error")
    keys = ("id", "content_hash", "raw_path")
    kept = accepted_by_two_keys(readable, emails, *keys)
    return rows_of(readable, kept, *keys), import_summary(parsed, kept)
