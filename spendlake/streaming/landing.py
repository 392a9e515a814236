"""Import of messages as they land.

The stream's own checkpoint remembers which files were read, so a restarted
run takes up where the last one stopped. A file that is offered twice adds
nothing, as ids and bodies are unique in the table.
"""

import datetime
import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from spendlake.plans.imports import import_messages
from spendlake.sources.landing import as_messages
from spendlake.sources.tables import append_emails, read_emails


def import_landed(
    spark: SparkSession,
    folder: str,
    emails_path: str,
    checkpoint: str,
    today: datetime.date,
    files_per_batch: int = 100_000,
) -> StreamingQuery:
    """Import every file that has landed and not been read, then stop.

    Each batch of the stream is a run of the table: a batch that broke off is done again and replaces itself.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )

    def one_batch(batch, number):
        run = f"{stream}-{number}"
        new, _ = import_messages(batch, read_emails(batch.sparkSession, emails_path, but=run), today)
        append_emails(new, emails_path, run)

    return (
        as_messages(files)
        .writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
