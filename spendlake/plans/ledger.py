"""Ledger: mails to transactions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions import replies as r
from spendlake.functions.text import (
    extraction_prompt,
    long_enough,
    receipt_candidate,
    transaction_id,
)
from spendlake.operators.antijoin import without_tx
from spendlake.operators.dedup import enforce_tx_key
from spendlake.operators.hooks import Hook, ask_hook, rule_replies
from spendlake.operators.totals import ledger_summary
from spendlake.sources.keys import KeySet
from spendlake.staging import staged


def reply_transactions(replies: DataFrame) -> DataFrame:
    """``email_id``, ``reply`` to transactions; a reply without one gives no row."""
    r.keep_last_keys(replies.sparkSession)
    # An array of at most one element: the reply is parsed once, and rows
    # without a transaction go where they are parsed.
    found = F.filter(
        F.transform(
            F.array(r.reply_object(F.col("reply"))),
            lambda obj: F.struct(obj.alias("obj"), r.amount_cents(obj).alias("cents")),
        ),
        lambda one: one["cents"].isNotNull(),
    )
    rows = replies.select("email_id", F.inline(found))
    obj = F.col("obj")
    return rows.select(
        transaction_id(F.col("email_id")).alias("id"),
        "email_id",
        r.field_or_default(obj, "merchant").alias("merchant"),
        F.col("cents").alias("amount_cents"),
        r.field_or_default(obj, "currency").alias("currency"),
        r.field_text(obj, "date").alias("tx_date"),
        r.field_or_default(obj, "category").alias("category"),
        F.lit(1.0).alias("confidence"),
    )


def _waiting(emails: DataFrame, tx: DataFrame | KeySet, scope: str) -> DataFrame:
    """Mails that may be receipts and have no transaction yet. The filter on the mail comes before the join."""
    return without_tx(emails.filter(receipt_candidate(F.col("subject"), F.col("body_text"), scope)), tx)


def _prompt() -> Column:
    return extraction_prompt(F.col("date"), F.col("subject"), F.col("body_text"))


def prompts(emails: DataFrame, tx: DataFrame | KeySet, scope: str = "subject_first") -> DataFrame:
    """Prompts for the mails that may be receipts, are long enough and have no transaction yet.

    Both filters on the mail come before the join.
    """
    long = emails.filter(long_enough(F.col("body_text")))
    return _waiting(long, tx, scope).select(F.col("id").alias("email_id"), _prompt().alias("prompt"))


def build_ledger(
    emails: DataFrame,
    tx: DataFrame,
    replies: DataFrame | None = None,
    hook: Hook | None = None,
    scope: str = "subject_first",
) -> tuple[DataFrame, DataFrame]:
    """The transactions to append, and the summary of the run.

    Replies come from a frame (``email_id``, ``reply``; each reply counts once),
    else from a ``hook`` on the prompt, else from a rule. The mails that wait are written, with
    their prompts unless replies are given: bodies are read once, for the run and its summary. A hook's replies are
    written too, so that no mail is asked about twice in a run. Mails that yield
    no transaction are tried again in the next run.

    The new transactions are a written table. ``tx`` is the stored transactions.
    """
    long = long_enough(F.col("body_text")).alias("long")
    asked = [] if replies is not None else [F.when(long, _prompt()).alias("prompt")]
    waiting = staged(_waiting(emails, tx, scope).select(F.col("id").alias("email_id"), long, *asked), "waiting")
    ready = waiting.filter("long")
    if replies is not None:
        ids = ready.select(F.col("email_id").alias("_asked"))
        answered = replies.join(ids, F.col("email_id").eqNullSafe(F.col("_asked")), "left_semi")
    elif hook is not None:
        answers = ask_hook(ready, "prompt", "reply", "string", hook)
        answered = staged(answers.select("email_id", "reply"), "replies")
    else:
        answered = rule_replies(ready, "prompt", "reply")
    found = reply_transactions(answered.select("email_id", "reply"))
    order = ["email_id", "amount_cents", "merchant", "tx_date"]
    new = staged(enforce_tx_key(found, tx, order), "new-tx")
    return new, ledger_summary(emails, waiting, new)
