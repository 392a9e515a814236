"""Text predicates, defaults and prompt building."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# A mail whose text holds one of these words may be a receipt.
RECEIPT_WORDS = (
    "receipt",
    "order",
    "invoice",
    "payment",
    "transaction",
    "total",
    "purchase",
    "amount",
    "charged",
    "paid",
)
# Sizes in characters, and what stands for a missing header.
MIN_BODY_CHARS = 50
NO_SUBJECT = "(No Subject)"
UNKNOWN_SENDER = "(Unknown)"

_WILDCARDS = {"%": ".*", "_": "."}


def fold_ascii(text: Column) -> Column:
    """Lower-case ASCII letters only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def contains_pattern(part: Column) -> Column:
    """LIKE pattern for "contains ``part``"; NULL when there is no filter.

    ``%`` and ``_`` in ``part`` stay wildcards. Spark treats a backslash as an
    escape, the data does not, so it is doubled.
    """
    escaped = F.replace(fold_ascii(part), F.lit("\\"), F.lit("\\\\"))
    return F.when(part != "", F.concat(F.lit("%"), escaped, F.lit("%")))


def merchant_contains(merchant: Column, part: str) -> Column:
    """Case-insensitive (ASCII) substring match; a NULL merchant never matches.

    The same test as ``contains_pattern``. For a part that is known up front a
    regular expression is several times faster than folding every merchant;
    its case flag, too, concerns ASCII letters only.
    """
    return merchant.rlike("(?is)" + "".join(_as_regex(c) for c in part))


def _as_regex(char: str) -> str:
    if char in _WILDCARDS:
        return _WILDCARDS[char]
    return char if char.isalnum() or not char.isascii() else "\\" + char


def or_default(value: Column, default: str) -> Column:
    """``default`` for NULL and for empty text."""
    return F.when(value != "", value).otherwise(F.lit(default))


def receipt_candidate(subject: Column, body: Column, scope: str = "subject_first") -> Column:
    """Does the mail hold a receipt word, anywhere inside a word?

    ``subject_first`` reads the body only where the subject is NULL or empty;
    ``both`` always reads subject and body. Never NULL.
    """
    if scope == "subject_first":
        text = F.when(subject != "", subject).otherwise(body)
    elif scope == "both":
        text = F.concat_ws(" ", subject, body)
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return F.coalesce(F.lower(text).rlike("|".join(RECEIPT_WORDS)), F.lit(False))


def long_enough(body: Column, least: int = MIN_BODY_CHARS) -> Column:
    """At least ``least`` characters; a NULL body has none."""
    return F.coalesce(F.length(body), F.lit(0)) >= least


def _body(body: Column, max_chars: int | None) -> Column:
    """The whole body, or its first ``max_chars`` characters; NULL is empty."""
    whole = F.coalesce(body, F.lit(""))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


# The literal parts of both texts.
def embedding_input(subject: Column, body: Column, max_chars: int | None = None) -> Column:
    """The text that is turned into a vector."""
    shown = F.coalesce(subject, F.lit(""))
    return F.concat(F.lit("Subject: "), shown, F.lit("\nBody: "), _body(body, max_chars))


def extraction_prompt(date: Column, subject: Column, body: Column, max_chars: int | None = None) -> Column:
    """The text that is sent for extraction; a missing date prints ``None``."""
    return F.concat(
        F.lit("Date: "),
        F.coalesce(date, F.lit("None")),
        F.lit("\nSubject: "),
        F.coalesce(subject, F.lit("")),
        F.lit("\n\n"),
        _body(body, max_chars),
    )


def transaction_id(email_id: Column) -> Column:
    return F.concat(F.lit("tx_"), F.coalesce(email_id, F.lit("None")))
