"""Raw messages to mail fields.

The JSON envelope, headers, defaults, dates and hashes are Spark expressions.
Python reads the two parts that are recursive, with the base64 in them: a MIME
message and a payload tree. A message that cannot be read keeps its path and gets an
``error``; it never fails the job.
"""

import base64
import datetime
import email
import functools
import json
from email import policy
from email.policy import EmailPolicy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions import codec
from spendlake.functions.dates import mail_day
from spendlake.functions.html import page_text
from spendlake.functions.replies import field, field_text, keep_last_keys, kind, strict_object
from spendlake.functions.text import NO_SUBJECT, UNKNOWN_SENDER, or_default

_FIELDS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("subject", "from_addr", "date_text", "body", "error")
    ]
)
_HEADERS = "array<struct<name:string,value:string>>"


def _bytes(coded: str) -> bytes:
    """Bytes of base64url text; missing padding is implied by its length."""
    return base64.urlsafe_b64decode(coded + "=" * (-len(coded) % 4))


def _part_text(part) -> str:
    """Text of the chosen part; broken content is decoded as far as it goes."""
    try:
        content = part.get_content()
        return page_text(content) if part.get_content_type() == "text/html" else content
    except Exception:
        return part.get_payload(decode=True).decode("utf-8", "replace")


@functools.cache
def _reading_policy() -> EmailPolicy:
    """The default policy, but no header text is parsed twice. One for each worker.

    One message asks for its headers many times, and most messages share
    some of them. A parsed header is large, so few are remembered.
    """
    parsed = functools.lru_cache(maxsize=64)(policy.default.header_fetch_parse)

    class Remembering(EmailPolicy):
        def header_fetch_parse(self, name, value):
            return parsed(name, value)

    return Remembering()


def read_mime(raw: str, reading: EmailPolicy) -> dict:
    """Fields of one base64url MIME message; plain text is preferred to HTML."""
    message = email.message_from_bytes(_bytes(raw), policy=reading)
    part = message.get_body(preferencelist=("plain", "html"))
    fields = {"body": "" if part is None else _part_text(part)}
    for name, header in (("subject", "subject"), ("from_addr", "from"), ("date_text", "date")):
        value = message[header]
        fields[name] = None if value is None else str(value)
    for text in fields.values():
        (text or "").encode("utf-8")
    return fields


def _data(node: dict) -> str | None:
    return node.get("body", {}).get("data")


def _decoded(data: str | None) -> str:
    return _bytes(data or "").decode("utf-8", "replace")


def _is_text(node: dict) -> bool:
    return node["mimeType"] in ("text/plain", "text/html")


def _chosen_node(node: dict | None) -> dict | None:
    """The first part with text, in document order, of a payload tree.

    Choosing a nested multipart is final, whether or not it holds a text.
    """
    while node is not None and "parts" in node:
        usable = (
            part
            for part in node["parts"]
            if (_data(part) if _is_text(part) else part["mimeType"].startswith("multipart/"))
        )
        node = next(usable, None)
        if node is not None and _is_text(node):
            break
    return node


def tree_body(node: dict) -> str:
    """Body of a payload tree; failing a text part, the root's own data as it is."""
    chosen = _chosen_node(node)
    text = _decoded(_data(chosen)) if chosen is not None else ""
    if text and chosen.get("mimeType") == "text/html":
        text = page_text(text)
    return text or _decoded(_data(node))


def read_tree(payload: str) -> dict:
    body = tree_body(json.loads(payload))
    body.encode("utf-8")
    return {"body": body}


def _row(value: str | None, read) -> tuple:
    """The fields of a value; a missing one has none."""
    fields = {}
    if value is not None:
        try:
            fields = read(value)
        except Exception as problem:
            fields = {"error": f"{type(problem).__name__}"}
    return tuple(fields.get(name) for name in _FIELDS.names)


# Plain functions, not vectorised ones: Spark hands these 100 rows at a time, and 10,000 to
# the others, however long the messages are.
@F.udf(_FIELDS, useArrow=False)
def _mime_fields(raw):
    return _row(raw, lambda value: read_mime(value, _reading_policy()))


@F.udf(_FIELDS, useArrow=False)
def _tree_fields(payload):
    return _row(payload, read_tree)


def parse_messages(messages: DataFrame, today: datetime.date) -> DataFrame:
    """``raw_path``, ``text`` to the columns of a mail plus ``error``.

    ``error`` is NULL for a readable message and names the problem otherwise.
    """
    keep_last_keys(messages.sparkSession)
    doc = messages.select("raw_path", strict_object(F.col("text")).alias("doc"))
    raw, payload = field(F.col("doc"), "raw"), field(F.col("doc"), "payload")
    # With no payload at all the tree is empty, which is a readable message.
    tree = F.when(payload.isNull(), F.lit("{}")).otherwise(F.to_json(payload))
    is_mime = raw.isNotNull()
    parts = doc.select(
        "raw_path",
        field_text(F.col("doc"), "id").alias("id"),
        F.col("doc").isNotNull().alias("is_json"),
        is_mime.alias("is_mime"),
        F.when(kind(raw) == "STRING", field_text(F.col("doc"), "raw")).alias("mime"),
        F.when(F.col("doc").isNotNull() & ~is_mime, tree).alias("tree"),
        F.when(~is_mime, field(payload, "headers")).alias("headers"),
    )
    headers = F.from_json(F.to_json("headers"), _HEADERS)
    read = parts.select(
        "raw_path",
        "id",
        "is_json",
        "is_mime",
        F.col("mime").isNotNull().alias("has_mime"),
        F.col("headers").isNotNull().alias("has_headers"),
        headers.alias("headers"),
        _mime_fields("mime").alias("m"),
        _tree_fields("tree").alias("t"),
    )
    readable = [codec.header_is_readable(F.col("headers"), n) for n in ("Subject", "From", "Date")]
    well_formed = (readable[0] & readable[1] & readable[2]) | ~F.col("has_headers")
    header = {n: codec.header_value(F.col("headers"), n) for n in ("Subject", "From", "Date")}
    mime = F.col("is_mime")
    fields = read.select(
        "raw_path",
        "id",
        F.when(mime, F.col("m.subject")).otherwise(header["Subject"]).alias("subject"),
        F.when(mime, F.col("m.from_addr")).otherwise(header["From"]).alias("from_addr"),
        F.when(mime, F.col("m.date_text")).otherwise(header["Date"]).alias("date_text"),
        F.when(mime, F.col("m.body")).otherwise(F.col("t.body")).alias("body"),
        F.when(~F.col("is_json"), "not a JSON object")
        .when(mime & ~F.col("has_mime"), "no raw text")
        .when(mime, F.col("m.error"))
        .when(~F.coalesce(well_formed, F.lit(False)), "malformed headers")
        .otherwise(F.col("t.error"))
        .alias("error"),
    )
    good = F.col("error").isNull()
    return fields.select(
        "id",
        mail_day(F.col("date_text"), today).alias("date"),
        F.when(good, or_default(F.col("from_addr"), UNKNOWN_SENDER)).alias("from_addr"),
        F.when(good, or_default(F.col("subject"), NO_SUBJECT)).alias("subject"),
        F.when(good, F.col("body")).alias("body_text"),
        "raw_path",
        F.when(good, codec.content_hash(F.col("body"))).alias("content_hash"),
        "error",
    )
