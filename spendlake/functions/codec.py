"""Body decoding and hashing."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64url_bytes(data: Column) -> Column:
    """Bytes of base64url text, padded or not; NULL where it cannot be decoded.

    Missing padding is implied by the text's length. Characters outside the
    alphabet are skipped, and what follows the padding is ignored. A text
    that is not ASCII, or ends inside a quantum without the padding for it, is
    undecodable.
    """
    is_plain = data.rlike(r"^[A-Za-z0-9_+/-]*=*\z")
    digits = F.rtrim(_standard_alphabet(data), F.lit("="))
    return F.when(is_plain, F.try_to_binary(digits, F.lit("base64"))).otherwise(
        _bytes_among_strays(data)
    )


def _standard_alphabet(data: Column) -> Column:
    return F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))


def _bytes_among_strays(data: Column) -> Column:
    clean = F.regexp_replace(_standard_alphabet(data), "[^A-Za-z0-9+/=]", "")
    digits = F.regexp_extract(clean, "^([^=]*)", 1)
    run = F.length(F.regexp_extract(clean, "^[^=]*(=*)", 1))
    to_the_end = F.length(digits) + run == F.length(clean)
    implied = F.pmod(-F.length(data), F.lit(4))
    padding = run + F.when(to_the_end, implied).otherwise(F.lit(0))
    left_over = F.pmod(F.length(digits), F.lit(4))
    complete = (
        (left_over == 0) | ((left_over == 2) & (padding >= 2)) | ((left_over == 3) & (padding >= 1))
    )
    is_ascii = data.rlike(r"^[\x00-\x7F]*\z")
    return F.when(is_ascii & complete, F.try_to_binary(digits, F.lit("base64")))


def utf8_text(data: Column) -> Column:
    """Text of UTF-8 bytes, each bad sequence shown as U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def decoded_body(data: Column) -> Column:
    """Text of a base64url body; no data is an empty text."""
    return F.when(data != "", utf8_text(base64url_bytes(data))).when(
        F.coalesce(data, F.lit("")) == "", F.lit("")
    )


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header with that name, in any letter case."""
    wanted = name.lower()
    found = F.filter(headers, lambda h: F.lower(h["name"]) == wanted)
    return F.try_element_at(found, F.lit(1))["value"]


def header_is_readable(headers: Column, name: str) -> Column:
    """Whether no header without a name comes before the first one called ``name``; after it, none matters."""
    wanted = name.lower()
    marks = F.transform(
        headers,
        lambda h: F.when(h["name"].isNull(), "nameless").when(F.lower(h["name"]) == wanted, "found").otherwise(""),
    )
    found, nameless = F.array_position(marks, "found"), F.array_position(marks, "nameless")
    return (nameless == 0) | ((found > 0) & (found < nameless))
