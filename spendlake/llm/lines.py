"""Line dedup: lines that many documents share go from all of them.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case. Keys are hashed to 128 bits; the documents of a key are counted, and the
lines of keys that ``min_docs`` documents or more hold are dropped by their
position. All of it is column expressions.

What moves: one narrow row for each different key of a document, to count them
(combined before the exchange by key, so that a line of all documents is no hot
key); the positions of dropped lines, one row for each text; and each text
once, to meet its positions. The keys that go are a written table: Spark sends
it to all tasks only if its bytes allow that, and otherwise joins by exchange.

Rows with equal doc_id are one document when keys are counted (those without an
id too); every row is cleaned. NULL and empty texts are one empty line. A text
that loses all lines becomes empty.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import free_name, staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\f\r"


def _whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII alone take the fast way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _keys(text: Column, min_chars: int) -> Column:
    """The hashed keys of the lines of a text by position; NULL for those that are too short."""
    hashed = lambda key: F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
    stripped = F.transform(F.split(_lowered(_whole(text)), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.transform(stripped, lambda key: F.when(F.length(key) >= min_chars, hashed(key)))


def common_keys(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """``a, b``: the hashed keys that at least ``min_docs`` documents hold."""
    own = docs.select("doc_id", F.explode(F.array_distinct(_keys(F.col("text"), min_chars))).alias("key"))
    own = own.filter("key IS NOT NULL").select("key.a", "key.b", "doc_id").distinct()
    return own.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("a", "b")


def dropped_places(docs: DataFrame, common: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_key, places``: positions (from 0) of the lines that go, of each text that loses any."""
    lines = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.posexplode(_keys(F.col("text"), min_chars)))
    lines = lines.filter("col IS NOT NULL").select("doc_id", "text_key", "pos", "col.a", "col.b")
    gone = lines.join(common, ["a", "b"], "left_semi")
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("places"))


def _text_key(text: Column) -> Column:
    return F.xxhash64(_whole(text))


def _without(text: Column, places: Column) -> Column:
    """``text`` without the lines at ``places``: one pass over the lines."""
    parts = F.struct(F.split(text, "\n", -1).alias("lines"), places.alias("places"))
    last = lambda x: F.size(x["lines"]) - 1
    kept = lambda x: F.array_except(F.sequence(F.lit(0), last(x)), x["places"])
    # An array of one makes Spark split the text once, not once for each line.
    joined = lambda x: F.array_join(F.transform(kept(x), lambda i: F.get(x["lines"], i)), "\n")
    return F.element_at(F.transform(F.array(parts), joined), 1)


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines, n_dropped`` (which replace columns of those names).

    Lines with a key of ``min_chars`` code points or more that ``min_docs`` documents hold are dropped.
    """
    narrow = docs.select("doc_id", "text")
    common = staged(common_keys(narrow, min_docs, min_chars), "line-keys")
    places = dropped_places(narrow, common, min_chars)
    names = ("_doc", "_key", "_places")
    doc, key, gone = (free_name(docs, name) for name in names)
    places = places.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("places").alias(gone))
    own = free_name(docs, "_own_key")
    rows = docs.withColumn(own, _text_key(F.col("text")))
    rows = rows.join(places, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")
    text = _whole(F.col("text"))
    counts = {
        "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long"),
    }
    cleaned = F.when(F.col(gone).isNull(), text).otherwise(_without(text, F.col(gone))).alias("text")
    others = [F.col(f"`{c}`") if c != "text" else cleaned for c in docs.columns if c.lower() not in counts]
    return rows.select(*others, *(value.alias(name) for name, value in counts.items()))
