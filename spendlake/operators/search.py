"""Keyword search over subject and body."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.sources.keys import run_path

_BREAK = r"[^\p{L}\p{N}]+"


def _split(text: Column) -> Column:
    return F.split(F.lower(text), _BREAK)


def _words(text: Column) -> Column:
    return F.filter(_split(text), lambda w: w != "")


def _fields(emails: DataFrame) -> DataFrame:
    field = F.array(
        F.struct(F.lit("subject").alias("field"), F.col("subject").alias("text")),
        F.struct(F.lit("body_text").alias("field"), F.col("body_text").alias("text")),
    )
    return emails.select("id", F.inline(field))


def _counts(words: Column) -> Column:
    """``term, tf`` of an array of words: sorted, each run of equal words is one term."""
    held = F.struct(F.sort_array(words).alias("w"))
    at = lambda x, i: F.get(x["w"], i)
    first = lambda x: F.filter(
        F.sequence(F.lit(0), F.size(x["w"]) - 1), lambda i: (i == 0) | (at(x, i) != at(x, i - 1))
    )
    runs = lambda x: F.struct(x["w"].alias("w"), first(x).alias("first"))
    ends = lambda x, j: F.coalesce(F.get(x["first"], j + 1), F.size(x["w"]))
    terms = lambda x: F.transform(
        x["first"], lambda i, j: F.struct(at(x, i).alias("term"), (ends(x, j) - i).cast("long").alias("tf"))
    )
    # Arrays of one: the text is split, the words are sorted, and their runs found, once for each text.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return once(held, lambda x: F.when(F.size(x["w"]) > 0, once(runs(x), terms)).otherwise(none))


def postings(emails: DataFrame) -> DataFrame:
    """How often each word occurs in each field of each mail; counted where the mail is read.

    A mail that stands twice is listed twice.
    """
    return _fields(emails).select(F.inline(_counts(_words(F.col("text")))), "id", "field").select("term", "id", "field", "tf")


#: Folders of a stored index.
TERM_BUCKETS = 256
_INDEX = "term STRING, id STRING, field STRING, tf BIGINT, term_bucket INT"


def _term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def append_index(emails: DataFrame, path: str, run: str) -> None:
    """Store the postings of ``emails`` as those of ``run``, by term, in place of any that it stored before.

    A common term is split over several files of its folder.
    """
    rows = postings(emails).withColumn("term_bucket", _term_bucket(F.col("term")))
    rows.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term").write.mode("overwrite").partitionBy(
        "term_bucket"
    ).parquet(run_path(path, run))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(path).select("term", "id", "field", "tf", "term_bucket")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """As ``search``, from a stored index: only the folders of the words of ``query`` are read.

    Each id is one mail.
    """
    terms = _query_terms(spark, query)
    buckets = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_term_bucket(F.col("t"))).collect()}
    rows = read_index(spark, path).filter(F.col("term_bucket").isin(*buckets) & F.col("term").isin(*terms))
    found = rows.groupBy("id").agg(F.sum("tf").alias("score"), F.count_distinct("term").alias("n"))
    return found.filter(F.col("n") == len(terms)).select("id", "score").filter(F.lit(bool(terms))).orderBy(F.desc("score"), "id")


def _query_terms(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(F.array_distinct(_words(F.lit(query)))).first()[0]


def search(emails: DataFrame, query: str) -> DataFrame:
    """Mails that hold every word of ``query``, best first.

    ``score`` is the number of times the words occur. Mails are matched where
    they are scanned, so only hits are sorted and nothing else is shuffled.
    """
    terms = _query_terms(emails.sparkSession, query)
    # A mail can only be a hit if its text holds each word as a substring.
    text = F.lower(F.concat_ws(" ", "subject", "body_text"))
    maybe = emails.filter(F.lit(bool(terms)))
    for term in terms:
        maybe = maybe.filter(F.contains(text, F.lit(term)))
    no_words = F.array().cast("array<string>")
    words = F.concat(*[F.coalesce(_split(F.col(c)), no_words) for c in ("subject", "body_text")])
    found = F.filter(words, lambda w: w.isin(terms))
    hits = maybe.select("id", found.alias("found"))
    return (
        hits.filter(F.size(F.array_distinct("found")) == len(terms))
        .select("id", F.size("found").cast("bigint").alias("score"))
        .orderBy(F.desc("score"), "id")
    )
