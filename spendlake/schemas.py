"""Table schemas."""

from pyspark.sql import types as T

#: Months of transactions whose date text is no plain day, and of those without a date.
ODD_MONTH, NO_MONTH = "none", "undated"

EMAILS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("from_addr", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("raw_path", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("email_id", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

TX = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("email_id", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("amount_cents", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("tx_date", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

QUESTIONS = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("metric", T.StringType()),
    ]
)
