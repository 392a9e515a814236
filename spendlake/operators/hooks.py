"""Model calls as a column.

A hook is a callable from a list of texts to a list of answers of the same
length. It runs inside tasks, at most ``batch`` texts at a time. If it fails
on a batch it is asked again for each half, and a row that fails alone gets NULL.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Hook = Callable[[list[str]], list]


def _answers(hook: Hook, texts: list) -> list:
    if not texts:
        return []
    try:
        answers = list(hook(texts))
    except Exception:
        answers = None
    if answers is not None and len(answers) == len(texts):
        return answers
    if len(texts) == 1:
        return [answers[0] if answers else None]
    half = len(texts) // 2
    return _answers(hook, texts[:half]) + _answers(hook, texts[half:])


def ask_hook(
    df: DataFrame, text: str, answer: str, answer_type: str, hook: Hook, batch: int = 1000, tasks: int | None = None
) -> DataFrame:
    """``df`` with the hook's answer to column ``text``.

    Calls cost far more than moving their texts, so these are spread evenly:
    over ``tasks``, or as Spark sees fit for their size.
    """

    @F.pandas_udf(answer_type)
    def call(texts: pd.Series) -> pd.Series:
        rows = texts.tolist()
        parts = (rows[i : i + batch] for i in range(0, len(rows), batch))
        return pd.Series([x for part in parts for x in _answers(hook, part)], index=texts.index, dtype=object)

    # Not to be repeated, moved or merged: a call is costly and may vary.
    spread = df.repartition(tasks) if tasks else df.hint("rebalance")
    return spread.withColumn(answer, call.asNondeterministic()(F.col(text)))


def hashed_vectors(df: DataFrame, text: str, vector: str, size: int = 256) -> DataFrame:
    """Vectors without a model: hashed word counts, scaled to length 1."""
    words = Tokenizer(inputCol=text, outputCol="_words").transform(df)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(words)
    scaled = Normalizer(inputCol="_counts", outputCol="_scaled").transform(counts)
    return scaled.withColumn(vector, vector_to_array("_scaled", "float32")).drop(
        "_words", "_counts", "_scaled"
    )


def rule_replies(df: DataFrame, prompt: str, reply: str) -> DataFrame:
    """Replies without a model: the first amount that follows a currency code.

    Commas may group its digits. No such amount gives ``{}``. The merchant is the subject line.
    """
    money = r"\b([A-Z]{3}) ?(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
    text = F.col(prompt)
    amount = F.replace(F.regexp_extract(text, money, 2), F.lit(","), F.lit(""))
    found = F.to_json(
        F.struct(
            F.regexp_extract(text, r"Subject: ([^\n]*)", 1).alias("merchant"),
            amount.alias("amount"),
            F.regexp_extract(text, money, 1).alias("currency"),
            F.nullif(F.regexp_extract(text, r"^Date: (\d{4}-\d{2}-\d{2})\n", 1), F.lit("")).alias(
                "date"
            ),
        )
    )
    return df.withColumn(reply, F.when(amount != "", found).otherwise(F.lit("{}")))
