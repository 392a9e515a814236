import random
import re

import pytest
from pyspark.sql import functions as F

from spendlake.functions import text


def fold(value):
    return re.sub("[A-Z]", lambda m: m[0].lower(), value)


def like(value, part):
    """Substring match with wildcards, by a regular expression."""
    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in fold(part))
    return re.search(pattern, fold(value), re.S) is not None


@pytest.mark.parametrize(
    ("merchant", "part", "expected"),
    [
        ("UBER Eats", "uber", True),
        ("É", "é", False),
        ("É", "É", True),
        ("axb", "a_b", True),
        ("ab", "a_b", False),
        ("a\\b", "a\\", True),
        ("ab", "a\\", False),
        ("50% off", "0%f", True),
        (None, "%", None),
    ],
)
def test_merchant_contains(column, merchant, part, expected):
    assert column(lambda x: text.merchant_contains(x, part), [merchant]) == [expected]


def test_merchant_contains_equals_regex(column):
    rng = random.Random(3)
    words = ["".join(rng.choices("aAbÉé_%\\ .x", k=rng.randint(0, 6))) for _ in range(200)]
    for part in ["a", "_", "%", "A%b", "\\", "é", "._", "b\\_", "a_A"]:
        got = column(lambda x: text.merchant_contains(x, part), words)
        assert got == [like(w, part) for w in words]
        as_column = column(lambda x: F.like(text.fold_ascii(x), text.contains_pattern(F.lit(part))), words)
        assert as_column == got


def test_no_pattern_for_empty_part(column):
    assert column(text.contains_pattern, ["", None]) == [None, None]


def test_receipt_candidate(spark):
    rows = [
        ("Hello", "receipt", False, True),
        (None, "receipt", True, True),
        ("", "Your ORDER", True, True),
        ("Reorder", None, True, True),
        (None, None, False, False),
        ("Notes", "nothing", False, False),
    ]
    df = spark.createDataFrame(rows, "s string, b string, first boolean, both boolean")
    subject, body = F.col("s"), F.col("b")
    wrong = df.filter(
        (text.receipt_candidate(subject, body) != F.col("first"))
        | (text.receipt_candidate(subject, body, "both") != F.col("both"))
    )
    assert wrong.count() == 0
    with pytest.raises(ValueError):
        text.receipt_candidate(subject, body, "all")


def test_long_enough_counts_characters(column):
    assert column(text.long_enough, ["é" * 50, "é" * 49, None]) == [True, False, False]


def test_prompts(column):
    nothing = F.lit(None).cast("string")
    assert column(lambda x: text.embedding_input(nothing, x, 512), [None, "é" * 600]) == [
        "Subject: \nBody: ",
        "Subject: \nBody: " + "é" * 512,
    ]
    assert column(lambda x: text.extraction_prompt(nothing, F.lit("S"), x, 2000), ["b" * 3000]) == [
        "Date: None\nSubject: S\n\n" + "b" * 2000
    ]
    assert column(text.transaction_id, ["m1", None]) == ["tx_m1", "tx_None"]
    assert column(lambda x: text.or_default(x, "d"), ["", None, "x"]) == ["d", "d", "x"]


def test_whole_bodies_by_default(column):
    nothing = F.lit(None).cast("string")
    assert column(lambda x: text.embedding_input(nothing, x), ["é" * 600]) == ["Subject: \nBody: " + "é" * 600]
    made = column(lambda x: text.extraction_prompt(nothing, F.lit("S"), x), ["b" * 3000 + " CHF 12.50"])
    assert made == ["Date: None\nSubject: S\n\n" + "b" * 3000 + " CHF 12.50"]
