import base64
import datetime
import random

import pytest
from pyspark.sql import functions as F

from spendlake.functions import codec, dates
from spendlake.sources import tables
from tests.conftest import TODAY


def python_bytes(data):
    try:
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    except ValueError:
        return None


def test_base64url_equals_python(column):
    rng = random.Random(5)
    coded = [base64.urlsafe_b64encode(rng.randbytes(n)).decode() for n in range(40)]
    inputs = coded + [c.rstrip("=") for c in coded]
    inputs += ["AAAAA", "aGVsbG8", "a", "=", "====", "aGVs\nbG8=", "aG VsbG8h", "aGVs\n", "aGVsbG8\n"]
    inputs += ["aGVsbG8=tail", "aGVsbA==aGVs", "é" + coded[30]]
    got = column(codec.base64url_bytes, inputs)
    assert [None if x is None else bytes(x) for x in got] == [python_bytes(x) for x in inputs]


def test_decoded_body(column):
    assert column(codec.decoded_body, ["aGVsbG8", "", None, "AAAAA"]) == ["hello", "", "", None]


def test_utf8_text(column):
    broken = [b"a\xffb", b"abc\xc3", b"\xe2\x82"]
    got = column(codec.utf8_text, broken, "binary")
    assert got == [x.decode("utf-8", "replace") for x in broken]


def test_empty_body_hash(column):
    assert column(codec.content_hash, [""])[0].startswith("e3b0c442")


def test_mail_day(column):
    cases = {
        "Tue, 3 Sep 2024 23:59:00 -0700": "2024-09-03",
        "3 Sep 2024 23:59": "2024-09-03",
        "Tue, 03 Sep 2024 00:10:00 GMT": "2024-09-03",
        "nonsense": None,
        "": None,
        None: None,
        "Tue, 3 Sep 2024 25:99:00 -0700": None,
        "31 Feb 2024 10:00:00": None,
        "Sep 2024": "2024-09-30",
        "2024-03-01T23:00:00Z": "2024-03-01",
        "3 Sep 24 10:00": "2024-09-03",
    }
    assert column(lambda x: dates.mail_day(x, TODAY), list(cases)) == list(cases.values())


def test_strict_form_agrees_with_the_lenient_parser(column):
    rng = random.Random(9)
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    texts = []
    for _ in range(400):
        text = f"{rng.randint(1, 32)} {rng.choice(months)} {rng.randint(1000, 2999)}"
        text += f" {rng.randint(0, 25):02}:{rng.randint(0, 61):02}"
        text += rng.choice(["", ":00", ":59", ":60"])
        text += rng.choice(["", " GMT", " UTC", " -0700", " +0530", " +2359"])
        texts.append(rng.choice(["", "Tue, ", "Sun, "]) + text)
    strict = column(dates.strict_mail_day, texts)
    lenient = column(lambda x: dates._lenient_day(TODAY)(x), texts)
    assert sum(day is not None for day in strict) > 200
    assert all(fast in (None, slow) for fast, slow in zip(strict, lenient))


def test_canonical_day(column):
    texts = ["2024-03-01", "2024-3-1", "2024-13-01", " 2024-03-01", "03/01/2024", "", None, "0001-01-01"]
    day = datetime.date
    assert column(dates.canonical_day, texts) == [
        day(2024, 3, 1), None, None, None, None, None, None, day(1, 1, 1)
    ]


def test_a_canonical_day_is_what_its_cast_prints(column, spark, plan):
    rng, forms = random.Random(8), ["2024-02-29", "0000-12-31", "9999-01-30", "12024-1-05", "2024-1-05 ", "+2024-1-05", "-2024-1-05"]
    texts = ["2024-01-5 ", "2024-01-5T", "2024-01-5\t", "2024-01-5５", "2024-02-30", "2024-01-T5", "-024-01-05"]
    for _ in range(3000):
        text = list(rng.choice(forms))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(["0", "1", "9", "-", " ", "T", "\t", "é", "", ":", "٣"])
        texts.append("".join(text))
    printed = lambda x: x.try_cast("date").cast("string")
    expected = column(lambda x: F.when((F.length(x) == 10) & (printed(x) == x), printed(x)), texts)
    assert column(lambda x: dates.canonical_day(x).cast("string"), texts) == expected
    assert 300 < sum(day is not None for day in expected) < 2000
    text = spark.range(9).select(F.concat(F.lit("2024-01-0"), "id").alias("tx_date"))
    text = plan(tables.with_day(text))
    assert text.count("try_cast(") == 1 and "date_format" not in text


def test_lookback_excludes_the_boundary(column):
    days = [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), None]
    got = column(lambda x: dates.after_lookback(x, TODAY, 90), days, "date")
    assert got == [False, True, None]


@pytest.mark.parametrize(
    ("period", "start", "end"),
    [
        ("last month", "2024-02-01", "2024-02-29"),
        ("December", "2023-12-01", "2023-12-31"),
        ("march", "2024-03-01", "2024-03-31"),
        (" January ", "2024-01-01", "2024-01-31"),
        ("", "2024-03-01", "2024-03-31"),
        (None, "2024-03-01", "2024-03-31"),
        ("some day", None, None),
    ],
)
def test_period_bounds(column, period, start, end):
    both = column(lambda x: F.struct(*dates.period_bounds(x, F.lit(TODAY))), [period])[0]
    assert tuple(both) == (start, end)
