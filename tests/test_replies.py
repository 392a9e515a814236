import json

import pytest
from pyspark.sql import functions as F

from spendlake.functions import replies
from spendlake.plans.ask import intents
from spendlake.plans.ledger import reply_transactions

REPLIES = [
    # reply, (merchant, cents, currency, date, category) or None
    ('{"merchant":"Uber","amount":9.5,"currency":"EUR","date":"2024-03-01","category":"Transport"}',
     ("Uber", 950, "EUR", "2024-03-01", "Transport")),
    ('{"amount":5}', ("Unknown", 500, "USD", None, "Other")),
    ('{"merchant":null,"amount":12.345,"currency":null,"category":null}',
     (None, 1234, None, None, None)),
    ("{}", None),
    ('Sure: {"merchant":"Cafe","amount":"3.50"} done', ("Cafe", 350, "USD", None, "Other")),
    ('{"merchant":"Cafe","amount":"$3.50"}', None),
    ("no json here", None),
    (None, None),
    ('[{"amount":1}]', None),
    ('"amount"', None),
    ('[1] {"amount":7}', ("Unknown", 700, "USD", None, "Other")),
    ('{"amount":7} {"amount":8}', None),
    ("} {", None),
    ('{"merchant":"Zero","amount":0,"date":"03/01/2024"}', ("Zero", 0, "USD", "03/01/2024", "Other")),
    ('{"amount":-2.5,"merchant":""}', ("", -250, "USD", None, "Other")),
    ('{"amount":1,"merchant":"a","amount":2,"merchant":"b"}', ("b", 200, "USD", None, "Other")),
    ('so {"amount":1,"amount":{"x":1}}', None),
    ('{"amount":1,"merchant":"%s"}' % ("m" * 21_000_000), ("m" * 21_000_000, 100, "USD", None, "Other")),
]


def test_reply_transactions(spark):
    rows = [(f"m{i:02}", reply) for i, (reply, _) in enumerate(REPLIES)]
    found = reply_transactions(spark.createDataFrame(rows, "email_id string, reply string"))
    got = {
        r.email_id: (r.merchant, r.amount_cents, r.currency, r.tx_date, r.category)
        for r in found.collect()
    }
    expected = {f"m{i:02}": row for i, (_, row) in enumerate(REPLIES) if row is not None}
    assert got == expected


AMOUNTS = [
    "12.345", "0.005", "1.005", "1e2", "-0.015", "2.5e-3", "true", "false", "null", '"true"',
    '"1_000"', '"1__0"', '"12.5f"', '"nan"', '"inf"', '" 7.25 "', '"+.5"', '"5."', '""', '"0x10"',
    "[1]", "{}", "123456789012345", '"1e3"', "1e400", "0.1", "19.99", "1234567.895",
]


def python_cents(text):
    try:
        return int(round(float(json.loads(text)) * 100))
    except (TypeError, ValueError, OverflowError):
        return None


def test_cents_equal_python(column):
    def cents(x):
        return replies.amount_cents(F.try_parse_json(F.concat(F.lit('{"amount":'), x, F.lit("}"))))

    assert column(cents, AMOUNTS) == [python_cents(a) for a in AMOUNTS]


@pytest.mark.parametrize("text", ['{"a":1} x', "[1] [2]", "1,2", "", "{'a':1}", '{"a":1,}', "{"])
def test_strict_json_rejects(column, text):
    assert column(lambda x: replies.strict_json(x).isNull(), [text]) == [True]


@pytest.mark.parametrize("text", ['{"a":[1,{"b":null}]}', " [1, 2]\n", "null", '"x"', "-1.5e3"])
def test_strict_json_accepts(column, text):
    got = column(lambda x: F.to_json(replies.strict_json(x)), [text])[0]
    assert json.loads(got) == json.loads(text)


def test_intents(spark):
    rows = [
        (0, '```json\n{"merchant":"caf","metric":"sum"}\n```'),
        (1, "{}"),
        (2, '{"merchant":null,"start_date":"2024-01-01","end_date":""}'),
        (3, "nope"),
        (4, '{"merchant":0,"metric":"sum"}'),
        (5, '{"merchant":5,"start_date":false,"end_date":[]}'),
        (6, '{"merchant":"x"} trailing'),
        (7, '["merchant"]'),
        (8, '```\n{"merchant":"x"}\n```'),
        (9, None),
        (10, '{"other":1}'),
        (11, '{"merchant":"false","metric":0.0}'),
    ]
    got = intents(spark.createDataFrame(rows, "qid long, reply string")).orderBy("qid").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("caf", None, None, "sum", True),
        (None, None, None, None, False),
        (None, "2024-01-01", None, None, True),
        (None, None, None, None, False),
        (None, None, None, "sum", True),
        ("5", None, None, None, True),
        (None, None, None, None, False),
        (None, None, None, None, False),
        (None, None, None, None, False),
        (None, None, None, None, False),
        (None, None, None, None, True),
        ("false", None, None, None, True),
    ]
