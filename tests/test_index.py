"""The stored index against a search of all mails, and what it reads."""

import random
from collections import Counter

import pytest

from spendlake.operators import search
from tests.test_ledger import formatted

MAILS = "id string, subject string, body_text string"


def mails(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Invoice", "paid", "été", "x1", "the-of", "", "  ", "PAID!", "日本"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    return [(f"m{i}", rng.choice([None, "", text()]), rng.choice([None, text()])) for i in range(n)]


def test_postings_equal_counts(spark):
    import re

    rows = [*mails(1, 80), (None, "a a", "b")]
    expected = Counter()
    for own, subject, body in rows:
        for field, text in (("subject", subject), ("body_text", body)):
            for word in re.split(r"[\W_]+", (text or "").lower()):
                if word:
                    expected[word, own, field] += 1
    got = {(r.term, r.id, r.field): r.tf for r in search.postings(spark.createDataFrame(rows, MAILS)).collect()}
    assert got == expected


def test_postings_need_no_exchange(spark, plan):
    assert "Exchange" not in plan(search.postings(spark.createDataFrame(mails(1, 3), MAILS)))


def test_postings_split_a_text_once(spark, plan):
    text = plan(search.postings(spark.createDataFrame(mails(1, 3), MAILS)))
    assert text.count("split(") == 1 and "array_sort(" not in text


@pytest.mark.parametrize("query", ["the", "THE of", "invoice paid été", "nothing here", "", "!", "日本 x1", "the the"])
def test_index_equals_a_search_of_all_mails(spark, tmp_path, query):
    rows, path = mails(2, 120), f"{tmp_path}/index"
    emails = spark.createDataFrame(rows, MAILS)
    search.append_index(emails, path, "a")
    search.append_index(spark.createDataFrame(rows[:50], MAILS), path, "a")
    search.append_index(spark.createDataFrame(rows[50:], MAILS), path, "b")
    expected = [tuple(r) for r in search.search(emails, query).collect()]
    assert [tuple(r) for r in search.search_index(spark, path, query).collect()] == expected


def test_only_the_folders_of_the_words_are_read(spark, tmp_path):
    path = f"{tmp_path}/index"
    search.append_index(spark.createDataFrame(mails(3, 40), MAILS), path, "a")
    text = formatted(search.search_index(spark, path, "invoice paid"))
    filters = next(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "term_bucket" in filters and "PushedFilters: [In(term" in text
