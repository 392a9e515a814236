import base64
import json

import pytest

from spendlake.functions.html import html_text, page_text
from spendlake.operators.messages import parse_messages
from tests.conftest import TODAY


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p> a <b>b</b>c&amp;d </p>", "a\nb\nc&d"),
        ("<script>var t='</p>x';</script>y<style>p{}</style>", "y"),
        ("<template><p>in</p></template>out", "out"),
        ("<div><template>in</div>out", "out"),
        ("a<!-- c -->b<br>c<br/>d", "a\nb\nc\nd"),
        ("<!DOCTYPE html><?pi x?>t", "t"),
        ("&nbsp;x&nbsp;y&nbsp;", "x\xa0y"),
        ("&#233;&#xe9;&copy;&unknown;z", "éé©&unknownz"),
        ("no markup", "no markup"),
        ("<p>unclosed <b>tags", "unclosed\ntags"),
        ("  \n ", ""),
        ("", ""),
    ],
)
def test_page_text(html, text):
    assert page_text(html) == text


def test_html_text_keeps_nulls(column):
    assert column(html_text, [None, "<b>x</b>"]) == [None, "x"]


def coded(text):
    data = text if isinstance(text, bytes) else text.encode()
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def body(mime, text):
    return {"mimeType": mime, "body": {"data": coded(text)}}


HEAD = "From: a@b\nSubject: S\nDate: Tue, 3 Sep 2024 23:59:00 -0700\n"
PLAIN = HEAD + "Content-Type: text/plain; charset=utf-8\n\n"


def mime(text):
    return {"id": "1", "raw": coded(text)}


MULTIPART = (
    HEAD + 'Content-Type: multipart/alternative; boundary="x"\n\n'
    "--x\nContent-Type: text/html\n\n<b>h</b>\n--x\nContent-Type: text/plain\n\nplain\n--x--\n"
)

# message, (subject, sender, day, body) or "error"
CASES = [
    (mime(PLAIN + "hello"), ("S", "a@b", "2024-09-03", "hello")),
    (mime(MULTIPART), ("S", "a@b", "2024-09-03", "plain")),
    (mime(HEAD + "Content-Type: text/html\n\n<p>a<b>b</b>"), ("S", "a@b", "2024-09-03", "a\nb")),
    (mime("Subject: =?utf-8?q?caf=C3=A9?=\n\nx"), ("café", "(Unknown)", None, "x")),
    (mime("Subject:\nFrom:\n\nx"), ("(No Subject)", "(Unknown)", None, "x")),
    (
        mime(HEAD.encode() + b"Content-Type: text/plain; charset=no-such\n\nab\xffc"),
        ("S", "a@b", "2024-09-03", "ab�c"),
    ),
    ({"id": "1", "raw": ""}, ("(No Subject)", "(Unknown)", None, "")),
    ({"id": "1", "raw": None}, "error"),
    ({"id": "1", "raw": "AAAAA"}, "error"),
    ({"id": "1", "raw": 5}, "error"),
    ({"id": "1"}, ("(No Subject)", "(Unknown)", None, "")),
    ({"id": "1", "payload": None}, "error"),
    ({"id": "1", "payload": []}, "error"),
    ("{broken", "error"),
    ("[1]", "error"),
    ('{"id":"1"} x', "error"),
    (None, "error"),
]

HTML, TEXT = body("text/html", "<i>h</i>"), body("text/plain", "plain")
TREES = [
    ({"parts": [HTML, TEXT]}, "h"),
    ({"parts": [TEXT, HTML]}, "plain"),
    ({"parts": [{"mimeType": "image/png"}, TEXT]}, "plain"),
    ({"parts": [{"mimeType": "text/plain", "body": {}}, HTML]}, "h"),
    ({"parts": [{"mimeType": "multipart/mixed", "parts": []}, TEXT], "body": {"data": coded("top")}}, "top"),
    ({"parts": [{"mimeType": "multipart/a", "parts": [{"mimeType": "multipart/b", "parts": [TEXT]}]}]}, "plain"),
    ({"parts": [{"mimeType": "multipart/a", **body("multipart/a", "own")}, TEXT]}, "own"),
    ({"parts": [], "body": {"data": coded("<b>k</b>")}, "mimeType": "text/html"}, "<b>k</b>"),
    ({"mimeType": "text/html", "body": {"data": coded("<b>k</b>")}}, "k"),
    ({"mimeType": "text/html", "body": {"data": coded("<script>k</script>")}}, "<script>k</script>"),
    ({"body": {"data": coded(b"a\xffb")}}, "a�b"),
    ({"parts": [{"body": {"data": coded("x")}}]}, "error"),
    ({"parts": [{"mimeType": None}]}, "error"),
    ({"parts": ["text"]}, "error"),
    ({"body": {"data": "AAAAA"}}, "error"),
    ({"headers": [{"value": "no name"}]}, "error"),
    ({"headers": None}, "error"),
    ({}, ""),
]


def parsed(spark, messages):
    rows = [
        (f"{i:03}", m if m is None or isinstance(m, str) else json.dumps(m))
        for i, m in enumerate(messages)
    ]
    df = spark.createDataFrame(rows, "raw_path string, text string")
    return parse_messages(df, TODAY).orderBy("raw_path").collect()


def test_messages(spark):
    got = [
        "error" if r.error else (r.subject, r.from_addr, r.date, r.body_text)
        for r in parsed(spark, [m for m, _ in CASES])
    ]
    assert got == [expected for _, expected in CASES]


def test_payload_trees(spark):
    rows = parsed(spark, [{"id": "1", "payload": p} for p, _ in TREES])
    assert ["error" if r.error else r.body_text for r in rows] == [b for _, b in TREES]


def test_tree_headers(spark):
    headers = [
        {"name": "SUBJECT", "value": "first"},
        {"name": "subject", "value": "second"},
        {"name": "From", "value": ""},
        {"name": "Date", "value": "3 Sep 2024 10:00:00 +0000"},
    ]
    row = parsed(spark, [{"id": 7, "payload": {"headers": headers}}])[0]
    assert (row.id, row.subject, row.from_addr, row.date) == ("7", "first", "(Unknown)", "2024-09-03")


def test_parsed_once(spark, plan):
    df = spark.createDataFrame([("p", "{}")], "raw_path string, text string")
    assert plan(parse_messages(df, TODAY)).count("_mime_fields(") == 1


@pytest.fixture
def headers_of(spark):
    def found(headers):
        row = parsed(spark, [{"id": "1", "payload": {"headers": headers}}])[0]
        return row.error or (row.subject, row.from_addr, row.date and str(row.date))

    return found


def test_a_header_without_a_name_matters_before_the_first_match_only(headers_of):
    needed = [{"name": n, "value": v} for n, v in (("Subject", "S"), ("From", "a@b"), ("Date", "3 Sep 2024 10:00:00"))]
    read = ("S", "a@b", "2024-09-03")
    assert headers_of([*needed, {"value": "nameless"}, None, {"name": None}]) == read
    for i in range(3):
        assert headers_of([*needed[:i], {"value": "nameless"}, *needed[i:]]) == "malformed headers"
    assert headers_of([*needed[:2], {"value": "nameless"}]) == "malformed headers"  # no date before it
    assert headers_of([*needed, {"name": "subject", "value": "later"}, {"value": "nameless"}]) == read


def test_very_long_mail_is_kept(spark):
    long = "word " * 5_000_000  # 25 MB, a third more in base64
    row = parsed(spark, [mime(PLAIN + long)])[0]
    assert row.error is None and row.body_text == long


def test_a_repeated_key_counts_with_its_last_value(spark):
    text = '{"id":"1","id":"2","raw":"AAAAA","raw":"%s"}' % coded(PLAIN + "x")
    assert parsed(spark, [text])[0].id == "2"
    tree = '{"id":"3","payload":{"body":{"data":"AAAAA"},"body":{"data":"AAAAA","data":"%s"}}}' % coded("last")
    assert parsed(spark, [tree])[0].body_text == "last"


def test_python_holds_few_messages_at_a_time(spark, plan):
    """Vectorised functions get 10,000 messages in one batch, plain ones a hundred."""
    df = spark.createDataFrame([("a.json", "{}")], "raw_path string, text string")
    shown = plan(parse_messages(df, TODAY))
    assert "BatchEvalPython [_mime_fields" in shown and "ArrowEvalPython [_mime_fields" not in shown
