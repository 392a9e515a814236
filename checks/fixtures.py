"""Inputs of the engine, derived from the driver tables.

Each fixture is one SQL text for both engines. ``{name}`` is a table or
another fixture; ``$name`` is an expression that the engines spell
differently.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Spelling in Spark and in DuckDB.
DIALECT = {
    "cents": ("rint(l_extendedprice * 100)", "round_even(l_extendedprice * 100, 0)"),
    "doc_base64": ("replace(base64(encode(mime, 'UTF-8')), chr(13) || chr(10), '')", "to_base64(encode(mime))"),
    "page_base64": ("replace(base64(encode(html, 'UTF-8')), chr(13) || chr(10), '')", "to_base64(encode(html))"),
    "text_hash": ("sha2(body_text, 256)", "sha256(body_text)"),
    "doc_day": (
        "date_format(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), 'd MMM yyyy')",
        "strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%-d %b %Y')",
    ),
    "order_day": (
        "date_format(o_orderdate, 'd MMM yyyy')",
        "strftime(o_orderdate, '%-d %b %Y')",
    ),
    "order_iso": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "order_hash": (
        "sha2(concat(CAST(CAST(o_orderdate AS DATE) AS STRING), o_orderpriority), 256)",
        "sha256(concat(CAST(CAST(o_orderdate AS DATE) AS STRING), o_orderpriority))",
    ),
    "word_code": ("ascii(word)", "ascii(word)"),
}

FIXTURES = {
    # Mails, one per document. NULL dates and subjects, copies of bodies,
    # receipt words in subjects and in some bodies.
    "emails_v": """
        SELECT id, date, from_addr, subject, body_text, raw_path, $text_hash AS content_hash FROM (
          SELECT 'm' || CAST(doc_id AS STRING) AS id,
            CASE WHEN doc_id % 11 = 0 THEN NULL
                 ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS STRING) END AS date,
            source || '@example.com' AS from_addr,
            CASE doc_id % 5 WHEN 0 THEN 'Your receipt ' || CAST(doc_id AS STRING)
              WHEN 1 THEN 'Invoice ' || CAST(doc_id AS STRING)
              WHEN 2 THEN 'Weekly notes' WHEN 3 THEN 'Reorder soon' ELSE NULL END AS subject,
            text || CASE WHEN n_chars % 7 = 0 THEN ' total paid' ELSE '' END AS body_text,
            'raw/' || lpad(CAST(doc_id AS STRING), 12, '0') || '.json' AS raw_path
          FROM {documents}) AS d""",
    # The same mails where those of one language have no id.
    "emails_null_v": """
        SELECT CASE WHEN lang = 'fr' THEN NULL ELSE 'm' || CAST(doc_id AS STRING) END AS id,
          raw_path FROM {documents} JOIN {emails_v} ON id = 'm' || CAST(doc_id AS STRING)""",
    # What is stored already: the labelled documents, and a row without an id.
    "stored_v": """
        SELECT 'm' || CAST(doc_id AS STRING) AS email_id FROM {labels}
        UNION ALL SELECT CAST(NULL AS STRING) AS email_id FROM {region} WHERE r_regionkey = 0""",
    "stored_emails_v": """
        SELECT e.* FROM {emails_v} e JOIN {labels} ON e.id = 'm' || CAST(doc_id AS STRING)""",
    # Transactions, one per line item. NULL dates and currencies, repeated ids.
    "tx_v": """
        SELECT 'tx_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS id,
          CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS email_id,
          p_name AS merchant, CAST($cents AS BIGINT) AS amount_cents,
          CASE n_regionkey WHEN 0 THEN 'ZAR' WHEN 1 THEN 'USD' WHEN 2 THEN 'INR'
                           WHEN 3 THEN 'EUR' ELSE NULL END AS currency,
          CASE WHEN l_orderkey % 97 = 0 THEN NULL
               ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS tx_date,
          p_type AS category, CAST(1.0 AS DOUBLE) AS confidence
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
          JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    # Transactions already stored: those of one supplier nation's region.
    "stored_tx_v": """
        SELECT DISTINCT 'tx_' || CAST(l_orderkey AS STRING) || '_'
          || CAST(l_linenumber AS STRING) AS id
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    # Model replies, one per order, in ten shapes.
    "replies_v": """
        SELECT 'm' || CAST(o_orderkey AS STRING) AS email_id, o_orderkey, o_totalprice,
          CASE o_orderkey % 10
          WHEN 0 THEN '{{"merchant":"Uber","amount":'
            || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)
            || ',"currency":"EUR","date":"2024-03-01","category":"Transport"}}'
          WHEN 1 THEN '{{"amount":' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || '}}'
          WHEN 2 THEN '{{"merchant":null,"amount":12.345,"currency":null,"category":null}}'
          WHEN 3 THEN '{{}}'
          WHEN 4 THEN 'Sure: {{"merchant":"Cafe","amount":"3.50"}} done'
          WHEN 5 THEN '{{"merchant":"Cafe","amount":"$3.50"}}'
          WHEN 6 THEN 'no json here' WHEN 7 THEN '[{{"amount":1}}]'
          WHEN 8 THEN '[1] {{"amount":true,"merchant":"' || o_orderpriority || '"}}'
          ELSE '{{"merchant":"Zero","amount":0,"date":"03/01/2024"}}' END AS reply
        FROM {orders}""",
    # Replies for the mails of emails_v.
    "mail_replies_v": """
        SELECT 'm' || CAST(doc_id AS STRING) AS email_id,
          CASE WHEN n_chars % 3 = 0 THEN '{{}}'
               ELSE '{{"merchant":"' || source || '","amount":' || CAST(n_chars AS STRING)
                    || '.5,"date":"2024-02-03"}}' END AS reply
        FROM {documents}""",
    # Questions: a word of the merchant and a year; a nation's name or none at
    # all and an open range; everything.
    "questions_v": """
        SELECT CAST(yr * 100000 + $word_code * 100 + length(word) AS BIGINT) AS qid,
          CASE WHEN yr % 3 = 0 THEN substr(word, 1, 1) || '_' || substr(word, 3)
               ELSE upper(word) END AS merchant,
          CAST(yr AS STRING) || '-01-01' AS start_date, CAST(yr AS STRING) || '-12-31' AS end_date,
          CASE WHEN yr % 2 = 0 THEN 'sum' ELSE 'list' END AS metric
        FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS word, 1995 + p_size % 7 AS yr
              FROM {part}) AS w
        UNION ALL
        SELECT CAST(n_nationkey AS BIGINT) AS qid,
          CASE WHEN n_regionkey = 4 THEN n_name WHEN n_regionkey = 3 THEN 'w%g_t'
               WHEN n_regionkey = 2 THEN '' ELSE NULL END AS merchant,
          CASE WHEN n_nationkey % 3 = 0 THEN NULL
               ELSE CAST(1995 + n_nationkey % 7 AS STRING) || '-03-15' END AS start_date,
          CASE WHEN n_nationkey % 4 = 0 THEN NULL
               WHEN n_nationkey % 4 = 1 THEN '1999-11'
               ELSE '2000-0' || CAST(1 + n_nationkey % 9 AS STRING) || '-30' END AS end_date,
          'sum' AS metric
        FROM {nation}
        UNION ALL
        SELECT CAST(1000 + r_regionkey AS BIGINT) AS qid, CAST(NULL AS STRING) AS merchant,
          '2001-0' || CAST(1 + r_regionkey AS STRING) || '-05' AS start_date,
          '2001-0' || CAST(1 + r_regionkey AS STRING) || '-25' AS end_date, 'list' AS metric
        FROM {region}""",
    # The same questions as model replies, some fenced; one per region unclear.
    "intent_replies_v": """
        SELECT qid, CASE WHEN qid % 2 = 0 THEN body ELSE '```json' || body || '```' END AS reply
        FROM (SELECT qid, '{{"merchant":' || coalesce('"' || merchant || '"', 'null')
                || coalesce(',"start_date":"' || start_date || '"', '')
                || ',"end_date":' || coalesce('"' || end_date || '"', 'null')
                || ',"metric":"' || metric || '"}}' AS body FROM {questions_v}) AS b
        UNION ALL
        SELECT CAST(2000 + r_regionkey AS BIGINT) AS qid,
          CASE WHEN r_regionkey % 2 = 0 THEN 'Sorry, ' || r_name ELSE '{{}}' END AS reply
        FROM {region}""",
    # MIME messages in a JSON envelope: plain text of the documents.
    "doc_messages_v": """
        SELECT 'm' || CAST(doc_id AS STRING) AS id, doc_id,
          'raw/' || lpad(CAST(doc_id AS STRING), 12, '0') || '.json' AS raw_path,
          CASE WHEN doc_id % 50 = 7 THEN '{{"id":"m' || CAST(doc_id AS STRING) || '","raw":null}}'
            ELSE '{{"id":"m' || CAST(doc_id AS STRING) || '","raw":"' || CASE WHEN doc_id % 2 = 0
              THEN trim(trailing '=' FROM replace(replace($doc_base64, '+', '-'), '/', '_'))
              ELSE replace(replace($doc_base64, '+', '-'), '/', '_') END || '"}}' END AS text
        FROM (SELECT doc_id,
          'From: ' || source || '@example.com' || chr(10)
          || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Subject: Receipt ' || CAST(doc_id AS STRING)
             || chr(10) END
          || 'Date: ' || CASE WHEN doc_id % 9 = 0 THEN 'no date'
               ELSE $doc_day || ' 23:30:00 -0700' END || chr(10)
          || 'Content-Type: text/plain; charset=utf-8' || chr(10)
          || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || text AS mime
          FROM {documents}) AS m""",
    # MIME messages of the pages, as HTML only or as HTML beside plain text.
    "page_messages_v": """
        SELECT 'p' || CAST(page_id AS STRING) AS id,
          'raw/' || lpad(CAST(page_id AS STRING), 12, '0') || '.json' AS raw_path,
          '{{"id":"p' || CAST(page_id AS STRING) || '","raw":"'
            || trim(trailing '=' FROM replace(replace($doc_base64, '+', '-'), '/', '_')) || '"}}' AS text
        FROM (SELECT page_id, 'From: shop@example.com' || chr(10) || 'Subject: Page '
          || CAST(page_id AS STRING) || chr(10) || 'Date: Tue, 3 Sep 2024 23:59:00 -0700' || chr(10)
          || CASE WHEN page_id % 2 = 0 THEN 'Content-Type: text/html; charset=utf-8' || chr(10)
                 || chr(10) || html
               ELSE 'Content-Type: multipart/alternative; boundary=x1x' || chr(10) || chr(10)
                 || '--x1x' || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(10)
                 || chr(10) || html || chr(10) || '--x1x' || chr(10)
                 || 'Content-Type: text/plain; charset=utf-8' || chr(10) || chr(10) || url || chr(10)
                 || '--x1x--' || chr(10) END AS mime
          FROM {pages}) AS m""",
    # Payload trees of the pages, in four shapes.
    "trees_v": """
        SELECT 't' || CAST(page_id AS STRING) AS id,
          'raw/' || lpad(CAST(page_id AS STRING), 12, '0') || '.json' AS raw_path,
          '{{"id":"t' || CAST(page_id AS STRING) || '","payload":{{"mimeType":"'
          || CASE WHEN page_id % 4 = 3 THEN 'text/html' ELSE 'multipart/mixed' END || '",'
          || '"headers":[{{"name":"SUBJECT","value":"Tree ' || CAST(page_id AS STRING)
          || '"}},{{"name":"Subject","value":"second"}},{{"name":"from","value":""}}],'
          || CASE page_id % 4
             WHEN 0 THEN '"parts":[{{"mimeType":"image/png"}},{{"mimeType":"text/html","body":{{"data":"'
               || b64 || '"}}}},{{"mimeType":"text/plain","body":{{"data":"cGxhaW4"}}}}]'
             WHEN 1 THEN '"parts":[{{"mimeType":"multipart/alternative","parts":[]}},'
               || '{{"mimeType":"text/plain","body":{{"data":"cGxhaW4"}}}}],"body":{{"data":"'
               || b64 || '"}}'
             WHEN 2 THEN '"parts":[{{"mimeType":"text/plain","body":{{}}}},'
               || '{{"mimeType":"multipart/alternative","parts":['
               || '{{"mimeType":"text/plain","body":{{"data":"cGxhaW4"}}}}]}}]'
             ELSE '"body":{{"data":"' || b64 || '"}}' END || '}}}}' AS text
        FROM (SELECT page_id, trim(trailing '=' FROM replace(replace($page_base64, '+', '-'), '/', '_')) AS b64
              FROM {pages}) AS p""",
    # Rows offered under two keys: customers as ids, day and priority as body.
    "rivals_v": """
        SELECT lpad(CAST(o_orderkey AS STRING), 12, '0') AS raw_path,
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL
               ELSE 'c' || CAST(o_custkey AS STRING) END AS id,
          $order_hash AS content_hash
        FROM {orders}""",
    "stored_rivals_v": """
        SELECT 'c' || CAST(n_nationkey AS STRING) AS id, n_name AS content_hash FROM {nation}""",
}

# Text of a page, for the markup and the entities that the driver pages have.
PAGE_TEXT_SQL = r"""array_to_string(list_filter(list_transform(string_split(
  regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>', chr(1), 'g'),
  chr(1)), lambda x: regexp_replace(replace(replace(replace(replace(x, '&middot;', '·'), '&copy;',
  '©'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"""

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _spelled(text: str, engine: int) -> str:
    for name, spelling in DIALECT.items():
        text = text.replace("$" + name, spelling[engine])
    return text


def _needs(text: str) -> list[str]:
    return sorted(set(_NAME.findall(text)))


class Inputs:
    """Driver tables and fixtures as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(
            _spelled(text, 0), **{name: getattr(self, name) for name in _needs(text)}
        )


def oracle(text: str) -> str:
    """DuckDB SQL: fixtures that ``text`` names become common table expressions."""
    ordered: list[str] = []

    def add(sql: str) -> None:
        for name in _needs(sql):
            if name in FIXTURES and name not in ordered:
                add(FIXTURES[name])
                ordered.append(name)

    add(text)
    names = {name: name for name in [*TABLES, *FIXTURES]}
    ctes = [f"{n} AS ({_spelled(FIXTURES[n], 1).format(**names)})" for n in ordered]
    head, body = "WITH ", _spelled(text, 1).format(page_text=PAGE_TEXT_SQL, **names).strip()
    if body.startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", ", " * bool(ctes) + body[len("WITH RECURSIVE ") :]
    elif body.startswith("WITH "):
        body = ", " * bool(ctes) + body[len("WITH ") :]
    elif not ctes:
        return body
    return f"{head}{', '.join(ctes)} {body}"
