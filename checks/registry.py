"""Every registered query with the SQL it must equal.

A query reads the whole tables of the scale-factor folder through
``checks.fixtures``. Similarities are rounded to 6 digits.
"""

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import Inputs, oracle
from spendlake.functions import codec, dates, html, render, replies, text, vectors
from spendlake.operators import antijoin, dedup, hooks, match, messages, search, similar, topk, totals
from spendlake.plans import ask, embed, imports, ledger
from spendlake.plans.query import filter_transactions, run_query
from spendlake.sources import landing, tables
from spendlake.sources.keys import KeySet
from spendlake.sources.ledger import Ledger
from spendlake.staging import stage_path

TODAY = datetime.date(2024, 3, 31)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None = None):
    """Register ``fn(inputs)`` under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return register


# --- One question over the transactions -------------------------------------

_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MERCHANT = _FOLDED.format("merchant")


@check(f"""
    SELECT currency, CAST(SUM(amount_cents) AS BIGINT) AS total FROM {{tx_v}}
    WHERE {_MERCHANT} LIKE '%widget%' AND tx_date >= '1997-01-01' AND tx_date <= '1997-12-31'
    GROUP BY currency""")
def spend_by_currency(t):
    return run_query(t.tx_v, "Widget", "1997-01-01", "1997-12-31", "sum")


@check(f"""
    SELECT merchant, amount_cents, currency, tx_date, category FROM {{tx_v}}
    WHERE {_MERCHANT} LIKE '%ring%' AND tx_date >= '1998-06-01'""")
def transaction_list(t):
    return run_query(t.tx_v, "RING", "1998-06-01", "", "list")


@check(f"SELECT id, merchant, amount_cents FROM {{tx_v}} WHERE {_MERCHANT} LIKE '%w_dg%t%'")
def merchant_contains(t):
    found = t.tx_v.filter(text.merchant_contains(F.col("merchant"), "W_DG%T"))
    return found.select("id", "merchant", "amount_cents")


@check("SELECT id, tx_date, amount_cents FROM {tx_v} WHERE tx_date >= '1999-07-15'")
def dated_from(t):
    found = filter_transactions(t.tx_v, start_date="1999-07-15")
    return found.select("id", "tx_date", "amount_cents")


@check("SELECT id, tx_date, amount_cents FROM {tx_v} WHERE tx_date <= '1999-07'")
def dated_until(t):
    found = filter_transactions(t.tx_v, end_date="1999-07")
    return found.select("id", "tx_date", "amount_cents")


_COMBINATIONS = [
    ("none", (None, "", None), "1 = 1"),
    ("merchant", ("BOLT", None, None), f"{_MERCHANT} LIKE '%bolt%'"),
    ("start", ("", "1996-02-03", ""), "tx_date >= '1996-02-03'"),
    ("end", (None, None, "1996-02-03"), "tx_date <= '1996-02-03'"),
    (
        "all",
        ("red", "1996-02-03", "1997-02-03"),
        f"{_MERCHANT} LIKE '%red%' AND tx_date >= '1996-02-03' AND tx_date <= '1997-02-03'",
    ),
]


@check(
    " UNION ALL ".join(
        f"SELECT '{name}' AS filters, COUNT(*) AS n, CAST(SUM(amount_cents) AS BIGINT) AS cents"
        f" FROM {{tx_v}} WHERE {where}"
        for name, _, where in _COMBINATIONS
    )
)
def optional_filters(t):
    out = None
    for name, arguments, _ in _COMBINATIONS:
        found = filter_transactions(t.tx_v, *arguments).agg(
            F.count("*").alias("n"), F.sum("amount_cents").alias("cents")
        )
        row = found.select(F.lit(name).alias("filters"), "n", "cents")
        out = row if out is None else out.unionByName(row)
    return out


@check("""
    SELECT currency, CAST(SUM(amount_cents) AS BIGINT) AS total FROM {tx_v} GROUP BY currency""")
def currency_totals(t):
    return totals.total_by_currency(t.tx_v)


# --- Many questions ----------------------------------------------------------

_ASKED = f"""({_FOLDED.format("t.merchant")} LIKE
    '%' || {_FOLDED.format("q.merchant")} || '%' OR coalesce(q.merchant, '') = '')
  AND (q.start_date IS NULL OR t.tx_date >= q.start_date)
  AND (q.end_date IS NULL OR t.tx_date <= q.end_date)"""


_QUESTION_TOTALS = f"""
    SELECT qid, currency, CAST(SUM(amount_cents) AS BIGINT) AS total
    FROM {{questions_v}} q JOIN {{tx_v}} t ON {_ASKED} GROUP BY qid, currency"""


@check(_QUESTION_TOTALS)
def question_totals(t):
    return match.totals_by_question(t.questions_v, t.tx_v)


def _ledger(t) -> Ledger:
    """The transactions in two runs, one of them tried twice."""
    made = Ledger(t.spark, stage_path(t.spark, "ledger")).create()
    odd = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    for run, part in (("one", t.tx_v), ("one", t.tx_v.filter(odd)), ("two", t.tx_v.filter(~odd))):
        made.append(part, run)
    return made


@check(_QUESTION_TOTALS)
def ledger_question_totals(t):
    """From a stored ledger: open questions by its summaries, others by the months asked about."""
    return _ledger(t).totals(t.questions_v)


@check(f"""
    SELECT qid, id, amount_cents, tx_date
    FROM {{questions_v}} q JOIN {{tx_v}} t ON {_ASKED} AND q.metric = 'list'""")
def question_transactions(t):
    listed = t.questions_v.filter("metric = 'list'")
    found = match.transactions_by_question(listed, t.tx_v)
    return found.select("qid", "id", "amount_cents", "tx_date")


_SUM_LINE = """printf('Total spent: %.2f %s', coalesce(total, 0) / 100.0,
    coalesce(nullif(currency, ''), 'USD'))"""
_LIST_LINE = """printf('- %s: %s (%.2f %s)', coalesce(tx_date, 'None'),
    coalesce(merchant, 'None'), amount_cents / 100.0, coalesce(currency, 'None'))"""
_TOTALS = f"""totals AS (SELECT qid, currency, SUM(amount_cents) AS total
    FROM {{questions_v}} q JOIN {{tx_v}} t ON {_ASKED} AND q.metric = 'sum'
    GROUP BY qid, currency)"""
_FOUND = f"""found AS (SELECT qid, tx_date, t.merchant, amount_cents, currency
    FROM {{questions_v}} q JOIN {{tx_v}} t ON {_ASKED} AND q.metric = 'list')"""
_NO_DATE = "CAST(NULL AS STRING) AS tx_date"


@check(f"""WITH {_TOTALS}
    SELECT qid, 1 AS part, {_NO_DATE}, {_SUM_LINE} AS line FROM totals""")
def sum_lines(t):
    sums = t.questions_v.filter("metric = 'sum'")
    return ask.sum_lines(match.totals_by_question(sums, t.tx_v))


@check(f"""WITH {_FOUND}
    SELECT qid, 1 AS part, tx_date, {_LIST_LINE} AS line FROM found
    UNION ALL SELECT qid, 0, NULL, printf('Found %d transactions:', COUNT(*)) FROM found
    GROUP BY qid""")
def list_lines(t):
    lists = t.questions_v.filter("metric = 'list'")
    found = match.transactions_by_question(lists, t.tx_v)
    return ask.list_lines(found, ask.list_counts(found))


@check(f"""
    SELECT qid, 0 AS part, {_NO_DATE}, '{render.NO_MATCH}' AS line FROM {{questions_v}} q
    WHERE NOT EXISTS (SELECT 1 FROM {{tx_v}} t WHERE {_ASKED})""")
def no_match_lines(t):
    return ask.no_match_lines(t.questions_v, match.totals_by_question(t.questions_v, t.tx_v))


_ANSWERS = f"""WITH {_TOTALS}, {_FOUND}
    SELECT qid, 1 AS part, {_NO_DATE}, {_SUM_LINE} AS line FROM totals
    UNION ALL SELECT qid, 1, tx_date, {_LIST_LINE} FROM found
    UNION ALL SELECT qid, 0, NULL, printf('Found %d transactions:', COUNT(*)) FROM found
    GROUP BY qid
    UNION ALL SELECT qid, 0, NULL, '{render.NO_MATCH}' FROM {{questions_v}}
    WHERE qid NOT IN (SELECT qid FROM totals) AND qid NOT IN (SELECT qid FROM found)
    UNION ALL SELECT qid, 0, NULL, '{render.NOT_UNDERSTOOD}' FROM {{intent_replies_v}}
    WHERE qid BETWEEN 2000 AND 2999"""


@check(_ANSWERS)
def ask_many(t):
    return ask.ask_many(t.intent_replies_v, t.tx_v)


@check(_ANSWERS)
def ask_ledger(t):
    return ask.ask_ledger(t.intent_replies_v, _ledger(t))


@check("""
    SELECT qid, nullif(merchant, '') AS merchant, start_date, end_date, metric, TRUE AS understood
    FROM {questions_v}
    UNION ALL SELECT qid, NULL, NULL, NULL, NULL, FALSE FROM {intent_replies_v}
    WHERE qid BETWEEN 2000 AND 2999""")
def intents(t):
    return ask.intents(t.intent_replies_v)


@check("""
    SELECT o_orderkey,
      CAST(CASE o_orderkey % 3 WHEN 0 THEN day - INTERVAL 30 DAY
        WHEN 1 THEN date_trunc('month', day) - INTERVAL 1 MONTH
        ELSE make_date(yr - CASE WHEN num > month(day) THEN 1 ELSE 0 END, num, 1) END
        AS DATE)::VARCHAR AS start_date,
      CAST(CASE o_orderkey % 3 WHEN 0 THEN day
        WHEN 1 THEN date_trunc('month', day) - INTERVAL 1 DAY
        ELSE last_day(make_date(yr - CASE WHEN num > month(day) THEN 1 ELSE 0 END, num, 1)) END
        AS DATE)::VARCHAR AS end_date
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS yr,
            CAST(1 + o_custkey % 12 AS BIGINT) AS num FROM {orders}) AS o""")
def relative_periods(t):
    months = F.array(*[F.lit(m.title()) for m in dates._MONTHS])
    period = F.expr("CASE o_orderkey % 3 WHEN 1 THEN 'last month' WHEN 2 THEN 'm' END")
    month = F.element_at(months, (1 + F.col("o_custkey") % 12).cast("int"))
    asked = t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(period == "m", month).otherwise(period).alias("period"),
    )
    start, end = dates.period_bounds(F.col("period"), F.col("day"))
    return asked.select("o_orderkey", start.alias("start_date"), end.alias("end_date"))


@check(f"""
    SELECT q.qid, currency, CAST(SUM(amount_cents) AS BIGINT) AS total
    FROM (SELECT CAST(n_nationkey AS BIGINT) AS qid,
            CASE WHEN n_regionkey = 1 THEN NULL ELSE 'gear' END AS merchant,
            CASE n_nationkey % 3 WHEN 0 THEN '1998-02-15' WHEN 1 THEN '1998-02-01'
              ELSE '1997-11-01' END AS start_date,
            CASE n_nationkey % 3 WHEN 0 THEN '1998-03-17' WHEN 1 THEN '1998-02-28'
              ELSE '1997-11-30' END AS end_date FROM {{nation}}) AS q
    JOIN {{tx_v}} t ON {_ASKED} GROUP BY q.qid, currency""")
def period_totals(t):
    asked = t.sql("""
        SELECT CAST(n_nationkey AS BIGINT) AS qid,
          CASE WHEN n_regionkey = 1 THEN NULL ELSE 'gear' END AS merchant,
          CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Last month' ELSE 'November' END
            AS period, 'sum' AS metric FROM {nation}""")
    questions = ask.from_periods(asked, datetime.date(1998, 3, 17))
    return match.totals_by_question(questions, t.tx_v)


# --- Mails: filters, prompts, defaults ---------------------------------------

_WORDS = "|".join(text.RECEIPT_WORDS)


@check(f"""
    SELECT id FROM {{emails_v}}
    WHERE regexp_matches(lower(CASE WHEN subject <> '' THEN subject ELSE body_text END),
      '{_WORDS}')""")
def receipt_candidates(t):
    found = t.emails_v.filter(text.receipt_candidate(F.col("subject"), F.col("body_text")))
    return found.select("id")


@check(f"""
    SELECT id FROM {{emails_v}}
    WHERE regexp_matches(lower(coalesce(subject, '') || ' ' || coalesce(body_text, '')),
      '{_WORDS}')""")
def receipt_candidates_both(t):
    found = text.receipt_candidate(F.col("subject"), F.col("body_text"), "both")
    return t.emails_v.filter(found).select("id")


@check("SELECT id FROM {emails_v} WHERE length(coalesce(body_text, '')) >= 50")
def long_bodies(t):
    return t.emails_v.filter(text.long_enough(F.col("body_text"))).select("id")


@check("""
    SELECT id, coalesce(nullif(subject, ''), '(No Subject)') AS subject,
      CASE WHEN nullif(date, '') IS NULL THEN '(Unknown)' ELSE from_addr END AS from_addr
    FROM {emails_v}""")
def header_defaults(t):
    sender = F.when(F.col("date").isNotNull(), F.col("from_addr")).otherwise("")
    return t.emails_v.select(
        "id",
        text.or_default(F.col("subject"), text.NO_SUBJECT).alias("subject"),
        text.or_default(sender, text.UNKNOWN_SENDER).alias("from_addr"),
    )


@check("""
    SELECT id, 'Subject: ' || coalesce(subject, '') || chr(10) || 'Body: '
      || coalesce(body_text, '') AS text FROM {emails_v}""")
def embedding_inputs(t):
    made = text.embedding_input(F.col("subject"), F.col("body_text"))
    return t.emails_v.select("id", made.alias("text"))


_PROMPT = """'Date: ' || coalesce(date, 'None') || chr(10) || 'Subject: ' || coalesce(subject, '')
  || chr(10) || chr(10) || coalesce(body_text, '')"""


@check(f"SELECT id, {_PROMPT} AS prompt FROM {{emails_v}}")
def extraction_prompts(t):
    made = text.extraction_prompt(F.col("date"), F.col("subject"), F.col("body_text"))
    return t.emails_v.select("id", made.alias("prompt"))


@check("SELECT id, date FROM {emails_v} WHERE CAST(date AS DATE) > DATE '2024-01-01'")
def recent_by_lookback(t):
    day = dates.canonical_day(F.col("date"))
    return t.emails_v.filter(dates.after_lookback(day, TODAY, 90)).select("id", "date")


@check("""
    SELECT date, from_addr, subject FROM {emails_v} ORDER BY date DESC NULLS LAST, id LIMIT 5""")
def recent_mails(t):
    return topk.recent_mails(t.emails_v)


# --- What is not stored yet ----------------------------------------------------


@check("""
    SELECT id, raw_path FROM {doc_messages_v} m
    WHERE NOT EXISTS (SELECT 1 FROM {stored_v} s WHERE s.email_id = m.id)""")
def unlanded_messages(t):
    landed = t.stored_v.withColumnRenamed("email_id", "id")
    return antijoin.skip_landed(t.doc_messages_v.select("id", "raw_path"), landed)


@check("""
    SELECT id, raw_path FROM {emails_v} e WHERE CAST(date AS DATE) > DATE '2024-03-01'
      AND NOT EXISTS (SELECT 1 FROM {stored_v} s WHERE s.email_id = e.id)""")
def messages_to_land(t):
    known = t.emails_v.select("id", "raw_path", dates.canonical_day(F.col("date")).alias("day"))
    landed = t.stored_v.withColumnRenamed("email_id", "id")
    return imports.messages_to_land(known, landed, TODAY, 30).drop("day")


_WITHOUT_VECTOR = """
    SELECT id, raw_path FROM {emails_null_v} e
    WHERE NOT EXISTS (SELECT 1 FROM {stored_v} s WHERE s.email_id = e.id)"""
_WITHOUT_TX = """
    SELECT id, raw_path FROM {emails_null_v} e
    WHERE NOT EXISTS (SELECT 1 FROM {stored_v} s WHERE s.email_id IS NOT DISTINCT FROM e.id)"""


@check(_WITHOUT_VECTOR)
def mails_without_vector(t):
    return antijoin.without_vector(t.emails_null_v, t.stored_v)


@check(_WITHOUT_TX)
def mails_without_tx(t):
    return antijoin.without_tx(t.emails_null_v, t.stored_v)


def _key_set(t, rows: DataFrame, key: str) -> KeySet:
    """The keys of ``rows``, stored in two runs, one of them twice."""
    stored = KeySet(t.spark, stage_path(t.spark, "keys"), buckets=8, blocks=8)
    half = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    for run, part in (("one", rows.filter(half)), ("two", rows), ("two", rows.filter(~half))):
        stored.add(part, key, run)
    return stored


@check(_WITHOUT_VECTOR)
def mails_without_stored_vector(t):
    """From a set of stored keys."""
    return antijoin.without_vector(t.emails_null_v, _key_set(t, t.stored_v, "email_id"))


@check(_WITHOUT_TX)
def mails_without_stored_tx(t):
    return antijoin.without_tx(t.emails_null_v, _key_set(t, t.stored_v, "email_id"))


@check("""
    SELECT id, raw_path, content_hash FROM (
      SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY raw_path) AS rn
      FROM {emails_v}) AS e
    WHERE rn = 1 AND content_hash NOT IN (SELECT content_hash FROM {stored_emails_v})""")
def new_bodies(t):
    rows = t.emails_v.select("id", "raw_path", "content_hash")
    return dedup.first_by_hash(rows, t.stored_emails_v)


def _two_key_rounds(rounds: int) -> str:
    """Each round accepts the rows that come first under both of their keys."""
    parts = [
        """r0 AS MATERIALIZED (SELECT sha256(raw_path) || raw_path AS pos, coalesce('k' || id, 'p' || raw_path) AS a,
             content_hash AS b FROM {rivals_v}
           WHERE content_hash NOT IN (SELECT content_hash FROM {stored_rivals_v})
             AND (id IS NULL OR id NOT IN (SELECT id FROM {stored_rivals_v})))"""
    ]
    for i in range(rounds):
        parts.append(
            f"""w{i} AS MATERIALIZED (SELECT pos, a, b FROM r{i}
              QUALIFY pos = MIN(pos) OVER (PARTITION BY a)
                AND pos = MIN(pos) OVER (PARTITION BY b)),
            r{i + 1} AS MATERIALIZED (SELECT * FROM r{i} WHERE a NOT IN (SELECT a FROM w{i})
              AND b NOT IN (SELECT b FROM w{i}))"""
        )
    won = " UNION ALL ".join(f"SELECT pos FROM w{i}" for i in range(rounds))
    return f"""WITH {", ".join(parts)}
      SELECT id, content_hash, raw_path FROM {{rivals_v}} WHERE sha256(raw_path) || raw_path IN ({won})"""


@check(_two_key_rounds(40))
def two_key_dedup(t):
    offered = t.rivals_v
    return dedup.first_by_two_keys(
        offered, t.stored_rivals_v, "id", "content_hash", "raw_path"
    ).select("id", "content_hash", "raw_path")


@check(_two_key_rounds(40))
def two_key_dedup_stored(t):
    """Against a set of stored keys for each of the two."""
    stored = t.stored_rivals_v
    sets = (_key_set(t, stored, "id"), _key_set(t, stored, "content_hash"))
    found = dedup.first_by_two_keys(t.rivals_v, sets, "id", "content_hash", "raw_path")
    return found.select("id", "content_hash", "raw_path")


@check("""
    SELECT id, amount_cents, merchant, tx_date, currency FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY amount_cents, merchant,
        tx_date NULLS FIRST, currency NULLS FIRST) AS rn FROM {tx_v}) AS x
    WHERE rn = 1 AND id NOT IN (SELECT id FROM {stored_tx_v})""")
def tx_keys(t):
    rows = t.tx_v.select("id", "amount_cents", "merchant", "tx_date", "currency")
    order = ["amount_cents", "merchant", "tx_date", "currency"]
    return dedup.enforce_tx_key(rows, t.stored_tx_v, order)


# --- Tables --------------------------------------------------------------------


@check("""
    SELECT id, date, subject, content_hash FROM {emails_v}
    UNION ALL SELECT id, date, subject, content_hash FROM {stored_emails_v}""")
def appended_emails(t):
    path = stage_path(t.spark, "emails")
    tables.append_emails(t.stored_emails_v, path)
    tables.append_emails(t.emails_v, path)
    stored = tables.read_emails(t.spark, path)
    return stored.select("id", "date", "subject", "content_hash")


@check("""
    SELECT CAST(vec_id AS STRING) AS email_id, len(embedding) AS size FROM {embeddings}
    WHERE label > 2""")
def appended_vectors(t):
    path = stage_path(t.spark, "vectors")
    made = t.embeddings.select(
        F.col("vec_id").cast("string").alias("email_id"),
        F.when(F.col("label") > 2, F.col("embedding")).alias("vector"),
    )
    tables.append_embeddings(made, path)
    stored = tables.read_embeddings(t.spark, path)
    return stored.select("email_id", F.size("vector").cast("bigint").alias("size"))


@check("""
    SELECT CAST(vec_id AS STRING) AS email_id, len(embedding) AS size FROM {embeddings}""")
def vectors_appended_once(t):
    """Every row is offered twice in a run, the run is tried twice, and a second run offers all again."""
    path, made = stage_path(t.spark, "vectors"), t.embeddings.select(F.col("vec_id").cast("string").alias("email_id"), F.col("embedding").alias("vector"))
    keys = {"email_id": KeySet(t.spark, stage_path(t.spark, "keys"), buckets=8, blocks=8)}
    for run, rows in (("one", made.filter("vec_id % 3 = 0")), ("one", made.filter("vec_id % 3 > 0")), ("two", made)):
        tables.append_embeddings(rows.unionByName(rows), path, run, keys)
    stored = tables.read_embeddings(t.spark, path)
    return stored.select("email_id", F.size("vector").cast("bigint").alias("size"))


@check("""
    SELECT currency, CAST(SUM(amount_cents) AS BIGINT) AS total FROM {tx_v}
    WHERE tx_date >= '1997-02-10' AND tx_date <= '1997-04-20' GROUP BY currency""")
def appended_tx(t):
    path = stage_path(t.spark, "tx")
    tables.append_tx(t.tx_v, path)
    return run_query(tables.read_tx(t.spark, path), None, "1997-02-10", "1997-04-20", "sum")


@check("""
    SELECT CAST(vec_id AS STRING) AS email_id,
      round(CAST(embedding[1] AS DOUBLE), 6) AS first_number, CAST(len(embedding) AS INT) AS size
    FROM {embeddings}""")
def vector_scan(t):
    rows = t.embeddings.select(
        F.col("vec_id").cast("string").alias("email_id"), F.col("embedding").alias("vector")
    )
    return rows.select(
        "email_id",
        F.round(F.col("vector")[0].cast("double"), 6).alias("first_number"),
        F.size("vector").alias("size"),
    )


@check("""
    SELECT id, sha256(CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END) AS text_hash
    FROM {doc_messages_v}""")
def raw_folder_scan(t):
    """One file per message is written, then scanned."""
    folder = stage_path(t.spark, "landing")
    raw = F.get_json_object("text", "$.raw")
    envelope = F.to_json(F.struct("id", raw.alias("raw"))).alias("text")
    landing.land_messages(t.doc_messages_v.select(F.col("id").alias("file"), envelope), folder)
    found = landing.scan_messages(t.spark, folder, nested=True)
    line = F.rtrim(found["text"], F.lit("\n"))
    return found.select(
        F.get_json_object("text", "$.id").alias("id"),
        F.sha2(F.when(line.contains('"raw"'), line).otherwise(""), 256).alias("text_hash"),
    )


# --- Decoding ------------------------------------------------------------------


@check("SELECT page_id, sha256(html) AS text_hash FROM {pages}")
def base64url_decode(t):
    coded = F.translate(F.base64(F.encode("html", "UTF-8")), "+/\r\n", "-_")
    bare = F.when(F.col("page_id") % 2 == 0, F.rtrim(coded, F.lit("="))).otherwise(coded)
    decoded = codec.decoded_body(bare)
    return t.pages.select("page_id", F.sha2(decoded, 256).alias("text_hash"))


@check("SELECT doc_id, sha256(text || '�' || text) AS text_hash FROM {documents}")
def utf8_repair(t):
    whole = F.encode("text", "UTF-8")
    broken = F.concat(whole, F.lit(bytes([0xFF])), whole)
    return t.documents.select("doc_id", F.sha2(codec.utf8_text(broken), 256).alias("text_hash"))


@check("SELECT page_id, {page_text} AS text FROM {pages}")
def html_text(t):
    return t.pages.select("page_id", html.html_text(F.col("html")).alias("text"))


@check("""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'x' || url ELSE url END AS subject,
      CAST(NULL AS STRING) AS cc FROM {pages}""")
def header_lookup(t):
    def one(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    url = F.col("url")
    first = F.when(F.col("page_id") % 3 == 0, F.array(one("SUBJECT", F.concat(F.lit("x"), url))))
    headers = F.concat(
        F.coalesce(first, F.array().cast("array<struct<name:string,value:string>>")),
        F.array(one("From", url), one("subject", url), one("Subject", F.lit("later"))),
    )
    return t.pages.select(
        "page_id",
        codec.header_value(headers, "Subject").alias("subject"),
        codec.header_value(headers, "Cc").alias("cc"),
    )


@check("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (4, 5) THEN NULL ELSE $order_iso END AS date
    FROM {orders}""")
def mail_dates(t):
    shown = t.sql("""
        SELECT o_orderkey, CASE o_orderkey % 6
          WHEN 0 THEN $order_day || ' 23:59:00 -0700' WHEN 1 THEN 'Tue, ' || $order_day || ' 0:00'
          WHEN 2 THEN $order_iso || 'T23:30:00Z'
          WHEN 3 THEN $order_day || ' 10:00:00 -0000 (PDT)'
          WHEN 4 THEN $order_day || ' 25:99:00' ELSE '' END AS shown FROM {orders}""")
    return shown.select("o_orderkey", dates.mail_day(F.col("shown"), TODAY).alias("date"))


@check("SELECT id, sha256(body_text) AS content_hash FROM {emails_v}")
def body_hashes(t):
    return t.emails_v.select("id", codec.content_hash(F.col("body_text")).alias("content_hash"))


# --- Messages --------------------------------------------------------------------

_DOC_MAILS = """SELECT 'm' || CAST(doc_id AS STRING) AS id,
    CASE WHEN doc_id % 9 = 0 THEN NULL
      ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS STRING) END AS date,
    source || '@example.com' AS from_addr,
    CASE WHEN doc_id % 4 = 0 THEN '(No Subject)' ELSE 'Receipt ' || CAST(doc_id AS STRING) END
      AS subject,
    text AS body_text, 'raw/' || lpad(CAST(doc_id AS STRING), 12, '0') || '.json' AS raw_path,
    sha256(text) AS content_hash FROM {documents} WHERE doc_id % 50 <> 7"""


@check(f"""
    {_DOC_MAILS.replace("AS content_hash FROM", "AS content_hash, FALSE AS is_error FROM")}
    UNION ALL
    SELECT 'm' || CAST(doc_id AS STRING), NULL, NULL, NULL, NULL, raw_path, NULL, TRUE
    FROM {{doc_messages_v}} WHERE doc_id % 50 = 7""")
def mime_messages(t):
    parsed = messages.parse_messages(t.doc_messages_v, TODAY)
    return parsed.withColumn("is_error", F.col("error").isNotNull()).drop("error")


@check("""
    SELECT 'p' || CAST(page_id AS STRING) AS id, '2024-09-03' AS date,
      'Page ' || CAST(page_id AS STRING) AS subject,
      CASE WHEN page_id % 2 = 0 THEN {page_text} ELSE url END AS body_text FROM {pages}""")
def mime_html_messages(t):
    parsed = messages.parse_messages(t.page_messages_v, TODAY)
    return parsed.select("id", "date", "subject", "body_text")


@check("""
    SELECT 't' || CAST(page_id AS STRING) AS id, 'Tree ' || CAST(page_id AS STRING) AS subject,
      '(Unknown)' AS from_addr,
      CASE page_id % 4 WHEN 1 THEN html WHEN 2 THEN 'plain' ELSE {page_text} END AS body_text
    FROM {pages}""")
def tree_messages(t):
    parsed = messages.parse_messages(t.trees_v, TODAY)
    return parsed.select("id", "subject", "from_addr", "body_text")


_NEW_MAILS = f"""SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY sha256(raw_path) || raw_path) AS rn
      FROM ({_DOC_MAILS}) AS d
      WHERE content_hash NOT IN (SELECT content_hash FROM {{stored_emails_v}})
        AND id NOT IN (SELECT id FROM {{stored_emails_v}})) AS e
    WHERE rn = 1"""


def _imported(t):
    """The documents are one file, so they are spread before they are parsed."""
    slots = t.spark.sparkContext.defaultParallelism
    return imports.import_messages(t.doc_messages_v, t.stored_emails_v, TODAY, slots)


@check(f"""
    SELECT id, date, from_addr, subject, body_text, raw_path, content_hash FROM ({_NEW_MAILS})""")
def import_messages(t):
    new, _ = _imported(t)
    return new


@check(f"""
    SELECT imported, n - errors - imported AS skipped, errors FROM
      (SELECT COUNT(*) AS imported FROM ({_NEW_MAILS})) AS a,
      (SELECT COUNT(*) AS n, COUNT(*) FILTER (doc_id % 50 = 7) AS errors
       FROM {{documents}}) AS b""")
def import_summary(t):
    _, summary = _imported(t)
    return summary


# --- Replies and the ledger --------------------------------------------------------


@check("""
    SELECT email_id, o_orderkey % 10 IN (0, 2, 4, 5, 8, 9) AS has_merchant,
      o_orderkey % 10 NOT IN (3) AS has_amount
    FROM {replies_v} WHERE o_orderkey % 10 NOT IN (6, 7)""")
def reply_objects(t):
    found = t.replies_v.select("email_id", replies.reply_object(F.col("reply")).alias("obj"))
    obj = F.col("obj")
    return found.filter(obj.isNotNull()).select(
        "email_id",
        replies.field(obj, "merchant").isNotNull().alias("has_merchant"),
        replies.field(obj, "amount").isNotNull().alias("has_amount"),
    )


@check("""
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      CAST(round_even(l_extendedprice / 8 * 100, 0) AS BIGINT) AS cents FROM {lineitem}""")
def amounts_to_cents(t):
    shown = F.to_json(F.struct((F.col("l_extendedprice") / 8).alias("amount")))
    value = replies.field(F.parse_json(shown), "amount")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        replies.to_cents(replies.number(value)).alias("cents"),
    )


_TX_OF_REPLIES = """SELECT 'tx_' || email_id AS id, email_id,
      CASE o_orderkey % 10 WHEN 0 THEN 'Uber' WHEN 1 THEN 'Unknown' WHEN 4 THEN 'Cafe'
        WHEN 8 THEN o_orderpriority WHEN 9 THEN 'Zero' END AS merchant,
      CASE o_orderkey % 10 WHEN 2 THEN 1234 WHEN 4 THEN 350 WHEN 8 THEN 100 WHEN 9 THEN 0
        ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) END AS amount_cents,
      CASE o_orderkey % 10 WHEN 0 THEN 'EUR' WHEN 2 THEN NULL ELSE 'USD' END AS currency,
      CASE o_orderkey % 10 WHEN 0 THEN '2024-03-01' WHEN 9 THEN '03/01/2024' END AS tx_date,
      CASE o_orderkey % 10 WHEN 0 THEN 'Transport' WHEN 2 THEN NULL ELSE 'Other' END AS category,
      CAST(1.0 AS DOUBLE) AS confidence
    FROM (SELECT *, 'm' || CAST(o_orderkey AS STRING) AS email_id FROM {orders}) AS o
    WHERE o_orderkey % 10 IN (0, 1, 2, 4, 8, 9)"""


@check(_TX_OF_REPLIES)
def reply_transactions(t):
    return ledger.reply_transactions(t.replies_v)


_CANDIDATE = f"regexp_matches(lower(CASE WHEN subject <> '' THEN subject ELSE body_text END), '{_WORDS}')"
_WAITING = f"""(SELECT * FROM {{emails_v}} WHERE {_CANDIDATE}
    AND id NOT IN (SELECT email_id FROM {{stored_v}} WHERE email_id IS NOT NULL))"""
_ADDED = f"""SELECT 'tx_' || e.id AS id, e.id AS email_id, source AS merchant,
      CAST(n_chars * 100 + 50 AS BIGINT) AS amount_cents, 'USD' AS currency,
      '2024-02-03' AS tx_date, 'Other' AS category, CAST(1.0 AS DOUBLE) AS confidence
    FROM {_WAITING} e JOIN {{documents}} d ON e.id = 'm' || CAST(d.doc_id AS STRING)
    WHERE length(e.body_text) >= 50 AND n_chars % 3 <> 0"""


def _stored_ledger(t):
    return t.stored_v.select("email_id", text.transaction_id(F.col("email_id")).alias("id"))


@check(f"SELECT id AS email_id, {_PROMPT} AS prompt FROM {_WAITING} WHERE length(body_text) >= 50")
def ledger_prompts(t):
    return ledger.prompts(t.emails_v, t.stored_v)


@check(_ADDED)
def build_ledger(t):
    new, _ = ledger.build_ledger(t.emails_v, _stored_ledger(t), t.mail_replies_v)
    return new


@check(f"""
    SELECT (SELECT COUNT(*) FROM {{emails_v}}) AS mails, COUNT(*) AS candidates,
      COUNT(*) FILTER (length(body_text) >= 50) AS processed,
      (SELECT COUNT(*) FROM ({_ADDED})) AS added FROM {_WAITING}""")
def ledger_summary(t):
    _, summary = ledger.build_ledger(t.emails_v, _stored_ledger(t), t.mail_replies_v)
    return summary


@check("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '{{}}'
      ELSE '{{"merchant":"Order ' || CAST(o_orderkey AS STRING) || '","amount":"'
        || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || '","currency":"EUR"'
        || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"date":"' || $order_iso || '"' END || '}}'
      END AS reply FROM {orders}""")
def rule_replies(t):
    prompts = t.sql("""
        SELECT o_orderkey, 'Date: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE $order_iso END
          || chr(10) || 'Subject: Order ' || CAST(o_orderkey AS STRING) || chr(10) || chr(10)
          || 'You paid ' || CASE WHEN o_orderkey % 4 = 0 THEN 'us' ELSE 'EUR '
          || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END || ' today' AS prompt
        FROM {orders}""")
    return hooks.rule_replies(prompts, "prompt", "reply").drop("prompt")


# --- Vectors -------------------------------------------------------------------------


def _query_vector(t) -> list[float]:
    return t.embeddings.filter("vec_id = 0").first()["embedding"]


_SIMILARITY = """coalesce(list_cosine_similarity(CAST(v.vector AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM {embeddings} WHERE vec_id = 0)), 0)"""
_VECTORS = """SELECT CAST(vec_id AS STRING) AS email_id, embedding AS vector FROM {embeddings}"""


@check(f"""
    SELECT email_id, round({_SIMILARITY}, 6) AS similarity FROM ({_VECTORS}) AS v
    UNION ALL SELECT 'zero' || CAST(vec_id AS STRING), CAST(0.0 AS DOUBLE) FROM {{embeddings}}""")
def cosine_scores(t):
    given = t.embeddings.select(F.col("vec_id").cast("string").alias("email_id"), F.col("embedding"))
    zero = F.transform("embedding", lambda _: F.lit(0.0).cast("float"))
    short = F.slice("embedding", 1, 3)
    holed = F.transform("embedding", lambda x: F.when(x > 0, x))
    every = (
        given.unionByName(given.select(F.concat(F.lit("zero"), "email_id").alias("email_id"), zero.alias("embedding")))
        .unionByName(given.select("email_id", short.alias("embedding")))
        .unionByName(given.select("email_id", holed.alias("embedding")))
        .unionByName(given.select("email_id", F.lit(None).cast("array<float>").alias("embedding")))
    )
    score = vectors.cosine_similarity(F.col("embedding"), _query_vector(t))
    scored = every.select("email_id", F.round(score, 6).alias("similarity"))
    return scored.filter(F.col("similarity").isNotNull())


@check(f"""
    SELECT email_id, round(similarity, 6) AS similarity FROM (
      SELECT email_id, {_SIMILARITY} AS similarity FROM ({_VECTORS}) AS v
      ORDER BY similarity DESC, email_id LIMIT 10) AS top""")
def similar_mails(t):
    stored = t.embeddings.select(
        F.col("vec_id").cast("string").alias("email_id"), F.col("embedding").alias("vector")
    )
    top = topk.find_similar(stored, _query_vector(t))
    return top.select("email_id", F.round("similarity", 6).alias("similarity"))


_BEST = """SELECT query_id, CAST(rank AS INT) AS rank, email_id, round(similarity, 6) AS similarity FROM (
      SELECT query_id, email_id, similarity,
        row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, email_id) AS rank FROM (
        SELECT q.query_id, v.email_id, coalesce(list_cosine_similarity(q.vector, v.vector), 0) AS similarity
        FROM {queries} AS q, {stored} AS v) AS pairs) AS ranked
    WHERE rank <= 10"""
_AS_DOUBLES = "SELECT {id}, CAST(embedding AS DOUBLE[]) AS vector FROM {{embeddings}}"
_STORED_VECTORS = _AS_DOUBLES.format(id="CAST(vec_id AS STRING) AS email_id")
_ASKED_VECTORS = _AS_DOUBLES.format(id="vec_id AS query_id") + " WHERE vec_id % 50 = 0"


@check(_BEST.format(queries=f"({_ASKED_VECTORS})", stored=f"({_STORED_VECTORS})"))
def similar_many(t):
    """Every fiftieth vector against all vectors."""
    stored = t.embeddings.select(F.col("vec_id").cast("string").alias("email_id"), F.col("embedding").alias("vector"))
    asked = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = similar.similar_many(stored, asked)
    return found.withColumn("similarity", F.round("similarity", 6))


_LETTERS = "etaoinshr dlu"


def _letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(text.count(letter)) for letter in _LETTERS] for text in texts]


_LETTER_COUNTS = f"""list_transform(string_split('{",".join(_LETTERS)}', ','),
    lambda x: CAST(length(text) - length(replace(text, x, '')) AS DOUBLE)) AS vector"""


@check(_BEST.format(
    queries=f"(SELECT doc_id AS query_id, {_LETTER_COUNTS} FROM {{documents}} WHERE doc_id % 50 = 0)",
    stored=f"(SELECT 'm' || CAST(doc_id AS STRING) AS email_id, {_LETTER_COUNTS} FROM {{documents}})",
))
def similar_to_text(t):
    """The text of every fiftieth document against all; the model counts letters."""
    texts = t.documents.select(F.concat(F.lit("m"), F.col("doc_id")).alias("email_id"), "text", F.col("doc_id").alias("query_id"))
    stored = hooks.ask_hook(texts, "text", "vector", "array<float>", _letter_counts)
    found = similar.similar_to_text(stored, texts.filter("query_id % 50 = 0"), _letter_counts)
    return found.withColumn("similarity", F.round("similarity", 6))


@check("""
    SELECT vec_id, CAST(len(embedding) AS INT) AS size,
      round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM {embeddings}""")
def vector_json(t):
    numbers = vectors.vector_from_json(vectors.vector_json(F.col("embedding")))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.size(numbers).alias("size"), F.round(total, 4).alias("total"))


@check("""
    SELECT id AS email_id, 256 AS size, CAST(1.0 AS DOUBLE) AS length FROM {emails_v}
    WHERE id NOT IN (SELECT email_id FROM {stored_v} WHERE email_id IS NOT NULL)""")
def embed_pending(t):
    made = embed.embed_pending(t.emails_v, t.stored_v)
    squares = F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    return made.select(
        "email_id", F.size("vector").alias("size"), F.round(F.sqrt(squares), 4).alias("length")
    )


@check("""
    SELECT id AS email_id, CAST(length(text) AS INT) AS chars FROM (
      SELECT id, 'Subject: ' || coalesce(subject, '') || chr(10) || 'Body: '
        || coalesce(body_text, '') AS text FROM {emails_v}
      WHERE id NOT IN (SELECT email_id FROM {stored_v} WHERE email_id IS NOT NULL)) AS e
    WHERE length(text) > 100""")
def embed_pending_hook(t):
    """A hook that refuses short texts, and so whole batches."""

    def lengths(texts):
        if min(map(len, texts)) <= 100:
            raise ValueError("too short")
        return [[float(len(x))] for x in texts]

    made = embed.embed_pending(t.emails_v, t.stored_v, lengths)
    return made.select("email_id", F.col("vector")[0].cast("int").alias("chars"))


# --- Full text ------------------------------------------------------------------------

_TOKENS = r"""(SELECT id, field, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'))
    AS term FROM (SELECT id, 'subject' AS field, subject AS text FROM {emails_v}
      UNION ALL SELECT id, 'body_text', body_text FROM {emails_v}) AS f)"""


@check(f"""
    SELECT term, id, field, COUNT(*) AS tf FROM {_TOKENS} AS w WHERE term <> ''
    GROUP BY term, id, field""")
def postings(t):
    return search.postings(t.emails_v)


_HITS = f"""
    SELECT id, COUNT(*) AS score FROM {_TOKENS} AS w WHERE term IN ('of', 'the', 'invoice')
    GROUP BY id HAVING COUNT(DISTINCT term) = 3"""


@check(_HITS)
def keyword_search(t):
    return search.search(t.emails_v, "Invoice of THE the")


@check(_HITS)
def indexed_search(t):
    """From a stored index of two runs, one of them tried twice."""
    path, odd = stage_path(t.spark, "index"), F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    for run, part in (("one", t.emails_v), ("one", t.emails_v.filter(odd)), ("two", t.emails_v.filter(~odd))):
        search.append_index(part, path, run)
    return search.search_index(t.spark, path, "Invoice of THE the")
