"""Registered queries of the operators, over whole driver tables, with their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import ann, lexical, lines, minhash, mixing, packing, pii, quality, repair, shards, spans, suffix, urls
from spendlake.llm.common import read
from spendlake.staging import stage_path

ORACLES: dict[str, str] = {
    "op11_document_fptree": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), asked AS (
            SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
            ) GROUP BY ALL
        ), held AS (
            SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
        ), lengths AS (
            SELECT doc_id, count(*) AS n FROM words GROUP BY ALL
        ), totals AS (
            SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths
        ), factors AS (
            SELECT doc_id, 25 + (75 * n * all_docs) // all_terms AS m FROM lengths, totals
        ), weighted AS (
            SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals
        ), scores AS (
            SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM asked JOIN weighted USING (term) JOIN held USING (term) JOIN factors USING (doc_id) GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "op12_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(own) AS line, unnest(range(len(own))) AS pos, len(own) AS n
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, count(common.key) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id""",
}


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without repeated runs of sentences."""
    left = spans.without_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    kept = F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    return left.select("doc_id", "n_sentences", "n_removed", "spans", kept)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.judged(docs, model).select("doc_id", "result.*")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without the strings of smaller documents."""
    return suffix.without_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every token sequence of the documents lies in the shards."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return shards.materialise(docs, public_tokenizers.path("word_bpe_49k.json"), stage_path(spark, "shards"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judge(read(spark, sf_dir, "pages", "page_id", "url"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_document_fptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest scores of every item."""
    return lexical.search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without the lines that ten documents share."""
    left = lines.without_common_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cheapest edits that give it a lawful structure."""
    rows = repair.damaged(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return repair.repair(rows)


QUERIES = {f.__name__: f for f in (
        op1_suffix_dedup,
        op2_adaptive_scan,
        op3_packing,
        op4_sentence_spans,
        op5_quality_rules,
        op6_minhash,
        op7_training_order,
        op8_mixing,
        op9_url_templates,
        op10_pii,
        op11_document_fptree,
        op12_line_dedup,
        op13_conversation_repair,
    )}
