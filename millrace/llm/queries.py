"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.decontaminate import find_leaks
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.html_extract import extract_text
from millrace.llm.language_id import identify_languages
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.minhash import near_duplicates
from millrace.llm.sentencepiece_codec import encode_documents
from millrace.llm.token_count import count_tokens
from millrace.llm.toxicity import score_toxicity, train_toxicity
from millrace.llm.url_filter import filter_urls

#: The rules of the URL query: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = encode_documents(table(spark, sf_dir, "documents"), model, round_trip=True)
    return coded.select("doc_id", "n_chunks", F.size("ids").alias("n_tokens"), "ids", "round_trip")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(listed))
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, similarity=0.8)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_url_filter": op5_url_filter,
    "op6_minhash": op6_minhash,
    "op7_token_count": op7_token_count,
    "op8_html_extract": op8_html_extract,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op5_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
            FROM pages),
        rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fits AS (
            SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
            FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id, host, path)
        SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict
        FROM u LEFT JOIN fits f ON u.page_id = f.page_id AND u.host = f.host AND u.path = f.path
    """,
    "op6_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
            FROM w),
        u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, len(sh) AS n_shingles, min(y) AS component_id, s.doc_id = min(y) AS kept
        FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, sh
    """,
}
