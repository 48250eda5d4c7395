"""The queries opN_<name> and pipeline, each over its whole tables, and their SQL where SQL can express them.

Every module here is optional for the others: one query never needs another's module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def labelled_domains(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The labelled table of domains: the language of the documents that `labels` covers."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.select("doc_id", docs["lang"].alias("domain")).join(known, "doc_id", "left_semi")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_rates

    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, labelled_domains(spark, sf_dir, docs), temper=0.7)


def op2_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_topk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op4_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition

    return repetition(table(spark, sf_dir, "documents"), max_covered=0.4, max_longest=50).drop("longest_repeat", "n_repeats")


def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path(), window=4096)


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=80)


QUERIES = (op1_soft_mixing, op2_trie_token_counts, op3_topk_tiles, op4_suffix_repetition, op5_license_sentences, op6_warc_transactions, op7_pii_crf, op8_line_crf_quality, op9_bm25_packing, op10_parity_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


SQL: dict[str, str] = {}

SQL["op3_topk_tiles"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL["op4_suffix_repetition"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, k, i, hash(ws[i:i + k - 1]) AS h FROM w, (VALUES (3), (5), (51)) v(k), unnest(range(1, len(ws) - k + 2)) u(i)),
r AS (SELECT doc_id, k, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k, h) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) FILTER (k = 3 AND j < 3) AS n_repeat_words, count(DISTINCT i + j) FILTER (k = 5) AS n_covered, max(k) AS most
  FROM r, range(0, 5) x(j) GROUP BY doc_id),
l AS (SELECT doc_id, t AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS t FROM w) WHERE regexp_matches(t, '[^\x20\x09-\x0D]') GROUP BY ALL),
d AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM l GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(most, 0) AS most
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_covered <= 0.4 * n_words AND most < 51 AS kept, n_covered FROM b
"""

SQL["op6_warc_transactions"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, b::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN b >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND page_id <> f THEN f END AS refers_to
FROM f
"""

SQL["op10_parity_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
