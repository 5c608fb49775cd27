"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, ngram_join, packing, pii, quality_classifier, quality_rules, token_counts, topk, warc
from .common import Scratch, table

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs), out_col="kept_text")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return cut.select("doc_id", lines.alias("n_lines"), "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica has the first byte of a page's block flipped wherever the record's hash begins with 00."""
    pages = table(spark, sf_dir, "pages")
    good = warc.warc_records(pages)
    files = warc.file_count(pages.select(F.col("page_id").alias("key")))
    hit = F.sha2(warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html")), 256).startswith("00") & (F.length("html") > 0)
    hurt = warc.warc_records(pages.withColumn("html", F.when(hit, F.concat(F.lit("~"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))))
    with Scratch(spark) as tables:
        a, b = (tables.written(warc.merkle_leaves(x, files), "warc-leaves") for x in (good, hurt))
        return warc.audit(a, b).select(F.col("key").alias("page_id"), "length", "record_hash", "intact")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, pii.session_key(spark), count_col="n_replaced")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [name for name, _, _ in quality_rules.plan_rules(docs)]
    measured = quality_rules.measures(docs).withColumn("base_failed", quality_rules.base_failed())
    order = [x for x in order if x not in ("few_words", "repeats")]  # those two are the base
    known = {k: F.col(k) for k in quality_rules.BASE_MEASURES}
    more = quality_rules.cascade(quality_rules.DEFAULT_RULES, order, F.col("text"), F.col("_words"), known)
    kept = F.when(F.col("base_failed"), False).otherwise(more.isNull())
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRIM = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

_SQL_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, string_split(t, chr(10)) AS parts FROM d),
l AS (SELECT rid, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_TRIM}), '{_UPPER}', '{_LOWER}') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, h.keeper IS NOT NULL AND k.doc_id IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

_SQL_RECORD = """
'WARC/1.0' || chr(13)||chr(10) || 'WARC-Type: resource' || chr(13)||chr(10) || 'WARC-Record-ID: <urn:uuid:'
|| substr(u,1,8)||'-'||substr(u,9,4)||'-'||substr(u,13,4)||'-'||substr(u,17,4)||'-'||substr(u,21,12) || '>' || chr(13)||chr(10)
|| 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13)||chr(10) || 'WARC-Target-URI: ' || url || chr(13)||chr(10)
|| 'Content-Type: text/html' || chr(13)||chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13)||chr(10)||chr(13)||chr(10)
|| html || chr(13)||chr(10)||chr(13)||chr(10)
"""

_SQL_WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
  sha256(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS u FROM pages),
r AS (SELECT page_id, html, {_SQL_RECORD} AS rec FROM p)
SELECT page_id, strlen(rec)::BIGINT AS length, sha256(rec) AS record_hash, NOT (sha256(rec) LIKE '00%' AND html <> '') AS intact FROM r
"""

_SQL_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

_SQL_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS win FROM w),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM f) GROUP BY rid),
m AS (SELECT w.rid, w.doc_id, w.t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, len(string_split(t, chr(10))) AS n_lines,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}\x{25cf}\x{25aa}]'))) AS bullets, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t]*$'))) AS broken,
  len(list_filter(ws, lambda x: regexp_matches(x, '[^\x21-\x40\x5B-\x60\x7B-\x7E]'))) AS letters, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c ON w.rid = c.rid),
x AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > 2 * n_words
    OR 10 * caps > 4 * word_chars OR 10 * n_dup_lines > 6 * n_lines
    OR 10 * bullets > 9 * n_lines OR 10 * broken > 3 * n_lines OR 10 * letters < 6 * n_words) AS kept
FROM x
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_ngram_join": op7_ngram_join,
    "op8_pii": op8_pii,
    "op9_topk": op9_topk,
    "op10_quality_rules": op10_quality_rules,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op4_line_dedup": _SQL_LINES, "op6_warc_fixity": _SQL_WARC, "op9_topk": _SQL_TOPK, "op10_quality_rules": _SQL_RULES}
