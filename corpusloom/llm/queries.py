"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, jaccard, kneser_ney, langid, line_dedup, pitman_yor, toxicity, warc
from .common import crc_fold, prepare, table_dir


def _tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(table_dir(sf_dir, name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    made = bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer_file(), keep=["doc_id"])
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 of the ids is held out of training."""
    documents, fold = _table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 4)
    model = langid.train(documents, fold != 2)
    made = langid.predict(documents.select("doc_id", "text"), model)
    return made.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and whether its language's threshold keeps it."""
    made = kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return made.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard 0.85 or more."""
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 0 of 5 of the ids is held out of training."""
    documents, fold = _table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5)
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive addressed by content and read back."""
    path = warc.new_archive(spark)
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.verified(warc.read_index(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; fold 1 of 5 of the ids is held out of training."""
    documents, fold = _table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5)
    made = pitman_yor.score(documents, pitman_yor.train(documents, fold != 1), fold == 1)
    return made.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the later of its repeated runs of 50 words or more cut out."""
    made = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), tails=True)
    return made.select("doc_id", "removed_lines", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"), F.length("kept_text").alias("kept_chars"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each whose id is divisible by 50."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited."""
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "first_word", "last_word", "n_seeds")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_jaccard": op4_jaccard,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_line_dedup": op8_line_dedup,
    "op9_nearest": op9_nearest,
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(encode(html), encode('')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS strong, upper(sha1(body)) AS hex FROM p),
f AS (SELECT *, first_value(page_id) OVER (PARTITION BY strong ORDER BY page_id) AS first_id,
             row_number() OVER (PARTITION BY strong ORDER BY page_id) AS nth FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, (1 + 10 * (k // 8))::INTEGER, 10))::BIGINT >> (35 - 5 * (k % 8))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to
FROM f
""",
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line FROM d),
t AS (SELECT doc_id, line, regexp_replace(raw, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS content FROM l),
w AS (SELECT doc_id, line, content, len(regexp_extract_all(content, '[^\t-\r ]+')) AS words FROM t WHERE content <> ''),
s AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM w),
g AS (SELECT doc_id, line, sum(words) OVER f AS total, max(line) OVER f AS last_line, list(content) OVER f AS run
      FROM s WINDOW f AS (PARTITION BY doc_id ORDER BY begins RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
r AS (SELECT doc_id, line, last_line, row_number() OVER (PARTITION BY run ORDER BY doc_id, line) AS seen FROM g WHERE total >= 50),
x AS (SELECT DISTINCT doc_id, unnest(range(line, last_line + 1)) AS line FROM r WHERE seen > 1),
k AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.line) AS kept FROM l ANTI JOIN x ON l.doc_id = x.doc_id AND l.line = x.line GROUP BY l.doc_id),
n AS (SELECT x.doc_id, count(*) AS removed FROM x JOIN w ON x.doc_id = w.doc_id AND x.line = w.line GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n.removed, 0)::BIGINT AS removed_lines,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.kept, '')) END AS kept_md5,
       CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.kept, ''))::INTEGER END AS kept_chars
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
}
