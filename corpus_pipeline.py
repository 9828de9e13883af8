"""Corpus pipeline: documents through toxicity, line dedup, near-duplicate join, decontamination and tokenization.

Each stage takes the documents its predecessor kept; all but the last return documents' columns, further ones included.

Decisions are by row, or by id and text where rows with both equal count as one document.  Null, empty and blank texts are
clean in every stage and stay, as far as they do not repeat an id's row; a null id is an id like any other, last in order.
Texts of any length count whole.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from corpusloom.llm.common import crc_fold, pick, prepare, table_dir, written
from corpusloom.llm.queries import _tokenizer_file

#: Stage 1 trains a model, stage 4 aligns: SQL can't express them, so there is none for run()'s rows.
ORACLE_SQL: str | None = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.5 or more; the model learns from the stage's own documents (fold 0 held out).

    Rows are judged one by one, from their texts alone, so equal texts share their fate; without a confirmed toxic document
    to learn from all stay.  A column named toxicity stays as it is.
    """
    prepare(spark)
    model = toxicity.train(docs, spark.read.parquet(table_dir(sf_dir, "labels")), crc_fold(F.col("doc_id"), 5) != 0)
    name = pick(docs, "toxicity")
    return toxicity.score(docs, model).where(F.col(name) < 0.5).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeated runs of 50 words or more; a document of which nothing is left goes, n_chars follows the text.

    Of occurrences the one with the smallest (doc_id, text hash, line) stays, null ids before all; rows with equal id and text
    are cut alike.  Texts without a repeated run stay as they are, null and blank ones too.
    """
    kept, removed = pick(docs, "kept_text"), pick(docs, "removed_lines")
    made = line_dedup.drop_repeated_lines(docs, tails=True)
    made = made.where((F.col(removed) == 0) | (F.trim(F.regexp_replace(kept, r"\s+", " ")) != ""))
    changed = F.col(removed) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return made.withColumns(new).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (5-word shingles, Jaccard 0.8): the smallest doc_id, then text hash; null ids last.

    Rows without a word form no group; of theirs, those that repeat an id and text count once, but for null ids.  Of rows with
    equal id and text that of the smallest further columns stays, as their JSON sorts.
    """
    prepare(spark)
    gone = jaccard.jaccard_classes(docs, n=5, percent=80, firsts=True).where("not is_first").select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct()
    digest = F.xxhash64(F.col("text"))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs["text"]) == F.col("_gone_digest")), "left_anti").select(*docs.columns)
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_none")))
    repeated = left.where(F.col("doc_id").isNotNull() | F.col("text").rlike(r"\S")).groupBy(F.col("doc_id").alias("_twice_id"), digest.alias("_twice_digest")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = written(repeated, "repeated_rows")
    if repeated.isEmpty():
        return left
    twice = left["doc_id"].eqNullSafe(F.col("_twice_id")) & (F.xxhash64(left["text"]) == F.col("_twice_digest"))
    again = left.join(repeated, twice, "left_semi").select(*docs.columns).groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), others).alias("row")).select("row.*")
    return left.join(repeated, twice, "left_anti").select(*docs.columns).union(again)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exact or edited.

    Rows with equal id and text go together; null and blank texts hold nothing and stay; without items all stay.
    """
    prepare(spark)
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(table_dir(sf_dir, "benchmark"))).select("doc_id", "digest").distinct()
    hit = (F.col("leaks.doc_id").eqNullSafe(F.col("docs.doc_id"))) & (F.col("leaks.digest") == F.xxhash64(F.col("docs.text")))
    return docs.alias("docs").join(leaks.alias("leaks"), hit, "left_anti").select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, packed ids and the digest of the decoded text of each remaining document.

    A null text counts as empty: no tokens.  Rows stay one for one.
    """
    prepare(spark)
    made = bpe.encode_decode(docs, _tokenizer_file(), keep=["doc_id"])
    return made.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(table_dir(sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage_{name}")
    return docs
