"""Sources.  Hidden files are skipped, folders are read recursively, gzip and bzip2 by extension."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.basic import broadcast_if_small

Paths = str | Sequence[str]


def _list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def json_documents(spark: SparkSession, paths: Paths, schema: T.StructType, on_error: str = "fail", add_id: str | None = None) -> DataFrame:
    """[S1 S2 S4-S6] JSON lines with a given schema.

    on_error: "fail" ends the job at a malformed line, "drop" leaves the line out, "null" keeps it with null fields.
    add_id adds "<file name>-<line number from 0>", right for compressed files and for plain ones read in parts.
    """
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "null": "PERMISSIVE"}[on_error]
    if add_id is None:
        return spark.read.schema(schema).option("recursiveFileLookup", True).json(_list(paths), mode=mode)
    lines = with_line_ids(spark, paths, add_id)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST" if on_error == "fail" else "PERMISSIVE"})
    made = lines.withColumn("_doc", parsed)
    if on_error == "drop":
        made = made.where(F.get_json_object("value", "$").isNotNull())
    return made.select("_doc.*", add_id)


def with_line_ids(spark: SparkSession, paths: Paths, name: str = "record_id") -> DataFrame:
    """[S2 P6 W3] value and the line's id; numbers are counted by file, in the order of the file's blocks."""
    rows = spark.read.option("recursiveFileLookup", True).text(_list(paths)).select("value", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    rows = rows.withColumn("_m", F.monotonically_increasing_id())
    # line numbers within a block come from the ids of its rows; only one row a block is needed to place the block
    part = rows.groupBy("_p", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_p").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = part.withColumn("_before", before).select("_p", "_b", "_first", "_before")
    made = rows.join(broadcast_if_small(place), ["_p", "_b"])
    return made.select("value", F.concat(F.col("_f"), F.lit("-"), (F.col("_before") + F.col("_m") - F.col("_first")).cast("string")).alias(name))


def text_documents(spark: SparkSession, paths: Paths) -> DataFrame:
    """[S3] id (file name) and content of whole files."""
    return spark.read.option("recursiveFileLookup", True).text(_list(paths), wholetext=True).select(F.col("_metadata.file_name").alias("id"), F.col("value").alias("content"))


def union_documents(parts: Sequence[DataFrame]) -> DataFrame:
    """[S6 U1] all rows of several tables; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def conll_sentences(text: Column) -> Column:
    """[S7] sentences of token columns: blank lines end sentences, further ones give empty sentences, a last one is kept."""
    trimmed = F.regexp_replace(text, r"\n$", "")
    return F.transform(F.split(F.regexp_replace(trimmed, r"\n$", ""), "\n\n"), lambda s: F.transform(F.filter(F.split(s, "\n"), lambda line: line != ""), lambda line: F.split(line, "\t")))


def conll_sentences_of(spark: SparkSession, paths: Paths) -> DataFrame:
    """[S7] id (file name) and sentence of the sentences with tokens in CoNLL files of any size: a sentence a row, files read in parts."""
    rows = spark.read.option("recursiveFileLookup", True).text(_list(paths), lineSep="\n\n").select(F.col("_metadata.file_name").alias("id"), "value")
    lines = F.filter(F.split("value", "\n"), lambda line: line != "")
    return rows.select("id", F.transform(lines, lambda line: F.split(line, "\t")).alias("sentence")).where(F.size("sentence") > 0)


def conll_documents(spark: SparkSession, paths: Paths) -> DataFrame:
    """[S7] id and content (array of sentences of tokens of columns) of CoNLL files, each a row; see conll_sentences_of for large ones."""
    return text_documents(spark, paths).withColumn("content", conll_sentences(F.col("content")))


def text_vectors(spark: SparkSession, paths: Paths, dimension: int = 0, keep_words: DataFrame | None = None) -> DataFrame:
    """[S8] idx, word, vec of lines "word x1 x2 ..."; lines that don't parse, or of another dimension, are skipped."""
    rows = spark.read.option("recursiveFileLookup", True).text(_list(paths)).withColumn("idx", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", r"\s+$", ""), " ")
    vec = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: x.try_cast("double"))
    made = rows.select("idx", F.get(parts, F.lit(0)).alias("word"), vec.alias("vec")).where((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull()))
    made = made.where(F.size("vec") == dimension) if dimension else made
    if keep_words is not None:
        made = made.join(broadcast_if_small(keep_words.select(F.col(keep_words.columns[0]).alias("word")).distinct()), "word", "left_semi")
    return made.select("idx", "word", "vec")


def npz_vectors(spark: SparkSession, paths: Paths) -> DataFrame:
    """[S9] idx (by file in order of paths, then row), word, vec of .npz files with words and dense vectors, or the parts of a CSR matrix (data, indices, indptr, shape)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, number in zip(batch["content"], batch["file"], strict=True):
                file = np.load(io.BytesIO(content), allow_pickle=False)
                words = [str(w) for w in file["words"]]
                if "vectors" in file:
                    rows = [r.astype(float).tolist() for r in file["vectors"]]
                else:
                    width, rows = int(file["shape"][1]), []
                    for a, b in zip(file["indptr"][:-1], file["indptr"][1:], strict=True):
                        row = np.zeros(width)
                        row[file["indices"][a:b]] = file["data"][a:b]
                        rows.append(row.tolist())
                for at in range(0, len(words), 1000):
                    yield pd.DataFrame({"idx": (number << 32) + np.arange(at, min(at + 1000, len(words))), "word": words[at : at + 1000], "vec": rows[at : at + 1000]})

    files = spark.read.format("binaryFile").load(_list(paths))
    order = files.select("path").distinct().withColumn("file", (F.row_number().over(W.orderBy("path")) - 1).cast("long"))  # a row a file
    return files.join(F.broadcast(order), "path").select("content", "file").mapInPandas(run, schemas.DENSE_VECTORS)


def word_set(spark: SparkSession, paths: Paths) -> DataFrame:
    """[S10 Q23] item: distinct non-empty lines."""
    return spark.read.text(_list(paths)).where("value <> ''").select(F.col("value").alias("item")).distinct()


def query_file(spark: SparkSession, path: Paths) -> DataFrame:
    """[S11] term, weight of a TSV; a missing weight is 1, of repeated words the last line's counts."""
    parts = F.split("value", "\t")
    rows = spark.read.text(_list(path)).where("value <> ''").select(F.get(parts, F.lit(0)).alias("term"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("weight"), F.monotonically_increasing_id().alias("_n"))
    return rows.groupBy("term").agg(F.max_by("weight", "_n").alias("weight"))


def query_list(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """[S11] term, weight 1 of a list of words."""
    return spark.createDataFrame([(w, 1.0) for w in dict.fromkeys(words)], schemas.TERM_WEIGHTS)


def frequencies(spark: SparkSession, path: Paths) -> DataFrame:
    """[S12] word, freq of a TSV with the frequency first."""
    return spark.read.csv(_list(path), sep="\t", schema="freq bigint, word string", quote="")


def dictionary(spark: SparkSession, path: Paths, header: bool = False) -> DataFrame:
    """[S13 S14] headword, definition of a TSV, by position or by the header's names; a missing definition is ''."""
    rows = spark.read.csv(_list(path), sep="\t", header=header, quote="")
    named = rows.select("headword", "definition") if header else rows.select(F.col(rows.columns[0]).alias("headword"), F.col(rows.columns[1]).alias("definition"))
    return named.fillna("", ["definition"])


def term_stats_json(spark: SparkSession, paths: Paths) -> DataFrame:
    """[S15 Q9 Q10] field, term, tf, df of nested JSON: {field: {TF, DF}}, or {TF, DF} under the field "all", also in a list."""
    # an object a row, where each begins a line: those after the first lack the brace that ended the row before
    rows = spark.read.text(_list(paths), lineSep="\n{").select(F.regexp_replace("value", r"^\s*\[|\]\s*$", "").alias("value")).where(F.rlike("value", F.lit(r"\S")))
    rows = rows.select(F.when(F.rlike("value", F.lit(r"^\s*\{")), F.col("value")).otherwise(F.concat(F.lit("{"), F.col("value"))).alias("value"))
    flat = F.when(F.get_json_object("value", "$.TF").isNotNull(), F.concat(F.lit('{"all":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    fields = rows.select(F.explode(F.from_json(flat, schemas.STATS_JSON)).alias("field", "s"))
    dfs = F.coalesce("s.DF", F.create_map().cast("map<string,bigint>"))
    both = F.map_zip_with(F.transform_values("s.TF", lambda k, v: F.struct(v.alias("tf"))), dfs, lambda k, t, n: F.struct(t.alias("t"), n.alias("n")))
    terms = fields.select("field", F.explode(both).alias("term", "b")).where("b.t is not null")
    return terms.select("field", "term", F.col("b.t.tf").alias("tf"), F.coalesce("b.n", F.lit(0)).alias("df"))


def gold_list(spark: SparkSession, path: Paths, vectors: DataFrame | None = None) -> DataFrame:
    """[S16 J15] word, value of a TSV, of words that have a vector."""
    rows = spark.read.csv(_list(path), sep="\t", schema="word string, value int", quote="")
    return rows if vectors is None else rows.join(vectors.select("word").distinct(), "word", "left_semi")
