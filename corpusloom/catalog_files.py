"""Registered queries of sources and sinks: each writes a table to the shared folder in one form and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import ASK, BI, POST, STAT2, asked, both_stats, docs, embedded, query, sentences, table, weighted
from .operators import stats
from .session import saved, shared_folder
from .sources import readers, webarchive, writers


def fresh(s: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses; it goes with the folder."""
    return f"{shared_folder(s)}/files-{name}-{uuid.uuid4().hex[:8]}"


def renamed(s: SparkSession, path: str, ending: str) -> None:
    """Gives the part files of a folder another ending, which Spark's writers don't let one choose."""
    jvm, conf = s.sparkContext._jvm, s.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(conf)
    for k, status in enumerate(system.listStatus(folder)):
        if status.getPath().getName().startswith("part-"):
            system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/part{k}{ending}"))


@query("json_lines_files", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def json_lines_files(s: SparkSession, d: str) -> DataFrame:
    """Gzip JSON lines."""
    path = fresh(s, "json")
    writers.json_lines(docs(s, d).select("doc_id", "text", "lang"), path)
    made = readers.json_documents(s, path, T.StructType.fromDDL("doc_id bigint, text string, lang string"))
    return made.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


@query("json_record_ids", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS line FROM nation")
def json_record_ids(s: SparkSession, d: str) -> DataFrame:
    """Line numbers within the file."""
    path = fresh(s, "ids")
    writers.reduced_json(table(s, d, "nation").select("n_nationkey").orderBy("n_nationkey"), path)
    made = readers.json_documents(s, path, T.StructType.fromDDL("n_nationkey bigint"), add_id="record_id")
    return made.select("n_nationkey", F.regexp_extract("record_id", r"-(\d+)$", 1).cast("long").alias("line"))


@query("json_by_source_files", "SELECT n_regionkey::BIGINT AS region, n_name FROM nation")
def json_by_source_files(s: SparkSession, d: str) -> DataFrame:
    """A folder a source."""
    path = fresh(s, "sources")
    writers.json_by_source(table(s, d, "nation").select("n_regionkey", "n_name"), "n_regionkey", path)
    made = s.read.schema("n_name string").option("recursiveFileLookup", True).json(path)
    return made.select(F.regexp_extract(F.col("_metadata.file_path"), r"n_regionkey=(\d+)", 1).cast("long").alias("region"), "n_name")


@query("whole_text_files", "SELECT r_name || chr(10) AS content FROM region")
def whole_text_files(s: SparkSession, d: str) -> DataFrame:
    """S3: a document a file."""
    path = fresh(s, "texts")
    table(s, d, "region").select("r_regionkey", F.col("r_name").alias("value")).write.partitionBy("r_regionkey").text(path)
    return readers.text_documents(s, path).select("content")


@query("reduced_tsv_query", r"SELECT term, count(*)::DOUBLE AS weight FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark) GROUP BY term")
def reduced_tsv_query(s: SparkSession, d: str) -> DataFrame:
    """A weighted query as TSV."""
    path = fresh(s, "query")
    writers.reduced_tsv(weighted(s, d), path)
    return readers.query_file(s, path)


@query("word_set_files", f"WITH {ASK} SELECT term AS item FROM ask")
def word_set_files(s: SparkSession, d: str) -> DataFrame:
    """S10."""
    path = fresh(s, "words")
    asked(s, d).select(F.col("term").alias("value")).union(asked(s, d)).write.text(path)
    return readers.word_set(s, path)


@query("frequency_files", f"WITH {POST} SELECT sum(tf)::BIGINT AS freq, term AS word FROM post GROUP BY term")
def frequency_files(s: SparkSession, d: str) -> DataFrame:
    """S12."""
    path = fresh(s, "freqs")
    own = stats.tf_df_of_tokens(docs(s, d), F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "lemmas")
    writers.tsv_line(own.select(F.col("tf").cast("long"), "term")).write.text(path)
    return readers.frequencies(s, path)


@query("dictionary_files", "SELECT p_name AS headword, p_type AS definition FROM part")
def dictionary_files(s: SparkSession, d: str) -> DataFrame:
    """By position."""
    path = fresh(s, "dictionary")
    writers.tsv_line(table(s, d, "part").select("p_name", "p_type")).write.text(path)
    return readers.dictionary(s, path)


@query("dictionary_header_files", "SELECT p_name AS headword, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS definition FROM part")
def dictionary_header_files(s: SparkSession, d: str) -> DataFrame:
    """By the header's names; missing definitions are empty."""
    path = fresh(s, "headed")
    own = table(s, d, "part").select(F.when(F.col("p_size") > 25, F.col("p_type")).alias("definition"), F.col("p_name").alias("headword"))
    own.write.csv(path, sep="\t", header=True, quote="", nullValue="", emptyValue="")
    return readers.dictionary(s, path, header=True)


@query("gold_list_files", "SELECT 'w' || vec_id AS word, label AS value FROM embeddings WHERE vec_id % 2 = 0")
def gold_list_files(s: SparkSession, d: str) -> DataFrame:
    """Of words that have a vector."""
    path = fresh(s, "gold")
    e = table(s, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("label").cast("int").alias("value"), "vec_id")
    writers.tsv_line(e.select("word", "value").union(e.select(F.concat("word", F.lit("x")), "value"))).write.text(path)
    return readers.gold_list(s, path, e.where("vec_id % 2 = 0"))


@query("text_vector_files", "SELECT 'w' || vec_id AS word, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 5) AS total FROM embeddings")
def text_vector_files(s: SparkSession, d: str) -> DataFrame:
    """K6 S8."""
    path = fresh(s, "vectors")
    writers.vectors_to_text(embedded(s, d), path)
    made = readers.text_vectors(s, path)
    return made.select("word", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("conll_files", r"WITH l AS (SELECT unnest(list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}]+')))) AS n FROM documents) SELECT count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens FROM l WHERE n > 0")
def conll_files(s: SparkSession, d: str) -> DataFrame:
    """Sentences and tokens of all files."""
    path = fresh(s, "conll")
    writers.conll_files(sentences(s, d).where(F.size("sentences") > 0), "sentences", path)
    made = readers.conll_sentences_of(s, path)
    return made.agg(F.count("*").alias("n_sentences"), F.coalesce(F.sum(F.size("sentence")), F.lit(0)).cast("long").alias("n_tokens"))


@query("term_stats_files", f"WITH {POST}, {BI}, {STAT2} SELECT field, term, tf, df FROM st2 WHERE df >= 5")
def term_stats_files(s: SparkSession, d: str) -> DataFrame:
    """Nested JSON, in parts."""
    path = fresh(s, "stats")
    own = saved(stats.filter_df(both_stats(s, d), {"lemmas": 5, "lemmas_bigrams": 5}), "stats")
    writers.term_stats_json(own, parts=16).write.text(path)
    return readers.term_stats_json(s, path)


@query("warc_files", "SELECT url, md5(html) AS page_md5 FROM pages WHERE url IS NOT NULL AND html IS NOT NULL AND octet_length(encode(html)) > 0")
def warc_files(s: SparkSession, d: str) -> DataFrame:
    """Pages as gzip WARC files, and their responses read back record by record."""
    path = fresh(s, "warc")
    pages = table(s, d, "pages").where("url is not null and html is not null and octet_length(html) > 0")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "html")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), "url", F.lit("\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    pages.select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    renamed(s, path, ".warc.gz")
    return webarchive.warc_documents(s, path, "html", "fail").select("url", F.md5(F.col("content").cast("binary")).alias("page_md5"))
