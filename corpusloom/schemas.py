"""Explicit schemas of a corpus's stages; counts must be maps, which inference would turn into structs."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TOKENS = T.ArrayType(T.ArrayType(T.ArrayType(_TEXT)))  # sentences of tokens of columns
RAW_DOCUMENT = _of(url=_TEXT, date=_TEXT, content=_TEXT)
ANNOTATED = _of(url=_TEXT, date=_TEXT, content=_TEXT, content_corenlp=TOKENS)
SIGNED = _of(url=_TEXT, record_id=_TEXT, minhash=T.ArrayType(_LONG))
LEMMAS = _of(url=_TEXT, lemmas=T.ArrayType(_TEXT), lemmas_bigrams=T.ArrayType(_TEXT), content=_TEXT)
COUNTS = _of(url=_TEXT, lemmas_counts=T.MapType(_TEXT, _LONG), lemmas_bigrams_counts=T.MapType(_TEXT, _LONG), content=_TEXT)
HITS = _of(url=_TEXT, score=_DOUBLE, content=_TEXT)
TERM_STATS = _of(field=_TEXT, term=_TEXT, tf=_DOUBLE, df=_LONG)
TERM_WEIGHTS = _of(term=_TEXT, weight=_DOUBLE)
DENSE_VECTORS = _of(idx=_LONG, word=_TEXT, vec=T.ArrayType(_DOUBLE))
SPARSE_VECTORS = _of(word=_TEXT, dim=T.IntegerType(), val=_DOUBLE)
STATS_JSON = "map<string,struct<TF:map<string,double>,DF:map<string,bigint>>>"
