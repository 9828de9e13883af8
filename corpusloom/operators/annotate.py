"""[G10] Annotation of texts by an exchangeable annotator, one client a partition."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..schemas import TOKENS

Sentence = list[list[str]]
Annotator = Callable[[str], list[Sentence]]
ANNOTATORS: dict[str, Callable[[], Annotator]] = {}


def annotator(name: str) -> Callable[[Callable[[], Annotator]], Callable[[], Annotator]]:
    """Registers a maker of annotators: functions from text to sentences of tokens (word, lemma, part of speech, entity)."""

    def put(f: Callable[[], Annotator]) -> Callable[[], Annotator]:
        ANNOTATORS[name] = f
        return f

    return put


def text_chunks(text: str, max_length: int) -> Iterator[str]:
    """Whole lines gathered until they exceed max_length characters."""
    held: list[str] = []
    size = 0
    for line in text.splitlines(keepends=True):
        held.append(line)
        size += len(line)
        if size > max_length:
            yield "".join(held)
            held, size = [], 0
    if held:
        yield "".join(held)


@annotator("rules")
def rules() -> Annotator:
    """Sentences end at . ! ? or a line's end; words are letters, numbers or single marks; lemmas are lower-cased words.

    Capitalised words that don't begin a sentence are NNP, numbers CD, marks their own tag, everything else NN.
    """
    token = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[^\w\s]")

    def run(text: str) -> list[Sentence]:
        out: list[Sentence] = []
        for line in text.splitlines():
            sentence: Sentence = []
            for word in token.findall(line):
                tag = "NN" if word[0].isalpha() else "CD" if word[0].isdigit() else word
                if tag == "NN" and word[0].isupper() and sentence:
                    tag = "NNP"
                sentence.append([word, word.lower() if tag != "NNP" else word, tag, "O"])
                if word in (".", "!", "?"):
                    out.append(sentence)
                    sentence = []
            if sentence:
                out.append(sentence)
        return out

    return run


def http_server(url: str, properties: str, tries: int = 3) -> Callable[[], Annotator]:
    """Maker of an annotator that posts text to a server answering in CoNLL, whose first column numbers the tokens."""

    def make() -> Annotator:
        from urllib.request import Request, urlopen

        def run(text: str) -> list[Sentence]:
            last: Exception | None = None
            for _ in range(tries):
                try:
                    with urlopen(Request(f"{url}?properties={properties}", text.encode("utf-8"))) as answer:
                        body = answer.read().decode("utf-8")
                    return [[line.split("\t")[1:] for line in s.split("\n") if line] for s in body.strip().split("\n\n") if s]
                except OSError as error:
                    last = error
            raise last or OSError("no answer")

        return run

    return make


PIECE = 1 << 18  # bytes of text annotated at once; a longer text is a piece of its own
ARROW_TOKENS = pa.list_(pa.list_(pa.list_(pa.string())))


def pieces(batch: pa.RecordBatch, fields: Sequence[str], size: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in slices whose fields have about so many bytes."""
    lengths = np.zeros(batch.num_rows, np.int64)
    for f in fields:
        lengths += pc.fill_null(pc.binary_length(batch.column(f)), 0).to_numpy(zero_copy_only=False)
    at = (np.cumsum(lengths) - lengths) // size
    bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield batch.slice(a, b - a)


def annotate(df: DataFrame, fields: Sequence[str], name: str | Callable[[], Annotator] = "rules", max_length: int = 10000) -> DataFrame:
    """Adds <field>_corenlp, sentences of tokens of columns; null where the field is null or empty.

    The annotations of PIECE bytes of text are held at once, not those of a batch.
    """
    make = ANNOTATORS[name] if isinstance(name, str) else name
    fields = [f for f in fields if f in df.columns]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{f}_corenlp", TOKENS) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            for piece in pieces(batch, fields, PIECE):
                made = [pa.array([[s for part in text_chunks(t, max_length) for s in own(part)] if t else None for t in piece.column(f).to_pylist()], ARROW_TOKENS) for f in fields]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)
