"""BPE encoding and decoding by a tokenization automaton.

The merges compile, one merge gadget after another, into a deterministic automaton over tokens: it has an arc for token u
after token t exactly if t, u can stand side by side in a correct tokenization.  The gadget of a merge (a, b) -> ab sends
all arcs labelled a to a copy of their target that lacks the arc b, and adds to each state with an arc a an arc ab to where
b leads.  A copy is stored as its original and the barred label, so the automaton takes one row a merge; arcs are expanded
into a transition table as texts need them.  Every prefix of a word has one correct tokenization, so each position of a
word is reached by one arc only, and encoding is a left-to-right pass of table look-ups.  Decoding emits arc labels.

White space, letters and digits are those of Unicode as the regex module has it.

(Construction after Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA", 2024.)
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

_ROOT = 0
_NEVER = 1 << 60
_TABLE_ENTRIES = 400_000
_CACHED_WORDS = 250_000
_CACHED_CHUNKS = 450_000
_OUT_BYTES = 4 << 20


class MergeAutomaton:
    """Automaton of a merge list; tokens are numbered as in the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        size = max(vocab.values()) + 1
        self.suffix = suffix
        self.labels = [""] * size
        for text, k in vocab.items():
            self.labels[k] = text
        self.target = [_ROOT] * size  # where arcs with this label lead
        self.left, self.made = [-1] * size, [-1] * size  # a token's left part, and the merge that made it
        self.original, self.barred, self.born = [-1], [-1], [-1]  # of each state
        self.table: dict[int, bool] = {}
        for step, (a, b) in enumerate(merges):
            self._gadget(step, vocab[a], vocab[b], vocab[a + b])
        self.pieces: dict[str, int] = {}  # tokens, and with -1 what only begins some token
        for text in vocab:
            bare = text.removesuffix(suffix) if suffix else text
            for end in range(1, len(bare) + 1):
                self.pieces.setdefault(bare[:end], -1)
        for text, k in vocab.items():
            if not suffix or not text.endswith(suffix):
                self.pieces[text] = k
        self.closing = {t.removesuffix(suffix): k for t, k in vocab.items() if not suffix or t.endswith(suffix)}

    def _gadget(self, step: int, a: int, b: int, ab: int) -> None:
        if not self._arc(self.target[a], b):
            self.made[ab] = _NEVER
            return
        self.left[ab], self.made[ab], self.target[ab] = a, step, self.target[b]
        self.original.append(self.target[a])
        self.barred.append(b)
        self.born.append(step)
        self.target[a] = len(self.born) - 1

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this label; it then leads to target[token]."""
        while state != _ROOT:
            if self.made[token] >= self.born[state]:  # an arc that came later came with the arc of its left part
                token = self.left[token]
                if token < 0:
                    return False
            elif self.barred[state] == token:
                return False
            else:
                state = self.original[state]
        return self.made[token] != _NEVER

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, in the vocabulary's byte alphabet."""
        n, pieces, table, target = len(word), self.pieces, self.table, self.target
        states, came = [-1] * (n + 1), [(0, 0)] * (n + 1)
        states[0] = _ROOT
        for i in range(n):
            state = states[i]
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                token = self.closing.get(piece, -1) if j == n else pieces.get(piece, -2)
                if token < 0:
                    if token == -2:
                        break
                    continue
                if states[j] >= 0:
                    continue
                key = state << 20 | token
                found = table.get(key)
                if found is None:
                    if len(table) > _TABLE_ENTRIES:
                        table.clear()
                    found = table[key] = self._arc(state, token)
                if found:
                    states[j], came[j] = target[token], (i, token)
        out, at = [], n
        while at:
            at, token = came[at]
            out.append(token)
        return out[::-1]


def _byte_alphabet() -> list[str]:
    """The usual printable stand-in for each byte: itself where it prints, else the next letter from U+0100."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """Encoder and decoder for a tokenizer file of lower-casing, word-splitting, byte-alphabet BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = list(self.automaton.labels)
        for text, k in self.special.items():
            self.labels += [""] * (k + 1 - len(self.labels))
            self.labels[k] = text
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.bytes = dict(enumerate(_byte_alphabet()))
        self.words: dict[str, bytes] = {}
        outer = self

        class Chunks(dict):
            """Packed ids by text between white space; filled as texts need it, emptied when large."""

            def __missing__(self, chunk: str) -> bytes:
                ids = outer._chunk(chunk)
                if len(chunk) <= 64:
                    if len(self) >= _CACHED_CHUNKS:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            spelled = word if word.isascii() and word.isprintable() else word.encode("utf-8", "replace").decode("latin-1").translate(self.bytes)
            ids = np.array(self.automaton.encode(spelled), "<u4").tobytes()
            if len(word) <= 48:
                if len(self.words) >= _CACHED_WORDS:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return b"".join([self._word(w) for w in self.pattern.findall(text.lower())])

    def _plain(self, text: str) -> bytes:
        pieces = self.space.split(text) if self.odd_space.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Labels of the ids, joined by a blank, as no decoder is set in such files."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The compiled tokenizer of a file, made once a Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ids (packed little-endian unsigned 32-bit), n_tokens and decoded to the kept columns of df (all by default).

    A null text counts as empty: no ids, an empty decoded text.  Texts of any length are encoded whole.  Rows are neither
    merged nor reordered, so repeated rows and ids give repeated results; an empty table gives an empty one.  Where df has
    a column of one of the three names, the added one gets underscores in front.  path must open on every executor.
    """
    keep = df.columns if keep is None else keep
    source = df.select(*[df[c] for c in keep], F.coalesce(df[text], F.lit("")).alias(pick(df, "_text_in")))
    names = [pick(df.select(*keep), c) for c in ("ids", "n_tokens", "decoded")]
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.BinaryType(), T.LongType(), T.StringType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts, at, begun = batch.column(batch.num_columns - 1), 0, 0
            ids: list[bytes] = []
            decoded: list[str] = []
            held = 0
            for at in range(batch.num_rows):
                ids.append(bpe.encode(texts[at].as_py()))
                decoded.append(bpe.decode(ids[-1]))
                held += len(ids[-1]) + len(decoded[-1])
                if held >= _OUT_BYTES or at + 1 == batch.num_rows:
                    part = batch.slice(begun, at + 1 - begun)
                    made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *names])
                    ids, decoded, held, begun = [], [], 0, at + 1

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that packed ids stand for; null ids decode to an empty text; a name that is taken gets underscores."""
    out = pick(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
