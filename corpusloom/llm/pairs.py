"""Words and word pairs of a corpus: counted by batch, merged in shards, and joined with documents by packed messages.

Both word models of this subpackage share it.  A bounded set of frequent ("hot") words is known everywhere by number; every
other word has a home, the shard of its hash.  A pair lives with its first word where that is cold, else with its second
where that is cold, else where its hash falls: so no shard grows with one word's followers, and most probabilities that a
pair needs are at hand.  The end of a text stands before and behind each document and has the hash 0.

Messages are arrays packed as compressed byte planes.  Shards follow from the texts' bytes, not from a setting, and nothing
that is computed depends on their number but for rounding.

Where texts are scored, frequent pairs are known too, and a filter of fixed size tells most pairs and words that the model
lacks; the others travel, once a batch of texts, and sums by text come back.

A model gives a word after another one  (n - taken) / (strength + total) + left * p(word),  left = (strength + all that is
taken from the first word's pairs) / (strength + total), where n counts the pair, total the first word and p is that of the
word alone.  A document's score is the sum of log10 p over its words, plus log10 of what the pair makes of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import forget_shuffles, written
from .packing import pack, unpack

HOT_WORDS = 1 << 18  # words known everywhere, at most
HOT_PAIRS = 1 << 20  # pairs of such words known everywhere, at most
FILTER_BITS = 1 << 27  # of the filter for pairs and words that are in the model
GATHERED = 6 << 20  # bytes of texts that travel together
SHARD_BYTES = 24 << 20  # of texts, that a shard is made for
END_HASH = np.uint64(0)
_SPLIT = 64  # parts in which sums over many shards are added first
_BLOCK = 1 << 14
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def uniform(keys: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from the keys and salts alone."""
    salt = 0
    for s in salts:
        salt = (salt * 0x9E3779B97F4A7C15 + s + 1) & 0xFFFFFFFFFFFFFFFF
    return (kernel.mix(stirred(keys) ^ np.uint64(salt)) >> np.uint64(11)) * 2.0**-53


def stirred(keys: np.ndarray) -> np.ndarray:
    return kernel.mix(keys.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def uniforms(keys: np.ndarray, salt: int, turns: range, kinds: int) -> np.ndarray:
    """uniform of the keys, stirred before, with salts (salt, turn, kind): by turn, kind and key."""
    factor = np.array([0x9E3779B97F4A7C15], np.uint64)
    salts = (np.array([salt + 1], np.uint64) * factor + np.arange(turns.start + 1, turns.stop + 1, dtype=np.uint64))[:, None] * factor + np.arange(1, kinds + 1, dtype=np.uint64)
    return (kernel.mix(keys ^ salts[..., None]) >> np.uint64(11)) * 2.0**-53


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return kernel.mix(first * np.uint64(0x9E3779B97F4A7C15) + kernel.mix(second))


def batch_line(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, an end before and behind each document, and the document of all but the first."""
    line, document = [np.array([END_HASH], np.uint64)], []
    for lo, hi, data, offsets in kernel.chunks(column):
        words = kernel.scan(data, offsets)
        lengths = np.diff(words.bounds)
        own = np.full(len(words.hashes) + hi - lo, END_HASH, np.uint64)
        own[np.arange(len(words.hashes)) + np.repeat(np.arange(hi - lo), lengths)] = words.hashes
        line.append(own)
        document.append(np.repeat(np.arange(lo, hi), lengths + 1))
    return np.concatenate(line), np.concatenate([np.zeros(0, np.int64), *document])


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of data, one after another."""
    ends = np.cumsum(lengths)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A batch of the rows; the columns' kinds are those of a schema of ints, longs and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(types)], names=list(names))


def slices(place: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Of sorted numbers: each one and its stretch."""
    edges = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(place)], strict=False):
        yield int(place[a]), slice(a, b)


# --- words --------------------------------------------------------------------------------------------------------------

WORDS = "shard int, hashes binary, counts binary, lengths binary, data binary"


def texts_of(documents: DataFrame, text: str) -> DataFrame:
    return documents.select(F.coalesce(documents[text], F.lit("")).alias("text"))


def shards_for(texts: DataFrame) -> int:
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(8, -(-int(total) // SHARD_BYTES))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kernel.gathered(batches, GATHERED):
        line, _ = batch_line(batch.column(0))
        hashes, n = np.unique(line[1:], return_counts=True)
        own = np.flatnonzero(n >= max(2, n.sum() / HOT_WORDS))
        yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), pa.array(n[own])], names=["hash", "n"])


def hot_words(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the end and of words that are frequent in some batch: the commonest HOT_WORDS of them."""
    counted = texts.mapInArrow(_frequent, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "hash").limit(HOT_WORDS - 1).select("hash").toArrow()["hash"].to_numpy()
    return np.unique(np.append(found.view(np.uint64), END_HASH))


def hot_number(hot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each hash's number among the hot ones, or -1."""
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    return np.where(hot[at] == hashes, at, -1)


def _count_words(shards: int, spelled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.gathered(batches, GATHERED):
            parts, texts = [], batch.num_rows
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                words = kernel.scan(data, offsets)
                if len(words.hashes):
                    hashes, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                    lengths = words.ends[first] - words.starts[first] if spelled else np.zeros(len(first), np.int64)
                    parts.append((hashes, n, lengths, _LOWER[_gather(words.data, words.starts[first], lengths)]))
            parts.append((np.array([END_HASH]), np.array([texts]), np.array([0]), np.zeros(0, np.uint8)))
            hashes, counts, lengths, spelling = _merge(parts)
            starts = np.cumsum(lengths) - lengths
            shard = (hashes % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            rows = []
            for s, own in slices(shard[order]):
                at = order[own]
                rows.append((s, pack(hashes[at]), pack(counts[at]), pack(lengths[at]), pack(_gather(spelling, starts[at], lengths[at]))))
            yield _rows(rows, WORDS)

    return run


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct hashes, summed counts, lengths and bytes of several (hashes, counts, lengths, bytes)."""
    hashes, counts, lengths, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.cumsum(lengths) - lengths
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, inverse, counts)
    return unique, total, lengths[first], _gather(data, starts[first], lengths[first])


def words_of(row) -> tuple[np.ndarray, ...]:
    """hashes, counts, lengths and bytes of a row of a WORDS table."""
    hashes, counts, lengths, data = (unpack(getattr(row, c))[0] for c in ("hashes", "counts", "lengths", "data"))
    return hashes.astype(np.uint64), counts, lengths, data.astype(np.uint8)


def _merge_words(rows: pd.DataFrame) -> pd.DataFrame:
    merged = _merge([words_of(r) for r in rows.itertuples()])
    return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), **{k: [pack(v)] for k, v in zip(("hashes", "counts", "lengths", "data"), merged, strict=True)}})


def count_words(texts: DataFrame, shards: int, spelled: bool) -> DataFrame:
    """A WORDS table, one row a shard, with the words' bytes where spelled is set."""
    made = written(texts.mapInArrow(_count_words(shards, spelled), WORDS).groupBy("shard").applyInPandas(_merge_words, WORDS), "words")
    forget_shuffles(texts.sparkSession)
    return made


def collect_hot(table: DataFrame, column: str, hot: np.ndarray, kind: str = "<i8") -> np.ndarray:
    """Of the hot words, the numbers that a packed column of a table by shard holds beside hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hashes, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number = hot_number(hot, unpack(hashes)[0].astype(np.uint64))
                own = np.flatnonzero(number >= 0)
                rows.append((pack(number[own], unpack(values)[0][own]),))
            yield _rows(rows, "part binary")

    out = np.zeros(len(hot), kind)
    for r in table.select("hashes", column).mapInArrow(run, "part binary").toLocalIterator():  # HOT_WORDS numbers in all
        at, values = unpack(r["part"])
        out[at] = values
    return out


def count_stats(table: DataFrame, column: str, at: int) -> dict[str, int]:
    """rows, total and how many numbers are 1, 2, 3 and 4, of one packed array of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(n), int(n.sum()), *(int((n == k).sum()) for k in range(1, 5))) for n in (unpack(x)[at] for x in batch.column(0).to_pylist())]
            yield _rows(rows, "rows long, total long, n1 long, n2 long, n3 long, n4 long")

    names = ["rows", "total", "n1", "n2", "n3", "n4"]
    r = table.select(column).mapInArrow(run, "rows long, total long, n1 long, n2 long, n3 long, n4 long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    return {c: int(r[c]) for c in names}


# --- pairs --------------------------------------------------------------------------------------------------------------

PAIRS = "shard int, pairs binary"
NOTES = "shard int, kind int, note binary"
CUSTOMERS, RESTAURANTS, ASKED, STATE, FREQUENT = range(5)  # kinds of notes; RESTAURANTS are by block, not by shard


def _shard_of(vocab: np.ndarray, code: np.ndarray, f: np.ndarray, s: np.ndarray, shards: int) -> np.ndarray:
    place = np.where(code[f] < 0, vocab[f], np.where(code[s] < 0, vocab[s], pair_hash(vocab[f], vocab[s])))
    return (place % np.uint64(shards)).astype(np.int64)


def _coded(vocab: np.ndarray, code: np.ndarray, f: np.ndarray, s: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cold words and, for pairs of numbers in vocab, codes: a hot word's number, or hot plus the place among the cold."""
    cold = np.unique(np.concatenate([f[code[f] < 0], s[code[s] < 0]]))
    number = lambda x: np.where(code[x] < 0, hot + np.searchsorted(cold, x), code[x])
    return vocab[cold], number(f), number(s)


def _count_pairs(shards: int, hot_of: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_of()
        for batch in kernel.gathered(batches, GATHERED):
            line, _ = batch_line(batch.column(0))
            vocab, place = np.unique(line, return_inverse=True)
            key, n = np.unique(place[:-1] * np.int64(len(vocab)) + place[1:], return_counts=True)
            f, s, code = key // len(vocab), key % len(vocab), hot_number(hot, vocab)
            shard = _shard_of(vocab, code, f, s, shards)
            order = np.argsort(shard, kind="stable")
            rows = []
            for k, own in slices(shard[order]):
                at = order[own]
                rows.append((k, pack(*_coded(vocab, code, f[at], s[at], len(hot)), n[at])))
            del line, place, key, n, f, s, vocab, code
            kernel.give_back()
            yield _rows(rows, PAIRS)

    return run


def _merge_pairs(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in rows["pairs"]]
        cold = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]))
        keys = []
        for own, f, s, _ in parts:
            to = np.concatenate([np.arange(hot), hot + np.searchsorted(cold, own.astype(np.uint64))]) if len(own) else np.arange(hot)
            keys.append(to[f] * np.int64(hot + len(cold)) + to[s])
        key, n = np.concatenate(keys), np.concatenate([p[3] for p in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = key[new]
        return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "pairs": [pack(cold, key // (hot + len(cold)), key % (hot + len(cold)), np.add.reduceat(n[order], new))]})

    return run


def count_pairs(texts: DataFrame, shards: int, hot_of: Callable, hot: int) -> DataFrame:
    """A PAIRS table, one row a shard: cold words, codes of the first and second words in order, counts."""
    made = written(texts.mapInArrow(_count_pairs(shards, hot_of), PAIRS).groupBy("shard").applyInPandas(_merge_pairs(hot), PAIRS), "pairs")
    forget_shuffles(texts.sparkSession)
    return made


def hashes_of(codes: np.ndarray, hot: np.ndarray, cold: np.ndarray) -> np.ndarray:
    return np.concatenate([hot, cold.astype(np.uint64)])[codes]


def customers_notes(hot: np.ndarray, cold: np.ndarray, second: np.ndarray, tables: np.ndarray, shards: int) -> list[tuple]:
    """Tables of pairs summed by second word, for the words' homes."""
    total = np.bincount(second, tables)
    code = np.flatnonzero(total)
    words, total = hashes_of(code, hot, cold), total[code].astype(np.int64)
    home = (words % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((code, home))
    rows = []
    for h, own in slices(home[order]):
        at = order[own]
        near = code[at] < len(hot)
        rows.append((h, CUSTOMERS, pack(code[at[near]], total[at[near]], words[at[~near]], total[at[~near]])))
    return rows


def restaurant_notes(codes: np.ndarray, values: np.ndarray) -> list[tuple]:
    """Sums over a shard's pairs of hot first words, by block of these; the block stands in place of a shard."""
    return [(b, RESTAURANTS, pack(codes[own], values[own])) for b, own in slices(codes // _BLOCK)]


def asked_notes(shard: int, shards: int, cold: np.ndarray, second: np.ndarray, hot: int) -> list[tuple]:
    """Cold second words that live in another shard, for which their home is asked."""
    words = cold[np.unique(second[second >= hot]) - hot].astype(np.uint64)
    home = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return [(h, ASKED, shard.to_bytes(8, "little") + pack(words[order[own]])) for h, own in slices(home[order]) if h != shard]


def first_notes(shards: int, hot_of: Callable, taken: Callable[[np.ndarray], np.ndarray]):
    """Notes of a PAIRS table with one table a pair; RESTAURANTS are sums of taken(counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_of()
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cold, first, second, n = unpack(packed)
                held = np.bincount(first[first < len(hot)], taken(n[first < len(hot)]))
                at = np.flatnonzero(held)
                yield _rows([*customers_notes(hot, cold, second, np.ones(len(n)), shards), *restaurant_notes(at, held[at]), *asked_notes(shard, shards, cold, second, len(hot))], NOTES)

    return run


def _add_restaurants(rows: pd.DataFrame) -> pd.DataFrame:
    codes, values = (np.concatenate(x) for x in zip(*(unpack(x) for x in rows["note"]), strict=True))
    at, inverse = np.unique(codes, return_inverse=True)
    return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "part": rows["part"].iloc[:1].to_numpy(), "note": [pack(at, np.bincount(inverse, values))]})


def collect_restaurants(notes: DataFrame, hot: int) -> np.ndarray:
    """Sums of the RESTAURANTS notes by hot word, added in two steps."""
    parts = notes.where(f"kind = {RESTAURANTS}").select("shard", F.pmod(F.xxhash64("note"), F.lit(_SPLIT)).alias("part"), "note")
    schema = "shard int, part long, note binary"
    parts = parts.groupBy("shard", "part").applyInPandas(_add_restaurants, schema).withColumn("part", F.lit(0).cast("long"))
    out = np.zeros(hot)
    for r in parts.groupBy("shard", "part").applyInPandas(_add_restaurants, schema).toLocalIterator():  # HOT_WORDS numbers in all
        at, values = unpack(r["note"])
        out[at] = values
    return out


def customers_of(words: pd.DataFrame, notes: pd.DataFrame, hot: np.ndarray) -> np.ndarray:
    """Customers of a shard's words, from the notes sent to it."""
    hashes = unpack(words["hashes"].iloc[0])[0].astype(np.uint64)
    n = np.zeros(len(hashes), np.int64)
    for note in notes["note"]:
        code, tables, cold, cold_tables = unpack(note)
        n[np.searchsorted(hashes, hot[code])] += tables
        n[np.searchsorted(hashes, cold.astype(np.uint64))] += cold_tables
    return n


POINTS = "shard int, hashes binary, points binary"


def _points_of(model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(model):
        return pd.DataFrame({"shard": np.zeros(0, np.int32), "hashes": [], "points": []})
    hashes, points = unpack(model["hashes"].iloc[0])[0].astype(np.uint64), unpack(model["points"].iloc[0])[0]
    notes = [(int.from_bytes(x[:8], "little"), unpack(x[8:])[0].astype(np.uint64)) for x in asked["note"]]
    own = (int(model["shard"].iloc[0]), hashes)
    return pd.DataFrame({"shard": [s for s, _ in (own, *notes)], "hashes": [pack(w) for _, w in (own, *notes)], "points": [pack(points[np.searchsorted(hashes, w)]) for _, w in (own, *notes)]})


def points_for_pairs(model: DataFrame, notes: DataFrame) -> DataFrame:
    """A POINTS table: each shard's own words, and the cold words of other shards that its pairs need."""
    return model.select("shard", "hashes", "points").groupBy("shard").cogroup(notes.where(f"kind = {ASKED}").groupBy("shard")).applyInPandas(_points_of, POINTS)


def second_points(cold: np.ndarray, second: np.ndarray, hot_points: np.ndarray, rows) -> np.ndarray:
    """log10 p of each pair's second word, from the rows of a POINTS table."""
    known, value = (np.concatenate(x) for x in zip(*((unpack(h)[0].astype(np.uint64), unpack(p)[0]) for h, p in rows), strict=True)) if rows else (np.zeros(0, np.uint64), np.zeros(0))
    every = np.concatenate([hot_points, np.zeros(len(cold))])
    used = np.unique(second[second >= len(hot_points)])
    if len(used):
        order = np.argsort(known)
        every[used] = value[order][np.searchsorted(known[order], cold[used - len(hot_points)].astype(np.uint64))]
    return every[second]


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(n)).astype(np.int64)


def frequent_bucket(pairs: DataFrame, hot: int) -> int:
    """The least bucket of counts (eight to a doubling) from which up there are HOT_PAIRS pairs of hot words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(1, np.int64)
            for x in batch.column(0).to_pylist():
                _, f, s, n = unpack(x)
                own = np.bincount(_bucket(n[(f < hot) & (s < hot)]), minlength=len(total))
                own[: len(total)] += total
                total = own
            yield _rows([(int(b), int(total[b])) for b in np.flatnonzero(total)], "bucket int, n long")

    counts = {r["bucket"]: r["n"] for r in pairs.select("pairs").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    least, held = 1 << 20, 0
    for b in sorted(counts, reverse=True):
        held += counts[b]
        if held > HOT_PAIRS:
            break
        least = b
    return least


def frequent(first: np.ndarray, second: np.ndarray, n: np.ndarray, taken: np.ndarray, hot: int, least: int) -> bytes:
    own = np.flatnonzero((first < hot) & (second < hot) & (_bucket(n) >= least))
    return pack(first[own], second[own], n[own], taken[own])


def frequent_rows(hot: int, least: int, taken: np.ndarray):
    """FREQUENT notes of a PAIRS table from which by count so much is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, f, s, n = unpack(x)
                yield _rows([(shard, FREQUENT, frequent(f, s, n, taken[np.minimum(n, 3)], hot, least))], NOTES)

    return run


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)) & np.uint64(FILTER_BITS - 1)


def _set_bits(filter_: np.ndarray, hashes: np.ndarray) -> None:
    bit = _bits(hashes)
    np.bitwise_or.at(filter_, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)))


def maybe_known(filter_: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if filter_ is None:
        return np.ones(len(hashes), bool)
    bit = _bits(hashes)
    return (filter_[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def known_filter(pairs: DataFrame, shared, count: int) -> np.ndarray | None:
    """Bits of all pairs and of their cold words; None where they would fill more than half of it, which changes no result."""
    if count > FILTER_BITS // 4:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = np.zeros(FILTER_BITS // 8, np.uint8), False
        for batch in batches:
            for x in batch.column(0).to_pylist():
                cold, f, s, _ = unpack(x)
                _set_bits(own, pair_hash(hashes_of(f, shared.value, cold), hashes_of(s, shared.value, cold)))
                _set_bits(own, cold.astype(np.uint64))
                some = True
        if some:
            yield _rows([(k, pack(part)) for k, part in enumerate(np.split(own, 64))], "block int, bits binary")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [pack(np.bitwise_or.reduce([unpack(x)[0].astype(np.uint8) for x in rows["bits"]]))]})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in pairs.select("pairs").mapInArrow(run, "block int, bits binary").groupBy("block").applyInPandas(join, "block int, bits binary").toLocalIterator():
        part = unpack(r["bits"])[0]
        out[r["block"] * len(part) : (r["block"] + 1) * len(part)] = part
    return out


# --- scoring ------------------------------------------------------------------------------------------------------------


@dataclass
class PairModel:
    words: DataFrame  # shard, hashes, counts, points (log10 p): packed, one row a shard
    pairs: DataFrame  # PAIRS
    notes: DataFrame  # kinds ASKED and, unless taken follows from the counts, STATE: what is taken from each pair
    taken: np.ndarray | None  # by count: 0, 1, 2, 3 and more
    strength: float
    shards: int
    tokens: int
    distinct: int
    unseen: float  # log10 p of a word not seen in training
    hot: np.ndarray
    hot_counts: np.ndarray
    hot_points: np.ndarray
    hot_left: np.ndarray  # log10
    frequent: tuple[np.ndarray, np.ndarray]  # sorted numbers of pairs of hot words (first * hot words + second), log10 deltas
    filter: np.ndarray | None

    def with_frequent(self, notes: DataFrame) -> PairModel:
        """The model that knows the pairs of FREQUENT notes."""
        keys, deltas = [np.zeros(0, np.int64)], [np.zeros(0)]
        for r in notes.where(f"kind = {FREQUENT}").select("note").toLocalIterator():  # HOT_PAIRS in all
            f, s, n, taken = unpack(r["note"])
            keys.append(f * np.int64(len(self.hot)) + s)
            p = self.hot_points[s]
            deltas.append(np.log10((n - taken) / (self.strength + self.hot_counts[f]) + 10 ** (self.hot_left[f] + p)) - p)
        key = np.concatenate(keys)
        order = np.argsort(key)
        return replace(self, frequent=(key[order], np.concatenate(deltas)[order]))

    def deltas(self, cold, first, second, n, taken, rows) -> tuple[np.ndarray, np.ndarray]:
        """log10 of what each pair makes of its second word's p; log10 left by code of the first word."""
        hot = len(self.hot)
        taken = self.taken[np.minimum(n, 3)] if taken is None else taken
        total = np.concatenate([self.hot_counts, np.bincount(first, n, minlength=hot + len(cold))[hot:]])
        held = np.bincount(first, taken, minlength=hot + len(cold))[hot:]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.concatenate([self.hot_left, np.where(total[hot:] > 0, np.log10((self.strength + held) / (self.strength + total[hot:])), 0.0)])
        log_p = second_points(cold, second, self.hot_points, rows)
        own = (n - taken) / (self.strength + total[first]) + 10 ** (left[first] + log_p)
        return np.log10(own) - log_p, left


def base_points(counts: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return np.log10((counts + 0.5) / (tokens + 0.5 * (distinct + 1)))


_SENT = "block long, shard int, kept binary, body binary"
_ANSWER = "block long, kept binary, sums binary"


def _local(model: PairModel, vocab: np.ndarray, code: np.ndarray, ask: np.ndarray, f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 deltas of the pairs that are settled where the texts are, whether each must be asked for, and whether what its
    first word leaves must be."""
    hot, (keys, deltas) = len(model.hot), model.frequent
    a, b = code[f], code[s]
    value = np.where(a >= 0, model.hot_left[a], 0.0)  # of pairs that the model lacks
    go = (a >= 0) | ask[f]
    go[go] = maybe_known(model.filter, pair_hash(vocab[f[go]], vocab[s[go]]))
    left = (a < 0) & ask[f] & ~go
    if len(keys):
        both = np.flatnonzero(go & (a >= 0) & (b >= 0))
        key = a[both] * np.int64(hot) + b[both]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        value[both[hit]] = deltas[at[hit]]
        go[both[hit]] = False
    value[go] = 0.0
    return value, go, left


def _send(model_of: Callable):
    """Of each batch: a row with its kept columns and the sums that are settled here, and a row a shard with the rest.

    The latter holds cold words; of those that are asked for their places, number of texts, texts, times, and times before a
    pair that the model lacks; of pairs their codes, number of texts, texts and times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: PairModel = model_of()
        hot, counts, points, shards, tokens, distinct = model.hot, model.hot_counts, model.hot_points, model.shards, model.tokens, model.distinct
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(kernel.gathered(batches, GATHERED)):
            size = batch.num_rows
            line, document = batch_line(batch.column(batch.num_columns - 1))
            vocab, place = np.unique(line, return_inverse=True)
            document, place = document.astype(np.int32), place.astype(np.int32)
            code, second = hot_number(hot, vocab), place[1:]
            del line
            seen = (code >= 0) & (counts[code] > 0)
            sums = [np.bincount(document, minlength=size).astype(float)]
            ask = (code < 0) & maybe_known(model.filter, vocab)  # other cold words are not in the model
            sums += [np.bincount(document, np.where(code >= 0, x, np.where(ask, 0.0, y))[second], minlength=size) for x, y in ((seen, 0.0), (base_points(counts[code], tokens, distinct), base_points(0, tokens, distinct)), (points[code], model.unseen))]
            sink = pa.BufferOutputStream()
            kept = batch.select(batch.schema.names[:-1])
            with pa.ipc.new_stream(sink, kept.schema) as stream:
                stream.write_batch(kept)
            kept = sink.getvalue().to_pybytes()
            far = ask[second]
            word_key, word_tf = np.unique(second[far] * np.int64(size) + document[far], return_counts=True)
            del batch, sink, far
            key = place[:-1] * np.int64(len(vocab)) + second
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, doc = key[order], document[order]
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            tf, key, doc = np.diff(np.append(new, len(key))), key[new], doc[new]
            del order, new, place, second, document
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            per_pair, key = np.diff(np.append(begins, len(key))), key[begins]
            f, s = key // len(vocab), key % len(vocab)
            value, go, left = _local(model, vocab, code, ask, f, s)
            of = np.repeat(np.arange(len(f)), per_pair)
            sums[3] += np.bincount(doc, tf * value[of], minlength=size)
            lone = left[of]  # the first word is one of the text's asked words, too
            word_left = np.bincount(np.searchsorted(word_key, f[of[lone]] * np.int64(size) + doc[lone]), tf[lone], minlength=len(word_key)).astype(np.int64)
            of = go[of]
            doc, tf = doc[of], tf[of]
            f, s, per_pair = f[go], s[go], per_pair[go]
            block = (part << 24) + number
            rows = [(block, block % shards, kept, pack(*sums))]
            word, word_doc = word_key // size, (word_key % size).astype(np.int32)
            home, shard = (vocab[word] % np.uint64(shards)).astype(np.int64), _shard_of(vocab, code, f, s, shards)
            by_home, by_shard = np.argsort(home, kind="stable"), np.argsort(shard, kind="stable")
            entries = np.argsort(np.repeat(shard, per_pair), kind="stable")
            ends = np.append(0, np.cumsum(per_pair[by_shard]))
            word_edges, pair_edges = (np.searchsorted(x, np.arange(shards + 1)) for x in (home[by_home], shard[by_shard]))
            for k in np.flatnonzero((np.diff(word_edges) > 0) | (np.diff(pair_edges) > 0)).tolist():
                w, p = by_home[word_edges[k] : word_edges[k + 1]], by_shard[pair_edges[k] : pair_edges[k + 1]]
                mine = entries[ends[pair_edges[k]] : ends[pair_edges[k + 1]]]
                asked, per_word = np.unique(word[w], return_counts=True)
                cold, codes_f, codes_s = _coded(vocab, code, np.concatenate([asked, f[p]]), np.concatenate([asked, s[p]]), len(hot))
                n = len(asked)
                body = pack(cold, codes_f[:n] - len(hot), per_word, word_doc[w], word_tf[w], word_left[w], codes_f[n:], codes_s[n:], per_pair[p], doc[mine], tf[mine])
                rows.append((block, k, None, body))
            made = _rows(rows, _SENT)
            del rows, key, doc, tf, f, s, entries, word_key, word, word_doc, word_tf, word_left, by_home, by_shard
            kernel.give_back()
            yield made

    return run


def _answer(model_of: Callable):
    def run(sent: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        model: PairModel = model_of()
        n_hot = len(model.hot)
        none = np.zeros(0)
        hashes, counts, points = none.astype(np.uint64), none.astype(np.int64), none
        for r in own[own["what"] == 0].itertuples():
            hashes, counts, points = (unpack(x)[0] for x in (r.a, r.b, r.c))
            hashes = hashes.astype(np.uint64)
        cold, keys, deltas, left, width = none.astype(np.uint64), none.astype(np.int64), none, model.hot_left, n_hot
        for r in own[own["what"] == 1].itertuples():
            cold, first, second, n = unpack(r.a)
            cold, width = cold.astype(np.uint64), n_hot + len(cold)
            state = [unpack(x)[0] for x in own.loc[own["what"] == 2, "a"]]
            deltas, left = model.deltas(cold, first, second, n, state[0].astype(float) if state else None, list(own.loc[own["what"] == 3, ["a", "b"]].itertuples(index=False)))
            keys = first * np.int64(width) + second
        out = []
        for r in sent.itertuples():
            if r.kept is not None:
                out.append((r.block, r.kept, r.body))
                continue
            theirs, word, per_word, word_doc, word_tf, word_left, f, s, per_pair, doc, tf = unpack(r.body)
            theirs = theirs.astype(np.uint64)
            at = np.minimum(np.searchsorted(cold, theirs), len(cold) - 1) if len(cold) else np.zeros(len(theirs), np.int64)
            to = np.concatenate([np.arange(n_hot), np.where(cold[at] == theirs, n_hot + at, -1) if len(cold) else np.full(len(theirs), -1)])
            c, score = np.zeros(len(word)), np.full(len(word), model.unseen)
            if len(hashes) and len(word):
                at = np.minimum(np.searchsorted(hashes, theirs[word]), len(hashes) - 1)
                hit = hashes[at] == theirs[word]
                c[hit], score[hit] = counts[at[hit]], points[at[hit]]
            context = to[n_hot + word]
            lone = np.where(context >= 0, left[context], 0.0)
            f, s = to[f], to[s]
            value = np.where(f >= 0, left[f], 0.0)
            known = np.flatnonzero((f >= 0) & (s >= 0))
            if len(keys) and len(known):
                key = f[known] * np.int64(width) + s[known]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                value[known[hit]] = deltas[at[hit]]
            of = np.repeat(np.arange(len(word)), per_word)
            seen, inverse = np.unique(np.concatenate([word_doc, doc]), return_inverse=True)
            by_word = lambda x, i=inverse[: len(word_doc)], n=len(seen): np.bincount(i, x, minlength=n)
            total = by_word(word_tf * score[of] + word_left * lone[of]) + np.bincount(inverse[len(word_doc) :], tf * np.repeat(value, per_pair), minlength=len(seen))
            out.append((r.block, None, pack(seen, by_word(word_tf * (c > 0)[of]), by_word(word_tf * base_points(c, model.tokens, model.distinct)[of]), total)))
        kernel.give_back()
        return pd.DataFrame(out, columns=["block", "kept", "sums"])

    return run


_SUMS = ("n_tokens", "n_known", "base_score", "score")


def _finish(rows: pa.Table) -> pa.Table:
    kept = total = None
    for own, sums in zip(rows["kept"].to_pylist(), rows["sums"].to_pylist(), strict=True):
        if own is not None:
            kept, total = pa.ipc.open_stream(own).read_all(), np.stack(unpack(sums))
    for own, sums in zip(rows["kept"].to_pylist(), rows["sums"].to_pylist(), strict=True):
        if own is None:
            doc, *columns = unpack(sums)
            total[1:, doc] += np.stack(columns)
    n, known, base, score = total
    made = (n.astype(np.int64), known.round().astype(np.int64), base, score)
    return pa.Table.from_arrays([*kept.columns, *map(pa.array, made)], names=[*kept.schema.names, *_SUMS])


def score(documents: DataFrame, model: PairModel, text: str) -> DataFrame:
    """documents' other columns, n_tokens, n_known, base_score and score; documents has none of these names."""
    spark = documents.sparkSession
    forget_shuffles(spark)
    small = spark.sparkContext.broadcast(replace(model, words=None, pairs=None, notes=None))
    whole = spark.sparkContext.broadcast(replace(model, words=None, pairs=None, notes=None, frequent=None, filter=None))
    keep = [c for c in documents.columns if c != text]
    source = documents.select(*keep, F.coalesce(documents[text], F.lit("")).alias(text))
    sent = source.mapInArrow(_send(lambda: small.value), _SENT)
    none = F.lit(None).cast("binary")
    part = lambda df, what, *columns: df.select("shard", F.lit(what).alias("what"), *(F.col(c).alias(x) for c, x in zip(columns, "abc", strict=False)), *(none.alias(x) for x in "abc"[len(columns) :]))
    own = part(model.words, 0, "hashes", "counts", "points").union(part(model.pairs, 1, "pairs")).union(part(points_for_pairs(model.words, model.notes), 3, "hashes", "points"))
    own = own.union(part(model.notes.where(f"kind = {STATE}"), 2, "note"))
    answered = sent.groupBy("shard").cogroup(own.groupBy("shard")).applyInPandas(_answer(lambda: whole.value), _ANSWER)
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return answered.groupBy("block").applyInArrow(_finish, schema)
