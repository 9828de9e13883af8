"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The least score leaves a copy of a test item some points to lose: a word changed or lost costs 3 and breaks n of the item's
g word n-grams, one left off at an end costs 2 and breaks one, a word put in costs 1 and breaks n - 1.  So a copy that may
lose p points still shares at least m = g - (n - 1) p n-grams, or g - p / 2 single words; each item takes the longest n, of
SEED_WORDS at most, for which m is 1 or more.  Among any g - m + 1 of an item's n-grams one at least is shared.  The seeds
of an item are its g - m + 1 n-grams that are rarest in the training corpus, counted over all documents: no copy within the
tolerance is missed, and frequent phrases open few alignments.  Every document that holds a
seed is aligned with the item around its hits, where enough of the item's words stand there for the score; the local alignment's score relative to the item's own decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
ITEM_GRAMS = 1 << 20  # n-grams of the items that are searched at once, and broadcast
_FILTER_BITS = 20


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi, data, offsets in kernel.chunks(pa.array(texts, pa.string())):
        words = kernel.scan(data, offsets, letters_only=True)
        out += [words.hashes[words.bounds[k] : words.bounds[k + 1]].copy() for k in range(hi - lo)]
    return out


def points_to_lose(words: int, least_score: float) -> int:
    return int((1 - least_score) * MATCH * words + 1e-9)


def seed_bound(words: int, least_score: float, n: int) -> tuple[int, int]:
    """(length of the seeds, least number of them that a copy shares) of an item with so many words."""
    lose = points_to_lose(words, least_score)
    for size in range(min(n, words), 1, -1):
        if words - size + 1 - (size - 1) * lose >= 1:
            return size, words - size + 1 - (size - 1) * lose
    return 1, max(1, words - lose // MATCH)


class Seeds:
    """n-gram -> (item, position) of some test items, with a bit filter in front."""

    def __init__(self, grams: np.ndarray, items: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.grams, self.items, self.at = grams[order], items[order], at[order]
        self.unique = np.unique(self.grams)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._cell(self.unique)] = True

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Positions in grams that hold a seed."""
        at = np.flatnonzero(self.filter[self._cell(grams)])
        if not len(at) or not len(self.unique):
            return at[:0]
        near = np.minimum(np.searchsorted(self.unique, grams[at]), len(self.unique) - 1)
        return at[self.unique[near] == grams[at]]


def _found(words: kernel.Words, seeds: Seeds, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds' n-grams in some documents: hashes, positions and documents."""
    grams = kernel.ngram_hashes(words.hashes, n)
    at = seeds.find(grams)
    document = np.searchsorted(words.bounds, at, side="right") - 1
    ok = at + n <= words.bounds[document + 1]
    return grams[at[ok]], at[ok], document[ok]


def _count_seeds(seeds_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = seeds_of()
        counts = {n: np.zeros(len(seeds.unique), np.int64) for n, seeds in by_size.items()}
        for batch in batches:
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                words = kernel.scan(data, offsets, letters_only=True)
                for n, seeds in by_size.items():
                    np.add.at(counts[n], np.searchsorted(seeds.unique, _found(words, seeds, n)[0]), 1)
        for n, seeds in by_size.items():
            hit = np.flatnonzero(counts[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), n, np.int32)), pa.array(seeds.unique[hit].view(np.int64)), pa.array(counts[n][hit])], names=["size", "gram", "n"])

    return run


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best score and the aligned part [begin, end) of text."""
    width = len(text)
    score, begin = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best = (0, 0, 0)
    steps = np.arange(width + 1) * -GAP
    for word in item:
        step = np.where(text == word, MATCH, MISMATCH)
        diagonal, down = score[:-1] + step, score[1:] + GAP
        fresh = np.zeros(width + 1, np.int64)
        source = np.arange(width + 1)
        take = diagonal >= down
        value = np.where(take, diagonal, down)
        value_begin = np.where(take, begin[:-1], begin[1:])
        positive = value > 0
        fresh[1:] = np.where(positive, value, 0)
        source[1:] = np.where(positive, value_begin, source[1:])
        lifted = fresh + steps  # gaps along the text: a running maximum
        run = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == run, np.arange(width + 1), 0))
        fresh, source = run - steps, source[came]
        top = int(np.argmax(fresh))
        if fresh[top] > best[0]:
            best = (int(fresh[top]), int(source[top]), top)
        score, begin = fresh, source
    return best


def _search(seeds_of, least_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size, items = seeds_of()
        names = ["doc_id", "digest", "item", "score", "first_word", "last_word", "n_seeds"]
        for batch in batches:
            for lo, hi, data, offsets in kernel.chunks(batch.column(2)):
                words = kernel.scan(data, offsets, letters_only=True)
                hits: dict[tuple[int, int], set[int]] = defaultdict(set)
                for n, seeds in by_size.items():
                    for gram, a, k in zip(*(x.tolist() for x in _found(words, seeds, n)), strict=True):
                        x, y = np.searchsorted(seeds.grams, np.uint64(gram), "left"), np.searchsorted(seeds.grams, np.uint64(gram), "right")
                        for item, place in zip(seeds.items[x:y].tolist(), seeds.at[x:y].tolist(), strict=True):
                            hits[k, item].add(a - place)  # where the item would begin
                rows = []
                for (k, item), begins in hits.items():
                    own = items[item]
                    slack = max(len(own) // 2, points_to_lose(len(own), least_score)) + 2  # words put in may stand before a seed
                    first, end = int(words.bounds[k]), int(words.bounds[k + 1])
                    best, covered = (0, 0, 0), -1
                    ordered = sorted(begins)
                    for j, b in enumerate(ordered):
                        if b - slack >= covered or j == 0:  # one stretch for seeds that lie close
                            reach = b
                            for c in ordered[j + 1 :]:
                                if c - reach > 2 * slack + len(own):
                                    break
                                reach = c
                            left, covered = max(first, b - slack), min(end, reach + len(own) + slack)
                            stretch = words.hashes[left:covered]
                            if MATCH * np.count_nonzero(np.isin(own, stretch)) < least_score * MATCH * len(own) - 1e-9:
                                continue  # the score is no higher
                            score, s, e = align(own, stretch)
                            if score > best[0]:
                                best = (score, left + s - first, left + e - first)
                    relative = best[0] / (MATCH * len(own))
                    if relative >= least_score:
                        rows.append((lo + k, item, relative, best[1], best[2] - 1, len(begins)))
                if rows:
                    k, item, score, a, b, m = zip(*rows, strict=True)
                    index = pa.array(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int64())], names=names)

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_score: float = 0.6, n: int = SEED_WORDS) -> DataFrame:
    """doc_id, digest, item_id, score, first_word, last_word, n_seeds: documents that hold a copy of a test item.

    score is the local alignment's, divided by the item's own (1 for an exact copy); pairs from least_score up are given,
    one row a document and item, at the best alignment.  Words are compared without case (A-Z) and ASCII punctuation.
    Seeds have n words at most, fewer where the bound asks for it.  Items of one word, null and empty items match nothing, as do null and empty texts.  Rows with equal id and text, and equal items, give repeated rows.
    Items are taken in batches of about ITEM_GRAMS n-grams, each broadcast, so any number of them can be searched; each batch
    reads the documents twice.  Texts of any length count whole; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    source = documents.select(documents[doc_id].alias("doc_id"), F.xxhash64(documents[text]).alias("digest"), documents[text].alias("text"))
    items = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[item_text].alias("item"))
    out = spark.createDataFrame([], f"doc_id {source.schema['doc_id'].dataType.simpleString()}, digest long, item_id {items.schema['item_id'].dataType.simpleString()}, score double, first_word long, last_word long, n_seeds long")
    for batch in _item_batches(items.where("item is not null").toLocalIterator()):
        out = out.union(_search_batch(spark, source, items, batch, least_score, n))
    return out


def _item_batches(rows: Iterator) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Ids and word hashes of items of two words or more, about ITEM_GRAMS words at once."""
    held: list[tuple[object, np.ndarray]] = []
    size = 0
    while part := [r for _, r in zip(range(1024), rows, strict=False)]:
        for r, own in zip(part, _word_hashes([r["item"] for r in part]), strict=True):
            if len(own) >= 2:
                held.append((r["item_id"], own))
                size += len(own)
        if size >= ITEM_GRAMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search_batch(spark, source: DataFrame, items: DataFrame, batch: list[tuple[object, np.ndarray]], least_score: float, n: int) -> DataFrame:
    number: dict[bytes, int] = {}  # equal items are searched once
    named = [(number.setdefault(own.tobytes(), len(number)), i) for i, own in batch]
    hashes = [np.frombuffer(x, np.uint64) for x in number]
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)  # by n-gram length
    for k, own in enumerate(hashes):
        size = seed_bound(len(own), least_score, n)[0]
        grams = kernel.ngram_hashes(own, size)
        parts[size].append((grams, np.full(len(grams), k), np.arange(len(grams))))
    every = {size: Seeds(*(np.concatenate(x) for x in zip(*own, strict=True))) for size, own in sorted(parts.items())}
    shared = spark.sparkContext.broadcast(every)
    counted = source.select("text").mapInArrow(_count_seeds(lambda: shared.value), "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counted.toLocalIterator():  # one row an n-gram of the batch at most
        counts[r["size"]][r["gram"]] = r["n"]
    shared.destroy()
    chosen = {}
    for size, own in sorted(parts.items()):
        kept = []
        for grams, item, at in own:
            seen = np.array([counts[size].get(int(g), 0) for g in grams.view(np.int64)])
            least = seed_bound(len(hashes[item[0]]), least_score, n)[1]
            rare = np.lexsort((at, seen))[: len(grams) - least + 1]
            kept.append((grams[rare], item[rare], at[rare]))
        chosen[size] = Seeds(*(np.concatenate(x) for x in zip(*kept, strict=True)))
    seeds = spark.sparkContext.broadcast((chosen, hashes))
    found = source.mapInArrow(_search(lambda: seeds.value, least_score), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, digest long, item long, score double, first_word long, last_word long, n_seeds long")
    names = spark.createDataFrame(named, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")  # ITEM_GRAMS rows at most
    return found.join(F.broadcast(names), "item").select("doc_id", "digest", "item_id", "score", "first_word", "last_word", "n_seeds")
