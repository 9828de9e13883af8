"""Language-model scoring by a hierarchical Pitman-Yor model.

A word comes from the restaurant of the word before it (at a text's beginning the end), whose base measure, shared by all of
them, is a Pitman-Yor restaurant of words; every table of a preceding word's restaurant is a customer of it.  Its base
measure in turn spells words: byte classes follow one another in context restaurants of up to three preceding ones, each
sharing its parent (the context one shorter) with its siblings, down to a uniform base; bytes are drawn within their class.
The end of a text is the empty word.  Tokens are the words seen in training, the end, and one for all words not seen, which
has what the base measure leaves to them.

Seating is sampled by Gibbs: a customer picked at random leaves its table and is seated anew, at a table of its dish in
proportion to that table's customers less the discount, or at a new one.  Tables are kept from sweep to sweep.  A
restaurant's dishes depend on each other only by its number of tables T; given a number g from a gamma distribution of shape
strength / discount + T they are independent, a new table of a dish weighing discount * g * parent's probability, so dishes
of one restaurant can be seated in different places.  A sweep gives each dish as many such moves as it has customers, takes
the parents' probabilities as the last sweep left them, and all its random numbers follow from word hashes, not from where
it runs.
Predictive probabilities are averaged over the sweeps after burn-in.

Words and pairs are counted, kept and joined with the texts as `pairs` has it; sweeps over words move nothing but counts of
the spelling.  Each of the ROUNDS seats the words, then the pairs, whose tables are the words' customers in the next.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, symbols
from . import pairs as P
from .common import discard, forget_shuffles, written

SWEEPS, BURN_IN = 3, 1
ROUNDS = 2  # of seating words, then pairs
DRAWS = 3  # of a pair's tables, averaged, in the last round
CELLS = 1 << 16  # sizes of tables that move side by side, about
FEW = 16  # dishes that move one after another rather than side by side, at most
RENEWED = 32  # turns after which a dish's largest table is looked up anew
STRENGTH = 1.0


# --- seating ------------------------------------------------------------------------------------------------------------


class Seating:
    """Customers of each table, dish by dish: dish k has the tables from bounds[k] to bounds[k + 1]."""

    def __init__(self, sizes: np.ndarray, bounds: np.ndarray) -> None:
        self.sizes, self.bounds = sizes, bounds

    @classmethod
    def fresh(cls, customers: np.ndarray) -> Seating:
        """One table a dish; every dish has a customer."""
        return cls(customers.astype(np.int64), np.arange(len(customers) + 1))

    @property
    def tables(self) -> np.ndarray:
        return np.diff(self.bounds)

    def customers(self) -> np.ndarray:
        return np.add.reduceat(self.sizes, self.bounds[:-1]) if len(self.bounds) > 1 else np.zeros(0, np.int64)

    def fitted(self, customers: np.ndarray) -> Seating:
        """For other numbers of customers: the last ones leave, new ones join their dish's first table."""
        tables = self.tables
        before = np.cumsum(self.sizes) - self.sizes
        before -= np.repeat(before[self.bounds[:-1]], tables)
        sizes = np.clip(np.repeat(customers, tables) - before, 0, self.sizes)
        sizes[self.bounds[:-1]] += np.maximum(customers - self.customers(), 0)
        kept = sizes > 0
        left = np.bincount(np.repeat(np.arange(len(tables)), tables)[kept], minlength=len(tables))
        return Seating(sizes[kept], np.append(0, np.cumsum(left)))

    def carried(self, keys: np.ndarray, new_keys: np.ndarray, customers: np.ndarray) -> Seating:
        """For another set of dishes: those known keep their tables as far as customers allow.  Keys are sorted."""
        at = np.minimum(np.searchsorted(keys, new_keys), len(keys) - 1)
        known = keys[at] == new_keys
        tables = np.where(known, self.tables[at], 1)
        bounds = np.append(0, np.cumsum(tables))
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.bounds[at], tables)
        old = np.repeat(known, tables)
        sizes = np.ones(bounds[-1], np.int64)
        sizes[old] = self.sizes[place[old]]
        return Seating(sizes, bounds).fitted(customers)

    def sweep(self, new: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> Seating:
        """As many moves of each dish as it has customers, given the weight of a new table; keys give its random numbers."""
        customers, tables = self.customers(), self.tables
        live = np.flatnonzero(customers > 1)
        at = np.repeat(self.bounds[live] - np.cumsum(tables[live]) + tables[live], tables[live]) + np.arange(tables[live].sum())
        owner, sizes = np.repeat(live, tables[live]), self.sizes[at]
        order = np.lexsort((-sizes, owner))
        owner, sizes = owner[order], sizes[order]
        main = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
        main_sizes, owner, sizes = sizes[main], owner[~main], sizes[~main]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (sizes[1:] != sizes[:-1]))[: len(owner)])
        counts, owner, sizes = np.diff(np.append(first, len(owner))), owner[first], sizes[first]
        kinds = np.bincount(np.searchsorted(live, owner), minlength=len(live))  # distinct sizes beside the main table's
        starts = np.cumsum(kinds) - kinds
        scale = np.frexp(customers[live])[1] // 3  # a factor of eight
        order = np.lexsort((kinds, scale))
        scale = scale[order]
        made, every, a = [], tables.copy(), 0
        while a < len(live):  # dishes alike in customers and kinds move side by side
            b = int(np.searchsorted(scale, scale[a], side="right"))
            b = max(a + 1, a + int(np.searchsorted((kinds[order[a:b]] + 2) * np.arange(1, b - a + 1), CELLS, side="right")))
            own, a = order[a:b], b
            width = kinds[own[-1]] + 2
            held = np.arange(width) < kinds[own, None]
            place = (starts[own, None] + np.arange(width))[held]
            size, count = np.zeros(held.shape, np.int64), np.zeros(held.shape, np.int64)
            size[held], count[held] = sizes[place], counts[place]
            own_main, size, count = _reseated(main_sizes[own], size, count, customers[live[own]], new[live[own]], keys[live[own]], discount, salt)
            count, size = np.column_stack([own_main > 0, count]), np.column_stack([own_main, size])
            every[live[own]] = count.sum(axis=1)
            made.append((live[own], np.repeat(size.ravel(), count.ravel())))
        bounds = np.append(0, np.cumsum(every))
        out = np.ones(bounds[-1], np.int64)  # the dishes not moved have a single customer
        for own, sizes in made:
            out[np.arange(len(sizes)) + np.repeat(bounds[own] - np.cumsum(every[own]) + every[own], every[own])] = sizes
        return Seating(out, bounds)

    def packed(self) -> bytes:
        return P.pack(self.tables, self.sizes)

    @classmethod
    def unpacked(cls, packed: bytes) -> Seating:
        tables, sizes = P.unpack(packed)
        return cls(sizes.astype(np.int64), np.append(0, np.cumsum(tables)))


def _add(size: np.ndarray, count: np.ndarray, rows: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of a new size in each of the rows; columns are added where one is full."""
    if not len(rows):
        return size, count
    own = count[rows]
    same = (size[rows] == new[:, None]) & (own > 0)
    free = own == 0
    column = np.where(same.any(axis=1), same.argmax(axis=1), free.argmax(axis=1))
    if not (same | free)[np.arange(len(rows)), column].all():
        more = ((0, 0), (0, 2 + size.shape[1] // 4))
        return _add(np.pad(size, more), np.pad(count, more), rows, new)
    size[rows, column] = new
    count[rows, column] += 1
    return size, count


def _reseated(main: np.ndarray, size: np.ndarray, count: np.ndarray, n: np.ndarray, new: np.ndarray, key: np.ndarray, discount: float, salt: int) -> tuple[np.ndarray, ...]:
    """main, size and count after n moves of each row, n its customers: a main table, and how many others have which size.

    A move takes one of the n customers at random out and seats it by the others.  Most of a large dish's moves go from its
    main table back to it: how many such ones come before the next other move is drawn at once, so that all moves are made,
    but only those that may change something one by one.
    """
    done_main, done_size, done_count = main.copy(), np.zeros_like(size), np.zeros_like(count)
    at, left, others, turn = np.arange(len(n)), n.copy(), count.sum(axis=1), 0
    n, key = n.astype(float), P.stirred(key)
    while True:
        done = left <= 0
        if done.sum() * 4 >= len(done):
            if size.shape[1] > done_size.shape[1]:
                done_size, done_count = (np.pad(x, ((0, 0), (0, size.shape[1] - x.shape[1]))) for x in (done_size, done_count))
            done_main[at[done]] = main[done]
            done_size[at[done], : size.shape[1]], done_count[at[done], : size.shape[1]] = size[done], count[done]
            main, size, count, n, new, key, at, left, others = (x[~done] for x in (main, size, count, n, new, key, at, left, others))
            if len(at) <= FEW:
                for k in range(len(at)):
                    made = _finished(int(main[k]), size[k].tolist(), count[k].tolist(), float(n[k]), float(new[k]), key[k : k + 1], discount, salt, int(left[k]), int(others[k]), turn)
                    if len(made[1]) > done_size.shape[1]:
                        done_size, done_count = (np.pad(x, ((0, 0), (0, len(made[1]) - x.shape[1]))) for x in (done_size, done_count))
                    done_main[at[k]], done_size[at[k], : len(made[1])], done_count[at[k], : len(made[1])] = made
                return done_main, done_size, done_count
        if turn % RENEWED == RENEWED - 1:  # the largest table becomes the main one
            largest = np.where(count > 0, size, 0)
            column = largest.argmax(axis=1)
            rows = np.flatnonzero(largest.max(axis=1) > main)
            count[rows, column[rows]] -= 1
            old, main[rows] = main[rows], size[rows, column[rows]]
            others[rows[old == 0]] -= 1
            size, count = _add(size, count, rows[old > 0], old[old > 0])
        rest = n - main
        back = np.where(main > 1, main - 1 - discount, 0.0)
        away = rest - discount * others + new
        main_leaves = main / n * (away / (away + back))
        change = np.minimum(main_leaves + rest / n, 1.0)
        first, second, third = P.uniforms(key, salt, range(turn, turn + 1), 3)[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            idle = np.log1p(-first) / np.log1p(-change)
        idle = np.where(change > 0, np.minimum(np.floor(idle), left), left)
        left = left - idle.astype(np.int64) - 1
        go = left >= 0  # else the moves end before the next change
        v = second * change
        from_main = (v < main_leaves) | (rest == 0)
        main = main - (go & from_main)
        rows = np.flatnonzero(go & ~from_main)
        if len(rows):
            pick = np.minimum(np.floor((v[rows] - main_leaves[rows]) * n[rows]), rest[rows] - 1)
            column = (np.cumsum(size[rows] * count[rows], axis=1) <= pick[:, None]).sum(axis=1)
            fewer = size[rows, column] - 1
            count[rows, column] -= 1
            others[rows] -= fewer == 0
            size, count = _add(size, count, rows[fewer > 0], fewer[fewer > 0])
        mass = np.cumsum((size - discount) * count, axis=1)
        held = mass[:, -1] + np.where(from_main | (main == 0), 0.0, main - discount)
        v = third * (held + new)
        small = v < mass[:, -1]
        opens = ~small & (v >= held)
        main = main + (go & ~small & ~opens)
        rows = np.flatnonzero(go & (small | opens))
        if len(rows):
            joins = small[rows]
            column = np.where(joins, (mass[rows] <= v[rows, None]).sum(axis=1), 0)
            count[rows, column] -= joins
            others[rows] += ~joins
            size, count = _add(size, count, rows, np.where(joins, size[rows, column], 0) + 1)
        turn += 1


def _finished(main: int, size: list[int], count: list[int], n: float, new: float, key: np.ndarray, discount: float, salt: int, left: int, others: int, turn: int) -> tuple:
    """What _reseated does from a turn on, for a single row, with the same result: quicker where few rows are left."""
    slot = {s: k for k, (s, c) in enumerate(zip(size, count, strict=True)) if c}
    drawn, begun = [], turn

    def add(own: int) -> None:
        if own in slot:
            count[slot[own]] += 1
            return
        if 0 not in count:
            size.append(0)
            count.append(0)
        k = count.index(0)
        size[k], count[k], slot[own] = own, 1, k

    def take(k: int) -> None:
        count[k] -= 1
        if not count[k]:
            del slot[size[k]]

    while left > 0:
        if turn - begun == len(drawn):
            begun, drawn = turn, P.uniforms(key, salt, range(turn, turn + 256), 3)[..., 0].tolist()
        if turn % RENEWED == RENEWED - 1 and slot and max(slot) > main:
            old, main = main, max(slot)
            take(slot[main])
            if old:
                add(old)
            else:
                others -= 1
        rest = n - main
        back = main - 1 - discount if main > 1 else 0.0
        away = rest - discount * others + new
        main_leaves = main / n * (away / (away + back))
        change = min(main_leaves + rest / n, 1.0)
        first, second, third = drawn[turn - begun]
        idle = left if change <= 0 else 0 if change == 1 else min(math.floor(math.log1p(-first) / math.log1p(-change)), left)
        left -= idle + 1
        if left < 0:
            break
        v = second * change
        from_main = v < main_leaves or rest == 0
        if from_main:
            main -= 1
        else:
            pick = min(math.floor((v - main_leaves) * n), rest - 1)
            k = bisect_right(list(itertools.accumulate(s * c for s, c in zip(size, count, strict=True))), pick)
            fewer = size[k] - 1
            take(k)
            if fewer:
                add(fewer)
            else:
                others -= 1
        mass = list(itertools.accumulate((s - discount) * c for s, c in zip(size, count, strict=True)))
        held = mass[-1] + (0.0 if from_main or not main else main - discount)
        v = third * (held + new)
        if v < mass[-1]:
            k = bisect_right(mass, v)
            more = size[k] + 1
            take(k)
            add(more)
        elif v < held:
            main += 1
        else:
            others += 1
            add(1)
        turn += 1
    return main, size, count


def gammas(shape: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """Gamma draws of shapes above 0, by Marsaglia and Tsang; random numbers follow from the keys."""
    out = np.zeros(len(shape))
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    left, turn = np.arange(len(shape)), 0
    while len(left):
        a, b, u = (P.uniform(keys[left], salt, turn, k) for k in (11, 12, 13))
        normal = np.sqrt(-2 * np.log(1 - a)) * np.cos(2 * np.pi * b)
        v = (1 + normal / np.sqrt(9 * d[left])) ** 3
        good = v > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            good &= np.log(np.maximum(u, 1e-300)) < normal * normal / 2 + d[left] * (1 - v + np.log(np.where(v > 0, v, 1)))
        out[left[good]] = d[left[good]] * v[good]
        left, turn = left[~good], turn + 1
    if small.any():
        out[small] *= np.maximum(P.uniform(keys[small], salt, 14), 1e-300) ** (1 / shape[small])
    return out


def seat(customers: np.ndarray, parent: np.ndarray, strength: float, discount: float, keys: np.ndarray, sweeps: int = 1, salt: int = 0) -> np.ndarray:
    """Mean tables of one restaurant's dishes over so many sweeps, beginning with a table each."""
    has = np.flatnonzero(customers > 0)
    seating, total = Seating.fresh(customers[has]), np.zeros(len(customers))
    one = np.array([np.uint64(1)])
    for k in range(sweeps):
        g = gammas(np.array([strength / discount + seating.tables.sum()]), one, 2 * (salt + k))
        seating = seating.sweep(discount * g * parent[has], discount, keys[has], 2 * (salt + k) + 1)
        total[has] += seating.tables
    return total / sweeps


def discount_of(ones: int, twos: int) -> float:
    """n1 / (n1 + 2 n2), kept within 0.1 and 0.9."""
    return float(np.clip(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1, 0.9))


# --- spelling -----------------------------------------------------------------------------------------------------------


class Spelling:
    """Predictive probabilities of the byte-class contexts, and of bytes within their class."""

    def __init__(self) -> None:
        self.table = np.full(symbols.CELLS, 1 / (symbols.SIZE - 1), np.float32)
        self.lower: list[np.ndarray] = []  # by context length
        self.seated: dict[int, tuple[np.ndarray, Seating]] = {}  # by order: cells, their tables
        self.within = np.zeros(257)
        members = np.bincount(symbols.CLASS, minlength=symbols.SIZE)
        self.within[:256] = -np.log(members[symbols.CLASS])

    def resample(self, cells: np.ndarray, counts: np.ndarray, bytes_seen: np.ndarray, sweep: int) -> None:
        """Seats the customers (4-gram cells with counts), level by level, and renews the probabilities."""
        size = symbols.SIZE
        levels = []
        at, n = cells, counts.astype(np.int64)
        for k in range(symbols.ORDER, 0, -1):  # old probabilities of the parent decide; its customers are the tables
            width = size ** (k - 1)
            parent = self.lower[k - 1][at % width] if self.lower else np.full(len(at), 1 / (size - 1))
            d = discount_of(int((n == 1).sum()), int((n == 2).sum()))
            restaurant = at // size
            seating = self.seated[k][1].carried(self.seated[k][0], at, n) if k in self.seated else Seating.fresh(n)
            held = np.bincount(restaurant, seating.tables, minlength=width)
            g = gammas(STRENGTH / d + held, np.arange(width, dtype=np.uint64), 40 * sweep + k)
            seating = seating.sweep(d * g[restaurant] * parent, d, at, 40 * sweep + 10 + k)
            self.seated[k] = (at, seating)
            tables = seating.tables
            levels.append((k, at, n, tables, d))
            merged = np.bincount(at % width if k > 1 else np.zeros(0, int), tables if k > 1 else None, minlength=1)
            at = np.flatnonzero(merged)
            n = merged[at].astype(np.int64)
        lower = [np.full(1, 1 / (size - 1))]
        p = np.full(size, 1 / (size - 1))
        p[symbols.START] = 0
        for k, at, n, tables, d in reversed(levels):
            width = size ** (k - 1)
            restaurant = at // size
            total, held = (np.bincount(restaurant, x, minlength=width) for x in (n, tables))
            new = (np.tile(p, size) if k > 1 else p).reshape(width, size) * ((STRENGTH + d * held) / (STRENGTH + total))[:, None]
            flat = new.reshape(-1)
            flat[at] += (n - d * tables) / (STRENGTH + total[restaurant])
            p = flat
            lower.append(p)
        self.lower = lower[:-1]
        self.table = p.astype(np.float32)
        seen = bytes_seen + 0.5
        group = np.bincount(symbols.CLASS, seen, minlength=symbols.SIZE)
        self.within = np.append(np.log(seen / group[symbols.CLASS]), 0.0)


def spell_cells(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words lying one after another: 4-gram cells with an END after each, bytes (256 for END), and starts."""
    ends = np.cumsum(lengths)
    n = len(lengths)
    bytes_ = np.full(len(data) + n, 256, np.int32)
    bytes_[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = data
    starts = ends - lengths + np.arange(n)
    classes = np.append(symbols.CLASS, symbols.END)[bytes_]
    return symbols.contexts(classes, starts), bytes_, starts


def spelled(model: tuple[np.ndarray, np.ndarray], data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of each word under the spelling model."""
    if not len(lengths):
        return np.zeros(0)
    table, within = model
    cells, bytes_, starts = spell_cells(data, lengths)
    return np.exp(np.maximum(np.add.reduceat(np.log(table[cells], dtype=np.float64) + within[bytes_], starts), -600))


# --- sweeps -------------------------------------------------------------------------------------------------------------

_SEATED = f"{P.WORDS}, seating binary, drawn binary"
_SWEPT = f"{_SEATED}, block int, cells binary"
_MODEL = f"{_SEATED}, points binary, mass double"


def _customers(hot_of):
    def run(words: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        """words with the tables of their pairs as customers; tables from before are kept as far as that allows."""
        n = P.customers_of(words, notes, hot_of())
        old = words["seating"].iloc[0] if "seating" in words.columns else None
        seating = Seating.fresh(n) if old is None else Seating.unpacked(old).fitted(n)
        own = words[[c.split()[0] for c in P.WORDS.split(", ")]]
        return own.assign(seating=[seating.packed()], drawn=[P.pack(np.zeros(len(n)))])

    return run


def _sweep_words(shared, tables: float, discount: float, salt: int, draws: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                hashes, _, lengths, data = P.words_of(row)
                g = gammas(np.array([STRENGTH / discount + tables]), np.array([np.uint64(7)]), 2 * salt)
                seating = Seating.unpacked(row.seating).sweep(discount * g * spelled(model, data, lengths), discount, hashes, 2 * salt + 1)
                now = seating.tables
                drawn = P.unpack(row.drawn)[0] + (now if draws else 0)
                cells, bytes_, _ = spell_cells(data, lengths)
                weight = np.repeat(now, lengths + 1)
                at, n = symbols.sparse_counts(cells, weight)
                seen = np.bincount(bytes_, weight, minlength=257)[:256]
                out = [(row.shard, row.hashes, row.counts, row.lengths, row.data, seating.packed(), P.pack(drawn), -2, None)]
                none = (row.shard, None, None, None, None, None, None)
                out.append((*none, -1, P.pack(np.arange(257), np.append(seen, now.sum()))))
                out += [(*none, b, P.pack(at[own], n[own].astype(np.int64))) for b, own in P.slices(at >> 16)]
                yield P._rows(out, _SWEPT)

    return run


def _add_block(rows: pd.DataFrame) -> pd.DataFrame:
    at, n = (np.concatenate(x) for x in zip(*(P.unpack(x) for x in rows["cells"]), strict=True))
    where, inverse = np.unique(at, return_inverse=True)
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "part": rows["part"].iloc[:1].to_numpy(), "cells": [P.pack(where, np.bincount(inverse, n))]})


def _collected(swept: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The counts of a sweep, by block, added in two steps; their size is the spelling's, whatever the corpus."""
    schema = "block int, part long, cells binary"
    parts = swept.where("block > -2").select("block", F.pmod(F.xxhash64("cells"), F.lit(64)).alias("part"), "cells")
    parts = parts.groupBy("block", "part").applyInPandas(_add_block, schema).withColumn("part", F.lit(0).cast("long"))
    return {r["block"]: tuple(P.unpack(r["cells"])) for r in parts.groupBy("block", "part").applyInPandas(_add_block, schema).collect()}


def _sample_words(words: DataFrame, spelling: Spelling, turn: int, sweeps: int) -> tuple[DataFrame, float]:
    """Sweeps over the words' restaurant and the spelling: the words with points (log10 p), and log10 p of an unseen word."""
    spark = words.sparkSession

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [Seating.unpacked(x) for x in batch.column(0).to_pylist()]
            rows = [(int(n.sum()), int((n == 1).sum()), int((n == 2).sum()), int(s.tables.sum())) for s in every for n in (s.customers(),)]
            yield P._rows(rows, "customers long, ones long, twos long, tables long")

    total = words.select("seating").mapInArrow(stats, "customers long, ones long, twos long, tables long").agg(*(F.sum(c).alias(c) for c in ("customers", "ones", "twos", "tables"))).first()
    customers, discount, tables = int(total["customers"]), discount_of(int(total["ones"]), int(total["twos"])), float(total["tables"])
    mean_table, mean_within, mean_tables, draws = np.zeros(symbols.CELLS, np.float32), np.zeros(257), 0.0, sweeps - BURN_IN
    for sweep in range(sweeps):
        salt = 100 * turn + sweep
        shared = spark.sparkContext.broadcast((spelling.table, spelling.within))
        swept = written(words.mapInArrow(_sweep_words(shared, tables, discount, salt, sweep >= BURN_IN), _SWEPT), "swept")
        sums = _collected(swept)
        shared.destroy()  # its files are as large as the spelling's table, on each executor
        seen = sums.pop(-1)[1]
        tables = float(seen[256])
        at, n = (np.concatenate(x) for x in zip(*(sums[b] for b in sorted(sums)), strict=True))
        spelling.resample(at, n, seen[:256], salt)
        if sweep >= BURN_IN:
            mean_table += spelling.table / draws
            mean_within += spelling.within / draws
            mean_tables += tables / draws
        discard(words)
        words = swept.where("block = -2").drop("block", "cells")
        words._loom_path = swept._loom_path
    final = spark.sparkContext.broadcast((mean_table, mean_within))
    fresh = (STRENGTH + discount * mean_tables) / (STRENGTH + customers)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pandas().itertuples():
                _, _, lengths, data = P.words_of(row)
                p = spelled(final.value, data, lengths)
                own = (Seating.unpacked(row.seating).customers() - discount * P.unpack(row.drawn)[0] / draws) / (STRENGTH + customers)
                score = np.log10(np.maximum(own + fresh * p, 1e-300))
                out.append((row.shard, row.hashes, row.counts, row.lengths, row.data, row.seating, row.drawn, P.pack(score), float(p.sum())))
            yield P._rows(out, _MODEL)

    model = written(words.mapInArrow(points, _MODEL), "model")
    final.destroy()
    discard(words)
    mass = model.agg(F.sum("mass")).first()[0]
    return model, float(np.log10(fresh * max(1 - mass, 1e-6)))


def _live(n: np.ndarray) -> np.ndarray:
    """Pairs whose tables can differ: the others have one customer and one table."""
    return np.flatnonzero(n > 1)


def _seat_pairs(shards: int, shared, discount: float, turn: int, draws: int, last: bool, least: int):
    """Seats each shard's pairs; notes of the state and, unless it is the last round, of the words' customers.

    The state is the seating or, in the last round, what the mean tables take from each pair.
    """

    def run(pairs: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        hot, hot_points, hot_g = shared.value
        shard = int(pairs["shard"].iloc[0])
        cold, first, second, n = P.unpack(pairs["pairs"].iloc[0])
        width, live = len(hot) + len(cold), _live(n)
        parent = 10 ** P.second_points(cold, second, hot_points, list(more.loc[more["what"] == 3, ["a", "b"]].itertuples(index=False)))
        state = [x for x in more.loc[more["what"] == 2, "a"]]
        seating = Seating.unpacked(state[0]) if state else Seating.fresh(n[live])
        keys = P.pair_hash(P.hashes_of(first, hot, cold), P.hashes_of(second, hot, cold))[live]
        tables = np.ones(len(n))
        tables[live] = seating.tables
        held = np.bincount(first, tables, minlength=width)[len(hot) :]
        g = np.concatenate([hot_g, gammas(STRENGTH / discount + held, cold.astype(np.uint64), turn)])
        mean = np.zeros(len(n))
        for draw in range(draws):
            seating = seating.sweep(discount * g[first[live]] * parent[live], discount, keys, 1000 + 100 * turn + draw)
            tables[live] = seating.tables
            mean += tables / draws
        sums = np.bincount(first[first < len(hot)], mean[first < len(hot)], minlength=len(hot))
        at = np.flatnonzero(sums)
        out = P.restaurant_notes(at, sums[at])
        if last:
            out.append((shard, P.STATE, P.pack((discount * mean).astype(np.float32))))
            out.append((shard, P.FREQUENT, P.frequent(first, second, n, discount * mean, len(hot), least)))
        else:
            out += [(shard, P.STATE, seating.packed()), *P.customers_notes(hot, cold, second, mean, shards)]
        del seating, parent, mean, tables, held, g, keys
        kernel.give_back()
        return pd.DataFrame(out, columns=["shard", "kind", "note"])

    return run


# --- model --------------------------------------------------------------------------------------------------------------


def train(documents: DataFrame, trains: Column, text: str = "text") -> P.PairModel | None:
    """Counts all words and pairs of the documents where trains holds and samples seatings; None without such documents.

    Null texts count as empty ones, which are their end alone.
    """
    spark = documents.sparkSession
    texts = P.texts_of(documents.where(trains), text)
    if texts.isEmpty():
        return None
    shards, hot = P.shards_for(texts), P.hot_words(texts)
    shared = spark.sparkContext.broadcast(hot)
    words = P.count_words(texts, shards, True)
    stats = P.count_stats(words, "counts", 0)
    hot_counts = P.collect_hot(words, "counts", hot)
    pairs = P.count_pairs(texts, shards, lambda: shared.value, len(hot))
    counted, least = P.count_stats(pairs, "pairs", 3), P.frequent_bucket(pairs, len(hot))
    discount = discount_of(counted["n1"], counted["n2"])
    notes = written(pairs.mapInArrow(P.first_notes(shards, lambda: shared.value, np.ones_like), P.NOTES), "notes")
    asked, state, spelling = written(notes.where(f"kind = {P.ASKED}"), "asked"), None, Spelling()
    none = F.lit(None).cast("binary")
    for turn in range(ROUNDS):
        last = turn + 1 == ROUNDS
        held = P.collect_restaurants(notes, len(hot))
        seated = written(words.groupBy("shard").cogroup(notes.where(f"kind = {P.CUSTOMERS}").groupBy("shard")).applyInPandas(_customers(lambda: shared.value), _SEATED), "customers")
        discard(words)
        words, unseen = _sample_words(seated, spelling, turn, SWEEPS if last else BURN_IN + 1)
        hot_points = P.collect_hot(words, "points", hot, "<f8")
        own = spark.sparkContext.broadcast((hot, hot_points, gammas(STRENGTH / discount + held, hot, turn)))
        more = P.points_for_pairs(words, asked).select("shard", F.lit(3).alias("what"), F.col("hashes").alias("a"), F.col("points").alias("b"))
        if turn:
            more = more.union(notes.where(f"kind = {P.STATE}").select("shard", F.lit(2).alias("what"), F.col("note").alias("a"), none.alias("b")))
        made = pairs.groupBy("shard").cogroup(more.groupBy("shard")).applyInPandas(_seat_pairs(shards, own, discount, turn, DRAWS if last else 1, last, least), P.NOTES)
        old, notes = notes, written(made, "notes")
        own.destroy()
        discard(old)
        forget_shuffles(spark)
    held = P.collect_restaurants(notes, len(hot))
    left = np.where(hot_counts > 0, np.log10((STRENGTH + discount * held) / (STRENGTH + hot_counts)), 0.0)
    made = P.PairModel(words, pairs, notes.where(f"kind = {P.STATE}").union(asked), None, STRENGTH, shards, stats["total"], stats["rows"], unseen, hot, hot_counts, hot_points, left, None, None)
    return made.with_frequent(notes)


def score(documents: DataFrame, model: P.PairModel | None, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability) a row.

    Words are runs of non-white-space after lower-casing A-Z, then one end.  Null and empty texts are the end alone.  Texts
    of any length count whole.  Rows keep to themselves: repeated ones get equal scores.  Columns of other names are left
    out, so none can clash.  Without a model every word is unseen: both scores are 0.  An empty table gives an empty one.
    """
    own = documents.select(documents[doc_id].cast("long").alias("doc_id"), held_out.alias("held_out"), documents[text].alias("text"))
    if model is None:
        words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
        zero = F.lit(0).cast("long")
        return own.select("doc_id", "held_out", words.alias("n_tokens"), zero.alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), zero.alias("train_tokens"))
    return P.score(own, model, "text").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
