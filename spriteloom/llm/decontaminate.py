"""Benchmark decontamination by greedy string tiling (operator 1).

Texts become lower-case word tokens (``\\w+``).  A document and a benchmark item
that share a seed (``seed`` tokens in a row) are a candidate pair; on each pair
the longest non-overlapping common runs are marked again and again (running
Karp-Rabin, longest first) down to ``seed`` tokens, and the share of the item's
tokens that end up marked is its coverage.  Because tiles may lie anywhere in the
document, an item is found when its sentences are reordered or split up.

Scale.  The benchmark is cut into slices of at most ``slice_tokens`` tokens; each
slice with the sorted table of its seeds is broadcast, so what is broadcast is
bounded by that parameter whatever the benchmark's size, and a larger benchmark
costs more passes.  The seed join is a sort-merge join in numpy where a document
is read: nothing is shuffled, no key is hot, and a lost executor costs its own
tasks.  Only the places under an item's seeds enter its tiling, so a phrase that
a third of all documents share costs each of them a few dozen tokens.

Edge cases: null and empty texts share nothing; an item of fewer tokens than a seed
cannot be told from chance and is never found; repeated documents are each
reported; a null doc_id is reported as null; null item_ids are items too; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, unused, with_rows, without

SEED = 5
COVERAGE = 0.6
SLICE_TOKENS = 2_000_000
BASE = 0x9E3779B97F4A7C15
TOKEN = re.compile(r"\w+")
#: What marked tokens are overwritten with (-1 is a token that no item has).
_DOC, _ITEM = -2, -3


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of every window of ``size`` token numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, x = np.zeros(n, np.uint64), ids.astype(np.uint64) + np.uint64(1)
    for k in range(size):
        h = h * np.uint64(BASE) + x[k : k + n]
    return h


def run_lengths(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far doc[i:] and item[j:] go together, for every pair of places (i, j)."""
    n, alive = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(alive):
        u, v = i[alive] + n[alive], j[alive] + n[alive]
        inside = (u < len(doc)) & (v < len(item))
        alive, u, v = alive[inside], u[inside], v[inside]
        alive = alive[doc[u] == item[v]]
        n[alive] += 1
    return n


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length) of non-overlapping matches of at least ``least`` tokens, longest first."""
    # marked tokens get numbers of their own, which match nothing
    doc_left, item_left = doc.copy(), item.copy()
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while size >= least:
        theirs, mine = window_hashes(item_left, size), window_hashes(doc_left, size)
        order = np.argsort(theirs, kind="stable")
        lo, hi = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
        n = hi - lo
        i = np.repeat(np.arange(len(mine)), n)
        j = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        length = run_lengths(doc_left, item_left, i, j)
        whole = length >= size
        i, j, length = i[whole], j[whole], length[whole]
        cut = False
        for k in np.lexsort((j, i, -length)).tolist():
            a, b, m = int(i[k]), int(j[k]), int(length[k])
            # the marks of this pass: ends suffice, as no tile is longer than those marked before it
            if doc_left[a] == _DOC or doc_left[a + m - 1] == _DOC or item_left[b] == _ITEM or item_left[b + m - 1] == _ITEM:
                cut = True
                continue
            doc_left[a : a + m], item_left[b : b + m] = _DOC, _ITEM
            tiles.append((a, b, m))
        # a match that a longer one has cut short may still hold a shorter tile: the same size again, then smaller
        if not (cut and _left(doc_left, item_left, size)):
            size = size - 1 if size <= 2 * least else max(least, size // 2)
    return tiles


def _left(doc: np.ndarray, item: np.ndarray, size: int) -> bool:
    """Whether unmarked windows of this size are still shared."""
    mine, theirs = window_hashes(doc, size), window_hashes(item, size)
    free = np.lib.stride_tricks.sliding_window_view(item, size).min(1) >= 0 if len(theirs) else np.empty(0, bool)
    return bool(np.isin(mine, theirs[free]).any())


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items with their tokens, in slices of at most ``limit`` tokens (or one item)."""
    got, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = tokens(row["text"])
        if not words:
            continue
        if got and n + len(words) > limit:
            yield got
            got, n = [], 0
        got.append((row["item_id"], words))
        n += len(words)
    if got:
        yield got


class Slice:
    """Items of one slice with their vocabulary and the sorted table of their seeds."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int):
        self.ids = [item_id for item_id, _ in items]
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64) for _, words in items]
        parts = [np.unique(window_hashes(item, seed)) for item in self.items]
        hashes = np.concatenate([*parts, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(parts)), [len(h) for h in parts])
        order = np.argsort(hashes, kind="stable")
        self.lengths = np.array([len(item) for item in self.items], np.int64)
        self.seed, self.hashes, self.owner = seed, hashes[order], owner[order]

    def leaks(self, words: list[str], coverage: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item number, coverage, tiles) of the items that a tokenised text holds."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        size = self.seed
        if len(ids) < size:
            return
        known = ids >= 0
        whole = known[: len(ids) - size + 1].copy()
        for d in range(1, size):
            whole &= known[d : d + len(whole)]
        at = np.flatnonzero(whole)
        h = np.zeros(len(at), np.uint64)
        for d in range(size):
            h = h * np.uint64(BASE) + (ids[at + d].astype(np.uint64) + np.uint64(1))
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            return
        # the seed join: each place in the text with each item that owns its seed
        place = np.repeat(at, n)
        item = self.owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        # a tile lies on seeds, so an item with too few of them is out before it is tiled
        many = np.bincount(item, minlength=len(self.items)) * size >= coverage * self.lengths
        place, item = place[many[item]], item[many[item]]
        if not len(item):
            return
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            wanted = self.items[item[part[0]]]
            # every tile is made of this item's seeds, so only the places under them matter
            under = np.unique((place[part][:, None] + np.arange(size)).ravel())
            if len(under) < coverage * len(wanted):
                continue
            gaps = np.flatnonzero(np.diff(under) > 1) + 1
            doc, real = np.insert(ids[under], gaps, -1), np.insert(under, gaps, -1)
            tiles = [(int(real[i]), j, n) for i, j, n in tile(doc, wanted, size)]
            covered = sum(n for _, _, n in tiles) / len(wanted)
            if covered >= coverage:
                yield int(item[part[0]]), covered, sorted(tiles)


def find_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile, tiles) of the pairs whose coverage reaches the threshold.

    ``tiles`` lists document token : item token : length.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long, tiles string"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], schema)
    for items in _slices(benchmark, slice_tokens):
        shared = spark.sparkContext.broadcast(Slice(items, seed))

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            piece = shared.value
            for batch in batches:
                rows = []
                for k, text in enumerate(batch.column(1)):
                    for n, covered, tiles in piece.leaks(tokens(text.as_py()), coverage):
                        rows.append((batch.column(0)[k].as_py(), piece.ids[n], covered, len(tiles), max(n for _, _, n in tiles), ",".join(f"{i}:{j}:{n}" for i, j, n in tiles)))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        found = found.union(texts.mapInArrow(kernel, schema))
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; rows are judged one by one, whatever their doc_ids."""
    row = f"{unused(docs)}_row"
    with scratch(docs.sparkSession, "rows", "keys"):
        rows = with_rows(docs, row)
        leaks = find_leaks(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, seed, coverage).select("doc_id")
        return without(rows, leaks, {"doc_id": F.col(row)}).drop(row)
