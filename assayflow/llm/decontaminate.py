"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (``seed`` consecutive
words) are tiled: running Karp-Rabin hashes find common runs of unmarked
words, the longest are marked first, and the search length falls until no
common run of ``seed`` words is left.  Tiles never overlap and may come in
any order, so a passage whose sentences were rearranged is still covered.
An item leaks into a document if tiles cover at least ``coverage`` of it.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from assayflow.llm.common import MULTIPLIER, PLAIN_WORDS, WordHashes, encoded, map_columns, small_batches, windows, word_hashes

SEED_WORDS = 5
COVERAGE = 0.6
#: Search length of the first round of tiling.
FIRST_LENGTH = 20
#: Words of benchmark text held by a task at a time; a larger benchmark is taken in blocks of this size.
BLOCK_WORDS = 2_000_000


def _runs(hashes: np.ndarray, prefix: np.ndarray, powers: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``s`` unmarked words, and their Karp-Rabin hashes (from running prefix hashes)."""
    n = len(hashes) - s + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    starts = np.flatnonzero(taken[s:] == taken[:n])
    return starts, prefix[starts + s] - prefix[starts] * powers[s]


def _prefix(hashes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Running hashes: p[i + s] - p[i] * B^s is the hash of words i .. i+s-1 (all modulo 2^64)."""
    # p[i] = sum_j<i h[j] * B^(i-1-j), computed as B^i * cumsum(h[j] * B^-(j+1)); B is odd, so it has an inverse
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    n = len(hashes)
    inv = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)
    out = np.zeros(n + 1, np.uint64)
    out[1:] = np.cumsum(hashes * inv, dtype=np.uint64) * powers[1 : n + 1]
    return out


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, MULTIPLIER, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED_WORDS, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word-hash sequences: (start in item, start in doc, length), longest first, ties by position."""
    powers = _powers(max(len(item), len(doc)))
    pi, pd_ = _prefix(item, powers), _prefix(doc, powers)
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    s = max(least, min(first, len(item), len(doc)))
    while True:
        si, hi = _runs(item, pi, powers, free_i, s)
        sd, hd = _runs(doc, pd_, powers, free_d, s)
        hit = np.isin(hd, hi)
        sd, hd = sd[hit], hd[hit]
        at: dict[int, list[int]] = defaultdict(list)
        for i, h in zip(si.tolist(), hi.tolist()):
            at[h].append(i)
        matches: list[tuple[int, int, int]] = []
        seen: set[tuple[int, int]] = set()
        for d, h in zip(sd.tolist(), hd.tolist()):
            for i in at[h]:
                if (i - 1, d - 1) in seen:  # inside a match that began earlier
                    seen.add((i, d))
                    continue
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n >= s:
                    seen.add((i, d))
                    matches.append((n, i, d))
        longest = max((m[0] for m in matches), default=0)
        if longest > 2 * s:  # begin anew with the longer length, so that no short match breaks it
            s = longest
            continue
        short = False
        for n, i, d in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_i[i : i + n].all() and free_d[d : d + n].all():
                free_i[i : i + n] = False
                free_d[d : d + n] = False
                found.append((i, d, n))
            else:
                short = True  # a part of it may still be free
        if short and longest > s:
            continue
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        elif not short or not matches:
            return found
        elif not _left(item, doc, pi, pd_, powers, free_i, free_d, s):
            return found


def _left(item, doc, pi, pd_, powers, free_i, free_d, s) -> bool:
    return bool(np.isin(_runs(doc, pd_, powers, free_d, s)[1], _runs(item, pi, powers, free_i, s)[1]).any())


class Items:
    """A block of benchmark items with their seeds, as arrays that a task searches."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int):
        memo = WordHashes()
        self.ids = [r[0] for r in rows]
        self.words = [word_hashes(encoded(r[1]).translate(PLAIN_WORDS).split(), memo) for r in rows]
        self.seed = seed
        pairs = [(h, k) for k, w in enumerate(self.words) for h in set(windows(w, min(seed, max(1, len(w)))).tolist())]
        pairs.sort()
        self.hashes = np.array([p[0] for p in pairs], np.uint64)
        self.owner = np.array([p[1] for p in pairs], np.int64)
        self.widths = sorted({min(seed, len(w)) for w in self.words if len(w)})

    def candidates(self, doc: np.ndarray) -> list[int]:
        """Items that share a seed with the document; an item shorter than a seed is one seed as a whole."""
        out: set[int] = set()
        for width in self.widths:
            h = np.unique(windows(doc, width))
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                out.update(k for k in self.owner[a:b].tolist() if min(self.seed, len(self.words[k])) == width)
        return sorted(out)

    def leaks(self, doc: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
        """(item id, item words, covered words, tiles) of each item that leaks into the document."""
        out = []
        for k in self.candidates(doc):
            item = self.words[k]
            got = tiles(item, doc, min(self.seed, len(item)))
            covered = sum(t[2] for t in got)
            if covered >= coverage * len(item):
                out.append((self.ids[k], len(item), covered, len(got)))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, seed: int):
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words (one item may be larger)."""
    rows, words = [], 0
    # streamed to the driver block by block; only one block is held at a time
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        n = len(encoded(r[1]).translate(PLAIN_WORDS).split())
        if rows and words + n > BLOCK_WORDS:
            yield Items(rows, seed)
            rows, words = [], 0
        rows.append((r[0], r[1]))
        words += n
    if rows:
        yield Items(rows, seed)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = SEED_WORDS, coverage: float = COVERAGE,
) -> DataFrame:
    """One row per (document, item) where the item leaks: doc_id, item_id, item_words, covered_words, n_tiles, coverage.

    Whole texts are searched.  Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.  A null
    or empty document or item leaks nothing.  Repeated document rows give a row each; items with equal texts each
    count.  Other columns are not looked at.  Empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double"
    wanted = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    spark, out = docs.sparkSession, None
    for items in _blocks(benchmark, item_col, item_text_col, seed):
        shared = spark.sparkContext.broadcast(items)  # BLOCK_WORDS words at most
        memo = WordHashes()

        def search(cols: dict[str, list], shared=shared, memo=memo) -> dict[str, list]:
            rows = []
            for doc_id, text in zip(cols["doc_id"], cols["text"]):
                words = word_hashes(encoded(text).translate(PLAIN_WORDS).split(), memo)
                rows += [(doc_id, i, n, c, t, c / n) for i, n, c, t in shared.value.leaks(words, coverage)]
            names = [x.split()[0] for x in schema.split(", ")]
            return {name: [r[k] for r in rows] for k, name in enumerate(names)}

        part = map_columns(wanted, schema, search)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with all columns, less the rows into which any benchmark item leaks (no join: the test runs on each row)."""
    small_batches(docs.sparkSession)
    for items in _blocks(benchmark, item_col, item_text_col, seed):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.filter(~_leaking(shared, coverage)(F.col(text_col)))
    return docs


def _leaking(shared, coverage: float):
    """A Column function: whole text -> whether any item of the block leaks into it."""
    memo = WordHashes()

    @pandas_udf(BooleanType())
    def leaking(text: pd.Series) -> pd.Series:
        seq = (word_hashes(encoded(t).translate(PLAIN_WORDS).split(), memo) for t in text)
        return pd.Series([bool(shared.value.leaks(w, coverage)) for w in seq], dtype=bool)

    return leaking
