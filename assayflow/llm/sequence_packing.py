"""Shortest-pack-first packing over the histogram of lengths.

Documents become ids once, which are kept as a table.  A document gives full
pieces of ``capacity`` ids, each a sequence of its own, and a remainder.  Only
the histogram of the remainders' lengths (at most ``capacity`` rows) reaches
the driver.  There, lengths are placed longest first: so many of them as fit go
into the shortest open pack, which updates the counts of the packing patterns,
and the rest opens packs.  Patterns that end short are then filled by cutting the members of the
shortest ones, so that at most one pack stays open; it is cut at powers of two.

Patterns are joined back to documents by rank: pieces of one length are ranked
by a hash of their document, and every rank range of a length belongs to one
place of a pattern.  A hash bucket starts at the number of its length's pieces
in earlier buckets, so ranks need one shuffle and no task sees a whole length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import map_columns, saved, slices

CAPACITY = 2048
#: The id that ends a document.
END_ID = 1
#: Ids of a hash bucket on average; the number of buckets follows the number of ids.
BUCKET_IDS = 8_000_000
#: How the tokenizer splits a text before it merges bytes, and the blocks of characters whose kind (letter, number,
#: blank) all versions of Unicode agree on.  Texts with other characters, or with the tokenizer's special token, are encoded whole.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSETTLED = "[^\x00-ԯḀ-⁯　-鿿가-힣＀-￯]|<\\|endoftext\\|>"

SIZED = "doc_id long, digest long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# ------------------------------------------------------------------ ids

class Encoder:
    """Ids of texts as unsigned 32-bit numbers, those that the tokenizers library gives for the vocabulary file.

    The merges run in tiktoken on the same vocabulary as ranks, at a fifth of the time.  It splits texts of settled
    characters alike (tested for each); other texts, and those it refuses, go to the tokenizers library itself.
    """

    def __init__(self, vocabulary: str):
        import base64

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_path(f"{vocabulary}.json"))
        self.unsettled = regex.compile(UNSETTLED).search
        with open(public_path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding(vocabulary, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not self.unsettled(text):
            try:
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # very long runs of blanks
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(4)
def encoder(vocabulary: str) -> Encoder:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(vocabulary)


def squeezed(ids: bytes) -> bytes:
    """Ids as kept in tables: 16 bits each where all fit, compressed."""
    import zstandard

    wide = np.frombuffer(ids, "<u4")
    return zstandard.compress(wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids, 1)


def restored(data: bytes, n: int) -> bytes:
    """The ``n`` ids that ``squeezed`` was given."""
    import zstandard

    raw = zstandard.decompress(data)
    return raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def public_path(name: str) -> str:
    """Where this machine keeps the named vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_docs(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """Per row: id, a hash of the text's ids, their number with the end id, and the ids (see ``squeezed``)."""

    def encode(cols: dict[str, list]) -> dict[str, list]:
        import xxhash

        end = np.array([END_ID], "<u4").tobytes()
        out: dict[str, list] = {"doc_id": cols["id"], "digest": [], "n": [], "ids": []}
        for text in cols["text"]:
            ids = encoder(vocabulary).encode(text or "") + end
            out["digest"].append(xxhash.xxh3_64_intdigest(ids) - (1 << 63))
            out["n"].append(len(ids) // 4)
            out["ids"].append(squeezed(ids))
        return out

    return map_columns(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), SIZED, encode)


# ------------------------------------------------------------------ patterns

@dataclass(frozen=True)
class Part:
    """Ids ``cut`` to ``cut + size`` of the pieces of one length whose ranks begin at ``rank``."""

    length: int
    rank: int
    cut: int
    size: int


@dataclass(frozen=True)
class Pattern:
    """``count`` packs alike; pack k takes each part from the piece whose rank lies k above the part's."""

    count: int
    parts: tuple[Part, ...]
    used: int

    def split(self, count: int) -> tuple[Pattern, Pattern | None]:
        """The first ``count`` packs, and the others."""
        if count == self.count:
            return self, None
        later = tuple(replace(p, rank=p.rank + count) for p in self.parts)
        return replace(self, count=count), Pattern(self.count - count, later, self.used)

    def joined(self, other: Pattern) -> Pattern:
        return Pattern(self.count, self.parts + other.parts, self.used + other.used)

    def cut_at(self, at: int) -> tuple[Pattern, Pattern]:
        """The packs' first ``at`` ids, and the rest."""
        left, right, passed = [], [], 0
        for p in self.parts:
            take = min(max(at - passed, 0), p.size)
            if take:
                left.append(replace(p, size=take))
            if take < p.size:
                right.append(replace(p, cut=p.cut + take, size=p.size - take))
            passed += p.size
        return Pattern(self.count, tuple(left), at), Pattern(self.count, tuple(right), self.used - at)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place every piece: lengths longest first, each into the shortest open packs that it fits, else into new ones.

    The number of patterns follows the number of distinct lengths, not of pieces: a step uses up a pattern or a length.
    """
    open_packs: dict[int, list[Pattern]] = {}  # by ids used
    lengths_used: list[int] = []
    done = []

    def put(p: Pattern) -> None:
        if p.used == capacity:
            done.append(p)
            return
        if not open_packs.setdefault(p.used, []):
            lengths_used.insert(bisect_right(lengths_used, p.used), p.used)
        open_packs[p.used].append(p)

    def take(used: int) -> Pattern:
        p = open_packs[used].pop()
        if not open_packs[used]:
            lengths_used.remove(used)
        return p

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if lengths_used and lengths_used[0] + length <= capacity:
                first, others = take(lengths_used[0]), None
                if first.count > left:
                    first, others = first.split(left)
                if others:
                    put(others)
                n = first.count
                put(first.joined(Pattern(n, (Part(length, rank, 0, length),), length)))
            else:
                n = left
                put(Pattern(n, (Part(length, rank, 0, length),), length))
            rank, left = rank + n, left - n
    return done + [p for used in lengths_used for p in open_packs[used]]


def filled(patterns: list[Pattern], capacity: int) -> list[Pattern]:
    """Fill the longest short packs with ids cut from packs of the most frequent pattern; the last open pack is cut at powers of two.

    Packs as long as a power of two are sequences as they are.  The most frequent pattern gives, so that a step as a rule
    fills all packs of a pattern: steps follow the number of patterns and the logarithm of their counts.
    """
    done: list[Pattern] = []
    short: dict[int, Pattern] = {}
    longest: list[tuple] = []  # heaps over ``short``; entries of packs that are gone are skipped
    most: list[tuple] = []
    numbers = count()

    def put(p: Pattern | None, wait: bool = True) -> None:
        if p is None or p.used == 0:
            return
        if p.used == capacity or not wait and p.used & (p.used - 1) == 0:
            done.append(p)
            return
        number = next(numbers)
        short[number] = p
        heappush(longest, (-p.used, number))
        heappush(most, (-p.count, p.used, number))

    def take(heap: list[tuple]) -> Pattern:
        while heap[0][-1] not in short:
            heappop(heap)
        return short.pop(heappop(heap)[-1])

    for p in patterns:
        put(p, wait=False)
    while len(short) > 1 or any(p.count > 1 for p in short.values()):
        donor = take(most)
        donor, taker = (donor, take(longest)) if short else donor.split(donor.count // 2)
        n = min(donor.count, taker.count)
        (donor, unused), (taker, waiting) = donor.split(n), taker.split(n)
        given, rest = donor.cut_at(min(capacity - taker.used, donor.used))
        for p in (taker.joined(given), rest, unused, waiting):
            put(p)
    for rest in short.values():
        while rest.used:
            piece, rest = rest.cut_at(1 << (rest.used.bit_length() - 1))
            done.append(piece)
    return done


@dataclass
class Places:
    """For each length the starts of its rank ranges, and for each range what becomes of its pieces."""

    starts: dict[int, list[int]]
    parts: dict[int, list[list[tuple[int, int, int, int]]]]

    def of(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(cut, size, sequence, offset) of every part of the piece, in order."""
        at = bisect_right(self.starts[length], rank) - 1
        above = rank - self.starts[length][at]
        return [(cut, size, first + above, offset) for cut, size, first, offset in self.parts[length][at]]


def places(patterns: list[Pattern], first_sequence: int) -> Places:
    """Number the packs from ``first_sequence`` and index their parts by length and rank."""
    found: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
    for p in patterns:
        offset = 0
        for part in p.parts:
            found.setdefault(part.length, []).append((part.rank, part.rank + p.count, part.cut, part.size, first_sequence, offset))
            offset += part.size
        first_sequence += p.count
    starts, parts = {}, {}
    for length, ranges in found.items():
        # parts of one piece can come from patterns that were split at different ranks
        edges = sorted({x for r in ranges for x in r[:2]})
        starts[length] = edges[:-1]
        held: list[list[tuple[int, int, int, int]]] = [[] for _ in edges[:-1]]
        for lo, hi, cut, size, first, offset in ranges:
            for k in range(bisect_right(edges, lo) - 1, bisect_right(edges, hi) - 1):
                held[k].append((cut, size, first + edges[k] - lo, offset))
        parts[length] = [sorted(h) for h in held]
    return Places(starts, parts)


def plan(histogram: dict[int, int], capacity: int, first_sequence: int) -> Places:
    return places(filled(shortest_pack_first(histogram, capacity), capacity), first_sequence)


# ------------------------------------------------------------------ back to documents

def pack_sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", bucket_ids: int = BUCKET_IDS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    * Every row is packed, whole: its ids without special tokens, then the end id.  A null or empty text is the end id alone.
    * A sequence holds at most ``capacity`` ids.  All are full but those whose length is a power of two: no padding.
    * A document is cut into full pieces and a remainder; few remainders are cut again (see ``filled``).
    * The result does not depend on the order or the partitions of the rows.  Rows that agree in id and text are packed
      each; which of them takes which place makes no difference.  Null ids stay null.
    * Other columns are not looked at.  Empty in, empty out.
    """
    spark = docs.sparkSession
    sized = saved(encoded_docs(docs, id_col, text_col, vocabulary), "ids")
    total = sized.agg(F.sum("n")).first()[0]
    if total is None:
        return spark.createDataFrame([], PIECES)
    buckets = max(1, -(-total // bucket_ids), min(spark.sparkContext.defaultParallelism, total // 100_000))
    # the upper 31 bits of a hash, scaled: buckets are ranges of the hash, so their order is the order of the ranks
    keyed = sized.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "digest"), 33))
    keyed = keyed.withColumn("bucket", F.shiftright(F.col("h") * F.lit(buckets), 31).cast("int"))
    lengths = keyed.select("bucket", F.explode(F.expr(f"filter(array(struct(n % {capacity} as length, 1L as c), struct({capacity}L as length, n div {capacity} as c)), x -> x.length > 0 and x.c > 0)")).alias("x"))
    counts = saved(lengths.groupBy("bucket", F.col("x.length").alias("length")).agg(F.sum("x.c").alias("c")), "counts")
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    full = histogram.pop(capacity, 0)
    where = plan(histogram, capacity, full)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    marks = before.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))  # at most ``capacity`` lengths
    rows = keyed.select("bucket", F.lit(1).alias("kind"), "h", "doc_id", "digest", "n", "ids", F.lit(None).cast("map<bigint,bigint>").alias("before"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("h", "long"), ("doc_id", "long"), ("digest", "long"), ("n", "long"), ("ids", "binary"))]
    every = rows.unionByName(marks.select("bucket", F.lit(0).alias("kind"), *none, "before"))
    every = every.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "h", F.col("doc_id").asc_nulls_first(), "digest")
    return placed(every, where, capacity)


def placed(every: DataFrame, where: Places, capacity: int) -> DataFrame:
    """The pieces of documents that arrive by bucket and rank, after the row with the ranks at which their bucket begins."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PIECES))

    def pieces_of(n: int, ranks: dict[int, int]) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of each piece of a document."""
        at = 0
        while n - at >= capacity:
            yield at, capacity, ranks[capacity], 0
            ranks[capacity] += 1
            at += capacity
        if at < n:
            length = n - at
            for cut, size, sequence, offset in where.of(length, ranks[length]):
                yield at + cut, size, sequence, offset
            ranks[length] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[int, int] = {}
        for cols in slices(batches):
            out = []
            for i, kind in enumerate(cols["kind"]):
                if kind == 0:
                    ranks = dict(cols["before"][i])
                    continue
                doc_id, n = cols["doc_id"][i], cols["n"][i]
                ids = memoryview(restored(cols["ids"][i], n))
                for start, length, sequence, offset in pieces_of(n, ranks):
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, offset))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return every.mapInArrow(run, PIECES)
