"""Ranked lexical search by presence masks.

Each block of items makes one pass over the texts, which keeps per document
its number of terms and the terms that the block asks for, with their counts.
Document frequencies are added up from that table.  The ranking reads it once:
inside a task, bitmap operations over the postings give every document of a
batch the mask of an item's terms that it holds, and documents are grouped by
mask.  A mask's score is at most the sum of the largest scores that its terms
reach in the batch; masks are evaluated by descending bound, and the item is
finished with the batch when the next bound lies below its k-th score so far,
which a task carries from batch to batch.  A task hands on k documents per
item, and two rounds of ranks merge them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import PLAIN_WORDS, discard, encoded, map_columns, saved, slices, small_batches
from assayflow.operators.ordered import running_sums

#: Results of an item.
TOP = 50
#: Distinct terms of the items that one pass over the documents serves.
BLOCK_TERMS = 200_000
#: Documents grouped by mask at a time.
BATCH_DOCS = 4096
#: Groups that the first merge of the tasks' results spreads an item over.
MERGE_SALTS = 64

MATCHED = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def plain_terms(text: str | None) -> list[bytes]:
    """The terms of a whole text: runs of ASCII letters (lower-cased), ASCII digits and non-ASCII characters."""
    return encoded(text).translate(PLAIN_WORDS).split()


def matched_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document its number of terms and the counts of those in ``vocabulary``; documents without terms are left out."""

    def count(cols: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "n": [], "terms": [], "counts": []}
        for doc_id, text in zip(cols["id"], cols["text"]):
            words = plain_terms(text)
            if not words:
                continue
            met, times = np.unique(np.fromiter((vocabulary.get(w, -1) for w in words), np.int32, len(words)), return_counts=True)
            known = met >= 0
            out["doc_id"].append(doc_id)
            out["n"].append(len(words))
            out["terms"].append(met[known])
            out["counts"].append(times[known].astype(np.int32))
        return out

    return map_columns(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), MATCHED, count)


class Postings:
    """The postings of a batch of documents, by document and by term."""

    def __init__(self, ids: list[int | None], n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.absent = np.array([i is None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.terms = terms
        docs = np.repeat(np.arange(len(ids)), lengths)
        tf = counts.astype(np.int64)
        self.scores = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
        by_term = np.argsort(terms, kind="stable")
        self.docs_by_term = docs[by_term]
        self.met, at = np.unique(terms[by_term], return_index=True)
        self.ends = np.append(at, len(terms))
        self.highest = np.maximum.reduceat(self.scores[by_term], at) if len(at) else np.empty(0, np.int64)

    def of(self, wanted: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Documents of each wanted term that the batch holds, and that term's highest score."""
        at = np.searchsorted(self.met, wanted)
        at = at[at < len(self.met)]
        at = at[np.isin(self.met[at], wanted)]
        at = np.unique(at[self.highest[at] > 0])
        return [self.docs_by_term[self.ends[i] : self.ends[i + 1]] for i in at], self.highest[at]

    def exact(self, docs: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Scores of ``docs`` over the terms marked in ``member``."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        owner = np.repeat(np.arange(len(docs)), lengths)
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(self.starts[docs], lengths) + within
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, owner, np.where(member[self.terms[at]], self.scores[at], 0))
        return total


def mask_groups(postings: list[np.ndarray], n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents with any term, number of the mask of each, masks as rows of 64-bit words)."""
    words = np.zeros((-(-len(postings) // 64), n_docs), np.uint64)
    for i, docs in enumerate(postings):
        words[i // 64, docs] |= np.uint64(1 << (i % 64))
    present = np.flatnonzero(words.any(axis=0))
    keys = np.ascontiguousarray(words[:, present].T)
    if keys.shape[1] == 1:
        masks, number = np.unique(keys[:, 0], return_inverse=True)
        return present, number, masks[:, None]
    _, first, number = np.unique(keys.view([("", np.uint64)] * keys.shape[1]).ravel(), return_index=True, return_inverse=True)
    return present, number.ravel(), keys[first]


class Best:
    """The k best documents of an item so far: score descending, then id ascending, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.absent, self.ids = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def least(self) -> int:
        """A document below this score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least()
        score, absent, ids = (np.concatenate([old, new[good]]) for old, new in ((self.score, score), (self.absent, absent), (self.ids, ids)))
        keep = np.lexsort((ids, absent, -score))[: self.k]
        self.score, self.absent, self.ids = score[keep], absent[keep], ids[keep]


def search_batch(batch: Postings, wanted: np.ndarray, member: np.ndarray, best: Best) -> int:
    """Enter the batch's documents for one item; returns how many were evaluated."""
    postings, highest = batch.of(wanted)
    if not postings or int(highest.sum()) < best.least():
        return 0
    present, number, masks = mask_groups(postings, len(batch.ids))
    bound = np.zeros(len(masks), np.int64)
    for i, h in enumerate(highest):
        bound += np.where(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), h, 0)
    by_mask = np.argsort(number, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(masks)))])
    order = np.argsort(-bound, kind="stable")
    seen, at = 0, 0
    while at < len(order) and bound[order[at]] >= best.least():
        group, size = [], 0
        while at < len(order) and size < best.k and bound[order[at]] >= best.least():
            g = order[at]
            group.append(by_mask[ends[g] : ends[g + 1]])
            size += len(group[-1])
            at += 1
        docs = present[np.concatenate(group)]
        best.add(batch.exact(docs, member), batch.absent[docs], batch.ids[docs])
        seen += len(docs)
    return seen


def ranked_block(matched: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The ``top`` best documents of each item and task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        member = np.zeros(len(weights), bool)
        for cols in slices(batches, BATCH_DOCS):
            lengths = np.fromiter(map(len, cols["terms"]), np.int64, len(cols["terms"]))
            flat = [np.fromiter((x for row in cols[c] for x in row), np.int32, int(lengths.sum())) for c in ("terms", "counts")]
            batch = Postings(cols["doc_id"], np.array(cols["n"], np.int64), lengths, *flat, weights, n_docs, n_terms)
            for wanted, b in zip(items, best):
                member[wanted] = True
                search_batch(batch, wanted, member, b)
                member[wanted] = False
        for i, b in enumerate(best):
            if len(b.score):
                ids = pa.array(b.ids, mask=b.absent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i, np.int32)), ids, pa.array(b.score)], schema=schema)

    return matched.mapInArrow(run, FOUND)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    top: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank, doc_id, score.

    * All rows of ``docs`` and ``items`` and whole texts count.  A null, empty or blank text has no terms: such a document
      counts for nothing and an item without terms, or whose terms no document holds, returns no rows.
    * A repeated document row is a document of its own.  A repeated item row gets a ranking of its own.
    * Equal scores go by ascending id, null ids last; rows that agree in both are equal.
    * Only scores above 0 are returned.  Other columns are not looked at.  Empty in, empty out.
    * Items are served in blocks of ``block_terms`` distinct terms, each a pass over the documents; what a task holds is
      bounded by a block, ``top`` documents for each of its items and a batch of documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = map_columns(
        items.select(items[item_col].alias("item_id"), items[item_text_col].cast("string").alias("text")).select(F.col("item_id").cast("long"), "text"),
        "item_id long, terms array<binary>, size long",
        lambda cols: {"item_id": cols["item_id"], "terms": (t := [sorted(set(plain_terms(x))) for x in cols["text"]]), "size": [len(x) for x in t]},
    )
    asked = saved(asked.filter("size > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    upto = running_sums(asked.select("item", "size"), [], ["item"], ["size"], ["upto"])
    blocks = saved(upto.select("item", F.expr(f"(upto - size) div {block_terms}").alias("block")), "blocks")
    numbers = [r["block"] for r in blocks.select("block").distinct().orderBy("block").toLocalIterator()]
    found, spent = [], []
    for number in numbers:
        rows = asked.join(blocks.filter(F.col("block") == number), "item", "left_semi").orderBy("item").collect()  # at most block_terms terms and one item
        vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in rows for w in r["terms"]}))}
        matched = saved(matched_terms(docs, id_col, text_col, vocabulary), "matched")
        n_docs, n_terms = matched.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n_docs:
            held = matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # at most a row per term of the block
            weights = np.zeros(len(vocabulary), np.int64)
            for t, df in held:
                weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            wanted = [np.array(sorted(vocabulary[bytes(w)] for w in r["terms"]), np.int64) for r in rows]
            part = saved(ranked_block(matched, wanted, weights, n_docs, n_terms, top).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_SALTS))), "found")
            names = spark.createDataFrame([(i, r["item"], r["item_id"]) for i, r in enumerate(rows)], "item int, item_row long, item_id long")
            found.append(part.join(F.broadcast(names), "item").select("item_row", "item_id", "salt", "doc_id", "score"))  # as many rows as items of the block
        spent.append(matched)
    discard(*spent, asked, blocks)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_row", "salt"], ["item_row"]):
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return every.select("item_id", "rank", "doc_id", "score")
