"""Document scores of a log-bilinear neural language model.

Words fall into a fixed number of classes: one for the end mark, one for each
of the most frequent training words, the others by the hash of their last two
bytes.  The network predicts a word's class from the two classes before it:
position matrices map their vectors to a predicted vector, whose inner
products with the class vectors (plus biases) are the scores.  It is trained in
numpy by noise-contrastive estimation against the class unigram, on the
counts of class triples of the whole training corpus (at most ``CLASSES`` ** 3
numbers, whatever the corpus size).  For scoring, batched matrix products
over all contexts give a table of normalised log-probabilities.  Within its
class a word has its smoothed training frequency, so a text's probability is
normalised over words too.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import encoded, remainder, saved, slices

OWN_CLASSES = 95
HASH_CLASSES = 32
CLASSES = 1 + OWN_CLASSES + HASH_CLASSES
#: Frequent words whose counts every task holds; counts of all other words are joined.
HELD_WORDS = 150_000
#: Distinct words a counting task holds before it passes them on.
FLUSH_WORDS = 300_000
DIMENSIONS = 16


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, words between ASCII blanks; null counts as empty."""
    return encoded(text).lower().split()


def hashed_class(word: bytes) -> int:
    return 1 + OWN_CLASSES + zlib.crc32(word[-2:]) % HASH_CLASSES


# ------------------------------------------------------------------ counting
def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; each task adds up what it holds before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for cols in slices(batches):
            for text in cols["text"]:
                held.update(words_of(text))
                if len(held) >= FLUSH_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the most frequent words, totals, and the class sizes."""

    index: dict[bytes, int]
    counts: np.ndarray
    kind: np.ndarray  # class of each held word
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, c):
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def inside(self, c, kind):
        """log10 probability of a word within its class; a class of one word gives 1."""
        shared = np.log10((c + 0.5) / (self.class_tokens[kind] + 0.5 * (self.class_words[kind] + 1)))
        return np.where(kind <= OWN_CLASSES, 0.0, shared)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    # the lowest eighth of a power of two from which on at most HELD_WORDS words are counted
    level = F.floor(F.log2("c") * 8)
    least, room = 1 << 30, HELD_WORDS
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # 8 * 63 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    held = counts.filter(level >= least).toArrow()  # HELD_WORDS rows at most
    held = sorted(zip(held["word"].to_pylist(), held["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    names = [w for w, _ in held]
    c = np.array([k for _, k in held], np.int64)
    kind = np.array([1 + i if i < OWN_CLASSES else hashed_class(w) for i, w in enumerate(names)], np.int64)
    by = F.expr(f"{1 + OWN_CLASSES} + crc32(substring(word, greatest(1, octet_length(word) - 1), 2)) % {HASH_CLASSES}")
    sizes = counts.groupBy(by.alias("kind")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("words")).collect()  # HASH_CLASSES rows
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sizes:
        tokens[r["kind"]], words[r["kind"]] = r["c"], r["words"]
    total, distinct = int(tokens.sum()), int(words.sum())
    for i, w in enumerate(names[:OWN_CLASSES]):  # counted under their hash so far
        tokens[hashed_class(w)] -= c[i]
        words[hashed_class(w)] -= 1
        tokens[1 + i], words[1 + i] = c[i], 1
    tokens[0], words[0] = ends, int(ends > 0)
    return Vocabulary({w: i for i, w in enumerate(names)}, c, kind, total + ends, distinct + int(ends > 0), ends, tokens, words)


def _classes(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(index of each word among the held ones or -1, class of each word)."""
    get = v.index.get
    at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    kind = np.zeros(len(words), np.int64)
    known = at >= 0
    kind[known] = v.kind[at[known]]
    for i in np.flatnonzero(~known).tolist():
        kind[i] = hashed_class(words[i])
    return at, kind


def _triples(kind: np.ndarray) -> np.ndarray:
    """Codes (class two before, class before, class) of a text's words and its end; before the text stand ends."""
    seq = np.concatenate(([0, 0], kind, [0]))
    return (seq[:-2] * CLASSES + seq[1:-1]) * CLASSES + seq[2:]


def count_triples(texts: DataFrame, v) -> DataFrame:
    """(code, c) over all texts, at most ``CLASSES`` ** 3 rows; each task adds up into an array of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int32)
        for cols in slices(batches):
            codes = [_triples(_classes(words_of(t), v.value)[1]) for t in cols["text"]]
            found, c = np.unique(np.concatenate(codes), return_counts=True)
            total[found] += c.astype(np.int32)
        found = np.flatnonzero(total)
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], ["code", "c"])

    return texts.select("text").mapInArrow(run, "code int, c long").groupBy("code").agg(F.sum("c").alias("c"))


# ------------------------------------------------------------------ network
def train(codes: np.ndarray, counts: np.ndarray, unigram: np.ndarray, steps: int = 400, noise: int = 96, rate: float = 0.03, seed: int = 7) -> dict[str, np.ndarray]:
    """Log-bilinear parameters by noise-contrastive estimation with Adam.

    Nothing is drawn: every step takes all triples with their counts, and the expectation over ``noise`` noise words a
    triple from the class unigram (at most ``CLASSES`` ** 2 contexts by ``CLASSES`` numbers, whatever the corpus size).
    Biases begin at the log unigram, so training begins at the unigram model; the seed is that of the first vectors.
    """
    m, d = len(unigram), DIMENSIONS
    rng = np.random.default_rng(seed)
    p = {
        "context": rng.normal(0, 0.1, (m, d)), "target": rng.normal(0, 0.1, (m, d)), "bias": np.log(unigram),
        "near": np.eye(d) + rng.normal(0, 0.05, (d, d)), "far": 0.5 * np.eye(d) + rng.normal(0, 0.05, (d, d)),
    }
    if not len(codes):
        return p
    contexts, at = np.unique(codes // m, return_inverse=True)
    w2, w1 = contexts // m, contexts % m
    data = np.zeros((len(contexts), m))
    data[at, codes % m] = counts / counts.sum()
    both = data + data.sum(1, keepdims=True) * (noise * unigram)  # shares of data and noise words after each context
    of2, of1 = (np.arange(m)[:, None] == w2).astype(float), (np.arange(m)[:, None] == w1).astype(float)
    log_noise = np.log(noise * unigram)
    one, two = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for t in range(1, steps + 1):
        r2, r1 = p["context"][w2], p["context"][w1]
        r = r2 @ p["far"] + r1 @ p["near"]
        hit = data - both / (1 + np.exp(log_noise - p["bias"] - r @ p["target"].T))  # pushes data words' scores up, noise words' down
        dr = hit @ p["target"]
        dc = of2 @ (dr @ p["far"].T) + of1 @ (dr @ p["near"].T)
        grad = {"target": hit.T @ r, "bias": hit.sum(0), "far": r2.T @ dr, "near": r1.T @ dr, "context": dc}
        step = rate * min(1.0, 3 * (1 - t / (steps + 1)))
        for k, g in grad.items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            p[k] = p[k] + step * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
    return p


def log_table(p: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each class after each pair of classes: matrix products, one batch for each far class."""
    m = len(p["bias"])
    near = p["context"] @ p["near"]
    out = np.empty((m, m, m), np.float32)
    for k in range(m):
        s = (p["context"][k] @ p["far"] + near) @ p["target"].T + p["bias"]
        s -= s.max(1, keepdims=True)
        out[k] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
    return out.reshape(-1)


# ------------------------------------------------------------------ scoring
def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model and all counts come from the rows outside the held-out fold (crc32 of the id as text modulo 5).  A
    null text counts as empty and has one token, its end.  Repeated rows are learned from and scored each; a null id
    counts as the empty text for the fold.  Without training rows ``n_known`` is 0 and the scores are those of the
    smoothed empty counts.  Other columns are not looked at.  An empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), (remainder(docs[id_col]) == held_out).alias("held_out"))
    training = texts.filter("not held_out")
    counts = saved(count_words(training), "words")
    v = vocabulary(counts, training.count())
    shared = sc.broadcast(v)  # HELD_WORDS words
    triples = count_triples(training, shared).toArrow()  # CLASSES ** 3 rows at most
    unigram = (v.class_tokens + 0.5) / (v.class_tokens + 0.5).sum()
    table = sc.broadcast(log_table(train(*_sorted(triples), unigram)))  # CLASSES ** 3 numbers

    schema = "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        base, inside = v.base(v.counts), v.inside(v.counts, v.kind)
        end = float(v.base(v.ends))
        row = TaskContext.get().partitionId() << 40
        for cols in slices(batches):
            rows = []
            for doc_id, text, out in zip(cols["doc_id"], cols["text"], cols["held_out"]):
                words = words_of(text)
                at, kind = _classes(words, v)
                known = at[at >= 0]
                rare = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                seq = table.value[_triples(kind)].sum(dtype=np.float64)
                rows.append((row, doc_id, out, len(words) + 1, len(known) + int(v.ends > 0), base[known].sum() + end, seq + inside[known].sum(), list(rare), list(rare.values())))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(names))], names)

    part = saved(texts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(run, schema), "scored")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("rare"), F.col("x.times").alias("times"))
    found = rare.join(counts, F.col("rare") == F.col("word"), "left")
    c = F.coalesce("c", F.lit(0))
    kind = F.expr(f"cast(crc32(substring(rare, greatest(1, octet_length(rare) - 1), 2)) % {HASH_CLASSES} as int)")
    lower = F.element_at(F.array(*[F.lit(float(v.class_tokens[k] + 0.5 * (v.class_words[k] + 1))) for k in range(1 + OWN_CLASSES, CLASSES)]), kind + 1)
    rest = found.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(float(v.tokens + 0.5 * (v.distinct + 1))))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((c + 0.5) / lower)).alias("rare_score"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return part.drop("rare", "times").join(rest, F.col("row") == F.col("of"), "left").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known")).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("score") + zero("rare_score")).alias("score"),
    )


def _sorted(triples) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = triples["code"].to_numpy().astype(np.int64), triples["c"].to_numpy()
    order = np.argsort(codes)
    return codes[order], counts[order]
