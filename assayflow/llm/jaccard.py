"""Jaccard join over word shingles, heavy-light by set size.

Light sets (up to a boundary size) enumerate fixed-size subsets: two sets of
sizes n and m are linked if and only if they share a subset of
``c(n, m) = ceil(t (n + m) / (1 + t))`` shingles, so they meet under a
subset's key.  Large sets scan inverted lists: the lists hold each set's
first shingles in an order that puts frequent shingles last (counted over
all documents in a fixed-size sketch), as many as a linked pair needs to
meet in one.  The boundary minimises the estimated number of list entries,
from the histogram of small set sizes.

Documents with equal sets collapse to their smallest id first.  Lists with
one entry drop out.  In a star round each entry meets one pivot of its list
only, and what is linked becomes one component; the last round takes every
remaining pair of a list whose two documents are not connected yet.  So a
group of near copies costs a few tests a document, and no link that joins two
components is lost.  A pair is tested in two steps: parity bitmaps of both
sets bound their symmetric difference from below, and what may reach the
similarity is decided from the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import BROADCAST_IDS, WordHashes, aside, cut, discard, encoded, map_columns, mixed, narrow, only_ids, saved, slices, windows, without_ids, word_hashes
from assayflow.llm.components import components

WIDTH = 5
PERCENT = 80
#: Counters of the frequency sketch (a fixed size, whatever the input) and of one of its slabs.
COUNTERS = 1 << 23
SLAB = 1 << 16
#: Largest set size that the cost model considers for subset enumeration.
LIGHT_MAX = 24
#: Work of one inverted-list entry in units of one subset key (entries are wider scanned and tested).
ENTRY_COST = 4.0
#: Words of 64 bits in the parity bitmap of a set.
BITMAP = 8
BITS = [f"s{i}" for i in range(BITMAP)]
#: Star rounds at most; they end early when few pairs are open (an eighth of the entries), or when a round linked few documents
#: (1 in 200) and either the open pairs are no more than ``OPEN_PAIRS`` an entry or the round left more than ``IDLE`` of
#: them open, so that further ones would spare the last round little.
STAR_ROUNDS = 8
OPEN_PAIRS = 64
IDLE = 0.875
#: Earlier keys that an entry of the last round carries, and entries from which a list is split by size class (the
#: logarithm of the size ratio of linked sets).
PRIOR = 16
SPLIT_LIST = 1000
CLASS = 0.2231435513142097


def shingles(text: str | None, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text: ASCII lower case, words between ASCII blanks."""
    words = encoded(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, memo)
    if len(h) < width:
        return windows(h, len(h)) + mixed(np.array([len(h)], np.uint64))
    return np.unique(windows(h, width))


def _counter(s: np.ndarray) -> np.ndarray:
    """The sketch counter of each shingle."""
    return (s >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """A slab of counts in the narrowest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(counts) // SLAB}").astype(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set: each shingle flips one bit.  Common shingles flip the same ones, so two bitmaps differ in no more
    bits than the sets differ in shingles."""
    at = (s & np.uint64(64 * BITMAP - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * BITMAP) & 1).astype(np.uint8)).view(np.int64)


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes of sets that a set of n shingles can be linked with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def subset_keys(s: np.ndarray, boundary: int, percent: int = PERCENT) -> list[int]:
    """Keys of all fixed-size subsets under which a light set meets its light partners."""
    n, values, out = len(s), s.tolist(), []
    for m in partners(n, percent):
        if 0 < m <= boundary:
            tag = (min(n, m) * 1009 + max(n, m)).to_bytes(4, "little")
            for subset in combinations(values, needed(n, m, percent)):
                key = hashlib.blake2b(tag + np.array(subset, np.uint64).tobytes(), digest_size=8).digest()
                out.append(int.from_bytes(key, "little", signed=True))
    return out


def light_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The boundary with the least cost; sizes: number of sets of each size up to ``LIGHT_MAX``."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= x:
                total += count * sum(comb(n, needed(n, m, percent)) for m in partners(n, percent) if 0 < m <= x)
            if n >= -(-percent * (x + 1) // 100):  # also listed, to meet larger sets
                total += count * prefix_length(n, percent) * ENTRY_COST
        return total

    return min(range(LIGHT_MAX + 1), key=lambda x: (cost(x), x))


# ------------------------------------------------------------------ passes over the texts
def _profile(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: size, 128-bit digest and parity bitmap of each set, and each task's share of the frequency sketch."""
    schema = "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"{c} long" for c in BITS) + ", slab int, run int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = {x: pa.int64() for x in names} | {"slab": pa.int32(), "run": pa.int32(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sketch = WordHashes(), np.zeros(COUNTERS, np.int32)

        def rows(**cols):
            k = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([pa.array(cols.get(x, [None] * k), type=types[x]) for x in names], names)

        for cols in slices(batches):
            sets = [shingles(t, memo, width) for t in cols["text"]]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            if any(map(len, sets)):
                np.add.at(sketch, _counter(np.concatenate(sets)), 1)
            half = lambda d, i: int.from_bytes(d[i : i + 8], "little", signed=True)
            bits = np.array([parity(s) for s in sets], np.int64).reshape(-1, BITMAP)
            yield rows(doc_id=cols["doc_id"], n=[len(s) for s in sets], d1=[half(d, 0) for d in digests], d2=[half(d, 8) for d in digests], **{c: bits[:, i] for i, c in enumerate(BITS)})
        part = TaskContext.get().partitionId()
        for slab in range(COUNTERS // SLAB):
            own = sketch[slab * SLAB : (slab + 1) * SLAB]
            if own.any():
                yield rows(slab=[slab], run=[part], counts=[packed(own)])

    return saved(docs.mapInArrow(run, schema), "profile")


def _levels(profile: DataFrame, fan_in: int = 64) -> np.ndarray:
    """Logarithm of each counter of the sketch, in eighths of a power of two: slabs are added up in a tree, a bounded number at a time."""
    slabs = profile.filter("slab is not null").select("slab", "run", "counts")
    runs = (slabs.agg(F.max("run")).first()[0] or 0) + 1

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLAB, np.int64)
        for x in pdf["counts"]:
            total += unpacked(x)
        return pd.DataFrame({"slab": pdf["slab"].iloc[:1], "run": pdf["run"].iloc[:1], "counts": [packed(total)]})

    while True:
        slabs = slabs.withColumn("run", F.expr(f"run div {fan_in}").cast("int")).groupBy("slab", "run").applyInPandas(add, slabs.schema)
        runs = -(-runs // fan_in)
        if runs == 1:
            break
    counts = np.zeros(COUNTERS, np.int64)
    for r in slabs.collect():  # COUNTERS / SLAB rows of SLAB counters
        counts[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = unpacked(bytes(r["counts"]))
    return np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8)


def _entries(docs: DataFrame, levels: np.ndarray, width: int, percent: int, boundary: int) -> DataFrame:
    """List entries (key, id, n, pos) in lists of more than one.

    ``pos`` is the shingle's place in the set's order, -1 under a subset's key; the first ``heads`` keys are shingles.
    Keys are shuffled once: a list is counted where its entries meet.
    """
    held = docs.sparkSession.sparkContext.broadcast(levels)  # COUNTERS bytes
    memo = WordHashes()
    listed_from = -(-percent * (boundary + 1) // 100)

    def emit(cols: dict[str, list]) -> dict[str, list]:
        ids, sizes, heads, keys = [], [], [], []
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            s = shingles(text, memo, width)
            n = len(s)
            if not n:
                continue
            head = np.empty(0, np.int64)
            if n >= listed_from:
                rank = (held.value[_counter(s)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                head = s[np.argsort(rank, kind="stable")[: prefix_length(n, percent)]].view(np.int64)
            light = subset_keys(s, boundary, percent) if n <= boundary else []
            ids.append(doc_id)
            sizes.append(n)
            heads.append(len(head))
            keys.append(np.concatenate([head, np.array(light, np.int64)]))
        return {"id": ids, "n": sizes, "heads": heads, "keys": keys}

    arrays = map_columns(docs, "id long, n int, heads int, keys array<long>", emit)
    out = arrays.select("id", "n", "heads", F.posexplode("keys").alias("pos", "key"))
    out = out.select("key", "id", F.expr("shiftleft(cast(n as long), 32) + if(pos < heads, pos + 1, 0)").alias("at"))  # one long for the shuffle
    out = out.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("c > 1")
    out = out.select("key", "id", F.expr("cast(shiftright(at, 32) as int)").alias("n"), F.expr("cast(at & 4294967295L as int) - 1").alias("pos"))
    return saved(out, "entries")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    memo = WordHashes()

    def emit(cols: dict[str, list]) -> dict[str, list]:
        return {"id": cols["doc_id"], "items": [shingles(t, memo, width).tobytes() for t in cols["text"]]}

    return saved(map_columns(docs, "id long, items binary", emit), "sets")


# ------------------------------------------------------------------ pairs
def _possible(a: str, b: str, percent: int):
    """Whether two entries of one list can belong to linked sets: sizes, places in the order, and the shorter one's own prefix."""
    t = 100 + percent
    sizes = f"least({a}n, {b}n) * 100L >= {percent} * greatest({a}n, {b}n)"
    bound = f"least({a}pos, {b}pos) + 1 + least({a}n - {a}pos - 1, {b}n - {b}pos - 1)"
    own = f"if({a}n <= {b}n, {a}pos < {a}n - ceil({2 * percent} * {a}n / {t}) + 1, {b}pos < {b}n - ceil({2 * percent} * {b}n / {t}) + 1)"
    return F.expr(f"{sizes} and ({a}pos < 0 or {b}pos < 0 or ({t} * ({bound}) >= {percent} * ({a}n + {b}n) and {own}))")


def _similar(a: str, b: str, percent: int):
    """Whether two sets can be linked by what their bitmaps say; ``a`` and ``b`` are formats of the column names."""
    apart = " + ".join(f"bit_count({a.format(c)} ^ {b.format(c)})" for c in BITS)
    return F.expr(f"{100 + percent}L * ({apart}) <= {100 - percent}L * ({a.format('n')} + {b.format('n')})")


def _beside(pairs: DataFrame, table: DataFrame, cols: list[str], rows: int, sides: str = "vu") -> DataFrame:
    """Pairs with the columns of both documents, as ``<column>_u`` and ``<column>_v``.

    ``rows``: the number of pairs; at ``sides``, few of them go to the table, not the table to them.
    """
    for side in ("v", "u"):
        own = table.select(F.col("id").alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in cols])
        pairs = own.join(aside(pairs, rows) if side in sides else pairs, F.col(side) == F.col(f"id_{side}")).drop(f"id_{side}")
    return pairs


def _linked(pairs: DataFrame, rows: int, maps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v), ``rows`` of them, whose whole sets reach the similarity."""

    def test(cols: dict[str, list]) -> dict[str, list]:
        keep = []
        for k, (x, y) in enumerate(zip(cols["items_u"], cols["items_v"])):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                keep.append(k)
        return {"u": [cols["u"][k] for k in keep], "v": [cols["v"][k] for k in keep]}

    near = cut(narrow(_beside(pairs, maps, ["n", *BITS], rows).filter(_similar("{}_u", "{}_v", percent)).select("u", "v").distinct(), rows))
    ids = cut(narrow(near.select(F.col("u").alias("id")).union(near.select("v")).distinct(), 2 * rows))
    sets = _sets(only_ids(texts, ids), width)
    links = cut(narrow(map_columns(_beside(near, sets, ["items"], rows, "v"), "u long, v long", test).distinct(), rows))
    discard(near, ids, sets)
    return links


def _relabel(labels: DataFrame, links: DataFrame, documents: int, rows: int) -> DataFrame:
    """Labels of ``documents`` documents after joining the components that ``rows`` new links connect."""
    side = lambda c: aside(labels.select(F.col("id").alias(f"id_{c}"), F.col("label").alias(f"label_{c}")), documents)
    bridges = links.join(side("u"), F.col("u") == F.col("id_u")).join(side("v"), F.col("v") == F.col("id_v"))
    bridges = bridges.select(F.col("label_u").alias("u"), F.col("label_v").alias("v")).filter("u <> v")
    merged = components(bridges, rows)
    out = labels.join(merged, labels["label"] == merged["node"], "left")
    return cut(out.select("id", F.coalesce(merged["label"], labels["label"]).alias("label")))


def _link_all(entries: DataFrame, bitmaps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Labels (id, label) of all documents with an entry in a list that is not alone."""
    rows = held_rows = entries.count()
    labels = cut(narrow(entries.select("id", F.col("id").alias("label")).distinct(), rows))
    documents, merged, tested, n_tested, before = labels.count(), 0, None, 0, 0.0
    maps = cut(only_ids(bitmaps, labels.select("id"), "id"))
    for k in range(STAR_ROUNDS + 1):
        if k:  # two longs a row, broadcast below the bound of id lists
            held = labels.select(F.col("id").alias("own"), "label")
            held = F.broadcast(held) if documents <= BROADCAST_IDS else held
            marked = entries.join(held, entries["id"] == held["own"]).select("key", "id", "n", "pos", "label")
        else:
            marked = entries.withColumn("label", F.col("id"))
        pivot = F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "pos", "label")
        if k:
            lists = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.min(pivot).alias("p"))
            lists = lists.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.min("p").alias("p"))
        else:  # every document is a component of its own
            lists = marked.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count(F.lit(1)).alias("same"), F.min(pivot).alias("p"))
        # a list of two was done with by its first pivot
        lists = lists.filter(f"all * all > same and all > {2 if k else 1}")
        lists = cut(narrow(lists.select(F.col("key").alias("list"), "all", "same", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("id", "n", "pos", "label")]), held_rows))
        open_pairs, n_lists, left = lists.agg(F.sum(F.expr("(cast(all as double) * all - same) / 2")), F.count(F.lit(1)), F.sum(F.expr("if(all > 2, all, 0)"))).first()
        if not open_pairs:
            return labels
        idle = merged < documents / 200 and (open_pairs <= OPEN_PAIRS * rows or open_pairs > IDLE * before)
        last = k > 0 and (open_pairs <= rows / 8 or idle) or k == STAR_ROUNDS
        before = open_pairs
        if last:  # every pair of a list that is not connected yet, in the first list that holds both
            live = marked.join(aside(lists.select("list"), n_lists), F.col("key") == F.col("list"), "left_semi")
            held = live.groupBy("id").agg(F.min("label").alias("label"), F.sort_array(F.collect_list(F.struct("pos", "key", "n"))).alias("at"))  # a set's entries
            texts_of = maps.groupBy(F.col("id").alias("own_id")).agg(F.count(F.lit(1)).alias("texts"))
            held = held.join(maps.select(F.col("id").alias("own"), *BITS), F.col("id") == F.col("own")).join(texts_of, F.col("id") == F.col("own_id"))
            held = held.select("id", "label", "texts", *BITS, F.transform("at", lambda x: x["key"]).alias("all_keys"), F.posexplode("at").alias("k", "x"))
            # (a pair is fresh in its first common list whatever is left out of the earlier keys; later repeats fall to the distinct)
            live = cut(held.select("x.key", "id", "x.n", "x.pos", "label", "texts", *BITS, F.expr(f"if(x.pos < 0, slice(all_keys, 1, 0), slice(all_keys, 1, least(k, {PRIOR})))").alias("prior")))
            # linked sets of a long list are of one size class or of neighbouring ones
            sizes = lists.select(F.col("list"), (F.col("all") > SPLIT_LIST).alias("long"))
            live_at = live.join(sizes, F.col("key") == F.col("list")).drop("list").withColumn("cls", F.when(F.col("long"), F.floor(F.log(F.col("n").cast("double")) / F.lit(CLASS))).otherwise(0))
            live_in = live_at.withColumn("cls", F.explode(F.when(F.col("long"), F.array(F.col("cls") - 1, "cls", F.col("cls") + 1)).otherwise(F.array("cls"))))
            # nothing in common before it, so only what follows can be: a tighter bound than any shared entry gives
            after = f"{100 + percent} * (1 + least(a.n - a.pos - 1, b.n - b.pos - 1)) >= {percent} * (a.n + b.n)"
            # (an id with several texts has several orders, so its pairs are met in every list)
            fresh = F.expr(f"a.texts > 1 or b.texts > 1 or not arrays_overlap(a.prior, b.prior) and (a.pos < 0 or b.pos < 0 or {after})")
            met = F.expr("a.key = b.key and a.cls = b.cls and a.id < b.id and a.label <> b.label") & _possible("a.", "b.", percent) & _similar("a.{}", "b.{}", percent) & fresh
            pairs = live_at.alias("a").join(live_in.alias("b"), met).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
        else:
            pairs = marked.join(aside(lists, n_lists), [F.col("key") == F.col("list"), F.col("label") != F.col("p_label"), _possible("", "p_", percent)])
            pairs = pairs.select(F.least("id", "p_id").alias("u"), F.greatest("id", "p_id").alias("v")).distinct()
        if tested is not None:
            done = tested.select(F.col("u").alias("done_u"), F.col("v").alias("done_v"))
            pairs = pairs.join(aside(done, n_tested), (F.col("u") == F.col("done_u")) & (F.col("v") == F.col("done_v")), "left_anti")
        pairs = cut(pairs if last else narrow(pairs, held_rows))  # an entry meets one pivot
        if last:
            discard(entries, lists, live)
        tested = pairs if tested is None else tested.union(pairs)
        n_pairs = pairs.count()
        n_tested += n_pairs
        links = _linked(pairs, n_pairs, maps, texts, width, percent)
        merged = links.count()
        labels = _relabel(labels, links, documents, merged)
        if last:
            return labels
        open_lists = lists.filter("all > 2").select("list")
        kept = cut(narrow(entries.join(aside(open_lists, n_lists), F.col("key") == F.col("list"), "left_semi"), left))
        discard(entries, lists)
        entries, held_rows = kept, left
    return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct ``width``-word shingles; a
    text of fewer words is one shingle as a whole.

    * A null, empty or blank text has no shingles, links with nothing and is its own component.
    * A row with a null id links with nothing; its component is null.
    * Rows that share an id are one document that links by any of its texts; each row has its own ``n_shingles``.
    * Ids are integers.  Other columns are not looked at.  An empty table gives an empty result.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    profile = _profile(texts, width)
    sized = cut(profile.filter("slab is null").select("doc_id", "n", "d1", "d2", *BITS))
    levels = _levels(profile)
    discard(profile)
    alike = sized.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    documents = sized.count()
    groups = cut(narrow(alike.filter("copies > 1").select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), F.col("n").alias("g_n"), "first"), documents))
    same = [F.col("d1") == F.col("g1"), F.col("d2") == F.col("g2"), F.col("n") == F.col("g_n")]
    named = sized.join(groups, same, "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("first"))
    # an id leaves the search only if each of its texts is a copy: another text has links of its own
    copies = cut(narrow(named.filter("doc_id <> first").select("doc_id").distinct(), documents))
    copies = without_ids(copies, only_ids(named.filter("n > 0 and doc_id = first").select("doc_id"), copies))
    sizes = alike.filter(f"n <= {LIGHT_MAX}").groupBy("n").count().collect()  # LIGHT_MAX rows at most
    boundary = light_boundary({r["n"]: r["count"] for r in sizes}, percent)
    singles = without_ids(texts.filter("doc_id is not null"), copies)
    bitmaps = without_ids(sized.filter("n > 0 and doc_id is not null"), copies).select(F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), *BITS)
    labels = _link_all(_entries(singles, levels, width, percent, boundary), bitmaps, texts, width, percent)
    # texts of one id, and copies of a set, belong together
    bound = cut(named.filter("n > 0 and first <> doc_id").select(F.col("doc_id").alias("u"), F.col("first").alias("v")).union(labels.select("id", "label").filter("id <> label")))
    final = components(bound, bound.count()).select(F.col("node"), F.col("label"))
    out = sized.join(final, [sized["doc_id"] == final["node"], sized["n"] > 0], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))
