"""Work and memory that stay in proportion, and results that do not depend on the partitioning."""

import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.llm import classifier as C
from assayflow.llm import components as K
from assayflow.llm import jaccard as J
from assayflow.llm import licenses as L
from assayflow.llm import packing as P
from assayflow.llm import personal_data as I
from assayflow.llm import warc_index as W

from ..conftest import spark  # noqa: F401
from .test_text_operators import brute_components, docs_of


# ------------------------------------------------------------------ 1
def test_records_are_read_by_as_many_tasks_as_there_are_captures_for(spark, monkeypatch):  # noqa: F811
    monkeypatch.setattr(W, "TASK_CAPTURES", 50)
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.example.org/{i}", f"page {i}") for i in range(400)], "page_id long, url string, html string")
    got = W.write_and_read_back(pages)
    assert got.rdd.getNumPartitions() == 8
    assert sum(1 for n in got.groupBy(F.spark_partition_id()).count().collect() if n["count"] > 0) > 4
    assert sorted(r["page_id"] for r in got.collect()) == list(range(400))


# ------------------------------------------------------------------ 5
def plain_features(text, lo, hi):
    """The features of one span, each by its definition."""
    span = text[lo:hi]
    digits = re.sub("[^0-9]", "", span)
    n, letters = len(digits), sum(c.isalpha() for c in span)
    others = len(span) - n - letters
    before, after, cue = text[lo - 1 : lo], text[hi : hi + 1], text[max(0, lo - 16) : lo]
    groups = re.findall("[0-9]+", span)
    f = [
        1, 12 <= n <= 19, 12 <= n <= 19 and I.luhn(digits), 9 <= n <= 15, 7 <= n <= 11, n == 0, letters == 0, letters == 0 and n > 0 and others <= n,
        bool(I.MAIL_SHAPE.match(span)), bool(I.IP_SHAPE.match(span)) and all(int(x) <= 255 for x in groups), bool(I.PHONE_SHAPE.match(span)), bool(I.CARD_SHAPE.fullmatch(span)),
        span[0].isspace() or span[-1].isspace(), not (span[0].isalnum() or span[0] in "+("), not span[-1].isalnum(),
        before.isalnum() or before in ("-", ".", "@", "_", "+") and before != "", after.isalnum() or after in ("-", "@", "_") and after != "",
        *[bool(p.search(cue)) for p in (I.PHONE_CUE, I.MAIL_CUE, I.CARD_CUE, I.IP_CUE)],
        "@" in span, "\n" in span, others / len(span), len(span) > 40, n > 19, 0 < n < 7, after == "." and text[hi + 1 : hi + 2].isdigit(), len(groups) == 4, "  " in span,
    ]
    return np.array(f, float)


TEXTS = [
    "call: 001 234 567 8901, e-mail: jo_1 [at] mail.example  dot org\nhost 10 dot 20 dot 30 dot 40.5 +é (234) 555-0199 card 4111/1111/1111/1111 AT x@y.z",
    "1234 5678 9012 3456 " * 3 + "ü  99.1.2.3   ١٢٣ aT 𝟙𝟚 fax. 5",
]


@pytest.mark.parametrize("block", [1, 5, 512])
def test_features_from_prefix_sums_are_those_of_the_definition(block):
    for text in TEXTS:
        starts, ends = I.tokens(text, 0, len(text))
        for first in range(0, len(starts), block):
            x, ok = I.segment_features(text, starts, ends, first, min(len(starts), first + block))
            for i, k in zip(*np.nonzero(ok)):
                end = first + i
                want = plain_features(text, int(starts[end - k]), int(ends[end]))
                assert x[i, k].tolist() == want.tolist(), text[starts[end - k] : ends[end]]
            assert not x[~ok].any()


def test_blocks_give_the_segmentation_of_the_whole(monkeypatch):
    w = np.random.default_rng(5).normal(size=(1 + len(I.KINDS), I.FEATURES))
    text = " ".join(TEXTS) * 3
    whole = I.decoded(text, 3, len(text) - 2, w)
    monkeypatch.setattr(I, "BLOCK_TOKENS", 7)
    assert len(whole) > 10 and I.decoded(text, 3, len(text) - 2, w) == whole


def test_a_table_of_a_million_characters_takes_bounded_memory():
    rng = random.Random(1)
    table = " ".join(str(rng.randint(1000, 9999)) for _ in range(200_000))
    w = I.train([])
    I.added_spans(table[:5000], w, I.base_spans(table[:5000]))
    tracemalloc.start()
    began = time.time()
    base = I.base_spans(table)
    I.added_spans(table, w, base)
    took, (_, most) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 150e6 and took < 400  # traced; 3 GB and 10 minutes when the whole window was held


def test_base_spans_that_meet_a_stretch():
    rng = random.Random(3)
    spans = sorted((a, a + rng.randint(1, 30), "ip") for a in (rng.randint(0, 300) for _ in range(40)))
    cover = I.Cover(spans)
    for _ in range(300):
        lo = rng.randint(0, 320)
        hi = lo + rng.randint(1, 20)
        want = [s for s in spans if s[0] < hi and s[1] > lo]
        assert cover.meeting(lo, hi) == want and cover.meets(lo, hi) == bool(want)
    assert I._blank("abcdefghij", 1, 9, [(0, 3, "ip"), (2, 5, "ip"), (8, 12, "ip")]) == "\0\0\0\0fgh\0"


def test_training_takes_a_window_of_an_id_that_repeats(spark):  # noqa: F811
    rows = [(1, f"write to jo{i}@mail.example.com " + "long " * 5000) for i in range(400)] + [(2, None), (3, ""), (4, "reach hannah [at] quietmail [dot] org")]
    got = I.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r["n_email"] for r in got) == 400
    assert {r["doc_id"]: r["spans"] for r in got}[4] == "email:6:37"
    words, window, lo, hi, kind = I.example_of(rows[0][1])
    assert len(words) <= I.SAMPLE_WORDS and window[lo:hi] == "jo0@mail.example.com" and kind == 1 and len(window) <= I.WINDOW_LETTERS
    assert I.example_of("x" * 10_000 + "@" + "y" * 10_000 + ".com")[1] is None and I.example_of(None) == ([], None, 0, 0, 0)


# ------------------------------------------------------------------ 8
def test_an_id_with_two_texts_trains_on_the_same_one_in_any_order(spark):  # noqa: F811
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "reader", "finds", "a", "plain", "story."]) for _ in range(60))
    bad = lambda: "!!" * rng.randint(20, 60)
    rows = [(i, good() if i % 2 else bad()) for i in range(60)] + [(i, bad() if i % 2 else good()) for i in range(0, 60, 3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [C.fit_quality(spark.createDataFrame(order, "doc_id long, text string").repartition(parts), labels) for order, parts in ((rows, 1), (rows[::-1], 5))]
    probe = np.array([C.statistics(t) for _, t in rows], float)
    assert np.array_equal(models[0].probability(probe), models[1].probability(probe))


# ------------------------------------------------------------------ 7
def test_star_rounds_end_when_they_link_and_close_little(spark, monkeypatch):  # noqa: F811
    rng = random.Random(4)
    # few kinds of shingles in long lists, hardly any two sets alike, and some near copies
    rows = [(i, " ".join(rng.choice("ab") for _ in range(24))) for i in range(250)]
    rows += [(1000 + i, rows[i][1] + " c") for i in range(0, 250, 50)]
    rounds, linked = [], J._linked
    monkeypatch.setattr(J, "_linked", lambda *a: rounds.append(1) or linked(*a))
    monkeypatch.setattr(J, "OPEN_PAIRS", 0)
    got = J.jaccard_components(docs_of(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute_components(rows)
    assert len(rounds) < J.STAR_ROUNDS


def test_few_counted_rows_take_few_tasks(spark):  # noqa: F811
    session = spark.newSession()
    for name, value in (("spark.sql.shuffle.partitions", "64"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        session.conf.set(name, value)
    edges = session.createDataFrame([(k, k + 1) for k in range(0, 400) if k % 20], "u long, v long")
    labels = K.components(edges)
    assert len(labels.inputFiles()) <= 8
    assert sorted(map(tuple, labels.collect())) == [(k, (k - 1) // 20 * 20 + 1) for k in range(1, 401)]


# ------------------------------------------------------------------ 9
def test_near_notices_cost_in_proportion():
    took = []
    for n in (1000, 10_000):
        text = "all right reserved " * n
        began = time.time()
        spans = L.fuzzy_spans(text.strip())
        took.append(time.time() - began)
        assert len(spans) == n and {e for *_, e in spans} == {1}
    assert took[1] < 40 * took[0] + 1


def test_notices_are_an_argument_and_rows_repeat(spark):  # noqa: F811
    rows = [(1, "do not coppy this text"), (1, "do not coppy this text"), (None, "Do NOT copy, this text"), (2, None)]
    own = (("do not copy this text", "mine"),)
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), notices=own).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], [s["edits"] for s in r["spans"]]) for r in got) == [(0, "mine", [0]), (1, "mine", [1]), (1, "mine", [1]), (2, "", [])]


# ------------------------------------------------------------------ 10
def test_bins_do_not_follow_the_partitions(spark):  # noqa: F811
    rng = random.Random(6)
    rows = [(100 + i if i % 9 else None, " ".join(["w"] * rng.randint(0, 90)), f"s{rng.randint(0, 5)}") for i in range(400)]
    rows += [(7, "again and again", "s1")] * 40 + [(8, " ".join(["w"] * 130), "s2")] * 3
    seen = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        out = P.pack(docs, capacity=64, shard_rows=64).collect()
        seen.append(sorted(map(str, out)))
        assert len({r["bin_id"] for r in out if r["doc_id"] == 7}) == 40 and sum(r["doc_id"] == 8 for r in out) == 9
    assert seen[0] == seen[1]
