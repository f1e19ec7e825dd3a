"""The training-text operators against brute force on small fixtures, with the awkward rows in each."""

import base64
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from assayflow.llm import classifier as C
from assayflow.llm import decontaminate as D
from assayflow.llm import jaccard as J
from assayflow.llm import language_model as L
from assayflow.llm import licenses as S
from assayflow.llm import packing as P
from assayflow.llm import personal_data as I
from assayflow.llm import perspectives as V
from assayflow.llm import warc_index as W
from assayflow.llm.exact_dedup import exact_dedup

from ..conftest import spark  # noqa: F401

DOCS = "doc_id long, text string, source string, best string, key string, digest string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def docs_of(spark, rows):  # noqa: F811
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, f"s{k % 3}", "x", "y", "z") for k, (i, t) in enumerate(rows)], DOCS)


def by_id(frame):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


# ------------------------------------------------------------------ 1
PAGES = [(3, "http://A.example.org/x?q=1#f", "<p>é</p>"), (1, "http://a.example.org:80/x?q=1", "<p>é</p>"), (1, "http://a.example.org/x?q=1", "<p>é</p>"),
         (2, None, None), (5, "no host", ""), (None, "http://b.example.org", "b\r\n\r\nWARC/1.1\r\n"), (7, "http://b.example.org/", "z" * 300_000)]


@pytest.mark.parametrize("least", [0, 1])
def test_archives_round_trip(spark, least):  # noqa: F811
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, key string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.write_and_read_back(pages, least_bytes=least).collect())
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        again = len(data) >= least and page_id != first
        want.append((str(page_id), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want)


def test_index_lookup_reads_keys_over_many_blocks(spark):  # noqa: F811
    rows = [(i, "http://hot.example.org/a" if i % 3 else f"http://h{i % 7}.example.org/{i}", f"page {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = W.write_archives(pages, block_lines=4)
    keys = spark.createDataFrame([("org,example,hot)/a",), ("org,example,h3)/3",), ("org,none)/",), (None,)], "k string")
    got = W.lookup(files, keys, with_payload=True).collect()
    assert sorted(r["page_id"] for r in got) == sorted([i for i, u, _ in rows if "hot" in u] + [3])
    assert all(bytes(r["payload"]).decode() == f"page {r['page_id']}" for r in got)


def test_archives_of_no_pages(spark):  # noqa: F811
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.write_and_read_back(pages).collect() == []


# ------------------------------------------------------------------ 2
def test_language_model_counts_and_normalisation(spark):  # noqa: F811
    rows = [(i, " ".join(f"v{(i * j) % 13}" for j in range(40)) + " The END") for i in range(30)] + [(100, None), (101, ""), (102, "never Seen\tbefore"), (102, "never Seen\tbefore"), (None, "v1 v2")]
    got = L.score_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    words = lambda t: (t or "").encode().lower().split()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = {}
    train = [t for i, t in rows if not fold(i)]
    for t in train:
        for w in [*words(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), fold(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), n, round(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_log_bilinear_table_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    codes = np.array([(a * L.CLASSES + b) * L.CLASSES + (b + 1) % 8 for a in range(8) for b in range(8)])
    counts = rng.integers(50, 100, len(codes))
    unigram = np.full(L.CLASSES, 0.5)
    np.add.at(unigram, codes % L.CLASSES, counts)
    unigram /= unigram.sum()
    table = L.log_table(L.train(codes, counts, unigram, steps=300))
    assert np.allclose((10 ** table.reshape(-1, L.CLASSES).astype(float)).sum(1), 1, atol=1e-4)
    assert table[codes].mean() > np.log10(unigram[codes % L.CLASSES]).mean() + 0.5


def test_language_model_beats_the_base_on_held_out_documents(spark):  # noqa: F811
    got = L.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_language_model_of_no_documents(spark):  # noqa: F811
    assert L.score_documents(docs_of(spark, [])).collect() == []


# ------------------------------------------------------------------ 3
def brute_tiles(item, doc, least):
    """Greedy string tiling by full scans: always the longest common run of unmarked words."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return out
        free_i[i : i + n], free_d[d : d + n] = [False] * n, [False] * n
        out.append((i, d, n))


@pytest.mark.parametrize("seed", range(12))
def test_tiling_covers_as_much_as_the_full_scan(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 6, 40).astype(np.uint64)
    doc = rng.integers(0, 6, 90).astype(np.uint64)
    for at in rng.integers(0, 30, 3):
        doc[at * 2 : at * 2 + 12] = item[at : at + 12][:12] if at + 12 <= 40 else doc[at * 2 : at * 2 + 12]
    got, want = D.tiles(item, doc, 4), brute_tiles(item.tolist(), doc.tolist(), 4)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
    for i, d, n in got:
        assert (item[i : i + n] == doc[d : d + n]).all()
    for k in (0, 1):
        marks = [x for t in got for x in range(t[k], t[k] + t[2])]
        assert len(marks) == len(set(marks))


def test_leaks_are_found_whole_and_reordered(spark, monkeypatch):  # noqa: F811
    item = [f"q{i}" for i in range(30)]
    turned = item[20:] + ["x"] + item[10:20] + ["y"] + item[:10]
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, other + " " + " ".join(item).upper() + ". end"), (2, " ".join(turned) + " " + other), (3, " ".join(item[:15])), (4, None), (5, ""), (6, LONG), (6, LONG), (7, "short one, here!")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, " ".join(item)), (5, "Short one")], "item_id long, text string")
    docs = docs_of(spark, rows)
    want = [(1, 1), (1, 4), (2, 1), (2, 4), (7, 5)]
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()) == want
    assert sorted(r["doc_id"] for r in D.drop_leaking(docs, bench).collect()) == [3, 4, 5, 6, 6]
    monkeypatch.setattr(D, "BLOCK_WORDS", 10)  # the benchmark in several blocks
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()) == want
    assert D.find_leaks(docs, bench.limit(0)).collect() == [] and D.find_leaks(docs_of(spark, []), bench).collect() == []


# ------------------------------------------------------------------ 4
def test_perspectives_of_many_people(spark, monkeypatch):  # noqa: F811
    turns = [("a", 0, "system", "be kind"), ("a", 1, "ann", "hi <|assistant|>"), ("a", 2, "bob", None), ("a", 2, None, "?"), ("b", 0, "system", "alone"), (None, 1, "cy", "x"), ("a", 3, "ann", "bye"), ("a", 3, "ann", "bye")]
    frame = spark.createDataFrame([(*t, "p") for t in turns], "conv_id string, turn int, role string, text string, part string")
    for size in (256, 2):
        got = V.rotate_perspectives(frame, max_turns=size).collect()
        assert {(r["conv_id"], r["perspective"]) for r in got} == {("a", "ann"), ("a", "bob"), ("a", "unknown"), (None, "cy")}
        own = {}
        for r in sorted(got, key=lambda r: r["part"]):
            own.setdefault((r["conv_id"], r["perspective"]), []).extend(r["rendered"][s["start"] : s["end"]] for s in r["mask"])
            assert r["n_own"] == len(r["mask"]) == r["rendered"].count("<|assistant|>\n") and r["rendered"].count("<|end|>\n") == r["n_turns"] <= size
        assert own[("a", "ann")] == ["hi < |assistant|><|end|>\n", "bye<|end|>\n", "bye<|end|>\n"]
        assert own[("a", "bob")] == ["<|end|>\n"] and own[("a", "unknown")] == ["?<|end|>\n"]
    whole = {r["perspective"]: r["rendered"] for r in V.rotate_perspectives(frame).filter("conv_id = 'a'").collect()}
    assert whole["bob"].startswith("<|system|>\nbe kind<|end|>\n<|user:ann|>\nhi ")
    assert V.rotate_perspectives(frame.limit(0)).collect() == []


# ------------------------------------------------------------------ 5
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


@pytest.mark.parametrize("seed", range(200))
def test_base_spans_match_the_plain_patterns(seed):
    rng = np.random.default_rng(seed)
    bits = ["a", "b.c", "@", "x@y.z", "1.2.3.4", "+1 ", "4111111111111111", "4111-1111 1111 1111", " ", "-", ".", "é", "255", "300", "()", "+", "9" * 25, "0123"]
    text = "".join(rng.choice(bits, 14))
    assert I.base_spans(text) == brute_spans(text)


def test_personal_data_adds_variants_and_leaves_plain_text_alone(spark):  # noqa: F811
    rows = [(1, "write to jo.smith@mail.example.com or +1 (234) 555-0199 now"), (2, "please reach hannah [at] quietmail [dot] org for details"), (3, "the chapter has 12 parts and 2024 pages, 3.14 or so"), (4, None), (5, ""), (6, LONG), (None, "ip 10.0.0.1 x")]
    got = by_id(I.find_personal_data(docs_of(spark, rows)))
    assert [r["n_email"] for r in got] == [1, 0, 0, 0, 0, 0, 0] and [r["n_phone"] for r in got] == [1, 0, 0, 0, 0, 0, 0] and got[-1]["n_ip"] == 1
    assert got[1]["spans"] == "email:13:44" and [r["spans"] for r in got[2:6]] == [""] * 4
    for r, (_, text) in zip(got, rows):
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_spans(text or ""))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_semi_markov_search_is_the_best_of_all_segmentations():
    window = I.Window("a 1-2 b", 0, 7)
    w = np.random.default_rng(3).normal(size=(1 + len(I.KINDS), I.FEATURES))
    s, n = window.scores(w), len(window.spans)

    def all_segmentations(i):
        if i == n:
            yield 0.0, []
            return
        for length, kind in itertools.product(range(1, n - i + 1), range(s.shape[2])):
            own = s[i + length - 1, length - 1, kind]
            if np.isfinite(own):
                for total, rest in all_segmentations(i + length):
                    yield own + total, ([(window.spans[i][0], window.spans[i + length - 1][1], kind)] if kind else []) + rest

    every = list(all_segmentations(0))
    assert window.best(w) == max(every, key=lambda x: x[0])[1]
    gold = [(2, 5, 1)]
    numeric = np.zeros_like(w)
    value = lambda u: _likelihood(window, u, gold)
    for k, f in [(0, 0), (1, 0), (1, 7), (2, 6)]:
        step = np.zeros_like(w)
        step[k, f] = 1e-5
        numeric[k, f] = (value(w + step) - value(w - step)) / 2e-5
        assert window.gradient(w, gold)[k, f] == pytest.approx(numeric[k, f], abs=1e-4)


def _likelihood(window, w, gold):
    s, n = window.scores(w), len(window.spans)
    a = np.full(n + 1, -np.inf)
    a[0] = 0
    for i in range(n):
        for length in range(1, i + 2):
            a[i + 1] = np.logaddexp(a[i + 1], np.logaddexp.reduce(s[i, length - 1]) + a[i + 1 - length])
    begin, end = [x[0] for x in window.spans], [x[1] for x in window.spans]
    total, covered = 0.0, set()
    for lo, hi, kind in gold:
        i, j = begin.index(lo), end.index(hi)
        total += s[j, j - i, kind]
        covered |= set(range(i, j + 1))
    return total + sum(s[i, 0, 0] for i in range(n) if i not in covered) - a[n]


def test_every_written_form_lies_in_a_window():
    rng = np.random.default_rng(77)
    forms = [span for span, kind in (I._variants(rng) for _ in range(1500)) if kind]
    forms += ["bob at mail.example dot com", "bob at mail.example.com", "bob At example Dot org", "bob @ mail.example.com", "bob@mail dot com", "a-b  at  c [dot] org"]
    forms += ["10{dot}20{dot}30{dot}40", "10 Dot 20 Dot 30 Dot 40", "10 {.} 20 {.} 30 {.} 40"]
    for span in forms:
        left = "please send the word about it to "
        text = left + span + " and the rest of this text"
        assert any(lo <= len(left) and len(left) + len(span) <= hi for lo, hi in I.windows(text)), span
    for plain in ("jo@mail.example.com", "arrive at 5.30 pm", "look at it. Then go", "no dot here"):
        assert I.windows(plain) == []


def test_planted_cards_and_ips_are_returned(spark):  # noqa: F811
    planted = [("card", "4123/4567/8901/2349"), ("card", "4123_4567_8901_2349"), ("ip", "10 dot 20 dot 30 dot 40"), ("ip", "10{dot}20{dot}30{dot}40")]
    left = "please ask for "
    got = by_id(I.find_personal_data(docs_of(spark, [(i, f"{left}{x} now and then") for i, (_, x) in enumerate(planted)])))
    assert [r["spans"] for r in got] == [f"{k}:{len(left)}:{len(left) + len(x)}" for k, x in planted]


# ------------------------------------------------------------------ 6
@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup_against_brute_force(spark, keep, fan_in):  # noqa: F811
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (102, LONG), (103, LONG), (103, LONG), (None, "text 1"), (None, "only null"), (104, "Text 1")]
    got = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in exact_dedup(docs_of(spark, rows).repartition(9), keep=keep, fan_in=fan_in).collect())
    want = []
    for i, t in rows:
        group = [j for j, u in rows if (u or "") == (t or "")]
        best = {"min": min, "max": max}[keep]((j for j in group if j is not None), default=None)
        want.append(str((i, best, len(group), i == best, hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(want)
    assert exact_dedup(docs_of(spark, [])).collect() == []


# ------------------------------------------------------------------ 7
def brute_components(rows, width=5, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if rows[a][0] is not None and rows[b][0] is not None and (rows[a][0] == rows[b][0] and x and y or x and y and 100 * len(x & y) >= percent * len(x | y)):
            old, new = label[b], label[a]
            label = [new if k == old else k for k in label]
    out = []
    for k, (i, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and sets[j]]
        out.append((i, len(sets[k]), i if not sets[k] or i is None else min(m for m in members if m is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("star_rounds, entry_cost", [(0, 4.0), (3, 4.0), (3, 500.0)])
def test_jaccard_components_against_brute_force(spark, monkeypatch, star_rounds, entry_cost):  # noqa: F811
    monkeypatch.setattr(J, "STAR_ROUNDS", star_rounds)
    monkeypatch.setattr(J, "ENTRY_COST", entry_cost)  # dear entries: more sets enumerate subsets
    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 3, 5, 7, 8, 9, 10, 12, 16, 25, 60, 200):
        base = [f"b{size}x{j}" for j in range(size)]
        for _ in range(9):
            words = list(base)
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(words) + 1))
                words[k : k + int(rng.integers(0, 2))] = [f"n{rng.integers(0, 99)}"] if rng.random() < 0.7 else []
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    passage = " ".join(f"p{j}" for j in range(60))
    rows += [(2000 + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(12))) for i in range(40)]
    rows += [(3000 + i, passage + " " + " ".join(f"z{i}x{j}" for j in range(40))) for i in range(20)]
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, LONG), (5004, LONG + " more"), (5003, LONG), (None, LONG), (5005, "one word"), (5006, "ONE  word"), (6000, "id twice a b c d"), (6000, "other text of it here now"), (6001, "other text of it here now")]
    # ids with two texts, of which either one or the other is a near copy of other rows
    rows += [(6010 + i % 3, f"r{i} " + " ".join(f"two{i // 3}x{j}" for j in range(30))) for i in range(6)]
    rows += [(6020 + i, f"q{i} " + " ".join(f"two{i}x{j}" for j in range(30))) for i in range(2)]
    got = J.jaccard_components(docs_of(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute_components(rows)


def test_an_id_with_a_copied_and_a_near_copied_text_keeps_both_links(spark):  # noqa: F811
    one, other = " ".join(f"one{j}" for j in range(40)), " ".join(f"other{j}" for j in range(40))
    rows = [(10, one), (11, one), (11, other), (12, other + " end"), (13, one), (14, "alone in all of this"), (15, one), (15, "")]
    got = J.jaccard_components(docs_of(spark, rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute_components(rows)


def test_exact_copies_go_row_by_row(spark):  # noqa: F811
    import corpus_pipeline as CP

    rows = [(1, "a"), (2, "a"), (1, "only here"), (2, "c"), (3, "c"), (4, None), (5, ""), (6, "d"), (6, "d"), (None, "a"), (None, "e")]
    got = sorted(((r["doc_id"], r["text"]) for r in CP.drop_exact(spark, docs_of(spark, rows), "").collect()), key=str)
    assert got == sorted([(2, "a"), (1, "only here"), (3, "c"), (5, ""), (6, "d"), (6, "d"), (None, "e")], key=str)


def test_bitmaps_never_say_more_than_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 400, 3000):
        for gone in (0, 1, n // 10, n):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            y = np.concatenate([x[gone:], rng.integers(0, 2**63, n // 10).astype(np.uint64)])
            apart = sum(int(v).bit_count() for v in (J.parity(x) ^ J.parity(y)).view(np.uint64))
            assert apart <= len(np.setxor1d(x, y))
            assert len(J.parity(x)) == J.BITMAP


def test_light_boundary_follows_the_cost(monkeypatch):
    sizes = {n: 100 for n in range(1, 25)}
    assert J.light_boundary({}) == 0
    low = J.light_boundary(sizes)
    monkeypatch.setattr(J, "ENTRY_COST", 500.0)
    assert low < 9 <= J.light_boundary(sizes) <= J.LIGHT_MAX


def test_jaccard_of_no_documents(spark):  # noqa: F811
    assert J.jaccard_components(docs_of(spark, [])).collect() == []


# ------------------------------------------------------------------ 8
def test_quality_on_held_out_documents(spark):  # noqa: F811
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = C.classify_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert right >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_of_awkward_rows(spark):  # noqa: F811
    docs = docs_of(spark, [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "a b"), (4, "A!! B!!")])
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (4, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = C.classify_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    none = C.classify_quality(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1 and C.classify_quality(docs.limit(0), labels).collect() == []


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(C.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = C.fit(x, y, trees=20)

    def walk(row, at):
        while model.feature[at] >= 0:
            at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
        return model.value[at]

    want = [model.base + sum(walk(r, k) for k in model.roots) for r in x[:50]]
    assert np.allclose(model.margin(x[:50]), want)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95


# ------------------------------------------------------------------ 9
def test_license_places_against_brute_force(spark):  # noqa: F811
    texts = ["Released under the MIT License.", "MIT-LICENSE mit license; CC BY CC by cc-by", "xmit license", "gnu general  public\nlicense apache license", None, "", LONG, "é mit license é", "Licensd under the Apache Licence, Version 2.0"]
    got = by_id(S.scan_licenses(docs_of(spark, list(enumerate(texts)))))
    for r, text in zip(got, texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        places, labels = [], set()
        for phrase, label in S.PHRASES:
            p = phrase.decode().split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[-1]["labels"] == "apache" and got[-1]["spans"][0]["edits"] in (2, 3) and got[6]["labels"] == ""
    assert S.scan_licenses(docs_of(spark, [])).collect() == []


def test_candidates_miss_no_bounded_error_match():
    import regex

    rng = np.random.default_rng(4)
    for notice, label in S.NOTICES:
        k = S.edits_allowed(notice)
        for _ in range(10):
            text = list(notice)
            for _ in range(int(rng.integers(0, k + 1))):
                at = int(rng.integers(0, len(text)))
                text[at : at + int(rng.integers(0, 2))] = rng.choice(list("abc"), int(rng.integers(0, 2))).tolist()
            plain = "zz " + "".join(text) + " yy"
            if regex.search(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])", plain):
                assert label in {x[2] for x in S.fuzzy_spans(plain)}


def test_notices_before_and_behind_a_better_one_are_kept():
    every = lambda text: [text[a:b] for a, b, _, _ in S.fuzzy_spans(text)]
    near, exact = "all right reserved", "all rights reserved"
    assert every(f"{near} {exact}") == [near, exact]
    assert every(f"{near} {exact} {near} {exact} {near}") == [near, exact, near, exact, near]
    assert every("mozilla public licence mozilla public license") == ["mozilla public licence", "mozilla public license"]


# ------------------------------------------------------------------ 10
def check_bins(pieces, capacity):
    bins = {}
    for r in pieces:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        assert sum(r["n_tokens"] for r in own) <= capacity
        spans = sorted((r["bin_offset"], r["n_tokens"]) for r in own)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
        for c in ("source", "cluster"):
            values = [r[c] for r in own if r[c] is not None]
            assert len(values) == len(set(values))


def test_packing_is_whole_and_free_of_conflicts(spark):  # noqa: F811
    rows = [(i, " ".join(["w"] * (i * 37 % 90)) + f" u{i % 11}") for i in range(200)] + [(500, None), (501, ""), (502, " ".join(["x"] * 350)), (502, " ".join(["x"] * 350)), (None, "a b c"), (503, " ".join(["y"] * 200))]
    docs = docs_of(spark, rows)
    pieces = [r.asDict() for r in P.pack(docs, capacity=100, shard_rows=64).collect()]
    check_bins(pieces, 100)
    want = sorted(str((i, s, min(100, n - s))) for i, t in rows for n in [len((t or "").split())] for s in (range(0, n, 100) if n else [0]))
    assert sorted(str((r["doc_id"], r["start_token"], r["n_tokens"])) for r in pieces) == want
    assert P.pack(docs.limit(0)).collect() == []


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(8)
    bins, plain = P.Bins(50), []
    for _ in range(300):
        n, s, c = int(rng.integers(0, 40)), 1 << int(rng.integers(0, 6)), 1 << int(rng.integers(0, 30))
        fits = [(b["left"], k) for k, b in enumerate(plain) if b["left"] >= n and not b["s"] & s and not b["c"] & c]
        k = min(fits)[1] if fits else len(plain)
        if not fits:
            plain.append({"left": 50, "s": 0, "c": 0})
        assert bins.place(n, s, c) == (k, 50 - plain[k]["left"])
        plain[k] = {"left": plain[k]["left"] - n, "s": plain[k]["s"] | s, "c": plain[k]["c"] | c}


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages_against_brute_force(spark, tmp_path):  # noqa: F811
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k == 4:
            break
        assert out.columns == names
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        if k == 0:
            want = {r["doc_id"] for r in C.classify_quality(docs, labels).collect() if r["predicted"] == 1}
        elif k == 1:
            want = {max(i for i, t in before.items() if t == text) for text in before.values()}
        elif k == 2:
            want = {c for _, _, c in brute_components(sorted(before.items()))}
        else:
            words = {i: set(zip(*[t.encode().translate(D.PLAIN_WORDS).split()[j:] for j in range(5)])) for i, t in before.items()}
            clean = set()
            for i, own in words.items():
                hit = False
                for _, text in bench:
                    w = text.encode().translate(D.PLAIN_WORDS).split()
                    seen = {p for s in range(len(w) - 4) if tuple(w[s : s + 5]) in own for p in range(s, s + 5)}
                    hit |= len(seen) >= D.COVERAGE * len(w)
                if not hit:
                    clean.add(i)
            want = clean
        assert set(kept) == want
        before, docs = kept, out
    pieces = [r.asDict() | {"cluster": None} for r in out.collect()]
    check_bins(pieces, P.CAPACITY)
    assert {r["doc_id"] for r in pieces} == set(before)
    assert sum(r["n_tokens"] for r in pieces) == sum(len(t.split()) for t in before.values())
    assert [r["doc_id"] for r in pipeline.run(spark, sf).select("doc_id").orderBy("doc_id", "piece").collect()] == sorted(r["doc_id"] for r in pieces)
