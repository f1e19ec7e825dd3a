"""Sequence packing, ranked lexical search and conversation repair against brute force, with awkward rows."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assayflow.llm import conversation_repair as R
from assayflow.llm import lexical_search as X
from assayflow.llm import sequence_packing as Q

from ..conftest import spark  # noqa: F401

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
DOCS = "doc_id long, text string, ids string, n string, kind string"


def docs_of(spark, rows):  # noqa: F811
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


# ------------------------------------------------------------------ 11
@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.public_path("byte_bpe_50k.json"))


def reference_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(pieces, docs, capacity):
    """Every id of every row in one piece, sequences gapless, padding only at powers of two."""
    want = Counter((i, tuple(reference_ids(t))) for i, t in docs)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for (doc_id, ids), times in want.items():
        raw = np.array(ids, "<u4").tobytes()
        own = by_doc[doc_id, len(ids)]
        mine = [p for p in own if zlib.crc32(raw[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]]
        cover = Counter(k for p in mine for k in range(p["start"], p["start"] + p["length"]))
        assert set(cover) == set(range(len(ids))) and all(n >= times for n in cover.values())
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    padded = 0
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])), key=lambda p: p["sequence_id"]):
        at = 0
        for p in group:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 or at == capacity else capacity - at
    assert padded == 0


AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, "a<|endoftext|>b"), (5, "𐵀 new letters ͏ é"), (6, LONG), (7, "same"), (7, "same"), (7, "other"), (None, "same"), (None, None), (8, "don't  stop\n\n now")]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip_and_partitions(spark, capacity):  # noqa: F811
    rng = random.Random(5)
    rows = AWKWARD + [(100 + i, " ".join(rng.choice(["alpha", "beta", "x1", "Zürich", "!?"]) for _ in range(rng.randint(1, 90)))) for i in range(150)]
    seen = []
    for parts in (1, 7):
        got = [r.asDict() for r in Q.pack_sequences(docs_of(spark, rows).repartition(parts), capacity=capacity, bucket_ids=5000).collect()]
        check_packing(got, rows, capacity)
        seen.append(sorted(tuple((x is None, x or 0) for x in r.values()) for r in got))
    assert seen[0] == seen[1]


def test_packing_of_nothing(spark):  # noqa: F811
    assert Q.pack_sequences(docs_of(spark, [])).collect() == []


def test_every_character_gets_the_tokenizers_ids():
    coder = Q.Encoder("byte_bpe_50k")
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}{c}1{c} {c}. {c}b{c}" for c in chars[k : k + 64]) for k in range(0, len(chars), 64)]
    texts += [" " * 1_500_000 + "x", "\n \t" * 2000, "a" * 20_000, "''s don't DON'T"]
    assert all(coder.encode(t) == np.array(reference.ids, "<u4").tobytes() for t, reference in zip(texts, coder.tokenizer.encode_batch(texts, add_special_tokens=False)))


def test_patterns_place_every_rank_once():
    rng = random.Random(2)
    for capacity, n in ((16, 40), (64, 500), (100, 300), (2048, 3000)):
        histogram = Counter(rng.randint(1, capacity - 1) for _ in range(n))
        where = Q.plan(dict(histogram), capacity, 0)
        held, cuts = {}, 0
        for length, c in histogram.items():
            for rank in range(c):
                parts = where.of(length, rank)
                assert sum(p[1] for p in parts) == length and [p[0] for p in parts] == [0, *itertools.accumulate(p[1] for p in parts)][:-1]
                cuts += len(parts) > 1
                for _, size, sequence, offset in parts:
                    held.setdefault(sequence, []).append((offset, size))
        assert sorted(held) == list(range(len(held)))
        assert all(sorted(v)[0][0] == 0 and sum(s for _, s in v) == max(o + s for o, s in v) <= capacity for v in held.values())
        assert len(held) <= -(-sum(k * c for k, c in histogram.items()) // capacity) + capacity.bit_length()
        assert cuts < n


def test_shortest_pack_is_filled_first():
    patterns = Q.shortest_pack_first({7: 2, 5: 1, 3: 2, 2: 1}, 10)
    assert sorted((p.count, tuple(x.length for x in p.parts)) for p in patterns) == [(1, (5, 3)), (1, (7, 2)), (1, (7, 3))]


def test_many_pieces_need_few_patterns():
    few = Q.plan({k: 100 + k for k in range(1, 2048)}, 2048, 0)
    many = Q.plan({k: 100_000_000 + k for k in range(1, 2048)}, 2048, 0)
    size = lambda w: sum(map(len, w.starts.values()))
    assert size(many) < 20 * size(few)


# ------------------------------------------------------------------ 12
def brute_search(docs, items, top):
    terms = lambda t: [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if absent else i, -s) for k, (s, absent, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [7, 200_000])
def test_search_equals_brute_force(spark, monkeypatch, block_terms):  # noqa: F811
    monkeypatch.setattr(X, "BATCH_DOCS", 40)
    rng = random.Random(9)
    word = lambda: f"t{min(int(rng.expovariate(0.05)), 120)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(250)]
    docs += [(300 + i, "T1 t2, t3 É") for i in range(60)] + [(7, "t1 t2"), (7, "t1 t2"), (None, "t1 t2"), (None, "t5"), (400, None), (401, ""), (402, "?! \n"), (403, LONG)]
    items = [(1, "t1 t2 t3 é t3"), (2, " ".join(f"t{i}" for i in range(100))), (3, None), (4, "nowhere"), (5, "T90 w5"), (5, "t2"), (None, "t4 t7 t100"), (6, "t1")]
    got = X.search(docs_of(spark, docs).repartition(3), spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, size string"), top=20, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 20)


def test_search_of_nothing(spark):  # noqa: F811
    some = docs_of(spark, [(1, "a")])
    for docs, items in ((some, docs_of(spark, [])), (docs_of(spark, []), some), (docs_of(spark, [(1, None)]), some)):
        assert X.search(docs, items, item_col="doc_id").collect() == []


def test_masks_below_the_kth_score_are_not_evaluated():
    rng = np.random.default_rng(3)
    lengths = np.full(2000, 5)
    terms = np.concatenate([np.sort(rng.choice(70, 5, replace=False)) for _ in range(2000)]).astype(np.int32)
    weights = np.arange(1, 71) ** 3
    batch = X.Postings(list(range(2000)), np.full(2000, 50), lengths, terms, np.ones(len(terms), np.int32), weights, 2000, 100_000)
    member, best = np.ones(70, bool), X.Best(10)
    seen = X.search_batch(batch, np.arange(70), member, best)
    whole = batch.exact(np.arange(2000), member)
    assert seen < 400
    assert best.score.tolist() == sorted(whole.tolist(), reverse=True)[:10]


# ------------------------------------------------------------------ 13
def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows):
    """Dynamic programming over whole audit strings of each conversation, from the front."""
    convs = {r[0] for r in rows}
    out = []
    for conv in convs:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            shown = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        close = lambda ways: {q: min(w for p, w in more if p == q) for q in {p for p, _ in more}} if (more := inserted(ways)) else {}

        def inserted(ways):
            found = list(ways)
            for _ in range(3):
                found += [(follow[q, r], (c + 2, a + "I", said + [f"{n}:"])) for q, (c, a, said) in found for r, n in (("u", "user"), ("a", "assistant")) if (q, r) in follow]
            return found

        states = close([(0, (0, "", []))])
        for (_, _, role, text), fault in zip(own, faults):
            more, ways = fault == "truncated", []
            for q, (c, a, said) in states.items():
                ways.append((q, (c + 3, a + "D", said)))
                if fault in ("", "truncated"):
                    for r, n in (("u", "user"), ("a", "assistant")):
                        if (q, r) in follow:
                            ways.append((follow[q, r], (c + 2 + more, a + "R", said + [f"{n}:{text}"])))
                    if (q, role[:1]) in follow:
                        ways.append((follow[q, role[:1]], (c + more, a + "K", said + [f"{role}:{text}"])))
            states = close(ways)
        cost, audit, said = min(states[q] for q in (0, 3) if q in states)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def chats(seed, n, turns):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, turns)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "unknown"], [8, 8, 2, 1, 1, 1, 1])[0]
            text = rng.choices(["Hello.", "Yes!", "cut off", "é?", " \n", None, "tail. \t", "Hello."], [6, 4, 2, 2, 1, 1, 2, 3])[0]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


CHATS = "conv_id long, turn long, role string, text string, place string, fault string"


def chat_frame(spark, rows):  # noqa: F811
    return spark.createDataFrame([(*r, "x", "y") for r in rows], CHATS)


@pytest.mark.parametrize("block, fan", [(256, 64), (4, 2)])
def test_repair_equals_brute_force(spark, monkeypatch, block, fan):  # noqa: F811
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "FAN", fan)
    rows = chats(3, 60, 9) + [(100, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(400)] + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]
    rows += [(101, 0, "user", LONG), (101, 1, "assistant", LONG)]
    rows += [(c, t, "user", "Gone.") for c in range(200, 240) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert any(c >= 200 for c, *_ in rows if c)
    got = R.repair_damaged(chat_frame(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repair(rows)


def test_repaired_rows_read_as_the_grammar_says(spark):  # noqa: F811
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Sure."), (1, 2, "user", "Thanks"), (1, 3, "tool", "Done."), (2, 0, "user", " "), (3, None, "user", "One."), (3, 1, "user", "One.")]
    got = R.repaired_rows(chat_frame(spark, rows)).orderBy("conv_id", "place").collect()
    told = {c: [(r["edit"], r["role"], r["text"]) for r in g] for c, g in itertools.groupby(got, key=lambda r: r["conv_id"])}
    assert told[1] == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Sure."), ("K", "user", "Thanks"), ("R", "assistant", "Done.")]
    assert told[2] == [("D", "", " ")]
    assert told[3] == [("K", "user", "One."), ("D", "", "One."), ("I", "assistant", "")] or told[3] == [("D", "", "One."), ("D", "", "One.")]


def test_repair_of_nothing(spark):  # noqa: F811
    assert R.repair_damaged(chat_frame(spark, [])).collect() == []
    assert R.repaired_rows(chat_frame(spark, [])).collect() == []
