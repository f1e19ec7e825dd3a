"""License notices in documents: exact phrases, and short notices with a bounded number of edits.

The text is reduced to words (ASCII lower-cased, other ASCII than letters and
digits dropped) joined by one blank.  A notice with at most ``k`` edits keeps
at least one of its ``k + 1`` parts unchanged (pigeonhole), so an automaton
over all parts finds every candidate place; there the regex library's
bounded-error matching decides and gives the span and the number of edits.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from assayflow.llm.common import PLAIN_WORDS, encoded, map_columns

# Base phrases (as words) and their labels.
PHRASES = (
    (b"gnu general public license", "gpl"),
    (b"apache license", "apache"),
    (b"cc by", "cc-by"),
    (b"mit license", "mit"),
)

# Short notices (as words) and the labels that they give.
NOTICES = (
    ("this work is licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Letters of a notice for each edit allowed.
LETTERS_PER_EDIT = 12


def edits_allowed(notice: str) -> int:
    return len(notice) // LETTERS_PER_EDIT


def parts(notice: str, k: int) -> list[tuple[int, str]]:
    """(offset, part) of k + 1 parts of almost equal length."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


Notices = tuple[tuple[str, str], ...]


@lru_cache(maxsize=4)
def _search(notices: Notices):
    """The automaton over all parts and the bounded-error pattern of each notice (built once a worker)."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (notice, label) in enumerate(notices):
        k = edits_allowed(notice)
        for at, part in parts(notice, k):
            seeds.setdefault(part, []).append((i, at))
        # best match in the window; the notice begins and ends at a word's edge
        patterns.append((regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])"), k, len(notice), label))
    automaton = ahocorasick.Automaton()
    for part, where in seeds.items():
        automaton.add_word(part, (len(part), where))
    automaton.make_automaton()
    return automaton, patterns


def fuzzy_spans(plain: str, notices: Notices = NOTICES) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of notices in reduced text, in characters of it; overlapping hits of a notice merge to the best.

    Each seed is verified in its own window, as long as the notice and the edits; so the work follows the number of seeds.
    """
    automaton, patterns = _search(notices)
    starts: dict[int, set[int]] = {}
    for end, (length, where) in automaton.iter(plain):
        for i, offset in where:
            starts.setdefault(i, set()).add(end + 1 - length - offset)
    out = []
    for i, own in starts.items():
        pattern, k, size, label = patterns[i]
        hits = set()
        for start in own:
            m = pattern.search(plain, max(0, start - k - 1), min(len(plain), start + size + k + 1))
            if m is not None:
                hits.add((sum(m.fuzzy_counts), m.start(), m.end()))
        kept: list[tuple[int, int]] = []  # disjoint, in order
        for edits, lo, hi in sorted(hits):
            at = bisect_right(kept, (lo, hi))
            if (at == 0 or kept[at - 1][1] <= lo) and (at == len(kept) or kept[at][0] >= hi):
                kept.insert(at, (lo, hi))
                out.append((lo, hi, label, edits))
    return sorted(out)


def scan(text: str | None, notices: Notices = NOTICES) -> dict:
    """All findings in one whole text.

    words, places (start word of each base place), base labels, spans (start word, end word, label, edits), labels, score.
    """
    words = encoded(text).translate(PLAIN_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    starts = None

    def word_at(byte: int) -> int:
        nonlocal starts
        if starts is None:
            starts, at = [], 1
            for w in words:
                starts.append(at)
                at += len(w) + 1
        return bisect_right(starts, byte) - 1

    for phrase, label in PHRASES:
        wanted, at = b" " + phrase + b" ", -1
        while (at := joined.find(wanted, at + 1)) >= 0:
            places.append(word_at(at + 1))
            base.add(label)
    # bytes as latin-1 keep one character a byte, so places in the text stay byte places
    plain = joined[1:-1].decode("latin-1")
    found = fuzzy_spans(plain, notices)
    spans = [(word_at(a + 1), word_at(b) + 1, label, e) for a, b, label, e in found]
    labels = base | {s[2] for s in spans}
    best = max((1 - e / max(1, b - a) for a, b, _, e in found), default=0.0)
    score = max(0.0, min(1.0, max(best, 0.9 if base else 0.0)))
    return {"words": len(words), "places": sorted(places), "base": base, "spans": spans, "labels": labels, "score": score}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Notices = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``notices`` are (words, label) pairs to search for with edits.  ``spans`` lists the notices found with edits (start and end word, label, number of edits).  A null or empty text
    has no words, no labels (empty strings) and score 0; ``first_word`` and ``last_word`` are null without a base
    place.  Repeated rows and null ids give a row each.  Other columns are not looked at.  Empty in, empty out.
    """
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<start: long, end: long, label: string, edits: int>>"
    )

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = [scan(t, notices) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            "n_words": [g["words"] for g in got],
            "n_base": [len(g["places"]) for g in got],
            "first_word": [g["places"][0] if g["places"] else None for g in got],
            "last_word": [g["places"][-1] if g["places"] else None for g in got],
            "base_labels": [",".join(sorted(g["base"])) for g in got],
            "labels": [",".join(sorted(g["labels"])) for g in got],
            "score": [g["score"] for g in got],
            "spans": [[dict(zip(("start", "end", "label", "edits"), s)) for s in g["spans"]] for g in got],
        }

    return map_columns(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), schema, run)
