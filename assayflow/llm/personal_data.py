"""Personal data by exact patterns and a semi-Markov conditional random field.

The base patterns give spans that always stay.  The random field adds written
variants that the patterns miss ("name [at] host dot org", phone numbers
without a plus, cards with other separators).  It scores whole candidate
segments of up to ``MAX_TOKENS`` tokens by features of the span (digits, check
sum, shape, words beside it); dynamic programming over segment ends jointly
chooses boundaries and types.  It is trained in numpy by the exact gradient
of the segmentations' likelihood, on weakly labelled windows: base spans
in a bounded sample of documents and variants written from rules.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from itertools import accumulate, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import map_columns

KINDS = ("email", "ip", "card", "phone")
#: Documents at most that give training windows (the smallest by hash of the id), and windows at most.
SAMPLE_DOCS = 200
TRAIN_WINDOWS = 160
MAX_TOKENS = 19
REACH = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base matches, by start, then kind.  Linear in the text: no pattern rescans a run."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ------------------------------------------------------------------ candidates
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
#: Where a variant may stand: digit groups, numbers with written dots between them, and every "at" that MAIL_SHAPE knows
#: before a host with a dot (an "@" only where the base pattern does not take it); one to three numbers are no host.
_OBSCURED = r"(?:\s?[\[({]dot[\])}]\s?| dot )"
_HOST = r"(?![0-9]+(?:\.[0-9]+){0,2}(?![A-Za-z0-9-]|\.[A-Za-z0-9]))[A-Za-z0-9-]+(?:\.|" + _OBSCURED + ")[A-Za-z0-9-]"
TRIGGER = re.compile(
    r"(?i)[0-9](?:[ ./_()-]{0,3}[0-9]){5,}"
    r"|[0-9]{1,3}(?:(?:\s?[\[({](?:\.|dot)[\])}]\s?| dot )[0-9]{1,3}){3}"
    r"|[\[({]\s?at\s?[\])}]"
    rf"|(?<=[A-Za-z0-9_%+-])\s? at \s?(?={_HOST})"
    rf"|@(?=[A-Za-z0-9-]+{_OBSCURED}[A-Za-z0-9-])|\s@(?=\s?{_HOST})|@\s(?={_HOST})"
)
PHONE_CUE = re.compile(r"(?i)(?:tel|phone|call|fax|mobile)[.:]?\s*$")
MAIL_CUE = re.compile(r"(?i)(?:e-?mail|contact|write)[.:]?\s*$")
CARD_CUE = re.compile(r"(?i)(?:card|visa|credit|payment)[.:]?\s*$")
IP_CUE = re.compile(r"(?i)(?:ip|host|server|addr|address)[.:]?\s*$")
MAIL_SHAPE = re.compile(r"(?i)[a-z0-9][a-z0-9_%+-]*(?:(?:\.|\s?[\[({]dot[\])}]\s?| dot )[a-z0-9_%+-]+)*\s?(?:[\[({]\s?at\s?[\])}]| at |@)\s?(?![0-9]+(?:\.[0-9]+){0,2}\Z)[a-z0-9-]+(?:(?:\.|\s?[\[({]dot[\])}]\s?| dot )[a-z0-9-]+)+\Z")
IP_SHAPE = re.compile(r"(?i)[0-9]{1,3}(?:\s?[\[({](?:\.|dot)[\])}]\s?[0-9]{1,3}){3}\Z|[0-9]{1,3}(?: dot [0-9]{1,3}){3}\Z")
PHONE_SHAPE = re.compile(r"(?:00[ .-]?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}\Z")
CARD_SHAPE = re.compile(r"[0-9]{4}([ ./_-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")
FEATURES = 30
#: Tokens scored at a time.
BLOCK_TOKENS = 512
#: Words of a sampled document, letters of a word and of a window that the training looks at.
SAMPLE_WORDS, WORD_LETTERS, WINDOW_LETTERS = 60, 40, 200


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers where a written variant may stand; stretches that meet become one."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def tokens(text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a stretch."""
    at = array("q")
    for m in TOKEN.finditer(text, lo, hi):
        at.extend(m.span())
    both = np.frombuffer(at, np.int64).reshape(-1, 2) if at else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def segment_features(text: str, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the candidate segments that end with the tokens ``first`` to ``last`` - 1, and which segments are candidates.

    Entry (i, L) is the segment of L + 1 tokens that ends with token ``first`` + i.  Counts of characters come from
    prefix sums, what depends on one end only is computed once a token, and patterns are tried only where counts let
    them match; so a block costs what its tokens cost, whatever the text around it.
    """
    left = max(0, first - MAX_TOKENS + 1)
    base, stop = int(starts[left]), int(ends[last - 1])
    part = text[base:stop]
    code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = ((code | 32) >= 97) & ((code | 32) <= 122)
    beyond = np.flatnonzero(code > 127)
    alpha[beyond] = [part[k].isalpha() for k in beyond]
    digit = (code >= 48) & (code <= 57)
    lower = code | 32
    counts = {
        "digit": digit, "alpha": alpha, "at": code == 64, "line": code == 10, "group": digit & ~np.append(False, digit[:-1]),
        "double": (code == 32) & np.append(code[1:] == 32, False), "at_word": (lower == 97) & np.append(lower[1:] == 116, False),
    }
    upto = {k: np.append(0, np.cumsum(v)) for k, v in counts.items()}

    spans = [(int(x), int(y)) for x, y in zip(starts[left:last], ends[left:last])]
    words = [text[x:y] for x, y in spans]
    alnum = np.array([t.isalnum() for t in words], bool)
    useful = alnum | np.array([t in "+(" for t in words], bool)
    front = np.zeros((len(spans), FEATURES), bool)  # what depends on where a segment starts, or ends
    back = np.zeros((len(spans), FEATURES), bool)
    for k, ((x, y), t) in enumerate(zip(spans, words)):
        before, after, cue = text[x - 1 : x], text[y : y + 1], text[max(0, x - 16) : x]
        front[k, 12], back[k, 12] = t[0].isspace(), t[-1].isspace()
        front[k, 13] = not (t[0].isalnum() or t[0] in "+(")
        back[k, 14] = not t[-1].isalnum()
        front[k, 15] = before.isalnum() or before in ("-", ".", "@", "_", "+") and before != ""
        back[k, 16] = after.isalnum() or after in ("-", "@", "_") and after != ""
        if cue.rstrip()[-1:].isalpha() or cue.rstrip()[-1:] in (".", ":"):
            for f, pattern in ((17, PHONE_CUE), (18, MAIL_CUE), (19, CARD_CUE), (20, IP_CUE)):
                front[k, f] = bool(pattern.search(cue))
        back[k, 27] = after == "." and text[y + 1 : y + 2].isdigit()

    end = np.arange(first - left, last - left)[:, None] + np.zeros(MAX_TOKENS, int)
    begin = end - np.arange(MAX_TOKENS)
    ok = begin >= 0
    begin = np.maximum(begin, 0)
    ok &= (end == begin) | (alnum[end] & useful[begin])
    at = np.array([x for x, _ in spans])[begin] - base
    to = np.array([y for _, y in spans])[end] - base
    held = {k: v[to] - v[at] for k, v in upto.items()}
    n, letters, size = held["digit"], held["alpha"], to - at
    others = size - n - letters
    x = np.zeros((*ok.shape, FEATURES))
    x[..., :] = front[begin] | back[end]
    x[..., 0] = 1
    x[..., 1] = (n >= 12) & (n <= 19)
    x[..., 3] = (n >= 9) & (n <= 15)
    x[..., 4] = (n >= 7) & (n <= 11)
    x[..., 5] = n == 0
    x[..., 6] = letters == 0
    x[..., 7] = (letters == 0) & (n > 0) & (others <= n)
    x[..., 21] = held["at"] > 0
    x[..., 22] = held["line"] > 0
    x[..., 23] = others / np.maximum(size, 1)
    x[..., 24] = size > 40
    x[..., 25] = n > 19
    x[..., 26] = (n > 0) & (n < 7)
    x[..., 28] = held["group"] == 4
    x[..., 29] = upto["double"][np.maximum(to - 1, at)] - upto["double"][at] > 0

    def where(f: int, possible: np.ndarray, holds) -> None:
        for i, k in zip(*np.nonzero(ok & possible)):
            x[i, k, f] = holds(part[at[i, k] : to[i, k]])

    where(2, (n >= 12) & (n <= 19), lambda t: luhn(re.sub("[^0-9]", "", t)))
    where(8, (held["at"] > 0) | (held["at_word"] > 0), lambda t: bool(MAIL_SHAPE.match(t)))
    where(9, (held["group"] == 4) & (n <= 12), lambda t: bool(IP_SHAPE.match(t)) and all(int(g) <= 255 for g in re.findall("[0-9]+", t)))
    where(10, (n >= 10) & (n <= 15) & (letters == 0), lambda t: bool(PHONE_SHAPE.match(t)))
    where(11, (n >= 13) & (n <= 19) & (letters == 0), lambda t: bool(CARD_SHAPE.fullmatch(t)))
    x[~ok] = 0
    return x, ok


def decoded(text: str, lo: int, hi: int, w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type) of the entities in the best segmentation of a stretch, block of tokens by block.

    The recursion looks back ``MAX_TOKENS`` tokens; of earlier ones only places, totals and back pointers are kept.
    """
    starts, ends = tokens(text, lo, hi)
    n = len(starts)
    top, length, kind = np.zeros(n + 1), np.zeros(n, np.int8), np.zeros(n, np.int8)
    for first in range(0, n, BLOCK_TOKENS):
        last = min(n, first + BLOCK_TOKENS)
        s = scored(*segment_features(text, starts, ends, first, last), w)
        for i in range(first, last):
            k = min(MAX_TOKENS, i + 1)
            total = s[i - first, :k] + top[i - np.arange(k)][:, None]
            j = int(total.argmax())
            top[i + 1] = total.flat[j]
            length[i], kind[i] = j // s.shape[2] + 1, j % s.shape[2]
    out, i = [], n
    while i > 0:
        back = int(length[i - 1])
        if kind[i - 1]:
            out.append((int(starts[i - back]), int(ends[i - 1]), int(kind[i - 1])))
        i -= back
    return out[::-1]


def scored(x: np.ndarray, ok: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(token, length, type) scores; type 0 is no entity and has length 1."""
    s = x @ w.T
    s[~ok] = -np.inf
    s[:, 1:, 0] = -np.inf
    return s


class Window:
    """A short stretch, as in training: its tokens and the feature vectors of all its candidate segments."""

    def __init__(self, text: str, lo: int = 0, hi: int | None = None):
        self.text, self.lo, self.hi = text, lo, len(text) if hi is None else hi
        starts, ends = tokens(text, lo, self.hi)
        self.spans = list(zip(starts.tolist(), ends.tolist()))
        self.x, self.ok = segment_features(text, starts, ends, 0, len(starts))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return scored(self.x, self.ok, w)

    def best(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, type) of the entities in the best segmentation."""
        return decoded(self.text, self.lo, self.hi, w)

    def gradient(self, w: np.ndarray, gold: list[tuple[int, int, int]]) -> np.ndarray:
        """Of the log-likelihood of the gold entities (all other tokens are no entity): forward and backward sums."""
        s, n = self.scores(w), len(self.spans)
        a, b = np.zeros(n + 1), np.zeros(n + 1)
        for i in range(n):
            k = min(MAX_TOKENS, i + 1)
            a[i + 1] = np.logaddexp.reduce((s[i, :k] + a[i + 1 - np.arange(1, k + 1)][:, None]).ravel())
        for i in range(n - 1, -1, -1):
            k = min(MAX_TOKENS, n - i)
            ends = i + np.arange(k)
            b[i] = np.logaddexp.reduce((s[ends, np.arange(k)] + b[ends + 1][:, None]).ravel())
        g = np.zeros_like(w)
        starts = np.arange(1, n + 1)[:, None] - np.arange(1, MAX_TOKENS + 1)
        p = np.exp(s + np.where(starts >= 0, a[np.maximum(starts, 0)], -np.inf)[:, :, None] + b[1:, None, None] - a[n])
        g -= np.einsum("nlk,nlf->kf", p, self.x)
        begin, end = {x[0]: i for i, x in enumerate(self.spans)}, {x[1]: i for i, x in enumerate(self.spans)}
        covered = np.zeros(n, bool)
        for lo, hi, kind in gold:
            if lo in begin and hi in end and end[hi] - begin[lo] < MAX_TOKENS:
                i, j = begin[lo], end[hi]
                g[kind] += self.x[j, j - i]
                covered[i : j + 1] = True
        g[0] += self.x[~covered, 0].sum(0)
        return g


# ------------------------------------------------------------------ training
def _variants(rng: np.random.Generator) -> tuple[str, int]:
    """A written variant and its type (0: looks alike but is none), from rules."""
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(3, 9))))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    kind = int(rng.integers(0, 5))
    if kind == 1:
        at = str(rng.choice([" [at] ", " (at) ", "[at]", " at ", "(at)", " {at} "]))
        dot = " dot " if at == " at " else str(rng.choice([" dot ", ".", " [dot] ", "[dot]", " (dot) "]))
        return word() + str(rng.choice(["", num(2)])) + at + word() + dot + str(rng.choice(["com", "org", "net"])), 1
    if kind == 2:
        return str(rng.choice(["[.]", " dot ", "[dot]", "(.)"])).join(str(x) for x in rng.integers(0, 256, 4)), 2
    if kind == 3:
        body = "4" + num(14)
        digits = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        return str(rng.choice([".", "/", "  ", "_"])).join(digits[i : i + 4] for i in range(0, 16, 4)), 3
    if kind == 4:
        a, b, c = num(3), num(3), num(4)
        return str(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}", f"{a}.{b}.{c}"])), 4
    bad = num(16)
    bad = bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
    date = f"20{num(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)} 1{num(1)}:{num(2)}"
    return str(rng.choice([bad, num(8), date, f"{num(1)}.{num(1)}.{num(2)}", f"{num(3)}.{num(6)}", num(24), f"{num(5)} {num(5)}"])), 0


def example_of(text: str | None) -> tuple[list[str], str | None, int, int, int]:
    """What the training takes of a document: some words, and the stretch around its first base span (text, start, end, type)."""
    words = [w for w in islice((m.group() for m in re.finditer(r"\S+", text or "")), SAMPLE_WORDS) if w.isalpha() and len(w) <= WORD_LETTERS]
    for lo, hi, kind in base_spans(text or "")[:1]:
        a, b = max(0, lo - REACH // 2), min(len(text), hi + REACH // 2)
        if b - a <= WINDOW_LETTERS:
            return words, text[a:b], lo - a, hi - a, 1 + KINDS.index(kind)
    return words, None, 0, 0, 0


def train(sample: list[tuple[list[str], str | None, int, int, int]], epochs: int = 6, rate: float = 0.25, seed: int = 11) -> np.ndarray:
    """Weights (type x feature) from the windows of ``example_of`` and from variants set among the documents' words."""
    rng = np.random.default_rng(seed)
    words = [w for row in sample for w in row[0]] or ["the", "and", "of"]
    examples = [(text, [(lo, hi, kind)]) for _, text, lo, hi, kind in sample if text is not None][: TRAIN_WINDOWS // 4]
    while len(examples) < TRAIN_WINDOWS:
        left = " ".join(map(str, rng.choice(words, 3))) + " "
        span, kind = _variants(rng)
        text = left + span + str(rng.choice([" ", ". ", ", "])) + " ".join(map(str, rng.choice(words, 2)))
        examples.append((text, [(len(left), len(left) + len(span), kind)] if kind else []))
    made = [(Window(t), gold) for t, gold in examples]
    w, seen = np.zeros((1 + len(KINDS), FEATURES)), np.full((1 + len(KINDS), FEATURES), 1e-6)
    w[1:, 0] = -2
    for _ in range(epochs):
        for k in rng.permutation(len(made)):
            g = made[k][0].gradient(w, made[k][1]) - 0.002 * w
            seen += g * g
            w = w + rate * g / np.sqrt(seen)
    return w


class Cover:
    """Sorted spans, asked which of them meet a stretch."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans, self.starts = spans, [s[0] for s in spans]
        self.ends = list(accumulate((s[1] for s in spans), max))  # the farthest end so far

    def meeting(self, lo: int, hi: int) -> list[tuple[int, int, str]]:
        return [s for s in self.spans[bisect_right(self.ends, lo) : bisect_left(self.starts, hi)] if s[1] > lo]

    def meets(self, lo: int, hi: int) -> bool:
        k = bisect_left(self.starts, hi)
        return k > 0 and self.ends[k - 1] > lo


def added_spans(text: str, w: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Entities of the model that touch no base span and carry the marks of their type."""
    out, cover = [], Cover(base)
    for lo, hi in windows(text):
        inside = cover.meeting(lo, hi)
        if inside and not TRIGGER.search(_blank(text, lo, hi, inside)):
            continue  # the base spans explain all that triggered
        out += [(a, b, KINDS[kind - 1]) for a, b, kind in decoded(text, lo, hi, w) if not cover.meets(a, b)]
    return out


def _blank(text: str, lo: int, hi: int, spans: list[tuple[int, int, str]]) -> str:
    """The stretch with NUL characters for all that the spans cover."""
    parts, at = [], lo
    for a, b, _ in spans:
        a, b = max(a, at), min(b, hi)
        if b > a:
            parts += [text[at:a], "\x00" * (b - a)]
            at = b
    return "".join(parts) + text[at:hi]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added.

    Places are code points, the end exclusive.  A null or empty text has no spans (``spans`` is empty).  Whole texts
    are read; the model is fitted on at most ``SAMPLE_DOCS`` documents and ``TRAIN_WINDOWS`` windows.  Repeated rows
    and null ids give a row each.  Other columns are not looked at.  An empty table gives an empty result.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    marked = texts.filter(F.col("text").rlike("@[A-Za-z0-9-]+\\.|\\+[0-9]"))
    chosen = marked.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()
    taken = map_columns(
        texts.filter(F.col("doc_id").isin([r["doc_id"] for r in chosen])),
        "doc_id long, words array<string>, window string, lo long, hi long, kind long",
        lambda cols: {"doc_id": cols["doc_id"], **dict(zip(("words", "window", "lo", "hi", "kind"), map(list, zip(*map(example_of, cols["text"])))))},
    )
    rows = taken.orderBy("doc_id", "window", "words").limit(SAMPLE_DOCS).collect() if chosen else []  # a window and some words each
    w = train([tuple(r)[1:] for r in rows])
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {x.split()[0]: [] for x in schema.split(", ")}
        out["doc_id"] = cols["doc_id"]
        for text in cols["text"]:
            base = base_spans(text or "")
            more = added_spans(text, w, base) if text else []
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
            out["n_added"].append(len(more))
        return out

    return map_columns(texts, schema, run)
