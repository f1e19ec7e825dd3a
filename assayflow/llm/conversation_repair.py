"""Repair of conversation structure as a lightest derivation.

A conversation's rows are edited (kept, given another role, deleted, or a row
inserted before, between or after them) until the initials of their roles read
``(s?(ua)+)?``.  Items of a weighted deduction are derived from one another:

    Edit(i, r)                      the lightest way to make row i say r (or nothing)
    Span(e, i, q)                   rows 0..i-1 lead from state e to state q
    Span(e, i, q), Edit(i, r)   ->  Span(e, i+1, q after r)
    Span(e, i, q), Insert(r)    ->  Span(e, i,   q after r)

Weights are (cost, audit), the audit being the letters of the edits in order.
Appending letters never lowers a weight, and two audits that use up the same
rows at the same cost are never prefixes of each other, so order is kept: the
functions are monotone and superior, and an agenda that pops the lightest item
first has each item's final weight when it pops.

A block holds at most ``BLOCK`` rows of one conversation and yields the weights
of its spans between all states.  Spans of neighbouring blocks join by the same
deduction, in rounds of ``FAN`` blocks, so a long conversation is repaired by
many tasks.  What a task holds of it is one block, or the audits it joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import discard, saved, slices, small_batches

#: Rows of a block, and blocks joined at a time (powers of two).
BLOCK = 256
FAN = 64

#: What edits cost, and the letters that stand for them.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
LETTERS = {"keep": "K", "rerole": "R", "delete": "D", "insert": "I"}
BLANKS = " \t\n\v\f\r"

#: States: nothing yet, after s, after u, after a; and where an initial leads.
STATES = range(4)
ENDS = (0, 3)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

Weight = tuple[int, str]

SPANS = "conv_id long, blk long, first_turn long, last_turn long, turns long, first_role string, last_role string, rows long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ------------------------------------------------------------------ deduction

@lru_cache(1 << 15)
def edits(initial: str, fault: str) -> tuple[tuple[str, Weight], ...]:
    """The lightest edits of a row for each initial it can give ('' for none)."""
    found: dict[str, Weight] = {"": (DELETE, LETTERS["delete"])}
    if fault not in ("blank", "duplicate"):
        more = CUT_OFF if fault == "truncated" else 0
        for r in "ua":
            found[r] = (REROLE + more, LETTERS["rerole"])
        if initial in ("s", "u", "a"):
            found[initial] = min(found.get(initial, (REROLE + DELETE, "")), (KEEP + more, LETTERS["keep"]))
    return tuple(found.items())


def block_spans(rows: tuple[tuple[str, str], ...]) -> dict[tuple[int, int], Weight]:
    """``derived_spans``; those of short blocks are remembered, as many conversations are alike."""
    return short_spans(rows) if len(rows) <= 12 else derived_spans(rows)


def derived_spans(rows: tuple[tuple[str, str], ...]) -> dict[tuple[int, int], Weight]:
    """The lightest weight of a block of (initial, fault) between every two states."""
    final: dict[tuple[int, int, int], Weight] = {}
    agenda: list[tuple[Weight, tuple[int, int, int]]] = [((0, ""), (e, 0, e)) for e in STATES]
    while agenda:
        weight, item = heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        cost, audit = weight
        e, i, q = item
        steps = [((INSERT, LETTERS["insert"]), i, AFTER.get((q, r))) for r in "ua"]
        if i < len(rows):
            steps += [(w, i + 1, AFTER.get((q, r)) if r else q) for r, w in edits(*rows[i])]
        for (more, letter), j, to in steps:
            if to is not None and (e, j, to) not in final:
                heappush(agenda, ((cost + more, audit + letter), (e, j, to)))
    return {(e, q): w for (e, i, q), w in final.items() if i == len(rows)}


short_spans = lru_cache(1 << 14)(derived_spans)


def joined_spans(left: dict[tuple[int, int], Weight], right: dict[tuple[int, int], Weight]) -> dict[tuple[int, int], Weight]:
    """The lightest weights over two neighbouring stretches of rows."""
    out: dict[tuple[int, int], Weight] = {}
    for e in STATES:
        for q in STATES:
            ways = [(left[e, m][0] + right[m, q][0], m) for m in STATES if (e, m) in left and (m, q) in right]
            if ways:
                least = min(ways)[0]
                out[e, q] = (least, min(left[e, m][1] + right[m, q][1] for c, m in ways if c == least))
    return out


def repaired_roles(audit: str) -> Iterator[tuple[str, str]]:
    """(edit, role) of every letter of an audit; deleted rows get ''.

    The number of rows that remain tells whether the first is a system row, so the letters fix all roles.
    """
    remain = len(audit) - audit.count("D")
    place = -(remain % 2)
    for letter in audit:
        if letter == "D":
            yield letter, ""
        else:
            yield letter, "system" if place < 0 else ("user", "assistant")[place % 2]
            place += 1


# ------------------------------------------------------------------ rows

def rows_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, dropped: nulls of role and text are one space."""
    c = conversations
    return c.select(
        c[conv_col].cast("long").alias("conv_id"), c[turn_col].cast("long").alias("turn"), F.coalesce(c[role_col].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(c[text_col].cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("dropped"),
    )


def damaged(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """The rows of ``rows_of`` damaged by crc32 of ``conv_id:turn`` (nulls: one space) modulo ``modulus``: 0 is marked
    dropped, 1 loses its text, 2 its full stops, question and exclamation marks, 3 comes twice, 4 becomes a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = rows.withColumn("d", F.pmod(F.crc32(key), F.lit(modulus)))
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.withColumn("text", text).withColumn("role", F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role"))).withColumn("dropped", F.col("d") == 0)
    twice = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("copy", F.explode(twice)).drop("copy", "d")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


# ------------------------------------------------------------------ summaries of stretches of rows

class Stretch:
    """What is known of neighbouring rows of one conversation."""

    COUNTS = ("turns", "rows", "blank", "duplicate", "truncated", "illegal")

    def __init__(self, first_turn, last_turn, first_role, last_role, counts: dict[str, int], spans: dict[tuple[int, int], Weight]):
        self.first_turn, self.last_turn, self.first_role, self.last_role = first_turn, last_turn, first_role, last_role
        self.counts, self.spans = counts, spans

    @classmethod
    def of(cls, rows: list[tuple[int | None, str, str]]) -> Stretch:
        """Of a block of (turn, initial, fault) in order."""
        turns = [t for t, _, _ in rows if t is not None]
        said = [r for _, r, _ in rows]
        faults = [f for _, _, f in rows]
        counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
        counts |= {"turns": len(set(turns)), "rows": len(rows), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(said, said[1:]))}
        return cls(turns[0] if turns else None, turns[-1] if turns else None, said[0], said[-1], counts, block_spans(tuple((r, f) for _, r, f in rows)))

    def then(self, other: Stretch) -> Stretch:
        counts = {k: self.counts[k] + other.counts[k] for k in self.COUNTS}
        counts["illegal"] += self.last_role + other.first_role not in ("su", "ua", "au")
        counts["turns"] -= self.last_turn is not None and self.last_turn == other.first_turn  # rows of a turn are neighbours
        first = other.first_turn if self.first_turn is None else self.first_turn
        last = self.last_turn if other.last_turn is None else other.last_turn
        return Stretch(first, last, self.first_role, other.last_role, counts, joined_spans(self.spans, other.spans))

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["turns"]

    def best(self) -> Weight:
        return min(self.spans[0, q] for q in ENDS if (0, q) in self.spans)

    def row(self, conv_id: int | None, blk: int) -> tuple:
        weights = [self.spans.get((e, q)) for e in STATES for q in STATES]
        c = self.counts
        return (conv_id, blk, self.first_turn, self.last_turn, c["turns"], self.first_role, self.last_role, c["rows"], c["blank"], c["duplicate"], c["truncated"], c["illegal"],
                [None if w is None else w[0] for w in weights], [None if w is None else w[1] for w in weights])

    @classmethod
    def read(cls, cols: dict[str, list], i: int) -> Stretch:
        pairs = [(e, q) for e in STATES for q in STATES]
        spans = {p: (c, a) for p, c, a in zip(pairs, cols["costs"][i], cols["audits"][i]) if c is not None}
        return cls(*(cols[k][i] for k in ("first_turn", "last_turn", "first_role", "last_role")), {k: cols[k][i] for k in cls.COUNTS}, spans)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _streamed(df: DataFrame, schema: str, fn) -> DataFrame:
    """``fn`` over the rows of each partition, which arrive batch by batch: (batches of columns as lists) -> rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(lambda batches: _batches(fn(slices(batches)), arrow), schema)


def _blocks(parts: Iterator[dict[str, list]]) -> Iterator[tuple]:
    """Rows in order, each after the mark that it is the first with its role and text (if it is)."""
    key, rows, first = None, [], None
    for cols in parts:
        for i, place in enumerate(cols["place"]):
            if cols["kind"][i] == 0:
                first = place
                continue
            here = (cols["conv_id"][i], cols["blk"][i])
            if rows and here != key:
                yield Stretch.of(rows).row(*key)
                rows = []
            key, fault = here, cols["fault"][i]
            rows.append((cols["turn"][i], cols["initial"][i], fault if fault == "blank" else "duplicate" if first != place else fault))
    if rows:
        yield Stretch.of(rows).row(*key)


def _chains(parts: Iterator[dict[str, list]]) -> Iterator[tuple]:
    """Neighbouring stretches of the same (conversation, upper block) made one."""
    key, held = None, None
    for cols in parts:
        for i, conv_id in enumerate(cols["conv_id"]):
            here, s = (conv_id, cols["up"][i]), Stretch.read(cols, i)
            if held is not None and here == key:
                held = held.then(s)
                continue
            if held is not None:
                yield held.row(*key)
            key, held = here, s
    if held is not None:
        yield held.row(*key)


def stretches(rows: DataFrame) -> DataFrame:
    """One row per conversation with any rows: what ``Stretch`` knows of all of them."""
    kept = rows.filter("not dropped")
    trimmed = F.rtrim(kept["text"], F.lit(BLANKS))
    fault = F.when(trimmed == "", F.lit("blank")).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), F.lit("truncated"))
    narrow = kept.select("conv_id", "turn", "role", digest(F.col("text")).alias("digest"), F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    # range partitions split a long conversation; the number of a row grows in the order of conversations and rows
    ordered = narrow.repartitionByRange(F.col("conv_id").asc_nulls_first(), *order()).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order())
    ordered = saved(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    block = F.shiftright("place", BLOCK.bit_length() - 1)
    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
    marks = firsts.select("place", block.alias("blk"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("initial", "string"), ("fault", "string"))])
    every = ordered.select("place", block.alias("blk"), F.lit(1).alias("kind"), "conv_id", "turn", "initial", "fault").unionByName(marks)
    spans = saved(_streamed(every.repartition("blk").sortWithinPartitions("place", "kind"), SPANS, _blocks), "spans")
    spent = [ordered]
    while True:
        most = spans.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        up = F.lit(0).cast("long") if most <= FAN else F.shiftright("blk", FAN.bit_length() - 1)
        dealt = spans.withColumn("up", up).repartition("conv_id", "up").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "up", "blk")
        spent.append(spans)
        spans = saved(_streamed(dealt, SPANS, _chains), "spans")
    discard(*spent)
    return spans


DETAIL = "conv_id long, place long, edit string, turn long, role string, text string"


def _repaired(parts: Iterator[dict[str, list]]) -> Iterator[tuple]:
    """The summary of each conversation, then its rows in order -> conv_id, position, edit, turn, role, text of every edit."""
    letters, key, place = iter(()), None, 0

    def insertions() -> Iterator[tuple]:
        nonlocal place
        for edit, role in letters:
            if edit != "I":
                ahead.append((edit, role))
                return
            yield key, place, edit, None, role, ""
            place += 1

    ahead: list[tuple[str, str]] = []
    started = False
    for cols in parts:
        for i, kind in enumerate(cols["kind"]):
            if not started or cols["conv_id"][i] != key:
                if started:
                    yield from insertions()
                key, letters, ahead, place, started = cols["conv_id"][i], iter(()), [], 0, True
            if kind == 0:
                s = Stretch.read(cols, i)
                letters = repaired_roles(s.best()[1])
                yield (key, None, None, None, None, None, s)
                yield from insertions()
            elif not cols["dropped"][i]:
                edit, role = ahead.pop()
                if edit == "K":
                    role = cols["role"][i]
                yield key, place, edit, cols["turn"][i], role, cols["text"][i]
                place += 1
                yield from insertions()
            else:
                yield (key, None, None, None, None, None, None)


def _arranged(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Summaries and rows of the same conversations side by side: the one shuffle of the texts."""
    small_batches(rows.sparkSession)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("dropped", "boolean"), ("digest", "binary"))]
    heads = spans.select("*", F.lit(0).alias("kind"), *none)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in spans.schema if f.name != "conv_id"]
    body = rows.select("conv_id", *blank, F.lit(1).alias("kind"), "turn", "role", "text", "dropped", digest(F.col("text")).alias("digest"))
    every = heads.unionByName(body).repartition("conv_id")
    return every.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order())


def repaired_rows(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """The edits of every conversation in order: conv_id, place, edit (K, R, D or I), turn, role, text.

    Leave out the rows with edit D to get the repaired conversations.  Rules as for ``repair_summaries``.
    """
    rows = rows_of(conversations, conv_col, turn_col, role_col, text_col)
    return _streamed(_arranged(rows, stretches(rows)), DETAIL, lambda parts: (r for r in _repaired(parts) if len(r) == 6))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summaries(parts: Iterator[dict[str, list]]) -> Iterator[tuple]:
    """Streams each repaired conversation into its hash."""
    key, head, hashed, any_row = None, None, None, False

    def row() -> tuple:
        if head is None:
            return (key, *[0] * len(SUMMARY), "", hashlib.sha256().hexdigest())
        cost, audit = head.best()
        c = head.counts
        return (key, head.gaps(), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, hashed.hexdigest())

    for r in _repaired(parts):
        if hashed is None or r[0] != key:
            if hashed is not None:
                yield row()
            key, head, hashed, any_row = r[0], None, hashlib.sha256(), False
        if len(r) == 7:
            head = r[6] or head
        elif r[2] != "D":
            hashed.update((("\n" if any_row else "") + f"{r[4]}:{r[5]}").encode("utf-8", "surrogatepass"))
            any_row = True
    if hashed is not None:
        yield row()


def repair_summaries(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (as from ``rows_of``): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    * Rows count in the order of turn (nulls first), then role, then SHA-256 of the text; rows alike in all are equal.
    * A null conv_id is a conversation like others.  Null roles and texts are one space, so such a text is blank.
    * A role whose initial is none of s, u, a must be changed or its row deleted.
    * A conversation whose rows are all dropped gives zeros, an empty audit and the hash of nothing.
    * Texts are hashed whole, row after row; other columns are not looked at.  Empty in, empty out.
    * The audit and the hash of a conversation are single values, so the last pass streams it through one task.
    """
    return _streamed(_arranged(rows, stretches(rows)), RESULT, _summaries)


def repair_damaged(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``repair_summaries`` of the conversations after ``damaged``."""
    return repair_summaries(damaged(rows_of(conversations, conv_col, turn_col, role_col, text_col)))
