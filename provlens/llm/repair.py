"""Operator 13: repair of conversation structure by a generalised LR parse with weighted edits.

The role grammar is C -> | H T, H -> | s, T -> P | T P, P -> u a over the first letters of
roles: an optional system turn, then pairs of user and assistant. Besides shifting a turn as
it is (Keep) the parser may shift it as another role (Rerole), skip it (Delete) or shift a
turn that is not there (Insert). All stacks go on at once in a graph-structured stack; where
two have the same top, the one with the smaller (cost, audit) stays.

A conversation may be of any length. Its turns are cut into segments, each segment is parsed
from every stack top it may begin with, and what leads from top to top is put together in a
tree of groups of segments. Only one letter per turn takes part in this.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.functions.ordered import document_digest, sequenced
from provlens.llm.common import SPACE, kept, landed

# Prices of edits, names that rerole and insert give.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
TOPS = "0HuT"  # tops of stacks: empty, head, user, turns
LAST = {"0": "", "H": "ua", "u": "a", "T": ""}  # what is missing from a sentence

SEGMENT = 256  # turns parsed at once
FAN = 512  # segments, or groups of them, put together at once


class Stack(NamedTuple):
    """A node of the graph-structured stack: the cheapest way to have ``top`` there, over ``below``."""

    cost: int
    audit: str
    top: str
    below: str


def shifted(node: Stack, symbol: str, cost: int, letter: str) -> Stack | None:
    """The stack after a symbol and all reductions that follow; nothing where the grammar forbids it."""
    price, audit = node.cost + cost, node.audit + letter
    if symbol == "s":
        return Stack(price, audit, "H", "0") if node.top == "0" else None  # H -> s
    if symbol == "u":
        # On an empty stack H -> (nothing) comes first.
        return None if node.top == "u" else Stack(price, audit, "u", "H" if node.top == "0" else node.top)
    if symbol == "a":
        return Stack(price, audit, "T", "H") if node.top == "u" else None  # P -> u a, then T -> P or T -> T P
    return None


def _merge(tops: dict[str, Stack], node: Stack | None) -> bool:
    """Put a node where its top is; true if it is the better one."""
    if node is None or (node.top in tops and (tops[node.top].cost, tops[node.top].audit) <= (node.cost, node.audit)):
        return False
    tops[node.top] = node
    return True


def remembered(make: Any, *args: Any) -> Any:
    """``make(*args)``; many conversations look alike, so a worker keeps some thousand results."""
    store = kept(("repair", make.__name__), dict)
    if args not in store:
        if len(store) >= 1 << 13:
            store.clear()
        store[args] = make(*args)
    return store[args]


def parsed(codes: str, entry: str) -> dict[str, tuple[int, str]]:
    """From a stack top over some turns: the least cost and audit for every top behind them.

    A turn is a letter: its role's first one (``s u a``, ``o`` for others), a capital if the
    text is truncated, ``x`` if it must go. Inserts stand before a turn, so no audit is the
    beginning of another, and audits end to end compare as their parts do.
    """
    tops = {entry: Stack(0, "", entry, "H")}
    for code in codes:
        open_tops = list(tops.values())
        while open_tops:
            node = open_tops.pop()
            for symbol in "ua":
                made = shifted(node, symbol, INSERT, "I")
                if _merge(tops, made):
                    open_tops.append(made)
        after: dict[str, Stack] = {}
        extra = TRUNCATED if code.isupper() else 0
        for node in tops.values():
            _merge(after, node._replace(cost=node.cost + DELETE, audit=node.audit + "D"))
            if code != "x":
                _merge(after, shifted(node, code.lower(), extra, "K"))
                for symbol in "ua":
                    _merge(after, shifted(node, symbol, REROLE + extra, "R"))
        tops = after
    return {t: (n.cost, n.audit) for t, n in tops.items()}


def replayed(codes: str, audit: str, entry: str) -> list[tuple[str, str, str, bool]]:
    """What an audit does to each turn: inserted lines before it, its letter, its new role, first or not."""
    node, out, lines, first = Stack(0, "", entry, "H"), [], [], entry == "0"
    at = 0
    for letter in audit:
        if letter == "D":
            out.append(("\n".join(lines), "D", "", first))
        else:
            symbol = codes[at].lower() if letter == "K" else "a" if node.top == "u" else "u"
            node = shifted(node, symbol, 0, letter)
            if letter == "I":
                lines.append(f"{NAMES[symbol]}:")
                continue
            out.append(("\n".join(lines), letter, NAMES[symbol] if letter == "R" else "", first))
        lines, at, first = [], at + 1, node.top == "0"
    return out


Way = tuple[int, int]  # a cost, and the rank of its audit among those of the same turns
NONE: Way = (-1, -1)


def joined_ways(left: list[list[Way]], right: list[list[Way]]) -> tuple[list[list[Way]], list[list[int]]]:
    """Ways over two neighbouring parts, and the top between them that each goes through.

    Ways are lists by entry and exit top. Audits of the two parts put end to end compare as
    pairs of ranks; pairs are ranked anew.
    """
    best = [[min(((a[0] + b[0], (a[1], b[1]), m) for m in range(4)
                  if (a := left[p][m]) != NONE and (b := right[m][q]) != NONE), default=None)
             for q in range(4)] for p in range(4)]
    ranks = {pair: i for i, pair in enumerate(sorted({x[1] for row in best for x in row if x}))}
    return ([[(x[0], ranks[x[1]]) if x else NONE for x in row] for row in best],
            [[x[2] if x else -1 for x in row] for row in best])


def _ways(flat: list[int]) -> list[list[Way]]:
    return [[(flat[8 * p + 2 * q], flat[8 * p + 2 * q + 1]) for q in range(4)] for p in range(4)]


def _flat(ways: list[list[Way]]) -> list[int]:
    return [n for row in ways for way in row for n in way]


def segment_ways(codes: str, whole: bool) -> tuple[int, ...]:
    """Ways over a segment; one that begins a conversation has the empty stack as entry only."""
    found = [remembered(parsed, codes, t) if t == "0" or not whole else {} for t in TOPS]
    ranks = {a: i for i, a in enumerate(sorted({a for row in found for _, a in row.values()}))}
    return tuple(_flat([[(row[t][0], ranks[row[t][1]]) if t in row else NONE for t in TOPS] for row in found]))


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with deterministic faults: dropped, emptied, cut, repeated or given to the user.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 sets its role to user. Nulls in the key, role or text are one
    blank; ``turn`` stays null. Columns: conv_id, turn, role, text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return (conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"),
                                 blank("text").alias("text"), fault.alias("fault"))
            .filter("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    text.alias("text"),
                    F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _key(conv_id: Column) -> Column:
    """Null is a conversation like any other."""
    return F.coalesce(conv_id.cast("string"), F.lit("\x00"))


def placed_turns(rows: DataFrame) -> DataFrame:
    """Turns with their place, segment and first fault, as a written table.

    Turns are ordered by turn (nulls first), role and text. A fault is ``blank``,
    ``duplicate`` (role and text seen earlier), ``truncated`` or null.
    """
    turns = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    turns = turns.withColumn("known", F.col("turn").isNotNull()).withColumn("initial", F.substring("role", 1, 1))
    placed = landed(sequenced(turns, ["key"], ["known", "turn", "role", "text"], previous=["initial"]).select(
        "key", "turn", "role", "text", "initial", "prev_initial", F.col("position").cast("long").alias("position"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said")), "turns")
    # Equal turns combine before they are dealt out, and meet the turns again by place.
    first = placed.groupBy("key", "said").agg(F.min("position").alias("position")).select("key", "position", F.lit(True).alias("new"))
    text = F.col("text")
    fault = (F.when(~text.rlike(f"[^{SPACE}]"), F.lit("blank")).when(F.col("new").isNull(), F.lit("duplicate"))
             .when(~text.rlike(f"[.!?][{SPACE}]*\\z"), F.lit("truncated")))
    return landed(placed.drop("said").join(first, ["key", "position"], "left")
                  .withColumn("segment", F.floor(F.col("position") / SEGMENT).cast("long"))
                  .withColumn("fault", fault).drop("new"), "faults")


def _coded(turns: DataFrame) -> DataFrame:
    """A segment's turns as one letter each."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x")).otherwise(
        F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o")))
    letter = F.when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return turns.groupBy("key", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("position", letter.alias("code")))), lambda x: x["code"]), "").alias("codes"))


def _climb(parts: DataFrame) -> DataFrame:
    """Put together ``FAN`` neighbouring parts each: key, segment, ways."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, group, lists in zip(*(c.to_pylist() for c in batch.columns)):
                ways = _ways(lists[0]["ways"])
                for x in lists[1:]:
                    ways = joined_ways(ways, _ways(x["ways"]))[0]
                out.append((key, group, _flat(ways)))
            yield _batch(["key", "segment", "ways"], [pa.string(), pa.int64(), pa.list_(pa.int64())], out)

    groups = parts.groupBy("key", F.floor(F.col("segment") / FAN).cast("long").alias("group")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "ways"))).alias("parts"))
    return groups.mapInArrow(run, "key string, segment long, ways array<long>")


def _descend(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The entry and exit of each part, from those of the groups they are in: key, segment, entry, exit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, lists, entry, leave in zip(*(c.to_pylist() for c in batch.columns)):
                ways, between = _ways(lists[0]["ways"]), []
                for x in lists[1:]:
                    ways, through = joined_ways(ways, _ways(x["ways"]))
                    between.append(through)
                ends = [leave]
                for through in reversed(between):
                    ends.append(through[entry][ends[-1]])
                ends.reverse()
                starts = [entry, *ends[:-1]]
                out += [(key, x["segment"], a, b) for x, a, b in zip(lists, starts, ends)]
            yield _batch(["key", "segment", "entry", "exit"], [pa.string(), pa.int64(), pa.int32(), pa.int32()], out)

    groups = parts.groupBy("key", F.floor(F.col("segment") / FAN).cast("long").alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "ways"))).alias("parts"))
    return groups.join(chosen, ["key", "segment"]).select("key", "parts", "entry", "exit").mapInArrow(
        run, "key string, segment long, entry int, exit int")


def cheapest(segments: DataFrame) -> DataFrame:
    """Segments (key, segment, codes) with the way that is cheapest over the whole conversation.

    Adds ``entry`` and ``exit`` (numbers of stack tops), ``cost`` (of the conversation, the
    turns that its end is missing included), and keeps ``codes``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, number, codes = (c.to_pylist() for c in batch.columns)
            yield _batch(["key", "segment", "ways"], [pa.string(), pa.int64(), pa.list_(pa.int64())],
                         [(k, n, remembered(segment_ways, c, n == 0)) for k, n, c in zip(key, number, codes)])

    levels = [landed(segments.select("key", "segment", "codes").mapInArrow(run, "key string, segment long, ways array<long>"), "ways")]
    while not levels[-1].filter("segment > 0").isEmpty():
        levels.append(landed(_climb(levels[-1]), "ways"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, flat in zip(*(c.to_pylist() for c in batch.columns)):
                ends = [(w[0] + INSERT * len(LAST[t]), w[1], q) for q, (t, w) in enumerate(zip(TOPS, _ways(flat)[0])) if w != NONE]
                cost, _, leave = min(ends)
                out.append((key, 0, 0, leave, cost))
            yield _batch(["key", "segment", "entry", "exit", "cost"],
                         [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], out)

    top = levels[-1].select("key", "ways").mapInArrow(best, "key string, segment long, entry int, exit int, cost long")
    if len(levels) == 1:
        return segments.join(top, ["key", "segment"])
    top = landed(top, "costs")
    chosen = top.drop("cost")
    for parts in reversed(levels[:-1]):
        chosen = landed(_descend(parts, chosen), "chosen")
    # One cost a conversation; the segments of a long one are dealt by segment first.
    return segments.join(chosen.join(top.select("key", "segment", "cost"), ["key", "segment"], "left"), ["key", "segment"])


def _edited(chosen: DataFrame) -> DataFrame:
    """Per segment: audit, what happens to each turn, and the lines that the conversation's end gets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "segment", "codes", "entry", "exit", "cost")]
            out = []
            for key, number, codes, entry, leave, cost in zip(*columns):
                audit = remembered(parsed, codes, TOPS[entry])[TOPS[leave]][1]
                turns = [{"before": b, "edit": e, "role": r, "first": f} for b, e, r, f in replayed(codes, audit, TOPS[entry])]
                out.append((key, number, audit, TOPS[leave], turns, cost))
            action = pa.struct([("before", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("first", pa.bool_())])
            yield _batch(["key", "segment", "audit", "top", "turns", "cost"],
                         [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(action), pa.int64()], out)

    return chosen.select("key", "segment", "codes", "entry", "exit", "cost").mapInArrow(
        run, "key string, segment long, audit string, top string, "
             "turns array<struct<before: string, edit: string, role: string, first: boolean>>, cost long")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair conversations: a table of turns, their edits by segment, and the repaired text in pieces.

    ``rows`` has conv_id, turn, role and text; other columns are not looked at. Null roles and
    texts are one blank; a null conv_id is a conversation of its own; repeated rows stand side by
    side and all but the first are duplicates. An empty table gives empty tables.

    Turns come as of :func:`placed_turns`. Pieces (key, place, text), put end to end, are the lines
    ``role:text`` of the repaired conversation.
    """
    turns = placed_turns(rows)
    edits = landed(_edited(cheapest(landed(_coded(turns), "codes"))), "edits")
    met = turns.select("key", "position", "segment", "role", "text").join(
        edits.select("key", "segment", "turns"), ["key", "segment"])
    act = F.element_at("turns", (F.col("position") % SEGMENT + 1).cast("int"))
    line = F.concat(F.when(F.col("a.edit") == "K", F.col("role")).otherwise(F.col("a.role")), F.lit(":"), "text")
    body = F.concat_ws("\n", F.nullif(F.col("a.before"), F.lit("")), F.when(F.col("a.edit") != "D", line))
    pieces = (met.select("key", "position", "role", "text", act.alias("a"))
              .filter("a.edit <> 'D' OR a.before <> ''")
              .select("key", F.col("position").alias("place"),
                      F.when(F.col("a.first"), body).otherwise(F.concat(F.lit("\n"), body)).alias("text")))
    last = edits.groupBy("key").agg(F.max_by("top", "segment").alias("top"))
    tail = F.create_map(*[F.lit(x) for t in TOPS for x in (t, "".join(f"\n{NAMES[s]}:" for s in LAST[t]))])
    ends = last.select("key", F.lit((1 << 63) - 1).alias("place"), tail[F.col("top")].alias("text")).filter("text <> ''")
    return turns, edits, pieces.unionByName(ends)


def reports(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """A row per conversation of ``conv_ids``: its faults, and what the cheapest repair does.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows are as of :func:`repaired`; conversations without rows get zeros, an empty audit and the
    hash of the empty string. Repeated ids count once.
    """
    turns, edits, pieces = repaired(rows)
    pair = F.concat("prev_initial", "initial")
    counts = turns.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("prev_initial").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"))
    tails = F.create_map(*[F.lit(x) for t in TOPS for x in (t, "I" * len(LAST[t]))])
    audits = (edits.groupBy("key").agg(
        F.max("cost").alias("cost"), F.max_by("top", "segment").alias("top"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        .select("key", "cost", F.concat("audit", tails[F.col("top")]).alias("audit")))
    hashes = document_digest(pieces.select("key", F.lit(0).alias("part"), F.col("place").alias("ord"),
                                           F.lit(False).alias("item"), "text"), ["key"])
    ids = conv_ids.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    joined = ids.join(counts, "key", "left").join(audits, "key", "left").join(hashes, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c)
               for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Damage all conversations, then report on their repair; every original conv_id has a row."""
    return reports(damaged(conversations), conversations)
