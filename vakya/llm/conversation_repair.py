"""Repair of the structure of conversations, by shortest paths found with an auction.

The rows of a conversation, in order, and the grammar of roles ``(s?(ua)+)?`` span a lattice: a node is (rows read,
state of the grammar), an arc keeps, reroles or deletes the next row or inserts a turn. The cheapest repair is a
shortest path. An auction finds it: every node has a price, a path grows from the origin along the arc with the least
cost plus price, and where that exceeds the last node's price, the price is raised and the path gives the node up.
Prices never exceed the distance left, so at the end every arc of a shortest path is tight (its cost is the difference
of the prices of its ends); the repair is the tight path with the least letters.

A conversation of any length is cut into blocks of at most 64 rows. Blocks are solved apart, each from the four states
to the four states; the resulting matrices are chained from the last block to the first, which gives each block the
prices of its exits; blocks are then traced apart, from each state, and a second chain picks the states. So no task
holds a conversation, and texts are shuffled once, by the conversation, to be given out in order.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: States: nothing yet, after the system's turn, after a user's turn, after an assistant's turn.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: What is still to be inserted after the last row, by state.
TAILS = ("", "II", "I", "")
ENDS = tuple(INSERT * len(x) for x in TAILS)
BLOCK_BITS = 6
SPACE = " \t\n\x0b\x0c\r"

Arc = tuple[str, int, int]  # letter, node that it leads to, cost


def row_arcs(state: int, initial: str, fault: str) -> list[tuple[str, int, int]]:
    """(letter, state, cost) of the ways to take one row. Faults are k (none), t (cut off), b (blank) and d (repeated)."""
    found = [("D", state, DELETE)]
    if fault in "kt":
        extra = CUT_OFF if fault == "t" else 0
        if (state, initial) in NEXT:
            found.append(("K", NEXT[state, initial], extra))
        found += [("R", NEXT[state, x], RETYPE + extra) for x in ROLES if x != initial and (state, x) in NEXT]
    return found


ROW_ARCS = {(q, i, f): row_arcs(q, i, f) for q in STATES for i in "suao" for f in "ktbd"}
INSERTS = {q: NEXT[q, x] for q in STATES for x in ROLES if (q, x) in NEXT}


def lattice(codes: str) -> list[list[Arc]]:
    """Arcs of each node of a block; node 4 * i + q is state q after i rows. Turns are inserted before a row only."""
    n = len(codes) // 2
    nodes: list[list[Arc]] = []
    for i in range(n):
        initial, fault = codes[2 * i], codes[2 * i + 1]
        for q in STATES:
            nodes.append([("I", 4 * i + INSERTS[q], INSERT), *((x, 4 * i + 4 + to, cost) for x, to, cost in ROW_ARCS[q, initial, fault])])
    return nodes + [[] for _ in STATES]


def reaches(nodes: list[list[Arc]], target: int, takes: Callable[[int, Arc], bool] = lambda i, arc: True) -> bytearray:
    """Marks the nodes with a path to the target over arcs that are taken."""
    found = bytearray(len(nodes))
    found[target] = 1
    for first in range((len(nodes) - 1) // 4 * 4, -1, -4):
        layer = range(min(first + 3, len(nodes) - 1), first - 1, -1)
        for _ in STATES:  # inserted turns stay in their layer
            for i in layer:
                if not found[i] and any(found[arc[1]] and takes(i, arc) for arc in nodes[i]):
                    found[i] = 1
    return found


def auction(nodes: list[list[Arc]], origin: int, target: int, price: list[int], alive: bytearray) -> None:
    """Raises the prices until ``price[origin] - price[target]`` is the length of the shortest path.

    The path is extended along the best arc while that keeps to the prices, and contracted with a raised price otherwise.
    """
    path = [origin]
    while path[-1] != target:
        i = path[-1]
        best, to = min((cost + price[j], j) for _, j, cost in nodes[i] if alive[j])
        if price[i] < best:
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


@lru_cache(1 << 14)  # short conversations look alike
def distances(codes: str) -> list[int]:
    """Cost from each state to each state over a block, row by row; -1 where there is no path."""
    nodes = lattice(codes)
    found = [-1] * 16
    for to in STATES:
        target = len(nodes) - 4 + to
        alive, price = reaches(nodes, target), [0] * len(nodes)
        for q in STATES:
            if alive[q]:
                auction(nodes, q, target, price, alive)
                found[4 * q + to] = price[q]
    return found


@lru_cache(1 << 14)
def traces(codes: str, exits: tuple[int, ...]) -> list[tuple[str, int]]:
    """From each state: the letters of the cheapest way through a block, given the prices of its exits, and the state it ends in; of equally cheap ways the one with the least letters."""
    nodes = lattice(codes)
    target, least = len(nodes), min(exits)
    for q in STATES:
        nodes[target - 4 + q] = [("", target, exits[q] - least)]
    nodes.append([])
    price, alive = [0] * len(nodes), bytearray(b"\1" * len(nodes))
    for q in STATES:
        auction(nodes, q, target, price, alive)
    tight = lambda i, arc: price[i] == arc[2] + price[arc[1]]
    good = reaches(nodes, target, tight)
    found = []
    for q in STATES:
        i, letters = q, []
        while i < target - 4:
            letter, i, _ = min(arc for arc in nodes[i] if good[arc[1]] and tight(i, arc))
            letters.append(letter)
        found.append(("".join(letters), i - (target - 4)))
    return found


def chained(matrix: list[int], exits: list[int]) -> list[int]:
    """Prices at the entry of a block, by its distances and the prices of its exits."""
    return [min(d + exits[to] for to, d in enumerate(matrix[4 * q : 4 * q + 4]) if d >= 0) for q in STATES]


def by_columns(f: Callable[..., Iterator[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function out of a generator over rows: ``f`` gets an iterator of all rows of the task and gives rows, which leave in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in f(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(rows) >= 1000 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)

    return run


def back_chain(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, block, codes, matrix) by conversation from the last block to the first -> (conv, block, codes, exits, last)."""
    now, exits = None, list(ENDS)
    for conv, block, codes, matrix in rows:
        last = conv != now
        if last:
            now, exits = conv, list(ENDS)
        yield conv, block, codes, exits, last
        exits = chained(matrix, exits)


def forth_chain(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, block, codes, last, letters and exit states from each state) in order -> (conv, block, letters, illegal pairs, cost)."""
    now, state, before = None, 0, ""
    for conv, block, codes, last, letters, ends in rows:
        if conv != now:
            now, state, before = conv, 0, ""
        initials = before + codes[::2]
        illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        took = letters[state] + (TAILS[ends[state]] if last else "")
        yield conv, block, took, illegal, price_of(took, codes)
        state, before = ends[state], codes[-2]


def price_of(letters: str, codes: str) -> int:
    """What the edits of a block cost."""
    total, i = 0, 0
    for x in letters:
        if x == "I":
            total += INSERT
            continue
        total += {"K": 0, "R": RETYPE, "D": DELETE}[x] + (CUT_OFF if x != "D" and codes[2 * i + 1] == "t" else 0)
        i += 1
    return total


def apply_edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, letters or null, role, text) in order, the letters of a block before its first row -> (conv, edit, role, text) of the turns that stay or are inserted."""
    now, state, letters = None, 0, deque()

    def inserted() -> Iterator[tuple]:
        nonlocal state
        while letters and letters[0] == "I":
            letters.popleft()
            state = INSERTS[state]
            yield now, "I", ROLES["u" if state == 2 else "a"], ""

    for conv, more, role, text in rows:
        if conv != now:
            yield from inserted()
            now, state = conv, 0
            letters.clear()
        if more is not None:
            letters.extend(more)
            continue
        yield from inserted()
        edit = letters.popleft()
        if edit == "K":
            state = NEXT[state, role[:1]]
            yield now, edit, role, text
        elif edit == "R":
            state = INSERTS[state]  # the only role that a row can be given in this state
            yield now, edit, ROLES["u" if state == 2 else "a"], text
    yield from inserted()


def marked(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """__conv (a text, never null), conv_id, turn, role, text, digest; null roles and texts are one space."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")), F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    conv = F.coalesce(F.concat(F.lit(":"), F.col(f"`{conv_col}`").cast("string")), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return df.select(conv.alias("__conv"), F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def coded(rows: DataFrame) -> DataFrame:
    """The rows without their texts, in order over all tasks and numbered, with initial and fault; written, as the numbers must not change."""
    ends = F.rtrim("text", F.lit(SPACE))
    fault = F.when(ends == "", "b").when(F.right(ends, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    small = rows.select("__conv", "conv_id", "turn", "digest", initial.alias("initial"), fault.alias("fault"))
    ordered = written(small.orderBy("__conv", F.asc_nulls_first("turn"), "digest").withColumn("at", F.monotonically_increasing_id()))
    first = ordered.where("fault <> 'b'").groupBy("__conv", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.when(F.col("at") > F.col("first"), "d").otherwise(F.col("fault"))
    return ordered.join(first, ["__conv", "digest"], "left").withColumn("fault", again).drop("first")


def find_repairs(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest repair: a written table with a row for each block of at most 64 rows of a conversation.

    Columns: __conv, block, conv_id, turn and digest of the block's first row, letters (of its edits; those of the last
    block end with what is inserted after it), illegal, cost, and the numbers of blank, duplicate and truncated rows.
    Rows with the same turn are taken in the order of the MD5 of role and text; null turns come first; a null id is a
    conversation of its own; null roles and texts count as one space. An empty table gives no blocks.
    """
    session = df.sparkSession
    small_batches(session)
    rows = coded(marked(df, conv_col, turn_col, role_col, text_col)).withColumn("block", F.shiftright("at", BLOCK_BITS))
    first = lambda c: F.min_by(c, "at").alias(c)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("initial", "fault").alias("code")))), lambda x: x["code"]), "")
    count = lambda f, name: F.count_if(F.col("fault") == f).alias(name)
    blocks = written(rows.groupBy("__conv", "block").agg(codes.alias("codes"), first("conv_id"), first("turn"), first("digest"), count("b", "blank"), count("d", "duplicate"), count("t", "truncated")))

    text, long, longs = pa.string(), pa.int64(), pa.list_(pa.int64())
    keys = [("conv", text), ("block", long)]

    def measure(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, block, codes in rows:
            yield conv, block, codes, distances(codes)

    def trace(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, block, codes, exits, last in rows:
            found = traces(codes, tuple(exits))
            yield conv, block, codes, last, [x for x, _ in found], [x for _, x in found]

    def arrow(source: DataFrame, f: Callable, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
        return source.mapInArrow(by_columns(f, pa.schema(fields)), ddl)

    measured = arrow(blocks.select("__conv", "block", "codes"), measure, [*keys, ("codes", text), ("matrix", longs)], "conv string, block long, codes string, matrix array<long>")
    back = measured.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    exits = arrow(back, back_chain, [*keys, ("codes", text), ("exits", longs), ("last", pa.bool_())], "conv string, block long, codes string, exits array<long>, last boolean")
    traced = arrow(exits, trace, [*keys, ("codes", text), ("last", pa.bool_()), ("letters", pa.list_(text)), ("ends", longs)], "conv string, block long, codes string, last boolean, letters array<string>, ends array<long>")
    forth = traced.repartition("conv").sortWithinPartitions("conv", "block")
    chosen = arrow(forth, forth_chain, [*keys, ("letters", text), ("illegal", long), ("cost", long)], "conv string, block long, letters string, illegal long, cost long").withColumnRenamed("conv", "__conv")
    return written(blocks.drop("codes").join(chosen, ["__conv", "block"]))


def repair_report(df: DataFrame, repairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A row for each conversation: conv_id, gaps (missing numbers of turns between the least and the greatest), blank, duplicate, truncated and illegal (rows, and pairs of neighbours that the grammar forbids), cost, audit (letters of the edits in order)."""
    kinds = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "")
    found = repairs.groupBy("__conv").agg(F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in kinds], audit.alias("audit"))
    conv = F.coalesce(F.concat(F.lit(":"), F.col(f"`{conv_col}`").cast("string")), F.lit(""))
    turns = df.select(conv.alias("__conv"), F.col(f"`{turn_col}`").alias("turn"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return found.join(turns.groupBy("__conv").agg(gaps.alias("gaps")), "__conv").select("conv_id", "gaps", *kinds, "audit")


def repaired_turns(df: DataFrame, repairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """__conv, edit (K, R or I), role, text of the repaired conversations. A conversation's turns lie in one task, in order, and pass through it row by row."""
    small_batches(df.sparkSession)
    rows = marked(df, conv_col, turn_col, role_col, text_col).select("__conv", "turn", "digest", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("letters"), "role", "text")
    edits = repairs.select("__conv", "turn", "digest", F.lit(0).alias("kind"), "block", "letters", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    ordered = rows.unionByName(edits).repartition("__conv").sortWithinPartitions("__conv", F.asc_nulls_first("turn"), "digest", "kind", "block")
    fields = pa.schema([("__conv", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return ordered.select("__conv", "letters", "role", "text").mapInArrow(by_columns(apply_edits, fields), "__conv string, edit string, role string, text string")


def turn_digests(turns: DataFrame) -> DataFrame:
    """__conv, repaired_sha256 of ``role:text`` of the turns of ``repaired_turns``, joined by line feeds, hashed as they pass."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, found = None, None
        for conv, role, text in rows:
            if found is None or conv != now:
                if found is not None:
                    yield now, found.hexdigest()
                now, found = conv, hashlib.sha256()
            else:
                found.update(b"\n")
            found.update(f"{role}:{text}".encode("utf-8", "replace"))
        if found is not None:
            yield now, found.hexdigest()

    return turns.select("__conv", "role", "text").mapInArrow(by_columns(run, pa.schema([("__conv", pa.string()), ("sha", pa.string())])), "__conv string, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults, chosen by the CRC of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its end marks away, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    hurt = df.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them; a row for every conversation, with the report and the digest of its repaired turns. One that has lost all rows has zeros and the digest of the empty text."""
    rows = damaged(conversations)
    repairs = find_repairs(rows)
    report = repair_report(rows, repairs)
    conv = F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))
    ids = conversations.select(conv.alias("__conv"), "conv_id").distinct()
    hashed = turn_digests(repaired_turns(rows, repairs))
    found = ids.join(report.withColumn("__conv", conv).drop("conv_id"), "__conv", "left").join(hashed, "__conv", "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
