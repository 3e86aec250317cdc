"""Conversation structure repair (13): the cheapest edits after which a conversation's roles alternate, by a rank-compressed DP.

A macro edit is a run of inserted turns and then what happens to one row. Its code, inserts before the row's letter, is
prefix-free, and codes are ordered, so audits (strings of codes) are compared code by code. The DP over the rows keeps for each
state (what the roles so far end with) the cost, and in place of the audit string its rank among the states of the same layer;
parent pointers say where it came from, and the audit is put together afterwards. Costs relative to the layer's least and ranks
take few values, so a layer is a lookup from the one before and the kind of row.

A conversation of any length is cut into blocks. Each tells for every state that it may be entered in what reaching every
state costs, and in which order its paths are; those tables are chained, some numbers for each block, and then every block is
gone through again, from the state that it is entered in to the one that it is left in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspring.llm.common import Scratch, partitions, trimmed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a block, as a power of two.
BLOCK_BITS = 13
#: Fixed value: what separates words.
SPACES = " \t\n\x0b\x0c\r"

#: States: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after one inserted turn: a user, or after a user an assistant.
INSERTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Letters of roles, and the states after which a row of that role may stand.
AFTER = {"s": (NOTHING,), "u": (NOTHING, SYSTEM, ASSISTANT), "a": (USER,)}
#: Codes of macro edits in their order. More than two inserts lead back to a state at a greater cost.
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
#: Inserts after the last row that end in a whole conversation.
ENDINGS = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Layer = tuple  # for each state (cost, rank), or None where it can't be reached


@lru_cache(maxsize=None)
def moves(letter: str, truncated: bool, doomed: bool) -> list[tuple[int, int, int, int]]:
    """(state, code, new state, cost) of every macro edit of a row: its role's letter, whether it is truncated, and whether it
    must be deleted."""
    out = []
    for state in STATES:
        for no, code in enumerate(CODES):
            at = state
            for _ in code[:-1]:
                at = INSERTED[at]
            cost = INSERT * (len(code) - 1)
            if code[-1] == "D":
                out.append((state, no, at, cost + DELETE))
            elif not doomed:
                cost += TRUNCATED * truncated
                if code[-1] == "R":
                    out.append((state, no, INSERTED[at], cost + REROLE))
                elif letter in AFTER and at in AFTER[letter]:
                    out.append((state, no, "_sua".index(letter), cost + KEEP))
    return out


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, letter: str, truncated: bool, doomed: bool) -> tuple[Layer, int, tuple]:
    """The next layer with its least cost taken off, that cost, and for each state its parent: (state, code)."""
    best: list = [None] * 4
    for state, code, to, cost in moves(letter, truncated, doomed):
        if layer[state] is not None:
            key = (layer[state][0] + cost, layer[state][1], code)
            if best[to] is None or key < best[to][0]:
                best[to] = (key, state)
    least = min(b[0][0] for b in best if b)
    order = sorted((b[0][1:], to) for to, b in enumerate(best) if b)
    rank = {to: i for i, (_, to) in enumerate(order)}
    made = tuple(None if b is None else (b[0][0] - least, rank[to]) for to, b in enumerate(best))
    return made, least, tuple(None if b is None else (b[1], b[0][2]) for b in best)


def entered(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


class Table:
    """What a block of rows does from every state; its rows are given one after the other."""

    def __init__(self):
        self.layers, self.costs = [entered(s) for s in STATES], [0] * 4

    def add(self, row: tuple[str, bool, bool]) -> None:
        for s in STATES:
            self.layers[s], more, _ = step(self.layers[s], *row)
            self.costs[s] += more

    def rows(self) -> list[int]:
        """Cost and rank from each state to each, -1 for none."""
        return [x for s in STATES for cell in self.layers[s] for x in ((self.costs[s] + cell[0], cell[1]) if cell else (-1, -1))]


def chained(tables: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of a conversation from its blocks' tables, and the states that each block is entered and left in."""
    layer: list = [(0, 0), None, None, None]
    parents = []
    for t in tables:
        best: list = [None] * 4
        for s in STATES:
            for to in STATES:
                cost, rank = t[8 * s + 2 * to : 8 * s + 2 * to + 2]
                if layer[s] is not None and cost >= 0:
                    key = (layer[s][0] + cost, layer[s][1], rank)
                    if best[to] is None or key < best[to][0]:
                        best[to] = (key, s)
        order = {to: i for i, (_, to) in enumerate(sorted((b[0][1:], to) for to, b in enumerate(best) if b))}
        layer = [None if b is None else (b[0][0], order[to]) for to, b in enumerate(best)]
        parents.append([None if b is None else b[1] for b in best])
    cost, _, at = min((layer[s][0] + INSERT * len(ENDINGS[s]), layer[s][1], s) for s in STATES if layer[s] is not None)
    ways = []
    for p in reversed(parents):
        ways.append((p[at], at))
        at = p[at]
    return cost, ways[::-1]


def block_codes(rows: list[tuple[str, bool, bool]], start: int, end: int) -> list[int]:
    """The codes of a block's rows on the best path between two states."""
    layer, parents = entered(start), []
    for row in rows:
        layer, _, p = step(layer, *row)
        parents.append(p)
    codes, at = [], end
    for p in reversed(parents):
        at, code = p[at]
        codes.append(code)
    return codes[::-1]


def damaged(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text and copy after the contract's damage; a null of any column is one space, but turn stays null."""
    of = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    h = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20
    rows = turns.select(turns["conv_id"].cast("long").alias("conv"), turns["turn"].cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"), h.alias("h")).where("h <> 0")
    role = F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def in_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with place, their order by conversation, turn (null first), role, text and copy, and block: rows of one conversation
    and block follow each other. Written once in sorted ranges, so a long conversation lies in several."""
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), "conv", "turn", "role", F.substring("text", 1, 64))
    placed = ranges.sortWithinPartitions("conv", "turn", "role", "text", "copy").withColumn("place", F.monotonically_increasing_id())
    return scratch.stored(placed.withColumn("block", F.shiftright("place", BLOCK_BITS)), "turns")


def kinds(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, turn, block, place, letter, blank, repeated and truncated of placed rows: each row's first fault."""
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    seen = rows.select("conv", "turn", "block", "place", F.substring("role", 1, 1).alias("letter"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"), said.alias("said"))
    # rows that say the same are brought together by their digest, and only places are kept of those that are repeated
    again = seen.groupBy("conv", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("conv").alias("c0"), F.col("said").alias("s0"), "first")
    held = seen.join(again, F.col("conv").eqNullSafe(F.col("c0")) & (F.col("said") == F.col("s0")), "left")
    repeated = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return scratch.stored(held.select("conv", "turn", "block", "place", "letter", "blank", repeated.alias("repeated"), (~F.col("blank") & ~repeated & F.col("open")).alias("truncated")), "kinds")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of kinds(), each block's in one task and in order."""
    return rows.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "place")


STATS = "n long, blank long, repeated long, truncated long, illegal long, first string, last string, turns long, low long, high long"


def illegal(before: str, letter: str) -> bool:
    return before + letter not in ("su", "ua", "au")


def block_tables(rows: DataFrame) -> DataFrame:
    """One row for each conversation's part of a block: its table, and what counts it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table, s = None, None, None
        out: list[dict] = []
        for batch in batches:
            for conv, turn, block, letter, blank, repeated, truncated in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "block", "letter", "blank", "repeated", "truncated")), strict=True):
                if table is None or key != (conv, block):
                    if table is not None:
                        out.append(s | {"table": table.rows()})
                    key, table = (conv, block), Table()
                    s = {"conv": conv, "block": block, "n": 0, "blank": 0, "repeated": 0, "truncated": 0, "illegal": 0, "first": letter, "last": None, "turns": 0, "low": None, "high": None}
                table.add((letter, truncated, blank or repeated))
                s["n"] += 1
                s["blank"] += blank
                s["repeated"] += repeated
                s["truncated"] += truncated
                s["illegal"] += s["last"] is not None and illegal(s["last"], letter)
                s["last"] = letter
                if turn is not None and turn != s["high"]:
                    s["turns"] += 1
                    s["low"], s["high"] = turn if s["low"] is None else s["low"], turn
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if table is not None:
            out.append(s | {"table": table.rows()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    of = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([("conv", pa.int64()), ("block", pa.int64()), *((f.split()[0], of[f.split()[1]]) for f in STATS.split(", ")), ("table", pa.list_(pa.int64()))])
    return blocks(rows).mapInArrow(trimmed(run), f"conv long, block long, {STATS}, table array<long>")


TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def chains(tables: DataFrame) -> DataFrame:
    """conv, block, start and end of each part, and with the last part of a conversation its totals and ending. One row comes
    for each part: as many as a conversation has blocks, at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def closed() -> list[dict]:
            cost, ways = chained([p["table"] for p in held])
            total = {k: sum(p[k] for p in held) for k in ("blank", "repeated", "truncated", "illegal")}
            turns, low, high, last = 0, None, None, None
            for p in held:
                total["illegal"] += last is not None and illegal(last, p["first"])
                last = p["last"]
                if p["turns"]:
                    turns += p["turns"] - (p["low"] == high)
                    low, high = p["low"] if low is None else low, p["high"]
            done = {"gaps": high - low + 1 - turns if turns else 0, "blank": total["blank"], "duplicate": total["repeated"], "truncated": total["truncated"], "illegal": total["illegal"], "cost": cost}
            rows = [{"conv": p["conv"], "block": p["block"], "start": a, "end": b, "ending": None} for p, (a, b) in zip(held, ways, strict=True)]
            rows[-1] |= done | {"ending": ENDINGS[ways[-1][1]]}
            return rows

        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if held and held[-1]["conv"] != p["conv"]:
                    out += closed()
                    held = []
                held.append(p)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(closed(), schema=arrow)

    arrow = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("ending", pa.string()), *((f.split()[0], pa.int64()) for f in TOTALS.split(", "))])
    ordered = tables.repartition(partitions(tables.sparkSession), "conv").sortWithinPartitions("conv", "block")
    return ordered.mapInArrow(trimmed(run), f"conv long, block long, start int, end int, ending string, {TOTALS}")


def row_codes(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """place and code of each row, its block gone through from the state that it is entered in."""
    joined = rows.join(ways.select(F.col("conv").alias("c0"), F.col("block").alias("b0"), "start", "end"), F.col("conv").eqNullSafe(F.col("c0")) & (F.col("block") == F.col("b0")))
    held = joined.select("conv", "block", "place", "letter", "truncated", (F.col("blank") | F.col("repeated")).alias("doomed"), "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, way, places, part = None, None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([CODES[c] for c in block_codes(part, *way)], pa.string())], names=["place", "code"])

        for batch in batches:
            for conv, block, place, letter, truncated, doomed, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if places and key != (conv, block):
                    yield done()
                    places, part = [], []
                key, way = (conv, block), (start, end)
                places.append(place)
                part.append((letter, truncated, doomed))
        if places:
            yield done()

    return blocks(held).mapInArrow(trimmed(run), "place long, code string")


def rebuilt(rows: DataFrame, codes: DataFrame, ways: DataFrame) -> DataFrame:
    """conv, audit and repaired_sha256. A conversation's rows stream by in order; its digest, its state and its audit's letters
    are all that is held of it."""
    last = ways.where("ending is not null").select("conv", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit((1 << 63) - 1).alias("place"), F.col("ending").alias("code"))
    every = rows.join(codes, "place").select("conv", "role", "text", "place", "code").unionByName(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, state, started = [], hashlib.sha256(), NOTHING, False

        def put(line: str) -> None:
            nonlocal started
            digest.update(("\n" if started else "").encode() + line.encode())
            started = True

        for batch in batches:
            out = []
            for conv, role, text, code in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text", "code")), strict=True):
                audit.append(code)
                for edit in code:
                    if edit == "I" or edit == "R":
                        state = INSERTED[state]
                        put(("user" if state == USER else "assistant") + ":" + ("" if edit == "I" else text))
                    elif edit == "K":
                        state = "_sua".index(role[0])
                        put(f"{role}:{text}")
                if role is None:  # the end of the conversation
                    out.append((conv, "".join(audit), digest.hexdigest()))
                    audit, digest, state, started = [], hashlib.sha256(), NOTHING, False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "audit", "repaired_sha256"])

    ordered = every.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "place")
    return ordered.select("conv", "role", "text", "code").mapInArrow(trimmed(run), "conv long, audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """For each conv_id of turns (conv_id, turn, role, text) gaps, blank, duplicate, truncated, illegal and cost (long), audit and
    repaired_sha256, after the contract's damage.

    Rows go by turn (null first), those of one turn by role, then text. A row's first fault counts: blank, a repetition of an
    earlier row's role and text, or an end without a full stop, exclamation or question mark. Audits are compared by code
    points. Nulls count as one space, in the text that is checksummed too, but a null turn stays null and a null conv_id is a
    conversation of its own; repeated rows are rows each. A conversation that loses all rows has zeros, an empty audit and the digest of nothing. An empty table gives no
    rows; other columns are ignored. A conversation's audit must fit into a row of Spark's; its texts needn't.
    """
    scratch = Scratch(turns.sparkSession)
    rows = in_order(damaged(turns), scratch)
    of_rows = kinds(rows, scratch)
    ways = scratch.stored(chains(block_tables(of_rows)), "ways")
    codes = scratch.stored(row_codes(of_rows, ways), "codes")
    made = rebuilt(rows, codes, ways).withColumnRenamed("conv", "c1")
    totals = ways.where("ending is not null").drop("block", "start", "end", "ending").withColumnRenamed("conv", "c0")
    every = turns.select(turns["conv_id"].cast("long").alias("conv_id")).distinct()
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    joined = every.join(totals, same("c0"), "left").join(made, same("c1"), "left")
    number: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (f.split()[0] for f in TOTALS.split(", "))]
    out = scratch.stored(joined.select("conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")), "repaired")
    scratch.drop(out)
    return out
