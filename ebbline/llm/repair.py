"""Conversation structure repair: the cheapest edits that make roles read s?(ua)+, decided by scalar big-integer weights.

An automaton with four states (nothing yet, after system, after user, after assistant) reads a conversation's rows. Each row
owns a slot of three octal digits: up to two inserts, then the row's own letter (Delete 1, Insert 2, Keep 3, Rerole 4), then
zeros. A path's weight is one integer, its cost above all slots, so the least integer is the cheapest path, and of equally
cheap ones that with the ASCII-least audit: letters of a slot are a prefix code, and the zeros behind the last letter are
less than any letter. More than two inserts in one place come back to a state for more cost, so no slot needs them.

Rows are dealt by ranges of (conversation, turn, digest, id), so that a conversation of any length is spread over tasks. Most
conversations lie within one task and are finished there. A longer one, or one at the edge of a range, becomes blocks; each
block gives the least weights from each state to each state, and of the digits only their ranks are needed to choose between
blocks, so that sixteen costs and ranks stand for a block when the blocks of a conversation are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ebbline.llm.storage import materialize

#: Rows and characters of a block at most (a single row may be longer).
BLOCK_ROWS, BLOCK_CHARS = 1024, 8 << 20
LETTERS = "DIKR"
D, I, K, R = 1, 2, 3, 4
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
#: States, the role that may follow each and the state it leads to; cost and slot of what ends a conversation in each.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FOLLOWS = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
INSERTS = {START: (0, 1, 2), SYSTEM: (0, 1, 2), USER: (0, 1), ASSISTANT: (0, 1)}
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
SLOT_BITS = 9
SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
COUNTS = ("gaps", *FAULTS, "illegal", "cost")


def slot(inserts: int, letter: int) -> int:
    """Three octal digits: inserts, the letter, zeros."""
    digits = ([I] * inserts + [letter, 0, 0])[:3]
    return digits[0] * 64 + digits[1] * 8 + digits[2]


@cache
def moves(initial: str, doomed: bool, truncated: bool) -> list[list[tuple[int, int, int]]]:
    """By state: (state before, cost, slot) of the least move over one row from each state before it."""
    least: dict[tuple[int, int], tuple[int, int]] = {}
    for before in STATES:
        at = before
        for n in INSERTS[before]:
            here = [(at, DELETE_COST, D)]
            if not doomed:
                if initial == FOLLOWS[at][0]:
                    here.append((AFTER[at], TRUNCATED_COST * truncated, K))
                elif initial == "s" and at == START:
                    here.append((SYSTEM, TRUNCATED_COST * truncated, K))
                here.append((AFTER[at], REROLE_COST + TRUNCATED_COST * truncated, R))
            for after, cost, letter in here:
                option = (cost + n * INSERT_COST, slot(n, letter))
                least[before, after] = min(option, least.get((before, after), option))
            at = AFTER[at]
    return [[(b, *least[b, t]) for b in STATES if (b, t) in least] for t in STATES]


def weights(kinds: list[tuple[str, bool, bool]], entry: int, slots: int) -> list[int | None]:
    """Least weight of a path from entry to each state over these rows, as one integer: cost, then `slots` slots."""
    top, least = SLOT_BITS * slots, [None] * 4
    least[entry] = 0
    at = top
    for kind in kinds:
        at -= SLOT_BITS
        least = [min((least[b] + (cost << top) + (digits << at) for b, cost, digits in ways if least[b] is not None), default=None) for ways in moves(*kind)]
    return least


def letters(weight: int, slots: int) -> str:
    """The audit that the digits of a weight spell."""
    digits = weight & ((1 << SLOT_BITS * slots) - 1)
    return f"{digits:o}".replace("0", "").translate({ord(str(k + 1)): x for k, x in enumerate(LETTERS)})


def rendered(state: int, audit: str, roles: list[str], texts: list[str]) -> list[str]:
    """role:text of the rows that an audit leaves or adds, from a state on."""
    out, row = [], 0
    for letter in audit:
        if letter == "I":
            out.append(f"{FOLLOWS[state]}:")
            state = AFTER[state]
            continue
        if letter == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            state = SYSTEM if state == START and roles[row][0] == "s" else AFTER[state]
        elif letter == "R":
            out.append(f"{FOLLOWS[state]}:{texts[row]}")
            state = AFTER[state]
        row += 1
    return out


class Rows:
    """The rows of a stretch of one conversation, in order."""

    def __init__(self) -> None:
        self.turns, self.roles, self.texts, self.kinds, self.chars = [], [], [], [], 0
        self.faults = dict.fromkeys(FAULTS, 0)

    def add(self, turn: int | None, role: str, text: str, blank: bool, later: bool, cut: bool) -> None:
        fault = "blank" if blank else "duplicate" if later else "truncated" if cut else None
        if fault:
            self.faults[fault] += 1
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.chars += len(role) + len(text)

    def facts(self) -> dict:
        """Counts, and what is needed to add them up over stretches: first and last turn and initial."""
        known = [t for t in self.turns if t is not None]
        ends = [k[0] for k in self.kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ends, ends[1:], strict=False))
        return self.faults | {"turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "first": ends[0], "last": ends[-1], "illegal": illegal}

    def finished(self) -> dict:
        """All of a whole conversation's result."""
        slots = len(self.kinds) + 1
        least = weights(self.kinds, START, slots)
        best = min(w + (ENDING[s] * INSERT_COST << SLOT_BITS * slots) + (0, slot(1, 0), slot(2, 0))[ENDING[s]] for s, w in enumerate(least) if w is not None)
        audit, facts = letters(best, slots), self.facts()
        text = "\n".join(rendered(START, audit, self.roles, self.texts))
        gaps = facts["last_turn"] - facts["first_turn"] + 1 - facts["turns"] if facts["turns"] else 0
        return facts | {"whole": True, "gaps": gaps, "cost": best >> SLOT_BITS * slots, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def block(self) -> dict:
        """Sixteen costs, ranks of digits and audits, by state before and after; -1 where no path leads."""
        slots = len(self.kinds)
        ways = [w for entry in STATES for w in weights(self.kinds, entry, slots)]
        digits = [None if w is None else w & ((1 << SLOT_BITS * slots) - 1) for w in ways]
        rank = {d: r for r, d in enumerate(sorted({d for d in digits if d is not None}))}
        return self.facts() | {
            "whole": False,
            "costs": [-1 if w is None else w >> SLOT_BITS * slots for w in ways],
            "ranks": [-1 if d is None else rank[d] for d in digits],
            "audits": ["" if w is None else letters(w, slots) for w in ways],
            "roles": self.roles,
            "texts": self.texts,
        }


def chosen(costs: list[list[int]], ranks: list[list[int]]) -> tuple[list[int], int]:
    """State before each block and after the last, and the whole cost, from the costs and ranks of a conversation's blocks in order."""
    ahead = {s: (ENDING[s] * INSERT_COST, ENDING[s]) for s in STATES}
    ways = []
    for cost, rank in zip(reversed(costs), reversed(ranks), strict=True):
        found, way = {}, [None] * 4
        for entry in STATES:
            options = [(((cost[k] + ahead[s][0]) * 16 + rank[k]) * 16 + ahead[s][1], s) for s in STATES if cost[k := 4 * entry + s] >= 0 and s in ahead]
            if options:
                found[entry], way[entry] = min(options)
        order = {d: r for r, d in enumerate(sorted({w % 256 for w in found.values()}))}
        ahead = {s: (w // 256, order[w % 256]) for s, w in found.items()}
        ways.append(way)
    states = [START]
    for way in reversed(ways):
        states.append(way[states[-1]])
    return states, ahead[START][0]


def stretches_of(conv_type: T.DataType) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("part", "seq", *COUNTS, "turns", "first_turn", "last_turn")]
    strings = [T.StructField(n, T.StringType()) for n in ("first", "last", "audit", "repaired_sha256")]
    lists = [T.StructField(n, T.ArrayType(t)) for n, t in (("costs", T.LongType()), ("ranks", T.LongType()), ("audits", T.StringType()), ("roles", T.StringType()), ("texts", T.StringType()))]
    return T.StructType([T.StructField("conv_id", conv_type), T.StructField("whole", T.BooleanType()), *longs, *strings, *lists])


def in_arrow(rows: Iterator[dict], shape: pa.Schema, at_once: int = 500, chars: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append({n: row.get(n) for n in shape.names})
        size += sum(map(len, row.get("texts") or ()))
        if len(held) >= at_once or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=shape)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=shape)


def cut_into_stretches(shape: pa.Schema):
    """Over sorted rows: whole conversations finished, those that reach an edge of the partition or a block's size as blocks."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, seq, now, open_at_edge, rows = TaskContext.get().partitionId(), 0, None, True, None
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows is None:
                    now, rows = conv, Rows()
                elif conv != now:
                    yield {"conv_id": now, "part": part, "seq": seq} | (rows.block() if open_at_edge else rows.finished())
                    now, open_at_edge, rows = conv, False, Rows()
                    seq += 1
                elif len(rows.kinds) >= BLOCK_ROWS or rows.chars >= BLOCK_CHARS:
                    yield {"conv_id": now, "part": part, "seq": seq} | rows.block()
                    open_at_edge, rows = True, Rows()
                    seq += 1
                rows.add(*row)
        if rows is not None:
            yield {"conv_id": now, "part": part, "seq": seq} | rows.block()

    return lambda batches: in_arrow(stretches(batches), shape)


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Consecutive rows of one conv_id."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


def put_together(shape: pa.Schema):
    """Over the blocks of conversations without their texts, in order: the states at each block and, with the first, the counts."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, group in by_conversation(batches):
            blocks = list(group)
            states, cost = chosen([b["costs"] for b in blocks], [b["ranks"] for b in blocks])
            known = [b for b in blocks if b["turns"]]
            shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
            gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - sum(b["turns"] for b in known) + shared if known else 0
            seams = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:], strict=False))
            totals = {n: sum(b[n] for b in blocks) for n in (*FAULTS, "illegal")}
            totals |= {"gaps": gaps, "illegal": totals["illegal"] + seams, "cost": cost}
            for k, b in enumerate(blocks):
                yield {"conv_id": conv, "part": b["part"], "seq": b["seq"], "before": states[k], "after": states[k + 1], "n_last": ENDING[states[k + 1]] if k + 1 == len(blocks) else None} | (dict.fromkeys(COUNTS, 0) if k else totals)

    return lambda batches: in_arrow(decided(batches), shape)


def pieces(shape: pa.Schema):
    """Over blocks with their decisions: each block's part of the audit and of the repaired text."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                audit = row["audits"][4 * row["before"] + row["after"]]
                lines = rendered(row["before"], audit, row["roles"], row["texts"])
                if row["n_last"]:
                    audit += "I" * row["n_last"]
                    lines += rendered(row["after"], "I" * row["n_last"], [], [])
                yield row | {"audit": audit, "texts": lines}

    return lambda batches: in_arrow(spelled(batches), shape)


def digested(shape: pa.Schema):
    """Over the pieces of conversations, in order: one row each. The digest runs over the pieces; only the audit is held."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, group in by_conversation(batches):
            digest, audit, begun, counts = hashlib.sha256(), [], False, dict.fromkeys(COUNTS, 0)
            for piece in group:
                for line in piece["texts"]:
                    digest.update((b"\n" if begun else b"") + line.encode())
                    begun = True
                audit.append(piece["audit"])
                counts = {n: counts[n] + piece[n] for n in COUNTS}
            yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | counts

    return lambda batches: in_arrow(whole(batches), shape)


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults made by crc32 of conv_id:turn (a null is one space there and in role and text), modulo 20:
    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 doubles it, 4 makes its role user."""
    kind = (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20).cast("int")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space; rows without a conv_id are one conversation; null turns come first; rows of one turn
    stand in the order of the md5 of their role and text, so repeated rows stand together. A role whose first letter isn't s, u or a
    is never kept as it is. Other columns are ignored; an empty table gives no rows. The digest of a conversation is computed
    in one task (SHA-256 is sequential) over pieces of up to 1,024 rows.
    """
    spark, conv_type = turns.sparkSession, turns.schema["conv_id"].dataType
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    full = F.rtrim("text", F.lit(SPACE))
    rows = rows.select(
        "conv_id", "turn", "role", "text",
        (F.length(full) == 0).alias("blank"),
        (~F.substring(full, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"),
        F.monotonically_increasing_id().alias("id"),
    )
    rows = materialize(rows, "turns")
    seen = rows.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min(F.struct("turn", "id")).alias("least")).filter("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("digest").alias("g"), F.col("least.id").alias("first_id"))
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left")
    rows = rows.withColumn("later", F.coalesce(F.col("first_id") != F.col("id"), F.lit(False)))
    rows = rows.repartitionByRange("conv_id", "turn", "digest", "id").sortWithinPartitions("conv_id", "turn", "digest", "id")

    shape = stretches_of(conv_type)
    stretches = rows.select("conv_id", "turn", "role", "text", "blank", "later", "cut").mapInArrow(cut_into_stretches(to_arrow_schema(shape)), shape)
    stretches = materialize(stretches, "stretches")
    blocks = stretches.filter("not whole")

    slim = [n for n in shape.names if n not in ("audits", "roles", "texts", "audit", "repaired_sha256")]
    decision = T.StructType([shape[n] for n in ("conv_id", "part", "seq", *COUNTS)] + [T.StructField(n, T.LongType()) for n in ("before", "after", "n_last")])
    ordered = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    decisions = materialize(ordered(blocks.select(*slim)).mapInArrow(put_together(to_arrow_schema(decision)), decision), "decisions")
    spelled = T.StructType([shape[n] for n in ("conv_id", "part", "seq", *COUNTS, "audit", "texts")])
    spoken = blocks.select("part", "seq", "audits", "roles", "texts").join(decisions, ["part", "seq"]).mapInArrow(pieces(to_arrow_schema(spelled)), spelled)
    result = T.StructType([shape[n] for n in ("conv_id", *COUNTS, "audit", "repaired_sha256")])
    long_ones = ordered(spoken).mapInArrow(digested(to_arrow_schema(result)), result)
    return stretches.filter("whole").select(*result.names).unionByName(long_ones)
