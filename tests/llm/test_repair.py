import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from ebbline.llm import queries, repair

SHAPE = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
FIRST_STATES = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order(row):
    return (row[1] is not None, row[1] or 0, hashlib.md5(f"{len(row[2])}:{row[2]}{row[3]}".encode()).hexdigest())


def repaired(rows):
    """All results of one conversation, by search over every sequence of edits (three inserts in a place at most)."""
    rows = sorted(rows, key=order)
    seen, kinds = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    full = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        options = []
        if inserts < 3:
            options += [(2, "I", (f"{full[r]}:",), i, r, inserts + 1) for r in FIRST_STATES[state] if r in full]
        if i < len(rows):
            _, _, role, text = rows[i]
            options.append((3, "D", (), i + 1, state, 0))
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                if role[:1] and role[:1] in FIRST_STATES[state]:
                    options.append((more, "K", (f"{role}:{text}",), i + 1, role[:1], 0))
                options += [(2 + more, "R", (f"{full[r]}:{text}",), i + 1, r, 0) for r in FIRST_STATES[state] if r in full]
        found = []
        for cost, letter, lines, *to in options:
            if rest := best(*to):
                found.append((cost + rest[0], letter + rest[1], lines + rest[2]))
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    known = [t for _, t, _, _ in rows if t is not None]
    ends = [r[2][:1] for r in rows]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        **{f: kinds.count(f) for f in repair.FAULTS},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(ends, ends[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def by_conversation(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def conversations(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "umpire"], ["Yes.", "No", " ", "", None, "ends! ", "a.\n", "x\xa0", "?"]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)))
    return rows + rows[:20]


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_a_search_over_all_edits(spark, monkeypatch, block):
    """With blocks of three rows most conversations are put together from blocks."""
    rows = conversations(random.Random(block), 150)
    shape = repair.stretches_of(spark.createDataFrame([], SHAPE).schema["conv_id"].dataType)
    real = repair.cut_into_stretches

    def cut(arrow):
        def task(batches):
            repair.BLOCK_ROWS = block
            return real(arrow)(batches)

        return task

    monkeypatch.setattr(repair, "cut_into_stretches", cut)
    wide = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("digest", "id", "later", "part", "seq", "kind", "audit")}).repartition(3)
    got = {r.conv_id: r.asDict() for r in repair.repair_conversations(wide).collect()}
    assert shape.names[0] == "conv_id"
    want = by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert got[conv] == {"conv_id": conv} | repaired(turns), turns


def test_query_on_damaged_rows(spark, tmp_path):
    rows = conversations(random.Random(8), 60) + [(1000 + i, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for i in range(40) for t in range(6)]
    rows += [(c, 0, "user", "x") for c in range(5000, 5100)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    after = by_conversation(damaged(rows))
    empty = dict.fromkeys(repair.COUNTS, 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert got.keys() == {r[0] for r in rows} and len(after) < len(got)
    for conv, row in got.items():
        assert row == {"conv_id": conv} | (repaired(after[conv]) if conv in after else empty)


def test_slots_are_in_the_order_of_audits():
    rng = random.Random(3)
    slots = [repair.slot(n, k) for n in range(3) for k in (repair.D, repair.K, repair.R)]
    spell = lambda x: "".join(repair.letters(s, 1) for s in x)
    for _ in range(500):
        a, b = ([rng.choice(slots) for _ in range(4)] for _ in range(2))
        assert (a < b) == (spell(a) < spell(b))


def test_a_conversation_of_many_blocks_and_an_empty_table(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "again."])) for t in range(2500)] + [(1, 0, "user", "a."), (9, 3, "assistant", "b.")]
    got = {r.conv_id: r for r in repair.repair_conversations(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()}
    ordered = repair.Rows()
    seen = set()
    for _, turn, role, text in rows[:2500]:
        ordered.add(turn, role, text, False, (role, text) in seen, text[-1] != ".")
        seen.add((role, text))
    want = ordered.finished()
    assert all(got[7][n] == want[n] for n in (*repair.COUNTS, "audit", "repaired_sha256"))
    assert got[1].audit == "KI" and got[9].audit == "IK" and got[1].cost == 2
    assert repair.repair_conversations(spark.createDataFrame([], SHAPE)).count() == 0
