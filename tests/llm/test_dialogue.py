"""Conversation repair against a plain shortest path, whole and in chunks."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from facsimile.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, seq string, audit int, _c0 string"
BLANK = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        text = " " if text is None else text
        role = " " if role is None else role
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def plain_repair(rows):
    """Rows (turn, role, text) of one conversation, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    due = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    kept = {(0, "s"), (0, "u"), (1, "u"), (2, "a"), (3, "u")}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, put):
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, "", ()))

        def way(price, letter, then, line):
            if then is not None:
                ways.append((price + then[0], letter + then[1], line + then[2]))

        if put < 2:
            way(2, "I", best(i, after[due[state]], put + 1), (full[due[state]] + ":",))
        if i < len(rows):
            _, role, text = rows[i]
            way(3, "D", best(i + 1, state, 0), ())
            if faults[i] not in ("blank", "duplicate"):
                t = 1 if faults[i] else 0
                if (state, role[:1]) in kept:
                    way(t, "K", best(i + 1, after[role[:1]], 0), (role + ":" + text,))
                way(t + 2, "R", best(i + 1, after[due[state]], 0), (full[due[state]] + ":" + text,))
        return min(ways) if ways else None

    cost, audit, lines = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(original, damaged):
    by = {}
    for conv, turn, role, text in damaged:
        by.setdefault(conv, []).append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16])
    return {conv: plain_repair(sorted(by.get(conv, []), key=key)) for conv in {r[0] for r in original}}


def made(seed, conversations, most, long=()):
    draw = random.Random(seed)
    rows = []
    for c in list(range(conversations)) + [None]:
        n = draw.choice(long) if long and draw.random() < 0.3 else draw.randint(1, most)
        for t in range(n):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "u", "User"]) if draw.random() < 0.4 else ["user", "assistant"][t % 2]
            text = draw.choice(["Yes.", "No!", "well", "", " \t\n", None, "So?  ", "x" * 50 + ".", f"say {t}.", f"say {draw.random()}."])
            turn = None if draw.random() < 0.05 else t if draw.random() < 0.9 else draw.randint(0, n)
            rows.append((c, turn, role, text, "z", 1, "q"))
            if draw.random() < 0.05:
                rows.append(rows[-1])
    return rows


def compare(found, expected):
    rows = {r[0]: tuple(r)[1:] for r in found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert rows.keys() == expected.keys()
    for c in expected:
        assert rows[c] == expected[c], c


def test_repair_equals_the_plain_path(spark):
    rows = made(1, 150, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    compare(dialogue.summary(df, dialogue.damage(df)), plain(rows, plain_damage(rows)))


@pytest.mark.parametrize("passes", [0, 1, 5])
def test_chunks_of_long_conversations(spark, passes):
    rows = made(2, 6, 60, long=(200, 300))
    # alternating rows hand their end's demands on from chunk to chunk
    rows += [(100, t, ["assistant", "user"][t % 2], f"so {t}.", None, None, None) for t in range(150)]
    rows += [(101, t, "user", "again.", None, None, None) for t in range(90)] + [(102, None, "user", "same.", None, None, None)] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    try:
        compare(dialogue.summary(df, df, dialogue.Settings(passes)), plain(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]))
    finally:
        spark.conf.unset(name)


def test_a_rerun_stops_where_only_a_constant_changes():
    draw = random.Random(3)
    codes, counts = [draw.choice([1, 2, 0, 5, 6, 8]) for _ in range(5000)], [1] * 5000
    first = dialogue.backward(codes, counts, dialogue.END)
    for right in ((3, 1, 0, 2), (9, 9, 9, 9)):
        assert dialogue.backward(codes, counts, right, first) == dialogue.backward(codes, counts, right)


def test_repaired_rows_read_in_order(spark):
    rows = [(1, 0, "user", "Hi.", None, None, None), (1, 1, "user", "Hi.", None, None, None), (1, 2, "assistant", "Yes.", None, None, None), (1, 3, "user", "Why?", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, chunks = dialogue.edits(df, role="role")
    order = ["conv", "end", F.asc_nulls_first("turn"), "role", "key", "step"]
    read = [(r["role_after"], r["text"]) for r in dialogue.repaired(df, chunks).orderBy(*order).collect()]
    assert read == [("user", "Hi."), ("assistant", "Yes."), ("user", "Why?"), ("assistant", "")]


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.summary(empty, dialogue.damage(empty)).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "x", None, None, None)], SCHEMA)
    r = dialogue.summary(gone, empty).first()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
