"""Repair of conversation structure: the cheapest edits that make the roles alternate, and their least audit.

Roles must read ``(s?(ua)+)?`` by their initials.  Rows are kept, get the other role, are deleted, or rows with empty text are
put in between; the cheapest way is a shortest path over four states (nothing yet, after a system, a user, an
assistant row), found backwards: a vector of four costs to go stands at every row.

Long conversations are cut into chunks (at most a batch of sorted rows), which start at once, each from a speculative cost vector
at its end.  Fix-up passes hand every chunk the vector of its successor and rerun it from its end, until
its vector differs from that of its last run by a constant only: from there on all costs move by that constant.
Passes end when no chunk's right end changed.  A conversation that has not converged after ``passes`` of them
gets the min-plus maps of its chunks multiplied in doubling rounds, so that rounds grow with the logarithm of its chunks.
Then the stitched costs are traced forwards: at every row the ASCII-least edit that stays cheapest.  A chunk
traces from each state that it may be entered in; which it is follows from the chunks before, again by doubling.

Equal rows of one turn are one row with a number, so a row that repeats without end is one step.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import drop_stored, stored

#: Prices of the edits, blank characters, ends of a complete text.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
BLANK = " \t\n\x0b\x0c\r"
COMPLETE = (".", "!", "?")
INITIALS = ("s", "u", "a")
ROLES = {2: "user", 3: "assistant"}

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; the state after a row of the role that is due.
DUE = (2, 2, 3, 2)
#: By state and initial (s, u, a): the state after a kept row.
KEPT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: Costs at the end of a conversation: what is missing is put in.
END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 50
_EVERY = 256  # rows between the vectors that a chunk remembers


@dataclass(frozen=True)
class Settings:
    passes: int = 3


def _before(code: int, n: int, v: tuple) -> tuple:
    """Costs to go before ``n`` equal rows, from those after them.  code: initial (3: another) + 4 * fault (1: cut off, 2: must go)."""
    fault, initial = code >> 2, code & 3
    if fault == 2:
        d = DELETE * n
        return (v[0] + d, v[1] + d, v[2] + d, v[3] + d)
    d = DELETE * (n - 1)
    user, assistant = v[2] + d, v[3] + d
    c0, c1, c2, c3 = v[0] + d + DELETE, v[1] + d + DELETE, user + DELETE, assistant + DELETE
    t = CUT if fault else 0
    as_user, as_assistant = t + (user if initial == 1 else user + REROLE), t + (assistant if initial == 2 else assistant + REROLE)
    c0, c1, c2, c3 = min(c0, as_user), min(c1, as_user), min(c2, as_assistant), min(c3, as_user)
    if initial == 0:
        c0 = min(c0, t + v[1] + d)
    return (
        min(c0, c2 + INSERT, c3 + 2 * INSERT), min(c1, c2 + INSERT, c3 + 2 * INSERT),
        min(c2, c3 + INSERT), min(c3, c2 + INSERT))


def _flat(v) -> tuple:
    return tuple(x - v[0] for x in v)


def backward(codes, counts, right: tuple, old: tuple | None = None) -> tuple[tuple, list]:
    """(costs at the start, remembered vectors).  ``old``: the same of an earlier run from another vector;
    the run stops where its vector differs from the remembered one by a constant."""
    v, marks = right, []
    for i in range(len(codes) - 1, -1, -1):
        v = _before(codes[i], counts[i], v)
        if i % _EVERY == 0:
            if old is not None:
                seen = old[1][len(marks)]
                if _flat(seen) == _flat(v):
                    by = v[0] - seen[0]
                    marks += [tuple(x + by for x in m) for m in old[1][len(marks):]]
                    return tuple(x + by for x in old[0]), marks
            marks.append(v)
    return v, marks


def trace(codes, counts, right: tuple, state: int, end: bool) -> tuple[list, list, list, str, int, int]:
    """From ``state`` on: inserted roles before each row, its edit, its state after, what is inserted at the end, the last state, the cost."""
    costs = [right]
    for code, n in zip(reversed(codes), reversed(counts)):
        costs.append(_before(code, n, costs[-1]))
    costs.reverse()
    before, edits, after, paid = [], [], [], 0
    for i, (code, n) in enumerate(zip(codes, counts)):
        fault, initial = code >> 2, code & 3
        t, more = (CUT if fault == 1 else 0), DELETE * (n if fault == 2 else n - 1)
        put, follow = "", costs[i + 1]
        here = costs[i][state]
        while True:
            # ASCII order: Delete, Insert, Keep, Rerole
            if fault == 2 and here == follow[state] + more or fault != 2 and here == follow[state] + more + DELETE:
                edit, cost = "D", more + (0 if fault == 2 else DELETE)
                break
            due = DUE[state]
            if len(put) < 2 and here == INSERT + costs[i][due]:
                put, state, here = put + "ua"[due - 2], due, here - INSERT
                paid += INSERT
                continue
            kept = KEPT[state][initial] if initial < 3 else None
            if fault != 2 and kept is not None and here == t + more + follow[kept]:
                edit, state, cost = "K", kept, t + more
                break
            edit, state, cost = "R", due, t + REROLE + more
            break
        paid += cost
        before.append(put)
        edits.append(edit)
        after.append(state)
    tail = ""
    while end and state in (1, 2):
        state = DUE[state]
        tail += "ua"[state - 2]
        paid += INSERT
    return before, edits, after, tail, state, paid


def times(a, b) -> list:
    """Min-plus product of two maps of four states, row by row."""
    return [min(a[4 * i + k] + b[4 * k + j] for k in range(4)) for i in range(4) for j in range(4)]


UNIT = [0 if i == j else _FAR for i in range(4) for j in range(4)]


def runs(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, key, n, fault): equal rows of one turn, with the first fault of the first and ``again`` for the rest.

    fault: blank, duplicate, truncated or null.
    """
    said = F.coalesce(F.col(text), F.lit(" "))
    bare = F.rtrim(said, F.lit(BLANK))
    slim = rows.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        _key(said).alias("key"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*COMPLETE)).alias("cut"))
    counted = stored(slim.groupBy("conv", "turn", "role", "key", "blank", "cut").agg(F.count(F.lit(1)).alias("n")), "runs")
    # texts that come again in a later turn
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = counted.where(~F.col("blank")).groupBy("conv", "role", "key").agg(F.count(F.lit(1)).alias("turns"), F.min(place).alias("first")).where(F.col("turns") > 1)
    again = stored(again.select(F.col("conv").alias("c"), F.col("role").alias("o"), F.col("key").alias("k"), F.col("first.turn").alias("first")), "again")
    joined = counted.join(again, counted["conv"].eqNullSafe(again["c"]) & (counted["role"] == again["o"]) & (counted["key"] == again["k"]), "left")
    later = F.col("k").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated")
    return joined.select("conv", "turn", "role", "key", "n", fault.alias("fault"))


def _key(said: Column) -> Column:
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def _packed(conv: pa.DataType):
    """Chunks of a conversation within a batch of sorted rows; the first and last of a batch may go on elsewhere."""
    def pack(batches):
        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0)
            here, last = ids.slice(1), ids.slice(0, n - 1)
            same = pa.compute.coalesce(pa.compute.equal(here, last), pa.compute.and_(pa.compute.is_null(here), pa.compute.is_null(last)))
            fresh = np.concatenate([[0], 1 + np.flatnonzero(~same.to_numpy(zero_copy_only=False)), [n]])
            offsets = pa.array(fresh, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in range(1, 6)]
            chunks = len(fresh) - 1
            open_ = np.zeros(chunks, bool)
            open_[[0, -1]] = True
            numbers = pa.array(np.arange(seq, seq + chunks), pa.int64())
            seq += chunks
            yield pa.RecordBatch.from_arrays([ids.take(offsets.slice(0, chunks)), numbers, pa.array(open_), *lists],
                                             names=["conv", "seq", "open", "turns", "roles", "keys", "ns", "codes"])
    return pack


_MARKS = "left array<long>, marks array<array<long>>, right array<long>"


def _rerun(batches):
    """Chunks whose right end moved run again, and stop where nothing but a constant has changed."""
    for rows in batches:
        left, marks, right, moved = [], [], [], []
        for codes, ns, l, m, r, new in zip(rows["codes"], rows["ns"], rows["left"], rows["marks"], rows["right"], rows["fresh"]):
            old = (tuple(l), [tuple(x) for x in m]) if l is not None else None
            wanted = tuple(new) if new is not None else tuple(r) if r is not None else END
            if old is not None and _flat(wanted) == _flat(r):
                by = wanted[0] - r[0]
                l, m = tuple(x + by for x in old[0]), [tuple(x + by for x in y) for y in old[1]]
            else:
                l, m = backward(list(codes), list(ns), wanted, old)
            moved.append(old is None or _flat(l) != _flat(old[0]))
            left.append(list(l)), marks.append([list(x) for x in m]), right.append(list(wanted))
        yield rows.drop(columns=["fresh"]).assign(left=left, marks=marks, right=right, moved=moved)


def _maps(kind: str):
    """The map of a chunk over the states: its costs from each state to each, or where its trace leaves it."""
    def of(batches):
        for rows in batches:
            made = []
            for codes, ns, right, end in zip(rows["codes"], rows["ns"], rows["right"], rows["end"]):
                codes, ns = list(codes), list(ns)
                if kind == "costs":
                    columns = [backward(codes, ns, tuple(0 if i == j else _FAR for i in range(4)))[0] for j in range(4)]
                    made.append([min(columns[j][i], _FAR) for i in range(4) for j in range(4)])
                else:
                    left = [trace(codes, ns, tuple(right), s, bool(end))[4] for s in range(4)]
                    made.append([0 if left[i] == j else _FAR for i in range(4) for j in range(4)])
            yield pd.DataFrame({"conv_at": rows["conv_at"], "at": rows["at"], "seq": rows["seq"], "m": made})
    return of


def _products(maps: DataFrame, step: int, most: int) -> DataFrame:
    """(seq, m): the product of the maps from each chunk to its conversation's last (step 1) or first (step -1), by doubling."""
    @F.pandas_udf("array<long>")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        forward = step > 0
        return pd.Series([list(x) if y is None else [min(v, _FAR) for v in (times(x, y) if forward else times(y, x))] for x, y in zip(a, b)])

    span = 1
    while span < most:
        other = maps.select("conv_at", (F.col("at") - step * span).alias("at"), F.col("m").alias("further"))
        maps = stored(maps.join(other, ["conv_at", "at"], "left").select("conv_at", "at", "seq", product("m", "further").alias("m")), "maps")
        span *= 2
    return maps


def _stitched(parts: DataFrame, settings: Settings) -> DataFrame:
    """Open chunks with the costs at their right end and the state they are entered in."""
    # one row a chunk: its place in its conversation; null conversations are one like others
    order = W.partitionBy("conv").orderBy("seq")
    index = parts.select("conv", "seq").withColumn("at", F.row_number().over(order)).withColumn("chunks", F.count(F.lit(1)).over(W.partitionBy("conv")))
    index = stored(index.select("seq", "at", "chunks", F.min("seq").over(W.partitionBy("conv")).alias("conv_at")), "chunks")
    most = index.agg(F.max("chunks")).first()[0] or 1
    body = parts.join(index, "seq").withColumn("end", F.col("at") == F.col("chunks"))
    schema = body.select("conv", "seq", "turns", "roles", "keys", "ns", "codes", "at", "chunks", "conv_at", "end")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields) + f", {_MARKS}, moved boolean"
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("left", "array<long>"), ("marks", "array<array<long>>"), ("right", "array<long>"), ("fresh", "array<long>"))]
    state = stored(schema.select("*", *nothing).mapInPandas(_rerun, ddl), "vectors")

    def passed_on(state: DataFrame, only: Column) -> DataFrame:
        given = state.where(only).select("conv_at", (F.col("at") - 1).alias("at"), F.col("left").alias("fresh"))
        return stored(state.drop("moved").join(given, ["conv_at", "at"], "left").select(*schema.columns, "left", "marks", "right", "fresh").mapInPandas(_rerun, ddl), "vectors")

    for n in range(settings.passes):
        if most == 1 or n and not state.where("moved").limit(1).count():
            break
        old, state = state, passed_on(state, F.lit(True))
        drop_stored(old)
    if most > 1 and state.where("moved").limit(1).count():
        slow = state.select("conv_at", "at", "seq", "codes", "ns", "right", "end").mapInPandas(_maps("costs"), "conv_at long, at int, seq long, m array<long>")
        far = _products(stored(slow, "maps"), 1, most)
        cost = lambda s: F.least(*[F.col("m")[4 * s + j] + F.lit(END[j]) for j in range(4)])
        given = far.select("conv_at", (F.col("at") - 1).alias("at"), F.array(*[cost(s) for s in range(4)]).alias("fresh"))
        state = stored(state.drop("moved").join(given, ["conv_at", "at"], "left").select(*schema.columns, "left", "marks", "right", "fresh").mapInPandas(_rerun, ddl), "vectors")
    if most == 1:
        return state.withColumn("state", F.lit(0))
    ways = state.select("conv_at", "at", "seq", "codes", "ns", "right", "end").mapInPandas(_maps("states"), "conv_at long, at int, seq long, m array<long>")
    led = _products(stored(ways, "maps"), -1, most)
    entry = led.select("conv_at", (F.col("at") + 1).alias("at"), (F.array_position(F.slice("m", 1, 4), 0) - 1).cast("int").alias("state"))
    return state.join(entry, ["conv_at", "at"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


def _traced(batches):
    for rows in batches:
        out = {c: [] for c in ("audit", "cost", "illegal", "first", "last", "before", "edits", "after", "tail")}
        for codes, ns, roles, right, state, end in zip(rows["codes"], rows["ns"], rows["roles"], rows["right"], rows["state"], rows["end"]):
            codes, ns = list(codes), list(ns)
            before, edits, after, tail, _, paid = trace(codes, ns, tuple(right), state, bool(end))
            out["audit"].append("".join("I" * len(b) + e + "D" * (n - 1) for b, e, n in zip(before, edits, ns)) + "I" * len(tail))
            initials = [r[:1] for r in roles]
            odd = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            for c, v in (("cost", paid), ("illegal", odd + int(sum(ns)) - len(ns)), ("first", initials[0]), ("last", initials[-1]),
                         ("before", before), ("edits", edits), ("after", after), ("tail", tail)):
                out[c].append(v)
        yield rows[["conv", "seq", "turns", "roles", "keys", "ns"]].assign(**out)


def edits(rows: DataFrame, settings: Settings = Settings(), conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(runs, chunks).  chunks: one row for each piece of a conversation, in order of ``seq``: conv, seq, audit, cost, illegal, first and last initial, and by
    row of ``runs`` (turns, roles, keys, ns) the initials put in before it, its edit and its state after (2 user, 3 assistant).

    The rows of a conversation stand by turn, nulls first, then by role and a digest of the text.  A null role or text is one space; rows
    without a conversation id are one conversation.  Blank rows and repeats of role and text must go.  Repeated rows, empty and very long texts are rows like others; no
    rows give no chunks; other columns are not looked at.
    """
    listed = stored(runs(rows, conversation, turn, role, text), "listed")
    initial = F.array_position(F.array(*map(F.lit, INITIALS)), F.substring("role", 1, 1)).cast("int")
    fault = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    code = (F.when(initial > 0, initial - 1).otherwise(3) + 4 * fault).cast("int")
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "key"]
    sorted_rows = listed.select("conv", "turn", "role", "key", "n", code.alias("code")).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = listed.schema["conv"].dataType.simpleString()
    chunk = f"conv {kind}, seq long, open boolean, turns array<long>, roles array<string>, keys array<binary>, ns array<long>, codes array<int>"
    chunks = stored(sorted_rows.mapInArrow(_packed(None), chunk), "chunks")
    whole = chunks.where(~F.col("open")).select(
        "conv", "seq", "turns", "roles", "keys", "ns", "codes", F.array(*map(F.lit, END)).cast("array<long>").alias("right"), F.lit(0).alias("state"), F.lit(True).alias("end"))
    joined = _stitched(chunks.where("open").drop("open"), settings).select(*whole.columns)
    traced = whole.unionByName(joined).mapInPandas(
        _traced, f"conv {kind}, seq long, turns array<long>, roles array<string>, keys array<binary>, ns array<long>, audit string, cost long, illegal long,"
        " first string, last string, before array<string>, edits array<string>, after array<int>, tail string")
    return listed, stored(traced, "edits")


def decisions(chunks: DataFrame) -> DataFrame:
    """(conv, turn, role, key, n, before, edit, role_after): what happens to the first of each run of rows; others of the run are deleted.

    ``before``: initials of the rows put in before it.  A last row with ``edit`` null holds what is put in at the end.
    """
    named = lambda s: F.when(F.col(s) == 2, ROLES[2]).when(F.col(s) == 3, ROLES[3])
    each = chunks.select("conv", F.explode(F.arrays_zip("turns", "roles", "keys", "ns", "before", "edits", "after")).alias("x")).select(
        "conv", F.lit(False).alias("end"), F.col("x.turns").alias("turn"), F.col("x.roles").alias("role"), F.col("x.keys").alias("key"), F.col("x.ns").alias("n"),
        F.col("x.before").alias("before"), F.col("x.edits").alias("edit"), F.col("x.after").alias("after"))
    tails = chunks.where(F.col("tail") != "").select(
        "conv", F.lit(True).alias("end"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n"),
        F.col("tail").alias("before"), F.lit(None).cast("string").alias("edit"), F.lit(0).alias("after"))
    both = each.unionByName(tails)
    return both.withColumn("role_after", F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", named("after"))).drop("after")


def repaired(rows: DataFrame, chunks: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, one row a row: conv, end, turn, role, key, step, role_after, text; in this order they read in sequence (nulls first)."""
    said = F.coalesce(F.col(text), F.lit(" "))
    texts = rows.select(F.col(conversation).alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit(" ")).alias("o"), _key(said).alias("k"), said.alias("text"))
    made = decisions(chunks)
    held = made.where(F.col("edit").isin("K", "R"))
    same = held["conv"].eqNullSafe(texts["c"]) & held["turn"].eqNullSafe(texts["t"]) & (held["role"] == texts["o"]) & (held["key"] == texts["k"])
    columns = ["conv", "end", "turn", "role", "key"]
    kept = held.join(texts.dropDuplicates(["c", "t", "o", "k"]), same).select(*columns, F.lit(9).alias("step"), "role_after", "text")
    put = made.where(F.col("before") != "").select(*columns, F.posexplode(F.split("before", "")).alias("step", "i"))
    return kept.unionByName(put.where(F.col("i") != "").select(
        *columns, "step", F.when(F.col("i") == "u", ROLES[2]).otherwise(ROLES[3]).alias("role_after"), F.lit("").alias("text")))


def _hashed(batches):
    """SHA-256 of each conversation's lines, streamed: rows come in order, only the state of the hash is held."""
    current, digest, wanted, lines = None, None, None, 0

    def add(role: str, said: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + role + ":" + said).encode())
        lines += 1

    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        done = []
        for i in range(batch.num_rows):
            conv, text, place, before, edit, role_after = columns[0][i].as_py(), columns[1][i], columns[2][i].as_py(), columns[3][i].as_py(), columns[4][i].as_py(), columns[5][i].as_py()
            if digest is None or conv != current:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest, wanted, lines = conv, hashlib.sha256(), None, 0
            if before is not None:  # a decision; its text follows
                for c in before:
                    add(ROLES[2] if c == "u" else ROLES[3], "")
                wanted = (place, role_after) if edit in ("K", "R") else None
            elif wanted is not None and wanted[0] == place:
                add(wanted[1], text.as_py())
                wanted = None
        if done:
            yield _digests(done, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    if digest is not None:
        yield _digests([(current, digest.hexdigest())], kind)


def _digests(done: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["conv", "repaired_sha256"])


def digests(rows: DataFrame, chunks: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` lines.  One task streams a conversation, as the hash of a sequence has no other way; it holds one batch of rows."""
    said = F.coalesce(F.col(text), F.lit(" "))
    texts = rows.select(F.col(conversation).alias("conv"), F.lit(False).alias("end"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        _key(said).alias("key"), F.lit(1).alias("kind"), said.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("before", "edit", "role_after")])
    told = decisions(chunks).select("conv", "end", "turn", "role", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "before", "edit", "role_after")
    order = [F.asc_nulls_first("conv"), "end", F.asc_nulls_first("turn"), "role", "key", "kind"]
    both = texts.unionByName(told).repartition("conv").sortWithinPartitions(*order)
    place = F.concat_ws("|", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.hex("key"), "role")
    kind = chunks.schema["conv"].dataType.simpleString()
    return both.select("conv", "text", place.alias("place"), "before", "edit", "role_after").mapInArrow(_hashed, f"conv {kind}, repaired_sha256 string")


def summary(original: DataFrame, rows: DataFrame, settings: Settings = Settings(), conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of ``original``: gaps, faults, illegal neighbours, cost, audit and digest of the repaired rows."""
    listed, chunks = edits(rows, settings, conversation, turn, role, text)
    # of equal rows the first has its own fault, the others are duplicates unless blank
    faults = listed.select(
        "conv", "turn", F.when(F.col("fault") == "blank", F.col("n")).otherwise(0).alias("blank"),
        (F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.when(F.col("fault") == "truncated", 1).otherwise(0).cast("long").alias("truncated"))
    turns = faults.groupBy("conv", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pieces = F.array_sort(F.collect_list(F.struct("seq", "audit", "illegal", "first", "last", "cost")))
    told = chunks.groupBy("conv").agg(pieces.alias("p"))
    joint = F.aggregate(
        F.sequence(F.lit(2), F.size("p")), F.lit(0).cast("long"),
        lambda a, i: a + F.when(F.concat(F.element_at("p", i - 1)["last"], F.element_at("p", i)["first"]).isin("su", "ua", "au"), 0).otherwise(1))
    added = lambda c: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[c])
    told = told.select(
        "conv", (added("illegal") + F.when(F.size("p") > 1, joint).otherwise(0)).alias("illegal"), added("cost").alias("cost"),
        F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"))
    hashed = digests(rows, chunks, conversation, turn, role, text)
    everyone = original.select(F.col(conversation).alias("conv")).distinct()
    out = everyone
    for n, table in enumerate((counts, told, hashed)):
        table = table.withColumnRenamed("conv", f"_c{n}")
        out = out.join(table, out["conv"].eqNullSafe(table[f"_c{n}"]), "left").drop(f"_c{n}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("conv").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults by crc32(``conv_id:turn``) modulo 20: 0 drops the row, 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes it a user's; nulls are one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select("conv_id", "turn", "role", "text", lot.alias("lot")).where(F.col("lot") != 0).select(
        "conv_id", "turn", F.when(F.col("lot") == 4, F.lit("user")).otherwise(known("role")).alias("role"),
        F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
