"""Repair of conversations by edits of least cost, in linear space.

The roles of a repaired conversation are an optional system row, then pairs of user and assistant. How far a
conversation has come is one of four states, so a stretch of rows is summed up by
vectors of four costs. To find the edits of a stretch whose first and last state are known, the forward vector
of its first half and the backward vector of its second half meet in the middle; the best
crossing is kept, and both halves are solved alike (divide and conquer after Hirschberg). Of crossings
of one cost the one with the least audit is taken: forward vectors carry the order of their audits.
An audit of some rows ends with an edit of the last row, so none begins with another, and the order
of two is settled by what they have up to now.

Rows are dealt in ranges of conversation and turn. A task solves the conversations that lie whole in
it. Of the at most two that go on in another task it gives a matrix of such vectors; a conversation's
matrices, at most one a task, are joined end to end, which fixes the states at the cuts, and
the tasks then solve their stretches. So no task holds more of a conversation than its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .common import WORD, written

#: Costs of the edits, and of an undeleted truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. What an inserted or reroled row becomes in each.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Rows of one output row with texts.
CHUNK = 1000

Vector = list[tuple[int, int] | None]  # per state: cost and place of the audit among those of all states
Steps = list[list[tuple[int, int, str]]]  # per state before: state after, cost, edits


def steps_of(initial: str, truncated: bool) -> Steps:
    """What can be done with a row that may stay: perhaps insert, then keep, rerole or delete."""
    out: Steps = []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {state: (DELETE, "D")}  # an insert before a deletion comes as well after it
        now, extra = state, TRUNCATED * truncated
        for inserts in range(3):
            edits = [(INSERT * inserts + REROLE + extra, "I" * inserts + "R", FOLLOWS[now])]
            kept = INITIALS.get(initial)
            if kept is not None and now in BEFORE[kept]:
                edits.append((INSERT * inserts + KEEP + extra, "I" * inserts + "K", kept))
            for cost, audit, after in edits:
                best[after] = min(best.get(after, (cost, audit)), (cost, audit))
            now = FOLLOWS[now]
        out.append([(after, cost, audit) for after, (cost, audit) in best.items()])
    return out


STEPS = {(initial, cut_off): steps_of(initial, cut_off) for initial in ("", *INITIALS) for cut_off in (False, True)}
DROP: Steps = [[(state, DELETE, "D")] for state in STATES]


def steps(role: str, fault: str) -> Steps:
    if fault in ("blank", "duplicate"):
        return DROP
    initial = role[:1]
    return STEPS[initial if initial in INITIALS else "", fault == "truncated"]


def begin(state: int) -> Vector:
    return [(0, 0) if s == state else None for s in STATES]


def forward(rows: Iterable[Steps], vector: Vector) -> Vector:
    """Least cost and order of the least audit for each state after the rows."""
    for row in rows:
        if row is DROP:
            vector = [v and (v[0] + DELETE, v[1]) for v in vector]
            continue
        found: dict[int, tuple[int, int, str]] = {}
        for before, v in enumerate(vector):
            if v is not None:
                for after, cost, audit in row[before]:
                    new = (v[0] + cost, v[1], audit)
                    if after not in found or new < found[after]:
                        found[after] = new
        order = {x: i for i, x in enumerate(sorted((rank, audit) for _, rank, audit in found.values()))}
        vector = [(x[0], order[x[1:]]) if (x := found.get(s)) else None for s in STATES]
    return vector


def backward(rows: list[Steps], costs: list[int | None]) -> list[int | None]:
    """Least cost from each state before the rows, given the costs after them."""
    for row in reversed(rows):
        costs = [
            min((cost + costs[after] for after, cost, _ in row[before] if costs[after] is not None), default=None) for before in STATES
        ]
    return costs


def crossing(vector: Vector, costs: list[int | None]) -> int:
    """The state where both meet at least cost; of several the one that is reached by the least audit."""
    return min((v[0] + costs[s], v[1], s) for s, v in enumerate(vector) if v is not None and costs[s] is not None)[2]


def solve(rows: list[Steps], first: int, last: int) -> list[str]:
    """The least edits for each row that lead from one state to another, without rows beside the two vectors."""
    out: list[str] = [""] * len(rows)
    stack = [(0, len(rows), first, last)]
    while stack:
        low, high, enter, leave = stack.pop()
        if high - low == 1:
            out[low] = next(audit for after, _, audit in rows[low][enter] if after == leave)
        elif high > low:
            middle = (low + high) // 2
            ahead = forward(rows[low:middle], begin(enter))
            behind = backward(rows[middle:high], [0 if s == leave else None for s in STATES])
            at = crossing(ahead, behind)
            stack += [(low, middle, enter, at), (middle, high, at, leave)]
    return out


def end_state(vector: Vector) -> int:
    return crossing(vector, [len(ENDS[s]) * INSERT for s in STATES])


class Row(NamedTuple):
    role: str
    text: str
    fault: str


#: Stands for what is inserted behind the last row.
NONE = Row("", "", "")


def apply(rows: list[Row], edits: list[str], state: int) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that the edits leave or make."""
    for row, audit in zip(rows, edits, strict=True):
        for edit in audit:
            if edit == "K":
                state = INITIALS[row.role[:1]]
                yield row.role, row.text
            elif edit in "RI":
                state = FOLLOWS[state]
                yield ROLES[state], row.text if edit == "R" else ""


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with how often each stands there and its fault, dealt in ranges of conversation, turn, role and text."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    one = one.withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    one = written(one, "turns")
    # Only what a conversation says at several turns.
    again = (
        one.filter("copies > 0").groupBy("conv_id", "same")
        .agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("null_first"))
        .filter("n > 1").drop("n").withColumnsRenamed({"conv_id": "c", "same": "s"})
    )
    both = one.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    later = F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("least")))
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank").when(F.coalesce(later, F.lit(False)), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    )
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    dealt = both.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")).repartitionByRange(
        *keys, F.substring("role", 1, 64), F.substring("text", 1, 128)
    )
    # A reliable checkpoint: both passes see the same ranges in the same order.
    return cut(dealt.sortWithinPartitions(*keys, "role", "text"))


class Turns:
    """Conversations of a task, one after the other."""

    def __init__(self, batches: Iterable[pa.RecordBatch]) -> None:
        self.rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def __iter__(self) -> Iterator[tuple[int | None, list[Row]]]:
        """Rows as often as they stand there; of equal ones at one turn all but the first are duplicates."""
        held: list[Row] = []
        now: object = self
        for conv, _, role, text, copies, fault in self.rows:
            if conv != now:
                if now is not self:
                    yield now, held
                now, held = conv, []
            if copies:
                held.append(Row(role, text, fault))
                held += [Row(role, text, fault if fault == "blank" else "duplicate")] * (copies - 1)
        if now is not self:
            yield now, held


def with_ends(conversations: Iterable) -> Iterator[tuple[object, bool]]:
    """Each item, and whether it is the first or the last one."""
    first, held = True, []
    for x in conversations:
        if held:
            yield held.pop(), first
            first = False
        held.append(x)
    if held:
        yield held.pop(), True


def summaries(turns: DataFrame) -> DataFrame:
    """conv_id, part and matrix of the conversations at both ends of every task, which may go on in another."""

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), []
        for (conv, rows), outer in with_ends(Turns(batches)):
            if outer:
                kinds = [steps(r.role, r.fault) for r in rows]
                flat = [x for s in STATES for v in forward(kinds, begin(s)) for x in (v or (-1, -1))]
                found.append({"conv_id": conv, "part": part, "matrix": flat})
        if found:
            yield pa.RecordBatch.from_pylist(
                found, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("matrix", pa.list_(pa.int64()))])
            )

    return turns.withColumn("text", F.lit("")).mapInArrow(matrices, "conv_id long, part int, matrix array<long>")


def joined(table: pa.Table) -> pa.Table:
    """States before and after each stretch of one conversation. At most one row a task."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    matrices = []
    for r in rows:
        pairs = list(zip(r["matrix"][::2], r["matrix"][1::2], strict=True))
        matrices.append([[p if p[0] >= 0 else None for p in pairs[4 * s : 4 * s + 4]] for s in STATES])
    costs: list[list[int | None]] = [[len(ENDS[s]) * INSERT for s in STATES]]
    for m in reversed(matrices):
        costs.append([min((v[0] + costs[-1][s] for s, v in enumerate(m[b]) if v and costs[-1][s] is not None), default=None) for b in STATES])
    state, out = START, []
    for i, (r, m) in enumerate(zip(rows, matrices, strict=True)):
        after = crossing(m[state], costs[len(rows) - 1 - i])
        out.append({"part": r["part"], "conv_id": r["conv_id"], "enter": state, "leave": after, "last": i == len(rows) - 1, "alone": len(rows) == 1})
        state = after
    return pa.Table.from_pylist(
        out,
        pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("alone", pa.bool_())]),
    )


STRETCHES = "part int, conv_id long, enter int, leave int, last boolean, alone boolean"
PIECE = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()),
        ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("sha256", pa.string()),
        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ]
)
PIECES = (
    "conv_id long, part int, chunk int, audit string, cost long, illegal long, first string, last string, sha256 string,"
    " roles array<string>, texts array<string>"
)
REPORT = "conv_id long, audit string, cost long, illegal long, sha256 string"


def figures(rows: list[Row], edits: list[str]) -> dict:
    """Audit and cost of the edits, illegal pairs among the rows, and the first and last initial."""
    audit = "".join(edits)
    stay = sum(r.fault == "truncated" and "D" not in e for r, e in zip(rows, edits, strict=False))
    initials = [r.role[:1] for r in rows]
    return {
        "audit": audit, "illegal": sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False)),
        "cost": audit.count("R") * REROLE + audit.count("D") * DELETE + audit.count("I") * INSERT + stay * TRUNCATED,
        "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
    }


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def pieces(turns: DataFrame, texts: bool) -> DataFrame:
    """Figures and repaired rows of the conversations.

    A conversation that lies whole in one task has its figures and digest in a piece of their own, chunk -1;
    those that do not, and all if ``texts``, have pieces of the repair of at most ``CHUNK`` rows.
    """
    ends = written(summaries(turns), "turn-matrices")
    # At most two rows a task of ``turns``, each a few numbers: as small as the list of its tasks.
    parts = written(ends.groupBy("conv_id").applyInArrow(joined, STRETCHES), "turn-stretches").filter("NOT alone").collect()
    known = turns.sparkSession.sparkContext.broadcast({(r["part"], r["conv_id"]): r.asDict() for r in parts})

    def repair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0
        for conv, rows in Turns(batches):
            kinds = [steps(r.role, r.fault) for r in rows]
            stretch = known.value.get((part, conv))
            enter = stretch["enter"] if stretch else START
            leave = stretch["leave"] if stretch else end_state(forward(kinds, begin(START)))
            edits = solve(kinds, enter, leave)
            tail = ENDS[leave] if not stretch or stretch["last"] else ""
            if not stretch:
                lines = (f"{role}:{text}" for role, text in apply([*rows, NONE], [*edits, tail], START))
                sha = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
                held.append({"conv_id": conv, "part": part, "chunk": -1, "sha256": sha} | figures(rows, [*edits, tail]))
            if stretch or texts:
                state = enter
                for chunk, low in enumerate(range(0, max(1, len(rows)), CHUNK)):
                    own, done = rows[low : low + CHUNK], edits[low : low + CHUNK]
                    done = [*done, tail if low + CHUNK >= len(rows) else ""]
                    made = list(apply([*own, NONE], done, state))
                    state = INITIALS[made[-1][0][0]] if made else state
                    held.append(
                        {"conv_id": conv, "part": part, "chunk": chunk, "roles": [r for r, _ in made], "texts": [t for _, t in made]}
                        | figures(own, done)
                    )
            size += sum(len(r.text) for r in rows)
            if size > 1 << 22 or len(held) >= 2000:
                yield pa.RecordBatch.from_pylist(held, PIECE)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, PIECE)

    return turns.mapInArrow(repair, PIECES)


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures and digest of conversations whose pieces come in order; of the texts only one batch is held."""

    def row() -> pa.RecordBatch:
        out = {"conv_id": conv, "audit": "".join(audits), "cost": cost, "illegal": illegal, "sha256": sha.hexdigest()}
        return pa.RecordBatch.from_pylist([out], pa.schema([PIECE.field(c) for c in out]))

    conv: object = batches
    for batch in batches:
        for r in batch.to_pylist():
            if r["conv_id"] != conv:
                if conv is not batches:
                    yield row()
                conv, audits, cost, illegal, last, sha, begun = r["conv_id"], [], 0, 0, None, hashlib.sha256(), False
            audits.append(r["audit"])
            cost += r["cost"]
            if r["first"] is not None:
                illegal += r["illegal"] + (last is not None and not legal(last, r["first"]))
                last = r["last"]
            for role, text in zip(r["roles"], r["texts"], strict=True):
                sha.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
    if conv is not batches:
        yield row()


def _filled(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.coalesce(copies, F.lit(1)).alias("copies"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the rows of all conversations after repair; ``rows`` as for ``repair_report``."""
    found = pieces(ordered_rows(_filled(rows)), texts=True).filter("chunk >= 0")
    found = written(found.select("conv_id", "part", "chunk", "roles", "texts").withColumn("n", F.size("roles")), "repaired-turns")
    # A row for each piece, that is for about ``CHUNK`` turns.
    before = Window.partitionBy("conv_id").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("chunk").alias("k"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("chunk") == F.col("k"))
    each = found.join(bases, same).select("conv_id", "base", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "row"))
    return each.select("conv_id", (F.col("base") + F.col("i")).alias("place"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def fault_counts(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate and truncated of conversations that have rows."""
    fault, copies = F.col("fault"), F.col("copies")
    number = {
        "blank": F.when(fault == "blank", copies).otherwise(0), "truncated": F.when(fault == "truncated", 1).otherwise(0),
        "duplicate": F.when(fault == "blank", 0).when(fault == "duplicate", copies).otherwise(copies - 1),
    }
    by_turn = turns.filter("copies > 0").groupBy("conv_id", "turn").agg(*(F.sum(x).alias(name) for name, x in number.items()))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("conv_id").agg(*(F.sum(name).alias(name) for name in number), gaps.alias("gaps"))


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``rows`` has conv_id, turn, role, text and perhaps ``copies``: how often the row stands there (without the
    column or where it is null: once; 0: the row only names its conversation). Rows of one turn go by role, then
    text; null turns come first; null roles and texts are one blank; rows with a null conv_id are one
    conversation. Repeated rows are duplicates. Very long texts are taken whole. A conversation without
    rows has zeros, an empty audit and the digest of an empty text; an empty table gives no rows.
    Other columns are ignored.

    The digest of a conversation that lies in several tasks is taken by one task, which streams its repaired rows.
    """
    turns = ordered_rows(_filled(rows))
    found = written(pieces(turns, texts=False), "repairs")
    one = ("conv_id", "audit", "cost", "illegal", "sha256")
    cut_up = found.filter("chunk >= 0").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    all_ = found.filter("chunk < 0").select(*one).unionByName(cut_up.mapInArrow(digests, REPORT))
    counts = fault_counts(turns).withColumnRenamed("conv_id", "c")
    out = all_.join(counts, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select(
        "conv_id", *(F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated")),
        "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after planted damage; nulls are one blank.

    crc32 of ``conv_id:turn`` modulo 20 tells the damage: 0 drops the row, 1 empties its text, 2 takes full stops and
    exclamation and question marks out of it, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
