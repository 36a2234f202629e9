import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from mediasift.llm import conversations as c
from mediasift.llm.queries import QUERIES

from ..conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def best_edits(rows):
    """Least cost and audit, and what is left, by trying every edit from every state. rows: (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if inserts < 2:
            made = NEXT[state]
            cost, audit, out = best(i, AFTER[made, state], inserts + 1)
            options.append((cost + 5, "I" + audit, (({"u": "user", "a": "assistant"}[made], ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (to := AFTER.get((role[:1], state))) is not None:
                    cost, audit, out = best(i + 1, to, 0)
                    options.append((cost + more, "K" + audit, ((role, text), *out)))
                made = NEXT[state]
                cost, audit, out = best(i + 1, AFTER[made, state], 0)
                options.append((cost + 1 + more, "R" + audit, (({"u": "user", "a": "assistant"}[made], text), *out)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return best(0, 0, 0)


def plain(rows):
    """The report of (conv_id, turn, role, text, copies) rows, conversation by conversation."""
    of = {}
    for conv, turn, role, text, copies in rows:
        of.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    out = []
    for conv, own in of.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            faults.append(fault)
            seen.add((role, text))
        cost, audit, left = best_edits(tuple((r, t, f) for (_, r, t), f in zip(own, faults, strict=True)))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left))
        out.append(
            (
                conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(), left,
            )
        )
    return sorted(out, key=lambda r: str(r[0]))


def frame(spark, rows, parts=1):
    return spark.createDataFrame([(*r[:4], "x", 7) for r in rows], SCHEMA).repartition(parts)


def report(spark, rows):
    return sorted(map(tuple, c.repair_report(frame(spark, rows)).collect()), key=lambda r: str(r[0]))


def random_rows(pick, convs, most):
    rows = []
    for conv in range(convs):
        for turn in range(pick.randint(1, most)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", ""])
            text = pick.choice(["yes.", "no", "why?", "", " \n", "fine! ", f"t{pick.randrange(99)}.", f"u{turn}"])
            rows += [(conv, pick.choice([turn, turn, turn + 2, None]), role, text, 1)] * pick.choice([1, 1, 1, 2])
    return rows


def test_halves_give_the_least_edits():
    pick = random.Random(4)
    for _ in range(1500):
        rows = tuple(
            (pick.choice(["user", "assistant", "system", "x"]), "t", pick.choice(["", "", "", "truncated", "blank"])) for _ in range(pick.randint(0, 14))
        )
        kinds = [c.steps(r, f) for r, _, f in rows]
        leave = c.end_state(c.forward(kinds, c.begin(0)))
        edits = [*c.solve(kinds, 0, leave), c.ENDS[leave]]
        cost, audit, left = best_edits(rows)
        assert "".join(edits) == audit
        assert tuple(c.apply([*(c.Row(*r) for r in rows), c.NONE], edits, 0)) == left
        assert c.figures([c.Row(*r) for r in rows], edits)["cost"] == cost


def test_report_against_all_edits(spark):
    rows = random_rows(random.Random(1), 150, 12)
    assert report(spark, rows) == [r[:-1] for r in plain(rows)]


@pytest.mark.parametrize("chunk", [c.CHUNK, 3])
def test_conversation_over_many_tasks(spark, monkeypatch, chunk):
    """One conversation has most rows; it is cut into several ranges and pieces."""
    monkeypatch.setattr(c, "CHUNK", chunk)
    order, checkpointed = ("conv_id", "turn", "role", "text"), c.cut
    monkeypatch.setattr(c, "cut", lambda df: checkpointed(df.repartitionByRange(13, *order).sortWithinPartitions(*order)))
    pick = random.Random(9)
    rows = [(5, t, r, x, n) for _, t, r, x, n in random_rows(pick, 30, 8)] + random_rows(pick, 9, 4)
    rows = [(conv, i if conv == 5 and pick.random() < 0.9 else t, r, x, n) for i, (conv, t, r, x, n) in enumerate(rows)]
    want = plain(rows)
    assert report(spark, rows) == [r[:-1] for r in want]
    texts = {}
    for r in c.repaired(frame(spark, rows)).orderBy("conv_id", "place").collect():
        texts.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    assert texts == {r[0]: [(i, *x) for i, x in enumerate(r[-1])] for r in want if r[-1]}


def test_odd_rows(spark):
    long = "long " * 50_000
    rows = [
        (1, 0, None, None, 1), (1, 1, "user", None, 1), (None, None, "user", "a.", 1), (None, 3, "assistant", "b.", 1), (None, 9, "assistant", "b.", 1),
        (2, None, "user", "q?", 1), (2, None, "assistant", "r.", 1), (3, 0, "user", long, 1), (3, 1, "assistant", long + ".", 1),
        (4, 0, "user", "same.", 3), (4, 5, "user", "same.", 1), (4, None, "user", "same.", 1), (6, 0, "system", "s.", 1),
    ]
    flat = [r[:4] for r in rows for _ in range(r[4])]
    assert report(spark, flat) == [r[:-1] for r in plain(rows)]


def test_rows_that_only_name_their_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "a.", 1), (2, 0, "user", "a.", None)], "conv_id long, turn long, role string, text string, copies int")
    one, two = sorted(map(tuple, c.repair_report(rows).collect()))
    assert one == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert two[:8] == (2, 0, 0, 1, 0, 1, 4, "DD")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.repair_report(empty).count() == 0 and c.repaired(empty).count() == 0


def test_query_against_all_edits(spark):
    rows = []
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r["text"]) if kind == 2 else r["text"]
        rows.append((r["conv_id"], r["turn"], "user" if kind == 4 else r["role"], text, {0: 0, 3: 2}.get(kind, 1)))
    query = next(f for name, f in QUERIES.items() if name.startswith("op13_"))
    got = sorted(map(tuple, query(spark, SMALL).collect()), key=lambda r: str(r[0]))
    assert got == [r[:-1] for r in plain(rows)] and len(got) == len({r[0] for r in rows})
