import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import Row

from docket.llm.turn_repair import Alignment, damaged, repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
BLANK = " \t\n\x0b\x0c\r"


def brute_script(initials, faults, state=""):
    """(cost, audit) of the ASCII-least of the cheapest scripts, row by row over the grammar's states."""
    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(initials):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            c, e = best(i + 1, state, 0)
            found.append((c + 2, "D" + e))
            late = 5 if faults[i] == "t" else 0
            for to in "sua" if faults[i] != "d" else "":
                if (state, to) in NEXT:
                    if initials[i] == to:
                        c, e = best(i + 1, to, 0)
                        found.append((c + late, "K" + e))
                    elif to != "s":
                        c, e = best(i + 1, to, 0)
                        found.append((c + late + 1, "R" + e))
        if inserted < 3:
            for to in "ua":
                if (state, to) in NEXT:
                    c, e = best(i, to, inserted + 1)
                    found.append((c + 5, "I" + e))
        return min(found, default=(10**9, ""))

    return best(0, state, 0)


def brute(rows):
    out, by = [], {}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for conv, turns in by.items():
        live = []
        for turn, role, text in turns:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 1:
                text = ""
            elif kind == 2:
                text = "".join(c for c in text if c not in ".!?")
            elif kind == 4:
                role = "user"
            live += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        live.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), ""
        for _, role, text in live:
            end = text.rstrip(BLANK)
            faults += "b" if not end else "d" if (role, text) in seen else " " if end[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join(r[1][:1] or " " for r in live)
        cost, audit = brute_script(initials, faults.replace("b", "d"))
        lines, at = [], 0
        kept = len(audit) - audit.count("D")
        want = ["system"] * (kept % 2) + ["user", "assistant"] * (kept // 2)
        for e in audit:
            role, text = live[at][1:] if e != "I" else ("", "")
            at += e != "I"
            if e != "D":
                w = want[len(lines)]
                lines.append(f"{role if e == 'K' else w}:{text}")
        t = [r[0] for r in live if r[0] is not None]
        out.append((conv, max(t) - min(t) + 1 - len(set(t)) if t else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_alignment_against_states():
    rng = random.Random(5)
    for k in range(1500):
        n = rng.choice([0, 1, 2, 3, 5, 9, 14])
        initials = "".join(rng.choice("suua aax"[: 3 + k % 6]) for _ in range(n))
        faults = "".join(rng.choice("   dt" if k % 3 else " ddttt") for _ in range(n))
        want = brute_script(initials, faults)
        end = [0, 1 << 40, 0, 1 << 40]
        assert Alignment(initials, faults, end, True).repair(0)[:2] == want, (initials, faults)


def conversations(spark, seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.15 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and conv % 3 == 0 else role
            text = rng.choice(["Yes.", "No!", "cut of", " ", f"text {rng.random()}?  ", "Good.\n", "x" * 30])
            rows.append(Row(conv_id=conv, turn=turn + 3 * (rng.random() < 0.02), role=role, text=text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_repair_against_brute_force(spark, block):
    rows = conversations(spark, block, [*range(1, 9)] * 6 + [60, 1, 1, 35])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair(damaged(df), block=block)) == brute(rows)


def test_odd_conversations(spark):
    rows = [Row(None, None, None, None), Row(None, None, None, None), Row(None, 1, "user", "A."), Row(None, 2, None, "B."),
            Row(1, None, "user", "Q?"), Row(1, 4, "", "empty role."), Row(1, 9, "assistant", None),
            Row(2, 0, "tool", "z."), Row(2, 0, "agent", "z!"), Row(2, 0, "tool", "z."), Row(2, 1, "Ü", "long " * 40_000 + "."),
            Row(3, 0, "system", "Only."), Row(4, 0, "user", "tab\t.\n\x0b"), Row(4, 1, "assistant", "nbsp. ")]
    rows = [Row(conv_id=a, turn=b, role=c, text=d) for a, b, c, d in rows]
    df = spark.createDataFrame([Row(*r, 1, "a", "K") for r in rows], SCHEMA + ", rid int, `a.b` string, audit string")
    assert got(repair(damaged(df), block=3)) == brute(rows)
    assert got(repair(damaged(df.limit(0)))) == []


def test_one_conversation_over_many_blocks(spark):
    rows = conversations(spark, 3, [3, 900, 2])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(repair(damaged(df), block=64)) == brute(rows)
