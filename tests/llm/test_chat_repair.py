import hashlib
import heapq
import random
import re
import zlib

import pytest

from sieveline.llm import chat_repair

from ..conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, seg string, symbol int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if m == 1:
            text = ""
        if m == 2:
            text = re.sub("[.!?]", "", text)
        if m == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return out


def cheapest(marks):
    """Least (cost, audit) by Dijkstra over rows read and state; marks: (initial, doomed, cut)."""
    go = lambda state, x: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(x)
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, k, state = heapq.heappop(queue)
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == len(marks) and state in ("", "a"):
            return cost, audit
        for x in "ua":
            if go(state, x):
                heapq.heappush(queue, (cost + 5, audit + "I", k, x))
        if k < len(marks):
            initial, doomed, cut = marks[k]
            heapq.heappush(queue, (cost + 2, audit + "D", k + 1, state))
            if not doomed:
                if go(state, initial):
                    heapq.heappush(queue, (cost + 5 * cut, audit + "K", k + 1, initial))
                for x in "ua":
                    if go(state, x):
                        heapq.heappush(queue, (cost + 1 + 5 * cut, audit + "R", k + 1, x))


def brute(rows, ids):
    by = {c: [] for c in ids}
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, marks, n = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            blank, double = not BLANK.search(text), (role, text) in seen
            seen.add((role, text))
            cut = not blank and not double and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
            for k, x in enumerate((blank, not blank and double, cut)):
                n[k] += x
            marks.append((role[:1], blank or double, cut))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = cheapest(marks)
        lines, k, state = [], 0, ""
        for x in audit:
            if x != "D":
                state = own[k][2][:1] if x == "K" else "a" if state == "u" else "u"
                role = own[k][2] if x == "K" else {"u": "user", "a": "assistant"}[state]
                lines.append(f"{role}:{'' if x == 'I' else own[k][3]}")
            k += x != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(chat_repair.query(spark, SF)) == brute(broken(rows), {r[0] for r in rows})


def odd_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    texts = ["Yes.", "No", "why?", "", " \n\x0b", None, "ok!  \n", "...", "a. ", "x" * 50_000 + "."]
    return [(rng.choice([None, *range(n // 9)]), rng.choice([None, *range(9)]), rng.choice(roles[:3] if k % 3 else roles), rng.choice(texts), "a", 5) for k in range(n)]


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair_of_odd_rows(spark, monkeypatch, segment):
    """Nulls anywhere, ties, repeated rows, clashing columns; tiny segments cut every conversation."""
    monkeypatch.setattr(chat_repair, "SEGMENT", segment)
    rows = odd_rows(segment, 500)
    rows += [(77, k, ["user", "assistant", "user"][k % 3], "Long." if k % 5 else f"Long {k}.", "s", 1) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = [r[:4] for r in rows]
    ids = {r[0] for r in rows}
    assert got(chat_repair.digests(df, chat_repair.damage(df))) == brute(broken(plain), ids)
    # without damage too, null role and text being one space
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in plain]
    assert got(chat_repair.digests(df, df)) == brute(clean, ids)


def test_repaired_rows_follow_the_pattern(spark):
    df = spark.createDataFrame(odd_rows(9, 300), SCHEMA)
    by = {}
    for r in chat_repair.repair(df)[1].orderBy("ck", "at", "place").collect():
        by.setdefault(r["ck"], []).append(r["role"][0])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_repair.digests(none, chat_repair.damage(none)).count() == 0
    gone = spark.createDataFrame([(k, 0, "user", "x", "", 0) for k in range(60) if zlib.crc32(f"{k}:0".encode()) % 20 == 0], SCHEMA)
    rows = got(chat_repair.digests(gone, chat_repair.damage(gone)))
    assert rows and set(rows.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
