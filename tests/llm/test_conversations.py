"""Conversation repair beside a plain search, in pieces of any size."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from cellwright.llm.conversations import AT_END, GONE, damaged, over_run, power, repair, unrolled

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (kind != 0) * (1 + (kind == 3))
    return out


def plain_repair(rows):
    """The result for one conversation, by a search over (row, state) that keeps the least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        kept = BLANK.findall(text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    best = {}
    for i in range(len(rows), -1, -1):
        found = {}
        for state in after:
            options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                extra = faults[i] == "truncated"
                c, a, lines = best[i + 1, state]
                options.append((c + 3, "D" + a, lines))
                if faults[i] not in ("blank", "duplicate"):
                    if role[:1] in after[state]:
                        c, a, lines = best[i + 1, role[:1]]
                        options.append((c + extra, "K" + a, ((role, text), *lines)))
                    for r in set("ua") & set(after[state]):
                        c, a, lines = best[i + 1, r]
                        options.append((c + 2 + extra, "R" + a, ((names[r], text), *lines)))
            found[state] = options
        for _ in range(4):
            for state in after:
                for r in set("ua") & set(after[state]):
                    for c, a, lines in sorted(found[r])[:1]:
                        found[state].append((c + 2, "I" + a, ((names[r], ""), *lines)))
        for state in after:
            best[i, state] = min(found[state])
    cost, audit, lines = best[0, ""]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    body = "\n".join(f"{r}:{t}" for r, t in lines)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest())


def conversations(rng, n, size):
    out = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(0, size)):
            turn = rng.choice([None, *range(size)])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            out.append((conv, turn, role, rng.choice(["Yes.", "No", "a b!", "", " \t\x0b", None, "Why?\n ", "é. \x1f"])))
    return out + rng.sample(out, len(out) // 5)


@pytest.mark.parametrize("size, piece", [(9, 32_768), (40, 3), (40, 1)])
def test_like_the_plain_version(spark, size, piece):
    rows = conversations(random.Random(size + piece), 40, size)
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, kind int").repartition(3)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair(damaged(table), table, piece).collect()}
    wanted = {c: [] for c in {r[0] for r in rows}}
    for conv, *row in plain_damage(rows):
        wanted[conv].append(tuple(row))
    assert found == {c: plain_repair(r) for c, r in wanted.items()}


def test_plain_version_is_least_over_all_edits():
    """Against all ways of keeping, changing and deleting two rows with up to two inserts around each."""
    rows = [(0, "assistant", "x."), (1, "system", "y")]
    least = min(
        (cost, audit)
        for choice in itertools.product("DKR", repeat=2)
        for inserts in itertools.product(range(3), repeat=3)
        for cost, audit in [valid(rows, choice, inserts)]
        if cost is not None
    )
    assert plain_repair(rows)[5:7] == least


def valid(rows, choice, inserts):
    """Cost and audit of given edits, if some roles of what is inserted or changed make the grammar's roles."""
    audit, cost, places = "", 0, []
    for k in range(len(rows) + 1):
        audit += "I" * inserts[k]
        cost += 2 * inserts[k]
        places += ["ua"] * inserts[k]
        if k < len(rows):
            audit += choice[k]
            cost += {"D": 3, "K": 0, "R": 2}[choice[k]]
            if choice[k] != "D":
                cost += rows[k][2][-1] not in ".!?"
                places.append(rows[k][1][0] if choice[k] == "K" else "ua")
    ok = any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*places))
    return (cost, audit) if ok else (None, audit)


def test_binary_powers_and_long_runs():
    for symbol in [GONE, ("u", True), ("s", False), ("?", False)]:
        one = AT_END
        for _ in range(13):
            one = over_run(symbol, 1, one)
        assert np.array_equal(over_run(symbol, 13, AT_END), one)
        assert power(symbol, 3).shape == (4, 4)
    letters, state, cost = unrolled([("u", False), GONE], [1, 10**9], 0, AT_END, True)
    assert letters == ["D", "D"] and state == 0 and cost == 3 * (10**9 + 1) or letters == ["K", "DI"] and cost == 3 * 10**9 + 2


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert repair(damaged(empty), empty).count() == 0
    gone = [(c, t, "user", "Hi.") for c in range(3) for t in range(60) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    table = spark.createDataFrame(gone, schema)
    rows = repair(damaged(table), table).collect()
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = [(1, t, ("user", "assistant")[t % 2], "word " * 1000 + str(t) + ".") for t in range(3000)]
    table = spark.createDataFrame(long, schema)
    (row,) = repair(damaged(table), table, 100).collect()
    assert tuple(row)[1:] == plain_repair([r[1:] for r in plain_damage(long)])
