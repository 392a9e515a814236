"""Conversation repair against brute force over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from spendlake.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """Rows after damage, and all conversations, by the words of the contract."""
    out, all_ids = {}, []
    show = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        if conv not in all_ids:
            all_ids.append(conv)
        d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        if d:
            out.setdefault(conv, []).extend([(turn, role, text)] * (2 if d == 3 else 1))
    return all_ids, out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif bare[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def shortest(rows, kinds):
    """Bellman-Ford over (row, state) with the whole string of edits as tie-break: no prices, no auction."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "", ())}
    todo = [(0, 0)]
    while todo:
        i, s = todo.pop()
        cost, audit, made = best[i, s]
        ways = []
        for name in ("user", "assistant"):
            if (s, name[0]) in step:
                ways.append((i, step[s, name[0]], 5, "I", made + ((name, ""),)))
        if i < len(rows):
            _, role, text = rows[i]
            ways.append((i + 1, s, 2, "D", made))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                if (s, role[:1]) in step:
                    ways.append((i + 1, step[s, role[0]], more, "K", made + ((role, text),)))
                for name in ("user", "assistant"):
                    if (s, name[0]) in step:
                        ways.append((i + 1, step[s, name[0]], 1 + more, "R", made + ((name, text),)))
        for j, t, c, label, new in ways:
            found = (cost + c, audit + label, new)
            if (j, t) not in best or found[:2] < best[j, t][:2]:
                best[j, t] = found
                todo.append((j, t))
    return min((best[len(rows), s] for s in (0, 3) if (len(rows), s) in best), key=lambda x: x[:2])


def brute(rows):
    ids, after = damaged(rows)
    out = {}
    for conv in ids:
        own = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0))
        kinds = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = shortest(own, kinds)
        assert LEGAL.match("".join(role[0] for role, _ in made))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(spark, rows, conv="long"):
    df = spark.createDataFrame(rows, f"conv_id {conv}, turn long, role string, text string")
    got = repair.repair(repair.damaged(df)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in sorted(rng.sample(range(longest + 3), rng.randrange(1, longest))):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "a", "User", "été"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No", "Wh y?", " ", "", None, "Hi! \x0b", "Ok.", f"x{rng.randrange(99)}.", " ", "é"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = conversations(seed, 120, 9)
    random.Random(seed).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_long_conversations_cross_blocks(spark, monkeypatch):
    rows = conversations(7, 3, 120)
    monkeypatch.setattr(repair, "BLOCK", 7)
    for conv in range(3):
        own = [(t, r or " ", x or " ") for c, t, r, x in rows if c == conv]
        kinds = faults(own)
        codes = bytes((INITIAL.get(r[:1], 3)) + 4 * repair.FAULTS.index(k) for (_, r, _), k in zip(own, kinds))
        assert repair._solved(codes) == shortest(own, kinds)[:2]


INITIAL = {"s": 0, "u": 1, "a": 2}


def test_all_codes_of_three_rows():
    rows = [("system", "x."), ("user", "x."), ("assistant", "x."), ("tool", "x.")]
    kinds = ["", "truncated", "blank"]
    every = [(0, role, text, k) for role, text in rows for k in kinds]
    for a in every:
        for b in every:
            for c in every:
                own, marks = [x[:3] for x in (a, b, c)], [x[3] for x in (a, b, c)]
                codes = bytes(INITIAL.get(r[0], 3) + 4 * repair.FAULTS.index(k) for (_, r, _), k in zip(own, marks))
                assert repair.cheapest_edits(codes) == shortest(own, marks)[:2]


def test_nulls_dropped_conversations_and_no_rows(spark):
    dropped = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(None, 0, "user", "Hi."), (None, 5, "assistant", None), (dropped, 0, "user", "Hi."), (-1, None, None, None), (-2, None, "user", "So.")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, []) == {}
    named = [("c", t, r, x) for _, t, r, x in conversations(3, 1, 9)]
    assert found(spark, named, conv="string") == brute(named)


def test_repeated_rows_are_duplicates(spark):
    rows = [(5, 2, "user", "Same."), (5, 2, "user", "Same."), (5, 2, "user", "Same."), (5, 3, "assistant", "Fine.")]
    assert found(spark, rows) == brute(rows)


def test_repaired_rows_and_clashing_columns(spark):
    rows = [(*r, 1, "x") for r in conversations(5, 30, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind int, stats string")
    rows = [r[:4] for r in rows]
    after = repair.damaged(df)
    got = {}
    for r in sorted(repair.repaired_rows(after, repair.solved(after)).collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    expected = brute(rows)
    for conv, result in expected.items():
        assert hashlib.sha256("\n".join(got.get(conv, [])).encode()).hexdigest() == result[-1]


def test_prices_are_exact_and_every_arc_is_bounded():
    rng = random.Random(1)
    codes = bytes(rng.randrange(16) for _ in range(200))
    prices = repair.converged_prices(codes, None)
    for i, code in enumerate(codes):
        for state in range(4):
            node = 4 * i + state
            beyond = [cost + prices[node + offset] for _, cost, offset in repair.ARCS[code][state]]
            assert prices[node] == min(beyond)
