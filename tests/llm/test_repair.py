import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from termfield.llm import repair
from termfield.llm.queries import op13_repair

BLANK, LAST = r"[^\x20\x09-\x0D]", r"[.!?]"


def damage(rows):
    """By conversation, as the contract says, one row after another."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(key.encode()) % 20
        text = "" if draw == 1 else re.sub(LAST, "", text) if draw == 2 else text
        out[conv] += [] if draw == 0 else [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def cheapest(roles, faults):
    """By exhaustive search with bounds: every way to edit row after row, the cheapest and then ASCII-least."""
    best = (10**9, "")
    most = 2 * len(roles) + 1

    def go(i, state, cost, edits):
        nonlocal best
        if (cost, edits) > best and cost >= best[0] or cost > most:
            return
        if i == len(roles) and state in ("", "a"):
            best = min(best, (cost, edits))
        follow = "a" if state == "u" else "u"
        if cost + 5 <= most and edits[-2:] != "II":
            go(i, follow, cost + 5, edits + "I")
        if i < len(roles):
            go(i + 1, state, cost + 2, edits + "D")
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                go(i + 1, follow, cost + 1 + extra, edits + "R")
                if roles[i] == follow or (roles[i] == "s" and state == ""):
                    go(i + 1, roles[i], cost + extra, edits + "K")

    go(0, "", 0, "")
    return best


def plain(turns, search):
    seen, faults = set(), []
    for _, role, text in turns:
        last = re.findall(BLANK, text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if not re.match(LAST, last[-1]) else "")
        seen.add((role, text))
    first = [role[:1] for _, role, _ in turns]
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit = search(first, faults)
    out, state, at = [], "", 0
    for e in audit:
        follow = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follow]
        if e == "I":
            out.append((name, ""))
            state = follow
            continue
        if e == "K":
            out.append(turns[at][1:])
            state = turns[at][1][0]
        elif e == "R":
            out.append((name, turns[at][2]))
            state = follow
        at += 1
    assert at == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def by_dp(roles, faults):
    """A plain DP from the end, for long conversations: cheapest, then least letter first."""
    n, far = len(roles), 10**9
    cost = {(n, s): far for s in ("", "s", "u", "a")}
    cost[n, ""] = cost[n, "a"] = 0
    cost[n, "u"], cost[n, "s"] = 5, 10

    def ways(i, s):
        follow = "a" if s == "u" else "u"
        out = [("D", 2, i + 1, s)]
        if faults[i] not in ("blank", "duplicate"):
            extra = 5 if faults[i] == "truncated" else 0
            out.append(("R", 1 + extra, i + 1, follow))
            if roles[i] == follow or (roles[i] == "s" and s == ""):
                out.append(("K", extra, i + 1, roles[i]))
        return out

    for i in range(n - 1, -1, -1):
        for s in ("", "s", "u", "a"):
            cost[i, s] = min(c + cost[j, t] for _, c, j, t in ways(i, s))
        for _ in range(3):
            for s in ("", "s", "u", "a"):
                cost[i, s] = min(cost[i, s], 5 + cost[i, "a" if s == "u" else "u"])
    i, s, audit = 0, "", ""
    while i < n or s not in ("", "a"):
        options = (ways(i, s) if i < n else []) + [("I", 5, i, "a" if s == "u" else "u")]
        e, _, i, s = min((o for o in options if o[1] + cost[o[2], o[3]] == cost[i, s]), key=lambda o: o[0])
        audit += e
    return cost[0, ""], audit


def answers(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_the_dp_equals_exhaustive_search():
    rng = random.Random(3)
    sigs = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 6))) for _ in range(500)})
    for sig, layer in repair.trie_answers(iter(sigs)):
        roles = [c.lower() for c in sig]
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in sig]
        assert repair.ended(layer[repair.START]) == cheapest(roles, faults) == by_dp(roles, faults), sig


def test_the_query_equals_a_plain_walk(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
        turns = damage(rows)
        got = answers(op13_repair(spark, f"/root/testdata/{sf}"))
        assert got == {conv: plain(turns[conv], by_dp) for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("parts", [1, 7])
def test_long_and_odd_conversations(spark, parts):
    rng = random.Random(5)
    texts = ["One.", "Two?", "cut", "", " \t", "gone on", None, "Three! \n"] + [f"Text {i}." for i in range(4000)]
    rows = [(1, t, rng.choice(["user", "assistant"] * 8 + ["system", None, "tool", ""]), rng.choice(texts)) for t in range(3000)]
    rows += [(None, t, "user", "Same.") for t in range(5)] + [(2, None, "user", "A."), (2, None, "assistant", "B."), (2, 9, None, None)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Say {t}.") for c in range(10, 60) for t in range(6)]
    rows += [(c, t, "user", "Gone.") for c in range(100, 160) for t in (0,)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hurt = repair.damaged(table)
        found = repair.repairs(hurt)
        got = answers(repair.summary(hurt))
        turns = damage(rows)
        assert got == {conv: plain(turns[conv], by_dp) for conv in {r[0] for r in rows}}
        lines = sorted(((r.at, f"{r.role}:{r.text}") for r in repair.repaired(hurt, found).where("conv_id = 1").collect()))
        assert hashlib.sha256("\n".join(t for _, t in lines).encode()).hexdigest() == got[1][-1] and [a for a, _ in lines] == list(range(len(lines)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # A conversation whose only row is gone.
    empty = [c for c in range(100, 160) if not turns[c]]
    assert empty and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in empty)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summary(repair.damaged(none)).collect() == []


def test_layers_are_shared(monkeypatch):
    made, step = [], repair.next_layer
    monkeypatch.setattr(repair, "next_layer", lambda layer, letter: made.append(letter) or step(layer, letter))
    sigs = sorted(["uauaua", "uauauS", "uaua", "ua", "x"])
    assert [s for s, _ in repair.trie_answers(iter(sigs))] == sigs
    assert len(made) == len({s[:k] for s in sigs for k in range(1, len(s) + 1)})
