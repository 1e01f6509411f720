"""Conversation repair against plain Python: every rule of the contract, and a search over all edits."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from conftest import SF_SMALL
from rolloutlab.llm import conversation_repair as C

sys.setrecursionlimit(20_000)          # the plain search recurses along a conversation
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NONBLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """Fault letter of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = NONBLANK.findall(text)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit) by a plain search from the back over whole strings."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if inserts < 2:
            for r in "ua":
                if r in step[state]:
                    c, a = best(i, step[state][r], inserts + 1)
                    found.append((c + 3, "I" + a))
        if i == len(rows):
            return min(found + ([(0, "")] if state in ("", "a") else [])) if found or state in ("", "a") else (10**9, "")
        initial, more = rows[i][1][:1], 3 if marks[i] == "t" else 0
        c, a = best(i + 1, state, 0)
        found.append((c + 4, "D" + a))
        if marks[i] not in "bd":
            if initial and initial in step[state]:
                c, a = best(i + 1, step[state][initial], 0)
                found.append((c + more, "K" + a))
            for r in "ua":
                if r in step[state]:
                    c, a = best(i + 1, step[state][r], 0)
                    found.append((c + 3 + more, "R" + a))
        return min(found)

    return best(0, "", 0)


def plain(rows):
    """The result row of one conversation's (turn, role, text), already in order."""
    marks = faults(rows)
    cost, audit = cheapest(rows, marks)
    lines, state, at = [], "", 0
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    for e in audit:
        if e == "I":
            state = nxt[state]
            lines.append(("user" if state == "u" else "assistant") + ":")
            continue
        _, role, text = rows[at]
        at += 1
        if e == "K":
            state = role[0]
            lines.append(f"{role}:{text}")
        elif e == "R":
            state = nxt[state]
            lines.append(("user" if state == "u" else "assistant") + ":" + text)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": marks.count("b"), "duplicate": marks.count("d"),
            "truncated": marks.count("t"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def ordered(rows):
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))


def check(spark, conversations, chunk=C.CHUNK):
    """conversations: id -> list of (turn, role, text)."""
    data = [(c, *r) for c, rows in conversations.items() for r in rows]
    random.Random(1).shuffle(data)
    got = {r["conv_id"]: r.asDict() for r in C.repair(spark.createDataFrame(data, SCHEMA), chunk).collect()}
    want = {c: {"conv_id": c} | plain(ordered(rows)) for c, rows in conversations.items() if rows}
    assert got == want


def some(rng, n, texts=("One.", "Two!", "cut", "", " \t", "Three? ", "é")):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice(roles), rng.choice(texts + (None, f"T{i}.", f"t{i}")))
            for i in range(n)]


def test_random_conversations_equal_the_plain_search(spark):
    rng = random.Random(5)
    check(spark, {i: some(rng, rng.randint(1, 9)) for i in range(300)} | {None: some(rng, 6)})


def test_chunks_of_any_size_give_the_same(spark):
    rng = random.Random(6)
    conversations = {i: some(rng, rng.randint(1, 40)) for i in range(40)}
    for chunk in (1, 2, 3, 7):
        check(spark, conversations, chunk)


def test_long_conversation(spark):
    rng = random.Random(7)
    check(spark, {1: some(rng, 400, ("A.", "B")), 2: [(i, "user", f"Same {i}.") for i in range(300)]}, 64)


def test_all_short_role_strings_against_every_edit(spark):
    """All edit strings of up to three turns, with every insert allowed, priced one by one."""
    grammar = re.compile(r"(s?(ua)+)?\Z")

    def exhaustive(rows, marks):
        found = []
        slots = [[""], ["I"], ["I", "I"]]
        for edits in itertools.product("KDuA", repeat=len(rows)):
            for gaps in itertools.product(range(3), repeat=len(rows) + 1):
                for fill in itertools.product("ua", repeat=sum(gaps)):
                    fill = list(fill)
                    out, audit, cost = "", "", 0
                    ok = True
                    for i in range(len(rows) + 1):
                        for _ in range(gaps[i]):
                            out, audit, cost = out + fill.pop(0), audit + "I", cost + 3
                        if i < len(rows):
                            e = edits[i]
                            if e == "D":
                                audit, cost = audit + "D", cost + 4
                            elif marks[i] in "bd":
                                ok = False
                            else:
                                out += rows[i][1][0] if e == "K" else e.lower()
                                audit, cost = audit + ("K" if e == "K" else "R"), cost + (e != "K") * 3 + (marks[i] == "t") * 3
                    if ok and grammar.match(out):
                        found.append((cost, audit))
        return min(found)

    for n in (1, 2):
        for roles in itertools.product(("user", "assistant", "system", "x"), repeat=n):
            for texts in itertools.product(("ok.", "cut", ""), repeat=n):
                rows = [(i, r, t and f"{i}{t}") for i, (r, t) in enumerate(zip(roles, texts))]
                marks = faults(rows)
                assert exhaustive(rows, marks) == cheapest(rows, marks), rows


def test_audit_order_and_collisions():
    class Weak(C.Audits):
        def add(self, parent, edits):
            node = super().add(parent, edits)
            self.hash[node] = 0                               # every hash collides: only the verification decides
            return node

    rng = random.Random(3)
    for kind in (C.Audits, Weak):
        audits, nodes = kind(), {"": 0}
        for _ in range(300):
            parent = rng.choice(list(nodes))
            e = rng.choice("DIKR")
            if parent + e not in nodes or rng.random() < 0.3:   # also a second node with the same edits
                nodes[parent + e] = audits.add(nodes[parent], e)
        pairs = [rng.sample(list(nodes), 2) for _ in range(800)]
        assert all(audits.less(nodes[a], nodes[b]) == (a < b) for a, b in pairs)
        assert all("".join(audits.edits(n)) == s for s, n in nodes.items())


def test_query_damages_and_returns_every_conversation(spark):
    import duckdb
    got = {r["conv_id"]: r.asDict() for r in C.op12_conversation_repair(spark, SF_SMALL).collect()}
    convs = {}
    for conv, turn, role, text in duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{SF_SMALL}/conversations.parquet'").fetchall():
        rows = convs.setdefault(conv, [])
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if m == 1:
            text = ""
        elif m == 2:
            text = re.sub("[.!?]", "", text)
        elif m == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    zero = {k: 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {
        "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert got == {c: {"conv_id": c} | (plain(ordered(rows)) if rows else zero) for c, rows in convs.items()}


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None)], [(None, None, "user", "Hi."), (None, None, "assistant", "Yes.")],
                                  [(1, 0, "user", "x" * 300_000), (1, 1, "assistant", "Fine.")] * 2])
def test_edges(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kind", "2 AS chunk", "3 AS payload", "4 AS same")
    got = [r.asDict() for r in C.repair(df).collect()]
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(tuple(r))
    assert got == [{"conv_id": c} | plain(ordered(r)) for c, r in convs.items()]
    df.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op12_conversation_repair(spark, str(tmp_path)).count() == len(convs)
