"""Turn repair and chat formatting: brute force over all edits, round trips, nulls, ties, repeated rows, clashing columns."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from trekspark.llm import chat_format, turn_repair

CONV = "conv_id long, turn long, role string, text string, there string, example int, turns string"
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y") for r in rows], CONV)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra over (cost, audit) with whole audits as tie breaks: rows are (role, text, fault)."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, seen, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", seen):
            return cost, audit, out
        state = (i, seen[-1:] if len(seen) > 1 else seen)
        if state in done:
            continue
        done.add(state)

        def go(c, a, j, role, text):
            new = seen + (role[:1] or "?") if role is not None else seen
            if re.fullmatch(r"s?(ua)*u?", new):
                heapq.heappush(heap, (cost + c, audit + a, j, new, out if role is None else (*out, (role, text))))

        go(2, "I", i, "user", "")
        go(2, "I", i, "assistant", "")
        if i < len(rows):
            role, text, fault = rows[i]
            go(3, "D", i + 1, None, None)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(0 + more, "K", i + 1, role, text)
                go(2 + more, "R", i + 1, "user", text)
                go(2 + more, "R", i + 1, "assistant", text)


def with_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        chars = SPACE.findall(text)
        fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_report(rows):
    """rows of one conversation as (turn, role, text), in order."""
    f = with_faults([r[1:] for r in rows])
    cost, audit, out = cheapest(f)
    turns = {r[0] for r in rows if r[0] is not None}
    count = lambda what: sum(x[2] == what for x in f)
    pairs = zip(f, f[1:])
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": count("blank"),
        "duplicate": count("duplicate"),
        "truncated": count("truncated"),
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (how != 0) + [(conv, turn, role, text)] * (how == 3)
    return out


def many_conversations(seed, n, longest=7):
    r, rows = random.Random(seed), []
    for c in range(n):
        for k in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, r.choice([k, k, k, k + 1, None]), role, r.choice(["Yes.", "No!", "cut off", "", " \t", None, f"Text {k}?", "　.", "ends \n", "Long. " * 50])))
    return rows


def test_repair_matches_a_search_over_all_edits(spark):
    rows = [*many_conversations(1, 400), *[(None, k, "user", f"{k}.") for k in range(4)], *[(900, k, "assistant", f"{k % 5} x") for k in range(60)]]
    df = conversations_of(spark, rows)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    got = {x.conv_id: x.asDict() for x in turn_repair.repair(df).withColumn("repaired_sha256", F.sha2(line, 256)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        mine = ordered([r for r in rows if r[0] == c])
        want[c] = {"conv_id": c, **plain_report([(t, a or "", b or "") for _, t, a, b in mine])}
    assert {c: {k: v for k, v in x.items() if k != "turns"} for c, x in got.items()} == want


def test_query_damages_and_repairs(spark, tmp_path):
    rows = many_conversations(2, 300)
    rows += [(c, 0, "user", "Alone.") for c in range(1000, 1100)]  # some are left without a row
    conversations_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x.asDict() for x in turn_repair.op11_prefix_doubling_repair(spark, str(tmp_path)).collect()}
    hurt = plain_damage(rows)
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert {r[0] for r in rows} - {r[0] for r in hurt}
    for c in {r[0] for r in rows}:
        mine = ordered([r for r in hurt if r[0] == c])
        assert got[c] == {"conv_id": c, **(plain_report([r[1:] for r in mine]) if mine else empty)}


def test_least_audit_of_long_conversations_is_greedy():
    """A node's optimal arcs differ in their labels, so the least audit takes the least label at each step."""
    r = np.random.default_rng(3)
    sizes = np.array([3000, 0, 1, 2, 700, 64, 65])
    first = np.concatenate([[0], np.cumsum(sizes)])
    role, fault = r.integers(0, 4, first[-1]), r.integers(0, 6, first[-1])
    paths = turn_repair.least_paths(role, fault < 2, fault == 2, first)
    for c, n in enumerate(sizes):
        a = first[c]
        togo = [[turn_repair.FAR] * 4 for _ in range(n + 1)]
        for i in range(n, -1, -1):
            for _ in range(3):
                for q in range(4):
                    togo[i][q] = min([x for x, *_ in arcs(togo, role, fault, a, i, n, q)], default=turn_repair.FAR)
        i, q, audit, cost = 0, 0, "", togo[0][0]
        while not (i == n and q in (0, 3)):
            _, label, i, q = min(x for x in arcs(togo, role, fault, a, i, n, q) if x[0] == togo[i][q])
            audit += label
        assert paths.cost[c] == cost
        assert turn_repair.INITIALS[paths.audit[paths.first[c] : paths.first[c + 1]]].tobytes().decode() == audit


def arcs(togo, role, fault, a, i, n, q):
    out, writes = [], (2, 2, 3, 2)[q]
    if i == n and q in (0, 3):
        out.append((0, "", n, q))
    out.append((2 + togo[i][writes], "I", i, writes))
    if i < n:
        out.append((3 + togo[i + 1][q], "D", i + 1, q))
        if fault[a + i] >= 2:
            more = int(fault[a + i] == 2)
            out.append((2 + more + togo[i + 1][writes], "R", i + 1, writes))
            mine = role[a + i]
            if mine == writes or mine == 1 and q == 0:
                out.append((more + togo[i + 1][mine], "K", i + 1, mine))
    return out


def test_repair_of_an_empty_table(spark):
    assert turn_repair.repair(conversations_of(spark, [])).collect() == []
    assert chat_format.read_back(chat_format.expand(conversations_of(spark, []))).collect() == []


HARD = ["", "<|end|>", "<|", "<\\|", "<\\\\|start|>", "a<", "|b", "<\\", "### User:", r"\### Assistant: </turn> ok", "<|text|>x<|end|><|start|>assistant<|text|>", "\U0001f600 é", None, "long " * 30000]


@pytest.mark.parametrize("text", [t for t in HARD if t is not None])
def test_escape_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)


def chats(seed, n):
    r, rows = random.Random(seed), []
    for c in range(n):
        for k in range(r.randint(1, 9)):
            rows.append((c, k, r.choice(["user", "assistant", "assistant", "system", "<|end|>", None]), r.choice(HARD)))
    return rows


def test_examples_hold_all_turns_before_a_reply(spark):
    rows = [*chats(4, 60), (70, None, "user", "first"), (70, 1, "assistant", "x"), (70, 1, "assistant", "x"), (None, 0, "assistant", None)]
    df = conversations_of(spark, rows)
    examples = chat_format.expand(df).collect()
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in ordered([r for r in rows if r[0] == c])]
        mine = sorted((x for x in examples if x.conv_id == c), key=lambda x: x.example)
        replies = [k for k, t in enumerate(turns) if t[0] == "assistant"]
        assert [x.n_context for x in mine if x.loss_start is not None] == replies
        for x in mine:
            upto = turns if x.loss_start is None else turns[: x.n_context + 1]
            assert chat_format.parse(x.text) == upto
            assert x.whole == (len(upto) == len(turns))
            if x.loss_start is not None:
                assert chat_format.unescape(x.text[x.loss_start : x.loss_end]) == turns[x.n_context][1]
        assert sum(x.whole for x in mine) == 1
        assert len(mine) == len(replies) + (not replies or replies[-1] != len(turns) - 1)


def test_small_batches_and_shuffled_examples_give_the_same(spark, monkeypatch):
    df = conversations_of(spark, chats(5, 40))
    want = sorted(map(tuple, chat_format.read_back(chat_format.expand(df), clustered=True).collect()))
    assert sorted(map(tuple, chat_format.read_back(chat_format.expand(df).repartition(5)).collect())) == want
    monkeypatch.setattr(chat_format, "BATCH_CHARS", 1)
    assert sorted(map(tuple, chat_format.read_back(chat_format.expand(df), clustered=True).collect())) == want


def test_digest_matches_sql(spark, tmp_path):
    conversations_of(spark, [*chats(6, 80), (3, None, "user", "null turn"), (3, 2, "assistant", "tie"), (3, 2, "assistant", "tie")]).drop("there", "example", "turns").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(chat_format.OP12_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    got = chat_format.op12_prefix_target_expansion(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == want and any(x[0] == -7 for x in want)
