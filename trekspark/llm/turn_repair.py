"""Conversation structure repair: least-cost edits of each conversation, ties by prefix-doubling path ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekspark.llm.common import gives_memory_back, read_table

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs; the last for each truncated row that stays
DELETE_AUDIT, INSERT_AUDIT, KEEP_AUDIT, REROLE_AUDIT = 0, 1, 2, 3  # labels in the order of their ASCII initials
INITIALS = np.frombuffer(b"DIKR", np.uint8)
CHUNK_ROWS = 20_000  # whole conversations that are repaired together in a task
BATCH_CHARS = 4_000_000  # of repaired turns that leave a task together

#: What has been written when a state holds: nothing; a system turn; last a user turn; last an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
WRITES = np.array([USER, USER, ASSISTANT, USER])  # the next turn of a pattern s?(ua)+, by state; a system turn only first
ENDS = np.array([True, False, False, True])
FAR = 1 << 28

_SPACE = " \t\n\x0b\x0c\r"
_ALLOWED = {"su", "ua", "au"}


@dataclass
class Paths:
    """The least audit of each conversation: edits in order, the row that each takes (-1 for an insertion), the state after it."""

    cost: np.ndarray  # by conversation
    first: np.ndarray  # where its edits begin; one more at the end
    audit: np.ndarray
    row: np.ndarray
    state: np.ndarray


def least_paths(role: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray, first: np.ndarray) -> Paths:
    """Cheapest edits of conversations whose rows stand one after another; ``first`` has where each begins, and the end.

    ``role`` is SYSTEM, USER, ASSISTANT or NOTHING (any other); rows of ``must_go`` are deleted. Nodes are (gap before
    a row or after the last one, state). The cost DP runs from the last gap to the first, for all conversations at once,
    longest first, so a step only handles those that have such a row. Then nodes on optimal arcs are ranked by their
    least audits of 1, 2, 4, ... edits: a node's rank for twice the length is that of the pair (its rank, the rank of
    the node that its pointer leads to), and its pointer that node's pointer. Ranks choose among a node's
    optimal arcs, and following the chosen arcs from the first gap gives the least audit.
    """
    sizes = np.diff(first)
    gaps = sizes + 1
    base = np.concatenate([[0], np.cumsum(gaps)])  # of each conversation's gaps
    togo = np.full((base[-1], 4), FAR, np.int32)
    arc_cost = np.full((base[-1], 4, 4), FAR, np.int32)  # gap, state, label
    arc_to = np.zeros((base[-1], 4, 4), np.int64)  # node: 4 * gap + state
    states = np.arange(4)
    by_size = np.argsort(-sizes, kind="stable")
    many = np.searchsorted(-sizes[by_size], -np.arange(sizes.max(initial=0) + 1), side="right")  # with at least so many rows
    for back in range(sizes.max(initial=0) + 1):
        of = by_size[: many[back]]
        gap = base[of] + sizes[of] - back
        step = np.full((len(of), 4, 4), FAR, np.int32)
        if back == 0:
            best = np.where(ENDS, 0, FAR)[None].repeat(len(of), 0)
        else:
            row = first[of] + sizes[of] - back
            after, stays = gap + 1, np.where(must_go[row], FAR, CUT_OFF * cut_off[row])
            step[:, :, DELETE_AUDIT] = DELETE + togo[after]
            arc_to[gap, :, DELETE_AUDIT] = 4 * after[:, None] + states
            step[:, :, REROLE_AUDIT] = (REROLE + stays)[:, None] + togo[after][:, WRITES]
            arc_to[gap, :, REROLE_AUDIT] = 4 * after[:, None] + WRITES
            mine = role[row]
            fits = (WRITES == mine[:, None]) | ((states == NOTHING) & (mine == SYSTEM)[:, None])
            step[:, :, KEEP_AUDIT] = np.where(fits, (KEEP + stays + togo[after, mine])[:, None], FAR)
            arc_to[gap, :, KEEP_AUDIT] = (4 * after + mine)[:, None]
            best = step.min(2)
        for _ in range(2):  # two insertions lead back to where they began
            best = np.minimum(best, INSERT + best[:, WRITES])
        togo[gap] = best
        step[:, :, INSERT_AUDIT] = INSERT + best[:, WRITES]
        arc_to[gap, :, INSERT_AUDIT] = 4 * gap[:, None] + WRITES
        arc_cost[gap] = step
    togo, arc_cost, arc_to = togo.ravel(), arc_cost.reshape(-1, 4), arc_to.reshape(-1, 4)
    ended = np.zeros(len(togo), bool)
    ended[4 * (base[1:] - 1) + NOTHING] = ended[4 * (base[1:] - 1) + ASSISTANT] = True
    optimal = (arc_cost == togo[:, None]) & (togo < FAR)[:, None] & ~ended[:, None]
    start = 4 * base[:-1]
    chosen = _ranked(optimal, arc_to, _from(start, optimal, arc_to))
    return _walk(start, chosen, arc_to, ended, base, first, togo[start])


def _from(start: np.ndarray, optimal: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The nodes that optimal arcs lead to from the first gaps, in order."""
    seen, now = np.zeros(len(optimal), bool), np.unique(start)
    while len(now):
        seen[now] = True
        now = np.unique(to[now][optimal[now]])
        now = now[~seen[now]]
    return np.flatnonzero(seen)


def _ranked(optimal: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The label of each node's first edit of its least audit; -1 where it ends."""
    n = len(nodes)
    place = np.full(len(optimal), n)
    place[nodes] = np.arange(n)
    arcs, there = place[to[nodes]], optimal[nodes]
    arcs = np.where(there, arcs, n)
    label = np.where(there.any(1), there.argmax(1), -1)  # least label: rank by one edit, arcs of a node differ in their labels
    pointer = np.append(np.where(label >= 0, arcs[np.arange(n), np.maximum(label, 0)], n), n)  # n is the end of all
    rank = np.unique(np.append(label + 1, 0), return_inverse=True)[1]  # an audit that ends comes before all that it begins
    live = np.flatnonzero(pointer[:n] < n)
    while len(live):
        pair = rank * (rank.max() + 1) + rank[pointer]
        new = np.unique(pair, return_inverse=True)[1]
        pointer = pointer[pointer]
        if new.max() == rank.max():  # no two nodes are told apart any more
            break
        rank, live = new, np.flatnonzero(pointer[:n] < n)
    first_rank = np.where(there, rank[arcs], np.iinfo(np.int64).max)
    order = np.where(there, np.arange(4) * (rank.max() + 2) + first_rank, np.iinfo(np.int64).max)  # by label, then by the rank of what follows
    chosen = np.full(len(optimal), -1)
    chosen[nodes] = np.where(there.any(1), order.argmin(1), -1)
    return chosen


def _walk(start: np.ndarray, chosen: np.ndarray, to: np.ndarray, ended: np.ndarray, base: np.ndarray, first: np.ndarray, cost: np.ndarray) -> Paths:
    """Follow the chosen arcs of all conversations at once, an edit of each at a time."""
    whose, audit, row, state, now = [], [], [], [], start.copy()
    live = np.flatnonzero(~ended[now])
    while len(live):
        at = now[live]
        what, after = chosen[at], to[at, chosen[at]]
        whose.append(live)
        audit.append(what)
        row.append(np.where(what == INSERT_AUDIT, -1, at // 4 - base[live] + first[live]))
        state.append(after % 4)
        now[live] = after
        live = live[~ended[after]]
    if not whose:
        return Paths(cost, np.zeros(len(start) + 1, np.int64), *(np.empty(0, np.int64) for _ in range(3)))
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    begins = np.searchsorted(whose[order], np.arange(len(start) + 1))
    return Paths(cost, begins, *(np.concatenate(x)[order] for x in (audit, row, state)))


def by_conversation(conversations: DataFrame, present: str | None) -> DataFrame:
    """Rows of a conversation together in one partition, by turn (nulls first, then by role and text)."""
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.when(there, F.col(c)), F.lit("")).alias(c) for c in ("role", "text")), there.alias("there"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, CHUNK_ROWS rows or one conversation at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < CHUNK_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = _starts(rows["conv_id"].chunk(0))[-1]
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(ids: pa.Array) -> np.ndarray:
    """Where another id begins."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])


def _faults(role: list[str], text: list[str], first: np.ndarray) -> np.ndarray:
    """By row: 0 none, 1 blank, 2 duplicate of an earlier row of its conversation, 3 truncated."""
    out = np.zeros(len(role), np.int8)
    for a, b in zip(first, first[1:]):
        seen = set()
        for k in range(a, b):
            body = text[k].rstrip(_SPACE)
            if not body:
                out[k] = 1
            elif (role[k], text[k]) in seen:
                out[k] = 2
            else:
                seen.add((role[k], text[k]))
                out[k] = 3 * (body[-1] not in ".!?")
    return out


def _repair(rows: pa.Table) -> Iterator[tuple[pa.Array, dict]]:
    """Each conversation's id and report, with its repaired turns as ``role:text``."""
    starts = _starts(rows["conv_id"].chunk(0))
    ids = rows["conv_id"].chunk(0).take(pa.array(starts))
    there = rows["there"].to_numpy()
    kept = rows.filter(rows["there"])
    first = np.concatenate([[0], np.cumsum(np.add.reduceat(there.astype(np.int64), starts))])
    role, text, turn = kept["role"].to_pylist(), kept["text"].to_pylist(), kept["turn"].to_pylist()
    initial = [x[:1] for x in role]
    fault = _faults(role, text, first)
    kind = np.array([{"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(x, NOTHING) for x in initial], np.int64)
    paths = least_paths(kind, (fault == 1) | (fault == 2), fault == 3, first)
    audits = INITIALS[paths.audit].tobytes().decode()
    for c in range(len(starts)):
        a, b, x, y = first[c], first[c + 1], paths.first[c], paths.first[c + 1]
        turns = {t for t in turn[a:b] if t is not None}
        repaired = []
        for what, k, state in zip(paths.audit[x:y].tolist(), paths.row[x:y].tolist(), paths.state[x:y].tolist()):
            if what != DELETE_AUDIT:
                name = role[k] if what == KEEP_AUDIT else "user" if state == USER else "assistant"
                repaired.append((name, "" if what == INSERT_AUDIT else text[k]))
        yield (
            ids.slice(c, 1),
            {
                "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                "blank": int((fault[a:b] == 1).sum()),
                "duplicate": int((fault[a:b] == 2).sum()),
                "truncated": int((fault[a:b] == 3).sum()),
                "illegal": sum(p + q not in _ALLOWED for p, q in zip(initial[a:b], initial[a + 1 : b])),
                "cost": int(paths.cost[c]),
                "audit": audits[x:y],
                "turns": repaired,
            },
        )


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair(conversations: DataFrame, present: str | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its cheapest repair, and ``turns``, the repaired
    conversation as an array of (role, text).

    Rows are taken by turn (nulls first; equal turns by role and text). A row is blank (only white space), a duplicate
    (role and text seen earlier in the conversation) or truncated (its last other character is none of ``.!?``),
    whichever is first. Edits: keep 0, another role 2, delete 3 (blank and duplicate rows must go), insert an
    empty user or assistant turn 2; each truncated row that stays 1. The result's role initials match ``(s?(ua)+)?``; of equally cheap
    edits the ones whose initials are ASCII-least are taken. gaps: missing numbers between the least and the greatest turn; illegal:
    neighbouring rows whose role initials are not su, ua or au.

    Null roles and texts are empty; rows of null conv_id are one conversation; an empty table gives an empty result;
    further columns are not read. Rows whose column ``present`` is not true only name their conversation, which is
    reported though it has no row left (zeros, no turns). Rows are shuffled once; a task holds CHUNK_ROWS rows, or one conversation where that is longer.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [*[pa.int64()] * 6, pa.string()]
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            out, held = [], 0
            for one in _repair(rows):
                out.append(one)
                held += 100 + sum(len(t) for _, t in one[1]["turns"])
                if held >= BATCH_CHARS:
                    yield table(out)
                    out, held = [], 0
            if out:
                yield table(out)

    def table(out: list[tuple[pa.Array, dict]]) -> pa.RecordBatch:
        ids, reports = zip(*out)
        turns = pa.array([[{"role": r, "text": t} for r, t in x["turns"]] for x in reports], turn)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array([x[n] for x in reports], k) for n, k in zip(names, kinds)), turns], names=["conv_id", *names, "turns"])

    return by_conversation(conversations, present).mapInArrow(run, f"conv_id {kind}, {REPORT}, turns array<struct<role: string, text: string>>")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn``, nulls as one space; ``_there`` is false for those that are dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", F.when(how == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (how != 0).alias("_there"), how.alias("_how"))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_how", "_copy")


def op11_prefix_doubling_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(damaged(read_table(spark, sf_dir, "conversations")), present="_there")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return out.withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n"), 256)).drop("turns")
