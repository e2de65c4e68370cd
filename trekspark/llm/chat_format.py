"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekspark.llm.common import gives_memory_back, read_table

START, SEP, END = "<|start|>", "<|text|>", "<|end|>"
REPLIER = "assistant"
BATCH_CHARS = 4_000_000  # of examples that leave a task together

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)

EXAMPLES = "conv_id {kind}, example int, n_context int, text string, loss_start int, loss_end int, whole boolean"


def escape(text: str) -> str:
    """A text in which no control string can be read: each of ``<|``, ``<\\|``, ``<\\\\|`` ... gets one backslash more."""
    return _CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example; ValueError if it holds anything else."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return turns


def by_conversation(conversations: DataFrame) -> DataFrame:
    """conv_id, role and text with a conversation's rows in one partition, by turn (nulls first, then by role and text)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def expand(conversations: DataFrame, replier: str = REPLIER) -> DataFrame:
    """One row per turn of ``replier``: all turns before it as context, then its reply, which alone is trainable.

    conv_id, example (from 0 within the conversation), n_context (turns before the reply), text (formatted, control
    strings within roles and texts escaped), loss_start and loss_end (the code points of the reply in text), whole
    (text holds all turns of the conversation). Where a conversation does not end with a reply, one more row holds all
    its turns with loss_start and loss_end null, so no turn is lost. Null roles and texts are empty; null turns come first, equal ones
    in the order of role and text; rows of null conv_id are one conversation; repeated rows are turns of their own; an empty
    table gives an empty result; further columns are not read.

    Rows are shuffled once, by conversation. A task holds one conversation's formatted text and a batch of about
    BATCH_CHARS; what it writes is, by the method, the sum of all prefixes.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names: list[pa.Array] = []
        held, now, formatted, turns, made, open_end = 0, None, "", 0, 0, False

        def batch() -> pa.RecordBatch:
            columns = zip(*out)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            arrays = [pa.array(x, k) for x, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(names), *arrays], names=[x.split()[0] for x in EXAMPLES.split(", ")])

        def closed() -> None:
            """The conversation is over: its last reply holds all turns, or one more row does."""
            if now is None:
                return
            if open_end:
                out.append((made, turns, formatted, None, None, True))
                names.append(now)
            else:
                out[-1] = (*out[-1][:-1], True)

        for rows in batches:
            ids = rows.column(0)
            for k, (role, text) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())):
                one = ids.slice(k, 1)
                if now is None or not one.equals(now):
                    closed()
                    now, formatted, turns, made, open_end = one, "", 0, 0, False
                    if held >= BATCH_CHARS:
                        yield batch()
                        out, names, held = [], [], 0
                body = escape(text)
                formatted += f"{START}{escape(role)}{SEP}"
                begin = len(formatted)
                formatted += body + END
                open_end = role != replier
                if not open_end:
                    if held >= BATCH_CHARS:  # before the row, so that the last one can still be marked
                        yield batch()
                        out, names, held = [], [], 0
                    out.append((made, turns, formatted, begin, begin + len(body), False))
                    names.append(now)
                    held += len(formatted)
                    made += 1
                turns += 1
        closed()
        if out:
            yield batch()

    return by_conversation(conversations).mapInArrow(run, EXAMPLES.format(kind=kind))


def read_back(examples: DataFrame, clustered: bool = False) -> DataFrame:
    """What stands in examples, per conversation: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each
    turn of the row that holds all), loss_chars and loss_sha256 (all text under the loss mask, unescaped), formatted_chars (of all rows).

    ``clustered``: rows of a conversation stand together in order, as ``expand`` gives them; others are shuffled and sorted
    first. Texts that are no formatted turns are an error. An empty table gives an empty result.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    @gives_memory_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, [None, None, 0, hashlib.sha256(), 0]

        def result() -> list[tuple]:
            return [] if now is None else [(now, state[0], state[1], state[2], state[3].hexdigest(), state[4])]

        for rows in batches:
            out, ids = [], rows.column(0)
            texts, begins, ends, whole = (rows.column(i).to_pylist() for i in (3, 4, 5, 6))
            for k, text in enumerate(texts):
                one = ids.slice(k, 1)
                if now is None or not one.equals(now):
                    out += result()
                    now, state = one, [None, None, 0, hashlib.sha256(), 0]
                if whole[k]:
                    turns = parse(text)
                    state[0], state[1] = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                if begins[k] is not None:
                    reply = unescape(text[begins[k] : ends[k]])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                state[4] += len(text)
            if out:
                yield table(out)
        if now is not None:
            yield table(result())

    def table(out: list[tuple]) -> pa.RecordBatch:
        ids, *columns = zip(*out)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=names)

    rows = examples.select("conv_id", "example", "n_context", "text", "loss_start", "loss_end", "whole")
    if not clustered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = (-7, r"\### Assistant: </turn> ok")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one of a user and an assistant row whose texts look like a template's control strings."""
    probe = conversations.sparkSession.range(2).select(F.lit(PROBE[0]).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE[1]).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op12_prefix_target_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(expand(with_probe(read_table(spark, sf_dir, "conversations"))), clustered=True)


_ESCAPE_SQL = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"

OP12_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '{PROBE[1]}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
f AS (SELECT *, row_number() OVER w AS i, lead(1) OVER w IS NULL AS is_last,
  sum(length('{START}{SEP}{END}') + length({_ESCAPE_SQL.format('role')}) + length({_ESCAPE_SQL.format('text')})) OVER (w ROWS UNBOUNDED PRECEDING) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(chars) FILTER (WHERE role = 'assistant' OR is_last), 0) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""
