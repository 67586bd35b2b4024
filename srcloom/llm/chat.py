r"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events, each belonging to a turn: `message` starts a message, `delta` appends to it, `edit`
replaces its text, `regenerate` throws its text away to be streamed again. Logs are partitioned by conversation and
sorted by turn and sequence, so all events of a message are neighbours, and one pass folds them into final messages and
renders each. The fold holds one message at a time: a conversation of any length streams through a task in bounded
memory, and an executor's loss repeats its partitions only.

The template writes a message as `<|im_start|>role\ntext<|im_end|>\n`. Control strings inside roles and texts (those
of CONTROL) are escaped by one backslash after their first character, and strings that look escaped get one more, so
reading back is exact. The loss mask covers the texts of assistants.

Null role, text or kind reads as empty, empty and `message`; an event without a message before it starts one. Rows with
equal turn and sequence are ordered by kind, role and text, and are messages each. Rows without a conversation id form
one conversation with a null id. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning to this template or to other common ones.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")


def escaped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), _ESCAPE, r"$1\\$2$3")


def unescaped(x: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", x)


def events_of_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of whole messages as events."""
    return rows.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events to rendered messages. Roles and texts come escaped."""
    nothing = object()
    conv: object = nothing
    turn: object = nothing
    role, parts, part = "", None, 0

    def rendered() -> tuple:
        return conv, part, f"{START}{role}\n{''.join(parts)}{END}\n", role == "assistant"

    for batch in batches:
        out = []
        for c, t, kind, r, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "kind", "role", "text")), strict=True):
            if c != conv or t != turn or kind == "message" or parts is None:
                if parts is not None:
                    out.append(rendered())
                    part = part + 1 if c == conv else 0
                conv, turn, role, parts = c, t, r, [text]
            elif kind == "delta":
                parts.append(text)
            else:  # edit, regenerate
                parts = [text]
        if out:
            yield _rows(out)
    if parts is not None:
        yield _rows([rendered()])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.large_string() if sum(len(r[2]) for r in out) > 1 << 28 else pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["conv_id", "part", "formatted", "loss"])


def formatted(events: DataFrame) -> DataFrame:
    """conv_id, part, formatted and loss (whether its text is trained on): a row for each message, each conversation's
    rows neighbours in one partition and in order. Concatenated, they are the conversation."""
    log = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    ordered = sorted_.select("conv_id", "turn", "kind", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    return ordered.mapInArrow(_fold, "conv_id long, part long, formatted string, loss boolean")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads conversations back, message by message, into counts and running digests."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    state: list | None = None

    def closed() -> tuple:
        return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    for batch in batches:
        out = []
        for conv, part, text, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "formatted", "loss")), strict=True):
            if state is None or part == 0:
                if state is not None:
                    out.append(closed())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, _, body = text[len(START) : -len(END) - 1].partition("\n")
            role, body = unescaped(role), unescaped(body)
            state[1] += 1
            state[2].update(f"{role}\n{body}\n".encode())
            state[5] += len(text)
            if loss:
                state[3] += len(body)
                state[4].update(body.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], list(names))
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(closed(), kinds, strict=True)], list(names))


def digest(events: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted rows: turns, their digest, and what the loss mask covers."""
    return formatted(events).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


#: The same rows in DuckDB.
SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) + 24 AS chars
  FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
