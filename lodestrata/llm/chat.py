"""Chat formatting by prefix-target expansion: each assistant turn is an example of its own, with all turns before it as context and only that reply trainable."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template. A turn is written as OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE, TARGET = "### ", ": ", "</turn>\n", "assistant"
_ESCAPED = re.compile(r"\\|###|</turn>|:")
_PLAIN = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)

SEGMENTS = "conv_id long, turn long, position long, role string, segment string, start long, stop long, loss_start long, loss_stop long, example long"


def escape(text: str) -> str:
    """A backslash before each backslash, `###`, `</turn>` and colon: no text can end a turn or begin one, and unescape() gives it back."""
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 2000, chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Small batches, so one task holds a bounded part of its rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("example", pa.int64())])


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        now, first, position, at, example = None, True, 0, 0, 0
        for r in _rows(batches):
            if first or r["conv_id"] != now:
                now, first, position, at, example = r["conv_id"], False, 0, 0, 0
            head = OPEN + escape(r["role"] or "") + MIDDLE
            body = escape(r["text"] or "")
            segment = head + body + CLOSE
            target = r["role"] == TARGET
            begin = at + len(head)
            yield now, r["turn"], position, r["role"] or "", segment, at, at + len(segment), begin if target else None, begin + len(body) if target else None, example if target else None
            position, at, example = position + 1, at + len(segment), example + target

    return _batches(rows(), _SEGMENT)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its formatted segment and where it lies in its conversation's rendering (code points).

    The rendering of a conversation is its segments in order, and every example is a prefix of it: example k ends where its target's
    segment ends and trains on [loss_start, loss_stop) alone. So all examples are stored in the space of one rendering, however
    long a conversation is; examples() lists them and render() writes them out in full. Rows are range-partitioned by conv_id, sorted,
    and streamed, so a task holds a batch of turns at a time and never a conversation.

    conversations: conv_id, turn, role, text. Ordered by turn (null first), then role, then text; equal rows are turns of their own.
    Null text and null role are empty; null conv_id is one more conversation; an empty table gives no rows; a conversation without
    assistant turns has segments and no example; other columns are left out.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    return turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, SEGMENTS)


def examples(segments: DataFrame) -> DataFrame:
    """One row per assistant turn: the example's length, and the span of it that is trained on."""
    return segments.where("example IS NOT NULL").select("conv_id", "example", F.col("turn").alias("target_turn"), F.col("stop").alias("n_chars"), "loss_start", "loss_stop")


EXPANDED = SEGMENTS + ", n_chars long, context_chars long"


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for r in _rows(batches):
            row = tuple(r[f.name] for f in _SEGMENT)
            if r["example"] is None:
                yield *row, None, None
            else:
                yield *row[:7], None, None, None, None, None
                # the example: the prefix before its reply is context, and the reply alone is trained on
                yield *row[:4], None, *row[5:], r["stop"], r["loss_start"]

    return _batches(rows(), _EXPANDED)


_EXPANDED = pa.schema([*_SEGMENT, ("n_chars", pa.int64()), ("context_chars", pa.int64())])


def expand(segments: DataFrame) -> DataFrame:
    """The prefix-target expansion: the rendering's segments, without targets, and after each assistant's an example of its own (segment NULL).

    Example k is the rendering's first n_chars: context_chars of context, its target [loss_start, loss_stop), and the turn's end. It is held
    as these spans, as its text is a prefix of the rendering that comes before it. Give it format_turns()'s own frame, which is sorted.
    """
    return segments.mapInArrow(_expand, EXPANDED)


def render(segments: DataFrame) -> DataFrame:
    """Every example written out in full: (conv_id, example, text, loss_start, loss_stop). Its size grows with the square of a conversation's turns, as these examples do."""
    part = segments.select(F.col("conv_id").alias("c"), F.col("position").alias("p"), "segment")
    last = segments.where("example IS NOT NULL").select("conv_id", "example", "position", "loss_start", "loss_stop")
    met = last.join(part, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p") <= F.col("position")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "segment"))), lambda x: x["segment"]), "")
    return met.groupBy("conv_id", "example", "loss_start", "loss_stop").agg(text.alias("text")).select("conv_id", "example", "text", "loss_start", "loss_stop")


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    m = _HEAD.match(segment)
    if not m or not segment.endswith(CLOSE):
        raise ValueError("this is no formatted turn")
    return unescape(m[1]), unescape(segment[m.end() : -len(CLOSE)])


def masked(segment: str, start: int, loss_start: int | None, loss_stop: int | None) -> str:
    """What of this segment is under the loss mask, unescaped."""
    return "" if loss_start is None else unescape(segment[loss_start - start : loss_stop - start])


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()), ("example_chars", pa.int64())])


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        state, last = None, None
        for r in _rows(batches):
            if state is None or r["conv_id"] != state[0]:
                if state:
                    yield out(state)
                state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            if r["segment"] is not None:
                last = r
                role, text = parse_segment(r["segment"])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[5] += len(r["segment"])
                continue
            # an example ends where the rendering so far does, and trains on a part of its last turn
            if not r["n_chars"] == state[5] or not last["start"] <= r["context_chars"] == r["loss_start"] <= r["loss_stop"] <= r["n_chars"]:
                raise ValueError("an example is no prefix of its conversation")
            loss = masked(last["segment"], last["start"], r["loss_start"], r["loss_stop"])
            state[3] += len(loss)
            state[4].update(loss.encode("utf-8", "surrogatepass"))
            state[6] += 1
            state[7] += r["n_chars"]
        if state:
            yield out(state)

    def out(s):
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6], s[7]

    return _batches(rows(), _DIGEST)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of what the formatted output says, parsed from it in the order it lies in: turns from the rendering, and the text under the loss mask from the examples. Give it format_turns()'s own frame, which is sorted."""
    return expand(segments).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long")


#: The fixed conversation -7 of the query: both texts hold the template's own marks.
TRAP = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return read_back(format_turns(turns))


OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': '
  || replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || '</turn>' || chr(10) AS s FROM t),
g AS (SELECT *, sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(s))::BIGINT AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples,
  coalesce(sum(CASE WHEN role = 'assistant' THEN stop END), 0)::BIGINT AS example_chars
FROM g GROUP BY conv_id
"""
