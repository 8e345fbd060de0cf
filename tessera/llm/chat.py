r"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn>role\n text </turn>\n`` (without the blanks). Inside roles and texts a backslash is put before
each backslash and into each control string (``<\turn>``, ``<\/turn>``), in roles also before a line feed, so a control
string in the output always is one of the template's, and dropping each backslash that starts a pair gives the text
back. For a slice of turns numpy finds what to escape, computes lengths, cumulative offsets and scatter indices, and
copies headers and contents into one preallocated buffer, which Arrow takes as it is.

Turns are dealt by ranges of (conversation, turn), so a conversation with a large part of all rows is formatted by many
tasks. It then comes as several rows: chunks whose order is (part, seq). ``loss_starts`` and ``loss_ends`` bound, in
code points of the chunk, the contents of assistant turns.

Defined results: a null text or role counts as empty; a null conversation is one of its own; ties of (conversation,
turn) are ordered by role, then text, nulls first; repeated rows are formatted each; texts of any length take one slice;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

OPEN, BREAK, CLOSE = b"<turn>", b"\n", b"</turn>\n"
_CONTROLS = (b"<turn>", b"</turn>")
_HEADER = re.compile(r"<turn>((?:\\.|[^\\\n])*)\n", re.S)
_END = CLOSE.decode()
_ESCAPED = re.compile(r"\\(.)", re.S)
TRAINED = "assistant"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column, nulls as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _marks(data: np.ndarray, offsets: np.ndarray, breaks: bool) -> np.ndarray:
    """1 before each byte that a backslash has to precede."""
    marks = np.zeros(len(data), np.int64)
    marks[data == ord("\\")] = 1
    if breaks:
        marks[data == ord("\n")] = 1
    opened = np.flatnonzero(data == ord("<"))
    ends = offsets[np.searchsorted(offsets, opened, "right")]
    for control in _CONTROLS:
        whole = opened[opened + len(control) <= ends]
        hit = (data[whole[:, None] + np.arange(len(control))] == np.frombuffer(control, np.uint8)).all(axis=1)
        marks[whole[hit] + 1] = 1
    return marks


class _Segment:
    """A column's escaped bytes: their lengths, and how they are scattered."""

    def __init__(self, column: pa.Array, breaks: bool = False):
        self.data, self.offsets = _flat(column)
        self.marks = _marks(self.data, self.offsets, breaks)
        self.before = np.concatenate([[0], np.cumsum(self.marks)])
        self.lengths = np.diff(self.offsets) + np.diff(self.before[self.offsets])

    def scatter(self, out: np.ndarray, starts: np.ndarray) -> None:
        shift = starts - self.offsets[:-1] - self.before[self.offsets[:-1]]
        at = np.arange(len(self.data)) + self.before[1:] + np.repeat(shift, np.diff(self.offsets))
        out[at] = self.data
        out[at[self.marks == 1] - 1] = ord("\\")


def _put(out: np.ndarray, starts: np.ndarray, literal: bytes) -> None:
    out[starts[:, None] + np.arange(len(literal))] = np.frombuffer(literal, np.uint8)


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> dict[str, pa.Array]:
    """Chunks of consecutive turns with one conversation id; the turns are in order."""
    n = len(conv)
    roles, texts = _Segment(role, breaks=True), _Segment(text)
    lengths = len(OPEN) + roles.lengths + len(BREAK) + texts.lengths + len(CLOSE)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, np.uint8)
    _put(out, starts, OPEN)
    roles.scatter(out, starts + len(OPEN))
    text_starts = starts + len(OPEN) + roles.lengths + len(BREAK)
    _put(out, text_starts - len(BREAK), BREAK)
    texts.scatter(out, text_starts)
    text_ends = text_starts + texts.lengths
    _put(out, text_ends, CLOSE)

    same = pc.fill_null(pc.equal(conv.slice(1), conv.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    first = np.concatenate([[True], ~(same | (null[1:] & null[:-1]))])
    heads = np.flatnonzero(first)
    bounds = np.append(starts[heads], ends[-1])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    trained = pc.fill_null(pc.equal(role, TRAINED), False).to_numpy(zero_copy_only=False)
    chunk = np.cumsum(first) - 1
    base = points[bounds[chunk[trained]]]
    spans = pa.array(np.concatenate([[0], np.cumsum(np.bincount(chunk[trained], minlength=len(heads)))]), pa.int32())
    return {
        "conv_id": conv.take(pa.array(heads)),
        "n_turns": pa.array(np.bincount(chunk, minlength=len(heads))),
        "formatted": pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(bounds.astype(np.int64)), buffer),
        "loss_starts": pa.ListArray.from_arrays(spans, pa.array(points[text_starts[trained]] - base)),
        "loss_ends": pa.ListArray.from_arrays(spans, pa.array(points[text_ends[trained]] - base)),
    }


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, part, seq, n_turns, formatted, loss_starts, loss_ends; see the module."""
    chosen = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    dealt = chosen.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                found = assemble(rows.column("conv_id"), rows.column("role"), rows.column("text"))
                n = len(found["conv_id"])
                order = {"part": pa.array([part] * n, pa.int32()), "seq": pa.array(range(seq, seq + n), pa.int64())}
                seq += n
                columns = order | found
                columns["formatted"] = columns["formatted"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([columns[f] for f in names], names)

    schema = T.StructType(
        [
            T.StructField("conv_id", chosen.schema["conv_id"].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("seq", T.LongType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss_starts", T.ArrayType(T.LongType())),
            T.StructField("loss_ends", T.ArrayType(T.LongType())),
        ]
    )
    names = schema.names
    return dealt.mapInArrow(run, schema)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn."""
    at = 0
    while at < len(formatted):
        header = _HEADER.match(formatted, at)
        end = formatted.index(_END, header.end())
        yield unescape(header[1]), unescape(formatted[header.end() : end])
        at = end + len(_END)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read back from the chunks.

    SHA-256 is sequential, so a conversation's chunks go to one task, which streams them in bounded memory.
    """
    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def closed(s: list) -> pa.RecordBatch:
            row = [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *(pa.int64(), pa.string()) * 2, pa.int64()]
            done = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        done.append(closed(state))
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                whole = row["formatted"]
                for role, text in parse(whole):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for start, end in zip(row["loss_starts"], row["loss_ends"]):
                    learnt = unescape(whole[start:end])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(whole)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield closed(state)

    schema = T.StructType(
        [
            T.StructField("conv_id", chunks.schema["conv_id"].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    names = schema.names
    return dealt.mapInArrow(run, schema)


def with_probe(turns: DataFrame) -> DataFrame:
    r"""The conversations and number -7, whose texts look like control strings."""
    spark: SparkSession = turns.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
made AS (SELECT *, '<turn>' || replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'),
    '</turn>', '<\/turn>'), chr(10), '\' || chr(10)) || chr(10) || replace(replace(replace(text, '\', '\\'),
    '<turn>', '<\turn>'), '</turn>', '<\/turn>') || '</turn>' || chr(10) AS formatted FROM plain)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM made GROUP BY conv_id"""
