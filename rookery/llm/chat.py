"""Chat formatting: rendered conversations assembled as bytes, with the mask of the texts to learn.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside roles and texts get a
backslash after their first character, and ones that already have backslashes there get one more, so
that taking one away restores them; a line break in a role is written `\\n`. Rows of a slice are laid
out in numpy: lengths of the five segments of each turn, their offsets by a cumulative sum, scatter
indices for headers and contents, one preallocated buffer.

Turns are dealt by ranges of (conversation, turn), so that a long conversation is split over tasks
and comes out as several chunks; chunks in order are the conversation. A chunk's spans are code
points [start, end) of the chunk: the texts of `learn` roles, escaped.

Cases: null text or role is empty; null conversation or turn sorts first; turns of one number are
ordered by role and a hash of the text, and repeated rows are formatted each; an empty table gives no chunks;
other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.staging import buffer_of, slices, utf8

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (
    START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_TAILS = "|".join(re.escape(x[1:]) for x in CONTROL)
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_ROLE_ESCAPED = re.compile(r"\\(.)")
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)
CHUNK_TURNS = 256
CHUNK_SCHEMA = (
    "conv_id long, first_turn long, first_role string, first_hash long, n_turns long, formatted string, "
    "spans array<struct<start:int,end:int>>"
)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted chunk."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _escaped(column: pa.Array, how) -> pa.Array:
    """Applies `how` to the few values that hold a bracket or a backslash."""
    column = pc.fill_null(column, "")
    odd = np.flatnonzero(pc.match_substring_regex(column, r"[<\[\\\n]" if how is escape_role else r"[<\[]").to_numpy(zero_copy_only=False))
    if not len(odd):
        return column
    mask = np.zeros(len(column), bool)
    mask[odd] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([how(column[i].as_py()) for i in odd.tolist()], column.type))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all turns one after another, and the byte where each turn ends."""
    n = len(roles)
    parts = [_escaped(roles, escape_role), _escaped(texts, escape)]
    data, offsets = zip(*(buffer_of(utf8(p)) for p in parts))
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    lens = np.empty((n, 5), np.int64)
    lens[:, 0], lens[:, 2], lens[:, 4] = map(len, fixed)
    lens[:, 1], lens[:, 3] = np.diff(offsets[0]), np.diff(offsets[1])
    stops = np.cumsum(lens.ravel()).reshape(n, 5)
    starts = stops - lens
    out = np.empty(int(stops[-1, -1]) if n else 0, np.uint8)
    for k, piece in zip((0, 2, 4), fixed):
        out[starts[:, k, None] + np.arange(len(piece))] = piece
    for k, src, at in zip((1, 3), data, offsets):
        total = int(lens[:, k].sum())
        scatter = np.arange(total) + np.repeat(starts[:, k] - np.concatenate(([0], np.cumsum(lens[:, k])[:-1])), lens[:, k])
        out[scatter] = src[at[0] : at[0] + total]
    return out, stops[:, -1]


def _chunks(batch: pa.RecordBatch, learn: tuple[str, ...]) -> pa.RecordBatch:
    conv, roles, texts = (batch.column(c) for c in ("conv_id", "role", "text"))
    roles, texts = roles.cast(pa.large_string()), texts.cast(pa.large_string())
    out, stops = assemble(roles, texts)
    ids = conv.to_pylist()
    first, count = [], {}
    for i, c in enumerate(ids):
        if not i or c != ids[i - 1] or count[first[-1]] == CHUNK_TURNS:
            first.append(i)
            count[i] = 0
        count[first[-1]] += 1
    bounds = np.concatenate(([0], stops[np.array(first[1:] + [len(ids)]) - 1])).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    # code points: characters of the escaped parts, with the fixed parts between them
    role_chars = pc.utf8_length(_escaped(roles, escape_role)).to_numpy(zero_copy_only=False)
    text_chars = pc.utf8_length(_escaped(texts, escape)).to_numpy(zero_copy_only=False)
    turn_chars = role_chars + text_chars + len(START) + 1 + len(END) + 1
    begin = np.concatenate(([0], np.cumsum(turn_chars)))
    chosen = pc.is_in(pc.fill_null(roles, ""), pa.array(learn, roles.type)).to_numpy(zero_copy_only=False)
    spans = []
    for i in first:
        own = np.arange(i, i + count[i])[chosen[i : i + count[i]]]
        s = begin[own] - begin[i] + len(START) + role_chars[own] + 1
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s, s + text_chars[own])])
    take = pa.array(first)
    return pa.RecordBatch.from_pydict(
        {
            "conv_id": conv.take(take), "first_turn": batch.column("turn").take(take),
            "first_role": batch.column("role").take(take), "first_hash": batch.column("h").take(take),
            "n_turns": pa.array([count[i] for i in first], pa.int64()), "formatted": formatted,
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        }
    )


def format_chat(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Chunks of at most CHUNK_TURNS turns of one conversation, ordered by (first_turn, first_role, first_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _chunks(batch, learn)

    order = ("conv_id", "turn", "role", "h")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.xxhash64("text").alias("h"),
    )
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, CHUNK_SCHEMA)


def digest(chunks: DataFrame) -> DataFrame:
    """Per conversation, from its chunks alone: turns and learnt texts as running SHA-256 digests.

    Chunks are hashed to tasks by conversation, sorted on disk and streamed; a task keeps two hash
    states, whatever the length of a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, done = None, None, []
        for batch in slices(batches, "formatted"):
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
                if row is None or conv != now:
                    if row:
                        done.append(row)
                    now, row = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    row[1] += 1
                    row[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    learnt = unescape(text[s["start"] : s["end"]])
                    row[3] += len(learnt)
                    row[4].update(learnt.encode())
                row[5] += len(text)
            if len(done) > 1000:
                yield _digests(done)
                done = []
        if row:
            yield _digests([*done, row])

    order = ("conv_id", "first_turn", "first_role", "first_hash")
    return (
        chunks.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
            run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
        )
    )


def _digests(rows: list[list]) -> pa.RecordBatch:
    conv, n, said, chars, learnt, total = zip(*rows)
    return pa.RecordBatch.from_pydict(
        {
            "conv_id": pa.array(conv, pa.int64()), "n_turns": pa.array(n, pa.int64()),
            "turns_sha256": [h.hexdigest() for h in said], "loss_chars": pa.array(chars, pa.int64()),
            "loss_sha256": [h.hexdigest() for h in learnt], "formatted_chars": pa.array(total, pa.int64()),
        }
    )
