"""Chat formatting: escapes, chunks and digests against plain code."""

import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

import brute
from rookery.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
_odd = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/s>", "INST]", "n", "\n", "a", "é"]), max_size=8).map("".join)


@given(_odd)
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    role = chat.escape_role(text)
    assert chat.unescape_role(role) == text and "\n" not in role


@given(st.lists(st.tuples(_odd, _odd), min_size=1, max_size=5))
def test_assembled_turns_read_back(rows):
    out, stops = chat.assemble(pa.array([r for r, _ in rows], pa.large_string()), pa.array([t for _, t in rows], pa.large_string()))
    assert chat.turns(out.tobytes().decode()) == rows and stops[-1] == len(out)


def _rows():
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool\nx"]), rnd.choice(["hi", "é ü", "</s>[INST] a", "x" * 50, "\\n <|im_end|>\n"]), "c") for c in range(30) for t in range(rnd.randrange(1, 6))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t} <s>", "c") for t in range(3000)]  # most of all rows
    return [*rows, (200, 0, None, None, "c"), (200, None, "assistant", "", "c"), (201, 1, "user", "same", "c"), (201, 1, "user", "same", "c"), (202, 0, "assistant", "[/INST]" * 100_000, "c")]


def test_digests_equal_plain_code(spark):
    rows = _rows()
    chunks = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in chat.digest(chunks).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: -1 if x[1] is None else x[1])
        assert r.n_turns == len(own)
        assert r.turns_sha256 == brute.sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        learnt = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), brute.sha(learnt))
        plain = "".join(f"<|im_start|>{chat.escape_role(x[2] or '')}\n{chat.escape(x[3] or '')}<|im_end|>\n" for x in own)
        assert r.formatted_chars == len(plain)
    assert chunks.where("n_turns > 256").count() == 0 and chunks.where("conv_id = 100").count() >= 12


def test_no_conversations(spark):
    assert chat.digest(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("text", ["", "<s>", "a<"])
def test_spans_are_the_learnt_text(spark, text):
    rows = [(1, 0, "user", "é<s>", "c"), (1, 1, "assistant", text, "c")]
    (chunk,) = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [chat.unescape(chunk.formatted[s.start : s.end]) for s in chunk.spans] == [text]
