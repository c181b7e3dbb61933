"""Free text: JSON objects inside prose, move claims, sections, escapes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json|JSON)?\s*(.*?)```", re.DOTALL)
_FENCE_SQL = r"(?s)```(?:json|JSON)?\s*(.*?)```"


def _object_slice(text: str | None) -> str | None:
    """Source text of the first JSON object: each fence first, then the whole text."""
    if text is None:
        return None
    decoder = json.JSONDecoder()
    for chunk in [m.strip() for m in _FENCE.findall(text)] + [text.strip()]:
        try:
            if isinstance(json.loads(chunk), dict):
                return chunk
        except ValueError:
            pass
        at = chunk.find("{")
        while at >= 0:
            try:
                value, end = decoder.raw_decode(chunk, at)
                if isinstance(value, dict):
                    return chunk[at:end]
            except ValueError:
                pass
            at = chunk.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def _slow_object(texts: pd.Series) -> pd.Series:
    return texts.map(_object_slice)


def _whole_object(text: Column) -> Column:
    """The text itself when it parses as a JSON object, else NULL."""
    looks = text.startswith("{") & text.endswith("}")
    return F.when(looks & F.is_variant_null(F.try_parse_json(text)).isNotNull(), text)


def extract_json(text: Column) -> Column:
    """JSON object inside a reply, as text; NULL when there is none.

    Replies that are one bare object, or whose first fence is one, stay in the JVM. Python sees the
    text of the remaining rows only (NULL for the others).
    """
    first_fence = F.trim(F.regexp_extract(text, _FENCE_SQL, 1))
    fast = F.when(text.contains("```"), _whole_object(first_fence)).otherwise(
        _whole_object(F.trim(text))
    )
    return F.coalesce(fast, _slow_object(F.when(fast.isNull() & text.contains("{"), text)))


def normalise_claim(text: Column) -> Column:
    """Trimmed move text without closing punctuation, zeros of castling turned into letters."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[.!?]+$", "")
    return F.replace(F.replace(bare, F.lit("0-0-0"), F.lit("O-O-O")), F.lit("0-0"), F.lit("O-O"))


def check_claim(text: Column, legal: Column) -> Column:
    """struct(move, reason): the claimed move when it is in the legal list, else a reason."""
    move = normalise_claim(text)
    ok = F.array_contains(legal, move)
    return F.struct(
        F.when((move != "") & ok, move).alias("move"),
        F.when(move == "", F.lit("empty move"))
        .when(~ok, F.lit("illegal in this position"))
        .otherwise(F.lit(""))
        .alias("reason"),
    )


def sections(text: Column) -> Column:
    """array<struct(title, body)> of the `## ` sections of a markdown text."""
    blocks = F.slice(F.split(text, r"(?m)^## "), 2, 1_000_000_000)
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.trim(F.regexp_extract(b, r"\A([^\n]*)", 1)).alias("title"),
            F.regexp_replace(b, r"\A[^\n]*\n?", "").alias("body"),
        ),
    )


def html_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def prompt_position(prompt: Column) -> Column:
    """The position named in the `FEN: ` line of a prompt."""
    found = F.regexp_extract(prompt, r"(?m)^FEN: (.+)$", 1)
    return F.when(found != "", found)
