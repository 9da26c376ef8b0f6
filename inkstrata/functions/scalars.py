"""Scalar functions of the grammar: native where Catalyst has the operation, Arrow batches where Unicode tables are needed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import MapType, StringType

from inkstrata.core import lexis as lx

_SPACE = " \t\n\r"


def trim(text: Column) -> Column:
    """Without leading and trailing space, tab and line ends (and no other white space)."""
    return F.btrim(text, F.lit(_SPACE))


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\r]+\z", "")


def normalize_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\r]+", " ")


def unescape_backslashes(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def unescape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("\\|"), F.lit("|"))


def normalize_code(text: Column) -> Column:
    """The literal of a code span from what stands between its ticks."""
    flat = F.regexp_replace(text, "\r\n|\r|\n", " ")
    padded = flat.rlike(r"\A (?s:.*) \z") & flat.rlike("[^ ]")
    return F.when(padded, F.substring(flat, F.lit(2), F.length(flat) - 2)).otherwise(flat)


def code_language(info: Column) -> Column:
    """The first word of a fence's info string; null if there is none."""
    return F.nullif(F.regexp_extract(info, r"[^ \t\n\r]+", 0), F.lit(""))


def is_comment(literal: Column) -> Column:
    """Whether an HTML literal is one complete comment."""
    body = F.regexp_replace(F.regexp_replace(literal, r"[\n \t]+\z", ""), r"\A +", "")
    close = F.locate("-->", body, 2)
    return body.startswith("<!--") & (close > 0) & (close + 2 == F.length(body))


def json_string(text: Column) -> Column:
    """A string as the canonical dump quotes it, for texts without control characters but \\n, \\r, \\t, \\b and \\f."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def count_newlines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n"))


def trim_link(url: Column) -> Column:
    """A bare link without closing punctuation, where no parentheses or entities are involved."""
    return F.regexp_replace(F.regexp_extract(url, r"\A[^<]*", 0), r"[?!.,:*_~'\"]+\z", "")


def _on_bytes(function):
    def apply(texts: pa.Array) -> pa.Array:
        out = [None if x is None else function(x.encode("utf-8", "surrogateescape")) for x in texts.to_pylist()]
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in out], pa.string())

    return apply


@arrow_udf(StringType())
def fold_label(labels: pa.Array) -> pa.Array:
    """The form in which labels are compared, by full case folding; null for a label that names nothing."""
    return _on_bytes(lx.fold_label)(labels)


@arrow_udf(StringType())
def decode_entities(texts: pa.Array) -> pa.Array:
    return _on_bytes(lx.decode_entities)(texts)


@arrow_udf(StringType())
def casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.casefold() for x in texts.to_pylist()], pa.string())


@arrow_udf(StringType())
def clean_url(texts: pa.Array) -> pa.Array:
    return _on_bytes(lx.clean_url)(texts)


@arrow_udf(StringType())
def clean_title(texts: pa.Array) -> pa.Array:
    return _on_bytes(lx.clean_title)(texts)


@arrow_udf(MapType(StringType(), StringType()))
def directive_attributes(texts: pa.Array) -> pa.Array:
    """The attributes in a directive's braces (without them); null if the block is rejected."""
    from inkstrata.core.attributes import attributes

    out = []
    for x in texts.to_pylist():
        found = None if x is None else attributes(x.encode())
        out.append(None if found is None else [(k.decode(), v.decode()) for k, v in found.items()])
    return pa.array(out, pa.map_(pa.string(), pa.string()))
