"""Exhaustive dispatch over node kinds, as a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.core.document import KINDS

BLOCK_KINDS = frozenset(KINDS[: KINDS.index("Text")])
INLINE_KINDS = frozenset(KINDS) - BLOCK_KINDS


def visit(visitor: Mapping[str, Column] | Callable[[str], Column], kind: Column | None = None) -> Column:
    """The expression that a visitor has for each node's kind; a visitor that lacks a kind, or has an unknown one, is an error."""
    cases = {k: visitor(k) for k in KINDS} if callable(visitor) else dict(visitor)
    missing, unknown = set(KINDS) - set(cases), set(cases) - set(KINDS)
    if missing or unknown:
        raise ValueError(f"kinds without a case: {sorted(missing)}; unknown kinds: {sorted(unknown)}")
    kind = F.col("kind") if kind is None else kind
    out = None
    for name in KINDS:
        out = F.when(kind == name, cases[name]) if out is None else out.when(kind == name, cases[name])
    return out


def with_category(nodes: DataFrame) -> DataFrame:
    """The nodes with `category`, block or inline."""
    return nodes.withColumn("category", visit(lambda kind: F.lit("block" if kind in BLOCK_KINDS else "inline")))
