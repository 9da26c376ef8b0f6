"""Append streams: each chain is a document that arrives in chunks.

`append_stream` keeps each chain's bytes and node identities in keyed state and emits, per trigger, the nodes of the chains
that grew. `append_batch` does the same for a table of all chunks. Both hold one chain in memory at a time; state is
written by Spark's state store, so a restarted query goes on where it was; with `idle_ms` a chain that has had no chunk for so
long is dropped. Chunks of a chain are taken in order of `seq`; one that is not later than the last taken is refused and
counted, as a writer with a stale revision would be. Chunks without chain_id or seq belong to no chain and are left out; a
null chunk is an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstrata.core import document as md
from inkstrata.core.append import Chain
from inkstrata.operators.parse import _batches

NODES = "chain_id long, seq long, doc_revision long, node_id long, last_changed_rev long, kind string, depth int, ord long"
RESULT = "chain_id long, chunks long, refused long, doc_revision long, bytes long, nodes long, ids_made long, whole boolean"


def _node_rows(chain_id: int, seq: int, chain: Chain, root) -> list[tuple]:
    rows, ids, k = [], chain.identities(), 0
    for node, depth, entering in root.walk():
        if entering:
            rows.append((chain_id, seq, chain.revision, *ids[k], node.kind, depth, k))
            k += 1
    return rows


def _grow(chain: Chain | None, chunks: Iterable[tuple], last: int | None, options: md.Options) -> tuple[Chain | None, int | None, int, object]:
    """Take (seq, chunk) by ascending seq; the chain, the last seq, how many were refused, and the last parse."""
    refused, parsed = 0, None
    for seq, chunk in chunks:
        if last is not None and seq <= last:
            refused += 1
            continue
        data = b"" if chunk is None else bytes(chunk)
        if chain is None:
            chain = Chain(b"", options)
        parsed, last = chain.append(data), int(seq)
    return chain, last, refused, parsed


def _stateful(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, options: md.Options, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    chain, last = pickle.loads(state.get[0]) if state.exists else (None, None)
    chunks = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")
    chain, last, _, parsed = _grow(chain, zip(chunks["seq"], chunks["chunk"], strict=True), last, options)
    if parsed is not None:
        state.update((pickle.dumps((chain, last)),))
        columns = [c.split()[0] for c in NODES.split(", ")]
        yield pd.DataFrame(_node_rows(int(key[0]), last, chain, parsed.root), columns=columns)


def _typed(chunks: DataFrame) -> DataFrame:
    typed = chunks.select(F.col("chain_id").cast("long"), F.col("seq").cast("long"), F.col("chunk").cast("binary"))
    return typed.where("chain_id is not null and seq is not null")


def append_stream(chunks: DataFrame, options: md.Options = md.PROFILES["default"], idle_ms: int | None = None) -> DataFrame:
    """Nodes of each chain that grew, from a stream of (chain_id, seq, chunk)."""
    run = partial(_stateful, options=options, idle_ms=idle_ms)
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return _typed(chunks).groupBy("chain_id").applyInPandasWithState(run, NODES, "state binary", "update", timeout)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(chain_id, its (seq, chunk) in order) from batches sorted by chain and seq."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("chain_id", "seq", "chunk")), strict=True))
    for chain_id, chunks in groupby(rows, key=itemgetter(0)):
        yield chain_id, [(seq, chunk) for _, seq, chunk in chunks]


def _by_chain(chunks: DataFrame) -> DataFrame:
    """The chunks with all of a chain in one task, in order: a task goes from chain to chain without a frame for each."""
    return _typed(chunks).repartition("chain_id").sortWithinPartitions("chain_id", "seq")


def _arrow(schema: str) -> tuple[list[pa.DataType], list[str]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    columns = [c.split() for c in schema.split(", ")]
    return [kinds[kind] for _, kind in columns], [name for name, _ in columns]


def _whole(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for chain_id, chunks in _chains(batches):
            chain, _, refused, parsed = _grow(None, chunks, None, options)
            same = md.same(parsed.root, md.parse(chain.data, options).root)
            yield chain_id, len(chunks) - refused, refused, chain.revision, len(chain.data), len(chain.identities()), chain.next_id - 1, same

    yield from _batches(rows(), *_arrow(RESULT))


def append_batch(chunks: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """What became of each chain of a table (chain_id, seq, chunk): its revisions, and whether its tree is that of all its bytes."""
    return _by_chain(chunks).mapInArrow(partial(_whole, options=options), RESULT)


def _last_nodes(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for chain_id, chunks in _chains(batches):
            chain, last, _, parsed = _grow(None, chunks, None, options)
            yield from _node_rows(chain_id, last, chain, parsed.root)

    yield from _batches(rows(), *_arrow(NODES))


def append_nodes(chunks: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """The nodes of each chain of a table (chain_id, seq, chunk) after its last chunk, with their ids and revisions."""
    return _by_chain(chunks).mapInArrow(partial(_last_nodes, options=options), NODES)
