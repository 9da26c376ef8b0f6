"""Questions to the node relation, in DataFrame operations: traversal, resolution of labels, numbering, tables, checks.

Every view partitions by document, and none needs recursion: `pre` and `post` order entering and leaving, so that what
lies below a node is an interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.operators.parse import TEXT_KINDS


def walk(nodes: DataFrame) -> DataFrame:
    """(doc_id, event, node_id, kind, depth, ord): entering and leaving of every node, in order of `ord`."""
    both = F.explode(F.array(F.struct(F.lit("enter").alias("event"), F.col("pre").alias("ord")), F.struct(F.lit("exit").alias("event"), F.col("post").alias("ord"))))
    return nodes.select("doc_id", "node_id", "kind", "depth", both.alias("e")).select("doc_id", "e.event", "node_id", "kind", "depth", "e.ord")


def children(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, node_id, next_id): each child with its next sibling."""
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("ordinal")
    return nodes.where("parent_id is not null").select("doc_id", "parent_id", "node_id", F.lead("node_id").over(siblings).alias("next_id"))


def navigation(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, kind, first_child, next_sibling, parent_id) of every node."""
    first = nodes.where("ordinal = 0 and parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("first_child"))
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("ordinal")
    following = nodes.select("doc_id", "node_id", "kind", "parent_id", F.lead("node_id").over(siblings).alias("next_sibling"))
    return following.join(first, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "kind", "first_child", "next_sibling", "parent_id")


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of `wanted` (doc_id, node_id) and all below them, in one pass over each document in order.

    Wanted nodes that lie in each other give what they share once.
    """
    marked = nodes.join(wanted.select("doc_id", "node_id", F.lit(True).alias("_wanted")).distinct(), ["doc_id", "node_id"], "left")
    order = Window.partitionBy("doc_id").orderBy("pre")
    reach = F.max(F.when(F.col("_wanted"), F.col("post"))).over(order)
    return marked.withColumn("_reach", reach).where("post <= _reach").select(*nodes.columns)


def subtree_texts(nodes: DataFrame, kinds: list[str], text_kinds: tuple[str, ...] = TEXT_KINDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node_id, *keep, text): the visible text below each node of the given kinds, with columns of that node.

    Line ends are spaces. Such nodes must not lie inside each other. Texts find theirs by one pass over each document in
    order, not by a join: the last such node entered is the one they are in, if it has not been left.
    """
    is_top = F.col("kind").isin(kinds)
    piece = F.when(F.col("kind").isin("SoftBreak", "LineBreak"), F.lit(" ")).when(F.col("kind").isin(*text_kinds), F.col("literal"))
    order = Window.partitionBy("doc_id").orderBy("pre")
    top = F.last(F.when(is_top, F.struct("node_id", "post", *keep)), ignorenulls=True).over(order)
    placed = nodes.select("doc_id", "pre", "post", is_top.alias("is_top"), piece.alias("piece"), top.alias("top"))
    inside = placed.where("top is not null and post <= top.post and (is_top or piece is not null)")
    parts = F.array_sort(F.collect_list(F.struct("pre", F.coalesce("piece", F.lit("")).alias("piece"))))
    text = F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text")
    kept = [F.first(F.col("top")[name]).alias(name) for name in keep]
    return inside.groupBy("doc_id", F.col("top.node_id").alias("node_id")).agg(*kept, text).select("doc_id", "node_id", *keep, "text")


def outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, level, title): the headings of each document."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
    return subtree_texts(nodes, ["Heading"], keep=("level",)).select("doc_id", number.alias("ord"), "level", F.col("text").alias("title"))


def first_wins(definitions: DataFrame) -> DataFrame:
    """Of the definitions of each label in each document, the first."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "space", "norm_label").orderBy("ord"))
    return definitions.where("norm_label is not null").withColumn("n", rank).where("n = 1").drop("n")


def fold(label: Column) -> Column:
    """The comparable form of an ASCII label; other labels have theirs in norm_label, or need functions.fold_label."""
    return F.trim(F.regexp_replace(F.lower(label), r"[ \t\n\r]+", " "))


def resolved_links(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc_id, node_id, kind, label, destination, title): references with what their labels, folded by the parser, stand for."""
    refs = nodes.where("kind in ('LinkReference', 'ImageReference')").select("doc_id", "node_id", "kind", "label", "norm_label")
    found = first_wins(definitions.where("space = 'link'")).select("doc_id", "norm_label", "destination", "title")
    return refs.join(found, ["doc_id", "norm_label"], "left").select("doc_id", "node_id", "kind", "label", "destination", "title")


def footnote_numbers(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, label, number, use): notes numbered by first use, and each use of a note counted."""
    refs = nodes.where("kind = 'FootnoteReference'").select("doc_id", "node_id", "pre", "label", F.col("norm_label").alias("key"))
    of_key = Window.partitionBy("doc_id", "key")
    first = refs.withColumns({"first": F.min("pre").over(of_key), "use": F.row_number().over(of_key.orderBy("pre"))})
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))
    return first.select("doc_id", "node_id", "label", number.alias("number"), "use")


def in_tables(nodes: DataFrame) -> DataFrame:
    """The nodes with the table and the row that each is in or behind: table_id, alignments, row, is_header of the row."""
    order = Window.partitionBy("doc_id").orderBy("pre")
    table = F.last(F.when(F.col("kind") == "Table", F.struct("node_id", "alignments")), ignorenulls=True).over(order)
    row = F.last(F.when(F.col("kind") == "TableRow", F.struct("ordinal", "is_header")), ignorenulls=True).over(order)
    found = nodes.withColumns({"_table": table, "_row": row})
    return found.withColumns({"table_id": F.col("_table.node_id"), "alignments": F.col("_table.alignments"), "row": F.col("_row.ordinal"), "is_header": F.col("_row.is_header")})


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, column, is_header, alignment, text): every cell of every table."""
    cells = subtree_texts(in_tables(nodes), ["TableCell"], keep=("table_id", "row", "ordinal", "is_header", "alignments"))
    return cells.select("doc_id", "table_id", "row", F.col("ordinal").alias("column"), "is_header", F.col("alignments")[F.col("ordinal")].alias("alignment"), "text")


def code_blocks(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, language, info, literal, fenced, closed)."""
    return nodes.where("kind = 'CodeBlock'").select("doc_id", "node_id", "language", "info", "literal", "fenced", "closed")


def tasks(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, checked): items of task lists."""
    return nodes.where("kind = 'ListItem' and checked is not null").select("doc_id", "node_id", "checked")


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each node and those it is in; nodes come by document in order, so that a stack of the open ones is all that is held."""
    names = ["doc_id", "node_id", "ancestor_id", "distance"]
    document, open_, started = None, [], False
    for batch in batches:
        rows = []
        for doc_id, node, pre, post in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "node_id", "pre", "post")), strict=True):
            if not started or doc_id != document:
                document, open_, started = doc_id, [], True
            while open_ and open_[-1][1] < pre:
                open_.pop()
            rows += [(doc_id, node, above, distance) for distance, (above, _) in enumerate(reversed(open_), 1)]
            open_.append((node, post))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor_id, distance): one pass over each document in order, linear in the pairs it gives."""
    ordered = nodes.select("doc_id", "node_id", "pre", "post").repartition("doc_id").sortWithinPartitions("doc_id", "pre")
    return ordered.mapInArrow(_stacked, "doc_id long, node_id long, ancestor_id long, distance int")


#: What structure_faults reads of a node; `bare` is that it has no parent and is no document.
_PLACES = ("doc_id", "node_id", "parent_id", "pre", "post", "depth", "ordinal", "child_count")
FAULTS = ("no parent", "parent missing", "order", "depth", "child count", "ordinal")


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that come by document, cut where a document ends; rows without a document belong together with none."""
    held, document = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        documents, last = batch.column("doc_id"), batch.column("doc_id")[-1].as_py()
        cut = batch.num_rows if last is None else int(np.searchsorted(documents.fill_null(np.iinfo(np.int64).min).to_numpy(), last))
        if held and (cut or document != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        if cut < batch.num_rows:
            held.append(batch.slice(cut))
        document = last
    if held:
        yield pa.Table.from_batches(held)


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the rows of its document that have its parent's id, and against those that have it as a parent."""
    for rows in _by_document(batches):
        has = {c: rows[c].is_valid().to_numpy() for c in _PLACES}
        at = {c: rows[c].fill_null(0).to_numpy() for c in _PLACES}
        n, known = rows.num_rows, has["doc_id"]
        change = (at["doc_id"][1:] != at["doc_id"][:-1]) | ~known[1:] | ~known[:-1]
        ids, codes = np.unique(np.concatenate([at["node_id"], at["parent_id"]]), return_inverse=True)
        place = np.concatenate([[0], np.cumsum(change)]) * len(ids)
        own, up = place + codes[:n], place + codes[n:]
        is_child = known & has["parent_id"]
        below = np.sort(up[is_child])
        children = np.searchsorted(below, own, "right") - np.searchsorted(below, own)
        children[~(known & has["node_id"])] = 0
        tops = np.flatnonzero(is_child & has["ordinal"])
        tops = tops[np.lexsort((at["ordinal"][tops], up[tops]))]
        k = np.searchsorted(up[tops], own, "right") - 1
        has_top = (children > 0) & (k >= 0)
        has_top[has_top] = up[tops[k[has_top]]] == own[has_top]
        top = np.zeros(n, np.int64)
        top[has_top] = at["ordinal"][tops[k[has_top]]]

        parents = np.flatnonzero(known & has["node_id"])
        parents = parents[np.argsort(own[parents], kind="stable")]
        first = np.searchsorted(own[parents], up)
        times = np.where(is_child, np.searchsorted(own[parents], up, "right") - first, 0)
        row = np.repeat(np.arange(n), np.maximum(times, 1))  # once for each row with the parent's id
        found = times[row] > 0
        step = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(times, 1)) - np.maximum(times, 1), np.maximum(times, 1))
        above = np.zeros(len(row), np.int64)
        above[found] = parents[(first[row] + step)[found]]

        def both(c: str, d: str):
            return found & has[c][row] & has[d][above]

        mine, theirs = {c: v[row] for c, v in at.items()}, {c: at[c][above] for c in ("pre", "post", "depth")}
        order = has["pre"][row] & has["post"][row] & (mine["pre"] >= mine["post"])
        order |= both("pre", "pre") & (mine["pre"] <= theirs["pre"]) | both("post", "post") & (mine["post"] >= theirs["post"])
        counted = has["child_count"][row]
        broken = [
            rows["bare"].fill_null(False).to_numpy()[row],
            has["parent_id"][row] & ~found,
            order,
            both("depth", "depth") & (mine["depth"] != theirs["depth"] + 1),
            counted & (children[row] != mine["child_count"]),
            counted & has_top[row] & (top[row] + 1 != mine["child_count"]),
        ]
        bad = np.flatnonzero(np.logical_or.reduce(broken))
        names = np.array(FAULTS)[np.argmax([b[bad] for b in broken], axis=0)]
        key = [pa.array(mine[c][bad], pa.int64(), mask=~has[c][row][bad]) for c in ("doc_id", "node_id")]
        yield pa.RecordBatch.from_arrays([*key, pa.array(names, pa.string())], ["doc_id", "node_id", "fault"])


def structure_faults(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, fault): rows that break what holds of every tree; none, if the relation is whole.

    The relation is read once and shuffled by document; a task holds a batch and one document.
    """
    bare = (F.col("parent_id").isNull() & (F.col("kind") != "Document")).alias("bare")
    places = nodes.select(*(F.col(c).cast("long").alias(c) for c in _PLACES), bare)
    return places.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_faults, "doc_id long, node_id long, fault string")


def subtree(nodes: DataFrame, doc_id: int, node_id: int) -> DataFrame:
    """A node and all below it."""
    top = nodes.where((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id)).select(F.col("pre").alias("low"), F.col("post").alias("high"))
    return nodes.where(F.col("doc_id") == doc_id).join(F.broadcast(top), (F.col("pre") >= F.col("low")) & (F.col("post") <= F.col("high"))).drop("low", "high")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, kind, subtree_hash, side): subtrees that only one of two versions has, as often as they occur; needs hashes."""
    key = ["doc_id", "kind", "subtree_hash"]
    gone, new = before.select(*key).exceptAll(after.select(*key)), after.select(*key).exceptAll(before.select(*key))
    return gone.withColumn("side", F.lit("before")).unionByName(new.withColumn("side", F.lit("after")))
