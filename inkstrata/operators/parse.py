"""Documents to relations: nodes, definitions, diagnostics and canonical dumps.

Parsing needs one document at a time and nothing of any other, so each relation is one `mapInArrow` over
(doc_id, content): no shuffle, and memory bounded by an Arrow batch and one document's tree. Literals travel as bytes
and become strings in the JVM, so that bytes which are not UTF-8 survive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.core import document as md
from inkstrata.core.lexis import fold_label
from inkstrata.core.tree import Block, Node

SCOPE = "struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>"
#: Columns that hold text, with the field each comes from.
TEXTS = ("info", "language", "literal", "name", "label", "norm_label", "destination", "source", "title", "reference")
NODE_SCHEMA = (
    "doc_id long, node_id long, parent_id long, kind string, depth int, ordinal int, child_count int, pre long, post long, "
    f"scope {SCOPE}, level int, flavor string, start long, tight boolean, checked boolean, mode string, info string, language string, "
    "fenced boolean, closed boolean, literal string, comment boolean, alignments array<string>, is_header boolean, name string, "
    "attributes map<string,string>, label string, norm_label string, destination string, source string, title string, form string, reference string, "
    "subtree_hash long"
)
_PLACE = pa.struct([("line", pa.int32()), ("column", pa.int32())])
_SCOPE = pa.struct([("start", _PLACE), ("end", _PLACE)])
_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "map<string,string>": pa.map_(pa.binary(), pa.binary()), SCOPE: _SCOPE,
}
ROWS = 20_000
#: Kinds with a label, whose comparable form is norm_label.
LABELLED = frozenset("ReferenceDefinition FootnoteDefinition LinkReference ImageReference FootnoteReference".split())
#: Kinds whose literal is text that a reader sees, and those that stand for a space.
TEXT_KINDS = ("Text", "Code", "Formula")
BREAKS = ("SoftBreak", "LineBreak")


def _columns(schema: str) -> list[tuple[str, str]]:
    out, depth, word = [], 0, ""
    for c in schema + ",":
        if c == "," and not depth:
            name, _, kind = word.strip().partition(" ")
            out.append((name, kind))
            word = ""
            continue
        depth += (c in "<(") - (c in ">)")
        word += c
    return out


#: Columns that only some kinds have, with the kinds of values in Arrow.
_OWN = {name: pa.binary() if name in TEXTS else _ARROW[kind] for name, kind in _columns(NODE_SCHEMA) if name not in (
    "doc_id", "node_id", "parent_id", "kind", "depth", "ordinal", "child_count", "pre", "post", "scope", "subtree_hash",
)}
_PLAIN_FIELDS = frozenset(_OWN) - {"attributes", "norm_label"}


def _digest(node: Node, below: list[bytes]) -> bytes:
    own = xxhash.xxh64(node.kind.encode())
    for name, value in md.shown_fields(node):
        own.update(name.encode() + b"\0" + value + b"\0")
    for child in below:
        own.update(child)
    return own.digest()


class _Rows:
    """Node rows as columns. Columns that few kinds have are kept as (row, value) until a batch is made."""

    def __init__(self, kinds: frozenset[str] | None, hashes: bool, columns: list[str]):
        self.kinds, self.hashes, self.columns = kinds, hashes, columns
        self.wanted = {name: kind for name, kind in _OWN.items() if name in columns}
        self.plain = _PLAIN_FIELDS & set(columns)
        self.clear()

    def clear(self) -> None:
        self.places: list[list] = []  # doc_id, node_id, parent_id, kind, depth, ordinal, children, pre, post, four of the scope, hash
        self.own: dict[str, list[tuple[int, object]]] = {name: [] for name in _OWN}  # those not asked for stay unread

    def add(self, doc_id: int | None, root: Node) -> None:
        """One row for each node in document order; numbers for entering and leaving order the whole tree."""
        stack: list[tuple[list, list[bytes]]] = []
        clock = number = 0
        for node, depth, entering in root.walk():
            if entering:
                above = stack[-1][0] if stack else None
                place = [doc_id, number, above[1] if above else None, node.kind, depth, above[6] if above else 0, 0, clock, 0, node.line, node.col, node.eline, node.ecol, None]
                if above:
                    above[6] += 1
                if self.kinds is None or node.kind in self.kinds:
                    self.describe(node, len(self.places))
                    self.places.append(place)
                stack.append((place, []))
                number += 1
            else:
                place, below = stack.pop()
                place[8] = clock
                if self.hashes:
                    digest = _digest(node, below)
                    place[13] = int.from_bytes(digest, "big", signed=True)
                    if stack:
                        stack[-1][1].append(digest)
            clock += 1

    def describe(self, node: Node, row: int) -> None:
        own, f, kind = self.own, node.fields, node.kind
        for name, value in f.items():
            if name in self.plain and value is not None:
                own[name].append((row, value))
        if kind in ("HTML", "HTMLBlock"):
            if "comment" not in f:
                own["comment"].append((row, md.lx.is_comment(f["literal"])))
        elif kind == "CodeBlock":
            own["mode"].append((row, "standalone"))
            own["language"].append((row, md.language_of(f["info"])))
        elif kind == "Code":
            own["mode"].append((row, "embedded"))
        elif kind in LABELLED:
            own["norm_label"].append((row, fold_label(f["label"].strip(md.lx.SPACES))))
        elif kind in ("Directive", "DirectiveBlock") and f["attributes"] is not None:
            own["attributes"].append((row, list(f["attributes"].items())))

    def batch(self) -> pa.RecordBatch:
        n = len(self.places)
        columns = list(zip(*self.places, strict=True)) if n else [()] * 14
        arrays = [pa.array(c, pa.string() if k == 3 else pa.int64() if k in (0, 1, 2, 7, 8, 13) else pa.int32()) for k, c in enumerate(columns)]
        ends = [pa.StructArray.from_arrays([arrays[k], arrays[k + 1]], ["line", "column"]) for k in (9, 11)]
        made = dict(zip(("doc_id", "node_id", "parent_id", "kind", "depth", "ordinal", "child_count", "pre", "post"), arrays[:9], strict=True))
        made |= {"scope": pa.StructArray.from_arrays(ends, ["start", "end"]), "subtree_hash": arrays[13]}
        for name, kind in self.wanted.items():
            dense: list = [None] * n
            for row, value in self.own[name]:
                dense[row] = value
            made[name] = pa.array(dense, kind) if self.own[name] else pa.nulls(n, kind)
        self.clear()
        return pa.RecordBatch.from_arrays([made[name] for name in self.columns], self.columns)


def _documents(batches: Iterator[pa.RecordBatch], options: md.Options, wanted: Callable[[Block], bool] | None = None) -> Iterator[tuple[int | None, md.Document]]:
    for batch in batches:
        for doc_id, content in zip(batch.column("doc_id"), batch.column("content"), strict=True):
            yield doc_id.as_py(), md.parse(content.as_py() or b"", options, wanted)


#: Columns that tell where a node stands among all nodes of its document.
_NUMBERS = frozenset(("node_id", "parent_id", "ordinal", "child_count", "pre", "post", "subtree_hash"))


def _parse(batches: Iterator[pa.RecordBatch], options: md.Options, kinds: frozenset[str] | None, hashes: bool, columns: list[str]) -> Iterator[pa.RecordBatch]:
    rows = _Rows(kinds, hashes, columns)
    wanted = None if kinds is None or _NUMBERS & set(columns) else md.may_hold(kinds)
    for doc_id, parsed in _documents(batches, options, wanted):
        rows.add(doc_id, parsed.root)
        if len(rows.places) >= ROWS:
            yield rows.batch()
    yield rows.batch()


def _content(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content"))


def nodes(
    docs: DataFrame, options: md.Options = md.PROFILES["default"], kinds: list[str] | None = None, hashes: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """One row for each node of each document (doc_id, content).

    With `kinds` only those kinds, with `columns` only those columns leave the parser; if no column counts nodes, blocks in which
    nothing can be of these kinds are left without inlines. With `hashes` subtree_hash is filled:
    equal for subtrees that show the same, wherever they stand.
    """
    asked = [(n, k) for n, k in _columns(NODE_SCHEMA) if columns is None or n in columns]
    raw = ", ".join(f"{n} {'binary' if n in TEXTS else 'map<binary,binary>' if n == 'attributes' else k}" for n, k in asked)
    names = [n for n, _ in asked]
    parsed = _content(docs).mapInArrow(partial(_parse, options=options, kinds=frozenset(kinds) if kinds else None, hashes=hashes, columns=names), raw)
    as_text = {n: F.col(n).cast("string") for n in TEXTS if n in names}
    if "attributes" in names:
        as_text["attributes"] = F.col("attributes").cast("map<string,string>")
    return parsed.withColumns(as_text)


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    columns = list(zip(*held, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def text_of(node: Node) -> bytes:
    """The visible text below a node; line ends are spaces."""
    return b"".join(b" " if x.kind in BREAKS else x.fields["literal"] if x.kind in TEXT_KINDS else b"" for x, _, entering in node.walk() if entering)


_SPACE_OF = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.binary()}


def _texts(batches: Iterator[pa.RecordBatch], options: md.Options, kinds: frozenset[str], keep: tuple[str, ...], numbers: bool) -> Iterator[pa.RecordBatch]:
    types = dict(_columns(NODE_SCHEMA))
    holds = md.may_hold(kinds)

    def shown(block: Block) -> bool:
        above = block
        while above is not None:
            if above.kind in kinds:
                return True
            above = above.parent
        return holds(block)

    def rows() -> Iterator[tuple]:
        for doc_id, parsed in _documents(batches, options, None if numbers else shown):
            number = 0
            for node, _, entering in parsed.root.walk():
                if entering:
                    if node.kind in kinds:
                        values = (node.fields.get(name) for name in keep)
                        yield (doc_id, number if numbers else None, node.kind.encode(), *(v.encode() if isinstance(v, str) else v for v in values), text_of(node))
                    number += 1

    names = ["doc_id", "node_id", "kind", *keep, "text"]
    yield from _batches(rows(), [pa.int64(), pa.int64(), pa.binary(), *(_SPACE_OF[types[k]] for k in keep), pa.binary()], names)


def texts(docs: DataFrame, kinds: list[str], options: md.Options = md.PROFILES["default"], keep: tuple[str, ...] = (), numbers: bool = True) -> DataFrame:
    """(doc_id, node_id, kind, *keep, text): the visible text below each node of the given kinds, with fields of that node.

    Text comes from the tree itself, so such nodes may lie inside each other and nothing is shuffled. Without `numbers` node_id
    is left out, and blocks that neither are, lie in nor can hold such nodes are left without inlines.
    """
    types = dict(_columns(NODE_SCHEMA))
    strings = ["kind", *(k for k in keep if types[k] == "string"), "text"]
    raw = ", ".join(f"{n} {'binary' if n in strings else types.get(n, 'long')}" for n in ("doc_id", "node_id", "kind", *keep, "text"))
    found = _content(docs).mapInArrow(partial(_texts, options=options, kinds=frozenset(kinds), keep=keep, numbers=numbers), raw)
    return (found if numbers else found.drop("node_id")).withColumns({n: F.col(n).cast("string") for n in strings})


def outline(docs: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, ord, level, title): the headings of each document; one task holds one document, so nothing is shuffled."""
    headings = texts(docs, ["Heading"], options, keep=("level",))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
    return headings.select("doc_id", order.alias("ord"), "level", F.col("text").alias("title"))


def _cells(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, parsed in _documents(batches, options):
            number, table, alignments, row = -1, 0, (), -1
            is_header, column = False, 0
            for node, _, entering in parsed.root.walk():
                number += entering
                if not entering:
                    continue
                if node.kind == "Table":
                    table, alignments, row = number, node.fields["alignments"], -1
                elif node.kind == "TableRow":
                    row, is_header, column = row + 1, node.fields["is_header"], 0
                elif node.kind == "TableCell":
                    yield doc_id, table, row, column, is_header, alignments[column], text_of(node)
                    column += 1

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
    yield from _batches(rows(), kinds, ["doc_id", "table_id", "row", "column", "is_header", "alignment", "text"])


def table_cells(docs: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, table_id, row, column, is_header, alignment, text): every cell of every table, as the tree holds them."""
    schema = "doc_id long, table_id long, row int, column int, is_header boolean, alignment string, text binary"
    return _content(docs).mapInArrow(partial(_cells, options=options), schema).withColumn("text", F.col("text").cast("string"))


def _cell_places(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, parsed in _documents(batches, options, lambda block: False):
            alignments, row, is_header, column = (), -1, False, 0
            for node, _, entering in parsed.root.walk():
                if not entering:
                    continue
                if node.kind == "TableCell":
                    yield doc_id, row, column, is_header, alignments[column]
                    column += 1
                elif node.kind == "TableRow":
                    row, is_header, column = row + 1, node.fields["is_header"], 0
                elif node.kind == "Table":
                    alignments, row = node.fields["alignments"], -1

    yield from _batches(rows(), [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()], ["doc_id", "row", "column", "is_header", "alignment"])


def cell_places(docs: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, row, column, is_header, alignment) of every cell of every table, from the blocks alone."""
    return _content(docs).mapInArrow(partial(_cell_places, options=options), "doc_id long, row int, column int, is_header boolean, alignment string")


def _footnote_numbers(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, parsed in _documents(batches, options, md.may_hold(["FootnoteReference"])):
            uses: dict[bytes | None, list[int]] = {}  # of each label, in order of first use: its number, and its uses so far
            for node, _, entering in parsed.root.walk():
                if entering and node.kind == "FootnoteReference":
                    label = node.fields["label"]
                    found = uses.setdefault(fold_label(label.strip(md.lx.SPACES)), [len(uses) + 1, 0])
                    found[1] += 1
                    yield doc_id, label, *found

    yield from _batches(rows(), [pa.int64(), pa.binary(), pa.int32(), pa.int32()], ["doc_id", "label", "number", "use"])


def footnote_numbers(docs: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, label, number, use): notes numbered by first use and each use of a note counted, in the tree of each document."""
    found = _content(docs).mapInArrow(partial(_footnote_numbers, options=options), "doc_id long, label binary, number int, use int")
    return found.withColumn("label", F.col("label").cast("string"))


def _definitions(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "space", "norm_label", "ord", "label", "destination", "title")
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    rows = []
    for doc_id, parsed in _documents(batches, options):
        for order, (node, _, entering) in enumerate(parsed.root.walk()):
            if entering and node.kind in ("ReferenceDefinition", "FootnoteDefinition"):
                f = node.fields
                space = "link" if node.kind == "ReferenceDefinition" else "footnote"
                rows.append((doc_id, space, fold_label(f["label"].strip(md.lx.SPACES)), order, f["label"], f.get("destination"), f.get("title")))
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def definitions(docs: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, space, norm_label, ord, label, destination, title) of every definition, in document order."""
    raw = "doc_id long, space string, norm_label binary, ord long, label binary, destination binary, title binary"
    found = _content(docs).mapInArrow(partial(_definitions, options=options), raw)
    return found.withColumns({n: F.col(n).cast("string") for n in ("norm_label", "label", "destination", "title")})


def _diagnostics(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    rows = [
        {"doc_id": doc_id, "ord": k, "code": "directive_attributes", "scope": {"start": {"line": a, "column": b}, "end": {"line": c, "column": d}}}
        for doc_id, parsed in _documents(batches, options, md.may_hold(["Directive"]))
        for k, (a, b, c, d) in enumerate(parsed.diagnostics)
    ]
    kinds = (pa.int64(), pa.int64(), pa.string(), _SCOPE)
    names = ("doc_id", "ord", "code", "scope")
    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], list(names))


def diagnostics(docs: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, ord, code, scope): rejected attribute blocks, in source order."""
    return _content(docs).mapInArrow(partial(_diagnostics, options=options), f"doc_id long, ord long, code string, scope {SCOPE}")


def _dumps(batches: Iterator[pa.RecordBatch], options: md.Options) -> Iterator[pa.RecordBatch]:
    ids, texts = [], []
    for doc_id, parsed in _documents(batches, options):
        ids.append(doc_id)
        texts.append(md.dump(parsed.root))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "dump"])


def dumps(docs: DataFrame, options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, dump): the canonical text of each document's tree."""
    return _content(docs).mapInArrow(partial(_dumps, options=options), "doc_id long, dump binary").withColumn("dump", F.col("dump").cast("string"))


def _subtree_dumps(batches: Iterator[pa.RecordBatch], options: md.Options, kinds: frozenset[str]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc_id, parsed in _documents(batches, options):
            number = -1
            for node, _, entering in parsed.root.walk():
                number += entering
                if entering and node.kind in kinds:
                    yield doc_id, number, md.dump(node)

    yield from _batches(rows(), [pa.int64(), pa.int64(), pa.binary()], ["doc_id", "node_id", "dump"])


def subtree_dumps(docs: DataFrame, kinds: list[str], options: md.Options = md.PROFILES["default"]) -> DataFrame:
    """(doc_id, node_id, dump): the canonical text of the subtrees of the given kinds, whose first lines are line 1."""
    found = _content(docs).mapInArrow(partial(_subtree_dumps, options=options, kinds=frozenset(kinds)), "doc_id long, node_id long, dump binary")
    return found.withColumn("dump", F.col("dump").cast("string"))
