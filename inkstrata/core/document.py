"""Parsing of whole documents, and the canonical text form of their trees."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from inkstrata.core import lexis as lx
from inkstrata.core.blocks import Machine
from inkstrata.core.inlines import Context, Scanner, join_texts, link_mails
from inkstrata.core.tree import Block, Node


@dataclass(frozen=True)
class Options:
    """The syntax that is on; by default all of it."""

    smart_punctuation: bool = True
    footnotes: bool = True
    tables: bool = True
    strikethrough: bool = True
    autolinks: bool = True
    task_lists: bool = True
    formulas: bool = True
    directives: bool = True
    cross_links: bool = True
    embeds: bool = True

    @classmethod
    def none(cls, **on: bool) -> Options:
        return cls(**({f.name: False for f in fields(cls)} | on))


#: The named sets of options.
PROFILES = {
    "default": Options(),
    "gfm": Options.none(footnotes=True, tables=True, strikethrough=True, autolinks=True, task_lists=True),
    "gfm-smart": Options.none(smart_punctuation=True, footnotes=True, tables=True, strikethrough=True, autolinks=True, task_lists=True),
    "gfm-extended": Options(smart_punctuation=False),
    "commonmark": Options.none(),
}

KINDS = (
    "Document BlockQuote Paragraph Heading ThematicBreak List ListItem CodeBlock HTMLBlock FormulaBlock Table TableRow TableCell "
    "DirectiveBlock DirectiveLabel FootnoteDefinition ReferenceDefinition Text SoftBreak LineBreak Code HTML Formula Emphasis Strong "
    "Strikethrough Link Image LinkReference ImageReference Directive FootnoteReference CrossLink Embed"
).split()
UNITS = frozenset(("Paragraph", "Heading", "TableCell", "DirectiveLabel"))

_LINES = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")


def split_lines(data: bytes) -> list[bytes]:
    """Lines with their ends; NUL becomes the replacement character, and nothing else is touched."""
    return _LINES.findall(data.replace(b"\0", b"\xef\xbf\xbd") if b"\0" in data else data)


class Document:
    """A parsed document: its tree, its diagnostics, and the labels it defines.

    Inlines are parsed only of blocks that `wanted` is true of, by default of all.
    """

    def __init__(self, data: bytes, options: Options = PROFILES["default"], wanted: Callable[[Block], bool] | None = None):
        machine = Machine(options)
        for line in split_lines(data):
            machine.feed(line)
        self.root: Node = machine.finish()
        self.links, self.notes = machine.links, machine.notes
        self.diagnostics = machine.diagnostics
        context = Context(options, self.links, self.notes, lambda *scope: self.diagnostics.append(scope))
        for block in [node for node, _, entering in self.root.walk() if entering and isinstance(node, Block)]:
            _refine(block, context, wanted is None or wanted(block))
        self.diagnostics.sort()


def _refine(block: Block, context: Context, inlines: bool = True) -> None:
    """Parse a block's inlines if it owns any, and make its last changes of kind."""
    options = context.options
    if inlines and block.kind in UNITS:
        data, offset = bytes(block.content).rstrip(lx.SPACES), block.col - 1 + block.inline_offset
        if data and not context.special.search(data):  # nothing but text
            block.append(Node("Text", block.line, offset + 1, block.line, offset + len(data), literal=data))
        elif data:
            Scanner(block, data, block.line, offset, context).run()
            join_texts(block)
        if options.autolinks and b"@" in data:
            link_mails(block)
    if block.kind == "HTMLBlock":
        block.fields["comment"] = lx.is_comment(block.fields["literal"])
    if not options.formulas:
        return
    if block.kind == "FormulaBlock":
        block.fields["literal"] = bytes(block.content).strip(lx.SPACES)
    elif block.kind == "CodeBlock" and block.fields["info"] == b"formula":
        _promote(block, block.fields["literal"].strip(lx.SPACES))
    elif block.kind == "Paragraph" and block.first is not None and block.first is block.last and block.first.kind == "Formula" and block.first.fields["mode"] == "standalone":
        formula = block.first.detach()
        _promote(block, formula.fields["literal"])


def _promote(block: Block, literal: bytes) -> None:
    block.kind, block.fields = "FormulaBlock", {"mode": "standalone", "literal": literal}


def parse(data: bytes, options: Options = PROFILES["default"], wanted: Callable[[Block], bool] | None = None) -> Document:
    return Document(data, options, wanted)


#: Bytes one of which a unit must have for an inline of a kind to come of it, or for the kind of the unit to change.
_SIGNS: dict[str, tuple[bytes, ...]] = {
    "Code": (b"`",), "HTML": (b"<",), "Formula": (b"$", b"\\"), "FormulaBlock": (b"$", b"\\"), "Paragraph": (b"$", b"\\"), "Emphasis": (b"*", b"_"), "Strong": (b"*", b"_"),
    "Strikethrough": (b"~",), "Link": (b"[", b"<", b"@", b"www.", b"://"), "Image": (b"[",), "LinkReference": (b"[",), "ImageReference": (b"[",),
    "Directive": (b":",), "DirectiveLabel": (b":",), "FootnoteReference": (b"[",), "CrossLink": (b"[[",), "Embed": (b"[[",), "Text": (b"",), "SoftBreak": (b"",), "LineBreak": (b"",),
}


def may_hold(kinds: Iterable[str]) -> Callable[[Block], bool]:
    """Whether the inlines of a block may have, or may make of it, nodes of these kinds."""
    signs = sorted({re.escape(sign) for kind in kinds for sign in _SIGNS.get(kind, ())})
    if not signs:
        return lambda block: False
    found = re.compile(b"|".join(signs)).search
    return lambda block: found(block.content) is not None


# -- the canonical text form ------------------------------------------------------------------------------------------------

_ESCAPES = {0x22: b'\\"', 0x5C: b"\\\\", 0x08: b"\\b", 0x0C: b"\\f", 0x0A: b"\\n", 0x0D: b"\\r", 0x09: b"\\t"}
_ESCAPED = re.compile(rb'["\\\x00-\x1f]')


def quoted(value: bytes | None) -> bytes:
    if value is None:
        return b"null"
    return b'"' + _ESCAPED.sub(lambda m: _ESCAPES.get(m[0][0]) or b"\\u00%02x" % m[0][0], value) + b'"'


def _flag(value: bool | None) -> bytes:
    return b"null" if value is None else b"true" if value else b"false"


def language_of(info: bytes | None) -> bytes | None:
    words = re.split(rb"[ \t\n\r]+", (info or b"").strip(lx.SPACES), maxsplit=1)
    return words[0] or None


def _attributes(found: dict[bytes, bytes] | None) -> bytes:
    return b"null" if found is None else b"[" + b" ".join(k + b"=" + quoted(v) for k, v in sorted(found.items())) + b"]"


def shown_fields(node: Node) -> list[tuple[str, bytes]]:
    """The fields of a node in the order in which its kind shows them."""
    f, kind = node.fields, node.kind
    if kind == "Heading":
        return [("level", b"%d" % f["level"])]
    if kind == "List":
        return [("flavor", f["flavor"].encode()), ("start", b"null" if f["start"] is None else b"%d" % f["start"]), ("tight", _flag(f["tight"]))]
    if kind == "ListItem":
        return [("checked", _flag(f["checked"]))]
    if kind == "CodeBlock":
        shown = [("mode", b"standalone"), ("info", quoted(f["info"])), ("language", quoted(language_of(f["info"])))]
        return [*shown, ("literal", quoted(f["literal"])), ("fenced", _flag(f["fenced"])), ("closed", _flag(f["closed"]))]
    if kind in ("HTMLBlock", "HTML"):
        return [("comment", _flag(lx.is_comment(f["literal"]))), ("literal", quoted(f["literal"]))]
    if kind in ("FormulaBlock", "Formula"):
        return [("mode", f["mode"].encode()), ("literal", quoted(f["literal"]))]
    if kind == "Code":
        return [("mode", b"embedded"), ("literal", quoted(f["literal"]))]
    if kind == "Text":
        return [("literal", quoted(f["literal"]))]
    if kind == "Table":
        return [("alignments", b"[" + ",".join(f["alignments"]).encode() + b"]")]
    if kind == "TableRow":
        return [("isHeader", _flag(f["is_header"]))]
    if kind in ("DirectiveBlock", "Directive"):
        return [("mode", f["mode"].encode()), ("name", quoted(f["name"])), ("attributes", _attributes(f["attributes"]))]
    if kind in ("FootnoteDefinition", "FootnoteReference"):
        return [("id", quoted(f["label"]))]
    if kind == "ReferenceDefinition":
        return [("label", quoted(f["label"])), ("destination", quoted(f["destination"])), ("title", quoted(f["title"]))]
    if kind in ("LinkReference", "ImageReference"):
        return [("label", quoted(f["label"])), ("form", f["form"].encode())]
    if kind == "Link":
        return [("destination", quoted(f["destination"])), ("title", quoted(f["title"]))]
    if kind == "Image":
        return [("source", quoted(f["source"])), ("title", quoted(f["title"]))]
    if kind in ("CrossLink", "Embed"):
        return [("reference", quoted(f["reference"]))]
    return []


def node_line(node: Node, shift: int = 0) -> bytes:
    """The line of one node, without what shows its place; `shift` is taken off line numbers that are not 0."""
    lines = [x - shift if x else 0 for x in (node.line, node.eline)]
    parts = [b"%s scope=%d:%d..%d:%d" % (node.kind.encode(), lines[0], node.col, lines[1], node.ecol)]
    parts += [name.encode() + b"=" + value for name, value in shown_fields(node)]
    children = sum(1 for _ in node)
    return b" ".join([*parts, b"children=%d" % children])


def dump(root: Node) -> bytes:
    """The canonical text of a tree: a line for each node. The first line of a subtree is line 1."""
    shift = max(0, root.line - 1) if root.kind != "Document" else 0
    out, bars = [], []
    for node, depth, entering in root.walk():
        if not entering:
            continue
        if depth:
            del bars[depth - 1 :]
            last = node.next is None
            out.append(b"".join(bars) + ("└── " if last else "├── ").encode() + node_line(node, shift))
            bars.append(b"    " if last else "│   ".encode())
        else:
            out.append(node_line(node, shift))
    return b"\n".join(out) + b"\n"


def same(a: Node, b: Node) -> bool:
    """Whether two documents have the same canonical text, without writing it."""
    for (x, depth, entering), (y, other, enters) in zip(a.walk(), b.walk(), strict=False):
        if depth != other or entering != enters or x.kind != y.kind:
            return False
        if entering and (x.line != y.line or x.col != y.col or x.eline != y.eline or x.ecol != y.ecol or (x.fields != y.fields and shown_fields(x) != shown_fields(y))):
            return False
    return True
