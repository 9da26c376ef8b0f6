"""What is not asked for is not parsed, and what is asked for is the same."""

import random

import pyarrow as pa
import pytest

from inkstrata.core import document as md
from inkstrata.operators import parse as p
from inkstrata.operators import views

PIECES = [
    "word", "\n\n", "\n", "[a]", "[a]: /u\n", "# h ", "- x", "> ", "| a | b |\n", "|--|:-:|\n", "*e*", "__s__", "`c`", "```\nq\n```\n", "$x$", "$$x$$", "$$\n", "::d{a=1}", ":::b[l *m*]\n", ":::\n",
    "[^n]", "\n\n[^n]: t `u`", "a@b.co", "https://x.yz", "<div>", "<b>", "===\n", "--", "~~s~~", "[[c]]", "![[e]]", "![i](/s)", "[l](/d 't')", "&amp;", "&#94;", ":badge[x]{k=v}", ":d{bad=}", "www.a.b", "- [x] t\n", "\\\\[z\\\\]", "<m@n.op>", "[&#94;n]",
]
DOCS = [b"[^n] and $x$\n\n$$y$$\n\n[&#94;n] x\n\n[^n]: t\n"]
_rng = random.Random(11)
DOCS += ["".join(_rng.choice(PIECES) for _ in range(_rng.randrange(1, 25))).encode() for _ in range(800)]
BATCH = pa.RecordBatch.from_arrays([pa.array(range(len(DOCS))), pa.array(DOCS)], ["doc_id", "content"])
PLACES = frozenset(p._NUMBERS) | {"norm_label"}
ALL = [n for n, _ in p._columns(p.NODE_SCHEMA)]


def rows(batches):
    return [r for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("profile", sorted(md.PROFILES))
def test_nodes_of_each_kind(profile):
    options, columns = md.PROFILES[profile], [c for c in ALL if c not in PLACES]
    every = rows(p._parse(iter([BATCH]), options, None, False, ALL))
    for kind in md.KINDS:
        got = rows(p._parse(iter([BATCH]), options, frozenset([kind]), False, columns))
        assert got == [{c: r[c] for c in columns} for r in every if r["kind"] == kind], kind
    kinds = frozenset(["Code", "Formula", "FormulaBlock", "HTMLBlock"])
    assert rows(p._parse(iter([BATCH]), options, kinds, False, columns)) == [{c: r[c] for c in columns} for r in every if r["kind"] in kinds]


@pytest.mark.parametrize("kinds", [["FootnoteDefinition"], ["Strong", "BlockQuote", "DirectiveLabel"], ["Link"], ["Heading"]])
def test_texts_without_numbers(kinds):
    options = md.PROFILES["default"]
    with_, without = (rows(p._texts(iter([BATCH]), options, frozenset(kinds), (), numbers)) for numbers in (True, False))
    assert [r | {"node_id": None} for r in with_] == without and with_


def test_diagnostics_and_cells():
    options = md.PROFILES["default"]
    wanted = [(k, *x) for k, text in enumerate(DOCS) for x in md.parse(text).diagnostics]
    place = lambda s: (s["start"]["line"], s["start"]["column"], s["end"]["line"], s["end"]["column"])
    assert [(r["doc_id"], *place(r["scope"])) for r in rows(p._diagnostics(iter([BATCH]), options))] == wanted and wanted
    names = ["doc_id", "row", "column", "is_header", "alignment"]
    cells = rows(p._cells(iter([BATCH]), options))
    assert rows(p._cell_places(iter([BATCH]), options)) == [{n: r[n] for n in names} for r in cells] and cells


def test_footnote_numbers_are_those_of_the_view(spark):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(DOCS)], "doc_id long, content binary")
    got = p.footnote_numbers(docs).collect()
    wanted = views.footnote_numbers(p.nodes(docs)).drop("node_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and got


def test_blocks_that_hold_nothing_wanted_are_not_scanned(monkeypatch):
    runs = []
    monkeypatch.setattr(md, "Scanner", lambda *a: runs.append(1) or pytest.fail("a block was scanned"))
    text = b"a *b* [c](/d)\n\n| *x* | `y` |\n|--|--|\n| 1 | *2* |\n\n```q\nw\n```\n"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "content"])
    options = md.PROFILES["default"]
    assert len(rows(p._parse(iter([batch]), options, frozenset(["CodeBlock"]), False, ["language"]))) == 1
    assert len(rows(p._cell_places(iter([batch]), options))) == 4
    assert rows(p._diagnostics(iter([batch]), options)) == rows(p._footnote_numbers(iter([batch[:0]]), options)) == []


def test_bytes_that_begin_nothing_alone_are_text():
    special = md.Context(md.PROFILES["default"], set(), set(), None).special.search
    assert not special(b"5-LOW with two words. And more..") and special(b"a--b") and special(b"a...b") and special(b"a www.b")
