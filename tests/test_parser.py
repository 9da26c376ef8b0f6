import html.entities
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.core import lexis
from inkstrata.core.attributes import attributes
from inkstrata.core.document import KINDS, PROFILES, Options, dump, parse

OFF = PROFILES["commonmark"]


def shown(text, options=PROFILES["default"]):
    """The tree without scopes and child counts, indented."""
    out = []
    for node, depth, entering in parse(text.encode(), options).root.walk():
        if entering and depth:
            f = node.fields
            said = f.get("literal") or f.get("destination") or f.get("source") or f.get("label") or f.get("reference") or f.get("name") or b""
            out.append("  " * (depth - 1) + node.kind + (f" {said.decode()!r}" if said else ""))
    return "\n".join(out)


def tree(*lines):
    return "\n".join(lines)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Title\n===\n\n# One #\n## Two##\n", tree("Heading", "  Text 'Title'", "Heading", "  Text 'One'", "Heading", "  Text 'Two##'")),
        ("> a\nlazy\n\n> b\n", tree("BlockQuote", "  Paragraph", "    Text 'a'", "    SoftBreak", "    Text 'lazy'", "BlockQuote", "  Paragraph", "    Text 'b'")),
        ("1) a\n2) b\n3. c\n", tree("List", "  ListItem", "    Paragraph", "      Text 'a'", "  ListItem", "    Paragraph", "      Text 'b'", "List", "  ListItem", "    Paragraph", "      Text 'c'")),
        ("    code\n\n    more\n", "CodeBlock 'code\\n\\nmore\\n'"),
        ("a  \nb\\\nc", tree("Paragraph", "  Text 'a'", "  LineBreak", "  Text 'b'", "  LineBreak", "  Text 'c'")),
        ("**a *b* c**", tree("Paragraph", "  Strong", "    Text 'a '", "    Emphasis", "      Text 'b'", "    Text ' c'")),
        ("snake_case_word _em_", tree("Paragraph", "  Text 'snake_case_word '", "  Emphasis", "    Text 'em'")),
        ("[a [b](/in) c](/out)", tree("Paragraph", "  Text '[a '", "  Link '/in'", "    Text 'b'", "  Text ' c](/out)'")),
        ("[x]\n\n[X]: </u v> (t)\n", tree("Paragraph", "  LinkReference 'x'", "    Text 'x'", "ReferenceDefinition '/u v'")),
        ("[^a] [^b]\n\n[^a]: note\n", tree("Paragraph", "  FootnoteReference 'a'", "  Text ' [^b]'", "FootnoteDefinition 'a'", "  Paragraph", "    Text 'note'")),
        ("| a | b |\n|---|:-:|\n| 1 | \\| |\n| x |\n\nend", tree("Table", "  TableRow", "    TableCell", "      Text 'a'", "    TableCell", "      Text 'b'", "  TableRow", "    TableCell", "      Text '1'", "    TableCell", "      Text '|'", "  TableRow", "    TableCell", "      Text 'x'", "    TableCell", "Paragraph", "  Text 'end'")),
        ("www.a.com/b. see https://x.y(z) a@b.co", tree("Paragraph", "  Link 'http://www.a.com/b'", "    Text 'www.a.com/b'", "  Text '. see '", "  Link 'https://x.y(z)'", "    Text 'https://x.y(z)'", "  Text ' '", "  Link 'mailto:a@b.co'", "    Text 'a@b.co'", "  Text")),
        ("\"q\" 'r' it's -- --- ...", tree("Paragraph", "  Text '“q” ‘r’ it’s – — …'")),
        ("$a$ and $5 and 6 $7 \\\\(b\\\\)", tree("Paragraph", "  Formula 'a'", "  Text ' and $5 and 6 $7 '", "  Formula 'b'")),
        ("$$\nx\n$$\n", "FormulaBlock 'x'"),
        (":::note[T]{#i .c}\nbody\n:::\nafter", tree("DirectiveBlock 'note'", "  DirectiveLabel", "    Text 'T'", "  Paragraph", "    Text 'body'", "Paragraph", "  Text 'after'")),
        (":a[b [[c]] d]{k=v}", tree("Paragraph", "  Directive 'a'", "    DirectiveLabel", "      Text 'b '", "      CrossLink 'c'", "      Text ' d'")),
        ("<!-- c --> x\n", "HTMLBlock '<!-- c --> x\\n'"),
        ("a <b c='d'> &amp; &#65; &nope;", tree("Paragraph", "  Text 'a '", "  HTML \"<b c='d'>\"", "  Text ' & A &nope;'")),
        ("`` a ` b `` `c", tree("Paragraph", "  Code 'a ` b'", "  Text ' `c'")),
    ],
)
def test_trees(text, expected):
    assert shown(text) == expected


def test_gates_leave_plain_text():
    text = "a ~~b~~ www.c.d $e$ :f [[g]] ![[h]] \"i\" [^j]\n\n[^j]: k\n"
    assert {n.kind for n, _, e in parse(text.encode(), OFF).root.walk() if e} <= {"Document", "Paragraph", "Text", "ReferenceDefinition", "LinkReference"}
    on = {n.kind for n, _, e in parse(text.encode()).root.walk() if e}
    assert {"Strikethrough", "Link", "Formula", "Directive", "CrossLink", "Embed", "FootnoteReference", "FootnoteDefinition"} <= on
    assert "Strikethrough" in {n.kind for n, _, e in parse(b"~a~", Options.none(strikethrough=True)).root.walk() if e}


def test_dump_form():
    text = "# A\n\n- [x] *b* `c`\n\n  d\n"
    assert dump(parse(text.encode()).root).decode() == (
        "Document scope=1:1..5:3 children=2\n"
        "├── Heading scope=1:1..1:3 level=1 children=1\n"
        '│   └── Text scope=1:3..1:3 literal="A" children=0\n'
        "└── List scope=3:1..5:3 flavor=bullet start=null tight=false children=1\n"
        "    └── ListItem scope=3:1..5:3 checked=true children=2\n"
        "        ├── Paragraph scope=3:7..3:13 children=3\n"
        "        │   ├── Emphasis scope=3:7..3:9 children=1\n"
        '        │   │   └── Text scope=3:8..3:8 literal="b" children=0\n'
        '        │   ├── Text scope=3:10..3:10 literal=" " children=0\n'
        '        │   └── Code scope=3:12..3:12 mode=embedded literal="c" children=0\n'
        "        └── Paragraph scope=5:3..5:3 children=1\n"
        '            └── Text scope=5:3..5:3 literal="d" children=0\n'
    )
    item = parse(text.encode()).root.last.first
    assert dump(item).startswith(b"ListItem scope=1:1..3:3 checked=true children=2\n")


def test_bytes_are_kept():
    literal = parse(b"a\xff\x00b").root.first.first.fields["literal"]
    assert literal == b"a\xff\xef\xbf\xbdb"
    assert dump(parse(b"\xef\xbb\xbf# x\r\ny\rz").root).count(b"\n") == 7


def test_every_named_entity():
    for name, value in html.entities.html5.items():
        if name.endswith(";"):
            assert lexis.decode_entities(b"&" + name.encode()) == value.encode()
    assert lexis.decode_entities(b"&#0;&#xD800;&#x110000;&#123456789;&#;&x;") == "���&#123456789;&#;&x;".encode()


def test_labels_fold():
    assert lexis.fold_label("  ẞ\t \nStraße ".encode()) == "ss strasse".encode()
    assert lexis.fold_label(b" \n") is None and lexis.fold_label(b"x" * 1001) is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (b"", {}),
        (b'a=1 b="x y" c', {b"a": b"1", b"b": b"x y", b"c": b""}),
        (b".x .y #i class=z", {b"class": b"x y z", b"id": b"i"}),
        (b"a=1 b=2 a=3", {b"a": b"3", b"b": b"2"}),
        (b"a=", None),
        (b"a=<", None),
        (b"#", None),
        (b"=x", None),
        (b'a="x"y', None),
    ],
)
def test_attributes(text, expected):
    got = attributes(text)
    assert got == expected and (got is None or list(got) == list(expected))


def test_rejected_attributes_are_told():
    assert parse(b"::leaf{a=}\n\nx :y{=} z").diagnostics == [(1, 7, 1, 10), (3, 5, 3, 5)]


PIECES = ["a", "b ", " ", "\n", "\n\n", "*", "**", "_", "`", "``", "[", "]", "](", ")", "![", "[[", "]]", "<", ">", "&amp;", "\\", "$", "$$", ":x", ":::x\n", ":::\n", "{k=v}", "~", "~~", "- ", "1. ", "# ", "> ", "| a | b |\n", "|-|-|\n", "    ", "\t", "```\n", "www.x.y", "a@b.c", '"', "'", "[^n]", "[^n]: ", "[a]: /u\n", "<b>", "<!-- ", "-->", "é", "\r\n", "---\n", "===\n"]


def check_whole(root):
    for node, _, entering in root.walk():
        if entering:
            assert node.kind in KINDS
            before = None
            for child in node:
                assert child.parent is node and child.prev is before
                before = child
            assert node.last is before


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.sampled_from(list(PROFILES.values())))
def test_any_text_parses(text, options):
    first = parse(text.encode(), options)
    check_whole(first.root)
    assert dump(first.root) == dump(parse(text.encode(), options).root)


GROWING = {
    "nested strong": lambda n: "*a **a " * n,
    "closers": lambda n: "a_ " * n,
    "openers": lambda n: "_a " * n,
    "brackets open": lambda n: "[a" * n,
    "brackets close": lambda n: "a]" * n,
    "link ends": lambda n: "a](b" * n,
    "mismatched": lambda n: "*a_ " * n,
    "backticks": lambda n: "".join("e" + "`" * k for k in range(1, min(n, 400))) + "x" * n,
    "quotes deep": lambda n: "> " * min(n, 2000) + "a",
    "comments": lambda n: "</" + "<!--" * n,
    "instructions": lambda n: "<?" * n,
    "declarations": lambda n: "<!A " * n,
    "cdata": lambda n: "<![CDATA[" * n,
    "dollars": lambda n: "$a " * n,
    "labels": lambda n: ":a[" * n + "]" * n,
    "cross": lambda n: "[[" * n + "]]" * n,
    "tildes": lambda n: "~a ~~b" * n,
    "definitions": lambda n: "[a]: u\n" * n,
    "mails": lambda n: "a@" * n,
    "urls": lambda n: "http://a.b/" * n,
    "rows": lambda n: "| a |\n| - |\n" + "| b |\n" * n,
    "emphasis runs": lambda n: "*" * n + "a" + "*" * n,
    "items": lambda n: "- a\n" * n,
}


@pytest.mark.parametrize("name", GROWING)
def test_time_grows_with_the_text(name):
    took = []
    for n in (2000, 8000):
        text = GROWING[name](n).encode()
        start = time.process_time()
        parse(text)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.2, took  # four times the text; sixteen times would be its square


def test_deep_trees():
    depth = 3000
    root = parse(b"> " * depth + b"a").root
    assert dump(root).count(b"BlockQuote") == depth
