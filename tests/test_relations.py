import pytest
from pyspark.sql import functions as F

from inkstrata.core.document import PROFILES, dump, parse
from inkstrata.functions import scalars, scanners
from inkstrata.operators import parse as p
from inkstrata.operators import views
from inkstrata.sources import documents

TEXT = "# One\n\n[a] and [^n] [^m] [^n]\n\n| x | y |\n|--:|---|\n| 1 | *2* |\n\n[A]: /u 't'\n[a]: /v\n\n[^m]: M\n\n[^n]: N\n\n::d{=}\n"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT.encode()), (2, b""), (3, None), (4, b"a\xff"), (None, b"x")]
    return spark.createDataFrame(rows, "doc_id long, content binary").withColumn("kind", F.lit("clash"))


def test_nodes_and_dumps(spark, docs):
    nodes = p.nodes(docs).cache()
    assert nodes.where("doc_id = 1").count() == sum(e for _, _, e in parse(TEXT.encode()).root.walk())
    assert views.structure_faults(nodes.where("doc_id is not null")).count() == 0
    assert nodes.where("doc_id = 4 and kind = 'Text'").select(F.hex("literal").alias("h")).first().h == "61FF"
    assert {r.doc_id for r in nodes.where("kind = 'Document'").collect()} == {1, 2, 3, 4, None}
    got = {r.doc_id: r.dump for r in p.dumps(docs).collect()}
    assert got[1].encode() == dump(parse(TEXT.encode()).root)
    only = p.nodes(docs, kinds=["Heading"])
    assert [(r.kind, r.level, r.scope.start.line) for r in only.collect()] == [("Heading", 1, 1)]
    assert p.nodes(docs.limit(0)).count() == p.dumps(docs.limit(0)).count() == 0
    assert p.nodes(docs, PROFILES["commonmark"]).where("kind = 'Table'").count() == 0


def test_views(spark, docs):
    nodes = p.nodes(docs.where("doc_id = 1")).cache()
    assert [(r.ord, r.level, r.title) for r in views.outline(nodes).collect()] == [(1, 1, "One")]
    links = views.resolved_links(nodes, p.definitions(docs)).collect()
    assert [(r.label, r.destination, r.title) for r in links] == [("a", "/u", "t")]
    notes = sorted((r.label, r.number, r.use) for r in views.footnote_numbers(nodes).collect())
    assert notes == [("m", 2, 1), ("n", 1, 1), ("n", 1, 2)]
    cells = sorted((r.row, r.column, r.is_header, r.alignment, r.text) for r in views.table_cells(nodes).collect())
    assert cells == [(0, 0, True, "right", "x"), (0, 1, True, "none", "y"), (1, 0, False, "right", "1"), (1, 1, False, "none", "2")]
    events = [r.event for r in views.walk(nodes).orderBy("ord").collect()]
    assert events[0] == "enter" and events[-1] == "exit" and len(events) == 2 * nodes.count()
    assert [(r.code, r.scope.start.line) for r in p.diagnostics(docs).collect()] == [("directive_attributes", 16)]
    table = nodes.where("kind = 'Table'").first()
    assert views.subtree(nodes, 1, table.node_id).count() == 12
    nodes = p.nodes(docs.where("doc_id = 1"), hashes=True)
    other = p.nodes(spark.createDataFrame([(1, (TEXT + "\nmore").encode())], "doc_id long, content binary"), hashes=True)
    assert {r.kind for r in views.changed(nodes, other).collect()} == {"Document", "Paragraph", "Text"}


def test_scanners_agree_with_the_parser(spark):
    lines = ["# a", "#", "####### a", "===", "--", "- - -", "***", "* a", "12. a", "1234567890. x", "``` x", "```` a`b", "~~~", "[^a]: b", "| - | :-: |", "[x] a", "<div>", "</p>", "<!-- a", "<?x", "<!DOCTYPE", "<a b='c'>", "<a b=c> d", "", " x"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    names = ["atx_heading_start", "setext_heading_line", "thematic_break", "list_marker", "open_code_fence", "table_start", "footnote_definition", "tasklist", "html_block_start_7"]
    rows = df.select("line", *(scanners.matches(n, F.col("line")).alias(n) for n in names), scanners.html_block_start(F.col("line")).alias("html")).collect()
    kinds = {"atx_heading_start": "Heading", "thematic_break": "ThematicBreak", "list_marker": "List", "open_code_fence": "CodeBlock", "footnote_definition": "FootnoteDefinition"}
    for r in rows:
        block = parse(r.line.encode()).root.first
        kind = block.kind if block is not None else None
        for name, wanted in kinds.items():
            if name == "list_marker" and r.thematic_break:
                continue
            assert r[name] == (kind == wanted), (r.line, name)
        assert (r.html is not None or r.html_block_start_7) == (kind == "HTMLBlock"), r.line
        under = parse(f"text\n{r.line}".encode()).root.first
        assert r.setext_heading_line == (under.kind == "Heading")
    assert spark.createDataFrame([("\t a",), ("  \tb",)], "l string").select(scanners.indent(F.col("l")).alias("n")).collect()[0].n == 5


def test_scalars(spark):
    row = spark.createDataFrame([(" \tẞ \n b ", "&lt;&#65;\\*", "`` a ``", "swift x", "<!-- a --> ", 'q"\\\n', "a=1 .b")], "a string, b string, c string, d string, e string, f string, g string")
    got = row.select(
        scalars.trim(F.col("a")).alias("trim"), scalars.normalize_whitespace(F.col("a")).alias("ws"), scalars.fold_label("a").alias("fold"), scalars.clean_url("b").alias("url"),
        scalars.decode_entities("b").alias("ent"), scalars.unescape_backslashes(F.col("b")).alias("esc"), scalars.normalize_code(F.lit(" a\n ")).alias("code"), scalars.code_language(F.col("d")).alias("lang"),
        scalars.is_comment(F.col("e")).alias("comment"), scalars.json_string(F.col("f")).alias("json"), scalars.directive_attributes("g").alias("attrs"), scalars.clean_title(F.lit('"t"')).alias("title"),
        scalars.casefold(F.lit("ẞ")).alias("cf"), scalars.count_newlines(F.col("a")).alias("n"), scalars.trim_link(F.lit("http://a.b/c?.")).alias("link"), scalars.rtrim(F.lit("a \n")).alias("r"), scalars.unescape_pipes(F.lit("a\\|b")).alias("pipe"),
    ).first()
    assert (got.trim, got.fold, got.url, got.ent, got.code, got.lang, got.comment) == ("ẞ \n b", "ss b", "<A*", "<A\\*", "a ", "swift", True)
    assert got.esc == "&lt;&#65;*" and got.json == '"q\\"\\\\\\n"' and got.attrs == {"a": "1", "class": "b"} and got.title == "t"
    assert (got.cf, got.n, got.link, got.r, got.pipe, got.ws) == ("ss", 1, "http://a.b/c", "a", "a|b", " ẞ b ")


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\n")
    (tmp_path / "b.md").write_bytes(b"text\r\n\nend")
    files = documents.from_files(spark, str(tmp_path))
    assert sorted(bytes(r.content) for r in files.collect()) == [b"# A\n", b"text\r\n\nend"]
    one = documents.concatenated(spark, [str(tmp_path / "b.md"), str(tmp_path / "a.md")])
    assert bytes(one.first().content) == b"text\r\n\nend# A\n"
    lines = documents.lines(one).orderBy("line").collect()
    assert [(r.line, r.text) for r in lines] == [(1, "text"), (2, ""), (3, "end# A")]
    documents.write_nodes(p.nodes(files), str(tmp_path / "nodes"), buckets=2)
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == p.nodes(files).count()
    documents.write_dumps(p.dumps(documents.from_table(one, "doc_id", "content")), str(tmp_path / "dumps"))
    assert spark.read.text(str(tmp_path / "dumps")).first().value.startswith("Document scope=1:1..3:6")


def test_visitors_are_exhaustive(spark):
    from inkstrata.core.document import KINDS
    from inkstrata.operators.visit import BLOCK_KINDS, INLINE_KINDS, visit

    assert len(KINDS) == 34 == len(BLOCK_KINDS) + len(INLINE_KINDS) and {"DirectiveLabel", "TableCell"} <= BLOCK_KINDS
    with pytest.raises(ValueError):
        visit({"Text": F.lit(1)})
    with pytest.raises(ValueError):
        visit({k: F.lit(1) for k in [*KINDS, "Nope"]})


def test_command_line(tmp_path, capfdbinary):
    from inkstrata.__main__ import main

    (tmp_path / "a.md").write_bytes(b"~~a~~ ")
    (tmp_path / "b.md").write_bytes(b":b\n")
    assert main(["--profile", "gfm", str(tmp_path / "a.md"), str(tmp_path / "b.md")]) == 0
    out = capfdbinary.readouterr().out
    assert b"Strikethrough" in out and b"Directive" not in out and out.startswith(b"Document scope=1:1..1:8")
