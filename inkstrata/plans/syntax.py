"""Queries for one construct of the syntax each: a document per customer or supplier is written from a pattern, in which {k} is its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.core.document import PROFILES
from inkstrata.functions import scalars, scanners
from inkstrata.operators import parse, views
from inkstrata.plans import corpora
from inkstrata.sources import documents

PLAIN = PROFILES["commonmark"]


def patterned(spark: SparkSession, sf_dir: str, pattern: str, table: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """(doc_id, content): the pattern with each row's key for {k}."""
    rows = corpora.table(spark, sf_dir, table)
    return corpora.spread(documents.from_table(rows, key, F.replace(F.lit(pattern), F.lit("{k}"), F.col(key).cast("string"))))


def expected(columns: str, rows: str, table: str = "supplier", key: str = "s_suppkey") -> str:
    """SQL of the given rows for each key; {k} in strings is the key."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = dict(c.split() for c in columns.split(", "))
    shown = ", ".join(f"replace({n}, '{{k}}', cast({key} as varchar)) as \"{n}\"" if kinds[n] == "varchar" else f"cast({n} as {kinds[n]}) as \"{n}\"" for n in names)
    return f"select cast({key} as bigint) as doc_id, {shown} from {table}, (values {rows}) as v({', '.join(names)})"


def _register(query) -> None:
    """Add the queries of this module with the decorator of the registry."""

    @query(expected("ord int, level int, title varchar", "(1, 1, 'Name {k} more'), (2, 2, 'Sub {k}'), (3, 2, 'ATX {k}'), (4, 1, '{k}#'), (5, 3, 'tab'), (6, 1, '')"))
    def md_heading_forms(spark, sf_dir):
        """Setext headings over two lines, closing hashes that count and that do not, an empty heading."""
        return parse.outline(patterned(spark, sf_dir, "Name {k}\nmore\n===\n\nSub {k}\n---\n\n## ATX {k} ##   \n# {k}#\n###\ttab\t#\n#\n"), PLAIN)

    @query(expected("line int, col int", "(3, 1), (5, 1), (6, 2)"))
    def md_thematic_breaks(spark, sf_dir):
        found = parse.nodes(patterned(spark, sf_dir, "a {k}\n\n***\n\n- - -\n ___  _____\nb\n\n-- -x\n"), PLAIN, ["ThematicBreak"], columns=["doc_id", "scope"])
        return found.select("doc_id", F.col("scope.start.line").alias("line"), F.col("scope.start.column").alias("col"))

    @query(
        expected(
            "ord bigint, flavor varchar, start bigint, tight boolean, child_count int",
            "(1, 'ordered', 7, true, 2), (2, 'bullet', -1, false, 2), (3, 'bullet', -1, true, 1), (4, 'bullet', -1, true, 2), (5, 'bullet', -1, true, 1), (6, 'ordered', 0, false, 1)",
        )
    )
    def md_lists(spark, sf_dir):
        """Start, tightness, markers that begin another list, and nesting."""
        pattern = "7. one {k}\n8. two\n\n- a\n\n- b\n\n* c\n\n+ d\n  - e\n+ f\n\n\n0) g\n\n   h\n"
        found = parse.nodes(patterned(spark, sf_dir, pattern), PLAIN, ["List"], columns=["doc_id", "pre", "flavor", "start", "tight", "child_count"])
        order = F.expr("row_number() over (partition by doc_id order by pre)").cast("long").alias("ord")
        return found.select("doc_id", order, "flavor", F.coalesce("start", F.lit(-1)).cast("long").alias("start"), "tight", "child_count")

    @query(expected("literal varchar, info varchar, fenced boolean, closed boolean", "('code {k}' || chr(10) || chr(10) || 'tab' || chr(10), null, false, true), (' x' || chr(10) || '{k}' || chr(10), 'py', true, false)"))
    def md_code_forms(spark, sf_dir):
        """Indented code without its blank tail, and a fence that never closes."""
        found = parse.nodes(patterned(spark, sf_dir, "    code {k}\n\n\ttab\n\n\n~~~ py\n x\n{k}\n"), PLAIN, ["CodeBlock"], columns=["doc_id", "literal", "info", "fenced", "closed"])
        return found.select("doc_id", "literal", "info", "fenced", "closed")

    @query(expected("text varchar", r"""('& © A{k} A &nosuch; "q"'), ('*{k}* \q \ #')"""))
    def md_entities_and_escapes(spark, sf_dir):
        pattern = "&amp; &copy; &#x41;{k} &#65; &nosuch; &quot;q&quot;\n\n\\*{k}\\* \\q \\\\ \\#\n"
        return parse.texts(patterned(spark, sf_dir, pattern), ["Paragraph"], PLAIN).select("doc_id", "text")

    @query(expected("destination varchar, title varchar, text varchar", """('a b{k}', null, 't'), ('u>{k}', 'x', 't'), ('/p(q)', 'say "{k}"', 't'), ('http://x.y/{k}', null, 'http://x.y/{k}'), ('mailto:a{k}@b.c', null, 'a{k}@b.c')"""))
    def md_link_destinations(spark, sf_dir):
        """Destinations in angles, with escapes and parentheses; titles; autolinks in angles."""
        pattern = "[t](<a b{k}>) [t](<u\\>{k}> 'x') [t](/p(q) \"say \\\"{k}\\\"\") <http://x.y/{k}> <a{k}@b.c>\n"
        return parse.texts(patterned(spark, sf_dir, pattern), ["Link"], PLAIN, keep=("destination", "title")).select("doc_id", "destination", "title", "text")

    @query(
        expected(
            "destination varchar, text varchar",
            "('http://www.e{k}.com/a_(b)', 'www.e{k}.com/a_(b)'), ('https://e{k}.org/x?y=1', 'https://e{k}.org/x?y=1'), ('http://www.z.org/a', 'www.z.org/a'), ('mailto:p.{k}@q.org', 'p.{k}@q.org'), ('xmpp:r{k}@s.t/u', 'xmpp:r{k}@s.t/u'), ('ftp://f{k}.net', 'ftp://f{k}.net')",
        )
    )
    def md_bare_links(spark, sf_dir):
        """Bare links and addresses, without the punctuation that closes a sentence, an entity or a parenthesis."""
        pattern = "see www.e{k}.com/a_(b). and https://e{k}.org/x?y=1, or (www.z.org/a) p.{k}@q.org; xmpp:r{k}@s.t/u ftp://f{k}.net&amp; www.a_b.c http://n_o.x_y no@dot xwww.q.r\n"
        return parse.texts(patterned(spark, sf_dir, pattern), ["Link"], PROFILES["gfm"], keep=("destination",)).select("doc_id", "destination", "text")

    @query(expected("literal varchar, line int, col int, eline int, ecol int", "('a`b', 1, 5, 1, 9), (' ', 1, 14, 1, 14), ('c d', 1, 18, 2, 1)"))
    def md_code_spans(spark, sf_dir):
        """Padding that goes and that stays, ticks inside, and a span over two lines with the scope of its content."""
        found = parse.nodes(patterned(spark, sf_dir, "q `` a`b `` ` ` `c\nd` {k}\n"), PLAIN, ["Code"], columns=["doc_id", "literal", "scope"])
        place = [F.col(f"scope.{e}.{p}").alias(n) for n, e, p in (("line", "start", "line"), ("col", "start", "column"), ("eline", "end", "line"), ("ecol", "end", "column"))]
        return found.select("doc_id", "literal", *place)

    @query(
        expected(
            "kind varchar, text varchar",
            "('Paragraph', 'lead {k}'), ('TableCell', 'a'), ('TableCell', 'b'), ('TableCell', 'x|y'), ('TableCell', '{k}'), ('TableCell', 'one'), ('TableCell', ''), ('TableCell', '1'), ('TableCell', '2')",
        )
    )
    def md_table_forms(spark, sf_dir):
        """Lines above a header, escaped pipes, a row that is too short and one that is too long."""
        return parse.texts(patterned(spark, sf_dir, "lead {k}\n| a | b |\n| - | - |\n| x\\|y | {k} |\n| one |\n1 | 2 | 3\n"), ["Paragraph", "TableCell"], PROFILES["gfm"]).drop("node_id")

    @query(expected("kind varchar, mode varchar, literal varchar", r"('FormulaBlock', 'standalone', 'x_{k}'), ('FormulaBlock', 'standalone', 'y_{k}'), ('Formula', 'embedded', 'z'), ('Formula', 'standalone', 'w {k}')"))
    def md_formula_forms(spark, sf_dir):
        """Formulas that stand alone become blocks, as does code of that language; padding inside goes; LaTeX spellings."""
        pattern = "$$x_{k}$$\n\n``` formula\ny_{k}\n```\n\nin $`z`$ and \\\\[ w {k} \\\\] $5 and 6$ no\n"
        found = parse.nodes(patterned(spark, sf_dir, pattern), kinds=["Formula", "FormulaBlock"], columns=["doc_id", "kind", "mode", "literal"])
        return found.where("literal not like '5%'")

    @query(expected("name varchar, key varchar, value varchar", "('badge', 'size', '{k}'), ('badge', 'class', 'a b'), ('badge', 'id', 'i'), ('badge', 'q', 'x y')"))
    def md_attribute_forms(spark, sf_dir):
        """The last value of a repeated key, merged classes, an id, and quoted values."""
        found = parse.nodes(patterned(spark, sf_dir, 'A :badge[x]{size=1 .a #i size={k} q="x y" .b}\n'), kinds=["Directive"], columns=["doc_id", "name", "attributes"])
        return found.select("doc_id", "name", F.explode("attributes").alias("key", "value"))

    @query(expected("kind varchar, comment boolean, literal varchar", "('HTMLBlock', true, '<!-- {k} -->' || chr(10)), ('HTML', true, '<!-- i -->'), ('HTML', false, '<b x=''{k}''>'), ('HTML', false, '<?p?>'), ('HTML', false, '<!D x>'), ('HTML', false, '<![CDATA[c]]>'), ('HTMLBlock', false, '<pre>' || chr(10) || chr(10) || 'y</pre> z' || chr(10))"))
    def md_html_forms(spark, sf_dir):
        """Comments, tags, instructions, declarations and CDATA in a line; blocks that end at a blank line or at their mark."""
        pattern = "<!-- {k} -->\n\nt <!-- i --> <b x='{k}'> <?p?> <!D x> <![CDATA[c]]>\n\n<pre>\n\ny</pre> z\nafter\n"
        return parse.nodes(patterned(spark, sf_dir, pattern), PLAIN, ["HTML", "HTMLBlock"], columns=["doc_id", "kind", "comment", "literal"])

    @query(expected("kind varchar, n_nodes bigint", "('LineBreak', 2), ('SoftBreak', 1)"))
    def md_break_kinds(spark, sf_dir):
        """Two spaces or a backslash make a hard break; those that end a paragraph none."""
        found = parse.nodes(patterned(spark, sf_dir, "a  \nb\\\nc {k}\nd  \n"), PLAIN, ["LineBreak", "SoftBreak"], columns=["doc_id", "kind"])
        return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n_nodes"))

    @query(expected("kind varchar, line int, label varchar, text varchar", "('ReferenceDefinition', 1, 'a {k}', ''), ('ReferenceDefinition', 2, 'b', ''), ('Paragraph', 4, null, 'rest {k}'), ('FootnoteDefinition', 6, 'n', 'note more {k}')"))
    def md_definition_prefix(spark, sf_dir):
        """Definitions at the front of a paragraph, whose rest stays, and a footnote over two paragraph lines."""
        pattern = "[a {k}]: /x\n[b]: /y\n 't'\nrest {k}\n\n[^n]: note\n    more {k}\n"
        docs = patterned(spark, sf_dir, pattern)
        placed = parse.nodes(docs, kinds=["ReferenceDefinition", "Paragraph", "FootnoteDefinition"], columns=["doc_id", "node_id", "scope", "depth"])
        found = parse.texts(docs, ["ReferenceDefinition", "Paragraph", "FootnoteDefinition"], keep=("label",)).join(placed.where("depth = 1"), ["doc_id", "node_id"])
        return found.select("doc_id", "kind", F.col("scope.start.line").alias("line"), "label", "text")

    @query(expected("label varchar, destination varchar", "('Straße {k}', '/u/{k}'), ('STRASSE  {k}', '/u/{k}'), ('ẞ', '/v'), ('İx', '/w')"))
    def md_folded_references(spark, sf_dir):
        """Labels meet by full case folding and by runs of white space."""
        docs = patterned(spark, sf_dir, "[Straße {k}] [STRASSE  {k}] [ẞ] [İx]\n\n[straße {k}]: /u/{k}\n[ss]: /v\n[i\u0307X]: /w\n")
        found = views.resolved_links(parse.nodes(docs, PLAIN, ["LinkReference"]), parse.definitions(docs, PLAIN))
        return found.select("doc_id", "label", "destination")

    @query(expected("label varchar, number int, use int", "('ẞ{k}', 1, 1), ('ss{k}', 1, 2), ('b', 2, 1), ('B', 2, 2)"))
    def md_folded_footnotes(spark, sf_dir):
        docs = patterned(spark, sf_dir, "[^ẞ{k}] [^ss{k}] [^b] [^B] [^none]\n\n[^ß{k}]: one\n\n[^b]: two\n")
        return views.footnote_numbers(parse.nodes(docs, kinds=["FootnoteReference"])).drop("node_id")

    @query(
        """select cast(s_suppkey as bigint) as doc_id, 'Paragraph scope=1:1..1:' || (8 + strlen(k)) || ' children=1' || chr(10) || '└── Text scope=1:1..1:' || (8 + strlen(k))
        || ' literal="q\\"b\\\\c\\t' || k || '\\u0001" children=0' || chr(10) as dump from (select *, cast(s_suppkey as varchar) as k from supplier)"""
    )
    def md_subtree_dumps(spark, sf_dir):
        """The dump of a paragraph below a heading: its first line is line 1, strings are quoted as JSON."""
        return parse.subtree_dumps(patterned(spark, sf_dir, '# h\n\nq"b\\\\c\t{k}\x01\n'), ["Paragraph"], PLAIN).select("doc_id", "dump")

    @query(expected("profile varchar, n_nodes bigint", "('commonmark', 0), ('gfm', 4), ('gfm-smart', 4), ('gfm-extended', 6), ('default', 6)"))
    def md_profiles(spark, sf_dir):
        """The same text under each named set of options."""
        docs = patterned(spark, sf_dir, "~~a {k}~~ www.x.org [^n] [[c]]\n\n- [x] t\n\n:d\n\n[^n]: f\n")
        kinds = "Strikethrough Link FootnoteReference FootnoteDefinition CrossLink Directive".split()
        found = None
        for name, options in PROFILES.items():
            counted = parse.nodes(docs, options, ["Document", *kinds], columns=["doc_id", "kind"]).groupBy("doc_id").agg(F.sum((F.col("kind") != "Document").cast("long")).alias("n_nodes"))
            counted = counted.withColumn("profile", F.lit(name))
            found = counted if found is None else found.unionByName(counted)
        return found

    @query(expected("node_id bigint, kind varchar, first_child bigint, next_sibling bigint, parent_id bigint", "(0, 'Document', 1, -1, -1), (1, 'Paragraph', 2, 3, 0), (2, 'Text', -1, -1, 1), (3, 'BlockQuote', 4, -1, 0), (4, 'Paragraph', 5, -1, 3), (5, 'Text', -1, -1, 4)"))
    def md_navigation(spark, sf_dir):
        """First child, next sibling and parent of every node, -1 for none."""
        nodes = parse.nodes(patterned(spark, sf_dir, "a {k}\n\n> b\n"), PLAIN, columns=["doc_id", "node_id", "parent_id", "kind", "ordinal"])
        return views.navigation(nodes).fillna(-1, ["first_child", "next_sibling", "parent_id"])

    @query(expected("node_id bigint, kind varchar, depth int", "(3, 'BlockQuote', 1), (4, 'Paragraph', 2), (5, 'Text', 3)"))
    def md_lookup(spark, sf_dir):
        """Nodes by id, with all below them."""
        docs = patterned(spark, sf_dir, "a {k}\n\n> b\n\nc\n")
        wanted = docs.select("doc_id", F.lit(3).cast("long").alias("node_id"))
        return views.lookup(parse.nodes(docs, PLAIN), wanted).select("doc_id", "node_id", "kind", "depth")

    @query(
        """select cast(s_suppkey as bigint) as doc_id, cast(node_id as bigint) as node_id, fault from supplier,
        (values (0, 1, 'child count'), (0, 0, 'ordinal'), (1, 2, 'depth'), (2, 1, 'order'), (3, 2, 'parent missing'), (4, 2, 'no parent'), (4, 1, 'child count')) as v(r, node_id, fault)
        where s_suppkey % 5 = r and not (r = 0 and fault = 'ordinal')"""
    )
    def md_planted_faults(spark, sf_dir):
        """What the structure check says of relations that were damaged, one way for each remainder of the key."""
        nodes = parse.nodes(patterned(spark, sf_dir, "a {k}\n"), PLAIN, columns=["doc_id", "node_id", "parent_id", "kind", "depth", "ordinal", "child_count", "pre", "post"])
        here = lambda r, node: (F.col("doc_id") % 5 == r) & (F.col("node_id") == node)
        damaged = nodes.select(
            "doc_id", "node_id", "kind", "ordinal", "pre",
            F.when(here(3, 2), 99).when(here(4, 2), None).otherwise(F.col("parent_id")).alias("parent_id"),
            F.when(here(0, 1), 7).when(here(3, 1), 0).otherwise(F.col("child_count")).alias("child_count"),
            F.when(here(1, 2), 5).otherwise(F.col("depth")).alias("depth"),
            F.when(here(2, 1), 0).otherwise(F.col("post")).alias("post"),
        )
        return views.structure_faults(damaged.where(~here(2, 2)).withColumn("child_count", F.when(here(2, 1), 0).otherwise(F.col("child_count"))))

    @query(expected("kind varchar, side varchar, n bigint", "('Document', 'before', 1), ('Document', 'after', 1), ('Paragraph', 'before', 1), ('Text', 'before', 1), ('Heading', 'after', 1), ('Text', 'after', 1)"))
    def md_changed_subtrees(spark, sf_dir):
        before = parse.nodes(patterned(spark, sf_dir, "same {k}\n\nold\n"), PLAIN, hashes=True)
        after = parse.nodes(patterned(spark, sf_dir, "# new\n\nsame {k}\n"), PLAIN, hashes=True)
        return views.changed(before, after).groupBy("doc_id", "kind", "side").agg(F.count("*").alias("n"))

    lines = [
        ("autolink_uri", "http://a{k}> x", "http://a{k}"), ("autolink_email", "a{k}@b.c> x", "a{k}@b.c"), ("html_tag", "b x='{k}'> y", "b x='{k}'>"),
        ("html_comment", "-- {k} --> y", "-- {k} -->"), ("html_pi", "p {k}?> y", "p {k}?>"), ("html_declaration", "D {k}> y", "D {k}"),
        ("html_cdata", "CDATA[{k}]]> y", "CDATA[{k}]]>"), ("html_block_start_7", "<x{k}>  ", "x{k}>"), ("link_title", "'t {k}' y", "'t {k}'"),
        ("spacechars", "  {k}", "  "), ("atx_heading_start", "### {k}", "###"), ("setext_heading_line", "=== ", "==="), ("open_code_fence", "``` {k}", "```"),
        ("close_code_fence", "~~~~  ", "~~~~"), ("footnote_definition", "[^n{k}]: x", "n{k}"), ("table_start", "| :-: | --- |", ""), ("table_cell", "a\\|{k} | b", "a\\|{k} "),
        ("table_cell_end", "|  {k}", "|  "), ("table_row_end", "  ", "  "), ("tasklist", "[x] {k}", "x"), ("formula_dollar_inline_open", "$x{k}$", "$"),
        ("formula_dollar_display_open", "$$x{k}", "$$"), ("formula_latex_backslash_inline_open", "\\\\({k}", "\\\\("),
        ("formula_latex_backslash_display_open", "\\\\[{k}", "\\\\["), ("directive_name", "name-{k}[x]", "name-{k}"), ("thematic_break", "* * *", ""), ("list_marker", "12) {k}", "12)"),
    ]
    quoted = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in (name, found))) for name, _, found in lines)

    @query(expected("scanner varchar, found varchar, elsewhere boolean", quoted.replace("), (", ", false), (")[:-1] + ", false)"))
    def md_scanners(spark, sf_dir):
        """What each lexical scanner finds at the start of a line that has its construct, and that it finds none behind other text."""
        key = corpora.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"))
        out = None
        for name, line, _ in lines:
            text = F.replace(F.lit(line), F.lit("{k}"), F.col("doc_id").cast("string"))
            group = scanners.extract(name, text) if "(" in scanners.PATTERNS[name].replace("(?", "") else F.when(scanners.matches(name, text), F.lit(""))
            before = "\x00\n" if name in ("table_cell", "directive_name", "html_pi") else "\x00 "
            away = scanners.matches(name, F.concat(F.lit(before), text)) if name not in ("html_pi", "table_cell") else F.lit(False)
            row = key.select("doc_id", F.lit(name).alias("scanner"), group.alias("found"), away.alias("elsewhere"))
            out = row if out is None else out.unionByName(row)
        return out

    blocks = [("<script>", 1, "x</script>"), ("<!-- {k}", 2, "x -->"), ("<?p", 3, "?>"), ("<!D", 4, "x>"), ("<![CDATA[", 5, "]]>"), ("</DIV {k}>", 6, None), ("<b>", None, None)]

    @query(expected("ord int, sort int, ends boolean", ", ".join(f"({k}, {kind or 0}, {'true' if end else 'false'})" for k, (_, kind, end) in enumerate(blocks))))
    def md_html_block_marks(spark, sf_dir):
        """Kinds of HTML blocks by their first line, and the lines that end the first five."""
        key = corpora.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"))
        out = None
        for k, (start, kind, end) in enumerate(blocks):
            ends = scanners.html_block_end(kind, F.lit(end)) if end else F.lit(False)
            row = key.select("doc_id", F.lit(k).alias("ord"), F.coalesce(scanners.html_block_start(F.replace(F.lit(start), F.lit("{k}"), F.col("doc_id").cast("string"))), F.lit(0)).alias("sort"), ends.alias("ends"))
            out = row if out is None else out.unionByName(row)
        return out

    functions = [
        ("trim", scalars.trim, " \t{k} x\n", "{k} x"), ("rtrim", scalars.rtrim, " {k}\t\r\n", " {k}"), ("spaces", scalars.normalize_whitespace, "a \n\t{k}", "a {k}"),
        ("backslashes", scalars.unescape_backslashes, "\\*{k}\\q\\\\", "*{k}\\q\\"), ("pipes", scalars.unescape_pipes, "a\\|{k}", "a|{k}"), ("code", scalars.normalize_code, " a\r\n{k} ", "a {k}"),
        ("language", scalars.code_language, " py{k} x", "py{k}"), ("json", scalars.json_string, 'a"\\{k}\n', '"a\\"\\\\{k}\\n"'), ("newlines", lambda x: scalars.count_newlines(x).cast("string"), "a\n{k}\n", "2"),
        ("comment", lambda x: scalars.is_comment(x).cast("string"), " <!-- {k} -->\n", "true"), ("link", scalars.trim_link, "http://x/{k}?!.<b", "http://x/{k}"),
        ("fold", scalars.fold_label, " Straße \t{k}", "strasse {k}"), ("entities", scalars.decode_entities, "&lt;{k}&#33;&no;", "<{k}!&no;"), ("casefold", scalars.casefold, "ẞİ{k}", "ssi̇{k}"),
        ("url", scalars.clean_url, " a\\){k}&amp; ", "a){k}&"), ("title", scalars.clean_title, '"t \\"{k}&quot;"', 't "{k}"'), ("attribute", lambda x: scalars.directive_attributes(x)["size"], "size={k} .a", "{k}"),
    ]
    wanted = ", ".join("('{}', '{}')".format(name, value.replace("'", "''")) for name, _, _, value in functions).replace("\n", "' || chr(10) || '")

    @query(expected("name varchar, value varchar", wanted))
    def md_scalars(spark, sf_dir):
        """Every scalar function of the grammar on a text with the key in it."""
        key = corpora.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"))
        made = [function(F.replace(F.lit(text), F.lit("{k}"), F.col("doc_id").cast("string"))).alias(name) for name, function, text, _ in functions]
        wide = key.select("doc_id", *made)
        return wide.select("doc_id", F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n, *_ in functions)), F.array(*(F.col(n) for n, *_ in functions)))).alias("name", "value"))
