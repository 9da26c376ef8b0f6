"""The engine's queries by name, with the SQL over the base tables that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.core.document import PROFILES
from inkstrata.functions import scanners
from inkstrata.operators import parse, views
from inkstrata.operators.visit import with_category
from inkstrata.plans import corpora, syntax
from inkstrata.sources import documents
from inkstrata.streaming.append import append_batch, append_nodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def outline_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.outline(corpora.regions(spark, sf_dir))


@query(
    """select cast(r_regionkey as bigint) as doc_id, cast(1 as int) as ord, cast(1 as int) as level, r_name as title
    from region where r_regionkey in (select n_regionkey from nation)
    union all
    select cast(n_regionkey as bigint), cast(1 + row_number() over (partition by n_regionkey order by n_nationkey) as int), cast(2 as int), n_name from nation"""
)
def md_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_of(spark, sf_dir)


@query(
    """with n as (select cast(n_regionkey as bigint) as doc_id, count(*) as n from nation group by 1)
    select doc_id, kind, cast(a + b * n as bigint) as n_nodes from n,
    (values ('Document', 1, 0), ('Heading', 1, 1), ('Paragraph', 0, 1), ('Emphasis', 0, 1), ('Text', 1, 4)) as k(kind, a, b)"""
)
def md_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nodes(corpora.regions(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n_nodes"))


@query(
    """with n as (select cast(n_regionkey as bigint) as doc_id, count(*) as n from nation group by 1)
    select doc_id, event, cast(3 + 7 * n as bigint) as n_events from n, (values ('enter'), ('exit')) as e(event)"""
)
def md_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.walk(parse.nodes(corpora.regions(spark, sf_dir))).groupBy("doc_id", "event").agg(F.count("*").alias("n_events"))


@query(
    """with n as (select cast(n_regionkey as bigint) as doc_id, count(*) as n from nation group by 1)
    select doc_id, category, cast(a + b * n as bigint) as n_nodes from n, (values ('block', 2, 2), ('inline', 1, 5)) as k(category, a, b)"""
)
def md_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_category(parse.nodes(corpora.regions(spark, sf_dir))).groupBy("doc_id", "category").agg(F.count("*").alias("n_nodes"))


@query("select cast(n_regionkey as bigint) as doc_id, cast(3 + 13 * count(*) as bigint) as n_pairs from nation group by 1")
def md_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ancestors(parse.nodes(corpora.regions(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("n_pairs"))


@query(
    """with n as (select cast(n_regionkey as bigint) as doc_id, count(*) as n from nation group by 1)
    select doc_id, cast(2 * n as bigint) as n_following from n"""
)
def md_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of the document that have a next sibling."""
    nodes = parse.nodes(corpora.regions(spark, sf_dir))
    return views.children(nodes).where("parent_id = 0 and next_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_following"))


@query(
    """select cast(n_nationkey as bigint) as doc_id, 'Document scope=1:1..1:' || (2 + strlen(n_name)) || ' children=1' || chr(10)
    || '└── Heading scope=1:1..1:' || (2 + strlen(n_name)) || ' level=1 children=1' || chr(10)
    || '    └── Text scope=1:3..1:' || (2 + strlen(n_name)) || ' literal="' || n_name || '" children=0' || chr(10) as dump from nation"""
)
def md_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = corpora.table(spark, sf_dir, "nation")
    return parse.dumps(documents.from_table(nation, "n_nationkey", F.concat(F.lit("# "), F.col("n_name"))))


@query("select cast(0 as bigint) as doc_id, cast(0 as bigint) as node_id, '' as fault where false")
def md_structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "node_id", "parent_id", "kind", "depth", "ordinal", "child_count", "pre", "post"]
    return views.structure_faults(parse.nodes(corpora.part_notes(spark, sf_dir), columns=columns))


@query("select cast(o_custkey as bigint) as doc_id, cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority from orders")
def md_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = parse.table_cells(corpora.order_tables(spark, sf_dir))
    pick = lambda k: F.max(F.when(F.col("column") == k, F.col("text")))
    rows = cells.where("not is_header").groupBy("doc_id", "table_id", "row")
    return rows.agg(pick(0).alias("o_orderkey"), pick(1).alias("o_orderstatus"), pick(2).alias("o_orderpriority")).drop("table_id", "row")


@query(
    """with c as (select count(*) as n, count(distinct o_custkey) as d from orders)
    select cast(k as int) as "column", alignment, cast(n + d as bigint) as n_cells from c, (values (0, 'right'), (1, 'center'), (2, 'none')) as a(k, alignment)"""
)
def md_table_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.cell_places(corpora.order_tables(spark, sf_dir)).groupBy("column", "alignment").agg(F.count("*").alias("n_cells"))


@query(
    """select cast(s_nationkey as bigint) as doc_id, '/supplier/' || s_suppkey as destination, 'nation ' || s_nationkey as title, 'go ' || s_name as text from supplier
    union all select cast(s_nationkey as bigint), 'https://example.com/' || s_suppkey, null, 'https://example.com/' || s_suppkey from supplier"""
)
def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.texts(corpora.suppliers(spark, sf_dir), ["Link"], keep=("destination", "title")).drop("node_id", "kind")


@query("select cast(s_nationkey as bigint) as doc_id, '/img/' || s_suppkey || '.png' as source, cast(null as varchar) as title from supplier")
def md_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nodes(corpora.suppliers(spark, sf_dir), kinds=["Image"]).select("doc_id", "source", "title")


@query("select cast(s_nationkey as bigint) as doc_id, 'S ' || s_suppkey as label, '/first/' || s_suppkey as destination, cast(null as varchar) as title from supplier")
def md_resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.suppliers(spark, sf_dir)
    found = views.resolved_links(parse.nodes(docs, kinds=["LinkReference", "ImageReference"]), parse.definitions(docs))
    return found.select("doc_id", "label", "destination", "title")


@query(
    """select cast(s_nationkey as bigint) as doc_id, 'link' as space, 's ' || s_suppkey as norm_label, 's  ' || s_suppkey as label, '/first/' || s_suppkey as destination, cast(null as varchar) as title from supplier
    union all select cast(s_nationkey as bigint), 'link', 's ' || s_suppkey, 'S ' || s_suppkey, '/second/' || s_suppkey, 'late' from supplier"""
)
def md_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.definitions(corpora.suppliers(spark, sf_dir)).drop("ord")


@query(
    """select doc_id, space, norm_label, ord, destination from (
      select cast(l_orderkey as bigint) as doc_id, 'link' as space, l_returnflag || l_linestatus as norm_label, cast(l_linenumber as bigint) as ord, cast(l_partkey as varchar) as destination,
      row_number() over (partition by l_orderkey, l_returnflag, l_linestatus order by l_linenumber) as n from lineitem) where n = 1"""
)
def md_first_definition_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of the first definition over a large relation of labels."""
    line = corpora.table(spark, sf_dir, "lineitem")
    definitions = line.select(
        F.col("l_orderkey").cast("long").alias("doc_id"), F.lit("link").alias("space"), F.concat("l_returnflag", "l_linestatus").alias("norm_label"),
        F.col("l_linenumber").cast("long").alias("ord"), F.col("l_partkey").cast("string").alias("destination"),
    )
    return views.first_wins(definitions)


@query(
    """select doc_id, kind, text from (select cast(p_partkey as bigint) as doc_id, p_partkey as k, p_size as s, p_brand as b from part),
    lateral (values ('Strong', cast(k as varchar)), ('Emphasis', b), ('Strikethrough', cast(s as varchar)), ('BlockQuote', 'quoted ' || s), ('DirectiveLabel', b), ('DirectiveLabel', 'Label')) as v(kind, text)"""
)
def md_styled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["Strong", "Emphasis", "Strikethrough", "BlockQuote", "DirectiveLabel"]
    return parse.texts(corpora.part_notes(spark, sf_dir), kinds, numbers=False)


@query(
    """select doc_id, kind, mode, literal from (select cast(p_partkey as bigint) as doc_id, p_partkey as k, p_size as s from part),
    lateral (values ('Code', 'embedded', cast(s as varchar)), ('Formula', 'embedded', 'x_{' || k || '}'), ('FormulaBlock', 'standalone', 'sum ' || k), ('HTMLBlock', null, '<div>' || k || '</div>' || chr(10))) as v(kind, mode, literal)"""
)
def md_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nodes(corpora.part_notes(spark, sf_dir), kinds=["Code", "Formula", "FormulaBlock", "HTMLBlock"], columns=["doc_id", "kind", "mode", "literal"])


@query(
    """select cast(p_partkey as bigint) as doc_id, 'lang' || p_size as language, 'lang' || p_size || ' extra' as info, 'code ' || p_partkey || chr(10) as literal, true as fenced, true as closed from part"""
)
def md_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "language", "info", "literal", "fenced", "closed"]
    return parse.nodes(corpora.part_notes(spark, sf_dir), kinds=["CodeBlock"], columns=columns).select(*columns)


@query("select 'lang' || p_size as language, count(*) as n_blocks from part group by 1")
def md_code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = parse.nodes(corpora.part_notes(spark, sf_dir), kinds=["CodeBlock"], columns=["language"])
    return blocks.groupBy("language").agg(F.count("*").alias("n_blocks"))


@query(
    """select doc_id, kind, reference from (select cast(p_partkey as bigint) as doc_id, p_partkey as k from part),
    lateral (values ('CrossLink', 'part ' || k), ('Embed', 'pic ' || k)) as v(kind, reference)"""
)
def md_cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nodes(corpora.part_notes(spark, sf_dir), kinds=["CrossLink", "Embed"], columns=["doc_id", "kind", "reference"])


@query(
    """select doc_id, kind, name, key, value from (select cast(p_partkey as bigint) as doc_id, p_partkey as k, p_size as s from part),
    lateral (values ('Directive', 'badge', 'size', cast(s as varchar)), ('Directive', 'badge', 'class', 'a b'), ('DirectiveBlock', 'box', 'key', cast(k as varchar))) as v(kind, name, key, value)"""
)
def md_directive_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.nodes(corpora.part_notes(spark, sf_dir), kinds=["Directive", "DirectiveBlock"], columns=["doc_id", "kind", "name", "attributes"])
    return found.select("doc_id", "kind", "name", F.explode("attributes").alias("key", "value"))


@query("select cast(p_partkey as bigint) as doc_id, 'directive_attributes' as code, cast(22 as int) as line, cast(7 as int) as \"column\" from part")
def md_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.diagnostics(corpora.part_notes(spark, sf_dir))
    return found.select("doc_id", "code", F.col("scope.start.line").alias("line"), F.col("scope.start.column").alias("column"))


@query("select cast(p_partkey as bigint) as doc_id, checked, count(*) as n_items from part, (values (true), (false)) as c(checked) group by 1, 2")
def md_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.nodes(corpora.part_notes(spark, sf_dir), kinds=["ListItem"], columns=["doc_id", "checked"]).where("checked is not null")
    return found.groupBy("doc_id", "checked").agg(F.count("*").alias("n_items"))


@query("select cast(p_partkey as bigint) as doc_id, 'n' || p_partkey as label, cast(1 as int) as number, cast(1 as int) as use from part")
def md_footnote_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.footnote_numbers(corpora.part_notes(spark, sf_dir))


@query("select cast(p_partkey as bigint) as doc_id, 'note ' || p_size || ' – “end”…' as text from part")
def md_smart_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.texts(corpora.part_notes(spark, sf_dir), ["FootnoteDefinition"], numbers=False).drop("kind")


@query("select cast(p_partkey as bigint) as doc_id, 'mailto:p' || p_partkey || '@example.com' as destination, cast(null as varchar) as title from part")
def md_mail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nodes(corpora.part_notes(spark, sf_dir), kinds=["Link"], columns=["doc_id", "destination", "title"])


@query(
    """select cast(doc_id as bigint) as doc_id, cast(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n')) as bigint) as n_breaks from documents"""
)
def md_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks in real prose: each line of a text gets a word in front, so that all of it is one paragraph."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(\A|\r\n|\r|\n)(?!\z)", "$1w ")
    docs = corpora.spread(documents.from_table(corpora.table(spark, sf_dir, "documents"), "doc_id", text))
    nodes = parse.nodes(docs, PROFILES["commonmark"], kinds=["Document", "SoftBreak", "LineBreak"], columns=["doc_id", "kind"])
    return nodes.groupBy("doc_id").agg(F.sum((F.col("kind") != "Document").cast("long")).alias("n_breaks"))


@query(
    """select doc_id, cast(len(l) as bigint) as n_lines, cast(len(list_filter(l, lambda x: regexp_full_match(x, '[ \\t]*'))) as bigint) as n_blank from (
      select cast(doc_id as bigint) as doc_id, case when coalesce(text, '') = '' then [] else string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') end as l from documents)"""
)
def md_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scanners.lines(F.coalesce(F.col("text"), F.lit("")))
    blank = F.size(F.filter(lines, scanners.is_blank))
    return corpora.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), blank.cast("long").alias("n_blank"))


@query(
    """select cast(n_regionkey as bigint) as doc_id, cast(1 + count(*) as bigint) as n_headings, cast(4 * count(*) + 1 as bigint) as n_lines from nation group by 1"""
)
def md_scanned_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings found by the native scanner alone, without a parse."""
    lines = documents.lines(corpora.regions(spark, sf_dir))
    heads = F.sum(scanners.matches("atx_heading_start", F.col("text")).cast("long")).alias("n_headings")
    return lines.groupBy("doc_id").agg(heads, F.count("*").alias("n_lines"))


@query("select cast(c_custkey as bigint) as doc_id, lower(c_name) || ' ' || lower(c_mktsegment) as norm_label from customer")
def md_folded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit(" \t"), F.upper("c_name"), F.lit("\n \t"), F.col("c_mktsegment"), F.lit(" "))
    return corpora.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), views.fold(F.regexp_replace(label, r"[\t\n]", " ")).alias("norm_label"))


@query(
    """select cast(conv_id as bigint) as chain_id, cast(count(*) as bigint) as chunks, cast(0 as bigint) as refused, cast(count(*) + 1 as bigint) as doc_revision,
    cast(sum(strlen(role) + strlen(text) + 8) as bigint) as bytes, true as whole from conversations group by 1"""
)
def md_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as append streams: what has grown chunk by chunk must be the parse of the whole."""
    return append_batch(corpora.conversations(spark, sf_dir)).drop("nodes", "ids_made")


_ORDERS = "(select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as j, count(*) over (partition by o_custkey) as n from orders)"


@query(f"select cast(o_custkey as bigint) as chain_id, cast(2 * n as bigint) as chunks, cast(2 * n + 1 as bigint) as doc_revision, cast(2 * n + 1 as bigint) as nodes, cast(2 * n + 1 as bigint) as ids_made, true as whole from {_ORDERS} where j = 1")
def md_append_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph for each order, in two chunks: what the first of them began keeps its ids when the second goes on with it."""
    return append_batch(corpora.order_chunks(spark, sf_dir)).drop("refused", "bytes")


@query(
    f"""select cast(o_custkey as bigint) as chain_id, cast(1 as bigint) as node_id, cast(2 * n + 1 as bigint) as last_changed_rev, 'Document' as kind from {_ORDERS} where j = 1
    union all select cast(o_custkey as bigint), cast(2 * j + i as bigint), cast(2 * j + 1 as bigint), kind from {_ORDERS}, (values (0, 'Paragraph'), (1, 'Text')) as v(i, kind)"""
)
def md_append_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which revision changed each node last: that of the chunk which ended its paragraph, and the last one for the document."""
    return append_nodes(corpora.order_chunks(spark, sf_dir)).select("chain_id", "node_id", "last_changed_rev", "kind")


syntax._register(query)
