"""Markdown written by queries over relational tables, so that what a parse must find is known from the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered(rows: DataFrame, doc_id: str, order: str, line: Column, between: str = "\n") -> DataFrame:
    """(doc_id, body): the lines of each document in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line"))))
    return rows.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda x: x["line"]), between).alias("body"))


def content(body: Column) -> Column:
    return body.cast("binary").alias("content")


def spread(docs: DataFrame) -> DataFrame:
    """The documents dealt over all cores by id: parsing costs far more than moving text, and these corpora come from a few
    small files or from aggregates that adaptive execution would put into one task."""
    spark = docs.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartition(n, "doc_id")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading for each region, a subheading for each of its nations, and a paragraph that names both."""
    nation = table(spark, sf_dir, "nation")
    line = F.concat(F.lit("## "), F.col("n_name"), F.lit("\n\nNation *"), F.col("n_nationkey").cast("string"), F.lit("* of the region.\n"))
    bodies = gathered(nation, "n_regionkey", "n_nationkey", line)
    named = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name")
    return spread(bodies.join(named, "doc_id").select("doc_id", content(F.concat(F.lit("# "), F.col("r_name"), F.lit("\n\n"), F.col("body")))))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table of each customer's orders."""
    orders = table(spark, sf_dir, "orders")
    line = F.concat_ws(" | ", F.lit(""), F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    head = "| key | status | priority |\n| --: | :-: | --- |\n"
    return spread(gathered(orders, "o_custkey", "o_orderkey", line).select("doc_id", content(F.concat(F.lit(head), F.ltrim("body"), F.lit("\n")))))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: an inline link, a reference, an image and an autolink for each supplier; definitions, each label twice."""
    key = F.col("s_suppkey").cast("string")
    line = F.concat(
        F.lit("[go "), F.col("s_name"), F.lit('](/supplier/'), key, F.lit(' "nation '), F.col("s_nationkey").cast("string"), F.lit('") and [S '), key,
        F.lit("] and ![pic](/img/"), key, F.lit(".png) and <https://example.com/"), key, F.lit(">\n\n[s  "), key, F.lit("]: /first/"), key,
        F.lit("\n[S "), key, F.lit("]: /second/"), key, F.lit(" 'late'\n\n"),
    )
    return spread(gathered(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", line, "").select("doc_id", content(F.col("body"))))


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part with one of every smaller construct, its values taken from the part."""
    key, size, brand = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_brand")
    body = F.concat(
        F.lit("Part **"), key, F.lit("** is *"), brand, F.lit("* not ~~"), size, F.lit("~~ with `"), size, F.lit("` and $x_{"), key, F.lit("}$ see [[part "), key,
        F.lit("]] and ![[pic "), key, F.lit("]] :badge["), brand, F.lit("]{size="), size, F.lit(" .a .b} mail p"), key, F.lit("@example.com.[^n"), key, F.lit("]\n\n- [x] size\n- [ ] type "), size,
        F.lit("\n\n``` lang"), size, F.lit(" extra\ncode "), key, F.lit("\n```\n\n$$\nsum "), key, F.lit("\n$$\n\n:::box[Label]{key="), key, F.lit("}\ninside\n:::\n\n> quoted "), size,
        F.lit("\n\n<div>"), key, F.lit("</div>\n\n::leaf{bad=}\n\n---\n\n[^n"), key, F.lit("]: note "), size, F.lit(' -- "end"...\n'),
    )
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), content(body)))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an append stream, a chunk a turn."""
    talk = table(spark, sf_dir, "conversations")
    chunk = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.col("text"), F.lit("\n\n"))
    return talk.select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("seq"), chunk.cast("binary").alias("chunk"))


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as an append stream: two chunks for an order, the second of which ends its paragraph."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("key"))
    parts = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("order").alias("text")), F.struct(F.lit(1).alias("part"), F.concat(F.lit(" "), F.col("key").cast("string"), F.lit("\n\n")).alias("text"))))
    split = orders.select("chain_id", "key", parts.alias("p"))
    return split.select("chain_id", (F.col("key") * 2 + F.col("p.part")).alias("seq"), F.col("p.text").cast("binary").alias("chunk"))
