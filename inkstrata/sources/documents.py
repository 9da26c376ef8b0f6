"""Where documents come from and where relations go. A document is (doc_id LONG, content BINARY)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(doc_id, path, content) of the files below a path, one document each; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def concatenated(spark: SparkSession, paths: list[str], doc_id: int = 0) -> DataFrame:
    """The files of a list, in its order, as one document; for lists whose files together fit one task."""
    order = F.array_position(F.array(*(F.lit(p) for p in paths)), F.regexp_replace("path", r"\Afile:/+", "/"))
    files = spark.read.format("binaryFile").load(paths).select(order.alias("k"), F.hex("content").alias("content"))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), ""))
    return files.agg(joined.alias("content")).select(F.lit(doc_id).cast("long").alias("doc_id"), "content")


def from_table(df: DataFrame, doc_id: str | Column, text: str | Column) -> DataFrame:
    """(doc_id, content) from a column of text or bytes; null is empty."""
    doc_id, text = (F.col(x) if isinstance(x, str) else x for x in (doc_id, text))
    return df.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("content"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text): the lines of each document, numbered from 1, without their ends."""
    from inkstrata.functions.scanners import lines as split

    numbered = docs.select("doc_id", F.posexplode(split(F.col("content").cast("string"))).alias("k", "text"))
    return numbered.select("doc_id", (F.col("k") + 1).alias("line"), "text")


def write_nodes(nodes: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write a node relation as Parquet, in document order within each file; with `buckets`, documents are dealt to that many
    files by id, so that later joins by document read what belongs together."""
    placed = nodes.repartition(buckets, "doc_id") if buckets else nodes
    placed.sortWithinPartitions("doc_id", "pre").write.mode("overwrite").parquet(path)


def write_dumps(dumps: DataFrame, path: str) -> None:
    """Write canonical dumps as text, a folder for each document id."""
    dumps.select("doc_id", F.regexp_replace("dump", r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
