"""The structure check over broken relations, against the joins that define it; it reads its input once and broadcasts nothing."""

import random

import pytest
from pyspark.sql import functions as F

from inkstrata.core.document import parse
from inkstrata.operators import parse as p
from inkstrata.operators import views
from inkstrata.plans import corpora, queries

SCHEMA = "doc_id long, node_id long, parent_id long, kind string, depth int, ordinal int, child_count int, pre long, post long"


def by_joins(nodes):
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("p_pre"), F.col("post").alias("p_post"), F.col("depth").alias("p_depth"), F.lit(True).alias("found"))
    counts = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"), F.max("ordinal").alias("top"))
    both = nodes.join(up, ["doc_id", "parent_id"], "left").join(counts, ["doc_id", "node_id"], "left")
    fault = F.expr(
        """case when parent_id is null and kind != 'Document' then 'no parent' when parent_id is not null and found is null then 'parent missing'
        when pre >= post or pre <= p_pre or post >= p_post then 'order' when depth != p_depth + 1 then 'depth'
        when coalesce(n, 0) != child_count then 'child count' when top + 1 != child_count then 'ordinal' end"""
    )
    return both.select("doc_id", "node_id", fault.alias("fault")).where("fault is not null")


@pytest.mark.parametrize("size", ["7", "10000"])
def test_faults_of_broken_relations(spark, size):
    rng, rows = random.Random(5), []
    for doc in range(60):
        text = b"# a *b* c\n\n- x\n- y `z`\n\n> q\n\n| a | b |\n|--|--|\n| 1 | 2 |\n" * (1 + doc % 3)
        made = p._Rows(None, False, [c.split()[0] for c in SCHEMA.split(", ")])
        made.add(doc, parse(text).root)
        batch = made.batch().to_pylist()
        for _ in range(doc % 7):
            row = rng.choice(batch)
            what = rng.choice([*row, "gone", "twice"])
            if what == "gone" and len(batch) > 1:
                batch.remove(row)
            elif what == "twice":
                batch.append(row | {"pre": row["pre"] + rng.choice([0, 3])})
            elif what == "kind":
                row["kind"] = rng.choice(["Text", "Document", None])
            elif what in row:
                row[what] = rng.choice([None, 0, -1, 2**62 if what in ("node_id", "parent_id", "pre", "post") else 2**30, 7, 1])
        rows += [tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in batch]
    nodes = spark.createDataFrame(rows, SCHEMA).cache()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = views.structure_faults(nodes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = by_joins(nodes).collect()
    assert {r.fault for r in wanted} == set(views.FAULTS)
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def test_the_check_parses_once_and_broadcasts_nothing(spark):
    found = queries.md_structure_faults(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert corpora.part_notes(spark, "/root/testdata/sf0.001").count() and found.count() == 0
