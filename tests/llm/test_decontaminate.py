import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstrata.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(docs, items):
    out = []
    freq = Counter(w for _, text in docs for w in words(text))
    for doc_id, text in docs:
        w, hit, found, near = words(text), set(), set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(13, len(v))
            windows = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1 if k else 0):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found.add(str(item_id))
            n_blocks = max(1, len(v) // 13)
            for block in range(n_blocks if v else 0):
                own = v[13 * block : 13 * block + 13 if block < n_blocks - 1 else len(v)]
                rare = sorted(set(own), key=lambda x: (freq[x], own.index(x)))[: d.NEAR_TERMS]
                need = min(len(rare), d.NEAR_TERMS - d.NEAR_MISSING)
                if any(len(set(rare) & set(w[max(0, p - d.SPAN + 1) : p + 1])) >= need for p in range(len(w)) if w[p] in rare):
                    near.add(item_id)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w), len(near)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    some = ["the", "of", "and", "Rare", "é1", "zig", "zag", "x9"]
    text = lambda n: " ".join(rng.choice(some) + rng.choice(["", ",", ".", " -"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(14)] + [(50, None), (51, " .,"), (52, text(20)), (53, "the " * 40)]
    items += [(60, items[5][1]), (61, items[5][1].upper())]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            v = words(items[rng.randrange(14)][1])
            a = rng.randrange(len(v))
            parts += [" ".join(v[a : a + rng.randrange(1, 25)]), text(rng.randrange(20))]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "\x7f\x00 -"), (103, items[12][1]), (104, "the " * 300)]
    return docs, items


@pytest.mark.parametrize("limit", [d.MAX_BROADCAST, 3])
def test_brute_force(spark, tables, limit, monkeypatch):
    monkeypatch.setattr(d, "MAX_BROADCAST", limit)
    docs, items = tables
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = [tuple(r) for r in d.contamination(frame, bench, near=True).drop("hash").collect()]
    assert sorted(got, key=str) == slow(docs, items)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b"), (7, "B C")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in d.contamination(docs, items).collect()))
    assert got == [(0, 4, 2, 1, True), (1, 3, 2, 1, True), (1, 3, 2, 1, True)]
    assert d.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in d.contamination(docs, items.limit(0)).collect()} == {0}


def test_hits_belong_to_the_row(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(None, f"start {passage} end"), (None, "a clean text of words"), (4, passage), (4, "clean too"), (9, passage + " and" * 2000), (9, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted((r.n_words, r.n_hit) for r in d.contamination(docs, bench).collect())
    assert got == [(2, 0), (2, 0), (5, 0), (15, 15), (17, 15), (2015, 15)]


def test_keep_drops_rows_with_any_window(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(None, passage), (None, "clean"), (4, passage), (4, "clean too"), (9, passage + " and" * 2000), (9, "nothing here"), (10, None), (11, passage[:-17])]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    kept = d.keep(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == [(0, "clean"), (4, "clean too"), (9, "nothing here"), (10, "")]


def test_long_items_and_common_words(spark):
    rng = random.Random(8)
    long_item = [f"w{rng.randrange(3000)}" for _ in range(100_000)]
    docs = [(i, " ".join(long_item[700 * i : 700 * i + 300]) + " the" * 50) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long_item)), (2, "the")], "item_id long, text string")
    got = d.contamination(frame, bench).collect()
    assert {(r.n_words, r.n_hit, r.n_items) for r in got} == {(350, 350, 2)}


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    one_less = item.replace("nine", "neun")
    two_less = one_less.replace("one", "uno")  # two of the four rarest words are missing: no match
    docs = spark.createDataFrame([(1, "x " + " ".join(reversed(item.split()))), (2, "one two and nothing else"), (3, item), (4, one_less), (5, two_less)], "doc_id long, text string")
    items = d.items_of(spark.createDataFrame([(1, item)], "item_id long, text string"))
    index = d.build_index(docs)
    terms = d.item_terms(items, d.frequencies(index, items.select(F.explode("words").alias("term")).distinct()))
    assert {r.doc_id for r in d.proximity_matches(index, terms).collect()} == {1, 3, 4}
    assert {r.doc_id for r in d.phrase_matches(index, terms).collect()} == {3}
