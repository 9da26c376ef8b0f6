import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstrata.llm import decontaminate, quality_rules, simhash, toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("sf")
    vocabulary = [a + b + c for a in ("ba", "to", "ri", "mel", "sun") for b in ("no", "ka", "ver", "li") for c in ("", "s", "ta", "dor", "n")]
    prose = lambda n: ". ".join(" ".join(rng.choices(vocabulary, k=9)).capitalize() for _ in range(n // 9 + 1))
    passage = prose(30)
    rows, labels = [], []
    for i in range(240):
        text, toxic, quality = prose(90), 0, 1
        if i % 6 == 0:
            words = text.split()
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "worthless", "idiot", "moron"]))
            text, toxic = " ".join(words), 1
        elif i % 6 == 1:
            text, quality = " ".join(w + rng.choice(["###", "***", "$$$"]) for w in text.split()), 0
        elif i % 12 == 2:
            text = prose(60) + " " + passage
        rows.append((i, text))
        labels.append((i, quality, toxic))
    rows += [(1000 + i, rows[i * 12 + 4][1]) for i in range(10)] + [(2000, None), (2001, ""), (None, prose(80)), (2002, prose(20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, prose(40)), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows)


def test_stages_keep_columns_and_take_effect(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = set(docs.columns)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    now = ids(docs)
    gone = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert set(docs.columns) == start
        gone.append(now - ids(docs))
        now = ids(docs)
    planted = [set(range(0, 240, 6)), {*range(1, 240, 6), 2000, 2001}, {1000 + i for i in range(10)}, set(range(2, 240, 12))]
    for found, wanted in zip(gone, planted, strict=True):
        assert found == wanted
    final = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert ids(final) == now == set(texts) - set().union(*planted)
    assert final.where("not round_trip").count() == 0


def test_run_equals_the_stages(spark, corpus):
    folder, texts = corpus
    got = {r.doc_id: r.n_chars for r in corpus_pipeline.run(spark, folder).collect()}
    assert len(got) == 240 - 40 - 40 - 20 + 2
    assert all(n == len(texts[i]) for i, n in got.items())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for operator in (decontaminate, quality_rules, simhash, toxicity):
        assert operator.query(spark, str(tmp_path)).count() == 0
