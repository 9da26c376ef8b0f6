import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstrata.llm import pieces as p


def library():
    import sentencepiece

    if not hasattr(library, "model"):
        library.model = sentencepiece.SentencePieceProcessor(model_file=p.model_path())
    return library.model


def check(texts):
    model = p.encoder(p.model_path())
    ids, sizes = model.encode(pa.array(texts, pa.string()))
    at = 0
    for text, size in zip(texts, sizes, strict=True):
        assert ids[at : at + size].tolist() == library().encode(text or "")
        at += size
    assert model.decode(ids, sizes) == [(t or "").replace("▁", " ") for t in texts]


PARTS = st.sampled_from([" ", "  ", "   ", "\n", "\t", "▁", "the", "The", "ing", "tion", "ou", "é", "é", "日本", "　", "😀", "\0", "<s>", "<0x41>", "aaaa", "1234", "...", "=====", "x"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(PARTS, st.text(max_size=5)), max_size=12).map("".join)), min_size=1, max_size=5))
def test_ids_are_the_librarys(texts):
    check([t and t.encode("utf-8", "ignore").decode() for t in texts])


@pytest.mark.parametrize("text", ["a" * 3000, " " * 1000, "abcdefghij" * 500 + "\n" + "==" * 300 + " end", "internationalization" * 60, "▁" * 40 + "x" + " " * 17 + "y", "日本語" * 100])
def test_long_cuts(text):
    check([text, "", text + " tail"])


def test_query(spark):
    rows = [(1, "Hello there, world"), (2, None), (3, ""), (None, "x  y"), (1, "Hello there, world"), (4, "ñ " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = p.encode(docs)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got.collect()) == sorted((i or 0, tuple(library().encode(t or ""))) for i, t in rows)
    assert got.where("not round_trip or n_tokens != size(ids)").count() == 0
    assert sorted((r.doc_id or 0, r.text) for r in p.decode(got).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert p.encode(docs.limit(0)).count() == 0
