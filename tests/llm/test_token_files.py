import heapq
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstrata.llm import token_files as t


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(t.tokenizer_path())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


PIECES = st.sampled_from(["the", "Éau", "ñandú,", "don't", "x's", " ", "\n", "\x0b", " ", "\x85", "###", "a1b22", "ÀÉ", "é", "́", "ß", "ẞ", "İ", "日本", "<|endoftext|>", "a.b", "'ll", "µ", "ª", "😀", "\x1c", "÷", "×"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=4)), max_size=12).map("".join))
def test_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    tok = test_ids_are_the_tokenizers.__dict__.setdefault("tok", Tokenizer.from_file(t.tokenizer_path()))
    text = text.encode("utf-8", "ignore").decode()
    ids, sizes = t.token_ids(pa.array([text, None, text]), t.tokenizer_path())
    assert ids.tolist() == whole(tok, text) + [2] + whole(tok, text)
    assert sizes.tolist() == [len(whole(tok, text)), 1, len(whole(tok, text))]


def huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@pytest.mark.parametrize("n", [1, 2, 3, 40, 3000])
def test_codes(n):
    rng = np.random.default_rng(n)
    counts = np.append((rng.pareto(1, n) * 3 + 1).astype(np.int64), 0)
    lengths = t.code_lengths(counts)
    assert lengths[-1] == 0 and lengths.max() <= t.MAX_BITS
    if n > 1:
        assert (2.0 ** -lengths[:-1].astype(float)).sum() == 1
        assert (lengths * counts).sum() >= huffman_cost(counts)
        if huffman_cost(counts) == (t.code_lengths(counts, 40) * counts).sum():
            assert (lengths * counts).sum() == huffman_cost(counts) or t.code_lengths(counts, 40).max() > t.MAX_BITS
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    limited = t.code_lengths(np.array(fib))
    assert limited.max() == t.MAX_BITS and (2.0 ** -limited.astype(float)).sum() == 1


def test_stream(tmp_path):
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.zipf(1.3, 50_000).clip(max=5000), minlength=5001)
    lengths = t.code_lengths(counts)
    files, base = t.open_fs(f"file://{tmp_path}")
    docs = [np.minimum(rng.zipf(1.3, n), 5000) for n in (1, 255, 256, 257, 0, 9000, 3, 70_000)]
    docs = [d[lengths[d] > 0] for d in docs]
    with t._Output(f"file://{tmp_path}", "x.ink") as out:
        writer = t.Writer(out, lengths)
        for low, high in ((0, 3), (3, 5), (5, 8)):
            part = docs[low:high]
            writer.add(pa.array([None, *range(low + 1, high)], pa.int64()), np.concatenate(part), np.array([len(d) for d in part]))
        writer.close()
    reader = t.Reader(files, f"{base}/x.ink")
    every = np.concatenate(docs)
    assert (reader.ids(0, reader.tokens) == every).all() and reader.tokens == len(every)
    for a, b in ((0, 1), (250, 260), (256, 512), (5000, 60_001)):
        assert (reader.ids(a, b) == every[a:b]).all()
    assert reader.sizes.tolist() == [len(d) for d in docs] and reader.nulls.tolist() == [True, False, False] + [True, False] + [True, False, False]


def test_run(spark, tokenizer):
    rows = [(i * 7 % 101, f"Some words, number {i}! " * (i % 5)) for i in range(60)] + [(None, "no id"), (500, None), (3, "again"), (3, "again"), (-4, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(4)
    got = t.run(docs).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    expected = []
    for doc_id, text in rows:
        ids = whole(tokenizer, text)
        expected.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(expected, key=key)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert t.run(docs.limit(0)).count() == 0
