import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import quality_rules as q
from inkstrata.llm._common import Words


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(w.count(c) for w in words for c in "#*$%&|<>"), dup, len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c#|.", max_size=40)), min_size=1, max_size=6))
def test_base_counts(texts):
    got = q.judge(pa.array(texts, pa.string()), np.zeros(q.BUCKETS))
    columns = zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
    assert list(columns) == [slow(t) for t in texts]


def test_verdicts(spark):
    clean = " ".join(f"word{i} and more{i} things" for i in range(40))
    junk = " ".join(f"word{i}### and*** more{i}$$$ |" for i in range(40))
    rows = [(i, clean + f" {i}") for i in range(30)] + [(50 + i, junk) for i in range(4)] + [(90, None), (91, ""), (92, "a " * 100), (None, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in q.score(docs, q.fit(docs, spark.createDataFrame([(i,) for i in range(10)], "doc_id long"))).collect()}
    assert all(got[i].kept for i in range(30)) and got[None].kept
    assert not any(got[i].kept for i in (50, 51, 90, 91, 92))
    assert got[50].base_failed is False and got[92].base_failed
    flat = q.fit(docs, spark.createDataFrame([], "doc_id long"))
    assert not flat.any()
    assert q.score(docs.limit(0), flat).count() == 0


def test_score_is_mean_of_bucket_ratios():
    ratio = np.random.default_rng(0).normal(size=q.BUCKETS)
    texts = pa.array(["One two, two three!", "", None])
    cells, row = q.grams(Words(texts, lower=False))
    got = q.judge(texts, ratio)["score"]
    assert got[0] == pytest.approx(ratio[cells[row == 0]].mean()) and got[1] == got[2] == 0
