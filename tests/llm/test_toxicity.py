import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import toxicity as t


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    plain = [a + b for a in ("ver", "lin", "tor", "mas", "ple") for b in ("a", "en", "is", "ora", "um", "itas", "el")]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randrange(30, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(3, 9)):
                words.insert(rng.randrange(len(words)), "grux" + rng.choice(plain))  # a beginning that only labels can teach
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "verA lin"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame([*labels, (2000, 1), (6, None), (None, 1)], "doc_id long, toxic int")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    got = t.score(docs, t.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    truth = {i: int(i % 4 == 0) for i in range(700)}
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_labels_of_held_out_rows_do_not_count(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in t.score(docs, t.fit(docs, labels)).collect()}
    b = {r.doc_id: r.score for r in t.score(docs, t.fit(docs, flipped)).collect()}
    assert a == b


def test_without_labels(spark, corpus):
    docs, labels = corpus
    assert {r.score for r in t.score(docs, t.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in t.score(docs, t.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert t.score(docs.limit(0), t.fit(docs.limit(0), labels)).count() == 0


def test_features():
    lexicon = t.Lexicon({"gru": 3.0, "grux": 4.0})
    texts = pa.array(["You are a GRUXEN!! st*pid m0ron", "", None, "plain words here"])
    x = t.features(texts, lexicon)
    assert x.shape == (4, t.FEATURES) and not x[1].any() and not x[2].any()
    assert x[0, 1] == 4 and x[3, 1] == 0
    assert t.cores(pa.array(["st*pid", "m0ron!", "idi0t###", "plain"])).to_pylist() == ["stpid", "moron", "idiot", "plain"]
    one = np.array([t.features(pa.array([s], pa.string()), lexicon)[0] for s in texts.to_pylist()])
    assert np.array_equal(one, x)


def test_isotonic():
    at, rate = t.isotonic(np.array([0.0, 1, 2, 3, 3]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all() and len(at) == 3


def test_trees_learn_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0)).astype(float)
    model = t.grow(x[:2000], y[:2000])
    assert (((t.margins(model, x[2000:]) > 0) == y[2000:]).mean()) > 0.97


def slow_core(word):
    core = word.lower()
    while core and not core[0].isalnum():
        core = core[1:]
    while core and not core[-1].isalnum():
        core = core[:-1]
    return core.translate(t.LEET) if re.search(r"[^\W\d_](?:[^\w\s]|[\d_])+[^\W\d_]", core) else core


def slow_features(text, weights):
    """Every feature of a text, word by word."""
    words = (text or "").split()
    n = max(1, len(words))
    cores = [slow_core(w) for w in words]
    weight = [max([0.0, *(v for k, v in weights.items() if c.startswith(k))]) for c in cores]
    count = max(1, len(words) // t.SPAN)
    windows = [range(k * t.SPAN, (k + 1) * t.SPAN if k < count - 1 else len(words)) for k in range(count)]
    mean_top = lambda values: sum(max((values[i] for i in w), default=0) for w in windows) / count
    out = [sum(weight) / n, mean_top(weight)]
    for level in t.LEVELS:
        hit = [float(w >= level) for w in weight]
        out += [sum(hit) / n, mean_top(hit)]
    insult = [float(c in t.INSULTS) for c in cores]
    out += [sum(insult) / n, mean_top(insult)]
    bad = [i for i, w in enumerate(weight) if w >= t.LEVELS[2] or insult[i]]
    near = sum(any(cores[j] in t.SECOND_PERSON for j in range(max(0, i - t.NEAR), min(len(words), i + t.NEAR + 1))) for i in bad)
    out += [near / n, near / max(1, len(bad)), sum(c in t.SECOND_PERSON for c in cores) / n]
    chars = max(1, sum(map(len, words)))
    letters = [[c for c in w if c.isalpha()] for w in words]
    out += [sum(c.isupper() for w in words for c in w) / chars, sum(len(x) > 1 and all(c.isupper() for c in x) for x in letters) / n]
    out += [sum(w.count("!") for w in words) / chars, sum(w.count("?") for w in words) / chars]
    out += [sum(not c.isalnum() for w in words for c in w) / chars, sum(bool(re.search("[!?]{2}", w)) for w in words) / n]
    out += [sum(bool(re.search(r"[^\W\d_][0-9@$*!_.\-]+[^\W\d_]", w)) for w in words) / n]
    out += [sum(len(x) == len(w) == 1 for x, w in zip(letters, words, strict=True)) / n, sum(bool(re.search("[#*$%&@]{2}", w)) for w in words) / n]
    return out


def test_features_equal_a_slow_version():
    rng = random.Random(6)
    weights = {"gru": 1.0, "grux": 4.0, "abc": 2.6, "mor": 0.8}
    pool = ["grux", "GRUmbel", "abcde", "m0ron", "MORE!!", "you", "Your", "plain", "i", "a", "what?!", "id*ot", "x-y", "##", "tu", "12", "ÀÉ", "été.", "st_upid", "4u"]
    texts = [" ".join(rng.choices(pool, k=n)) for n in (1, 2, 7, 49, 50, 51, 99, 100, 120, 400) for _ in range(3)]
    got = t.features(pa.array([*texts, None, ""]), t.Lexicon(weights))
    for row, text in zip(got, [*texts, None, ""], strict=True):
        assert row == pytest.approx(slow_features(text, weights)), text


def test_trees_and_scores_equal_a_slow_version():
    rng = np.random.default_rng(4)
    x = rng.random((400, t.FEATURES)).round(2)
    y = (x[:, 2] + x[:, 5] > 1).astype(float)
    model = t.grow(x, y)

    def slow_margin(row):
        total = model["start"]
        for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
            node = 0
            for _ in range(t.DEPTH):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            total += leaf[node - (2**t.DEPTH - 1)]
        return total

    assert t.margins(model, x) == pytest.approx([slow_margin(r) for r in x])
    # the first tree's leaves are what its rows' gradients say, and its first cut is the best of all
    node = np.array([0] * len(x))
    for _ in range(t.DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), model["feature"][0][node]] > model["cut"][0][node])
    p = y.mean()
    for k in np.unique(node):
        own = y[node == k]
        assert model["leaf"][0][k - (2**t.DEPTH - 1)] == pytest.approx(t.RATE * (own - p).sum() / (p * (1 - p) * len(own) + 1))
    gain = lambda m: (y[m] - p).sum() ** 2 / (p * (1 - p) * m.sum() + 1) if t.LEAST <= m.sum() <= len(y) - t.LEAST else -1
    best = max(gain(x[:, j] <= c) + gain(x[:, j] > c) for j in range(x.shape[1]) for c in t._cuts(x[:, j]))
    left = x[:, model["feature"][0][0]] <= model["cut"][0][0]
    assert gain(left) + gain(~left) == pytest.approx(best)


def test_scores_do_not_hang_on_length(spark, corpus):
    docs, labels = corpus
    model = t.fit(docs, labels)
    rng = random.Random(3)
    plain = [a + b for a in ("ver", "lin", "tor", "mas", "ple") for b in ("a", "en", "is", "ora", "um", "itas", "el")]
    for n in (10, 90, 500, 2_000, 20_000, 100_000):
        clean = [rng.choice(plain) for _ in range(n)]
        toxic = ["grux" + w if rng.random() < 0.1 else w for w in clean[1:]] + ["gruxora"]
        a, b = t.predict(model, pa.array([" ".join(clean) + ".", " ".join(toxic) + "."]))
        assert a < 0.5 < b, n
