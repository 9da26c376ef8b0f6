import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import lbl
from inkstrata.llm._common import Words, crc32_of_id


def tokens(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    first, second = [f"la{i}" for i in range(80)], [f"to{i}er." for i in range(80)]
    out = []
    for i in range(150):
        words = first if i % 2 else second
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120))).title()))
    return [*out, (200, None), (201, ""), (202, " \t"), (None, "la1 la2"), (3, out[3][1]), (3, out[3][1]), (7, "new words\x0bunseen unseen")]


@pytest.mark.parametrize("head", [lbl.MAX_HEAD, 40, 0])
def test_base_and_known(spark, rows, head, monkeypatch):
    monkeypatch.setattr(lbl, "MAX_HEAD", head)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).repartition(3)
    got = lbl.run(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, text in rows:
        if not held(i):
            counts.update([*tokens(text), None])
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for i, text in rows:
        t = [*tokens(text), None]
        wanted.append((i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(wanted, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    if head == lbl.MAX_HEAD:
        scored = [r for r in got if r.held_out]
        assert sum(r.score for r in scored) > sum(r.base_score for r in scored)


def test_score_is_the_models(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(crc32_of_id(F.col("doc_id")) % 7 == 2, F.lit(False)).alias("held_out"))
    training = docs.where("not held_out")
    counts = lbl.word_counts(training)
    known = lbl.vocabulary_of(counts, training.count())
    model = lbl.fit(training, known)
    by_word = {r.word: r.n for r in counts.collect()}
    assert sum(by_word.values()) + training.count() == known.n
    got = {(r.doc_id, r.n_tokens): r.score for r in lbl.scores(docs, counts, known, model).collect()}
    for i, text in rows[:25]:
        words = [w.decode() for w in tokens(text)]
        units = [*known.units(pa.array(words, pa.string())).tolist(), lbl.END] if words else [lbl.END]
        total = 0.0
        for at, unit in enumerate(units):
            context = [units[at - k - 1] if at > k else lbl.START for k in range(lbl.CONTEXT)]
            logits = (model.r[context] * model.c).sum(0) @ model.q.T + model.b
            p = np.exp(logits - logits.max())
            assert abs(p.sum() / p.sum() - 1) < 1e-9
            total += math.log10(p[unit] / p.sum())
            if unit > lbl.OWN:
                total += math.log10((by_word.get(words[at], 0) + 1) / (known.unit_tokens[unit] + known.unit_words[unit] + 1))
        assert got[(i, len(units))] == pytest.approx(total, rel=1e-4)


def test_units_cover_all_words():
    words = Words(pa.array(["a b c. ça x", None, ""]))
    known = lbl.Vocabulary(pa.array(["a"]), np.array([3]), pa.array(["a"]), 2)
    units, place, row = lbl.token_units(words, known.units(words.vocabulary))
    assert row.tolist() == [0] * 6 + [1, 2] and place.tolist() == [0, 1, 2, 3, 4, 5, 0, 0]
    assert units[0] == 1 and units[5] == units[6] == units[7] == lbl.END and (units[1:5] > lbl.OWN).all() and units.max() < lbl.UNITS
    assert lbl.contexts(units, place)[2].tolist() == [units[1], units[0], lbl.START, lbl.START]


def test_empty(spark):
    assert lbl.run(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = lbl.run(spark.createDataFrame([(held, "no training")], "doc_id long, text string")).first()
    assert (only.train_tokens, only.n_known, only.base_score) == (0, 0, 0.0)


def test_words_of_the_vocabulary_have_their_own_outputs(spark):
    rng, pairs = random.Random(1), {f"w{i}us": f"x{i}us" for i in range(400)}  # all of one ending
    texts = [" ".join(f"{a} {pairs[a]}" for a in rng.choices(list(pairs), k=300)) for _ in range(400)]
    training = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    counts = lbl.word_counts(training)
    known = lbl.vocabulary_of(counts, training.count())
    assert len(known.own) + len(known.word_counts) == 800 and len(known.class_start) > 2
    assert known.n == 400 * 601 and known.v == 801
    model = lbl.fit(training, known)
    start = lbl.new_model(known)
    words = [w for w in pairs if known.units(pa.array([w, pairs[w]]))[1] > lbl.START][:50]
    context = np.array([[known.units(pa.array([w]))[0], *[lbl.START] * (lbl.CONTEXT - 1)] for w in words])
    target = known.units(pa.array([pairs[w] for w in words]))
    assert len(set(target.tolist())) == len(words) > 30
    # both levels together are a distribution over all tokens
    every = np.array([*range(lbl.UNITS), *range(lbl.START + 1, len(model.r))])
    p = 10 ** model.log10_probabilities(np.repeat(context[:1], len(every), axis=0), every)
    assert p.sum() == pytest.approx(1, rel=1e-4)
    # the word itself is learned from the word before it
    right, wrong = model.log10_probabilities(context, target), model.log10_probabilities(context, np.roll(target, 1))
    assert right.mean() > start.log10_probabilities(context, target).mean() + 0.05
    assert right.mean() > wrong.mean() + 0.05
    got = lbl.scores(training.limit(3), counts, known, model).collect()
    assert all(math.isfinite(r.score) and r.score > r.base_score for r in got)


def test_training_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    follow = {f"m{i}" : f"n{i}" for i in range(60)}
    texts = [" ".join(f"{a} {follow[a]}" for a in rng.choices(list(follow), k=40)) for _ in range(200)]
    training = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = lbl.word_counts(training)
    known = lbl.vocabulary_of(counts, training.count())
    words = list(follow)
    context = np.array([[known.units(pa.array([w]))[0], *[lbl.START] * (lbl.CONTEXT - 1)] for w in words])
    target = known.units(pa.array([follow[w] for w in words]))
    few, many = (lbl.fit(training.repartition(n), known).log10_probabilities(context, target).mean() for n in (1, 40))
    start = lbl.new_model(known).log10_probabilities(context, target).mean()
    assert few > start + 0.2 and many > start + 0.2 and abs(few - many) < 0.25 * (few - start)


def small_vocabulary():
    words = pa.array([f"w{i}" for i in range(700)])
    known = lbl.Vocabulary(words, np.sort(np.random.default_rng(5).integers(lbl.MIN_COUNT, 9000, 700))[::-1].copy(), words.slice(0, lbl.OWN), 300)
    known.unit_tokens[:] = np.random.default_rng(6).integers(1, 5000, len(known.unit_tokens))
    return known


def test_unit_sizes_look_words_up_in_bulk(monkeypatch):
    known, calls, units = small_vocabulary(), [], lbl.Vocabulary.units
    monkeypatch.setattr(lbl.Vocabulary, "units", lambda self, words, *rest: calls.append(len(words)) or units(self, words, *rest))
    every = pa.array([f"w{i}" for i in range(4000)])
    table = pa.RecordBatch.from_arrays([every, pa.array(np.arange(1, 4001))], ["word", "n"])
    (got,) = lbl._unit_sizes((table.slice(at, 100) for at in range(0, 4000, 100)), lbl.pickle.dumps(known))
    assert calls == [4000]  # the head is hashed at each
    unit = known.outer(units(known, every))
    assert got.column("tokens").to_pylist() == np.bincount(unit, np.arange(1, 4001), len(known.unit_tokens)).tolist()
    assert got.column("words").to_pylist() == np.bincount(unit, minlength=len(known.unit_tokens)).tolist()


@pytest.mark.parametrize(("merged", "batches"), [(1 << 20, 1), (0, 2)])
def test_counts_are_summed_over_slices(merged, batches, monkeypatch):
    monkeypatch.setattr(lbl, "MERGED", merged)
    texts = pa.RecordBatch.from_arrays([pa.array(["One two " * 700_000, None, "two three " * 500_000])], ["text"])
    got, total = list(lbl._word_counts(iter([texts]))), Counter()
    for batch in got:
        total.update(dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)))
    assert len(got) == batches and total == {"one": 700_000, "two": 1_200_000, "three": 500_000}


def slow_minibatch(model, tokens, place, rng):
    """Gradients of a minibatch by its definition, from the contexts of each target; (q, b, r, c, w, a)."""
    sigmoid, known = lambda x: 1 / (1 + np.exp(-x)), model.known
    r, c, q, b, w, a = (getattr(model, name).astype(np.float64) for name in "rcqbwa")
    g = {name: np.zeros(getattr(model, name).shape) for name in "rcqbwa"}
    samples = rng.choice(len(q), lbl.NOISE, p=model.noise)
    shift = np.log(lbl.NOISE * model.noise)
    cases = [(s, i) for s in range(len(tokens)) for i in range(place.shape[1])]
    inner = [int(tokens[s, lbl.CONTEXT + i]) > lbl.START for s, i in cases]
    draws = iter(rng.random((sum(inner), lbl.NEAR)))
    for s, i in cases:
        token = int(tokens[s, lbl.CONTEXT + i])
        context = [int(tokens[s, lbl.CONTEXT + i - k - 1]) if place[s, i] > k else lbl.START for k in range(lbl.CONTEXT)]
        hidden, back = (r[context] * c).sum(0), np.zeros(lbl.SIZE)
        unit = int(known.outer(np.array([token]))[0])
        for at, label, table, bias, offset in [(unit, 1, "q", "b", shift), *((int(x), 0, "q", "b", shift) for x in samples)]:
            error = (label - sigmoid(q[at] @ hidden + b[at] - offset[at])) / len(cases)
            g[table][at] += error * hidden
            g[bias][at] += error
            back += error * q[at]
        if token > lbl.START:
            word = token - lbl.START - 1
            low, high = known.class_start[known.class_of[word]], known.class_start[known.class_of[word] + 1]
            for at, label in [(word, 1), *((low + int(u * (high - low)), 0) for u in next(draws))]:
                error = (label - sigmoid(w[at] @ hidden + a[at] - np.log(lbl.NEAR / (high - low)))) / len(cases)
                g["w"][at] += error * hidden
                g["a"][at] += error
                back += error * w[at]
        for k, at in enumerate(context):
            g["r"][at] += back * c[k]
            g["c"][k] += back * r[at]
    return g


def test_a_minibatch_takes_the_steps_of_its_definition():
    known, rng = small_vocabulary(), np.random.default_rng(7)
    model = lbl.new_model(known)
    tokens = rng.integers(0, len(model.r), (5, lbl.CONTEXT + 40))
    place = np.concatenate([np.arange(n) for n in (1, 2, 7, 60, 1, 129)])[:200].reshape(5, 40)
    g = slow_minibatch(model, tokens, place, np.random.default_rng(8))
    before = {name: getattr(model, name).astype(np.float64) for name in "rcqbwa"}
    squares = {name: model.squares[name].astype(np.float64) for name in "rcqbwa"}
    model.train(tokens, place, np.random.default_rng(8))
    for name in "rcqbwa":
        square = np.square(g[name]).mean(axis=1, keepdims=True) if name in "rw" else np.square(g[name]).reshape(squares[name].shape)
        step = lbl.RATE * g[name] / np.sqrt(squares[name] + square)
        assert np.abs(g[name]).max() > 0
        np.testing.assert_allclose(getattr(model, name), before[name] + step, atol=2e-5)


@pytest.mark.parametrize("scale", [1, 30, 400])
def test_probabilities_of_large_logits(scale):
    known, rng = small_vocabulary(), np.random.default_rng(9)
    model = lbl.new_model(known)
    model.q *= scale
    model.w *= scale
    model.b -= scale
    context, token = rng.integers(0, len(model.r), (500, lbl.CONTEXT)), rng.integers(0, len(model.r), 500)
    token[token == lbl.START] = lbl.END
    got = model.log10_probabilities(context, token)
    hidden = (model.r[context] * model.c).sum(1).astype(np.float64)
    for i, t in enumerate(token):
        logits, unit = model.q.astype(np.float64) @ hidden[i] + model.b, known.outer(np.array([t]))[0]
        wanted = logits[unit] - np.logaddexp.reduce(logits)
        if t > lbl.START:
            k = known.class_of[t - lbl.START - 1]
            low, high = known.class_start[k], known.class_start[k + 1]
            inside = model.w[low:high].astype(np.float64) @ hidden[i] + model.a[low:high]
            wanted += inside[t - lbl.START - 1 - low] - np.logaddexp.reduce(inside)
        assert got[i] == pytest.approx(wanted / np.log(10), rel=1e-4, abs=1e-5 * scale)
