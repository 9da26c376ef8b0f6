"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of words whose beginnings mark toxic training texts (a lexicon with weights, learned
from labels) and of a few fixed insults, in how many of the text's windows of SPAN words such words stand, how many of them
are near second-person words, capitals, punctuation and obfuscation rates. All are rates and none grows with the length
of a text. They are computed once per distinct word of an Arrow slice and summed over the text.

Learning uses about MAX_TRAIN labelled rows (a documented bound; chosen by a hash of the id, never those whose
crc32(doc_id as text) mod 5 is 0). The lexicon counts beginnings of words per fold, summed in Spark; a row's features
for training use the lexicon of the other folds, so the trees see it as it is on new text. Trees are grown in numpy on
the driver on FEATURES numbers a row; the last fold calibrates. The model (some 100 kB) goes to the executors with the
task; nothing that grows with the corpus is collected or broadcast.

Defined results: null and empty texts have all features 0 and get a score like any other text. With no usable labels,
or of one class only, every score is the share of label 1 (0 without labels). Repeated rows get repeated results; a null
doc_id is not held out. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import Words, crc32_of_id, join_bounded, map_arrow, slices, stored, table

FOLDS = 5
#: Labelled rows that the model is fitted on, in expectation.
MAX_TRAIN = 20_000
#: Parts of the training rows: lexicon and trees are crossed over these; the last one calibrates.
PARTS = 5
PREFIXES = range(3, 10)
MIN_DOCS = 4
MAX_LEXICON = 20_000
NEAR = 5
#: Words of a window; the last one of a text takes what is left over.
SPAN = 50
#: Bytes of text whose features are computed at once.
SLICE = 2 << 20
TREES, DEPTH, RATE, BINS, LEAST = 150, 3, 0.1, 48, 8

#: Common insults, and second-person words of the corpus' languages.
INSULTS = "clown disgusting dumb fool idiot imbecile loser moron pathetic scum stupid trash ugly worthless".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros vuestro".split()
#: What stands for a letter in an obfuscated word.
LEET = str.maketrans("013457@$!", "oieastasi", "*_.-")


def _regex_hits(vocabulary: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(vocabulary, pattern).to_numpy(zero_copy_only=False)


def cores(vocabulary: pa.Array) -> pa.Array:
    """Words in lower case without outer punctuation; letters inside restored where symbols stand for them."""
    core = pc.replace_substring_regex(pc.utf8_lower(vocabulary), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    odd = _regex_hits(core, r"\p{L}[^\p{L}\s]+\p{L}")
    if not odd.any():
        return core
    plain = pa.array([x.translate(LEET) for x in core.filter(pa.array(odd)).to_pylist()], pa.string())
    return pc.replace_with_mask(core, pa.array(odd), plain)


class Lexicon:
    """Beginnings of words and their weights."""

    def __init__(self, weights: dict[str, float]):
        self.by_size = {}
        for k in PREFIXES:
            found = {x: w for x, w in weights.items() if len(x) == k}
            if found:
                self.by_size[k] = (pa.array(list(found)), np.array([*found.values(), 0.0]))

    def weights(self, core: pa.Array) -> np.ndarray:
        """The largest weight of a beginning of each word, 0 if it has none."""
        best = np.zeros(len(core))
        for k, (known, weight) in self.by_size.items():
            at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(core, 0, k), known), -1).to_numpy()
            best = np.maximum(best, weight[at])
        return best


LEVELS = (0.7, 1.5, 2.5, 3.5)
FEATURES = 2 + 2 * len(LEVELS) + 2 + 3 + 2 + 4 + 3


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    texts = pc.fill_null(texts, "")
    words, rows = Words(texts, lower=False), len(texts)
    n = words.counts
    row, vocabulary = np.repeat(np.arange(rows), n), words.vocabulary
    core = cores(vocabulary)
    size = pc.utf8_length(vocabulary).to_numpy()

    def total(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(row, per_word[words.codes], rows)

    one, chars = np.maximum(n, 1), np.maximum(total(size), 1)
    windows = np.maximum(n // SPAN, 1)
    ends = np.cumsum(windows)
    place = np.arange(len(row)) - words.offsets[row]
    window = (ends - windows)[row] + np.minimum(place // SPAN, windows[row] - 1)

    def window_mean(per_word: np.ndarray) -> np.ndarray:
        """Mean over a text's windows of the largest value in each."""
        top = np.zeros(ends[-1] if rows else 0)
        np.maximum.at(top, window, per_word[words.codes])
        return np.bincount(np.repeat(np.arange(rows), windows), top, rows) / windows

    weight = lexicon.weights(core)
    out = [total(weight) / one, window_mean(weight)]
    for level in LEVELS:
        out += [total(weight >= level) / one, window_mean(weight >= level)]
    insult = pc.is_in(core, pa.array(INSULTS)).to_numpy(zero_copy_only=False)
    out += [total(insult) / one, window_mean(insult)]

    person = pc.is_in(core, pa.array(SECOND_PERSON)).to_numpy(zero_copy_only=False)
    bad = (insult | (weight >= LEVELS[2]))[words.codes]
    at, so_far = np.flatnonzero(bad), np.concatenate([[0], np.cumsum(person[words.codes])])
    low = np.maximum(at - NEAR, words.offsets[row[at]])
    high = np.minimum(at + NEAR + 1, words.offsets[row[at] + 1])
    near = np.bincount(row[at], so_far[high] > so_far[low], rows)
    out += [near / one, near / np.maximum(np.bincount(row[at], minlength=rows), 1), total(person) / one]

    capitals = pc.count_substring_regex(vocabulary, r"\p{Lu}").to_numpy()
    letters = pc.count_substring_regex(vocabulary, r"\p{L}").to_numpy()
    out += [total(capitals) / chars, total((capitals == letters) & (letters > 1)) / one]
    for pattern in (r"!", r"\?", r"[^\p{L}\p{N}]"):
        out.append(total(pc.count_substring_regex(vocabulary, pattern).to_numpy()) / chars)
    out.append(total(_regex_hits(vocabulary, r"[!?]{2}")) / one)
    obfuscated = _regex_hits(vocabulary, r"\p{L}[0-9@$*!_.\-]+\p{L}")
    out += [total(obfuscated) / one, total((letters == 1) & (size == 1)) / one, total(_regex_hits(vocabulary, r"[#*$%&@]{2}")) / one]
    return np.stack(out, axis=1)


# -- the lexicon ------------------------------------------------------------------------------------------------------


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each beginning of a word, by part and label."""
    counted: dict[tuple[int, int], Counter] = {}
    for part in slices(batches, "text", SLICE):
        words = Words(part.column("text"), lower=False)
        core = cores(words.vocabulary)
        spelled = core.to_pylist()
        labels = zip(part.column("part").to_pylist(), part.column("toxic").to_pylist(), strict=True)
        for i, key in enumerate(labels):
            cores_here = {spelled[c] for c in np.unique(words.codes[words.offsets[i] : words.offsets[i + 1]])}
            counted.setdefault(key, Counter()).update({x[:k] for x in cores_here for k in PREFIXES if len(x) >= k})
        if sum(map(len, counted.values())) > 500_000:
            yield from _sent(counted)
            counted = {}
    yield from _sent(counted)


def _sent(counted: dict[tuple[int, int], Counter]) -> Iterator[pa.RecordBatch]:
    for (part, toxic), found in counted.items():
        if found:
            size = len(found)
            columns = [pa.array(list(found)), pa.array([part] * size, pa.int32()), pa.array([toxic] * size, pa.int32()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["prefix", "part", "toxic", "n"])


def _lexicon(counts: list, sizes: np.ndarray, skip: int | None) -> Lexicon:
    """Log odds of the beginnings that are commoner in toxic documents, over all parts but one."""
    use = [p for p in range(PARTS) if p != skip]
    with_1, with_0 = sizes[use, 1].sum(), sizes[use, 0].sum()
    found: dict[str, float] = {}
    for prefix, ones, zeros in counts:
        one, zero = sum(ones[p] for p in use), sum(zeros[p] for p in use)
        if one >= MIN_DOCS:
            odds = np.log((one + 0.5) / (with_1 + 1)) - np.log((zero + 0.5) / (with_0 + 1))
            if odds > LEVELS[0] / 2:
                found[prefix] = float(odds)
    best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:MAX_LEXICON]
    return Lexicon(dict(best))


# -- trees ------------------------------------------------------------------------------------------------------------


def _cuts(values: np.ndarray) -> np.ndarray:
    """Halfway between neighbours among the values, at quantiles: a rate just above 0 is on the side of 0."""
    known = np.unique(values)
    at = np.unique(np.searchsorted(known, np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")))
    at = at[at < len(known) - 1]
    return (known[at] + known[at + 1]) / 2


def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees of depth DEPTH for logistic loss, on binned features; arrays of split features, cuts and leaves."""
    cuts = [_cuts(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), start)
    feature = np.zeros((TREES, 2**DEPTH - 1), np.int32)
    cut = np.full((TREES, 2**DEPTH - 1), np.inf)
    leaf = np.zeros((TREES, 2**DEPTH))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            nodes = 2**depth
            gain = np.full(nodes, 1e-6)
            split = np.full((nodes, 2), -1, np.int64)
            n_all = np.bincount(node, minlength=nodes)
            g_all, h_all = (np.bincount(node, v, nodes) for v in (g, h))
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                cell = node * width + binned[:, j]
                n_l, g_l, h_l = (np.cumsum(np.bincount(cell, v, nodes * width).reshape(nodes, width), axis=1)[:, :-1] for v in (np.ones(len(y)), g, h))
                better = g_l**2 / (h_l + 1) + (g_all[:, None] - g_l) ** 2 / (h_all[:, None] - h_l + 1) - (g_all**2 / (h_all + 1))[:, None]
                better[(n_l < LEAST) | (n_all[:, None] - n_l < LEAST)] = 0
                at = better.argmax(axis=1)
                top = better[np.arange(nodes), at]
                won = top > gain
                gain[won], split[won, 0], split[won, 1] = top[won], j, at[won]
            base = nodes - 1
            go_right = np.zeros(len(y), bool)
            for k in range(nodes):
                j, b = split[k]
                if j >= 0:
                    feature[t, base + k], cut[t, base + k] = j, cuts[j][b]
                    here = node == k
                    go_right[here] = binned[here, j] > b
            node = 2 * node + go_right
        leaf[t] = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
        margin += leaf[t][node]
    return {"start": start, "feature": feature, "cut": cut, "leaf": leaf}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            at = 2**depth - 1 + node
            node = 2 * node + (x[rows, feature[at]] > cut[at])
        out += leaf[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the rates there, both rising; equal margins are one point."""
    points, inverse = np.unique(margin, return_inverse=True)
    weight, ones = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    pools: list[list[float]] = []
    for x, w, o in zip(points, weight, ones, strict=True):
        pools.append([x * w, w, o])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at = np.array([p[0] / p[1] for p in pools])
    rate = np.array([(p[2] + 0.05) / (p[1] + 0.1) for p in pools])
    return at, np.maximum.accumulate(rate)


# -- fitting and scoring ----------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch], lexicons: bytes) -> Iterator[pa.RecordBatch]:
    by_part = pickle.loads(lexicons)
    for part in slices(batches, "text", SLICE):
        parts = part.column("part").to_numpy()
        x = np.zeros((len(part), FEATURES))
        for p in np.unique(parts):
            x[parts == p] = features(part.column("text").filter(pa.array(parts == p)), by_part[p])
        yield pa.RecordBatch.from_arrays([part.column("part"), part.column("toxic"), pa.array(list(x))], ["part", "toxic", "x"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, part) of about MAX_TRAIN labelled documents that are not held out; stored."""
    usable = labels.where(F.col("toxic").isin(0, 1) & (crc32_of_id(F.col("doc_id")) % FOLDS != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, MAX_TRAIN / max(1, usable.count()))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chosen = usable.where(spread < share * 1_000_003).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PARTS)).cast("int"))
    return stored(join_bounded(docs.select("doc_id", "text"), chosen, "doc_id", "inner").select("text", "toxic", "part"), "toxicity-train")


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from documents (doc_id, text) and labels (doc_id, toxic)."""
    train = training_rows(docs, labels)
    sizes = np.zeros((PARTS, 2))
    for r in train.groupBy("part", "toxic").count().collect():
        sizes[r["part"], r["toxic"]] = r["count"]
    if not sizes[:, 0].sum() or not sizes[:, 1].sum():
        return {"constant": float(sizes[:, 1].sum() / max(1, sizes.sum()))}
    sums = map_arrow(train, _beginnings, "prefix string, part int, toxic int, n long").groupBy("prefix").agg(
        *(F.sum(F.when((F.col("part") == p) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{t}{p}") for t in (0, 1) for p in range(PARTS))
    )
    ones = sum(F.col(f"n1{p}") for p in range(PARTS))
    zeros = sum(F.col(f"n0{p}") for p in range(PARTS))
    ratio = float(sizes[:, 0].sum() / sizes[:, 1].sum())
    likely = sums.where((ones >= MIN_DOCS) & (ones * ratio > zeros * 1.2)).orderBy(F.desc(ones / (zeros + 1)), "prefix").limit(4 * MAX_LEXICON)
    counts = [(r.prefix, [r[f"n1{p}"] for p in range(PARTS)], [r[f"n0{p}"] for p in range(PARTS)]) for r in likely.collect()]
    crossed = pickle.dumps([_lexicon(counts, sizes, p) for p in range(PARTS)])
    table_ = map_arrow(train, partial(_rows, lexicons=crossed), "part int, toxic int, x array<double>").toArrow()
    part, y = table_.column("part").to_numpy(), table_.column("toxic").to_numpy().astype(float)
    x = np.stack(table_.column("x").to_numpy()) if len(y) else np.zeros((0, FEATURES))
    order = np.lexsort((*x.T, y, part))  # the same model however the rows came
    part, y, x = part[order], y[order], x[order]
    last = part == PARTS - 1
    grown = ~last if 0 < y[~last].sum() < (~last).sum() and last.any() else np.ones(len(y), bool)
    trees = grow(x[grown], y[grown])
    check = last if last.any() else grown
    at, rate = isotonic(margins(trees, x[check]), y[check])
    return {"lexicon": _lexicon(counts, sizes, None), "trees": trees, "at": at, "rate": rate}


def predict(model: dict, texts: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    margin = margins(model["trees"], features(texts, model["lexicon"]))
    return np.clip(np.interp(margin, model["at"], model["rate"]), 0, 1)


def _scores(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    fitted = pickle.loads(model)
    for part in slices(batches, "text", SLICE):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(predict(fitted, part.column("text")))], ["doc_id", "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs` (doc_id, text)."""
    scored = map_arrow(docs.select("doc_id", "text"), partial(_scores, model=pickle.dumps(model)), "doc_id long, score double")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns as they are; the model learns from `docs`."""
    model = pickle.dumps(fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model)
        for part in slices(batches, "text", SLICE):
            yield part.filter(pa.array(predict(fitted, part.column("text")) < 0.5))

    return map_arrow(docs, passing, docs.schema)
