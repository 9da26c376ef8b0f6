"""Scoring by a log-bilinear neural language model, trained in numpy with noise-contrastive estimation.

Tokens are the words of a text and one end. The model predicts the next token from the CONTEXT tokens before it: the
prediction vector is the sum of their context vectors, each scaled by the weights of its position, and a logit is its
product with an output vector plus a bias. The vocabulary is every word that training has MIN_COUNT times or more; each of
its words has its own context vector and its own output. All other words fall in SPELLINGS buckets by their last letters
and punctuation, and within a bucket a word has probability (c + 1) / (N_bucket + V_bucket + 1) from the exact corpus
counts; the bucket keeps one share for words that training has not seen.

Outputs have two exact levels. The first has the units: the end, the OWN most frequent words, the buckets, and the classes
of the rest of the vocabulary, neighbours in frequency with equal sums of root counts, as many as make the least work. The
second tells a class's words apart. Both are normalised by their sums, so every token has a normalised probability.

Training reads every training token, in ROUNDS rounds over a share of the texts each. A round's texts are dealt by a hash over
shards, however the rows lie in files and whatever the cluster has. Each shard trains a copy of the
model from the averages of the round before: it goes over its tokens in minibatches (several times, if the corpus has
fewer than BATCH x STEPS, but not over PASSES), with shared noise samples for the units and a few from the target's class for its words. The
copies send what has changed in packets of rows, which are averaged by how often each row was trained; one that none has
trained keeps its start.

Scale: word counts are exact over all training documents and live in a stored table. Its words of highest count, at most
MAX_HEAD and the whole vocabulary, go to every task and serve most tokens; for the rest, a document's row lists its distinct
words, which are joined to the counts by word and summed by document. The vocabulary's words and parameters (some 200
bytes a word) are what grows on the driver and in each task.

Defined results: a null text is empty; an empty text has the end alone. A null doc_id is not held out. Repeated rows get
repeated results and count repeatedly in training. Without training documents N and V are 0 and all units likewise
likely. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from copy import copy
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import Words, crc32_of_id, map_arrow, slices, stored, table

FOLDS, HELD_OUT = 7, 2
MAX_HEAD = 300_000
OWN, SPELLINGS = 63, 64
UNITS = 1 + OWN + SPELLINGS
#: Training tokens from which on a word has its own vectors.
MIN_COUNT = 100
#: Tokens 0 to UNITS - 1 are units, then comes the start, which only ever stands in a context, then the classes' words.
END, START = 0, UNITS
CONTEXT, SIZE = 4, 24
NOISE, NEAR, BATCH, RATE, SEED = 32, 4, 2048, 0.1, 11
#: Rounds of training, each over its share of the rows (by their text) and from the averaged parameters of the one before.
ROUNDS = 4
#: A round of x times SHARD training tokens trains x ** GROWTH copies of the model: their rows cross the network, so shards
#: grow slowly with the corpus.
SHARD, GROWTH = 1 << 19, 2 / 3
#: Tokens of a minibatch that follow each other; rows of a packet of parameters.
SEGMENT, PACKET = 128, 256
#: Minibatches that training has at least, as far as PASSES over the tokens go.
STEPS, PASSES = 512, 16
#: Tokens that are scored in one matrix product, those whose class words are scored at once, and logits of such a product:
#: products stay within a core's cache.
SCORED, GROUPED, CELLS = 1 << 10, 1 << 18, 1 << 18
#: Bytes of distinct words, by slice, that a task holds at most to sum their counts.
MERGED = 16 << 20

_TAIL = re.compile(r"(\w{0,2})([^\w]*)\Z")


# -- units ------------------------------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def _spelling(end: str) -> int:
    return 1 + OWN + zlib.crc32(repr(_TAIL.search(end).groups()).encode()) % SPELLINGS


def spelling_units(words: pa.Array) -> np.ndarray:
    """The class of each word by its last two letters and its closing punctuation."""
    ends = pc.utf8_slice_codeunits(words, -4, 2**31 - 1).dictionary_encode()
    classes = np.array([_spelling(x) for x in ends.dictionary.to_pylist()], np.int64)
    return classes[ends.indices.to_numpy()] if len(classes) else np.zeros(0, np.int64)


class Vocabulary:
    """What every task needs of the counts: the head words with counts, classes, unit sizes, and the totals N and V.

    The head is sorted by count; `own` is its start, and the words after it of MIN_COUNT or more are those of the classes.
    """

    def __init__(self, head: pa.Array, counts: np.ndarray, own: pa.Array, documents: int):
        self.head, self.counts, self.own, self.documents = head, counts, own, documents
        self.word_counts = counts[len(own) :][counts[len(own) :] >= MIN_COUNT]
        self.class_of, self.class_start = classes_of(self.word_counts, counts.sum() + documents)
        self.outer_of = np.concatenate([np.arange(START + 1), UNITS + self.class_of])
        self.unit_tokens = np.zeros(UNITS + len(self.class_start) - 1)
        self.unit_words = np.zeros(len(self.unit_tokens))
        self.n = self.v = 0

    def places(self, words: pa.Array, first: int | None = None) -> np.ndarray:
        """Places of the words in the head or its `first` words, -1 for others; hashes those at each call, so words should come in bulk."""
        return pc.fill_null(pc.index_in(words, self.head.slice(0, first)), -1).to_numpy()

    def units(self, words: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
        """The token number of each word; `at` are its places, if at hand."""
        own, known = len(self.own), len(self.own) + len(self.word_counts)
        at = self.places(words, known) if at is None else at
        out = np.where(at < own, at + 1, START + 1 + at - own)
        other = np.flatnonzero((at < 0) | (at >= known))
        out[other] = spelling_units(words.take(pa.array(other)))
        return out

    def outer(self, tokens: np.ndarray) -> np.ndarray:
        """The first-level unit of each token."""
        return self.outer_of.take(tokens)

    def head_counts(self, at: np.ndarray) -> np.ndarray:
        """Training counts of the words at these places of the head, -1 for others."""
        return np.append(self.counts, -1)[at]

    def log_shares(self) -> np.ndarray:
        """log10 of what a word's c + 1 is divided by within each bucket; 0 where the model itself gives the word."""
        out = np.zeros(START + 1 + len(self.word_counts))
        out[1 + OWN : UNITS] = np.log10(self.unit_tokens + self.unit_words + 1)[1 + OWN : UNITS]
        return out


def classes_of(counts: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word of descending counts, and where classes start (with the end).

    K classes of equal sums of root counts make K + A / K logits a token, with A the square of the sum of roots of shares.
    """
    if not len(counts):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    roots = np.cumsum(np.sqrt(counts / max(1, tokens)))
    k = int(min(len(counts), np.ceil(roots[-1])))
    of = np.unique(np.minimum((roots / roots[-1] * k).astype(np.int64), k - 1), return_inverse=True)[1]
    return of, np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))


def token_units(words: Words, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the texts' tokens with ends, place in the text, and row of each."""
    counts = words.counts
    sizes = counts + 1
    row = np.repeat(np.arange(len(counts)), sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(row)) - np.repeat(ends - sizes, sizes)
    units = np.full(len(row), END, np.int64)
    units[place < counts[row]] = unit_of[words.codes]
    return units, place, row


def contexts(units: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each token, nearest first."""
    out = np.full((CONTEXT, len(units)), START, np.int32)
    for k in range(min(CONTEXT, len(units))):
        out[k, k + 1 :] = units[: len(units) - k - 1]
        out[k, np.flatnonzero(place <= k)] = START
    return out.T


# -- the model --------------------------------------------------------------------------------------------------------


class Model:
    """Parameters: context vectors r, position weights c, unit vectors q and biases b, class words' vectors w and biases a.

    r and w are trained by rows, with one sum of squares a row.
    """

    NAMES = ("r", "c", "q", "w")  # in flat rows, with the biases after q and w

    def __init__(self, noise: np.ndarray, known: Vocabulary):
        rng = np.random.default_rng(SEED)
        units, words = len(noise), len(known.word_counts)
        self.noise, self.known = noise, known
        self.cumulated, self.shift = np.cumsum(noise) / noise.sum(), np.log(NOISE * noise).astype(np.float32)
        self.r = rng.normal(0, 0.1, (START + 1 + words, SIZE)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (units, SIZE)).astype(np.float32)
        self.w = rng.normal(0, 0.1, (words, SIZE)).astype(np.float32)
        self.c = np.full((CONTEXT, SIZE), 1.0, np.float32) / np.arange(1, CONTEXT + 1, dtype=np.float32)[:, None]
        self.b = np.log(noise).astype(np.float32)
        sums = np.add.reduceat(known.word_counts, known.class_start[:-1]) if words else np.zeros(0)
        self.a = np.log(known.word_counts / sums[known.class_of]).astype(np.float32)
        self.squares = {name: np.full((len(getattr(self, name)), 1) if name in "rw" else getattr(self, name).shape, 1e-4, np.float32) for name in "rcqbwa"}
        self.times = {name: np.zeros(len(getattr(self, name))) for name in self.NAMES}

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, values with biases, and weights of the rows that were trained."""
        at, values, weights, base = [], [], [], 0
        for name in self.NAMES:
            table, times = getattr(self, name), self.times[name]
            bias = {"q": self.b, "w": self.a}.get(name, np.zeros(len(table), np.float32))
            some = np.flatnonzero(times)
            at.append(base + some)
            values.append(np.column_stack([table[some], bias[some]]))
            weights.append(times[some])
            base += len(table)
        return np.concatenate(at), np.concatenate(values), np.concatenate(weights)

    def values(self, at: np.ndarray) -> np.ndarray:
        """The rows at the given places, with biases."""
        out, base = np.zeros((len(at), SIZE + 1), np.float32), 0
        for name in self.NAMES:
            table = getattr(self, name)
            own = (at >= base) & (at < base + len(table))
            out[own, :SIZE] = table[at[own] - base]
            if name in "qw":
                out[own, SIZE] = {"q": self.b, "w": self.a}[name][at[own] - base]
            base += len(table)
        return out

    def add(self, at: np.ndarray, change: np.ndarray) -> None:
        """Add to the rows at the given places what has changed in them."""
        base = 0
        for name in self.NAMES:
            table = getattr(self, name)
            own = (at >= base) & (at < base + len(table))
            table[at[own] - base] += change[own, :SIZE]
            if name in "qw":
                {"q": self.b, "w": self.a}[name][at[own] - base] += change[own, SIZE]
            base += len(table)

    def scorer(self) -> Model:
        """The model without what only training needs."""
        out = copy(self)
        out.squares = out.times = None
        return out

    def _mix(self) -> np.ndarray:
        """The position weights as a matrix, from the context vectors side by side to the prediction."""
        return np.vstack([np.diag(c) for c in self.c])

    def _step(self, name: str, gradient: np.ndarray) -> None:
        squares = self.squares[name]
        squares += gradient * gradient
        getattr(self, name).__iadd__(RATE * gradient / np.sqrt(squares))

    def _step_rows(self, name: str, groups: tuple[np.ndarray, ...], values: np.ndarray, gradient: np.ndarray) -> None:
        """A step of the rows that are grouped: they have the given values, and their gradients are summed by row."""
        order, starts, rows, times = groups
        total = _group_sums(gradient, groups)
        squares = self.squares[name][rows] + (np.square(total) @ _MEAN)[:, None]
        self.squares[name][rows] = squares
        total *= RATE / np.sqrt(squares)
        total += values.take(order[starts], axis=0)
        getattr(self, name).view(_VECTOR)[rows] = total.view(_VECTOR)
        self.times[name][rows] += times

    def train(self, tokens: np.ndarray, place: np.ndarray, rng: np.random.Generator) -> None:
        """One minibatch of noise-contrastive estimation: tell each target from noise, by units and within its class.

        `tokens` has segments of tokens, each with the CONTEXT tokens before its first target, and `place` the targets'
        places in their texts. What follows each other shares context vectors, so that each is read and stepped once.
        """
        n, length = place.shape
        token = tokens[:, CONTEXT:].ravel()
        size, target, units = len(token), self.known.outer(token), len(self.q)
        samples = self.cumulated.searchsorted(rng.random(NOISE), side="right")
        sampled, shift = self.q[samples], self.shift
        # the rows are read once, and a segment's lie flat: operations by position have long runs
        seen = np.append(tokens.ravel(), START)
        groups = _grouped(seen)
        vectors = self.r.take(seen, axis=0)
        flat, first = vectors[:-1].reshape(n, -1), vectors[-1]
        runs = [slice((CONTEXT - 1 - k) * SIZE, (CONTEXT - 1 - k + length) * SIZE) for k in range(CONTEXT)]
        scales = np.broadcast_to(self.c[:, None], (CONTEXT, length, SIZE)).reshape(CONTEXT, -1)
        hidden = flat[:, runs[0]] * scales[0]
        for run, scale in zip(runs[1:], scales[1:], strict=True):
            hidden += flat[:, run] * scale
        hidden = hidden.reshape(size, SIZE)
        # the few that would look beyond their text's start see the start instead
        at = place.ravel()
        early = np.flatnonzero(at < CONTEXT)
        outside = [early[at[early] <= k] for k in range(CONTEXT)]
        inputs = [x + x // length * CONTEXT + CONTEXT - 1 - k for k, x in enumerate(outside)]
        wrong = [first - vectors[x] for x in inputs]
        for k, x in enumerate(outside):
            hidden[x] += wrong[k] * self.c[k]
        own = self.q.take(target, axis=0)
        real = np.einsum("bd,bd->b", hidden, own) + (self.b - shift)[target]
        down = hidden @ sampled.T
        down += self.b[samples] - shift[samples]
        up = (_logistic(-real) / size).astype(np.float32)
        down = _logistic(down)
        down /= size
        back = own
        back *= up[:, None]
        back -= down @ sampled
        both, g_q = np.append(target, samples), np.zeros(self.q.shape, np.float32)
        given = np.empty((len(both), SIZE), np.float32)
        np.multiply(hidden, up[:, None], out=given[:size])
        np.negative(down.T @ hidden, out=given[size:])
        met = _grouped(both)
        g_q[met[2]] = _group_sums(given, met)
        g_b = np.bincount(both, np.append(up, -(np.ones(size, np.float32) @ down)), units).astype(np.float32)
        inner = np.flatnonzero(token > START)
        if len(inner):
            back[inner] += self._train_words(token[inner] - START - 1, hidden[inner], size, rng)
        line, g_r = back.reshape(n, -1), np.zeros(vectors.shape, np.float32)
        g_flat, g_c, product = g_r[:-1].reshape(n, -1), np.empty(self.c.shape, np.float32), np.empty(line.shape, np.float32)
        for k, run in enumerate(runs):
            g_flat[:, run] += np.multiply(line, scales[k], out=product)
            g_c[k] = np.einsum("nl,nl->l", line, flat[:, run]).reshape(length, SIZE).sum(0)
        for k, x in enumerate(outside):
            given = back[x]
            g_c[k] += (given * wrong[k]).sum(0)
            given *= self.c[k]
            g_r[inputs[k]] -= given
            g_r[-1] += given.sum(0)
        for name, gradient in (("q", g_q), ("b", g_b)):
            self._step(name, gradient)
        self._step_rows("r", groups, vectors, g_r)
        self._step("c", g_c)
        self.times["q"] += size
        self.times["c"] += size

    def _train_words(self, word: np.ndarray, hidden: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
        """Tell words from NEAR words each of their classes, which are drawn alike; gives the gradient of `hidden`."""
        of, start = self.known.class_of[word], self.known.class_start
        low = start[of]
        sizes = start[of + 1] - low
        both = np.empty((len(word), NEAR + 1), np.int64)
        both[:, 0] = word
        both[:, 1:] = rng.random((len(word), NEAR)) * sizes[:, None]
        both[:, 1:] += low[:, None]
        order, starts, rows, _ = groups = _grouped(both.ravel())
        vectors = self.w.take(both, axis=0)
        logits = np.einsum("bd,bkd->bk", hidden, vectors)
        logits += self.a.take(both)
        logits -= np.log(NEAR / sizes).astype(np.float32)[:, None]
        gradient = _logistic(logits)
        np.negative(gradient, out=gradient)
        gradient[:, 0] += 1
        gradient /= size
        back = np.einsum("bk,bkd->bd", gradient, vectors)
        given = np.einsum("bk,bd->bkd", gradient, hidden)
        self._step_rows("w", groups, vectors.reshape(-1, SIZE), given.reshape(-1, SIZE))
        total = np.add.reduceat(gradient.ravel()[order], starts)
        squares = self.squares["a"][rows] + total * total
        self.squares["a"][rows] = squares
        self.a[rows] += RATE * total / np.sqrt(squares)
        return back

    def log10_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Normalised over all units, and over the words of the token's class."""
        out, target = np.empty(len(token)), self.known.outer(token)
        units, words = (np.column_stack(x) * _LOG2_E for x in ((self.q, self.b), (self.w, self.a)))
        mix = self._mix()
        for base in range(0, len(token), GROUPED):
            hidden = np.ones((len(token[base : base + GROUPED]), SIZE + 1), np.float32)  # with a one for the bias
            for at in range(base, base + len(hidden), SCORED):
                part = slice(at, min(at + SCORED, base + len(hidden)))
                given = hidden[part.start - base : part.stop - base]
                np.matmul(self.r.take(context[part], axis=0).reshape(len(given), -1), mix, out=given[:, :SIZE])
                out[part] = _log2_softmax(given, units, target[part])
            self._add_words(out[base : base + len(hidden)], hidden, token[base : base + len(hidden)], words)
        return out * np.log10(2)

    def _add_words(self, out: np.ndarray, hidden: np.ndarray, token: np.ndarray, words: np.ndarray) -> None:
        inner = np.flatnonzero(token > START)
        of = self.known.class_of[token[inner] - START - 1]
        inner = inner[np.argsort(of.astype(np.min_scalar_type(len(self.known.class_start))), kind="stable")]
        word, hidden = token[inner] - START - 1, hidden.take(inner, axis=0)
        ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(self.known.class_start) - 1)))
        found = np.empty(len(inner))
        for k in np.flatnonzero(np.diff(ends)):
            low, high = self.known.class_start[k], self.known.class_start[k + 1]
            step = max(1, CELLS // (high - low))
            for at in range(ends[k], ends[k + 1], step):
                part = slice(at, min(at + step, ends[k + 1]))
                found[part] = _log2_softmax(hidden[part], words[low:high], word[part] - low)
        out[inner] += found


#: What makes powers of e powers of two; mean of a row's values, as a product; a row as one item, which is written at once.
_LOG2_E = np.float32(np.log2(np.e))
_MEAN, _VECTOR = np.full(SIZE, 1 / SIZE, np.float32), np.dtype((np.void, 4 * SIZE))


def _log2_softmax(hidden: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Binary logarithm of each row's chosen probability over all of `vectors`; both have the bias as a last column.

    Logits are binary too: numpy takes powers of two in 2/3 of the time of powers of e.
    """
    logits = hidden @ vectors.T
    own = logits.take(np.arange(0, logits.size, len(vectors)) + chosen).astype(np.float64)
    with np.errstate(all="ignore"):
        np.exp2(logits, out=logits)
        sums = (logits @ np.ones(logits.shape[1], np.float32)).astype(np.float64)
        out = own - np.log2(sums)
    far = np.flatnonzero(~((sums > 1e-20) & (sums < 1e30)))  # elsewhere no power that counts overflows or vanishes
    if len(far):
        logits = hidden[far] @ vectors.T
        top = logits.max(axis=1)
        out[far] = own[far] - top - np.log2(np.exp2(logits - top[:, None]).sum(axis=1, dtype=np.float64))
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.clip(x, -30, 30, out=x)
    x *= -_LOG2_E
    np.exp2(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _grouped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by place, where each place starts in it, the places, and how often each occurs."""
    bits = len(at).bit_length()
    keys = np.sort(at << bits | np.arange(len(at)))  # much faster than a stable argsort
    order, ordered = keys & ((1 << bits) - 1), keys >> bits
    first = np.ones(len(at) + 1, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:-1])
    bounds = np.flatnonzero(first)
    return order, bounds[:-1], ordered[bounds[:-1]], np.diff(bounds)


def _group_sums(values: np.ndarray, groups: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sums of the rows that `_grouped` has brought together: most stand alone, so only the rest is added up."""
    order, starts, _, times = groups
    out, several = values.take(order[starts], axis=0), np.flatnonzero(times > 1)
    if len(several):
        rest = np.ones(len(order), bool)
        rest[starts] = False
        more = times[several] - 1
        # as pairs of floats, since reduceat goes column by column
        pairs = np.add.reduceat(values.take(order[rest], axis=0).view(np.complex64), np.cumsum(more) - more, axis=0)
        out[several] += pairs.view(np.float32)
    return out


# -- counting ---------------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in slices(batches, "text"):
        words = Words(part.column("text"))
        if held and size + words.vocabulary.nbytes > MERGED:
            yield _merged(held)
            held, size = [], 0
        held.append((words.vocabulary, np.bincount(words.codes, minlength=len(words.vocabulary))))
        size += words.vocabulary.nbytes
    if held:
        yield _merged(held)


def _merged(held: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """The counts of several slices, summed by word."""
    words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
    n = np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in held]), len(words.dictionary)).astype(np.int64)
    return pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of `docs`; stored."""
    # dealt first: a task has summed its slices, so that another sum before the shuffle would lessen nothing
    rows = map_arrow(docs.select("text"), _word_counts, "word string, n long").repartition("word")
    return stored(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")


def _unit_sizes(batches: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    known = pickle.loads(vocabulary)
    units = len(known.unit_tokens)
    tokens, words = np.zeros(units, np.int64), np.zeros(units, np.int64)
    for part in slices(batches, "word"):  # not by batch: each look-up hashes the whole head
        unit = known.outer(known.units(part.column("word")))
        tokens += np.bincount(unit, part.column("n").to_numpy(), units).astype(np.int64)
        words += np.bincount(unit, minlength=units)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(units)), pa.array(tokens), pa.array(words)], ["unit", "tokens", "words"])


def vocabulary_of(counts: DataFrame, documents: int) -> Vocabulary:
    """The head is every word from the lowest count on (in steps of an eighth of an octave) that leaves at most MAX_HEAD, and the vocabulary."""
    step = F.floor(F.log2("n") * 8)
    steps = sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s)
    left, lowest = MAX_HEAD, None
    for r in steps:
        left -= r["count"]
        if left < 0:
            break
        lowest = r.s
    chosen = F.col("n") >= MIN_COUNT
    head = counts.where(chosen | (step >= lowest) if lowest is not None else chosen).toArrow()
    head = head.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    words, n = head.column("word").combine_chunks(), head.column("n").to_numpy()
    known = Vocabulary(words, n, words.slice(0, OWN), documents)
    sizes = map_arrow(counts, partial(_unit_sizes, vocabulary=pickle.dumps(known)), "unit long, tokens long, words long")
    for r in sizes.groupBy("unit").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        known.unit_tokens[r.unit], known.unit_words[r.unit] = r.tokens, r.words
    known.unit_tokens[END], known.unit_words[END] = documents, documents > 0
    known.n, known.v = int(known.unit_tokens.sum()), int(known.unit_words.sum())
    return known


# -- training ---------------------------------------------------------------------------------------------------------


def new_model(known: Vocabulary) -> Model:
    share = known.unit_tokens + 1
    return Model(share / share.sum(), known)


#: Rows of a packet as they cross the network.
_ROW = np.dtype([("at", "<i8"), ("weight", "<f4"), ("change", "<f2", SIZE + 1)])


def _segments(tokens: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of SEGMENT tokens with the CONTEXT tokens before them, and their places; START and place 0 beyond the end."""
    n = -(-len(tokens) // SEGMENT)
    padded = np.full(CONTEXT + n * SEGMENT, START, np.int64)
    padded[CONTEXT : CONTEXT + len(tokens)] = tokens
    at = np.zeros(n * SEGMENT, np.int64)
    at[: len(place)] = place
    return padded[np.arange(n)[:, None] * SEGMENT + np.arange(CONTEXT + SEGMENT)], at.reshape(n, SEGMENT)


def _train(batches: Iterator[pa.RecordBatch], state: bytes, turn: int, passes: int) -> Iterator[pa.RecordBatch]:
    model, start = pickle.loads(state), pickle.loads(state)
    known = model.known
    rng, seen = np.random.default_rng([SEED, turn, TaskContext.get().partitionId()]), 0
    for part in slices(batches, "text"):
        words = Words(part.column("text"))
        units, place, _ = token_units(words, known.units(words.vocabulary))
        whole = len(units) // SEGMENT * SEGMENT
        segments, places = _segments(units[:whole], place[:whole])
        last = _segments(units[whole:], place[whole:])
        for _ in range(passes):
            order, step = rng.permutation(len(segments)), BATCH // SEGMENT
            for at in range(0, len(segments), step):
                chosen = order[at : at + step]
                model.train(segments[chosen], places[chosen], rng)
            if len(units) > whole:  # what is left over stands alone, without the filling
                left = len(units) - whole
                model.train(last[0][:, : CONTEXT + left], last[1][:, :left], rng)
        seen += len(units)
    if seen:
        at, values, weights = model.rows()
        packed = np.empty(len(at), _ROW)
        packed["at"], packed["weight"] = at, weights
        for base in range(0, len(at), 1 << 16):
            part = slice(base, base + (1 << 16))
            packed["change"][part] = values[part] - start.values(at[part])
        ends = np.append(np.flatnonzero(np.diff(at // PACKET)) + 1, len(at))
        starts = np.append(0, ends[:-1])
        for base in range(0, len(ends), 256):
            some = [(int(at[a] // PACKET), packed[a:b].tobytes()) for a, b in zip(starts[base : base + 256], ends[base : base + 256], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], ["packet", "rows"])


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows of one place, by place."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0, dtype=np.float64)


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the copies' packets, averaged by weight."""
    at, sums = np.zeros(0, np.int64), np.zeros((0, SIZE + 2))
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("rows").to_pylist()), _ROW)
        if len(rows):
            weight = rows["weight"][:, None]
            own = _summed(rows["at"], np.hstack([weight, rows["change"].astype(np.float32) * weight]))
            at, sums = _summed(np.concatenate([at, own[0]]), np.concatenate([sums, own[1]]))
    means = np.column_stack([at, sums[:, 1:] / sums[:, :1]])
    for base in range(0, len(at), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array([means[base : base + (1 << 14)].tobytes()], pa.binary())], ["rows"])


def fit(training: DataFrame, known: Vocabulary) -> Model:
    model = new_model(known)
    copies = max(1, round((known.n / (ROUNDS * SHARD)) ** GROWTH))
    passes = min(PASSES, max(1, -(-BATCH * STEPS // max(1, known.n))))
    hashed = training.select("text", F.xxhash64("text").alias("h"))
    for turn in range(ROUNDS):
        share = hashed.where(F.pmod("h", F.lit(ROUNDS)) == turn)
        dealt = share.repartition(copies, F.pmod(F.xxhash64("h"), F.lit(copies))).sortWithinPartitions("h").select("text")
        trained = map_arrow(dealt, partial(_train, state=pickle.dumps(model), turn=turn, passes=passes), "packet long, rows binary")
        for rows in map_arrow(trained.repartition("packet"), _mean, "rows binary").toArrow().column("rows").to_pylist():
            means = np.frombuffer(rows).reshape(-1, SIZE + 2)
            model.add(means[:, 0].astype(np.int64), means[:, 1:].astype(np.float32))
    return model


# -- scoring ----------------------------------------------------------------------------------------------------------

SCORED_SCHEMA = "doc_id long, hash long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word:string,times:long>>"


def _scored(batches: Iterator[pa.RecordBatch], state: bytes) -> Iterator[pa.RecordBatch]:
    """What the head and the model give of each text, and its distinct words beyond the head."""
    model = pickle.loads(state)
    known = model.known
    all_tokens, shares = np.log10(known.n + known.v + 1), known.log_shares()
    for part in slices(batches, "text"):
        words = Words(part.column("text"))
        at = known.places(words.vocabulary)
        rows, unit_of, count = len(part), known.units(words.vocabulary, at), known.head_counts(at)
        units, place, row = token_units(words, unit_of)
        score = np.bincount(row, model.log10_probabilities(contexts(units, place), units), rows)
        in_head = count >= 0
        mass = np.where(in_head, np.log10(np.maximum(count, 0) + 1.0), 0)
        own = (unit_of <= OWN) | (unit_of > START)
        word_row = np.repeat(np.arange(rows), words.counts)
        score += np.bincount(word_row, np.where(own, 0, mass - shares[unit_of])[words.codes], rows)
        n_tokens = words.counts + 1
        base = np.bincount(word_row, mass[words.codes], rows) + np.log10(known.documents + 1) - n_tokens * all_tokens
        n_known = np.bincount(word_row, in_head[words.codes], rows).astype(np.int64) + (known.documents > 0)
        beyond, width = ~in_head[words.codes], np.int64(max(1, len(words.vocabulary)))
        cell, times = np.unique(word_row[beyond] * width + words.codes[beyond], return_counts=True)
        listed = pa.StructArray.from_arrays([words.vocabulary.take(pa.array(cell % width)), pa.array(times.astype(np.int64))], ["word", "times"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(cell // width, minlength=rows))]).astype(np.int32)
        tail = pa.ListArray.from_arrays(pa.array(ends), listed)
        columns = [part.column("doc_id"), part.column("hash"), part.column("held_out"), *map(pa.array, (n_tokens, n_known, base, score)), tail]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "held_out", "n_tokens", "n_known", "base", "score", "tail"])


def scores(docs: DataFrame, counts: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """One row per row of `docs` (doc_id, text, held_out)."""
    keyed = docs.select("doc_id", "text", "held_out", F.xxhash64("text").alias("hash"))
    heads = stored(map_arrow(keyed, partial(_scored, state=pickle.dumps(model.scorer())), SCORED_SCHEMA), "scored")
    # copies of a row have the same words: the sums of one of them serve all
    words = heads.select("doc_id", "hash", F.explode("tail").alias("w")).select("doc_id", "hash", "w.word", "w.times")
    once = words.groupBy("doc_id", "hash", "word").agg(F.first("times").alias("times")) if _repeats(heads) else words
    found = once.join(counts, "word", "left").select("doc_id", "hash", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = found.groupBy("doc_id", "hash").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("mass"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    both = heads.drop("tail").alias("h").join(sums.alias("t"), (F.col("h.hash") == F.col("t.hash")) & F.col("h.doc_id").eqNullSafe(F.col("t.doc_id")), "left")
    mass = F.coalesce("mass", F.lit(0.0))
    return both.select(
        "h.doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.n).cast("long").alias("train_tokens"), (F.col("base") + mass).alias("base_score"), (F.col("score") + mass).alias("score"),
    )


def _repeats(heads: DataFrame) -> bool:
    """Whether any id has two rows of one text."""
    return heads.groupBy("doc_id", "hash").count().where("count > 1").limit(1).count() > 0


def run(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of `docs` (doc_id, text)."""
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = word_counts(training)
    known = vocabulary_of(counts, training.count())
    return scores(docs, counts, known, fit(training, known))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(table(spark, sf_dir, "documents", "doc_id", "text"))
