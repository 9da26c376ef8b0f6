"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Both sides are multinomials over hashed n-grams. The raw one counts every document, the target one every document
that `labels` marks as good. A document's score is the mean of log(p_target / p_raw) over its n-grams, so it does not
grow with length, and every document is kept or rejected by the same fixed threshold.

Each word gives two symbols: its letters and digits, and its punctuation in order ('' if none). N-grams are the single
symbols and the pairs of neighbouring words' symbols, hashed to BUCKETS cells. The target is smoothed by the raw
multinomial (a Dirichlet prior of weight SMOOTHING x target size), so an n-gram that the target never has scores
log(SMOOTHING / (1 + SMOOTHING)) at worst, at any corpus size.

Defined results: a null or empty text has no words, all counts 0, score 0 and fails the base rules. Repeated rows give
repeated results. Without target documents every score is 0 and the base rules alone decide. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import Words, hash64, join_bounded, map_arrow, slices, table

BUCKETS = 1 << 16
SMOOTHING = 0.1
#: Mean log ratio (natural log) below which a document is rejected.
THRESHOLD = -0.3
MIN_WORDS = 50
#: The symbol characters that the base rules count.
SYMBOLS = "#*$%&|<>"

#: Bytes of text that are judged at once; their n-grams take some thirty times as much.
SLICE = 2 << 20

COUNT_SCHEMA = "bucket int, raw long, target long"
OUT_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def _mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """Bucket of a pair of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def _hashes(strings: pa.Array) -> np.ndarray:
    coded = strings.dictionary_encode()
    return hash64(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the row each belongs to."""
    spelled = pc.utf8_lower(words.vocabulary)
    core = _hashes(pc.replace_substring_regex(spelled, r"[^\p{L}\p{N}]+", ""))
    mark = _hashes(pc.replace_substring_regex(spelled, r"[\p{L}\p{N}]+", ""))
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    inner = row[1:] == row[:-1]
    first, second, zero = words.codes[:-1][inner], words.codes[1:][inner], np.uint64(0)
    buckets = [_mix(core, zero, 1)[words.codes], _mix(mark, zero, 2)[words.codes]]
    buckets += [_mix(core[first], core[second], 3), _mix(mark[first], mark[second], 4)]
    return np.concatenate(buckets), np.concatenate([row, row, row[1:][inner], row[1:][inner]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for part in slices(batches, "text", SLICE):
        cells, row = grams(Words(part.column("text"), lower=False))
        trusted = pc.fill_null(part.column("trusted"), False).to_numpy(zero_copy_only=False)
        raw += np.bincount(cells, minlength=BUCKETS)
        target += np.bincount(cells[trusted[row]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def counts(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each bucket in all of `docs` (doc_id, text), and in those whose ids `trusted` has.

    Tasks send at most BUCKETS sums each into one aggregation; the driver gets the BUCKETS totals.
    """
    ids = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("trusted", F.lit(True))
    marked = join_bounded(docs.select("doc_id", "text"), ids, "doc_id", "left").select("text", "trusted")
    sums = map_arrow(marked, _count, COUNT_SCHEMA).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target, at = np.zeros(BUCKETS), np.zeros(BUCKETS), sums.column("bucket").to_numpy()
    raw[at], target[at] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    return raw, target


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each bucket; `docs` has doc_id and text, `trusted` the ids of good documents."""
    raw, target = counts(docs, trusted)
    if not target.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    prior = SMOOTHING * target.sum()
    return np.log((target + prior * p_raw) / ((target.sum() + prior) * p_raw))


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words in 3-word windows that occur twice or more in it."""
    counts, codes = words.counts, words.codes
    n, rows = len(codes), len(counts)
    if n < 3:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), counts)
    start = np.flatnonzero(row[2:] == row[:-2])
    with np.errstate(over="ignore"):  # equal windows of a text have equal hashes; those are then compared in full
        code, odd = codes.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
        key = ((row[start].astype(np.uint64) * odd + code[start]) * odd + code[start + 1]) * odd + code[start + 2]
    ordered = np.sort(key ^ (key >> np.uint64(31)))
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.zeros(rows, np.int64)
    key = key ^ (key >> np.uint64(31))
    start = start[shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key]
    full = np.stack([row[start], codes[start], codes[start + 1], codes[start + 2]], axis=1)
    _, inverse, times = np.unique(full, axis=0, return_inverse=True, return_counts=True)
    twice = start[times[inverse.ravel()] > 1]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(row[hit], minlength=rows)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, the lines (split at \\n) with a word that equal an earlier line."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = split.offsets.to_numpy()
    lines, rows = split.flatten(), len(texts)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    coded = lines.dictionary_encode()
    key = (row * np.int64(max(1, len(coded.dictionary))) + coded.indices.to_numpy())[worded]
    seen = np.unique(key, return_index=True)[1]
    return np.bincount(row[worded], minlength=rows) - np.bincount(row[worded][seen], minlength=rows)


def judge(texts: pa.Array, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """All columns but doc_id for a run of texts."""
    texts = pc.fill_null(texts, "")
    words = Words(texts, lower=False)
    rows, n_words = len(texts), words.counts
    row = np.repeat(np.arange(rows), n_words)
    chars = pc.utf8_length(words.vocabulary).to_numpy()[words.codes]
    signs = pc.count_substring_regex(words.vocabulary, f"[{SYMBOLS}]").to_numpy()[words.codes]
    cells, at = grams(words)
    size = np.bincount(at, minlength=rows)
    score = np.bincount(at, ratio[cells], rows) / np.maximum(size, 1)
    repeat = repeated_words(words)
    failed = (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": np.bincount(row, chars, rows).astype(np.int64),
        "n_symbols": np.bincount(row, signs, rows).astype(np.int64),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "score": score,
        "kept": ~failed & (score >= THRESHOLD),
    }


def _judged(batches: Iterator[pa.RecordBatch], ratio: bytes) -> Iterator[pa.RecordBatch]:
    table_ = np.frombuffer(ratio)
    for part in slices(batches, "text", SLICE):
        found = judge(part.column("text"), table_)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """One row per row of `docs` (doc_id, text) with the base counts, the score and the verdict."""
    return map_arrow(docs.select("doc_id", "text"), partial(_judged, ratio=ratio.tobytes()), OUT_SCHEMA)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(docs, trusted_ids(spark, sf_dir)))


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns as they are; the counts are those of `docs` itself."""
    ratio = fit(docs, trusted_ids(spark, sf_dir)).tobytes()

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(ratio)
        for part in slices(batches, "text", SLICE):
            yield part.filter(pa.array(judge(part.column("text"), cells)["kept"]))

    return map_arrow(docs, passing, docs.schema)
