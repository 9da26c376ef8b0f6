"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one of the trusted documents (label quality = 1), one of all
documents. A document's log importance weight is the sum over its n-grams of log(p_target / p_raw), both smoothed by
ALPHA a bucket. Adding Gumbel noise to the log weights and taking the k largest draws k documents without replacement
in proportion to their weights; the noise is a hash of the id, so a rerun draws the same.

k is SHARE of the rows. The k-th largest key is found in four passes over a stored table of keys, each a histogram of
at most 65,536 cells of 16 bits of the key, so no global sort is needed and no rows are collected.

Defined results: null and empty texts have no n-grams and weight 0. Rows whose key equals the k-th largest (repeated
rows) are all selected. Without target documents the weights are 0 and the noise alone decides. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import Words, map_arrow, slices, stored, table
from inkstrata.llm.quality_rules import BUCKETS, counts, grams, trusted_ids

SHARE = 0.8
ALPHA = 1.0
SEED = 20_251
KEYED = "doc_id long, n_grams long, log_weight double, key double, ordered long"


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def ordered(keys: np.ndarray) -> np.ndarray:
    """Longs that sort as the doubles do."""
    bits = (keys + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def weights(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and log importance weight of each text."""
    cells, row = grams(Words(texts, lower=False))
    return np.bincount(row, minlength=len(texts)), np.bincount(row, ratio[cells], len(texts))


def _keys(batches: Iterator[pa.RecordBatch], ratio: bytes) -> Iterator[pa.RecordBatch]:
    by_bucket = np.frombuffer(ratio)
    for part in slices(batches, "text"):
        n, weight = weights(part.column("text"), by_bucket)
        uniform = ((part.column("noise").to_numpy().astype(np.int64) & ((1 << 52) - 1)) + 0.5) / (1 << 52)
        key = weight - np.log(-np.log(uniform))
        columns = [part.column("doc_id"), pa.array(n), pa.array(weight), pa.array(key), pa.array(ordered(key))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_grams", "log_weight", "key", "ordered"])


def kth_largest(rows: DataFrame, k: int) -> int | None:
    """The k-th largest value of the long column `ordered`, by 16 bits at a time; None if there are fewer rows."""
    high, left = 0, k
    for shift in (48, 32, 16, 0):
        here = rows.where(F.shiftright("ordered", shift + 16) == high) if shift < 48 else rows
        digit = F.shiftright("ordered", shift) if shift == 48 else F.shiftright("ordered", shift).bitwiseAND(F.lit(0xFFFF))
        cells = here.groupBy(digit.alias("digit")).count().collect()
        for cell in sorted(cells, key=lambda r: -r.digit):
            if left <= cell["count"]:
                break
            left -= cell["count"]
        else:
            return None
        high = (high << 16) + cell.digit if shift < 48 else cell.digit
    return high


def resample(docs: DataFrame, trusted: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, selected), one row per row of `docs` (doc_id, text)."""
    ratio = log_ratio(*counts(docs, trusted)).tobytes()
    noise = F.xxhash64(F.col("doc_id"), F.lit(SEED)).alias("noise")
    keyed = stored(map_arrow(docs.select("doc_id", "text", noise), partial(_keys, ratio=ratio), KEYED), "importance")
    k = math.ceil(share * keyed.count())
    least = kth_largest(keyed, k) if k else None
    return keyed.select("doc_id", "n_grams", "log_weight", "key", (F.col("ordered") >= least if least is not None else F.lit(False)).alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), trusted_ids(spark, sf_dir))
