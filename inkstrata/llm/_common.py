"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that are worked on at once within an Arrow batch; bounds the memory of a Python worker.
SLICE_BYTES = 8 << 20
BATCH_ROWS = 1000
#: Tasks that one hot key's rows are dealt over.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; extra columns of the files are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder path below the folder that driver and executors share (spark.checkpoint.dir)."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = context._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if base is None:  # as in tests: one machine and no setting
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/inkstrata-checkpoints"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_salted(left: DataFrame, right: DataFrame, on: str, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on a key of which `left` may have very many rows (dealt by `spread` over `salts` tasks) and `right` has few."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [on, "_salt"], how).drop("_salt")


def _bytes(field: T.StructField) -> Column:
    """About how many bytes of a row a column takes."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        strings = isinstance(kind.elementType, (T.StringType, T.BinaryType))
        own = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + (F.coalesce(F.octet_length(x), F.lit(0)) + 16 if strings else F.lit(64)))
        return F.coalesce(own, F.lit(0)) + 16
    return F.lit(64 if isinstance(kind, T.StructType) else 16)


def is_small(df: DataFrame, max_rows: int = 500_000, max_bytes: int = 128 << 20) -> bool:
    """Whether a frame has at most so many rows and bytes, by one pass that stops at the bound."""
    if not df.columns:
        return True
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0))
    n, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def join_bounded(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str, max_rows: int = 500_000) -> DataFrame:
    """Join that broadcasts `right` only when its rows and bytes are shown to be few (`is_small`), and shuffles otherwise."""
    return left.join(F.broadcast(right) if is_small(right, max_rows) else right, on, how)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. `lower` has a fast path for ASCII and would change other letters, so it serves ASCII texts alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows, so that a batch of long texts fits beside an executor's heap."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:  # read when a plan is made, so it can't be put back here
        spark.conf.set(key, BATCH_ROWS)
    return df.mapInArrow(function, schema)


class Words:
    """White-space separated words of a run of texts: codes into a vocabulary, and the offsets of each text's words."""

    __slots__ = ("codes", "offsets", "vocabulary")

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        some = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)])
        coded = flat.filter(some).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.vocabulary = coded.dictionary
        self.offsets = kept[offsets]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


@cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def _give_back() -> None:
    """Return freed memory to the system: a worker shares an executor's memory with others and with the heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `limit` bytes together, over the ends of batches; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = total[start - 1] if start else 0
            end = int(np.searchsorted(total, base + limit - size, side="right"))
            if end > start or not held:
                end = max(start + 1, end)
                held.append(batch.slice(start, end - start))
                size += int(total[end - 1] - base)
                start = end
            if start < len(sizes):
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
                _give_back()
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


class Recent:
    """A dictionary of what was used lately: at most two generations of `size` entries, the older one dropped when full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def hash64(items: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each byte string."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in items), np.uint64, len(items))


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
