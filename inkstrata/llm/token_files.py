"""Token ids of documents in canonical, length-limited Huffman files.

1. Every text is encoded once; its ids go to a stored table as they are.
2. The ids of that table are counted: a task sends one sum per id. Code lengths of at most MAX_BITS bits come from the
   global counts by package-merge on the driver (one number per vocabulary entry), the canonical codes from the lengths.
3. The table is sorted by doc_id over range partitions; each task writes one file: the bit stream, then the code lengths,
   each document's id and first token, and the bit offset of every BLOCK-th token, so that blocks decode independently.
4. Files are read back with a table of 2^MAX_BITS entries, all blocks of a run in step.

Texts are split at ASCII white space, over which the tokenizer's own splitting never reaches, and each distinct word is
encoded once per run of texts; the parts of plain words go to the tokenizer's model directly, other words through all of
it. Nothing but the counts and the number of tokens of each file reaches the driver.

Defined results: null texts are empty; an empty text has the end id alone. A null doc_id comes first; rows that share an
id stand together, ordered by a hash of the text. An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm._common import Recent, Words, crc_of_ids, map_arrow, shared_dir, slices, stored, table
from inkstrata.llm.warc import _Output, open_fs

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_BITS = 18
BLOCK = 256
#: Blocks that are decoded in step.
RUN = 8192
CACHED = 150_000
SLICE = 8 << 20
#: Bytes of an id in the stored table.
WIDTH = 2
MAGIC = b"INKTOK01"
_FOOTER = struct.Struct("<QQQQQB")
# Words that the tokenizer splits into one run of letters and one of punctuation.
_LETTERS = "a-zß-öø-ÿ"
_CAPITALS = "A-ZÀ-ÖØ-Þ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = rf"^[{_LETTERS}{_CAPITALS}]*[{_MARKS}]*$"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of words without white space, by the tokenizer at a path; keeps those of recent pieces of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.pieces, self.others = Recent(CACHED), Recent(CACHED // 4)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the usual byte-level alphabet
        others = [b for b in range(256) if b not in printable]
        alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.alphabet = str.maketrans({chr(b): c for b, c in alphabet.items()})

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled)]) if piece else b""

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _through(known: Recent, items: pa.Array, encode) -> tuple[list[bytes], np.ndarray]:
        """Ids of the distinct items, and which of them each item is."""
        coded, out = items.dictionary_encode(), []
        for item in coded.dictionary.to_pylist():
            found = known.get(item)
            if found is None:
                found = encode(item)
                known.put(item, found)
            out.append(found)
        return out, coded.indices.to_numpy()

    def encode(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        plain = pc.match_substring_regex(vocabulary, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        simple = pc.utf8_lower(vocabulary.filter(plain))
        letters, a = self._through(self.pieces, pc.replace_substring_regex(simple, rf"[{_MARKS}]+$", ""), self._piece)
        marks, b = self._through(self.pieces, pc.replace_substring_regex(simple, rf"^[{_LETTERS}]+", ""), self._piece)
        whole, c = self._through(self.others, vocabulary.filter(pc.invert(plain)), self._word)
        every = [*letters, *marks, *whole, b""]
        parts = np.full((len(vocabulary), 2), len(every) - 1, np.int64)  # each word is one or two of them
        parts[is_plain, 0], parts[is_plain, 1] = a, b + len(letters)
        parts[~is_plain, 0] = c + len(letters) + len(marks)
        flat = np.frombuffer(b"".join(every), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, every), np.int64, len(every)) // 4
        return _gathered(flat, sizes, parts.ravel()), sizes[parts].sum(axis=1)


def _gathered(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of `flat`, of the given sizes, in an order."""
    starts, size = np.cumsum(sizes) - sizes, sizes[order]
    return flat[np.repeat(starts[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


@cache
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with their ends, one after another, and how many each text has."""
    words = Words(texts, lower=False)
    ids, sizes = encoder(path).encode(words.vocabulary)
    ids, sizes = np.append(ids, END_ID), np.append(sizes, 1)
    counts = words.counts
    row_end = np.cumsum(counts + 1) - 1
    order = np.full(len(words.codes) + len(counts), len(sizes) - 1, np.int64)
    inner = np.ones(len(order), bool)
    inner[row_end] = False
    order[inner] = words.codes
    per_row = np.add.reduceat(sizes[order], row_end - counts) if len(counts) else np.zeros(0, np.int64)
    return _gathered(ids, sizes, order), per_row


# -- codes ------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, levels = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by_weight = np.argsort(both, kind="stable")
        merged = both[by_weight]
        levels.append(by_weight < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        size = lengths[order].astype(np.int64)
        step = 1 << (int(size[-1]) - size)  # in units of the longest code
        codes[order] = (np.cumsum(step) - step) >> (int(size[-1]) - size)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Big-endian 32-bit words of the codes starting at bit `bit` (below 32) of the first, and each code's bit offset."""
    size = lengths[ids].astype(np.int64)
    at = bit + np.cumsum(size) - size
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    total = bit + int(size.sum())
    out = np.zeros((total >> 5) + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(np.uint32), at


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """Id and code length (low 5 bits) by the next MAX_BITS bits."""
    out, used = np.zeros(1 << MAX_BITS, np.uint32), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    out[: spans.sum()] = np.repeat((order.astype(np.uint32) << 5) | lengths[order], spans)
    return out


def unpack(stream: bytes, starts: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """BLOCK ids from each of the bit offsets, a row each; what follows the last id of a stream is arbitrary."""
    data = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at, last = starts.astype(np.int64), len(window) - 1
    out = np.empty((BLOCK, len(starts)), np.uint32)
    for k in range(BLOCK):
        found = table_[((window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS))]
        out[k] = found >> 5
        at += found & 31
    return out.T


# -- files ------------------------------------------------------------------------------------------------------------


class Writer:
    """Writes one file: the stream as it comes, its indexes at the end."""

    def __init__(self, out, lengths: np.ndarray):
        self.out, self.lengths, self.codes = out, lengths, canonical_codes(lengths)
        self.bits = self.tokens = 0
        self.open = np.uint32(0)
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.checkpoints: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        words, at = pack(ids, self.lengths, self.codes, self.bits & 31)
        words[0] |= self.open
        base = self.bits - (self.bits & 31)
        self.checkpoints.append(base + at[np.arange(-self.tokens % BLOCK, len(ids), BLOCK)])
        self.bits += int(self.lengths[ids].sum(dtype=np.int64))
        full = (self.bits - base) >> 5
        self.out.write(words[:full].astype(">u4").tobytes())
        self.open = words[full]
        self.tokens += len(ids)
        self.doc_ids.append(pc.fill_null(doc_ids, 0).to_numpy())
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.sizes.append(sizes)

    def close(self) -> None:
        self.out.write(np.array([self.open], ">u4").tobytes())
        parts = [
            zlib.compress(self.lengths.tobytes()),
            zlib.compress(np.concatenate(self.doc_ids).astype("<i8").tobytes(), 1),
            zlib.compress(np.packbits(np.concatenate(self.nulls)).tobytes(), 1),
            zlib.compress(np.concatenate(self.sizes).astype("<u4").tobytes(), 1),
            zlib.compress(np.concatenate(self.checkpoints).astype("<u8").tobytes(), 1),
        ]
        for part in parts:
            self.out.write(part)
        self.out.write(struct.pack("<5Q", *map(len, parts)))
        self.out.write(_FOOTER.pack(sum(map(len, self.sizes)), self.tokens, self.bits, 8 + 4 * ((self.bits >> 5) + 1), BLOCK, MAX_BITS))


class Reader:
    """Reads a file by its indexes."""

    def __init__(self, files, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(40 + _FOOTER.size, size - 40 - _FOOTER.size)
        self.documents, self.tokens, self.bits, at, self.block, bits = _FOOTER.unpack(tail[40:])
        if self.file.read_at(8, 0) != MAGIC or self.block != BLOCK or bits != MAX_BITS:
            raise ValueError(f"{path} is not a token file of this format")
        parts = []
        for n in struct.unpack("<5Q", tail[:40]):
            parts.append(zlib.decompress(self.file.read_at(n, at)))
            at += n
        self.table = decode_table(np.frombuffer(parts[0], np.uint8))
        self.doc_ids = np.frombuffer(parts[1], "<i8")
        self.nulls = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=self.documents).astype(bool)
        self.sizes = np.frombuffer(parts[3], "<u4").astype(np.int64)
        self.checkpoints = np.frombuffer(parts[4], "<u8").astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids [first, last) of the file."""
        low, high = first // BLOCK, -(-last // BLOCK)
        out = []
        for at in range(low, high, RUN):
            starts = self.checkpoints[at : min(at + RUN, high)]
            end = self.checkpoints[at + RUN] if at + RUN < len(self.checkpoints) else self.bits
            byte = starts[0] >> 3
            out.append(unpack(self.file.read_at(int((end + 7 >> 3) - byte), 8 + int(byte)), starts - 8 * byte, self.table).ravel())
        whole = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return whole[first - low * BLOCK : last - low * BLOCK]


# -- Spark ------------------------------------------------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE):
        ids, sizes = token_ids(part.column("text"), path)
        ends = np.concatenate([[0], np.cumsum(sizes)]) * WIDTH
        data = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(f"<u{WIDTH}"))])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), data], ["doc_id", "tie", "ids"])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tie, ids) of `docs` (doc_id, text); ids are little-endian integers of WIDTH bytes; stored."""
    if encoder(path).size > 1 << 8 * WIDTH:
        raise ValueError("the vocabulary is too large")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return stored(map_arrow(keyed, partial(_encode, path=path), "doc_id long, tie long, ids binary"), "ids", compression="zstd")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binaries, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], f"<u{WIDTH}", (offsets[-1] - offsets[0]) // WIDTH, offsets[0])
    return data.astype(np.int64), np.diff(offsets) // WIDTH


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for part in slices(batches, "ids", SLICE):
        total += np.bincount(_ids(part.column("ids"))[0], minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all rows."""
    sums = map_arrow(rows.select("ids"), partial(_count, size=size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[sums.column("id").to_numpy()] = sums.column("n").to_numpy()
    return out


def _write(batches: Iterator[pa.RecordBatch], folder: str, lengths: bytes) -> Iterator[pa.RecordBatch]:
    parts = slices(batches, "ids", SLICE)
    first = next(parts, None)
    if first is None:
        return
    number = TaskContext.get().partitionId()
    name, coded = f"tokens-{number:06d}.ink", np.frombuffer(lengths, np.uint8)
    with _Output(folder, name) as out:
        writer = Writer(out, coded)
        for part in itertools.chain([first], parts):
            writer.add(part.column("doc_id"), *_ids(part.column("ids")))
        writer.close()
        tokens = writer.tokens
    yield pa.RecordBatch.from_pylist([{"number": number, "file": name, "tokens": tokens}])


def write_files(docs: DataFrame, folder: str, path: str) -> list[tuple[str, int]]:
    """Write `docs` (doc_id, text) in ascending order of doc_id; files in order, with the ids before each. Also a manifest."""
    rows = encoded(docs, path)
    lengths = code_lengths(id_counts(rows, encoder(path).size)).tobytes()
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie")
    written = map_arrow(placed, partial(_write, folder=folder, lengths=lengths), "number long, file string, tokens long").collect()
    out, before = [], 0
    for r in sorted(written):
        out.append((r.file, before))
        before += r.tokens
    if out:
        with _Output(folder, "manifest.json") as manifest:
            manifest.write(json.dumps([{"file": f, "start": s} for f, s in out]).encode())
    return out


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, base = open_fs(folder)
    for batch in batches:
        for name, before in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader = Reader(files, f"{base}/{name}")
            ends = np.cumsum(reader.sizes)
            low = 0
            while low < reader.documents:  # about RUN blocks at a time, whole documents
                begin = int(ends[low] - reader.sizes[low])
                high = max(low + 1, int(np.searchsorted(ends, begin + RUN * BLOCK, side="right")))
                ids = reader.ids(begin, int(ends[high - 1]))
                starts = ends[low:high] - reader.sizes[low:high]
                crcs = [crc_of_ids(ids[s:e]) for s, e in zip(starts - begin, ends[low:high] - begin, strict=True)]
                doc_ids = pa.array(reader.doc_ids[low:high], mask=reader.nulls[low:high])
                columns = [doc_ids, pa.array(starts + before), pa.array(reader.sizes[low:high]), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                low = high


def read_files(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    return map_arrow(spark.createDataFrame(files, "file string, start long").repartition(len(files)), partial(_read, folder=folder), schema)


def run(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "tokens")
    return read_files(spark, folder, write_files(docs, folder, path or tokenizer_path()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(table(spark, sf_dir, "documents", "doc_id", "text"))
