"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece reaches across (before a run of spaces, around line ends), and the distinct
cuts not seen lately are joined into one text. Its suffixes are sorted by as many symbols as the longest piece has, every
piece's range of occurrences is found by binary search in all pieces at once, and the occurrences are the edges of a
graph over the text. The edges are sorted by position in their cut and rank, and relaxed in the order that a model of
merges asks for: in each round every cut takes its best-ranked edge that spans exactly two present tokens, the leftmost
of equals, until none is left. What no piece covers becomes its UTF-8 bytes. This gives the ids of the model's own library.

The model file's path is a parameter; it holds the pieces, their scores and kinds. Encoding needs no shuffle: a task
holds one batch and the ids of recent cuts.

Defined results: null and empty texts have no ids and decode to the empty text. U+2581 in a text means a space to the
model and comes back as one; everything else comes back as it was. Repeated rows get repeated results. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm._common import Recent, crc_of_ids, map_arrow, slices, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHED = 100_000
SLICE = 2 << 20
#: Symbols in one 64-bit key, and bits of each.
PACKED, BITS = 4, 16
#: Cuts of more symbols are relaxed one by one with a heap instead of in rounds.
LONG = 48


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a model as symbols, ready to be searched for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        spelled = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(spelled[i][3:5], 16)] = i
        self.decoded = [b"" if i in special else spelled[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        self.piece_sizes = np.array([len(x) for x in self.decoded], np.int64)
        self.piece_bytes = np.frombuffer(b"".join(self.decoded), np.uint8)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

        normal = [i for i in range(size) if i not in special]
        alphabet = sorted({c for i in normal for c in spelled[i]})
        if len(alphabet) + 2 >= 1 << BITS:
            raise ValueError("too many symbols")
        self.code_points = np.array([ord(c) for c in alphabet])
        symbol = {c: k + 1 for k, c in enumerate(alphabet)}  # 0: none of them
        self.single = np.full(len(alphabet) + 1, -1, np.int64)
        for i in normal:
            if len(spelled[i]) == 1:
                self.single[symbol[spelled[i]]] = i
        several = [i for i in normal if len(spelled[i]) > 1]
        self.ids = np.array(several, np.int64)
        self.sizes = np.array([len(spelled[i]) for i in several], np.int64)
        width = -(-int(self.sizes.max(initial=1)) // PACKED) * PACKED
        self.width = width
        low = np.zeros((len(several), width), np.uint64)
        for row, i in enumerate(several):
            low[row, : len(spelled[i])] = [symbol[c] for c in spelled[i]]
        high = np.where(np.arange(width) < self.sizes[:, None], low, (1 << BITS) - 1).astype(np.uint64)
        self.low, self.high = self._packed(low), self._packed(high)
        scores = np.array([model.get_score(i) for i in several])
        self.rank = np.unique(-scores, return_inverse=True)[1]  # equal scores are equal ranks

    @staticmethod
    def _packed(symbols: np.ndarray) -> np.ndarray:
        parts = symbols.reshape(len(symbols), -1, PACKED)
        out = np.zeros(parts.shape[:2], np.uint64)
        for k in range(PACKED):
            out = (out << np.uint64(BITS)) | parts[:, :, k]
        return out

    def symbols(self, code_points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.code_points, code_points), len(self.code_points) - 1)
        return np.where(self.code_points[at] == code_points, at + 1, 0)


class SuffixArray:
    """Suffixes of a text of symbols, sorted by their first `width` symbols."""

    def __init__(self, text: np.ndarray, width: int):
        n = len(text)
        padded = np.concatenate([text, np.zeros(width + PACKED, np.int64)]).astype(np.uint64)
        key = np.zeros(n + width, np.uint64)
        for k in range(PACKED):
            key = (key << np.uint64(BITS)) | padded[k : k + n + width]
        self.keys, self.parts = key, width // PACKED
        rank, span = np.unique(key, return_inverse=True)[1].astype(np.int64), PACKED
        while span < width:  # prefix doubling
            next_ = np.concatenate([rank[span:], np.zeros(span, np.int64)])
            rank = np.unique(rank * np.int64(rank.max() + 1) + next_, return_inverse=True)[1].astype(np.int64)
            span *= 2
        self.order = np.argsort(rank[:n], kind="stable")

    def _before(self, at: np.ndarray, wanted: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffixes come before packed symbols; `equal` counts for those that are equal."""
        out, open_ = np.zeros(len(at), bool), np.ones(len(at), bool)
        for part in range(self.parts):
            have = self.keys[at + part * PACKED]
            out |= open_ & (have < wanted[:, part])
            open_ &= have == wanted[:, part]
        return out | (open_ if equal else False)

    def bound(self, wanted: np.ndarray, equal: bool) -> np.ndarray:
        """How many suffixes come before each row of packed symbols, by binary search in all rows at once."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order), np.int64)
        while (busy := np.flatnonzero(low < high)).size:
            middle = (low[busy] + high[busy]) >> 1
            before = self._before(self.order[middle], wanted[busy], equal)
            low[busy[before]] = middle[before] + 1
            high[busy[~before]] = middle[~before]
        return low


def edges(pieces: Pieces, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and piece (a row of `pieces`) of every occurrence of every piece of two symbols or more."""
    suffixes = SuffixArray(text, pieces.width)
    low, high = suffixes.bound(pieces.low, False), suffixes.bound(pieces.high, True)
    n = high - low
    first = np.cumsum(n) - n
    at = suffixes.order[np.repeat(low - first, n) + np.arange(n.sum())]
    return at, np.repeat(np.arange(len(n)), n)


def _relax_long(start: np.ndarray, piece: np.ndarray, pieces: Pieces, end: np.ndarray, token: np.ndarray, low: int, high: int) -> None:
    """The same order of merges for one long cut, by a heap over its edges."""
    known = {(s, s + int(pieces.sizes[p])): p for s, p in zip(start.tolist(), piece.tolist(), strict=True)}
    ends = end[low:high].tolist()
    before = [i - 1 for i in range(low, high)]
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int) -> None:
        if left >= low and (right := ends[left - low]) < high:
            stop = ends[right - low]
            p = known.get((left, stop))
            if p is not None:
                heapq.heappush(heap, (int(pieces.rank[p]), left, right, stop))

    for i in range(low, high):
        offer(i)
    while heap:
        _, left, right, stop = heapq.heappop(heap)
        if token[left] < 0 or ends[left - low] != right or token[right] < 0 or ends[right - low] != stop:
            continue
        token[left], token[right] = known[left, stop] + 1, -1
        ends[left - low] = stop
        if stop < high:
            before[stop - low] = left
        offer(before[left - low])
        offer(left)
    end[low:high] = ends


def relax(pieces: Pieces, text: np.ndarray, cut_starts: np.ndarray, cut_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of the token at each place, and token + 1: 0 for a single symbol, -1 where no token starts."""
    n = len(text)
    end, token = np.arange(1, n + 1, dtype=np.int32), np.zeros(n, np.int32)
    start, piece = edges(pieces, text)
    cut = np.searchsorted(cut_starts, start, side="right") - 1
    long = cut_sizes[cut] > LONG
    if long.any():
        by_cut = np.flatnonzero(long)[np.argsort(cut[long], kind="stable")]
        for own in np.split(by_cut, np.flatnonzero(np.diff(cut[by_cut])) + 1):
            c = cut[own[0]]
            _relax_long(start[own], piece[own], pieces, end, token, int(cut_starts[c]), int(cut_starts[c] + cut_sizes[c]))
        start, piece, cut = start[~long], piece[~long], cut[~long]
    span = int(pieces.rank.max(initial=0)) + 1
    order = np.argsort((cut * span + pieces.rank[piece]) * (LONG + 2) + (start - cut_starts[cut]))
    start, piece, cut = (x[order].astype(np.int32) for x in (start, piece, cut))
    stop = start + pieces.sizes[piece].astype(np.int32)
    while len(start):
        middle = end[start]
        ready = np.flatnonzero(end[np.minimum(middle, n - 1)] == stop)  # two tokens, as what is behind them goes below
        if not len(ready):
            break
        owner = cut[ready]
        best = ready[np.concatenate([[True], owner[1:] != owner[:-1]])]
        token[end[start[best]]] = -1
        end[start[best]] = stop[best]
        token[start[best]] = piece[best] + 1
        active = np.zeros(len(cut_starts), bool)
        active[owner] = True
        ends_here = (stop >= n) | (token[np.minimum(stop, n - 1)] >= 0)
        left = active[cut] & (token[start] >= 0) & (end[start] < stop) & ends_here
        start, piece, cut, stop = start[left], piece[left], cut[left], stop[left]
    return end, token


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known = Recent(CACHED)

    def _new(self, cuts: list[str]) -> list[bytes]:
        """Ids of distinct cuts, by one suffix array over all of them."""
        pieces, joined = self.pieces, "\0".join(cuts) + "\0"  # a symbol that no piece has stands between cuts
        code_points = np.frombuffer(joined.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        text = pieces.symbols(code_points)
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts)) + 1
        starts = np.cumsum(sizes) - sizes
        text[starts + sizes - 1] = 0
        _, token = relax(pieces, text, starts, sizes)
        at = np.flatnonzero(token >= 0)
        separator = np.zeros(len(text), bool)
        separator[starts + sizes - 1] = True
        at = at[~separator[at]]
        ids = np.where(token[at] > 0, pieces.ids[np.maximum(token[at] - 1, 0)], pieces.single[text[at]])
        unknown = np.flatnonzero(ids < 0)
        owner = np.searchsorted(starts, at, side="right") - 1
        width = np.ones(len(ids), np.int64)
        if len(unknown):  # as their UTF-8 bytes
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code_points[at[unknown]]]
            width[unknown] = [len(x) for x in spelled]
            out = np.repeat(ids, width)
            out[out < 0] = pieces.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            ids = out
        per_cut = np.bincount(owner, width, len(cuts)).astype(np.int64)
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(per_cut) * 4
        return [data[e - 4 * k : e] for e, k in zip(ends.tolist(), per_cut.tolist(), strict=True)]

    def encode_cuts(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts in one array, and how many each has."""
        spelled, known = cuts.to_pylist(), self.known
        out = [known.get(x) for x in spelled]
        new = [k for k, x in enumerate(out) if x is None]
        if new:
            for k, found in zip(new, self._new([spelled[k] for k in new]), strict=True):
                out[k] = found
                known.put(spelled[k], found)
        return np.frombuffer(b"".join(out), "<u4").astype(np.int64), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        space, line = data == 0x20, data == 0x0A
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] |= space[1:] & ~space[:-1]
        begins[1:-1] |= line[1:] | line[:-1]
        begins[offsets] = True
        bounds = np.flatnonzero(begins)
        cuts = pa.StringArray.from_buffers(max(0, len(bounds) - 1), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
        if not len(cuts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        coded = cuts.dictionary_encode()
        ids, sizes = self.encode_cuts(coded.dictionary)
        codes = coded.indices.to_numpy()
        starts, size = np.cumsum(sizes) - sizes, sizes[codes]
        total = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.repeat(starts[codes] - total[:-1], size) + np.arange(total[-1])]
        return out, np.diff(total[np.searchsorted(bounds, offsets)])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        pieces = self.pieces
        width = pieces.piece_sizes[ids]
        total = np.concatenate([[0], np.cumsum(width)])
        data = pieces.piece_bytes[np.repeat(pieces.piece_starts[ids] - total[:-1], width) + np.arange(total[-1])].tobytes()
        bounds = total[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


OUT = "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, n_chars long, round_trip boolean"


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = encoder(path)
    for part in slices(batches, "text", SLICE):
        ids, sizes = model.encode(part.column("text"))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        texts, back = pc.fill_null(part.column("text"), "").to_pylist(), model.decode(ids, sizes)
        same = [a.replace(SPACE, " ") == b for a, b in zip(texts, back, strict=True)]
        crcs = [crc_of_ids(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
        columns = [part.column("doc_id"), pa.array(sizes), lists, pa.array(crcs, pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array(same)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "ids_crc32", "n_chars", "round_trip"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its ids, and the length of their text and whether it is the row's."""
    return map_arrow(docs.select("doc_id", "text"), partial(_encode, path=path or model_path()), OUT)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = pc.fill_null(batch.column("ids"), [])
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = encoder(path).decode(lists.flatten().to_numpy().astype(np.int64), sizes)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids."""
    return map_arrow(encoded.select("doc_id", "ids"), partial(_decode, path=path or model_path()), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))
