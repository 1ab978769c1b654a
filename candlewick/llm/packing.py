"""Packing of tokenised documents into sequences: harmonic classes, and best-fit-decreasing with id matrices.

Both run where the documents are read, without a shuffle: every input partition packs its own documents, so a lost
executor costs its own partitions, and a rerun gives the same sequences. Memory holds one Arrow batch of documents
and, for best-fit, one block of tokens.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_batches
from .tokens import word_tokenizer

#: Sequence ids: the partition in the high bits, the partition's own count in the low ones.
_PARTITION_BITS = 40
#: Bytes of text that are tokenised at a time.
_SLICE_BYTES = 1_000_000

PIECE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts in slices of bounded bytes; a single text is never cut."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    sizes = np.zeros(len(texts), dtype=np.int64)
    lengths = pa.compute.binary_length(texts)
    sizes[:] = pa.compute.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes) // _SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield ids[lo:hi], texts.slice(lo, hi - lo)


def _with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document's ids."""
    stops = np.cumsum(counts)
    return np.insert(flat, stops, np.uint32(end_id)), counts + 1


class HarmonicBins:
    """Open bins of the reciprocal-capacity classes of one worker.

    A document of more than capacity / (k + 1) and at most capacity / k tokens is of class k, and a bin of that class
    takes k of them, whole; no class looks at another or at another worker. What a full bin has left (less than
    capacity / (k + 1) per share) is filled from the stock: rests of documents that exceed a sequence, or, while bins
    wait for a filling, the next document. Only these are cut. At the end all that is held is laid out end to end, in
    whole sequences and then in runs of a power of two, so that nothing needs padding.
    """

    def __init__(self, capacity: int, first_id: int) -> None:
        if capacity < 1:
            raise ValueError("the capacity must be positive")
        self.capacity, self.next_id = capacity, first_id
        self.held: dict[int, list[tuple]] = {}
        self.stock: deque[tuple] = deque()
        self.waiting: deque[tuple[int, list[tuple]]] = deque()

    def add(self, doc: tuple) -> list[tuple]:
        """doc: (document, first token, tokens). Returns pieces (document, first token, tokens, sequence id, offset) of bins that it closes."""
        name, start, n = doc
        out: list[tuple] = []
        long = n > self.capacity
        while n >= self.capacity:
            out += self._close([(name, start, self.capacity)])
            start, n = start + self.capacity, n - self.capacity
        if not n:
            return out
        if long or self.waiting:
            self.stock.append((name, start, n))
        else:
            k = self.capacity // n
            held = self.held.setdefault(k, [])
            held.append((name, start, n))
            if len(held) == k:
                del self.held[k]
                self.waiting.append((self.capacity - sum(p[2] for p in held), held))
        while self.waiting and (self.stock or not self.waiting[0][0]):
            room, pieces = self.waiting.popleft()
            while room and self.stock:
                name, start, n = self.stock.popleft()
                cut = min(room, n)
                pieces.append((name, start, cut))
                room -= cut
                if cut < n:
                    self.stock.appendleft((name, start + cut, n - cut))
            if room:
                self.waiting.appendleft((room, pieces))
            else:
                out += self._close(pieces)
        return out

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next_id, at))
            at += p[2]
        self.next_id += 1
        return out

    def finish(self) -> list[tuple]:
        rest = [p for _, pieces in self.waiting for p in pieces]
        rest += [p for k in sorted(self.held) for p in self.held[k]] + list(self.stock)
        total = sum(p[2] for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        left = total % self.capacity
        sizes += [1 << j for j in range(left.bit_length() - 1, -1, -1) if left >> j & 1]
        out: list[tuple] = []
        rest.reverse()
        for size in sizes:
            pieces = []
            while size:
                name, start, n = rest.pop()
                cut = min(size, n)
                pieces.append((name, start, cut))
                size -= cut
                if cut < n:
                    rest.append((name, start + cut, n - cut))
            out += self._close(pieces)
        self.held, self.stock, self.waiting = {}, deque(), deque()
        return out


def harmonic_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens by harmonic classes; one row per piece.

    A document is its ids and then ``end_id``. Full sequences are cut off first; a document of at most ``capacity``
    tokens stays whole, but for those that fill what the bins of the classes have left (see HarmonicBins) and the last
    ones of an input partition. No sequence needs padding: it is either full or, at the end of an input partition,
    of a power of two tokens.

    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. A null text
    is empty and still has its end id. Repeated rows and ids are packed as they stand; a null id stays null. An
    empty table gives no rows. Other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << _PARTITION_BITS)

        def rows(pieces: list[tuple]) -> list[tuple]:
            return [(doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, sequence, offset) for (doc_id, ids), start, n, sequence, offset in pieces]

        for batch in batches:
            for names, texts in _slices(batch):
                flat, counts = _with_end(*tokenizer.encode_arrow(texts), end_id)
                flat = flat.astype("<u4", copy=False)
                done, at = [], 0
                for doc_id, n in zip(names, counts.tolist(), strict=True):
                    done += rows(bins.add(((doc_id, flat[at : at + n].tobytes()), 0, n)))
                    at += n
                yield from _rows(done)
                pa.default_memory_pool().release_unused()
        yield from _rows(rows(bins.finish()))

    return in_batches(docs.select(_id(docs, id_col), text_col), pack, PIECE_SCHEMA)


def _id(docs: DataFrame, id_col: str):
    return docs[id_col].cast("long").alias(id_col)


def _rows(rows: list[tuple], step: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    for lo in range(0, len(rows), step):
        columns = zip(*rows[lo : lo + step], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECE_SCHEMA.names)


class CapacityTree:
    """Segment tree over the free room of open bins: finds the fullest bin that still takes a piece.

    Leaf r holds the bins with r tokens free; an inner node counts the bins below it.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_no: int) -> None:
        self.bins[room].append(bin_no)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) with the least room of at least need, removed from the tree; None if no bin has it."""
        at = need + self.leaves
        count = self.count
        while not count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room, found = at - self.leaves, self.bins[at - self.leaves].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, found


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, ties in the order given; each to the fullest bin with room."""
    tree, out, made = CapacityTree(capacity), np.zeros(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, made = (capacity, made), made + 1
        out[i] = found[1]
        if found[0] > n:
            tree.put(found[0] - n, found[1])
    return out


SEQUENCE_SCHEMA = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("input_ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType(), False)),
        T.StructField("position_ids", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType(), False)),
        T.StructField("doc_tokens", T.ArrayType(T.LongType(), False)),
    ]
)


def bfd_pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    block_tokens: int = 4_000_000,
    id_width: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Best-fit-decreasing packing into rows of exactly ``capacity`` ids; one row per sequence.

    Documents longer than a sequence are cut into full pieces and a rest, in order and without loss. Pieces are
    packed in blocks of about ``block_tokens`` tokens of one input partition, which bounds memory; no piece is left
    out. input_ids is one line of the packed id matrix (little-endian, ``id_width`` bytes an id, padded with
    ``pad_id``); cu_seqlens the cumulative segment lengths, from 0 to the tokens used; position_ids (little-endian
    unsigned 16-bit, or 32-bit beyond 65,536 tokens a sequence) counts from 0 anew in each segment and in the
    padding. doc_ids, starts and doc_tokens name each segment's document, its first token there and that
    document's length.

    A null text is empty and still has its end id; repeated rows and null ids are packed as they stand; an empty
    table gives no rows. Other columns are not read.
    """
    kind, place = np.dtype(f"<u{id_width}"), np.dtype("<u2" if capacity <= 1 << 16 else "<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        if tokenizer.vocab_size > 1 << 8 * id_width:
            raise ValueError(f"ids of {tokenizer.vocab_size} kinds do not fit into {id_width} bytes")
        next_id = TaskContext.get().partitionId() << _PARTITION_BITS
        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            for ids, texts in _slices(batch):
                flat, counts = _with_end(*tokenizer.encode_arrow(texts), end_id)
                flat, at = flat.astype(kind), 0
                for doc_id, n in zip(ids, counts.tolist(), strict=True):
                    held += [(doc_id, s, flat[at + s : at + min(n, s + capacity)], n) for s in range(0, n, capacity)]
                    at, tokens = at + n, tokens + n
                if tokens >= block_tokens:
                    rows, next_id = matrices(held, next_id)
                    yield from rows
                    held, tokens = [], 0
        if held:
            yield from matrices(held, next_id)[0]

    def matrices(held: list[tuple], next_id: int) -> tuple[list[pa.RecordBatch], int]:
        lengths = np.array([len(p[2]) for p in held], dtype=np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        order = np.lexsort((np.arange(len(held)), bins))
        edges = np.flatnonzero(np.diff(bins[order], prepend=-1, append=-1))
        out, rows = [], []
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            own = [held[k] for k in order[lo:hi]]
            line, spots = np.full(capacity, pad_id, dtype=kind), np.zeros(capacity, dtype=place)
            stops = [0]
            for p in own:
                line[stops[-1] : stops[-1] + len(p[2])] = p[2]
                spots[stops[-1] : stops[-1] + len(p[2])] = np.arange(len(p[2]))
                stops.append(stops[-1] + len(p[2]))
            spots[stops[-1] :] = np.arange(capacity - stops[-1])
            rows.append((next_id + i, line.tobytes(), stops, spots.tobytes(), [p[0] for p in own], [p[1] for p in own], [p[3] for p in own]))
            if len(rows) == 500:
                out.append(_matrix(rows))
                rows = []
        if rows:
            out.append(_matrix(rows))
        return out, next_id + len(edges) - 1

    return in_batches(docs.select(_id(docs, id_col), text_col), pack, SEQUENCE_SCHEMA)


def _matrix(rows: list[tuple]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), longs, longs, longs]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SEQUENCE_SCHEMA.names)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Writes packed sequences as a Parquet folder; Spark's committer shows whole folders only."""
    sequences.write.mode("overwrite").parquet(path)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 in place of their ids."""
    from pyspark.sql import functions as F

    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
