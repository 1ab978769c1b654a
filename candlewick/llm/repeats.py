"""Removal of repeated byte strings: depth-limited radix passes over the suffixes of all texts.

Suffixes are ordered only through the threshold (100 bytes) and only as far as groups stay open, the most significant
digit first. A suffix's digits are (1) its anchor, the gram of ANCHOR bytes with the least hash inside its first 100
bytes, (2) the block, all that the neighbouring suffixes with the same anchor cover, and (3) the 100 bytes themselves.
Suffixes with unlike first digits are unlike, and one whose digit is alone is settled, so most texts leave after the
first pass with one row for a block of some 30 suffixes; equal blocks settle all their suffixes at once; only suffixes
of unlike blocks with a common anchor reach the third pass. Equal groups after it are exactly the repeated windows, and
in each all but the first are removed. Digits are compared by 64-bit hashes, the later ones within equal earlier ones.

A pass is one shuffle by its digit; no group is held in memory as a whole. Anchors that a sample shows to be very common
(a line that many texts hold) are dealt out over SALTS parts: the first of equal digits is found in each part, then among
the parts' firsts, and all their suffixes go on to the third pass. The sample decides the way only, never the result;
its list is all that reaches the driver, ANCHORS at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_batches

#: Bytes of a gram that anchors a window.
ANCHOR = 40
#: Bytes of text that are hashed at a time; a longer text is taken in overlapping parts.
_AT_ONCE = 1 << 18
_MARK_BITS, _COUNT_BITS = 18, 7
_LOWEST = -(1 << 63)
#: Very common anchors: one text in SAMPLE is looked at, for anchors of OFTEN blocks of those or more, ANCHORS at most.
SAMPLE, OFTEN, ANCHORS = 32, 24, 20_000
SALTS = 64


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


class _Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a buffer, from one running sum."""

    def __init__(self, size: int) -> None:
        self.table = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        self.up, self.down = np.full(size, base, dtype=np.uint64), np.full(size + 1, inverse, dtype=np.uint64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _spread((sums[stop] - sums[start]) * self.down[start])


_rolling: dict[int, _Rolling] = {}


def _tool(size: int) -> _Rolling:
    if size not in _rolling:
        _rolling[size] = _Rolling(size)
    return _rolling[size]


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def _blocks(data: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, count, offset, anchor, block) of the blocks of a buffer of texts that end at ``stops``."""
    none = (np.zeros(0, dtype=np.int64),) * 5
    if len(data) < length:
        return none
    tool = _tool(_AT_ONCE + 2 * 1024)
    sums, n = tool.sums(data), len(data)
    grams = _spread((sums[ANCHOR:] - sums[:-ANCHOR]) * tool.down[: n - ANCHOR + 1])
    bits = np.uint64(20)
    low = np.uint64((1 << 20) - 1)
    keyed = (grams >> bits << bits) | (low - np.arange(len(grams), dtype=np.uint64))
    at = (low - (_least_in_window(keyed, length - ANCHOR + 1) & low)).astype(np.int64)
    inside = np.ones(n, dtype=bool)
    for stop in stops.tolist():
        inside[max(0, stop - length + 1) : stop] = False
    starts = np.flatnonzero(inside[: n - length + 1])
    if not len(starts):
        return none
    anchors = at[starts]
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    count = np.diff(first, append=len(starts))
    start, anchor = starts[first], anchors[first]
    # a run of equal anchors has no gap: an anchor lies inside all its windows, and windows inside one text
    block = tool.stretch(sums, start, start + count - 1 + length)
    return start, count, anchor - start, grams[anchor].view(np.int64), block.view(np.int64)


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, starts in the buffer, starts in the text): whole texts together, long ones in parts that overlap by length - 1."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        sizes = np.array([len(t) for _, _, t in held], dtype=np.int64)
        return np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8), np.array([r for r, _, _ in held]), np.cumsum(sizes) - sizes, np.array([o for _, o, _ in held])

    for row, text in enumerate(texts):
        step = _AT_ONCE - length
        for lo in range(0, max(len(text) - length + 1, 0), step):
            part = text[lo : lo + step + length - 1]
            if size + len(part) > _AT_ONCE and held:
                yield flush()
                held, size = [], 0
            held.append((row, lo, part))
            size += len(part)
    if held:
        yield flush()


def _text_bytes(column: pa.Array) -> list[bytes]:
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x.as_py() or b"" for x in column]


def _first_digits(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, rows, inner, outer in _buffers(_text_bytes(batch.column(2)), length):
                start, count, offset, anchor, block = _blocks(data, np.append(inner[1:], len(data)), length)
                part = np.searchsorted(inner, start, side="right") - 1
                place = (start - inner[part] + outer[part]) << 32 | offset << (32 - _COUNT_BITS) | count << _MARK_BITS
                # unlike offsets or counts are unlike blocks
                block = block ^ ((offset << 7 | count) * 0x27D4EB2F165667C5 & 0x7FFFFFFFFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(block), pa.array(ids[rows[part]]), pa.array(marks[rows[part]]), pa.array(place)], names=["anchor", "block", "id", "mark", "place"])

    return run


def _last_digits(length: int):
    """One row for every suffix of the blocks listed beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            places, anchors = (lists.flatten().field(i).to_numpy() for i in (0, 1))
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for row, text in enumerate(_text_bytes(batch.column(2))):
                place, anchor = places[edges[row] : edges[row + 1]], anchors[edges[row] : edges[row + 1]]
                start, count = place >> 32, place >> _MARK_BITS & (1 << _COUNT_BITS) - 1
                at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                whole = np.frombuffer(text, dtype=np.uint8)
                hashed = np.zeros(len(at), dtype=np.int64)
                for lo in range(0, len(whole), _AT_ONCE):  # by the part in which a suffix starts
                    own = np.flatnonzero((at >= lo) & (at < lo + _AT_ONCE))
                    if len(own):
                        tool = _tool(_AT_ONCE + 2 * 1024)
                        sums = tool.sums(whole[lo : lo + _AT_ONCE + length])
                        hashed[own] = tool.stretch(sums, at[own] - lo, at[own] - lo + length).view(np.int64)
                spot = at << 32 | 1 << _MARK_BITS | np.repeat(place & (1 << _MARK_BITS) - 1, count)
                for lo in range(0, len(at), 200_000):
                    hi = lo + 200_000
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, count)[lo:hi]), pa.array(hashed[lo:hi]), pa.array(np.full(len(at[lo:hi]), ids[row])), pa.array(np.full(len(at[lo:hi]), marks[row])), pa.array(spot[lo:hi])], names=["anchor", "window", "id", "mark", "place"])

    return run


def common_anchors(rows: DataFrame, length: int) -> DataFrame:
    """(anchor): anchors that a sample of the texts shows to be very common."""
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    seen = in_batches(sample, _first_digits(length), _FIRST).groupBy("anchor").count().where(F.col("count") >= OFTEN)
    top = seen.orderBy(F.desc("count"), "anchor").limit(ANCHORS).select("anchor").collect()
    return rows.sparkSession.createDataFrame([tuple(r) for r in top], "anchor long")


_FIRST = "anchor long, block long, id long, mark long, place long"
_LAST = "anchor long, window long, id long, mark long, place long"


def _spot():
    return F.struct(F.col("id").alias("i"), F.shiftright("place", 32).alias("s"))


def _salt():
    """The part of a common anchor, from 1; 0 for the others. It also lies in the low bits of place, for tables."""
    return F.col("place").bitwiseAND(F.lit((1 << _MARK_BITS) - 1))


def _dealt(rows: DataFrame, common: DataFrame) -> DataFrame:
    """rows with the part of a common anchor as ``salt``, and in their place."""
    told = rows.join(F.broadcast(common.withColumn("crowded", F.lit(True))), "anchor", "left")
    part = F.when(F.col("crowded"), F.pmod(F.xxhash64("id"), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    return told.withColumn("salt", part).withColumn("place", F.col("place").bitwiseOR(F.col("salt"))).drop("crowded")


def _later(rows: DataFrame, digit: str) -> DataFrame:
    """rows with ``later``: whether an equal digit under the same anchor starts earlier (smaller id, or same id and earlier start) in the same part."""
    return rows.withColumn("later", _spot() > F.min(_spot()).over(Window.partitionBy("anchor", "salt", digit)))


def _settled(found: DataFrame, digit: str) -> DataFrame:
    """The same over all parts, of which the firsts only meet."""
    firsts = found.where((_salt() > 0) & ~F.col("later"))
    met = firsts.withColumn("later", _spot() > F.min(_spot()).over(Window.partitionBy("anchor", digit)))
    return found.where(F.col("later") | (_salt() == 0)).unionAll(met.select(*found.columns))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans array<long>): for texts with something to remove, places of repeated blocks and windows (start << 32 | ... | count << 18)."""
    if not ANCHOR < length <= ANCHOR + (1 << _COUNT_BITS) - 2:
        raise ValueError(f"length must be from {ANCHOR + 1} to {ANCHOR + (1 << _COUNT_BITS) - 2}")
    rows = _keyed(docs, id_col, text_col)
    common = scratch.cut(common_anchors(rows, length))
    first = _dealt(in_batches(rows, _first_digits(length), _FIRST), common)
    group, crowded = Window.partitionBy("anchor", "salt"), _salt() > 0
    ranked = _later(first.withColumn("open", crowded | (F.min("block").over(group) != F.max("block").over(group))), "block")
    kept = ranked.where("later or open").select("anchor", "id", "mark", "place", "later", F.when(crowded, F.col("block")).alias("block"))
    kept = scratch.cut(kept)
    open_groups = scratch.cut(_settled(kept, "block").select("anchor", "id", "mark", "place", "later"))
    scratch.drop(kept)
    asked = open_groups.where("not later").groupBy("id", "mark").agg(F.collect_list(F.struct("place", "anchor")).alias("blocks"))
    windows = in_batches(rows.join(asked, ["id", "mark"]).select("id", "mark", "text", "blocks"), _last_digits(length), _LAST)
    # dealt by anchor, so that a block's windows stay beside each other and compress well
    dealt = windows.withColumn("salt", _salt()).repartition("anchor", "salt")
    ranked = _later(dealt, "window").where(F.col("later") | crowded)
    again = _settled(scratch.cut(ranked.select("anchor", "id", "mark", "place", "later", F.when(crowded, F.col("window")).alias("window"))), "window").where("later")
    lost = open_groups.where("later").select("id", "mark", "place").unionAll(again.select("id", "mark", "place"))
    return lost.groupBy("id", "mark").agg(F.collect_list("place").alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the lowest long), mark (0, or the text's hash where ids repeat, to tell apart texts under one id), text."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST).cast("long"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    once = docs.select(ident.alias("id")).groupBy("id").count().where("count > 1").isEmpty()
    return docs.select(ident.alias("id"), (F.lit(0).cast("long") if once else F.xxhash64(text)).alias("mark"), text.alias("text"))


def _merged(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the places cover."""
    start = places >> 32
    stop = start + (places >> _MARK_BITS & (1 << _COUNT_BITS) - 1) - 1 + length
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    head = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return list(zip(start[head].tolist(), stop[np.append(head[1:], len(start)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, removed array<struct<start, stop>>), one row per row of ``docs``.

    A byte of a text's UTF-8 form goes if a string of ``length`` bytes over it also starts earlier: in a document of
    smaller id, or before in the same one. Strings are judged on the input and never cross documents. Null texts are
    empty; a null id comes before all others; rows that share an id and a text are one document and lose the same
    bytes, so that none of them counts as earlier; texts shorter than ``length`` lose nothing. An empty table gives
    no rows; other columns are not read.
    """
    spans = repeated_spans(docs, scratch, length, id_col, text_col)
    rows = _keyed(docs, id_col, text_col).join(spans, ["id", "mark"], "left")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:bigint,stop:bigint>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, places in zip(_text_bytes(batch.column(1)), batch.column(2), strict=True):
                runs = _merged(places.values.to_numpy(), length) if places.is_valid else []
                at, kept = 0, []
                for lo, hi in runs:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                for column, x in zip(out, (len(text), sum(b - a for a, b in runs), len(runs), b"".join(kept), [{"start": a, "stop": b} for a, b in runs]), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    done = in_batches(rows.select("id", "text", "spans"), cut, schema)
    return done.select(F.when(F.col("id") != _LOWEST, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "removed")


def brute_force(docs: list[tuple[int, bytes]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The same by a set of all windows, for tests: id to (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
