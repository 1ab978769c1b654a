"""SimHash fingerprints and near-duplicate groups by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 23, 23 and 18 bits. Two fingerprints that differ in at most two bits
agree wholly on one segment and differ in at most one bit on the next one, in one of the cyclic pairs (C, A), (A, B)
and (B, C). The agreeing segment and a codeword index of the other one make a key. The binary Golay code of 23 bits
has exactly one codeword within three bits of any word, so a word's own codeword lies within four bits of every word
one bit away: a fingerprint asks with its nearest codeword and is filed under all codewords within four bits, five or
six on the average. Every link therefore meets in a key, and each meeting is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_batches
from .components import connected_components

#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY_GENERATOR = 0xAE3
_LENGTH, _CHECK = 23, 11
#: Fingerprints of more than one document in SHARE are at most SHARE; their components are broadcast (0.5 MB).
SHARE = 20_000
#: Words of a text that are hashed at a time.
_WORDS_AT_ONCE = 250_000


def _remainder(word: int) -> int:
    for bit in range(_LENGTH - 1, _CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GOLAY_GENERATOR << (bit - _CHECK)
    return word


class GolayKeys:
    """Codeword indices (12 bits: codewords are systematic) near 23-bit words."""

    def __init__(self) -> None:
        unit = [_remainder(1 << i) for i in range(_LENGTH)]
        nearest, near = {}, {s: [] for s in range(1 << _CHECK)}
        for weight in range(5):
            for places in combinations(range(_LENGTH), weight):
                syndrome, error = 0, 0
                for i in places:
                    syndrome ^= unit[i]
                    error |= 1 << i
                near[syndrome].append(error)
                if weight <= 3:
                    nearest[syndrome] = error
        self.nearest = np.array([nearest[s] for s in range(1 << _CHECK)], dtype=np.int64)
        self.counts = np.array([len(near[s]) for s in range(1 << _CHECK)], dtype=np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.errors = np.array([e for s in range(1 << _CHECK) for e in near[s]], dtype=np.int64)
        table = np.zeros(1 << 12, dtype=np.int64)
        for i in range(12):
            table[1 << i : 2 << i] = table[: 1 << i] ^ unit[i]
        high = np.zeros(1 << 11, dtype=np.int64)
        for i in range(11):
            high[1 << i : 2 << i] = high[: 1 << i] ^ unit[12 + i]
        self.low, self.high = table, high

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def own(self, words: np.ndarray) -> np.ndarray:
        """The index of each word's codeword within three bits."""
        return (words ^ self.nearest[self.syndromes(words)]) >> _CHECK

    def within_four(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of every codeword within four bits of each word."""
        s = self.syndromes(words)
        n = self.counts[s]
        rows = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[s], n)
        return rows, (words[rows] ^ self.errors[at]) >> _CHECK


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of one text: see simhash()."""
    return int(_fingerprints([(text or "").encode()], shingle)[0])


def _fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n, ones = max(1, len(words) - shingle + 1), np.zeros(64, dtype=np.int64)
        for lo in range(0, n, _WORDS_AT_ONCE):
            part = words[lo : min(lo + _WORDS_AT_ONCE, n) + shingle - 1]
            joined = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            if len(part) >= shingle:
                starts, ends = starts[: len(part) - shingle + 1], ends[shingle - 1 :]
            else:
                starts, ends = starts[:1], ends[-1:]
            hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[row] = powers[ones * 2 > n].sum(dtype=np.uint64)
    return out


def simhash(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of every whole text.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles of ``shingle`` words, repeats
    included, are joined by spaces (fewer words: all of them) and hashed by XXH64 with seed 42. A bit is set if it is
    set in more than half the hashes. A null or empty text has the fingerprint zero.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("fingerprint", "long")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.columns[-1]
            texts = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
            found = _fingerprints([t.as_py() or b"" for t in texts], shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=schema.names)

    return in_batches(rows, hashes, schema)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = GolayKeys()
    for batch in batches:
        f = batch.column(0).to_numpy().view(np.uint64)
        a, b, c = ((f >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18)))
        own = f.view(np.int64)
        for table, (exact, fuzzy) in enumerate(((c, a), (a, b), (b, c))):
            head = table << 60 | exact << 12
            asked = head | golay.own(fuzzy)
            rows, index = golay.within_four(fuzzy)
            for key, prints, asks in ((asked, own, True), (head[rows] | index, own[rows], False)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints), pa.array(np.full(len(key), asks))], names=["key", "fingerprint", "asks"])


def links(prints: DataFrame, scratch: Scratch, most: int = 64) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fingerprint), enough of them to connect all that differ in at most two bits.

    Keys filed by at most ``most`` fingerprints are joined and verified. Those of fuller keys are linked another,
    equally exact way that makes no pairs: fingerprints differ in at most two bits just if one of their 65 words
    within one bit is common, so each is linked to the least fingerprint of each of its 65 words, of which a word has
    at most 65.
    """
    filed = scratch.cut(in_batches(prints, _filed, "key long, fingerprint long, asks boolean"))
    full = filed.where("not asks").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key")
    rare = filed.join(full, "key", "left_anti")
    asks, files = rare.where("asks").select("key", F.col("fingerprint").alias("u")), rare.where("not asks").select("key", F.col("fingerprint").alias("v"))
    near = asks.join(files, "key").where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    crowded = filed.join(full, "key", "left_semi").select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    words = crowded.select("fingerprint", F.explode(flips).alias("flip")).select(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("word"), "fingerprint")
    met = words.groupBy("word").agg(F.min("fingerprint").alias("v"), F.collect_list("fingerprint").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.explode("all").alias("u"), "v").where("u <> v").distinct()
    return near.unionAll(stars)


def near_groups(docs: DataFrame, scratch: Scratch, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, fingerprint long, component_id): one row per document; the component's smallest doc_id.

    Documents link if their fingerprints differ in at most two bits; copies share a fingerprint and are one node
    from the start. Repeated rows stay; a null doc_id is in its fingerprint's component, and the smallest non-null
    id names it (null if there is none). An empty table gives no rows; other columns are not read.
    """
    found = scratch.cut(simhash(docs, shingle, id_col, text_col))
    total = found.count()
    counted = found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    prints = scratch.cut(counted.select("fingerprint", "least", (F.col("n") * share > total).alias("hot")))
    reached = connected_components(links(prints.select("fingerprint"), scratch), scratch)
    grouped = prints.join(reached, prints.fingerprint == reached.node).select("fingerprint", "root", "least")
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    by_print = grouped.join(named, "root").select("fingerprint", "component")
    names = scratch.cut(prints.join(by_print, "fingerprint", "left").select("fingerprint", F.coalesce("component", "least").alias("component_id"), "hot"))
    hot = F.broadcast(names.where("hot").drop("hot"))
    rest = found.join(hot, "fingerprint", "left_anti").join(names.where("not hot").drop("hot"), "fingerprint")
    columns = ["doc_id", "fingerprint", "component_id"]
    return found.join(hot, "fingerprint").select(columns).unionAll(rest.select(columns))


def hex_print(col):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
