"""Near copies by SimHash links and an exact set-similarity join, for filtering a corpus.

Texts link if their sets of five-word shingles have a Jaccard similarity of the threshold t or more. Candidates are the
pairs whose fingerprints link (Golay keys, see simhash.py), and what a prefix-filtered join finds beyond them; both are
verified. For the join all shingles have one order: those that a sample shows to be common last, the others by their hash. Of two alike texts each holds ceil(t m) of its m shingles in common with
the other, so they share one of their first m - ceil(t m) + 1 (prefix filter), and from the first they share there are
enough left (positional filter). Sizes and parity bits of the sets drop most pairs before a set is moved; what passes
is counted exactly. The sample sets the order only: any order loses nothing.

The texts of a shingle are not paired out at once. They are first held against one of them, a hub, and the groups that
these pairs and the fingerprints' form are one from there on; then every text outside of a key's largest group meets all texts of other groups. Pairs inside a
group are the only ones left out, and they change no group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, in_batches
from .components import connected_components
from .simhash import _fingerprints, links

#: Ids of texts to verify up to which they are broadcast (5 MB).
ASKED = 200_000
#: Common shingles that come last: one text in SAMPLE is looked at, for shingles of SEEN of those or more, COMMON at most.
SAMPLE, SEEN, COMMON = 16, 4, 100_000
#: Turns in which a key's texts are held against a hub before all that is left meets.
HUBS = 2
#: Texts of a batch that are worked on at a time.
_TEXTS_AT_ONCE = 256


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of a text's n-word shingles; of all its words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    hashed = np.fromiter((xxh64_intdigest(w, 42) for w in words), dtype="<u8", count=len(words))
    if not words:
        return hashed
    k = max(1, len(words) - n + 1)
    out = np.zeros(k, dtype=np.uint64)
    for i in range(min(n, len(words))):
        out = _mixed(out ^ hashed[i : i + k], i + 1)
    return np.unique(out)


def of_dice(share: float) -> float:
    """The Jaccard similarity of sets whose Dice similarity (twice what they share over the sum of their sizes) is ``share``; rounded down, so that equal shares pass."""
    return float(np.nextafter(share / (2 - share), 0))


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The first m - ceil(threshold m) + 1 of m shingles, and how many of them are rare; those in ``common`` (ascending) come last, by their rank."""
    m = rare = len(found)
    if not m:
        return found, 0
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        hit = common[at] == found
        found = np.concatenate([found[~hit], found[hit][np.argsort(rank[at[hit]], kind="stable")]])
        rare = m - int(hit.sum())
    k = m - int(np.ceil(threshold * m - 1e-9)) + 1
    return found[:k], min(rare, k)


def parities(found: np.ndarray) -> np.ndarray:
    """Parities of how many shingles flip each bit, of as many bits as the least power of two from the set's size on (512 at least)."""
    bits = max(512, 1 << max(len(found) - 1, 0).bit_length())
    flips = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<u8")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Columns but the last, and the texts in the last, some texts at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _TEXTS_AT_ONCE):
            part = batch.slice(lo, _TEXTS_AT_ONCE)
            last = part.columns[-1]
            yield part.columns[:-1], [t.as_py() or b"" for t in last.cast(pa.binary() if pa.types.is_string(last.type) else pa.large_binary())]
    pa.default_memory_pool().release_unused()  # workers stay for later stages


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(np.uint64).view(np.int64)))


def _sketched(batches: Iterator[pa.RecordBatch], common: np.ndarray, rank: np.ndarray, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for columns, texts in _slices(batches):
        sets = [shingles(t, n) for t in texts]
        heads, rare = zip(*[prefix(s, common, rank, threshold) for s in sets], strict=True)
        made = [pa.array(_fingerprints(texts, 3).view(np.int64)), pa.array(list(map(len, sets)), pa.int32()), _lists(heads), pa.array(rare, pa.int32()), _lists([parities(s) for s in sets])]
        yield pa.RecordBatch.from_arrays([*columns, *made], names=["doc_id", "h", "c", "fingerprint", "size", "prefix", "rare", "odd"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for columns, texts in _slices(batches):
        yield pa.RecordBatch.from_arrays([*columns, _lists([shingles(t, n) for t in texts])], names=["node", "h", "c", "set"])


def common_shingles(rows: DataFrame, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, rank): what a sample of the texts shows to be common, the most common ranked last."""
    sample = rows.where(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h", "c"]).select("doc_id", "h", "c", "text")
    sets = in_batches(sample, partial(_sets, n=n), "node long, h long, c long, set array<long>")
    counts = sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") >= SEEN)
    top = counts.orderBy(F.desc("k"), "s").limit(COMMON).collect()
    found = np.array([r["s"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], len(found) - order


def _enough(threshold: float):
    """For entries (s, p) and (t, q), sizes and places from 0: whether the sizes, and what is left from there on, allow the threshold."""
    left = F.least(F.col("s") - F.col("p"), F.col("t") - F.col("q"))
    return (F.least("s", "t") >= threshold * F.greatest("s", "t") - 1e-9) & (left * (1 + threshold) >= threshold * (F.col("s") + F.col("t")) - 1e-9)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()


def filed(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, x, s, p, score): node x of s shingles files key at place p of its prefix; keys of one node are left out.

    Keys that the sample showed to be common are filed without a look at how many nodes have them, so that only keys
    of few nodes are grouped. score is the share of the node's shingles that are filed here.
    """
    entries = nodes.select(F.col("node").alias("x"), F.col("size").alias("s"), "rare", F.posexplode("prefix").alias("p", "key"))
    columns = ["key", "x", "s", "p"]
    rare = entries.where("p < rare").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    shared = scratch.cut(rare.select(columns).unionAll(entries.where("p >= rare").select(columns)))
    return scratch.cut(shared.join(shared.groupBy("x").agg((F.count("*") / F.first("s")).alias("score")), "x"))


def shingle_sets(ids: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch, n: int = 5) -> DataFrame:
    """(node, set) of the nodes in ``ids``, whose texts only are read again.

    Their ids are broadcast while there are at most ASKED of them, and joined by a shuffle beyond.
    """
    asked = scratch.cut(nodes.join(ids, "node", "left_semi").select(F.col("node").alias("doc_id"), "h", "c"))
    asked = F.broadcast(asked) if asked.count() <= ASKED else asked
    texts = rows.join(asked, ["doc_id", "h", "c"], "left_semi").select("doc_id", "h", "c", "text")
    sets = scratch.cut(in_batches(texts, partial(_sets, n=n), "node long, h long, c long, set array<long>"))
    if not sets.groupBy("node", "h", "c").count().where("count > 1").isEmpty():
        sets = scratch.cut(sets.dropDuplicates(["node", "h", "c"]))
    return sets.select("node", "set")


def close_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The pairs (u, v) that sizes and parities leave: sets that differ in d shingles differ in at most d bits of parity."""
    marks = lambda c, k: nodes.select(F.col("node").alias(c), F.col("size").alias(f"{k}n"), F.col("odd").alias(f"{k}odd"))
    xor = lambda x, y: F.zip_with(x, y, lambda i, j: i.bitwiseXOR(j))
    # sizes that fit differ by less than two, so the longer marks are folded once at most
    folded = lambda x, y: F.when(F.size(x) > F.size(y), xor(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)))).otherwise(F.col(x))
    differ = F.aggregate(xor(folded("aodd", "bodd"), folded("bodd", "aodd")), F.lit(0), lambda n, x: n + F.bit_count(x))
    near = F.least("an", "bn") >= threshold * F.greatest("an", "bn") - 1e-9
    fits = near & (differ * (1 + threshold) <= (1 - threshold) * (F.col("an") + F.col("bn")) + 1e-9)
    return pairs.join(marks("u", "a"), "u").join(marks("v", "b"), "v").where(fits).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of ``threshold`` or more; two empty sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.withColumn("s", shared).where(F.col("s") >= threshold * (F.size("a") + F.size("b") - F.col("s"))).select("u", "v")


def alike_groups(proposed: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(node, root) of all nodes that shingle sets alike to ``threshold`` connect to others.

    The pairs (u, v) of ``proposed`` are verified with those of the first turn. The nodes of a key meet its hubs first,
    one a turn, then whatever is of another group; see above.
    """
    entries = filed(nodes, scratch)
    reached = None
    for turn in range(HUBS + 1):
        if reached is None:
            placed = entries.withColumn("root", F.col("x"))
        else:
            placed = scratch.cut(entries.join(reached, entries.x == reached.node, "left").select(*entries.columns, F.coalesce("root", "x").alias("root")))
        groups = placed.groupBy("key", "root").agg(F.count("*").alias("k"))
        main = groups.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
        outside = placed.join(main, "key").where("root <> main") if turn else placed
        if turn < HUBS:
            chosen = outside.groupBy("key").agg(F.max_by(F.struct(F.col("x").alias("y"), F.col("s").alias("t"), F.col("p").alias("q"), F.col("root").alias("_root")), F.struct("score", -F.col("x"))).alias("hub")).select("key", "hub.*")
        else:
            chosen = placed.select("key", F.col("x").alias("y"), F.col("s").alias("t"), F.col("p").alias("q"), F.col("root").alias("_root"))
        met = outside.join(chosen, "key").where("root <> _root").where(_enough(threshold)).select("x", "y")
        met = met if turn else met.unionAll(proposed.select(F.col("u").alias("x"), F.col("v").alias("y")))
        close = scratch.cut(close_pairs(_pairs(met), nodes, threshold))
        if reached is not None:
            scratch.drop(placed)
        sets = shingle_sets(close.select(F.explode(F.array("u", "v")).alias("node")).distinct(), rows, nodes, scratch, n)
        found = scratch.cut(verified(close, sets, threshold))
        scratch.drop(sets)
        if reached is None:
            reached = connected_components(found, scratch)
        elif not found.isEmpty():
            reached = connected_components(reached.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(found), scratch)
    return reached


def representatives(docs: DataFrame, scratch: Scratch, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, h, c): ids, with hash and checksum of the text, of the documents that stay: the smallest id of each group.

    Groups link equal texts and texts whose shingle sets are alike to ``threshold``; texts without a word are alike.
    Fingerprints of three-word shingles that differ in at most two bits propose pairs, but don't link by themselves.
    Documents with a null id are no part of it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), text.alias("text"))
    common, rank = common_shingles(rows, n)
    sketched = in_batches(rows, partial(_sketched, common=common, rank=rank, n=n, threshold=threshold), "doc_id long, h long, c long, fingerprint long, size int, prefix array<long>, rare int, odd array<long>")
    least = F.min_by(F.struct("fingerprint", "size", "prefix", "rare", "odd"), "doc_id").alias("first")
    nodes = scratch.cut(sketched.groupBy("h", "c").agg(F.min("doc_id").alias("node"), least).select("node", "h", "c", "first.*"))
    # texts without a word have no shingle to meet by: of the fingerprint zero one of them is the first
    prints = scratch.cut(nodes.groupBy("fingerprint").agg(F.min_by("node", F.struct("size", "node")).alias("first")))
    same = nodes.join(prints, "fingerprint").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    name = lambda c: prints.select(F.col("fingerprint").alias(c), F.col("first").alias(f"_{c}"))
    near = links(prints.select("fingerprint"), scratch).join(name("u"), "u").join(name("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    reached = alike_groups(same.unionAll(near), rows, nodes, scratch, n, threshold)
    lost = reached.where("node <> root").select("node").distinct()
    return scratch.cut(nodes.select("node", "h", "c").join(lost, "node", "left_anti"))


def drop_near_copies(docs: DataFrame, scratch: Scratch, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one document of each group (see representatives()), all columns as they were.

    Documents without an id can't be told apart and all stay; repeated rows (id and text) of a kept id become one; null
    and empty texts are one group. An empty table gives no rows.
    """
    keep = representatives(docs, scratch, n, threshold, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h, c, nth = (free_name(docs.columns, x) for x in ("_h", "_c", "_nth"))
    own = docs.where(F.col(id_col).isNotNull()).withColumn(h, F.xxhash64(text)).withColumn(c, F.crc32(text.cast("binary")))
    keep = keep.toDF(*(free_name(own.columns, x) for x in ("_node", "_kept_h", "_kept_c")))
    kept = own.join(keep, (F.col(id_col).cast("long") == F.col(keep.columns[0])) & (F.col(h) == F.col(keep.columns[1])) & (F.col(c) == F.col(keep.columns[2])), "left_semi")
    if not own.groupBy(id_col, h, c).count().where("count > 1").isEmpty():
        kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, h, c).orderBy(id_col))).where(F.col(nth) == 1)
    once = kept.select(*docs.columns)
    return once.unionAll(docs.where(F.col(id_col).isNull()))
