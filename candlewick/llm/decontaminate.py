"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item of m distinct shingles that is contained to t lacks at most m - ceil(t m) of them in the document, so
one of its m - ceil(t m) + 1 least shingle hashes (its bottom-k MinHash sketch) is there for certain. Items are parted
by size, doubling from class to class, and k is set by each class's largest size: no contained item is missed, however
long the document is. All documents meet the sketches only; the full sets of items meet the documents that hold a
sketched shingle, and only pairs that a sketch proposed are counted. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORD, Scratch, ascii_lower, free_name

#: Rows of the items' sketches, sets or candidate pairs up to which they are broadcast (16 MB); beyond, the join shuffles.
BROADCAST_ROWS = 400_000


def words_of(text):
    """Runs of letters and digits, A-Z in lower case; anything beyond ASCII counts as a letter."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_WORD), F.lit(0))


def shingles(words, n: int):
    """Hashes of all runs of n words; none if there are fewer."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, n)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def item_index(items: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n, shingle, sketched, need, m): every distinct shingle of every item; items of fewer words than n have one shingle of all of them."""
    words = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    width = F.least(F.size("words"), F.lit(n))
    hashed = F.coalesce(*[F.when(width == k, shingles(F.col("words"), k)) for k in range(1, n + 1)])
    sets = words.select("item_id", width.alias("n"), F.array_sort(F.array_distinct(hashed)).alias("set")).withColumn("m", F.size("set"))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m")))).cast("int")
    sketch = F.floor(largest * (1 - threshold) + 1e-9) + 1
    return sets.withColumns({"k": sketch, "need": F.ceil(F.col("m") * threshold - 1e-9)}).select("item_id", "n", "m", "need", "k", F.posexplode("set").alias("rank", "shingle")).select(
        "item_id", "n", "shingle", (F.col("rank") < F.col("k")).alias("sketched"), "need", "m"
    )


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _met(read: DataFrame, index: DataFrame, widths: list[int], rows: int) -> DataFrame:
    """Every place of a document that holds a shingle of the index, joined with its rows."""
    found = None
    for width in widths:
        seen = read.select("doc_id", F.explode(shingles(F.col("words"), width)).alias("shingle"))
        hits = seen.join(_bounded(index.where(F.col("n") == width).drop("n"), rows), "shingle")
        found = hits if found is None else found.unionAll(hits)
    return found


def candidates(docs: DataFrame, index: DataFrame, widths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id): the document holds a shingle of the item's sketch; contained items are among them."""
    sketches = index.where("sketched").select("n", "shingle", "item_id")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    return _met(read, sketches, widths, sketches.count()).select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item that a document holds to ``threshold`` or more.

    Shingles are sets of ``n`` words; an item of fewer words is one shingle of all its words, looked for among the
    document's runs of that many. Null or empty texts hold nothing and items without a word are found nowhere. Rows
    that share an id are one document (a null id too). Empty tables give no rows; other columns are not read.
    Sketches, sets and candidate pairs are broadcast only up to BROADCAST_ROWS rows; more are joined by shuffles.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    index = scratch.cut(item_index(items, n, threshold, item_col, item_text_col))
    widths = sorted(r["n"] for r in index.select("n").distinct().collect())  # n of them at most
    if not widths:
        empty = "doc_id long, item_id long, n_shared long, n_item long, containment double"
        return docs.sparkSession.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in empty.split(", ")])
    pairs = scratch.cut(candidates(docs, index, widths, id_col, text_col))
    asked = pairs.groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("items"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = own.join(_bounded(asked.select("_doc"), asked.count()), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    sets = index.select("n", "shingle", "item_id", "need", "m")
    hits = _met(own.select("doc_id", words_of(F.col("text")).alias("words")), sets, widths, sets.count())
    proposed = pairs.select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item"))
    kept = hits.join(_bounded(proposed, pairs.count()), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("item_id") == F.col("_item")), "left_semi")
    counted = kept.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"), F.max("need").alias("need"), F.max("m").cast("long").alias("n_item"))
    return counted.where("n_shared >= need").select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, all columns as they were; a null id goes if any document without id holds one."""
    name = free_name(docs.columns, "_lost")
    lost = contained_items(docs, items, n, threshold, id_col, text_col, item_col, item_text_col).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")


#: The same search in DuckDB's SQL; {n} words, {threshold}.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
e AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), {n}) AS n, unnest(range(1, len(w) - least(len(w), {n}) + 2)) AS k FROM i WHERE len(w) > 0)),
m AS (SELECT item_id, count(*) AS n_item FROM e GROUP BY item_id),
g AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM e) WHERE len(w) >= n)),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM g JOIN e USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN m USING (item_id) WHERE n_shared >= ceil(n_item * {threshold} - 1e-9)
"""
