"""Document fingerprints by winnowing, and likeness of neighbouring and edited texts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE_WORD, ascii_lower, bind, range_bounds, range_of


def winnowed(text: Column, k: int = 3, w: int = 16) -> Column:
    """array<struct<hash, back>>: the winnowed k-grams of a text in order of position, which is -back.

    Words are runs of anything but ASCII white space, A-Z in lower case; each run of k words is hashed to 64 bits, word
    upon word (fewer words: all of them; none: no fingerprint), and of each window of w hashes the least is kept, the
    rightmost of equals. Texts that share k + w - 1 consecutive words share a kept hash; nothing shorter than k words is
    ever matched.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_SPACE_WORD), F.lit(0))
    return bind(bind(words, lambda x: _grams(x, k)), lambda x: _minima(x, w))


def _grams(words: Column, k: int) -> Column:
    """Structs whose order is that of the hashes, and among equals the rightmost first."""
    marked = lambda x, i: F.struct(F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)]).alias("hash"), (-i).alias("back"))
    return F.slice(F.transform(words, marked), F.lit(1), F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.size(words) - (k - 1), F.lit(1))))


def _minima(grams: Column, w: int) -> Column:
    """Window minima in order of position; windows that keep the same gram follow each other, so each is kept once."""
    last = F.greatest(F.size(grams) - w, F.lit(0))
    kept = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice(grams, i + 1, w)))
    once = bind(kept, lambda x: F.filter(x, lambda g, i: (i == 0) | (g["back"] != F.get(x, i - 1)["back"])))
    return F.when(F.size(grams) == 0, grams).otherwise(once)


def hashes(selected: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(selected, lambda x: x["hash"]))


def positions(selected: Column) -> Column:
    """array<struct<hash, position>> of a fingerprint."""
    return F.transform(selected, lambda x: F.struct(x["hash"].alias("hash"), (-x["back"]).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; 1 if both are empty."""
    x, y = hashes(a), hashes(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def fingerprints(docs: DataFrame, k: int = 3, w: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint array<struct<hash, position>>) of every whole text; null and empty texts have none."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), positions(winnowed(F.col(text_col), k, w)).alias("fingerprint"))


def digest(selected: Column) -> Column:
    """A fingerprint's hashes and positions as 32 hex digits: equal for equal texts."""
    return F.md5(F.array_join(F.transform(selected, lambda x: F.concat_ws(":", x["hash"].cast("string"), x["back"].cast("string"))), ","))


def with_next(docs: DataFrame, carried: list[str], parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with next_<column> of ``carried`` from the row that follows by id; the first row follows the last.

    Rows are parted by ranges of the id, so that one shuffle brings neighbours together and no task has them all. The
    first row of each range is also sent to the range before it. Null ids come first; rows that share an id are in
    order of their texts (null first). At most ``parts`` bounds and first ids are collected.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    bounds = range_bounds(docs.select(order.alias("id")), min(parts, 4096))
    firsts = sorted((r["b"], r["o"]) for r in docs.groupBy(range_of(order, bounds).alias("b")).agg(F.min(order).alias("o")).collect())
    if not firsts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried]).limit(0)
    # every column goes in one struct, so that no name can clash
    whole = docs.select(F.struct("*").alias("row"), order.alias("at"), range_of(order, bounds).alias("home"))
    before = {o: firsts[i - 1][0] for i, (_, o) in enumerate(firsts)}
    places = F.create_map(*[x for o, b in before.items() for x in (F.lit(o).cast("long"), F.struct(F.lit(b).alias("b"), F.lit(o == firsts[0][1]).alias("wraps")))])
    guest = F.element_at(places, F.col("at"))
    home = F.struct(F.col("home").alias("b"), F.lit(False).alias("wraps"), F.lit(False).alias("guest"))
    also = F.struct(guest["b"].alias("b"), guest["wraps"].alias("wraps"), F.lit(True).alias("guest"))
    sent = whole.select("row", "at", F.explode(F.when(guest.isNull(), F.array(home)).otherwise(F.array(home, also))).alias("to")).select("row", "at", "to.*")
    line = Window.partitionBy("b").orderBy("wraps", "at", "guest", F.col(f"row.{text_col}"))
    led = sent.select("row", "guest", *[F.lead(F.col(f"row.{c}")).over(line).alias(f"n{i}") for i, c in enumerate(carried)])
    return led.where("not guest").select("row.*", *[F.col(f"n{i}").alias(f"next_{c}") for i, c in enumerate(carried)])


def edited(docs: DataFrame, k: int = 3, w: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses; one row per row of ``docs``.

    The edited text has its last floor(n / 2) of n code points replaced by the first as many (or all) of the next
    document's, in order of the id; the first document follows the last one. Columns: doc_id, n_chars, edited_sha256,
    fingerprint and edited_fingerprint (arrays, see winnowed()), near_edited and near_next. Null texts are
    empty; see with_next() for null and repeated ids. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # hashes and places travel as two plain arrays: structs would take three times the room
    apart = F.struct(F.transform("f", lambda x: x["hash"]).alias("hash"), F.transform("f", lambda x: x["back"]).alias("back"))
    made = with_next(rows.withColumn("f", winnowed(F.col("text"), k, w)).withColumn("f", apart).select("doc_id", "text", "f.*"), ["text", "hash"])
    together = F.zip_with("hash", "back", lambda h, b: F.struct(h.alias("hash"), b.alias("back")))
    made = made.withColumn("fingerprint", together).withColumn("next_fingerprint", F.transform("next_hash", lambda h: F.struct(h.alias("hash"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    changed = made.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    printed = changed.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", winnowed(F.col("edited"), k, w).alias("edited_fingerprint"), "next_fingerprint")
    return printed.select("*", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")).drop("next_fingerprint")
