"""Source divergence: how each source's use of terms differs from that of the other sources of its language.

Counts of terms become one wide vector a term, indexed by the sources of its language; higher-order functions turn a
vector into contributions of pairs of sources, and map-side aggregation adds them up. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, bind, in_batches

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Counts of (language, source, term) that a task adds up before it passes them on.
HELD = 500_000
#: Rows of the table of groups (languages by sources) that are broadcast at most; the output has their square.
BROADCAST_GROUPS = 20_000
#: Parts that a language's terms are dealt over where that table is too large for a broadcast.
SALTS = 64


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) for whole numbers with count <= total < 9 * 10^15, by long division in steps of three digits."""
    whole, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + _div(rest, total), rest % total
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) for longs up to 10^9 + 1."""
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, uses, documents) of docs (lang, source, text): counted in each task, then added up.

    On the bytes of a text every ASCII character that isn't a letter becomes a space, and letters lower case; what stands
    between spaces are its terms. A task holds HELD counts and a piece of one text. The one shuffle is by language and term, which
    serves the grouping by term as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, having = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                terms, seen = uses[lang, source], set()
                for piece in _pieces(text.translate(_SPACED)):
                    found = piece.split()
                    terms.update(found)
                    seen.update(found)
                having[lang, source].update(seen)
                if sum(map(len, uses.values())) > HELD:
                    yield from _flushed(uses, having)
        yield from _flushed(uses, having)

    made = in_batches(docs.select("lang", "source", "text"), run, "lang string, source string, term string, uses long, documents long")
    return made.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("uses").alias("uses"), F.sum("documents").alias("documents"))


def _pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text cut at spaces into pieces of some ``size`` bytes."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _flushed(uses: dict, having: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), terms in uses.items():
        listed, counts = list(terms), having[lang, source]
        for at in range(0, len(listed), 1 << 16):
            part = listed[at : at + (1 << 16)]
            own = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in part], pa.int64()), pa.array([counts[t] for t in part], pa.int64())], names=["lang", "source", "term", "uses", "documents"])
    uses.clear()
    having.clear()


def audit(docs: DataFrame, scratch: Scratch | None = None, least_documents: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence, and the source's own terms.

    Reads text, lang and source of ``docs``; NULLs are ''. A-Z are lower-cased. A language keeps the terms in at least
    ``least_documents`` of its documents (rows; a repeated row counts again). A group's p of a kept term with n uses
    there is 1 + floor(10^9 (n + 2) / (N + 2 V)), for N uses of all V kept terms; likewise a language's q. Part `pair` has every
    other source, by the sum of floor((p - q)^2 / (p + q)) over all kept terms (0 without any); part `term` has the
    ``top`` kept terms that the group uses and whose p is beyond the language's. Ties go by item in UTF-8 order. A
    language with one source has no pairs, an empty table no rows. Counts up to 9 * 10^15 are exact.
    Term vectors and their shares are written once as scratch tables.
    """
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vectors = scratch.cut(
        term_counts(texts).groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sort_array(F.collect_list(F.struct("source", "uses"))).alias("used"))  # one entry a source
        .where(F.col("documents") >= least_documents).select("lang", "term", "used")
    )
    totals = vectors.select("lang", F.inline("used")).groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = scratch.cut(
        texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", (F.coalesce("total", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0))).cast("long").alias("weight"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    )
    by_lang = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("sources"),  # one entry a source
        (F.sum("weight") - 2 * (F.count("*") - 1) * F.max("terms")).cast("long").alias("weight"),
    )
    wide = _with_groups(vectors, groups, by_lang)
    # a term's p in every source of its language, in their order: the vector is filled up from the sources that use it
    shares = scratch.cut(wide.select("lang", "term", "used", "sources", share(F.aggregate("used", F.lit(0).cast("long"), lambda a, u: a + u["uses"]) + 2, F.col("weight")).alias("q"), _dense().alias("p")))
    n = F.size("p")
    pairs = F.flatten(
        F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), distance(F.col("p")[i], F.col("p")[j]).alias("value"))))
    )
    summed = shares.where(n > 1).select("lang", F.inline(pairs)).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    # every pair of a language, also without kept terms; as many rows as the result has
    names = by_lang.where(F.size("sources") > 1).select("lang", F.posexplode(F.transform("sources", lambda s: s["source"])).alias("at", "source"), "sources")
    all_pairs = names.select("lang", "source", "at", F.posexplode(F.transform("sources", lambda s: s["source"])).alias("other", "item")).where("at <> other")
    keyed = all_pairs.select("lang", "source", "item", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    pair = keyed.join(summed, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    own = F.filter(F.transform("used", lambda u: F.struct(u["source"].alias("source"), F.get(F.col("p"), F.array_position(F.transform("sources", lambda s: s["source"]), u["source"]).cast("int") - 1).alias("p"))), lambda u: u["p"] > F.col("q"))
    term = shares.select("lang", F.col("term").alias("item"), "q", F.inline(own)).select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = term.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(place)).unionByName(best)


def _with_groups(vectors: DataFrame, groups: DataFrame, by_lang: DataFrame) -> DataFrame:
    """vectors with their language's sources: by broadcast where the counted groups are few, else dealt over salts."""
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return vectors.join(F.broadcast(by_lang), "lang")
    salted = by_lang.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return vectors.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")


def _dense() -> Column:
    """p of every source: those that use the term are merged with all of the language, both in order of their names."""
    uses = F.map_from_entries("used")
    return bind(uses, lambda m: F.transform("sources", lambda s: share(F.coalesce(F.try_element_at(m, s["source"]), F.lit(0).cast("long")) + 2, s["weight"])))


#: audit() of `documents` in DuckDB's SQL.
SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_sort(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM documents),
x AS (SELECT lang, source, unnest(t) AS term, unnest(list_transform(t, lambda v, i: (i = 1 OR t[i - 1] <> v)::INT)) AS first FROM d),
c AS (SELECT lang, source, term, count(*) AS uses, sum(first) AS docs FROM x GROUP BY ALL),
k AS (SELECT lang, term, sum(uses)::HUGEINT AS uses FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(uses)::HUGEINT AS n FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v.v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(c.uses)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.uses, 0) AS uses, 1 + 1000000000 * (coalesce(c.uses, 0) + 2) // (g.n + 2 * g.v) AS p, 1 + 1000000000 * (k.uses + 2) // (v.n + 2 * v.v) AS q FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
w AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE uses > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
