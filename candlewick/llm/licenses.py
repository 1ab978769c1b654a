"""License scan by an exact set-similarity join of word windows with templates; DataFrame functions only.

A template is found where some run of ``span`` consecutive words holds its token set to the threshold t, wherever the
run starts. Tokens are ordered by their frequency in all documents, rarest first. A run that holds ceil(t m) of m
tokens has one of the template's first m - ceil(t m) + 1 tokens (prefix filter), so only the surroundings of these are
looked at; they must hold enough of the template's tokens (length filter), and enough from the shared one on
(positional filter). What passes is counted exactly over all runs around the shared token. Texts are cut into words
once; from there on only places of template tokens are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORD, LOWER, UPPER, Scratch, ascii_lower, literal_array

#: Phrases that name a license wherever their words stand consecutively.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices of other licenses, or other wordings, found by containment of their words.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this library is free software under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the mozilla public license version 2 0", "mpl-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing", "apache-2"),
]
#: Words in a run, at least; a template of more than half as many words has runs of twice its words.
SPAN = 64


def _templates(base: list, more: list, threshold: float) -> list[dict]:
    out = []
    for i, (text, label) in enumerate([*base, *more]):
        words = text.split()
        if not words:
            raise ValueError("a template has a word at least")
        exact = i < len(base)
        size = len(set(words))
        span = len(words) if exact else max(SPAN, 2 * len(words))
        out.append({"id": i, "label": label, "words": words, "base": exact, "need": size if exact else -int(-threshold * size // 1), "size": size, "span": span})
    return out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_WORD), F.lit(0))


def _placed(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, hits array<struct<p, w>>): the places of template tokens in each row's words, from 0."""
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.col(text_col).cast("string")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda h: h["w"].isin(vocabulary))
    return words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def _prefixes(placed: DataFrame, templates: list[dict], vocabulary: list[str]) -> tuple[DataFrame, list[str]]:
    """The prefix index (as many rows as the templates have words at most), and the vocabulary from the rarest token on, ties by the token."""
    counted = placed.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t in templates:
        tokens = sorted(set(t["words"]), key=rank.get)
        for place, token in enumerate(tokens[: t["size"] - t["need"] + 1]):
            numbers = {"template": t["id"], "need": t["need"], "size": t["size"], "span": t["span"], "place": place, "at": t["words"].index(token)}
            rows.append(F.struct(F.lit(token).alias("token"), F.lit(t["base"]).alias("base"), *[F.lit(v).alias(k) for k, v in numbers.items()], literal_array(tokens, "string").alias("tokens"), literal_array(t["words"], "string").alias("words")))
    return placed.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*rows))), order


def matches(placed: DataFrame, base: list = BASE_PHRASES, more: list = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(row, template int, containment, starts long, first_word, last_word): templates that each row of _placed() holds.

    Base phrases need all their words next to each other; starts counts their places, the others have none.
    """
    templates = _templates(base, more, threshold)
    vocabulary = sorted({w for t in templates for w in t["words"]})
    prefixes, order = _prefixes(placed, templates, vocabulary)
    heads, reach = sorted({r["token"] for r in prefixes.select("token").collect()}), max(t["span"] for t in templates)
    # around each prefix token as many hits as can lie within the longest run; nothing else leaves a row
    around = F.transform("hits", lambda h, i: F.struct(h["p"].alias("p"), h["w"].alias("w"), F.slice("hits", F.greatest(i - (reach - 2), F.lit(1)), 2 * reach - 1).alias("near")))
    asked = placed.where(F.arrays_overlap("hits.w", literal_array(heads, "string"))).select("row", F.explode(F.filter(around, lambda x: x["w"].isin(heads))).alias("h")).select("row", "h.*")
    met = asked.join(F.broadcast(prefixes), F.col("w") == F.col("token")).drop("token")
    own = F.filter("near", lambda h: (F.abs(h["p"] - F.col("p")) < F.col("span")) & F.array_contains("tokens", h["w"]))
    held = F.array_intersect("tokens", "held.w")
    left = F.least(F.size(held) - F.array_position(held, F.col("w")) + 1, F.col("size") - F.col("place"))
    close = met.withColumn("held", own).where((F.size(held) >= F.col("need")) & (left >= F.col("need")))
    # exact: the run that starts at each of the template's tokens around; or the phrase's words one by one
    run = lambda s: F.size(F.array_distinct(F.transform(F.filter("held", lambda h: (h["p"] >= s["p"]) & (h["p"] < s["p"] + F.col("span"))), lambda h: h["w"])))
    best = F.array_max(F.transform("held", run))
    start = F.col("p") - F.col("at")
    whole = F.forall(F.transform("words", lambda w, j: F.exists("held", lambda h: (h["p"] == start + j) & (h["w"] == w))), lambda x: x)
    counted = close.withColumn("overlap", F.when(~F.col("base"), best).otherwise(F.when(whole, F.col("size")).otherwise(0))).where("overlap >= need")
    place = F.when(F.col("base"), start).cast("long")
    return counted.groupBy("row", "template").agg((F.max("overlap") / F.max("size")).alias("containment"), F.count(place).alias("starts"), F.min(place).alias("first_word"), F.max(place).alias("last_word"))


def scan(docs: DataFrame, base: list = BASE_PHRASES, more: list = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z are lower-cased; words are runs of ASCII letters and digits and of anything beyond ASCII. n_base counts the
    places where a base phrase's words stand consecutively, first_word and last_word are the least and largest of
    their starts (words from 0; null if there is none). labels adds the templates that some run of words contains to
    ``threshold``; score is the largest containment found (0 if nothing was). Null and empty texts have no words.
    Rows that share an id, or have none, have findings of their own each. An empty table gives no rows; other columns
    are not read. Places of template tokens are written once as a scratch table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "licenses")
    templates = _templates(base, more, threshold)
    placed = scratch.cut(_placed(docs, sorted({w for t in templates for w in t["words"]}), id_col, text_col))
    label = F.element_at(literal_array([t["label"] for t in templates], "string"), F.col("template") + 1)
    found = matches(placed, base, more, threshold).withColumn("label", label).withColumn("base", F.col("template") < len(base))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_row = found.groupBy("row").agg(
        F.sum("starts").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("containment").alias("score"),
    )
    return placed.select("row", "doc_id", "n_words").join(by_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def sql(base: list = BASE_PHRASES, more: list = TEMPLATES, threshold: float = 0.8) -> str:
    """scan() in DuckDB's SQL: the run that starts at every template token of every document, against every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = _templates(base, more, threshold)
    rows = ", ".join(f"('{t['label']}', {t['id']}, {str(t['base']).lower()}, {quoted(t['words'])}, {quoted(dict.fromkeys(t['words']))}, {t['need']})" for t in templates)
    runs = "\nUNION ALL ".join(
        f"SELECT doc_id, id, max(len(list_distinct(v)) / n) AS share FROM (SELECT doc_id, id, len(tokens) AS n, need, list(w) OVER (PARTITION BY doc_id, id ORDER BY p RANGE BETWEEN CURRENT ROW AND {span - 1} FOLLOWING) AS v FROM k WHERE id IN ({', '.join(str(t['id']) for t in templates if not t['base'] and t['span'] == span)})) WHERE len(list_distinct(v)) >= need GROUP BY 1, 2"
        for span in sorted({t["span"] for t in templates if not t["base"]})
    )
    return f"""
WITH t(label, id, base, words, tokens, need) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ASCII_WORD}') AS w FROM documents),
p AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, label, w, words, unnest(range(1, len(w) - len(words) + 2)) AS i FROM d, t WHERE base AND list_has_all(w, tokens)) WHERE w[i:i + len(words) - 1] = words),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1),
h AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d), x AS (SELECT id, need, tokens, unnest(tokens) AS w FROM t WHERE NOT base), k AS (SELECT doc_id, id, need, tokens, p, w FROM h JOIN x USING (w)),
r AS ({runs}),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, 1.0 AS share FROM p UNION ALL SELECT doc_id, label, share FROM r JOIN t USING (id)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
