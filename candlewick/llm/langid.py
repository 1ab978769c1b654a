"""Language identification by string kernels: blended-spectrum presence kernels, Nyström landmarks, kernel ridge.

The kernel of two texts is the number of n-grams (1 to 4 letters, lower case, other signs as blanks) that both hold,
divided by the root of the product of how many each holds. Landmarks are sample texts; Nyström features and
one-versus-rest ridge weights fold into one weight for each n-gram bucket and language, so that a batch of texts is
scored by one sparse matrix product of its presence rows with these weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches

#: Texts that are scored at a time.
_TEXTS_AT_ONCE = 64
#: Hash buckets of n-grams.
BUCKETS = 1 << 17
_ORDERS = 4
#: Code points with a class of their own; those beyond count as blanks.
_POINTS = 0x40000
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a blank."""
    if "letters" not in _tables:
        table = np.full(_POINTS, 32, dtype=np.uint32)
        for i in range(_POINTS):
            if chr(i).isalpha():
                table[i] = ord(chr(i).lower()[0])
        _tables["letters"] = table
    return _tables["letters"]


def presence(text: str, at_once: int = 4_000_000) -> np.ndarray | None:
    """Sorted buckets of the n-grams that a whole text holds; None if it has no letter."""
    flags, table, found = np.zeros(BUCKETS, dtype=bool), _letters(), False
    for lo in range(0, len(text), at_once):
        part = text[lo : lo + at_once + _ORDERS - 1]
        points = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32)
        points = table[np.minimum(points, _POINTS - 1)]
        found = found or bool((points != 32).any())
        gram = points
        for n in range(1, _ORDERS + 1):
            if n > 1:
                if len(points) < n:
                    break
                gram = gram[:-1] * np.uint32(0x01000193) + points[n - 1 :]
            mixed = (gram ^ (gram >> np.uint32(15)) ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            flags[mixed >> np.uint32(15)] = True
    return np.flatnonzero(flags) if found else None


@dataclass
class KernelModel:
    languages: list[str]
    weights: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """One line of language scores for each presence row: a sparse matrix product."""
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        sums = np.add.reduceat(self.weights[np.concatenate(rows)], np.cumsum(counts) - counts, axis=0)
        return sums / np.sqrt(counts)[:, None]


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where("not held_out and id is not null and lang is not null and text is not null")


def sample(docs: DataFrame, per_language: int, at_most: int) -> DataFrame:
    """Up to per_language labelled rows of each language, at_most in all, chosen by a hash of id and text.

    Languages are counted first, so that a threshold on the hash leaves a few times the rows wanted and no task ranks
    a frequent language as a whole.
    """
    rows = _learnable(docs).withColumn("mark", F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 62) - 1)) / float(1 << 62))
    sizes = rows.groupBy("lang").count()
    kinds = sizes.count()
    if not kinds:
        return rows.limit(0).withColumn("rank", F.lit(0))
    each = max(2, min(per_language, at_most // kinds))
    # a map of at most at_most languages; beyond that a join, since each language then has two rows
    if kinds <= at_most:
        share = F.create_map(*[F.lit(x) for r in sizes.collect() for x in (r["lang"], (4 * each + 20) / r["count"])])
        near = rows.where(F.col("mark") < F.element_at(share, F.col("lang")))
    else:
        near = rows.join(sizes, "lang").where(F.col("mark") * F.col("count") < 4 * each + 20)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "id"))).where(F.col("rank") <= each)


def fit(docs: DataFrame, per_language: int = 256, at_most: int = 2048, landmarks: int = 32, ridge: float = 0.02) -> KernelModel:
    """Learns from ``docs`` (id, text, lang, held_out): a sample of at most ``at_most`` labelled rows, the first
    ``landmarks`` of each language being landmarks. Only presence bits of the sample reach the driver (16 kB a row).
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, rank, out = [], [], []
            for name, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = presence(text)
                if found is not None:
                    flags = np.zeros(BUCKETS, dtype=np.uint8)
                    flags[found] = 1
                    lang.append(name), rank.append(place), out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(rank, pa.int32()), pa.array(out, pa.binary())], names=["lang", "rank", "bits"])

    chosen = sample(docs, per_language, at_most).select("lang", "rank", "text")
    rows = sorted(in_batches(chosen, bits, "lang string, rank int, bits binary").collect(), key=lambda r: (r["lang"], r["rank"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return KernelModel([], np.zeros((BUCKETS, 0), dtype=np.float32))
    packed = np.stack([np.frombuffer(r["bits"], dtype=np.uint8) for r in rows])
    order = {}
    for i, r in enumerate(rows):
        order.setdefault(r["lang"], []).append(i)
    marks = np.array([i for lang in languages for i in order[lang][:landmarks]])
    common, step = np.zeros((len(rows), len(marks))), BUCKETS // 32 // 8
    for lo in range(0, packed.shape[1], step):
        part = np.unpackbits(packed[:, lo : lo + step], axis=1).astype(np.float32)
        common += part @ part[marks].T
    own = np.bitwise_count(packed).sum(axis=1).astype(float)
    kernel = common / np.sqrt(np.outer(own, own[marks]))
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in languages] for r in rows])
    share = np.array([1 / len(order[r["lang"]]) for r in rows])[:, None]
    solved = np.linalg.solve((features * share).T @ features + ridge * np.eye(features.shape[1]) / len(languages), (features * share).T @ target)
    alpha = (root @ solved) / np.sqrt(own[marks])[:, None]
    weights = np.zeros((BUCKETS, len(languages)), dtype=np.float32)
    for lo in range(0, packed.shape[1], step):
        weights[8 * lo : 8 * (lo + step)] = np.unpackbits(packed[marks, lo : lo + step], axis=1).T @ alpha
    return KernelModel(languages, weights)


def predict(docs: DataFrame, model: KernelModel, extra: list[str]) -> DataFrame:
    """lang_pred and score (0 to 1, the largest of a softmax of the scores) beside the columns ``extra``; reads text only.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned.
    """
    shown = docs.select(*extra, "text")
    schema = docs.select(*extra).schema.add("lang_pred", "string").add("score", "double")

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = ["und"] * len(batch), np.zeros(len(batch))
            rows, at = [], []
            for i, text in enumerate(batch.column(len(extra))):
                found = presence(text.as_py() or "") if model.languages else None
                if found is not None:
                    rows.append(found), at.append(i)
                if rows and (len(rows) == _TEXTS_AT_ONCE or i == len(batch) - 1):
                    line = model.score(rows) * 4
                    chance = np.exp(line - line.max(axis=1, keepdims=True))
                    chance /= chance.sum(axis=1, keepdims=True)
                    for k, best, c in zip(at, line.argmax(axis=1), chance.max(axis=1), strict=True):
                        names[k], scores[k] = model.languages[best], c
                    rows, at = [], []
            if rows:
                line = model.score(rows) * 4
                chance = np.exp(line - line.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                for k, best, c in zip(at, line.argmax(axis=1), chance.max(axis=1), strict=True):
                    names[k], scores[k] = model.languages[best], c
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], pa.array(names), pa.array(scores)], names=schema.names)

    return in_batches(shown, guess, schema)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, text, lang, held_out): crc32 of the id as text, modulo 3, is 1 for rows that are never learned from."""
    key = docs[id_col].cast("string")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), F.coalesce(F.crc32(key.cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    Learns from rows that are not held out; language, source and id are no inputs of a prediction. A null id is
    predicted but not learned from; repeated rows are predicted each; texts are read whole. An empty table gives no
    rows; other columns are not read.
    """
    rows = labelled(docs, id_col, text_col, lang_col)
    return predict(rows, fit(rows, **fitting), ["id", "held_out"]).withColumnRenamed("id", "doc_id")


def keep_known(docs: DataFrame, languages: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """The documents whose predicted language is learned (and among ``languages``, if given), all columns as they were."""
    model = fit(labelled(docs, id_col, text_col, lang_col), **fitting)
    keep = set(model.languages if languages is None else languages) - {"und"}
    names, at = docs.columns, docs.columns.index(text_col)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.zeros(len(batch), dtype=bool)
            for lo in range(0, len(batch) if model.languages else 0, _TEXTS_AT_ONCE):
                found = [presence(t.as_py() or "") for t in batch.column(at).slice(lo, _TEXTS_AT_ONCE)]
                places = [i for i, r in enumerate(found) if r is not None]
                if places:
                    best = model.score([found[i] for i in places]).argmax(axis=1)
                    flags[[lo + i for i in places]] = [model.languages[k] in keep for k in best]
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(flags))

    return in_batches(docs, known, docs.schema)
