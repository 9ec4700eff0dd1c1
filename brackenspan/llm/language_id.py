"""Language identification by nearest centroid.

A text's vector is the TF-IDF of its hashed byte n-grams (of lower-cased text), of unit length. Each language
has several centroids, found by spherical k-means on a bounded sample; the nearest by cosine names the
language, and a cosine below what nearly all of that language's own texts reach rejects the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brackenspan.llm.common import in_small_batches, per_slice, table, text_or_empty, train_fold

SAMPLE = 1_000
DIMENSION = 4096
CENTROIDS = 3
REJECTED_SHARE = 0.005
FOLD, HELD = 5, 0
UNKNOWN = "und"


@dataclass
class Model:
    languages: list
    idf: np.ndarray
    centroids: np.ndarray  # (languages * centroids) x dimension, unit length
    owner: np.ndarray
    least: np.ndarray  # by language


_NO_LETTERS = re.compile(r"[\W\d_]+")


def n_grams(text: str) -> np.ndarray:
    """Hashed counts of byte pairs and triples of the lower-cased words, a space between and around them."""
    raw = np.frombuffer(f" {_NO_LETTERS.sub(' ', text.lower())} ".encode(), dtype=np.uint8).astype(np.uint32)
    pairs = raw[:-1] * np.uint32(257) + raw[1:]
    triples = pairs[:-1] * np.uint32(263) + raw[2:] + np.uint32(1 << 24)
    mixed = np.concatenate([pairs, triples]) * np.uint32(2654435761)
    return np.bincount(mixed >> np.uint32(20), minlength=DIMENSION)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_k_means(x: np.ndarray, k: int, seed: int = 5, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[near == c].sum(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit_rows(texts: list[str], languages: list[str], centroids: int = CENTROIDS) -> Model:
    names = sorted(set(languages))
    counts = np.stack([n_grams(t) for t in texts])
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    x = weighted(counts, idf)
    groups = np.array(languages)
    found, owner, least = [], [], []
    for k, name in enumerate(names):
        own = x[groups == name]
        centres = spherical_k_means(own, min(centroids, len(own)))
        found.append(centres)
        owner += [k] * len(centres)
        least.append(np.quantile((own @ centres.T).max(1), REJECTED_SHARE))
    return Model(names, idf.astype(np.float32), np.concatenate(found).astype(np.float32), np.array(owner), np.array(least))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE) -> Model:
    """From about ``rows`` distinct texts of each language of ``docs``, those of the least hashes; texts without a letter teach nothing.

    Copies of a text count once, and are dropped before anything reaches the driver.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    at = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 20))
    n = {r["lang"]: max(r["n"], 1) for r in known.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    if not n:
        return Model([], np.ones(DIMENSION, np.float32), np.zeros((0, DIMENSION), np.float32), np.zeros(0, int), np.zeros(0))
    share = F.element_at(F.create_map(*(F.lit(v) for lang, c in n.items() for v in (lang, min(1.0, rows / c)))), F.col("lang"))
    some = known.where(at < share * F.lit(1 << 20)).distinct().toArrow().to_pandas()
    if not set(n) <= set(some["lang"]):
        # A language whose few texts all missed the share takes part with those of its least hashes.
        few = [lang for lang in n if lang not in set(some["lang"])]
        least = known.where(F.col("lang").isin(few)).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(13)), "text")))
        some = pd.concat([some, least.where(F.col("nth") <= rows).drop("nth").toArrow().to_pandas()])
    some = some.sort_values(["lang", "text"], kind="stable")
    return fit_rows(some["text"].tolist(), some["lang"].tolist())


def _predict(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    texts, letters = part["text"].to_pylist(), part["letters"].to_pylist()
    names, scores, rejected = [], [], []
    has = [k for k, y in enumerate(letters) if y] if model.languages else []
    cosine = weighted(np.stack([n_grams(texts[k]) for k in has]), model.idf) @ model.centroids.T if has else None
    at = dict(zip(has, range(len(has)), strict=True))
    for k in range(len(texts)):
        if k not in at:
            names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
            continue
        row = cosine[at[k]]
        best = int(np.argmax(row))
        who = int(model.owner[best])
        names.append(model.languages[who]), scores.append(float(np.clip(row[best], 0, 1))), rejected.append(bool(row[best] < model.least[who]))
    return pa.RecordBatch.from_arrays([part["id"], pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (cosine, 0 to 1) and rejected for each row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0. ``rejected`` tells that the text is farther
    from its nearest centroid than nearly all texts of that language; its nearest language is still given.
    Of languages with equal cosines the first by code point wins. A very long text is read whole, as one row.
    Null and repeated ids are kept row by row; other columns are not read; an empty table gives no rows.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_slice(partial(_predict, model=model), 256), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = train_fold("doc_id", FOLD) == HELD
    found = identify(docs, fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
