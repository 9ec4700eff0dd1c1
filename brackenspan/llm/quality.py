"""Quality: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

Tokens are words, runs of marks, and shapes for all-capital words and numbers; features are single tokens
and pairs, hashed, and how many tokens equal the one 1 to ``LAGS`` before; a text's vector has unit length. A score is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenspan.llm.common import in_small_batches, per_slice, table, text_or_empty, train_fold
from brackenspan.llm.labelled import FOLD, HELD, labelled_sample

SAMPLE = 10_000
BITS = 18
THRESHOLD = 0.5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
LAGS = 6
#: Spellings whose hashes a worker keeps.
SPELLINGS = 100_000

_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Hashes(dict):
    """Token hashes, computed once for each spelling; emptied between slices when large."""

    def __missing__(self, token: str) -> int:
        if token.isupper() and len(token) > 1:
            key = "<capitals>"
        elif token.isdigit():
            key = "<number>"
        else:
            key = token.lower() if token[0].isalnum() else token[:3]
        value = self[token] = zlib.crc32(key.encode())
        return value


_hashes = _Hashes()


def vector(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices, sorted, and their values; an empty text has none."""
    one = np.fromiter(map(_hashes.__getitem__, _TOKENS.findall(text)), dtype=np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    again = [np.full(int((one[lag:] == one[:-lag]).sum()), np.uint64(lag << 56)) for lag in range(1, LAGS + 1)]
    mixed = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two, *again])
    index, count = np.unique((mixed >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
    return index, count / max(np.sqrt((count.astype(float) ** 2).sum()), 1.0)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Per-coordinate updates over (indices, values, label) rows; the weights and the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value, label = rows[k]
            i, x = np.append(index, 1 << bits), np.append(value, 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange((1 << bits) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _vectors(part: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    found = [vector(t, bits) for t in part["text"].to_pylist()]
    if len(_hashes) > SPELLINGS:
        _hashes.clear()
    return pa.RecordBatch.from_arrays([part["label"], pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["label", "index", "value"])


def fit(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (id, text, label) rows; no rows give no opinion (every score 0.5)."""
    rows = sample.select("id", "text", "label").mapInArrow(per_slice(partial(_vectors, bits=bits), 64), "label int, index binary, value binary").toArrow().to_pandas()
    rows = rows.sort_values(["index", "label"], kind="stable")  # the order of rows is no input
    return follow_the_leader([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in zip(rows["index"], rows["value"], rows["label"], strict=True)], bits, epochs)


def _score_slice(part: pa.RecordBatch, weights: np.ndarray, bias: float, bits: int) -> pa.RecordBatch:
    raw = []
    for text in part["text"].to_pylist():
        index, value = vector(text, bits)
        raw.append(float(weights[index] @ value) + bias)
    if len(_hashes) > SPELLINGS:
        _hashes.clear()
    return pa.RecordBatch.from_arrays([part["id"], pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, dtype=float), -30, 30))))], ["id", "score"])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """id, score (0 to 1) and predicted (score >= ``threshold``) for each row of ``docs``.

    Only the text decides; null and empty texts have no features and score the bias alone. Null and repeated
    ids are kept row by row. Other columns are not read, whatever their names. An empty table gives an empty result.
    A very long text is read whole, as one row.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(per_slice(partial(_score_slice, weights=model[0], bias=model[1], bits=bits), 256), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """``docs``, all columns, without the rows whose score is under ``threshold``; a null text counts as empty.

    Each row is judged by its own text, so rows with null or repeated ids stay or go one by one, and equal texts
    alike. Other columns may have any name. No rows give no rows.
    """
    in_small_batches(docs.sparkSession)
    weights, bias = model

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = []
        for text in part[text_col].to_pylist():
            index, value = vector(text or "", bits)
            raw.append(float(weights[index] @ value) + bias)
        if len(_hashes) > SPELLINGS:
            _hashes.clear()
        keep = 1 / (1 + np.exp(-np.clip(np.array(raw, dtype=float), -30, 30))) >= threshold
        return part.filter(pa.array(keep))

    return docs.mapInArrow(per_slice(run, 256), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, float]:
    return fit(labelled_sample(docs, labels, "quality", rows))


def op10_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (train_fold("doc_id", FOLD) == HELD).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_ftrl": op10_quality_ftrl}
ORACLES: dict[str, str] = {}
