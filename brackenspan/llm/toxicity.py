"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a seed list plus what labelled rows teach: words and word beginnings whose documents are
mostly toxic. The sample has two folds, by how a text begins, so near copies don't sit in both. Trees grow on
features made with the other fold's lexicon, and are calibrated on scores of trees grown on the other
fold; the lexicon that is kept comes from both.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenspan.llm.common import by_slices, in_small_batches, per_slice, stored, table, text_or_empty, train_fold
from brackenspan.llm.labelled import FOLD, HELD, labelled_sample

SAMPLE = 24_000
LEXICON = 4_000
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7, 8)
SEED_LEXICON = frozenset("idiot idiots moron morons stupid scum trash clown loser losers worthless pathetic disgusting dumb imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton vous votre usted tú ti tus su".split())
FIELDS = ("seed", "strong", "weak", "stems", "distinct", "address", "caps", "caps_words", "punctuation", "marks", "leet", "spaced", "masked", "repeats", "length")
NEAR = 6

_WORDS = re.compile(r"[^\W_]+")
_LEET = re.compile(r"\b(?=\w*[a-z])(?=\w*[0134578@$])[a-z0134578@$]{3,}\b")
_MASKED = re.compile(r"[a-z][*#@$%]{1,4}[a-z]")
_SPACED = re.compile(r"\b(?:[a-z][ .\-_]){3,}[a-z]\b")
_REPEATS = re.compile(r"([a-z])\1{3,}")
_UNLEET = str.maketrans("0134578@$", "oleastbas")
_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


@dataclass(frozen=True)
class Lexicon:
    strong: frozenset
    weak: frozenset
    stems: frozenset


def grams(text: str) -> set[str]:
    """The words of a text, and their beginnings marked with a trailing dash."""
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def features(text: str, lexicon: Lexicon) -> list[float]:
    low = text.lower()
    words = _WORDS.findall(low)
    n = max(len(words), 1)
    known = lexicon.strong | SEED_LEXICON
    hits = [k for k, w in enumerate(words) if w in known]
    stems = lexicon.stems
    weak = sum(w in lexicon.weak for w in words)
    stem_hits = [w for w in words if w[:4] in stems or w[:5] in stems or w[:6] in stems or w[:7] in stems or w[:8] in stems] if stems else []
    near = sum(any(w in SECOND_PERSON for w in words[max(0, k - NEAR) : k + NEAR + 1]) for k in hits)
    raw = text.encode()
    size = max(len(raw), 1)
    leet = [t for t in _LEET.findall(low)] if any(c in low for c in "0134578@$") else []
    unleet = sum(t.translate(_UNLEET) in known for t in leet)
    return [
        100 * sum(words[k] in SEED_LEXICON for k in hits) / n,
        100 * len(hits) / n,
        100 * weak / n,
        100 * len(stem_hits) / n,
        float(len({words[k] for k in hits}) + len(set(stem_hits))),
        100 * near / n,
        (size - len(raw.translate(None, _UPPER))) / size,
        sum(w.isupper() for w in text.split()) / n,
        (size - len(raw.translate(None, _PUNCTUATION))) / size,
        100 * (low.count("!") + low.count("?")) / n,
        100 * unleet / n,
        100 * len(_SPACED.findall(low)) / n,
        100 * len(_MASKED.findall(low)) / n,
        100 * len(_REPEATS.findall(low)) / n,
        float(np.log1p(len(words))),
    ]


# Trees: nested arrays over binned features.


@dataclass
class Boosted:
    edges: list
    trees: list
    bias: float
    xs: np.ndarray
    ys: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)
        out = np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                right = bins[np.arange(len(x)), f] > cut[node]
                node = 2 * node + 1 + right
            out += value[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.xs, self.ys) if len(self.xs) else 1 / (1 + np.exp(-self.raw(x)))


DEPTH, TREES, BINS, RATE, LEAST, RIDGE = 3, 120, 64, 0.12, 12, 1.0


def _best_split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, widths: list[int]) -> tuple[int, int]:
    best = (1e-6, 0, BINS + 1)
    g, h = grad.sum(), hess.sum()
    for f, width in enumerate(widths):
        gl = np.cumsum(np.bincount(bins[:, f], grad, width))[:-1]
        hl = np.cumsum(np.bincount(bins[:, f], hess, width))[:-1]
        nl = np.cumsum(np.bincount(bins[:, f], minlength=width))[:-1]
        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
        gain[(nl < LEAST) | (len(bins) - nl < LEAST)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    widths = [len(e) + 1 for e in edges]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    margin, trees, inner = np.full(len(y), bias), [], 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut, value = np.zeros(inner, dtype=np.int64), np.full(inner, BINS + 1), np.zeros(inner + 1)
        node = np.zeros(len(y), dtype=np.int64)
        for _level in range(DEPTH):
            for k in np.unique(node):
                inside = node == k
                feature[k], cut[k] = _best_split(bins[inside], grad[inside], hess[inside], widths)
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = RATE * g / (h + RIDGE)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return Boosted(edges, trees, bias, np.zeros(0), np.zeros(0))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the rising step function nearest to the labels, as points to interpolate."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([v, 1.0, r, r])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in ((p[0] + 0.02) / (p[1] + 0.04),) * 2])
    return xs, np.maximum.accumulate(ys) if len(ys) else ys


def _gram_counts(batches):
    """In how many toxic and clean texts of each fold a gram is, among those of a partition."""
    names = ("toxic0", "clean0", "toxic1", "clean1")
    schema = pa.schema([("gram", pa.string()), *((n, pa.int64()) for n in names)])
    counts = [Counter() for _ in names]

    def flush():
        keys = list(set().union(*counts))
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"gram": some} | {n: [c[k] for k in some] for n, c in zip(names, counts, strict=True)}, schema)
        for c in counts:
            c.clear()

    for part in by_slices(batches, 64):
        for text, label, fold in zip(*(part[c].to_pylist() for c in ("text", "label", "fold")), strict=True):
            counts[2 * fold + (0 if label else 1)].update(grams(text))
        if sum(map(len, counts)) > 400_000:
            yield from flush()
    yield from flush()


def _lexicon(counts: DataFrame, folds: tuple[int, ...], size: int) -> Lexicon:
    """The ``size`` entries with most toxic texts, of those at least half of whose texts are toxic."""
    toxic, clean = (sum((F.col(f"{n}{f}") for f in folds), F.lit(0)) for n in ("toxic", "clean"))
    rows = counts.select("gram", toxic.alias("toxic"), ((toxic - 1) / (toxic + clean)).alias("purity")).where("toxic >= 3 AND purity >= 0.5")
    found = rows.orderBy(F.desc("toxic"), F.desc("purity"), "gram").limit(size).collect()
    words = [r for r in found if not r["gram"].endswith("-")]
    strong = frozenset(r["gram"] for r in words if r["purity"] >= 0.85 and r["toxic"] >= 8)
    return Lexicon(strong, frozenset(r["gram"] for r in words) - strong, frozenset(r["gram"][:-1] for r in found if r["gram"].endswith("-") and r["purity"] >= 0.7))


def _feature_rows(part: pa.RecordBatch, lexicons: tuple[Lexicon, Lexicon]) -> pa.RecordBatch:
    rows = [features(t, lexicons[f]) for t, f in zip(part["text"].to_pylist(), part["fold"].to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([part["fold"], part["label"], pa.array(rows, pa.list_(pa.float64()))], ["fold", "label", "x"])


def fit(sample: DataFrame, lexicon_size: int = LEXICON) -> tuple[Lexicon, Boosted]:
    """The lexicon and the calibrated trees from (id, text, label) rows; without rows every score is low."""
    start = F.substring("text", 1, 48)
    folds = stored(sample.withColumn("start", start).withColumn("fold", F.pmod(F.xxhash64("start", F.lit(5)), F.lit(2)).cast("int")), "toxic-sample")
    # Equal texts of one label teach the lexicon once; an opening that many texts share is no copy.
    once = folds.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["digest", "label"]).select("text", "label", "fold")
    names = [f"{n}{f}" for f in (0, 1) for n in ("toxic", "clean")]
    counts = once.mapInArrow(_gram_counts, "gram string, toxic0 bigint, clean0 bigint, toxic1 bigint, clean1 bigint").groupBy("gram").agg(*(F.sum(n).alias(n) for n in names))
    counts = stored(counts.where("toxic0 + toxic1 >= 3"), "toxic-grams")
    crossed = (_lexicon(counts, (1,), lexicon_size), _lexicon(counts, (0,), lexicon_size))
    lexicon = _lexicon(counts, (0, 1), lexicon_size)
    rows = folds.select("text", "label", "fold").mapInArrow(per_slice(partial(_feature_rows, lexicons=crossed), 64), "fold int, label int, x array<double>").toArrow().to_pandas()
    if not len(rows):
        return lexicon, Boosted([np.zeros(0)] * len(FIELDS), [], -4.0, np.zeros(0), np.zeros(0))
    x, y, fold = np.stack(rows["x"].to_list()), rows["label"].to_numpy(float), rows["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the order of rows is no input
    x, y, fold = x[order], y[order], fold[order]
    model = boost(x, y)
    raw = np.zeros(len(y))
    for f in (0, 1):
        if (fold == f).any():
            raw[fold == f] = (boost(x[fold != f], y[fold != f]) if (fold != f).any() else model).raw(x[fold == f])
    model.xs, model.ys = isotonic(raw, y)
    return lexicon, model


def _score_slice(part: pa.RecordBatch, lexicon: Lexicon, model: Boosted) -> pa.RecordBatch:
    x = np.array([features(t, lexicon) for t in part["text"].to_pylist()]).reshape(-1, len(FIELDS))
    score = np.clip(model.score(x), 0.0, 1.0)
    return pa.RecordBatch.from_arrays([part["id"], pa.array(score)], ["id", "score"])


def score_toxicity(docs: DataFrame, model: tuple[Lexicon, Boosted], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (0 to 1) and predicted (score >= ``threshold``) for each row of ``docs``.

    Only the text decides; a null text counts as empty and is scored as one. Null and repeated ids are
    kept row by row. Other columns are not read, whatever their names. An empty table gives an empty result.
    A very long text is read whole, as one row.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(per_slice(partial(_score_slice, lexicon=model[0], model=model[1]), 256), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: tuple[Lexicon, Boosted], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows whose score is at or over ``threshold``; a null text counts as empty.

    Each row is judged by its own text, so rows with null or repeated ids stay or go one by one, and equal texts
    alike. Other columns may have any name. No rows give no rows.
    """
    in_small_batches(docs.sparkSession)
    lexicon, trees = model

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t or "", lexicon) for t in part[text_col].to_pylist()]).reshape(-1, len(FIELDS))
        keep = np.clip(trees.score(x), 0.0, 1.0) < threshold
        return part.filter(pa.array(keep))

    return docs.mapInArrow(per_slice(run, 256), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Lexicon, Boosted]:
    return fit(labelled_sample(docs, labels, "toxic", rows))


def op8_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (train_fold("doc_id", FOLD) == HELD).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity_trees": op8_toxicity_trees}
ORACLES: dict[str, str] = {}
