"""Sharding by histogram sort: law ``bytes``.

Rows are ordered by (hash of the text, hash of the id), so rows of equal texts are neighbours. Each round
counts, over all partitions, the exact bytes below evenly spaced probes inside the brackets of the
splitters that are still open, and narrows each bracket to the bin that holds its target. A splitter
is settled at a probe within ``tolerance`` of a piece's target; where a single text hash holds more than
that (a hot group of copies), the second hash of the order is bracketed in the same way, for all such splitters at once, so that
groups of equal texts stay whole unless wholeness would break the law. When all splitters stand, rows
are exchanged once, by piece, and numbered.

Pieces are finer than shards (a shard is a run of pieces), which keeps a task's share of the
exchange bounded: only ids, sizes and hashes move, some 50 bytes for a text of any length. At most ``max_pieces`` splitters
and as many counts, or ``probes`` if more, of a round are on the driver: 64 Ki of them, beyond a terabyte of text.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackenspan.llm.common import in_small_batches, stored, table, text_or_empty

TOP = 1 << 62
PIECE_BYTES = 16 << 20
MAX_PIECES = 1 << 16
PROBES = 1 << 15
TOLERANCE = 0.01
LOOSE = 0.25


def _histogram(batches, edges: dict[int | None, np.ndarray]):
    """Bytes of each interval of the edges: of first hashes under None, or of second ones for each first hash that is named."""
    firsts = np.array(sorted(k for k in edges if k is not None), dtype=np.int64)
    start, past = {}, 0
    for key in [None] if None in edges else firsts.tolist():
        start[key], past = past, past + len(edges[key]) + 1
    size = np.zeros(past, dtype=np.int64)

    def add(at: np.ndarray, n: np.ndarray, key: int | None) -> None:
        where = np.searchsorted(edges[key], at, side="right")
        order = np.argsort(where, kind="stable")
        cut = np.flatnonzero(np.diff(where[order], prepend=-1))
        if len(cut):
            size[start[key] + where[order][cut]] += np.add.reduceat(n[order], cut)

    for part in batches:
        h1, n = part["h1"].to_numpy(), part["size"].to_numpy()
        if None in edges:
            add(h1, n, None)
            continue
        h2, place = part["h2"].to_numpy(), np.minimum(np.searchsorted(firsts, h1), len(firsts) - 1)
        hot = np.flatnonzero(firsts[place] == h1)
        hot = hot[np.argsort(place[hot], kind="stable")]
        cuts = np.flatnonzero(np.diff(place[hot], prepend=-1))
        for x, y in zip(cuts, np.append(cuts[1:], len(hot)), strict=True):
            add(h2[hot[x:y]], n[hot[x:y]], int(h1[hot[x]]))
    full = np.flatnonzero(size)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full])], ["bin", "bytes"])


def _count(rows: DataFrame, edges: dict[int | None, np.ndarray]) -> dict[int | None, np.ndarray]:
    found = rows.mapInArrow(partial(_histogram, edges=edges), "bin bigint, bytes bigint").groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect()
    keys = [None] if None in edges else sorted(edges)
    out = np.zeros(sum(len(edges[k]) + 1 for k in keys), dtype=np.int64)
    for r in found:
        out[r["bin"]] = r["bytes"]
    cuts = np.cumsum([len(edges[k]) + 1 for k in keys])[:-1]
    return dict(zip(keys, np.split(out, cuts), strict=True))


def _refine(rows: DataFrame, targets: list[tuple[float, float]], probes: int, within: list[tuple[int, float] | None]) -> tuple[list[int], list[int], list[float]]:
    """For each (target, tolerance) a key; the indices whose single key is still too heavy; bytes below each key.

    Keys are boundaries: what sorts before the key is below the splitter. They are first hashes, or second ones
    among the rows of the first hash in ``within``, that come after so many bytes. All are refined in the same rounds.
    """
    low = {j: (0, TOP, w[1] if w else 0.0) for j, w in enumerate(within)}
    keys, base, heavy = [0] * len(targets), [0.0] * len(targets), []
    while low:
        spans: dict[int | None, set] = {}
        for j, (a, b, _) in low.items():
            spans.setdefault(within[j][0] if within[j] else None, set()).add((a, b))
        each = max(2, probes // sum(map(len, spans.values())))
        edges = {first: np.array(sorted({a + (b - a) * k // each for a, b in some for k in range(each + 1)}), dtype=np.int64) for first, some in spans.items()}
        counts = _count(rows, edges)
        below = {w[0] if w else None: w[1] if w else 0.0 for w in within}
        upto_of = {first: below[first] + np.cumsum(counts[first])[: len(e)] for first, e in edges.items()}  # bytes below each edge
        for j, (a, b, _) in list(low.items()):
            first, (target, slack) = within[j][0] if within[j] else None, targets[j]
            edge, upto = edges[first], upto_of[first]
            lo, hi = np.searchsorted(edge, a), np.searchsorted(edge, b)
            near = lo + int(np.argmin(np.abs(upto[lo : hi + 1] - target)))
            if abs(upto[near] - target) <= slack:
                keys[j], base[j] = int(edge[near]), float(upto[near])
                del low[j]
                continue
            k = min(max(lo + 1, int(np.searchsorted(upto[lo : hi + 1], target, side="left")) + lo), hi)
            a, b, under = int(edge[k - 1]), int(edge[k]), float(upto[k - 1])
            if b - a <= 1:
                # The single key is heavy; at the nearer of its ends for a second hash, which has no further key.
                at_end = first is not None and abs(upto[k] - target) < abs(under - target)
                keys[j], base[j] = (b, float(upto[k])) if at_end else (a, under)
                heavy.append(j)
                del low[j]
            else:
                low[j] = (a, b, under)
    return keys, heavy, base


def splitters(rows: DataFrame, total: int, shards: int, fine: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[tuple[int, int]]:
    """(first hash, second hash) of each boundary between pieces, ``fine`` of them a shard.

    A shard's boundaries are within ``tolerance`` of a piece's bytes; those inside it only deal the work and may be off
    by a quarter of a piece.
    """
    pieces = shards * fine
    targets = [(total * j / pieces, (tolerance if j % fine == 0 else LOOSE) * total / pieces) for j in range(1, pieces)]
    keys, heavy, base = _refine(rows, targets, probes, [None] * len(targets))
    out = [(k, 0) for k in keys]
    if heavy:
        inside = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in sorted({keys[j] for j in heavy})], "h1 bigint")), "h1", "left_semi")
        seconds, _, _ = _refine(inside, [targets[j] for j in heavy], probes, [(keys[j], base[j]) for j in heavy])
        for j, second in zip(heavy, seconds, strict=True):
            out[j] = (keys[j], second)
    return sorted(out)


def _piece(part: pa.RecordBatch, bounds: list[tuple[int, int]]) -> pa.Array:
    """Number of boundaries at or below each row's (h1, h2)."""
    h1, h2 = part["h1"].to_numpy(), part["h2"].to_numpy()
    b1, b2 = (np.array([b[k] for b in bounds], dtype=np.int64) for k in (0, 1))
    piece = np.searchsorted(b1, h1, side="left")
    until = np.searchsorted(b1, h1, side="right")
    for row in np.flatnonzero(until > piece):
        piece[row] += np.searchsorted(b2[piece[row] : until[row]], h2[row], side="right")
    return pa.array(piece.astype(np.int32))


def _placed(batches, bounds: list[tuple[int, int]]):
    for part in batches:
        yield pa.RecordBatch.from_arrays([*part.columns, _piece(part, bounds)], [*part.schema.names, "piece"])


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES, max_pieces: int = MAX_PIECES) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 1. The bytes of two shards differ by at most the tolerance of
    a piece's target on either side, plus one row where rows are indivisible. Slots count from 0 in each
    shard, in the order of the text's hash. A null text counts as empty (crc32 0). Rows with the same
    text and id are alike in all that is returned; however many there are, they may be split. Null ids sort as one value.
    Other columns are not read, whatever their names; an empty table gives an empty result. A very long text is one
    row like any other; a shard can't come nearer to its share than half of the longest text.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    text = text_or_empty(text_col)
    positive = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 2)
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            positive(text).alias("h1"),
            # By id, and last by row: rows that repeat id and text are alike, so any of them may go either way.
            (F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(id_col), text, F.lit(1)), 24), 22) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 22))).alias("h2"),
        ),
        "shard-keys",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    fine = max(1, min(max_pieces // shards, -(-total // (piece_bytes * shards))))
    bounds = splitters(rows.select("h1", "h2", "size"), total, shards, fine, tolerance) if total else []
    placed = rows.mapInArrow(partial(_placed, bounds=bounds), T.StructType([*rows.schema.fields, T.StructField("piece", T.IntegerType())])) if bounds else rows.withColumn("piece", F.lit(0))
    placed = stored(placed, "shard-pieces")
    # Rows before each piece in its shard: a row a piece, max_pieces at most.
    counts = {r["piece"]: r["count"] for r in placed.groupBy("piece").count().collect()}
    before, run = [], 0
    for p in range(shards * fine):
        run = 0 if p % fine == 0 else run
        before.append((p, p // fine, run))
        run += counts.get(p, 0)
    starts = F.broadcast(spark.createDataFrame(before, "piece int, shard int, start bigint"))
    ranked = placed.selectExpr("*", "row_number() OVER (PARTITION BY piece ORDER BY h1, h2, id) - 1 AS nth").join(starts, "piece")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op2_histogram_shards": op2_histogram_shards}
ORACLES: dict[str, str] = {}
