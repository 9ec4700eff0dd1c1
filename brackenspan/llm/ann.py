"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the residuals' codebooks are fitted on a bounded sample; every vector is then put
in its nearest cell and coded. A query visits the cells whose centroids have the largest inner product
with it, a share of them tuned on held-out rows of the sample. In a cell all its queries' table scores (asymmetric
distance tables: query against codebook) come from one gather; the best of a large cell are reranked by the exact inner
product in double precision. A table score is off by at most the query's length times the row's quantisation
error: every other row that could by that bound still be among the query's best is reranked too. So the
visited cells' best are exact, also among vectors nearer to each other than the codebooks tell apart.

Small cells are packed into groups of about ``block`` rows, and a query comes to a group once with the cells it visits
there; large cells are dealt into blocks, and queries into chunks, so no task holds more than one block and one
chunk, however many vectors are alike. Equal vectors have the same inner product: of each at most
``k`` + 1 rows (smallest ids first) are needed, so copies can't crowd out others. Different vectors with the same
codes only share their table score, and all that tie with the shortlist's last are reranked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brackenspan.llm.common import per_slice, stored, table

SAMPLE = 16_384
MAX_CELLS = 4096
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0)
SHORTLIST = 128
TARGET = 0.95
PARTS = 16
CODES = 64
TUNE_QUERIES = 256
PAIRS = 65_536
BLOCK = 4096
CHUNK = 1024
#: Over the rounding of a table score or an inner product, as a share of the lengths' product.
ROUNDING = 1e-9


@dataclass
class Index:
    centroids: np.ndarray  # cells x dimension
    codebooks: np.ndarray  # parts x codes x dimension of a part


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct sampled points; an emptied centre stays where it was."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)


def fit(sample: np.ndarray, cells: int, parts: int = PARTS, codes: int = CODES, seed: int = 7) -> Index:
    centroids = k_means(sample, min(cells, len(sample)), 12, seed)
    rest = sample - centroids[nearest(sample, centroids)]
    parts = max(p for p in range(1, parts + 1) if sample.shape[1] % p == 0)
    books = [k_means(piece, min(codes, len(piece)), 12, seed + 1 + n) for n, piece in enumerate(np.split(rest, parts, axis=1))]
    width = max(map(len, books))
    books = [np.concatenate([b, np.repeat(b[:1], width - len(b), axis=0)]) for b in books]
    return Index(centroids, np.stack(books))


def tune(asked: np.ndarray, sample: np.ndarray, index: Index, k: int, target: float = TARGET) -> float:
    """The smallest share of cells that keeps ``target`` of the true best ``k`` in the sample of queries not fitted on.

    The sample is sparser than the whole, where neighbours are nearer and easier to find.
    """
    k = min(k, len(sample))
    best = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
    cell = nearest(sample, index.centroids)
    visit = np.argsort(np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    place = np.take_along_axis(visit, cell[best], axis=1)
    cells = len(index.centroids)
    return next(s for s in SHARES if s == 1.0 or (place < max(1, round(cells * s))).mean() >= target)


def fitted(points: np.ndarray, cells: int, k: int) -> tuple[Index, float]:
    """The index of a sample and its tuned share; a few rows spread over the sample are held out and asked."""
    held = np.zeros(len(points), bool)
    held[np.linspace(0, len(points) - 1, min(TUNE_QUERIES, len(points) // 8)).astype(int)] = len(points) >= 64
    index = fit(points[~held], cells)
    return index, tune(points[held], points[~held], index, k) if held.any() else 1.0


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)


def _coded(part: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    points = _matrix(part["vector"], index.centroids.shape[1])
    cell = nearest(points, index.centroids)
    rest = np.split(points - index.centroids[cell], len(index.codebooks), axis=1)
    codes = np.stack([nearest(r, b) for r, b in zip(rest, index.codebooks, strict=True)], axis=1).astype(np.uint8)
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [*part.schema.names, "cell", "codes"])


def packed(sizes: dict[int, int], cells: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's group (-1: it is empty), and each group's number of blocks: small cells share one, a large one has its own."""
    group, blocks, held = np.full(cells, -1, dtype=np.int32), [], block
    for cell in sorted(sizes):
        n = sizes[cell]
        if n >= block:
            group[cell] = len(blocks)
            blocks.append(-(-n // block))
            held = block
            continue
        if held + n > block:
            blocks.append(1)
            held = 0
        group[cell], held = len(blocks) - 1, held + n
    return group, np.array(blocks, dtype=np.int32)


def _probes(part: pa.RecordBatch, centroids: np.ndarray, group: np.ndarray, probes: int) -> pa.RecordBatch:
    """Each query once for each group it visits, with its cells there."""
    points = _matrix(part["vector"], centroids.shape[1])
    near = np.sort(np.argsort(-(points @ centroids.T), axis=1, kind="stable")[:, :probes], axis=1)
    rows, cells = np.repeat(np.arange(len(points)), near.shape[1]), near.ravel()
    rows, cells = rows[group[cells] >= 0], cells[group[cells] >= 0]
    order = np.lexsort((cells, group[cells], rows))
    rows, cells = rows[order], cells[order].astype(np.int32)
    new = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(group[cells], prepend=-2) != 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)).astype(np.int32)), pa.array(cells))
    at = pa.array(rows[new])
    return pa.RecordBatch.from_arrays([part["id"].take(at), part["vector"].take(at), pa.array(group[cells[new]]), lists], ["query_id", "query", "grp", "cells"])


def _needed(points: np.ndarray, ids: np.ndarray, same: int) -> np.ndarray:
    """Rows that can be among a query's best: at most ``same`` of equal vectors, smaller ids first."""
    points = np.ascontiguousarray(points + 0.0)  # -0.0 and 0.0 are equal
    digest = points.view(np.dtype((np.void, points.shape[1] * points.itemsize))).ravel()
    group = np.unique(digest, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return np.sort(order[place < same])


HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class _Best:
    """Each query's best ``k`` (score, id) so far, and the score a row must reach to be among them."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.at, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        at, ids, score = np.append(self.at, at), np.append(self.ids, ids), np.append(self.score, score)
        order = np.lexsort((ids, -score, at))
        at = at[order]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.at, self.ids, self.score = at[place < self.k], ids[kept], score[kept]
        self.least[at[place == self.k - 1]] = score[full]


def _searched(block: pa.Table, queries: pa.Table, index: Index, k: int, shortlist: int) -> pa.Table:
    """The best of one block's rows for each query of a chunk, in the cells the query visits."""
    if not block.num_rows or not queries.num_rows:
        return HITS.empty_table()
    dimension, parts = index.centroids.shape[1], len(index.codebooks)
    ids = block["id"].to_numpy()
    points = _matrix(block["vector"].combine_chunks(), dimension)
    codes = np.frombuffer(b"".join(block["codes"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
    cell = block["cell"].to_numpy()
    # A query's own id drops out, as often as it is repeated.
    needed = _needed(points, ids, k + int(np.unique(ids, return_counts=True)[1].max()))
    ids, points, codes, cell = ids[needed], points[needed], codes[needed], cell[needed]
    rebuilt = index.centroids[cell] + index.codebooks[np.arange(parts)[None, :], codes].reshape(len(ids), -1)
    error = np.linalg.norm(points - rebuilt, axis=1) + ROUNDING * (np.linalg.norm(points, axis=1) + np.linalg.norm(rebuilt, axis=1))
    query_ids, asked = queries["query_id"].to_numpy(), _matrix(queries["query"].combine_chunks(), dimension)
    length, size = np.linalg.norm(asked, axis=1), np.linalg.norm(points, axis=1)
    tables = np.einsum("pcd,qpd->pqc", index.codebooks, asked.reshape(len(asked), parts, -1))
    visits = queries["cells"].combine_chunks()
    visitor, visited = np.repeat(np.arange(len(asked)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
    best = _Best(len(asked), k)

    def rerank(q: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> None:
        """Of the wanted pairs of queries and rows, those that by one matrix product can be among the best, summed one by one."""
        columns = np.flatnonzero(wanted.any(axis=0))
        if not len(columns):
            return
        r, wanted = rows[columns], wanted[:, columns]
        product = np.where(wanted, asked[q] @ points[r].T, -np.inf)
        floor = best.least[q]
        if len(r) > k:
            floor = np.maximum(floor, np.partition(product, -k, axis=1)[:, -k])
        # A product is off from the sum by rounding alone.
        i, j = np.nonzero(wanted & (product >= floor[:, None] - ROUNDING * length[q][:, None] * size[r]))
        for at in range(0, len(i), PAIRS):
            some_q, some_r = q[i[at : at + PAIRS]], r[j[at : at + PAIRS]]
            best.add(some_q, ids[some_r], (points[some_r] * asked[some_q]).sum(1))

    for c in np.unique(cell):
        rows, who = np.flatnonzero(cell == c), visitor[visited == c]
        step = max(1, (1 << 20) // len(rows))
        for at in range(0, len(who), step):
            q = who[at : at + step]
            score = np.repeat((asked[q] @ index.centroids[c])[:, None], len(rows), axis=1)
            for p in range(parts):
                score += np.take(tables[p][q], codes[rows, p], axis=1)
            open_ = query_ids[q][:, None] != ids[rows]
            if len(rows) > shortlist:
                # All that tie with the shortlist's last belong to it.
                ranked = np.where(open_, score, -np.inf)
                last = np.partition(ranked, -shortlist, axis=1)[:, -shortlist]
                first = open_ & (score >= last[:, None])
                rerank(q, rows, first)
                open_ &= ~first
            # What the bound doesn't rule out against the k-th best so far.
            rerank(q, rows, open_ & (score + length[q][:, None] * error[rows] >= best.least[q][:, None]))
    return pa.Table.from_arrays([pa.array(query_ids[best.at]), pa.array(best.ids), pa.array(best.score)], schema=HITS)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part: the commonest length, all components finite, not all zero."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == F.lit(common["n"] if common else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE, max_cells: int = MAX_CELLS, probed: float | None = None, shortlist: int = SHORTLIST, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the ``k`` best rows found by inner product.

    The query's own id is no candidate. Rows with a null id, or a vector that is null, zero, of another
    length than most, or with null or non-finite components take no part, as queries or candidates.
    Scores are sums in double precision of the original components; ties go to the smaller id. Repeated
    rows are candidates each. Fewer candidates give fewer ranks; no usable vector gives no rows. The index
    is fitted on about ``sample_rows`` rows and holds all. ``probed`` (the share of cells visited) is tuned on that sample
    where it isn't given; ``shortlist`` (rows of a cell reranked before the rest is bounded) decides speed only.
    Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col), "ann-vectors")
    n = rows.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], empty)
    share = int(min(1.0, sample_rows / n) * (1 << 32))
    sample = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 32)) < F.lit(max(share, 1))) if n > sample_rows else rows
    sample = sample.toArrow() if sample.head(1) else rows.orderBy(F.xxhash64("id", "vector")).limit(sample_rows).toArrow()
    sample = sample.sort_by("id")
    points = _matrix(sample["vector"].combine_chunks(), len(sample["vector"][0]))
    index, share = fitted(points, max(1, min(max_cells, int(2 * n**0.5))), k)
    cells, probed = len(index.centroids), probed or share

    coded = stored(rows.mapInArrow(per_slice(partial(_coded, index=index), 4096), "id bigint, vector array<double>, cell int, codes binary"), "ann-index")
    # A row a cell: which group it is in, and how many blocks that is dealt into.
    group, blocks = packed({r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}, cells, block)
    wanted = queries.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    asked = stored(rows.join(wanted, "id", "left_semi").mapInArrow(per_slice(partial(_probes, centroids=index.centroids, group=group, probes=max(1, round(cells * probed))), 512), "query_id bigint, query array<double>, grp int, cells array<int>"), "ann-probes")
    loads = {r["grp"]: r["count"] for r in asked.groupBy("grp").count().collect()}
    grid = F.broadcast(spark.createDataFrame([(g, int(n), -(-loads.get(g, 0) // chunk)) for g, n in enumerate(blocks)], "grp int, blocks int, chunks int"))
    member = F.broadcast(spark.createDataFrame([(c, int(g)) for c, g in enumerate(group)], "cell int, grp int"))
    dealt = coded.join(member, "cell").join(grid, "grp").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.where("chunks > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("grp", "block", "chunk", "cell", "id", "vector", "codes")
    spread = asked.join(grid, "grp").withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(5)), F.col("chunks")).cast("int"))
    spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", "block", "chunk", "query_id", "query", "cells")
    at = ("grp", "block", "chunk")
    hits = dealt.groupBy(*at).cogroup(spread.groupBy(*at)).applyInArrow(lambda left, right: _searched(left, right, index, k, shortlist), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op7_ivf_pq": op7_ivf_pq}
ORACLES: dict[str, str] = {}
