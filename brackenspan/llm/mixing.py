"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should get. The
fractions are rounded in pairs: words move between two documents, in a random direction whose odds keep
either's expectation, until the copies of one are integral; the sum of words is unchanged by each
move. Buckets of documents are rounded apart and leave a few fractional documents for each source;
these go up a reduction tree, ``FAN_IN`` nodes at a time, and the last of them, at the root, are
rounded to the choice whose words come nearest to what is left of the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brackenspan.llm.common import released, stored, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKET_ROWS = 1024
FAN_IN = 32
KEEP = 12
DRIVER_SOURCES = 10_000
SEED = 20240601
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(col: str) -> Column:
    """Number of maximal runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: list[tuple], weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> list[tuple]:
    """(source, size, target) of each (source, size), sources by code point with null last.

    Targets share the sum of all sizes by weight; what a source can't take (``most`` times its size) is
    shared again among the others.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {n: float(weights[n % len(weights)]) for n in range(len(order))}
    total, target, open_ = float(sum(s for _, s in order)), [0.0] * len(order), set(range(len(order)))
    left = total
    while open_:
        share = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if share * weight[n] > most * order[n][1]}
        for n in full or open_:
            target[n] = most * float(order[n][1]) if full else share * weight[n]
        left -= sum(target[n] for n in full)
        open_ = open_ - full if full else set()
    return [(name, size, target[n]) for n, (name, size) in enumerate(order)]


def targets_of(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """``source_targets`` of a table (source, size, n) of any length, by Spark: (source, n, size, target).

    The order comes from a range exchange and counts of its partitions. Each round settles the sources whose share
    exceeds what they can take, as ``source_targets`` does, from two sums over the table.
    """
    spark = sums.sparkSession
    # Nulls last: they sort as (1, ""). Strings compare by their UTF-8 bytes, which is by code point.
    ordered = sums.withColumns({"_no": F.col("source").isNull().cast("int"), "_name": F.coalesce("source", F.lit(""))}).repartitionByRange("_no", "_name").sortWithinPartitions("_no", "_name")
    ordered = stored(ordered.withColumn("_row", F.monotonically_increasing_id()).drop("_no", "_name"), "mix-sources")
    part = F.shiftright("_row", 33)
    before, run = [], 0
    for r in sorted(ordered.groupBy(part.alias("part")).agg((F.max("_row") + 1).alias("past"), F.count("*").alias("count")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], run))
        run += r["count"]
    starts = F.broadcast(spark.createDataFrame(before, "part bigint, start bigint"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("_nth"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ordered.withColumn("part", part).join(starts, "part").withColumn("_nth", F.col("start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_weight", weight)
    plan = stored(ranked.select("source", "n", "size", "_weight", F.lit(None).cast("double").alias("target")), "mix-plan")
    left = float(plan.agg(F.sum("size")).first()[0] or 0)
    while True:
        open_ = plan.where("target IS NULL").agg(F.sum("_weight")).first()[0]
        if not open_:
            return plan.drop("_weight")
        share = F.lit(left / open_) * F.col("_weight")
        limit = F.lit(float(most)) * F.col("size")
        full = F.col("target").isNull() & (share > limit)
        taken = plan.where(full).agg(F.count("*"), F.sum(limit)).first()
        value = F.when(full, limit) if taken[0] else F.when(F.col("target").isNull(), share)
        last, plan = plan, stored(plan.withColumn("target", value.otherwise(F.col("target"))), "mix-plan")
        released(last)
        left -= float(taken[1] or 0)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_nth``, a running number from 0 within each key, whatever share of all rows a key has.

    Rows are stored first, so that which partition has how many of a key stands; each partition then numbers
    its own, from where those before it end.
    """
    kept = stored(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "mix-repeats")
    counts = kept.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).drop("_n")
    inside = kept.withColumn("_inside", F.row_number().over(Window.partitionBy(key, "_part").orderBy("_row")) - 1)
    return inside.join(before, [key, "_part"]).withColumn("_nth", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_row", "_part", "_before", "_inside")


def _draw(key: int, level: int) -> float:
    """A number in [0, 1) that depends on the document's key and the tree's level only."""
    x = (key ^ (SEED + level) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def move(size_a: int, part_a: float, size_b: int, part_b: float, draw: float) -> tuple[float, float]:
    """Words go from a to b or back until one part is 0 or 1; size-weighted sum and expectations stay."""
    to_b = min(size_a * part_a, size_b * (1 - part_b))
    to_a = min(size_b * part_b, size_a * (1 - part_a))
    if draw * (to_a + to_b) < to_a:
        a, b = part_a - to_b / size_a, part_b + to_b / size_b
        a, b = (0.0, b) if to_b == size_a * part_a else (a, 1.0)
    else:
        a, b = part_a + to_a / size_a, part_b - to_a / size_b
        a, b = (a, 0.0) if to_a == size_b * part_b else (1.0, b)
    return min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)


def pivot(items: list[tuple[int, int, float]], keep: int, level: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, float]]]:
    """Rounds (key, size, part) items of one source: the decided (key, 0 or 1), and at most ``keep`` + 1 left."""
    items = sorted(items)
    waiting, rest = items[:keep], items[keep:]
    decided, carry = [], None
    for key, size, part in rest:
        if carry is None:
            carry = (key, size, part)
            continue
        a, b = move(carry[1], carry[2], size, part, _draw(key, level))
        pair, carry = ((carry[0], carry[1], a), (key, size, b)), None
        for k, s, p in pair:
            if p in (0.0, 1.0):
                decided.append((k, int(p)))
            else:
                carry = (k, s, p)
    return decided, waiting + ([carry] if carry else [])


def settle(items: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Rounds the last few: of all choices, that whose words come nearest to the sum of the parts."""
    items = sorted(items)
    if not items:
        return []
    sizes = np.array([s for _, s, _ in items], dtype=np.int64)
    goal = float(sum(s * p for _, s, p in items))
    picks = (np.arange(1 << len(items))[:, None] >> np.arange(len(items))) & 1
    best = picks[int(np.argmin(np.abs(picks @ sizes - goal)))]
    return [(k, int(b)) for (k, _, _), b in zip(items, best, strict=True)]


STATE = pa.schema([("bucket", pa.int64()), ("nodes", pa.int64()), ("source", pa.string()), ("key", pa.int64()), ("size", pa.int64()), ("part", pa.float64()), ("pick", pa.int32())])


def _node(keep: int, level: int):
    """One node of the tree: decided rows get a pick, those that go up have none; the root decides all."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket, source, nodes = (k.as_py() for k in key)
        items = list(zip(group["key"].to_pylist(), group["size"].to_pylist(), group["part"].to_pylist(), strict=True))
        sizes = {k: s for k, s, _ in items}
        decided, left = pivot(items, keep, level)
        if nodes == 1:
            decided, left = decided + settle(left), []
        rows = [(bucket, nodes, source, k, sizes[k], None, b) for k, b in decided] + [(bucket, nodes, source, k, s, p, None) for k, s, p in left]
        return pa.Table.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(STATE.names)}, STATE)

    return run


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col), F.lit(SEED))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, keep: int = KEEP, driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, copies (0 to ``most``), key, nth.

    Null sources are one source, the last. A null text has no words; rows without words get no copies in
    words whatever their count, and their count is the source's whole copies. Rows that repeat id, source and text share
    a key and are told apart by ``nth``, a running number, so each is decided alone. Ids may be null. A very long text
    is one row whose words no other can stand in for: a source comes as near to its target as its rows allow. An
    empty table gives an empty result. Other columns are not read, whatever their names. Up to ``driver_sources`` sources
    have their targets set on the driver, more by Spark, with the same results.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), _key(id_col, text_col, source_col).alias("key")), "mix-rows")
    twice = stored(rows.groupBy("key").count().where("count > 1").select("key"), "mix-twice")
    if twice.head(1):
        again = numbered(rows.join(twice, "key", "left_semi"), "key").withColumn("nth", F.col("_nth")).drop("_nth")
        rows = stored(rows.join(twice, "key", "left_anti").withColumn("nth", F.lit(0).cast("bigint")).unionByName(again), "mix-numbered")
    else:
        rows = rows.withColumn("nth", F.lit(0).cast("bigint"))
    # What a row's decision hangs on: the key alone where it is the only one.
    rows = rows.withColumn("own", F.when(F.col("nth") == 0, F.col("key")).otherwise(F.xxhash64("key", "nth")))
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-sums")
    most_rows, sources = sums.agg(F.max("n"), F.count("*")).first()
    if sources <= driver_sources:
        facts = sums.collect()
        n_of = {r["source"]: r["n"] for r in facts}
        plan = F.broadcast(spark.createDataFrame([(s, n_of[s], n, t) for s, n, t in source_targets([(r["source"], r["size"]) for r in facts], weights, most)], "source string, n bigint, size bigint, target double"))
    else:
        plan = targets_of(sums, weights, most)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = plan.select("source", F.col("size").alias("source_size"), "target", rate.alias("rate"), F.ceil(F.col("n") / F.lit(bucket_rows)).cast("bigint").alias("nodes"))
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "source_size", "target", "rate", "nodes")
    joined = joined.withColumn("whole", F.floor(F.col("rate") + F.lit(1e-12)).cast("int")).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))

    open_ = joined.where((F.col("part") > 1e-12) & (F.col("size") > 0))
    state = open_.withColumn("bucket", F.pmod(F.xxhash64("own", F.lit(1)), F.col("nodes"))).select("bucket", "nodes", "source", F.col("own").alias("key"), "size", "part")
    kind = "bucket bigint, nodes bigint, source string, key bigint, size bigint, part double, pick int"
    nodes, level, decided = max(1, -(-(most_rows or 1) // bucket_rows)), 0, []
    while True:
        state = stored(state.groupBy("bucket", "source", "nodes").applyInArrow(_node(keep, level), kind), f"mix-level{level}")
        decided.append(state.where("pick IS NOT NULL").select(F.col("key").alias("own"), "pick"))
        if nodes == 1:
            break
        up = lambda c: F.floor(c / F.lit(fan_in)).cast("bigint")
        state = state.where("pick IS NULL").drop("pick").withColumns({"bucket": up(F.col("bucket")), "nodes": up(F.col("nodes") + F.lit(fan_in - 1))})
        nodes, level = -(-nodes // fan_in), level + 1
    picks = decided[0]
    for more in decided[1:]:
        picks = picks.unionByName(more)
    out = joined.join(picks, "own", "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.coalesce("pick", F.lit(0))).cast("int").alias("copies"), "key", "nth")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; the same columns, which may have any name.

    Rows that repeat id, source and text are interchangeable: each takes one of the counts decided for them. Nulls,
    empty texts and empty tables are as in ``mix``.
    """
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), _key(id_col, text_col, source_col).alias("key"))
    mixed = mix(docs, id_col, text_col, source_col, **options)
    copies = stored(mixed.where("copies > 0 OR nth > 0").select("key", "nth", "copies"), "mix-copies")
    single = copies.where("nth = 0 AND copies > 0").select("key", "copies")
    twice = stored(copies.where("nth > 0").select("key").distinct(), "mix-again")
    if twice.head(1):
        again = numbered(rows.join(twice, "key", "left_semi"), "key").withColumnRenamed("_nth", "nth").join(copies.where("copies > 0"), ["key", "nth"]).select("row", "copies")
        taken = rows.join(twice, "key", "left_anti").join(single, "key").select("row", "copies").unionByName(again)
    else:
        taken = rows.join(single, "key").select("row", "copies")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


QUERIES = {"op9_pivotal_mix": op9_pivotal_mix}
ORACLES: dict[str, str] = {}
