"""Queries built of queries: lookups, chains, unions, partitions by date, families of documents, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackenspan.plans import rules
from brackenspan.plans.compile import Model, query

#: Rows of a side that may be broadcast, at an identifier each.
BROADCAST_ROWS = 100_000


def lookup(documents: DataFrame, text: str, kinds: set[str], syntax: str = "lucene") -> DataFrame:
    """Documents by identifiers: ``KIND:value`` terms joined by OR. Values are matched as they stand, so scans can prune."""
    terms = rules.lookup_terms(text, syntax, kinds)
    where = F.lit(False)
    for kind in sorted({k for k, _ in terms}):
        data = documents.schema[kind].dataType
        where = where | F.col(kind).isin(*(F.lit(v).cast(data) for k, v in terms if k == kind))
    return documents.where(where)


def chained(first: DataFrame, documents: DataFrame, on: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Documents whose fields equal the named columns of an earlier query's results: all results feed one join."""
    keys = first.select(*(F.col(a).alias(f"_{b}") for a, b in on.items())).distinct()
    cond = [F.col(b).cast("string") == F.col(f"_{b}").cast("string") for b in on.values()]
    out = documents.join(keys, cond, "left_semi")
    return out.select(*keep) if keep else out


def edge_events(edges: DataFrame, events: DataFrame, source_field: str, sink_field: str) -> DataFrame:
    """The events behind edges: those whose fields are an edge's source and sink."""
    return chained(edges, events, {"source": source_field, "sink": sink_field})


def composite(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Results of several queries as one, each document once, with the names of the queries that found it."""
    found = None
    for name, df in parts.items():
        one = df.withColumn("_logic", F.lit(name))
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    others = [c for c in found.columns if c not in (key, "_logic")]
    return found.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(c) for c in others), F.sort_array(F.collect_set("_logic")).alias("logics"))


def by_date(documents: DataFrame, day: str, ranges: list[tuple[str, str]], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One query over each date range, results together; ranges that don't overlap give each document once."""
    out = None
    for low, high in ranges:
        part = run(documents.where(F.col(day).between(F.lit(low).cast(documents.schema[day].dataType), F.lit(high).cast(documents.schema[day].dataType))))
        out = part if out is None else out.unionByName(part)
    return out


def filtered(allowed: bool, run: Callable[[], DataFrame], empty: DataFrame) -> DataFrame:
    """A query that only runs for whom, and when, a condition holds."""
    return run() if allowed else empty.where(F.lit(False))


def pages(results: DataFrame, order: list[str], size: int) -> DataFrame:
    """``page`` (from 1) and ``row`` in it, by an order that must be total. Rows are counted by range partition, so none sorts all."""
    kept = results.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).persist()
    starts, run = [], 0
    for r in sorted(kept.groupBy(F.shiftright("_row", 33).alias("part")).count().collect(), key=lambda r: r["part"]):
        starts.append((r["part"], run))
        run += r["count"]
    table = F.broadcast(results.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    nth = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    out = kept.withColumn("_part", F.shiftright("_row", 33)).join(table, "_part").withColumn("_nth", nth)
    return out.withColumn("page", (F.floor(F.col("_nth") / size) + 1).cast("bigint")).withColumn("row", F.pmod("_nth", F.lit(size)).cast("bigint")).drop("_nth", "_row", "_part", "_start")


# Families: a child's uid is its parent's with one more part behind a dot; a top-level uid has no dot.


def top_level(uid: Column) -> Column:
    return F.split_part(uid, F.lit("."), F.lit(1))


def parent_uid(uid: Column) -> Column:
    """Null for a top-level document."""
    return F.when(uid.contains("."), F.regexp_replace(uid, r"\.[^.]*$", ""))


def ancestors_of(uid: Column) -> Column:
    """Uids from the top down to the document itself."""
    parts = F.split(uid, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def top_level_query(documents: DataFrame, uid: str, text: str, syntax: str = "jexl", model: Model | None = None) -> DataFrame:
    """Whole families any of whose documents together hold what the query asks: fields of a family are one document's."""
    fields = [f.name for f in documents.schema.fields if f.name != uid and not f.dataType.simpleString().startswith(("array", "map"))]
    merged = documents.groupBy(top_level(F.col(uid)).alias(uid)).agg(*(F.array_compact(F.collect_set(n)).alias(n) for n in fields))
    hits = query(merged, text, syntax, model).select(F.col(uid).alias("_top"))
    return documents.join(hits, top_level(F.col(uid)) == F.col("_top"), "left_semi")


def parents_of_hits(documents: DataFrame, hits: DataFrame, uid: str) -> DataFrame:
    """The parent document of each hit; a top-level hit stands for itself."""
    wanted = hits.select(F.coalesce(parent_uid(F.col(uid)), F.col(uid)).alias("_uid")).distinct()
    return documents.join(wanted, F.col(uid) == F.col("_uid"), "left_semi")


def ancestors_of_hits(documents: DataFrame, hits: DataFrame, uid: str) -> DataFrame:
    wanted = hits.select(F.explode(ancestors_of(F.col(uid))).alias("_uid")).distinct()
    return documents.join(wanted, F.col(uid) == F.col("_uid"), "left_semi")


def descendants_of_hits(documents: DataFrame, hits: DataFrame, uid: str) -> DataFrame:
    """All documents below a hit, without the hits themselves."""
    wanted = hits.select(F.col(uid).alias("_uid")).distinct()
    above = documents.select("*", F.explode(ancestors_of(F.col(uid))).alias("_above")).where(F.col("_above") != F.col(uid))
    return above.join(wanted, F.col("_above") == F.col("_uid"), "left_semi").drop("_above").distinct()


def with_descendant_counts(documents: DataFrame, uid: str) -> DataFrame:
    """``CHILD_COUNT`` and ``DESCENDANT_COUNT`` of every document."""
    above = documents.select(F.col(uid).alias("_own"), F.explode(ancestors_of(F.col(uid))).alias("_above")).where("_own != _above")
    counts = above.groupBy("_above").agg(F.count("*").alias("DESCENDANT_COUNT"), F.count_if(parent_uid(F.col("_own")) == F.col("_above")).alias("CHILD_COUNT"))
    return documents.join(counts, F.col(uid) == F.col("_above"), "left").drop("_above").fillna(0, ["DESCENDANT_COUNT", "CHILD_COUNT"])


def term_frequencies(documents: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, term, offsets) of every word of a text field."""
    from brackenspan.functions.content import words

    rows = documents.select(F.col(key).alias("key"), F.posexplode(words(F.col(field))).alias("at", "term"))
    return rows.groupBy("key", "term").agg(F.sort_array(F.collect_list("at")).alias("offsets")).select("key", F.lit(field).alias("field"), "term", "offsets")


def content_of(documents: DataFrame, hits: DataFrame, key: str, field: str) -> DataFrame:
    """The stored text of documents that were found."""
    return documents.join(hits.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_semi").select(key, field)


def newest(results: DataFrame, key: list[str], time: str) -> DataFrame:
    """One row a key, that of the latest time, by a map-side aggregate."""
    names = results.columns
    return results.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(time, *(n for n in names if n not in key))).alias("r")).select("r.*")


def running_totals(results: DataFrame, by: str, value: str) -> DataFrame:
    return results.withColumn("total", F.sum(value).over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
