"""Lookups in the term index and set operations on what they find, date and day indexes, first and last dates of terms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackenspan.functions.types import fold_text


def literal_lookup(index: DataFrame, term: str, fields: list[str] | None = None) -> DataFrame:
    """Index rows of a term, in any field or some."""
    out = index.where(F.col("term") == F.lit(fold_text(term)))
    return out.where(F.col("field").isin(fields)) if fields else out


def regex_lookup(index: DataFrame, pattern: str, fields: list[str] | None = None) -> DataFrame:
    """Index rows whose term matches; what the pattern begins with literally bounds the scan."""
    out = index.where(F.col("term").rlike(rf"\A(?:{pattern})\z"))
    start = re.match(r"[\w\s-]*", pattern)[0]
    # The last literal may be made optional by what follows it.
    start = start[:-1] if len(start) < len(pattern) and pattern[len(start)] in "*?{" else start
    if start and "|" not in pattern:
        out = out.where(F.col("term").startswith(start))
    return out.where(F.col("field").isin(fields)) if fields else out


def range_lookup(index: DataFrame, field: str, low: str, high: str, open_low: bool = False, open_high: bool = False) -> DataFrame:
    """Index rows of a field's terms between two normal forms."""
    term = F.col("term")
    return index.where((F.col("field") == field) & ((term > low) if open_low else (term >= low)) & ((term < high) if open_high else (term <= high)))


def list_lookup(index: DataFrame, field: str, terms: list[str]) -> DataFrame:
    return index.where((F.col("field") == field) & F.col("term").isin([fold_text(t) for t in terms]))


def field_names(index: DataFrame, term: str) -> DataFrame:
    """Fields that hold a term, which expand a search without a field."""
    return literal_lookup(index, term).select("field").distinct()


def dated(index: DataFrame, low: str, high: str) -> DataFrame:
    return index.where(F.col("date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def union_keys(parts: list[DataFrame]) -> DataFrame:
    """Keys that any of the index parts holds."""
    return reduce(lambda a, b: a.unionByName(b), (p.select(F.explode("keys").alias("key")) for p in parts)).distinct()


def intersect_keys(parts: list[DataFrame]) -> DataFrame:
    """Keys that all of the index parts hold: one grouping, however many parts."""
    marked = reduce(lambda a, b: a.unionByName(b), (p.select(F.explode("keys").alias("key"), F.lit(n).alias("part")) for n, p in enumerate(parts)))
    return marked.groupBy("key").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(parts)).select("key")


def without_keys(found: DataFrame, gone: DataFrame) -> DataFrame:
    return found.join(gone.select(F.explode("keys").alias("key")).distinct(), "key", "left_anti")


def documents_of(documents: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return documents.join(keys.select(F.col("key").alias("_key")), F.col(key) == F.col("_key"), "left_semi")


def merge_index(parts: DataFrame, most_keys: int = 20) -> DataFrame:
    """Index rows of one term and day as one: counts add up, keys unite until they are too many to list."""
    known = F.when(F.count_if(F.col("keys").isNull()) == 0, F.array_distinct(F.flatten(F.collect_list("keys"))))
    out = parts.groupBy("field", "term", "date").agg(F.sum("count").cast("bigint").alias("count"), known.alias("keys"))
    return out.withColumn("keys", F.when(F.size("keys") <= most_keys, F.sort_array("keys")))


def first_and_last_seen(index: DataFrame) -> DataFrame:
    return index.groupBy("field", "term").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.sum("count").cast("bigint").alias("count"))


def day_index(long: DataFrame) -> DataFrame:
    """(field, value, year, days): the days of a year on which a value occurs, as sorted day numbers."""
    return long.where("date IS NOT NULL").groupBy("field", "value", F.year("date").alias("year")).agg(F.sort_array(F.collect_set(F.dayofyear("date"))).alias("days"))


def year_index(long: DataFrame) -> DataFrame:
    return long.where("date IS NOT NULL").groupBy("field", "value").agg(F.sort_array(F.collect_set(F.year("date"))).alias("years"))


def date_index(df: DataFrame, other: str, event: str, kind: str) -> DataFrame:
    """(type, other date, event date, count): on which event dates documents with another date lie."""
    rows = df.select(F.lit(kind).alias("type"), F.to_date(other).alias("other"), F.to_date(event).alias("event"))
    return rows.where("other IS NOT NULL AND event IS NOT NULL").groupBy("type", "other", "event").agg(F.count("*").alias("count"))


def event_range(index: DataFrame, kind: str, low: str, high: str) -> DataFrame:
    """One row: the event dates that a range of another date comes to, nulls without any."""
    at = index.where((F.col("type") == kind) & F.col("other").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    return at.agg(F.min("event").alias("first"), F.max("event").alias("last"))


def by_other_date(df: DataFrame, index: DataFrame, kind: str, other: str, event: str, low: str, high: str) -> DataFrame:
    """Documents by another date: the index's bounds prune the event date, then the date itself decides."""
    bounds = event_range(index, kind, low, high).first()
    if bounds["first"] is None:
        return df.where(F.lit(False))
    inside = df.where(F.to_date(event).between(F.lit(bounds["first"]), F.lit(bounds["last"])))
    return inside.where(F.to_date(other).between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def cardinalities(index: DataFrame) -> DataFrame:
    """Distinct terms and rows of each field and day."""
    return index.groupBy("field", "date").agg(F.count_distinct("term").alias("terms"), F.sum("count").cast("bigint").alias("count"))


def field_summary(long: DataFrame) -> DataFrame:
    """Of each field: values, distinct values (estimated), shortest and longest, first and last date."""
    size: Column = F.length("value")
    return long.groupBy("field").agg(F.count("*").alias("count"), F.approx_count_distinct("value", 0.02).alias("distinct"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.min("date").alias("first"), F.max("date").alias("last"))
