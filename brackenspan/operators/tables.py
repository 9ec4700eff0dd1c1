"""Side tables of a document set: long view, term index, discovery, facets, field statistics, edges, age-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackenspan.functions.types import fold


def long_view(df: DataFrame, key: str, fields: list[str], date: str | None = None) -> DataFrame:
    """(key, date, field, value) of every value of the named fields."""
    day = F.to_date(date) if date else F.lit(None).cast("date")
    values = lambda f: F.col(f).cast("array<string>") if df.schema[f].dataType.simpleString().startswith("array") else F.array(F.col(f).cast("string"))
    named = lambda f: F.transform(values(f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))
    pairs = F.flatten(F.array(*map(named, fields)))
    out = df.select(F.col(key).alias("key"), day.alias("date"), F.explode(pairs).alias("p")).select("key", "date", "p.field", "p.value")
    return out.where("value IS NOT NULL")


def term_index(long: DataFrame, most_ids: int = 20) -> DataFrame:
    """(field, term, date) with count, and the keys unless they are more than ``most_ids``."""
    terms = long.withColumn("term", fold(F.col("value")))
    counts = terms.groupBy("field", "term", "date").agg(F.count("*").alias("count"), F.count_distinct("key").alias("n"))
    at = lambda left, right: [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("field", "term", "date")]
    few = terms.alias("t").join(counts.where(F.col("n") <= most_ids).alias("c"), at("t", "c"), "left_semi")
    keys = few.groupBy("field", "term", "date").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return counts.drop("n").alias("c").join(keys.alias("k"), at("c", "k"), "left").select("c.*", "k.keys")


def discovery(long: DataFrame, pattern: str) -> DataFrame:
    """Terms that match a pattern (whole, normalised), with their counts by field and date."""
    return long.withColumn("term", fold(F.col("value"))).where(F.col("term").rlike(f"^(?:{pattern})$")).groupBy("field", "term", "date").agg(F.count("*").alias("count"))


def facets(long: DataFrame, least: int = 1) -> DataFrame:
    """Count of documents for each value of each field."""
    return long.groupBy("field", "value").agg(F.count_distinct("key").alias("count")).where(F.col("count") >= least)


def field_statistics(long: DataFrame) -> DataFrame:
    """For each field: values, distinct values, and the share of distinct ones."""
    out = long.groupBy("field").agg(F.count("*").alias("count"), F.count_distinct("value").alias("cardinality"))
    return out.withColumn("weight", F.col("cardinality") / F.col("count"))


def field_cardinality(long: DataFrame) -> DataFrame:
    """As a mergeable sketch for each field."""
    return long.groupBy("field").agg(F.hll_sketch_agg("value", F.lit(12)).alias("sketch"))


def edges(df: DataFrame, source: Column, sink: Column, kind: Column, time: Column) -> DataFrame:
    """Counts between two vertices by kind and day, with counts by hour."""
    rows = df.select(source.cast("string").alias("source"), sink.cast("string").alias("sink"), kind.alias("type"), F.to_date(time).alias("date"), F.hour(time).alias("h"))
    rows = rows.where("source IS NOT NULL AND sink IS NOT NULL")
    hours = F.array(*(F.count_if(F.col("h") == n) for n in range(24)))
    return rows.groupBy("source", "sink", "type", "date").agg(F.count("*").alias("count"), hours.alias("hours"))


def edge_lookup(edge_table: DataFrame, vertices: list[str], both_ways: bool = True) -> DataFrame:
    at = F.col("source").isin(vertices)
    return edge_table.where(at | F.col("sink").isin(vertices) if both_ways else at)


def age_off(df: DataFrame, time: str, now: str, rules: list[tuple[Column, int]], default_days: int | None = None) -> DataFrame:
    """Rows younger than the days of the first rule that applies; without one, than the default."""
    days = F.lit(default_days).cast("int")
    for applies, n in reversed(rules):
        days = F.when(applies, F.lit(n)).otherwise(days)
    age = F.datediff(F.lit(now).cast("timestamp"), F.col(time))
    return df.where(days.isNull() | (age < days))


def ngram_index(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(ngram, key) of a string column, for similarity lookup."""
    last = F.length(text) - F.lit(size - 1)
    grams = F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col(text), i, F.lit(size)))))
    return df.select(F.col(key).alias("key"), F.explode(grams).alias("ngram"))


def similar_by_ngrams(index: DataFrame, queries: DataFrame, least: int) -> DataFrame:
    """Pairs (query, key) that share at least so many n-grams, with the number shared."""
    hits = queries.withColumnRenamed("key", "query").join(index, "ngram").where("query != key")
    return hits.groupBy("query", "key").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
