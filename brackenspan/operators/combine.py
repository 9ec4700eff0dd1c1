"""Aggregates of side tables: combiners of counts, bits and extremes, metrics, and rules for what ages off."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of each unit of a time to live (fixed values of the format).
UNIT_SECONDS = {"d": 86_400.0, "h": 3_600.0, "m": 60.0, "s": 1.0, "ms": 0.001}


def summed(df: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(c).cast("bigint").alias(c) for c in counts))


def extremes(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))))


def united_bits(df: DataFrame, keys: list[str], bits: str) -> DataFrame:
    """Bit sets of one key, or-ed."""
    return df.groupBy(*keys).agg(F.bit_or(bits).alias(bits))


def summed_maps(df: DataFrame, keys: list[str], counters: str) -> DataFrame:
    """Counters by name: maps of one key added name by name."""
    rows = df.select(*keys, F.explode(counters).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").cast("bigint").alias("n"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias(counters))


def latency(values: Column) -> Column:
    """The sum of a metric's durations: of all of its array but the first, which counts events."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, v: a + v)


def ingest_rate(df: DataFrame, events: str, seconds: str) -> Column:
    return F.when(F.col(seconds) > 0, F.col(events) / F.col(seconds)).otherwise(0.0)


def daily_summary(df: DataFrame, time: str, keys: list[str], value: str) -> DataFrame:
    """Count, sum, least, greatest and mean of a measure for each day and key."""
    v = F.col(value)
    return df.groupBy(F.to_date(time).alias("date"), *keys).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"))


def distinct_sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A mergeable sketch of distinct values for each key."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value).cast("string"), F.lit(12)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


# Age-off.


@dataclass(frozen=True)
class Ttl:
    """A time to live: a number and a unit of ``UNIT_SECONDS``."""

    value: float
    unit: str = "d"

    @classmethod
    def parse(cls, text: str) -> Ttl:
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|[dhms])\s*", text)
        if not m:
            raise ValueError(f"{text!r} is no time to live")
        return cls(float(m[1]), m[2])

    @property
    def seconds(self) -> float:
        return self.value * UNIT_SECONDS[self.unit]


@dataclass(frozen=True)
class Rule:
    """To which rows a time to live applies; the first rule that does decides."""

    applies: Column
    ttl: Ttl


def matches(column: str, pattern: str) -> Column:
    """Rows whose column matches a regex somewhere."""
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def tokens(column: str) -> Column:
    return F.split(F.col(column), r"[^A-Za-z0-9_:./-]+")


def any_token(column: str, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(column), F.array(*map(F.lit, wanted))), F.lit(False))


def all_tokens(column: str, wanted: list[str]) -> Column:
    return F.coalesce(F.size(F.array_intersect(tokens(column), F.array(*map(F.lit, dict.fromkeys(wanted))))) == F.lit(len(set(wanted))), F.lit(False))


def token_rules(column: str, ttls: dict[str, str]) -> list[Rule]:
    """A rule for each token, the one listed first before the others."""
    return [Rule(any_token(column, [token]), Ttl.parse(text)) for token, text in ttls.items()]


def prefix_rules(column: str, ttls: dict[str, str]) -> list[Rule]:
    """By what a value begins with, the longest prefix first."""
    return [Rule(F.coalesce(F.col(column).startswith(p), F.lit(False)), Ttl.parse(ttls[p])) for p in sorted(ttls, key=len, reverse=True)]


def aged(df: DataFrame, time: str, now: str, rules: list[Rule], default: Ttl | None = None) -> DataFrame:
    """``df`` with ``ttl_seconds`` of the first rule that applies and ``expired``; nulls and False where none does."""
    ttl = F.lit(default.seconds if default else None).cast("double")
    for rule in reversed(rules):
        ttl = F.when(rule.applies, F.lit(rule.ttl.seconds)).otherwise(ttl)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6
    return df.withColumn("ttl_seconds", ttl).withColumn("expired", F.coalesce(age >= F.col("ttl_seconds"), F.lit(False)))


def alive(df: DataFrame, time: str, now: str, rules: list[Rule], default: Ttl | None = None) -> DataFrame:
    return aged(df, time, now, rules, default).where(~F.col("expired")).drop("ttl_seconds", "expired")
