"""Shaping of results: unique, group-by with aggregates, rename, limits, excerpts and summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackenspan.functions.content import excerpt, summary
from brackenspan.functions.types import granule

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "average": F.avg, "count": F.count}


def parse_keys(args: list, unit: str | None = None) -> list[tuple[str, str]]:
    """(field, granularity) of ``F``, ``F[DAY,HOUR]`` and comma-separated lists of them."""
    out = []
    for name, units in re.findall(r"(\w+)(?:\[([\w,\s]+)\])?", ",".join(map(str, args))):
        out += [(name, u.strip().upper()) for u in (units or unit or "ALL").split(",")]
    return out


def _key_columns(keys: list[tuple[str, str]]):
    return [F.col(n).alias(n) if u == "ALL" else granule(F.col(n), u).alias(n if sum(m == n for m, _ in keys) == 1 else f"{n}_{u}") for n, u in keys]


def unique(df: DataFrame, keys: list[tuple[str, str]], latest: str | None = None) -> DataFrame:
    """One document for each distinct key: that of the latest time, ties and the rest by the least values.

    An aggregate that is begun before the exchange, so a key with any share of the rows is no task's burden.
    """
    plain = [F.col(f"`{c}`") for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    row, order = F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*plain)
    named = [k.alias(f"_k{n}") for n, k in enumerate(_key_columns(keys))]
    if latest:
        time = -F.unix_micros(F.col(latest).cast("timestamp")) if not df.schema[latest].dataType.simpleString().startswith(("bigint", "int", "double", "float", "decimal")) else -F.col(latest)
        # Nulls come last.
        order = F.struct(F.col(latest).isNull(), time, order)
    return df.groupBy(*named).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def group_by(df: DataFrame, keys: list[tuple[str, str]], aggregates: list[tuple[str, str]]) -> DataFrame:
    """Count and aggregates (kind, field) of each group; a multi-valued field counts each value."""
    arrays = {f.name for f in df.schema.fields if f.dataType.simpleString().startswith("array")}
    for name in {n for n, _ in keys} & arrays:
        df = df.withColumn(name, F.explode(name))
    out = [F.count("*").alias("COUNT")]
    for kind, name in aggregates:
        if name in arrays:
            inner = {"sum": lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, v: a + v)), "count": lambda c: F.sum(F.size(c)), "min": lambda c: F.min(F.array_min(c)), "max": lambda c: F.max(F.array_max(c)), "average": lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, v: a + v)) / F.sum(F.size(c))}[kind]
            out.append(inner(F.col(name)).alias(f"{name}_{kind.upper()}"))
        else:
            out.append(AGGREGATES[kind](name).alias(f"{name}_{kind.upper()}"))
    return df.groupBy(*_key_columns(keys)).agg(*out)


def limit_fields(df: DataFrame, limits: dict[str, int], hits: dict[str, list] | None = None, together: list[list[str]] | None = None) -> DataFrame:
    """At most so many values of each named multi-valued field; the count before goes to ``<F>_ORIGINAL_COUNT``.

    Values that pass one of the field's tests in ``hits`` come first and are kept even beyond the limit, and so do
    those of the fields of one set in ``together`` that equal a hit of another field of the set.
    """
    tests_of = {n: list(t) for n, t in (hits or {}).items()}
    values = {n: F.col(n) for names in together or [] for n in names if n in df.columns}
    for names in together or []:
        for name in names:
            for other in names:
                if other != name and (hits or {}).get(other) and other in values:
                    found = F.filter(values[other], _any_of(hits[other]))
                    tests_of.setdefault(name, []).append(lambda v, found=found: F.array_contains(found, v))
    for name, n in limits.items():
        tests = tests_of.get(name)
        df = df.withColumn(f"{name}_ORIGINAL_COUNT", F.size(name)).withColumn(name, _hits_first(name, n, tests) if tests else F.slice(name, 1, n))
    return df


def _any_of(tests: list):
    return lambda v: reduce(lambda a, b: a | b, (F.coalesce(t(v), F.lit(False)) for t in tests))


def _hits_first(name: str, n: int, tests: list):
    hit = lambda v: reduce(lambda a, b: a | b, (F.coalesce(t(v), F.lit(False)) for t in tests))
    first, others = F.filter(name, lambda v: hit(v)), F.filter(name, lambda v: ~hit(v))
    return F.concat(first, F.slice(others, F.lit(1), F.greatest(F.lit(n) - F.size(first), F.lit(0))))


def rename(df: DataFrame, pairs: list[str]) -> DataFrame:
    for old, new in (p.split("=") for text in pairs for p in str(text).split(",")):
        df = df.withColumnRenamed(old.strip(), new.strip())
    return df


def apply(df: DataFrame, options: list[tuple[str, list]]) -> DataFrame:
    """What the query's ``f:`` functions ask, in the order unique, group-by, rename."""
    keys, aggregates, renames = [], [], []
    for name, args in options:
        unit = re.sub(r"^(most_recent_)?(unique_by|groupby)_", "", name).upper() if re.search(r"(unique_by|groupby)_", name) else None
        if name.startswith(("unique", "most_recent_unique")):
            time = None
            if name.startswith("most_recent"):
                time, args = str(args[0]), args[1:]
            df = unique(df, parse_keys(args, unit), time)
        elif name.startswith("groupby"):
            keys += parse_keys(args, unit)
        elif name in AGGREGATES:
            aggregates += [(name, n) for a in args for n in re.findall(r"\w+", str(a))]
        elif name == "rename":
            renames += args
        elif name == "excerpt_fields":
            for text in args:
                n, _, size = str(text).partition("/")
                field, _, term = n.partition("=")
                df = df.withColumn(f"{field}_EXCERPT", excerpt(F.col(field), term, int(size or 10)) if term else summary(F.col(field), int(size or 10) * 10))
        elif name == "summary":
            field, *size = [str(a) for a in args]
            df = df.withColumn(f"{field}_SUMMARY", summary(F.col(field), int(size[0]) if size else 150))
    if keys:
        df = group_by(df, keys, aggregates)
    return rename(df, renames) if renames else df
