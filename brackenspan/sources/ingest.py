"""From raw records to documents and side tables: normal forms, virtual and composite fields, masks, edges by definition, labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackenspan.functions.types import NORMAL
from brackenspan.plans.compile import NORMAL_SUFFIX, Compiler, Model, parsed


def normalised(df: DataFrame, fields: list[str], model: Model | None = None) -> DataFrame:
    """``df`` with a column of normal forms beside each field, made once here so that queries compare it as it stands."""
    types = (model or Model()).types

    def one(name: str) -> Column:
        make = NORMAL[types.get(name, "text")]
        array = df.schema[name].dataType.simpleString().startswith("array")
        return F.transform(name, lambda v: make(v.cast("string"))) if array else make(F.col(name).cast("string"))

    return df.withColumns({name + NORMAL_SUFFIX: one(name) for name in fields})


def virtual_field(df: DataFrame, name: str, parts: list[str], separator: str = " ", all_needed: bool = True) -> DataFrame:
    """Values of several fields joined to one; null where one is missing, or with ``all_needed`` off, of those that are there."""
    joined = F.concat_ws(separator, *(F.col(p).cast("string") for p in parts))
    missing = [F.col(p).isNull() for p in parts]
    none = missing[0]
    for m in missing[1:]:
        none = none | m if all_needed else none & m
    return df.withColumn(name, F.when(~none, joined))


def composite_field(df: DataFrame, name: str, parts: list[str], separator: str = "\U0010ffff") -> DataFrame:
    """The normal forms of several fields in one column that sorts by them in turn: one range instead of several."""
    return virtual_field(df, name, parts, separator)


def masked(df: DataFrame, field: str, mask: Column) -> DataFrame:
    """``df`` with the form of a field that those see who may not see the field."""
    return df.withColumn(f"{field}_MASKED", mask)


def uid(*columns: str) -> Column:
    """A document's identifier by content: 128 bits in hexadecimal."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32)


@dataclass(frozen=True)
class Edge:
    """One kind of edge: which fields are its ends, its name, and the expression that documents must fulfil."""

    source: str
    sink: str
    kind: str
    relation: str = "-"
    when: str | None = None


def defined_edges(df: DataFrame, definitions: list[Edge], time: str, model: Model | None = None) -> DataFrame:
    """(source, sink, type, relation, date, count, hours) of all definitions: one pass over the documents."""

    def of(name: str) -> Column:
        return F.col(name).cast("array<string>") if df.schema[name].dataType.simpleString().startswith("array") else F.array(F.col(name).cast("string"))

    def pairs(e: Edge) -> Column:
        wanted = Compiler(df.schema, model or Model()).predicate(parsed(e.when)) if e.when else F.lit(True)
        both = F.flatten(F.transform(of(e.source), lambda a: F.transform(of(e.sink), lambda b: F.struct(a.alias("source"), b.alias("sink"), F.lit(e.kind).alias("type"), F.lit(e.relation).alias("relation")))))
        return F.when(wanted, both)

    lists = [F.coalesce(pairs(e), F.array().cast("array<struct<source:string,sink:string,type:string,relation:string>>")) for e in definitions]
    rows = df.select(F.to_date(time).alias("date"), F.hour(time).alias("h"), F.explode(F.concat(*lists)).alias("e")).select("date", "h", "e.*").where("source IS NOT NULL AND sink IS NOT NULL")
    hours = F.array(*(F.count_if(F.col("h") == n) for n in range(24)))
    return rows.groupBy("source", "sink", "type", "relation", "date").agg(F.count("*").alias("count"), hours.alias("hours"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """Of each vertex and day: its links (distinct other ends) and their counts."""
    both = edges.select("type", "date", F.col("source").alias("vertex"), F.col("sink").alias("other"), "count").unionByName(edges.select("type", "date", F.col("sink").alias("vertex"), F.col("source").alias("other"), "count"))
    return both.groupBy("vertex", "type", "date").agg(F.count_distinct("other").alias("links"), F.sum("count").cast("bigint").alias("count"))


# Labels: boolean expressions of tokens, as ``A&(B|C)``.


@lru_cache(maxsize=65_536)
def may_see(expression: str, held: frozenset) -> bool:
    """Whether a holder of tokens satisfies an expression; an empty one is open to all, a broken one to none."""
    import re

    tokens = re.findall(r'[&|()]|"[^"]*"|[^&|()\s"]+', expression or "")[::-1]
    if not tokens:
        return True

    def term() -> bool:
        token = tokens.pop()
        if token == "(":
            out = either()
            if not tokens or tokens.pop() != ")":
                raise ValueError
            return out
        if token in "&|)":
            raise ValueError
        return token.strip('"') in held

    def both() -> bool:
        out = term()
        while tokens and tokens[-1] == "&":
            tokens.pop()
            out = term() and out
        return out

    def either() -> bool:
        out = both()
        while tokens and tokens[-1] == "|":
            tokens.pop()
            out = both() or out
        return out

    try:
        out = either()
        return out and not tokens
    except (ValueError, IndexError):
        return False


def visible(df: DataFrame, label: str, held: set[str]) -> DataFrame:
    """Rows whose label the tokens satisfy. Each distinct label is parsed once a worker."""
    mine = frozenset(held)

    @F.pandas_udf("boolean")
    def test(labels: pd.Series) -> pd.Series:
        return labels.map(lambda e: may_see(e or "", mine))

    return df.where(test(F.coalesce(F.col(label).cast("string"), F.lit(""))))
