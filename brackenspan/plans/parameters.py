"""Per-query parameters: options by name that bound, filter, project and shape one query's results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackenspan.plans.ast import QuerySyntaxError

#: Names of options and what each holds (fixed values of the interface).
KNOWN = {
    "query.syntax": "text", "datatype.filter.set": "list", "datatype.field": "text", "include.datatype.as.field": "flag", "include.record.id": "flag",
    "include.grouping.context": "flag", "return.fields": "list", "disallowlisted.fields": "list", "rename.fields": "list", "limit.fields": "list",
    "matching.field.sets": "text", "group.fields": "list", "sum.fields": "list", "max.fields": "list", "min.fields": "list", "count.fields": "list", "average.fields": "list",
    "unique.fields": "text", "most.recent.unique": "text", "no.expansion.fields": "list", "lenient.fields": "list", "strict.fields": "list", "hit.list": "flag",
    "excerpt.fields": "list", "summary.options": "list", "raw.data.only": "flag", "ignore.non.existent.fields": "flag", "max.results": "number",
    "date.field": "text", "begin.date": "text", "end.date": "text", "raw.types": "flag", "record.id": "text",
    "filter.masked.values": "flag", "masked.fields": "list",
}
#: Columns that only carry an index or a normal form.
_HIDDEN = "__norm"


class Parameters:
    def __init__(self, given: dict[str, str]):
        self.given: dict[str, str] = {}
        self.update(given)

    def update(self, more: dict[str, str]) -> None:
        for name, value in more.items():
            if name not in KNOWN:
                raise QuerySyntaxError(f"no parameter {name!r}")
            if KNOWN[name] == "number" and not re.fullmatch(r"\d+", str(value)):
                raise QuerySyntaxError(f"{name} takes a number, not {value!r}")
            self.given[name] = str(value)

    def list_of(self, name: str) -> list[str]:
        return [x.strip() for x in re.split(r"[,;](?![^\[]*\])", self.given.get(name, "")) if x.strip()]

    def flag(self, name: str) -> bool:
        return self.given.get(name, "").lower() == "true"

    @property
    def syntax(self) -> str | None:
        return self.given.get("query.syntax", "").lower() or None

    def before(self, df: DataFrame) -> DataFrame:
        """Documents of the wanted data types and dates: plain predicates, which prune partitions of those columns."""
        kinds = self.list_of("datatype.filter.set")
        if kinds:
            df = df.where(F.col(self.given.get("datatype.field", "DATATYPE")).isin(kinds))
        time = self.given.get("date.field")
        if time:
            from brackenspan.functions.types import literal_date, time_literal, unit_end

            data = df.schema[time].dataType
            for name, end in (("begin.date", False), ("end.date", True)):
                if name in self.given:
                    found = literal_date(self.given[name])
                    if found is None:
                        raise QuerySyntaxError(f"{name} takes a date, not {self.given[name]!r}")
                    stamp = time_literal(unit_end(*found) if end else found[0], data)
                    df = df.where(F.col(time) <= stamp if end else F.col(time) >= stamp)
        return df

    def model(self, model):
        from dataclasses import replace

        return replace(model, lenient=frozenset(model.lenient) | set(self.list_of("lenient.fields")), strict=frozenset(model.strict) | set(self.list_of("strict.fields")))

    def fixed(self) -> set[str]:
        return set(self.list_of("no.expansion.fields"))

    def hit_list(self) -> bool:
        return self.flag("hit.list")

    def limits(self) -> dict[str, int]:
        out = {}
        for text in self.list_of("limit.fields"):
            name, _, n = text.rpartition("=")
            if not name or not re.fullmatch(r"-?\d+", n):
                raise QuerySyntaxError(f"limit.fields takes FIELD=n, not {text!r}")
            if int(n) >= 0:
                out[name] = int(n)
        return out

    def matching_sets(self) -> list[list[str]]:
        """``A=B,C=D``: fields of one set keep values that are equal in all of them."""
        return [[n.strip() for n in part.split("=")] for part in self.given.get("matching.field.sets", "").split(",") if part.strip()]

    def max_results(self) -> int | None:
        return int(self.given["max.results"]) if "max.results" in self.given else None

    def options(self) -> list[tuple[str, list]]:
        """The same as the ``f:`` functions of these names."""
        out: list[tuple[str, list]] = []
        if "unique.fields" in self.given:
            recent = self.given.get("most.recent.unique")
            out.append(("most_recent_unique", [recent, self.given["unique.fields"]]) if recent and recent.lower() not in ("true", "false") else ("unique", [self.given["unique.fields"]]))
        for name, option in (("group.fields", "groupby"), ("sum.fields", "sum"), ("max.fields", "max"), ("min.fields", "min"), ("count.fields", "count"), ("average.fields", "average"), ("rename.fields", "rename"), ("excerpt.fields", "excerpt_fields"), ("summary.options", "summary")):
            if found := self.list_of(name):
                out.append((option, found))
        return out

    def added(self, df: DataFrame, documents: DataFrame) -> DataFrame:
        """Columns that parameters add, by the fields' own names."""
        if self.flag("include.datatype.as.field") and "EVENT_DATATYPE" not in df.columns:
            df = df.withColumn("EVENT_DATATYPE", F.col(self.given.get("datatype.field", "DATATYPE")))
        if self.flag("include.record.id") and "RECORD_ID" not in df.columns:
            key = self.given.get("record.id") or documents.columns[0]
            df = df.withColumn("RECORD_ID", F.col(key).cast("string"))
        return df

    def after(self, df: DataFrame) -> DataFrame:
        """Projection, and what parameters take away."""
        if self.flag("filter.masked.values"):
            for name in self.list_of("masked.fields"):
                # The masked form stands beside the value; who may not see the value gets that.
                if name in df.columns and f"{name}_MASKED" in df.columns:
                    df = df.withColumn(name, F.col(f"{name}_MASKED")).drop(f"{name}_MASKED")
        if "include.grouping.context" in self.given and not self.flag("include.grouping.context"):
            for f in df.schema.fields:
                kind = f.dataType.simpleString()
                if kind.startswith("array<struct<group:") and ",value:" in kind:
                    df = df.withColumn(f.name, F.transform(f.name, lambda v: v["value"]))
        if wanted := self.list_of("return.fields"):
            missing = [n for n in wanted if n not in df.columns]
            if missing and not self.flag("ignore.non.existent.fields"):
                raise QuerySyntaxError(f"no fields {missing}")
            keep = [n for n in wanted if n in df.columns]
            df = df.select(*keep, *(c for c in ("HIT_TERM", "RECORD_ID", "EVENT_DATATYPE") if c in df.columns and c not in keep))
        gone = [*self.list_of("disallowlisted.fields"), *(c for c in df.columns if self.flag("raw.data.only") and c.endswith(_HIDDEN))]
        if gone:
            df = df.drop(*gone)
        if self.flag("raw.types"):
            df = df.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if not f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f"`{f.name}`") for f in df.schema.fields))
        return df
