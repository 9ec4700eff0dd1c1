"""Sources and sinks: CSV and JSON documents (nested ones flattened, plainly or with grouping contexts), lines of any length, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, multi: tuple[str, ...] = (), separator: str = ";") -> DataFrame:
    """Rows of a CSV with a header; the fields in ``multi`` hold several values."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumns({c: F.split(c, separator) for c in multi})


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return flatten(spark.read.schema(schema).json(path))


def flatten(df: DataFrame, joiner: str = "_") -> DataFrame:
    """Nested objects become columns named by their path; arrays of objects become arrays by member."""
    return df.select(*_leaves(df.schema, joiner))


def _leaves(schema: T.StructType, joiner: str = "_", path: str = "", name: str = ""):
    for f in schema.fields:
        at, label = (f"{path}.`{f.name}`" if path else f"`{f.name}`"), (f"{name}{joiner}{f.name}" if name else f.name)
        kind = f.dataType
        if isinstance(kind, T.StructType):
            yield from _leaves(kind, joiner, at, label)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            yield from _leaves(kind.elementType, joiner, at, label)
        else:
            yield F.col(at).alias(label)


def flatten_json(df: DataFrame, mode: str = "normal") -> DataFrame:
    """Nested objects as flat fields, in one of four modes.

    ``simple`` keeps the root's plain values; ``normal`` names each leaf by its path; ``grouped`` collects leaves of one
    name, in upper case, as (group, value) pairs, whose group is the path with each step's place (``b_0.d_1``), so that values
    of one object can be told to belong together; ``grouped_and_normal`` has both.
    """
    if mode == "simple":
        return df.select(*(f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))))
    if mode == "normal":
        return flatten(df)
    if mode not in ("grouped", "grouped_and_normal"):
        raise ValueError(f"no mode {mode!r}")
    found: dict[str, list] = {}

    def item(group, value):
        return F.struct(group.alias("group"), value.cast("string").alias("value"))

    def walk(schema: T.StructType, lift) -> None:
        """``lift`` makes, from a function of (object, its group) to an array, that array over all objects of this kind."""
        for f in schema.fields:
            def step(make, f=f, lift=lift):
                kind = f.dataType
                place = lambda g, k: F.concat_ws(".", F.when(g != "", g), F.concat(F.lit(f"{f.name}_"), k.cast("string")))
                if isinstance(kind, T.ArrayType):
                    inner = lambda o, g: F.flatten(F.transform(F.coalesce(o[f.name], F.array().cast(kind)), lambda x, k: make(x, place(g, k))))
                else:
                    inner = lambda o, g: make(o[f.name], place(g, F.lit(0)))
                return lift(inner)

            kind = f.dataType
            if isinstance(kind, T.StructType):
                walk(kind, step)
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                walk(kind.elementType, step)
            elif isinstance(kind, T.ArrayType):
                found.setdefault(f.name.upper(), []).append(lift(lambda o, g, f=f: F.transform(F.coalesce(o[f.name], F.array().cast(f.dataType)), lambda x: item(g, x))))
            else:
                found.setdefault(f.name.upper(), []).append(lift(lambda o, g, f=f: F.array(item(g, o[f.name]))))

    root = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    walk(df.schema, lambda make: make(root, F.lit("")))
    columns = {name: F.filter(F.concat(*lists), lambda x: x["value"].isNotNull()) for name, lists in found.items()}
    if mode == "grouped":
        return df.select(*(c.alias(name) for name, c in columns.items()))
    plain = flatten(df)
    taken = {c.lower() for c in plain.columns}
    normal = list(_leaves(df.schema))
    return df.select(*normal, *(c.alias(name if name.lower() not in taken else f"{name}_GROUPED") for name, c in columns.items()))


def long_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of each line of text files, of any length; ``line`` rises within a file's part and is unique."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def write(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)
