import re

import duckdb
import pytest
from pyspark.sql import functions as F

from brackenspan.functions import types as N
from brackenspan.operators import tables
from brackenspan.plans import catalogue
from brackenspan.plans.ast import QuerySyntaxError
from brackenspan.plans.compile import Model, query
from brackenspan.sources.ingest import normalised
from brackenspan.sources.io import flatten

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(f"{v:.6f}" if isinstance(v, float) or str(v).lstrip("-").isdigit() else str(v) for v in map(lambda v: float(v) if str(v).lstrip("-").isdigit() else v, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    assert canonical(catalogue.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(catalogue.ORACLES[name]).df())


def test_normal_forms_of_long_keys_match_sql(spark, tmp_path):
    keys = [0, 9, 255, 4095, 4096, 65535, 65536, 65537, 74565, 899999, 1048575, 1048576, 16777216, 2**40, None]
    rows = [(k, f"Customer#{k}", 1, 2.5, "MACHINERY") for k in keys]
    schema = spark.read.parquet(f"{SF}/customer.parquet").schema
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "customer.parquet"))
    catalogue.QUERIES["normal_forms"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    with duckdb.connect() as con:
        for name, folder in (("customer", "customer.parquet"), ("given", "out")):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{folder}/*.parquet')")
        wanted = f"({catalogue.ORACLES['normal_forms']})"
        for one, other in (("(FROM given)", wanted), (wanted, "(FROM given)")):
            assert con.sql(f"{one} EXCEPT ALL {other}").fetchall() == []


@pytest.fixture(scope="module")
def cities(spark):
    rows = [(1, ["Paris", "Roma"], "48.85_2.35", "Élan vital of the town", 5.0, "10.0.0.7"), (2, ["London"], "51.5_-0.12", "the town of elan", 7.0, "10.1.0.1"), (3, None, None, None, None, None), (4, [], "bad", "", 0.0, "x")]
    return spark.createDataFrame(rows, "id int, city array<string>, geo string, note string, num double, ip string")


@pytest.mark.parametrize(
    "text,ids",
    [
        ("city == 'paris'", [1]),
        ("city != 'paris'", [2, 3, 4]),
        ("city =~ 'lon.*'", [2]),
        ("city == null", [3, 4]),
        ("note == 'ÉLAN VITAL of the town'", [1]),
        ("content:phrase(note, 'the', 'town')", [1, 2]),
        ("content:adjacent(note, 'vital', 'elan')", [1]),
        ("content:within(note, 3, 'elan', 'town')", [2]),
        ("geo:within_bounding_box(geo, '40_-1', '52_3')", [1, 2]),
        ("geo:within_circle(geo, '48.8_2.3', 1)", [1]),
        ("ip == '10.0.0.0/16'", [1]),
        ("filter:isNull(note)", [3]),
        ("city.size() > 1 || num == 7", [1, 2]),
        ("nowhere == 'x'", []),
    ],
)
def test_predicates(cities, text, ids):
    found = query(cities, text, model=Model(types={"ip": "ip"}))
    assert sorted(r.id for r in found.select("id").collect()) == ids


@pytest.mark.parametrize(
    "text,syntax,ids",
    [
        ("note =~ '.*word'", "jexl", [1]),
        ("note:*word", "lucene", [1]),
        ("note =~ 'word'", "jexl", []),
        ("note =~ 'FIRST.*'", "jexl", [1]),
        (r"note =~ '\S+'", "jexl", [2]),
        ("note =~ 'é.*'", "jexl", [2]),
        ("filter:includeRegex(note, 'FIRST.*word')", "jexl", [1]),
        ("filter:excludeRegex(note, 'FIRST.*word')", "jexl", [2, 3]),
    ],
)
def test_regexes(spark, text, syntax, ids):
    df = spark.createDataFrame([(1, "First line\nlast\nWord"), (2, "Élan"), (3, None)], "id int, note string")
    assert sorted(r.id for r in query(df, text, syntax).collect()) == ids


def test_limits_keep_hits(spark):
    df = spark.createDataFrame([(1, ["a", "b", None, "Hit", "c", "hit too", "hit"]), (2, ["x", "hit"]), (3, None)], "id int, v array<string>")
    kept = lambda text, n: {r.id: (r.v_ORIGINAL_COUNT, r.v) for r in query(df, text, limits={"v": n}).collect()}
    assert kept("v == 'hit'", 3) == {1: (7, ["Hit", "hit", "a"]), 2: (2, ["hit", "x"])}
    assert kept("v =~ 'hit.*' && !(v == 'a' && v == 'x')", 1) == {1: (7, ["Hit", "hit too", "hit"]), 2: (2, ["hit"])}
    assert kept("true", 1)[1] == (7, ["a"])


def test_groups(spark):
    kind = "array<struct<group:string,value:string>>"
    df = spark.createDataFrame([(1, [("e", "Rome"), ("w", "Oslo")], [("e", "IT"), ("w", "NO")]), (2, [("e", "Rome")], [("w", "IT")])], f"id int, city {kind}, state {kind}")
    assert [r.id for r in query(df, "grouping:matchesInGroup(city, 'rome', state, 'it')").collect()] == [1]


def pushed(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", df._jdf.queryExecution().executedPlan().toString()).groups()


@pytest.mark.parametrize(
    "table,text,syntax,wanted",
    [
        ("orders", "o_totalprice > 1000", "jexl", "GreaterThan(o_totalprice,1000.0)"),
        ("orders", "o_custkey == 7 || 9 == o_custkey", "jexl", "Or(EqualTo(o_custkey,7),EqualTo(o_custkey,9))"),
        ("orders", "o_custkey != 7", "jexl", "Or(IsNull(o_custkey),Not(EqualTo(o_custkey,7)))"),
        ("orders", "o_orderdate > '1997-01-01'", "jexl", "GreaterThan(o_orderdate,1997-01-01"),
        ("orders", "filter:betweenDates(o_orderdate, '1995-01-01', '1995-06-30')", "jexl", "LessThanOrEqual(o_orderdate,1995-06-30"),
        ("lineitem", "l_quantity:[10 TO 12]", "lucene", "GreaterThanOrEqual(l_quantity,10.0)"),
        ("lineitem", "f:between(l_quantity, 10, 12)", "jexl", "LessThanOrEqual(l_quantity,12.0)"),
    ],
)
def test_filters_reach_the_scan(spark, table, text, syntax, wanted):
    filters, schema = pushed(query(spark.read.parquet(f"{SF}/{table}.parquet"), text, syntax, fields=[text.split()[0]] if text.startswith("o_totalprice") else None))
    assert wanted in filters
    if text.startswith("o_totalprice"):
        assert "o_orderpriority" not in schema


def test_normalised_text_reaches_the_scan(spark, tmp_path):
    normalised(spark.read.parquet(f"{SF}/events.parquet"), ["event_type"]).write.parquet(str(tmp_path / "n"))
    df = query(spark.read.parquet(str(tmp_path / "n")), "event_type == 'CLICK'")
    assert "EqualTo(event_type__norm,click)" in pushed(df)[0]
    assert df.count() == spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").count()


def test_normal_forms(spark):
    df = spark.createDataFrame([("0xABC", "00-1A-2B-3C-4D-5E", "0042", "1.2.3.4", "a;B,ç")], "h string, m string, z string, i string, l string")
    row = df.select(N.hex_text(F.col("h")), N.mac(F.col("m")), N.trim_zeros(F.col("z")), N.ipv4(F.col("i")), N.text_list(F.col("l"))).first()
    assert tuple(row) == ("0abc", "00:1a:2b:3c:4d:5e", "42", 16909060, ["a", "b", "c"])


def test_tables(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "bcde"), (3, "x"), (4, None)], "id int, t string")
    index = tables.ngram_index(df, "id", "t", 3)
    assert tables.similar_by_ngrams(index, index, 1).count() == 2
    terms = tables.term_index(tables.long_view(df, "id", ["t"]), most_ids=1).collect()
    assert {r.term: r.keys for r in terms}["x"] == [3]


def test_flatten(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"a": {"b": 1, "c": [{"d": 2}, {"d": 3}]}}']))
    assert flatten(df).first().asDict() == {"a_b": 1, "a_c_d": [2, 3]}


def test_streams(spark, tmp_path):
    from brackenspan.streaming.events import ingest_rate, read_stream, standing_query

    source = spark.read.parquet(f"{SF}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), source.schema)
    for name, df, mode in (("hits", standing_query(stream, "event_type:click", "lucene"), "append"), ("rates", ingest_rate(stream, "ts", "event_type", "1 day", "2 days"), "complete")):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        run.processAllAvailable()
        run.stop()
    assert spark.table("hits").count() == source.where("event_type = 'click'").count()
    assert spark.table("rates").agg(F.sum("events")).first()[0] == source.count()


def test_arithmetic(spark):
    rows = [(1, [1.0, 7.0], 3, "4"), (2, [2.0], 0, "x"), (3, None, 5, "1"), (4, [10.0, 3.0], None, "2")]
    df = spark.createDataFrame(rows, "id long, many array<double>, n int, word string")
    found = lambda text: sorted(r.id for r in query(df, text).select("id").collect())
    assert found("many + n >= 10") == [1]
    assert found("many / n < 1") == [1]
    assert found("many / n == 1 / 0") == []
    assert found("n % 2 == 1") == [1, 3]
    assert found("n != 2 + 1") == [2, 3, 4]
    assert found("!(n + 1 > 3)") == [2, 4]
    assert found("word * n == 12") == [1]
    assert found("many > many * 2 - 2") == [1]
    assert found("nowhere + 1 > 0") == []
