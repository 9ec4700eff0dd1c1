"""Fuzzy hashes (``size:chunk:double chunk``): neighbours by n-grams, edit distance and overlap scores; keywords and tag clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackenspan.functions.content import words

NGRAM = 7
LEAST_BLOCK = 3
CHUNK_LENGTH = 64


def parse_hash(c: Column) -> Column:
    """struct(size, chunk, double_chunk) of a fuzzy hash; null if it is none."""
    ok = c.rlike(r"^\d+:[A-Za-z0-9+/]*:[A-Za-z0-9+/]*")
    part = lambda n: F.split_part(c, F.lit(":"), F.lit(n))
    return F.when(ok, F.struct(part(1).cast("bigint").alias("size"), part(2).alias("chunk"), F.regexp_extract(part(3), r"^[A-Za-z0-9+/]*", 0).alias("double_chunk")))


def without_runs(c: Column) -> Column:
    """Runs of one character over three long cut to three, as they tell nothing."""
    return F.regexp_replace(c, r"(.)\1{3,}", "$1$1$1")


def ngrams(c: Column, size: int = NGRAM) -> Column:
    last = F.length(c) - F.lit(size - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def hash_index(df: DataFrame, hash_col: str, size: int = NGRAM) -> DataFrame:
    """(chunk_size, ngram, hash): each n-gram of either chunk under the block size it stands for."""
    p = parse_hash(F.col(hash_col))
    rows = df.select(F.col(hash_col).alias("hash"), p.alias("p")).where("p IS NOT NULL").distinct()
    both = F.concat(
        F.transform(ngrams(without_runs(F.col("p.chunk")), size), lambda g: F.struct(F.col("p.size").alias("chunk_size"), g.alias("ngram"))),
        F.transform(ngrams(without_runs(F.col("p.double_chunk")), size), lambda g: F.struct((F.col("p.size") * 2).alias("chunk_size"), g.alias("ngram"))),
    )
    return rows.select("hash", F.explode(F.array_distinct(both)).alias("g")).select("g.chunk_size", "g.ngram", "hash")


def capped(index: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of n-grams with at most so many hashes, the n-grams left out with their numbers), so that nothing goes unseen."""
    counts = index.groupBy("chunk_size", "ngram").agg(F.count("*").alias("hashes"))
    return index.join(counts.where(F.col("hashes") <= most), ["chunk_size", "ngram"], "left_semi"), counts.where(F.col("hashes") > most)


def overlap_score(a: Column, b: Column, size: int = NGRAM) -> Column:
    """Number of n-grams two parsed hashes share at equal block sizes."""
    same = lambda x, y: F.size(F.array_intersect(ngrams(without_runs(x), size), ngrams(without_runs(y), size)))
    return (
        F.when(a["size"] == b["size"], same(a["chunk"], b["chunk"]) + same(a["double_chunk"], b["double_chunk"]))
        .when(a["size"] == b["size"] * 2, same(a["chunk"], b["double_chunk"]))
        .when(a["size"] * 2 == b["size"], same(a["double_chunk"], b["chunk"]))
        .otherwise(F.lit(0))
    )


def _chunk_score(x: Column, y: Column, size: Column) -> Column:
    """0 to 100 from an edit distance in which a change costs what an insertion and a deletion do."""
    # With changes at that cost, the distance is both lengths less twice the longest common subsequence; the
    # built-in distance counts changes once, so it is weighted by how lengths and edits relate.
    x, y = without_runs(x), without_runs(y)
    both = F.length(x) + F.length(y)
    edits = F.levenshtein(x, y) * 2 - F.abs(F.length(x) - F.length(y))
    raw = F.lit(100) - F.floor(F.floor(edits * CHUNK_LENGTH / F.greatest(both, F.lit(1))) * 100 / CHUNK_LENGTH)
    most = F.floor(size / LEAST_BLOCK) * F.least(F.length(x), F.length(y))
    # Short chunks at small block sizes can't prove much.
    bounded = F.when(size >= (99 + 7) / 7 * LEAST_BLOCK, raw).otherwise(F.least(raw, most))
    shared = F.arrays_overlap(ngrams(x), ngrams(y))
    return F.when(F.coalesce(shared, F.lit(False)), F.greatest(bounded, F.lit(0))).otherwise(F.lit(0)).cast("int")


def edit_score(a: Column, b: Column) -> Column:
    """0 to 100: how alike two parsed hashes are; 100 for equal ones, 0 without a common run of seven."""
    equal = (a["size"] == b["size"]) & (without_runs(a["chunk"]) == without_runs(b["chunk"])) & (without_runs(a["double_chunk"]) == without_runs(b["double_chunk"]))
    return (
        F.when(equal, F.lit(100))
        .when(a["size"] == b["size"], F.greatest(_chunk_score(a["chunk"], b["chunk"], a["size"]), _chunk_score(a["double_chunk"], b["double_chunk"], a["size"] * 2)))
        .when(a["size"] == b["size"] * 2, _chunk_score(a["chunk"], b["double_chunk"], a["size"]))
        .when(a["size"] * 2 == b["size"], _chunk_score(a["double_chunk"], b["chunk"], b["size"]))
        .otherwise(F.lit(0))
    )


def similar_hashes(index: DataFrame, queries: DataFrame, hash_col: str, least_overlap: int = 1, least_score: int = 0, size: int = NGRAM) -> DataFrame:
    """(query, hash, overlap, score) of hashes that share n-grams with a queried one, best first within a query."""
    asked = hash_index(queries, hash_col, size).withColumnRenamed("hash", "query")
    hits = asked.join(index, ["chunk_size", "ngram"]).groupBy("query", "hash").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least_overlap)
    scored = hits.withColumn("score", edit_score(parse_hash(F.col("query")), parse_hash(F.col("hash"))))
    return scored.where(F.col("score") >= least_score)


def discovered(pairs: DataFrame, long: DataFrame) -> DataFrame:
    """What is known of similar hashes: how often, and on which dates, each occurs in the documents."""
    seen = long.groupBy(F.col("value").alias("hash")).agg(F.count("*").alias("count"), F.min("date").alias("first"), F.max("date").alias("last"))
    return pairs.join(seen, "hash")


# Keywords after the published YAKE features: lower scores are better.


def keywords(df: DataFrame, key: str, text: str, most: int = 20, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, keyword, score, rank): words that are frequent, early, spread over sentences and not tied to many neighbours."""
    sentences = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?\n]+"), lambda s: F.trim(s) != "")
    rows = df.select(F.col(key).alias("key"), F.posexplode(sentences).alias("s", "sentence")).withColumn("ws", words(F.col("sentence")))
    placed = rows.select("key", "s", "ws", F.posexplode("ws").alias("i", "word")).withColumn("before", F.when(F.col("i") > 0, F.element_at("ws", F.col("i")))).withColumn("after", F.when(F.col("i") + 1 < F.size("ws"), F.element_at("ws", F.col("i") + 2)))
    stats = placed.groupBy("key", "word").agg(
        F.count("*").alias("tf"), F.percentile_approx("s", 0.5).alias("middle"), F.count_distinct("s").alias("spread"), F.count_distinct("before").alias("nb"), F.count_distinct("after").alias("na")
    )
    whole = placed.groupBy("key").agg((F.max("s") + 1).alias("n"))
    means = stats.groupBy("key").agg(F.avg("tf").alias("mean"), F.stddev_pop("tf").alias("sd"), F.max("tf").alias("top"))
    all_ = stats.join(whole, "key").join(means, "key").where((F.length("word") > 2) & ~F.col("word").isin(*stop, ""))
    position, frequency = F.log(F.log(F.lit(3.0) + F.col("middle")) + 1), F.col("tf") / (F.col("mean") + F.col("sd"))
    relation = 1 + (F.col("nb") / F.col("tf") + F.col("na") / F.col("tf")) * F.col("tf") / F.col("top")
    score = relation * position / (F.lit(1.0) + frequency / relation + (F.col("spread") / F.col("n")) / relation)
    ranked = all_.select("key", F.col("word").alias("keyword"), F.round(score / F.col("tf"), 9).alias("score"))
    order = Window.partitionBy("key").orderBy("score", "keyword")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def tag_cloud(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Keywords of many documents together: how many hold each, and the best score."""
    return found.groupBy(*(by or []), "keyword").agg(F.count_distinct("key").alias("frequency"), F.min("score").alias("score"))
