"""Token counts through a digest cache.

A stored count belongs to a content digest and a tokenizer version (a digest of the tokenizer's file).
Contents without one are encoded once each, however many rows repeat them, and appended to the cache.
Which row encodes a content is settled on (digest, id) alone, so the texts move once, by a key that has
no hot values; counts come back to the rows by a join that adaptive execution may split.

The stored normal form of a content is the text itself with null as empty: any other folding (case,
white space, Unicode form) would change what these tokenizers count.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenspan.llm.common import by_slices, in_small_batches, new_path, table, text_or_empty

#: How the byte-level pre-tokenizer splits text (fixed value of that format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 1024
#: Rows by which a task knows repeated ones again before they travel.
REMEMBERED = 100_000


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """The ranks of a plain byte-level BPE file; None if anything in it asks for more than ranks."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    added = spec.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        return None
    alphabet = _byte_alphabet()
    raw = lambda token: bytes(alphabet[c] for c in token)
    special = {t["content"] for t in added}
    ranks = {raw(token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = 256
    in_order = all(model["vocab"].get(a + b) == first + n for n, (a, b) in enumerate(merges))
    return ranks if in_order and len(ranks) == first + len(merges) and all(bytes([b]) in ranks for b in range(256)) else None


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a list of texts to their token counts, as the file's own library counts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = byte_level_ranks(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        return lambda texts: [len(x) for x in whole.encode_batch(texts, add_special_tokens=False)]
    import regex
    import tiktoken

    enc = tiktoken.Encoding("counts", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    contents = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
    specials = regex.compile("|".join(map(regex.escape, contents))) if contents else None

    def count(text: str) -> int:
        if specials is None or not (found := specials.findall(text)):
            return len(enc.encode_ordinary(text))
        return len(found) + sum(len(enc.encode_ordinary(p)) for p in specials.split(text) if p)

    return lambda texts: [count(t) for t in texts]


def _once(batches):
    """Rows without those whose id and content came before in the same task, as far back as ``REMEMBERED`` rows."""
    seen: set = set()
    for part in by_slices(batches, 512):
        keys = list(zip(part["id"].to_pylist(), part["digest"].to_pylist(), strict=True))
        new = []
        for key in keys:
            new.append(key not in seen)
            seen.add(key)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield part if all(new) else part.filter(pa.array(new))


def _counted(batches, path: str):
    """Each content's count; rows of one content come one after another, and are encoded once."""
    last = None
    for part in by_slices(batches, 512):
        digests = part["digest"].to_pylist()
        new = [d != p for d, p in zip(digests, [last, *digests], strict=False)]
        last = digests[-1]
        some = part if all(new) else part.filter(pa.array(new))
        n = counter(path)(some["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([some["digest"], pa.array(np.asarray(n, dtype=np.int64))], ["digest", "n_tokens"])


def repeats(keys: DataFrame) -> bool:
    """Whether any id and content come twice."""
    return bool(keys.groupBy("id", "digest").count().where("count > 1").head(1))


CACHE_SCHEMA = "digest binary, n_tokens bigint, version string"


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: the id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    ``cache_path`` is a Parquet folder that every executor can read; counts of contents it lacks are
    appended to it, so a later call encodes new contents only. None starts from an empty one. A null text
    counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat, also with the same text; every row is returned, and
    each content is encoded once. Other columns are not read, whatever their names. An empty table gives an empty
    result. A very long text is encoded whole.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or new_path(spark, "token-counts")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = rows.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))

    # An empty append creates the folder, and with it the schema, on the first call.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(f"{cache_path}")
    known = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens")
    # One row stands for each content that has no count yet. A null id is its own smallest value.
    missing = keys.groupBy("digest").agg(F.min(F.struct("id")).alias("first")).join(known(), "digest", "left_anti").select("digest", F.col("first.id").alias("id"))
    at = [F.col("t.digest") == F.col("m.digest"), F.col("t.id").eqNullSafe(F.col("m.id"))]
    distinct = rows.mapInArrow(_once, rows.schema) if repeats(keys) else rows
    misses = distinct.alias("t").join(missing.alias("m"), at, "left_semi").select("digest", "text").sortWithinPartitions("digest")
    counted = misses.mapInArrow(partial(_counted, path=tokenizer_path), "digest binary, n_tokens bigint").dropDuplicates(["digest"])
    counted.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache_path)

    out = keys.join(known(), "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
