"""Byte-level BPE by overlapping chunks.

Every text is cut into chunks of ``chunk_chars`` that overlap their successors, and each chunk is pre-tokenised from
its own start. The splitting pattern never looks behind, so once two neighbouring scans both have a boundary at a
position they agree from there on: that position is the cut. Only cuts after a visible character that is
not white space count, as the pattern's one lookahead concerns runs of white space at the end of what it sees.
Where an overlap has no common boundary (one run of letters longer than that), it is widened: the earlier
scan goes on from its last boundary over one more chunk, then two, four and so on, until it meets one of the chunk
that follows. The pieces between cuts are encoded apart, and decoding concatenates the bytes of the ids.

The chunks of a text up to ``spread_chars`` stay with the task that read it, which has thousands of others to keep the
rest of the cluster busy. Those of a longer text are dealt to tasks of their own, in runs of ``spread_chars`` that overlap
and are stitched by the same rule.
"""

from __future__ import annotations

import base64
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenspan.llm.common import by_slices, in_small_batches, per_slice, stored, table, text_or_empty

CHUNK_CHARS = 1 << 10
OVERLAP_CHARS = 1 << 7
SPREAD_CHARS = 1 << 16


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The rank file as a tiktoken encoding without special tokens; one for each Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(pattern: str, text: str) -> list[int]:
    """Ends of the pattern's matches that hold whatever follows ``text``."""
    ends = (m.end() for m in splitter(pattern).finditer(text))
    return [e for e in ends if e < len(text) and not text[e - 1].isspace()]


def chunk_spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each chunk; neighbours share ``overlap`` characters."""
    starts = range(0, max(length - overlap, 1), chunk)
    return [(s, min(s + chunk + overlap, length)) for s in starts]


def stitch(text: str, spans: list[tuple[int, int]], heads: list[list[int]], tails: list[list[int]], pattern: str) -> list[int]:
    """Cuts of one text: 0, one for each neighbour whose scan meets the one before it, its length.

    ``heads`` has the boundaries of each chunk's scan inside the overlap with its predecessor, ``tails`` those
    inside the overlap with its successor, as places in the text.
    """
    cuts, lasts, k = [0], tails[0], 1
    while k < len(spans):
        common = [c for c in set(heads[k]).intersection(lasts) if c > cuts[-1]]
        if common:
            cuts.append(min(common))
            lasts, k = tails[k], k + 1
            continue
        # No boundary in common: the scan goes on over the chunks that follow.
        at, more = max([cuts[-1], *lasts]), 1
        while True:
            k, (_, end) = k + more, spans[min(k + more, len(spans)) - 1]
            found = [at + e for e in boundaries(pattern, text[at:end])]
            if k >= len(spans):
                break
            lasts = [e for e in found if e >= spans[k][0]]
            if set(heads[k]).intersection(lasts):
                break
            at, more = found[-1] if found else at, 2 * more
    return [*cuts, spans[-1][1]]


def scanned(text: str, chunk: int, overlap: int, pattern: str) -> list[int]:
    """Cuts of a text whose chunks are all pre-tokenised here."""
    spans = chunk_spans(len(text), chunk, overlap)
    if len(spans) == 1:
        return [0, len(text)]
    ends = [[s + e for e in boundaries(pattern, text[s:e])] for s, e in spans]
    heads = [[e for e in b if e <= s + overlap] for (s, _), b in zip(spans, ends, strict=True)]
    tails = [[e for e in b if e >= s + chunk] for (s, _), b in zip(spans, ends, strict=True)]
    return stitch(text, spans, heads, tails, pattern)


def encoded_text(text: str, ranks_path: str, pattern: str, chunk: int, overlap: int) -> list[int]:
    """Ids of one text, piece by piece."""
    enc, cuts = encoding(ranks_path, pattern), scanned(text, chunk, overlap, pattern)
    out: list[int] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out += enc.encode_ordinary(text[a:b])
    return out


def _encode_slice(part: pa.RecordBatch, keys: int, ranks_path: str, pattern: str, chunk: int, overlap: int) -> pa.RecordBatch:
    enc = encoding(ranks_path, pattern)
    ids = [np.array(encoded_text(t, ranks_path, pattern, chunk, overlap), dtype=np.int32) for t in part.column(keys).to_pylist()]
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    raw = [enc.decode_bytes(i.tolist()) for i in ids]
    columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays([*part.columns[:keys], *columns], [*part.schema.names[:keys], "ids", "decoded"])


def _chunks(batches, chunk: int, overlap: int):
    for part in by_slices(batches, 4):
        for digest, text in zip(part["digest"].to_pylist(), part["text"].to_pylist(), strict=True):
            spans = chunk_spans(len(text), chunk, overlap)
            for start in range(0, len(spans), 16):
                some = list(enumerate(spans))[start : start + 16]
                yield pa.RecordBatch.from_pydict(
                    {"digest": [digest] * len(some), "chunk": [k for k, _ in some], "n": [len(spans)] * len(some), "start": [s for _, (s, _) in some], "part": [text[s:e] for _, (s, e) in some]},
                    pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("n", pa.int32()), ("start", pa.int64()), ("part", pa.string())]),
                )


def _pre_tokenised(part: pa.RecordBatch, chunk: int, overlap: int, pattern: str) -> pa.RecordBatch:
    heads, tails = [], []
    for start, text in zip(part["start"].to_pylist(), part["part"].to_pylist(), strict=True):
        ends = boundaries(pattern, text)
        heads.append([start + e for e in ends if e <= overlap])
        tails.append([start + e for e in ends if e >= chunk])
    kind = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([part["digest"], part["chunk"], pa.array(heads, kind), pa.array(tails, kind)], ["digest", "chunk", "heads", "tails"])


def _pieces(batches, chunk: int, overlap: int, pattern: str):
    schema = pa.schema([("digest", pa.binary()), ("piece", pa.int32()), ("text", pa.string())])
    for part in by_slices(batches, 4):
        for digest, text, zones in zip(part["digest"].to_pylist(), part["text"].to_pylist(), part["zones"].to_pylist(), strict=True):
            zones = sorted(zones, key=lambda z: z["chunk"])
            cuts = stitch(text, chunk_spans(len(text), chunk, overlap), [z["heads"] for z in zones], [z["tails"] for z in zones], pattern)
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                yield pa.RecordBatch.from_pydict({"digest": [digest], "piece": [k], "text": [text[s:e]]}, schema)


def _assembled(batches):
    for part in by_slices(batches, 4):
        ids, raw = [], []
        for pieces in part["pieces"]:
            found = [(p["piece"].as_py(), p["ids"].values.to_numpy(), p["decoded"].as_py()) for p in pieces]
            found.sort(key=lambda p: p[0])
            ids.append(np.concatenate([p[1] for p in found]))
            raw.append(b"".join(p[2] for p in found))
        yield pa.RecordBatch.from_arrays([part["digest"], pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())], ["digest", "ids", "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``ids`` array<int>, and ``decoded``, the bytes those ids stand for.

    A null text counts as empty and has no ids. Ids that are null or repeat are kept row by row; the
    same text always has the same ids. Other columns of ``docs`` are neither read nor returned, whatever their names.
    An empty table gives an empty result. A very long text is read whole, its chunks are dealt to many tasks, and
    texts over ``spread_chars`` characters are encoded once for each distinct text.
    """
    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    is_long = F.char_length("text") > F.lit(spread_chars)
    id_type = rows.schema["id"].dataType.simpleString()
    encoder = partial(_encode_slice, ranks_path=ranks_path, pattern=pattern, chunk=chunk_chars, overlap=overlap_chars)
    run, wide = spread_chars, min(8 * overlap_chars, spread_chars)

    short = rows.where(~is_long).mapInArrow(per_slice(partial(encoder, keys=1), 256), f"id {id_type}, ids array<int>, decoded binary")
    long_rows = rows.where(is_long).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = stored(long_rows.dropDuplicates(["digest"]).select("digest", "text"), "bpe-long")
    zones = (
        texts.mapInArrow(partial(_chunks, chunk=run, overlap=wide), "digest binary, chunk int, n int, start bigint, part string")
        .repartition("digest", "chunk")
        .mapInArrow(per_slice(partial(_pre_tokenised, chunk=run, overlap=wide, pattern=pattern), 16), "digest binary, chunk int, heads array<bigint>, tails array<bigint>")
        .groupBy("digest")
        .agg(F.collect_list(F.struct("chunk", "heads", "tails")).alias("zones"))
    )
    pieces = texts.join(zones, "digest").select("digest", "text", "zones").mapInArrow(partial(_pieces, chunk=run, overlap=wide, pattern=pattern), "digest binary, piece int, text string")
    whole = (
        pieces.repartition("digest", "piece")
        .mapInArrow(per_slice(partial(encoder, keys=2), 16), "digest binary, piece int, ids array<int>, decoded binary")
        .groupBy("digest")
        .agg(F.collect_list(F.struct("piece", "ids", "decoded")).alias("pieces"))
        .mapInArrow(_assembled, "digest binary, ids array<int>, decoded binary")
    )
    out = short.unionByName(long_rows.select("id", "digest").join(whole, "digest").select("id", "ids", "decoded"))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``decoded``: the concatenated bytes of each id; null ids give null, unknown ids an error."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path, pattern)
        raw = [None if x is None else enc.decode_bytes(x) for x in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(per_slice(run, 256), f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's ids and bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLES: dict[str, str] = {}
