"""Ogg media columns: write payloads as multiplexed logical streams, and read them back.

Payload bytes are 8-bit samples. Packets of ``PACKET`` samples are dealt in turn to the logical streams
of a file; each stream opens with a header packet that names its rate, place and count. Reading checks
every page's checksum, joins packets from lacing values over page ends, parts the streams by serial
number and takes times from granule positions (samples of the stream complete at the page's end).
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenspan.llm.common import in_small_batches, per_slice, table, text_or_empty

# Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
PAGE = struct.Struct("<4sBBqIIIB")
MAX_SEGMENTS = 255

HEAD = struct.Struct("<8sIBBQ")
MAGIC = b"\x01samples"
RATE, STREAMS, PACKET, SEGMENTS = 8000, 2, 6000, 20
ALIGN = 64

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0, as the mirror image of zlib's."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "big").translate(_MIRROR), "little")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_checksum(head + body)) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = SEGMENTS) -> list[bytes]:
    """Pages of one logical stream; each packet comes with the granule position at its end.

    The first packet has a page of its own, as its header.
    """
    out: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def flush(goes_on: bool, last: bool = False) -> None:
        nonlocal lacing, body, granule, continued
        kind = CONTINUED * continued | FIRST * (not out) | LAST * last
        out.append(page(kind, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), -1, goes_on

    for k, (data, end) in enumerate(packets):
        whole = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for n, size in enumerate(whole):
            if len(lacing) == segments:
                flush(goes_on=n > 0)
            lacing.append(size)
            body += data[at : at + size]
            at += size
        granule = end
        if k == 0 and len(packets) > 1:
            flush(goes_on=False)
    flush(goes_on=False, last=True)
    return out


def write_ogg(payload: bytes, streams: int = STREAMS, packet: int = PACKET, rate: int = RATE) -> bytes:
    """One physical stream: all header pages first, then the pages of the streams in turn."""
    dealt: list[list[bytes]] = [[] for _ in range(streams)]
    for k, at in enumerate(range(0, len(payload), packet)):
        dealt[k % streams].append(payload[at : at + packet])
    runs = []
    for k, parts in enumerate(dealt):
        packets, done = [(HEAD.pack(MAGIC, rate, k, streams, sum(map(len, parts))), 0)], 0
        for part in parts:
            done += len(part)
            packets.append((part, done))
        runs.append(stream_pages(k + 1, packets))
    return b"".join(run[n] for n in range(max(map(len, runs))) for run in runs if n < len(run))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    granule: int = 0
    partial: bytes | None = None
    ended: bool = False


class OggError(ValueError):
    pass


def read_ogg(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; OggError for a bad checksum, a lost page or a cut file."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < PAGE.size or data[at : at + 4] != CAPTURE:
            raise OggError(f"no page at byte {at}")
        _, version, kind, granule, serial, number, checksum, n = PAGE.unpack_from(data, at)
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"page at byte {at} is cut short")
        if page_checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != checksum:
            raise OggError(f"checksum of the page at byte {at}")
        stream = streams.setdefault(serial, Stream())
        if number != stream.pages or bool(kind & FIRST) != (number == 0) or bool(kind & CONTINUED) != (stream.partial is not None) or stream.ended:
            raise OggError(f"page {number} of stream {serial} is out of order")
        body = at + PAGE.size + n
        parts = [stream.partial] if stream.partial is not None else []
        stream.partial = None
        completed = 0
        for size in lacing:
            parts.append(data[body : body + size])
            body += size
            if size < 255:
                stream.packets.append(b"".join(parts))
                parts, completed = [], completed + 1
        if parts:
            stream.partial = b"".join(parts)
        if completed:
            stream.granule = granule
            stream.times.append((len(stream.packets), granule))
        stream.pages += 1
        stream.ended = bool(kind & LAST)
        at = end
    if any(not s.ended or s.partial is not None for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def timestamps(streams: dict[int, Stream]) -> list[tuple[int, int, int]]:
    """(serial, packets complete, milliseconds) at the end of each page that completes a packet, header pages left out.

    A page's granule position is the number of the stream's samples up to there; over the header's rate it is a time.
    """
    out = []
    for serial, stream in sorted(streams.items()):
        rate = HEAD.unpack(stream.packets[0])[1]
        out += [(serial, done - 1, granule * 1000 // rate) for done, granule in stream.times if done > 1]
    return out


def unpack(data: bytes) -> tuple[bytes, dict]:
    """The payload and what the container says of it: pages, packets, streams, duration and page times in milliseconds."""
    streams = read_ogg(data)
    parts, rate = {}, 1
    for stream in streams.values():
        magic, rate, k, count, samples = HEAD.unpack(stream.packets[0])
        if magic != MAGIC or count != len(streams) or sum(map(len, stream.packets[1:])) != samples or stream.granule != samples:
            raise OggError("a header disagrees with its stream")
        if any(a[1] > b[1] for a, b in zip(stream.times[:-1], stream.times[1:], strict=True)):
            raise OggError("granule positions fall")
        parts[k] = stream.packets[1:]
    n = sum(map(len, parts.values()))
    payload = b"".join(parts[k % len(parts)][k // len(parts)] for k in range(n))
    length = max(s.granule for s in streams.values())
    facts = {"pages": sum(s.pages for s in streams.values()), "packets": n, "streams": len(streams), "samples": sum(s.granule for s in streams.values()), "duration_ms": length * 1000 // rate, "timed_pages": sum(len(s.times) for s in streams.values()), "times": timestamps(streams)}
    return payload, facts


def _write(part: pa.RecordBatch) -> pa.RecordBatch:
    media = [write_ogg(t + bytes(ALIGN - len(t) % ALIGN if len(t) % ALIGN or not t else 0)) for t in part["raw"].to_pylist()]
    return pa.RecordBatch.from_arrays([part["id"], part["n_bytes"], pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


FACTS = ("pages", "packets", "streams", "samples", "duration_ms", "timed_pages")
TIMES = "array<struct<stream:bigint,packets:bigint,ms:bigint>>"
_TIME = pa.list_(pa.struct([("stream", pa.int64()), ("packets", pa.int64()), ("ms", pa.int64())]))


def _read(part: pa.RecordBatch) -> pa.RecordBatch:
    payloads, times, facts = [], [], {k: [] for k in FACTS}
    for data in part["media"].to_pylist():
        payload, found = unpack(data) if data is not None else (None, {})
        payloads.append(payload)
        times.append([dict(zip(("stream", "packets", "ms"), t, strict=True)) for t in found["times"]] if found else None)
        for k in FACTS:
            facts[k].append(found.get(k))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), *(pa.array(facts[k], pa.int64()) for k in FACTS), pa.array(times, _TIME)], [*part.schema.names, "payload", *FACTS, "times"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and ``media``, an Ogg file whose samples are the text's bytes, padded with zeros.

    A null text counts as empty; its payload is 64 zeros. Every row is kept, with null or repeated ids;
    equal texts have equal media. Other columns are not read, whatever their names. An empty table gives an empty
    result. A very long text is one file of many pages.
    """
    in_small_batches(docs.sparkSession)
    raw = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(raw).cast("bigint").alias("n_bytes"), raw.alias("raw"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_slice(_write, 256), f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds ``payload``, the container's facts and ``times``, when each page of each stream ends.

    A null file gives nulls, a damaged one an error. Columns of ``media`` with one of these names give way.
    """
    keep = [c for c in media.columns if c != media_col and c not in ("payload", "times", *FACTS)]
    rows = media.select(*keep, F.col(media_col).alias("media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", payload binary, " + ", ".join(f"{k} bigint" for k in FACTS) + f", times {TIMES}"
    return rows.mapInArrow(per_slice(_read, 256), schema)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(to_media(table(spark, sf_dir, "documents")))
    ends = F.array_join(F.transform("times", lambda t: F.concat_ws("/", t["stream"].cast("string"), t["packets"].cast("string"), t["ms"].cast("string"))), ",")
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.col(k)) for k in FACTS), F.concat(F.lit("times="), F.sha2(ends, 256)))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{ALIGN}, {ALIGN})")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


QUERIES = {"op6_ogg_media": op6_ogg_media}
ORACLES: dict[str, str] = {}
