"""Normal forms of field types, as column expressions and, for query terms, of literals."""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Letters of one code point that decompose to an unmarked one, and those, by the Unicode rule."""
    marked = [c for c in map(chr, range(0xC0, 0x2000)) if len(unicodedata.normalize("NFD", c)) > 1 and not unicodedata.combining(unicodedata.normalize("NFD", c)[0])]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def fold(c: Column) -> Column:
    """Lower case without diacritics: the default of text. Values of plain ASCII, nearly all, only change case."""
    marked, plain = _plain_letters()
    whole = F.lower(F.regexp_replace(F.translate(c, marked, plain), r"\p{M}", ""))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(whole)


def fold_text(s: str) -> str:
    kept = (c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", "".join(kept)).lower()


def number(c: Column) -> Column:
    return c.try_cast("double")


#: Date layouts that data and queries use (fixed values of the format), each with Spark's pattern.
DATE_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ssX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd'T'HH",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyyMMddHHmmss",
    "yyyyMMddHHmm",
    "yyyyMMddHH",
    "yyyyMMdd HHmmss",
    "yyyyMMdd",
    "yyyy-MM",
    "yyyy",
)


def date(c: Column, layout: str | None = None) -> Column:
    """The text as a time: by ``layout``, or by the first of the usual ones that reads it."""
    text = c.cast("string")
    if layout:
        return F.try_to_timestamp(text, F.lit(layout))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in DATE_LAYOUTS[:3]), c.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(p)) for p in DATE_LAYOUTS[3:]))


def is_time(data: T.DataType) -> bool:
    return isinstance(data, (T.TimestampType, T.DateType, T.TimestampNTZType))


def date_of(c: Column, data: T.DataType, layout: str | None = None) -> Column:
    """A date field's value: a column that is a time already stays as it is, so that scans can use it."""
    return c if is_time(data) else date(c, layout)


_UNITS = ((r"\d{4}", "%Y", "year"), (r"\d{4}-\d\d", "%Y-%m", "month"), (r"\d{4}-\d\d-\d\d", "%Y-%m-%d", "day"), (r"\d{8}", "%Y%m%d", "day"), (r"\d{10}", "%Y%m%d%H", "hour"), (r"\d{12}", "%Y%m%d%H%M", "minute"), (r"\d{14}", "%Y%m%d%H%M%S", "second"), (r"\d{8} \d{6}", "%Y%m%d %H%M%S", "second"), (r"\d{4}-\d\d-\d\d[T ]\d\d", "%Y-%m-%d %H", "hour"), (r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d", "%Y-%m-%d %H:%M", "minute"), (r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d", "%Y-%m-%d %H:%M:%S", "second"))


def literal_date(text: str) -> tuple[dt.datetime, str] | None:
    """(time, the unit it names) of a date in a query; None if no layout reads it. Times with a zone become UTC."""
    text = str(text).strip()
    for pattern, layout, unit in _UNITS:
        if re.fullmatch(pattern, text):
            try:
                return dt.datetime.strptime(text.replace("T", " "), layout), unit
            except ValueError:
                return None
    try:
        found = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return (found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found), "millisecond"


def unit_end(start: dt.datetime, unit: str) -> dt.datetime:
    """The last millisecond of the unit that begins at ``start``."""
    if unit == "year":
        nxt = start.replace(year=start.year + 1)
    elif unit == "month":
        nxt = start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
    else:
        nxt = start + {"day": dt.timedelta(days=1), "hour": dt.timedelta(hours=1), "minute": dt.timedelta(minutes=1), "second": dt.timedelta(seconds=1), "millisecond": dt.timedelta(milliseconds=1)}[unit]
    return nxt - dt.timedelta(milliseconds=1)


def time_literal(when: dt.datetime, data: T.DataType | None = None) -> Column:
    """A literal of the column's own type, as scans compare only like with like."""
    text = when.isoformat(sep=" ")
    if isinstance(data, T.DateType) and when.time() == dt.time():
        return F.lit(when.date())
    return F.expr(f"TIMESTAMP_NTZ '{text}'") if isinstance(data, T.TimestampNTZType) else F.to_timestamp(F.lit(text)) if data is None else F.expr(f"TIMESTAMP '{text}'")


def ipv4(c: Column) -> Column:
    """The address as a number; null if it is none."""
    parts = F.split(c, r"\.")
    ok = c.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & ~F.exists(parts, lambda p: p.try_cast("int") > 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p.try_cast("bigint")))


def ipv4_padded(c: Column) -> Column:
    """The address with every part of three digits, which sorts as the number does."""
    parts = F.split(c, r"\.")
    return F.when(ipv4(c).isNotNull(), F.array_join(F.transform(parts, lambda p: F.lpad(p.cast("int").cast("string"), 3, "0")), "."))


def ipv6(c: Column) -> Column:
    """All eight groups of four hexadecimal digits, in lower case; null if it is no address without a zone or an IPv4 tail."""
    low = F.lower(c)
    left, right = F.split_part(low, F.lit("::"), F.lit(1)), F.split_part(low, F.lit("::"), F.lit(2))
    some = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    gap = F.lit(8) - F.size(some(left)) - F.size(some(right))
    groups = F.when(low.contains("::"), F.when(gap > 0, F.concat(some(left), F.array_repeat(F.lit("0"), gap), some(right)))).otherwise(some(low))
    ok = low.rlike(r"^[0-9a-f:]+$") & ~low.contains(":::") & (F.size(groups) == 8) & F.forall(groups, lambda g: F.length(g) <= 4)
    return F.when(ok, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":"))


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last number of an IPv4 block, also written with asterisks for whole parts."""
    if "*" in cidr:
        parts = [p for p in cidr.split(".") if p != "*"]
        cidr = ".".join([*parts, *["0"] * (4 - len(parts))]) + f"/{8 * len(parts)}"
    block = ipaddress.ip_network(cidr, strict=False)
    return int(block.network_address), int(block.broadcast_address)


def in_cidr(c: Column, cidr: str) -> Column:
    low, high = cidr_range(cidr)
    return F.coalesce(ipv4(c).between(low, high), F.lit(False))


def mac(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"[:\-.]", ""))
    return F.when(bare.rlike("^[0-9a-f]{12}$"), F.regexp_replace(F.regexp_replace(bare, "(..)", "$1:"), ":$", ""))


def hex_text(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, "^0[xX]", ""))
    return F.when(bare.rlike("^[0-9a-f]+$"), F.when(F.length(bare) % 2 == 1, F.concat(F.lit("0"), bare)).otherwise(bare))


def network(c: Column) -> Column:
    return F.coalesce(ipv4(c).cast("string"), ipv6(c), mac(c), fold(c))


def trim_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def text_list(c: Column) -> Column:
    return F.transform(F.split(c, "[,;]"), lambda x: fold(F.trim(x)))


def number_list(c: Column) -> Column:
    return F.transform(F.split(c, "[,;]"), lambda x: number(F.trim(x)))


def hit_count(c: Column) -> Column:
    """A whole number; null otherwise."""
    return c.try_cast("bigint")


def boolean(c: Column) -> Column:
    """``true`` or ``false`` of the usual spellings; null otherwise."""
    low = F.lower(c.cast("string"))
    return F.when(low.isin("true", "t", "yes", "y", "1"), "true").when(low.isin("false", "f", "no", "n", "0"), "false")


def latitude(c: Column) -> Column:
    """Degrees as a number within -90 and 90; null otherwise."""
    v = c.try_cast("double")
    return F.when(v.between(-90, 90), v)


def longitude(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(v.between(-180, 180), v)


#: The normal form of each type name a model may give a field.
NORMAL = {
    "text": fold,
    "lower": F.lower,
    "raw": lambda c: c,
    "number": number,
    "date": date,
    "ip": ipv4,
    "ipv6": ipv6,
    "mac": mac,
    "hex": hex_text,
    "network": network,
    "digits": trim_zeros,
    "boolean": boolean,
    "hits": hit_count,
    "latitude": latitude,
    "longitude": longitude,
}


def encode_number(c: Column) -> Column:
    """A number as text that sorts as the number does: sign, exponent, mantissa.

    Positive numbers are ``+`` with the exponent's letter (a is 0) and the mantissa; for negative ones exponent and
    mantissa run the other way, behind ``!``. Zero is ``+AE0``. Null and what is no number give null.
    """
    v = c.try_cast("decimal(38,18)")
    size = F.abs(v)
    power = F.floor(F.log10(size.cast("double"))).cast("int")
    # The logarithm of a number just under a power of ten may round up to it.
    power = F.when(F.pow(F.lit(10.0), power) > size.cast("double"), power - 1).otherwise(power)
    mantissa = size.cast("double") / F.pow(F.lit(10.0), power)
    # Bytes from A (25 below) over a (0) to z (25 above).
    letter = lambda p: F.when(p >= 0, F.char(F.lit(97) + p)).otherwise(F.char(F.lit(65) + 26 + p))
    tail = lambda m: F.regexp_replace(F.regexp_replace(F.format_string("%.15f", m), "0+$", ""), r"\.$", "")
    flipped = F.lit(10.0) - mantissa
    turned = F.when(power >= 0, F.char(F.lit(90) - power)).otherwise(F.char(F.lit(97) + 25 + 1 + power - 26 - 2 * power))
    return F.when(v == 0, "+AE0").when(v > 0, F.concat(F.lit("+"), letter(power), F.lit("E"), tail(mantissa))).when(v < 0, F.concat(F.lit("!"), turned, F.lit("E"), tail(flipped)))


def granule(c: Column, unit: str) -> Column:
    """A time cut to a granularity."""
    text = {"ALL": None, "YEAR": "yyyy", "MONTH": "yyyy-MM", "DAY": "yyyy-MM-dd", "HOUR": "yyyy-MM-dd'T'HH", "MINUTE": "yyyy-MM-dd'T'HH:mm", "SECOND": "yyyy-MM-dd'T'HH:mm:ss", "MILLISECOND": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    if unit == "TENTH_OF_HOUR":
        return F.substring(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), 1, 15)
    layout = text[unit]
    return c.cast("string") if layout is None else F.date_format(c, layout)
