"""Exact Jaccard join of shingle sets by PartEnum signatures.

Set sizes fall into bands within which sizes may be similar; a set of band j takes part in the instances
j (as smaller or equal partner) and j - 1 (as larger one). The instance's sizes bound how many shingles two
similar sets differ in. The shingles' hash range is cut into ``n1`` parts of ``n2`` subparts: with at most
k differences some part has at most k2 of them, so some choice of ``n2 - k2`` of its subparts is the same in both
sets, and each such choice's contents is a signature. An empty choice is no signature: a set with so few
empty ones that a filled one must be shared leaves them out (nearly all do); the others add the empty ones.
As parts outnumber the differences, similar sets share at least some number t of signatures. In one
order of all signatures, each set may then leave out its t - 1 last (prefix filter): last come those that most
sets have, as counted over all sets, such as of a passage many texts quote. Two larger partners of one instance
needn't meet there, as they do in their own band's.

Signatures travel as packed columns, bucketed by their first bits. Sets that share one are candidates; a
bit vector of parities bounds their difference from below, and the rest are compared in full. Verification goes in
rounds, with components after each: every set with the partner it shares most signatures with; then the likeliest
links that would join a signature group's components, a spanning forest in each block and next in each pair of
blocks; last, for whatever is still in different components, all partners. So links inside an established
group needn't all be made, and none between different groups is missed. Groups of a few sets go straight to the last round.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackenspan.llm.common import by_slices, in_small_batches, released, stored, table, text_or_empty
from brackenspan.llm.components import components

SHINGLE = 5
PERCENT = 75
N2, K2 = 2, 1
SLACK = 0.25
SKETCH = 512
MOST_PARTS = 2048
BUCKET_SIGNATURES = 250_000
LEAST_BUCKETS = 256
BLOCK = 512
FOREST_FROM = 8
BROADCAST_CLASSES = 200_000
#: What a task of the signatures holds before it passes them on, and how many of its sets it knows again.
HELD_SIGNATURES = 1_000_000
SEEN_CLASSES = 200_000

_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; fewer words than ``width`` make one; no words, none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    n = min(width, len(one))
    total = np.full(len(one) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mixed(total * _M[k % 5] + one[k : len(one) - n + 1 + k])
    return np.unique(total)


@lru_cache(maxsize=1)
def bands(percent: int, upto: int = 1 << 40) -> list[int]:
    """First size of each band: sizes l to l * 100 // percent are one band."""
    out = [1]
    while out[-1] < upto:
        out.append(out[-1] * 100 // percent + 1)
    return out


def most_apart(a: int, b: int, percent: int) -> int:
    """Most differences of two similar sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def instance(j: int, percent: int, k2: int) -> tuple[int, int]:
    """(k, n1) of band j and the next."""
    high = bands(percent)[j + 1] - 1
    k = most_apart(high, high * 100 // percent, percent)
    full = k // (k2 + 1)
    return k, full + 1 + int(np.ceil(SLACK * full))


def _dealt(sets: list[np.ndarray], role: int, percent: int, n2: int, k2: int):
    """The sets' shingles dealt to the cells of their instances in this role; None without any.

    Of each set: its index, instance, number of parts and the number of its filled signatures that a
    similar partner must share (under 1: no bound). Of all cells in a row: content and whether filled.
    """
    starts = np.array(bands(percent))
    jobs = []
    for i, s in enumerate(sets):
        if len(s):
            j = int(np.searchsorted(starts, len(s), side="right")) - 1 - role
            if j >= 0:
                jobs.append((i, j, *instance(j, percent, k2)))
    if not jobs:
        return None
    index, inst, _, n1 = (np.array(c, dtype=np.int64) for c in zip(*jobs, strict=True))
    size = np.array([len(sets[i]) for i in index])
    base = np.concatenate([[0], np.cumsum(n1 * n2)])
    flat = np.concatenate([sets[i] for i in index])
    job = np.repeat(np.arange(len(index)), size)
    cell = ((flat >> np.uint64(32)) * (n1 * n2).astype(np.uint64)[job] >> np.uint64(32)).astype(np.int64) + base[job]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    total, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
    total[cell[first]] = np.add.reduceat(mixed(flat + _M[1]), first)
    filled[cell[first]] = True
    total, filled = total.reshape(-1, n2), filled.reshape(-1, n2)
    some = np.stack([filled[:, list(c)].any(axis=1) for c in combinations(range(n2), n2 - k2)], axis=1)
    # Differences this set may have with a partner of this instance, from its own size.
    high = np.array([bands(percent)[j + 1] - 1 for j in inst])
    partner = np.minimum(size * 100 // percent, high * 100 // percent) if role == 0 else np.minimum(size, high)
    own_k = (size + partner) * (100 - percent) // (100 + percent)
    part_base = base[:-1] // n2
    at_least = np.add.reduceat(some.sum(axis=1), part_base) - own_k * comb(n2 - 1, n2 - k2 - 1)
    sure = (np.add.reduceat(some.all(axis=1).astype(np.int64), part_base) > own_k // (k2 + 1)) | (at_least >= 1)
    return index, inst, n1, at_least, sure, part_base, total, some


def least_shared(sets: list[np.ndarray], percent: int = PERCENT, n2: int = N2, k2: int = K2) -> np.ndarray:
    """For each set and role, how many signatures a similar partner must share; at least 1."""
    out = np.ones((len(sets), 2), np.int64)
    for role in (0, 1):
        dealt = _dealt(sets, role, percent, n2, k2)
        if dealt is not None:
            out[dealt[0], role] = np.maximum(dealt[3], 1)
    return out


def signatures(sets: list[np.ndarray], percent: int = PERCENT, n2: int = N2, k2: int = K2) -> tuple[np.ndarray, np.ndarray]:
    """(signature, twice the index of its set plus its role) of all sets' signatures."""
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for role in (0, 1):
        dealt = _dealt(sets, role, percent, n2, k2)
        if dealt is None:
            continue
        index, inst, n1, _, sure, part_base, total, some = dealt
        part_job = np.repeat(np.arange(len(index)), n1)
        part = np.arange(len(part_job)) - part_base[part_job]
        keep = some | ~sure[part_job][:, None]
        for c, subset in enumerate(combinations(range(n2), n2 - k2)):
            rows = np.flatnonzero(keep[:, c])
            seed = (inst[part_job[rows]].astype(np.uint64) * _M[2]) ^ (part[rows].astype(np.uint64) * _M[3]) ^ np.uint64((c + 1) * int(_M[4]) & 0xFFFFFFFFFFFFFFFF)
            sigs.append(mixed(total[rows][:, list(subset)].sum(axis=1, dtype=np.uint64) ^ mixed(seed)))
            owners.append(2 * index[part_job[rows]] + role)
    return np.concatenate(sigs), np.concatenate(owners)


def parities(s: np.ndarray) -> bytes:
    """A bit for each of some parts, a power of two that grows with the set: whether it holds an odd number of shingles.

    Bits in which two sets differ bound the sets' difference from below, closely as there are two parts or more
    for each shingle. A longer vector folds onto a shorter one.
    """
    parts = max(SKETCH, 1 << max(2 * len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts).astype(np.uint8) & 1).tobytes()


def folded(vector: bytes, size: int) -> np.ndarray:
    """The first ``size`` bytes' worth of parts, each the parity of those it stands for."""
    return np.bitwise_xor.reduce(np.frombuffer(vector, np.uint8).reshape(-1, size), axis=0)


def near_enough(x: bytes, n_x: int, y: bytes, n_y: int, percent: int) -> bool:
    """Whether the whole vectors allow the similarity; never false for similar sets."""
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
    return apart * (100 + percent) <= (n_x + n_y) * (100 - percent)


def class_of(s: np.ndarray) -> int | None:
    """64-bit digest of a set: equal sets are one class. Two of n different sets collide with odds n * n / 2 ** 65."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _described(batches, width: int, percent: int, n2: int, k2: int):
    for part in by_slices(batches, 256):
        sets = [shingles(t, width) for t in part["text"].to_pylist()]
        least = least_shared(sets, percent, n2, k2).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [part["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary()), pa.array(least[:, 0]), pa.array(least[:, 1])],
            ["id", "n", "class", "sketch", "least0", "least1"],
        )


PACKED = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("classes", pa.binary()), ("at", pa.binary())])


def _packed(batches, width: int, percent: int, n2: int, k2: int, bits: int):
    """Signatures by bucket; a row has the bits of the signatures after the bucket's, and their classes by number and role.

    Equal sets of a task give their signatures once.
    """
    seen: set[int] = set()
    sig_parts, owner_parts, classes = [], [], []

    def flush():
        if not sum(map(len, sig_parts)):
            return
        sig, owner = np.concatenate(sig_parts), np.concatenate(owner_parts)
        bucket = (sig >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        table_ = np.array(classes, dtype=np.int64)
        rows = {n: [] for n in PACKED.names}
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            mine = order[a:b]
            used, at = np.unique(owner[mine] >> 1, return_inverse=True)
            at = 2 * at + (owner[mine] & 1)
            tail = ((sig[mine] << np.uint64(bits)) >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
            rows["bucket"].append(int(bucket[mine[0]]))
            rows["sigs"].append(np.ascontiguousarray(tail).tobytes())
            rows["classes"].append(table_[used].tobytes())
            rows["at"].append(at.astype(np.uint16 if len(used) <= 32_768 else np.uint32).tobytes())
            if len(rows["bucket"]) == 256:
                yield pa.RecordBatch.from_pydict(rows, PACKED)
                rows = {n: [] for n in PACKED.names}
        if rows["bucket"]:
            yield pa.RecordBatch.from_pydict(rows, PACKED)

    held = 0
    for part in by_slices(batches, 128):
        sets, base = [], len(classes)
        for text in part["text"].to_pylist():
            s = shingles(text, width)
            name = class_of(s)
            if name is not None and name not in seen:
                seen.add(name)
                classes.append(name)
                sets.append(s)
        sig, owner = signatures(sets, percent, n2, k2)
        sig_parts.append(sig)
        owner_parts.append((owner + 2 * base).astype(np.int32))
        held += len(sig)
        if held > HELD_SIGNATURES:
            yield from flush()
            sig_parts, owner_parts, classes, held = [], [], [], 0
            if len(seen) > SEEN_CLASSES:
                seen.clear()
    yield from flush()


FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("role", pa.int32()), ("size", pa.int64())])


def _shared(group: pa.Table) -> pa.Table:
    """Of one bucket: kind 0, (least smaller partner of a signature, another member, number of such signatures);
    kind 1, (group, member, number of signatures of this group, the member's role, size) of three or more.
    """
    sig, cls, role = [], [], []
    for s, c, at in zip(group["sigs"].to_pylist(), group["classes"].to_pylist(), group["at"].to_pylist(), strict=True):
        five = np.frombuffer(s, np.uint8).reshape(-1, 5)
        eight = np.zeros((len(five), 8), np.uint8)
        eight[:, 3:] = five
        sig.append(eight.reshape(-1).view(">u8").astype(np.uint64))
        at = np.frombuffer(at, np.uint16 if len(at) == 2 * len(five) else np.uint32)
        cls.append(np.frombuffer(c, np.int64)[at >> 1])
        role.append((at & 1).astype(np.uint8))
    sig, cls, role = np.concatenate(sig), np.concatenate(cls), np.concatenate(role)
    # Only signatures that occur twice matter, and few do.
    order = np.argsort(sig, kind="stable")
    twin = np.zeros(len(sig), bool)
    twin[1:] = sig[order[1:]] == sig[order[:-1]]
    twin[:-1] |= twin[1:]
    order = order[twin]
    sig, cls, role = sig[order], cls[order], role[order]
    order = np.lexsort((cls, role, sig))
    sig, cls, role = sig[order], cls[order], role[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls, role = sig[new], cls[new], role[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(sig)))
    # Roles rise within a signature: one whose first member is a larger partner has no smaller one.
    useful = np.repeat((role[start] == 0) & (length > 1), length) if len(sig) else np.zeros(0, bool)
    sig, cls, role = sig[useful], cls[useful], role[useful]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(sig)))
    lead = np.repeat(cls[start], length)
    other = lead != cls
    pairs, shared = np.unique(np.stack([np.minimum(lead, cls)[other], np.maximum(lead, cls)[other]], axis=1), axis=0, return_counts=True)
    marks = mixed(cls.astype(np.uint64) * np.uint64(2) + role)
    group_of = np.repeat(np.bitwise_xor.reduceat(marks, start) + length.astype(np.uint64), length) if len(sig) else sig
    sizes = np.repeat(length, length)
    big = sizes >= 3
    members, times = np.unique(np.stack([group_of.astype(np.int64), cls, role.astype(np.int64), sizes], axis=1)[big], axis=0, return_counts=True)
    none = np.zeros(len(pairs), np.int64)
    return pa.Table.from_arrays(
        [
            pa.array(np.repeat([0, 1], [len(pairs), len(members)]).astype(np.int32)),
            pa.array(np.concatenate([pairs[:, 0], members[:, 0]])),
            pa.array(np.concatenate([pairs[:, 1], members[:, 1]])),
            pa.array(np.concatenate([shared, times]).astype(np.int64)),
            pa.array(np.concatenate([none, members[:, 2]]).astype(np.int32)),
            pa.array(np.concatenate([none, members[:, 3]])),
        ],
        schema=FOUND,
    )


def _bits(vectors: list[bytes]) -> np.ndarray:
    """The vectors as rows of zeros and ones, folded to the shortest of them."""
    size = min(MOST_PARTS // 8, *map(len, vectors))
    return np.unpackbits(np.stack([folded(v, size) for v in vectors]), axis=1).astype(np.float32)


def _filtered(batches, percent: int):
    for part in by_slices(batches, 1024):
        va, vb, na, nb = (part[c].to_pylist() for c in ("sa", "sb", "na", "nb"))
        keep = [min(m, n) * 100 >= max(m, n) * percent and near_enough(x, m, y, n, percent) for x, m, y, n in zip(va, na, vb, nb, strict=True)]
        yield part.select(["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))


CELL = ["group", "x", "y"]


def _forest(score: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of high scores; ``left`` and ``right`` have their labels, negative scores no edge."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = at[: len(left)], at[len(left) :]
    root = np.arange(len(names))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    rows, cols = [], []
    while True:
        top = np.array([find(k) for k in range(len(names))])
        open_ = np.where(top[left][:, None] != top[right], score, -1.0)
        # The best edge of every row and column has that of every component among them.
        i = np.concatenate([np.arange(len(left)), open_.argmax(axis=0)])
        j = np.concatenate([open_.argmax(axis=1), np.arange(len(right))])
        value = open_[i, j]
        some = np.flatnonzero(value >= 0)
        if not len(some):
            return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
        for k in some[np.lexsort((j[some], i[some], -value[some]))]:
            one, other = find(left[i[k]]), find(right[j[k]])
            if one != other:
                root[max(one, other)] = min(one, other)
                rows.append(i[k])
                cols.append(j[k])


def _compared(cell: pa.Table, percent: int, forest: bool) -> np.ndarray:
    """Candidate pairs of one pair of blocks of a group: other label, and possible by size and parities; all, or a spanning forest."""
    x, y, side = cell["x"][0].as_py(), cell["y"][0].as_py(), cell["side"].to_numpy()
    whole, label, cls, n, role = cell["sketch"].to_pylist(), *(cell[c].to_numpy() for c in ("label", "class", "n", "role"))
    left, right = (np.arange(len(cls)),) * 2 if x == y else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(left) or not len(right) or (label == label[0]).all():
        return np.zeros((0, 2), np.int64)
    bits = _bits(whole)
    ones = bits.sum(axis=1)
    ok = (label[left][:, None] != label[right]) & (role[left][:, None] + role[right] < 2)
    if x == y:
        ok &= cls[left][:, None] < cls[right]
    both = n[left][:, None] + n[right]
    apart = ones[left][:, None] + ones[right] - 2 * (bits[left] @ bits[right].T)
    ok &= apart * (100 + percent) <= both * (100 - percent)
    ok &= np.minimum(n[left][:, None], n[right]) * 100 >= np.maximum(n[left][:, None], n[right]) * percent
    i, j = _forest(np.where(ok, 1 - apart / both, -1.0), label[left], label[right]) if forest and ok.any() else np.nonzero(ok)
    a, b = cls[left[i]], cls[right[j]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _crossing(batches, percent: int, forest: bool):
    """Pairs of each run of rows of one cell; rows come sorted by cell, and one cell is held at a time."""
    held, last, out, n = [], None, [], 0

    def pairs():
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in CELL], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            key = tuple(keys[a])
            if key != last and held:
                out.append(_compared(pa.Table.from_batches(held), percent, forest))
                n += len(out[-1])
                held = []
                if n > 100_000:
                    yield pairs()
                    out, n = [], 0
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        out.append(_compared(pa.Table.from_batches(held), percent, forest))
    if out:
        yield pairs()


def _crossed(members: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, forest: bool, own_blocks: bool, least: int) -> DataFrame:
    """Candidate pairs (a, b) between different components of a group of ``least`` members or more, within its blocks or between all of them."""
    known = members.join(labels.withColumnRenamed("node", "class"), "class", "left").select("group", "class", "role", F.coalesce("label", "class").alias("label"))
    open_ = known.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("role").alias("role"), F.count("*").alias("size")).where(f"lo != hi AND role = 0 AND size >= {least}").select("group", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = known.join(open_, "group").join(classes.select("class", "n", "sketch"), "class").withColumn("block", F.pmod(F.xxhash64("class", F.lit(9)), F.col("blocks")).cast("int"))
    # Each pair of blocks of a group is one unit of work, however large the group.
    other = F.array("block") if own_blocks else F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = F.transform(other, lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    grid = dealt.withColumn("cell", F.explode(cells)).select("group", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), F.when(F.col("block") == F.col("cell.x"), 0).otherwise(1).alias("side"), "class", "role", "label", "n", "sketch")
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grid.repartition(partitions, *CELL).sortWithinPartitions(*CELL).mapInArrow(partial(_crossing, percent=percent, forest=forest), "a bigint, b bigint").distinct()


def _set_rows(batches, width: int):
    for part in by_slices(batches, 64):
        sets = [shingles(t, width) for t in part["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "members"])


def _with_class(batches, width: int):
    for part in by_slices(batches, 256):
        names = pa.array([class_of(shingles(t or "", width)) for t in part["text"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*part.columns, names], [*part.schema.names, "_class"])


def _similar(batches, percent: int):
    for part in by_slices(batches, 512):
        keep = []
        for x, y in zip(part["ma"].to_pylist(), part["mb"].to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    pairs = stored(pairs.select("a", "b").distinct(), "jaccard-pairs")
    if not pairs.head(1):
        return pairs
    wanted = stored(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(classes.select("class", "first"), "class"), "jaccard-wanted")
    # A row of a class's least id lends its text. Ids may be null or repeat with other texts, so each text tells its
    # class by content; a side of this checked size needn't shuffle the texts.
    n, with_id = wanted.agg(F.count("*"), F.count("first")).first()
    side, names = wanted.select("first").where("first IS NOT NULL").distinct(), wanted.select("class")
    if n <= BROADCAST_CLASSES:
        side, names = F.broadcast(side), F.broadcast(names)
    rows = texts.join(side, texts["id"] == side["first"], "left_semi").select("text")
    if with_id < n:
        rows = rows.union(texts.where("id IS NULL").select("text"))
    sets = stored(rows.mapInArrow(partial(_set_rows, width=width), "class bigint, members binary").dropDuplicates(["class"]).join(names, "class", "left_semi"), "jaccard-sets")
    out = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("class").alias("b"), F.col("members").alias("mb")), "b")
    links = stored(out.mapInArrow(partial(_similar, percent=percent), "a bigint, b bigint"), "jaccard-links")
    released(pairs, wanted, sets)
    return links


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, n2: int = N2, k2: int = K2) -> DataFrame:
    """id, n_shingles and component_id (least id reachable by links) for each row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of ``width``-word shingles is ``percent`` % or more.
    Empty and null texts have no shingles and link with nothing. Rows with equal sets are one class, so any
    number of copies costs one set. A row with a null id takes part and reports its component's least id
    (null if it has none). Repeated rows are kept. Other columns are not read; an empty table gives no rows.
    """
    described, groups = _grouped(docs, id_col, text_col, width, percent, n2, k2)
    return _reported(described, groups, id_col)


def _reported(described: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    out = described.select("id", "n", "class").join(groups.select("class", "component_id"), "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, n2: int = N2, k2: int = K2) -> tuple[DataFrame, DataFrame]:
    """The rows' ids and classes; and of each class its component's label and least id."""
    in_small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    described = stored(texts.mapInArrow(partial(_described, width=width, percent=percent, n2=n2, k2=k2), f"id {kind}, n bigint, class bigint, sketch binary, least0 int, least1 int"), "jaccard-rows")
    # A class's text is that of its least id; should that id repeat with another text, or be null, its class is found by content.
    classes = stored(described.where("n > 0").groupBy("class").agg(F.min("id").alias("first"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("sketch", "least0", "least1"))), "jaccard-classes")

    total = described.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BUCKETS.bit_length() - 1, int(np.ceil(np.log2(max(total * 0.75 / BUCKET_SIGNATURES, 1)))))
    packed = texts.select("text").mapInArrow(partial(_packed, width=width, percent=percent, n2=n2, k2=k2, bits=bits), "bucket int, sigs binary, classes binary, at binary")
    found = stored(packed.groupBy("bucket").applyInArrow(_shared, "kind int, a bigint, b bigint, shared bigint, role int, size bigint"), "jaccard-found")
    del packed

    facts = lambda side: classes.select(F.col("class").alias(side), F.col("n").alias("n" + side), F.col("sketch").alias("s" + side))
    raw = found.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = stored(raw.join(facts("a"), "a").join(facts("b"), "b").mapInArrow(partial(_filtered, percent=percent), "a bigint, b bigint, shared bigint"), "jaccard-possible")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    labels = components(_verified(best, texts, classes, width, percent))

    members = found.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("class"), "shared", "role", "size").repartition("class")
    members = members.groupBy("class", "role", "group", "size").agg(F.sum("shared").alias("shared")).join(classes.select("class", "least0", "least1"), "class")
    # The prefix filter: of a set's signatures in a role, the most frequent may go while a shared one must stay.
    so_far = F.sum("shared").over(Window.partitionBy("class", "role").orderBy(F.desc("size"), "group").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    members = members.withColumn("so_far", so_far).where(F.col("so_far") >= F.when(F.col("role") == 0, F.col("least0")).otherwise(F.col("least1")))
    members = stored(members.select("group", "class", "role"), "jaccard-members")

    def possible(crossing: DataFrame) -> DataFrame:
        """By the whole vectors, once for each pair, however many groups it meets in."""
        return crossing.withColumn("shared", F.lit(0)).join(facts("a"), "a").join(facts("b"), "b").mapInArrow(partial(_filtered, percent=percent), "a bigint, b bigint, shared int").select("a", "b")

    tried = best
    largest = members.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    for own_blocks, least in ((True, FOREST_FROM), (False, BLOCK + 1)):
        if largest < least:
            continue
        likely = stored(possible(_crossed(members, labels, classes, percent, True, own_blocks, least)).join(tried, ["a", "b"], "left_anti"), "jaccard-likely")
        labels = components(_verified(likely, texts, classes, width, percent), labels)
        tried = tried.union(likely)

    # What is still apart: other partners of a least class, and other members of a signature's group.
    label_of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias("l" + side))
    apart = pairs.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left").where("coalesce(la, a) != coalesce(lb, b)").select("a", "b")
    more = apart.union(possible(_crossed(members, labels, classes, percent, False, False, 2))).join(tried, ["a", "b"], "left_anti")
    labels = components(_verified(more, texts, classes, width, percent), labels)

    joined = classes.select("class", "first").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    joined = stored(joined, "jaccard-joined")
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    return described, stored(joined.join(least, "label").select("class", "label", "component_id"), "jaccard-components")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of similar texts does: that of the least id.

    Texts without words are in no group and stay. Of rows that repeat a group's least id, one stays; rows
    with a null id stay only if their group has no id, and then one of them does. Other columns may have any name.
    """
    names = docs.columns
    kept = _one_of_each(docs.select(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")), text_col, **options)
    return kept.select("row.*")


def _one_of_each(docs: DataFrame, text_col: str, **options) -> DataFrame:
    """The same of (id, row), the text inside the row."""
    id_col, text = "id", F.col("row").getField(text_col).cast("string").alias("text")
    described, groups = _grouped(docs.select("id", text), id_col, "text", **options)
    found = stored(_reported(described, groups, id_col), "jaccard-groups")
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_gone")).distinct()
    side = F.broadcast(gone) if gone.count() <= BROADCAST_CLASSES else gone
    twice = found.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).select(F.col(id_col).alias("_twice"))
    if not twice.head(1):
        return docs.join(side, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
    # Where an id doesn't tell the row, the text does.
    named, repeated = docs.where(F.col(id_col).isNotNull()), twice.where("_twice IS NOT NULL")
    once = named.join(repeated, F.col(id_col) == F.col("_twice"), "left_anti").join(side, F.col(id_col) == F.col("_gone"), "left_anti")
    others = named.join(repeated, F.col(id_col) == F.col("_twice"), "left_semi").union(docs.where(F.col(id_col).isNull()))
    others = others.select("id", "row", text)
    others = others.mapInArrow(partial(_with_class, width=options.get("width", SHINGLE)), T.StructType([*others.schema.fields, T.StructField("_class", T.LongType())])).drop("text")
    others = others.join(groups.select(F.col("class").alias("_class"), F.col("label").alias("_label"), F.col("component_id").alias("_component")), "_class", "left").select(*docs.columns, "_class", "_label", "_component")
    least = others.where(F.col("_class").isNotNull() & F.col(id_col).eqNullSafe(F.col("_component"))).dropDuplicates(["_label"])
    return once.union(least.union(others.where("_class IS NULL")).drop("_class", "_label", "_component"))


def op5_part_enum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))


QUERIES = {"op5_part_enum_join": op5_part_enum_join}
#: All pairs that share a shingle, and the closure of those that are similar.
ORACLES = {
    "op5_part_enum_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), members AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
    SELECT doc_id AS x, doc_id AS y FROM sets
    UNION
    SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, min(r.y)) AS component_id FROM sets s JOIN reached r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""
}
