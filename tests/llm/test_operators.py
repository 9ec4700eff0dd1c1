"""Each operator against a brute-force version, a round trip or a library, and on odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from brackenspan.llm import ann, bpe, jaccard, language_id, mixing, ogg, quality, sharding, token_counts, toxicity
from brackenspan.llm.components import components

ODD = [(1, "The cat's  sat\n\n on 12 mats <|endoftext|>", "a"), (2, None, None), (3, "", "b"), (3, "", "b"), (None, "Ünïcödé \t x", "a"), (5, "a" * 3000, "a"), (6, "word " * 2000, "c"), (7, "  \n \t", "c"), (8, "The cat's  sat\n\n on 12 mats <|endoftext|>", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, empty and long texts, and extra columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("x") for c in ("id", "ids", "digest", "label", "score", "n", "class", "key", "size", "lang", "media", "payload")})


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (50, 20), (700, 8)])
def test_bpe(spark, odd, tokenizer, chunk, overlap):
    out = bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect()
    want = sorted(((i or 0, tokenizer.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in ODD))
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in out) == want
    again = bpe.decode(spark.createDataFrame([(1, want[1][1]), (2, None)], "doc_id long, ids array<int>"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in again.collect()} == {1: want[1][2], 2: None}


def test_stitching_random_texts(tokenizer):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "7", "!", "'s", "é", "\t"]) for _ in range(rng.randrange(1, 400)))
        chunk, overlap = rng.randrange(20, 80), rng.randrange(4, 19)
        spans = bpe.chunk_spans(len(text), chunk, overlap)
        ends = [bpe.boundaries(P.PATTERN, text[s:e]) for s, e in spans]
        cuts = bpe.stitch(text, spans, [[s + x for x in b if x <= overlap] for (s, _), b in zip(spans, ends)], [[s + x for x in b if x >= chunk] for (s, _), b in zip(spans, ends)], P.PATTERN)
        assert [i for a, b in zip(cuts, cuts[1:]) for i in tokenizer.encode_ordinary(text[a:b])] == tokenizer.encode_ordinary(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, tmp_path, name):
    texts = [t or "" for _, t, _ in ODD]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(P.path(name))
        want = [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
    cache = str(tmp_path / "cache")
    for _ in range(2):
        out = token_counts.count_tokens(odd, P.path(name), cache).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == sorted((i or 0, len((t or "").encode()), n) for (i, t, _), n in zip(ODD, want))
    assert spark.read.parquet(cache).count() == len(set(texts))


def test_shards(spark, odd):
    rng = random.Random(2)
    rows = [(i, "hot" * 40 if i % 3 == 0 else "x" * rng.randrange(300)) for i in range(4000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), piece_bytes=4000).toPandas()
    assert sorted(out.doc_id) == list(range(4000))
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.02 * sums.mean() + 600
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert all(c == zlib.crc32(rows[i][1].encode()) for i, c in zip(out.doc_id, out.text_crc32))
    assert sharding.shard(odd).count() == len(ODD)


def test_ogg():
    rng = random.Random(3)
    for size in (64, 128, 6000, 5952, 64 * 255, 40000 * 2):
        payload = rng.randbytes(size)
        media = ogg.write_ogg(payload)
        back, facts = ogg.unpack(media)
        assert back == payload and facts["samples"] == size
        at = rng.randrange(len(media))
        with pytest.raises(ogg.OggError):
            ogg.unpack(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    # A fixed page: checksum by the bitwise definition.
    page, crc = ogg.page(2, 0, 1, 0, b"\x01", b"a"), 0
    for byte in page[:22] + bytes(4) + page[26:]:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
    assert crc == int.from_bytes(page[22:26], "little")


def test_media_rows(odd):
    out = ogg.read_media(ogg.to_media(odd)).collect()
    want = sorted(hashlib.sha256((t or "").encode() + bytes(-len((t or "").encode()) % 64 or (0 if t else 64))).hexdigest() for _, t, _ in ODD)
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in out) == want


def test_search(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(1, 16)), 600, axis=0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0))
    got = ann.search(df, df.where("vec_id % 20 = 0"), block=256, chunk=32).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -np.round(score, 9)))[:20]
        hits, total = hits + len(set(best) & set(g.vec_id)), total + 20
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21))
    assert got.query_id.nunique() == 105 and hits / total >= 0.9
    assert ann.search(df.where("false"), df).count() == 0


@pytest.mark.parametrize("sd", [0.001, 0.01])
def test_search_near_vectors(spark, sd):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 64))
    x[:2000] = x[0] / np.linalg.norm(x[0]) + rng.normal(scale=sd, size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id < 2000 AND vec_id % 100 = 7")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(g.vec_id))
    assert got.query_id.nunique() == 20 and hits / 400 >= 0.95


def test_search_tight_clusters(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(200, 16)), 100, axis=0) + rng.normal(scale=1e-3, size=(20_000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 400 = 0")).toPandas()
    score = x @ x[got.query_id.unique()].T
    hits = 0
    for column, (q, g) in enumerate(got.groupby("query_id")):
        s = score[:, column].copy()
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert got.query_id.nunique() == 50 and hits / 1000 >= 0.95


def test_search_visits_a_part(spark):
    """Clustered vectors: the tuned share is well under 1, measured on rows that were not fitted on."""
    rng = np.random.default_rng(13)
    x = np.repeat(rng.normal(size=(100, 16)), 60, axis=0) + rng.normal(scale=0.2, size=(6000, 16))
    index, share = ann.fitted(x, 150, 20)
    assert len(index.centroids) == 150 and share <= 0.3


def test_search_same_codes():
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(300, 4)), np.ones((60, 4))])
    index = ann.Index(np.zeros((1, 4)), np.zeros((2, 1, 2)))  # one code: all table scores tie
    block = pa.table({"id": np.arange(len(x)), "vector": list(x), "codes": [bytes(2)] * len(x), "cell": pa.array([0] * len(x), pa.int32())})
    for q in (0, 200, 310):
        got = ann._searched(block, pa.table({"query_id": [q], "query": [list(x[q])], "cells": pa.array([[0]], pa.list_(pa.int32()))}), index, 20, 32).to_pandas()
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        assert list(got.vec_id) == list(np.lexsort((np.arange(len(x)), -score))[:20])


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n2,k2", [(2, 1), (3, 1)])
def test_jaccard(spark, n2, k2):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(60)]
    texts = [None, "", "  ", "one two", "ONE two", "one two three", "a b c d e", "a b c d f"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 30, 120, 500]))]
        at = rng.randrange(len(base))
        base[at:at] = common
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(999)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"class": F.lit(1), "n": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(df, n2=n2, k2=k2).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    if n2 == 2:
        kept = jaccard.one_of_each(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}


def test_jaccard_odd_rows(odd):
    assert jaccard.join_similar(odd).count() == len(ODD)
    assert jaccard.join_similar(odd.where("false")).count() == 0


def test_jaccard_null_and_repeated_ids(spark):
    rng = random.Random(11)
    rows = []
    for ids in ((None, None), (None, 4, None), (7, 7), (7, 3), (7,), (7,), (None,), (None,), (9, 8), (8,), (None, 7, 5)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60 + len(rows))]
        rows += [(i, " ".join([*base, *(f"n{len(rows)}-{k}" for k in range(at))])) for at, i in enumerate(ids)]
    rows += [(None, ""), (7, None), (7, rows[0][1]), (None, rows[5][1])]
    rng.shuffle(rows)
    facts = brute_components([t for _, t in rows])
    least = {}
    for (i, _), (_, c) in zip(rows, facts, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = Counter((i, n, least[c] if n else i) for (i, _), (n, c) in zip(rows, facts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join_similar(df).collect())) == want
    group = {t: c for (_, t), (n, c) in zip(rows, facts, strict=True) if n}
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()]
    assert Counter((i, group[t]) for i, t in kept if t) == Counter((least[c], c) for c in set(group.values()))
    assert Counter(x for x in kept if not x[1]) == Counter([(None, ""), (7, None)])


def test_components(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, 99), (7, 7), (200, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100: 99, 200: 99}
    for rows, expected in (
        ([], {}),
        ([(1, 2), (1, 3), (2, 1)], {2: 1, 3: 1}),
        ([(3, 1), (3, 2)], {2: 1, 3: 1}),
        ([(1, 2), (2, 3), (3, 1), (None, 4)], {2: 1, 3: 1}),
    ):
        assert {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()} == expected


def test_components_in_steps(spark):
    rng = np.random.default_rng(7)
    stars = [(int(hub), int(leaf)) for hub, leaf in zip(rng.integers(900, 910, 150), rng.permutation(900)[:150], strict=True)]
    steps = [[(int(a), int(b)) for a, b in rng.integers(0, 900, (260, 2))], stars, []]
    label = {k: k for k in range(910)}
    known = None
    for rows in steps:
        for a, b in rows:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
        known = components(spark.createDataFrame(rows, "a long, b long"), known)
        got = known.collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.label for r in got} == {k: v for k, v in label.items() if v != k}


def test_targets():
    assert [round(t, 6) for _, _, t in mixing.source_targets([("a", 10), (None, 50), ("b", 40)])] == [30.0, 46.666667, 23.333333]
    assert mixing.source_targets([("a", 0)]) == [("a", 0, 0.0)]


def test_mix(spark, odd):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (mixing.mix(df.repartition(n), bucket_rows=64, fan_in=4).toPandas().sort_values("doc_id") for n in (2, 5))
    assert (one.copies.values == two.copies.values).all() and one.copies.between(0, 3).all()
    for _, g in one.groupby("source", dropna=False):
        rate = g.target.iloc[0] / g.source_size.iloc[0]
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 20
        assert g.copies.between(int(rate), int(rate) + 1).all()
    assert mixing.mix(odd).count() == len(ODD)
    again = mixing.repeated(df, bucket_rows=64, fan_in=4)
    assert again.columns == df.columns and again.count() == one.copies.sum()


def test_pivot_keeps_words_and_expectation():
    decided, left = mixing.pivot([(k, 10 + k, 0.3) for k in range(200)], 5, 0)
    words = sum((10 + k) * b for k, b in decided) + sum(s * p for _, s, p in left)
    assert len(left) <= 6 and abs(words - sum((10 + k) * 0.3 for k in range(200))) < 1e-6
    rng = random.Random(7)
    mean = np.mean([mixing.move(30, 0.4, 50, 0.7, rng.random())[0] for _ in range(20000)])
    assert abs(mean - 0.4) < 0.02


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def held_out(tables, scored, label):
    docs, labels = tables
    held = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) & F.col(label).isNotNull())
    rows = scored.join(held, "doc_id").toPandas()
    rank, hit = rows.score.rank(), rows[label] == 1
    return (rank[hit].mean() - (hit.sum() + 1) / 2) / (~hit).sum()


def test_quality(tables, odd):
    model = quality.fitted(*tables)
    assert held_out(tables, quality.score_quality(tables[0], model), "quality") > 0.95
    assert quality.score_quality(odd, model).count() == len(ODD)
    assert quality.drop_poor(odd, model).columns == odd.columns


def test_toxicity(tables, odd):
    model = toxicity.fitted(*tables)
    assert held_out(tables, toxicity.score_toxicity(tables[0], model), "toxic") > 0.75
    assert toxicity.score_toxicity(odd, model).count() == len(ODD)
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_lexicon_behind_one_opening(spark):
    rows = [(k, "Licensed to all who read this; see the notice at the end. " + ("zorkish " if k % 4 == 0 else "kindly ") + f"line {k}", int(k % 4 == 0)) for k in range(60)]
    lexicon, _ = toxicity.fit(spark.createDataFrame(rows * 2, "id long, text string, label int"))
    words = lexicon.strong | lexicon.weak
    assert "zorkish" in words and "kindly" not in words


def test_isotonic_and_trees():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((toxicity.boost(x, y).raw(x) > 0) == y).mean() > 0.95


def test_language(tables, odd):
    docs = tables[0]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.fit(docs.where(~held))
    rows = language_id.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()
    found = {r.doc_id: r.lang_pred for r in language_id.identify(odd, model).collect()}
    assert found[2] == found[3] == found[7] == "und" and len(found) == 8
    assert language_id.identify(odd, language_id.fit(odd.where("false"))).where("lang_pred != 'und'").count() == 0
