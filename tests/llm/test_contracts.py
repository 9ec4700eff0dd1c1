"""The registered opN queries against brute-force versions, and operators on odd rows by value."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brackenspan.llm import bpe, common, language_id, mixing, ogg, quality, sharding, token_counts, toxicity
from brackenspan.llm.labelled import labelled_sample

SF = "/root/testdata/sf0.001"
ODD = [(1, "The cat sat", "a"), (1, "The cat sat", "a"), (None, "The cat sat", "a"), (2, None, None), (3, "", "b"), (3, "", "b"), (None, None, "a"), (4, "long word " * 9000, "c"), (5, "x" * 70_000, "c"), (6, "  \n\t", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, empty and very long texts, and columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    names = "id ids digest label score n class key size nth own row lang media payload times copies _mix_copy _mix_key _gone _twice _class _nth _row piece h1 h2 fold"
    return df.withColumns({c: F.lit("x") for c in names.split()})


@pytest.fixture(scope="module")
def models(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.fitted(docs, labels), quality.fitted(docs, labels), language_id.fit(docs)


def test_op1(spark, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_byte_bpe(spark, SF).collect()}
    for i, t in rows:
        ids = encode(t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_ordinary_texts_come_in_chunks(rows):
    """With the default settings most documents are stitched from several chunks."""
    many = [len(bpe.scanned(t, bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS, P.PATTERN)) - 1 for _, t in rows if len(t) > 1500]
    assert many and np.mean([n > 1 for n in many]) > 0.95


def test_op2(spark, rows):
    out = sharding.op2_histogram_shards(spark, SF).toPandas()
    size = {i: len(t.encode()) + 1 for i, t in rows}
    assert dict(zip(out.doc_id, out["size"])) == size and len(out) == len(rows)
    assert dict(zip(out.doc_id, out.text_crc32)) == {i: zlib.crc32(t.encode()) for i, t in rows}
    assert set(out.shard) <= set(range(8)) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    share, longest = sum(size.values()) / 8, max(size.values())
    assert all(abs(g["size"].sum() - share) <= 0.02 * share + longest for _, g in out.groupby("shard"))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    text = dict(rows)
    spread = defaultdict(set)
    for i, s in zip(out.doc_id, out.shard):
        spread[text[i]].add(s)
    assert sum(len(s) > 1 for s in spread.values()) <= 7  # at most one group a boundary


def test_shards_of_one_repeated_row(spark):
    out = sharding.shard(spark.createDataFrame([(7, "the same text")] * 4000 + [(k, "t") for k in range(100)], "doc_id long, text string")).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(out) == 4100 and len(sums) == 8 and sums.max() - sums.min() <= 0.05 * sums.mean()


def test_op3(spark, docs, rows):
    out = {r.doc_id: r for r in language_id.op3_language_id(spark, SF).collect()}
    model = language_id.fit(docs.where(common.train_fold("doc_id", 5) != 0))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    right = []
    for i, t in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i].score <= 1
        if not any(c.isalpha() for c in t):
            assert out[i].lang_pred == "und"
            continue
        # Brute force: the vector of one text against every centroid.
        x = language_id.weighted(language_id.n_grams(t)[None, :], model.idf)[0]
        cosines = [float(x @ c) for c in model.centroids]
        best = int(np.argmax(cosines))
        assert out[i].lang_pred == model.languages[model.owner[best]] and abs(out[i].score - min(max(cosines[best], 0), 1)) < 1e-5
        if out[i].held_out and lang[i]:
            right.append(out[i].lang_pred == lang[i])
    assert np.mean(right) > 0.9


def test_language_sample_takes_copies_once(spark):
    rows = [(k, "the same english words again and again", "en") for k in range(500)] + [(1000 + k, f"des mots français numéro {k}", "fr") for k in range(5)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=3)
    assert model.languages == ["en", "fr"]


def test_op4(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op4_token_counts(spark, SF).collect()}
    for i, t in rows:
        n = len(library.encode(t, add_special_tokens=False))
        assert got[i] == (len(t.encode()), n, n > 1024)


def test_cache_encodes_misses_only(spark, odd, tmp_path):
    cache = str(tmp_path / "cache")
    path = P.path("byte_bpe_50k.json")
    token_counts.count_tokens(odd.where("doc_id = 1"), path, cache).collect()
    assert spark.read.parquet(cache).count() == 1
    # A stored count is taken as it stands: the text isn't encoded again.
    poisoned = spark.read.parquet(cache).withColumn("n_tokens", F.lit(99).cast("bigint")).collect()
    other = str(tmp_path / "other")
    spark.createDataFrame(poisoned, "digest binary, n_tokens bigint, version string").write.partitionBy("version").parquet(other)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, path, other).where("n_bytes = 11").collect())
    assert got == Counter({(1, 99): 2, (None, 99): 1})
    assert spark.read.parquet(other).count() == len({t or "" for _, t, _ in ODD})


def test_op6(spark, rows):
    got = {r.doc_id: r for r in ogg.op6_ogg_media(spark, SF).collect()}
    for i, t in rows:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = ogg.write_ogg(payload)
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()


def test_ogg_times():
    payload = bytes(64) * 1000  # 64,000 samples, dealt to two streams by 6,000
    _, facts = ogg.unpack(ogg.write_ogg(payload))
    for serial, samples in ((1, 34_000), (2, 30_000)):
        times = [t for t in facts["times"] if t[0] == serial]
        assert times[-1][2] == samples * 1000 // ogg.RATE and [t[2] for t in times] == sorted(t[2] for t in times)
        # A page's time is that of the packets complete at its end.
        assert all(t[2] == min(t[1] * ogg.PACKET, samples) * 1000 // ogg.RATE for t in times)


def test_op8_op10(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lexicon, trees = toxicity.fitted(docs, labels)
    weights, bias = quality.fitted(docs, labels)
    toxic = {r.doc_id: r for r in toxicity.op8_toxicity_trees(spark, SF).collect()}
    good = {r.doc_id: r for r in quality.op10_quality_ftrl(spark, SF).collect()}
    assert len(toxic) == len(good) == len(rows)
    for i, t in rows:
        # One tree after the other, one node after the other.
        x, total = toxicity.features(t, lexicon), trees.bias
        for feature, cut, value in trees.trees:
            node = 0
            while node < len(feature):
                f = feature[node]
                node = 2 * node + 1 + int(np.searchsorted(trees.edges[f], x[f], side="right") > cut[node])
            total += value[node - len(feature)]
        want = float(np.clip(np.interp(total, trees.xs, trees.ys), 0, 1))
        assert abs(toxic[i].score - want) < 1e-9 and toxic[i].predicted == int(toxic[i].score >= 0.7) and toxic[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        index, value = quality.vector(t)
        raw = bias + sum(float(weights[k]) * v for k, v in zip(index, value))
        assert abs(good[i].score - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-5 and good[i].predicted == int(good[i].score >= 0.5)


def test_labels_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 100).collect()
    held = zlib.crc32(b"1") % 3 == 1
    assert [(r.id, r.label) for r in got] == ([] if held else [(1, 1)]) and all(r.text in ("a", "b", "") for r in got)


def test_op9(spark, docs, rows):
    out = mixing.op9_pivotal_mix(spark, SF).toPandas()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(t.encode().split()) for i, t in rows}
    sums = Counter()
    for i in size:
        sums[source[i]] += size[i]
    target = {s: t for s, _, t in mixing.source_targets(list(sums.items()))}
    taken, longest = Counter(), Counter()
    for r in out.itertuples():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= max(longest[s], 1) for s in target)
    assert abs(sum(target.values()) - sum(sums.values())) < 1e-3 or any(abs(target[s] - 3 * sums[s]) < 1e-6 for s in target)


def test_mix_of_one_repeated_row(spark):
    rows = [(1, "w " * 50, "a")] * 4000 + [(k, "w " * 50, "b") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, bucket_rows=64).toPandas()
    for _, g in out.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 50
    assert out[out.source == "a"].copies.nunique() == 2
    again = Counter(r.source for r in mixing.repeated(df, bucket_rows=64).select("source").collect())
    assert again == Counter({s: int(g.copies.sum()) for s, g in out.groupby("source")})


def test_targets_by_spark(spark):
    rng = random.Random(4)
    sizes = [(f"s{k:03}", rng.choice([0, 1, 5, 1000, 20_000])) for k in range(200)] + [(None, 70), ("é", 9), ("Z", 3)]
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, size bigint, n bigint")
    want = {s: t for s, _, t in mixing.source_targets(sizes)}
    got = {r.source: r.target for r in mixing.targets_of(df).collect()}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)
    docs = spark.createDataFrame([(k, "w " * (k % 40), f"s{k % 7}") for k in range(500)], "doc_id long, text string, source string")
    one, two = (mixing.mix(docs, driver_sources=n, bucket_rows=64).toPandas().sort_values("doc_id") for n in (10_000, 2))
    assert (one.copies.values == two.copies.values).all()


def test_odd_rows_by_value(odd, models):
    toxic, good, language = models
    count = Counter((i, t) for i, t, _ in ODD)
    for scored in (toxicity.score_toxicity(odd, toxic), quality.score_quality(odd, good)):
        got = scored.collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in ODD)
        # Equal texts, equal scores; null as empty.
        assert len({round(r.score, 12) for r in got if r.doc_id in (2, 3)}) == 1
    named = language_id.identify(odd, language).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in named if r.doc_id in (2, 3, 6))
    kept = Counter((r.doc_id, r.text) for r in toxicity.drop_toxic(odd, toxic).select("doc_id", "text").collect())
    assert all(kept[k] in (0, count[k]) for k in kept)
    placed = sharding.shard(odd).toPandas()
    assert Counter(placed.text_crc32) == Counter(zlib.crc32((t or "").encode()) for _, t, _ in ODD)
    mixed = mixing.mix(odd).toPandas()
    assert sorted(mixed["size"]) == sorted(len((t or "").split()) for _, t, _ in ODD)
    media = ogg.read_media(ogg.to_media(odd)).collect()
    assert Counter(len(r.payload) for r in media) == Counter(max(64, -(-len((t or "").encode()) // 64) * 64) for _, t, _ in ODD)


def test_empty_tables(odd, models, tmp_path):
    none, (toxic, good, language) = odd.where("false"), models
    found = [bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), sharding.shard(none), language_id.identify(none, language), token_counts.count_tokens(none, P.path("byte_bpe_50k.json")), ogg.read_media(ogg.to_media(none)), toxicity.score_toxicity(none, toxic), quality.score_quality(none, good), mixing.mix(none), mixing.repeated(none)]
    assert [df.count() for df in found] == [0] * len(found)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, odd, empty):
    """Each stage keeps the columns it is given, whatever their names; the last tokenises."""
    docs = odd.where("false") if empty else odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
        have = {(i, t) for i, t, _ in ODD}
        assert set(got) <= have and (not empty or not got), name
        if name.startswith("n-gram"):
            assert sum(n for (_, t), n in got.items() if t == "The cat sat") == (0 if empty else 1) and got[(3, "")] == (0 if empty else 2)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r.n_tokens > 0 for r in last.collect()) == (Counter() if empty else Counter(bool(t) for _, t, _ in ODD))


def test_work_folder_must_be_shared():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        common.work_dir(Session())
