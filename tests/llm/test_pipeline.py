"""The pipeline against its stages recomputed row by row in plain Python."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from brackenspan.llm import mixing, quality, toxicity
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_kept_rows(spark):
    import tiktoken

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    lexicon, trees = toxicity.fitted(docs, labels)
    score = lambda r: float(trees.score(np.array([toxicity.features(r.text or "", lexicon)]))[0])
    clean = [r for r in rows if score(r) < toxicity.THRESHOLD]
    weights, bias = quality.fitted(spark.createDataFrame(clean, docs.schema), labels)

    def good(r):
        index, value = quality.vector(r.text or "", quality.BITS)
        return 1 / (1 + np.exp(-(float(weights[index] @ value) + bias))) >= quality.THRESHOLD

    fine = [r for r in clean if good(r)]
    single = [r for k, (r, (n, c)) in enumerate(zip(fine, brute_components([r.text for r in fine]), strict=True)) if not n or c == k]
    size = lambda r: len((r.text or "").encode().split())
    sums = defaultdict(int)
    for r in single:
        sums[r.source] += size(r)
    target = {s: t for s, _, t in mixing.source_targets(list(sums.items()))}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    out = corpus_pipeline.run(spark, SF).collect()
    copies, text = Counter(r.doc_id for r in out), {r.doc_id: r.text or "" for r in single}
    assert len(single) < len(fine) < len(rows) and set(copies) <= set(text)
    taken = defaultdict(int)
    for r in single:
        rate = target[r.source] / sums[r.source]
        assert int(rate + 1e-9) <= copies[r.doc_id] <= int(rate + 1e-9) + 1
        taken[r.source] += copies[r.doc_id] * size(r)
    most = max(map(size, single))
    assert all(abs(taken[s] - t) <= most for s, t in target.items())
    for r in out:
        assert r.ids == encode(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
