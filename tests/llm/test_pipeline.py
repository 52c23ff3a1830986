"""The pipeline on a small fixture, against plain Python."""

import base64
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline

from .test_edges import brute_classes, brute_kept, split, words


def fixture():
    texts = [words(1000 * i, 60 + i) for i in range(12)]
    passage = words(50_000, 50)
    texts += [words(90_000, 40) + " " + passage, passage + " " + words(95_000, 45), "too short", None, "again " * 80]
    texts += [texts[0], texts[1] + " tail", texts[2].replace("w2030", "other")]
    return [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]


def expected():
    rows = [r for r in fixture() if len(split(r[1])) >= 10 and r[0] != 16]  # 16 is one word again and again
    roots = brute_classes([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    return [(r[0], k if k != r[1] else r[1], r[3]) for r, k in zip(rows, brute_kept([r[1] for r in rows], 35), strict=True)]


def test_run(spark, tmp_path):
    spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    want = expected()
    assert Counter((r.doc_id, r.text, r.source) for r in docs.collect()) == Counter(want)

    sizes, whole = Counter(), Counter()
    for i, t, s in want:
        sizes[s] += len(split(t))
        whole[i] = len(split(t))
    target, owed, weight = {}, 1.5 * sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=True))
    for s in sorted(sizes, key=lambda s: 2 * sizes[s] / weight[s]):
        target[s] = min(2 * sizes[s], owed * weight[s] / sum(weight[o] for o in sizes if o not in target))
        owed -= target[s]

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    got, taken, by_doc = corpus_pipeline.run(spark, str(tmp_path)).collect(), Counter(), Counter()
    texts = {i: t for i, t, _ in want}
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        text = enc.decode(ids)
        assert r.round_trip and r.n_tokens == len(ids) and enc.encode_ordinary(text) == ids
        assert not Counter(split(text)) - Counter(split(texts[r.doc_id]))
        taken[r.source] += len(split(text))
        by_doc[r.doc_id] += len(split(text))
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert all(n <= 2 * whole[i] for i, n in by_doc.items())
