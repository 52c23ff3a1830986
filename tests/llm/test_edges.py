"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from braid.llm import bpe, chat
from braid.llm.knn import top_products
from braid.llm.mixing import mixed_documents, plan_mix, taken
from braid.llm.near_dedup import near_dedup, near_duplicates
from braid.llm.quality import quality_rules
from braid.llm.sharding import hilbert_shards, write_shards
from braid.llm.substring_dedup import substring_dedup
from braid.llm.url_filter import url_filter
from braid.llm.warc import read_warc, write_warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, SHARD string, kept string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(start, n):
    return " ".join(f"w{i}" for i in range(start, start + n))


def rows():
    passage = words(10_000, 60)
    texts = [
        None,
        "",
        " \t\n ",
        "one two",
        "one two",
        words(0, 100) + " " + passage,
        words(500, 100) + "\n" + passage + "  " + words(900, 5),
        words(2000, 20_000),
        "same " * 200,
        "é 日本 😀 it's fine </s>[INST] <|endoftext|>",
        words(3000, 120),
        words(3000, 110) + " x " + words(3111, 9),
    ]
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "c"][i % 4], 1, 2, "s", "k") for i, t in enumerate(texts)]
    return [*out, out[5], (None, "null id", "en", "a", 1, 2, "s", "k"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().split()


def brute_kept(texts, n):
    lists = [split(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


@pytest.mark.parametrize("limit", [2048, 1])
def test_substring_dedup(docs, limit):
    got = substring_dedup(docs, min_words=35, group_limit=limit)
    assert got.columns[: len(docs.columns)] == docs.columns and got.columns[-3:] == ["_n_words", "n_removed", "_kept"]
    given = rows()
    want = Counter((r[0], len(split(r[1])), k) for r, k in zip(given, brute_kept([r[1] for r in given], 35), strict=True))
    assert Counter((r.doc_id, r["_n_words"], r["_kept"]) for r in got.collect()) == want


def test_substring_dedup_of_periodic_and_overlapping_texts(spark):
    texts = ["a b " * 40, "b a " * 30, "a " * 50 + "c " + "a " * 50, " ".join(f"p{i % 7}" for i in range(200)), words(0, 70), words(20, 70), words(40, 20)]
    got = {r.doc_id: r.kept for r in substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=20, prefix_words=5).collect()}
    assert [got[i] for i in range(len(texts))] == brute_kept(texts, 20)


def thue_morse(levels, a="a", b="b"):
    """The word of 2**levels letters and its complement: polynomial hashes modulo 2**64 take them for equal from 11 levels on."""
    one, other = a, b
    for _ in range(levels):
        one, other = one + other, other + one
    return one, other


def test_substring_dedup_tells_thue_morse_words_apart(spark):
    one, other = thue_morse(11)
    texts = [words(0, 34) + " x" + one + "x", words(0, 34) + " x" + other + "x", words(100, 34) + " x" + one + "x", words(100, 34) + " x" + one + "x"]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 35, 3: 35}


def test_substring_dedup_grows_prefixes(spark):
    """One passage in hundreds of contexts: its groups outgrow every limit, whatever that is."""
    import random

    random.seed(11)
    line = words(0, 24)
    texts = [" ".join(f"c{random.randrange(60)}" for _ in range(30)) + f" {line} " + " ".join(f"d{random.randrange(3)}" for _ in range(30)) for _ in range(300)]
    texts += [words(5000 + 10 * i, 20) + " " + words(100, 40) + f" e{i} " + words(100, 36) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(texts, 35)
    for limit in (2, 16, 100, 2048):
        got = {r.doc_id: (r.kept, r.repeats, r.n_words) for r in substring_dedup(df, group_limit=limit).collect()}
        assert [got[i][0] for i in range(len(texts))] == want
        for i, t in enumerate(texts):
            gone = {p for r in got[i][1] for p in range(r["first"], r["first"] + r["words"])}
            assert " ".join(w for p, w in enumerate(t.split()) if p not in gone) == want[i] and got[i][2] == len(t.split())


def test_segments_of_long_texts():
    """A long text in parts has the words, runs, shingles and ids of the whole."""
    import numpy as np
    import pyarrow as pa

    from braid.llm.near_dedup import shingles
    from braid.llm.substring_dedup import _cut, _pack
    from braid.llm.textkernel import segments

    texts = ["a b", " \t ".join(f"w{i % 997}é" for i in range(5000)) + "  ", None, "x" * 9000, " " * 9000, "", "end of all"]
    array = pa.array(texts, pa.large_string())
    got = {}
    for part in segments(array, 3, most_bytes=1000):
        for doc, token in zip(part.words.doc[: part.own].tolist(), part.words.tokens(), strict=False):
            got.setdefault(part.at + doc, []).append(token)
        assert len(part.words.starts) == part.own or not part.last
    assert got == {i: split(t) for i, t in enumerate(texts) if split(t)}
    long = " ".join(f"v{i * i % 100_003}" for i in range(400_000))
    assert len(long) > 1 << 21
    w = long.split()
    ((_, _, _, value, weight),) = shingles(pa.array([long], pa.large_string()), 5)
    assert weight.sum() == 400_000 - 4 and len(value) == len(set(zip(*(w[i:] for i in range(5)), strict=False)))
    spans = pa.array([[int(_pack(a, 3, 0)) for a in (0, 50_000, 50_001, 399_900)]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([long], pa.large_string()), spans], ["c0", "spans"])
    (out,) = _cut(35, 1, 0)(iter([batch]))
    assert out.column(1).to_pylist() == [[{"first": 0, "words": 37}, {"first": 50_000, "words": 38}, {"first": 399_900, "words": 37}]]
    gone = {*range(37), *range(50_000, 50_038), *range(399_900, 399_937)}
    assert out.column("n_removed").to_pylist() == [len(gone)] and out.column("n_words").to_pylist() == [400_000]
    assert out.column("kept").to_pylist() == [" ".join(x for i, x in enumerate(w) if i not in gone)]
    assert np.array_equal(out.column(0).to_pylist()[0], long)


def test_substring_dedup_of_long_texts(spark):
    """Repeats far inside a text of several segments, and across them."""
    import random

    random.seed(2)
    long = [f"u{random.randrange(10**9)}" for _ in range(150_000)]
    passage = long[60_000:60_080]
    texts = [" ".join(long), "short " + " ".join(passage) + " tail", " ".join(long[100_000:100_034])]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_words, got[i].n_removed) for i in range(3)] == [(150_000, 80), (82, 80), (34, 0)]
    assert got[0].kept == " ".join(long[:60_000] + long[60_080:]) and got[1].kept == "short tail"


def jaccard(a, b):
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} or ({tuple(t)} if t else set())
    x, y = grams(split(a)), grams(split(b))
    return len(x & y) / max(1, len(x | y))


def brute_classes(texts):
    n = len(texts)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or jaccard(texts[i], texts[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_near_duplicates(docs):
    given = rows()
    roots = brute_classes([r[1] for r in given])
    least = {}
    for r, c in zip(given, roots, strict=True):
        ids = [x for x in (r[0], least.get(c)) if x is not None]
        least[c] = min(ids) if ids else None
    want = Counter((r[0], least[c]) for r, c in zip(given, roots, strict=True))
    got = near_duplicates(docs)
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == want
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots))


def test_near_dedup_of_null_and_shared_ids(spark):
    texts = [(None, words(0, 30)), (None, words(100, 30)), (7, words(200, 30)), (7, words(300, 30)), (7, words(300, 30))]
    kept = near_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter(set(texts))


def test_near_duplicates_in_mixed_buckets(spark):
    """A chain: neighbours are similar, ends are not; and texts that share a long passage but differ."""
    base = words(0, 150).split()
    texts = []
    for i in range(40):
        own = base[:]
        for j in range(0, i):
            own[3 * j] = f"x{j}"
        texts.append(" ".join(own))
    texts += [words(0, 60) + " " + words(1000 * i, 60) for i in range(1, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, block_members=8).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def in_families(spark, families, **how):
    """The classes of texts whose families share no words, against brute force."""
    df = spark.createDataFrame([(1000 * f + i, t) for f, texts in enumerate(families) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, **how).collect()}
    for f, texts in enumerate(families):
        assert [got[1000 * f + i] for i in range(len(texts))] == [1000 * f + c for c in brute_classes(texts)]


def test_near_duplicates_of_short_texts_in_mixed_buckets(spark):
    """Pairs at similarity 0.8 of 4 and 8 common shingles; buckets of one register mix them with texts that share the passage only."""
    families = []
    for f in range(60):
        n = 12 if f % 2 else 8
        base = words(100 * f, n)
        pair = [base + " left", base + " right"] if f % 2 else [base, base + " more"]
        families.append([*pair, *(base + " " + words(100_000 + 1000 * f + 10 * k, 5) for k in range(20))])
    in_families(spark, families, bands=5, rows=1)


def test_near_duplicates_that_differ_in_repeats(spark):
    """A line once, and many times: the sets of shingles are alike, their counts are not."""
    families = []
    for f in range(8):
        body, line = words(1000 * f, 200), words(1000 * f + 500, 12)
        families.append([f"{body} {line}", body + f" {line}" * 40, body + f" {line}" * 90, words(1000 * f, 120) + " " + words(1000 * f + 700, 60)])
    in_families(spark, families)


def test_mix(docs):
    given = rows()
    mixed = plan_mix(docs, block_words=64)
    got = taken(mixed).collect()
    total = sum(len(split(r[1])) for r in given)
    assert len(got) == len(given)
    assert sum(s.target for s in mixed.shares) == pytest.approx(1.5 * total)
    by = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"]
        by[r.source] += r.taken
    for s in mixed.shares:
        assert s.target <= 2 * s.size + 1e-6 and abs(by[s.source] - s.target) <= 1
    again = taken(plan_mix(docs.repartition(7), block_words=64)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixed_documents(docs, block_words=64)
    assert out.columns == docs.columns
    words_out = Counter()
    for r in out.collect():
        words_out[r.source] += len(split(r.text))
    assert words_out == Counter({k: v for k, v in by.items() if v})


def brute_mix(rows, block_words, shard_slots, seed=1):
    """The mix in plain Python, from the hash order of (id, text, source) up: words taken by row, and the slots."""
    import math

    import numpy as np

    from braid.llm.mixing import permuted, shard_draws

    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(split(r["text"])) for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, owed, free = {}, 1.5 * sum(sizes.values()), set(sources)
    while True:  # share, fix what is above its bound, share the rest again
        over = [s for s in free if owed * weight[s] / sum(weight[o] for o in free) > 2 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        owed, free = owed - sum(2.0 * sizes[s] for s in over), free - set(over)
    target |= {s: owed * weight[s] / sum(weight[o] for o in free) for s in free}
    taken, slots = Counter(), []
    by_order = sorted(rows, key=lambda r: (r["order"], r["n"]))
    streams = {s: [r["n"] for r in by_order if r["source"] == s for _ in split(r["text"])] for s in sources}
    for place, s in enumerate(sources):
        stream, left, own, turn = streams[s], round(target[s]), 0, 0
        blocks = [stream[a : a + block_words] for a in range(0, len(stream), block_words)]
        while left > 0:
            for b in permuted(np.arange(len(blocks)), len(blocks), (seed * 1_000_003 + place) * 64 + turn).tolist():
                for i in blocks[b][:left]:
                    taken[i] += 1
                own, left = own + 1, left - len(blocks[b][:left])
                if left <= 0:
                    break
            turn += 1
        slots.append(own)
    shards = math.ceil(sum(slots) / shard_slots)
    drawn = [shard_draws(tuple(slots), shard_slots, seed)(i) for i in range(shards)]
    return target, taken, slots, drawn


def test_mix_against_brute_force(spark):
    import random

    random.seed(9)
    texts = [" ".join(f"m{random.randrange(50)}" for _ in range(random.choice([0, 1, 7, 40, 300]))) for _ in range(150)]
    given = [(i % 60, t, random.choice(["a", "b", "c", "d", None])) for i, t in enumerate(texts)] + [(1, None, "a"), (2, "x y", "e"), (2, "x y", "e")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string").coalesce(1)
    orders = df.select("doc_id", "text", "source", F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), "text", "source").alias("order")).collect()
    rows = [r.asDict() | {"n": n} for n, r in enumerate(orders)]
    target, want, slots, drawn = brute_mix(rows, 16, 32)
    got = taken(plan_mix(df.repartition(5), block_words=16, shard_slots=32)).collect()
    assert sum(r.taken for r in got) == sum(want.values()) == sum(map(round, target.values()))
    assert all(r.target == pytest.approx(target[r.source]) for r in got)
    assert Counter((r.id, r.source, r["size"], r.taken) for r in got) == Counter((r["doc_id"], r["source"], len(split(r["text"])), want[r["n"]]) for r in rows)
    # every slot is dealt once, shards are full but the last, and their draws follow each other
    assert [sum(c[i] for _, c in drawn) for i in range(len(slots))] == slots
    assert all(sum(c) == 32 for _, c in drawn[:-1])
    assert all(tuple(a + b for a, b in zip(*drawn[i], strict=True)) == drawn[i + 1][0] for i in range(len(drawn) - 1))


def test_mix_of_long_texts(spark):
    long = " ".join(f"n{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, long, "a"), (2, "  b  c ", "b"), (3, words(0, 1000), "b")], "doc_id long, text string, source string")
    by = Counter()
    for r in mixed_documents(df, block_words=512).collect():
        own = r.text.split()
        assert r.text == long if len(own) == 150_000 else set(own) <= set(long.split()) | set(words(0, 1000).split()) | {"b", "c"}
        by[r.doc_id] += len(own)
    assert by == Counter({r.id: r.taken for r in taken(plan_mix(df, block_words=512)).collect()})


def test_near_duplicates_recall(spark):
    """Variants of long texts at similarities from 0.8 up: at least 0.9 of the pairs at the threshold are found, and none below it alone."""
    import random

    random.seed(12)
    families, pairs = [], 0
    for f in range(120):
        base = [f"r{f}x{i}" for i in range(random.choice([30, 120, 400]))]
        own = base[:]
        edits = max(1, int(len(base) * random.choice([0.005, 0.012, 0.02])))
        for at in random.sample(range(len(base)), edits):
            own[at] = f"e{f}x{at}"
        families.append([" ".join(base), " ".join(own)])
    df = spark.createDataFrame([(10 * f + i, t) for f, texts in enumerate(families) for i, t in enumerate(texts)], "doc_id long, text string")
    got, found = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}, 0
    for f, (a, b) in enumerate(families):
        near = jaccard(a, b) >= 0.8
        pairs += near
        found += near and got[10 * f] == got[10 * f + 1]
        assert near or got[10 * f] != got[10 * f + 1]
    assert pairs > 40 and found >= 0.9 * pairs


def test_near_duplicates_of_a_large_family_with_strays(spark):
    """Members of one bucket: hundreds linked, a few strays that reach them through one member only."""
    base = words(0, 400).split()
    texts = [" ".join([*base[:-1], f"v{i}"]) for i in range(300)]
    for i in range(6):  # each like variant i with more changes, below the threshold to the base
        own = texts[i].split()
        for at in range(0, 40):
            own[7 * at + i] = f"s{i}x{at}" if at < 6 + i else own[7 * at + i]
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts)
    for most in (2048, 16):
        got = {r.doc_id: r.class_id for r in near_duplicates(df, block_members=most).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs.select("text", "doc_id", "n_words"), RANKS, offsets=True)
    import numpy as np

    for r in bpe.decode(got, RANKS).collect():
        text = r.text or ""
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert ids.tolist() == enc.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        places = np.frombuffer(r.offsets, dtype="<u4").reshape(-1, 2)
        assert len(places) == len(ids)
        for i, (a, b) in zip(ids.tolist()[:300], places.tolist()[:300], strict=True):
            piece = enc.decode_single_token_bytes(i)
            assert piece in text[a:b].encode() and b > a
    one = {(r.doc_id, r.n_tokens, bytes(r.decoded)) for r in bpe.round_trip(docs.select("text", "doc_id"), RANKS).collect()}
    assert one == {(r[0], len(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows()}


def test_bpe_pieces_against_tiktoken(spark):
    import random

    random.seed(7)
    some = ["a", "aa", " ", "  ", "'", "'s", "'re", "'ll", "re", "\n", "\t", "é", "日本", "0", ".", "!!", "　", "😀", "\r\n", "x"]
    texts = ["".join(random.choice(some) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    got = bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), RANKS)
    for r in got.collect():
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == enc.encode_ordinary(r.text)


def test_bpe_tells_thue_morse_pieces_apart_and_cuts_long_texts(spark):
    import random

    import numpy as np

    random.seed(4)
    one, other = thue_morse(11)
    some = ["word", "it's", "  two", "é", "日本 ", "\n\n", "12", "!?", " x"]
    long = "".join(random.choice(some) + random.choice(["", " "]) for _ in range(400_000))
    texts = [f"x{one}x", f"x{other}x", f"x{one}x", "y" * 700_000, " " * 700_000 + "z", long]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in bpe.round_trip(spark.createDataFrame([(t,) for t in texts], "text string").repartition(1), RANKS).collect():
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == enc.encode_ordinary(r.text)
        assert bytes(r.decoded) == r.text.encode()


def test_hilbert_shards(docs):
    got = hilbert_shards(docs, shards=4).collect()
    assert len(got) == len(rows())
    slots, text_shards = {}, {}
    for r in got:
        t = r.text or ""
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        slots.setdefault(r["_shard"], []).append(r.slot)
        text_shards.setdefault(t, set()).add(r["_shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in text_shards.values())


def test_hilbert_curve_is_a_walk():
    """Every cell once, each step to a neighbour."""
    import numpy as np

    from braid.llm.sharding import hilbert_index

    cells = np.stack(np.meshgrid(*[np.arange(16)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = hilbert_index(cells, 4)
    assert sorted(place.tolist()) == list(range(16**3))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_written(spark, tmp_path):
    given = [(i, f"text {i} " + "x" * (i * 37 % 400), "ab"[i % 2], "en") for i in range(2000)] + [(5000 + i, "one copy", "a", "en") for i in range(300)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, lang string")
    done = hilbert_shards(df, shards=8)
    rows = done.collect()
    size, slots = Counter(), {}
    for r in rows:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(n - mean) <= 300 * 9 + 400 for n in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    write_shards(done, f"file://{tmp_path}/shards", files_each=2)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in rows)
    write_shards(hilbert_shards(df.limit(0)), f"file://{tmp_path}/none")


def test_quality(spark, docs):
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (None, 1, 0), (5, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels)
    assert got.columns[: len(docs.columns)] == docs.columns
    for r in got.collect():
        w = split(r.text)
        assert r["_n_words"] == len(w)
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))
        assert r["_kept"] == (not r.base_failed)  # too few labels: no cutoff is certified


def test_quality_cutoffs_hold_their_risk(spark):
    good = [(i, " ".join(f"word{(i * 31 + j) % 997}" for j in range(40)), "en") for i in range(2000)]
    bad = [(10_000 + i, " ".join(f"#$%{j}***" for j in range(40)), "en") for i in range(200)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 10_000)) for r in [*good, *bad]], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()}
    assert all(got[r[0]] for r in good) and not any(got[r[0]] for r in bad)


def test_clashing_names(spark):
    """Columns named like those that the operators use on the way."""
    names = "cut_symbols long, cut_long_words long, braid_parts long, b_parts long, b_row long, row long, span long, spans long, key long, component long, n long, size long, shard long, class_id long, repeats long, stratum long, good long, b_id long"
    df = spark.createDataFrame([(i, words(i, 40), "en", "a", *range(18)) for i in range(5)], f"doc_id long, text string, lang string, source string, {names}")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for make in (lambda: quality_rules(df, labels), lambda: mixed_documents(df), lambda: substring_dedup(df), lambda: near_duplicates(df), lambda: hilbert_shards(df), lambda: bpe.round_trip(df, RANKS)):
        out = make()
        assert out.columns[: len(df.columns)] == df.columns and {r["cut_symbols"] for r in out.collect()} == {0}


def binomial_tail(n, k, p):
    from math import exp, fsum, lgamma, log, log1p

    return fsum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1))


def test_binomial_tail(spark):
    from math import comb

    from braid.llm.quality import chance_at_most

    for n, k, p in ((50, 0, 0.05), (200, 3, 0.05), (1000, 20, 0.05), (30, 29, 0.5), (15, 1, 0.2), (16, 2, 0.3), (20_000, 150, 0.01), (3_000, 0, 0.01), (100_000, 990, 0.01)):
        row = spark.range(1).select(chance_at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("c")).first()
        from fractions import Fraction

        chance = Fraction(p)
        want = 1.0 if k >= n * p else float(sum(comb(n, i) * chance**i * (1 - chance) ** (n - i) for i in range(k + 1))) if n < 2000 else binomial_tail(n, k, p)
        assert row.c == pytest.approx(want, rel=1e-9 if n < 2000 else 1e-7)


def test_knn(spark):
    import random

    random.seed(3)
    given = [(i, [random.uniform(-1, 1) for _ in range(8)]) for i in range(0, 400)]
    given += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (800, [0.5] * 8), (801, [0.5] * 8), (900, [0.25] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in given], "vec_id long, embedding array<double>, score string")
    import math

    ok = {i: [math.floor(1024 * x) for x in v] for i, v in given if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in ok if i % 100 == 0):
        all_scores = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q))[:10]
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(all_scores, 1)}
    for blocks in ({}, {"data_block": 16, "query_block": 2, "pivots": 5}):
        got = top_products(df, "vec_id % 100 = 0", **blocks).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want


def test_warc(spark, tmp_path):
    given = [(1, "http://a/\r\nx: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (None, "http://d", "only"), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (6, "u", "x" * 300_000)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in given], "page_id long, url string, html string, payload string")
    manifest = write_warc(df, folder=f"file://{tmp_path}/warc", archive_bytes=200_000)
    got = read_warc(manifest).collect()
    top = {}
    for i, _, h in given:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in given:
        raw = (h or "").encode()
        first = i is None and top[h or ""] == -1 or i == top[h or ""]
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""])] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in given}


def test_warc_files(spark, tmp_path):
    """Archives open with a dictionary in a skippable frame, and each record is a frame that the dictionary alone decodes."""
    import zstandard

    given = [(i, f"http://h/{i}", f"<p>{'same words again ' * 20}{i}</p>") for i in range(300)] + [(1000, None, None)]
    manifest = write_warc(spark.createDataFrame(given, "page_id long, url string, html string").coalesce(1), folder=f"file://{tmp_path}/w", archive_bytes=20_000).collect()
    assert sum(r.records for r in manifest) == 301 and len(manifest) > 1
    bodies = 0
    for r in manifest:
        raw = open(r.archive.removeprefix("file://"), "rb").read()
        assert raw[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(raw[4:8], "little")
        unpack, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])), 8 + size
        for _ in range(r.records):
            one = unpack.decompressobj()
            record = one.decompress(raw[at:])
            at = len(raw) - len(one.unused_data)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            bodies += b"same words again" in record
        assert at == len(raw)
    assert bodies == 300


def test_url_filter(spark):
    pages = [(i, f"https://good.example/en/{i}.html") for i in range(60)] + [(100 + i, f"http://Bad.Example/spam/{i}?q=1#x") for i in range(60)]
    pages += [(300, None), (301, "no scheme/x"), (302, "http://a.net"), (303, "http://a.net/"), (304, "https://x.example.net/en/1"), (305, "https://y.example.com/de/2"), (306, "ftp://b.org/fr/"), (307, "http://notnet/x")]
    df = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    labels = spark.createDataFrame([(u, int("Bad" in u)) for i, u in pages[:120] if i % 2 == 0] + [(None, 1), ("http://a.net", None)], "url string, bad int")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    got = {r.page_id: r for r in url_filter(df, labels, rules).collect()}
    assert len(got) == len(pages)
    assert all(got[i].verdict == "allow" for i in range(60)) and all(got[100 + i].verdict == "block" for i in range(60))
    assert got[5].template == "/en/*" and got[100]["_host"] == "bad.example"
    want = {300: ("", "", None), 301: ("", "", None), 302: ("a.net", "", None), 303: ("a.net", "/", "net/"), 304: ("x.example.net", "/en/1", "example.net/en/"), 305: ("y.example.com", "/de/2", "example.com/de/"), 306: ("b.org", "/fr/", "org/fr/"), 307: ("notnet", "/x", None)}
    assert {i: (got[i]["_host"], got[i].path, got[i].rule) for i in want} == want
    assert got[304].verdict == "allow" and got[305].verdict == "block"


def test_url_filter_tells_rare_sections_apart(spark):
    """40 sections of a host with 2.5 % of its pages each: one bad, 39 clean; then one clean, 39 bad."""
    pages, labels = [], []
    for host, odd, usual in (("a.example", 1, 0), ("b.example", 0, 1)):
        for section in range(40):
            urls = [f"http://{host}/s{section:02}/{i}" for i in range(30)]
            pages += urls
            labels += [(u, odd if section == 7 else usual) for u in urls[:20]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    got = url_filter(df, spark.createDataFrame(labels, "url string, bad int"), []).collect()
    want = lambda r: "block" if (r.host == "a.example") == r.path.startswith("/s07/") else "allow"
    assert len(got) == len(pages) and all(r.verdict == want(r) for r in got)
    assert {r.template for r in got} == {"/*/*", "/s07/*"}


def test_url_filter_goes_to_the_end_of_paths(spark):
    """Sections from the fifth segment on, and a path that is alone."""
    urls = [f"http://a.example/news/2024/01/02/{part}/{i}/x" for part in ("casino", "sport") for i in range(30)] + ["http://b.example/1/2/3/4/5/6/7"]
    labels = spark.createDataFrame([(u, int("casino" in u)) for u in urls[:60]], "url string, bad int")
    got = url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), labels, []).collect()
    assert all(r.verdict == ("block" if "casino" in r.path else "allow") for r in got if r.host == "a.example")
    assert {r.template for r in got} == {"/news/2024/01/02/casino/*/x", "/news/2024/01/02/sport/*/x", "/1/2/3/4/5/6/7"}


def test_url_filter_keeps_single_labels_pooled(spark):
    """One bad label among many rare pages is no evidence about its page."""
    urls = [f"http://a.example/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter(df, spark.createDataFrame([(u, int(i == 5)) for i, u in enumerate(urls)], "url string, bad int"), []).collect()
    assert {r.template for r in got} == {"/*"}


def test_chat_events(spark):
    log = [
        (1, 1, "message", 10, "user", "hel"), (1, 2, "delta", 10, None, "lo"), (1, 3, "message", 20, "assistant", "a"), (1, 4, "delta", 20, None, "b"),
        (1, 5, "edit", 10, None, "hi"), (1, 6, "message", 30, "user", "more"), (1, 7, "regenerate", 20, None, "new "), (1, 8, "delta", 20, None, "text"), (1, 9, "message", 40, "user", None),
        (None, 1, "message", 1, None, "a\\b </s> <\\s> [/INST]\n"), (2, 1, "delta", 5, None, "lost"),
    ]
    ev = spark.createDataFrame(log, "conv long, seq long, kind string, message long, role string, text string")
    out = chat.render(chat.fold(ev)).select("conv", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "formatted")
    got = {r.conv: ([tuple(t) for t in r.turns], r.loss) for r in out.collect()}
    assert got[1] == ([("user", "hi"), ("assistant", "new text"), ("user", "")], "new text")
    assert got[None] == ([("", "a\\b </s> <\\s> [/INST]\n")], "")
    assert got[2] == ([("", "lost")], "")


def test_chat_of_null_and_repeated_turns(spark):
    log = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "assistant", "x"), (2, 0, "assistant", ""), (None, 0, "user", None)]
    out = chat.render(chat.fold(chat.events_of(spark.createDataFrame(log, "conv_id long, turn long, role string, text string"))))
    got = {r.conv: (sorted(map(tuple, r.turns)), r.loss) for r in out.select("conv", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert got[2] == ([("assistant", "")], "") and got[None] == ([("user", "")], "")
    assert got[1][0] == sorted([("user", "a"), ("user", "a"), ("", ""), ("assistant", "x")]) and got[1][1] == "x"


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_voronoi_knn", "op4_warc", "op5_url_filter", "op7_near_duplicates", "op8_hilbert_shards", "op9_chat_format", "op10_quality_rules"])
def test_queries_against_sql(spark, name):
    import duckdb

    from braid.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    result = con.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(result.fetchall())


@pytest.mark.parametrize(
    "make",
    [
        lambda d, s: substring_dedup(d),
        lambda d, s: near_duplicates(d),
        lambda d, s: near_dedup(d),
        lambda d, s: taken(plan_mix(d)),
        lambda d, s: mixed_documents(d),
        lambda d, s: bpe.round_trip(d, RANKS),
        lambda d, s: hilbert_shards(d),
        lambda d, s: quality_rules(d, s.createDataFrame([], "doc_id long, quality int")),
        lambda d, s: top_products(s.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0"),
        lambda d, s: read_warc(write_warc(s.createDataFrame([], "page_id long, url string, html string"))),
        lambda d, s: url_filter(s.createDataFrame([], "page_id long, url string"), s.createDataFrame([], "url string, bad int"), []),
        lambda d, s: chat.render(chat.fold(chat.events_of(s.createDataFrame([], "conv_id long, turn long, role string, text string")))),
    ],
)
def test_empty_tables(spark, none, make):
    assert make(none, spark).count() == 0


def test_components(spark):
    import random

    from braid.llm.components import components

    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 501 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
