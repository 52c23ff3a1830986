"""Near-duplicate classes by ProbMinHash, banding and verification.

Every text is a weighted set of shingles of five words; a shingle's weight is how
often the text holds it. ProbMinHash gives each shingle a Poisson process of
arrivals whose rate is its weight, on a clock that depends on the shingle alone; each
arrival hits a random register, which keeps its first. A shingle's process ends
once its next arrival is later than every register's, so the work is near the
number of shingles plus m log m. Two texts agree in a register with the
probability Jaccard similarity of their weights. A text that repeats a shingle has a
second sketch in which every weight is 1, as the first one is for other texts, so that texts
that differ in repeats alone meet by the similarity of their sets.

Texts that agree in all registers of a band meet in a bucket. A bucket links its
members to its least member only, never all to all, and each link is verified by
the Jaccard similarity of the two shingle sets. In buckets that still hold more than one
component the rest is found by prefix filtering, which is exact: of two sets of similarity t each has a
shingle of the other among its first n - ceil(t n) + 1, the rarest first. Texts whose rarest
shingles meet no other component are done; that ends buckets of texts that share a common passage.
Of what is left of a bucket, the texts outside its largest component are compared with all texts outside
their own, block by block, by the number of shingles that two texts share. What passes is verified like the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from ..tables import fresh_names, written
from .textkernel import Ranges, Words, mix, segments

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 7  # of texts at similarity 0.8, one pair in 80,000 shares no band
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 19  # of a block of a bucket, on the average


def _distinct(doc: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by text and value, those of one text and value as one with their weights' sum."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], value[heads], np.add.reduceat(weight[order], heads) if len(heads) else weight


def _some_shingles(words: Words, own: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of the shingles that start at the first ``own`` words."""
    hashes, _ = words.hashes()
    ranges = Ranges(hashes, size)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    at = np.flatnonzero(words.doc[: max(0, len(hashes) - size + 1)] == words.doc[size - 1 :])[:own] if len(hashes) >= size else np.zeros(0, dtype=np.int64)
    at = at[at < own]
    start, length = np.append(at, words.first[short]), np.append(np.full(len(at), size), n[short])
    doc, value = words.doc[start], ranges.of(start, length)
    return _distinct(doc, value, np.ones(len(doc), dtype=np.int64))


def shingles(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, text, shingle hash, weight), the last three sorted, for runs of ``texts``.

    A text of fewer words than ``size`` is one shingle, a text without words none. A long
    text's shingles are gathered part by part.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in segments(texts, size - 1):
        if part.whole:
            yield part.at, part.to, *_some_shingles(part.words, part.own, size)
            continue
        if len(part.words.starts) >= size:  # a last part of fewer words has no shingle of its own
            held.append(_some_shingles(part.words, part.own, size))
        if part.last:
            yield part.at, part.to, *_distinct(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The element that holds each of ``m`` registers of each text; rows of texts without elements are meaningless."""
    first = np.full(n_docs * m, np.inf)
    holder = np.zeros(n_docs * m, dtype=np.uint64)
    live, clock, step = np.arange(len(doc)), np.zeros(len(doc)), 0
    while len(live):
        points = 1 if len(live) > 8192 else 16
        lap = np.arange(step, step + points, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        random = mix(value[live][:, None] + lap)
        wait = -np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[live][:, None]
        arrival = clock[live][:, None] + np.cumsum(wait, axis=1)
        register = ((mix(random) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        place = (doc[live][:, None] * m + register.astype(np.int64)).ravel()
        arrived, who = arrival.ravel(), np.repeat(live, points)
        np.minimum.at(first, place, arrived)
        won = arrived == first[place]
        holder[place[won]] = value[who[won]]
        clock[live] = arrival[:, -1]
        latest = first.reshape(n_docs, m).max(axis=1)
        live = live[clock[live] < latest[doc[live]]]
        step += points
    return holder.reshape(n_docs, m)


def registers_of(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """:func:`prob_minhash` of texts sorted by place, a bounded number of registers at a time."""
    step = max(1, (1 << 19) // m)
    out = np.empty((n_docs, m), dtype=np.uint64)
    for at in range(0, n_docs, step):
        to = min(at + step, n_docs)
        a, b = np.searchsorted(doc, (at, to))
        out[at:to] = prob_minhash(doc[a:b] - at, value[a:b], weight[a:b].astype(np.float64), to - at, m)
    return out


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    odd = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((registers.reshape(-1, bands, rows) * odd).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _sketch(size: int, bands: int, rows: int):
    """(node, text) to (node, n, keys, low): shingles, the text's bucket in each band, and the low halves of these, packed.

    A text that repeats a shingle has two buckets in each band, of both its sketches; those of weights 1 come first.
    A task sketches copies once. Texts without words have no row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for row, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(row)
            batch = batch.take(pa.array(new, pa.int64()))
            for at, _, doc, value, weight in shingles(batch.column(1), size):
                some, n = np.unique(doc, return_counts=True)
                if not len(some):
                    continue
                local = np.searchsorted(some, doc)
                once = band_keys(registers_of(local, value, np.ones(len(value)), len(some), bands * rows), bands, rows)
                again = np.unique(local[weight > 1])
                own = np.isin(local, again)
                by_count = band_keys(registers_of(np.searchsorted(again, local[own]), value[own], weight[own], len(again), bands * rows), bands, rows)
                order = np.argsort(np.append(np.arange(len(some)), again), kind="stable")
                keys = np.concatenate((once, by_count))[order]
                ends = np.append(0, np.cumsum(1 + np.isin(np.arange(len(some)), again)))
                lists = pa.ListArray.from_arrays(pa.array((ends * bands).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                low = pa.array([keys[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + at)), pa.array(n), lists, low], ["node", "n", "keys", "low"])

    return work


def _values(size: int):
    """(node, text) to (node, values): the text's shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, doc, value, _ in shingles(batch.column(1), size):
                ends = np.searchsorted(doc, np.arange(to - at + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))], ["node", "values"])

    return work


def _near_others(nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of ``nodes`` (node, component, n), those whose prefix meets one of another component."""
    found = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(_values(size), "node binary, values array<long>")
    rows = written(found.select("node", F.explode("values").alias("value")), "shingles")
    often = written(rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    shared = written(rows.join(often, "value"), "shared-shingles").join(nodes, "node")
    own = Window.partitionBy("node")  # the shingles of one text
    ranked = shared.withColumns({"place": F.row_number().over(own.orderBy("df", "value")), "common": F.count("*").over(own)})
    # shingles that no other text has come first, and meet none
    first = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1 - (F.col("n") - F.col("common"))
    prefix = written(ranked.where(F.col("place") <= first).select("value", "node", "component"), "prefixes")
    meet = written(prefix.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value"), "meeting-shingles")
    return prefix.join(meet, "value").select("node").distinct()


def _sets(size: int):
    """(node, text) to (node, held): the low halves of the text's shingles, sorted. Two texts share at least as many of these as shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, doc, value, _ in shingles(batch.column(1), size):
                ends = np.searchsorted(doc, np.arange(to - at + 1)).tolist()
                held = [np.sort(value[a:b].astype("<u4")).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(held, pa.binary())], ["node", "held"])

    return work


def _verify(size: int, similarity: float):
    """(u, v, text of u, text of v) to the (u, v) whose sets of shingles are similar; texts without words are not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = shingles(batch.column(3), size)
            have, to_right = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)), 0
            for at, to, a, x, _ in shingles(batch.column(2), size):
                # the right texts come in slices of their own: gather those up to ``to``
                parts = [have]
                while to_right < to:
                    begin, to_right, b, y, _ = next(right)
                    parts.append((b + begin, y))
                b, y = (np.concatenate(c) for c in zip(*parts, strict=True))
                cut = np.searchsorted(b, to)
                have, b, y = (b[cut:], y[cut:]), b[:cut] - at, y[:cut]
                pair, value = np.concatenate((a, b)), np.concatenate((x, y))
                order = np.lexsort((value, pair))
                pair, value = pair[order], value[order]
                both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=to - at)
                either = np.bincount(pair, minlength=to - at) - both
                rows = pa.array(np.flatnonzero((both > 0) & (both / np.maximum(either, 1) >= similarity)) + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["u", "v"])

    return work


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    return joined.mapInArrow(_verify(size, similarity), "u binary, v binary")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, with the groups' bounds; a group stays in memory until its end."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for name in names:
            own = table.column(name).to_numpy()
            new[1:] |= own[1:] != own[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        heads = cut(table)
        if len(heads) > 1:
            yield table.slice(0, heads[-1]), heads
        held = table.slice(heads[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(cut(table), table.num_rows)


def _in_common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements each of the sets ``x`` shares with each of the sets ``y``; repeats within a set count once."""

    def held(value: np.ndarray, row: np.ndarray, n: int, part: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(part, value), len(part) - 1)
        hit = part[place] == value
        out = np.zeros((n, len(part)), dtype=np.float32)
        out[row[hit], place[hit]] = 1
        return out

    def flat(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([sets[i] for i in at]), np.repeat(np.arange(len(at)), [len(sets[i]) for i in at])

    (u, left), (v, right) = flat(x), flat(y)
    both = np.intersect1d(u, v)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for at in range(0, len(both), 2048):
        part = both[at : at + 2048]
        out += held(u, left, len(x), part) @ held(v, right, len(y), part).T
    return out


def _first_shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The low half of a bucket in the first band that each pair of texts shares, by any of their sketches; (pair, sketch, band) each."""
    equal = p[:, :, None, :] == q[:, None, :, :]
    band = equal.any(axis=(1, 2)).argmax(axis=1)
    row = np.arange(len(p))
    shared = equal[row, :, :, band].any(axis=2)
    return np.where(shared, p[row, :, band], np.uint32(0xFFFFFFFF)).min(axis=1)


def _alike(similarity: float, bands: int):
    """Members of buckets, in blocks, to the pairs of different components that may be similar.

    A pair passes if its texts share enough (halves of) shingles for their numbers. It comes out of
    one bucket only: that of the first band that its texts share.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_groups(batches, ["key", "i", "j"]):
            block, i, j, component, n = (table.column(c).to_numpy() for c in ("block", "i", "j", "component", "n"))
            # the two sketches of a text without repeats are one
            low = np.frombuffer(b"".join(b if len(b) == 8 * bands else b + b for b in table.column("low").to_pylist()), dtype="<u4").reshape(-1, 2, bands)
            own = table.column("key").to_numpy().view(np.uint64).astype(np.uint32)
            sets = [np.frombuffer(b, dtype="<u4") for b in table.column("held").to_pylist()]
            left, right = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                same = i[a] == j[a]
                x = np.arange(a, b) if same else a + np.flatnonzero(block[a:b] == i[a])
                y = x if same else a + np.flatnonzero(block[a:b] == j[a])
                if not len(x) or not len(y):
                    continue
                step = max(1, (1 << 20) // len(y))
                for at in range(0, len(x), step):
                    some = x[at : at + step]
                    both = _in_common(sets, some, y)
                    ok = both >= similarity / (1 + similarity) * (n[some][:, None] + n[y][None, :]) - 0.01  # what passes is verified
                    ok &= component[some][:, None] != component[y][None, :]
                    if same:
                        ok &= some[:, None] < y[None, :]
                    p, q = np.nonzero(ok)
                    p, q = some[p], y[q]
                    here = _first_shared(low[p], low[q]) == own[a]
                    left += p[here].tolist()
                    right += q[here].tolist()
            node = table.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(left, pa.int64())), node.take(pa.array(right, pa.int64()))], ["u", "v"])

    return work


def _blocks(n: str, members: str, most: int) -> Column:
    """How many blocks so many shingles and members take."""
    return F.greatest(F.ceil(F.col(n) / BLOCK_SHINGLES), F.ceil(F.col(members) / most)).cast("int")


def _rest(buckets: DataFrame, sketches: DataFrame, linked: DataFrame, texts: DataFrame, tried: DataFrame, size: int, similarity: float, bands: int, most: int) -> DataFrame:
    """Links inside buckets that hold several components, whatever the bucket's size.

    Texts of the bucket's largest component are compared with those of its other components only,
    so a large group with few strays costs its size times theirs.
    """
    about = sketches.select("node", "n", "low").join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    member = buckets.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")).join(about.select("node", "n"), "node")
    member = written(member.select("key", "node", "component", "n"), "members")
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    nodes = written(member.join(written(mixed, "mixed"), "key").select("node", "component", "n").distinct(), "mixed-nodes")
    live = written(_near_others(nodes, texts, size, similarity), "near-others")
    member = written(member.join(live, "node", "left_semi"), "members")
    parts = member.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "component", "members")).alias("major"), F.sum("n").alias("all_n"), F.sum("members").alias("all_members")).where(F.col("all_members") > F.col("major.members"))
    mixed = mixed.withColumns({"minor_n": F.col("all_n") - F.col("major.n"), "minor_members": F.col("all_members") - F.col("major.members")})
    mixed = mixed.select("key", F.col("major.component").alias("major"), _blocks("minor_n", "minor_members", most).alias("minors"), _blocks("major.n", "major.members", most).alias("majors"))
    left = written(member.join(written(mixed, "mixed"), "key"), "mixed-buckets")
    some = left.select("node").distinct()
    held = written(texts.join(some, "node", "left_semi").select("node", "text").mapInArrow(_sets(size), "node binary, held binary").join(about.select("node", "low"), "node"), "shingle-sets")
    minor = F.col("component") != F.col("major")
    dealt = F.pmod(F.xxhash64("node"), F.when(minor, F.col("minors")).otherwise(F.col("majors"))).cast("int")
    rows = left.withColumn("block", F.when(minor, dealt).otherwise(F.col("minors") + dealt))
    # a text of a minor component meets every block, one of the major component the minor blocks
    meets = F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.join(held, "node").select("key", "i", "j", "block", "node", F.xxhash64("component").alias("component"), "n", "held", "low")
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_alike(similarity, bands), "u binary, v binary")
    pairs = alike.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return _verified(pairs.join(tried, ["u", "v"], "left_anti"), texts, size, similarity)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    block_members: int = BLOCK_MEMBERS,
) -> DataFrame:
    """``docs`` with column ``class_id``: the least id of the texts linked to the row's text, over any number of links.

    Equal texts are one class; a null text counts as empty. Texts of fewer words than
    a shingle are one shingle; texts without words match equal texts only. Ties cannot
    occur, since a class is named by its least id; a null id is no name, so a class of
    null ids has a null ``class_id``. Repeated rows are kept, in one class. Other columns
    pass through; if ``class_id`` is taken, the new column is ``_class_id``.
    """
    classed, _, component = _classed(docs, id_col, text_col, shingle_words, similarity, bands, rows, block_members)
    return classed.drop(component)


def _classed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    block_members: int = BLOCK_MEMBERS,
) -> tuple[DataFrame, str, str]:
    """``docs`` with the class id and the component, and these columns' names."""
    node, name, component = fresh_names(docs, "braid_node", "class_id", "braid_component")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(node, F.unhex(F.md5(text)))
    plain = keyed.select(F.col(node).alias("node"), F.col(id_col).alias("id"), text.alias("text"))
    nodes = plain.groupBy("node").agg(F.min("id").alias("id"))

    sketches = written(plain.select("node", "text").mapInArrow(_sketch(shingle_words, bands, rows), "node binary, n long, keys array<long>, low binary"), "sketches")
    entries = sketches.select("node", F.explode("keys").alias("key"))
    # copies have equal sketches: the first aggregate takes together those that tasks have left
    buckets = entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    buckets = written(buckets, "bucket-heads")  # Spark splits the join of a hot bucket only between plain shuffles
    members = written(written(entries.join(buckets, "key"), "entries").distinct(), "buckets")
    pairs = members.where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    pairs = written(pairs, "pairs")
    met = members.select("node").distinct().join(nodes, "node")
    texts = plain.alias("p").join(met.alias("m"), (F.col("p.node") == F.col("m.node")) & F.col("p.id").eqNullSafe(F.col("m.id"))).select("p.node", "p.text")
    texts = written(texts.dropDuplicates(["node"]), "texts")

    edges = written(_verified(pairs, texts, shingle_words, similarity), "links")
    linked = components(edges)
    more = written(_rest(members.select("key", "node"), sketches, linked, texts, pairs, shingle_words, similarity, bands, block_members), "links")
    if not more.isEmpty():
        linked = components(edges.union(more))
    linked = written(nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    least = written(linked.groupBy("component").agg(F.min("id").alias("class")), "components")
    classes = linked.select("node", "component").join(least, "component").select(F.col("node").alias(node), F.col("class").alias(name), F.col("component").alias(component))
    return keyed.join(written(classes, "classes"), node).drop(node), name, component


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class of :func:`near_duplicates`: that with the least id (of equal rows, one; of a class of null ids, one). The columns are those of ``docs``."""
    classed, name, component = _classed(docs, id_col, text_col, **how)
    stays = classed.where(F.col(id_col).eqNullSafe(F.col(name)))
    if not stays.groupBy(component).count().where("count > 1").isEmpty():
        stays = stays.dropDuplicates([component])
    return stays.drop(name, component)
