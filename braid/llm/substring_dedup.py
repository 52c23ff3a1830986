"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat is a run of ``min_words`` words or more that starts at two places of the
corpus. The suffixes of all texts are split by prefix, and the parts are solved
apart from each other:

1. *Sampled suffixes.* Of the suffixes in each window of ``min_words`` words, the
   one with the least hash of its first ``prefix_words`` words stands for the
   window. Equal windows choose alike, so about 1 suffix in 14 is dealt out and no
   repeat is lost. Consecutive windows with the same choice form a *run*.
2. *Variable-length prefixes.* Runs are counted by that short prefix. A prefix
   found once cannot branch and goes. Runs of equal words are one leaf of the tree that
   several suffixes share: all their windows are repeats, and one of them stays for
   comparison. What is left under a prefix is a group. While a group has more than
   ``group_limit`` leaves its prefix grows (8, 14, 24, ... words), which deals its
   windows to smaller groups; at ``min_words`` a group is one node of the tree.
3. *Subtrees.* Each group of at most ``group_limit`` leaves is one suffix tree in one task:
   its suffixes sorted with their longest common prefixes (the nodes of depth d
   are the runs of neighbours with LCP >= d), and the same for the words left of
   the anchor, read leftwards. A window is a repeat if the node of depth
   ``min_words`` above it has two leaves. Neighbouring windows that are repeats join
   to the maximal repeats of the text.

Inside a group words are compared by their bytes; runs, and windows that are whole
prefixes, by 128 bits folded from 128-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import fresh_names, written
from .textkernel import Numbers, Ranges, Segment, Words, join_hashes, segments, spread, strings, words_of

PREFIX_WORDS = 8
GROUP_LIMIT = 2048
GROUP_ROWS = 20_000  # runs that a task solves, on the average


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, the leftmost place of the least value among it and the ``width - 1`` next."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, have = np.arange(len(values)), 1
    while have * 2 <= width:
        left, right = at[:-have], at[have:]
        at, have = np.where(values[right] < values[left], right, left), have * 2
    left, right = at[:n], at[width - have : width - have + n]
    return np.where(values[right] < values[left], right, left)


def _pack(start, count, back):
    """A span: ``count`` windows from word ``start`` (< 2**51) on, the first ``back`` words before its anchor; count and back < 64."""
    return (start << 12) | (count << 6) | back


def _runs(part: Segment, min_words: int, prefix_words: int):
    """(start, count, back, prefix hash, run's two hashes) of the runs of a segment's own windows; starts are word places in the segment."""
    words, n = part.words, len(part.words.starts)
    if n < min_words:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z, z
    low, high = (Ranges(h) for h in words.hashes())
    grams = low.of(np.arange(n - prefix_words + 1), prefix_words)
    anchor = _least(grams, min_words - prefix_words + 1)
    whole = words.doc[: n - min_words + 1] == words.doc[min_words - 1 :]
    whole[part.own :] = False
    places = np.flatnonzero(whole)
    anchor = anchor[places]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (places[1:] != places[:-1] + 1)
    heads = np.flatnonzero(new)
    start, anchor = places[heads], anchor[heads]
    count = np.diff(np.append(heads, len(places)))
    size = count + min_words - 1
    return start, count, anchor - start, grams[anchor], low.of(start, size), high.of(start, size)


def _light_rows(min_words: int, prefix_words: int):
    """(k1, k2, text) to a row for each run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in segments(batch.column(2), min_words - 1):
                start, count, back, prefix, low, high = _runs(part, min_words, prefix_words)
                if not len(start):
                    continue
                doc = part.words.doc[start]
                rows = pa.array(doc + part.at)
                span = _pack(start - part.words.first[doc] + part.base, count, back)
                hashes = [pa.array(h.view(np.int64)) for h in (prefix, low, high)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *hashes, pa.array(span)], ["k1", "k2", "prefix", "low", "high", "span"])

    return work


def _run_texts(min_words: int):
    """Rows (k1, k2, text, opens) to one row for each open run, with the run's words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opens = batch.column(3)
            for part in segments(batch.column(2), 64 + min_words):
                words = part.words
                own = opens.slice(part.at, part.to - part.at)
                doc, _ = spread(np.diff(own.offsets.to_numpy()))
                flat = own.flatten()
                group, times, span, members = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                first = words.first[doc] + (span >> 12) - part.base
                here = np.flatnonzero(part.whole | ((first >= 0) & (first < part.own)))
                doc, group, times, span, members, first = (x[here] for x in (doc, group, times, span, members, first))
                last = first + ((span >> 6) & 63) + min_words - 2
                a, b = words.starts[first], words.ends[last]
                bounds = np.append(0, np.cumsum(b - a))
                item, place = spread(b - a)
                rows = pa.array(doc + part.at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(group), pa.array(times), pa.array(span), pa.array(members), strings(words.data[a[item] + place], bounds)],
                    RUN_NAMES,
                )

    return work


RUN_NAMES = ["k1", "k2", "prefix", "times", "span", "members", "words"]
RUN_SCHEMA = "k1 long, k2 int, prefix long, times long, span long, members long, words string"


def _grow(min_words: int, level: int):
    """Runs of groups that are too large, dealt anew: their windows by ``level`` words.

    Windows that have so many words from the anchor on stay together, under those words.
    Any other window goes alone, under its last ``level`` words and its distance from the anchor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(RUN_NAMES.index("span")).to_numpy()
            for at, to, words in words_of(batch.column(RUN_NAMES.index("words"))):
                start, count, back = spans[at:to] >> 12, (spans[at:to] >> 6) & 63, spans[at:to] & 63
                low, high = (Ranges(h) for h in words.hashes())
                skip = np.maximum(0, back - (min_words - level))  # windows that have too few words from the anchor on
                stay = np.flatnonzero(count > skip)
                row, place = spread(np.minimum(skip, count))
                item = np.append(stay, row)
                from_word = np.append(skip[stay], place)
                n = np.append(count[stay] - skip[stay], np.ones(len(row), dtype=np.int64))
                new_back = back[item] - from_word
                head = words.first[item] + from_word + np.append(new_back[: len(stay)], np.full(len(row), min_words - level))
                alone = np.append(np.zeros(len(stay), dtype=np.uint64), new_back[len(stay) :].astype(np.uint64) + np.uint64(1))
                keys = [pa.array(join_hashes(side.of(head, level), alone).view(np.int64)) for side in (low, high)]
                a, b = words.starts[words.first[item] + from_word], words.ends[words.first[item] + from_word + n + min_words - 2]
                bounds = np.append(0, np.cumsum(b - a))
                byte, step = spread(b - a)
                rows = pa.array(item + at)
                take = lambda c: batch.column(RUN_NAMES.index(c)).take(rows)
                yield pa.RecordBatch.from_arrays(
                    [take("k1"), take("k2"), *keys, take("times"), pa.array(_pack(start[item] + from_word, n, new_back)), strings(words.data[a[byte] + step], bounds)],
                    ["k1", "k2", "prefix", "more", "times", "span", "words"],
                )

    return work


GROWN_SCHEMA = "k1 long, k2 int, prefix long, more long, times long, span long, words string"


def _sorted(group: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of rows within their groups, and each row's common prefix with the row sorted before it (-1: another group)."""
    order = np.lexsort((*columns.T[::-1], group))
    g, c = group[order], columns[order]
    lcp = np.full(len(order), -1)
    same = g[1:] == g[:-1]
    differ = c[1:] != c[:-1]
    lcp[1:] = np.where(same, np.where(differ.any(axis=1), differ.argmax(axis=1), c.shape[1]), -1)
    return order, lcp


def _subtrees(group: np.ndarray, times: np.ndarray, span: np.ndarray, texts: pa.Array, min_words: int, prefix_words: int):
    """For each row and each of its windows, by distance back from the anchor: whether the window is a repeat."""
    back_most = min_words - prefix_words
    n = len(group)
    # a missing word differs from every other word, so it ends the common prefix
    left = np.broadcast_to(-1 - np.arange(n, dtype=np.int64)[:, None], (n, back_most)).copy()
    right = np.broadcast_to(left[:, :1], (n, min_words)).copy()
    numbers = Numbers()
    for at, to, words in words_of(texts):
        number, first = numbers.of(words.tokens()), words.first
        back = span[at:to] & 63
        item, place = spread(back)
        left[at + item, place] = number[first[item] + back[item] - 1 - place]
        item, place = spread(np.minimum(np.diff(first) - back, min_words))
        right[at + item, place] = number[first[item] + back[item] + place]
    r_order, r_lcp = _sorted(group, right)
    l_order, l_lcp = _sorted(group, left)
    r_node, l_node = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    count = (span >> 6) & 63
    start_back = span & 63
    repeated = np.zeros((n, back_most + 1), dtype=bool)
    for back in range(back_most + 1):
        here = (back <= start_back) & (back > start_back - count)
        if not here.any():
            continue
        r_node[r_order] = np.cumsum(r_lcp < min_words - back)
        l_node[l_order] = np.cumsum(l_lcp < back)
        rows = np.flatnonzero(here)
        _, node = np.unique(r_node[rows] * (n + 1) + l_node[rows], return_inverse=True)
        leaves = np.bincount(node, weights=times[rows])
        repeated[rows, back] = leaves[node] >= 2
    return repeated


def _solve_groups(min_words: int, prefix_words: int, chunk: int = 1 << 13):
    """Over runs sorted by prefix: the repeated windows of runs that are found once."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        prefix, times, span = (rows.column(c).to_numpy() for c in ("prefix", "times", "span"))
        repeated = _subtrees(prefix, times, span, rows.column("words"), min_words, prefix_words)
        repeated &= (times < 2)[:, None]
        # neighbouring windows that are repeats are one span; the greatest distance back comes first
        edge = np.diff(np.pad(repeated[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        back = repeated.shape[1] - 1 - begin
        start = (span[row] >> 12) + (span[row] & 63) - back
        at = pa.array(row)
        take = lambda c: rows.column(c).take(at).combine_chunks()
        return pa.RecordBatch.from_arrays([take("k1"), take("k2"), pa.array(_pack(start, end - begin, np.zeros_like(start)))], ["k1", "k2", "span"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n < chunk:
                continue
            rows = pa.concat_tables(held)
            prefix = rows.column("prefix").to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1], side="left"))  # the last group may go on
            while cut > 0:
                end = cut if cut <= 2 * chunk else int(np.searchsorted(prefix, prefix[chunk], side="left")) or int(np.searchsorted(prefix, prefix[chunk], side="right"))
                yield solve(rows.slice(0, end))
                rows, prefix, cut = rows.slice(end), prefix[end:], cut - end
            held, n = [rows], rows.num_rows
        if n:
            yield solve(pa.concat_tables(held))

    return work


def _covered(span: np.ndarray, doc: np.ndarray, words: Words, base: int, min_words: int) -> np.ndarray:
    """Whether each word is in a window of one of the spans; spans of a text's other parts are cut to these words."""
    n = len(words.starts)
    step = np.zeros(n + 1, dtype=np.int64)
    first = words.first[doc] + (span >> 12) - base
    np.add.at(step, np.clip(first, 0, n), 1)
    np.add.at(step, np.clip(first + ((span >> 6) & 63) + min_words - 1, 0, n), -1)
    return np.cumsum(step)[:n] > 0


def _stretches(gone: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the longest stretches of covered words within a text."""
    edge = np.ones(len(gone), dtype=bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (words.doc[1:] != words.doc[:-1])
    head = np.flatnonzero(edge)
    size = np.diff(np.append(head, len(gone)))
    head, size = head[gone[head]], size[gone[head]]
    return words.doc[head], head - words.first[words.doc[head]], size


REPEATS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))


def _repeats(doc: np.ndarray, first: np.ndarray, size: np.ndarray, n_docs: int) -> pa.Array:
    ends = np.append(0, np.cumsum(np.bincount(doc, minlength=n_docs))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(first), pa.array(size)], fields=list(REPEATS.value_type)))


def _cut(min_words: int, extra: int, text_at: int, changed_only: bool = False):
    """Rows (columns, spans) to (columns, repeats, n_words, n_removed, kept); ``kept`` is null for texts that lose nothing if ``changed_only``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            names = [*(f"c{i}" for i in range(extra)), "repeats", "n_words", "n_removed", "kept"]
            found = None  # what the parts of a long text have given so far
            for part in segments(batch.column(text_at)):
                words = part.words
                own = spans.slice(part.at, part.to - part.at)
                doc, _ = spread(np.diff(own.offsets.to_numpy()))
                span = own.flatten().to_numpy(zero_copy_only=False)
                gone = _covered(span, doc, words, part.base, min_words)
                of, first, size = _stretches(gone, words)
                same = np.bincount(of, minlength=words.n_docs) == 0
                kept, bounds = join_words(words, ~gone & ~same[words.doc] if changed_only and part.whole else ~gone)
                columns = [batch.column(i).slice(part.at, part.to - part.at) for i in range(extra)]
                if part.whole:
                    n_words = np.diff(words.first)
                    removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
                    out = strings(kept, bounds)
                    out = pc.if_else(pa.array(same), None, out) if changed_only else out
                    yield pa.RecordBatch.from_arrays([*columns, _repeats(of, first, size, words.n_docs), pa.array(n_words), pa.array(removed), out], names)
                    continue
                found = found or ([], [], [])
                for a, n in zip((first + part.base).tolist(), size.tolist(), strict=True):
                    if found[0] and sum(found[0][-1]) == a:  # goes on from the part before
                        a, n = found[0][-1][0], found[0].pop()[1] + n
                    found[0].append((a, n))
                found[1].append(len(gone) - int(gone.sum()))
                if len(kept):
                    found[2].append(kept.tobytes())
                if part.last:
                    n_words = part.base + part.own
                    repeats = pa.array([[{"first": a, "words": n} for a, n in found[0]]], REPEATS)
                    out = None if changed_only and not found[0] else b" ".join(found[2])
                    yield pa.RecordBatch.from_arrays([*columns, repeats, pa.array([n_words]), pa.array([n_words - sum(found[1])]), pa.array([out], pa.large_binary()).view(pa.large_string())], names)
                    found = None

    return work


def join_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes and bounds."""
    step = np.zeros(len(words.data) + 1, dtype=np.int8)
    step[words.starts[keep]] += 1
    step[words.ends[keep]] -= 1
    stays = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    doc = words.doc[keep]
    more = np.flatnonzero(doc[1:] == doc[:-1])  # followed by another kept word of the text, so by a space first
    gaps = words.ends[keep][more]
    stays[gaps] = True
    data = words.data.copy()
    data[gaps] = 0x20
    bounds = np.append(0, np.cumsum(stays))[words.bounds]
    return data[stays], bounds


def _solved(opens: DataFrame, min_words: int, prefix_words: int, group_limit: int) -> list[DataFrame]:
    """Tables (k1, k2, span) of the repeated windows in the groups of ``opens`` (RUN_SCHEMA), of any size."""
    spark = opens.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out, level = [], prefix_words
    while True:
        fits, hot = opens.where(F.col("members") <= group_limit), opens.where(F.col("members") > group_limit)
        tasks = max(least, -(-fits.count() // GROUP_ROWS))
        out.append(fits.drop("members").repartition(tasks, "prefix").sortWithinPartitions("prefix").mapInArrow(_solve_groups(min_words, prefix_words), "k1 long, k2 int, span long"))
        if hot.isEmpty():
            return out
        level = min(min_words, level + level * 3 // 4 + 1)
        grown = written(hot.select(RUN_NAMES).mapInArrow(_grow(min_words, level), GROWN_SCHEMA), "grown-runs")
        if level == min_words:  # a group is one node; its leaves are counted
            node = ["prefix", "more"]
            leaves = written(grown.groupBy(node).agg(F.sum("times").alias("leaves")).where("leaves > 1").select(node), "nodes")
            out.append(written(grown.join(leaves, node).select("k1", "k2", "span"), "node-windows"))
            return out
        sizes = written(grown.groupBy("prefix").agg(F.count("*").alias("members")).where("members > 1"), "groups")
        opens = written(grown.drop("more").join(sizes, "prefix").select(RUN_NAMES), "run-texts")


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, prefix_words: int = PREFIX_WORDS, group_limit: int = GROUP_LIMIT, keep_text: bool = True, changed_only: bool = False
) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ``repeats``, ``n_words``, ``n_removed`` and ``kept``.

    ``kept`` are the words that no repeated window covers, joined by one space (null for texts that lose none if ``changed_only``); ``repeats``
    are the others as maximal stretches (first word, counted from 0, and number of words).
    Windows are judged on the input: every occurrence of a repeat goes, in one text
    or in several. A null or empty text has no words and an empty ``kept``. Rows that
    repeat count as further occurrences. Nulls elsewhere, ties and any other columns
    pass through; result columns whose names are taken get a leading underscore. A text
    of any length is worked on in segments, with memory for the text and its words' places.
    """
    if not prefix_words < min_words < 64:
        raise ValueError("prefix_words < min_words < 64 is needed")
    k1, k2, spans = fresh_names(docs, "braid_k1", "braid_k2", "braid_spans")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({k1: F.xxhash64(F.col(id_col), text), k2: F.hash(text, F.col(id_col))})
    plain = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text"))

    light = written(plain.mapInArrow(_light_rows(min_words, prefix_words), "k1 long, k2 int, prefix long, low long, high long, span long"), "runs")
    # sums are written before they are joined: Spark splits the join of a hot prefix only between plain shuffles
    counted = written(light.groupBy("prefix").agg(F.count("*").alias("times")).where("times > 1").select("prefix"), "prefixes")
    shared = written(light.join(counted, "prefix"), "shared-runs")

    run = ["prefix", "low", "high"]
    runs = written(shared.groupBy(run).agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "span")).alias("one")), "different-runs")
    closed = written(shared.join(runs.where("times > 1").select(run), run).select("k1", "k2", "span"), "leaves")
    groups = written(runs.groupBy("prefix").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    opens = (
        runs.join(groups, "prefix")
        .select("one.k1", "one.k2", F.struct("prefix", "times", "one.span", "members").alias("open"))
        .groupBy("k1", "k2")
        .agg(F.collect_list("open").alias("opens"))  # at most the runs of one text
    )
    texts = plain.join(opens, ["k1", "k2"]).select("k1", "k2", "text", "opens").mapInArrow(_run_texts(min_words), RUN_SCHEMA)
    # rows that are equal in id and text give equal runs
    one_each = written(written(texts, "run-texts").dropDuplicates(["k1", "k2", "span"]), "run-texts")
    marks = closed
    for found in _solved(one_each, min_words, prefix_words, group_limit):
        marks = marks.unionAll(found)
    marks = marks.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("span").alias(spans))  # at most the windows of one text
    joined = keyed.join(marks, [k1, k2], "left").withColumn(spans, F.coalesce(F.col(spans), F.array().cast("array<long>")))
    return _with_kept(joined, docs, text_col, spans, min_words, keep_text, changed_only)


def _with_kept(joined: DataFrame, docs: DataFrame, text_col: str, spans: str, min_words: int, keep_text: bool, changed_only: bool) -> DataFrame:
    names = fresh_names(docs, "repeats", "n_words", "n_removed", "kept")
    dtypes = dict(docs.dtypes)
    out = [c for c in docs.columns if keep_text or c != text_col]
    # a text column goes to Python once
    single = keep_text and dtypes[text_col] == "string"
    text = [] if single else [F.col(text_col).cast("string").alias("text")]
    flat = joined.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(out)), *text, F.col(spans).alias("spans"))
    schema = ", ".join([*(f"c{i} {dtypes[c]}" for i, c in enumerate(out)), "repeats array<struct<first: long, words: long>>, n_words long, n_removed long, kept string"])
    return flat.mapInArrow(_cut(min_words, len(out), out.index(text_col) if single else len(out), changed_only), schema).toDF(*out, *names)
