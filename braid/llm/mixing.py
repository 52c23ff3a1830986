"""Mixing sources to target weights with token blocks.

Each source's texts, in a pseudorandom order, are one stream of words that is cut into
blocks of ``block_words``. A mix is a list of slots, dealt to output shards. The draw goes by
halves: of any run of shards, the first half draws from a multinomial over the sources, whose
chances are the slots that each source owes to the run, and the second half takes the rest; so
every shard finds its own counts, and the slots before them, from the totals alone. A source's
slot j takes the block at place j of the source's permutation for that pass over its blocks (a
Feistel cipher that walks until it lands inside), and its last slot is cut to the target. Slots
and blocks are joined by (source, block index).

Sources are the entries of a mixture: their names and totals go to the driver, their
rows do not. Word offsets are sums over range partitions of (source, pseudorandom order), so
neither a source nor a group of equal rows with a third of all rows is a single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import counted_before
from ..tables import fresh_names, written
from .substring_dedup import join_words
from .textkernel import mix, segments, spread, strings

WORD = r"[^\x20\x09-\x0D]+"


def permuted(index: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (or its inverse) at ``index``: four Feistel rounds, repeated while outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [mix(np.array([seed * 4 + r], dtype=np.uint64))[0] for r in range(4)]
    out = index.astype(np.uint64)
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> np.uint64(half), out[live] & mask
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ key) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & mask)
        out[live] = (left << np.uint64(half)) | right
        live = live[out[live] >= n]
    return out.astype(np.int64)


@dataclass
class Share:
    """One source's part of a mix."""

    source: str | None
    size: int
    weight: float
    target: float = 0.0
    blocks: int = 0
    slots: int = 0
    cut: int = 0  # words of the last slot
    seed: int = 0


def targets(shares: list[Share], total: float, most: float) -> None:
    """Share ``total`` by weight; what lies above ``most`` times a source's size is shared again among the others."""
    owed, weight = float(total), float(sum(s.weight for s in shares))
    for s in sorted(shares, key=lambda s: most * s.size / s.weight):
        s.target = min(most * s.size, owed * s.weight / weight)
        owed, weight = owed - s.target, weight - s.weight


def _slots(s: Share, words: int, seed: int) -> None:
    s.blocks, s.seed = -(-s.size // words), seed
    take = int(round(s.target))
    if not take:
        return
    passes, rest = divmod(take, s.size)
    short = words * s.blocks - s.size
    s.slots, s.cut = passes * s.blocks, words
    if rest:
        at = int(permuted(np.array([s.blocks - 1]), s.blocks, seed + passes, back=True)[0])
        held = lambda m: m * words - (short if m > at else 0)  # noqa: E731  words in the pass's first m blocks
        m = -(-rest // words)
        m += held(m) < rest
        s.slots, s.cut = s.slots + m, rest - held(m - 1)


def halved(owed: np.ndarray, n: int, seed: int, first: int, shards: int) -> np.ndarray:
    """How many of the ``owed`` slots of each source the first ``n`` slots of a run of shards take: a multinomial draw, none above what is owed."""
    drawn = np.minimum(np.random.Generator(np.random.PCG64([seed, first, shards])).multinomial(n, owed / owed.sum()), owed)
    while (more := n - int(drawn.sum())) > 0:
        free = owed - drawn
        drawn += np.minimum(free, -(-more * free // int(free.sum())))
        over = int(drawn.sum()) - n
        for i in np.flatnonzero(drawn)[::-1]:
            back = min(over, int(drawn[i]))
            drawn[i] -= back
            over -= back
            if over <= 0:
                break
    return drawn


def shard_draws(slots: tuple[int, ...], shard_slots: int, seed: int, most: int = 1 << 12):
    """A function from a shard to (slots of each source before it, slots of each source in it)."""
    whole = sum(slots)
    last = -(-whole // shard_slots)

    @lru_cache(maxsize=most)
    def run(first: int, shards: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """(before, owed) of a run of shards; runs are halves of halves of all shards."""
        if shards == total:
            return (0,) * len(slots), slots
        left = first // (2 * shards) * (2 * shards)
        before, owed = (np.array(x, dtype=np.int64) for x in run(left, 2 * shards))
        end = min(left + 2 * shards, last)
        if end <= left + shards:  # the second half lies behind the last shard
            taken = owed
        else:
            taken = halved(owed, shards * shard_slots, seed, left, shards)
        if first == left:
            return tuple(before.tolist()), tuple(taken.tolist())
        return tuple((before + taken).tolist()), tuple((owed - taken).tolist())

    total = 1 << max(0, last - 1).bit_length()
    return lambda shard: run(shard, 1)


def _slot_blocks(shares: list[Share], words: int, shard_slots: int, seed: int):
    """Shards to a row for each of their slots: its source, pass, block and words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = shard_draws(tuple(s.slots for s in shares), shard_slots, seed)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for source, (first, count) in enumerate(zip(*drawn(shard), strict=True)):
                    if not count:
                        continue
                    s = shares[source]
                    slot = np.arange(first, first + count)
                    turn, place = np.divmod(slot, s.blocks)
                    block = np.empty(count, dtype=np.int64)
                    for t in np.unique(turn):
                        block[turn == t] = permuted(place[turn == t], s.blocks, s.seed + int(t))
                    most = np.full(count, words)
                    most[slot == s.slots - 1] = s.cut
                    one = lambda v: pa.array(np.full(count, v))
                    yield pa.RecordBatch.from_arrays([one(shard), one(source), pa.array(slot), pa.array(turn), pa.array(block), pa.array(most)], ["shard", "s", "slot", "turn", "block", "most"])

    return work


@dataclass
class Mix:
    """``rows``: a row for each text (row, id, source, s, size, source_size, target). ``spans``: a row for each
    part of a text in a slot (shard, slot, turn, source's place, row, first word, words)."""

    rows: DataFrame
    spans: DataFrame
    shares: list[Share]


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 256,
    shard_slots: int = 8192,
    seed: int = 1,
    row_col: str | None = None,
) -> Mix:
    """The mix of ``docs``: sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words.

    ``most`` is an upper bound on how often any word is taken, in whole passes. A null
    or empty text has size 0 and no spans; a source without words has target 0. An empty
    table has no sources and no slots. Equal rows count each; they stand side by side in their source's
    stream. Reruns on equal rows agree, in any order and partitioning. Other columns, whatever
    their names, do not matter here. ``row_col`` is a number of each row in a written
    table; without it rows are numbered here.
    """
    if most != int(most):
        raise ValueError("most is a number of whole passes")
    spark = docs.sparkSession
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    flat = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"), "text", "source")
    sized = flat.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "order": order})
    sizes = written(sized.select("row", "id", "source", "size", "order"), "sizes")

    found = sorted(((r.source, r.size) for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    shares = [Share(source, size, float(weights[i % len(weights)])) for i, (source, size) in enumerate(found)]
    targets(shares, share * sum(s.size for s in shares), most)
    for i, s in enumerate(shares):
        _slots(s, block_words, (seed * 1_000_003 + i) * 64)

    heads, at = [], 0
    for i, s in enumerate(shares):
        heads.append((i, s.source, s.size, float(s.target), at))
        at += s.size
    table = F.broadcast(spark.createDataFrame(heads, "s long, own string, source_size long, target double, head long"))  # a row for each source
    rows = sizes.join(table, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    streamed = rows.where("size > 0").select("s", "order", "row", "size", "head")
    placed = counted_before(streamed, [F.col("s"), F.col("order"), F.col("row")], "size", "before").withColumn("at", F.col("before") - F.col("head"))
    words = F.lit(block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))))
    pieces = pieces.withColumns({"from": F.greatest("at", F.col("block") * words), "to": F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * words)}).select("s", "block", "row", "at", "from", "to")
    shards = -(-sum(s.slots for s in shares) // shard_slots)
    plan = spark.range(0, shards, 1, max(1, min(shards, sum(s.slots for s in shares) // 20_000)))
    slots = plan.mapInArrow(_slot_blocks(shares, block_words, shard_slots, seed), "shard long, s long, slot long, turn long, block long, most long")
    # both sides grow with the input, and no estimate knows how many slots a shard has
    spans = slots.hint("merge").join(pieces, ["s", "block"]).withColumn("words", F.least("to", F.col("block") * words + F.col("most")) - F.col("from")).where("words > 0")
    return Mix(rows.drop("head", "order"), spans.select("shard", "slot", "turn", "s", "row", (F.col("from") - F.col("at")).alias("first"), "words"), shares)


def taken(mixed: Mix) -> DataFrame:
    """(id, source, size, source_size, target, taken): the words that the mix takes of each text, repeats counted."""
    each = mixed.spans.groupBy("row").agg(F.sum("words").alias("taken"))
    return mixed.rows.join(each, "row", "left").select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _texts(extra: int, text_at: int):
    """(columns, parts) to the columns, a row for each pass that takes words of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, parts = batch.column(text_at), batch.column(extra)
            names = batch.schema.names[:extra]
            held: dict[int, list[tuple[int, bytes]]] = {}  # of a long text, by pass: words kept of each part, and their bytes
            for part in segments(text):
                words, own = part.words, parts.slice(part.at, part.to - part.at)
                doc, _ = spread(np.diff(own.offsets.to_numpy()))
                flat = own.flatten()
                turn, first, size = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                n = len(words.starts)
                for t in np.unique(turn):
                    here = turn == t
                    step = np.zeros(n + 1, dtype=np.int64)
                    begin = words.first[doc[here]] + first[here] - part.base
                    np.add.at(step, np.clip(begin, 0, n), 1)
                    np.add.at(step, np.clip(begin + size[here], 0, n), -1)
                    keep = np.cumsum(step)[:-1] > 0
                    data, bounds = join_words(words, keep)
                    if not part.whole:
                        held.setdefault(int(t), []).append((int(keep.sum()), data.tobytes()))
                        continue
                    some = np.unique(doc[here])
                    got = np.bincount(words.doc[keep], minlength=words.n_docs)
                    cut = strings(data, bounds).to_pylist()
                    full = got == np.diff(words.first)
                    whole = text.slice(part.at, part.to - part.at)
                    out = pa.array([whole[i].as_py() if full[i] else cut[i] for i in some.tolist()], pa.large_string())
                    rows = pa.array(some + part.at)
                    yield pa.RecordBatch.from_arrays([out if i == text_at else batch.column(i).take(rows) for i in range(extra)], names)
                if part.last and not part.whole:
                    rows = pa.array([part.at])
                    for found in held.values():
                        full = sum(k for k, _ in found) == part.base + part.own
                        out = text.take(rows).cast(pa.large_string()) if full else pa.array([b" ".join(raw for k, raw in found if k)], pa.large_binary()).cast(pa.large_string())
                        yield pa.RecordBatch.from_arrays([out if i == text_at else batch.column(i).take(rows) for i in range(extra)], names)
                    held = {}

    return work


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as rows of ``docs``: one for each text and pass that takes words of it, the text (as string) cut to those words.

    A text that a pass takes whole keeps its white space; words of a text that is cut
    are joined by one space. Null and empty texts and texts without words have no rows, an
    empty table gives none. Equal rows are mixed each. All columns pass through, whatever
    their names; names used here give way to them.
    """
    row, parts = fresh_names(docs, "b_row", "b_parts")
    # rows are numbered once, in a table
    rows = written(docs.withColumn(text_col, F.col(text_col).cast("string")).withColumn(row, F.monotonically_increasing_id()), "mixed-rows")
    mixed = plan_mix(rows, id_col, text_col, source_col, row_col=row, **how)
    each = mixed.spans.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("turn", "first", "words")).alias(parts))
    joined = rows.join(each, row)
    flat = joined.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col(parts).alias("parts"))
    schema = ", ".join(f"c{i} {'string' if c == text_col else t}" for i, (c, t) in enumerate(docs.dtypes))
    return flat.mapInArrow(_texts(len(docs.columns), docs.columns.index(text_col)), schema).toDF(*docs.columns)
