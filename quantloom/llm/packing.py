"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted; each has a cost: its length, a fixed overhead
and a share that grows with its square, as attention does.  Pieces go in decreasing length, each to
the open bin that it leaves with the least room.  Where none has room, a bin of the least-cost size opens.
The permitted sizes compete for it: for each one at or above the piece the bin is filled, as a trial, with
the largest of the pieces still to come that fit, and the size with the least cost per token held, downsized
to what it would hold, wins.  So a larger bin opens where the pieces that are left would
waste the room of a smaller one.  At the end every bin shrinks to the least permitted size that
holds its contents.

Lengths are UTF-8 bytes, the tokens of a byte-level model, unless the caller gives a
column of token counts.  Texts never move: only (id, length) pairs do.  Rows that repeat both are
interchangeable: they are counted first, map-side too, and dealt as blocks of copies, so an id (or null) of
a third of all rows spreads like any other.  Pieces are dealt by a hash into groups of bounded
expected size, each packed on its own, so a task's memory is bounded and a lost executor costs a few groups.  A group wastes at most one part-filled
bin per size more than packing all pieces at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_batches, grouped_runs, sorted_groups

SIZES = (1024, 2048, 4096, 8192)
OVERHEAD = 64
ATTENTION = 16_384  # the length at which the square costs as much as the length
GROUP_PIECES = 20_000
COPY_BLOCK = 1_000  # copies of a row that are dealt together


def bin_cost(size: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return size + size * size / attention + overhead


def best_fit(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int]]:
    """Bin of each piece, and final size of each bin.  Lengths must not exceed the largest size.

    Pieces of length 0 go to the first bin.  Ties: equal lengths keep their order;
    among bins with equal room the oldest takes the piece; of sizes with equal cost the smaller opens.
    """
    sizes = tuple(sorted(sizes))
    cost = {s: bin_cost(s, overhead, attention) for s in sizes}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [-lengths[i] for i in order]  # ascending, for bisect
    before = [0, *accumulate(-x for x in falling)]
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    bins = [0] * len(lengths)

    def trial(at: int, size: int) -> int:
        """What a bin of a size would hold: the piece at a place of the order, and then the largest that fit."""
        left = size
        while at < len(order) and left:
            end = bisect_right(before, before[at] + left, at) - 1  # as many in a row as fit
            left -= before[end] - before[at]
            at = max(end, bisect_left(falling, -left, end))
        return size - left

    for k, i in enumerate(order):
        n = lengths[i]
        if not n:
            if not used:
                used.append(0)
            continue
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            best = None
            for size in sizes:
                if size >= n:
                    held = trial(k, size)
                    shrunk = next(s for s in sizes if s >= held)
                    price = (cost[shrunk] / held, size)
                    best = price if best is None else min(best, price)
            left = best[1]
            b = len(used)
            used.append(0)
        bins[i] = b
        used[b] += n
        if left - n:
            insort(room, (left - n, b))
    return bins, [next(s for s in sizes if s >= u) for u in used]


def text_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes of a text, the tokens of a byte-level model; null is 0."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, bin_group, bin, bin_size: where each part of each document goes.

    Lengths are in bytes of UTF-8, or in the unit of ``length``.  A document longer than the largest size is cut into pieces of it and a rest.  Null
    and empty texts have one piece of length 0.  Rows that repeat an id, or have none, are packed each
    on its own; the pieces of two such rows aren't told apart.  An empty table gives an empty result; ``length`` may be any
    non-negative column, null counts as 0.
    """
    spark = docs.sparkSession
    largest = max(sizes)
    size = F.greatest(F.coalesce((text_bytes() if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / largest), F.lit(1))
    total = few.agg(F.sum(pieces).alias("n")).first()["n"] or 1
    count = max(1, -(-int(total) // group_pieces))
    block = min(COPY_BLOCK, max(1, group_pieces // 20))
    rows = few.groupBy("doc_id", "n").agg(F.count("*").alias("m"))
    rows = rows.select("doc_id", "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / block))).alias("block"))
    rows = rows.withColumn("copies", F.least(F.col("m") - F.col("block") * block, F.lit(block)).cast("int"))
    parts = rows.select("doc_id", "n", "block", "copies", F.explode(F.sequence(F.lit(0).cast("long"), (pieces - 1).cast("long"))).alias("piece"))
    start = F.col("piece") * largest
    group = F.pmod(F.xxhash64("doc_id", "n", "piece", "block"), F.lit(count)).cast("int")
    parts = parts.select(group.alias("bin_group"), "doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).alias("length"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "bin_group"):
            t = t.combine_chunks()
            t = t.take(np.repeat(np.arange(len(t)), t.column("copies").to_numpy())).drop_columns("copies")
            n = t.column("length").to_numpy()
            bins, final = np.zeros(len(n), np.int32), np.zeros(len(n), np.int32)
            for lo, hi in zip(*grouped_runs(t.column("bin_group").to_numpy()), strict=True):
                b, s = best_fit(n[lo:hi].tolist(), sizes, overhead, attention)
                bins[lo:hi] = b
                final[lo:hi] = np.array(s, np.int32)[b]
            for b in t.append_column("bin", pa.array(bins)).append_column("bin_size", pa.array(final)).to_batches():
                yield b

    arrow_batches(spark)
    dealt = parts.repartition("bin_group").sortWithinPartitions("bin_group", F.desc("length"), "doc_id", "piece")
    return dealt.mapInArrow(run, "bin_group int, doc_id long, piece long, start long, length long, bin int, bin_size int").select("doc_id", "piece", "start", "length", "bin_group", "bin", "bin_size")
