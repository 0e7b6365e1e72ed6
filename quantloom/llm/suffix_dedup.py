"""Removal of repeated byte strings by distributed prefix doubling on anchored positions.

A byte goes when a string of ``min_bytes`` (100) that covers it also starts
earlier: in a document of smaller id, or earlier in the same one.

Ranks are names, as in naming by doubling: equal strings have equal names.  Strings of 25
bytes are named by a hash; the pair (name, name at offset 25) names 50 bytes, the pair
(name, name at offset 50) names 100.  Each round is one global Spark sort of such pairs with the position
behind them; what is unique leaves, what has reached the threshold is settled.

Ranking every byte position would shuffle many times the input, so the first sort takes
*anchors* only.  Each 100-byte string holds one anchor, the leftmost of its 50-byte strings
of least name; equal strings have it at the same place.  Neighbouring strings with one
anchor form a *stretch*.

1. offset 25: stretches are sorted by their anchor's rank of 50 bytes, then by the name of the stretch
   as a whole.  An anchor that only one stretch has is unique and leaves.  Of stretches that are equal throughout
   all but the first are past the threshold, hence repeated.  The first of each distinct
   one goes on, position by position.
2. offset 50: the positions that are left are sorted by (rank, rank at offset 50); of equal
   pairs all but the earliest are repeated.

The sorts are range partitioned by the whole pair and the position, so the positions of one string,
however many, are spread over tasks.  What a task can't know, whether its first and last strings go on in
its neighbours, is settled from four rows a task.  Before each sort a task settles repeats
among its own texts, so that a string found in a third of all documents is shuffled once per task.

Defined results: null is the empty text; texts under 100 bytes are never cut; rows of one id and
text are one document and get equal results; rows of one id and other texts are
documents of their own, in the order of a hash of the text; a null id counts as the largest
one; an empty table gives an empty one.  Names are 64-bit hashes, compared among strings that share their
first half (or anchor): n such strings hold a wrong pair with a chance of n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import OTHER_BYTE, U64, RollingHash, Stage, arrow_batches, grouped_runs, mix, signed, text_chunks

MIN_BYTES = 100
FLUSH_ROWS = 1_000_000
LAST_ID = 2**63 - 1

#: kind 0: to be ranked, 1: a repeated span (span is its end), 2: not unique, 3 to 6: edges of a task (see _rank).
_ROW = "kind byte, k long, sw long, doc long, sub int, lo int, span int"
_RANKED = f"{_ROW}, part int"
_KINDS = {"byte": pa.int8(), "long": pa.int64(), "int": pa.int32()}


def _batch(schema: str, *arrays) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, _KINDS[t]) for a, (_, t) in zip(arrays, fields, strict=True)], names=[n for n, _ in fields])


def merge_spans(keys: tuple[np.ndarray, ...], lo: np.ndarray, hi: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Union of half-open spans per document; touching spans become one."""
    order = np.lexsort((hi, lo, *keys))
    keys, lo, hi = tuple(k[order] for k in keys), lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(lo):
        return keys, lo, hi
    new_doc = np.ones(len(lo), bool)
    new_doc[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    group = np.cumsum(new_doc)
    reach = np.maximum.accumulate(hi + group * (1 << 32)) - group * (1 << 32)  # running maximum inside a document
    new = new_doc.copy()
    new[1:] |= lo[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return tuple(k[start] for k in keys), lo[start], reach[np.append(start[1:], len(lo)) - 1]


def _names(buf: np.ndarray, quarter: int) -> np.ndarray:
    """The name of every string of two quarters: of the pair (name, name at offset ``quarter``)."""
    grams = RollingHash(buf).grams(quarter)
    if len(grams) <= quarter:
        return np.zeros(0, U64)
    return mix(grams[:-quarter] * U64(0xC2B2AE3D27D4EB4F) + grams[quarter:])


def stretches(buf: np.ndarray, offs: np.ndarray, n: int, quarter: int) -> tuple[np.ndarray, ...]:
    """Row, anchor's rank, stretch name, first start and number of starts of each stretch."""
    size = len(buf)
    if size < n:
        z = np.zeros(0, np.int64)
        return z, z.view(U64), z.view(U64), z, z
    names = _names(buf, quarter)
    w = n - 2 * quarter + 1
    least = (names >> U64(32) << U64(32)) | np.arange(len(names), dtype=U64)
    reach = 1
    while reach * 2 <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if w > reach:
        least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
    step = np.zeros(size - n + 2, np.int32)
    long = np.flatnonzero(np.diff(offs) >= n)
    np.add.at(step, offs[long], 1)
    np.add.at(step, offs[long + 1] - n + 1, -1)
    inside = np.cumsum(step[:-1]) > 0
    same = np.zeros(len(anchor) + 1, bool)
    same[1:-1] = (anchor[1:] == anchor[:-1]) & inside[1:] & inside[:-1]
    lo = np.flatnonzero(inside & ~same[:-1])
    hi = np.flatnonzero(inside & ~same[1:])
    row = np.searchsorted(offs, lo, "right") - 1
    whole = RollingHash(buf, OTHER_BYTE).spans(lo, hi + n)
    return row, names[anchor[lo]], whole, lo - offs[row], hi - lo + 1


def _settled(rows: list[tuple], n: int) -> Iterator[pa.RecordBatch]:
    """Of rows (k, sw, doc, sub, lo, count) with equal names, the first is to be ranked, and the others are repeated."""
    k, sw, doc, sub, lo, count = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((lo, sub, doc, sw, k))
    k, sw, doc, sub, lo, count = (x[order] for x in (k, sw, doc, sub, lo, count))
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (sw[1:] != sw[:-1])
    first = np.flatnonzero(keep)[np.cumsum(keep) - 1]
    later = (doc != doc[first]) | (sub != sub[first]) | (lo != lo[first])
    if later.any():
        (d, u), a, b = merge_spans((doc[later], sub[later]), lo[later], (lo + count - 1 + n)[later])
        z = np.zeros(len(d), np.int64)
        yield _batch(_ROW, z + 1, d * 0x9E3779B1 + a * 0x5851F42D4C957F2D, z, d, u, a, b)
    yield _batch(_ROW, np.zeros(int(keep.sum()), np.int64), signed(k[keep]), signed(sw[keep]), doc[keep], sub[keep], lo[keep], count[keep])


def _flushing(rows_of, n: int):
    """A task over texts: rows_of(batch) gives tuples of rows, which are settled a million at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for rows in rows_of(batch):
                if len(rows[0]):
                    held.append(rows)
                    count += len(rows[0])
                if count >= FLUSH_ROWS:
                    yield from _settled(held, n)
                    held, count = [], 0
        if held:
            yield from _settled(held, n)

    return run


def _scan(n: int, quarter: int):
    """Round 1: the stretches of every text (doc, sub, text)."""

    def rows_of(batch: pa.RecordBatch):
        doc, sub = (batch.column(c).to_numpy() for c in (0, 1))
        for i, j, buf, offs in text_chunks(batch.column(2)):
            row, anchor, whole, lo, count = stretches(buf, offs, n, quarter)
            yield anchor, whole, doc[i:j][row], sub[i:j][row], lo, count

    return _flushing(rows_of, n)


def _positions(n: int, quarter: int):
    """Round 2: every position of the stretches (doc, sub, text, spans) that aren't unique."""

    def rows_of(batch: pa.RecordBatch):
        doc, sub = (batch.column(c).to_numpy() for c in (0, 1))
        spans = batch.column(3)
        ends = spans.offsets.to_numpy()
        flat = spans.flatten()
        lo_all, count_all = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "span"))
        ends = ends - ends[0]
        for i, j, buf, offs in text_chunks(batch.column(2)):
            of = slice(ends[i], ends[j])
            row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            lo, count = lo_all[of], count_all[of]
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            row = np.repeat(row, count)
            names = _names(buf, quarter)
            p = at + offs[row]
            yield names[p], names[p + n - 2 * quarter], doc[i:j][row], sub[i:j][row], at, np.ones(len(at), np.int64)

    return _flushing(rows_of, n)


def _rank(n: int, go_on: bool):
    """Rerank one task's share of the sorted pairs (k, sw): repeated spans, and with ``go_on`` what isn't unique.

    A row whose pair the row before has too is repeated, unless it is the same position.  The
    first of each distinct pair isn't unique if its k has another pair.  Whether that holds
    across the task's ends is told by its edges: its first row (kind 3, or 6 if
    that row's k has several pairs here), the first row of its last pair (4), and the
    first row of its last k as long as that has one pair only (5).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head = tail = alone = None  # rows (k, sw, doc, sub, lo, span)
        several = False

        def out(kind: int, *cols) -> pa.RecordBatch:
            m = len(cols[0])
            return _batch(_RANKED, np.full(m, kind), *cols, np.full(m, part))

        def one(kind: int, row: tuple) -> pa.RecordBatch:
            return out(kind, *(np.array([x], np.int64) for x in row))

        for b in batches:
            kind = b.column(0).to_numpy()
            k, sw, doc, sub, lo, span = (b.column(c).to_numpy() for c in range(1, 7))
            if (done := kind == 1).any():
                yield out(1, *(x[done] for x in (k, sw, doc, sub, lo, span)))
                k, sw, doc, sub, lo, span = (x[~done] for x in (k, sw, doc, sub, lo, span))
            if not len(k):
                continue
            at = lambda i: tuple(int(x[i]) for x in (k, sw, doc, sub, lo, span))  # noqa: B023, E731
            new_k, new = np.ones(len(k), bool), np.ones(len(k), bool)
            new_k[1:] = k[1:] != k[:-1]
            new[1:] = new_k[1:] | (sw[1:] != sw[:-1])
            if tail is None:
                head = at(0)
            else:
                new_k[0] = k[0] != tail[0]
                new[0] = new_k[0] or sw[0] != tail[1]
            several |= bool((new & ~new_k & (k == head[0])).any())
            start = np.flatnonzero(new)
            of = np.cumsum(new)  # 0: goes on with the pair of the batch before
            first = [np.append(-1 if tail is None else t, x[start])[of] for t, x in zip(tail[2:5] if tail else (0, 0, 0), (doc, sub, lo), strict=True)]
            later = (doc != first[0]) | (sub != first[1]) | (lo != first[2])
            if later.any():
                (d, u), a, z = merge_spans((doc[later], sub[later]), lo[later], (lo + span - 1 + n)[later])
                yield out(1, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, u, a, z)
            if not len(start):
                continue
            tail = at(start[-1])
            if go_on:
                opens = new_k[start]
                if alone is not None and not opens[0]:
                    yield one(2, alone)
                alone = at(start[-1]) if opens[-1] else None
                torn = ~opens
                torn[:-1] |= ~opens[1:]
                if torn.any():
                    yield out(2, *(x[start[torn]] for x in (k, sw, doc, sub, lo, span)))
        if head is not None:
            yield one(6 if several else 3, head)
            yield one(4, tail)
            if alone is not None:
                yield one(5, alone)

    return run


def _across(edges: list, n: int, go_on: bool) -> list[tuple]:
    """What the edges of neighbouring tasks tell: rows (kind, doc, sub, lo, span)."""
    parts: dict[int, dict[int, tuple]] = {}
    for r in edges:
        parts.setdefault(r["part"], {})[r["kind"]] = tuple(r[c] for c in ("k", "sw", "doc", "sub", "lo", "span"))
    found: list[tuple] = []
    run = alone = None  # the first row of the pair, and of the k as long as it has one pair, that the task before ends with
    for _, e in sorted(parts.items()):
        several, head, tail, mine = 6 in e, e.get(6) or e[3], e[4], e.get(5)
        on_k = run is not None and run[0] == head[0]
        on = on_k and run[1] == head[1]
        if on_k and alone is not None and (several or not on):
            found.append((2, *alone[2:]))
            alone = None
        if on and run[2:5] != head[2:5]:
            found.append((1, head[2], head[3], head[4], head[4] + head[5] - 1 + n))
        elif on_k and not on:
            found.append((2, *head[2:]))
        if not (on and tail[:2] == head[:2]):
            run = tail
        if not (mine is not None and on_k and mine[0] == head[0]):
            alone = mine
        elif not on:
            alone = None
    return found if go_on else [x for x in found if x[0] == 1]


def _sorted_round(rows: DataFrame, stage: Stage, name: str, n: int, go_on: bool) -> DataFrame:
    """One round: the global sort of the pairs, the ranks from it, written; kind, doc, sub, lo, span."""
    order = ["k", "sw", "doc", "sub", "lo"]
    ranked = stage.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_rank(n, go_on), _RANKED), name)
    edges = ranked.where("kind > 2").collect()  # at most three rows a task
    found = ranked.sparkSession.createDataFrame(_across(edges, n, go_on), "kind byte, doc long, sub int, lo int, span int")
    return ranked.where("kind in (1, 2)").select("kind", "doc", "sub", "lo", "span").unionByName(found)


def _document(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells documents apart: the id (a null one counts as the largest) and a hash of the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.hash(F.coalesce(F.col(text_col), F.lit("")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, stage: Stage | None = None) -> DataFrame:
    """(doc, sub, spans): for each document with repeats, its spans of repeated bytes; they may overlap."""
    if min_bytes < 16:
        raise ValueError("strings of fewer than 16 bytes have no quarters worth ranking")
    spark = docs.sparkSession
    stage = stage or Stage(spark, "suffix_dedup")
    quarter = -(-min_bytes // 4)
    doc, sub = _document(id_col, text_col)
    texts = docs.select(doc.alias("doc"), sub.alias("sub"), F.col(text_col).alias("text"))
    arrow_batches(spark)
    ranked = _sorted_round(texts.mapInArrow(_scan(min_bytes, quarter), _ROW), stage, "stretches", min_bytes, True)
    torn = ranked.where("kind = 2").groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "span")).alias("spans"))
    places = texts.join(torn, ["doc", "sub"]).select("doc", "sub", "text", "spans").mapInArrow(_positions(min_bytes, quarter), _ROW)
    more = _sorted_round(places, stage, "positions", min_bytes, False)
    every = ranked.where("kind = 1").unionByName(more).select("doc", "sub", "lo", F.col("span").alias("hi"))
    return every.groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(raw: bytes, spans) -> tuple[bytes, int, int]:
    """What remains of a text, the number of bytes removed and of maximal runs."""
    kept, at, removed, runs = [], 0, 0, 0
    for lo, hi in spans:
        kept.append(raw[at:lo])
        removed += hi - lo
        runs += 1
        at = hi
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def _row_spans(col: pa.Array) -> list[list[tuple[int, int]]]:
    """Merged spans of each row of a nullable array of structs (lo, hi)."""
    n = len(col)
    ends = col.offsets.to_numpy()
    base, sizes = ends[0], np.diff(ends)
    if col.null_count:
        sizes = np.where(col.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    flat = col.values.slice(base, ends[-1] - base)
    lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
    pick = np.concatenate([np.arange(s, s + c) for s, c in zip(ends[:-1] - base, sizes, strict=True)] or [np.zeros(0, int)]).astype(np.int64)
    (row,), lo, hi = merge_spans((np.repeat(np.arange(n), sizes),), lo[pick], hi[pick])
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
        out[r].append((a, b))
    return out


def _spans_beside(docs: DataFrame, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """``docs`` with their spans as the last column."""
    spans = repeated_spans(docs, id_col, text_col, min_bytes).select(F.col("doc").alias("_ql_doc"), F.col("sub").alias("_ql_sub"), F.col("spans").alias("_ql_spans"))
    doc, sub = _document(id_col, text_col)
    marked = docs.withColumns({"_ql_doc": doc, "_ql_sub": sub})
    return marked.join(spans, ["_ql_doc", "_ql_sub"], "left").select(*(F.col(f"`{c}`") for c in docs.columns), "_ql_spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; other columns stay.

    A code point of which only some bytes remain goes as well.  ``length_col``, if
    the table has it, gets the new number of code points.
    """
    schema = docs.schema
    length_col = length_col if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = _row_spans(b.column(b.num_columns - 1))
            at = b.schema.get_field_index(text_col)
            texts = [None if t is None else _cut(t.encode(), s)[0].decode("utf-8", "ignore") if s else t for t, s in zip(b.column(at).to_pylist(), spans, strict=True)]
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if length_col:
                i = b.schema.get_field_index(length_col)
                cols[i] = pa.array([len(t or "") for t in texts], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(b.schema)[:-1]))

    return _spans_beside(docs, id_col, text_col, min_bytes).mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), _row_spans(b.column(2)), strict=True):
                raw = (t or "").encode()
                kept, removed, runs = _cut(raw, s)
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))  # a null id stays null
    return _spans_beside(few, "doc_id", "text", min_bytes).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
