"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased with white space runs as single blanks.  A test
item of length m has an error budget of e = floor(rate * m) edits and is cut
into e + 1 pieces.  An occurrence with at most e edits leaves one piece intact, so
every occurrence is found at an exact hit of a piece (one automaton over all
pieces scans each text once).  Around a hit, Myers' bit-parallel algorithm gives
the edit distance of the whole item to the best substring.

An item of fewer than ``WHOLE_CHARS`` (20) has no budget: it must occur exactly, and as whole words.

The items travel to the tasks in blocks of about ``BLOCK_CHARS`` (dealt by a hash), one scan of the
documents per block, written before the next one begins, so a large benchmark takes more scans rather
than more memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Stage, arrow_batches

RATE = 0.05
WHOLE_CHARS = 20
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """Error budget, and (offset, piece) of the budget plus one pieces of nearly equal length."""
    budget = int(rate * len(item))
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, budget: int) -> int | None:
    """Least edit distance of the pattern to a substring of the text, None beyond the budget."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = every, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | (~(diagonal | up) & every)
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1) & every  # a match may start anywhere: no step up along the text's edge
        fall = (fall << 1) & every
        up = fall | (~(diagonal | rise) & every)
        down = rise & diagonal
        best = min(best, score)
    return best if best <= budget else None


class Matcher:
    """The automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, text, int(rate * len(text))) for i, text in items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text) in enumerate(items):
            for offset, piece in pieces(text, rate)[1]:
                at[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    @staticmethod
    def whole_words(text: str, lo: int, hi: int) -> bool:
        """Whether text[lo:hi] neither begins nor ends inside a word."""
        return not (lo and text[lo].isalnum() and text[lo - 1].isalnum() or hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum())

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item, least distance) of every item that occurs within its budget."""
        if not self.any:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        exact: set[int] = set()
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                if n in exact:
                    continue
                if self.items[n][2]:
                    starts[n].add(end - size + 1 - offset)
                elif size >= WHOLE_CHARS or self.whole_words(text, end - size + 1, end + 1):
                    exact.add(n)
        out = {self.items[n][0]: 0 for n in exact}
        for n, found in starts.items():
            item, pattern, budget = self.items[n]
            if pattern in text:
                out[item] = 0
                continue
            best = None
            spans: list[list[int]] = []
            for s in sorted(found):
                lo, hi = max(0, s - budget), s + len(pattern) + budget
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                d = myers(pattern, text[lo:hi], budget)
                if d is not None and (best is None or d < best):
                    best = d
            if best is not None:
                out[item] = min(best, out.get(item, best))
        return sorted(out.items())


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size, one on the driver at a time; an item of several texts has each of them."""
    few = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    chars = few.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-int(chars) // BLOCK_CHARS))
    few = few.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    for i in range(count):
        items = [(r["item"], normal(r["text"])) for r in few.where(F.col("block") == i).collect()]
        if items := sorted(x for x in items if x[1]):
            yield items


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with _ql_items, _ql_distances: the items each text contains within their budgets."""
    spark = docs.sparkSession
    stage = Stage(spark, "decontamination")
    arrow_batches(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    array = pa.list_(pa.int64())

    def scan(shipped, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for b in batches:
                found = [matcher.find(normal(t)) if t else [] for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                new = [[[x[k] for x in f] for f in found] for k in (0, 1)]
                if not first:
                    new = [[a + c for a, c in zip(b.column(at).to_pylist(), n, strict=True)] for at, n in zip((-2, -1), new, strict=True)]
                kept = b.columns if first else b.columns[:-2]
                names = b.schema.names if first else b.schema.names[:-2]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, array) for x in new)], names=[*names, "_ql_items", "_ql_distances"])

        return run

    out, done = docs, 0
    for block in _blocks(benchmark, item_col, item_text_col):
        if done:  # a plan holds one scan, and tasks one automaton
            out = stage.write(out, f"scan{done}")
            stage.drop(f"scan{done - 1}")
        out = out.mapInArrow(scan(spark.sparkContext.broadcast(block), not done), f"{schema}, _ql_items array<long>, _ql_distances array<long>")
        done += 1
    if not done:
        none = F.array().cast("array<long>")
        out = docs.withColumns({"_ql_items": none, "_ql_distances": none})
    return out


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, min_distance for every row of ``docs``.

    Null and empty texts contain nothing.  Items that are null or blank don't take part; items of
    one id and several texts match by any of them.  Empty tables give an empty result, or one without matches.
    """
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = matches(few, benchmark, rate=rate)
    return found.select("doc_id", (F.size("_ql_items") > 0).alias("contaminated"), F.size(F.array_distinct("_ql_items")).alias("n_items"), F.array_sort(F.array_distinct("_ql_items")).alias("item_ids"), F.array_min("_ql_distances").alias("min_distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a test item; columns stay."""
    return matches(docs, benchmark, text_col).where(F.size("_ql_items") == 0).drop("_ql_items", "_ql_distances")
