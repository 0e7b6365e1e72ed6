"""Exact self-join of texts on the Jaccard similarity of their word shingles, as components.

Set-relation skipping, distributed:

* Equal sets form one class; the join runs over classes.
* Shingles are put in one global order, rare before frequent.  The frequencies come
  from a table of hashed counters, one for 32 shingles, 16 million at most; any
  order gives right results, this one keeps frequent shingles out of the prefixes.
* Two similar sets share at least l shingles among their first
  ``n - ceil(0.8 n) + l``; those prefixes go to an index of lists, sorted by set
  size.  Size alone decides which block of a list can hold partners; the positions of the
  shingle in both sets bound the overlap and drop single pairs, not whole blocks.
* A set whose lists have too little company to reach l leaves the index.
* Answers are derived from those of a highly similar set: for some turns each set is
  compared with one leader only, the one of its lists' leaders with which it shares
  most.  Sets linked to a leader take over its component, and pairs inside a
  component are never formed.  Lists of one component leave the index, and so do sets
  left with too little company.  Then all pairs across components are considered, in the
  shorter lists of each set; those that share enough of them and pass the filters are verified.
* One filter is a map of parities: each shingle flips one of 1024 bits of its set, so the
  maps of two sets differ in no more bits than the sets do in shingles.

Every pair that is linked is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import U64, Stage, arrow_batches, grouped_runs, mix, shingle_sets, signed, sorted_groups, text_chunks
from quantloom.llm.graph import components

WORDS, PERCENT = 5, 80
TURNS = 1
SHORT = 64  # lists up to this length are paired all at once
COUNTERS = (1 << 21, 1 << 24)  # least and greatest number of hashed counters, a byte each
PARITY = 1024  # bits of a set's parity map
TASK_PAIRS = 500  # pairs whose texts one task reads and verifies
FILTER = (1 << 23, 1 << 28)  # least and greatest number of bits of the filter of wanted documents


def needed(n, percent: int):
    """Least overlap that a set of n shingles needs with any similar set."""
    return -(-percent * n // 100)


def shared(n, percent: int):
    """Prefix shingles that two similar sets share at least (the smaller of both values)."""
    return np.minimum(1 + n // 20, np.maximum(needed(n, percent), 1))


def _sets(batch: pa.RecordBatch, at: int, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, buf, offs in text_chunks(batch.column(at)):
        yield i, j, *shingle_sets(buf, offs, width)


def _signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and order-free 64-bit signature of the set of each of n rows."""
    size = np.bincount(rows, minlength=n)
    acc = np.zeros(n, U64)
    start, _ = grouped_runs(rows)
    if len(start):
        acc[rows[start]] = np.add.reduceat(mix(hashes ^ U64(0x243F6A8885A308D3)), start)
    return size, mix(acc + size.astype(U64) * U64(0x13198A2E03707345))


def _size(wanted: int, bounds: tuple[int, int]) -> int:
    """A power of two of at least ``wanted`` within bounds."""
    return min(bounds[1], max(bounds[0], 1 << max(0, int(wanted) - 1).bit_length()))


def _count(width: int, counters: int):
    """Hashed counts of one task, without those too small to tell shingles apart."""

    def run(batches):
        table = np.zeros(counters, np.int32)
        total = 0
        for b in batches:
            for _, _, _, h in _sets(b, 1, width):
                np.add.at(table, (h & U64(counters - 1)).astype(np.int64), 1)
                total += len(h)
        at = np.flatnonzero(table >= max(8, 4 * total // counters))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int64))], names=["at", "n"])

    return run


def _describe(width: int):
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for i, j, rows, h in _sets(b, 1, width):
                n, s = _signatures(rows, h, j - i)
                odd = np.bincount(rows * PARITY + (h & U64(PARITY - 1)).astype(np.int64), minlength=(j - i) * PARITY).astype(np.uint8) & 1
                bits = [x.tobytes() for x in np.packbits(odd.reshape(j - i, PARITY), axis=1)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(signed(s)), pa.array(bits, pa.binary())], names=["doc", "n", "s", "bits"])

    return run


def _prefixes(width: int, percent: int, weights):
    def run(batches):
        weight = weights.value
        last = U64(len(weight) - 1)
        done: set[int] = set()
        for b in batches:
            for i, j, rows, h in _sets(b, 1, width):
                n, s = _signatures(rows, h, j - i)
                fresh = np.zeros(j - i, bool)
                for r in np.flatnonzero(n):
                    if (key := int(s[r])) not in done:
                        done.add(key)
                        fresh[r] = True
                if len(done) > 1_000_000:
                    done.clear()
                keep = fresh[rows]
                rows, h = rows[keep], h[keep]
                if not len(rows):
                    continue
                order = np.lexsort((h, weight[(h & last).astype(np.int64)], rows))
                rows, h = rows[order], h[order]
                start, end = grouped_runs(rows)
                pos = np.arange(len(rows)) - np.repeat(start, end - start)
                size = n[rows]
                keep = pos < size - needed(size, percent) + shared(size, percent)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[keep])), pa.array(signed(s[rows[keep]])), pa.array(size[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["h", "s", "n", "pos"])

    return run


def _summed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    """Pairs with the number of times each is there."""
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(a[start]), pa.array(b[start]), pa.array(na[start]), pa.array(nb[start]), pa.array(np.diff(np.append(start, len(a))).astype(np.int64))], names=["a", "b", "na", "nb", "hits"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of two sets or more; m is the number of sets in the list."""
    for t in sorted_groups(batches, "h"):
        h, s, n, pos = (t.column(c).to_numpy() for c in ("h", "s", "n", "pos"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s, n, pos = h[new], s[new], n[new], pos[new]
        start, end = grouped_runs(h)
        m = np.repeat(end - start, end - start)
        many = m > 1
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (h, s, n, pos, m)], names=["h", "s", "n", "pos", "m"])


def _stars(percent: int, turn: int):
    """A row (leader, set) for each set of a list that is in another component than the list's leader.

    No list gives more rows than it has, however the lists are dealt; Spark adds up the rows of a
    pair.  The leader of the first turn is the set with the most company in all of its lists;
    later turns take another member of its component.
    """

    def run(batches):
        for t in sorted_groups(batches, "h"):
            h, s, n, w, c = (t.column(x).to_numpy() for x in ("h", "s", "n", "w", "c"))
            n = n.astype(np.int64)
            start, end = grouped_runs(h)
            of = np.repeat(np.arange(len(start)), end - start)
            leader = np.lexsort((s, -w, of))[start]
            if turn:
                own = c == c[leader][of]
                leader = np.lexsort((s if turn % 2 else -s, ~own, of))[start]
            leader = leader[of]
            fits = (c != c[leader]) & (100 * np.minimum(n, n[leader]) >= percent * np.maximum(n, n[leader]))
            if fits.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[leader][fits], s[fits], n[leader][fits], n[fits])], names=["a", "b", "na", "nb"])

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of lists that hold two components or more; w becomes the length of the list."""
    for t in sorted_groups(batches, "h"):
        h, c = (t.column(x).to_numpy() for x in ("h", "c"))
        start, end = grouped_runs(h)
        mixed = np.repeat(np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start), end - start)
        if mixed.any():
            t = t.set_column(t.schema.get_field_index("w"), "w", pa.array(np.repeat(end - start, end - start)))
            yield from t.filter(pa.array(mixed)).to_batches()


def _across(percent: int, block: int = 500_000):
    """Pairs of one list that are in two components and pass the filters on size, position and parity.

    The sets outside the list's largest component are held against those inside it and
    against one another, each against the block of sizes that can be similar.
    """

    def run(batches):
        for t in sorted_groups(batches, "h"):
            t = t.combine_chunks()
            h, s, n, pos, c = (t.column(x).to_numpy() for x in ("h", "s", "n", "pos", "c"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), U64).reshape(-1, PARITY // 64)

            def passing(i, j):
                """The pairs of positions i, j that may be similar, counted."""
                ok = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                bound = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
                ok = (100 + percent) * bound >= percent * (n[i] + n[j])
                i, j = i[ok], j[ok]
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)  # at most the symmetric difference
                ok = (100 + percent) * (n[i] + n[j] - apart) >= 2 * percent * (n[i] + n[j])
                i, j = i[ok], j[ok]
                swap = s[i] > s[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                return _summed(s[i], s[j], n[i], n[j]) if len(i) else None

            start, end = grouped_runs(h)
            size = end - start
            short = np.repeat(size <= SHORT, size)
            left = (np.repeat(end, size) - np.arange(len(h)))[short]  # rows of the list from here on
            at = np.flatnonzero(short)
            for step in range(1, SHORT):  # all short lists at once, neighbours at growing distance
                at = at[left > step]
                left = left[left > step]
                if not len(at):
                    break
                if found := passing(at, at + step):
                    yield found
            for x, y in zip(start[size > SHORT].tolist(), end[size > SHORT].tolist(), strict=True):
                names, members = np.unique(c[x:y], return_counts=True)
                inside = c[x:y] == names[members.argmax()]
                outer = np.flatnonzero(~inside) + x
                for pool in (np.flatnonzero(inside) + x, outer):
                    low = np.searchsorted(n[pool], needed(n[outer], percent)) if pool is not outer else np.arange(len(outer)) + 1
                    high = np.searchsorted(n[pool], n[outer] * 100 // percent, "right")
                    count = np.maximum(high - low, 0)
                    ends = np.cumsum(count)
                    at = 0
                    while at < len(outer):
                        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
                        k = count[at:to]
                        i = np.repeat(outer[at:to], k)
                        j = pool[np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[at:to], k)]
                        at = to
                        if found := passing(i, j):
                            yield found

    return run


def _verify(width: int, percent: int):
    def row_sets(b: pa.RecordBatch, at: int) -> list[np.ndarray]:
        out = []
        for i, j, rows, h in _sets(b, at, width):
            cut = np.searchsorted(rows, np.arange(1, j - i))
            out += np.split(h, cut)
        return out

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(row_sets(b, 2), row_sets(b, 3), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(mask)

    return run


def _place(doc: np.ndarray, size: int) -> np.ndarray:
    return (mix(doc.view(U64)) & U64(size - 1)).astype(np.int64)


def _wanted(bits, size: int, width: int):
    """Signature and text of the documents that the filter passes; other documents may pass too."""

    def run(batches):
        table = bits.value
        for b in batches:
            at = _place(b.column(0).to_numpy(), size)
            b = b.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for i, j, rows, h in _sets(b, 1, width):
                _, s = _signatures(rows, h, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(signed(s)), b.column(1).slice(i, j - i)], names=["s", "text"])

    return run


def _filter_bits(size: int):
    def run(batches):
        table = np.zeros(size // 8, np.uint8)
        for b in batches:
            at = _place(b.column(0).to_numpy(), size)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int16))], names=["at", "bits"])

    return run


class NgramJoin:
    """One run of the join over a table with an integer key and a text.

    Defined results: null, empty and blank texts have no shingles and link with
    nothing; a text of fewer words than the width has one shingle, all of its words;
    rows that repeat an id are one document, which links with whatever one of its texts
    links with; rows without an id are left out; an empty table gives an empty result; other
    columns are not read.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT):
        self.spark = docs.sparkSession
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
        self.width, self.percent = width, percent
        self.stage = Stage(self.spark, "ngram_join")

    def _weights(self, shingles: int):
        """Broadcast order of the shingles: a byte each for the hashed counts, eight steps to a doubling."""
        arrow_batches(self.spark)
        size = _size(shingles // 32, COUNTERS)
        counted = self.texts.mapInArrow(_count(self.width, size), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
        counted = counted.select("at", F.least(F.floor(8 * F.log2("n")), F.lit(255)).cast("int").alias("n")).toPandas()
        table = np.zeros(size, np.uint8)
        table[counted["at"].to_numpy(np.int64)] = counted["n"].to_numpy(np.uint8)
        return self.spark.sparkContext.broadcast(table)

    def _verified(self, pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are similar, by their whole sets."""
        pairs = self.stage.write(pairs, f"{name}-pairs")
        tasks = 1 + pairs.count() // TASK_PAIRS
        want = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
        want = self.stage.write(want.join(classes.select("s", "rep"), "s").select("s", F.col("rep").alias("doc")).coalesce(tasks), f"{name}-want")
        size = _size(16 * want.count(), FILTER)
        bits = np.zeros(size // 8, np.uint8)  # at most 32 MB, whatever the input
        found = want.select("doc").mapInArrow(_filter_bits(size), "at int, bits short").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
        near = self.texts.mapInArrow(_wanted(self.spark.sparkContext.broadcast(bits), size, self.width), "s long, text string")
        texts = self.stage.write(want.select("s").join(near, "s").dropDuplicates(["s"]).coalesce(tasks), f"{name}-texts")  # any text of a set will do
        a, b = (texts.select(F.col("s").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        links = self.stage.write(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(self.width, self.percent), "a long, b long").coalesce(tasks), f"{name}-links")
        self.stage.drop(f"{name}-pairs", f"{name}-want", f"{name}-texts")
        return links

    def run(self) -> DataFrame:
        """doc, n_shingles, component_id and n_class (documents of the same set), a row for each row of the table."""
        stage, percent = self.stage, self.percent
        arrow_batches(self.spark)
        sets = stage.write(self.texts.mapInArrow(_describe(self.width), "doc long, n long, s long, bits binary"), "sets")
        classes = stage.write(sets.where("n > 0").groupBy("s").agg(F.min("doc").alias("rep"), F.count("*").alias("n_class"), F.max("bits").alias("bits")), "classes")
        weights = self._weights(sets.agg(F.sum("n")).first()[0] or 0)
        of_doc = sets.where("n > 0").groupBy("doc").agg(F.min("s").alias("a"), F.max("s").alias("z"), F.collect_set("s").alias("b")).where("a <> z")
        shared = of_doc.select("a", F.explode("b").alias("b")).where("a <> b")  # the sets of one document are linked
        found = self.texts.mapInArrow(_prefixes(self.width, percent, weights), "h long, s long, n int, pos int").repartition("h").sortWithinPartitions("h", "n", "s")
        arrow_batches(self.spark)
        lists = stage.write(found.mapInArrow(_lists, "h long, s long, n int, pos int, m long"), "lists")
        row = "h long, s long, n int, pos int, w long, c long"
        smallest = F.ceil(F.col("n") * percent / 100)  # of the sets similar to one of n shingles
        fewest = F.least(1 + F.floor(smallest / 20), F.greatest(F.ceil(smallest * percent / 100), F.lit(1)))

        def by_list(rows: DataFrame) -> DataFrame:
            arrow_batches(self.spark)
            return rows.repartition("h").sortWithinPartitions("h", "n", "s")

        def placed(rows: DataFrame) -> DataFrame:
            return rows.join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("c", F.coalesce("root", "s")).select("h", "s", "n", "pos", "w", "c")

        pair = "a long, b long, na long, nb long, hits long"
        small = F.least("na", "nb")
        least = F.least(1 + F.floor(small / 20), F.greatest(F.ceil(small * percent / 100), F.lit(1)))

        enough = lists.groupBy("s").agg(F.count("*").alias("k"), F.sum("m").alias("w"), F.first("n").alias("n")).where(F.col("k") >= fewest).select("s", "w")
        rows = stage.write(lists.join(enough, "s").select("h", "s", "n", "pos", "w", F.col("s").alias("c")), "members")
        stage.drop("lists")
        links = None
        for turn in range(TURNS):
            stars = by_list(rows).mapInArrow(_stars(percent, turn), "a long, b long, na long, nb long").groupBy("a", "b").agg(F.count("*").alias("hits"), F.min("na").alias("na"), F.min("nb").alias("nb"))
            best = stars.where(2 * F.col("hits") >= least).groupBy("b").agg(F.max_by("a", F.struct("hits", "a")).alias("a")).select("a", "b")  # hits count the lists that the leader leads alone; what this misses is found below
            found = self._verified(best, classes, f"near{turn}")
            links = found if links is None else links.union(found)
            root = components(links, stage, f"near{turn}")
            mixed = stage.write(by_list(placed(rows)).mapInArrow(_mixed, row), f"rows{turn}")
            stage.drop(f"rows{turn - 1}" if turn else "members")
            rows = mixed
        # Of the shingles that similar sets share in their prefixes, ``fewest`` at least, a quarter must be among
        # those that remain when each set leaves its longest lists, three quarters of ``fewest``.  A set with
        # company of other components in fewer lists than ``fewest`` has no partner there.
        own = Window.partitionBy("s")
        rank = F.row_number().over(own.orderBy("w", "h"))
        rows = rows.withColumns({"k": F.count("*").over(own), "r": rank}).where((F.col("k") >= fewest) & (F.col("r") <= F.col("k") - fewest + F.ceil(fewest / 4))).drop("k", "r")
        seen = by_list(rows.join(classes.select("s", "bits"), "s"))
        arrow_batches(self.spark)
        pairs = seen.mapInArrow(_across(percent), pair).groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.least(F.min("na"), F.min("nb")).alias("n"))
        pairs = pairs.where(F.col("hits") >= F.ceil(fewest / 4)).select("a", "b")
        far, of = self._verified(pairs, classes, "far"), root.withColumnRenamed("root", "c")
        for end in "ab":  # links between sets are links between their roots
            far = far.join(of.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        links = root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(far.select("a", "b")).union(shared)
        root = components(links, stage, "all")
        of_class = classes.drop("bits").join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("c", F.coalesce("root", "s"))
        smallest = of_class.groupBy("c").agg(F.min("rep").alias("component_id"))
        labels = stage.write(of_class.join(smallest, "c").select("s", "component_id", "n_class"), "labels")
        return sets.drop("bits").join(labels, "s", "left").select("doc", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_class for every row with an id; see NgramJoin."""
    return NgramJoin(docs, id_col, text_col, width, percent).run().withColumnRenamed("doc", "doc_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component holds a smaller id; rows without an id and all columns stay."""
    gone = near_duplicates(docs, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias("_ql_gone"))
    return docs.join(gone, docs[id_col].cast("long") == F.col("_ql_gone"), "left_anti")
