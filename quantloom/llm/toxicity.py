"""Toxicity of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all texts (letters, word by word).
2. Words that may be disguised (digits or signs inside or at the ends, a letter three times in
   a row, cut by gap characters, letters spaced out) become lattices: each sign stands for itself, for the letters it
   is used for, or for nothing; runs of a letter may be shortened.  Viterbi decoding finds
   the likeliest letters under the trigram model and the costs of the channel.  Other words have
   a single path, themselves.
3. A logistic regression scores the presence of words and of their beginnings (four to
   eight bytes) in the restored text.  It is fitted on one row each of at most
   ``TRAIN_ROWS`` labelled ids, drawn by a hash of the id.  Features are chosen by how far
   their share in toxic texts exceeds that in others.

Counts of the character model cover all texts and come to the driver as one table of 28^3.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import RollingHash, U64, arrow_batches, text_chunks
from quantloom.llm.language_id import fold_letters, is_held_out, letter_runs

TRAIN_ROWS = 20_000
FEATURES = 1 << 20
KEPT_FEATURES = 50_000
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

#: Letters that a sign is used for; fixed values.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "(": "c", "<": "c", "€": "e", "£": "l"}
#: Signs that may stand between the letters of a word.
GAPS = set(".-_*~ '^,/\\")
#: Signs that end a sentence or a decorated word rather than stand for its last letter.
TRAIL = "!|+*(<"
_SIGN_BYTE = np.zeros(256, bool)
_SIGN_BYTE[[ord(c) for c in SIGNS if ord(c) < 128]] = True
_GAP_BYTE = np.zeros(256, bool)
_GAP_BYTE[[ord(c) for c in GAPS]] = True
_NO_GAPS = {ord(c): None for c in GAPS if c not in SIGNS}
_TRIPLE = re.compile(r"(.)\1\1")
_CODE = np.full(256, 27, np.int64)
_CODE[97:123] = np.arange(1, 27)


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts (28 x 28 x 28: edge, a-z, other letters) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(28**3, np.int64)
        for b in batches:
            for _, _, buf, offs in text_chunks(b.column(0)):
                buf = fold_letters(buf)
                lo, hi, _ = letter_runs(buf, offs)
                if not len(lo):
                    continue
                code = _CODE[buf]
                code[buf == 0x20] = 0
                last = np.zeros(len(buf), bool)
                last[lo] = True
                before = np.concatenate(([0], code[:-1]))
                before[lo] = 0
                two = np.concatenate(([0], before[:-1]))
                two[lo] = 0
                inside = code > 0
                table += np.bincount((two * 784 + before * 28 + code)[inside], minlength=28**3)
                end = hi - 1
                table += np.bincount(before[end] * 784 + code[end] * 28, minlength=28**3)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["at", "n"])

    arrow_batches(docs.sparkSession)
    found = docs.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(28**3)
    table[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return table.reshape(28, 28, 28)


_LAST: dict[bytes, Decoder] = {}


class Decoder:
    """Viterbi decoding of disguised words under a character model."""

    SWAP, DROP, LOSE, REPEAT = 1.0, 0.5, 4.0, 0.5  # channel costs in nats: a letter for a sign, a gap or a sign for nothing, a repeat shortened

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.1
        self.cost = (-np.log(smooth / smooth.sum(2, keepdims=True))).tolist()
        self._remember()

    @classmethod
    def of(cls, cost: list) -> Decoder:
        """The decoder of costs already counted; a worker keeps the last one, with what it has read, for its next tasks."""
        key = np.array(cost).tobytes()
        if key not in _LAST:
            made = cls.__new__(cls)
            made.cost = cost
            made._remember()
            _LAST.clear()
            _LAST[key] = made
        return _LAST[key]

    def _remember(self) -> None:
        self.decode = lru_cache(1 << 16)(self._decode)
        self.read = lru_cache(1 << 16)(self._read)

    def _read(self, raw: bytes) -> tuple[bytes, ...]:
        """What a span of a text may stand for: with its last signs as punctuation, and as letters."""
        word = raw.decode("utf-8", "ignore").lower()
        found = {}
        for w in dict.fromkeys((word.rstrip(TRAIL), word)):
            plain = w.translate(_NO_GAPS)
            if not (plain.isalpha() and not _TRIPLE.search(plain)):
                plain = self.decode(w)
            if plain and plain != word:
                found[plain.encode()] = None
        return tuple(found)

    @staticmethod
    @lru_cache(1 << 12)
    def _ways(c: str, n: int) -> tuple[tuple[str, tuple[int, ...], float], ...]:
        """What n of a character in a row may stand for: letters, their codes, and the cost."""
        if c.isalpha():
            ways = [(c * n, 0.0)] if n < 3 else [(c, Decoder.REPEAT), (c * 2, Decoder.REPEAT)]
        elif c in SIGNS:
            ways = [("", Decoder.DROP * n if c in GAPS else Decoder.LOSE * (n + 1))]
            for x in SIGNS[c]:
                ways.append((x * min(n, 2), Decoder.SWAP * n))
                if n > 1:
                    ways.append((x, Decoder.SWAP * n + Decoder.REPEAT))
        else:
            ways = [("", Decoder.DROP)]
        return tuple((x, tuple(ord(y) - 96 if "a" <= y <= "z" else 27 for y in x), e) for x, e in ways)

    @staticmethod
    def _steps(word: str) -> list[tuple[tuple[str, tuple[int, ...], float], ...]]:
        """The ways of each run of a character."""
        steps = []
        i = 0
        while i < len(word):
            j = i + 1
            while j < len(word) and word[j] == word[i]:
                j += 1
            steps.append(Decoder._ways(word[i], j - i))
            i = j
        return steps

    def _decode(self, word: str) -> str:
        """The likeliest letters behind a lower-cased word.

        A state is the pair of last letters; each keeps a pointer to the state it came from, so a step takes constant
        time and memory however long the word is.
        """
        price = self.cost
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for ways in self._steps(word):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for letters, codes, extra in ways:
                    x, y, total = a, b, cost + extra
                    for z in codes:
                        total += price[x][y][z]
                        x, y = y, z
                    known = new.get((x, y))
                    if known is None or total < known[0]:
                        new[x, y] = (total, (path, letters) if letters else path)
            best = new
        path = min(((cost + self.cost[a][b][0], (a, b)) for (a, b), (cost, _) in best.items()))[1]
        path = best[path][1]
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))


def disguised(buf: np.ndarray, folded: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of the byte spans that may be disguised words."""
    n = len(buf)
    if n < 2:
        return []
    letter = folded != 0x20
    row_of = lambda p: np.searchsorted(offs, p, "right") - 1
    sign = _SIGN_BYTE[buf] & ~letter
    body = letter | sign
    body_cut = np.zeros(n + 1, bool)
    body_cut[offs] = True
    start = body.copy()
    start[1:] &= ~body[:-1] | body_cut[1:n]
    end = body.copy()
    end[:-1] &= ~body[1:] | body_cut[1:n]
    lo, hi = np.flatnonzero(start), np.flatnonzero(end) + 1
    triple = np.zeros(n, bool)
    triple[2:] = letter[2:] & (folded[2:] == folded[1:-1]) & (folded[1:-1] == folded[:-2]) & (folded[2:] < 0x80)
    flags = np.concatenate(([0], np.cumsum(sign | triple)))
    letters = np.concatenate(([0], np.cumsum(letter)))
    odd = (flags[hi] > flags[lo]) & (letters[hi] > letters[lo]) & ((letters[hi] - letters[lo] >= 2) | (hi - lo >= 3))
    spans = [(lo[odd], hi[odd])]
    solid = np.concatenate(([0], np.cumsum(~_GAP_BYTE[buf] | sign)))  # bytes that are no gap
    blanks = np.concatenate(([0], np.cumsum(buf == 0x20)))
    row = row_of(lo)
    joined = np.zeros(len(lo) + 1, bool)  # nothing but gap characters since the word before
    joined[1:-1] = (solid[lo[1:]] == solid[hi[:-1]]) & (row[1:] == row[:-1])
    joined[1:-1] &= lo[1:] > hi[:-1]
    cut = joined.copy()  # and none of them a blank
    cut[1:-1] &= blanks[lo[1:]] == blanks[hi[:-1]]
    first, last = np.flatnonzero(~cut[:-1] & cut[1:]), np.flatnonzero(cut[:-1] & ~cut[1:])
    spans.append((lo[first], hi[last]))
    single = hi - lo == 1  # runs of single letters, alone and with the words next to them
    linked = joined[:-1] & np.concatenate(([False], single[:-1]))
    first = np.flatnonzero(single & ~linked)
    linked = joined[1:] & np.concatenate((single[1:], [False]))
    last = np.flatnonzero(single & ~linked)
    left, right = joined[first], joined[last + 1]
    spans.append((lo[first], hi[last]))
    spans.append((lo[first[left] - 1], hi[last[left]]))
    spans.append((lo[first[right]], hi[last[right] + 1]))
    spans.append((lo[first[left & right] - 1], hi[last[left & right] + 1]))
    x, y = (np.concatenate(z) for z in zip(*spans, strict=True))
    some = (letters[y] > letters[x]) & (y - x >= 2)
    x, y = np.unique(np.stack((x[some], y[some])), axis=1)
    return list(zip(row_of(x).tolist(), x.tolist(), y.tolist(), strict=True))


def features(buf: np.ndarray, offs: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each word and each beginning of a word, in the texts and in what their disguised words stand for."""
    folded = fold_letters(buf)
    extra, rows = [], []
    for r, a, b in disguised(buf, folded, offs):
        for plain in decoder.read(buf[a:b].tobytes()):
            extra.append(plain + b" ")
            rows.append(r)
    out = [_word_features(folded, offs)]
    if extra:
        tail = np.frombuffer(b"".join(extra), np.uint8)
        r, f = _word_features(tail, np.concatenate(([0], np.cumsum([len(x) for x in extra]))))
        out.append((np.array(rows)[r], f))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _word_features(folded: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi, row = letter_runs(folded, offs)
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolling = RollingHash(folded)
    rows, found = [row], [rolling.spans(lo, hi)]
    for k in PREFIXES:
        longer = hi - lo > k
        rows.append(row[longer])
        found.append(rolling.spans(lo[longer], lo[longer] + k) ^ U64(0xA5A5A5A5A5A5A5A5))
    return np.concatenate(rows), (np.concatenate(found) >> U64(44)).astype(np.int64)


def _present(rows: np.ndarray, found: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of the features kept, sorted."""
    ok = keep[found]
    both = np.unique(rows[ok] * FEATURES + found[ok])
    return both // FEATURES, both % FEATURES


def fit(rows: DataFrame, decoder: Decoder) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (text, toxic), a bounded number of them; zero weights where one label is missing."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(decoder.cost)

    def model() -> Decoder:
        return Decoder.of(shipped.value)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, FEATURES), np.int32)
        total = np.zeros(2, np.int64)
        mine = model()
        every = np.ones(FEATURES, bool)
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in text_chunks(b.column(0)):
                r, f = _present(*features(buf, offs, mine), every)
                for y in (0, 1):
                    table[y] += np.bincount(f[label[i:j][r] == y], minlength=FEATURES).astype(np.int32)
                    total[y] += int((label[i:j] == y).sum())
        at = np.flatnonzero(table.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(table[0, at], total[0]).astype(np.int64)), pa.array(np.append(table[1, at], total[1]).astype(np.int64))], names=["at", "no", "yes"])

    counts = rows.mapInArrow(count, "at int, no long, yes long").groupBy("at").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).where("yes + no >= 4").toPandas()
    all_rows = counts[counts["at"] == -1]
    counts = counts[counts["at"] >= 0]
    weights = np.zeros(FEATURES, np.float32)
    n0, n1 = (float(all_rows[c].sum()) for c in ("no", "yes"))
    if not n0 or not n1:
        return weights, -4.0 if n0 or not n1 else 4.0
    p1, p0 = (counts["yes"] + 0.1) / (n1 + 0.2), (counts["no"] + 0.1) / (n0 + 0.2)
    gain = (p1 - p0) / np.sqrt((counts["yes"] + counts["no"] + 1) / (n0 + n1) / n1)
    gain = gain.where(p1 > 2 * p0, 0)
    best = counts["at"].to_numpy()[np.argsort(-gain.to_numpy(), kind="stable")[: min(KEPT_FEATURES, int((gain > 1.5).sum()))]]
    keep = np.zeros(FEATURES, bool)
    keep[best] = True
    kept = spark.sparkContext.broadcast(np.packbits(keep))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = model()
        mask = np.unpackbits(kept.value).astype(bool)
        for b in batches:
            for i, j, buf, offs in text_chunks(b.column(0)):
                r, f = _present(*features(buf, offs, mine), mask)
                cut = np.searchsorted(r, np.arange(1, j - i))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array([x.astype(np.int32) for x in np.split(f, cut)], pa.list_(pa.int32()))], names=["y", "f"])

    data = rows.mapInArrow(gather, "y int, f array<int>").toPandas()
    y = data["y"].to_numpy(float)
    size = data["f"].str.len().to_numpy(int)
    col = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in data["f"])])
    names, col = np.unique(col, return_inverse=True)
    row = np.repeat(np.arange(len(y)), size)
    w, bias = _logistic(row, col, y, len(names))
    weights[names] = w
    return weights, bias


def _logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by Adam over all rows."""
    w = np.zeros(width + 1)
    w[-1] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[:-1][col], len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(col, error[row], width) + ridge * w[:-1], error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, decoder: Decoder, weights: np.ndarray, bias: float, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1; null and empty texts get that of a text without any feature."""
    spark = docs.sparkSession
    docs = docs.drop(out)
    at = np.flatnonzero(weights).astype(np.int32)
    shipped = spark.sparkContext.broadcast((decoder.cost, at, weights[at], bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, at, w, base = shipped.value
        mine = Decoder.of(cost)
        table = np.zeros(FEATURES)
        table[at] = w
        keep = np.zeros(FEATURES, bool)
        keep[at] = True
        for b in batches:
            parts = []
            for i, j, buf, offs in text_chunks(b.column(b.schema.get_field_index(text_col))):
                r, f = _present(*features(buf, offs, mine), keep)
                z = np.bincount(r, table[f], j - i) + base
                parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*b.schema.names, out])

    arrow_batches(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learned from labelled rows that aren't held out.

    A null id is never held out nor learned from; of several labels of one id the
    greatest holds; of several texts of one id one is learned from.  Without labels of both kinds all rows score alike.  An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    decoder = Decoder(count_characters(docs, text_col))
    known = labels.select(F.col("doc_id").alias("_ql_id"), F.col(label_col).cast("int").alias("_ql_y")).where("_ql_id is not null and _ql_y in (0, 1)").where(~is_held_out("_ql_id", folds, fold))
    known = known.groupBy("_ql_id").agg(F.max("_ql_y").alias("_ql_y")).orderBy(F.xxhash64("_ql_id"), "_ql_id").limit(train_rows)
    train = docs.select(F.col(id_col).alias("_ql_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_ql_id")
    train = train.groupBy("_ql_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_ql_y").alias("y")).select("text", "y")  # at most train_rows
    weights, bias = fit(train, decoder)
    few = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    return score(few, decoder, weights, bias).select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
