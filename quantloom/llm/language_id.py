"""Language identification as inference of a multilingual mixture.

Each word is a bag of byte 4-grams (of the lower-cased letters, with the word's
edges); a language gives it a likelihood from gram counts over all labelled
training texts.  A document is a mixture of languages: expectation-maximisation
over its words estimates the proportions, for the k likeliest languages with
k = 1, 2, ..., and the set with the best penalised likelihood is selected.  The
prediction is the largest share in that set.

The model has a fixed number of counters per language, whatever the corpus (half a
megabyte each, sent to all tasks); the counts cover every training document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_batches, text_chunks

BUCKETS = 1 << 17
ROUNDS, TOLERANCE = 50, 1e-3
LEAST_SHARE = 0.5  # of a document's words in its main language
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold_letters(buf: np.ndarray) -> np.ndarray:
    """Lower-cased letters (ASCII and the Latin-1 block); other ASCII becomes a blank."""
    out = _FOLD[buf]
    upper = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)) + 1
    out[upper] += 0x20
    return out


def letter_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the runs of letters in folded bytes."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = buf != 0x20
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    lo = np.flatnonzero(first)
    return lo, np.flatnonzero(last) + 1, np.searchsorted(offs, lo, "right") - 1


def word_grams(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram, word by word, and the first gram of each word (length + 1 of them)."""
    size = hi - lo + 1
    start = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(start, size)
    pos = np.repeat(lo, size) + at
    n = len(buf)
    wide = buf.astype(np.uint32)
    inner = np.full(len(at), 0, np.uint32)
    for back in range(4):
        byte = np.where(at >= back, wide[np.clip(pos - back, 0, n - 1)], np.uint32(0x20 if back == 1 else 0))
        if back == 1:
            byte = np.where(at == 0, np.uint32(0x20), byte)
        elif back > 1:
            byte = np.where(at == back - 1, np.uint32(0x20), byte)
        inner |= byte.astype(np.uint32) << np.uint32(8 * back)
    last = start + size - 1
    inner[last] = (inner[last] & np.uint32(0xFFFFFF00)) | np.uint32(0x20)
    return ((inner * np.uint32(0x9E3779B1)) >> np.uint32(15)).astype(np.int64), start


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (one row of BUCKETS each) from every given row.

    Rows without a text or a language teach nothing.  The counts are added up over
    all rows; only a table of languages by BUCKETS comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for i, j, buf, offs in text_chunks(b.column(0)):
                buf = fold_letters(buf)
                lo, hi, row = letter_runs(buf, offs)
                if not len(lo):
                    continue
                grams, start = word_grams(buf, lo, hi)
                of = np.repeat(row, np.diff(np.append(start, len(grams))))
                names = langs[i:j]
                for lang in set(names[np.unique(row)].tolist()):
                    mine = np.bincount(grams[(names == lang)[of]], minlength=BUCKETS)
                    tables[lang] = tables[lang] + mine if lang in tables else mine
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int64))], names=["lang", "at", "n"])

    spark = docs.sparkSession
    arrow_batches(spark)
    few = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = few.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        mine = counts[counts["lang"] == lang]
        table[i, mine["at"].to_numpy(np.int64)] = mine["n"].to_numpy(float)
    used = max(1, int((table.sum(0) > 0).sum()))
    model = np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * used))
    return langs, model.astype(np.float32)


def _mixture(lik: np.ndarray, start: np.ndarray, count: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions under EM restricted to ``mask`` (documents by languages), and the log-likelihood of each document.

    A document leaves the rounds when its proportions move by less than ``TOLERANCE``, or after ``ROUNDS``.
    """
    share = mask / mask.sum(1, keepdims=True)
    todo = np.flatnonzero(mask.sum(1) > 1)
    for _ in range(ROUNDS):
        if not len(todo):
            break
        size = count[todo]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first - start[todo], size)
        part = lik[at] * np.repeat(share[todo], size, axis=0)
        part /= part.sum(1, keepdims=True)
        new = np.add.reduceat(part, first) / size[:, None]
        moved = np.abs(new - share[todo]).max(1)
        share[todo] = new
        todo = todo[moved > TOLERANCE]
    total = (lik * np.repeat(share, count, axis=0)).sum(1)
    return share, np.add.reduceat(np.log(total), start)


def infer(lik: np.ndarray, start: np.ndarray, count: np.ndarray, penalty: float = 4.0) -> np.ndarray:
    """Proportions (documents by languages) of the language set with the best penalised likelihood.

    lik: likelihood of each word in each language, the best of a word being 1 (and a floor added); the words
    of a document follow one another.  A set of k languages costs penalty * (k - 1) * log(1 + words).  As no set
    fits better than a likelihood of the best language for each word, larger sets are tried only
    while that bound less their cost beats what has been found.
    """
    docs, langs = len(count), lik.shape[1]
    single = np.add.reduceat(np.log(lik), start)
    result = np.zeros((docs, langs))
    result[np.arange(docs), single.argmax(1)] = 1
    value = single.max(1)
    bound = np.add.reduceat(np.log(lik.max(1)), start)
    cost = penalty * np.log1p(count)
    open_ = np.flatnonzero(bound - cost > value + 1e-9)
    if not len(open_):
        return result
    size = count[open_]
    first = np.cumsum(size) - size
    lik = lik[np.arange(int(size.sum())) - np.repeat(first - start[open_], size)]
    every, _ = _mixture(lik, first, size, np.ones((len(open_), langs)))
    rank = np.argsort(np.argsort(-every, axis=1, kind="stable"), axis=1, kind="stable")
    for k in range(2, langs + 1):
        some = np.flatnonzero(bound[open_] - (k - 1) * cost[open_] > value[open_] + 1e-9)
        if not len(some):
            break
        few = size[some]
        at = np.cumsum(few) - few
        mine = lik[np.arange(int(few.sum())) - np.repeat(at - first[some], few)]
        share, fit = _mixture(mine, at, few, (rank[some] < k).astype(float))
        fit -= (k - 1) * cost[open_[some]]
        better = fit > value[open_[some]] + 1e-9
        value[open_[some[better]]], result[open_[some[better]]] = fit[better], share[better]
    return result


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns, the language and its share; null texts and texts without a letter are ``und``, 0.

    A model without languages predicts ``und`` throughout.  Existing columns of these ``names`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for b in batches:
            preds: list[str] = []
            scores: list[np.ndarray] = []
            for i, j, buf, offs in text_chunks(b.column(text_col)):
                raw, buf = buf, fold_letters(buf)
                lo, hi, row = letter_runs(buf, offs)
                pred = np.full(j - i, -1)
                score = np.zeros(j - i)
                if len(lo) and langs:
                    grams, first = word_grams(buf, lo, hi)
                    logp = np.stack([np.add.reduceat(t[grams], first) for t in table], axis=1).astype(float)
                    lik = np.exp(logp - logp.max(1, keepdims=True)) + 1e-6
                    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    share = infer(lik, start, np.diff(np.append(start, len(row))))
                    of = row[start]
                    pred[of] = share.argmax(1)
                    score[of] = np.clip(share.max(1), 0, 1)
                    plain = np.zeros(j - i, bool)
                    plain[row[buf[lo] < 0x80]] = True
                    for r in of[~plain[of]]:  # no word begins with an ASCII letter
                        if not _has_letter(raw[offs[r] : offs[r + 1]].tobytes()):
                            pred[r], score[r] = -1, 0
                preds += [UNKNOWN if p < 0 else langs[p] for p in pred]
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*b.schema.names, *names])

    arrow_batches(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def is_held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into the fold; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows that aren't held out.

    A null id is never held out and never learned from.  An empty table gives an empty result.
    """
    held = is_held_out(id_col, folds, fold)
    langs, model = learn(docs.where(~held & F.col(id_col).isNotNull()), text_col, lang_col)
    few = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return predict(few, langs, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_told(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> DataFrame:
    """``docs`` with the inferred main language in ``lang_col``, without the rows that have none; other columns stay.

    Rejected are null texts, texts without a letter, and mixtures in which no language has
    ``least_share`` of the words.  Without a labelled row nothing can be told and every row goes.
    """
    held = is_held_out(id_col, 3, 1)
    langs, model = learn(docs.where(~held & F.col(id_col).isNotNull()), text_col, lang_col)
    marked = predict(docs, langs, model, text_col, ("_ql_lang", "_ql_share"))
    kept = marked.where((F.col("_ql_lang") != UNKNOWN) & (F.col("_ql_share") >= least_share))
    return kept.withColumn(lang_col, F.col("_ql_lang")).drop("_ql_lang", "_ql_share")
