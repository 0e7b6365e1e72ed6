"""License texts in documents, by MinHash bands over overlapping windows, in DataFrame operations only.

Texts and templates are sequences of lower-cased alphanumeric words; their shingles
are pairs of words (notices may have three words, so wider shingles can't tell them).
Windows of ``WINDOW`` shingles, one at every half window, get one minimum per band under as
many hash functions, in documents and templates alike; templates of fewer shingles are one window.
Windows that share a band's minimum with a window of a template retrieve it, and a
retrieved template is verified by the share of its shingles that occur around the window.

A window that holds a template of t shingles, or of which half of the shingles are a
template's, shares one band with probability t / WINDOW, or a third, at least; the number of bands is such that
the least template is retrieved with ``COLLISION`` probability or more.  Overlapping windows, and for
longer templates many windows, add to that.

Templates are a table of any size.  A window whose shingles are in no template can't share a minimum with one;
such windows are dropped before their minima are computed, which changes no result.  What may be a template's
shingle is told by a table of bits, 512 for each shingle of the templates and ``MOST_BITS`` at most, so a longer list only
lets more windows through.  The minima meet by an equi-join, which Spark broadcasts if the templates are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import Stage

WINDOW, STEP = 8, 4
COLLISION, CONTAINED = 0.99, 0.8
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 22
#: Notices by license; fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
)


def bands_needed(shingles: int, window: int = WINDOW, collision: float = COLLISION) -> int:
    """Bands of one minimum each with which a window that holds a template of so many shingles collides with that probability."""
    share = min(1.0, shingles / window)
    return 1 if share >= 1 else math.ceil(math.log(1 - collision) / math.log(1 - share))


def _shingles(text: Column) -> tuple[Column, Column]:
    """Hashes of the words, and of the pairs of neighbours (empty for texts of one word or none)."""
    h = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    n = F.greatest(F.size("_ql_w") - 1, F.lit(0))
    return h, F.zip_with(F.slice("_ql_w", F.lit(1), n), F.slice("_ql_w", F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _with_shingles(df: DataFrame, text_col: str) -> DataFrame:
    words, pairs = _shingles(F.col(text_col))
    return df.withColumn("_ql_w", words).withColumn("sh", pairs).drop("_ql_w")


def _minima(part: Column, bands: int) -> Column:
    """A struct (band, least) for each band of a window's shingles."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(part, lambda x: F.xxhash64(x, j))).alias("least")))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """license, text of a list of pairs."""
    return spark.createDataFrame(list(templates), "license string, text string")


def _known(templates: DataFrame) -> DataFrame:
    """template, license, sh, shingles (distinct) of each distinct template of two words or more."""
    few = _with_shingles(templates.select("license", "text").where("license is not null").distinct(), "text")
    few = few.withColumn("template", F.xxhash64("license", "text")).withColumn("shingles", F.array_distinct("sh"))
    return few.select("template", "license", "sh", "shingles").where("size(shingles) > 0")


def _index(known: DataFrame, bands: int) -> DataFrame:
    """template, band, least: the distinct minima of the templates' windows."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("sh") - 1 - (WINDOW - STEP), F.lit(0)), F.lit(STEP))
    windows = known.select("template", "sh", F.explode(starts).alias("s")).select("template", F.slice("sh", F.col("s") + 1, F.lit(WINDOW)).alias("part"))
    return windows.select("template", F.explode(_minima(F.col("part"), bands)).alias("x")).select("template", "x.band", "x.least").distinct()


def _bits(known: DataFrame) -> list[int]:
    """A table of bits as longs (half a megabyte at most): set where a shingle of a template may be."""
    every = known.select(F.explode("shingles").alias("x")).distinct()
    size = LEAST_BITS
    wanted = 512 * every.count()
    while size < min(wanted, MOST_BITS):
        size *= 2
    at = F.pmod("x", F.lit(size))
    bit = F.expr(f"shiftleft(1L, cast(pmod(x, {size}) % 64 as int))")
    words = every.groupBy(F.floor(at / 64).cast("int").alias("i")).agg(F.bit_or(bit).alias("x")).collect()
    table = [0] * (size // 64)
    for r in words:
        table[r["i"]] = r["x"]
    return table


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, position (of the first word of the first window found), containment (the best): a row for each license found in a document.

    ``templates`` is a table (license, text), by default TEMPLATES; rows with a null license, and texts of one word
    or none, are left out.  Null, empty and one-word texts hold no license; rows that repeat an id count as one
    document, rows with a null id as another; documents without a license have no row; an empty table or
    no templates give an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "license_scan")
    known = stage.write(_known(template_table(spark) if templates is None else templates), "known")
    least, longest = known.agg(F.min(F.size("shingles")), F.max(F.size("sh"))).first()
    bands = bands_needed(least or WINDOW)
    longest = longest or 0
    index = stage.write(_index(known, bands), "index")
    table = _bits(known)
    bits = F.expr(f"array({', '.join(f'{x}L' if x > -(2**63) else '-9223372036854775807L - 1L' for x in table)})")
    size = 64 * len(table)

    def may_be_known(x: Column) -> Column:
        return F.getbit(F.get(bits, F.shiftrightunsigned(F.pmod(x, F.lit(size)), 6).cast("int")), F.pmod(x, F.lit(64)).cast("int")) == 1

    few = _with_shingles(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_ql_t"), F.xxhash64(text_col).alias("of")), "_ql_t").drop("_ql_t")
    few = few.withColumn("hits", F.filter(F.sequence(F.lit(0), F.greatest(F.size("sh") - 1, F.lit(0))), lambda i: may_be_known(F.get(F.col("sh"), i))))
    # No filter stands on these arrays (explode_outer infers none): pushed down, it would compute them once for each element.
    near = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.filter(F.array(F.floor(i / STEP) * STEP, F.floor(i / STEP) * STEP - STEP), lambda s: s >= 0))))
    windows = few.select("doc_id", "of", "sh", F.explode_outer(near).alias("start")).where("start is not null").withColumn("start", F.col("start").cast("int"))
    block = F.floor(F.col("start") / max(1, longest)).cast("int")
    around = F.slice("sh", F.greatest((block - 1) * longest, F.lit(0)) + 1, F.lit(WINDOW + 3 * longest))  # all that a template near the window can cover
    windows = windows.select("doc_id", "of", block.alias("block"), around.alias("around"), "start", F.slice("sh", F.col("start") + 1, F.lit(WINDOW)).alias("part"))
    banded = windows.select("doc_id", "of", "block", "around", "start", F.explode_outer(_minima(F.col("part"), bands)).alias("x")).select("doc_id", "of", "block", "around", "start", "x.band", "x.least")
    near = banded.join(index, ["band", "least"]).groupBy("doc_id", "of", "template", "block").agg(F.first("around").alias("around"), F.min("start").alias("start"))
    share = F.size(F.array_intersect("shingles", "around")) / F.size("shingles")
    checked = near.join(known.select("template", "license", "shingles"), "template").withColumn("share", share).where(F.col("share") >= contained)
    return checked.groupBy("doc_id", "license").agg(F.min("start").cast("int").alias("position"), F.max("share").alias("containment"))
