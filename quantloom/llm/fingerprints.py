"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is its sequence of words; of a word over ``LONG`` code points (a language without blanks, encoded
bytes, minified code) each code point counts as a word, so such texts have k-mers, too.  A k-mer (six words) is chosen if the least of its
inner pairs of words, by hash, is the first or the last: whether it is chosen depends on its
own words alone, so an edit elsewhere never changes it, unlike with minimisers.
The 64 least of a text's distinct chosen k-mers, by hash, with the place of their first word
(of the first occurrence) are its sketch; the fingerprint is the sketch in hexadecimal.

Likeness is by position: of the k-mers that two sketches share, those count whose places
differ by the same shift (the median of all, give or take ``SLACK`` words), so texts
that hold the same pieces in another order aren't alike.  It is Dice's coefficient of the
sets of chosen k-mers as the sketches estimate it, for the k-mers that count: 1 for equal
texts, 0 for disjoint ones.

A k-mer is certain to be chosen from nine words on only: a text without one has its words for
a fingerprint, and is compared with any other text by the sketches of their words.
``anchors`` lists all chosen k-mers with their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

K, S, SKETCH, SLACK, LONG = 6, 2, 64, 32, 40
BUCKET_ROWS, MAX_BUCKETS = 128, 1 << 18
WHITE = r"[\x09-\x0D\x20]+"
BELOW = -float(2**64)  # below every id


def _hashed(text: Column) -> Column:
    """Hashes of the words of a text, of the code points of long words; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    apart = F.flatten(F.transform(F.split(text, WHITE), lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    units = F.when(text.rlike(rf"[^\x09-\x0D\x20]{{{LONG + 1}}}"), apart).otherwise(F.split(text, WHITE))
    return F.transform(F.filter(units, lambda w: w != ""), lambda w: F.xxhash64(w))


def _chosen(h: Column, pairs: Column) -> Column:
    """0-based starts of the chosen k-mers."""
    inner = K - S + 1

    def edge(i: Column) -> Column:
        least = F.array_min(F.slice(pairs, i + 1, F.lit(inner)))
        return (least == F.get(pairs, i)) | (least == F.get(pairs, i + (inner - 1)))

    return F.when(F.size(h) >= K, F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - K, F.lit(0))), edge)).otherwise(F.array().cast("array<int>"))


def _with_words(df: DataFrame, text: Column) -> DataFrame:
    """df with _ql_h, the hashes of the words, and _ql_p, those of pairs of neighbours."""
    n = F.greatest(F.size("_ql_h") - 1, F.lit(0))
    df = df.withColumn("_ql_h", _hashed(text))
    return df.withColumn("_ql_p", F.zip_with(F.slice("_ql_h", F.lit(1), n), F.slice("_ql_h", F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def _with_sketch(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the sketches of a text's chosen k-mers and of its words: 32-bit hashes above 32-bit places, ascending."""
    placed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 32).bitwiseOR(i.cast("long"))
    df = _with_words(df, text)
    kmers = F.transform(_chosen(F.col("_ql_h"), F.col("_ql_p")), lambda i: placed(F.xxhash64(F.slice(F.col("_ql_h"), i + 1, F.lit(K))), i))
    df = df.withColumns({"_ql_k": F.sort_array(kmers), "_ql_w": F.sort_array(F.transform("_ql_h", placed))})

    def least(name: str) -> Column:
        """The first place of each of the least hashes; the column is named twice, so it isn't computed anew for each element."""
        values = F.col(name)
        first = F.filter(values, lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(values, i - 1), 32)))
        return F.slice(first, 1, SKETCH)

    return df.withColumn(out, F.struct(least("_ql_k").alias("kmers"), least("_ql_w").alias("words"))).drop("_ql_h", "_ql_p", "_ql_k", "_ql_w")


def written(sketch: Column) -> Column:
    """A sketch as text, 16 hexadecimal digits a value (hash, place): of the words where no k-mer is chosen; empty for a text without words."""
    values = F.when(F.size(sketch["kmers"]) > 0, sketch["kmers"]).otherwise(sketch["words"])
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the likeness of the texts of two sketches, of their words where either has no chosen k-mer; two texts without words are alike."""
    x, y = F.col(a), F.col(b)
    by_kmers = (F.size(x["kmers"]) > 0) & (F.size(y["kmers"]) > 0)
    pick = lambda s: F.when(by_kmers, s["kmers"]).otherwise(s["words"])
    hashes = lambda c: F.transform(c, lambda v: F.shiftright(v, 32))
    places = lambda c: F.transform(c, lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)))
    df = df.withColumns({"_ql_x": pick(x), "_ql_y": pick(y)})
    df = df.withColumns({"_ql_xh": hashes("_ql_x"), "_ql_yh": hashes("_ql_y"), "_ql_xp": places("_ql_x"), "_ql_yp": places("_ql_y")})
    df = df.withColumn("_ql_u", F.slice(F.sort_array(F.array_union("_ql_xh", "_ql_yh")), 1, SKETCH))
    place = lambda p, h, v: F.get(F.col(p), (F.array_position(F.col(h), v) - 1).cast("int"))
    shared = F.array_intersect(F.array_intersect("_ql_u", "_ql_xh"), "_ql_yh")
    df = df.withColumn("_ql_s", F.sort_array(F.transform(shared, lambda v: place("_ql_yp", "_ql_yh", v) - place("_ql_xp", "_ql_xh", v))))
    shift = F.get(F.col("_ql_s"), F.floor(F.size("_ql_s") / 2).cast("int"))
    both = F.size(F.filter("_ql_s", lambda v: F.abs(v - shift) <= SLACK)).cast("double")
    jaccard = both / F.size("_ql_u")
    none = (F.size("_ql_x") == 0) | (F.size("_ql_y") == 0)
    alike = F.when(F.size("_ql_u") == 0, 1.0).when(none, 0.0).otherwise(2 * jaccard / (1 + jaccard))
    return df.withColumn(out, alike).drop("_ql_x", "_ql_y", "_ql_xh", "_ql_yh", "_ql_xp", "_ql_yp", "_ql_u", "_ql_s")


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column; a column of that name is replaced."""
    return _with_sketch(docs, F.col(text_col), "_ql_sketch").withColumn(out, written(F.col("_ql_sketch"))).drop("_ql_sketch")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position (of the first word), kmer: every chosen k-mer of every text."""
    few = _with_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_ql_t")), F.col("_ql_t"))
    few = few.withColumn("i", F.explode(_chosen(F.col("_ql_h"), F.col("_ql_p"))))
    return few.select("doc_id", F.col("i").alias("position"), F.xxhash64(F.slice("_ql_h", F.col("i") + 1, F.lit(K))).alias("kmer"))


def with_ranges(docs: DataFrame, rows: int = BUCKET_ROWS, most: int = MAX_BUCKETS) -> DataFrame:
    """docs (doc_id: long, text) with _ql_start, _ql_sub, a range of ids of about ``rows`` rows (more beyond ``most`` ranges), and _ql_hash, a hash of the text.

    Ranges of equal width are split again, each on its own, as long as one holds several
    times its share; the rows of a single id that is as frequent are split by the hash.  So neither outlying
    ids nor an id that many rows have leave all rows in one range.  A null id lies below all others.
    """
    spark = docs.sparkSession
    x = F.coalesce(F.col("doc_id").cast("double"), F.lit(BELOW))  # order of ids is kept, those that a double can't tell apart share a range
    docs = docs.withColumns({"_ql_x": x, "_ql_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    low, high, count = docs.agg(F.min("_ql_x"), F.max("_ql_x"), F.count("*")).first()
    share = max(rows, count // most)
    step = lambda lo, width: lo + F.floor((F.col("_ql_x") - lo) / width) * width
    width = ((high or 0.0) - (low or 0.0)) / max(1, count // share) or 1.0
    docs = docs.withColumns({"_ql_start": step(F.lit(low or 0.0), F.lit(width)), "_ql_sub": F.lit(0).cast("long")})
    settled: set[float] = set()
    while True:
        sizes = docs.groupBy("_ql_start").agg(F.count("*").alias("n"), F.min("_ql_x").alias("low"), F.max("_ql_x").alias("high"), (F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("one"))
        found = [r for r in sizes.where(F.col("n") > 4 * share).collect() if r["_ql_start"] not in settled]  # a quarter of ``most`` at most
        if not found:
            return docs.drop("_ql_x")
        table = []
        for r in found:
            parts = r["n"] // share
            if r["low"] < r["high"]:
                table.append((r["_ql_start"], r["low"], (r["high"] - r["low"]) / parts, 0))
            else:
                settled.add(r["_ql_start"])
                table.append((r["_ql_start"], None, None, parts if r["one"] else 1))
        split = spark.createDataFrame(table, "_ql_start double, _ql_low double, _ql_width double, _ql_parts long")
        docs = docs.join(F.broadcast(split), "_ql_start", "left")
        part = F.floor((F.col("_ql_hash") / F.lit(float(2**64)) + 0.5) * F.col("_ql_parts"))
        start = F.coalesce(step(F.col("_ql_low"), F.col("_ql_width")), F.col("_ql_start"))
        docs = docs.withColumns({"_ql_start": start, "_ql_sub": F.when(F.col("_ql_parts") > 0, part).otherwise(F.col("_ql_sub"))}).drop("_ql_low", "_ql_width", "_ql_parts")


def with_next(docs: DataFrame, carried: list[str], rows: int = BUCKET_ROWS, most: int = MAX_BUCKETS) -> DataFrame:
    """docs (doc_id: long, text, ...) with next_<column> of the row that follows in descending doc_id; after the last comes the first.

    Ids are cut into ranges (see ``with_ranges``), sorted one by one; the first row of a
    range is copied into the range before, so no range waits for another.  Rows of equal id follow one
    another by a hash of the text; a null id comes last.
    """
    spark = docs.sparkSession
    docs = with_ranges(docs, rows, most)
    docs = docs.withColumns({"_ql_null": F.col("doc_id").isNull(), "_ql_down": F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long")))})
    key = ["_ql_null", "_ql_down", "_ql_hash"]
    tops = docs.groupBy("_ql_start", "_ql_sub").agg(F.min(F.struct(*key)).alias("top")).collect()  # a row for each range
    tops = sorted(((-r["_ql_start"], r["_ql_sub"]), tuple(r["top"])) for r in tops)
    copies = [(*top, -before[0], before[1], 0) for (_, top), (before, _) in zip(tops[1:], tops, strict=False)]
    copies += [(*tops[0][1], -tops[-1][0][0], tops[-1][0][1], 1)] if tops else []
    to = "array<struct<start:double,sub:bigint,wrap:int,copy:boolean>>"
    table = spark.createDataFrame(copies, "_ql_null boolean, _ql_down long, _ql_hash long, start double, sub long, wrap int").groupBy(*key).agg(F.collect_list(F.struct("start", "sub", "wrap", F.lit(True).alias("copy"))).cast(to).alias("_ql_to"))
    own = F.array(F.struct(F.col("_ql_start").alias("start"), F.col("_ql_sub").alias("sub"), F.lit(0).alias("wrap"), F.lit(False).alias("copy"))).cast(to)
    dealt = docs.join(F.broadcast(table), key, "left").withColumn("_ql_at", F.explode(F.concat(own, F.coalesce("_ql_to", F.array().cast(to))))).drop("_ql_to", "_ql_start", "_ql_sub")
    order = Window.partitionBy("_ql_at.start", "_ql_at.sub").orderBy("_ql_at.wrap", *key, "text")
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return dealt.where("not _ql_at.copy").drop("_ql_at", *key)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text replaces the last floor(n/2) code points by as many, or all, of the
    first of the next document's (see ``with_next``).  Null is the empty text; a
    single row is its own next; an empty table gives an empty result.
    """
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next(_with_sketch(few, F.col("text"), "sketch"), ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    paired = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    paired = _with_sketch(paired, F.col("edited"), "edited_sketch")
    paired = paired.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch", "next_sketch")
    paired = with_likeness(with_likeness(paired, "sketch", "edited_sketch", "near_edited"), "sketch", "next_sketch", "near_next")
    return paired.select("doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
