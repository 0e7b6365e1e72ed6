"""A Merkle manifest of a dataset: a tree of fan-out 8 over each group's rows, and one over the groups.

A row's place in its group is its rank by id.  Ranks come from a radix trie, without a global sort: keys are
hexadecimal digits (id, then the leaf's hash, then a row number that tells equal rows apart), rows are counted by a prefix
of their digits, prefixes that hold too many rows grow by two digits until none does, and a prefix's first
rank is the sum over its ancestors of the counts of smaller siblings.  Only inside one prefix, of bounded
size, rows are numbered in order.

The digits of a rank in base 8 are the path of a leaf, so a node is keyed by a prefix of them.  Four digits at a
time, all leaves that share the longer prefix meet in one row (4,096 at most), where their levels
are built as arrays; the nodes so made are the leaves of the next pass, until a group has one.  Proofs go the other way: a
block gets the siblings on its path to the root once, and its rows add their own.

Intermediate tables are written to the shared folder, so lost executors cost only their tasks.

Defined results: null columns count as ``-``; rows without an id come first in their group; rows that
repeat an id are ordered by their leaf, equal rows are leaves of their own; an empty table has no rows.  Texts of any
length are hashed whole.  Extra columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom.llm.common import Stage

FANOUT, DEPTH = 8, 4  # children of a node; levels of one pass
BLOCK = FANOUT**DEPTH
BUCKET = 1 << 14  # rows that are numbered together
STEP = 2  # digits by which a full prefix grows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def leaf_hash(*values: Column) -> Column:
    """Hash of the values, each ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    return joined_hash(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]))


def group_key(x: Column) -> Column:
    """A key that is never null; null comes first, the others in the order of their bytes."""
    return F.when(x.isNull(), "-").otherwise(F.concat(F.lit("="), x))


def digits(x: Column) -> Column:
    """Sixteen hexadecimal digits that sort like the long x; null sorts first."""
    low = F.lpad(F.lower(F.hex(x.bitwiseXOR(F.lit(-(2**63))))), 16, "0")
    return F.when(x.isNull(), "0" * 17).otherwise(F.concat(F.lit("1"), low))


def ranks(rows: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Adds rank (from 0) and size within the group ``g``, in the order of the bytes of ``key``; keys are unique.

    Keys may be of any length: a prefix that is the whole key holds one row.
    """
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("n")).first()
    low, high = ends["low"] or "", ends["high"] or ""
    same = next((k for k in range(min(len(low), len(high))) if low[k] != high[k]), min(len(low), len(high)))
    first, n = same, ends["n"]
    while n > BUCKET // 64:
        first, n = first + 1, n // 16
    prefix = lambda size: F.substring("key", 1, size)
    held = rows.withColumns({"at": F.lit(first), "bucket": prefix(first)})
    sizes = stage.write(held.groupBy("g", "bucket", "at").agg(F.count("*").alias("n")), f"{name}-sizes-{first}")
    settled, size = sizes.where(F.col("n") <= BUCKET), first
    full = sizes.where(F.col("n") > BUCKET).select("g", "bucket")
    while not full.isEmpty():
        grown = held.join(full.withColumn("_full", F.lit(True)), ["g", "bucket"], "left")
        more = F.coalesce("_full", F.lit(False))
        size += STEP
        held = stage.write(grown.withColumns({"at": F.when(more, size).otherwise(F.col("at")), "bucket": F.when(more, prefix(size)).otherwise(F.col("bucket"))}).drop("_full"), f"{name}-rows-{size}")
        sizes = stage.write(held.where(F.col("at") == size).groupBy("g", "bucket", "at").agg(F.count("*").alias("n")), f"{name}-sizes-{size}")
        settled = settled.unionByName(sizes.where(F.col("n") <= BUCKET))
        full = sizes.where(F.col("n") > BUCKET).select("g", "bucket")
    offsets = _offsets(settled, same, size)
    inside = F.row_number().over(Window.partitionBy("g", "bucket").orderBy("key")) - 1
    return held.join(offsets, ["g", "bucket"]).withColumn("rank", F.col("before") + inside).drop("at", "bucket", "before", "key")


def _offsets(buckets: DataFrame, same: int, deepest: int) -> DataFrame:
    """(g, bucket, before, size): the rows of the group in smaller buckets, level by level, and in all."""
    cuts = [*range(same, deepest, STEP), deepest]
    at = F.lit(0).cast("long")
    out = buckets.select("g", "bucket", "n")
    total = buckets.groupBy("g").agg(F.sum("n").alias("size"))
    for upper, lower in zip(cuts, cuts[1:], strict=False):
        # within one parent there are 16^STEP digits at most, and the parent's own end
        digit, parent = F.substring("bucket", 1, lower), F.substring("bucket", 1, upper)
        level = buckets.groupBy("g", parent.alias("parent"), digit.alias("digit")).agg(F.sum("n").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("g", "parent").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = level.select("g", "digit", below.alias(f"_b{lower}"))
        out = out.withColumn("digit", digit).join(level, ["g", "digit"]).drop("digit")
        at = at + F.col(f"_b{lower}")
    return out.withColumn("before", at).join(total, "g").select("g", "bucket", "before", "size")


def height(size: Column) -> Column:
    """Levels above the leaves: the least h with 8^h >= size."""
    out = F.lit(0)
    for h in range(20):
        out = out + (size > FANOUT**h).cast("int")
    return out


def _parents(level: Column) -> Column:
    """Hashes of every eight consecutive nodes."""
    count = F.ceil(F.size(level) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: joined_hash(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), "")))


def blocks(nodes: DataFrame) -> DataFrame:
    """(g, left, block, members, levels) of nodes (g, left, rank, hash, and a struct ``own``): left is the height still to go.

    members are the nodes' ``own`` by rank, levels the arrays of hashes from the nodes up, four levels or as many as are left.
    """
    met = nodes.groupBy("g", "left", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "hash", "own"))).alias("_all"))
    steps = F.slice(F.array(*[F.lit(k) for k in range(DEPTH)]), F.lit(1), F.least(F.col("left"), F.lit(DEPTH)))
    levels = F.aggregate(steps, F.array(F.transform("_all", lambda x: x["hash"])), lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
    return met.select("g", "left", "block", F.transform("_all", lambda x: x["own"]).alias("members"), levels.alias("levels"))


def _step(level: Column, i: Column) -> Column:
    """What stands before and after node i among its siblings."""
    start = F.floor(i / FANOUT).cast("int") * FANOUT
    family = F.slice(level, start + 1, FANOUT)
    return F.struct(F.array_join(F.slice(family, 1, i - start), "").alias("before"), F.array_join(F.slice(family, i - start + 2, FANOUT), "").alias("after"))


def _inner_path(levels: Column, i: Column) -> Column:
    """Siblings of member i, from its level up to its block's last one."""
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), lambda level, k: _step(level, F.floor(i / F.pow(F.lit(FANOUT), k)).cast("int")))


class Tree:
    """Trees of all groups over rows (g, key, hash, and a struct ``own``), written pass by pass."""

    def __init__(self, rows: DataFrame, stage: Stage, name: str):
        nodes = ranks(rows, stage, name).withColumn("left", height(F.col("size")))
        tallest = None
        self.passes: list[DataFrame] = []
        while True:
            made = stage.write(blocks(nodes), f"{name}-blocks-{len(self.passes)}")
            self.passes.append(made)
            if tallest is None:
                tallest = made.agg(F.max("left")).first()[0] or 0
            if tallest <= DEPTH * len(self.passes):
                break
            top = F.element_at(F.element_at("levels", -1), 1)
            nodes = made.where(F.col("left") > DEPTH).select("g", (F.col("left") - DEPTH).alias("left"), F.col("block").alias("rank"), top.alias("hash"), F.struct("block").alias("own"))

    def roots(self) -> DataFrame:
        """(g, root)"""
        found = None
        for made in self.passes:
            done = made.where(F.col("left") <= DEPTH).select("g", F.element_at(F.element_at("levels", -1), 1).alias("root"))
            found = done if found is None else found.unionByName(done)
        return found

    def paths(self, above: DataFrame) -> DataFrame:
        """Blocks of the first pass with ``path``, the siblings from the block up, and the columns of ``above`` (g, path, ...).

        ``above`` has the path from each group's root on.
        """
        rest = [c for c in above.columns if c not in ("g", "path")]
        upper = None
        for made in reversed(self.passes):
            ended = made.where(F.col("left") <= DEPTH).join(above, "g")
            if upper is not None:
                ended = ended.unionByName(made.where(F.col("left") > DEPTH).join(upper.withColumnRenamed("rank", "block"), ["g", "block"]))
            if made is self.passes[0]:
                return ended
            child = F.transform("members", lambda m, i: F.struct(m["block"].alias("rank"), F.concat(_inner_path(F.col("levels"), i), F.col("path")).alias("path")))
            upper = ended.select("g", *rest, F.inline(child))


def _leaves(docs: DataFrame, stage: Stage) -> DataFrame:
    """g, key, hash and own (doc_id, tampered leaf) of each row, written once."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    columns = [F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    touched = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    few = docs.select(
        group_key(F.col("lang").cast("string")).alias("g"),
        leaf_hash(doc_id, *columns, text).alias("hash"),
        F.struct(doc_id.alias("doc_id"), F.when(touched, leaf_hash(doc_id, *columns, F.translate(text, UPPER, LOWER))).alias("tampered")).alias("own"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return stage.write(few.select("g", "hash", "own", F.concat(digits(F.col("own.doc_id")), F.col("hash"), digits(F.col("_row"))).alias("key")), "leaves")


def manifest(docs: DataFrame, stage: Stage | None = None) -> tuple[Tree, Tree]:
    """The tree of each language's rows and the tree of the languages' roots (group '')."""
    stage = stage or Stage(docs.sparkSession, "merkle")
    rows = Tree(_leaves(docs, stage), stage, "rows")
    tops = rows.roots().select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("hash"), F.struct(F.col("g").alias("block")).alias("own"))
    return rows, Tree(stage.write(tops, "tops"), stage, "groups")


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (array of before and after), tampered: the evidence of each row, unhashed."""
    return _evidence(docs).select("doc_id", "leaf", "subroot", "root", "proof", "tampered")


def _evidence(docs: DataFrame, proof: bool = True) -> DataFrame:
    rows, tops = manifest(docs)
    none = F.array().cast("array<struct<before:string,after:string>>")
    above = tops.roots().select("g", none.alias("path"), F.col("root"))
    group = F.transform("members", lambda m, i: F.struct(m["block"].alias("g"), F.element_at(F.element_at("levels", 1), i + 1).alias("subroot"), F.concat(_inner_path(F.col("levels"), i), F.col("path")).alias("path")))
    above = tops.paths(above).select("root", F.inline(group))
    blocks_ = rows.paths(above)
    leaf = lambda i: F.element_at(F.element_at("levels", 1), i + 1)

    def row(m: Column, i: Column) -> Column:
        path = F.concat(_inner_path(F.col("levels"), i), F.col("path"))
        base = [m["doc_id"].alias("doc_id"), leaf(i).alias("leaf")]
        if proof:
            return F.struct(*base, path.alias("proof"), m["tampered"].alias("tampered"))
        said = joined_hash(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))
        return F.struct(*base, said.alias("proof_sha256"), fold(F.coalesce(m["tampered"], leaf(i)), path).alias("folded_root"))

    return blocks_.select("subroot", "root", F.inline(F.transform("members", row)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, s: joined_hash(F.concat(s["before"], acc, s["after"])))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; a third of the ids are tampered with."""
    return _evidence(docs, proof=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, text,
    concat(
      coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')
    ) AS head,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, (v & 1) * 3988292384))
    ), 4294967295) % 3 = 0 AS touched
  FROM documents
), hashed AS MATERIALIZED (
  SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS h,
    CASE WHEN touched THEN sha256(head || coalesce(octet_length(encode(text)) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM leaves
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM hashed
), nodes(g, lvl, idx, h, n) AS (
  SELECT g, 0, idx, h, n FROM placed
  UNION ALL
  SELECT g, any_value(lvl) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY g, idx // 8
), subroots AS MATERIALIZED (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(lvl, idx, h, n) AS (
  SELECT 0, idx, h, n FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM tops WHERE n > 1 GROUP BY idx // 8
), steps AS MATERIALIZED (
  SELECT g, part, lvl, idx, struct_pack(
      a := coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
      b := coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS s
  FROM (SELECT g, 0 AS part, lvl, idx, h, n FROM nodes UNION ALL SELECT '', 1, lvl, idx, h, n FROM tops) WHERE n > 1
  WINDOW w AS (PARTITION BY g, part, lvl, idx // 8 ORDER BY idx)
), path AS (
  SELECT p.g, p.idx, list(s.s ORDER BY s.part, s.lvl) AS path
  FROM placed p JOIN subroots r USING (g)
  JOIN steps s ON (s.part = 0 AND s.g = p.g AND s.idx = p.idx // (8 ** s.lvl)::BIGINT) OR (s.part = 1 AND s.idx = r.idx // (8 ** s.lvl)::BIGINT)
  GROUP BY ALL
), told AS (
  SELECT p.doc_id, p.h AS leaf, r.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(a := coalesce(p.tampered, p.h), b := ''), coalesce(path, [])),
      lambda acc, x: struct_pack(a := sha256(x.a || acc.a || x.b), b := '')).a AS folded_root
  FROM placed p JOIN subroots r USING (g) LEFT JOIN path q ON q.g = p.g AND q.idx = p.idx
)
SELECT *, folded_root = root AS verified FROM told
"""
