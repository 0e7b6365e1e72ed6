"""URL rules by a sort-merge range join on reversed-host keys, in DataFrame operations only.

A rule (host, path) covers its host and all subdomains where the URL's path starts
with the rule's.  Hosts are keyed by their labels in reverse, so a host and its
subdomains share a prefix; a URL takes part once for each prefix that can be a rule's
host.  Within one key a path prefix is the interval from the path itself to the path
followed by a byte above all others.  Rule boundaries and URLs are sorted together;
each boundary carries the stack of rules that are active from there on, the sweep
hands the last one to the URLs that follow, and the top of the stack is the longest
rule of that key.  The longest of a URL's keys decides.

Keys are dealt out with a salt (boundaries go to every salt of their key), so that a third of all
URLs under one host spreads over tasks.  A key has ``SALTS`` of them, and more where that would leave
over ``SALT_ROWS`` rows to one.  Equal (host, path) pairs are judged once.  URLs without a host fit no rule; they
stay spread by the partition that they come from when verdicts are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS, SALT_ROWS = 32, 1_000_000
#: The rules of the registered query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """key, at, stack: where the active rules of a key change, and the rules active from there on, shortest path first."""
    rules = rules.where("host is not null and path is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of rivals, block
    named = rules.select(F.array_join(_reversed(F.col("host")), ".").alias("key"), "host", "path", F.struct(F.length("path").alias("size"), F.concat("host", "path").alias("rule"), "verdict").alias("top"))
    heads = named.select("key", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).select("key", "path", F.expr("substring(path, 1, n)").alias("head"))
    above = heads.join(named.select("key", F.col("path").alias("head"), "top"), ["key", "head"])
    stacks = above.groupBy("key", "path").agg(F.array_sort(F.collect_list("top")).alias("stack"))
    start, end = F.col("path").cast("binary"), F.concat(F.col("path").cast("binary"), F.lit(bytearray(b"\xff")))
    both = F.explode(F.array(F.struct(start.alias("at"), F.col("stack").alias("stack")), F.struct(end.alias("at"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))))
    return stacks.select("key", both.alias("b")).select("key", "b.at", "b.stack")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", salts: int = SALTS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``urls`` with host, path, rule (null where none fits) and verdict (the rule's, else ``default``).

    Columns of these names that are there already are replaced.  Null and malformed
    URLs have empty host and path and fit no rule.  Rules with a null host or path are
    ignored, of equal rules with two verdicts the greater name (block) holds.  Rows may
    repeat; empty tables give an empty result, or the default throughout.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    urls = urls.withColumns({"_ql_host": host, "_ql_path": path}).drop("host", "path", "rule", "verdict")
    rules = rules.where("host is not null and path is not null")
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    pairs = urls.select(F.col("_ql_host").alias("host"), F.col("_ql_path").alias("path")).where("host <> ''").distinct()
    turned = _reversed(F.col("host"))
    keyed = pairs.withColumn("turned", turned).select("host", "path", F.explode(F.expr(f"transform(sequence(1, least(size(turned), {max(1, labels)})), i -> array_join(slice(turned, 1, i), '.'))")).alias("key"))
    keyed = keyed.join(rules.select(F.array_join(_reversed(F.translate("host", UPPER, LOWER)), ".").alias("key")).distinct(), "key", "left_semi")
    heavy = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > salts * salt_rows)
    heavy = F.broadcast(heavy.select("key", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")))  # a key for each salts * salt_rows rows at most
    many = F.coalesce("salts", F.lit(salts))
    marks = _boundaries(rules).join(heavy, "key", "left").select("key", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"), "at", "stack")
    kind = marks.schema["stack"].dataType
    keyed = keyed.join(heavy, "key", "left").withColumn("salt", F.pmod(F.xxhash64("host", "path"), many).cast("int"))
    rows = keyed.select("key", "salt", F.col("path").cast("binary").alias("at"), F.lit(1).alias("url"), "host", "path", F.lit(None).cast(kind).alias("stack"))
    none = F.lit(None).cast("string")
    swept = rows.unionByName(marks.select("key", "salt", "at", F.lit(0).alias("url"), none.alias("host"), none.alias("path"), "stack"))
    order = Window.partitionBy("key", "salt").orderBy("at", "url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("active", F.last("stack", ignorenulls=True).over(order)).where("url = 1 and size(active) > 0")
    top = F.element_at("active", -1)
    best = swept.groupBy("host", "path").agg(F.max(F.struct(F.length(top["rule"]).alias("n"), F.length("key").alias("k"), top["rule"].alias("rule"), top["verdict"].alias("verdict"))).alias("best"))
    best = best.select(F.col("host").alias("_ql_h"), F.col("path").alias("_ql_p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), F.lit(-1).alias("_ql_s"))
    urls = urls.withColumn("_ql_from", F.when(F.col("_ql_host") == "", F.spark_partition_id()).otherwise(-1))
    same = (F.col("_ql_host") == F.col("_ql_h")) & (F.col("_ql_path") == F.col("_ql_p")) & (F.col("_ql_from") == F.col("_ql_s"))
    out = urls.join(best, same, "left").drop("_ql_h", "_ql_p", "_ql_s", "_ql_from")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).withColumnsRenamed({"_ql_host": "host", "_ql_path": "path"})


ORACLE = """
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS r FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), keyed AS (
  SELECT DISTINCT host, path FROM named
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM keyed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM named n LEFT JOIN best b ON n.host = b.host AND n.path = b.path
"""
