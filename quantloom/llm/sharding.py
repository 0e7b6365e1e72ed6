"""A shard store with size-tiered compaction and atomically committed manifests.

Arrivals are appended as small immutable shards (Parquet files under ``data/``).
Shards belong to tiers by size; when a tier holds ``fanout`` shards or more, they
are merged into files of about ``target_bytes``, tier by tier, until no tier is
full.  The set of live shards is a manifest: version v + 1 is written whole under a name of
its own and then takes its final name by an operation that fails where that name exists: a hard
link on local disks, a rename without overwriting elsewhere (atomic on HDFS; object stores need a file system
that renames conditionally).  Of two writers one commits, the other
reads the new version and tries again.  Readers see one version, whole.  ``vacuum`` alone deletes files, those
that none of the last versions names and that are old enough to belong to no one who is still writing or reading.
All files are reached through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.llm.common import Stage

TARGET_BYTES = 128 << 20
SMALL_BYTES = 1 << 20
FANOUT = 4
RETRIES = 20
KEPT_VERSIONS, LEAST_AGE_S = 5, 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the root
    n_bytes: int
    n_rows: int
    level: int  # how many merges its rows have been through
    born: int  # the version that added it


def tier(n_bytes: int, small: int = SMALL_BYTES, fanout: int = FANOUT) -> int:
    """0 up to ``small`` bytes, and one more for each factor of ``fanout``."""
    t = 0
    while n_bytes > small:
        small *= fanout
        t += 1
    return t


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fanout: int = FANOUT):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small, self.fanout = target_bytes, small_bytes, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        path = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(path))

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return max([0, *(int(n[1:9]) for n, _ in self._list("manifest") if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> tuple[list[Shard], str | None]:
        """Live shards and schema (JSON) of a version."""
        version = self.version() if version is None else version
        if not version:
            return [], None
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            raw = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        state = json.loads(raw)
        return [Shard(**s) for s in state["shards"]], state["schema"]

    def _commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """Make the shards version base + 1; Conflict if that is there already."""
        body = json.dumps({"version": base + 1, "schema": schema, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]})
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifest/v{base + 1:08d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            self._take_name(temporary, final)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {base + 1} is there") from None
            raise
        finally:
            self._fs.delete(temporary, False)
        return base + 1

    def _take_name(self, temporary, final) -> None:
        """Give a file its final name; java.nio's or Hadoop's FileAlreadyExistsException if that is taken."""
        jvm = self.spark._jvm
        if self._fs.getScheme() == "file":
            at = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(at(final), at(temporary))
        else:
            hadoop = jvm.org.apache.hadoop.fs
            options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            options[0] = hadoop.Options.Rename.NONE
            hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(temporary, final, options)

    def _write(self, df: DataFrame, level: int, version: int) -> list[Shard]:
        """Write one folder of files and describe them; files without rows are no shards."""
        folder = f"data/{version:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        sizes = {n: b for n, b in self._list(folder) if n.endswith(".parquet")}
        if not sizes:
            return []
        named = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("name"))
        rows = {r["name"]: r["n"] for r in named.agg(F.count("*").alias("n")).collect()}  # a row for each file; no column is read
        return [Shard(f"{folder}/{n}", b, rows[n], level, version) for n, b in sizes.items() if n in rows]

    def _drop(self, shards: list[Shard]) -> None:
        for s in shards:
            self._fs.delete(self._path(f"{self.root}/{s.path}"), False)

    def append(self, df: DataFrame) -> int:
        """Add rows as new shards and commit; returns the version.  An arrival without rows commits nothing new but its schema.

        Rivals that commit first don't matter: the shards join the version that is the last then.
        """
        mine = df.schema.json()
        new = None
        for _ in range(RETRIES):
            base = self.version()
            shards, schema = self.manifest(base)
            if schema is not None and StructType.fromJson(json.loads(schema)).names != df.columns:
                self._drop(new or [])
                raise ValueError("the columns of an arrival must be those of the store")
            new = self._write(df, 0, base + 1) if new is None else [replace(s, born=base + 1) for s in new]
            try:
                return self._commit(base, shards + new, schema or mine)
            except Conflict:
                continue
        self._drop(new or [])
        raise Conflict(f"no commit in {RETRIES} attempts")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version."""
        shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("nothing has been committed")
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def plan(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the lowest full tier, in the order of their age; shards of target size are left alone."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.born, s.path)):
            if s.n_bytes < self.target // 2:
                tiers.setdefault(tier(s.n_bytes, self.small, self.fanout), []).append(s)
        full = [t for t, found in sorted(tiers.items()) if len(found) >= self.fanout]
        return tiers[full[0]] if full else []

    def compact(self) -> int:
        """Merge full tiers until none is left, one commit per merge; returns the version.

        A merge whose shards a rival has merged meanwhile is dropped and planned anew; where
        they are still live it is committed on top of what the rival did.
        """
        while True:
            base = self.version()
            shards, schema = self.manifest(base)
            if not (run := self.plan(shards)):
                return base
            files = max(1, round(sum(s.n_bytes for s in run) / self.target))
            rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{self.root}/{s.path}" for s in run))
            merged = self._write(rows.coalesce(files), 1 + max(s.level for s in run), base + 1)
            if len(merged) >= len(run):  # nothing gained; don't turn in circles
                self._drop(merged)
                return base
            gone = {s.path for s in run}
            for _ in range(RETRIES):
                try:
                    self._commit(base, [s for s in shards if s.path not in gone] + merged, schema)
                    break
                except Conflict:
                    base = self.version()
                    shards, schema = self.manifest(base)
                    if not gone <= {s.path for s in shards}:
                        self._drop(merged)
                        break
            else:
                self._drop(merged)
                raise Conflict(f"no commit in {RETRIES} attempts")

    def vacuum(self, versions: int = KEPT_VERSIONS, least_age_s: float = LEAST_AGE_S) -> int:
        """Delete data files that none of the last ``versions`` names and that are ``least_age_s`` old; returns their number.

        A reader of an older version, or a writer that takes longer than that age, would lose files.
        """
        last = self.version()
        live = {s.path for v in range(max(1, last - versions + 1), last + 1) for s in self.manifest(v)[0]}
        before = (time.time() - least_age_s) * 1000
        gone = 0
        for folder, _ in self._list("data"):
            for status in self._fs.listStatus(self._path(f"{self.root}/data/{folder}")):
                name = status.getPath().getName()
                if name.endswith(".parquet") and f"data/{folder}/{name}" not in live and status.getModificationTime() <= before:
                    gone += bool(self._fs.delete(status.getPath(), False))
        return gone

    def shards(self, version: int | None = None) -> DataFrame:
        """The manifest as a table: shard, n_rows, n_bytes, level, tier, born."""
        found, _ = self.manifest(version)
        rows = [(s.path.rsplit("/", 1)[1], s.n_rows, s.n_bytes, s.level, tier(s.n_bytes, self.small, self.fanout), s.born) for s in found]
        return self.spark.createDataFrame(rows, "shard string, n_rows long, n_bytes long, level int, tier int, born int")


def ingest(docs: DataFrame, id_col: str = "doc_id", arrivals: int = 8, store: ShardStore | None = None) -> ShardStore:
    """Append a table as a number of arrivals (rows dealt by a hash of the id), compacting on the way.

    Rows with a null id come with the first arrival; rows that repeat an id come together.
    Empty arrivals add no shard.  All columns are kept as they are.
    """
    spark = docs.sparkSession
    mine = store is None
    store = store or ShardStore(spark, Stage(spark, "shards").root)
    files = -(-docs.rdd.getNumPartitions() // arrivals)  # an arrival has its share of the table, in shards of about a read split
    of = F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(arrivals)), F.lit(0)) if arrivals > 1 else F.lit(0)
    for i in range(arrivals):
        part = docs if arrivals == 1 else docs.where(F.when(F.col(id_col).isNull(), 0).otherwise(of) == i)
        store.append(part.coalesce(files))
        store.compact()
        if mine:  # no one else knows of this store yet
            store.vacuum(1, 0)
    return store


def stored_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = 8) -> DataFrame:
    """doc_id, n_bytes and md5 of the text (null stays null): every row of the compacted store, read back by its manifest."""
    rows = ingest(docs, id_col, arrivals).read()
    return rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.md5(F.col(text_col).cast("binary")).alias("md5"))
