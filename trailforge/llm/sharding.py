"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. A manifest version is a
table with a row for each live shard, stored under a name of its own; a version exists once
its pointer file (``v`` and the number, holding the table's name) does. The pointer is
published in one step that fails if it is there already: a hard link on local disks, a rename without
overwriting on HDFS and other file systems that have it. A writer that loses this race reads the new
version, applies its change to that and tries again, so no writer's rows are lost.

A compaction round takes the shards below the target size, sorts them into tiers
of similar size (powers of ``ratio``), fills groups of up to the target size from
each tier, rewrites every group of at least ``min_merge`` shards as one
shard, and commits the next version; if one of its shards was merged by somebody else meanwhile, its work is
thrown away and planned anew. Rounds go on until no group is left to merge.

Readers hold a version, and its shards stay until ``vacuum`` is asked for: that removes files which
none of the newest ``keep_versions`` versions names and which are older than ``min_age_s`` (younger ones may
belong to a writer that has not committed yet).

Only DataFrame operations touch rows; the driver handles manifest rows (one for
each shard) and folder names.

Defined results: rows are kept exactly as they arrive, nulls, repeats, empty and very long
texts included; a null arrival number is its own arrival; an empty table has a
manifest without rows and reads back empty; shards of equal size are taken in the order of their paths; no input
column is reserved.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import delete, scratch, tables

MANIFEST = "path string, bytes long, rows long, born int"


class ManifestConflict(RuntimeError):
    """A change can't be committed, as other writers came first."""


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, target_bytes: int = 128 << 20, min_merge: int = 4, ratio: float = 4.0, groups_per_job: int = 128, tries: int = 20):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.target_bytes, self.min_merge, self.ratio, self.groups_per_job, self.tries = target_bytes, min_merge, ratio, groups_per_job, tries

    # -- manifest ---------------------------------------------------------

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        path, fs = self._fs()
        root = path(f"{self.folder}/manifest")
        if not fs.exists(root):
            return 0
        names = (x.getPath().getName() for x in fs.listStatus(root))
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        path, fs = self._fs()
        pointer = fs.open(path(f"{self.folder}/manifest/v{version:08d}"))
        try:
            name = pointer.readLine()
        finally:
            pointer.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{name}")

    def _publish(self, table: str, version: int) -> bool:
        """Make the pointer of a version in one step; False if the version is there already."""
        path, fs = self._fs()
        tmp, final = path(f"{self.folder}/manifest/_{uuid.uuid4().hex}"), path(f"{self.folder}/manifest/v{version:08d}")
        out = fs.create(tmp, False)
        out.writeBytes(table + "\n")
        out.close()
        jvm = self.spark.sparkContext._jvm
        try:
            if fs.getUri().getScheme() == "file":
                place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(place(final), place(tmp))
            else:
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(tmp, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(tmp, False)
        return True

    def _commit(self, change: Callable[[DataFrame], DataFrame | None]) -> int:
        """Commit what change makes of the newest manifest; again on the newer one if another writer came first."""
        for _ in range(self.tries):
            version = self.version()
            rows = change(self.manifest(version))
            if rows is None:
                raise ManifestConflict("the change doesn't apply to the newest version")
            table = f"t-{version + 1:08d}-{uuid.uuid4().hex}"
            rows.select("path", "bytes", "rows", F.coalesce("born", F.lit(version + 1)).alias("born")).coalesce(1).write.parquet(f"{self.folder}/manifest/{table}")
            if self._publish(table, version + 1):
                return version + 1
            delete(self.spark, f"{self.folder}/manifest/{table}")
        raise ManifestConflict(f"{self.tries} other writers came first")

    # -- rows -------------------------------------------------------------

    def _listed(self, folder: str) -> DataFrame:
        """The shards of a folder just written: path, bytes, rows; reads footers only."""
        files = self.spark.read.schema(self.schema).parquet(folder)
        meta = files.metadataColumn("_metadata")
        return files.groupBy(meta["file_path"].alias("path"), meta["file_size"].alias("bytes")).agg(F.count("*").alias("rows")).withColumn("born", F.lit(None).cast("int"))

    def _write(self, df: DataFrame, by: str | None) -> tuple[str, DataFrame]:
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        return folder, self._listed(folder)

    def append(self, df: DataFrame, arrival=None) -> int:
        """Append rows as new shards (a set for each value of the column expression arrival); returns the version."""
        rows, by = df.select(*self.schema.names), None
        if arrival is not None:
            by = f"__arrival_{uuid.uuid4().hex[:8]}"
            rows = df.select(*self.schema.names, arrival.alias(by))
        _, new = self._write(rows, by)
        return self._commit(lambda old: old.unionByName(new))

    def plan(self, version: int | None = None) -> DataFrame:
        """The merges that are due: path and group, for each shard to merge."""
        tier = F.floor(F.log(self.ratio, F.greatest(F.col("bytes"), F.lit(1024)).cast("double"))).alias("tier")
        small = self.manifest(version).where(F.col("bytes") < self.target_bytes).select("path", "bytes", tier)
        before = F.coalesce(F.sum("bytes").over(Window.partitionBy("tier").orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        grouped = small.withColumn("group", F.concat_ws("-", "tier", F.floor(before / self.target_bytes)))
        return grouped.withColumn("n", F.count("*").over(Window.partitionBy("group"))).where(F.col("n") >= self.min_merge).select("path", "group")

    def compact(self) -> int:
        """Merge until nothing is due; returns the number of rounds."""
        rounds = 0
        while True:
            due = [(r.path, r.group) for r in self.plan(self.version()).collect()]  # metadata: one row for each shard
            if not due:
                return rounds
            groups: dict[str, list[str]] = {}
            for path, group in due:
                groups.setdefault(group, []).append(path)
            merged = self.spark.createDataFrame([(p,) for p, _ in due], "path string")
            new, folders, names = None, [], sorted(groups)
            for i in range(0, len(names), self.groups_per_job):  # a group is one task: no shuffle
                parts = [self.spark.read.schema(self.schema).parquet(*groups[g]).coalesce(1) for g in names[i : i + self.groups_per_job]]
                folder, part = self._write(reduce(DataFrame.unionAll, parts), None)
                folders.append(folder)
                new = part if new is None else new.unionByName(part)

            def replace(old: DataFrame, merged=merged, new=new, n=len(due)) -> DataFrame | None:
                if old.join(merged, "path", "left_semi").count() < n:
                    return None
                return old.join(merged, "path", "left_anti").unionByName(new)

            try:
                self._commit(replace)
            except ManifestConflict:  # somebody else has merged some of them
                for folder in folders:
                    delete(self.spark, folder)
            rounds += 1

    def vacuum(self, keep_versions: int = 10, min_age_s: float = 7 * 86400) -> int:
        """Remove data files that none of the newest versions names and that are old enough; returns their number."""
        path, fs = self._fs()
        newest = self.version()
        versions = [v for v in range(max(1, newest - keep_versions + 1), newest + 1) if fs.exists(path(f"{self.folder}/manifest/v{v:08d}"))]
        live = {path(r.path).toString() for v in versions for r in self.manifest(v).select("path").toLocalIterator()}
        for v in range(1, newest - keep_versions + 1):
            fs.delete(path(f"{self.folder}/manifest/v{v:08d}"), False)
        before, gone = (time.time() - min_age_s) * 1000, 0
        for folder in fs.listStatus(path(f"{self.folder}/data")) if fs.exists(path(f"{self.folder}/data")) else []:
            found, left = fs.listFiles(folder.getPath(), True), 0
            while found.hasNext():
                file = found.next()
                if not file.getPath().getName().startswith("part-"):
                    continue
                if file.getPath().toString() in live or file.getModificationTime() > before:
                    left += 1
                else:
                    fs.delete(file.getPath(), False)
                    gone += 1
            if not left and folder.getModificationTime() <= before:
                delete(self.spark, folder.getPath().toString())
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


ARRIVALS = 8


def arrival_of(doc_id):
    """The arrival a document comes with in the query: a hash of its identifier."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 4), 16, 10).cast("int") % ARRIVALS, F.lit(0))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    shards = ShardStore(spark, scratch(spark, "shards"), docs.schema)
    shards.append(docs, arrival_of(F.col("doc_id")))
    shards.compact()
    if not shards.plan().isEmpty():
        raise ManifestConflict("shards that are due were not merged")
    shards.vacuum(keep_versions=1, min_age_s=0)  # nobody else knows this folder
    return shards.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
