"""Size-tiered compaction of shards under versioned manifests. DataFrame operations only.

A store is a folder: data/ holds immutable Parquet shards, manifests/ tables of the shards that make up a version, and
versions/ one small file for each version, which names its manifest. That file is written under another name and then
moved to its own in one step that fails where the name is taken: it is the commit. A reader sees the shards of a
committed version or none, whenever a writer is lost; of two writers of the same version one fails and tries again on
top of the other.

Arrivals are appended as they come, as small shards. Compaction sorts the shards by size into tiers, and merges the
similarly sized ones of a tier once there are enough of them, into files of about the target size; those that have
nearly that size already are left alone. Merging reads neighbouring shards into one task, without a shuffle.

Arrivals may have different columns. The manifest says each shard's schema; a version has the columns of all of its
shards, by name, in types that hold every value of theirs (see common_type()).
"""

from __future__ import annotations

import json
import math
import time
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import free_name, remove, scratch, table

#: Bytes of a finished shard; of the lowest tier; sizes in a tier differ by this factor; shards that start a merge.
TARGET_BYTES, BASE_BYTES, FACTOR, LEAST_RUNS = 128 << 20, 1 << 20, 4, 4
#: A shard of this part of the target is finished.
FINISHED = 0.75

#: Seconds for which vacuum() leaves files that no kept version names: a writer may be about to commit them.
GRACE_SECONDS = 24 * 3600
#: How often a writer tries again after another one has committed first.
RETRIES = 20

MANIFEST = "path string, bytes bigint, rows bigint, tier int, added bigint, schema string"

_WHOLE = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the values of both without loss: numbers by their digits, structs by their fields, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, common_type(a.valueType, b.valueType))
    digits = {k: (p, 0) for k, p in _WHOLE.items()} | {k: (k.precision, k.scale) for k in (a, b) if isinstance(k, T.DecimalType)}
    if a in digits and b in digits:
        if a in _WHOLE and b in _WHOLE:
            return max(a, b, key=_WHOLE.get)
        (p, s), (q, t) = digits[a], digits[b]
        if max(p - s, q - t) + max(s, t) <= 38:
            return T.DecimalType(max(p - s, q - t) + max(s, t), max(s, t))
    small = {T.ByteType(), T.ShortType(), T.FloatType(), T.DoubleType()}
    if {a, b} <= small | {T.IntegerType()} and {a, b} & {T.FloatType(), T.DoubleType()}:
        return T.DoubleType()
    if {type(a), type(b)} == {T.StringType, T.BinaryType}:
        return T.BinaryType()
    return T.StringType()


def common_schema(schemas: list[T.StructType]) -> T.StructType:
    """Columns of all schemas by name (case aside, as Spark reads them), in the order in which they come first; all may be null."""
    out: dict[str, T.StructField] = {}
    for field in (f for s in schemas for f in s):
        known = out.get(field.name.lower())
        out[field.name.lower()] = T.StructField(known.name if known else field.name, common_type(known.dataType, field.dataType) if known else field.dataType)
    return T.StructType(list(out.values()))


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the columns of schema: cast where theirs have another type (structs, arrays and maps to JSON if text is wanted), null where they have none."""
    own = {f.name.lower(): f for f in rows.schema}

    def column(want: T.StructField) -> Column:
        have = own.get(want.name.lower())
        if have is None:
            return F.lit(None).cast(want.dataType).alias(want.name)
        return _cast(F.col(f"`{have.name.replace('`', '``')}`"), have.dataType, want.dataType).alias(want.name)

    return rows.select(*map(column, schema))


def _cast(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        own = {f.name.lower(): f for f in have}
        fields = [(_cast(value[own[f.name.lower()].name], own[f.name.lower()].dataType, f.dataType) if f.name.lower() in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _cast(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return F.transform_values(value, lambda _, x: _cast(x, have.valueType, want.valueType))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(have, T.BinaryType):  # text that gives the bytes back, whatever they are
        return F.base64(value)
    return value.cast(want)


class CommitConflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


class ShardStore:
    """A store in a folder of any Hadoop file system whose rename is atomic and does not replace (HDFS; local ones by a hard link)."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES, factor: int = FACTOR, least_runs: int = LEAST_RUNS):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.base, self.factor, self.least_runs = target_bytes, base_bytes, factor, least_runs
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._hadoop.Path(at)

    # ---- versions ----

    def versions(self) -> list[int]:
        """The committed versions, ascending. Files of other names are writers' own, empty ones are none."""
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(at) if x.getPath().getName().isdigit() and x.getLen() > 0)

    def version(self) -> int:
        """The newest committed version; 0 for an empty store."""
        return max(self.versions(), default=0)

    def _named(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012d}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, tier, added) of a version's shards; added is the version that brought the shard."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._named(version)}")

    def _publish(self, content: str, to: str) -> bool:
        """A file with this content under its name, whole from the first moment on; False where the name is taken."""
        own = self._path(f"{self.root}/versions/.{scratch(self.spark, 'v').rpartition('/')[2]}")
        out = self._fs.create(own, False)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":  # whose rename replaces; a second hard link does not
                paths, files = self.spark.sparkContext._jvm.java.nio.file.Paths, self.spark.sparkContext._jvm.java.nio.file.Files
                at = lambda p: paths.get(p, self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0))
                files.createLink(at(urlparse(to).path), at(urlparse(own.toString()).path))
                return True
            return bool(self._fs.rename(own, self._path(to)))
        except Exception:
            if self._fs.exists(self._path(to)):
                return False
            raise
        finally:
            self._fs.delete(own, False)

    def _commit(self, manifest: DataFrame, base: int) -> int:
        """Make manifest the version after base, all or nothing."""
        at = scratch(self.spark, "m").rpartition("/")[2]
        manifest.write.parquet(f"{self.root}/manifests/{at}")
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        if not self._publish(at, f"{self.root}/versions/{base + 1:012d}"):
            self._fs.delete(self._path(f"{self.root}/manifests/{at}"), True)
            raise CommitConflict(f"version {base + 1} exists")
        return base + 1

    def _committed(self, change) -> int:
        """Commit change(manifest, base) on top of the newest version, again if another writer was first. None changes nothing."""
        for attempt in range(RETRIES):
            base = self.version()
            new = change(self.manifest(base), base)
            if new is None:
                return base
            try:
                return self._commit(new, base)
            except CommitConflict:
                if attempt + 1 == RETRIES:
                    raise
        raise AssertionError("unreachable")

    # ---- writing ----

    def _shards(self, folder: str) -> DataFrame:
        """Manifest rows, without added, of the shards that hold rows in a folder just written. No column is read.

        What one write made has one schema, which is taken from a footer.
        """
        schema = self.spark.read.parquet(folder).schema.json()
        read = self.spark.read.schema(T.StructType([])).parquet(folder)
        files = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        found = files.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("bytes"), F.lit(1)) / F.lit(float(self.base))) / math.log(self.factor))).cast("int")
        return found.select("path", F.col("bytes").cast("bigint").alias("bytes"), "rows", tier.alias("tier"), F.lit(schema).alias("schema"))

    def append(self, rows: DataFrame) -> int:
        """Write rows as small shards, one for each partition, and commit them on top of the newest version.

        An empty arrival commits nothing new; the version stays. Another writer's commit meanwhile is built upon.
        """
        folder = f"{self.root}/data/{scratch(self.spark, 'arrival').rpartition('/')[2]}"
        rows.write.parquet(folder)
        return self._add(self._shards(folder))

    def _add(self, new: DataFrame) -> int:
        if new.isEmpty():
            return self.version()
        return self._committed(lambda now, base: now.unionByName(new.withColumn("added", F.lit(base + 1).cast("bigint")).select(now.columns)))

    def append_dealt(self, rows: DataFrame, arrival: Column, arrivals: int) -> int:
        """Append rows that come in so many arrivals, dealt by arrival (0 and up): one pass over rows, a version each."""
        name = free_name(rows.columns, "arrival")
        folder = f"{self.root}/data/{scratch(self.spark, 'arrivals').rpartition('/')[2]}"
        rows.withColumn(name, arrival.cast("int")).write.partitionBy(name).parquet(folder)
        version = self.version()
        for k in range(arrivals):
            if self._fs.exists(self._path(f"{folder}/{name}={k}")):
                version = self._add(self._shards(f"{folder}/{name}={k}"))
        return version

    def compact(self) -> int:
        """Merge every tier that has enough unfinished shards, and commit the result; the version, new or not.

        Rows are neither lost nor doubled, nor are columns: a merge reads whole shards, each by its own schema, and the
        manifest drops them as it takes the merged ones. Old shards stay for readers of old versions until vacuum().
        """
        base = self.version()
        now = self.manifest(base)
        open_ = now.where(F.col("bytes") < FINISHED * self.target)
        ready = open_.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.least_runs).orderBy("tier").collect()  # a row a tier: few
        if not ready:
            return base
        added = None
        for r in ready:
            folder = f"{self.root}/data/{scratch(self.spark, f'tier{r.tier}').rpartition('/')[2]}"
            self._rows(open_.where(F.col("tier") == r.tier), "bytes").coalesce(max(1, round(r.bytes / self.target))).write.parquet(folder)
            added = self._shards(folder) if added is None else added.unionByName(self._shards(folder))
        gone = open_.where(F.col("tier").isin([r.tier for r in ready])).select("path")

        def change(newest: DataFrame, on: int) -> DataFrame:
            if on != base and not gone.join(newest, "path", "left_anti").isEmpty():
                raise CommitConflict("another writer has merged these shards")
            return newest.join(gone, "path", "left_anti").unionByName(added.withColumn("added", F.lit(on + 1).cast("bigint")))

        return self._committed(change)

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> None:
        """Forget all versions but the newest keep, and delete the data and manifests that none of those refers to.

        What is younger than grace_seconds stays, as a writer may be about to commit it.
        """
        versions = self.versions()
        stay = versions[-keep:]
        used, named = set(), {self._named(v) for v in stay}
        for v in stay:
            used |= {r[0] for r in self.manifest(v).select(F.regexp_extract("path", r"^.*/data/(.+)/[^/]+$", 1)).distinct().toLocalIterator()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{v:012d}"), False)
        old = lambda x: x.getModificationTime() / 1000 <= time.time() - grace_seconds
        listed = lambda at: self._fs.listStatus(self._path(at)) if self._fs.exists(self._path(at)) else []
        for x in listed(f"{self.root}/manifests"):
            if x.getPath().getName() not in named and old(x):
                self._fs.delete(x.getPath(), True)
        for x in listed(f"{self.root}/data"):
            name = x.getPath().getName()
            if name in used or not old(x):
                continue
            if not any(u.startswith(f"{name}/") for u in used):
                self._fs.delete(x.getPath(), True)
                continue
            for y in listed(x.getPath().toString()):  # arrivals that were written in one pass
                if y.isDirectory() and f"{name}/{y.getPath().getName()}" not in used:
                    self._fs.delete(y.getPath(), True)

    # ---- reading ----

    def _rows(self, shards: DataFrame, *order: str) -> DataFrame:
        """The rows of some of a manifest's shards, with the columns of all of them. Shards of one schema are one read."""
        paths: dict[str, list[str]] = {}
        first: dict[str, tuple[int, str]] = {}
        for r in shards.select("path", "schema", "added", *order).orderBy(*order, "path").toLocalIterator():
            paths.setdefault(r.schema, []).append(r.path)
            first[r.schema] = min(first.get(r.schema, (r.added, r.path)), (r.added, r.path))
        if not paths:
            raise ValueError("the store is empty")
        named = sorted(paths, key=first.get)
        schemas = {s: T.StructType.fromJson(json.loads(s)) for s in named}
        wanted = common_schema(list(schemas.values()))
        return reduce(DataFrame.unionByName, [conformed(self.spark.read.schema(schemas[s]).parquet(*paths[s]), wanted) for s in named])

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """A version's rows; with_shard adds _shard, the shard's path under data/ (with underscores after its name if it is taken)."""
        rows = self._rows(self.manifest(version))
        if not with_shard:
            return rows
        return rows.withColumn(free_name(rows.columns, "_shard"), F.regexp_extract(F.input_file_name(), r"^.*/data/(.+)$", 1))


def shard(rows: DataFrame, root: str, arrivals: int = 4, key: str = "doc_id", **options) -> ShardStore | None:
    """Store rows that come in so many arrivals (dealt by a hash of the key; null keys are dealt alike), compacted.

    Each arrival is appended, then tiers are merged until none is ready. Columns are stored as they are, whatever
    their names, so equal and repeated rows and nulls come back as they went in. None for an empty table. The store is
    new and has no other writer, so what merges have replaced is deleted at once.
    """
    store = ShardStore(rows.sparkSession, root, **options)
    store.append_dealt(rows, F.pmod(F.xxhash64(F.lit("arrival"), key), F.lit(arrivals)), arrivals)
    before = -1
    while (now := store.version()) != before:
        before = now
        store.compact()
    if not store.version():
        return None
    store.vacuum(grace_seconds=0)
    return store


def sharded(rows: DataFrame, arrivals: int = 4) -> DataFrame:
    """All columns of rows, and _shard and _version, as read back from a new store in the shared folder.

    Where a column has such a name already, the new one gets underscores after it. An empty table has none stored.
    """
    spark = rows.sparkSession
    root = scratch(spark, "shards")
    version = free_name(rows.columns, "_version")
    store = shard(rows, root, arrivals)
    if store is None:
        remove(spark, root)
        return rows.withColumns({free_name(rows.columns, "_shard"): F.lit(None).cast("string"), version: F.lit(None).cast("bigint")})
    return store.read(with_shard=True).withColumn(version, F.lit(store.version()).cast("bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents as read back from a compacted store, with the shard and version that hold each row."""
    rows = sharded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("_shard").alias("shard"), F.col("_version").alias("version"))
