"""Files of artifacts, one for each scope and kind, written all or none: a data source that only writes.

Tasks write files under a staging folder of their attempt; what an attempt that was lost or repeated wrote is never named by a
message. The commit first writes down what has to be moved, then moves it: a driver that is lost before that leaves
nothing to see, one that is lost after it is finished by recover(). An abort deletes the staging folder.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FILES = "scope string, name string, payload string"
STAGING, COMMITS = "_staging", "_commits"
#: Files that are moved at once.
MOVERS = 16


def pretty(payload: str, sort: bool) -> str:
    """A JSON text with an indent of two and a line end; keys sorted at every level if asked for."""
    return json.dumps(json.loads(payload), ensure_ascii=False, indent=2, sort_keys=sort) + "\n"


def _place(scope: str | None, name: str | None) -> str:
    at = posixpath.normpath(posixpath.join(scope or "", name or ""))
    if not name or at.startswith(("..", "/", "_")) or at == ".":
        raise ValueError(f"no place for a file: scope {scope!r}, name {name!r}")
    return at


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, sort: bool):
        self.path, self.sort, self.job = path.rstrip("/"), sort, uuid.uuid4().hex

    def _fs(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        fs, base = self._fs()
        task = TaskContext.get()
        folder = f"{STAGING}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        files: list[str] = []
        seen: set[str] = set()
        for row in rows:
            at = _place(row.scope, row.name)
            if at in seen:
                raise ValueError(f"{at} is written twice")
            seen.add(at)
            text = pretty(row.payload, self.sort) if at.endswith(".json") else row.payload or ""
            fs.create_dir(posixpath.dirname(f"{base}/{folder}/{at}"), recursive=True)
            with fs.open_output_stream(f"{base}/{folder}/{at}", compression=None) as out:
                out.write(text.encode())
            files.append(at)
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._fs()
        moves = {}
        for m in messages:
            for at in m.files if m else []:
                if at in moves:
                    self.abort(messages)
                    raise ValueError(f"{at} is written twice")
                moves[at] = f"{m.folder}/{at}"
        fs.create_dir(f"{base}/{COMMITS}", recursive=True)
        with fs.open_output_stream(f"{base}/{COMMITS}/.{self.job}", compression=None) as out:
            out.write(json.dumps(moves).encode())
        fs.move(f"{base}/{COMMITS}/.{self.job}", f"{base}/{COMMITS}/{self.job}.json")  # from here on it is committed
        _finish(fs, base, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = self._fs()
        if fs.get_file_info(f"{base}/{STAGING}/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{base}/{STAGING}/{self.job}")


def _finish(fs: pyarrow.fs.FileSystem, base: str, job: str) -> None:
    """Move what a commit names and is not moved yet, then forget the commit."""
    with fs.open_input_stream(f"{base}/{COMMITS}/{job}.json", compression=None) as f:
        moves: dict[str, str] = json.loads(f.read())

    def move(to: str) -> None:
        if fs.get_file_info(f"{base}/{moves[to]}").type == pyarrow.fs.FileType.File:
            fs.create_dir(posixpath.dirname(f"{base}/{to}"), recursive=True)
            fs.move(f"{base}/{moves[to]}", f"{base}/{to}")

    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(move, moves))
    if fs.get_file_info(f"{base}/{STAGING}/{job}").type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(f"{base}/{STAGING}/{job}")
    fs.delete_file(f"{base}/{COMMITS}/{job}.json")


def recover(path: str) -> list[str]:
    """Finish commits whose driver was lost while it moved files; the jobs that were finished so."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path.rstrip("/"))
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{COMMITS}", allow_not_found=True))
    jobs = sorted(x.base_name.removesuffix(".json") for x in found if x.base_name.endswith(".json"))
    for job in jobs:
        _finish(fs, base, job)
    return jobs


class ArtifactFiles(DataSource):
    """Format artifact_files, mode append, options path and sort (true or false): rows scope, name, payload. A file that is there is replaced."""

    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("artifact_files are only appended")
        return _Writer(self.options["path"], self.options.get("sort", "false").lower() == "true")


def _qualified(spark: SparkSession, path: str) -> str:
    """A folder as Spark's readers name it, with its scheme, whether it was given as a path, an address or relative."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def write_files(rows: DataFrame, path: str, sort: bool = False) -> None:
    """Write rows (scope, name, payload) as files path/scope/name, all or none. Names that end in .json are JSON, set out
    with an indent; others are text as it is. Two rows for one file are an error. path is a folder that Spark and pyarrow's file systems know."""
    spark = rows.sparkSession
    spark.dataSource.register(ArtifactFiles)
    chosen = rows.select(*(F.col(c).cast("string").alias(c) for c in ("scope", "name", "payload")))
    # Without its scheme, as pyarrow takes a local path as it stands but wants addresses percent-encoded.
    at = _qualified(spark, path).removeprefix("file:")
    chosen.write.format("artifact_files").mode("append").option("path", at).option("sort", str(sort).lower()).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(scope, name, payload) of the files of a folder, as they are; empty ones are not listed by Spark."""
    base = _qualified(spark, path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = F.col("path").substr(F.lit(len(base) + 1), F.length("path"))
    rows = files.select(F.regexp_extract(at, r"^(?:(.*)/)?([^/]+)$", 1).alias("scope"), F.regexp_extract(at, r"([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("payload"))
    return rows.where(~F.col("scope").rlike(f"^({STAGING}|{COMMITS})(/|$)"))


def stage_files(results: DataFrame, log: DataFrame, stage: str, artifact: str) -> DataFrame:
    """Files of a stage's outcome (operators.runner): each scope's artifact, and its raw answers attempt by attempt.

    results: id, artifact. log: id, attempt, repair_type, raw. The ids are the scopes.
    """
    raw = F.concat(F.lit("attempt_"), "attempt", F.coalesce(F.concat(F.lit("_"), "repair_type"), F.lit("")), F.lit(".txt"))
    outputs = log.where("raw is not null").select(F.concat(F.col("id").cast("string"), F.lit(f"/raw_model_outputs/{stage}")).alias("scope"), raw.alias("name"), F.col("raw").alias("payload"))
    return results.select(F.col("id").cast("string").alias("scope"), F.lit(artifact).alias("name"), F.col("artifact").alias("payload")).unionByName(outputs)
