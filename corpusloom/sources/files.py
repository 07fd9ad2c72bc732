"""An index of files' contents, and cache keys. Only files whose length or time changed are read again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.jsons import canonical_json, sorted_json
from corpusloom.functions.text import text

#: Bytes of a file that are held at once.
PIECE = 1 << 20
INDEX = "path string, length bigint, modified timestamp, sha256 string, bytes_read bigint"
#: Versions that are part of keys.
AUDIO_PASS_VERSION, SCOPE_PROMPT_VERSION, CAPTURE_VERSION = "audio_grounding_v1", "book_scope_deepseek_v1", "browserbase_book_capture_v2"
#: Where pages are asked for, and what of a request does not matter to its answer.
SCRAPE_URL, PASSING = "https://api.firecrawl.dev/v2/scrape", ("maxAge", "storeInCache", "timeout")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of the files under a folder, but for empty ones, which Spark does not list. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def file_index(spark: SparkSession, path: str, known: DataFrame | None = None, glob: str = "*") -> DataFrame:
    """(path, length, modified, sha256, bytes_read) of the files under a folder.

    known: an index made before. A file with the same path, length and time there keeps its digest, and bytes_read is 0; the
    others are read in pieces on executors, through pyarrow's file systems. Files that are gone are left out.
    """
    now = listing(spark, path, glob)
    known = spark.createDataFrame([], INDEX) if known is None else known
    both = now.join(known.select("path", "length", "modified", "sha256").dropDuplicates(["path"]), ["path", "length", "modified"], "left")
    kept = both.where("sha256 is not null").select("path", "length", "modified", "sha256", F.lit(0).cast("bigint").alias("bytes_read"))
    new = both.where("sha256 is null").select("path", "length", "modified").repartition("path")
    return kept.unionByName(new.mapInArrow(_digests, INDEX))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, read = [], []
        for path in batch.column("path").to_pylist():
            fs, at = pa.fs.FileSystem.from_uri(path)
            digest, n = hashlib.sha256(), 0
            with fs.open_input_stream(at, compression=None) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
                    n += len(piece)
            digests.append(digest.hexdigest())
            read.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(read, pa.int64())], names=["path", "length", "modified", "sha256", "bytes_read"])


def fingerprints(sources: DataFrame, index: DataFrame) -> DataFrame:
    """sources (source, ...) with fingerprint: JSON of a local file's path, digest and size (where the index has the source as its
    path), of an address, or of what is neither."""
    files = index.select(F.col("path").alias("source"), F.col("sha256").alias("_sha"), F.col("length").alias("_n"))
    rows = sources.join(files, "source", "left")
    c = F.col("source")
    local = sorted_json({"kind": F.lit("local_file"), "path": c, "sha256": F.col("_sha"), "size_bytes": F.col("_n")})
    kind = F.when(urls.in_domain(c, "youtube.com") | urls.in_domain(c, "youtu.be"), "youtube_url").otherwise("remote_video_url")
    remote = sorted_json({"kind": kind, "url": urls.normalize_remote(c)})
    other = sorted_json({"kind": F.lit("unresolved_source"), "source": c})
    found = F.when(F.col("_sha").isNotNull(), local).when(F.lower(urls.scheme(c)).isin("http", "https"), remote).otherwise(other)
    return rows.select(*sources.columns, found.alias("fingerprint"))


def _sha256(json: Column) -> Column:
    return F.sha2(json.cast("binary"), 256)


def audio_key(fingerprint: Column, languages: Column, model: Column, extra_args: Column) -> Column:
    """The key of a video's transcript: its source's fingerprint, languages and what transcribes it."""
    return _sha256(sorted_json({"audio_pass_version": F.lit(AUDIO_PASS_VERSION), "source": {"": fingerprint}, "preferred_languages": languages, "whisper_model": F.regexp_extract(text(model), r"[^/]*$", 0), "whisper_extra_args": extra_args}))


def book_key(book_id: Column, code: Column, url: Column, status: Column, kind: Column, value: Column) -> Column:
    """The key of a book's capture: the book and the scope that is asked of it."""
    scope = {"status": status, "kind": kind, "value": value}
    return _sha256(sorted_json({"book_id": book_id, "resource_code": code, "url": url, "scope": scope, "scope_prompt_version": F.lit(SCOPE_PROMPT_VERSION), "capture_version": F.lit(CAPTURE_VERSION)}, spaced=True))


def request_key(params: Column, strategy: Column, exact: bool = False, timeout: int | None = None) -> Column:
    """The key of a page's request, its parameters as JSON text: without what does not matter, or exact, with another time limit if given."""
    left = F.from_json(text(params), "map<string,variant>")
    if not exact:
        left = F.map_filter(left, lambda k, _: ~k.isin(*PASSING))
    elif timeout is not None:
        left = F.map_concat(F.map_filter(left, lambda k, _: k != "timeout"), F.create_map(F.lit("timeout"), F.parse_json(F.lit(str(timeout)))))
    return _sha256(sorted_json({"endpoint": F.lit(SCRAPE_URL), "request_params": {"": canonical_json(left)}, "strategy": strategy}))


def request_keys(params: Column, strategy: Column, limits: tuple[int, ...] = (120_000, 240_000)) -> Column:
    """The keys under which an answer may be stored, in the order in which they are tried, each once."""
    return F.array_distinct(F.array(request_key(params, strategy), request_key(params, strategy, True), *(request_key(params, strategy, True, n) for n in limits)))
