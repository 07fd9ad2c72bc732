"""Artifacts of stages and caches of answers, as tables of JSON texts keyed by what they answer. Paths are whatever Spark's readers know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.manifests import exists

ARTIFACTS = "stage string, scope_id string, payload string"
CACHE = "cache_key string, payload string, fetched_at timestamp"


class MissingInput(ValueError):
    """A stage cannot start: an artifact that it needs is not there, or is no JSON."""


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(stage, scope_id, payload) of a folder of artifacts; none where there is no folder. A stage and scope can come more than once; see latest()."""
    return spark.read.schema(ARTIFACTS).json(path) if exists(spark, path) else spark.createDataFrame([], ARTIFACTS)


def write_artifacts(rows: DataFrame, path: str) -> None:
    """Append rows (stage, scope_id, payload), one file a task and none half written."""
    rows.select("stage", "scope_id", "payload").write.mode("append").json(path)


def latest(made: DataFrame, order: str) -> DataFrame:
    """One artifact of each stage and scope: the last by a column that orders them."""
    return made.groupBy("stage", "scope_id").agg(F.max_by("payload", order).alias("payload"))


def required(made: DataFrame, stages: tuple[str, ...], scopes: DataFrame) -> DataFrame:
    """(stage, scope_id, problem) of what scopes (scope_id) lack of the stages that they need: missing, or not valid JSON."""
    needs = scopes.select("scope_id").distinct().select("scope_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    have = made.select("stage", "scope_id", F.try_parse_json("payload").isNotNull().alias("_ok"), F.lit(True).alias("_there")).groupBy("stage", "scope_id").agg(F.bool_or("_ok").alias("_ok"))
    both = needs.join(have, ["stage", "scope_id"], "left")
    problem = F.when(F.col("_ok").isNull(), "missing required input artifact").when(~F.col("_ok"), "input artifact is not valid JSON")
    return both.select("stage", "scope_id", problem.alias("problem")).where("problem is not null")


def required_inputs(made: DataFrame, stages: tuple[str, ...], scopes: DataFrame) -> DataFrame:
    """The needed artifacts of all scopes, or MissingInput with the first ten that are not there."""
    lacking = required(made, stages, scopes)
    if not lacking.isEmpty():
        raise MissingInput("; ".join(f"{r.stage} of {r.scope_id}: {r.problem}" for r in lacking.orderBy("scope_id", "stage").limit(10).collect()))
    return made.where(F.col("stage").isin(*stages)).join(scopes.select("scope_id").distinct(), "scope_id", "left_semi")


def cached(requests: DataFrame, cache: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """requests (id, the key columns) with the payload that the cache (cache_key, payload, fetched_at) has for the first of
    their keys that it knows, and hit: the name of that key. Of a key stored more than once the latest counts."""
    newest = cache.groupBy("cache_key").agg(F.max_by("payload", "fetched_at").alias("payload"))
    asked = requests.select("id", F.posexplode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("cache_key")) for k in keys))).alias("_p", "_k"))
    found = asked.select("id", "_p", "_k.name", F.col("_k.cache_key").alias("cache_key")).join(newest, "cache_key")
    best = found.groupBy("id").agg(F.min_by(F.struct("name", "payload"), "_p").alias("_b"))
    return requests.join(best, "id", "left").select(*requests.columns, F.col("_b.payload").alias("payload"), F.col("_b.name").alias("hit"))


def pending(requests: DataFrame, cache: DataFrame, keys: tuple[str, ...], refresh: Column | bool = False) -> DataFrame:
    """The requests that have to be made: those without a hit, and those to refresh."""
    again = F.lit(refresh) if isinstance(refresh, bool) else refresh
    return cached(requests, cache, keys).where(F.col("hit").isNull() | again).select(*requests.columns)


def write_cache(rows: DataFrame, path: str) -> None:
    """Append rows (cache_key, payload) with the time of writing."""
    rows.select("cache_key", "payload", F.current_timestamp().alias("fetched_at")).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)


def transcripts_of(cache: DataFrame) -> DataFrame:
    """Segments (cache_key, pos, text, start_seconds, duration_seconds) of cached transcripts; payloads that are no transcript have none."""
    schema = "segments array<struct<text: string, start_seconds: string, duration_seconds: string>>"
    each = cache.select("cache_key", F.posexplode(F.from_json("payload", schema)["segments"]).alias("pos", "_s"))
    number = lambda f: F.col(f"_s.{f}").try_cast("double").alias(f)
    return each.where("_s is not null").select("cache_key", "pos", F.coalesce("_s.text", F.lit("")).alias("text"), number("start_seconds"), number("duration_seconds"))


def whole_bundles(made: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Scopes of artifacts that have every one of the parts as a JSON object: only such a bundle is used again."""
    ok = made.where(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT") & F.col("stage").isin(*parts))
    return ok.groupBy("scope_id").agg(F.count_distinct("stage").alias("_n")).where(F.col("_n") == len(parts)).select("scope_id")
