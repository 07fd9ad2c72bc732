"""A stage's calls to an external model, row by row: what fails is asked again with its errors, what still fails is set aside.

Each attempt asks only the rows that are left, so no row that holds is asked twice. Answers are written before they are read:
a lost task, or a plan that is run again, does not ask again for what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_fence, text
from corpusloom.operators.access import repair_type
from corpusloom.operators.models import Router
from corpusloom.operators.rounds import cut

#: What is wrong with an answer that is no object.
NO_JSON, NO_OBJECT = "JSON parse error", "stage output must be a JSON object"

#: Rows (id, inputs, attempt, stage, route, model, thinking, repair_context) to the same with raw and call_error.
Ask = Callable[[DataFrame], DataFrame]
#: The artifact and the errors of an answer: columns of (raw, inputs).
Read = Callable[[Column, Column], tuple[Column, Column]]


@dataclass(frozen=True)
class Contract:
    """A stage: its routes, what a repair is told, and how often a row is asked."""

    name: str
    route: str
    format_route: str | None = None
    contextual_route: str | None = None
    attempts: int = 2
    instructions: tuple[tuple[str, str], ...] = (("format_repair", "Give the same answer in the form asked for."), ("contextual_repair", "Mend what the errors name, and only that."))

    def route_of(self, kind: str | None) -> str:
        return {None: self.route, "contextual_repair": self.contextual_route or self.format_route or self.route}.get(kind, self.format_route or self.route)


class Outcome(NamedTuple):
    """results: id, artifact, attempts, repaired. blocked: id, attempts, reason, raw. log: a row an attempt."""

    results: DataFrame
    blocked: DataFrame
    log: DataFrame


def checked_object(raw: Column, *errors: Column) -> tuple[Column, Column]:
    """An answer as JSON text, without its fence; errors: of its form, or else those given that are not null."""
    plain = strip_fence(raw)
    value = F.try_parse_json(plain)
    form = F.when(value.isNull(), NO_JSON).when(~F.schema_of_variant(value).startswith("OBJECT"), NO_OBJECT)
    own = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return F.when(form.isNull(), plain), F.when(form.isNotNull(), F.array(form)).otherwise(own)


def called(call: Callable[[list[dict]], list[str]], batch: int = 32) -> Ask:
    """Asks with a function of requests to their answers, batch requests at once. If it raises, each of these rows has the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                try:
                    raw, error = call(part.to_pylist()), None
                    if len(raw) != part.num_rows:
                        raise ValueError(f"{len(raw)} answers to {part.num_rows} requests")
                except Exception as e:
                    raw, error = [None] * part.num_rows, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.string()), pa.array([error] * part.num_rows, pa.string())], names=[*part.schema.names, "raw", "call_error"])

    def ask(rows: DataFrame) -> DataFrame:
        schema = rows.select("*", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("call_error")).schema
        return rows.mapInArrow(run, schema)

    return ask


def _requests(rows: DataFrame, contract: Contract, router: Router, attempt: int) -> DataFrame:
    """rows (id, inputs, and of earlier attempts errors and raw) as requests."""
    if attempt == 1:
        return _routed(rows.select("id", "inputs", F.lit(None).cast("string").alias("repair_type"), F.lit(None).cast("string").alias("repair_context")), contract, router, attempt, (None,))
    kind = repair_type(F.col("errors"))
    told = F.create_map(*(F.lit(x) for pair in contract.instructions for x in pair))
    again = rows.select("id", "inputs", kind.alias("repair_type"), "errors", "raw")
    context = F.to_json(F.struct("repair_type", F.col("errors").alias("validator_errors"), text("raw").alias("failed_output"), F.try_element_at(told, F.col("repair_type")).alias("instruction")))
    return _routed(again.select("id", "inputs", "repair_type", context.alias("repair_context")), contract, router, attempt, ("format_repair", "contextual_repair"))


def _routed(rows: DataFrame, contract: Contract, router: Router, attempt: int, kinds: tuple) -> DataFrame:
    of = [(k, router.resolve(contract.route_of(k))) for k in kinds]
    named = lambda f: reduce(lambda out, x: F.when(F.col("repair_type").eqNullSafe(F.lit(x[0])), F.lit(f(x[1]))).otherwise(out), of, F.lit(f(of[0][1])))
    return rows.select(
        "id", "inputs", F.lit(attempt).alias("attempt"), F.lit(contract.name).alias("stage"), named(lambda r: r.name).alias("route"), named(lambda r: r.model).alias("model"), named(lambda r: r.thinking).alias("thinking"), "repair_type", "repair_context"
    )


def run(prompts: DataFrame, contract: Contract, router: Router, ask: Ask, read: Read | None = None) -> Outcome:
    """Ask for each of prompts (id, inputs as JSON text), up to contract.attempts times, and set aside what does not hold.

    A row whose call failed is blocked at once: there is no answer to mend. Ids are unique. An empty table asks nothing.
    """
    read = read or (lambda raw, inputs: checked_object(raw))
    left, log = prompts.select("id", "inputs"), []
    for attempt in range(1, contract.attempts + 1):
        answers = cut(ask(_requests(left, contract, router, attempt)))
        artifact, errors = read(F.col("raw"), F.col("inputs"))
        errors = F.when(F.col("call_error").isNotNull(), F.array("call_error")).otherwise(errors)
        done = answers.withColumn("artifact", F.when(F.size(errors) == 0, artifact)).withColumn("errors", errors)
        log.append(done)
        left = done.where((F.size("errors") > 0) & F.col("call_error").isNull())
        if attempt < contract.attempts and left.isEmpty():
            break
    every = reduce(DataFrame.unionByName, log)
    last = every.groupBy("id").agg(F.max_by(F.struct("attempt", "artifact", "errors", "raw"), "attempt").alias("_l")).select("id", "_l.*")
    held = F.size("errors") == 0
    results = last.where(held).select("id", "artifact", F.col("attempt").alias("attempts"), (F.col("attempt") > 1).alias("repaired"))
    blocked = last.where(~held).select("id", F.col("attempt").alias("attempts"), F.array_join("errors", "; ").alias("reason"), "raw")
    return Outcome(results, blocked, every)


def progress(outcome: Outcome) -> DataFrame:
    """The log as events: (id, stage, event, attempt, route, repair_type, input_bytes, output_bytes, error), a start and an end for each call."""
    size = lambda c: F.octet_length(c).cast("bigint")
    end = F.when(F.col("call_error").isNull(), "model_call_returned").otherwise("model_call_error")
    both = F.explode(F.array(F.struct(F.lit("model_call_start").alias("event"), size("inputs").alias("input_bytes"), F.lit(None).cast("bigint").alias("output_bytes"), F.lit(None).cast("string").alias("error")), F.struct(end.alias("event"), F.lit(None).cast("bigint").alias("input_bytes"), size("raw").alias("output_bytes"), F.col("call_error").alias("error"))))
    return outcome.log.withColumn("_e", both).select("id", "stage", "_e.event", "attempt", "route", "repair_type", "_e.input_bytes", "_e.output_bytes", "_e.error")
