"""A run of a generator over the scored tasks, and the comparison of runs, as two graphs.

A generator takes rows ``record_id, prompt`` and adds ``raw_output``,
``completion_tokens``, ``latency_seconds`` and ``peak_vram_mb``; the scripted one is a
join, a model would be a ``mapInPandas`` with one model a task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clausemill.functions import text as T
from clausemill.operators import retrieval as R, runs as X
from clausemill.sources.manifests import ANSWER

Generator = Callable[[DataFrame], DataFrame]
# Statuses of an answer and the fields it may have.
STATUSES = ("answered", "insufficient_evidence", "conflicting_evidence", "unreadable_source")
ANSWER_FIELDS = ("schema_version", "question", "perspective", "status", "explanation", "confidence", "evidence", "warnings")
# What each class of outcome says.
DETAILS = {
    "correct": "schema-valid output matched the scored gold labels",
    "prompt_error": "direct prompting did not return a JSON object",
    "parse_error": "schema-constrained prompting did not return a JSON object",
    "validation_error": "JSON was returned but failed ontology validation",
    "retrieval_error": "gold evidence was missing from the supplied context",
    "model_error": "schema-valid output disagreed with the gold labels",
}


def prompt(template: Column | str, values: dict[str, Column]) -> Column:
    """A template with its named places filled in order; unknown places stay."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def answer_valid(payload: Column) -> Column:
    """Whether a JSON object is an answer: known fields only, a known status, confidence in 0 to 1, evidence where answered.

    Question and perspective may be missing: the task fills them in.
    """
    a = F.from_json(payload, ANSWER)
    known = F.size(F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, ANSWER_FIELDS)))) == 0
    confident = a["confidence"].isNotNull() & a["confidence"].between(0, 1)
    grounded = (a["status"] != "answered") | (F.coalesce(F.size(a["evidence"]), F.lit(0)) > 0)
    return F.coalesce(known & a["status"].isin(*STATUSES) & a["explanation"].isNotNull() & confident & grounded, F.lit(False))


def predict(records: DataFrame, generate: Generator, template: str, *, prompt_mode: str = "schema_constrained", context_mode: str = "full_document", top_k: int = 4, limit: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Predictions of answer tasks: generated, parsed, validated, scored and classed.

    done: predictions of an earlier attempt; their records are not generated again.
    """
    tasks = X.tasks(records).filter(F.col("subset").isin(*X.ANSWERED_SUBSETS))
    if limit is not None:
        tasks = tasks.orderBy("record_id").limit(limit)
    if done is not None:
        tasks = X.resume(tasks, done)
    context = R.contexts(tasks, tasks.select("record_id", "query"), context_mode, top_k).select("record_id", "context", "block_ids")
    asked = tasks.join(context, "record_id").withColumn("prompt", prompt(template, {"record_id": F.col("record_id"), "question": F.col("query"), "context": F.col("context")}))
    raw = generate(asked.select("record_id", "prompt"))
    both = asked.join(raw.drop("prompt"), "record_id")
    payload = T.json_object(F.col("raw_output"))
    rows = both.withColumn("payload", payload).withColumn("schema_valid", answer_valid(F.col("payload"))).withColumn("evidence", F.forall(F.filter("quotes", lambda q: q != ""), lambda q: F.contains(F.col("context"), q)))
    right = F.col("schema_valid") & F.coalesce(F.get_json_object("payload", "$.status") == F.col("gold_status"), F.lit(False))
    rows = rows.withColumn("correct", right)
    kind = X.error_class(F.lit("direct" if prompt_mode == "direct" else "schema"), F.col("payload").isNotNull(), F.col("schema_valid"), F.col("correct"), F.col("evidence"))
    detail = F.create_map(*(F.lit(x) for pair in DETAILS.items() for x in pair))
    return rows.withColumn("error_class", kind).select(
        "record_id", "family_id", "subset", "error_class", "schema_valid", F.col("correct").cast("double").alias("content_score"), "evidence", "raw_output", "payload", F.element_at(detail, F.col("error_class")).alias("detail"), "completion_tokens", "latency_seconds", "peak_vram_mb"
    )


def scripted(outputs: DataFrame) -> Generator:
    """A generator that answers from ``record_id, output``."""
    return lambda asked: X.scripted(asked, outputs).withColumn("latency_seconds", F.lit(0.0)).withColumn("peak_vram_mb", F.lit(0.0))


def timed(call: Callable[[list[str]], list[str]]) -> Generator:
    """A generator around a function of prompts, batch by batch in the workers; a row's latency is its share of its batch's time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(1).to_pylist()
            start = time.perf_counter()
            outputs = call(prompts)
            seconds = (time.perf_counter() - start) / max(1, len(prompts))
            n = len(prompts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(outputs, pa.string()), pa.array([len((o or "").split()) for o in outputs], pa.int32()), pa.array([seconds] * n, pa.float64()), pa.array([0.0] * n, pa.float64())],
                names=["record_id", "prompt", "raw_output", "completion_tokens", "latency_seconds", "peak_vram_mb"],
            )

    return lambda asked: asked.select("record_id", "prompt").mapInArrow(run, "record_id string, prompt string, raw_output string, completion_tokens int, latency_seconds double, peak_vram_mb double")


#: Makers of generators by the kind a configuration names.
BACKENDS: dict[str, Callable[..., Generator]] = {"scripted": scripted, "function": timed}


def backend(kind: str, *args) -> Generator:
    """The generator of a kind; an unknown one, or one that needs hardware this engine does not drive, is an error."""
    if kind not in BACKENDS:
        raise ValueError(f"no backend {kind!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[kind](*args)


def compare(runs: DataFrame, candidates: DataFrame, comparison: str, max_vram_mb: float) -> DataFrame:
    """Latest run of each candidate in the required comparison, ranked; ``selected`` only if no candidate is missing.

    runs: run metrics with candidate_id, comparison_id, completed_at, ordinal, oom, backend_kind.
    """
    latest = X.latest_runs(runs.filter(F.col("comparison_id") == comparison))
    practical = ~F.col("oom") & (F.col("backend_kind") != "scripted") & (F.col("peak_vram_mb") <= max_vram_mb)
    ranked = X.rank_candidates(latest.withColumn("practical", practical))
    missing = X.missing_candidates(candidates, latest).agg(F.count(F.lit(1)).alias("missing"))  # one row
    return ranked.crossJoin(F.broadcast(missing)).withColumn("selected", (F.col("place") == 1) & F.col("practical") & (F.col("missing") == 0)).drop("missing")
