"""Rules of record shapes, configurations, splits and runs, each as the rows that break it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from clausemill.functions import text as T

# Purposes of development, names of the test split, and the field each timing asks for.
DEVELOPMENT = ("fine-tuning", "continued-pretraining", "preference-data", "synthetic-prompts", "prompt-selection", "hyperparameter-selection", "error-driven-training")
TEST_NAMES = ("test", "official test", "official_test", "held-out-test")
TIMING = {"fixed_date": "due_date", "relative_deadline": "relative_deadline", "recurring": "recurrence", "event_based": "trigger"}
REASON_LEAST = 8


def _broken(rows: DataFrame, keys: list[str], failure: Column) -> DataFrame:
    return rows.withColumn("failure", failure).filter("failure is not null").select(*keys, "failure").distinct()


def clause_page_violations(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """Clauses with one page of ``page_start, page_end`` only, or that end before they start."""
    failure = F.when(F.col("page_start").isNull() != F.col("page_end").isNull(), "pages_unpaired").when(F.col("page_end") < F.col("page_start"), "pages_reversed")
    return _broken(clauses, keys, failure)


def obligation_violations(obligations: DataFrame, keys: list[str]) -> DataFrame:
    """Obligations whose timing lacks its own field, or with one of ``timing_value, timing_unit`` only."""
    lacks = F.lit(False)
    for kind, field in TIMING.items():
        lacks = lacks | ((F.col("timing_type") == kind) & F.col(field).isNull())
    failure = F.when(lacks, "timing_detail_missing").when(F.col("timing_value").isNull() != F.col("timing_unit").isNull(), "timing_unpaired")
    return _broken(obligations, keys, failure)


def extraction_identity_violations(records: DataFrame) -> DataFrame:
    """Records whose extraction (``extraction_document_id, extraction_family_id``) is of another document or family."""
    failure = F.when(~F.array_contains("document_ids", F.col("extraction_document_id")), "document_not_listed").when(F.col("extraction_family_id") != F.col("family_id"), "family_differs")
    return _broken(records, ["record_id"], failure)


def preference_violations(pairs: DataFrame) -> DataFrame:
    """Pairs (``preferred_text, preferred_invented, rejected_text, ranking_reason``) that show no clear preference."""
    failure = (
        F.when(F.col("preferred_invented"), "preferred_invented")
        .when(F.col("preferred_text") == F.col("rejected_text"), "responses_equal")
        .when(F.length(F.coalesce(T.strip(F.col("ranking_reason")), F.lit(""))) < REASON_LEAST, "reason_missing")
    )
    return _broken(pairs, ["record_id"], failure)


def config_violations(config: DataFrame, subsets: Iterable[str] | None = None) -> DataFrame:
    """What is wrong with a configuration row: percentages, blocked ids, and (where it has them) subsets."""
    s, blocked = F.col("splits"), F.col("exclusion.blocked_from_training_document_ids")
    found = [
        F.when(s["train_percent"] + s["validation_percent"] + s["test_percent"] != 100, "percents_do_not_sum"),
        F.when(F.size(F.array_distinct(blocked)) != F.size(blocked), "blocked_ids_repeated"),
    ]
    if "subsets" in config.columns and subsets is not None:
        wanted = F.array(*map(F.lit, subsets))
        found += [F.when(F.size(F.array_distinct("subsets")) != F.size("subsets"), "subsets_repeated"), F.when(F.size(F.array_except(wanted, F.col("subsets"))) + F.size(F.array_except(F.col("subsets"), wanted)) > 0, "subsets_incomplete")]
    return config.select(F.explode(F.array_compact(F.array(*found))).alias("failure")).distinct()


def purpose_violations(uses: DataFrame) -> DataFrame:
    """Uses (``split, purpose``) of a test split, by any of its names, for development."""
    plain = lambda c: F.trim(F.translate(F.lower(F.trim(c)), "_-", "  "))
    names = [n.replace("_", " ").replace("-", " ") for n in TEST_NAMES]
    return uses.filter(plain(F.col("split")).isin(*names) & F.col("purpose").isin(*DEVELOPMENT))


def eval_split_violations(families: DataFrame, pin: DataFrame, config: DataFrame) -> DataFrame:
    """``subject, failure``: a frozen evaluation split against the configuration.

    families: ``family_id, split`` as frozen; pin: one row ``salt, method,
    dataset_version, blocked_from_training_document_ids``; config: one row.  Both rows
    are single by construction, and the ids are few.
    """
    one = config.select("splits", F.col("dataset_version").alias("_version"), F.col("exclusion.blocked_from_training_document_ids").alias("_blocked")).limit(1)
    both = pin.limit(1).join(F.broadcast(one), F.lit(True))
    head = F.array_compact(
        F.array(F.when(F.col("salt") != F.col("splits.salt"), "salt_differs"), F.when(F.col("method") != F.col("splits.method"), "method_differs"), F.when(F.col("dataset_version") != F.col("_version"), "version_differs"))
    )
    heads = both.select(F.lit("pin").alias("subject"), F.explode(head).alias("failure"))
    ids = both.select(F.explode(F.array_except("blocked_from_training_document_ids", "_blocked")).alias("subject"), F.lit("not_blocked").alias("failure"))
    bucket = T.family_bucket(F.col("family_id"), F.col("splits.salt"))
    expected = T.assign_split(bucket, F.col("splits.train_percent"), F.col("splits.validation_percent"))
    moved = families.join(F.broadcast(one.select("splits")), F.lit(True)).filter(F.col("split") != expected).select(F.col("family_id").alias("subject"), F.lit("split_differs").alias("failure"))
    return heads.unionByName(ids).unionByName(moved).distinct()


def run_binding_violations(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """``run_id, failure``: published runs off their benchmark's pins (specs: ``benchmark_id, repository_revision, evaluator_revision``)."""
    s = specs.select(F.col("benchmark_id"), F.col("repository_revision").alias("_repository"), F.col("evaluator_revision").alias("_evaluator"))
    failure = (
        F.when(F.col("_repository").isNull(), "benchmark_unknown")
        .when(F.col("repository_revision") != F.col("_repository"), "dataset_revision_differs")
        .when(F.col("evaluator_revision") != F.col("_evaluator"), "evaluator_revision_differs")
        .when(~F.col("used_official_evaluator"), "evaluator_unofficial")
        .when(F.exists("metrics", lambda m: ~m["official"]), "metrics_unofficial")
    )
    return _broken(runs.join(s, "benchmark_id", "left"), ["run_id"], failure)


def run_violations(runs: DataFrame) -> DataFrame:
    """``run_id, failure``: runs that end before they start or name a metric or record twice."""
    failure = F.array_compact(
        F.array(
            F.when(F.col("completed_at") < F.col("started_at"), "ends_before_start"),
            F.when(F.size(F.array_distinct("metric_names")) != F.size("metric_names"), "metric_repeated"),
            F.when(F.size(F.array_distinct("record_ids")) != F.size("record_ids"), "record_repeated"),
        )
    )
    return runs.select("run_id", F.explode(failure).alias("failure")).distinct()


def registry_violations(candidates: DataFrame, comparisons: DataFrame) -> DataFrame:
    """``subject, failure``: candidate ids listed twice, and comparisons of unknown candidates."""
    twice = candidates.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("candidate_id").cast("string").alias("subject"), F.lit("candidate_repeated").alias("failure"))
    named = comparisons.select("comparison_id", F.explode("candidate_ids").alias("candidate_id"))
    unknown = named.join(candidates.select("candidate_id").distinct(), "candidate_id", "left_anti").select(F.col("comparison_id").cast("string").alias("subject"), F.lit("candidate_unknown").alias("failure"))
    return twice.unionByName(unknown).distinct()


def headline_violations(reports: DataFrame) -> DataFrame:
    """Internal reports that are passed off as a professional benchmark."""
    return reports.filter(F.col("is_professional_benchmark") | F.col("headline_claim_allowed")).select("report_id")
