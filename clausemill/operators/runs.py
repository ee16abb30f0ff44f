"""Tasks, predictions, run metrics and the ranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausemill.functions import text as T

# Classes of outcome.
ANSWERED_SUBSETS = ("evidence_conversation", "refusal_uncertainty")


def error_class(prompt_mode: Column, parsed: Column, valid: Column, correct: Column, evidence: Column) -> Column:
    """The first that holds: no JSON, invalid, correct, evidence missing, otherwise the model's."""
    return (
        F.when(~parsed, F.when(prompt_mode == "direct", "prompt_error").otherwise("parse_error"))
        .when(~valid, "validation_error")
        .when(correct, "correct")
        .when(~evidence, "retrieval_error")
        .otherwise("model_error")
    )


def extraction_labels(e: Column) -> Column:
    """Labels of an extraction: parties, premises, clause types, money, dates, obligations."""
    text = lambda *parts: F.concat_ws(":", *parts)
    return F.array_distinct(
        F.concat(
            F.transform(e["parties"], lambda x: text(F.lit("party"), x["role"], x["name"])),
            F.transform(e["premises"], lambda x: text(F.lit("premises"), x["description"])),
            F.transform(F.flatten(F.transform(e["clauses"], lambda x: x["clause_types"])), lambda x: text(F.lit("clause"), x)),
            F.transform(F.filter(e["monetary_terms"], lambda x: x["amount"].isNotNull()), lambda x: text(F.lit("money"), x["amount"], x["currency"])),
            F.transform(F.filter(e["date_terms"], lambda x: x["normalized_date"].isNotNull()), lambda x: text(F.lit("date"), x["normalized_date"].cast("string"))),
            F.transform(e["obligations"], lambda x: text(F.lit("obligation"), x["responsible_party"], x["action"])),
        )
    )


def tasks(records: DataFrame) -> DataFrame:
    """Scored records of the test split, in order of their ids when written."""
    return records.filter((T.normalize_split(F.col("split")) == "test") & F.col("subset").isin("structured_extraction", *ANSWERED_SUBSETS)).select("record_id", "family_id", "subset", F.col("answer.question").alias("query"), F.col("answer.status").alias("gold_status"), F.transform("answer.evidence", lambda e: e["text"]).alias("quotes"), "source_texts").dropDuplicates(["record_id"])


def resume(work: DataFrame, done: DataFrame, key: str = "record_id") -> DataFrame:
    """Work that no checkpoint row completes."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def last_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in an append-only log."""
    w = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def scripted(work: DataFrame, outputs: DataFrame, default: str = "NO_JSON") -> DataFrame:
    """``raw_output`` of a scripted generator: its output for the record, else the default; tokens are words."""
    rows = work.join(outputs.select("record_id", "output"), "record_id", "left")
    raw = F.coalesce("output", F.lit(default))
    return rows.withColumn("raw_output", raw).drop("output").withColumn("completion_tokens", F.size(T.words(F.col("raw_output"))))


def until_out_of_memory(predictions: DataFrame, run: str = "run_id", order: str = "ordinal") -> DataFrame:
    """Rows up to and with the first that ran out of memory, per run."""
    first = predictions.groupBy(run).agg(F.min(F.when(F.col("oom"), F.col(order))).alias("_stop"))
    return predictions.join(first, run).filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def run_metrics(predictions: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: validity, mean extraction score, share of right answers, evidence share, resources. 0 where there is nothing."""
    answered = F.col("subset").isin(*ANSWERED_SUBSETS)
    tokens, seconds = F.sum("completion_tokens"), F.sum("latency_seconds")
    mean = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return predictions.groupBy(run).agg(
        F.count(F.lit(1)).alias("predictions"),
        mean(F.avg(F.col("schema_valid").cast("double"))).alias("schema_validity"),
        mean(F.avg(F.when(F.col("subset") == "structured_extraction", F.col("content_score")))).alias("extraction_f1"),
        mean(F.avg(F.when(answered, (F.col("error_class") == "correct").cast("double")))).alias("answer_status_accuracy"),
        mean(F.avg(F.col("evidence").cast("double"))).alias("evidence_recall"),
        F.max("peak_vram_mb").alias("peak_vram_mb"),
        tokens.alias("completion_tokens"),
        F.round(F.when((tokens == 0) | (seconds == 0), 0.0).otherwise(tokens / seconds), 9).alias("tokens_per_second"),
    )


def error_counts(predictions: DataFrame, run: str = "run_id") -> DataFrame:
    return predictions.groupBy(run, "error_class").agg(F.count(F.lit(1)).alias("n"))


def dominant_error(counts: DataFrame, run: str = "run_id") -> DataFrame:
    """The most frequent class but correct, the greatest name on ties; correct without failures."""
    best = F.max_by(F.when(F.col("error_class") != "correct", F.col("error_class")), F.when(F.col("error_class") != "correct", F.struct("n", "error_class")))
    return counts.groupBy(run).agg(F.coalesce(best, F.lit("correct")).alias("dominant_error"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last completed run of each candidate, the first listed on ties."""
    w = W.partitionBy("candidate_id").orderBy(F.desc("completed_at"), "ordinal")
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rank_candidates(runs: DataFrame) -> DataFrame:
    """``place`` of each candidate: practical, validity, F1, status, evidence, speed, memory (least first), id descending."""
    # One row per candidate: a single ordered partition is small by construction.
    w = W.orderBy(F.desc("practical"), F.desc("schema_validity"), F.desc("extraction_f1"), F.desc("answer_status_accuracy"), F.desc("evidence_recall"), F.desc("tokens_per_second"), "peak_vram_mb", F.desc("candidate_id"))
    return runs.withColumn("place", F.row_number().over(w))


def missing_candidates(expected: DataFrame, runs: DataFrame) -> DataFrame:
    return expected.select("candidate_id").join(runs.select("candidate_id").distinct(), "candidate_id", "left_anti")


def matrix(candidates: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Candidate and comparison of every configured run (comparisons: comparison_id, candidate_ids)."""
    return comparisons.select("comparison_id", F.explode("candidate_ids").alias("candidate_id")).join(candidates.select("candidate_id").distinct(), "candidate_id")


# What the dominant failure of the best practical candidate suggests, in our own words.
HYPOTHESES = {
    "prompt_error": "output is not JSON: train the output format",
    "parse_error": "constrained output is not JSON: train the output format",
    "validation_error": "JSON breaks the schema: train on schema-valid records",
    "retrieval_error": "evidence is missing from the context: mend retrieval before training",
    "model_error": "valid output is wrong: train on labelled records",
    "correct": "no failures: nothing to train for",
}


def hypothesis(ranked: DataFrame, dominant: DataFrame) -> DataFrame:
    """``candidate_id, dominant_error, hypothesis`` of the first practical candidate (no row without one)."""
    best = ranked.filter("practical").orderBy("place").limit(1).select("candidate_id")
    said = F.create_map(*(F.lit(x) for pair in HYPOTHESES.items() for x in pair))
    return best.join(dominant, "candidate_id").select("candidate_id", "dominant_error", F.element_at(said, F.col("dominant_error")).alias("hypothesis"))


def extraction_scores(predicted: Column, gold: Column) -> Column:
    """F1 of the label sets of two extractions."""
    from clausemill.operators.metrics import set_scores

    return set_scores(extraction_labels(predicted), extraction_labels(gold))[2]
