"""The internal regression suite: seven checks and six metrics over extractions and answers, as one graph.

Extractions come as two tables: ``extractions`` (path, valid, expected_family_id,
document_id, family_id, document_type, rights_status, rights_notes, source_license,
effects), one row a record, and ``items`` (document_id, kind, label, evidence), one row
a party, premises, clause type, monetary or date term or obligation, with the number of
its spans.  Answers are rows (path, valid, status, expected_status, evidence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# The checks in their order, and what each metric compares.
CHECKS = ("schema_validity", "required_evidence", "agreement_family_splits", "rights_and_training_gates", "grounded_answers_and_abstention", "amendment_effects", "evaluation_holdout")
GROUNDED = ("party", "premises", "money", "date", "obligation")
LABEL_METRICS = {"clause": "clause_label_f1", "date": "date_term_f1", "money": "monetary_term_f1", "obligation": "obligation_f1"}


def failures(extractions: DataFrame, items: DataFrame, answers: DataFrame, families: DataFrame, blocked: DataFrame) -> DataFrame:
    """``check, subject, failure`` of everything that fails (families: family_id, member_document_ids; blocked: document_id)."""
    good = extractions.filter("valid")
    row = lambda frame, check, subject, failure: frame.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), failure.alias("failure"))
    answer = F.array_compact(
        F.array(
            F.when(~F.col("valid"), "invalid"),
            F.when(F.col("valid") & (F.col("status") != F.col("expected_status")), "status_differs"),
            F.when(F.col("valid") & (F.col("status") == "answered") & (F.col("evidence") == 0), "answered_without_evidence"),
            F.when(F.col("valid") & (F.col("status") == "insufficient_evidence") & (F.col("evidence") > 0), "abstention_with_evidence"),
        )
    )
    actual = good.groupBy("family_id").agg(F.array_sort(F.collect_set("document_id")).alias("actual"))
    wrong = families.join(actual, "family_id", "left").filter(F.array_sort(F.array_distinct("member_document_ids")) != F.coalesce("actual", F.array().cast("array<string>")))
    parts = [
        row(extractions.filter("not valid"), "schema_validity", "path", F.lit("invalid")),
        row(good.filter("family_id <> expected_family_id"), "schema_validity", "path", F.lit("family_differs")),
        row(items.filter(F.col("kind").isin(*GROUNDED) & (F.col("evidence") == 0)), "required_evidence", "document_id", F.concat_ws(" ", "kind", "label")),
        row(wrong, "agreement_family_splits", "family_id", F.lit("members_differ")),
        row(good.filter("rights_status = 'review_required' and rights_notes is null"), "rights_and_training_gates", "document_id", F.lit("review_without_notes")),
        row(good.filter("rights_status = 'open_license' and source_license is null"), "rights_and_training_gates", "document_id", F.lit("licence_unnamed")),
        row(answers.withColumn("_f", F.explode(answer)), "grounded_answers_and_abstention", "path", F.col("_f")),
        row(good.filter("document_type = 'amendment' and effects = 0"), "amendment_effects", "document_id", F.lit("no_effects")),
        row(good.join(blocked.select("document_id").distinct(), "document_id", "left_anti"), "evaluation_holdout", "document_id", F.lit("not_blocked")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def checks(found: DataFrame) -> DataFrame:
    """``check, passed, failures`` of all seven."""
    listed = found.sparkSession.createDataFrame([(c,) for c in CHECKS], "check string")
    counted = found.groupBy("check").agg(F.count(F.lit(1)).alias("failures"))
    return listed.join(counted, "check", "left").select("check", F.col("failures").isNull().alias("passed"), F.coalesce("failures", F.lit(0)).alias("failures"))


def label_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``kind, f1`` of labels (kind, label) as sets: 1 where both are empty."""
    p, g = predicted.select("kind", "label").distinct().withColumn("p", F.lit(1)), gold.select("kind", "label").distinct().withColumn("g", F.lit(1))
    counts = p.join(g, ["kind", "label"], "full_outer").groupBy("kind").agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    return counts.select("kind", F.when(F.col("hit") == 0, 0.0).otherwise(F.lit(2.0) * F.col("hit") / (F.col("np") + F.col("ng"))).alias("f1"))


def metrics(found: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``name, value`` of the six metrics; a kind without labels on either side scores 1."""
    results = checks(found)
    rate = results.agg(F.avg(F.col("passed").cast("double")).alias("value")).select(F.lit("check_pass_rate").alias("name"), "value")
    valid = results.filter("check = 'schema_validity'").select(F.lit("schema_validity").alias("name"), F.col("passed").cast("double").alias("value"))
    names = found.sparkSession.createDataFrame(list(LABEL_METRICS.items()), "kind string, name string")
    labels = names.join(label_scores(predicted, gold), "kind", "left").select("name", F.coalesce("f1", F.lit(1.0)).alias("value"))
    return rate.unionByName(valid).unionByName(labels)
