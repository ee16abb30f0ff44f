"""Set, span and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def set_scores(predicted: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two label arrays: 1, 1, 1 where both are empty; 0, 1, 0 without reference; 0, 0, 0 without prediction."""
    p, r = F.array_distinct(predicted), F.array_distinct(reference)
    hit, np_, nr = F.size(F.array_intersect(p, r)), F.size(p), F.size(r)
    none = (np_ == 0) & (nr == 0)
    precision = F.when(none, 1.0).when(np_ == 0, 0.0).otherwise(hit / np_)
    recall = F.when(none | (nr == 0), 1.0).otherwise(hit / nr)
    f1 = F.when(none, 1.0).when(hit == 0, 0.0).otherwise(F.lit(2.0) * hit / (np_ + nr))
    return precision, recall, f1


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """``key, start, end``: overlapping and touching spans become one (gaps and islands)."""
    w = W.partitionBy(key).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(far.isNull() | (F.col("start") > far), 1).otherwise(0)
    island = F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = spans.filter(F.col("end") > F.col("start")).select(key, "start", "end").distinct().withColumn("fresh", fresh).withColumn("island", island)
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def span_coverage(predicted: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """``key, overlap, predicted, reference, precision, recall`` in characters of merged spans."""
    p, r = merge_spans(predicted, key), merge_spans(reference, key)
    length = F.sum(F.col("end") - F.col("start"))
    sizes = p.groupBy(key).agg(length.alias("predicted")).join(r.groupBy(key).agg(length.alias("reference")), key, "full_outer")
    # Both lists are disjoint, so the range join gives few rows per key.
    a, b = p.alias("a"), r.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    shared = met.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum(F.least("a.end", "b.end") - F.greatest("a.start", "b.start")).alias("overlap"))
    out = sizes.join(shared, key, "left").select(key, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("overlap", "predicted", "reference")))
    none = (F.col("predicted") == 0) & (F.col("reference") == 0)
    precision = F.when(none, 1.0).when(F.col("predicted") == 0, 0.0).otherwise(F.col("overlap") / F.col("predicted"))
    recall = F.when(none | (F.col("reference") == 0), 1.0).otherwise(F.col("overlap") / F.col("reference"))
    return out.withColumn("precision", F.round(precision, 9)).withColumn("recall", F.round(recall, 9))


def pr_curve(ranked: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``key, place, precision, recall`` after each row of a ranking with a boolean ``relevant``."""
    w = W.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = ranked.select(key, F.row_number().over(w).alias("place"), F.sum(F.col("relevant").cast("bigint")).over(run).alias("tp"), F.sum(F.col("relevant").cast("bigint")).over(W.partitionBy(key)).alias("total"))
    recall = F.when(F.col("total") == 0, 1.0).otherwise(F.col("tp") / F.col("total"))
    return rows.select(key, "place", (F.col("tp") / F.col("place")).alias("precision"), recall.alias("recall"))


def area_under(curve: DataFrame, key: str) -> DataFrame:
    """Trapezoids over points in order of recall and precision, without an anchor at recall 0, within 0 and 1."""
    w = W.partitionBy(key).orderBy("recall", "precision")
    step = (F.col("recall") - F.lag("recall").over(w)) * (F.col("precision") + F.lag("precision").over(w)) / 2
    return curve.select(key, step.alias("step")).groupBy(key).agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.sum("step"), F.lit(0.0)))), 9).alias("aupr"))


def precision_at_recall(curve: DataFrame, key: str, at: float) -> DataFrame:
    if not 0 < at <= 1:
        raise ValueError("the recall must lie in (0, 1]")
    return curve.groupBy(key).agg(F.round(F.coalesce(F.max(F.when(F.col("recall") >= at, F.col("precision"))), F.lit(0.0)), 9).alias("precision"))
