"""Records: shape, evidence, splits, leakage, licences, statistics, samples, bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausemill.functions import canonical, text as T
from clausemill.operators import documents as O

# Kinds of record, in canonical order.
SUBSETS = ("raw_domain_text", "structured_extraction", "evidence_conversation", "refusal_uncertainty", "multi_turn", "preference_pairs")


def evidence_rows(records: DataFrame) -> DataFrame:
    """``record_id, ordinal, document_id, quote, start_char, end_char, source``: spans of answers with their source text."""
    spans = records.select("record_id", "source_texts", F.posexplode("answer.evidence").alias("ordinal", "e"))
    return spans.select("record_id", "ordinal", F.col("e.document_id").alias("document_id"), F.col("e.text").alias("quote"), F.col("e.page_number").alias("page_number"), F.col("e.section").alias("section"), F.col("e.start_char").alias("start_char"), F.col("e.end_char").alias("end_char"), F.try_element_at("source_texts", F.col("e.document_id")).alias("source"))


def evidence_failures(records: DataFrame) -> DataFrame:
    """Spans with an unknown document, a quote that is not in the source, or offsets at which it does not stand."""
    there = F.col("source").substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    failure = (
        F.when(F.col("source").isNull(), "unknown_document")
        .when(~F.contains("source", "quote"), "quote_missing")
        .when(F.col("start_char").isNotNull() & F.col("end_char").isNotNull() & (F.coalesce(there, F.lit("")) != F.col("quote")), "offsets_differ")
    )
    return evidence_rows(records).withColumn("failure", failure).filter("failure is not null").select("record_id", "ordinal", "document_id", "failure").distinct()


def locator_violations(records: DataFrame) -> DataFrame:
    """Spans without any locator, with one offset only, or that end before they start."""
    e = evidence_rows(records)
    bad = (
        F.when(F.col("start_char").isNull() != F.col("end_char").isNull(), "offsets_unpaired")
        .when(F.col("end_char") <= F.col("start_char"), "offsets_reversed")
        .when(F.col("start_char").isNull() & F.col("page_number").isNull() & F.col("section").isNull(), "no_locator")
    )
    return e.withColumn("failure", bad).filter("failure is not null").select("record_id", "ordinal", "failure").distinct()


def evidence_in_context(quotes: Column, context: Column) -> Column:
    """Every non-empty quote occurs; true without quotes."""
    return F.forall(F.filter(quotes, lambda q: q != ""), lambda q: F.contains(context, q))


def shape_violations(records: DataFrame) -> DataFrame:
    """Records whose source texts and document ids do not name the same documents."""
    keys = F.map_keys("source_texts")
    missing, extra = F.array_except("document_ids", keys), F.array_except(keys, F.col("document_ids"))
    return records.select("record_id", F.size(missing).alias("missing"), F.size(extra).alias("extra")).filter("missing > 0 or extra > 0").distinct()


def turn_violations(records: DataFrame) -> DataFrame:
    """Conversations of under two turns, or in which user and assistant do not take turns, the user first."""
    wrong = F.exists(F.transform("turns", lambda t, i: t["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    return records.filter(F.size("turns") > 0).select("record_id", F.size("turns").alias("turns"), wrong.alias("broken")).filter("broken or turns < 2").distinct()


def turn_statistics(records: DataFrame) -> DataFrame:
    turns = records.select("record_id", F.explode("turns").alias("t")).distinct()
    return turns.groupBy(F.col("t.role").alias("role")).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("record_id").alias("records"), F.sum(F.length("t.text")).alias("chars"))


def hashed_splits(records: DataFrame, config: DataFrame) -> DataFrame:
    """``record_id, family_id, bucket, split`` by family hash under the configured salt and percentages."""
    c = F.broadcast(config.select("splits"))  # one row
    rows = records.select("record_id", "family_id").distinct().crossJoin(c)
    bucket = T.family_bucket(F.col("family_id"), F.col("splits.salt"))
    return rows.withColumn("bucket", bucket).select("record_id", "family_id", "bucket", F.when(F.col("bucket").isNotNull(), T.assign_split(F.col("bucket"), F.col("splits.train_percent"), F.col("splits.validation_percent"))).alias("split"))


def split_statistics(records: DataFrame) -> DataFrame:
    """``subset, split, records`` with totals (null) of both."""
    return records.rollup("subset", "split").agg(F.count(F.lit(1)).alias("records"))


def statistics(records: DataFrame) -> DataFrame:
    """``metric, value``: counts of records, families, documents, synthetic ones, splits and licences."""
    placed = records.filter("split is not null")
    one = lambda name, column: placed.agg(column.alias("value")).select(F.lit(name).alias("metric"), F.col("value").cast("bigint").alias("value"))
    parts = [
        records.agg(F.count(F.lit(1)).alias("value")).select(F.lit("records").alias("metric"), "value"),
        one("families", F.countDistinct("family_id")),
        placed.select(F.explode("document_ids").alias("d")).agg(F.countDistinct("d").alias("value")).select(F.lit("documents").alias("metric"), "value"),
        one("synthetic", F.count_if("synthetic")),
        placed.groupBy(F.concat(F.lit("split:"), F.col("split")).alias("metric")).agg(F.count(F.lit(1)).alias("value")),
        placed.groupBy(F.concat(F.lit("licence:"), F.coalesce("source_license", "rights_status")).alias("metric")).agg(F.count(F.lit(1)).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subset_counts(records: DataFrame) -> DataFrame:
    """``subset, total, train, validation, test`` of all six kinds, zeros included."""
    spark = records.sparkSession
    kinds = spark.createDataFrame([(s,) for s in SUBSETS], "subset string")
    counts = records.filter("split is not null").groupBy("subset").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")))
    return kinds.join(counts, "subset", "left").select("subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "train", "validation", "test")))


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("record_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def family_split_leakage(records: DataFrame) -> DataFrame:
    """``family_id, splits``: families in more than one split, null counted as unassigned."""
    return records.groupBy("family_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("split", F.lit("unassigned")))), ", ").alias("splits"), F.countDistinct(F.coalesce("split", F.lit("unassigned"))).alias("n")).filter("n > 1 and family_id is not null").drop("n")


def document_family_leakage(records: DataFrame) -> DataFrame:
    """``document_id, families``: documents that more than one family holds."""
    rows = records.filter("family_id is not null").select("family_id", F.explode("document_ids").alias("document_id"))
    return rows.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("family_id")), ", ").alias("families"), F.countDistinct("family_id").alias("n")).filter("n > 1").drop("n")


def licence_records(records: DataFrame) -> DataFrame:
    """One row per document: of the first record (by subset, record_id) that names it."""
    rows = records.select(F.struct("subset", "record_id").alias("o"), "family_id", "source_name", "rights_status", "source_license", "synthetic", F.explode("document_ids").alias("document_id"))
    first = rows.groupBy("document_id").agg(F.min_by(F.struct("family_id", "source_name", "rights_status", "source_license", "synthetic"), "o").alias("r"))
    return first.select("document_id", "r.*")


def quality_sample(records: DataFrame, per_subset: int = 2, reviews: DataFrame | None = None) -> DataFrame:
    """The first records of each subset by id, with their review status (pending where unknown)."""
    w = W.partitionBy("subset").orderBy("record_id")
    picked = records.select("record_id", "subset", "split").distinct().withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_subset).filter("split is not null")
    if reviews is None:
        return picked.select("record_id", "subset", "split", F.lit("pending_review").alias("review_status"), F.lit(None).cast("string").alias("notes"))
    known = reviews.select("record_id", F.when(F.col("review_status").isin("pending_review", "accepted", "rejected"), F.col("review_status")).alias("s"), F.nullif("notes", F.lit("")).alias("notes"))
    return picked.join(known, "record_id", "left").select("record_id", "subset", "split", F.coalesce("s", F.lit("pending_review")).alias("review_status"), "notes")


def reviews_complete(sample: DataFrame) -> bool:
    row = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("review_status") != "accepted").alias("open")).first()
    return row.n > 0 and row.open == 0


def naming_blocked(records: DataFrame, config: DataFrame) -> DataFrame:
    """Records that name a held-out document (semi-join on the small list)."""
    blocked = config.select(F.explode("exclusion.blocked_from_training_document_ids").alias("document_id")).distinct()
    named = records.select("record_id", F.explode("document_ids").alias("document_id")).join(blocked, "document_id", "left_semi").select("record_id").distinct()
    return records.join(named, "record_id", "left_semi")


#: Hash buckets of record ids whose hashes are taken before those of subsets.
BUCKETS = 4096


def checksums(records: DataFrame, columns: list[str], whole: str = "*") -> DataFrame:
    """``subset, records, sha256``: hash over each subset's records, and over all of them (subset ``whole``).

    Records are hashed first, then the records of a bucket of ids in order of their ids,
    then the buckets in their order: what is gathered in one row is one bucket of 64
    characters a record, and then at most ``BUCKETS`` hashes.
    """
    hashed = records.select("subset", "record_id", canonical.json_sha256(F.to_json(F.struct(*columns))).alias("h")).distinct().withColumn("bucket", F.pmod(F.conv(F.substring(F.sha2("record_id", 256), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)))
    inner = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "h"))), lambda x: x["h"]), ","), 256)
    outer = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ","), 256)

    def total(rows: DataFrame) -> DataFrame:
        buckets = rows.groupBy("subset", "bucket").agg(F.count(F.lit(1)).alias("n"), inner.alias("h"))
        return buckets.groupBy("subset").agg(F.sum("n").alias("records"), outer.alias("sha256"))

    return total(hashed).unionByName(total(hashed.withColumn("subset", F.lit(whole))))


def verify_checksums(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Subsets whose hash differs from the expected one or that only one side has."""
    return found.select("subset", F.col("sha256").alias("found")).join(expected.select("subset", F.col("sha256").alias("expected")), "subset", "full_outer").filter(~F.col("found").eqNullSafe(F.col("expected")))


def clause_text_failures(clauses: DataFrame) -> DataFrame:
    """``record_id, clause_id``: clauses (record_id, clause_id, text, source) whose text does not stand in the source."""
    return clauses.filter(F.col("source").isNull() | ~F.contains("source", "text")).select("record_id", "clause_id").distinct()


def status_failures(records: DataFrame, document_types: list[str] | None = None) -> DataFrame:
    """``code, record_id``: refusals that answer, preference pairs without a reason, extractions of a type outside the scope."""
    codes = [F.when((F.col("subset") == "refusal_uncertainty") & (F.col("answer.status") == "answered"), "refusal_status")]
    if "ranking_reason" in records.columns:
        reason = F.coalesce(T.strip(F.col("ranking_reason")), F.lit(""))
        codes.append(F.when((F.col("subset") == "preference_pairs") & (F.length(reason) == 0), "preference_rank"))
    if document_types is not None:
        codes.append(F.when((F.col("subset") == "structured_extraction") & ~F.coalesce(F.col("document_type").isin(*document_types), F.lit(False)), "document_type"))
    return records.select("record_id", F.explode(F.array_compact(F.array(*codes))).alias("code")).distinct()


def record_texts(records: DataFrame) -> DataFrame:
    """``document_id`` (the record's id), ``family_id, normalized_text``: source texts in order of their documents, joined.

    A row a delivery: what is made of them counts equal ones once, so texts need not be moved for that.
    """
    joined = F.array_join(F.transform(F.array_sort(F.map_keys("source_texts")), lambda k: F.element_at("source_texts", k)), "\n")
    return records.select(F.col("record_id").alias("document_id"), "family_id", joined.alias("normalized_text"))


def duplicate_issues(records: DataFrame, threshold: float, size: int) -> DataFrame:
    """``code, record_id, message``: records of the same text, and near-duplicates in other families."""
    texts = record_texts(records)
    exact = O.exact_duplicates(texts, checksum=F.sha2("normalized_text", 256)).select(F.lit("exact_duplicate").alias("code"), F.col("document_id").alias("record_id"), F.concat_ws(" duplicates ", "document_id", "duplicate_of").alias("message"))
    near = O.cross_family_near_duplicates(texts, threshold, size).select(
        F.lit("near_duplicate_leakage").alias("code"), F.col("document_id").alias("record_id"), F.format_string("%s in family %s is a near-duplicate of %s in family %s", "document_id", "later_family", "near_duplicate_of", "earlier_family").alias("message")
    )
    return exact.unionByName(near)


def quotes(children: list[Column]) -> Column:
    """The texts of all spans of lists of things with ``evidence``, in order."""
    return F.concat(*(F.flatten(F.transform(c, lambda x: F.transform(x["evidence"], lambda e: e["text"]))) for c in children))


def issues(records: DataFrame, *, document_types: list[str] | None = None, clauses: DataFrame | None = None, threshold: float | None = None, size: int = 5) -> DataFrame:
    """``code, record_id, message``: everything wrong with the records, as rows.

    document_types: the scope of extractions; clauses: those of ``clause_text_failures``;
    threshold: that of near-duplicates, which are looked for only where it is given.
    """
    none = F.lit(None).cast("string")
    parts = [
        duplicate_ids(records).select(F.lit("record_id").alias("code"), "record_id", F.format_string("delivered %d times", F.col("times")).alias("message")),
        evidence_failures(records).select(F.lit("evidence").alias("code"), "record_id", F.concat_ws(":", "ordinal", "failure").alias("message")),
        shape_violations(records).select(F.lit("source_texts").alias("code"), "record_id", F.format_string("%d missing, %d extra", F.col("missing"), F.col("extra")).alias("message")),
        turn_violations(records).select(F.lit("turns").alias("code"), "record_id", F.format_string("%d turns", F.col("turns")).alias("message")),
        status_failures(records, document_types).select("code", "record_id", F.lit("").alias("message")),
        family_split_leakage(records).select(F.lit("family_split_leakage").alias("code"), none.alias("record_id"), F.concat_ws(": ", "family_id", "splits").alias("message")),
        document_family_leakage(records).select(F.lit("document_family_leakage").alias("code"), none.alias("record_id"), F.concat_ws(": ", "document_id", "families").alias("message")),
    ]
    if clauses is not None:
        parts.append(clause_text_failures(clauses).select(F.lit("clause_text").alias("code"), "record_id", F.col("clause_id").alias("message")))
    if threshold is not None:
        parts.append(duplicate_issues(records, threshold, size))
    return reduce(DataFrame.unionByName, parts)


def check_report(found: DataFrame, codes: list[str]) -> DataFrame:
    """``code, passed, failures``: a check passes without rows of its code."""
    spark = found.sparkSession
    all_codes = spark.createDataFrame([(c,) for c in codes], "code string")
    counted = found.groupBy("code").agg(F.count(F.lit(1)).alias("failures"))
    return all_codes.join(counted, "code", "left").select("code", F.col("failures").isNull().alias("passed"), F.coalesce("failures", F.lit(0)).alias("failures"))


def write_bundle(records: DataFrame, path: str, found: DataFrame | None = None) -> bool:
    """Write the records by subset and split, only if there is no issue (all or nothing)."""
    if found is not None and not found.isEmpty():
        return False
    records.repartition("subset", "split").write.partitionBy("subset", "split").mode("overwrite").parquet(path)
    return True
