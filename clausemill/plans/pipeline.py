"""The document pipeline as one graph: files to pages, redaction, segmentation, duplicates, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.functions import text as T
from clausemill.operators import documents as O
from clausemill.session import cut
from clausemill.sources import files


def process(spark: SparkSession, manifest: DataFrame, folder: str, *, allowed: list[str] | None = None, max_bytes: int = 20 * 1024 * 1024, threshold: float = 0.85, size: int = 5, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents, blocks, reports and families of a manifest whose files lie in ``folder``.

    done: a stage log; documents that it has as exported are skipped.  Everything up
    to segmentation is one narrow pass per file; duplicates are the only wide step.
    """
    todo = manifest if done is None else O.unfinished(manifest, done)
    got = files.acquire(todo, files.scan(spark, folder), allowed or ["pdf", "docx", "markdown", "text"], max_bytes)
    pages = cut(files.pages(got))
    good = pages.filter("error is null")
    # Identifiers go before compatibility forms are folded.
    redacted = good.select("document_id", "page_number", T.redact(F.col("text")).alias("text"), T.redaction_codes(F.col("text")).alias("codes"))
    blocks = cut(O.segment_pages(redacted))
    ordered = F.array_sort(F.collect_list(F.struct("start_char", "page_number", "text")))
    # A page's first line follows a blank line, any other line a line feed.
    joined = F.aggregate("b", F.struct(F.lit("").alias("t"), F.lit(None).cast("int").alias("p")), lambda acc, x: F.struct(F.concat(acc["t"], F.when(acc["p"].isNull(), "").when(acc["p"] == x["page_number"], "\n").otherwise("\n\n"), x["text"]).alias("t"), x["page_number"].alias("p")), lambda acc: acc["t"])
    texts = blocks.groupBy("document_id").agg(ordered.alias("b")).select("document_id", joined.alias("normalized_text"))
    codes = redacted.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "codes"))).alias("c")).select("document_id", F.array_distinct(F.flatten("c.codes")).alias("redaction_codes"))
    base = cut(todo.join(texts, "document_id").join(codes, "document_id"))
    exact = O.exact_duplicates(base, checksum=F.col("sha256"), order="ordinal" if "ordinal" in base.columns else None)
    near = O.near_duplicates(base, threshold, size).groupBy("document_id").agg(F.array_sort(F.collect_set("near_duplicate_of")).alias("near_duplicate_of"))
    documents = base.join(exact, "document_id", "left").join(near, "document_id", "left").withColumn("near_duplicate_of", F.coalesce("near_duplicate_of", F.array().cast("array<string>")))
    failed = pages.filter("error is not null").select("document_id", "error").distinct()
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("normalized_text").isNull(), "failed").otherwise("exported")
    reports = todo.select("document_id").join(failed, "document_id", "left").join(documents.select("document_id", "normalized_text", "duplicate_of", "near_duplicate_of"), "document_id", "left").select("document_id", status.alias("status"), "error", "duplicate_of", "near_duplicate_of")
    if done is not None:
        skipped = manifest.select("document_id").join(todo.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("skipped").alias("status"))
        reports = reports.unionByName(skipped, allowMissingColumns=True)
    return {"documents": documents, "blocks": blocks, "reports": reports, "families": O.family_groups(manifest)}
