"""Blocks of sources, keyword ranking and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from clausemill.functions import text as T


def source_blocks(records: DataFrame) -> DataFrame:
    """``record_id, block_id, text``: lines of every source text, labelled, in order of the documents.

    A text without any line gives one block ``document:full``.
    """
    texts = records.select("record_id", F.explode("source_texts").alias("document_id", "text")).distinct()
    lines = F.filter(F.split(T.normalize_whitespace(F.col("text")), "\n"), lambda x: F.length(x) > 0)
    rows = texts.select("record_id", "document_id", F.posexplode(lines).alias("i", "line"))
    blocks = rows.select("record_id", F.concat(F.col("document_id"), F.lit(":"), F.format_string("block-%04d", F.col("i") + 1)).alias("block_id"), F.concat(F.lit("["), F.col("document_id"), F.lit("] "), F.col("line")).alias("text"), F.struct("document_id", "i").alias("place"))
    empty = texts.filter(F.coalesce(F.size(lines), F.lit(0)) == 0)
    whole = empty.select("record_id", F.concat("document_id", F.lit(":full")).alias("block_id"), F.concat(F.lit("["), F.col("document_id"), F.lit("] "), F.coalesce(T.strip(F.col("text")), F.lit(""))).alias("text"), F.struct("document_id", F.lit(0).alias("i")).alias("place"))
    return blocks.unionByName(whole)


def rank_blocks(blocks: DataFrame, queries: DataFrame, key: str, top_k: int = 4, min_score: float = 0.0) -> DataFrame:
    """``key, block_id, score, place``: the best blocks of each key for its query, score first, block id on ties.

    An equi-join by key; the window keeps top_k rows a group (WindowGroupLimit), so
    no group is gathered.
    """
    scored = blocks.join(queries.select(key, "query"), key).select(key, "block_id", "text", F.round(T.overlap_score(F.col("query"), F.col("text")), 9).alias("score")).filter(F.col("score") >= min_score)
    w = W.partitionBy(key).orderBy(F.desc("score"), "block_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_k)


def contexts(records: DataFrame, queries: DataFrame, mode: str, top_k: int = 4, min_score: float = 0.0) -> DataFrame:
    """``record_id, block_ids, context`` in mode full_document, clause_level or retrieval_assisted.

    Retrieval falls back on the full text where no block passes.
    """
    full = records.select("record_id", T.combined_source_text(F.col("source_texts")).alias("full")).distinct()
    if mode == "full_document":
        return full.select("record_id", F.array(F.lit("full_document")).alias("block_ids"), F.col("full").alias("context"))
    blocks = source_blocks(records)
    if mode == "clause_level":
        ordered = F.array_sort(F.collect_list(F.struct("place", "block_id", "text")))
        grouped = blocks.groupBy("record_id").agg(ordered.alias("b"))
        return grouped.select("record_id", F.col("b.block_id").alias("block_ids"), F.array_join("b.text", "\n").alias("context"))
    if mode != "retrieval_assisted":
        raise ValueError(f"unknown mode {mode}")
    best = rank_blocks(blocks, queries, "record_id", top_k, min_score)
    grouped = best.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("place", "block_id", "text"))).alias("b"))
    out = full.join(grouped, "record_id", "left")
    return out.select("record_id", F.coalesce(F.col("b.block_id"), F.array(F.lit("retrieval_fallback"))).alias("block_ids"), F.coalesce(F.array_join("b.text", "\n"), F.col("full")).alias("context"))
