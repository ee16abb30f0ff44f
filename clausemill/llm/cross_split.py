"""The same or nearly the same records in evaluation and training splits.

Each text gets a similarity-hash fingerprint of 16-bit lanes, of which lane i holds bits
of the least image of the text's shingles under hash i.  A lane agrees with the
probability of the texts' Jaccard similarity, so the Hamming distance of two codes falls
as similarity rises.  The code is cut into blocks of ``LANES_A_BLOCK`` lanes; codes of
the two sides are joined where a block is equal, kept within the Hamming radius, and
verified exactly on the whole texts.

How many blocks there are follows from the threshold: at similarity t a block is equal
with probability t^3, and all blocks differ with at most ``MISS``.  The radius is the
expected distance at the threshold plus six standard deviations; codes of unrelated
texts lie twenty deviations beyond.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.llm import kernel as K
from clausemill.llm.components import block_join
from clausemill.llm.near_duplicates import _verify, within
from clausemill.session import cut

U64 = np.uint64
LANES_A_BLOCK, LANES = 3, 4096
#: Chance that a pair at the threshold meets in no block, and the least threshold whose fingerprints stay within ``LANES``.
MISS, LEAST = 1e-6, 0.25


def block_count(threshold: float) -> int:
    """Blocks of a fingerprint; refused where a threshold would need more lanes than there are."""
    if not LEAST <= threshold <= 1:
        raise ValueError(f"the threshold must lie between {LEAST} and 1")
    equal = threshold**LANES_A_BLOCK
    return 4 if equal >= 1 else max(4, math.ceil(math.log(MISS) / math.log(1 - equal)))


_FACTORS = K.mix(np.arange(1, LANES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_TERMS = K.mix(np.arange(1, LANES + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))


def radius(threshold: float) -> int:
    """Most differing bits of two codes whose texts reach the threshold, six deviations over."""
    lanes = block_count(threshold) * LANES_A_BLOCK
    p = 1 - threshold
    mean, square = 8.0, 8.0 * 8.0 + 4.0
    return math.ceil(lanes * p * mean + 6 * math.sqrt(lanes * (p * square - (p * mean) ** 2)))


def codes(tokens: np.ndarray, offsets: np.ndarray, lanes: int) -> np.ndarray:
    """One row of 16-bit lanes for each non-empty set."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(full), lanes), np.uint16)
    if not len(full):
        return out
    starts = offsets[:-1][full]
    for lane in range(lanes):
        image = tokens * _FACTORS[lane] + _TERMS[lane]
        image ^= image >> U64(32)
        out[:, lane] = (K.mix(np.minimum.reduceat(image, starts)) & U64(0xFFFF)).astype(np.uint16)
    return out


def split_side(column: str):
    """'train', 'validation', 'test' or null of a stored split name."""
    name = F.lower(F.trim(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")))
    return F.when(name.isin("train", "training"), "train").when(name.isin("validation", "val", "dev"), "validation").when(name.isin("test", "testing"), "test")


def record_text(column: str = "source_texts"):
    """The values of the map in ascending key order, joined by a line feed."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: e["value"]), "\n")


def _fingerprints(batches, size, blocks):
    """node, block keys and the code of every text that has a shingle."""
    for batch in batches:
        for row, tokens, offsets in K.shingle_sets(batch.column(1), size):
            lanes = codes(tokens, offsets, blocks * LANES_A_BLOCK)
            full = row + np.flatnonzero(np.diff(offsets) > 0)
            if not len(full):
                continue
            wide = lanes.astype(U64).reshape(len(full), -1, LANES_A_BLOCK)
            keys = wide[:, :, 0]
            for i in range(1, LANES_A_BLOCK):
                keys = (keys << U64(16)) | wide[:, :, i]
            keys = K.mix(keys * U64(0x9E3779B97F4A7C15) + (np.arange(keys.shape[1], dtype=U64) << U64(50)) + U64(1)).view(np.int64)
            data = np.ascontiguousarray(lanes)
            width = 2 * data.shape[1]
            code = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((np.arange(len(full) + 1) * width).astype(np.int32)), pa.py_buffer(data)])
            blocked = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), blocked, code], names=["node", "blocks", "code"])


def _within_radius(batches, most):
    """a, b of rows a, b, code_a, code_b that differ in at most ``most`` bits."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            near = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])


def cross_split_pairs(records: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``record_a, record_b, side_a, side_b``: a train record and one of validation or test whose texts reach ``threshold``.

    Records without a split, a text or an id take no part; rows delivered twice
    count once; texts of fewer words than a shingle are one shingle; an empty table
    gives an empty result.  Copies of one text are compared once and paired at the end.
    """
    blocks = block_count(threshold)
    rows = (
        records.select(F.col("record_id"), split_side("split").alias("side"), record_text().alias("text"))
        .filter("record_id is not null and side is not null and text is not null")
        .filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
        .withColumn("node", F.xxhash64("text"))
    )
    members = cut(rows.select("record_id", "side", "node").distinct())
    texts = rows.select("node", "text")
    prints = cut(texts.dropDuplicates(["node"]).mapInArrow(lambda it: _fingerprints(it, size, blocks), "node long, blocks array<long>, code binary"))
    trained, held = members.filter("side = 'train'").select("node").distinct(), members.filter("side <> 'train'").select("node").distinct()
    keyed = prints.select("node", F.explode("blocks").alias("block"))
    left = keyed.join(trained, "node", "left_semi").select("block", F.col("node").alias("a"))
    right = keyed.join(held, "node", "left_semi").select("block", F.col("node").alias("b"))
    met = block_join(left, right, "block").select("a", "b").distinct()
    code = prints.select("node", "code")
    near = cut(
        met.join(code.select(F.col("node").alias("a"), F.col("code").alias("code_a")), "a")
        .join(code.select(F.col("node").alias("b"), F.col("code").alias("code_b")), "b")
        .select("a", "b", "code_a", "code_b")
        .mapInArrow(lambda it: _within_radius(it, radius(threshold)), "a long, b long")
    )
    count = near.count()
    chosen = within(texts, "node", near.select(F.explode(F.array("a", "b")).alias("key")), 2 * count).dropDuplicates(["node"])
    checked = (
        near.join(chosen.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(chosen.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(lambda it: _verify(it, size, threshold), "a long, b long, similarity double")
        .select("a", "b")
    )
    ours = members.filter("side = 'train'").select(F.col("node").alias("a"), F.col("record_id").alias("train_id"))
    theirs = members.filter("side <> 'train'").select(F.col("node").alias("b"), F.col("record_id").alias("held_id"), F.col("side").alias("held_side"))
    return checked.join(ours, "a").join(theirs, "b").filter("train_id <> held_id").select("train_id", "held_id", "held_side").distinct()


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("train_id", "held_id").alias("record_a"), F.greatest("train_id", "held_id").alias("record_b")).distinct()


def overlap_report(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per held-out split and source_name: its records, those that overlap, and the pairs."""
    held = records.select("record_id", split_side("split").alias("split"), "source_name").filter("record_id is not null and split in ('validation', 'test')").distinct()
    counts = pairs.groupBy(F.col("held_id").alias("record_id")).agg(F.countDistinct("train_id").alias("pairs"))
    return (
        held.join(counts, "record_id", "left")
        .groupBy("split", "source_name")
        .agg(F.countDistinct("record_id").alias("records"), F.countDistinct(F.when(F.col("pairs") > 0, F.col("record_id"))).alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )
