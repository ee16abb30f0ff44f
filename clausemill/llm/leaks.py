"""Evaluation passages inside training text: Wu and Manber's multi-pattern search over words.

Every run of ``run`` words of every test item is a pattern.  Three tables serve the
search, over word hashes instead of characters:

* SHIFT says for the block of ``BLOCK`` words that ends a window how many words the
  window may move on without passing over the end of any pattern; a block that stands
  in no pattern lets it move on ``run - BLOCK + 1`` words.  The table is addressed by
  hash, blocks that fall on one slot keep the least shift, so it never moves too far.
* HASH leads from the last block of a window (shift 0) to the patterns that end so;
* direct comparison of all words confirms the occurrence.

SHIFT has a bounded size whatever the items are many, and is what workers hold.  HASH
is a distributed table of patterns: windows that SHIFT stops at are rows that are
joined to it by the hash of their words.  So the corpus is scanned once for any number
of items, and items never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.llm import kernel as K
from clausemill.session import cut

U64 = np.uint64
BLOCK = 3
#: Slots of the SHIFT table (one byte each) at least and at most; eight a block of the items between.
SHIFT_BITS = (20, 26)
PAGE_BITS = 16
#: Words of a text that one lane of the search takes, besides the run that reaches into the next lane.
LANE = 512


def blocks_at(words: np.ndarray, at: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    key = np.zeros(len(at), U64)
    for i in range(size):
        key = key * U64(0x9E3779B97F4A7C15) + words[at + i]
    return K.mix(key)


def _places(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every run of ``size`` words."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(counts)), counts)
    return text, bounds[:-1][text] + np.arange(first[-1]) - first[text]


def _shift_rows(batches: Iterator[pa.RecordBatch], run: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(page, slot, shift) of the blocks of the items, the least shift of a slot in its batch."""
    for batch in batches:
        slots, shifts = [], []
        for _, data, offsets in K.chunks(batch.column(1), K.fold_alnum):
            words, bounds = K.word_hashes(data, offsets, K.ALNUM_WORDS)
            text, at = _places(bounds, BLOCK)
            keep = np.diff(bounds)[text] >= run
            text, at = text[keep], at[keep]
            # Later blocks of an item end some pattern; the first ones stand only inside.
            shifts.append(np.maximum(0, run - (at - bounds[text] + BLOCK)).astype(np.int16))
            slots.append((blocks_at(words, at) >> U64(64 - bits)).astype(np.int64))
        slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        shift = np.concatenate(shifts) if shifts else np.zeros(0, np.int16)
        order = np.lexsort((shift, slot))
        slot, shift = slot[order], shift[order]
        lead = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
        slot, shift = slot[lead], shift[lead]
        yield pa.RecordBatch.from_arrays([pa.array((slot >> PAGE_BITS).astype(np.int32)), pa.array((slot & ((1 << PAGE_BITS) - 1)).astype(np.int32)), pa.array(shift)], names=["page", "slot", "shift"])


def shift_table(items: DataFrame, run: int, words: int) -> tuple[np.ndarray, int]:
    """The SHIFT table of the items and its bits: built by pages, of bounded size (64 MB at most)."""
    low, high = SHIFT_BITS
    bits = min(high, max(low, (8 * max(1, words)).bit_length()))
    size = 1 << min(bits, PAGE_BITS)

    def page(table: pa.Table) -> pa.Table:
        out = np.full(size, 255, np.uint8)
        np.minimum.at(out, table.column("slot").to_numpy(), table.column("shift").to_numpy().astype(np.uint8))
        return pa.table({"page": pa.array([table.column("page")[0].as_py()], pa.int32()), "shifts": pa.array([out.tobytes()], pa.binary())})

    rows = items.mapInArrow(lambda it: _shift_rows(it, run, bits), "page int, slot int, shift short").groupBy("page", "slot").agg(F.min("shift").alias("shift"))
    shifts = np.full(1 << bits, min(255, run - BLOCK + 1), np.uint8)
    for r in rows.groupBy("page").applyInArrow(page, "page int, shifts binary").toLocalIterator():
        found = np.frombuffer(r.shifts, np.uint8)
        part = shifts[r.page << PAGE_BITS : (r.page << PAGE_BITS) + size]
        np.minimum(part, found, out=part)
    return shifts, bits


def search(words: np.ndarray, bounds: np.ndarray, shifts: np.ndarray, bits: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the windows at which SHIFT stops: all windows that may be a pattern.

    Texts are taken in lanes that go on together, so a long text takes no more steps than
    its lanes have words.
    """
    lengths = np.diff(bounds)
    windows = np.maximum(lengths - run + 1, 0)
    lanes = -(-windows // LANE)
    first = np.concatenate(([0], np.cumsum(lanes)))
    text = np.repeat(np.arange(len(lengths)), lanes)
    begin = bounds[:-1][text] + (np.arange(first[-1]) - first[text]) * LANE
    end = np.minimum(begin + LANE, bounds[:-1][text] + windows[text])
    texts, places = [], []
    while len(begin):
        shift = shifts[(blocks_at(words, begin + run - BLOCK) >> U64(64 - bits)).astype(np.int64)]
        stop = shift == 0
        texts.append(text[stop])
        places.append(begin[stop])
        begin = begin + np.maximum(shift, 1)
        alive = begin < end
        begin, end, text = begin[alive], end[alive], text[alive]
    none = np.zeros(0, np.int64)
    return (np.concatenate(texts), np.concatenate(places)) if texts else (none, none)


def _windows(words: np.ndarray, at: np.ndarray, run: int) -> pa.Array:
    data = np.ascontiguousarray(words[at[:, None] + np.arange(run)]) if len(at) else np.zeros((0, run), U64)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 8 * run).astype(np.int32)), pa.py_buffer(data)])


def _pattern_rows(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """(key, window, item_id) of every pattern: the HASH table, with the words to compare."""
    for batch in batches:
        for row, data, offsets in K.chunks(batch.column(1), K.fold_alnum):
            words, bounds = K.word_hashes(data, offsets, K.ALNUM_WORDS)
            text, at = _places(bounds, run)
            yield pa.RecordBatch.from_arrays([pa.array(blocks_at(words, at, run).view(np.int64)), _windows(words, at, run), batch.column(0).take(pa.array(row + text))], names=["key", "window", "item_id"])


def _scan(batches: Iterator[pa.RecordBatch], shifts: np.ndarray, bits: int, run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in K.chunks(batch.column(1), K.fold_alnum):
            words, bounds = K.word_hashes(data, offsets, K.ALNUM_WORDS)
            text, at = search(words, bounds, shifts, bits, run)
            if not len(at):
                continue
            key = blocks_at(words, at, run)
            # A window that a text repeats is looked up once.
            order = np.lexsort((key, text))
            text, at, key = text[order], at[order], key[order]
            lead = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))
            text, at, key = text[lead], at[lead], key[lead]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + text)), pa.array(key.view(np.int64)), _windows(words, at, run)], names=["document_id", "key", "window"])


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "document_id", text_column: str = "normalized_text", run: int = 12) -> DataFrame:
    """``document_id, item_id``: the documents that share ``run`` consecutive words with an item.

    Null, empty and short texts share nothing; items of fewer words have no pattern (see
    ``unsearched``); repeated rows count once; documents or items with a null id are left
    out; empty tables give an empty result; whole texts are read, once.
    """
    if not BLOCK <= run <= 250:
        raise ValueError(f"a run has {BLOCK} to 250 words")
    corpus = documents.select(F.col(id_column).cast("string").alias("document_id"), F.col(text_column).alias("text")).filter(F.col("document_id").isNotNull())
    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    patterns = cut(chosen.mapInArrow(lambda it: _pattern_rows(it, run), "key long, window binary, item_id long").distinct())
    shifts, bits = shift_table(chosen, run, patterns.count())
    met = corpus.mapInArrow(lambda it: _scan(it, shifts, bits, run), "document_id string, key long, window binary")
    return met.join(patterns, ["key", "window"]).select("document_id", "item_id").distinct()


def blocked_items(items: DataFrame, config: DataFrame) -> DataFrame:
    """The test items whose holdout document must stay out of training."""
    blocked = config.select(F.explode("exclusion.blocked_from_training_document_ids").alias("document_id")).distinct()
    return items.join(blocked, "document_id", "left_semi")


def unsearched(items: DataFrame, config: DataFrame, run: int = 12) -> DataFrame:
    """``item_id, reason``: items that ``leaks`` cannot report, because they are no held-out
    ones ('not_blocked') or have fewer words than a run ('short'; a null text counts as such)."""
    blocked = config.select(F.explode("exclusion.blocked_from_training_document_ids").alias("document_id")).distinct().withColumn("held", F.lit(True))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in K.chunks(batch.column(2), K.fold_alnum):
                _, bounds = K.word_hashes(data, offsets, K.ALNUM_WORDS)
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(bounds) < run)], names=["item_id", "held", "short"])

    rows = items.join(blocked, "document_id", "left").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("held", F.lit(False)).alias("held"), "text").filter("item_id is not null")
    return rows.mapInArrow(short, "item_id long, held boolean, short boolean").filter("not held or short").select("item_id", F.when(~F.col("held"), "not_blocked").otherwise("short").alias("reason")).distinct()
