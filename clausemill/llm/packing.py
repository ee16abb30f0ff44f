"""Filling containers of fixed capacity: conflict-constrained best fit, decreasing.

Texts are spread over shards by hash, so copies of one text and large sources lie
evenly on all of them.  A shard keeps its open containers ordered by what is left in
them; each carries bitmaps of its sources and duplicate clusters.  An item goes to
the tightest container that holds it and has nothing against it: the search starts at
the item's size and follows the order.  Containers that stay far from full are taken
apart and packed once more over many shards together.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.llm import tokens as T
from clausemill.session import cut

#: Items a shard is sized for, and shards whose loose ends are packed together.
SHARD_ITEMS = 4096
JOINED_SHARDS = 32
#: A container filled to less than this is packed again.
LOOSE = 0.985


def best_fit(sizes: np.ndarray, clusters: np.ndarray, sources: np.ndarray, capacity: int, most_sources: int | None = None) -> np.ndarray:
    """The container of each item, from 0; items are taken from the largest down, ties in order.

    No two items of one cluster share a container (cluster -1 has no conflicts), nor
    do more than ``most_sources`` sources.
    """
    order = np.argsort(-sizes, kind="stable")
    _, cluster_no = np.unique(clusters, return_inverse=True)
    repeated = np.bincount(cluster_no)[cluster_no] > 1
    bit: dict[int, int] = {}
    home = np.zeros(len(sizes), np.int64)
    open_: list[tuple[int, int]] = []  # (left, container), ordered
    held: list[int] = []
    origin: list[int] = []
    source_bit: dict[int, int] = {}
    for i in order.tolist():
        size = int(sizes[i])
        mark = 0
        if repeated[i] and clusters[i] != -1:
            mark = 1 << bit.setdefault(int(cluster_no[i]), len(bit))
        of = 1 << source_bit.setdefault(int(sources[i]), len(source_bit))
        at = bisect_left(open_, (size, -1))
        while at < len(open_):
            box = open_[at][1]
            if not held[box] & mark and (most_sources is None or (origin[box] | of).bit_count() <= most_sources):
                break
            at += 1
        if at < len(open_):
            left, box = open_.pop(at)
        else:
            left, box = capacity, len(held)
            held.append(0)
            origin.append(0)
        held[box] |= mark
        origin[box] |= of
        home[i] = box
        if left - size > 0:
            insort(open_, (left - size, box))
    return home


_OUT = "shard long, box long, doc_id long, piece int, start_token long, tokens long, cluster long, source int, fill long"


def _pack(table: pa.Table, capacity: int, most_sources: int | None) -> pa.Table:
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("piece", "ascending")])
    sizes = table.column("tokens").to_numpy()
    home = best_fit(sizes, table.column("cluster").to_numpy(), table.column("source").to_numpy(), capacity, most_sources)
    fill = np.bincount(home, weights=sizes, minlength=int(home.max()) + 1).astype(np.int64)
    cols = {"shard": table.column("shard"), "box": pa.array(home), **{c: table.column(c) for c in ("doc_id", "piece", "start_token", "tokens", "cluster", "source")}, "fill": pa.array(fill[home])}
    return pa.Table.from_pydict(cols)


def items(documents: DataFrame, capacity: int, vocabulary: str = T.VOCABULARY, id_column: str = "doc_id", text_column: str = "text", source_column: str | None = "source", clusters: DataFrame | None = None) -> DataFrame:
    """``doc_id, piece, start_token, tokens, cluster, source``: texts, cut only where they alone exceed the capacity.

    clusters: ``doc_id, class_id`` of near-duplicate groups; without them, and for texts
    they do not name, the copies of a text (blanks and case aside) are a cluster.  Null
    sources count as one source.
    """
    folded = F.lower(F.regexp_replace(F.trim(text_column), r"\s+", " "))
    base = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("_text"),
        F.xxhash64(folded).alias("cluster"),
        (F.hash(F.coalesce(F.col(source_column), F.lit(""))) if source_column else F.lit(0)).alias("source"),
    ).filter("doc_id is not null and _text is not null and _text <> ''")
    sized = T.counted(base, "_text", vocabulary, ["doc_id", "cluster", "source"]).filter("tokens > 0")
    # A row delivered twice counts once.
    sized = sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "cluster", "source")).alias("r")).select("doc_id", "r.*")
    if clusters is not None:
        # What is joined are sizes, not texts.
        groups = clusters.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("class_id").alias("class")).distinct()
        sized = sized.join(groups, "doc_id", "left").withColumn("cluster", F.coalesce("class", "cluster")).drop("class")
    whole = F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))
    return sized.select("doc_id", F.explode(whole).alias("piece"), "tokens", "cluster", "source").select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece").cast("long") * capacity).alias("tokens"), "cluster", "source"
    )


def pack(parts: DataFrame, capacity: int = 4096, most_sources: int | None = None) -> DataFrame:
    """``container_id, doc_id, piece, start_token, tokens, fill``: every item in one container.

    Null and empty texts have no items; an empty table gives an empty result.
    """
    parts = cut(parts)
    shards = max(1, math.ceil(parts.count() / SHARD_ITEMS))
    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(11)), F.lit(shards)))
    first = cut(sharded.groupBy("shard").applyInArrow(lambda t: _pack(t, capacity, most_sources), _OUT))
    loose = F.col("fill") < F.lit(int(capacity * LOOSE))
    again = first.filter(loose).drop("box", "fill").withColumn("shard", (F.col("shard") / JOINED_SHARDS).cast("long"))
    second = again.groupBy("shard").applyInArrow(lambda t: _pack(t, capacity, most_sources), _OUT)
    name = lambda level: F.concat(F.lit(f"{level}-"), F.col("shard"), F.lit("-"), F.col("box"))
    out = first.filter(~loose).withColumn("container_id", name("a")).unionByName(second.withColumn("container_id", name("b")))
    return out.select("container_id", "doc_id", "piece", "start_token", "tokens", "fill")


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    boxes = packed.groupBy("container_id").agg(F.sum("tokens").alias("fill"))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.ceil(F.sum("fill") / capacity).alias("least_containers"), F.round(F.sum("fill") / (F.count(F.lit(1)) * capacity), 6).alias("filled")
    )
