"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clausemill.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs ``hi > lo``; hubs are joined to their minimum, never gathered.

    large: each node hangs its larger neighbours on the least node near it.
    small: each node hangs itself and its smaller neighbours on the least of them.
    """
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.filter("hi <> lo").distinct()


#: Edges of a partition that are contracted together; bounds the memory of a task.
LOCAL_EDGES = 1 << 20


def _contracted(hi: pa.Array, lo: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The same ties as stars: every node of the edges hangs on the least one it reaches through them."""
    coded = pa.concat_arrays([hi, lo]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[coded.indices.to_numpy()]
    x, y = ends[: len(hi)], ends[len(hi) :]
    label = np.arange(len(order))
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    node = np.flatnonzero(label != np.arange(len(label)))
    values = coded.dictionary.take(pa.array(order))
    return values.take(pa.array(node)), values.take(pa.array(label[node]))


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts the edges of a partition, ``LOCAL_EDGES`` at a time, so stars need few rounds."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out() -> pa.RecordBatch:
        both = pa.Table.from_batches(held).combine_chunks()
        hi, lo = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in both.columns)
        hi, lo = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (hi, lo))
        return pa.RecordBatch.from_arrays(list(_contracted(hi, lo)), names=["hi", "lo"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= LOCAL_EDGES:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root`` of every node that has an edge; the root is the component's least node.

    Nulls and loops are ignored.  Each round is written to the shared folder, so
    the lineage stays short; a component of diameter d needs about log d rounds.
    An edge table that is empty gives an empty result.
    """
    first = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    kind = dict(first.dtypes)["hi"]
    local = lambda frame: frame.mapInArrow(_locally, f"hi {kind}, lo {kind}")
    now = cut(local(first))
    mark = None
    for step in range(rounds + 1):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        if step == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        now = cut(local(_star(_star(now, True), False)))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def class_pairs(members: DataFrame, class_column: str, id_column: str, block: int = 512) -> DataFrame:
    """``a, b`` of every two different members of a class, a < b.

    For results whose columns ask for pairs.  A class is cut into blocks of about
    ``block`` members and blocks are paired, so a class that a third of all rows share
    is spread over as many tasks as it has pairs of blocks.
    """
    m = members.select(F.col(class_column).alias("c"), F.col(id_column).alias("m")).filter("c is not null and m is not null").distinct()
    sizes = m.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    placed = m.join(sizes, "c").withColumn("own", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = placed.select("c", F.col("own").alias("i"), F.col("other").alias("j"), F.col("m").alias("a"))
    right = placed.select("c", F.col("other").alias("i"), F.col("own").alias("j"), F.col("m").alias("b"))
    return left.join(right, ["c", "i", "j"]).filter("a < b").select("a", "b")


def block_join(left: DataFrame, right: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """Inner join of two sides on ``key``, no task of which holds more than about ``size`` rows of a left group.

    Rows of keys that one side lacks go first; a left group is cut into parts by hash
    of its row, to each of which the right group is sent.  So a key that a third of all
    rows share is spread over many tasks.
    """
    left_counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = left_counts.join(right.select(key).distinct(), key).select(key, F.ceil(F.col("_n") / size).cast("int").alias("_parts"))
    parts = cut(parts)
    spread = left.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int")).drop("_parts")
    copied = right.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return spread.join(copied, [key, "_part"]).drop("_part")
