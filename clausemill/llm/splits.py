"""Splits that keep tied records together, over a persisted component table.

The table lies in a folder of the shared file system, one version a batch: ``keys``
(key, component) and ``components`` (component, split, size, since).  Keys are family
values (``f:``), document ids (``d:``) and records (``r:``); a component is named by its
least key.  A batch loads the last version, finds the rows of its own keys, and contracts
the graph of these keys and the components they touch, nothing else: old components that
meet get one root, and the rows of the table that point to them jump to it.  Components
that exist keep their split; components of different splits that merge are quarantined;
all new ones fill what is missing of the wanted shares of the records of all batches.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from clausemill.llm.components import class_pairs, components
from clausemill.session import cut, shared_dir

SPLITS = ("train", "validation", "test")
QUARANTINE = "quarantine"
KEYS, COMPONENTS = "key string, component string", "component string, split string, size long, since int"
SLOTS = 4096


@dataclass
class ComponentTable:
    """A version of the table: ``keys`` and ``components`` as read from the folder."""

    path: str
    version: int
    keys: DataFrame
    components: DataFrame

    def records(self) -> DataFrame:
        """``record_id, component, split, since`` of all records of all batches."""
        own = self.keys.filter("key like 'r:%'").select(F.expr("substring(key, 3)").alias("record_id"), "component")
        return own.join(self.components, "component").select("record_id", "component", "split", "since")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written to their end (the components come last)."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    system = root.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(jvm.Path(f"{path}/{n}/components/_SUCCESS")))


def load(spark: SparkSession, path: str) -> ComponentTable | None:
    """The last whole version of the table, None where there is none yet."""
    found = _versions(spark, path)
    if not found:
        return None
    at = f"{path}/v{found[-1]:06d}"
    return ComponentTable(path, found[-1], spark.read.schema(KEYS).parquet(f"{at}/keys"), spark.read.schema(COMPONENTS).parquet(f"{at}/components"))


def _store(spark: SparkSession, path: str, version: int, keys: DataFrame, parts: DataFrame) -> ComponentTable:
    at = f"{path}/v{version:06d}"
    keys.write.mode("overwrite").parquet(f"{at}/keys")
    parts.write.mode("overwrite").parquet(f"{at}/components")
    return load(spark, path)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for a table in the shared folder of the session."""
    return f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"


def family_key(column: str) -> Column:
    """The family that a stored value names; null where it names none."""
    folded = F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "-")
    return F.when(F.length(folded) > 0, folded)


def record_keys(records: DataFrame, family: str = "family_id", documents: str = "document_ids") -> DataFrame:
    """``record_id, keys``: the distinct keys of every row, families before documents."""
    keys = F.array_distinct(
        F.concat(
            F.array_compact(F.array(F.concat(F.lit("f:"), family_key(family)))),
            F.coalesce(F.transform(F.array_compact(F.col(documents)), lambda d: F.concat(F.lit("d:"), d)), F.array().cast("array<string>")),
        )
    )
    return records.select("record_id", keys.alias("keys"))


def update(records: DataFrame, salt: str, percents: dict[str, int], path: str) -> ComponentTable:
    """Take a batch of records into the table at ``path`` and write its next version.

    A record delivered twice, in one batch or in several, counts once, and its keys
    together tie.  Rows without an id tie their keys and are not counted; a record without
    any key is a component by itself; families that name nothing are no key.  An empty
    batch gives a version that differs in nothing.
    """
    if sum(percents.values()) != 100 or set(percents) - set(SPLITS):
        raise ValueError("the percentages of train, validation and test must add up to 100")
    spark = records.sparkSession
    old = load(spark, path)
    rows = record_keys(records)
    of_record = F.concat(F.lit("r:"), F.col("record_id"))
    named = rows.filter("record_id is not null").groupBy("record_id").agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"))
    if old is not None:
        seen = old.keys.filter("key like 'r:%'").select(F.col("key").alias("_seen"))
        named = named.join(seen, of_record == F.col("_seen"), "left").select("record_id", F.when(F.col("_seen").isNull(), F.col("keys")).otherwise(F.array_union(F.array("_seen"), "keys")).alias("keys"))
    named = named.withColumn("keys", F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(of_record)))
    keyed = cut(named.unionByName(rows.filter("record_id is null and size(keys) > 0")))

    edges = keyed.filter("size(keys) > 1").select(F.element_at("keys", 1).alias("a"), F.explode(F.expr("slice(keys, 2, size(keys))")).alias("b")).distinct()
    mine = keyed.select(F.explode("keys").alias("key")).distinct()
    if old is not None:
        touched = cut(old.keys.join(mine, "key", "left_semi"))
        edges = edges.unionByName(touched.filter("key <> component").select(F.col("key").alias("a"), F.col("component").alias("b")))
    roots = cut(components(edges))
    placed = cut(mine.join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("component")))
    owner = keyed.filter("record_id is not null").select(of_record.alias("record"), F.element_at("keys", 1).alias("key")).join(placed, "key").select(F.col("record").alias("key"), "component")
    fresh_keys = placed.unionByName(owner).distinct()
    version = 1
    if old is None:
        keys = fresh_keys
        counted = owner.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        parts = placed.select("component").distinct().join(counted, "component", "left").select("component", F.lit(None).cast("string").alias("split"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(1).alias("since"))
    else:
        version = old.version + 1
        # Components that the batch touches, and where they are now.
        moved = touched.select("component").distinct().join(roots, F.col("component") == F.col("node")).select("component", F.col("root").alias("now")).filter("component <> now")
        jump = lambda frame: frame.join(moved, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
        new_keys = fresh_keys.join(old.keys.select("key"), "key", "left_anti")
        keys = jump(old.keys).select("key", "component").unionByName(new_keys)
        added = new_keys.filter("key like 'r:%'").groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        new_parts = placed.select("component").distinct().join(added, "component", "left").select("component", F.lit(None).cast("string").alias("split"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(version).alias("since"))
        both = jump(old.components).select("component", "split", "size", "since").unionByName(new_parts)
        splits = F.collect_set("split")
        parts = both.groupBy("component").agg(splits.alias("s"), F.sum("size").alias("size"), F.min("since").alias("since")).select(
            "component", F.when(F.size("s") > 1, QUARANTINE).when(F.size("s") == 1, F.element_at("s", 1)).alias("split"), "size", "since"
        )
    parts = cut(parts)
    full = parts.filter("split is not null").unionByName(fill_deficits(parts, salt, percents))
    return _store(spark, path, version, keys, full)


def quotas(size: int, count: int, missing: dict[str, float]) -> dict[str, int]:
    """How many of ``count`` components of one size each split gets, so that the largest deficits shrink first."""
    order = sorted(missing, key=lambda s: (-missing[s], SPLITS.index(s)))
    level, active = 0.0, len(order)
    for active in range(1, len(order) + 1):
        level = (sum(missing[s] for s in order[:active]) - count * size) / active
        if active == len(order) or level >= missing[order[active]]:
            break
    out = {s: 0 for s in missing}
    for s in order[:active]:
        out[s] = max(0, math.floor((missing[s] - level) / size + 1e-9))
    while sum(out.values()) > count:
        out[max((s for s in order if out[s]), key=lambda s: out[s])] -= 1
    for _ in range(count - sum(out.values())):
        out[max(order, key=lambda s: (missing[s] - out[s] * size, -SPLITS.index(s)))] += 1
    return out


def fill_deficits(parts: DataFrame, salt: str, percents: dict[str, int]) -> DataFrame:
    """The components without a split, with the split they fill: the largest first, ties by salted hash.

    What is collected is one row a split and distinct size: sizes that add up to n records are
    fewer than the square root of 2 n.  Places within a size come from counts by hash
    slot and a row number within the slot, so no task holds all components of a size.
    """
    spark = parts.sparkSession
    sizes = parts.groupBy("split", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["size"] * r.n for r in sizes)
    missing = {s: total * percents[s] / 100 - sum(r["size"] * r.n for r in sizes if r.split == s) for s in SPLITS if percents.get(s, 0)}
    fresh = parts.filter("split is null")
    levels = []
    for r in sorted((r for r in sizes if r.split is None), key=lambda r: -r["size"]):
        given = quotas(max(1, r["size"]), r.n, missing)
        for s, n in given.items():
            missing[s] -= n * r["size"]
        levels.append((r["size"], given.get("train", 0), given.get("train", 0) + given.get("validation", 0)))
    hashed = F.sha2(F.concat(F.lit(salt + ":"), F.col("component")), 256)
    slotted = fresh.withColumn("h", hashed).withColumn("slot", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(SLOTS)))
    counts = slotted.groupBy("size", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("size", "slot", (F.sum("n").over(W.partitionBy("size").orderBy("slot")) - F.col("n")).alias("before"))
    ranked = slotted.withColumn("i", F.row_number().over(W.partitionBy("size", "slot").orderBy("h", "component"))).join(before, ["size", "slot"])
    bounds = spark.createDataFrame(levels, "size long, upto long, upto2 long")
    place = F.col("before") + F.col("i")
    split = F.when(place <= F.col("upto"), "train").when(place <= F.col("upto2"), "validation").otherwise("test")
    return ranked.join(bounds, "size").select("component", split.alias("split"), "size", "since")


def assign_splits(records: DataFrame, salt: str, percents: dict[str, int], path: str | None = None) -> DataFrame:
    """``record_id, component, split, since`` of all records of the table after this batch."""
    return update(records, salt, percents, path or fresh_folder(records.sparkSession)).records()


def in_batches(records: DataFrame, salt: str, percents: dict[str, int], batches: int = 2) -> ComponentTable:
    """All records, taken into a fresh table batch by batch (by hash of the record id)."""
    path = fresh_folder(records.sparkSession)
    number = F.pmod(F.coalesce(F.xxhash64("record_id"), F.lit(0)), F.lit(batches))
    return [update(records.filter(number == i), salt, percents, path) for i in range(batches)][-1]


def family_pairs(records: DataFrame, table: ComponentTable) -> DataFrame:
    """``family_a, family_b``: distinct stored family values that the table ties."""
    named = records.select("family_id").filter("family_id is not null").distinct().withColumn("key", F.concat(F.lit("f:"), family_key("family_id"))).filter("key is not null")
    placed = cut(named.join(table.keys, "key").select("family_id", "component"))
    return class_pairs(placed, "component", "family_id").select(F.col("a").alias("family_a"), F.col("b").alias("family_b"))


def configured(config: DataFrame) -> tuple[str, dict[str, int]]:
    """Salt and percentages of the one configuration row."""
    r = config.select("splits").first().splits
    return r.salt, {"train": r.train_percent, "validation": r.validation_percent, "test": r.test_percent}


def split_report(assigned: DataFrame) -> DataFrame:
    total = assigned.count()
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"), F.round(F.count(F.lit(1)) / F.lit(max(1, total)), 6).alias("share"))
