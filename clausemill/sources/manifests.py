"""Scans of manifests, record folders, checkpoints and small inputs."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SOURCE_ENTRY = (
    "document_id string, family_id string, document_type string, source_name string, source_url string, local_path string, sha256 string, rights_status string, source_license string, rights_notes string, "
    "is_template boolean, media_type string, jurisdiction string, language string, related_document_ids array<string>, retrieved_at date, training_eligible boolean, validation_role string"
)
EVIDENCE = "struct<document_id string, text string, page_number int, page_label string, section string, start_char int, end_char int>"
ANSWER = f"struct<schema_version string, question string, perspective string, status string, explanation string, confidence double, evidence array<{EVIDENCE}>, warnings array<string>>"
RESPONSE = f"struct<text string, answer {ANSWER}, invented_facts boolean>"
#: The superset of the kinds of record; each kind fills its own columns.
RECORD = (
    "record_id string, subset string, family_id string, document_ids array<string>, source_texts map<string,string>, rights_status string, source_license string, source_name string, synthetic boolean, split string, "
    f"document_type string, extraction string, perspective string, answer {ANSWER}, turns array<struct<role string, text string, answer {ANSWER}>>, prompt string, preferred {RESPONSE}, rejected {RESPONSE}, ranking_reason string"
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON manifest ``{"sources": [...]}``, with their ordinal; malformed files fail."""
    whole = spark.read.schema(f"sources array<struct<{_fields(SOURCE_ENTRY)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.posexplode("sources").alias("ordinal", "s")).select("ordinal", "s.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def entry(entries: DataFrame, document_id: str):
    """The first entry of a document; an unknown one is a KeyError."""
    row = entries.filter(F.col("document_id") == document_id).orderBy("ordinal").first()
    if row is None:
        raise KeyError(document_id)
    return row


# Kinds of record.
SUBSETS = ("raw_domain_text", "structured_extraction", "evidence_conversation", "refusal_uncertainty", "multi_turn", "preference_pairs")


def system_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address (local, hdfs, s3, gs), and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(target)


def read_text(path: str) -> str:
    """A small file, on the driver."""
    system, inner = system_of(path)
    with system.open_input_stream(inner) as f:
        return f.read().decode("utf-8")


def records(spark: SparkSession, root: str) -> DataFrame:
    """Records of a folder of JSON files, one each (or a list of them), with ``path`` and ``ordinal``, which grows with the paths.

    An unknown subset or a file that is no JSON fails the scan; a folder without any JSON file is an error.
    """
    frame = spark.read.schema(RECORD).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "FAILFAST").json(root)
    if not frame.inputFiles():
        raise FileNotFoundError(f"no record files below {root}")
    known = F.when(F.col("subset").isin(*SUBSETS), F.col("subset")).otherwise(F.raise_error(F.concat(F.lit("unknown subset "), F.coalesce("subset", F.lit("null")))).cast("string"))
    return frame.withColumn("subset", known).withColumn("path", F.col("_metadata.file_path")).orderBy("path").withColumn("ordinal", F.monotonically_increasing_id())


def subset_records(frame: DataFrame, subset: str) -> DataFrame:
    return frame.filter(F.col("subset") == subset)


def checkpoint_rows(spark: SparkSession, path: str, key: str = "record_id") -> DataFrame:
    """``key, line``: the last row of each key of a JSON-lines log; an absent log is empty, blank lines are skipped.

    Rows of ``append_rows`` go by batch and place within it; of other files the later
    one counts, then the later line.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, line string")
    text = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).alias("batch"), F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    rows = text.filter(F.trim("value") != "").withColumn(key, F.get_json_object("value", f"$.{key}"))
    numbered = F.coalesce(F.when(F.col("batch") != "", F.col("batch").cast("long")), F.lit(-1))
    place = F.coalesce(F.get_json_object("value", "$._row").cast("long"), F.lit(-1))
    order = F.struct(numbered.alias("batch"), F.when(numbered < 0, F.col("time")).alias("time"), place.alias("row"), "file", "block", "at")
    return rows.groupBy(key).agg(F.max_by("value", order).alias("line"))


def scripted_outputs(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, output`` of a JSON object of strings; an empty one is an error."""
    found = json.loads(read_text(path))
    if not isinstance(found, dict) or not found or not all(isinstance(v, str) for v in found.values()):
        raise ValueError("scripted outputs must be a non-empty JSON object of strings")
    return spark.createDataFrame(sorted(found.items()), "record_id string, output string")


def ranked_fixture(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, relevant`` of the ``predictions`` of a ranked fixture, in their order."""
    whole = spark.read.schema("predictions array<struct<relevant: boolean>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.posexplode("predictions").alias("ordinal", "p")).select("ordinal", "p.relevant")


def runs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """One row a run file, with ``ordinal``, the place of its path in the list."""
    frame = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    order = spark.createDataFrame([(p.rsplit("/", 1)[-1], i) for i, p in enumerate(paths)], "name string, ordinal int")
    return frame.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).join(order, "name").drop("name")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, review_status, notes`` of a review file; the last row of an id wins."""
    whole = spark.read.schema("samples array<struct<record_id: string, review_status: string, notes: string>>").option("multiLine", True).json(path)
    rows = whole.select(F.posexplode("samples").alias("n", "s")).filter(F.length("s.record_id") > 0)
    return rows.groupBy(F.col("s.record_id").alias("record_id")).agg(F.max_by("s", "n").alias("s")).select("record_id", "s.review_status", "s.notes")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a text file that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("document_id")).filter(F.length("document_id") > 0)


def config(path: str) -> dict:
    """A small JSON configuration, on the driver."""
    found = json.loads(read_text(path))
    if not isinstance(found, dict):
        raise ValueError("a configuration is a JSON object")
    return found


def write_json(path: str, value: dict) -> None:
    """Sorted keys, two blanks of indent, a line feed at the end."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".partial", "w", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, indent=2, default=str) + "\n")
    os.replace(path + ".partial", path)


def append_rows(frame: DataFrame, path: str) -> int:
    """Append rows to a JSON-lines log as its next batch (a folder of parts); the batch's number.

    Rows keep their order in ``_row``; a batch is a folder of its own, so readers tell
    what came later without any clock.
    """
    spark = frame.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    system = root.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
    number = 1 + max((int(n[6:]) for n in names if re.fullmatch(r"batch=\d+", n)), default=0)
    frame.withColumn("_row", F.monotonically_increasing_id()).write.json(f"{path}/batch={number:010d}")
    return number


def write_objects(frame: DataFrame, path: str, name: str | None = None) -> None:
    """Rows as JSON files, one a partition: a list of objects, or an object with the list under ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for batch in batches for x in batch.column(0).to_pylist()]
        if rows:
            text = "[" + ",".join(rows) + "]"
            yield pa.RecordBatch.from_arrays([pa.array([f'{{"{name}":{text}}}' if name else text])], names=["value"])

    frame.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def export_schemas(folder: str) -> list[str]:
    """Write the record schemas as JSON files; their names."""
    made = []
    for name, ddl in {"source_entry": SOURCE_ENTRY, "record": RECORD, "answer": f"answer {ANSWER}"}.items():
        write_json(os.path.join(folder, f"{name}.schema.json"), json.loads(StructType.fromDDL(ddl).json()))
        made.append(f"{name}.schema.json")
    return made


def violations(entries: DataFrame) -> DataFrame:
    """``document_id, failure``: entries of an insecure address, an open licence without a name, a review without notes, or a repeated id."""
    failure = F.array_compact(
        F.array(
            F.when(~F.startswith("source_url", F.lit("https://")), "insecure_url"),
            F.when((F.col("rights_status") == "open_license") & F.col("source_license").isNull(), "licence_unnamed"),
            F.when((F.col("rights_status") == "review_required") & F.col("rights_notes").isNull(), "review_without_notes"),
        )
    )
    single = entries.select("document_id", F.explode(failure).alias("failure"))
    repeated = entries.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("document_id", F.lit("id_repeated").alias("failure"))
    return single.unionByName(repeated).distinct()
