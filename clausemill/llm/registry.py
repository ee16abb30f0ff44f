"""Queries of the problems, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.llm import cross_split, leaks, mixing, near_duplicates, packing, privacy, sentences, splits, splitting
from clausemill.session import shared_dir, table, text_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(text_table(spark, sf_dir, "processed_document"), threshold=0.70)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_pairs(p1_groups(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = leaks.blocked_items(table(spark, sf_dir, "eval_item"), table(spark, sf_dir, "dataset_config"))
    return leaks.leaks(text_table(spark, sf_dir, "processed_document"), items)


def p2_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each leaked item."""
    return p2_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p2_unsearched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the search cannot report, and why."""
    return leaks.unsearched(table(spark, sf_dir, "eval_item"), table(spark, sf_dir, "dataset_config"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence with the surrogate that replaces it."""
    return privacy.entities(text_table(spark, sf_dir, "processed_document"), table(spark, sf_dir, "name_list"), key="clausemill")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences that got a surrogate unlike themselves: all of them."""
    return p3_entities(spark, sf_dir).filter("surrogate is not null").select("document_id", "kind", "start_char").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with typed placeholders, and the corrected codes."""
    return privacy.redacted(text_table(spark, sf_dir, "processed_document"), table(spark, sf_dir, "name_list"))


def p3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with keyed surrogates, and the corrected codes."""
    return privacy.redacted(text_table(spark, sf_dir, "processed_document"), table(spark, sf_dir, "name_list"), key="clausemill")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.ordered_pairs(cross_split.cross_split_pairs(table(spark, sf_dir, "dataset_record"), threshold=0.70))


def p4_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "dataset_record")
    return cross_split.overlap_report(records, cross_split.cross_split_pairs(records, threshold=0.70))


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_long(table(spark, sf_dir, "text_block"), ["document_id", "block_id"], "text", 1200)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that came out in more than one piece."""
    return p5_blocks(spark, sf_dir).filter("piece > 0").select("document_id", "block_id").distinct()


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All normalized texts as a few large files, cut by byte ranges: pieces, characters and the longest piece of each file."""
    texts = text_table(spark, sf_dir, "processed_document").select("normalized_text")
    paths = splitting.export_texts(texts, "normalized_text", f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}")
    pieces = splitting.split_files(spark, paths, 4000)
    return pieces.groupBy(F.element_at(F.split("path", "/"), -1).substr(1, 10).alias("file")).agg(F.count(F.lit(1)).alias("pieces"), F.max("end_char").alias("chars"), F.max(F.length("piece_text")).alias("longest"))


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_long(text_table(spark, sf_dir, "processed_document"), ["document_id"], "normalized_text", 4000)


def _split_settings(spark: SparkSession, sf_dir: str):
    return splits.configured(table(spark, sf_dir, "dataset_config"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of the persisted table after the records came in two batches."""
    records = table(spark, sf_dir, "dataset_record")
    return splits.family_pairs(records, splits.in_batches(records, *_split_settings(spark, sf_dir)))


def p6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every record, in one batch."""
    return splits.assign_splits(table(spark, sf_dir, "dataset_record"), *_split_settings(spark, sf_dir)).select("record_id", "component")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, components and records of each split by share, in one batch."""
    return splits.assign_splits(table(spark, sf_dir, "dataset_record"), *_split_settings(spark, sf_dir)).select("record_id", "component", "split")


def p6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all records are after the second of two batches, and how their component came there."""
    found = splits.in_batches(table(spark, sf_dir, "dataset_record"), *_split_settings(spark, sf_dir)).records()
    how = F.when(F.col("split") == splits.QUARANTINE, "quarantined").when(F.col("since") == 1, "kept").otherwise("filled")
    return found.select("record_id", "component", "split", how.alias("how"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No two near-duplicates and at most six sources in one container."""
    documents = text_table(spark, sf_dir, "documents")
    groups = near_duplicates.near_duplicate_groups(documents, "doc_id", "text")
    return packing.pack(packing.items(documents, 4096, clusters=groups), 4096, most_sources=6)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf_dir), 4096)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(text_table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(text_table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(text_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_groups, p2_found, p2_by_item, p2_unsearched, p3_found, p3_entities, p3_redacted, p3_surrogates, p4_found, p4_overlap, p5_found, p5_blocks, p5_documents, p5_files, p6_found, p6_components, p6_splits, p6_batches, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found]
    return {f.__name__: f for f in found}


#: Blanks as RE2 sees them when all of Unicode's are named.
_BLANK = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _similar(rows: str) -> str:
    """Similar pairs a < b of rows (id, text), as table pairs."""
    return f"""words AS (SELECT id, list_filter(string_split_regex(lower(text), '{_BLANK}+'), lambda x: x <> '') AS w FROM ({rows})),
 sets AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM words),
 spread AS (SELECT id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
 pairs AS (SELECT a.id AS a, b.id AS b FROM spread a JOIN spread b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9)"""


_SIDE = "CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'test' THEN 'test' WHEN 'testing' THEN 'test' END"
_FAMILY = f"regexp_replace(lower(regexp_replace(family_id, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '({_BLANK}|[_-])+', '-', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH RECURSIVE {_similar("SELECT document_id AS id, normalized_text AS text FROM processed_document WHERE normalized_text IS NOT NULL")},
 edges AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
 SELECT DISTINCT x AS document_a, y AS document_b FROM reach WHERE x < y""",
        "p4_found": f"""WITH records AS (SELECT DISTINCT record_id, {_SIDE} AS side, array_to_string(list_transform(list_sort(map_keys(source_texts)), lambda k: source_texts[k]), chr(10)) AS text FROM dataset_record),
 {_similar("SELECT (record_id, side) AS id, text FROM records WHERE side IS NOT NULL AND text IS NOT NULL")},
 crossed AS (SELECT a[1] AS x, b[1] AS y FROM pairs WHERE (a[2] = 'train') <> (b[2] = 'train') AND a[1] <> b[1])
 SELECT DISTINCT least(x, y) AS record_a, greatest(x, y) AS record_b FROM crossed""",
        "p1_groups": f"""WITH RECURSIVE {_similar("SELECT document_id AS id, normalized_text AS text FROM processed_document WHERE normalized_text IS NOT NULL")},
 edges AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
 SELECT document_id, coalesce(least(document_id, (SELECT min(y) FROM reach WHERE x = document_id)), document_id) AS class_id, (SELECT count(*) FROM edges WHERE x = document_id) AS links FROM (SELECT DISTINCT document_id FROM processed_document)""",
        "p4_overlap": f"""WITH records AS (SELECT DISTINCT record_id, {_SIDE} AS side, source_name, array_to_string(list_transform(list_sort(map_keys(source_texts)), lambda k: source_texts[k]), chr(10)) AS text FROM dataset_record),
 {_similar("SELECT DISTINCT (record_id, side) AS id, text FROM records WHERE side IS NOT NULL AND text IS NOT NULL")},
 held AS (SELECT CASE WHEN a[2] = 'train' THEN b[1] ELSE a[1] END AS record_id, count(DISTINCT CASE WHEN a[2] = 'train' THEN a[1] ELSE b[1] END) AS n FROM pairs WHERE (a[2] = 'train') <> (b[2] = 'train') AND a[1] <> b[1] GROUP BY 1)
 SELECT side AS split, source_name, count(DISTINCT record_id) AS records, count(DISTINCT CASE WHEN n > 0 THEN record_id END) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM (SELECT DISTINCT record_id, side, source_name FROM records WHERE side IN ('validation', 'test')) LEFT JOIN held USING (record_id) GROUP BY side, source_name""",
        "p5_found": "SELECT DISTINCT document_id, block_id FROM text_block WHERE length(text) > 1200",
        "p6_components": f"""WITH RECURSIVE r AS (SELECT record_id, CASE WHEN f <> '' THEN ['f:' || f] ELSE [] END || list_transform(list_filter(coalesce(document_ids, []), lambda x: x IS NOT NULL), lambda x: 'd:' || x) AS k FROM (SELECT record_id, {_FAMILY} AS f, document_ids FROM dataset_record WHERE record_id IS NOT NULL)),
 keys AS (SELECT DISTINCT record_id, unnest(CASE WHEN len(k) = 0 THEN ['r:' || record_id] ELSE k END) AS k FROM r), ties AS (SELECT DISTINCT a.k AS x, b.k AS y FROM keys a JOIN keys b USING (record_id) WHERE a.k <> b.k),
 reach(x, y) AS (SELECT DISTINCT k, k FROM keys UNION SELECT q.x, t.y FROM reach q JOIN ties t ON q.y = t.x), least AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
 SELECT DISTINCT record_id, component FROM keys JOIN least ON k = x""",
        "p6_found": f"""WITH RECURSIVE r AS (SELECT row_number() OVER () AS n, family_id, {_FAMILY} AS f, document_ids FROM dataset_record),
 keys AS (SELECT n, 'f:' || f AS k FROM r WHERE f <> '' UNION SELECT n, 'd:' || d FROM (SELECT n, unnest(document_ids) AS d FROM r)),
 ties AS (SELECT DISTINCT a.k AS x, b.k AS y FROM keys a JOIN keys b USING (n) WHERE a.k LIKE 'f:%' OR b.k LIKE 'f:%' OR a.k <> b.k), families AS (SELECT DISTINCT family_id, 'f:' || f AS k FROM r WHERE f <> ''),
 reach(x, y) AS (SELECT k, k FROM families UNION SELECT q.x, t.y FROM reach q JOIN ties t ON q.y = t.x)
 SELECT DISTINCT a.family_id AS family_a, b.family_id AS family_b FROM families a JOIN reach ON reach.x = a.k JOIN families b ON b.k = reach.y WHERE a.family_id < b.family_id""",
    }
