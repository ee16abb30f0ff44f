"""The query catalogue of the engine's own operators and their SQL twins.

Every query runs over its whole tables.  Ratios are one division, rounded to nine
places on both sides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.functions import text as T
from clausemill.operators import dataset as D, documents as O, metrics as M, regression as G, retrieval as R, runs as X, validators as V
from clausemill.plans import baseline as B2
from clausemill.session import cut, shared_dir, table, text_table
from clausemill.sources import files as Y, manifests as S

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}

#: Blanks as RE2 sees them when all of Unicode's are named.
B = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORDS = rf"list_filter(string_split_regex(lower(coalesce(%s, '')), '{B}+'), lambda x: x <> '')"
TOKENS = "regexp_extract_all(lower(%s), '[a-z0-9]+')"
SPLIT = "lower(trim(translate(split, '_-', '  ')))"
RECORDS = "(SELECT DISTINCT record_id, subset, family_id, document_ids, source_texts, rights_status, source_license, source_name, synthetic, split, answer, turns FROM dataset_record)"


#: The same with violations planted by the last digit of the id, so that checks have something to find.
_EV = """struct_pack(document_id := CASE WHEN k = '2' THEN 'nowhere' ELSE e.document_id END, "text" := CASE WHEN k = '1' THEN e."text" || '~' ELSE e."text" END, page_number := CASE WHEN k = '5' THEN NULL ELSE e.page_number END, page_label := e.page_label,
  section := CASE WHEN k = '5' THEN NULL ELSE e.section END, start_char := CASE WHEN k = '0' THEN e.start_char + 1 WHEN k = '5' THEN NULL ELSE e.start_char END, end_char := CASE WHEN k = '4' THEN e.start_char WHEN k IN ('3', '5') THEN NULL ELSE e.end_char END)"""
DAMAGED = f"""(SELECT record_id, subset, family_id, CASE k WHEN '8' THEN list_append(document_ids, 'unlisted') WHEN '9' THEN document_ids[2:] ELSE document_ids END AS document_ids, source_texts, split,
  CASE WHEN answer IS NULL THEN NULL ELSE struct_pack(question := answer.question, status := CASE WHEN k = '7' THEN 'answered' ELSE answer.status END, evidence := CASE WHEN k = '6' THEN answer.evidence[:0] ELSE list_transform(answer.evidence, lambda e: {_EV}) END) END AS answer,
  CASE k WHEN '6' THEN list_reverse(turns) WHEN '7' THEN turns[:1] ELSE turns END AS turns FROM (SELECT *, right(record_id, 1) AS k FROM {RECORDS}))"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        f.__name__ = name
        CATALOGUE[name] = (f, sql)
        return f

    return add


def shingle_sql(size: int) -> str:
    """Distinct runs of words of every document, as column sh."""
    return f"""w AS (SELECT document_id, {WORDS % 'normalized_text'} AS w FROM processed_document),
 s AS (SELECT document_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(list_slice(w, i, i + {size - 1}), ' '))) END AS sh FROM w)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return text_table(spark, d, "processed_document")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records, each once (rows delivered twice differ in nothing)."""
    return table(spark, d, "dataset_record").dropDuplicates(["record_id"])


def damaged(spark: SparkSession, d: str) -> DataFrame:
    """The records with violations planted, as in DAMAGED."""
    rows = records(spark, d)
    k = F.substring("record_id", -1, 1)

    def span(e):
        e = e.withField("document_id", F.when(k == "2", "nowhere").otherwise(e["document_id"])).withField("text", F.when(k == "1", F.concat(e["text"], F.lit("~"))).otherwise(e["text"]))
        e = e.withField("end_char", F.when(k == "4", e["start_char"]).when(~k.isin("3", "5"), e["end_char"]))
        e = e.withField("start_char", F.when(k == "0", e["start_char"] + 1).when(k != "5", e["start_char"]))
        return e.withField("page_number", F.when(k != "5", e["page_number"])).withField("section", F.when(k != "5", e["section"]))

    evidence = F.when(k == "6", F.slice("answer.evidence", 1, 0)).otherwise(F.transform("answer.evidence", span))
    answer = F.when(F.col("answer").isNotNull(), F.col("answer").withField("evidence", evidence).withField("status", F.when(k == "7", "answered").otherwise(F.col("answer.status"))))
    ids = F.when(k == "8", F.array_append("document_ids", F.lit("unlisted"))).when(k == "9", F.slice("document_ids", 2, F.greatest(F.size("document_ids"), F.lit(1)))).otherwise(F.col("document_ids"))
    turns = F.when(k == "6", F.reverse("turns")).when(k == "7", F.slice("turns", 1, 1)).otherwise(F.col("turns"))
    return rows.withColumns({"answer": answer, "document_ids": ids, "turns": turns})


REDACTED = (
    r"regexp_replace(regexp_replace(regexp_replace(normalized_text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g'),"
    r" '\b(?:\+1[-.\s\x{00a0}]?)?(?:\(?\d{3}\)?[-.\s\x{00a0}]?)\d{3}[-.\s\x{00a0}]?\d{4}\b', '[REDACTED_PHONE]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED_SSN]', 'g')"
)


@query("redact_documents", f"SELECT document_id, sha256({REDACTED}) AS sha256, length({REDACTED}) AS chars FROM processed_document")
def _(spark, d):
    text = T.redact(F.col("normalized_text"))
    return docs(spark, d).select("document_id", F.sha2(text, 256).alias("sha256"), F.length(text).cast("bigint").alias("chars"))


@query(
    "redaction_code_counts",
    f"""WITH r AS (SELECT {REDACTED} AS t, normalized_text AS o FROM processed_document)
    SELECT code, count(*) AS documents FROM (
      SELECT 'email' AS code FROM r WHERE contains(t, '[REDACTED_EMAIL]') AND NOT contains(o, '[REDACTED_EMAIL]')
      UNION ALL SELECT 'phone' FROM r WHERE contains(t, '[REDACTED_PHONE]') AND NOT contains(o, '[REDACTED_PHONE]')
      UNION ALL SELECT 'ssn' FROM r WHERE contains(t, '[REDACTED_SSN]') AND NOT contains(o, '[REDACTED_SSN]')) GROUP BY code""",
)
def _(spark, d):
    return docs(spark, d).select(F.explode(T.redaction_codes(F.col("normalized_text"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("documents"))


COLLAPSED = rf"regexp_replace(array_to_string(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{0085}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '{B}+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '^{B}+|{B}+$', '', 'g')"


@query("collapse_lines", f"SELECT doc_id, sha256({COLLAPSED}) AS sha256 FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return text_table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(T.collapse_lines(F.col("text")), 256).alias("sha256"))


@query("normalize_text")
def _(spark, d):
    """Compatibility composition has no SQL twin; the pytest literals hold it."""
    return text_table(spark, d, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("normalized"))


SEGMENTS = rf"""WITH flat AS (SELECT document_id, regexp_replace(array_to_string(list_transform(string_split_regex(normalized_text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{0085}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '{B}+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '^{B}+|{B}+$', '', 'g') AS t FROM processed_document),
 l AS (SELECT document_id, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS lines FROM flat),
 e AS (SELECT document_id, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS n FROM l),
 o AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS end_char FROM e),
 k AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(text, '^[# ]+', ''), '(?i)^(?:exhibit|schedule|appendix)\b') THEN 'exhibit' WHEN contains(text, '|') THEN 'table'
   WHEN regexp_matches(text, '(?i)^(?:#{{1,3}}\s+.+|article\s+[ivxlcdm0-9]+(?:\s*[.:-].*)?|section\s+[0-9]+(?:\.[0-9]+)*(?:\s*[.:-].*)?|(?:exhibit|schedule|appendix)\s+[a-z0-9]+(?:\s*[.:-].*)?|[0-9]+\.(?:[0-9]+(?:\.[0-9]+)*\.?)?\s+[A-Z].+)$') THEN 'heading' ELSE 'paragraph' END AS kind FROM o)"""


@query(
    "segment_blocks",
    SEGMENTS
    + " SELECT document_id, 'block-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS block_id, kind, text, CASE WHEN kind IN ('heading', 'exhibit') THEN trim(regexp_replace(text, '^[# ]+', '')) END AS heading, (end_char - length(text))::INT AS start_char, end_char::INT AS end_char FROM k",
)
def _(spark, d):
    return O.segment(docs(spark, d), normalize=False)


@query("block_kind_counts", SEGMENTS + " SELECT source.family_id AS family_id, kind, count(*) AS blocks FROM k JOIN processed_document USING (document_id) GROUP BY ALL")
def _(spark, d):
    return O.segment(docs(spark, d), normalize=False, keep={"family_id": F.col("source.family_id")}).groupBy("family_id", "kind").agg(F.count(F.lit(1)).alias("blocks"))


@query("delivered_block_kinds", "SELECT kind, count(*) AS blocks, count(DISTINCT document_id) AS documents, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM text_block GROUP BY kind")
def _(spark, d):
    return table(spark, d, "text_block").groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("document_id").alias("documents"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query(
    "offset_violations",
    "SELECT DISTINCT b.document_id, b.block_id, b.start_char, b.end_char FROM text_block b JOIN processed_document p USING (document_id) WHERE substr(p.normalized_text, b.start_char + 1, b.end_char - b.start_char) IS DISTINCT FROM b.text",
)
def _(spark, d):
    return O.offset_violations(table(spark, d, "text_block"), docs(spark, d))


@query("text_sha256", "SELECT document_id, sha256(normalized_text) AS sha256, sha256(normalized_text) = source.normalized_text_sha256 AS as_stored FROM processed_document")
def _(spark, d):
    sha = F.sha2("normalized_text", 256)
    return docs(spark, d).select("document_id", sha.alias("sha256"), (sha == F.col("source.normalized_text_sha256")).alias("as_stored"))


@query(
    "exact_duplicates",
    "SELECT document_id, f AS duplicate_of FROM (SELECT document_id, min(document_id) OVER (PARTITION BY upper(source.sha256[1:2])) AS f FROM processed_document WHERE source.sha256 IS NOT NULL) WHERE document_id <> f",
)
def _(spark, d):
    """Raw checksums are all different here, so files count as equal by their first two digits."""
    return O.exact_duplicates(docs(spark, d), checksum=F.upper(F.substring("source.sha256", 1, 2)))


@query(
    "exact_text_duplicates",
    "SELECT document_id, f AS duplicate_of FROM (SELECT document_id, min(document_id) OVER (PARTITION BY normalized_text) AS f FROM processed_document WHERE normalized_text IS NOT NULL) WHERE document_id <> f",
)
def _(spark, d):
    return O.exact_duplicates(docs(spark, d), checksum=F.sha2("normalized_text", 256))


@query("shingle_counts", f"WITH {shingle_sql(5)} SELECT document_id, len(sh)::INT AS shingles FROM s")
def _(spark, d):
    return docs(spark, d).select("document_id", F.size(T.shingles(F.col("normalized_text"), 5)).alias("shingles"))


NEAR = f"""WITH {shingle_sql(5)}, e AS (SELECT document_id, len(sh) AS n, hash(unnest(sh)) AS g FROM s),
 p AS (SELECT a.document_id AS a, b.document_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.document_id < b.document_id GROUP BY ALL HAVING c >= 0.85 * (any_value(a.n) + any_value(b.n) - c)
  UNION ALL SELECT a.document_id, b.document_id, 1, 1, 1 FROM s a JOIN s b ON len(a.sh) = 0 AND len(b.sh) = 0 AND a.document_id < b.document_id)"""


@query("near_duplicates", NEAR + " SELECT b AS document_id, a AS near_duplicate_of, round(c / (na + nb - c), 9) AS similarity FROM p")
def _(spark, d):
    return O.near_duplicates(docs(spark, d)).withColumn("similarity", F.round("similarity", 9))


@query(
    "cross_family_near_dups",
    NEAR + " SELECT b AS document_id, y.source.family_id AS later_family, a AS near_duplicate_of, x.source.family_id AS earlier_family, round(c / (na + nb - c), 9) AS similarity FROM p JOIN processed_document x ON x.document_id = a JOIN processed_document y ON y.document_id = b WHERE x.source.family_id <> y.source.family_id",
)
def _(spark, d):
    return O.cross_family_near_duplicates(docs(spark, d), family=F.col("source.family_id")).withColumn("similarity", F.round("similarity", 9))


BUCKET = "(('0x' || substr(sha256(c.splits.salt || ':' || r.family_id), 1, 8))::BIGINT % 100)"


@query(
    "family_split",
    f"SELECT DISTINCT r.record_id, r.family_id, coalesce({BUCKET}, -1) AS bucket, CASE WHEN {BUCKET} < c.splits.train_percent THEN 'train' WHEN {BUCKET} < c.splits.train_percent + c.splits.validation_percent THEN 'validation' WHEN r.family_id IS NOT NULL THEN 'test' END AS split FROM dataset_record r, dataset_config c",
)
def _(spark, d):
    """Records without a family have bucket -1 and no split."""
    found = D.hashed_splits(table(spark, d, "dataset_record"), table(spark, d, "dataset_config"))
    return found.withColumn("bucket", F.coalesce("bucket", F.lit(-1).cast("bigint")))


@query("split_statistics", f"SELECT subset, split, count(*) AS records FROM (SELECT subset, {SPLIT} AS split FROM {RECORDS}) GROUP BY ROLLUP (subset, split)")
def _(spark, d):
    return D.split_statistics(records(spark, d).select("subset", T.normalize_split(F.col("split")).alias("split")))


@query(
    "dataset_statistics",
    f"""WITH r AS (SELECT * FROM {RECORDS}), p AS (SELECT * FROM r WHERE split IS NOT NULL)
    SELECT 'records' AS metric, count(*) AS value FROM r UNION ALL SELECT 'families', count(DISTINCT family_id) FROM p UNION ALL SELECT 'documents', count(DISTINCT x) FROM (SELECT unnest(document_ids) AS x FROM p)
    UNION ALL SELECT 'synthetic', count(*) FILTER (WHERE synthetic) FROM p UNION ALL SELECT 'split:' || split, count(*) FROM p GROUP BY split UNION ALL SELECT 'licence:' || coalesce(source_license, rights_status), count(*) FROM p GROUP BY 1""",
)
def _(spark, d):
    return D.statistics(records(spark, d))


@query("subset_counts", f"SELECT subset, count(*) AS total, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'validation') AS validation, count(*) FILTER (WHERE s = 'test') AS test FROM (SELECT subset, {SPLIT} AS s FROM {RECORDS}) WHERE s IS NOT NULL GROUP BY subset")
def _(spark, d):
    return D.subset_counts(records(spark, d).withColumn("split", T.normalize_split(F.col("split"))))


@query("duplicate_ids", "SELECT record_id, count(*) AS times FROM dataset_record GROUP BY record_id HAVING count(*) > 1")
def _(spark, d):
    return D.duplicate_ids(table(spark, d, "dataset_record"))


@query(
    "family_split_leakage",
    f"SELECT family_id, array_to_string(list_sort(list(DISTINCT s)), ', ') AS splits FROM (SELECT family_id, coalesce({SPLIT}, 'unassigned') AS s FROM dataset_record WHERE family_id IS NOT NULL) GROUP BY family_id HAVING count(DISTINCT s) > 1",
)
def _(spark, d):
    return D.family_split_leakage(table(spark, d, "dataset_record").withColumn("split", T.normalize_split(F.col("split"))))


@query(
    "document_family_leakage",
    "SELECT document_id, array_to_string(list_sort(list(DISTINCT family_id)), ', ') AS families FROM (SELECT family_id, unnest(document_ids) AS document_id FROM dataset_record WHERE family_id IS NOT NULL) GROUP BY document_id HAVING count(DISTINCT family_id) > 1",
)
def _(spark, d):
    return D.document_family_leakage(table(spark, d, "dataset_record"))


@query(
    "licence_records",
    f"SELECT document_id, family_id, source_name, rights_status, source_license, synthetic FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY subset, record_id) AS n FROM (SELECT *, unnest(document_ids) AS document_id FROM {RECORDS})) WHERE n = 1",
)
def _(spark, d):
    return D.licence_records(records(spark, d))


BLOCKED = "(SELECT unnest(exclusion.blocked_from_training_document_ids) FROM dataset_config)"


@query("records_naming_blocked", f"SELECT DISTINCT record_id FROM (SELECT record_id, unnest(CASE WHEN right(record_id, 1) = '8' THEN list_append(document_ids, (SELECT exclusion.blocked_from_training_document_ids[1] FROM dataset_config)) ELSE document_ids END) AS x FROM dataset_record) WHERE x IN {BLOCKED}")
def _(spark, d):
    """With a held-out document added to the records whose id ends in 8."""
    config = table(spark, d, "dataset_config")
    first = F.broadcast(config.select(F.element_at("exclusion.blocked_from_training_document_ids", 1).alias("_first")).limit(1))
    rows = records(spark, d).join(first, F.lit(True)).withColumn("document_ids", F.when(F.substring("record_id", -1, 1) == "8", F.array_append("document_ids", F.col("_first"))).otherwise(F.col("document_ids")))
    return D.naming_blocked(rows, config).select("record_id")


@query("items_not_blocked", f"SELECT item_id, document_id FROM eval_item WHERE document_id NOT IN {BLOCKED}")
def _(spark, d):
    blocked = table(spark, d, "dataset_config").select(F.explode("exclusion.blocked_from_training_document_ids").alias("document_id"))
    return table(spark, d, "eval_item").join(blocked, "document_id", "left_anti").select("item_id", "document_id")


EVIDENCE = f"(SELECT record_id, (unnest(range(len(answer.evidence))))::INT AS ordinal, unnest(answer.evidence) AS e, source_texts FROM {RECORDS})"


@query(
    "evidence_failures",
    f"""SELECT record_id, ordinal, document_id, failure FROM (SELECT record_id, ordinal, e.document_id AS document_id, CASE WHEN s IS NULL THEN 'unknown_document' WHEN NOT contains(s, e.text) THEN 'quote_missing'
     WHEN e.start_char IS NOT NULL AND e.end_char IS NOT NULL AND substr(s, e.start_char + 1, e.end_char - e.start_char) <> e.text THEN 'offsets_differ' END AS failure FROM (SELECT *, source_texts[e.document_id] AS s FROM {EVIDENCE.replace(RECORDS, DAMAGED)})) WHERE failure IS NOT NULL""",
)
def _(spark, d):
    return D.evidence_failures(damaged(spark, d))


@query(
    "locator_violations",
    f"""SELECT record_id, ordinal, failure FROM (SELECT record_id, ordinal, CASE WHEN (e.start_char IS NULL) <> (e.end_char IS NULL) THEN 'offsets_unpaired' WHEN e.end_char <= e.start_char THEN 'offsets_reversed'
     WHEN e.start_char IS NULL AND e.page_number IS NULL AND e.section IS NULL THEN 'no_locator' END AS failure FROM {EVIDENCE.replace(RECORDS, DAMAGED)}) WHERE failure IS NOT NULL""",
)
def _(spark, d):
    return D.locator_violations(damaged(spark, d))


@query("shape_violations", f"SELECT * FROM (SELECT record_id, len(list_filter(document_ids, lambda x: NOT list_contains(map_keys(source_texts), x)))::INT AS missing, len(list_filter(map_keys(source_texts), lambda x: NOT list_contains(document_ids, x)))::INT AS extra FROM {DAMAGED}) WHERE missing > 0 OR extra > 0")
def _(spark, d):
    return D.shape_violations(damaged(spark, d))


@query(
    "turn_violations",
    f"SELECT * FROM (SELECT record_id, len(turns)::INT AS turns, len(list_filter(range(len(turns)), lambda i: turns[i + 1].role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) > 0 AS broken FROM {DAMAGED} WHERE len(turns) > 0) WHERE broken OR turns < 2",
)
def _(spark, d):
    return D.turn_violations(damaged(spark, d))


@query("turn_statistics", f"SELECT t.role AS role, count(*) AS turns, count(DISTINCT record_id) AS records, sum(length(t.text))::BIGINT AS chars FROM (SELECT DISTINCT record_id, unnest(turns) AS t FROM {RECORDS}) GROUP BY t.role")
def _(spark, d):
    return D.turn_statistics(records(spark, d))


@query(
    "quality_sample",
    f"""SELECT record_id, subset, split, CASE right(record_id, 1) WHEN '1' THEN 'accepted' WHEN '2' THEN 'rejected' ELSE 'pending_review' END AS review_status, CASE right(record_id, 1) WHEN '2' THEN 'see ' || record_id END AS notes
     FROM (SELECT record_id, subset, split, row_number() OVER (PARTITION BY subset ORDER BY record_id) AS n FROM {RECORDS}) WHERE n <= 20 AND split IS NOT NULL""",
)
def _(spark, d):
    """Twenty a subset, with the reviews of a review file: those ending in 1 accepted (after a first rejection), in 2 rejected, in 3 of an unknown status."""
    k = F.substring("record_id", -1, 1)
    status = F.when(k == "1", "accepted").when(k == "2", "rejected").when(k == "3", "postponed")
    rows = records(spark, d).select("record_id", status.alias("review_status"), F.when(k == "2", F.concat(F.lit("see "), F.col("record_id"))).otherwise("").alias("notes")).filter("review_status is not null")
    early = rows.filter("review_status = 'accepted'").withColumn("review_status", F.lit("rejected"))
    path = _fresh(spark)
    S.write_objects(early.unionByName(rows).coalesce(1), path, "samples")
    return D.quality_sample(records(spark, d), 20, S.reviews(spark, path))


@query("record_checksums")
def _(spark, d):
    return D.checksums(records(spark, d), ["record_id", "subset", "family_id", "document_ids", "source_texts", "split"])


ISSUES = f"""(WITH ev AS (SELECT record_id, ordinal, CASE WHEN s IS NULL THEN 'unknown_document' WHEN NOT contains(s, e.text) THEN 'quote_missing' WHEN e.start_char IS NOT NULL AND e.end_char IS NOT NULL AND substr(s, e.start_char + 1, e.end_char - e.start_char) <> e.text THEN 'offsets_differ' END AS f FROM (SELECT *, source_texts[e.document_id] AS s FROM {EVIDENCE.replace(RECORDS, DAMAGED)})),
    d AS (SELECT *, document_type, ranking_reason FROM {DAMAGED} JOIN (SELECT DISTINCT record_id, document_type, ranking_reason FROM dataset_record) USING (record_id)), twice AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE right(record_id, 2) = '11')
    SELECT 'evidence' AS code FROM ev WHERE f IS NOT NULL
    UNION ALL SELECT 'record_id' FROM (SELECT record_id FROM twice GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'family_split_leakage' FROM (SELECT family_id FROM twice WHERE family_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT coalesce(split, 'unassigned')) > 1)
    UNION ALL SELECT 'document_family_leakage' FROM (SELECT x FROM (SELECT family_id, unnest(document_ids) AS x FROM twice WHERE family_id IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT family_id) > 1)
    UNION ALL SELECT 'source_texts' FROM d WHERE len(list_filter(document_ids, lambda x: NOT list_contains(map_keys(source_texts), x))) > 0 OR len(list_filter(map_keys(source_texts), lambda x: NOT list_contains(document_ids, x))) > 0
    UNION ALL SELECT 'turns' FROM d WHERE len(turns) > 0 AND (len(turns) < 2 OR len(list_filter(range(len(turns)), lambda i: turns[i + 1].role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) > 0)
    UNION ALL SELECT 'refusal_status' FROM d WHERE subset = 'refusal_uncertainty' AND answer.status = 'answered'
    UNION ALL SELECT 'preference_rank' FROM d WHERE subset = 'preference_pairs' AND right(record_id, 1) IN ('1', '2')
    UNION ALL SELECT 'document_type' FROM d WHERE subset = 'structured_extraction' AND coalesce(document_type NOT IN ('office', 'retail', 'amendment'), true)
    UNION ALL SELECT 'clause_text' FROM (SELECT record_id, i, map_values(source_texts)[1] AS s, unnest(['a', 'b']) AS c FROM (SELECT *, 1 AS i FROM d WHERE len(map_values(source_texts)) > 0)) WHERE NOT contains(s, CASE WHEN c = 'b' AND right(record_id, 1) = '4' THEN s || '~' ELSE s[:20] END))"""
CODES = ["record_id", "evidence", "source_texts", "turns", "refusal_status", "preference_rank", "document_type", "clause_text", "family_split_leakage", "document_family_leakage", "eligibility"]


def _issues(spark, d):
    """All issues of the records with violations planted: ids ending in 11 delivered twice, reasons taken from 1 and 2, a clause altered at 4."""
    k = F.substring("record_id", -1, 1)
    rows = damaged(spark, d).withColumn("ranking_reason", F.when(~k.isin("1", "2"), F.col("ranking_reason")))
    source = F.element_at(F.map_values("source_texts"), 1)
    made = F.array(F.struct(F.lit("a").alias("clause_id"), F.substring(source, 1, 20).alias("text")), F.struct(F.lit("b").alias("clause_id"), F.when(k == "4", F.concat(source, F.lit("~"))).otherwise(F.substring(source, 1, 20)).alias("text")))
    clauses = rows.filter("size(source_texts) > 0").select("record_id", source.alias("source"), F.explode(made).alias("c")).select("record_id", "source", "c.clause_id", "c.text")
    return D.issues(rows.unionByName(rows.filter("record_id like '%11'")), document_types=["office", "retail", "amendment"], clauses=clauses)


@query("record_issues", f"SELECT code, count(*) AS issues FROM {ISSUES} GROUP BY code")
def _(spark, d):
    return _issues(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("issues"))


@query("check_report", f"SELECT c AS code, count(i.code) = 0 AS passed, count(i.code) AS failures FROM (SELECT unnest({CODES}) AS c) LEFT JOIN {ISSUES} i ON c = i.code GROUP BY c")
def _(spark, d):
    """Every check but eligibility has something to find."""
    return D.check_report(_issues(spark, d), CODES)


RECORD_TEXT = "array_to_string(list_transform(list_sort(map_keys(source_texts)), lambda k: source_texts[k]), chr(10))"


@query(
    "duplicate_issues",
    f"""WITH r AS (SELECT record_id AS document_id, family_id, {RECORD_TEXT} AS normalized_text FROM {RECORDS}), w AS (SELECT document_id, {WORDS % 'normalized_text'} AS w FROM r),
 s AS (SELECT document_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM w),
 e AS (SELECT document_id, len(sh) AS n, hash(unnest(sh)) AS g FROM s), p AS (SELECT a.document_id AS a, b.document_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.document_id < b.document_id GROUP BY ALL HAVING c >= 0.7 * (any_value(a.n) + any_value(b.n) - c) - 1e-9)
 SELECT 'exact_duplicate' AS code, document_id AS record_id, document_id || ' duplicates ' || f AS message FROM (SELECT document_id, min(document_id) OVER (PARTITION BY normalized_text) AS f FROM r) WHERE document_id <> f
 UNION ALL SELECT 'near_duplicate_leakage', b, b || ' in family ' || y.family_id || ' is a near-duplicate of ' || a || ' in family ' || x.family_id FROM p JOIN r x ON x.document_id = a JOIN r y ON y.document_id = b WHERE x.family_id <> y.family_id""",
)
def _(spark, d):
    """Copies and near-copies among all records, with the configured threshold."""
    q = table(spark, d, "dataset_config").select("quality").first().quality
    return D.duplicate_issues(table(spark, d, "dataset_record"), q.near_duplicate_threshold, q.shingle_size)


@query("tokenize_counts", f"SELECT document_id, len({TOKENS % 'normalized_text'})::INT AS tokens, len(list_distinct({TOKENS % 'normalized_text'}))::INT AS distinct_tokens FROM processed_document")
def _(spark, d):
    t = T.tokens(F.col("normalized_text"))
    return docs(spark, d).select("document_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def _questions(spark, d):
    return records(spark, d).filter("answer.question is not null").select("record_id", F.col("answer.question").alias("query"), F.explode("document_ids").alias("document_id"))


QUERY_TOKENS = TOKENS % "q.query"
TOPK = f"""WITH q AS (SELECT record_id, answer.question AS query, unnest(document_ids) AS document_id FROM {RECORDS} WHERE answer.question IS NOT NULL), b AS (SELECT DISTINCT document_id, block_id, text FROM text_block),
 s AS (SELECT q.record_id, q.document_id || ':' || b.block_id AS block_id, b.text, CASE WHEN len({QUERY_TOKENS}) = 0 THEN 0.0::DOUBLE ELSE round(least(1.0, len(list_intersect(list_distinct({QUERY_TOKENS}), list_distinct({TOKENS % 'b.text'}))) / len(list_distinct({QUERY_TOKENS}))
   + 0.25 * len(list_filter(range(1, len({QUERY_TOKENS})), lambda i: contains(lower(b.text), ({QUERY_TOKENS})[i] || ' ' || ({QUERY_TOKENS})[i + 1])))), 9)::DOUBLE END AS score FROM q JOIN b USING (document_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, block_id, text) AS place FROM s QUALIFY place <= 4)"""


def _top_blocks(spark, d):
    q = _questions(spark, d)
    blocks = table(spark, d, "text_block").select("document_id", "block_id", "text").distinct()
    pairs = q.join(blocks, "document_id").select("record_id", F.concat("document_id", F.lit(":"), "block_id").alias("block_id"), "text")
    return R.rank_blocks(pairs, q.select("record_id", "query").distinct(), "record_id")


@query("keyword_topk", TOPK + " SELECT record_id, block_id, score, place::INT AS place FROM k")
def _(spark, d):
    return _top_blocks(spark, d).select("record_id", "block_id", "score", "place")


#: Labelled lines of source texts, and those a question ranks best.
LINES = f"""t AS (SELECT DISTINCT record_id, answer.question AS query, unnest(map_keys(source_texts)) AS document_id, unnest(map_values(source_texts)) AS text FROM {RECORDS}),
 l AS (SELECT record_id, query, document_id, list_filter(string_split({COLLAPSED}, chr(10)), lambda x: x <> '') AS lines FROM t),
 b AS (SELECT record_id, query, document_id, unnest(CASE WHEN len(lines) = 0 THEN [0] ELSE range(1, len(lines) + 1) END) AS i, unnest(CASE WHEN len(lines) = 0 THEN [''] ELSE lines END) AS line FROM l),
 c AS (SELECT record_id, query, document_id, i, document_id || ':' || CASE WHEN i = 0 THEN 'full' ELSE 'block-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0') END AS block_id, '[' || document_id || '] ' || line AS text FROM b)"""
LEAST_SCORE = 0.45


@query(
    "context_retrieval",
    f"""WITH {LINES}, q AS (SELECT * FROM c WHERE query IS NOT NULL), s AS (SELECT q.record_id, q.block_id, q.text, CASE WHEN len({QUERY_TOKENS}) = 0 THEN 0.0::DOUBLE ELSE round(least(1.0, len(list_intersect(list_distinct({QUERY_TOKENS}), list_distinct({TOKENS % 'q.text'}))) / len(list_distinct({QUERY_TOKENS}))
   + 0.25 * len(list_filter(range(1, len({QUERY_TOKENS})), lambda i: contains(lower(q.text), ({QUERY_TOKENS})[i] || ' ' || ({QUERY_TOKENS})[i + 1])))), 9)::DOUBLE END AS score FROM q),
 k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, block_id) AS place FROM s WHERE score >= {LEAST_SCORE} QUALIFY place <= 4),
 g AS (SELECT record_id, string_agg(text, chr(10) ORDER BY place) AS context, count(*) AS blocks FROM k GROUP BY record_id),
 f AS (SELECT record_id, array_to_string(list_transform(list_sort(map_keys(source_texts)), lambda k: '[' || k || ']' || chr(10) || regexp_replace(source_texts[k], '^{B}+|{B}+$', '', 'g')), chr(10) || chr(10)) AS whole FROM {RECORDS} WHERE answer.question IS NOT NULL)
 SELECT record_id, coalesce(blocks, 0) AS blocks, sha256(coalesce(context, whole)) AS sha256 FROM f LEFT JOIN g USING (record_id)""",
)
def _(spark, d):
    """Contexts of the best blocks; where none reaches the least score, the whole text."""
    rows = records(spark, d).filter("answer.question is not null")
    found = R.contexts(rows, rows.select("record_id", F.col("answer.question").alias("query")), "retrieval_assisted", 4, LEAST_SCORE)
    blocks = F.when(F.element_at("block_ids", 1) == "retrieval_fallback", 0).otherwise(F.size("block_ids"))
    return found.select("record_id", blocks.cast("bigint").alias("blocks"), F.sha2("context", 256).alias("sha256"))


@query(
    "context_full",
    f"SELECT record_id, sha256(array_to_string(list_transform(list_sort(map_keys(source_texts)), lambda k: '[' || k || ']' || chr(10) || regexp_replace(source_texts[k], '^{B}+|{B}+$', '', 'g')), chr(10) || chr(10))) AS sha256 FROM {RECORDS}",
)
def _(spark, d):
    q = records(spark, d).select("record_id", F.lit("").alias("query"))
    return R.contexts(records(spark, d), q, "full_document").select("record_id", F.sha2("context", 256).alias("sha256"))


@query("context_clause_level", f"WITH {LINES} SELECT record_id, count(*)::INT AS blocks, sha256(string_agg(text, chr(10) ORDER BY document_id, i)) AS sha256 FROM c GROUP BY record_id")
def _(spark, d):
    q = records(spark, d).select("record_id", F.coalesce("answer.question", F.lit("")).alias("query"))
    return R.contexts(records(spark, d), q, "clause_level").select("record_id", F.size("block_ids").alias("blocks"), F.sha2("context", 256).alias("sha256"))


@query("json_payload", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE try_cast(props AS JSON) IS NOT NULL")
def _(spark, d):
    found = T.json_object(F.col("props"))
    return table(spark, d, "events").withColumn("j", found).filter("j is not null").select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"))


@query(
    "code_scores",
    f"""WITH r AS (SELECT document_id, list_filter([CASE WHEN contains({REDACTED}, '[REDACTED_EMAIL]') THEN 'email' END, CASE WHEN contains({REDACTED}, '[REDACTED_PHONE]') THEN 'phone' END, CASE WHEN contains({REDACTED}, '[REDACTED_SSN]') THEN 'ssn' END], lambda x: x IS NOT NULL) AS g, list_distinct(redaction_codes) AS p FROM processed_document),
    n AS (SELECT document_id, len(p) AS np, len(g) AS ng, len(list_intersect(p, g)) AS h FROM r)
    SELECT document_id, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0::DOUBLE WHEN np = 0 THEN 0.0::DOUBLE ELSE h / np END, 9) AS precision, round(CASE WHEN ng = 0 THEN 1.0::DOUBLE ELSE h / ng END, 9) AS recall, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0::DOUBLE WHEN h = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * h / (np + ng) END, 9) AS f1 FROM n""",
)
def _(spark, d):
    """Stored codes of the earlier run against those found now, per document."""
    p, r, f = M.set_scores(F.col("redaction_codes"), T.redaction_codes(F.col("normalized_text")))
    return docs(spark, d).select("document_id", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1"))


def _ranking(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("relevant"))


CURVE = """WITH c AS (SELECT l_suppkey, place, tp / place AS precision, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE tp / total END AS recall FROM (SELECT l_suppkey, row_number() OVER w AS place, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS total FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)))"""


def _curve(spark, d):
    return M.pr_curve(_ranking(spark, d), "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])


@query("pr_curve", CURVE + " SELECT l_suppkey, place::INT AS place, round(precision, 9) AS precision, round(recall, 9) AS recall FROM c")
def _(spark, d):
    return _curve(spark, d).select("l_suppkey", "place", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "area_under_curve",
    CURVE + " SELECT l_suppkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(sum(step), 0.0::DOUBLE))), 6) AS aupr FROM (SELECT l_suppkey, (recall - lag(recall) OVER w) * (precision + lag(precision) OVER w) / 2 AS step FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY recall, precision)) GROUP BY l_suppkey",
)
def _(spark, d):
    return M.area_under(_curve(spark, d), "l_suppkey").withColumn("aupr", F.round("aupr", 6))


@query("precision_at_recall", CURVE + " SELECT l_suppkey, round(coalesce(max(precision) FILTER (WHERE recall >= 0.8), 0.0), 9) AS precision FROM c GROUP BY l_suppkey")
def _(spark, d):
    return M.precision_at_recall(_curve(spark, d), "l_suppkey", 0.8)


def _spans(spark, d, flag):
    return table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select("l_suppkey", (F.col("l_partkey") * 7 % 1000).alias("start"), (F.col("l_partkey") * 7 % 1000 + F.col("l_quantity").cast("bigint")).alias("end"))


def _merged(flag: str) -> str:
    return f"""SELECT l_suppkey, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY l_suppkey ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS f
      FROM (SELECT DISTINCT l_suppkey, l_partkey * 7 % 1000 AS s, l_partkey * 7 % 1000 + l_quantity::BIGINT AS e FROM lineitem WHERE l_returnflag = '{flag}' AND l_quantity::BIGINT > 0))) GROUP BY l_suppkey, i"""


@query("span_merge", f'SELECT l_suppkey, s AS start, e AS "end" FROM ({_merged("R")})')
def _(spark, d):
    return M.merge_spans(_spans(spark, d, "R"), "l_suppkey")


@query(
    "span_coverage",
    f"""WITH a AS ({_merged("R")}), b AS ({_merged("A")}), x AS (SELECT coalesce(p.l_suppkey, r.l_suppkey) AS l_suppkey, coalesce(p.n, 0)::BIGINT AS predicted, coalesce(r.n, 0)::BIGINT AS reference FROM (SELECT l_suppkey, sum(e - s) AS n FROM a GROUP BY 1) p FULL JOIN (SELECT l_suppkey, sum(e - s) AS n FROM b GROUP BY 1) r USING (l_suppkey)),
    o AS (SELECT a.l_suppkey, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS overlap FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.s < b.e AND b.s < a.e GROUP BY 1)
    SELECT x.l_suppkey, coalesce(overlap, 0) AS overlap, predicted, reference, round(CASE WHEN predicted = 0 AND reference = 0 THEN 1.0::DOUBLE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE coalesce(overlap, 0) / predicted END, 9) AS precision, round(CASE WHEN reference = 0 THEN 1.0::DOUBLE ELSE coalesce(overlap, 0) / reference END, 9) AS recall FROM x LEFT JOIN o USING (l_suppkey)""",
)
def _(spark, d):
    return M.span_coverage(_spans(spark, d, "R"), _spans(spark, d, "A"), "l_suppkey")


def _predictions(spark, d):
    """Line items as predictions of runs, one run per supplier."""
    x = table(spark, d, "lineitem")
    parsed, valid, correct, evidence = F.col("l_discount") > 0.005, F.col("l_tax") > 0.005, F.col("l_returnflag") == "R", F.col("l_linenumber") > 2
    mode = F.when(F.col("l_linenumber") % 2 == 0, "direct").otherwise("schema")
    return x.select(
        F.col("l_suppkey").alias("run_id"),
        F.when(F.col("l_linenumber") == 1, "structured_extraction").when(F.col("l_linenumber") == 2, "evidence_conversation").otherwise("refusal_uncertainty").alias("subset"),
        valid.alias("schema_valid"),
        (F.col("l_quantity") / 50).alias("content_score"),
        evidence.alias("evidence"),
        X.error_class(mode, parsed, valid, correct, evidence).alias("error_class"),
        F.col("l_quantity").cast("bigint").alias("completion_tokens"),
        F.col("l_tax").alias("latency_seconds"),
        F.col("l_extendedprice").alias("peak_vram_mb"),
        F.col("l_orderkey").alias("ordinal"),
        ((F.col("l_orderkey") % 997 == 0) & (F.col("l_linenumber") == 1)).alias("oom"),
    )


PREDICTIONS = """(SELECT l_suppkey AS run_id, CASE l_linenumber WHEN 1 THEN 'structured_extraction' WHEN 2 THEN 'evidence_conversation' ELSE 'refusal_uncertainty' END AS subset, l_tax > 0.005 AS schema_valid, l_quantity / 50 AS content_score, l_linenumber > 2 AS evidence,
  CASE WHEN NOT l_discount > 0.005 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'prompt_error' ELSE 'parse_error' END WHEN NOT l_tax > 0.005 THEN 'validation_error' WHEN l_returnflag = 'R' THEN 'correct' WHEN NOT l_linenumber > 2 THEN 'retrieval_error' ELSE 'model_error' END AS error_class,
  l_quantity::BIGINT AS completion_tokens, l_tax AS latency_seconds, l_extendedprice AS peak_vram_mb, l_orderkey AS ordinal, l_orderkey % 997 = 0 AND l_linenumber = 1 AS oom FROM lineitem)"""


@query("error_taxonomy", f"SELECT run_id, error_class, count(*) AS n FROM {PREDICTIONS} GROUP BY ALL")
def _(spark, d):
    return X.error_counts(_predictions(spark, d))


@query(
    "dominant_error",
    f"SELECT run_id, coalesce(arg_max(error_class, (n, error_class)) FILTER (WHERE error_class <> 'correct'), 'correct') AS dominant_error FROM (SELECT run_id, error_class, count(*) AS n FROM {PREDICTIONS} GROUP BY ALL) GROUP BY run_id",
)
def _(spark, d):
    return X.dominant_error(X.error_counts(_predictions(spark, d)))


METRICS = f"""SELECT run_id, count(*) AS predictions, round(avg(schema_valid::INT::DOUBLE), 6) AS schema_validity, round(coalesce(avg(content_score) FILTER (WHERE subset = 'structured_extraction'), 0), 6) AS extraction_f1,
  round(coalesce(avg((error_class = 'correct')::INT::DOUBLE) FILTER (WHERE subset <> 'structured_extraction'), 0), 6) AS answer_status_accuracy, round(avg(evidence::INT::DOUBLE), 6) AS evidence_recall, max(peak_vram_mb) AS peak_vram_mb, sum(completion_tokens)::BIGINT AS completion_tokens,
  round(CASE WHEN sum(completion_tokens) = 0 OR sum(latency_seconds) = 0 THEN 0.0::DOUBLE ELSE sum(completion_tokens) / sum(latency_seconds) END, 4) AS tokens_per_second FROM {PREDICTIONS} GROUP BY run_id"""


def _metrics(spark, d):
    found = X.run_metrics(_predictions(spark, d))
    return found.select("run_id", "predictions", *(F.round(c, 6).alias(c) for c in ("schema_validity", "extraction_f1", "answer_status_accuracy", "evidence_recall")), "peak_vram_mb", "completion_tokens", F.round("tokens_per_second", 4).alias("tokens_per_second"))


@query("run_metrics", METRICS)
def _(spark, d):
    return _metrics(spark, d)


@query("until_out_of_memory", f"SELECT run_id, count(*) AS predictions FROM (SELECT *, min(ordinal) FILTER (WHERE oom) OVER (PARTITION BY run_id) AS stop FROM {PREDICTIONS}) WHERE stop IS NULL OR ordinal <= stop GROUP BY run_id")
def _(spark, d):
    return X.until_out_of_memory(_predictions(spark, d)).groupBy("run_id").agg(F.count(F.lit(1)).alias("predictions"))


@query(
    "candidate_ranking",
    f"""SELECT run_id AS candidate_id, row_number() OVER (ORDER BY practical DESC, schema_validity DESC, extraction_f1 DESC, answer_status_accuracy DESC, evidence_recall DESC, tokens_per_second DESC, peak_vram_mb, run_id DESC)::INT AS place, practical
     FROM (SELECT *, peak_vram_mb <= 104000 AS practical FROM ({METRICS}))""",
)
def _(spark, d):
    runs = _metrics(spark, d).withColumnRenamed("run_id", "candidate_id").withColumn("practical", F.col("peak_vram_mb") <= 104000)
    return X.rank_candidates(runs).select("candidate_id", "place", "practical")


@query("latest_run", "SELECT o_custkey AS candidate_id, o_orderkey AS ordinal, o_orderdate AS completed_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(spark, d):
    return X.latest_runs(table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("completed_at")))


@query("missing_candidates", "SELECT DISTINCT c_custkey * 2 AS candidate_id FROM customer WHERE c_custkey * 2 NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    """Twice the customers' keys are expected, half of which have no orders."""
    expected = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("candidate_id")).distinct()
    return X.missing_candidates(expected, table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id")))


@query("scored_tasks", f"SELECT record_id, family_id, subset, answer.question AS query, answer.status AS gold_status, coalesce(len(answer.evidence), 0)::INT AS quotes FROM {RECORDS} WHERE {SPLIT} = 'test' AND subset IN ('structured_extraction', 'evidence_conversation', 'refusal_uncertainty')")
def _(spark, d):
    return X.tasks(records(spark, d)).select("record_id", "family_id", "subset", "query", "gold_status", F.greatest(F.coalesce(F.size("quotes"), F.lit(0)), F.lit(0)).alias("quotes"))


@query("resume_anti_join", "SELECT document_id FROM source_entry WHERE document_id NOT IN (SELECT document_id FROM pipeline_checkpoint WHERE completed_stage = 'exported' AND document_id IS NOT NULL)")
def _(spark, d):
    return O.unfinished(table(spark, d, "source_entry"), table(spark, d, "pipeline_checkpoint")).select("document_id")


@query("latest_stage", "SELECT document_id, arg_max(completed_stage, (updated_at, logged_at, completed_stage)) AS completed_stage FROM pipeline_checkpoint GROUP BY document_id")
def _(spark, d):
    return O.latest_stage(table(spark, d, "pipeline_checkpoint"))


@query("stage_counts", "SELECT completed_stage, count(DISTINCT document_id) AS documents FROM pipeline_checkpoint GROUP BY completed_stage")
def _(spark, d):
    return table(spark, d, "pipeline_checkpoint").groupBy("completed_stage").agg(F.countDistinct("document_id").alias("documents"))


@query(
    "family_groups",
    "SELECT family_id, array_to_string(list_sort(list(DISTINCT document_id)), ',') AS document_ids FROM (SELECT family_id, document_id FROM source_entry UNION ALL SELECT family_id, unnest(related_document_ids) FROM source_entry) WHERE family_id IS NOT NULL AND document_id IS NOT NULL GROUP BY family_id",
)
def _(spark, d):
    return O.family_groups(table(spark, d, "source_entry")).select("family_id", F.array_join("document_ids", ",").alias("document_ids"))


@query("media_type_sniff", "SELECT document_id, CASE WHEN regexp_matches(lower(local_path), '\\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(lower(local_path), '\\.txt$') THEN 'text' WHEN regexp_matches(lower(local_path), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(local_path), '\\.docx$') THEN 'docx' END AS sniffed, media_type FROM source_entry")
def _(spark, d):
    return table(spark, d, "source_entry").select("document_id", T.media_type(F.col("local_path")).alias("sniffed"), "media_type")


@query("manifest_urls", "SELECT source_name, count(*) AS entries, count(source_url) AS with_url, count(*) FILTER (WHERE NOT starts_with(source_url, 'https://')) AS insecure FROM source_entry GROUP BY source_name")
def _(spark, d):
    return table(spark, d, "source_entry").groupBy("source_name").agg(F.count(F.lit(1)).alias("entries"), F.count("source_url").alias("with_url"), F.count_if(~F.startswith("source_url", F.lit("https://"))).alias("insecure"))


ENTRIES = """(SELECT document_id, CASE k WHEN '0' THEN 'http://example.org/a' ELSE source_url END AS source_url, CASE k WHEN '1' THEN 'open_license' WHEN '2' THEN 'review_required' ELSE rights_status END AS rights_status,
  CASE k WHEN '1' THEN NULL ELSE source_license END AS source_license, CASE k WHEN '2' THEN NULL ELSE rights_notes END AS rights_notes FROM (SELECT *, right(document_id, 1) AS k FROM (SELECT * FROM source_entry UNION ALL SELECT * FROM source_entry WHERE right(document_id, 1) = '3')))"""


@query(
    "manifest_violations",
    f"""SELECT DISTINCT document_id, failure FROM (SELECT document_id, 'insecure_url' AS failure FROM {ENTRIES} WHERE NOT starts_with(source_url, 'https://') UNION ALL SELECT document_id, 'licence_unnamed' FROM {ENTRIES} WHERE rights_status = 'open_license' AND source_license IS NULL
     UNION ALL SELECT document_id, 'review_without_notes' FROM {ENTRIES} WHERE rights_status = 'review_required' AND rights_notes IS NULL UNION ALL SELECT document_id, 'id_repeated' FROM {ENTRIES} GROUP BY document_id HAVING count(*) > 1)""",
)
def _(spark, d):
    """Entries with violations planted by the last digit of the id."""
    k = F.substring("document_id", -1, 1)
    entries = table(spark, d, "source_entry")
    entries = entries.unionByName(entries.filter(k == "3")).withColumns(
        {"source_url": F.when(k == "0", "http://example.org/a").otherwise(F.col("source_url")), "rights_status": F.when(k == "1", "open_license").when(k == "2", "review_required").otherwise(F.col("rights_status")), "source_license": F.when(k != "1", F.col("source_license")), "rights_notes": F.when(k != "2", F.col("rights_notes"))}
    )
    return S.violations(entries)


@query("patched_duplicates", "SELECT s.document_id, s.family_id, p.duplicate_of, len(p.near_duplicate_of)::INT AS near FROM source_entry s JOIN processed_document p USING (document_id)")
def _(spark, d):
    """Duplicate fields of the processed documents beside their manifest rows."""
    return table(spark, d, "source_entry").select("document_id", "family_id").join(docs(spark, d).select("document_id", "duplicate_of", F.size("near_duplicate_of").alias("near")), "document_id")


@query("answered_without_evidence", f"SELECT record_id FROM {DAMAGED} WHERE answer.status = 'answered' AND coalesce(len(answer.evidence), 0) = 0")
def _(spark, d):
    return damaged(spark, d).filter((F.col("answer.status") == "answered") & (F.coalesce(F.size("answer.evidence"), F.lit(0)) == 0)).select("record_id")


_VALID = "answer.status IN ('answered', 'insufficient_evidence', 'conflicting_evidence', 'unreadable_source') AND answer.confidence BETWEEN 0 AND 1 AND answer.explanation IS NOT NULL AND (answer.status <> 'answered' OR len(answer.evidence) > 0)"


@query(
    "scripted_run",
    f"""SELECT record_id, subset, CASE WHEN answer.confidence < 0.2 THEN 'parse_error' WHEN NOT ({_VALID}) THEN 'validation_error' ELSE 'correct' END AS error_class,
     len(list_filter(answer.evidence, lambda e: e.text <> '' AND NOT contains(array_to_string(list_transform(map_values(source_texts), lambda t: t), chr(10)), e.text))) = 0 AS evidence
     FROM {RECORDS} WHERE {SPLIT} = 'test' AND subset IN ('evidence_conversation', 'refusal_uncertainty') AND answer IS NOT NULL""",
)
def _(spark, d):
    """A run whose generator repeats the stored answer, or prose where its confidence is low."""
    rows = records(spark, d).filter("answer is not null")
    outputs = rows.select("record_id", F.when(F.col("answer.confidence") < 0.2, "no object here").otherwise(F.concat(F.lit("Here it is: "), F.to_json("answer"))).alias("output"))
    found = B2.predict(rows, B2.scripted(outputs), "Record ID: {record_id}\n{question}\n\n{context}")
    return found.select("record_id", "subset", "error_class", "evidence")


def _fresh(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/made-{uuid.uuid4().hex}"


@query("manifest_scan", "SELECT document_id, family_id, document_type, local_path, media_type, rights_status, len(related_document_ids)::INT AS related, retrieved_at::VARCHAR AS retrieved_at, is_template FROM source_entry")
def _(spark, d):
    """The entries written as JSON manifests and scanned again."""
    path = _fresh(spark)
    S.write_objects(table(spark, d, "source_entry"), path, "sources")
    return S.manifest(spark, path).select("document_id", "family_id", "document_type", "local_path", "media_type", "rights_status", F.size("related_document_ids").alias("related"), F.col("retrieved_at").cast("string").alias("retrieved_at"), "is_template")


@query("record_scan", f"SELECT record_id, subset, family_id, len(document_ids)::INT AS documents, answer.status AS status, len(turns)::INT AS turns FROM {RECORDS} WHERE subset IN ('evidence_conversation', 'multi_turn', 'refusal_uncertainty')")
def _(spark, d):
    """The records written as JSON files, scanned and selected by subset."""
    path = _fresh(spark)
    S.write_objects(records(spark, d), path)
    # The text writer's suffix is not that of records.
    found = S.records(spark, _renamed(spark, path, ".json"))
    chosen = S.subset_records(found, "evidence_conversation").unionByName(S.subset_records(found, "multi_turn")).unionByName(S.subset_records(found, "refusal_uncertainty"))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return chosen.select("record_id", "subset", "family_id", count("document_ids").alias("documents"), F.col("answer.status").alias("status"), count("turns").alias("turns"))


def _renamed(spark: SparkSession, path: str, suffix: str) -> str:
    """Gives the part files of a folder another suffix."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    system = root.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    for f in system.listStatus(root):
        if f.getPath().getName().startswith("part-"):
            system.rename(f.getPath(), jvm.Path(root, f.getPath().getName().rsplit(".", 1)[0] + suffix))
    return path


@query("checkpoint_scan", "SELECT document_id, CASE WHEN count(DISTINCT completed_stage) > 1 THEN max(completed_stage) ELSE min(completed_stage) END AS completed_stage FROM pipeline_checkpoint WHERE document_id IS NOT NULL AND completed_stage IS NOT NULL GROUP BY document_id")
def _(spark, d):
    """A log appended to twice: what a later batch says of a document counts, whatever the files are like."""
    stages = table(spark, d, "pipeline_checkpoint").filter("document_id is not null and completed_stage is not null").groupBy("document_id").agg(F.min("completed_stage").alias("first"), F.max("completed_stage").alias("last"))
    path = _fresh(spark)
    S.append_rows(stages.select("document_id", F.col("first").alias("completed_stage"), F.repeat(F.lit("long "), F.lit(50)).alias("note")), path)
    S.append_rows(stages.filter("first <> last").select("document_id", F.col("last").alias("completed_stage")), path)
    return S.checkpoint_rows(spark, path, "document_id").select("document_id", F.get_json_object("line", "$.completed_stage").alias("completed_stage"))


@query("training_id_scan", f"SELECT DISTINCT x AS document_id FROM (SELECT unnest(document_ids) AS x FROM {RECORDS}) WHERE x NOT IN {BLOCKED}")
def _(spark, d):
    """Ids written as lines with blanks around them and empty lines between, scanned, without the blocked ones."""
    path = _fresh(spark)
    records(spark, d).select(F.explode("document_ids").alias("x")).distinct().select(F.concat(F.lit("  "), "x", F.lit(" \n"))).write.text(path)
    blocked = table(spark, d, "dataset_config").select(F.explode("exclusion.blocked_from_training_document_ids").alias("document_id"))
    return S.id_list(spark, path).join(blocked, "document_id", "left_anti").distinct()


def _files(spark, d) -> tuple[DataFrame, str]:
    """Texts as files below ``document_id/lease.txt`` and their manifest, with faults planted by the last digit of the id."""
    folder = f"{_fresh(spark)}/raw"
    k = F.substring("document_id", -1, 1)
    body = F.when(k == "0", F.lit("")).when(k == "1", F.concat(F.lit("%PDF-1.4 "), "normalized_text")).otherwise(F.col("normalized_text"))
    rows = docs(spark, d).filter("normalized_text is not null").select("document_id", body.alias("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = []
            for document, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8")
                shas.append(hashlib.sha256(data).hexdigest())
                if document[-1] != "2":
                    system, inner = S.system_of(f"{folder}/{document}/lease.txt")
                    system.create_dir(inner.rsplit("/", 1)[0])
                    with system.open_output_stream(inner) as f:
                        f.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string())], names=["document_id", "sha256"])

    made = cut(rows.mapInArrow(write, "document_id string, sha256 string"))
    sha = F.when(k == "3", F.sha2("document_id", 256)).otherwise(F.col("sha256"))
    return made.select("document_id", F.lit("raw/lease.txt").alias("local_path"), F.lit("text").alias("media_type"), sha.alias("sha256")), folder


ACQUIRED = "CASE right(document_id, 1) WHEN '0' THEN 'file_empty' WHEN '2' THEN 'file_ambiguous' WHEN '1' THEN 'media_type_differs' WHEN '3' THEN 'checksum_differs' END"


@query("file_acquisition", f"SELECT document_id, CASE WHEN right(document_id, 1) = '2' THEN NULL WHEN right(document_id, 1) = '0' THEN NULL WHEN right(document_id, 1) = '1' THEN sha256('%PDF-1.4 ' || normalized_text) ELSE sha256(normalized_text) END AS sha256, {ACQUIRED} AS error FROM processed_document WHERE normalized_text IS NOT NULL")
def _(spark, d):
    """Files of one name, each in the folder of its document, and what is wrong with them (one that has none there could be any of the others)."""
    manifest, folder = _files(spark, d)
    found = Y.acquire(manifest, Y.scan(spark, folder), ["text", "markdown"], 20 * 1024 * 1024)
    return found.select("document_id", F.col("found_sha256").alias("sha256"), "error")


@query("file_pages", f"SELECT document_id, CASE WHEN e IS NULL THEN 1 END AS page_number, CASE WHEN e IS NULL THEN sha256(normalized_text) END AS sha256, e AS error FROM (SELECT *, {ACQUIRED} AS e FROM processed_document WHERE normalized_text IS NOT NULL)")
def _(spark, d):
    """The text reader behind acquisition: one page a good file, one row with the error of any other."""
    manifest, folder = _files(spark, d)
    pages = Y.pages(Y.acquire(manifest, Y.scan(spark, folder), ["text", "markdown"], 20 * 1024 * 1024))
    return pages.select("document_id", "page_number", F.sha2("text", 256).alias("sha256"), "error")


@query("bundle_export", f"SELECT subset, split, count(*) AS records, count(DISTINCT family_id) AS families FROM (SELECT record_id, subset, family_id, {SPLIT} AS split FROM {RECORDS}) WHERE split IS NOT NULL GROUP BY subset, split")
def _(spark, d):
    """The bundle written by subset and split, and read again; with an issue nothing would be written."""
    path = _fresh(spark)
    rows = records(spark, d).withColumn("split", T.normalize_split(F.col("split"))).filter("split is not null").select("record_id", "subset", "family_id", "split")
    D.write_bundle(rows, path, D.issues(damaged(spark, d)).filter("false"))
    return spark.read.parquet(path).groupBy("subset", "split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("family_id").alias("families"))


@query("candidate_matrix", "SELECT r_regionkey AS comparison_id, n_nationkey AS candidate_id FROM region JOIN nation ON n_nationkey % 5 <= r_regionkey WHERE n_nationkey < 20")
def _(spark, d):
    """Nations as candidates (the last five unknown), regions as comparisons."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("candidate_id"))
    named = table(spark, d, "region").join(nations, F.col("candidate_id") % 5 <= F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("comparison_id")).agg(F.collect_list("candidate_id").alias("candidate_ids"))
    return X.matrix(nations.filter("candidate_id < 20"), named).select("comparison_id", "candidate_id")


@query("registry_violations", "SELECT n_nationkey::VARCHAR AS subject, 'candidate_repeated' AS failure FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT r_regionkey::VARCHAR, 'candidate_unknown' FROM region WHERE r_regionkey > 2")
def _(spark, d):
    """Nations divisible by 7 listed twice; comparisons above 2 name a candidate nobody knows."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("candidate_id"))
    named = table(spark, d, "region").select(F.col("r_regionkey").alias("comparison_id"), F.array(F.lit(1), F.when(F.col("r_regionkey") > 2, 999).otherwise(2)).alias("candidate_ids"))
    return V.registry_violations(nations.unionByName(nations.filter("candidate_id % 7 = 0")), named)


@query("clause_page_violations", "SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'pages_unpaired' ELSE 'pages_reversed' END AS failure FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity::INT END AS a, CASE WHEN l_linenumber <> 4 THEN (l_suppkey % 50)::INT END AS b FROM lineitem) WHERE (a IS NULL) <> (b IS NULL) OR b < a")
def _(spark, d):
    """Line items as clauses: the third without a first page, the fourth without a last."""
    x = table(spark, d, "lineitem")
    rows = x.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("int")).alias("page_start"), F.when(F.col("l_linenumber") != 4, (F.col("l_suppkey") % 50).cast("int")).alias("page_end"))
    return V.clause_page_violations(rows, ["l_orderkey", "l_linenumber"])


@query(
    "obligation_violations",
    """SELECT o_orderkey, CASE WHEN (t = 'fixed_date' AND o_orderkey % 3 = 0) OR (t = 'recurring' AND o_orderkey % 5 = 0) OR t = 'event_based' THEN 'timing_detail_missing' ELSE 'timing_unpaired' END AS failure
     FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fixed_date' WHEN 1 THEN 'recurring' WHEN 2 THEN 'event_based' ELSE 'unstated' END AS t FROM orders)
     WHERE (t = 'fixed_date' AND o_orderkey % 3 = 0) OR (t = 'recurring' AND o_orderkey % 5 = 0) OR t = 'event_based' OR o_orderkey % 11 = 0""",
)
def _(spark, d):
    """Orders as obligations of four timings, some without their detail, some with a value but no unit."""
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(n % 4 == 0, "fixed_date").when(n % 4 == 1, "recurring").when(n % 4 == 2, "event_based").otherwise("unstated").alias("timing_type"),
        F.when(n % 3 != 0, F.col("o_orderdate")).alias("due_date"), F.lit(None).cast("string").alias("relative_deadline"), F.when(n % 5 != 0, "monthly").alias("recurrence"), F.lit(None).cast("string").alias("trigger"),
        F.lit(1).alias("timing_value"), F.when(n % 11 != 0, "days").alias("timing_unit"),
    )
    return V.obligation_violations(rows, ["o_orderkey"])


@query("extraction_identity", f"SELECT record_id, CASE WHEN k IN ('1', '2') THEN 'document_not_listed' ELSE 'family_differs' END AS failure FROM (SELECT *, right(record_id, 1) AS k FROM {RECORDS} WHERE subset = 'structured_extraction' AND len(document_ids) > 0) WHERE k IN ('1', '2') OR (k = '3' AND family_id IS NOT NULL)")
def _(spark, d):
    k = F.substring("record_id", -1, 1)
    rows = records(spark, d).filter("subset = 'structured_extraction' and size(document_ids) > 0")
    rows = rows.withColumn("extraction_document_id", F.when(k.isin("1", "2"), "elsewhere").otherwise(F.element_at("document_ids", 1))).withColumn("extraction_family_id", F.when(k == "3", F.concat("family_id", F.lit("x"))).otherwise(F.col("family_id")))
    return V.extraction_identity_violations(rows)


@query(
    "preference_violations",
    f"""SELECT record_id, CASE WHEN k = '1' THEN 'preferred_invented' WHEN k = '2' THEN 'responses_equal' ELSE 'reason_missing' END AS failure FROM (SELECT r.*, q.reason, right(r.record_id, 1) AS k FROM {RECORDS} r JOIN (SELECT DISTINCT record_id, coalesce(ranking_reason, '') AS reason FROM dataset_record) q USING (record_id) WHERE subset = 'preference_pairs')
     WHERE k IN ('1', '2', '3') OR length(regexp_replace(reason, '^{B}+|{B}+$', '', 'g')) < 8""",
)
def _(spark, d):
    k = F.substring("record_id", -1, 1)
    rows = records(spark, d).filter("subset = 'preference_pairs'").select("record_id", F.lit("a").alias("preferred_text"), (k == "1").alias("preferred_invented"), F.when(k == "2", "a").otherwise("b").alias("rejected_text"), F.when(k == "3", " short ").otherwise(F.col("ranking_reason")).alias("ranking_reason"))
    return V.preference_violations(rows)


@query("config_violations", "SELECT 'percents_do_not_sum' AS failure UNION ALL SELECT 'blocked_ids_repeated' UNION ALL SELECT 'subsets_incomplete'")
def _(spark, d):
    """The configuration with a percentage, a blocked id and the subsets changed."""
    blocked = F.col("exclusion.blocked_from_training_document_ids")
    c = table(spark, d, "dataset_config").select(F.col("splits").withField("test_percent", F.col("splits.test_percent") + 1).alias("splits"), F.col("exclusion").withField("blocked_from_training_document_ids", F.concat(blocked, F.slice(blocked, 1, 1))).alias("exclusion"), F.array(F.lit("multi_turn")).alias("subsets"))
    return V.config_violations(c, S.SUBSETS)


@query("purpose_violations", f"SELECT record_id, subset FROM {RECORDS} WHERE {SPLIT} = 'test' AND subset = 'preference_pairs' OR ({SPLIT} = 'test' AND subset = 'raw_domain_text')")
def _(spark, d):
    """Records of the test split that are used to train on."""
    purpose = F.when(F.col("subset") == "preference_pairs", "preference-data").when(F.col("subset") == "raw_domain_text", "continued-pretraining").otherwise("reporting")
    return V.purpose_violations(records(spark, d).select("record_id", "subset", "split", purpose.alias("purpose"))).select("record_id", "subset")


@query(
    "eval_split_violations",
    """WITH f AS (SELECT family_id, (('0x' || substr(sha256(c.splits.salt || ':' || family_id), 1, 8))::BIGINT % 100) AS b, c.splits AS s FROM (SELECT DISTINCT family_id FROM dataset_record WHERE family_id IS NOT NULL), dataset_config c)
     SELECT 'pin' AS subject, 'version_differs' AS failure UNION ALL SELECT 'elsewhere', 'not_blocked' UNION ALL SELECT family_id, 'split_differs' FROM f WHERE b >= s.train_percent""",
)
def _(spark, d):
    """A pin of another version with an unknown blocked id, and all families frozen as train."""
    config = table(spark, d, "dataset_config")
    pin = config.select("splits.salt", "splits.method", F.lit("0.9").alias("dataset_version"), F.array_append("exclusion.blocked_from_training_document_ids", F.lit("elsewhere")).alias("blocked_from_training_document_ids"))
    families = table(spark, d, "dataset_record").filter("family_id is not null").select("family_id", F.lit("train").alias("split")).distinct()
    return V.eval_split_violations(families, pin, config)


@query(
    "run_binding",
    "SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 5 > 3 THEN 'benchmark_unknown' WHEN o_orderkey % 7 = 0 THEN 'dataset_revision_differs' WHEN o_orderkey % 11 = 0 THEN 'evaluator_revision_differs' WHEN o_orderkey % 13 = 0 THEN 'evaluator_unofficial' ELSE 'metrics_unofficial' END AS failure FROM orders WHERE o_custkey % 5 > 3 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0",
)
def _(spark, d):
    """Orders as runs of benchmarks (regions), bound to the pins of the registry."""
    n = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(n.alias("run_id"), (F.col("o_custkey") % 5).alias("benchmark_id"), F.when(n % 7 == 0, "x").otherwise("r1").alias("repository_revision"), F.when(n % 11 == 0, "x").otherwise("e1").alias("evaluator_revision"), (n % 13 != 0).alias("used_official_evaluator"), F.array(F.struct((n % 17 != 0).alias("official"))).alias("metrics"))
    specs = table(spark, d, "region").filter("r_regionkey <= 3").select(F.col("r_regionkey").alias("benchmark_id"), F.lit("r1").alias("repository_revision"), F.lit("e1").alias("evaluator_revision"))
    return V.run_binding_violations(runs, specs)


@query("run_violations", "SELECT o_orderkey AS run_id, unnest(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'ends_before_start' END, CASE WHEN o_orderkey % 11 = 0 THEN 'metric_repeated' END, CASE WHEN o_custkey = o_orderkey % 1000 THEN 'record_repeated' END], lambda x: x IS NOT NULL)) AS failure FROM orders")
def _(spark, d):
    n = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(n.alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(n % 7 == 0, F.expr("o_orderdate - interval 1 day")).otherwise(F.col("o_orderdate")).alias("completed_at"), F.when(n % 11 == 0, F.array(F.lit("f1"), F.lit("f1"))).otherwise(F.array(F.lit("f1"))).alias("metric_names"), F.array(F.col("o_custkey"), n % 1000).alias("record_ids"))
    return V.run_violations(runs)


@query("headline_violations", "SELECT o_orderkey AS report_id FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return V.headline_violations(table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), (F.col("o_orderstatus") == "F").alias("is_professional_benchmark"), F.lit(False).alias("headline_claim_allowed")))


def _extractions(spark, d):
    """Orders as extractions: the gold one of their columns, the predicted one with parts left out or changed."""
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    span = lambda text: F.array(F.struct(text.alias("text")))

    def made(predicted: bool):
        role = F.when(F.lit(predicted) & (n % 3 == 0), "owner").otherwise("tenant")
        amount = F.when(F.lit(predicted) & (n % 5 == 0), F.lit(None)).otherwise(F.col("o_totalprice").cast("bigint"))
        clauses = F.array(F.struct(F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("clause_types")))
        if predicted:
            clauses = F.when(n % 7 == 0, F.slice(clauses, 1, 0)).otherwise(clauses)
        return F.struct(
            F.array(F.struct(role.alias("role"), F.concat(F.lit("c"), F.col("o_custkey")).alias("name"), span(F.col("o_orderstatus")).alias("evidence"))).alias("parties"),
            F.array(F.struct(F.col("o_orderstatus").alias("description"), span(F.col("o_orderpriority")).alias("evidence"))).alias("premises"),
            clauses.alias("clauses"),
            F.array(F.struct(amount.alias("amount"), F.lit("USD").alias("currency"), span(F.lit("price")).alias("evidence"))).alias("monetary_terms"),
            F.array(F.struct(day.alias("normalized_date"), span(day.cast("string")).alias("evidence"))).alias("date_terms"),
            F.array(F.struct(F.lit("tenant").alias("responsible_party"), F.col("o_orderpriority").alias("action"), span(F.lit("pay")).alias("evidence"))).alias("obligations"),
        )

    return table(spark, d, "orders").select("o_orderkey", made(True).alias("predicted"), made(False).alias("gold"))


def _labels(predicted: bool) -> str:
    role = "CASE WHEN o_orderkey % 3 = 0 THEN 'owner' ELSE 'tenant' END" if predicted else "'tenant'"
    clauses = "CASE WHEN o_orderkey % 7 = 0 THEN [] ELSE ['clause:' || o_orderpriority, 'clause:' || o_orderstatus] END" if predicted else "['clause:' || o_orderpriority, 'clause:' || o_orderstatus]"
    money = "CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['money:' || trunc(o_totalprice)::BIGINT || ':USD'] END" if predicted else "['money:' || trunc(o_totalprice)::BIGINT || ':USD']"
    return f"list_distinct(['party:' || {role} || ':c' || o_custkey, 'premises:' || o_orderstatus, 'date:' || strftime(o_orderdate, '%Y-%m-%d'), 'obligation:tenant:' || o_orderpriority] || {clauses} || {money})"


@query(
    "extraction_scores",
    f"SELECT o_orderkey, len(p)::INT AS labels, round(CASE WHEN len(list_intersect(p, g)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END, 9) AS f1, len(list_intersect(p, g)) = len(p) AND len(p) = len(g) AS correct FROM (SELECT o_orderkey, {_labels(True)} AS p, {_labels(False)} AS g FROM orders)",
)
def _(spark, d):
    """Label F1 of extractions, and whether the content is right (F1 of 1)."""
    score = X.extraction_scores(F.col("predicted"), F.col("gold"))
    return _extractions(spark, d).select("o_orderkey", F.size(X.extraction_labels(F.col("predicted"))).alias("labels"), F.round(score, 9).alias("f1"), (score == 1.0).alias("correct"))


@query(
    "quote_recall",
    "SELECT o_orderkey, 6 AS quotes, round(len(list_intersect(list_distinct(q), list_distinct(g))) / len(list_distinct(g)), 9) AS recall FROM (SELECT o_orderkey, [o_orderstatus, o_orderpriority, 'price', strftime(o_orderdate, '%Y-%m-%d'), 'pay', 'more'] AS q, [o_orderstatus, 'price', 'unseen ' || (o_orderkey % 2)] AS g FROM orders)",
)
def _(spark, d):
    """Quotes of all child lists of a prediction against gold quotes."""
    e = F.col("predicted")
    found = F.array_append(D.quotes([e[c] for c in ("parties", "premises", "monetary_terms", "date_terms", "obligations")]), F.lit("more"))
    rows = _extractions(spark, d).select("o_orderkey", found.alias("q"), F.array(F.element_at("gold.premises", 1)["description"], F.lit("price"), F.concat(F.lit("unseen "), F.col("o_orderkey") % 2)).alias("g"))
    return rows.select("o_orderkey", F.size("q").alias("quotes"), F.round(M.set_scores(F.col("q"), F.col("g"))[1], 9).alias("recall"))


def _suite(spark, d):
    """The inputs of the regression suite, of manifest entries and records, with faults planted by the last digit."""
    k = F.substring("document_id", -1, 1)
    entries = table(spark, d, "source_entry").dropDuplicates(["document_id"])
    extractions = entries.select(
        F.concat(F.lit("gold/"), "document_id").alias("path"), (k != "0").alias("valid"), F.when(k == "1", "other").otherwise(F.col("family_id")).alias("expected_family_id"), "document_id", "family_id", "document_type",
        F.when(k == "2", "review_required").when(k == "3", "open_license").otherwise("public_domain").alias("rights_status"), F.lit(None).cast("string").alias("rights_notes"), F.lit(None).cast("string").alias("source_license"), F.when(k == "4", 0).otherwise(1).alias("effects"),
    )
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), F.lit(m).alias("mark")) for n, m in (("party", "5"), ("premises", "6"), ("clause", "7"), ("money", "8"), ("date", "9"), ("obligation", "x"))))
    items = entries.filter(k != "0").select("document_id", F.explode(kinds).alias("i"), k.alias("k"), "document_type").select("document_id", "i.kind", F.concat_ws(":", "i.kind", "document_type").alias("label"), F.when(F.col("k") == F.col("i.mark"), 0).otherwise(1).alias("evidence"))
    r = F.substring("record_id", -1, 1)
    answers = records(spark, d).filter("answer is not null").select("record_id", (r != "0").alias("valid"), F.col("answer.status").alias("status"), F.when(r == "1", "unreadable_source").otherwise(F.col("answer.status")).alias("expected_status"), F.when(r == "2", 0).when(r == "3", 1).otherwise(F.size("answer.evidence")).alias("evidence")).withColumnRenamed("record_id", "path")
    families = O.family_groups(entries.filter(k != "0").withColumn("related_document_ids", F.array().cast("array<string>"))).select("family_id", F.when(F.col("family_id").endswith("7"), F.array_append("document_ids", F.lit("gone"))).otherwise(F.col("document_ids")).alias("member_document_ids"))
    return G.failures(extractions, items, answers, families, entries.filter(k != "5")), items


_E = "(SELECT *, right(document_id, 1) AS k FROM (SELECT DISTINCT ON (document_id) document_id, family_id, document_type FROM source_entry))"
_A = f"(SELECT record_id, right(record_id, 1) AS k, answer.status AS status, len(answer.evidence) AS n FROM {RECORDS} WHERE answer IS NOT NULL)"
SUITE = f"""(SELECT 'schema_validity' AS c, document_id AS s, k AS f FROM {_E} WHERE k = '0' OR (k = '1' AND family_id <> 'other')
 UNION ALL SELECT 'required_evidence', document_id, k FROM {_E} WHERE k IN ('5', '6', '8', '9')
 UNION ALL SELECT 'agreement_family_splits', family_id, '' FROM (SELECT DISTINCT family_id FROM {_E} WHERE k <> '0' AND family_id LIKE '%7')
 UNION ALL SELECT 'rights_and_training_gates', document_id, k FROM {_E} WHERE k IN ('2', '3')
 UNION ALL SELECT 'grounded_answers_and_abstention', record_id, unnest(CASE WHEN k = '0' THEN ['i'] WHEN k = '1' AND status <> 'unreadable_source' THEN ['d'] WHEN k = '2' AND status = 'answered' THEN ['a'] WHEN k = '3' AND status = 'insufficient_evidence' THEN ['b'] ELSE [] END
   || CASE WHEN k NOT IN ('0', '2') AND status = 'answered' AND k <> '3' AND n = 0 THEN ['a'] ELSE [] END || CASE WHEN k NOT IN ('0', '2', '3') AND status = 'insufficient_evidence' AND n > 0 THEN ['b'] ELSE [] END) FROM {_A}
 UNION ALL SELECT 'amendment_effects', document_id, k FROM {_E} WHERE k = '4' AND document_type = 'amendment'
 UNION ALL SELECT 'evaluation_holdout', document_id, k FROM {_E} WHERE k = '5')"""


@query("regression_checks", f"SELECT c AS \"check\", count(s) = 0 AS passed, count(s) AS failures FROM (SELECT unnest({list(G.CHECKS)}) AS c) LEFT JOIN {SUITE} USING (c) GROUP BY c")
def _(spark, d):
    return G.checks(_suite(spark, d)[0])


@query(
    "regression_metrics",
    f"""SELECT 'check_pass_rate' AS name, round(1 - count(DISTINCT c) / 7, 9) AS value FROM {SUITE} UNION ALL SELECT 'schema_validity', CASE WHEN count(*) > 0 THEN 0.0 ELSE 1.0 END FROM {SUITE} WHERE c = 'schema_validity'
     UNION ALL SELECT n, round(2.0::DOUBLE * h / (h + t), 9) FROM (SELECT count(DISTINCT document_type) FILTER (WHERE k <> '0' AND document_type <> 'retail') AS h, count(DISTINCT document_type) FILTER (WHERE k <> '0') AS t FROM {_E}), (SELECT unnest(['clause_label_f1', 'date_term_f1', 'monetary_term_f1', 'obligation_f1']) AS n)""",
)
def _(spark, d):
    """The labels predicted leave those of retail leases out."""
    found, items = _suite(spark, d)
    return G.metrics(found, items.filter("label not like '%:retail'"), items).withColumn("value", F.round("value", 9))


@query("hypothesis_class", f"WITH m AS ({METRICS}), best AS (SELECT run_id FROM m WHERE peak_vram_mb <= 1000000 ORDER BY schema_validity DESC, extraction_f1 DESC, answer_status_accuracy DESC, evidence_recall DESC, tokens_per_second DESC, peak_vram_mb, run_id DESC LIMIT 1) SELECT run_id AS candidate_id, coalesce(arg_max(error_class, (n, error_class)) FILTER (WHERE error_class <> 'correct'), 'correct') AS dominant_error FROM (SELECT run_id, error_class, count(*) AS n FROM {PREDICTIONS} JOIN best USING (run_id) GROUP BY ALL) GROUP BY run_id")
def _(spark, d):
    """The first practical candidate and the failure it is to be trained against."""
    runs = _metrics(spark, d).withColumnRenamed("run_id", "candidate_id").withColumn("practical", F.col("peak_vram_mb") <= 1000000)
    worst = X.dominant_error(X.error_counts(_predictions(spark, d))).withColumnRenamed("run_id", "candidate_id")
    return X.hypothesis(X.rank_candidates(runs), worst).select("candidate_id", "dominant_error")


@query("page_redaction", f"SELECT document_id, 2 AS pages, list_aggregate(list_sort(list_distinct(list_filter([CASE WHEN contains({REDACTED}, '[REDACTED_EMAIL]') THEN 'email' END, CASE WHEN contains({REDACTED}, '[REDACTED_PHONE]') THEN 'phone' END, CASE WHEN contains({REDACTED}, '[REDACTED_SSN]') THEN 'ssn' END], lambda x: x IS NOT NULL))), 'string_agg', ',') AS codes FROM processed_document WHERE normalized_text IS NOT NULL")
def _(spark, d):
    """A page before each text; codes over all pages of a document."""
    rows = docs(spark, d).filter("normalized_text is not null").select("document_id", F.explode(F.array(F.struct(F.lit(1).alias("page_number"), F.lit("cover").alias("text")), F.struct(F.lit(2).alias("page_number"), F.col("normalized_text").alias("text")))).alias("p")).select("document_id", "p.*")
    found = O.redact_pages(rows)
    return found.select("document_id", F.size("pages").alias("pages"), F.when(F.size("codes") > 0, F.array_join(F.array_sort("codes"), ",")).alias("codes"))


@query("checksum_verification", f"SELECT subset FROM {RECORDS} WHERE right(record_id, 2) = '17' GROUP BY subset UNION SELECT '*' WHERE EXISTS (SELECT 1 FROM {RECORDS} WHERE right(record_id, 2) = '17')")
def _(spark, d):
    """Subsets whose checksum differs once the records ending in 17 are changed; '*' is all records."""
    rows = records(spark, d)
    changed = rows.withColumn("split", F.when(F.col("record_id").endswith("17"), "altered").otherwise(F.col("split")))
    columns = ["record_id", "subset", "family_id", "document_ids", "source_texts", "split"]
    return D.verify_checksums(D.checksums(rows, columns), D.checksums(changed, columns)).select("subset")


@query("scripted_scan", f"SELECT record_id, 'out of ' || record_id AS output FROM {RECORDS} WHERE subset = 'multi_turn'")
def _(spark, d):
    """Scripted outputs as one JSON object, scanned."""
    path = _fresh(spark)
    ids = [r.record_id for r in records(spark, d).filter("subset = 'multi_turn'").select("record_id").collect()]
    S.write_json(S.system_of(path)[1], {i: f"out of {i}" for i in ids})
    return S.scripted_outputs(spark, path)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
