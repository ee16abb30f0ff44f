"""Small fixtures for the document, metric, run and record operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_support import RECORD, record

from clausemill.operators import dataset as D, documents as O, metrics as M, regression as G, retrieval as R, runs as X, validators as V
from clausemill.session import cut


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_segment(spark):
    docs = spark.createDataFrame([("d", "# Lease\r\n\n  Tenant   pays. \nExhibit A"), ("e", None), ("f", " \n "), ("g", "\U0001f600 x\ny")], "document_id string, normalized_text string")
    found = O.segment(docs).collect()
    by = {(r.document_id, r.block_id): r for r in found}
    assert sorted({r.document_id for r in found}) == ["d", "g"]
    assert by["d", "block-0002"].text == "Tenant pays." and by["d", "block-0002"].start_char == 8
    assert by["d", "block-0003"].kind == "exhibit" and by["d", "block-0001"].heading == "Lease"
    assert by["g", "block-0002"].start_char == 4
    joined = "# Lease\nTenant pays.\nExhibit A"
    assert all(joined[r.start_char : r.end_char] == r.text for r in found if r.document_id == "d")


def test_segment_pages(spark):
    pages = spark.createDataFrame([("d", 1, " "), ("d", 2, "A\nB"), ("d", 3, "C")], "document_id string, page_number int, text string")
    found = sorted(O.segment_pages(pages).collect(), key=lambda r: r.block_id)
    whole = "A\nB\n\nC"
    assert [whole[r.start_char : r.end_char] for r in found] == ["A", "B", "C"]
    assert [r.page_number for r in found] == [2, 2, 3]


def test_duplicates(spark):
    docs = spark.createDataFrame([("a", "one two three four five six"), ("b", "one two three four five seven"), ("c", "one two three four five six"), ("d", None), ("e", "")], "document_id string, normalized_text string")
    assert rows(O.exact_duplicates(docs, checksum=F.sha2("normalized_text", 256))) == [("c", "a")]
    pairs = {(r.document_id, r.near_duplicate_of) for r in O.near_duplicates(docs, 0.3, 3).collect()}
    assert pairs == {("b", "a"), ("c", "a"), ("c", "b")}
    assert O.ceil_prefix(10, 0.85) == 2


def test_exact_duplicates_go_by_the_raw_checksum(spark):
    docs = spark.createDataFrame([("a", "same text", ("x",)), ("b", "same text", ("y",)), ("c", "other", ("x",)), ("d", "none", (None,))], "document_id string, normalized_text string, source struct<sha256: string>")
    assert rows(O.exact_duplicates(docs)) == [("c", "a")]


def test_blank_texts_are_alike(spark):
    docs = spark.createDataFrame([("a", ""), ("b", " "), ("c", "\n"), ("d", "word"), ("e", None)], "document_id string, normalized_text string")
    assert rows(O.near_duplicates(docs, 0.85, 5)) == [("b", "a", 1.0), ("c", "a", 1.0), ("c", "b", 1.0)]


def test_common_tokens_only_order(spark, monkeypatch):
    import random

    random.seed(9)
    texts = [(f"d{i}", " ".join(["boiler"] * 3 + [random.choice("abcdefgh") for _ in range(random.randrange(4, 12))])) for i in range(40)]
    docs = spark.createDataFrame(texts, "document_id string, normalized_text string")
    want = rows(O.near_duplicates(docs, 0.5, 2))
    monkeypatch.setattr(O, "COMMON_LEAST", 10**9)
    assert want and rows(O.near_duplicates(docs, 0.5, 2)) == want


def _changed_texts(count, seed=5):
    import random

    random.seed(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(count):
        words = list(base)
        for _ in range(random.randrange(12)):
            words[random.randrange(120)] = f"x{random.randrange(40)}"
        texts.append((f"d{i:03d}", " ".join(words[: random.randrange(80, 121)])))
    return texts


def test_near_duplicates_write_no_sets(spark, monkeypatch):
    written = []
    monkeypatch.setattr(O, "cut", lambda frame: written.append(dict(frame.dtypes)) or cut(frame))
    texts = _changed_texts(40) + [("e", "one two"), ("f", "one two"), ("g", "two one")]
    found = O.near_duplicates(spark.createDataFrame(texts, "document_id string, normalized_text string"), 0.7)
    runs = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts)}
    want = {(j, i): len(x & y) / len(x | y) for i, x in runs.items() for j, y in runs.items() if i < j and len(x & y) / len(x | y) >= 0.7}
    assert {(r.document_id, r.near_duplicate_of): r.similarity for r in found.collect()} == want and len(want) > 20
    assert written and not [kinds for kinds in written if any(k.startswith("array") or k == "string" for k in kinds.values())]


def test_pairs_meet_across_batches():
    import itertools

    sizes = {7: [5], 8: [1, 2, 3, 4, 5, 6], 9: [2, 4, 4, 6], 11: [1, 6]}
    rows = [(t, node, 1, 0) for t, nodes in sizes.items() for node in nodes]
    want = {}
    for nodes in sizes.values():
        for pair in itertools.combinations(sorted(set(nodes)), 2):
            want[pair] = want.get(pair, 0) + 1
    for size in (1, 2, 3, 5, 50):
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], names=["token", "node", "n", "place"]) for i in range(0, len(rows), size)]
        got = {(a, b): met for batch in O._pairs(iter(parts), 0.85) for a, b, _, met in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        assert got == want


def test_cross_family_near_duplicates(spark):
    """Ids of several texts or families, and of none, as the join of the pairs with the families has them."""
    rows_ = [(i, t, f"f{k % 3}" if k % 7 else None) for k, (i, t) in enumerate(_changed_texts(30))]
    rows_ += [("d001", rows_[4][1], "f9"), ("d001", rows_[4][1], "f9"), ("d005", rows_[5][1], "f8"), ("e", "same", "f1"), ("f", "same", "f2"), (None, "same", "f3")]
    docs = spark.createDataFrame(rows_, "document_id string, normalized_text string, family_id string")
    want = rows(O.cross_family(O.near_duplicates(docs, 0.5), docs))
    assert want and rows(O.cross_family_near_duplicates(docs, 0.5)) == want


def test_duplicate_issues_take_every_text_of_a_record(spark):
    texts = [("a", "f", {"d": "one two"}), ("b", "g", {"d": "one two"}), ("b", "g", {"d": "one two"}), ("b", "g", {"d": "three four"}), ("c", "h", {"d": "three four"})]
    found = D.duplicate_issues(spark.createDataFrame(texts, "record_id string, family_id string, source_texts map<string,string>"), 0.7, 5)
    assert rows(found.select("code", "record_id")) == [("exact_duplicate", "b"), ("exact_duplicate", "c"), ("near_duplicate_leakage", "b"), ("near_duplicate_leakage", "c")]


def test_validators(spark):
    pages = spark.createDataFrame([("a", 1, 2), ("b", None, 2), ("c", 3, 2), ("d", None, None)], "clause_id string, page_start int, page_end int")
    assert rows(V.clause_page_violations(pages, ["clause_id"])) == [("b", "pages_unpaired"), ("c", "pages_reversed")]
    duty = spark.createDataFrame([("a", "fixed_date", None, None, None, None, 1, "days"), ("b", "unstated", None, None, None, None, 1, None), ("c", "recurring", None, None, "monthly", None, None, None)], "id string, timing_type string, due_date string, relative_deadline string, recurrence string, trigger string, timing_value int, timing_unit string")
    assert rows(V.obligation_violations(duty, ["id"])) == [("a", "timing_detail_missing"), ("b", "timing_unpaired")]
    uses = spark.createDataFrame([("Official-Test", "fine-tuning"), (" test ", "reporting"), ("train", "fine-tuning")], "split string, purpose string")
    assert rows(V.purpose_violations(uses)) == [("Official-Test", "fine-tuning")]
    runs = spark.createDataFrame([("a", 2, 1, ["f1", "f1"], ["r"]), ("b", 1, 1, ["f1"], ["r", "r"])], "run_id string, started_at int, completed_at int, metric_names array<string>, record_ids array<string>")
    assert rows(V.run_violations(runs)) == [("a", "ends_before_start"), ("a", "metric_repeated"), ("b", "record_repeated")]
    pair = spark.createDataFrame([("a", "x", True, "y", "long enough"), ("b", "x", False, "x", "long enough"), ("c", "x", False, "y", " short  "), ("d", "x", False, "y", "long enough"), ("e", "x", False, "y", None)], "record_id string, preferred_text string, preferred_invented boolean, rejected_text string, ranking_reason string")
    assert rows(V.preference_violations(pair)) == [("a", "preferred_invented"), ("b", "responses_equal"), ("c", "reason_missing"), ("e", "reason_missing")]


def test_regression_suite(spark):
    extractions = spark.createDataFrame([("p1", True, "f", "d1", "f", "amendment", "open_license", None, None, 0), ("p2", False, "f", None, None, None, None, None, None, 0), ("p3", True, "g", "d3", "f", "office", "public_domain", None, None, 0)], "path string, valid boolean, expected_family_id string, document_id string, family_id string, document_type string, rights_status string, rights_notes string, source_license string, effects int")
    items = spark.createDataFrame([("d1", "party", "x", 0), ("d1", "clause", "y", 0), ("d3", "date", "z", 1)], "document_id string, kind string, label string, evidence int")
    answers = spark.createDataFrame([("q1", True, "answered", "answered", 0), ("q2", True, "insufficient_evidence", "answered", 1)], "path string, valid boolean, status string, expected_status string, evidence int")
    families = spark.createDataFrame([("f", ["d1", "d3"]), ("h", ["d9"])], "family_id string, member_document_ids array<string>")
    found = G.failures(extractions, items, answers, families, spark.createDataFrame([("d1",)], "document_id string"))
    assert rows(found) == [
        ("agreement_family_splits", "h", "members_differ"), ("amendment_effects", "d1", "no_effects"), ("evaluation_holdout", "d3", "not_blocked"), ("grounded_answers_and_abstention", "q1", "answered_without_evidence"),
        ("grounded_answers_and_abstention", "q2", "abstention_with_evidence"), ("grounded_answers_and_abstention", "q2", "status_differs"), ("required_evidence", "d1", "party x"), ("rights_and_training_gates", "d1", "licence_unnamed"),
        ("schema_validity", "p2", "invalid"), ("schema_validity", "p3", "family_differs"),
    ]
    assert all(not r.passed for r in G.checks(found).collect()) and all(r.passed for r in G.checks(found.limit(0)).collect())
    scores = {r.name: r.value for r in G.metrics(found.limit(0), items, items.filter("kind <> 'date'")).collect()}
    assert scores == {"check_pass_rate": 1.0, "schema_validity": 1.0, "clause_label_f1": 1.0, "date_term_f1": 0.0, "monetary_term_f1": 1.0, "obligation_f1": 1.0}


def test_duplicates_match_brute_force(spark):
    import random

    random.seed(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):
        words = list(base if i % 2 else reversed(base))
        for _ in range(random.randint(0, 6)):
            words[random.randrange(60)] = f"x{random.randrange(30)}"
        texts.append((f"d{i:02d}", " ".join(words)))
    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for i, (a, x) in enumerate(texts):
        for b, y in texts[i + 1 :]:
            s, t = sh(x), sh(y)
            if len(s & t) / len(s | t) >= 0.5:
                want.add((b, a))
    found = O.near_duplicates(spark.createDataFrame(texts, "document_id string, normalized_text string"), 0.5)
    assert {(r.document_id, r.near_duplicate_of) for r in found.collect()} == want


def test_set_scores(spark):
    cases = [(["a", "b"], ["a", "c"], (0.5, 0.5, 0.5)), ([], [], (1.0, 1.0, 1.0)), ([], ["a"], (0.0, 0.0, 0.0)), (["a"], [], (0.0, 1.0, 0.0))]
    frame = spark.createDataFrame([(p, r) for p, r, _ in cases], "p array<string>, r array<string>")
    found = frame.select(*M.set_scores(F.col("p"), F.col("r"))).collect()
    assert [tuple(x) for x in found] == [w for _, _, w in cases]


def test_spans(spark):
    frame = spark.createDataFrame([("k", 8, 15), ("k", 0, 10), ("k", 20, 25), ("k", 25, 30)], "k string, start int, end int")
    assert rows(M.merge_spans(frame, "k")) == [("k", 0, 15), ("k", 20, 30)]
    p = spark.createDataFrame([("k", 0, 15)], "k string, start int, end int")
    r = spark.createDataFrame([("k", 5, 20)], "k string, start int, end int")
    found = M.span_coverage(p, r, "k").first()
    assert (found.overlap, found.predicted, found.reference) == (10, 15, 15) and found.precision == round(2 / 3, 9)


def test_ranking_curve(spark):
    frame = spark.createDataFrame([("k", 0, True), ("k", 1, False), ("k", 2, True)], "k string, o int, relevant boolean")
    curve = M.pr_curve(frame, "k", [F.col("o")])
    assert [(round(r.precision, 3), r.recall) for r in curve.orderBy("place").collect()] == [(1.0, 0.5), (0.5, 0.5), (0.667, 1.0)]
    assert M.area_under(curve, "k").first().aupr == round(5 / 12, 9)
    assert M.precision_at_recall(curve, "k", 0.8).first().precision == round(2 / 3, 9)
    with pytest.raises(ValueError):
        M.precision_at_recall(curve, "k", 0.0)


def test_error_classes(spark):
    frame = spark.createDataFrame(
        [("direct", False, False, False, False), ("schema", False, False, False, False), ("schema", True, False, True, True), ("schema", True, True, True, False), ("schema", True, True, False, False), ("schema", True, True, False, True)],
        "m string, p boolean, v boolean, c boolean, e boolean",
    )
    found = [r[0] for r in frame.select(X.error_class(F.col("m"), F.col("p"), F.col("v"), F.col("c"), F.col("e"))).collect()]
    assert found == ["prompt_error", "parse_error", "validation_error", "correct", "retrieval_error", "model_error"]


def test_runs(spark):
    runs = spark.createDataFrame([("a", 0, 5), ("a", 1, 5), ("b", 2, 1)], "candidate_id string, ordinal int, completed_at int")
    assert rows(X.latest_runs(runs)) == [("a", 0, 5), ("b", 2, 1)]
    expected = spark.createDataFrame([("a",), ("c",)], "candidate_id string")
    assert rows(X.missing_candidates(expected, runs)) == [("c",)]
    p = spark.createDataFrame([("r", 0, False), ("r", 1, True), ("r", 2, False)], "run_id string, ordinal int, oom boolean")
    assert X.until_out_of_memory(p).count() == 2
    counts = spark.createDataFrame([("r", "correct", 9), ("r", "model_error", 2), ("r", "parse_error", 2), ("s", "correct", 1)], "run_id string, error_class string, n long")
    assert rows(X.dominant_error(counts)) == [("r", "parse_error"), ("s", "correct")]
    log = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "record_id string, o int, v string")
    assert rows(X.last_rows(log, "record_id", ["o"])) == [("x", 2, "new")]
    work = spark.createDataFrame([("x",), ("y",)], "record_id string")
    assert rows(X.resume(work, log)) == [("y",)]
    outputs = spark.createDataFrame([("x", "{} done")], "record_id string, output string")
    assert rows(X.scripted(work, outputs)) == [("x", "{} done", 2), ("y", "NO_JSON", 1)]


def test_labels(spark):
    schema = "e struct<parties array<struct<role string, name string>>, premises array<struct<description string>>, clauses array<struct<clause_types array<string>>>, monetary_terms array<struct<amount string, currency string>>, date_terms array<struct<normalized_date date>>, obligations array<struct<responsible_party string, action string>>>"
    e = ([("tenant", "T")], [("Suite 1",)], [(["rent", "term"],), (["rent"],)], [("5000.00", "USD"), (None, "USD")], [(None,)], [("T", "pay")])
    found = spark.createDataFrame([(e,)], schema).select(X.extraction_labels(F.col("e")).alias("r")).first().r
    assert found == ["party:tenant:T", "premises:Suite 1", "clause:rent", "clause:term", "money:5000.00:USD", "obligation:T:pay"]


def test_records(spark):
    span = lambda q, a, b, d="d": (d, q, None, None, a, b)
    data = [
        record("a", answer=("q", "answered", [span("Rent is due", 0, 11), span("Rent", 1, 5), span("Gone", None, None), span("Rent", 0, 4, "z")])),
        record("b", document_ids=["d", "e"], split="test", turns=[("user", "x"), ("user", "y")]),
        record("b", document_ids=["d", "e"], split="test", turns=[("user", "x"), ("user", "y")]),
        record("c", family_id="g", split=None, subset="raw_domain_text"),
    ]
    frame = spark.createDataFrame(data, RECORD)
    assert {(r.ordinal, r.failure) for r in D.evidence_failures(frame).collect()} == {(1, "offsets_differ"), (2, "quote_missing"), (3, "unknown_document")}
    assert {(r.ordinal, r.failure) for r in D.locator_violations(frame).collect()} == {(2, "no_locator")}
    assert rows(D.shape_violations(frame)) == [("b", 1, 0)]
    assert rows(D.turn_violations(frame)) == [("b", 2, True)]
    assert rows(D.duplicate_ids(frame)) == [("b", 2)]
    assert rows(D.family_split_leakage(frame)) == [("f", "test, train")]
    assert rows(D.document_family_leakage(frame)) == [("d", "f, g")]
    assert {r.subset: r.total for r in D.subset_counts(frame).collect()}["multi_turn"] == 0
    assert [r.record_id for r in D.quality_sample(frame, 1).orderBy("record_id").collect()] == ["a"]
    report = {r.code: (r.passed, r.failures) for r in D.check_report(D.issues(frame), ["record_id", "turns", "other"]).collect()}
    assert report == {"record_id": (False, 1), "turns": (False, 1), "other": (True, 0)}
    assert D.licence_records(frame).count() == 2
    sums = D.checksums(frame, ["record_id", "split"])
    assert D.verify_checksums(sums, sums).count() == 0
    assert sums.filter("subset = '*'").first().records == 3


def test_contexts(spark):
    frame = spark.createDataFrame([record("a", source_texts={"d": "Rent is due.\nParking is free.", "e": ""})], RECORD)
    query = spark.createDataFrame([("a", "parking free")], "record_id string, query string")
    best = R.contexts(frame, query, "retrieval_assisted", top_k=1).first()
    assert best.block_ids == ["d:block-0002"] and best.context == "[d] Parking is free."
    assert R.contexts(frame, query, "clause_level").first().block_ids == ["d:block-0001", "d:block-0002", "e:full"]
    assert R.contexts(frame, query, "full_document").first().context.startswith("[d]\nRent")
    assert R.contexts(frame, query, "retrieval_assisted", min_score=2.0).first().block_ids == ["retrieval_fallback"]
    with pytest.raises(ValueError):
        R.contexts(frame, query, "other")


def test_bundle_is_all_or_nothing(spark, tmp_path):
    frame = spark.createDataFrame([record("a")], RECORD)
    found = spark.createDataFrame([("x",)], "code string")
    assert not D.write_bundle(frame, str(tmp_path / "b"), found)
    assert D.write_bundle(frame, str(tmp_path / "b"), found.limit(0))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1
