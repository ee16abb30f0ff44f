"""Generation runs and their comparison."""

import pytest
from pyspark.sql import functions as F

from clausemill.plans import baseline as B
from tests_support import RECORD, record


def test_prompt(spark):
    frame = spark.createDataFrame([("x", None)], "a string, b string")
    assert frame.select(B.prompt("{a}-{b}-{c}", {"a": F.col("a"), "b": F.col("b")}).alias("r")).first().r == "x--{c}"


def test_answers(spark):
    cases = {
        '{"status": "answered", "explanation": "e", "confidence": 0.5, "evidence": [{"text": "q"}]}': True,
        '{"status": "answered", "explanation": "e", "confidence": 0.5, "evidence": []}': False,
        '{"status": "insufficient_evidence", "explanation": "e", "confidence": 0.5}': True,
        '{"status": "insufficient_evidence", "explanation": "e", "confidence": 1.5}': False,
        '{"status": "other", "explanation": "e", "confidence": 0.5}': False,
        '{"status": "insufficient_evidence", "explanation": "e", "confidence": 0.5, "extra": 1}': False,
        "{}": False,
    }
    frame = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r.p: r.v for r in frame.select("p", B.answer_valid(F.col("p")).alias("v")).collect()} == cases


def test_run_resumes_and_classes(spark):
    span = ("d", "Rent is due", None, None, 0, 11)
    rows = [record(i, split="test", answer=("q", "answered", [span])) for i in "abcd"] + [record("e", split="train", answer=("q", "answered", [span]))]
    frame = spark.createDataFrame(rows, RECORD)
    good = '{"status": "answered", "explanation": "e", "confidence": 0.5, "evidence": [{"text": "Rent is due"}]}'
    other = good.replace("answered", "conflicting_evidence")
    outputs = spark.createDataFrame([("a", f"```json\n{good}\n```"), ("b", "{}"), ("c", other)], "record_id string, output string")
    found = {r.record_id: r for r in B.predict(frame, B.scripted(outputs), "{question} {context}").collect()}
    assert {i: r.error_class for i, r in found.items()} == {"a": "correct", "b": "validation_error", "c": "model_error", "d": "parse_error"}
    assert found["a"].evidence and found["a"].detail.startswith("schema-valid")
    done = spark.createDataFrame([("a",), ("b",)], "record_id string")
    assert {r.record_id for r in B.predict(frame, B.scripted(outputs), "x", done=done, prompt_mode="direct").collect()} == {"c", "d"}
    assert B.predict(frame, B.scripted(outputs), "x", limit=1).count() == 1


def test_comparison(spark):
    schema = "candidate_id string, comparison_id string, completed_at int, ordinal int, oom boolean, backend_kind string, schema_validity double, extraction_f1 double, answer_status_accuracy double, evidence_recall double, tokens_per_second double, peak_vram_mb double"
    rows = [("a", "c", 1, 0, False, "model", 0.5, 0.5, 0.5, 0.5, 5.0, 100.0), ("a", "c", 2, 1, False, "model", 0.9, 0.5, 0.5, 0.5, 5.0, 100.0), ("b", "c", 1, 2, True, "model", 1.0, 1.0, 1.0, 1.0, 9.0, 10.0), ("b", "x", 9, 3, False, "model", 1.0, 1.0, 1.0, 1.0, 9.0, 10.0)]
    runs = spark.createDataFrame(rows, schema)
    two, three = (spark.createDataFrame([(c,) for c in names], "candidate_id string") for names in ("ab", "abz"))
    found = {r.candidate_id: (r.place, r.practical, r.selected) for r in B.compare(runs, two, "c", 15000).collect()}
    assert found == {"a": (1, True, True), "b": (2, False, False)}
    assert not any(r.selected for r in B.compare(runs, three, "c", 15000).collect())


def test_functions_are_timed_and_backends_named(spark):
    asked = spark.createDataFrame([("a", "one two"), ("b", "three")], "record_id string, prompt string")
    found = {r.record_id: r for r in B.backend("function", lambda prompts: [p.upper() for p in prompts])(asked).collect()}
    assert found["a"].raw_output == "ONE TWO" and found["a"].completion_tokens == 2 and found["b"].latency_seconds >= 0
    with pytest.raises(ValueError):
        B.backend("transformers")
