"""File readers, scans, the pipeline and the stream, on files made here."""

import hashlib
import io
import json
import zipfile

import pytest

from clausemill.plans import pipeline
from clausemill.session import cut
from clausemill.sources import files, manifests
from clausemill.streaming import ingest

TEXT = "# Lease\nTenant shall pay rent on the first day of each month to the landlord at the office."


def tiny_pdf(text: str) -> bytes:
    stream = f"BT /F1 12 Tf 72 720 Td ({text}) Tj ET".encode()
    return b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(stream), stream)


def tiny_docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Lease</w:t></w:r></w:p><w:p><w:r><w:t>Pay rent.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_sniffing():
    assert files.sniff("a.bin", tiny_pdf("x")) == "pdf"
    assert files.sniff("a.bin", tiny_docx()) == "docx"
    assert files.sniff("a.MD", b"x") == "markdown" and files.sniff("a.txt", b"x") == "text"
    assert files.sniff("a.bin", b"x") is None and files.sniff("a.docx", b"PKxx") is None


def test_readers():
    assert "Tenant pays" in files.pdf_pages(tiny_pdf("Tenant pays"))[0]
    assert files.docx_text(tiny_docx()) == "# Lease\nPay rent.\na | b"
    with pytest.raises(ValueError):
        files.read_pages("x", b"", None)


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    contents = {"a.md": TEXT.encode(), "b.txt": (TEXT + " Mail x@example.com.").encode(), "c.md": TEXT.encode(), "d.pdf": tiny_pdf("Short page"), "e.docx": tiny_docx(), "f.txt": b"\xff\xfe"}
    for name, data in contents.items():
        (raw / name).write_bytes(data)
    kinds = {"md": "markdown", "txt": "text", "pdf": "pdf", "docx": "docx"}
    entries = [{"document_id": n[0], "family_id": "fam", "local_path": f"raw/{n}", "media_type": kinds[n.split(".")[1]], "sha256": hashlib.sha256(d).hexdigest(), "related_document_ids": ["z"]} for n, d in contents.items()]
    entries.append({"document_id": "g", "family_id": "fam", "local_path": "raw/none.md", "media_type": "markdown"})
    (tmp_path / "manifest.json").write_text(json.dumps({"sources": entries}))
    return tmp_path


def test_pipeline(spark, folder):
    manifest = manifests.manifest(spark, str(folder / "manifest.json"))
    assert manifests.entry(manifest, "a").local_path == "raw/a.md"
    with pytest.raises(KeyError):
        manifests.entry(manifest, "nope")
    made = pipeline.process(spark, manifest, str(folder / "raw"), threshold=0.5, size=3)
    status = {r.document_id: (r.status, r.error) for r in made["reports"].collect()}
    assert status["a"] == ("exported", None) and status["g"] == ("failed", "file_missing")
    assert status["f"][0] == "failed"
    docs = {r.document_id: r for r in made["documents"].collect()}
    assert docs["c"].duplicate_of == "a" and "a" in docs["b"].near_duplicate_of
    assert docs["b"].redaction_codes == ["email"] and "[REDACTED_EMAIL]" in docs["b"].normalized_text
    for r in made["blocks"].collect():
        assert docs[r.document_id].normalized_text[r.start_char : r.end_char] == r.text
    assert made["families"].first().document_ids == ["a", "b", "c", "d", "e", "f", "g", "z"]
    log = spark.createDataFrame([("a", "exported")], "document_id string, completed_stage string")
    again = {r.document_id: r.status for r in pipeline.process(spark, manifest, str(folder / "raw"), done=log)["reports"].collect()}
    assert again["a"] == "skipped"


def test_scans(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text(json.dumps({"record_id": "x", "subset": "multi_turn", "source_texts": {"d": "t"}, "turns": [{"role": "user", "text": "q"}]}))
    found = manifests.records(spark, str(tmp_path / "r"))
    assert manifests.subset_records(found, "multi_turn").first().turns[0].text == "q"
    log = tmp_path / "log.jsonl"
    log.write_text('{"record_id": "a", "v": 1}\n\n{"record_id": "a", "v": 2}\n{"record_id": "b", "v": 3}\n')
    assert {r.record_id: json.loads(r.line)["v"] for r in manifests.checkpoint_rows(spark, str(log)).collect()} == {"a": 2, "b": 3}
    assert manifests.checkpoint_rows(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "o.json").write_text("{}")
    with pytest.raises(ValueError):
        manifests.scripted_outputs(spark, str(tmp_path / "o.json"))
    (tmp_path / "q.json").write_text(json.dumps({"samples": [{"record_id": "a", "review_status": "accepted"}, {"record_id": "a", "review_status": "rejected", "notes": "n"}, {"record_id": ""}]}))
    assert [tuple(r) for r in manifests.reviews(spark, str(tmp_path / "q.json")).collect()] == [("a", "rejected", "n")]
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert sorted(r.document_id for r in manifests.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    manifests.write_json(str(tmp_path / "out" / "r.json"), {"b": 1, "a": 2})
    assert (tmp_path / "out" / "r.json").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n'
    assert manifests.config(str(tmp_path / "out" / "r.json")) == {"a": 2, "b": 1}


def test_unknown_subsets_and_empty_folders_fail(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        manifests.records(spark, str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.json").write_text(json.dumps({"record_id": "x", "subset": "something_else"}))
    with pytest.raises(Exception, match="unknown subset"):
        manifests.records(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "two").mkdir()
    for n in ("b", "a"):
        (tmp_path / "two" / f"{n}.json").write_text(json.dumps({"record_id": n, "subset": "multi_turn"}))
    assert [r.record_id for r in manifests.records(spark, str(tmp_path / "two")).orderBy("ordinal").collect()] == ["a", "b"]


def test_later_appends_count_whatever_their_size(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.createDataFrame([("a", "old"), ("b", "only")], "record_id string, v string")
    assert manifests.append_rows(old, path) == 1
    assert manifests.append_rows(spark.createDataFrame([("a", "new" * 5000)], "record_id string, v string"), path) == 2
    found = lambda: {r.record_id: json.loads(r.line)["v"][:3] for r in manifests.checkpoint_rows(spark, path).collect()}
    assert found() == {"a": "new", "b": "onl"}
    manifests.append_rows(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "record_id string, v string").coalesce(1), path)
    assert found() == {"a": "y", "b": "z"}


def test_files_of_one_name_do_not_cross(spark, tmp_path):
    raw = tmp_path / "raw"
    for folder, text in (("a", "one"), ("b", "two"), ("x", "three")):
        (raw / folder).mkdir(parents=True)
        (raw / folder / "lease.txt").write_text(text)
    (raw / "single.txt").write_text("four")
    rows = [("a", "raw/lease.txt"), ("b", "raw/lease.txt"), ("c", "raw/lease.txt"), ("d", "raw/single.txt"), ("e", "other/single.txt"), ("f", "x/lease.txt")]
    manifest = spark.createDataFrame([(d, p, "text", None) for d, p in rows], "document_id string, local_path string, media_type string, sha256 string")
    got = {r.document_id: (None if r.content is None else bytes(r.content).decode(), r.error) for r in files.acquire(manifest, files.scan(spark, str(raw)), ["text"], 100).collect()}
    assert got == {"a": ("one", None), "b": ("two", None), "c": (None, "file_ambiguous"), "d": ("four", None), "e": ("four", None), "f": ("three", None)}
    small = {r.document_id: r.error for r in files.acquire(manifest, files.scan(spark, str(raw)), ["text"], 3).collect()}
    assert small["d"] == "file_too_large" and small["a"] is None


def test_ranked_fixtures_and_runs(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"predictions": [{"relevant": True}, {"relevant": False}]}))
    assert [tuple(r) for r in manifests.ranked_fixture(spark, str(tmp_path / "f.json")).orderBy("ordinal").collect()] == [(0, True), (1, False)]
    for n in ("r2", "r1"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"run_id": n}))
    got = manifests.runs(spark, [str(tmp_path / "r2.json"), str(tmp_path / "r1.json")], "run_id string").orderBy("ordinal").collect()
    assert [r.run_id for r in got] == ["r2", "r1"]


def test_schemas_and_violations(spark, tmp_path):
    assert manifests.export_schemas(str(tmp_path)) == ["source_entry.schema.json", "record.schema.json", "answer.schema.json"]
    assert json.loads((tmp_path / "record.schema.json").read_text())["type"] == "struct"
    rows = [("a", "http://x", "public_domain", None, None), ("b", None, "open_license", None, None), ("c", "https://x", "review_required", None, ""), ("c", "https://x", "public_domain", None, None)]
    frame = spark.createDataFrame(rows, "document_id string, source_url string, rights_status string, source_license string, rights_notes string")
    assert sorted(tuple(r) for r in manifests.violations(frame).collect()) == [("a", "insecure_url"), ("b", "licence_unnamed"), ("c", "id_repeated")]


def test_stream_counts_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("One line.\nTwo lines.")
    run = lambda: ingest.stream_texts(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (source / "b.md").write_text("# Head")
    run()
    run()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.document_id, r.text) for r in found.collect()) == [("a", "One line."), ("a", "Two lines."), ("b", "# Head")]


def test_cut_uses_files(spark):
    assert cut(spark.range(3)).count() == 3
