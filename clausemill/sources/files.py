"""Reading document files: sniffing, validation and page text of pdf, docx, markdown and text.

Files come as ``binaryFile`` rows.  Problems are rows with an error, never exceptions.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.sources.manifests import system_of

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Paragraph styles that become headings.
HEADING_STYLES = frozenset({"heading1", "heading2", "heading3", "title"})


def sniff(path: str, payload: bytes) -> str | None:
    """pdf by its magic number, docx by its members, text and markdown by suffix."""
    if payload[:4] == b"%PDF":
        return "pdf"
    if payload[:2] == b"PK":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(payload)).namelist())
        except zipfile.BadZipFile:
            return None
        return "docx" if {"[Content_Types].xml", "word/document.xml"} <= names else None
    suffix = path.lower().rpartition(".")[2]
    return {"md": "markdown", "markdown": "markdown", "txt": "text"}.get(suffix)


def _paragraph(node) -> str:
    text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in node.iter())
    style = node.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val", "") if style is not None else "").lower().replace(" ", "")
    return f"# {text.strip()}" if name in HEADING_STYLES and text.strip() else text


def docx_text(payload: bytes) -> str:
    """Paragraphs and tables of a docx in order; cells of a row are joined by bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(payload)).read("word/document.xml")).find(f"{_W}body")
    parts = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            parts.append(_paragraph(node))
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = [" ".join(_paragraph(p).strip() for p in c.iter(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
                if any(cells):
                    parts.append(" | ".join(cells))
    return "\n".join(p for p in parts if p.strip())


_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>")
_SHOW = re.compile(rb"(\[(?:\\.|[^\]])*\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>)\s*(?:TJ|Tj|'|\")|(T\*|Td|TD|ET)")


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3})|\\(.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1] else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[2], m[2]), raw[1:-1], flags=re.S)
    return data.decode("utf-16-be", "replace")[1:] if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def pdf_pages(payload: bytes) -> list[str]:
    """Page texts of a simple PDF: content streams plain or deflated, single-byte fonts.

    The full reader is used where a PDF library is installed.
    """
    if re.search(rb"/Encrypt\b", payload):
        raise ValueError("encrypted")
    try:
        from pypdf import PdfReader
    except ImportError:
        pass
    else:
        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(payload)).pages]
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj(.*?)endobj", payload, re.S)}
    pages = []
    for _, body in sorted(objects.items()):
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        text = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", contents[1]) if contents else []:
            stream = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", objects.get(int(ref), b""), re.S)
            if not stream:
                continue
            data = stream[1]
            if b"FlateDecode" in objects[int(ref)]:
                data = zlib.decompressobj().decompress(data)
            for show, move in _SHOW.findall(data):
                text.append("\n" if move else "".join(_pdf_string(s) for s in _STRING.findall(show)))
        pages.append(re.sub(r"\n+", "\n", "".join(text)).strip())
    return pages


def read_pages(path: str, payload: bytes, media_type: str | None) -> list[str]:
    if media_type == "pdf":
        return pdf_pages(payload)
    if media_type == "docx":
        return [docx_text(payload)]
    if media_type in ("markdown", "text"):
        return [payload.decode("utf-8")]
    raise ValueError(f"no reader for {path}")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``path, relative, length`` of the files below a folder, empty ones too; no content is read.

    The folder's own entries are listed here, each folder in it by a worker.
    """
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder and not folder.startswith("file:") else "file:"
    system, root = system_of(folder.rstrip("/"))
    top = system.get_file_info(pafs.FileSelector(root))
    schema = "path string, relative string, length long"
    cut_off = len(root.rstrip("/")) + 1
    row = lambda f: (scheme + f.path, f.path[cut_off:], f.size)
    files = spark.createDataFrame([row(f) for f in top if f.type == pafs.FileType.File], schema)
    folders = [f.path for f in top if f.type == pafs.FileType.Directory]
    if not folders:
        return files

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for inner in batch.column(0).to_pylist():
                own, path = system_of(scheme + inner)
                found = [f for f in own.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([scheme + f.path for f in found], pa.string()), pa.array([f.path[cut_off:] for f in found], pa.string()), pa.array([f.size for f in found], pa.int64())], names=["path", "relative", "length"])

    tasks = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, min(len(folders), spark.sparkContext.defaultParallelism)))
    return files.unionByName(tasks.mapInArrow(below, schema))


def placed(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with ``path, length`` of their file: the one below ``document_id``, else at the local path, else the only one of the name.

    Each way is an equi-join on a key that names one file, so folders full of files of
    one name cost no more than others.
    """
    name = F.element_at(F.split("local_path", "/"), -1)
    parts = F.split("relative", "/")
    deep = files.filter(F.size(parts) > 1).select(F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("own_key"), F.struct("path", "length").alias("own")).groupBy("own_key").agg(F.min("own").alias("own"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    exact = files.select(F.col("relative").alias("relative_key"), F.struct("path", "length").alias("exact"))
    single = files.select(F.element_at(parts, -1).alias("name_key"), F.struct("path", "length").alias("single")).groupBy("name_key").agg(F.min("single").alias("single"), F.count(F.lit(1)).alias("named"))
    inner = F.regexp_replace("local_path", "^[^/]+/", "")
    rows = (
        manifest.withColumn("_name", name)
        .join(deep, F.col("own_key") == F.concat_ws("/", "document_id", "_name"), "left")
        .join(exact, F.col("relative_key") == F.col("local_path"), "left")
        .join(exact.select(F.col("relative_key").alias("inner_key"), F.col("exact").alias("inner_")), F.col("inner_key") == inner, "left")
        .join(single, F.col("name_key") == F.col("_name"), "left")
    )
    found = F.coalesce("own", "exact", "inner_", F.when(F.col("named") == 1, F.col("single")))
    return rows.withColumn("_file", found).withColumn("_many", F.col("_file").isNull() & (F.col("named") > 1)).select(*manifest.columns, "_file.path", "_file.length", F.coalesce("_many", F.lit(False)).alias("_many"))


def acquire(manifest: DataFrame, files: DataFrame, allowed: list[str], max_bytes: int) -> DataFrame:
    """Manifest rows with their file, ``content`` and the first thing wrong with it (``error``, null where good).

    Names and lengths are checked first; only files that pass are opened, by the worker
    that checks their hash and type.
    """
    error = (
        F.when(F.col("_many"), "file_ambiguous")
        .when(F.col("path").isNull(), "file_missing")
        .when(F.col("length") == 0, "file_empty")
        .when(F.col("length") > max_bytes, "file_too_large")
    )
    checked = placed(manifest, files).withColumn("early", error).drop("_many").repartition("document_id")
    names = checked.columns
    columns = [c for c in names if c != "early"]
    places = [names.index(c) for c in columns]
    at = {c: names.index(c) for c in ("path", "early", "sha256", "media_type")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, early, sha, kind = (row.column(at[c])[0].as_py() for c in ("path", "early", "sha256", "media_type"))
                content = found = sniffed = None
                if early is None:
                    system, inner = system_of(path)
                    with system.open_input_stream(inner) as f:
                        content = f.read()
                    found, sniffed = hashlib.sha256(content).hexdigest(), sniff(path, content)
                    if sha is not None and sha != found:
                        early = "checksum_differs"
                    elif sniffed is None or sniffed != kind:
                        early = "media_type_differs"
                    elif kind not in allowed:
                        early = "media_type_not_allowed"
                extra = [pa.array([content if early is None else None], pa.binary()), pa.array([found]).cast(pa.string()), pa.array([sniffed]).cast(pa.string()), pa.array([early]).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(row.column(j) for j in places), *extra], names=[*columns, "content", "found_sha256", "sniffed", "error"])

    types = dict(checked.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", content binary, found_sha256 string, sniffed string, error string"
    return checked.mapInArrow(read, schema)


def pages(acquired: DataFrame) -> DataFrame:
    """``document_id, page_number, text, error``: a row per page of each good file, or one with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts, errors = [], [], [], []
            for d, path, content, kind, error in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                found: list[str] = []
                if error is None:
                    try:
                        found = read_pages(path, content, kind)
                    except Exception as problem:  # noqa: BLE001
                        error = f"unreadable: {problem}"[:200]
                for n, text in enumerate(found, 1) if error is None else [(None, None)]:
                    ids.append(d)
                    numbers.append(n)
                    texts.append(text)
                    errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["document_id", "page_number", "text", "error"])

    return acquired.select("document_id", "path", "content", "media_type", "error").mapInArrow(run, "document_id string, page_number int, text string, error string")
