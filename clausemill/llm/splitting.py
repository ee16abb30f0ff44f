"""Cutting oversized texts at natural boundaries, with an overlap.

One way for texts of every size, in a column or in a file: the text's UTF-8 bytes are
cut into ranges of ``RANGE`` bytes.  A range begins at its anchor, the first line break
(else sentence end, blank, character) at or after its nominal byte.  A worker gets a
range with a halo on both sides, finds the anchors and takes pieces greedily: the last
blank line in the second half of the limit, else line break, sentence end, clause mark,
blank, and only then any character.  A piece repeats the end of the one before from the
first natural boundary within the overlap.  It leaves a row of the boundary table:
characters and pieces of the range, and where the pieces begin and end in it.  Prefix
sums over the table give the ranges' places in the text, and pieces come out by offset.
No worker ever holds more of a file than a range and its halos.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clausemill.session import cut

#: Bytes of a range, and ranges whose sums one task adds up.
RANGE = 1 << 20
STRETCH = 4096
_SENTENCE = re.compile("[.!?。！？।۔؟][\"'”’»)\\]」）]*(?:\\s+|(?<=[。！？\"'”」）]))")
_CLAUSE = re.compile("[;:,、，；؛]\\s*")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n\s*")
_BLANK = re.compile(r"\s+")
#: Natural boundaries, the strongest first; the cut lies behind the match.
BOUNDARIES = (_BLANK_LINE, _LINE, _SENTENCE, _CLAUSE, _BLANK)


def last_boundary(text: str, low: int, high: int) -> int:
    """The best place in (low, high] to end a piece; high where nothing breaks."""
    for pattern in BOUNDARIES:
        best = 0
        for match in pattern.finditer(text, low, high):
            if low < match.end() <= high:
                best = match.end()
        if best:
            return best
    return high


def overlap_start(text: str, end: int, overlap: int) -> int:
    """Where the repeat before ``end`` begins: within ``overlap``, at a natural boundary if there is one."""
    low = max(0, end - overlap)
    if low == 0 or overlap == 0:
        return end if overlap == 0 else low
    for pattern in (_LINE, _SENTENCE, _CLAUSE, _BLANK):
        match = pattern.search(text, low, end)
        while match and match.end() >= end:
            match = None
        if match and match.end() < end:
            return match.end()
    return low


def anchor(text: str, nominal: int, reach: int) -> int:
    """The place at or after ``nominal``, within ``reach``, where a range begins."""
    if nominal <= 0 or nominal >= len(text):
        return max(0, min(nominal, len(text)))
    for pattern in (_LINE, _SENTENCE, _BLANK):
        match = pattern.search(text, nominal, min(len(text), nominal + reach))
        if match:
            return match.end()
    return nominal


def pieces(text: str, limit: int, overlap: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces that end within (low, high]."""
    high = len(text) if high is None else high
    end = low
    while end < high:
        start = end if end == 0 else overlap_start(text, end, overlap)
        if high - start <= limit:
            yield start, high
            return
        top = start + limit
        end = last_boundary(text, max(end, start + limit // 2), top)
        yield start, end


def _check(limit: int, overlap: int) -> None:
    if overlap < 0 or limit < 2 * overlap + 2:
        raise ValueError("the limit must exceed twice the overlap")


def halo_bytes(limit: int) -> int:
    """Bytes read besides a range on either side: two limits of the widest characters."""
    return 8 * limit


def _lead(data: bytes, at: int) -> int:
    """The first byte at or after ``at`` that begins a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def range_pieces(data: bytes, base: int, low: int, high: int, size: int, limit: int, overlap: int) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(characters of the range, its pieces relative to its begin, their texts).

    data: the bytes from ``base`` on, which reach a halo beyond the range [low, high) of
    a text of ``size`` bytes.  What comes out depends on the range and its halos only.
    """
    first = _lead(data, 0) if base else 0
    last = len(data)
    if base + last < size:
        # The window may end within a character.
        while last > first and data[last - 1] & 0xC0 == 0x80:
            last -= 1
        last = max(first, last - 1)
    before, after = _lead(data, min(low - base, last)), _lead(data, min(high - base, last))
    text = data[first:last].decode("utf-8")
    places = [len(data[first:x].decode("utf-8")) for x in (before, after)]
    a = 0 if low == 0 else anchor(text, places[0], limit)
    b = len(text) if high >= size else anchor(text, places[1], limit)
    cuts = list(pieces(text, limit, overlap, a, b)) if a < b else []
    return max(0, b - a), [(s - a, e - a) for s, e in cuts], [text[s:e] for s, e in cuts]


def split_text(text: str, limit: int, overlap: int, range_size: int = RANGE) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, range by range as everywhere."""
    data, halo, at, out = text.encode("utf-8"), halo_bytes(limit), 0, []
    for low in range(0, len(data), range_size):
        base, high = max(0, low - halo), min(len(data), low + range_size)
        chars, cuts, _ = range_pieces(data[base : high + halo], base, low, high, len(data), limit, overlap)
        out += [(at + s, at + e) for s, e in cuts]
        at += chars
    return out


_FOUND = "chars long, starts array<int>, ends array<int>, texts array<string>"


def _found(batch: pa.RecordBatch, kept: int, rows: list[tuple[int, list[tuple[int, int]], list[str]]]) -> pa.RecordBatch:
    lists = [pa.array([[s for s, _ in r[1]] for r in rows], pa.list_(pa.int32())), pa.array([[e for _, e in r[1]] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array([r[0] for r in rows], pa.int64()), *lists], names=[*batch.schema.names[:kept], "chars", "starts", "ends", "texts"])


def stitched(found: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``piece``, ``start_char``, ``end_char``, ``piece_text`` from ranges (``text``, low, number, chars, starts, ends, texts).

    The boundary table has one small row a range.  Its prefix sums are taken in two
    levels, within stretches of ranges and over the stretches, so a file of any length is
    added up by many tasks.  The first range of a text begins at 0 and needs no sums.
    """
    rows = found.filter("number > 0 or more").select(text, "number", "chars", F.size("ends").cast("long").alias("n")).withColumn("stretch", F.expr(f"number div {STRETCH}"))
    sums = rows.groupBy(text, "stretch").agg(F.sum("chars").alias("chars"), F.sum("n").alias("n"))
    earlier = W.partitionBy(text).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    outer = sums.select(text, "stretch", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inner = W.partitionBy(text, "stretch").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    table = rows.select(text, "number", "stretch", F.coalesce(F.sum("chars").over(inner), F.lit(0)).alias("c"), F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("k")).join(outer, [text, "stretch"])
    table = table.filter("number > 0").select(text, "number", (F.col("c") + F.col("chars0")).alias("base"), (F.col("k") + F.col("n0")).alias("count"))
    later = found.filter("number > 0").join(table, [text, "number"])
    all_ranges = found.filter("number = 0").withColumns({"base": F.lit(0).cast("long"), "count": F.lit(0).cast("long")}).unionByName(later)
    return all_ranges.select(*keep, "base", "count", F.posexplode(F.arrays_zip("starts", "ends", "texts")).alias("i", "p")).select(
        *keep, (F.col("count") + F.col("i")).alias("piece"), (F.col("base") + F.col("p.starts")).alias("start_char"), (F.col("base") + F.col("p.ends")).alias("end_char"), F.col("p.texts").alias("piece_text")
    )


def split_long(frame: DataFrame, keys: list[str], text_column: str, limit: int, overlap: int = 120, range_size: int = RANGE) -> DataFrame:
    """keys, ``piece`` (from 0), ``start_char``, ``end_char``, ``piece_text`` of texts above ``limit`` code points.

    Texts within the limit, null and empty texts give no rows; repeated rows are kept
    once; keys may be null; other columns are ignored.  Every text goes range by range;
    what a task of the cutter holds of a text is a range with its halos.
    """
    _check(limit, overlap)
    halo = halo_bytes(limit)
    names = [f"_k{i}" for i in range(len(keys))]
    chosen = frame.filter(F.char_length(text_column) > limit).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.encode(text_column, "UTF-8").alias("_data"))
    # Repeated rows meet by hash, so whole texts are not what is sorted.
    named = chosen.withColumns({"_id": F.sha2(F.concat(F.encode(F.to_json(F.struct(*names)), "UTF-8"), F.col("_data")), 256), "_size": F.octet_length("_data")}).dropDuplicates(["_id"])
    low = F.col("number") * range_size
    at = named.withColumn("number", F.explode(F.sequence(F.lit(0), F.expr(f"(_size - 1) div {range_size}").cast("int")))).withColumn("_base", F.greatest(low - halo, F.lit(0)))
    high = F.least(low + range_size, F.col("_size"))
    windows = at.select(*names, "_id", "number", (F.col("_size") > range_size).alias("more"), "_size", "_base", F.substring(F.col("_data"), F.col("_base") + 1, high + halo - F.col("_base")).alias("_window"))
    many = len(names) + 3

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, size, base, data in zip(*(batch.column(i).to_pylist() for i in (many - 2, many, many + 1, many + 2)), strict=True):
                out.append(range_pieces(data, base, number * range_size, min(size, (number + 1) * range_size), size, limit, overlap))
            yield _found(batch, many, out)

    types = dict(chosen.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in names) + f", _id string, number int, more boolean, {_FOUND}"
    found = cut(windows.mapInArrow(detect, schema))
    return stitched(found, "_id", names).select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), F.col("piece").cast("int").alias("piece"), F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"), "piece_text")


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address (local, hdfs, s3, gs), and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int = 120, range_bytes: int = RANGE) -> DataFrame:
    """``path, piece, start_char, end_char, piece_text`` of UTF-8 files, given by path or address.

    Workers open the files by byte range on the file system of their address; none reads
    more than a range and its halos.  Files of no bytes give no rows; a file within the
    limit gives one piece; a path given twice counts once; the pieces of a file are those
    of ``split_text``.
    """
    _check(limit, overlap)
    halo = halo_bytes(limit)
    sizes = [(p, system.get_file_info(inner).size) for p in sorted(set(paths)) for system, inner in [_system(p)]]
    if any(n is None for _, n in sizes):
        raise FileNotFoundError([p for p, n in sizes if n is None][0])
    files = spark.createDataFrame([(p, n) for p, n in sizes if n], "path string, size long")
    ranges = files.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {range_bytes}")))).select("path", "number", (F.col("size") > range_bytes).alias("more"), "size").repartition("path", "number")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                path, number, _, size = (c[0].as_py() for c in one.columns)
                low, high = number * range_bytes, min(size, (number + 1) * range_bytes)
                base = max(0, low - halo)
                system, inner = _system(path)
                with system.open_input_file(inner) as f:
                    data = f.read_at(min(size, high + halo) - base, base)
                yield _found(one, 3, [range_pieces(data, base, low, high, size, limit, overlap)])

    found = cut(ranges.mapInArrow(detect, f"path string, number long, more boolean, {_FOUND}"))
    return stitched(found, "path", ["path"])


def export_texts(frame: DataFrame, text_column: str, folder: str) -> list[str]:
    """Write the texts of a column as files of UTF-8 lines below ``folder`` (one a partition); their paths.

    Line feeds within a text stay; a text ends with a blank line, a natural boundary.
    """
    frame.filter(F.length(text_column) > 0).select(F.concat(F.col(text_column), F.lit("\n")).alias("value")).write.mode("overwrite").text(folder)
    jvm = frame.sparkSession._jvm.org.apache.hadoop.fs
    root = jvm.Path(folder)
    found = root.getFileSystem(frame.sparkSession._jsc.sc().hadoopConfiguration()).listStatus(root)
    paths = [f.getPath().toString() for f in found if f.getPath().getName().startswith("part-")]
    return sorted(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p for p in paths)
