"""Segmentation, offsets, duplicates and families of documents."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from clausemill.functions import text as T
from clausemill.session import cut


@F.pandas_udf(ArrayType(IntegerType()))
def _running(lengths: pd.Series) -> pd.Series:
    """Where each line begins: the lengths of those before, and a line feed after each."""
    return lengths.map(lambda x: None if x is None else np.concatenate(([0], np.cumsum(np.asarray(x, np.int64) + 1)[:-1])).astype(np.int32))


def segment(documents: DataFrame, id_column: str = "document_id", text_column: str = "normalized_text", normalize: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """``document_id, block_id, kind, text, heading, start_char, end_char``: one block per line that is not blank.

    Narrow: offsets are running sums of the line lengths of the document's own array,
    linear in its lines, and what ``keep`` names is carried along, so nothing is
    shuffled.  Blank lines vanish; lines are joined by one line feed; null and blank
    texts have no blocks.
    """
    keep = keep or {}
    flat = (T.normalize_whitespace if normalize else T.collapse_lines)(F.col(text_column))
    full = F.filter(F.split(flat, "\n"), lambda x: F.length(x) > 0)
    rows = documents.select(F.col(id_column).alias("document_id"), *(c.alias(n) for n, c in keep.items()), full.alias("_lines")).filter(F.size("_lines") > 0)
    starts = _running(F.transform("_lines", lambda x: F.length(x)))
    zipped = rows.select("document_id", *keep, F.posexplode(F.arrays_zip(F.col("_lines").alias("line"), starts.alias("start"))).alias("i", "b"))
    kind = T.classify_line(F.col("b.line"))
    return zipped.select(
        "document_id",
        *keep,
        F.format_string("block-%04d", F.col("i") + 1).alias("block_id"),
        kind.alias("kind"),
        F.col("b.line").alias("text"),
        T.heading_text(F.col("b.line"), kind).alias("heading"),
        F.col("b.start").alias("start_char"),
        (F.col("b.start") + F.length("b.line")).alias("end_char"),
    )


def segment_pages(pages: DataFrame) -> DataFrame:
    """Blocks of documents that come as rows ``document_id, page_number, text``.

    Pages are joined by a blank line, lines within a page by one line feed; blank
    pages vanish; numbering and offsets run over the whole document.
    """
    line = pages.select("document_id", "page_number", F.posexplode(F.split(T.normalize_whitespace(F.col("text")), "\n")).alias("i", "line")).filter(F.length("line") > 0)
    w = W.partitionBy("document_id").orderBy("page_number", "i")
    first = F.row_number().over(W.partitionBy("document_id", "page_number").orderBy("i")) == 1
    lead = F.when(F.lag("line").over(w).isNull(), 0).when(first, 2).otherwise(1)
    end = F.sum(F.col("lead") + F.length("line")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = line.withColumn("first", first).withColumn("lead", lead).withColumn("end_char", end).withColumn("n", F.row_number().over(w))
    kind = T.classify_line(F.col("line"))
    return rows.select("document_id", F.format_string("block-%04d", F.col("n")).alias("block_id"), kind.alias("kind"), F.col("line").alias("text"), "page_number", T.heading_text(F.col("line"), kind).alias("heading"), (F.col("end_char") - F.length("line")).alias("start_char"), "end_char")


def redact_pages(pages: DataFrame) -> DataFrame:
    """``document_id, pages, codes``: redacted texts in page order and the distinct codes, first seen first."""
    rows = pages.select("document_id", "page_number", T.redact(F.col("text")).alias("text"), T.redaction_codes(F.col("text")).alias("codes"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text", "codes")))
    return rows.groupBy("document_id").agg(ordered.alias("p")).select("document_id", F.col("p.text").alias("pages"), F.array_distinct(F.flatten("p.codes")).alias("codes"))


def offset_violations(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks whose text is not what stands at their offsets."""
    joined = blocks.select("document_id", "block_id", "text", "start_char", "end_char").join(documents.select("document_id", "normalized_text"), "document_id")
    there = F.col("normalized_text").substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return joined.filter(there.isNull() | (there != F.col("text"))).select("document_id", "block_id", "start_char", "end_char").distinct()


def exact_duplicates(documents: DataFrame, id_column: str = "document_id", checksum: Column | None = None, order: str | None = None) -> DataFrame:
    """``document_id, duplicate_of``: later documents and the first of the same raw checksum.

    checksum: by default the manifest's (``source.sha256``); the hash of a text makes
    copies of texts out of it.  The least id (or order) wins.  The first is found by an
    aggregate with partial results; joining it back meets one row a checksum, so rows
    of a hot one may be split over tasks as they come.
    """
    checksum = F.col("source.sha256") if checksum is None else checksum
    rows = documents.select(F.col(id_column).alias("document_id"), F.col(order or id_column).alias("o"), checksum.alias("sha")).filter("document_id is not null and sha is not null").distinct()
    first = rows.groupBy("sha").agg(F.min(F.struct("o", "document_id")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first, "sha").filter(F.col("document_id") != F.col("first.document_id")).select("document_id", F.col("first.document_id").alias("duplicate_of"))


#: Tokens in at least this share of texts are common, and at most so many of them are held.
COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 1 / 2000, 6, 200_000
#: Rows whose sets are made together; rows of pairs given out together; most bits of the map of candidates (8 MB).
ROWS, PAIRS, MAP_BITS = 1024, 1 << 16, 1 << 26


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(words: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of every row, repeats kept, and where each row begins.

    Words come as hashes; rows of fewer words have one run of them all, and those without words none.
    """
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(count)))
    if not bounds[-1]:
        return np.zeros(0, np.int64), bounds
    at = np.arange(bounds[-1]) + np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])) - bounds[:-1], count)
    own = np.repeat(np.minimum(n, size), count)
    factors = _mixed(np.arange(1, size + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = own.astype(np.uint64) * factors[size]
    for k in range(size):
        out += np.where(k < own, flat[np.minimum(at + k, len(flat) - 1)] * factors[k], np.uint64(0))
    return _mixed(out).view(np.int64), bounds


def _sets(words: pa.ListArray, size: int) -> Iterator[np.ndarray]:
    """The runs of every row, sorted and each once."""
    for start in range(0, len(words), ROWS):
        flat, bounds = _runs(words.slice(start, ROWS), size)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            x = np.sort(flat[low:high])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Tokens of a batch and how many of its sets hold them, without those too rare to be common; without a token, how many sets there are."""
    for batch in batches:
        tokens, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *_sets(batch.column(0), size)]), return_counts=True)
        keep = counts >= max(2, batch.num_rows * COMMON_SHARE / 2)
        yield pa.RecordBatch.from_arrays([pa.array([None, *tokens[keep].tolist()], pa.int64()), pa.array([batch.num_rows, *counts[keep].tolist()], pa.int64())], names=["token", "n"])


def _common(words: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The common tokens, sorted, and in how many texts each is at least.  They only order the tokens of a set; any order is right.

    Where there are too many, those of the lowest counts stay away: the driver gets a
    histogram of the counts and then the tokens it keeps, never a partition's best.
    """
    counted = words.mapInArrow(lambda it: _counted(it, size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = cut(counted.filter(F.col("token").isNull() | (F.col("n") >= COMMON_LEAST)))
    texts = counted.filter("token is null").agg(F.sum("n")).first()[0] or 0
    often = counted.filter(F.col("token").isNotNull() & (F.col("n") >= max(COMMON_LEAST, texts * COMMON_SHARE)))
    held = 0
    for n, tokens in sorted(map(tuple, often.groupBy("n").count().collect()), reverse=True):
        held += tokens
        if held > COMMON_MOST:
            often = often.filter(F.col("n") > n)
            break
    found = often.toArrow()
    tokens, counts = found.column("token").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float, size: int, tokens: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, node, n, place) of the first n - ceil(t n) + 1 tokens of every set of a batch, copies once."""
    for batch in batches:
        nodes, sizes, places, out, seen = [], [], [], [], set()
        for node, x in zip(batch.column(0).to_pylist(), _sets(batch.column(1), size), strict=True):
            n = len(x)
            if not n or node in seen:
                continue
            seen.add(node)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                often = np.where(tokens[at] == x, counts[at], 0)
            else:
                often = np.zeros(n, np.int64)
            first = x[np.lexsort((x, often))[: ceil_prefix(n, threshold)]]
            nodes.append(np.full(len(first), node))
            sizes.append(np.full(len(first), n, np.int32))
            places.append(np.arange(len(first), dtype=np.int32))
            out.append(first)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out, nodes, sizes, places)], names=["token", "node", "n", "place"])


def _meeting(token: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, threshold: float) -> Iterator[list[np.ndarray]]:
    """Pairs of nodes for each token that they share, and how many they need, from rows sorted by token and node.

    What they share lies in both prefixes, or behind the prefix that ends first: so what
    they need at least, less all that stands behind a prefix, is to be found in the
    prefixes.  Pairs whose sizes, or whose places of a token, leave no chance are left out;
    pairs that reach the threshold meet at every token that their prefixes share.
    """
    once = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
    token, node, n, place = token[once], node[once], n[once].astype(np.int64), place[once]
    behind = np.ceil(n * threshold - 1e-9).astype(np.int64) - 1
    i, step = np.arange(len(token)), 0
    while True:
        step += 1
        i = i[: np.searchsorted(i, len(token) - step)]
        i = i[token[i] == token[i + step]]
        if not len(i):
            return
        j = i + step
        shared = threshold / (1 + threshold) * (n[i] + n[j]) - 1e-6
        fit = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
        fit &= np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= shared
        if fit.any():
            need = np.ceil(shared).astype(np.int64) - np.maximum(behind[i], behind[j])
            yield [node[i[fit]], node[j[fit]], need[fit]]


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b, need of ``_meeting`` and how many tokens they met at, for rows that are sorted by token and node; a token may go over many batches."""
    found, rows = [], 0

    def flush() -> pa.RecordBatch:
        x, y, need = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((y, x))
        x, y, need = x[order], y[order], need[order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        met = np.diff(np.append(first, len(x)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[first], y[first], need[first].astype(np.int32), met.astype(np.int32))], names=["a", "b", "need", "met"])

    held: list[list[np.ndarray]] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            last = np.searchsorted(held[-1][0], held[-1][0][-1])
            if not last and (len(held) == 1 or held[-2][0][-1] == held[-1][0][0]):
                continue  # one token so far
            tail = [c[last:] for c in held[-1]]
            held[-1] = [c[:last] for c in held[-1]]
        elif not held:
            break
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        held = [] if batch is None else [tail]
        for part in _meeting(*whole, threshold):
            found.append(part)
            rows += len(part[0])
            if rows >= PAIRS:
                yield flush()
                found, rows = [], 0
    if rows:
        yield flush()


def _page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of 2^16 bits of a partition that holds all rows (page, bit) of each."""
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        page, bit = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for p in np.unique(page):
            pages.setdefault(int(p), np.zeros(1 << 16, bool))[bit[page == p]] = True
    if pages:
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([np.packbits(x).tobytes() for x in pages.values()], pa.binary())], names=["page", "bits"])


def _among(nodes: DataFrame) -> Callable[[Column], Column]:
    """Whether a node may be one of ``nodes``: a bit map, of bounded size, of their hashes.  Some others pass, none is lost."""
    wide = min(MAP_BITS, max(1 << 16, 1 << (16 * nodes.count()).bit_length()))
    place = lambda node: F.pmod(node, F.lit(wide))
    rows = nodes.select(F.shiftright(place(F.col("node")), 16).cast("int").alias("page"), (place(F.col("node")) % (1 << 16)).cast("int").alias("bit")).distinct()
    found = rows.repartition("page").mapInArrow(_page, "page int, bits binary").toArrow()
    bits = np.zeros((wide >> 16, 1 << 13), np.uint8)
    for page, part in zip(found.column("page").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[page] = np.frombuffer(part, np.uint8)
    bits = bits.ravel()

    @F.pandas_udf(BooleanType())
    def among(node: pd.Series) -> pd.Series:
        at = node.to_numpy() % wide
        return pd.Series((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return among


def _alike(batches: Iterator[pa.RecordBatch], threshold: float, size: int) -> Iterator[pa.RecordBatch]:
    """a, b, similarity of rows a, b and their words, where it reaches the threshold; numpy counts what the sets share."""
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(_sets(batch.column(2), size), _sets(batch.column(3), size), strict=True)):
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            scores[i] = shared / (len(both) - shared)
        keep = scores >= threshold
        if keep.any():
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(scores[keep])], names=["a", "b", "similarity"])


def _texts(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, text, node`` of rows with an id and a text; copies of a text are one node, and so are all blank ones."""
    node = F.when(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id is not null and text is not null").withColumn("node", node)


def _alike_nodes(base: DataFrame, threshold: float, size: int) -> DataFrame:
    """``a, b, similarity``: nodes of different texts that reach the threshold, each pair once."""
    rare, common = _common(base.select(T.word_hashes(F.col("text")).alias("words")), size)
    prefix = base.select("node", T.word_hashes(F.col("text")).alias("words")).mapInArrow(lambda it: _prefixes(it, threshold, size, rare, common), "token long, node long, n int, place int")
    meeting = prefix.repartition("token").sortWithinPartitions("token", "node").mapInArrow(lambda it: _pairs(it, threshold), "a long, b long, need int, met int")
    pairs = cut(meeting.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("met").alias("met")).filter("met >= need").select("a", "b"))
    among = _among(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = base.select("node", "text").filter(among(F.col("node"))).dropDuplicates(["node"])
    x = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    words = x.select("a", "b", T.word_hashes(F.col("ta")).alias("wa"), T.word_hashes(F.col("tb")).alias("wb"))
    return cut(words.mapInArrow(lambda it: _alike(it, threshold, size), "a long, b long, similarity double"))


def _spread(alike: DataFrame, member: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of nodes as pairs of ids, the later first: ``i_`` and ``j_`` of each of ``columns``, and ``similarity``, each row once.

    member: ``node, id, many`` and further columns; many: whether the id has several
    texts.  Only pairs with such an id can come twice, so the others, which may be many
    more than there are ids, leave the last join as they are and are not moved again.
    """
    both = alike.unionByName(member.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("similarity")).distinct())

    def side(key: str, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("node").alias(key), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        out = both.join(side("a", "x", left), "a").join(side("b", "y", right), "b").filter(F.when(F.col("a") == F.col("b"), F.col("x_id") < F.col("y_id")).otherwise(F.col("x_id") != F.col("y_id")))
        later = F.col("x_id") > F.col("y_id")
        return out.select(*(F.when(later, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{n}_{c}") for n, p, q in (("i", "x", "y"), ("j", "y", "x")) for c in columns), "similarity")

    one, many = member.filter("not many"), member.filter("many")
    return met(one, one).unionByName(met(many, member).unionByName(met(one, many)).distinct())


def _members(base: DataFrame) -> DataFrame:
    """``id, node, many`` of every id and text."""
    found = base.groupBy("id").agg(F.collect_set("node").alias("nodes"))
    return found.select("id", F.explode("nodes").alias("node"), (F.size("nodes") > 1).alias("many"))


def near_duplicates(documents: DataFrame, threshold: float = 0.85, size: int = 5, id_column: str = "document_id", text_column: str = "normalized_text") -> DataFrame:
    """``document_id, near_duplicate_of, similarity``: pairs, the later id first, by an inverted index over prefixes.

    Tokens are ordered by hash, the common ones last, from the rarest; two sets that reach the threshold share one
    of their first n - ceil(t n) + 1 tokens, so only those are indexed, and the pairs
    that meet often enough are verified on the whole sets.  Copies of a text are compared once, and
    all blank texts are copies of one another.

    Sets are made anew from the texts in each pass and never written: what is moved is
    the prefixes, once, and the texts of those that meet.
    """
    base = _texts(documents, id_column, text_column)
    found = _spread(_alike_nodes(base, threshold, size), _members(base), ["id"])
    return found.select(F.col("i_id").alias("document_id"), F.col("j_id").alias("near_duplicate_of"), "similarity")


def cross_family_near_duplicates(documents: DataFrame, threshold: float = 0.85, size: int = 5, id_column: str = "document_id", text_column: str = "normalized_text", family: Column | str = "family_id") -> DataFrame:
    """``cross_family`` of the ``near_duplicates``, with the families of the same rows.

    Families go with the ids into the join that makes pairs, so pairs are never moved
    to look families up.  An id of several families has a row for each.
    """
    family = F.col(family) if isinstance(family, str) else family
    base = _texts(documents, id_column, text_column)
    families = documents.select(F.col(id_column).alias("id"), family.alias("family")).filter("id is not null and family is not null").distinct()
    found = _spread(_alike_nodes(base, threshold, size), _members(base).join(families, "id"), ["id", "family"]).filter("i_family <> j_family")
    return found.select(F.col("i_id").alias("document_id"), F.col("i_family").alias("later_family"), F.col("j_id").alias("near_duplicate_of"), F.col("j_family").alias("earlier_family"), "similarity")


def cross_family(pairs: DataFrame, families: DataFrame) -> DataFrame:
    """Near-duplicate pairs whose families differ (families: document_id, family_id)."""
    f = families.select("document_id", "family_id").distinct()
    return (
        pairs.join(f.withColumnRenamed("family_id", "later_family"), "document_id")
        .join(f.select(F.col("document_id").alias("near_duplicate_of"), F.col("family_id").alias("earlier_family")), "near_duplicate_of")
        .filter(F.col("later_family") != F.col("earlier_family"))
        .select("document_id", "later_family", "near_duplicate_of", "earlier_family", "similarity")
    )


def family_groups(manifest: DataFrame) -> DataFrame:
    """``family_id, document_ids``: members and the documents they relate to, distinct and sorted."""
    own = manifest.select("family_id", "document_id")
    related = manifest.select("family_id", F.explode("related_document_ids").alias("document_id"))
    return own.unionByName(related).filter("family_id is not null and document_id is not null").groupBy("family_id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))


def latest_stage(log: DataFrame) -> DataFrame:
    """``document_id, completed_stage``: the last row of the stage log by update time, later logging on ties."""
    return log.groupBy("document_id").agg(F.max_by("completed_stage", F.struct("updated_at", "logged_at", "completed_stage")).alias("completed_stage"))


def unfinished(manifest: DataFrame, log: DataFrame, last: str = "exported") -> DataFrame:
    """Manifest rows without the last stage: what a resumed run has to do."""
    done = log.filter(F.col("completed_stage") == last).select("document_id").distinct()
    return manifest.join(done, "document_id", "left_anti")


def ceil_prefix(n: int, threshold: float) -> int:
    """Tokens of a set of n that have to be indexed."""
    return n - math.ceil(n * threshold - 1e-9) + 1
