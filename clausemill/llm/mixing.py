"""Mixing sources to target weights of tokens.

Stored sources are read without regard to case, hyphens, underscores and blanks.  Every
record has a soft membership: a naive Bayes classifier over hashed words, fitted on a
bounded sample of labelled rows, gives its text's likelihood under each domain, weighted
as calibration on a held-out half of the sample says, and the stored source is one more
feature, right with probability ``LABEL_TRUST``.  Document
rates are then fitted by projected gradient descent on the squared distance of the
domains' expected tokens from their targets; a rate lies between 0 and the record's most
repeats.  A step is one pass that returns a sum a domain, until the targets are met or
the projected gradient vanishes; the residual is reported.  Rates become copies by error
diffusion over tokens within salted shards of a source, from the largest record down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.llm import kernel as K, tokens as T
from clausemill.session import cut

#: Bound of the labelled sample (rows, and characters of each) the classifier is fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 4000
CELLS = 1 << 13
#: Probability that a stored source is the domain of its record, as a feature beside the text.
LABEL_TRUST = 0.995
#: Weights of the text's evidence that calibration tries.
WEIGHTS = (0.0, 0.03, 0.06, 0.12, 0.25, 0.5, 1.0, 2.0)
#: Steps of the descent at most, and the relative error and gradient at which it has converged.
STEPS, CONVERGED, FLAT = 60, 5e-4, 1e-4
#: Sources that the target table may have at most; it is collected.
MOST_SOURCES = 10_000
SHARD_ROWS = 20_000


def source_key(column: str):
    folded = F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "-")
    return F.when(F.length(folded) > 0, folded)


class Classifier:
    """Naive Bayes over hashed words, tempered by length."""

    def __init__(self, sources: list[str]):
        self.sources = sources
        self.counts = np.zeros((len(sources), CELLS))
        self.rows = np.zeros(len(sources))
        #: How much the text's evidence counts.
        self.weight = 1.0

    def fit(self, texts: list[str], labels: list[int]) -> Classifier:
        for cells, sizes, rows in _cells(pa.array(texts, pa.string())):
            owner = np.repeat(np.array([labels[r] for r in rows]), sizes)
            np.add.at(self.counts, (owner, cells), 1)
        for label in labels:
            self.rows[label] += 1
        totals = self.counts.sum(axis=1, keepdims=True)
        shared = (self.counts.sum(axis=0) + 1) / (self.counts.sum() + CELLS)
        self.log = np.log((self.counts + 500 * shared) / (totals + 500))
        self.log_of = np.ascontiguousarray(self.log.T)
        self.prior = np.log((self.rows + 1) / (self.rows.sum() + len(self.sources)))
        return self

    @classmethod
    def calibrated(cls, sources: list[str], texts: list[str], labels: list[int]) -> Classifier:
        """Fitted on the sample; the weight of the evidence is the one that tells the labels of its second half best from the first.

        Where texts say nothing about their sources, it comes out near 0.
        """
        model, half = cls(sources).fit(texts, labels), len(texts) // 2
        if half and len(sources) > 1:
            first = cls(sources).fit(texts[:half], labels[:half])
            unseen, right = pa.array(texts[half:], pa.string()), np.array(labels[half:])
            told = {}
            for first.weight in WEIGHTS:
                p = first.posterior(unseen, np.full(len(right), -1))
                told[first.weight] = float(np.log(np.maximum(p[np.arange(len(right)), right], 1e-12)).mean())
            model.weight = max(WEIGHTS, key=lambda w: told[w])
        return model

    def posterior(self, texts: pa.Array, labels: np.ndarray, trust: float = LABEL_TRUST) -> np.ndarray:
        """Domains of texts with stored labels (-1 for none)."""
        out = np.tile(self.prior, (len(texts), 1))
        known, n = np.flatnonzero(labels >= 0), len(self.sources)
        if n > 1:
            out[known] += math.log((1 - trust) / (n - 1))
            out[known, labels[known]] += math.log(trust) - math.log((1 - trust) / (n - 1))
        for cells, sizes, rows in _cells(texts):
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for i, r in enumerate(rows):
                own = cells[starts[i] : starts[i + 1]]
                if len(own):
                    out[r] += self.weight * self.log_of[own].sum(axis=0) / math.sqrt(len(own))
        out -= out.max(axis=1, keepdims=True)
        p = np.exp(out)
        return p / p.sum(axis=1, keepdims=True)


def _cells(texts: pa.Array):
    for row, data, offsets in K.chunks(texts, K.fold_alnum):
        words, bounds = K.word_hashes(data, offsets, K.ALNUM_WORDS)
        yield (words % np.uint64(CELLS)).astype(np.int64), np.diff(bounds), range(row, row + len(bounds) - 1)


def prepared(documents: DataFrame, targets: DataFrame, vocabulary: str = T.VOCABULARY) -> tuple[DataFrame, list]:
    """(``doc_id, source, tokens, domain, cap, p``, the target rows); domain is -1 without a known source."""
    goals = targets.filter("source is not null and target_share > 0").groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} target sources")
    names = [g.source for g in goals]
    spark = documents.sparkSession
    numbered = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, domain int")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source_key("source").alias("source")).filter("doc_id is not null and text is not null and text <> ''")
    base = base.join(F.broadcast(numbered), "source", "left").withColumn("domain", F.coalesce("domain", F.lit(-1)))
    labelled = base.filter("domain >= 0").select("domain", F.substring("text", 1, SAMPLE_CHARS).alias("text"), F.xxhash64("doc_id", F.lit(3)).alias("h"))
    # Rows under a hash threshold are about as many as wanted, so few texts are moved; the bound is exact.
    share = min(1.0, 2.0 * SAMPLE_ROWS / max(1, documents.count()))
    sample = labelled.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).orderBy("h").limit(SAMPLE_ROWS).toArrow()
    model = Classifier.calibrated(names, sample.column("text").to_pylist(), sample.column("domain").to_pylist())
    most = np.array([max(0, g.most or 0) for g in goals], np.int64)
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = T.encoding(vocabulary)
        for batch in batches:
            domain = batch.column(3).to_numpy(zero_copy_only=False)
            known = domain >= 0
            p = model.posterior(batch.column(1), domain) if size else np.zeros((len(domain), 0))
            cap = np.where(known, most[np.maximum(domain, 0)], most[p.argmax(axis=1)]) if size else np.zeros(len(domain), np.int64)
            sizes = [len(coder.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), batch.column(3).cast(pa.int32()), pa.array(cap.astype(np.int32)), pa.ListArray.from_arrays(np.arange(len(domain) + 1, dtype=np.int32) * size, pa.array(p.reshape(-1).astype(np.float32)))],
                names=["doc_id", "source", "tokens", "domain", "cap", "p"],
            )

    rows = base.select("doc_id", "text", "source", "domain").mapInArrow(run, "doc_id long, source string, tokens long, domain int, cap int, p array<float>")
    rows = rows.filter("tokens > 0").dropDuplicates(["doc_id"])
    return cut(rows), goals


def _diffused(table: pa.Table) -> pa.Table:
    """Whole copies of a shard's records, the largest first: what a record gets too much or too little is owed by the next."""
    table = table.combine_chunks().sort_by([("tokens", "descending"), ("doc_id", "ascending")])
    sizes, rates, caps = table.column("tokens").to_pylist(), table.column("rate").to_pylist(), table.column("cap").to_pylist()
    copies, owed = [], 0.0
    for size, rate, cap in zip(sizes, rates, caps, strict=True):
        owed += rate * size
        n = max(0, min(cap, math.floor(owed / size + 0.5)))
        owed -= n * size
        copies.append(n)
    found = table.append_column("copies", pa.array(copies, pa.int32()))
    return found.filter(pa.array([n > 0 for n in copies])).select(["doc_id", "source", "domain", "tokens", "copies", "p"])


def _dense(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, size).astype(float)


def _rates(p: np.ndarray, cap: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far, each projected on 0 to cap; rows need nothing of each other."""
    rate = np.clip(p @ start, 0.0, cap)
    for step in steps:
        rate = np.clip(rate - p @ step, 0.0, cap)
    return rate


def _sums(rows: DataFrame, size: int, rate) -> np.ndarray:
    """Expected tokens a domain of the rates ``rate(p, cap)``; one row a batch leaves the workers' passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                p, cap = _dense(batch.column(2), size), batch.column(1).to_numpy().astype(float)
                total += (rate(p, cap) * batch.column(0).to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["d", "x"])

    found = rows.select("tokens", "cap", "p").mapInArrow(run, "d int, x double").groupBy("d").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in found:
        out[r.d] = r.x
    return out


def fitted(rows: DataFrame, goal: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float]:
    """(start, steps, relative residual) of the descent that brings the domains' expected tokens to the goal."""
    size = len(goal)
    scale = np.maximum(_sums(rows, size, lambda p, cap: np.ones(len(cap))), 1e-9)
    start, steps, total = np.clip(goal / scale, 0, None), [], max(1.0, float(goal.sum()))
    best, last = (math.inf, 0), None
    while True:
        now = _sums(rows, size, lambda p, cap, held=list(steps): _rates(p, cap, start, held))
        gap = now - goal
        error = float(np.abs(gap).sum() / total)
        if error < best[0]:
            best = (error, len(steps))
        # Where rates lie at their bounds sums no longer move: the projected gradient is flat.
        still = last is not None and float(np.abs(now - last).sum()) < FLAT * total
        if error < CONVERGED or still or len(steps) == STEPS:
            return start, steps[: best[1]], best[0]
        last = now
        steps.append(gap / scale)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = T.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, domain, tokens, copies``, the report).

    The report has ``source, target_share, share, stored_share, tokens, records,
    residual``: share and tokens are expected ones by soft membership, stored_share counts
    records whole for their stored source (the likeliest domain where it is none), and
    residual is the fit's distance from all targets, relative to the size.

    total_tokens: size of the mixture; by default the largest at which every target
    can be met within the repeats.  A larger one is met as far as they allow.  Null and
    empty texts take no part; a record counts once however often it is delivered;
    without targets nothing is mixed.
    """
    rows, goals = prepared(documents, targets, vocabulary)
    names = [g.source for g in goals]
    shares = np.array([g.share for g in goals], float)
    size = len(goals)
    spark = documents.sparkSession
    if not size or not shares.sum():
        empty = rows.select("doc_id", "source", F.col("source").alias("domain"), "tokens", F.lit(0).alias("copies")).filter("false")
        return empty, spark.createDataFrame([], "source string, target_share double, share double, stored_share double, tokens long, records long, residual double")
    shares = shares / shares.sum()
    if total_tokens is None:
        reach = _sums(rows, size, lambda p, cap: cap)
        total = min((reach[d] / shares[d] for d in range(size) if shares[d] > 0), default=0.0)
    else:
        total = float(total_tokens)
    start, steps, residual = fitted(rows, shares * total)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _dense(batch.column(5), size)
            rate = _rates(p, batch.column(4).to_numpy().astype(float), start, steps)
            stored = batch.column(3).to_numpy()
            domain = np.where(stored >= 0, stored, p.argmax(axis=1)) if len(p) else stored
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(domain.astype(np.int32)), *batch.columns[4:], pa.array(rate)], names=["doc_id", "source", "tokens", "domain", "cap", "p", "rate"])

    state = cut(rows.select("doc_id", "source", "tokens", "domain", "cap", "p").mapInArrow(rated, "doc_id long, source string, tokens long, domain int, cap int, p array<float>, rate double").filter("rate > 0"))
    shards = max(1, math.ceil(state.count() / SHARD_ROWS))
    placed = state.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)))
    chosen = cut(placed.groupBy("domain", "shard").applyInArrow(_diffused, "doc_id long, source string, domain int, tokens long, copies int, p array<float>"))
    copied = chosen.select((F.col("tokens") * F.col("copies")).alias("tokens"), F.lit(1).alias("cap"), "p")
    expected = _sums(copied, size, lambda p, cap: np.ones(len(cap)))
    used = {r.domain: r for r in chosen.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records")).collect()}
    everything = max(1.0, float(expected.sum()))
    report = spark.createDataFrame(
        [(n, float(shares[d]), round(float(expected[d]) / everything, 6), round((used[d].tokens if d in used else 0) / everything, 6), int(round(expected[d])), used[d].records if d in used else 0, round(residual, 6)) for d, n in enumerate(names)],
        "source string, target_share double, share double, stored_share double, tokens long, records long, residual double",
    )
    named = spark.createDataFrame([(d, n) for d, n in enumerate(names)], "domain int, name string")
    out = chosen.join(F.broadcast(named), "domain").select("doc_id", "source", F.col("name").alias("domain"), "tokens", "copies")
    return out, report
