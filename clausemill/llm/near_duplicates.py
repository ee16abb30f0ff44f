"""Near-duplicate groups by universe partition and pigeonhole.

Two sets with Jaccard similarity of at least t differ in at most
H = (1 - t) / (1 + t) * (|X| + |Y|) tokens.  The token universe is cut by hash into
m segments per size band.  If the larger set Y picks segments of its own whose
values add up to H + 1, at least one of them must meet X:

* an exact segment has value 1: a miss costs one differing token at least;
* a segment with its one-deletion neighbourhood has value 2.

Every set indexes all of its segments (and the neighbourhoods of a few positions)
in its own band and probes the band below.  Which segments a set picks is decided
by cost: document counts of frequent tokens, gathered over all documents, make
segments of nothing but frequent tokens expensive, and these are left out as long
as the others reach H + 1; segments of many tokens come before those of one.  With
picks worth H + c a similar pair meets c times at least, and a small histogram of
each candidate's tokens bounds the differing tokens from below; both thin the candidates.
What is left is verified exactly on the whole texts.

Signatures travel packed, five bytes each, one row per document and bucket, so the
shuffle is smaller than the text.  Signatures of frequent tokens only never enter a
bucket, and runs of one signature longer than ``RUN`` leave it; both become rows that
a distributed join pairs, without a cap.  So no bucket grows with one signature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausemill.llm import kernel as K
from clausemill.llm.components import block_join, class_pairs, components
from clausemill.session import cut

U64 = np.uint64
#: Tokens in at least this share of documents count as frequent; so there are at most (mean set size / share) of them.
FREQUENT_SHARE = 1 / 2000
FREQUENT_LEAST = 6
FREQUENT_MOST = 200_000
#: Picks beyond H, so many times a pair must meet (at most 3, two bits).
SPARE = 3
#: Positions whose one-deletion neighbourhoods are indexed.
NEIGHBOURHOODS = 6
#: Signatures a bucket is sized for, and the longest run paired inside a bucket.
BUCKET_SIGNATURES = 3_000_000
RUN = 256
#: A signature whose tokens all lie in more documents than this may be met by so many
#: that it is kept out of the buckets and joined as rows.
HOT_DOCUMENTS = 100_000
#: Bits of the candidate filter at least and at most (2 MB and 64 MB as broadcast).
FILTER_BITS = (1 << 24, 1 << 29)
_HASH_BITS = U64(38)
#: Bits of a segment's number in the keys of a chunk; a chunk has far fewer texts than the other bits count.
SEGMENT_BITS = 36
#: Cells of the token histogram, four bits each.
CELLS = 128


def differing(size: np.ndarray, other: np.ndarray, t: float) -> np.ndarray:
    """Most tokens by which sets of these sizes may differ."""
    return np.floor((1 - t) / (1 + t) * (size + other) + 1e-9).astype(np.int64)


def segments_of_band(band: int, t: float) -> int:
    """Segments so that a set that probes the band has H + 1 non-empty ones, six deviations over."""
    top = 2 ** (band + 1) - 1
    if top < 64:
        return 1 << 20
    y = int(top / t) + 1
    need = int(differing(np.array([y]), np.array([top]), t)[0]) + 1
    m = max(need, 8)
    while True:
        empty = math.exp(-y / m)
        spread = math.sqrt(max(m * (empty - (1 + y / m) * empty * empty), 0.0))
        if m * (1 - empty) - 6 * spread >= need:
            return m
        m = int(m * 1.03) + 1


def _frequent_counts(batches: Iterator[pa.RecordBatch], size: int, share: float) -> Iterator[pa.RecordBatch]:
    """(what, token, n): 0 counts of a token, 1 all tokens, 2 all documents."""
    for batch in batches:
        parts, docs, total = [], batch.num_rows, 0
        for _, tokens, _ in K.shingle_sets(batch.column(0), size):
            parts.append(tokens)
            total += len(tokens)
        tokens, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
        keep = counts >= max(2, docs * share / 2)
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.zeros(n, np.int32), np.array([1, 2], np.int32))), pa.array(np.append(tokens[keep].view(np.int64), [0, 0])), pa.array(np.append(counts[keep].astype(np.int64), [total, docs]))], names=["what", "token", "n"]
        )


def frequent_tokens(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Frequent tokens with their document counts, over all texts; all tokens; all documents.  One scan."""
    counted = cut(texts.mapInArrow(lambda it: _frequent_counts(it, size, FREQUENT_SHARE), "what int, token long, n long").groupBy("what", "token").agg(F.sum("n").alias("n")))
    sums = {r.what: r.n for r in counted.filter("what > 0").collect()}
    total, documents = sums.get(1, 0), sums.get(2, 0)
    least = max(FREQUENT_LEAST, documents * FREQUENT_SHARE)
    rows = counted.filter((F.col("what") == 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).toArrow()
    tokens, counts = rows.column("token").to_numpy().view(U64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order], total, documents


class _Signer:
    """Turns sets into (document, signature, role, picked) arrays."""

    def __init__(self, t: float, hot: np.ndarray, hot_counts: np.ndarray):
        self.t, self.hot, self.counts = t, hot, hot_counts
        self._m: dict[int, int] = {}

    def _segments(self, band: np.ndarray) -> np.ndarray:
        """Segments of each band, of sets of any size."""
        for b in np.unique(band).tolist():
            if b not in self._m:
                self._m[b] = segments_of_band(b, self.t)
        return np.array([self._m[b] for b in band.tolist()], np.int64)

    def _one_band(self, tokens: np.ndarray, cost: np.ndarray, offsets: np.ndarray, docs: np.ndarray, band: np.ndarray, own: bool):
        """docs: rows to sign; band: the band of each, by whose universe it is cut."""
        sizes = (offsets[1:] - offsets[:-1])[docs]
        keep = np.zeros(len(offsets) - 1, bool)
        keep[docs] = True
        token_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        chosen = keep[token_doc]
        x, price = tokens[chosen], cost[chosen]
        local = np.cumsum(keep) - 1
        d = local[token_doc[chosen]]
        m = self._segments(band)
        segment = ((x * U64(0x9FB21C651E98DF25)) >> U64(16)).astype(np.int64) % m[d]
        # Slots of the segments that are used, in order of document and segment.
        key = (d << SEGMENT_BITS) + segment
        slots, slot = np.unique(key, return_inverse=True)
        slot_doc, slot_segment = slots >> SEGMENT_BITS, slots & ((1 << SEGMENT_BITS) - 1)
        mixed = K.mix(x ^ U64(0x2545F4914F6CDD1D))
        sums = np.zeros(len(slots), U64)
        np.add.at(sums, slot, mixed)
        members = np.bincount(slot, minlength=len(slots))
        price_of = np.full(len(slots), np.iinfo(np.int64).max)
        np.minimum.at(price_of, slot, price)
        salt = (band[slot_doc].astype(U64) << U64(32)) + slot_segment.astype(U64) + U64(1)
        salt = K.mix(salt * U64(0x9E3779B97F4A7C15))
        other = np.minimum(sizes, 2 ** (band + 1) - 1)
        most = differing(sizes, other, self.t)
        value = np.ones(len(slots), np.int64)
        # Cheap segments first, those of many tokens before others; expensive ones only up to H + 1.
        order = np.argsort((slot_doc << 40) | (np.minimum(price_of, 1 << 31) << 8) | (255 - np.minimum(members, 255)), kind="stable")
        bounds = np.searchsorted(slot_doc, np.arange(len(docs) + 1))
        rank = np.empty(len(slots), np.int64)
        rank[order] = np.arange(len(slots)) - bounds[slot_doc[order]]
        cheap = np.bincount(slot_doc[price_of == 0], minlength=len(docs))
        spare = np.clip(cheap - most, 1, SPARE)
        picked = rank < (most + spare)[slot_doc]
        short = np.zeros(len(docs), bool)
        for i in np.flatnonzero(np.diff(bounds) < most + 1):
            # Too few segments: the neighbourhoods of some count twice.
            have = int(bounds[i + 1] - bounds[i])
            for s in range(bounds[i], bounds[i + 1]):
                if have <= most[i] and slot_segment[s] < NEIGHBOURHOODS and members[s] > 1:
                    value[s], have = 2, have + 1
            short[i] = have <= most[i]
        exact = K.mix(sums + salt)
        near = (slot_segment[slot] < NEIGHBOURHOODS) & (members[slot] > 1) & (np.ones(len(slot), bool) if own else value[slot] == 2)
        cut_sig = K.mix(sums[slot[near]] - mixed[near] + salt[slot[near]])
        # A cut set is as frequent as the rarest token that is left in it.
        near_slot, near_price = slot[near], price[near]
        by = np.lexsort((near_price, near_slot))
        lead = np.ones(len(by), bool)
        lead[1:] = near_slot[by][1:] != near_slot[by][:-1]
        second = np.zeros(len(slots), np.int64)
        follow = np.flatnonzero(lead[:-1] & ~lead[1:]) + 1
        second[near_slot[by][follow]] = near_price[by][follow]
        cut_price = np.empty(len(by), np.int64)
        cut_price[by] = np.where(lead, second[near_slot[by]], price_of[near_slot[by]])
        emit = np.ones(len(slots), bool) if own else picked
        hot = np.concatenate((price_of[emit], cut_price)) > HOT_DOCUMENTS
        doc = docs[np.concatenate((slot_doc[emit], slot_doc[slot[near]]))]
        sig = np.concatenate((exact[emit], cut_sig))
        flag = np.concatenate((picked[emit], value[slot[near]] == 2))
        return doc, sig, flag, hot, docs[short], spare

    def sign(self, tokens: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        cost = np.zeros(len(tokens), np.int64)
        if len(self.hot) and len(tokens):
            at = np.minimum(np.searchsorted(self.hot, tokens), len(self.hot) - 1)
            cost = np.where(self.hot[at] == tokens, self.counts[at], 0)
        docs = np.flatnonzero(sizes > 0)
        band = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        out = []
        doc, sig, flag, hot, short, spare = self._one_band(tokens, cost, offsets, docs, band[docs], True)
        least = np.ones(len(sizes), np.int64)
        least[docs] = spare
        out.append((doc, sig, np.ones(len(doc), bool), flag, hot))
        # A smaller partner may lie one band below (t of 0.5 or more).
        low = docs[(band[docs] > 0) & (np.ceil(sizes[docs] * self.t - 1e-9) < 2 ** band[docs])]
        if len(low):
            doc, sig, flag, hot, more, spare = self._one_band(tokens, cost, offsets, low, band[low] - 1, False)
            least[low] = np.minimum(least[low], spare)
            out.append((doc, sig, np.zeros(len(doc), bool), flag, hot))
            short = np.union1d(short, more)
        return *(np.concatenate(x) for x in zip(*out, strict=True)), short, least


def _histograms(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens by hash cell and text, at most 15, two cells a byte."""
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n), np.diff(offsets)) * CELLS + ((tokens * U64(0xC2B2AE3D27D4EB4F)) >> U64(57)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=n * CELLS), 15).astype(np.uint8).reshape(n, CELLS)
    return counts[:, 0::2] | (counts[:, 1::2] << 4)


def _near_enough(histograms: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """False where the histograms alone show more differing tokens than similar sets may have."""
    out = np.ones(len(a), bool)
    for start in range(0, len(a), 65536):
        i, j = a[start : start + 65536], b[start : start + 65536]
        x, y = histograms[i], histograms[j]
        low = np.abs((x & 15).astype(np.int8) - (y & 15).astype(np.int8)).sum(axis=1, dtype=np.int64)
        high = np.abs((x >> 4).astype(np.int8) - (y >> 4).astype(np.int8)).sum(axis=1, dtype=np.int64)
        out[start : start + 65536] = low + high <= differing(sizes[i], sizes[j], t)
    return out


def _packed(signatures: np.ndarray, own: np.ndarray, picked: np.ndarray) -> np.ndarray:
    low = (signatures >> (U64(64) - _HASH_BITS)) << U64(2)
    return low | (own.astype(U64) << U64(1)) | picked.astype(U64)


def _hot_rows(doc: np.ndarray, sig: np.ndarray, own: np.ndarray, picked: np.ndarray, nodes: np.ndarray, fact: np.ndarray) -> pa.RecordBatch:
    """Rows of bucket -2: a document's hot signatures, eight bytes each, the last two bits for its role."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    data = ((sig & ~U64(3)) | (own.astype(U64) << U64(1)) | picked.astype(U64))[order]
    begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    blobs = [data[a:b].tobytes() for a, b in zip(begins, np.append(begins[1:], len(doc)), strict=True)]
    of = doc[begins]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(of), -2, np.int32)), pa.array(nodes[of].astype(np.int64)), pa.array(fact[of].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "node", "size", "sigs"]
    )


def _hot_members(table: pa.Table) -> pa.Table:
    blobs = table.column("sigs").to_pylist()
    sizes = np.array([len(b) // 8 for b in blobs])
    data = np.frombuffer(b"".join(blobs), np.uint64)
    node, fact = np.repeat(table.column("node").to_numpy(), sizes), np.repeat(table.column("size").to_numpy(), sizes)
    return pa.Table.from_pydict({"kind": pa.array(1 + (data & U64(3)).astype(np.int32)), "a": pa.array((data >> U64(2)).view(np.int64)), "b": pa.array(node), "size": pa.array(fact.astype(np.int32))})


def _cell_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """node, size, cells of every text."""
    for batch in batches:
        for row, tokens, offsets in K.shingle_sets(batch.column(1), size):
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(offsets).astype(np.int32)), pa.array([x.tobytes() for x in _histograms(tokens, offsets)], pa.binary())], names=["node", "size", "cells"])


def _thin_rows(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, CELLS // 2) for i in (3, 5))
        sizes = np.concatenate((batch.column(2).to_numpy(), batch.column(4).to_numpy())).astype(np.int64)
        at = np.arange(batch.num_rows)
        keep = pa.array(_near_enough(np.concatenate((x, y)), sizes, at, at + batch.num_rows, t))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _thinned(nodes: DataFrame, pairs: DataFrame, size: int, t: float) -> DataFrame:
    """Candidates that the histograms of their texts leave possible."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    cells = cut(within(nodes.select("node", "text"), "node", members, 2 * pairs.count()).mapInArrow(lambda it: _cell_rows(it, size), "node long, size int, cells binary").dropDuplicates(["node"]))
    joined = (
        pairs.join(cells.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("cells").alias("ca")), "a")
        .join(cells.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("cells").alias("cb")), "b")
        .select("a", "b", "na", "ca", "nb", "cb")
    )
    return cut(joined.mapInArrow(lambda it: _thin_rows(it, t), "a long, b long"))


def _signature_rows(batches: Iterator[pa.RecordBatch], signer: _Signer, size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, node, size, sigs); a document that reaches no guarantee comes as bucket -1.

    Copies met again in the same task are left out before the shuffle.
    """
    met: set[int] = set()
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        fresh = np.zeros(len(nodes), bool)
        for i, node in enumerate(nodes.tolist()):
            if node not in met:
                met.add(node)
                fresh[i] = True
        if len(met) > 2_000_000:
            met.clear()
        batch = batch.filter(pa.array(fresh))
        nodes = nodes[fresh]
        for row, tokens, offsets in K.shingle_sets(batch.column(1), size):
            sizes = np.diff(offsets)
            doc, sig, own, picked, hot, short, least = signer.sign(tokens, offsets)
            fact = (sizes << 2) | least
            if hot.any():
                yield _hot_rows(doc[hot], sig[hot], own[hot], picked[hot], nodes[row:], fact)
                doc, sig, own, picked = doc[~hot], sig[~hot], own[~hot], picked[~hot]
            bucket = ((sig & U64(0xFFFFFF)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket * len(sizes) + doc, kind="stable")
            key = (bucket * len(sizes) + doc)[order]
            data = np.ascontiguousarray(_packed(sig, own, picked)[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(begins[1:], len(key)).astype(np.int64) if len(key) else begins
            blobs = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((np.append(begins, ends[-1:] if len(ends) else 0) * 5).astype(np.int32)), pa.py_buffer(data)])
            row_doc = key[begins] % len(sizes) if len(key) else begins
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((key[begins] // len(sizes), np.full(len(short), -1))).astype(np.int32)),
                    pa.array(np.concatenate((nodes[row + row_doc], nodes[row + short])).astype(np.int64)),
                    pa.array(np.concatenate((fact[row_doc], fact[short])).astype(np.int32)),
                    pa.concat_arrays([blobs, pa.array([b""] * len(short), pa.binary())]),
                ],
                names=["bucket", "node", "size", "sigs"],
            )


def _pairs_of(signature: np.ndarray, member: np.ndarray, size: np.ndarray, own: np.ndarray, picked: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as members' numbers) and how often they meet within runs of one signature; arrays are sorted by signature."""
    found = []
    step = 1
    while step < len(signature):
        same = np.flatnonzero(signature[step:] == signature[:-step])
        if not len(same):
            break
        i, j = same, same + step
        large = np.maximum(size[i], size[j])
        good = (own[i] | own[j]) & (np.minimum(size[i], size[j]) >= t * large - 1e-9) & (member[i] != member[j])
        good &= (picked[i] & (size[i] == large)) | (picked[j] & (size[j] == large))
        i, j = member[i[good]], member[j[good]]
        found.append((np.minimum(i, j).astype(np.int64) << 32) | np.maximum(i, j))
        step += 1
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket_pairs(table: pa.Table, t: float) -> pa.Table:
    """kind 0: candidate nodes a, b, size: times they meet << 2 | times they must.
    kind 1 to 4: member of a long run: signature a, node b, size: its size << 2 | times it must meet."""
    table = table.combine_chunks()
    none = {"kind": [], "a": [], "b": [], "size": []}
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32())])
    blobs = table.column("sigs").combine_chunks()
    if isinstance(blobs, pa.ChunkedArray):
        blobs = pa.concat_arrays(blobs.chunks)
    nodes, sizes = table.column("node").to_numpy(), table.column("size").to_numpy()
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    raw = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    packed = wide.reshape(-1).view("<u8")
    bucket = int(table.column("bucket")[0].as_py())
    # Rows of copies of one text count once.
    unique, first, row_node = np.unique(nodes, return_index=True, return_inverse=True)
    counted = np.zeros(len(nodes), bool)
    counted[first] = True
    per_row = np.diff(offsets) // 5
    keep = np.repeat(counted, per_row)
    member = np.repeat(row_node, per_row)[keep].astype(np.int64)
    packed = packed[keep]
    order = np.argsort(packed, kind="stable")
    packed, member = packed[order], member[order]
    signature = packed >> U64(2)
    # Most signatures stand alone; drop them at once.
    again = np.zeros(len(signature), bool)
    if len(signature) > 1:
        equal = signature[1:] == signature[:-1]
        again[1:] |= equal
        again[:-1] |= equal
    signature, packed, member = signature[again], packed[again], member[again]
    if not len(signature):
        return pa.Table.from_pydict(none, schema=schema)
    starts = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
    lengths = np.diff(np.append(starts, len(signature)))
    useful = np.repeat(np.maximum.reduceat(packed & U64(1), starts) > 0, lengths)
    long = np.repeat(lengths > RUN, lengths) & useful
    node_fact = sizes[first].astype(np.int64)
    node_size = node_fact >> 2
    picked, own = (packed & U64(1)).astype(bool), (packed & U64(2)).astype(bool)
    short = ~long & useful
    pairs, times = _pairs_of(signature[short], member[short], node_size[member[short]], own[short], picked[short], t)
    x, y = pairs >> 32, pairs & 0xFFFFFFFF
    need = np.minimum(node_fact[x] & 3, node_fact[y] & 3)
    parts = [pa.Table.from_pydict({"kind": np.zeros(len(pairs), np.int32), "a": unique[pairs >> 32], "b": unique[pairs & 0xFFFFFFFF], "size": ((times << 2) | need).astype(np.int32)}, schema=schema)]
    if long.any():
        bits = (packed[long] & U64(3)).astype(np.int32)
        name = K.mix(signature[long] * U64(2654435761) + U64(bucket)).view(np.int64)
        parts.append(pa.Table.from_pydict({"kind": 1 + bits, "a": name, "b": unique[member[long]], "size": node_fact[member[long]].astype(np.int32)}, schema=schema))
    return pa.concat_tables(parts)


def _verify(batches: Iterator[pa.RecordBatch], size: int, t: float) -> Iterator[pa.RecordBatch]:
    """Rows a, b, text_a, text_b whose exact similarity reaches t."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            sides = []
            for column in (2, 3):
                sets: list[np.ndarray] = []
                for _, tokens, offsets in K.shingle_sets(part.column(column), size):
                    sets += [tokens[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
                sides.append(sets)
            scores = np.array([K.jaccard(x, y) for x, y in zip(*sides, strict=True)])
            keep = scores >= t - 1e-12
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep)), pa.array(scores[keep])], names=["a", "b", "similarity"]
                )


def within(frame: DataFrame, key: str, members: DataFrame, count: int) -> DataFrame:
    """Rows of ``frame`` whose 64-bit ``key`` may be in ``members.key``: a bitmap of bounded size is broadcast.

    Keeps every member; others pass with a probability of about count / bits.
    """
    bits = FILTER_BITS[0]
    while bits < FILTER_BITS[1] and bits < 8 * count:
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = members.select(place(F.col("key")).alias("at")).groupBy(F.expr("at div 32768").alias("block")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bitmap"))
    at = place(F.col(key))
    tested = frame.withColumn("_at", at).join(F.broadcast(maps), F.expr("_at div 32768") == F.col("block"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast((_at % 32768) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return tested.filter(byte.bitwiseAND(F.expr("cast(pow(2, _at % 8) as int)")) != 0).drop("_at", "block", "bitmap")


def _prefix_rows(batches: Iterator[pa.RecordBatch], size: int, t: float, allowed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(token, node) of the first n - ceil(t n) + 1 tokens of every set, those whose bit is set in ``allowed``."""
    for batch in batches:
        ids = batch.column(0)
        for row, tokens, offsets in K.shingle_sets(batch.column(1), size):
            sizes = np.diff(offsets)
            place = np.arange(len(tokens)) - np.repeat(offsets[:-1], sizes)
            keep = place < np.repeat(sizes - np.ceil(sizes * t - 1e-9).astype(np.int64) + 1, sizes)
            if allowed is not None:
                keep &= ((allowed[(tokens >> U64(43)).astype(np.int64)] >> ((tokens >> U64(40)) & U64(7)).astype(np.uint8)) & 1).astype(bool)
            of = np.repeat(np.arange(len(sizes)), sizes)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), ids.take(pa.array(row + of))], names=["token", "node"])


def _against_all(nodes: DataFrame, short: DataFrame, size: int, t: float) -> DataFrame | None:
    """Candidates ``a, b`` of the sets whose segments reach no guarantee, against all rows: similar sets share one of their first tokens in hash order.

    The tokens of the short sets are a table; a bitmap of them (2 MB whatever their
    number) keeps other tokens out of the scan of all rows, and the rest is joined.
    """
    if short.limit(1).count() == 0:
        return None
    chosen = nodes.join(short, "node", "left_semi").select("node", "text").dropDuplicates(["node"])
    queried = cut(chosen.mapInArrow(lambda it: _prefix_rows(it, size, t, None), "token long, node long"))
    slot = F.shiftrightunsigned("token", 40)
    maps = queried.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits"))
    allowed = np.zeros(1 << 21, np.uint8)
    for r in maps.toLocalIterator():
        allowed[r.page * 4096 : r.page * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    others = nodes.select("node", "text").mapInArrow(lambda it: _prefix_rows(it, size, t, allowed), "token long, node long").distinct()
    met = block_join(others.withColumnRenamed("node", "x"), queried.withColumnRenamed("node", "y"), "token").filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_texts(nodes: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``a, b, similarity`` of all pairs of different texts whose shingle sets reach ``threshold``.

    nodes: ``node`` LONG (a hash of the text) and ``text``; copies may repeat.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    hot, counts, total, documents = frequent_tokens(nodes.select("text"), size)
    signer = _Signer(threshold, hot, counts)
    buckets = min(1 << 24, max(8, math.ceil(total * 0.75 / BUCKET_SIGNATURES)))
    parts = 1 + documents // 100_000
    rows = nodes.select("node", "text").mapInArrow(lambda it: _signature_rows(it, signer, size, buckets), "bucket int, node long, size int, sigs binary")
    met = cut(
        rows.withColumn("part", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("node"), F.lit(parts))).otherwise(0))
        .groupBy("bucket", "part")
        .applyInArrow(lambda table: {-2: _hot_members, -1: _short_rows}.get(table.column("bucket")[0].as_py(), lambda x: _bucket_pairs(x, threshold))(table), "kind int, a long, b long, size int")
    )
    runs = met.filter("kind between 1 and 4").select("a", "b", F.shiftright("size", 2).alias("size"), F.col("size").bitwiseAND(3).alias("need"), ((F.col("kind") - 1).bitwiseAND(1) > 0).alias("picked"), ((F.col("kind") - 1).bitwiseAND(2) > 0).alias("own")).distinct()
    # A signature that nobody picked finds nothing.
    runs = runs.join(runs.filter("picked").select("a").distinct(), "a", "left_semi")
    # Members of a signature are cut into blocks, and blocks are paired, so no task holds a hot one.
    blocks = runs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("blocks"))
    spread = cut(runs.join(blocks, "a").withColumn("own_block", F.pmod(F.xxhash64("b", "size", "picked", "own"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    x = spread.select("a", F.col("own_block").alias("i"), F.col("other").alias("j"), *(F.col(c).alias(f"x_{c}") for c in ("b", "size", "need", "picked", "own")))
    y = spread.select("a", F.col("other").alias("i"), F.col("own_block").alias("j"), *(F.col(c).alias(f"y_{c}") for c in ("b", "size", "need", "picked", "own")))
    large = F.greatest("x_size", "y_size")
    long_pairs = (
        x.join(y, ["a", "i", "j"])
        .filter("x_b < y_b")
        .filter((F.col("x_own") | F.col("y_own")) & (F.least("x_size", "y_size") >= threshold * large - 1e-9))
        .filter((F.col("x_picked") & (F.col("x_size") == large)) | (F.col("y_picked") & (F.col("y_size") == large)))
        .select(F.col("x_b").alias("a"), F.col("y_b").alias("b"), F.lit(1).alias("times"), F.least("x_need", "y_need").alias("need"))
    )
    meetings = met.filter("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.shiftright("size", 2).alias("times"), F.col("size").bitwiseAND(3).alias("need")).unionByName(long_pairs)
    # Of H + c picks at most H can miss, so a pair meets c times at least.
    pairs = cut(meetings.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).filter("times >= need").select("a", "b"))
    pairs = _thinned(nodes, pairs, size, threshold)
    extra = _against_all(nodes, met.filter("kind = 9").select(F.col("b").alias("node")).distinct(), size, threshold)
    if extra is not None:
        pairs = cut(pairs.unionByName(extra).distinct())
    members = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    texts = within(nodes.select("node", "text"), "node", members, 2 * pairs.count()).groupBy("node").agg(F.first("text").alias("text"))
    joined = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInArrow(lambda it: _verify(it, size, threshold), "a long, b long, similarity double")


def _short_rows(table: pa.Table) -> pa.Table:
    n = table.num_rows
    return pa.Table.from_pydict({"kind": pa.array([9] * n, pa.int32()), "a": pa.array([0] * n, pa.int64()), "b": table.column("node").cast(pa.int64()), "size": table.column("size").cast(pa.int32())})


def near_duplicate_groups(documents: DataFrame, id_column: str = "document_id", text_column: str = "normalized_text", threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``document_id, class_id, links``: the group of every document and its number of similar documents.

    class_id is the least document id of the group (the document's own where it has
    no near-duplicate).  Null and blank texts have no shingles and stay alone with
    no links; a repeated row of one id counts once; rows with a null id are left
    out; an empty table gives an empty result; other columns are ignored.
    """
    base = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).filter(F.col("_id").isNotNull())
    spoken = base.filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    nodes = spoken.select(F.xxhash64("text").alias("node"), "text")
    edges = cut(similar_texts(nodes, threshold, size))
    roots = components(edges)
    member = cut(base.select("_id", F.when(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.xxhash64("text")).alias("node")).distinct())
    copies = member.filter("node is not null").groupBy("node").agg(F.countDistinct("_id").alias("copies"))
    near = (
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("near"))
    )
    facts = copies.join(near.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    labelled = member.join(facts, "node", "left")
    least = labelled.filter("root is not null").groupBy("root").agg(F.min("_id").alias("class_id"))
    return labelled.join(least, "root", "left").groupBy(F.col("_id").alias(id_column)).agg(F.min(F.coalesce("class_id", "_id")).alias("class_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"))


def group_pairs(groups: DataFrame, id_column: str = "document_id") -> DataFrame:
    """``document_a, document_b`` of every two documents of one group."""
    shared = groups.filter("links > 0 or class_id <> " + id_column)
    return class_pairs(shared, "class_id", id_column).select(F.col("a").alias("document_a"), F.col("b").alias("document_b"))
