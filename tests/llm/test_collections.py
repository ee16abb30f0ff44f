"""Splits, packing and mixing."""

import collections
import os
import random

import numpy as np
import pytest

from clausemill.llm import mixing as M, packing as P, splits as X, tokens as T

needs_vocabulary = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no public vocabulary here")
RECORD = "record_id string, family_id string, document_ids array<string>, component string"


def tied(records):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for i, family, documents, _ in records:
        keys = ([("f", "-".join(family.strip().lower().replace("_", " ").replace("-", " ").split()))] if family and family.strip() else []) + [("d", d) for d in documents or [] if d is not None]
        for k in [("r", i), *keys]:
            root[find(k)] = find(("r", i))
    return {i: find(("r", i)) for i, *_ in records}


def fixture(seed=1, n=300):
    random.seed(seed)
    out = []
    for i in range(n):
        family = "fam-0" if random.random() < 0.3 else random.choice([f"fam-{random.randrange(150)}", f" FAM_{random.randrange(150)} ", None, " "])
        out.append((f"r{i:03d}", family, random.choice([None, [], [f"d{random.randrange(400)}", None], [f"d{random.randrange(400)}", f"d{random.randrange(400)}"]]), "clash"))
    return out + [out[3]]


def test_tied_records_share_a_split(spark):
    rows = fixture()
    frame = spark.createDataFrame(rows, RECORD)
    root = tied(rows)
    got = {r.record_id: (r.component, r.split) for r in X.assign_splits(frame, "salt", {"train": 70, "validation": 15, "test": 15}).collect()}
    assert set(got) == set(root)
    of = collections.defaultdict(set)
    for i, r in root.items():
        of[r].add(got[i])
    assert all(len(s) == 1 for s in of.values()) and len({c for c, _ in got.values()}) == len(of)
    share = collections.Counter(s for _, s in got.values())
    assert abs(share["train"] / len(got) - 0.7) < 0.05 and abs(share["test"] / len(got) - 0.15) < 0.05


def test_family_pairs_match_brute_force(spark):
    rows = fixture(2)
    root = tied(rows)
    groups = collections.defaultdict(set)
    for i, family, *_ in rows:
        if family and family.strip():
            groups[root[i]].add(family)
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    percents = {"train": 70, "validation": 15, "test": 15}
    frame, none = spark.createDataFrame(rows, RECORD), spark.createDataFrame([], RECORD)
    for batches in (1, 3):
        found = X.family_pairs(frame, X.in_batches(frame, "s", percents, batches))
        assert {(r.family_a, r.family_b) for r in found.collect()} == want
    assert X.family_pairs(none, X.in_batches(none, "s", percents)).count() == 0


def test_components_keep_their_split_and_conflicts_are_quarantined(spark):
    percents = {"train": 50, "validation": 0, "test": 50}
    first = spark.createDataFrame([(f"r{i}", f"f{i}", [f"d{i}"], "") for i in range(8)], RECORD)
    path = X.fresh_folder(spark)
    old = {r.record_id: r.split for r in X.assign_splits(first, "s", percents, path).collect()}
    train = next(i for i in old if old[i] == "train")[1:]
    test = next(i for i in old if old[i] == "test")[1:]
    same = next(i for i in old if i[1:] not in (train, test))
    more = spark.createDataFrame([("new", f"f{train}", [f"d{test}"], ""), ("fresh", None, ["fresh"], ""), ("same", f"f{same[1:]}", [], "")], RECORD)
    table = X.update(more, "s", percents, path)
    found = {r.record_id: r.split for r in table.records().collect()}
    assert found["new"] == found[f"r{train}"] == found[f"r{test}"] == "quarantine" and found["same"] == old[same] and found["fresh"] in ("train", "test")
    assert all(found[i] == old[i] for i in old if i[1:] not in (train, test))
    assert table.version == 2 and X.load(spark, path).version == 2
    # Nothing new changes nothing; an unfinished version is none.
    after = X.update(more.limit(0), "s", percents, path)
    assert {r.record_id: r.split for r in after.records().collect()} == found
    table.keys.write.parquet(f"{path}/v000009/keys")
    assert X.load(spark, path).version == 3


def test_later_batches_make_up_for_earlier_ones(spark):
    percents = {"train": 70, "validation": 15, "test": 15}
    path = X.fresh_folder(spark)
    first = spark.createDataFrame([(f"a{i}", "one", [], "") for i in range(80)], RECORD)
    assert {r.split for r in X.assign_splits(first, "s", percents, path).collect()} == {"train"}
    later = X.assign_splits(spark.createDataFrame([(f"b{i}", f"f{i}", [], "") for i in range(100)], RECORD), "s", percents, path)
    found = {r.record_id: r.split for r in later.collect()}
    assert collections.Counter(found.values()) == {"train": 126, "validation": 27, "test": 27}
    # Records that come again count once and tie what they bring.
    table = X.update(spark.createDataFrame([(f"b{i}", "new", [], "") if i == 3 else (f"b{i}", f"f{i}", [], "") for i in range(100)] + [("c", "new", None, "")], RECORD), "s", percents, path)
    now = {r.record_id: r.split for r in table.records().collect()}
    assert now.pop("c") == found["b3"] and now == found
    assert table.keys.filter("key like 'r:%'").count() == 181 and table.components.agg({"size": "sum"}).first()[0] == 181


def test_quotas_fill_the_largest_deficits_first():
    for size, count, missing in [(1, 100, {"train": 70.0, "validation": 15.0, "test": 15.0}), (7, 9, {"train": 40.0, "validation": -5.0, "test": 30.0}), (50, 1, {"train": 3.0, "test": 4.0})]:
        given = X.quotas(size, count, missing)
        assert sum(given.values()) == count and min(given.values()) >= 0
        left = {s: missing[s] - size * given[s] for s in missing}
        # No component could lower the largest excess by moving.
        assert all(left[s] + size >= left[t] - 1e-9 for s in given if given[s] for t in given)


def test_splits_of_nothing_and_bad_percents(spark):
    empty = spark.createDataFrame([], RECORD)
    assert X.assign_splits(empty, "s", {"train": 70, "validation": 15, "test": 15}).count() == 0
    with pytest.raises(ValueError):
        X.assign_splits(empty, "s", {"train": 70})


def test_best_fit():
    random.seed(1)
    sizes = np.array([random.randrange(1, 100) for _ in range(500)])
    clusters = np.array([random.choice([-1, 1, 2, 3] + list(range(10, 200))) for _ in range(500)])
    sources = np.array([random.randrange(5) for _ in range(500)])
    home = P.best_fit(sizes, clusters, sources, 100, most_sources=3)
    fill, held, origin = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for s, c, o, h in zip(sizes, clusters, sources, home, strict=True):
        fill[h] += s
        if c != -1:
            held[h].append(c)
        origin[h].add(o)
    assert max(fill.values()) <= 100 and sum(fill.values()) == sizes.sum()
    assert all(len(x) == len(set(x)) for x in held.values()) and max(len(x) for x in origin.values()) <= 3
    assert len(fill) <= sizes.sum() / 100 * 1.1 + 1
    assert list(P.best_fit(np.array([5, 5]), np.array([7, 7]), np.array([0, 0]), 10)) == [0, 1]


@needs_vocabulary
def test_packing_frames(spark):
    random.seed(3)
    rows = [(i, " ".join(random.choice(["rent", "lease", "租金", "due"]) for _ in range(random.randrange(1, 60))), random.choice(["a", "b", None]), 9) for i in range(200)]
    rows += [(900, None, "a", 1), (901, "", "a", 1), (902, "word " * 500, "a", 1), (None, "x", "a", 1), rows[0], (903, "same text", "a", 1), (904, "Same  text ", "b", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, fill int")
    found = P.pack(P.items(frame, 100), 100).collect()
    sizes = {i: T.count(t) for i, t, *_ in rows if i is not None and t}
    per = collections.defaultdict(list)
    for r in found:
        per[r.doc_id].append((r.piece, r.start_token, r.tokens))
    assert set(per) == set(sizes)
    for i, parts in per.items():
        parts.sort()
        assert sum(n for _, _, n in parts) == sizes[i] and len(parts) == -(-sizes[i] // 100)
        assert [s for _, s, _ in parts] == [100 * k for k in range(len(parts))]
    fill = collections.Counter()
    for r in found:
        fill[r.container_id] += r.tokens
    assert max(fill.values()) <= 100 and all(fill[r.container_id] == r.fill for r in found)
    box = {r.doc_id: r.container_id for r in found if r.doc_id in (903, 904)}
    assert box[903] != box[904]
    assert P.pack(P.items(frame.limit(0), 100), 100).count() == 0


@needs_vocabulary
def test_mixture_meets_targets(spark):
    random.seed(6)
    topic = {"big": ["rent", "lease", "tenant"], "mid": ["court", "judge", "appeal"], "small": ["harbor", "ship", "dock"]}
    rows = []
    for i in range(600):
        s = random.choices(["big", "mid", "small"], [8, 3, 1])[0]
        text = " ".join(random.choice(topic[s]) for _ in range(random.randrange(5, 60)))
        stored = random.choice([s, s.upper(), f" {s} ", None]) if i % 5 == 0 else s
        rows.append((i, text, stored, "x"))
    rows += [rows[0], (900, None, "big", "x"), (901, "", "big", "x"), (None, "a", "big", "x"), (902, "other words", "unknown", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.3, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = M.mixture(docs, targets)
    most = {"big": 1, "mid": 2, "small": 3}
    picked = chosen.collect()
    assert len({r.doc_id for r in picked}) == len(picked) and all(1 <= r.copies <= most[r.domain] for r in picked)
    shares = {r.source: (r.target_share, r.share) for r in report.collect()}
    assert set(shares) == set(most) and all(abs(a - b) < 0.03 for a, b in shares.values())
    over = {r.source: r.share for r in M.mixture(docs, targets, total_tokens=10**7)[1].collect()}
    assert abs(sum(over.values()) - 1) < 1e-4
    assert M.mixture(docs.limit(0), targets)[0].count() == 0
    assert M.mixture(docs, targets.limit(0))[0].count() == 0


def test_classifier_learns_topics():
    import pyarrow as pa

    texts = ["rent lease tenant", "court judge appeal"] * 50
    model = M.Classifier(["a", "b"]).fit(texts, [0, 1] * 50)
    p = model.posterior(pa.array(["lease rent rent", "appeal judge", "", None]), np.full(4, -1))
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and np.allclose(p.sum(axis=1), 1) and np.allclose(p[2], p[3])


def test_text_evidence_is_calibrated():
    """Texts that tell their source count, texts that do not leave the stored source alone."""
    import pyarrow as pa

    random.seed(3)
    told = M.Classifier.calibrated(["a", "b"], [t for _ in range(100) for t in ("rent lease tenant", "court judge appeal")], [0, 1] * 100)
    noise = M.Classifier.calibrated(["a", "b"], [" ".join(random.choice(["rent", "court", "dock"]) for _ in range(30)) for _ in range(400)], [random.randrange(2) for _ in range(400)])
    assert told.weight > noise.weight
    p = noise.posterior(pa.array(["rent dock", "rent dock"]), np.array([0, 1]))
    assert p[0, 0] > 0.95 and p[1, 1] > 0.95 and 0 < p[0, 1] < 0.05
