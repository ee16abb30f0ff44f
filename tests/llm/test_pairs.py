"""Near-duplicates, leaks and cross-split overlaps against brute force."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from clausemill.llm import cross_split as C, kernel as K, leaks as L, near_duplicates as N
from clausemill.llm.components import components


def shingle_set(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed, n=120, words=60):
    random.seed(seed)
    base = [[f"w{random.randrange(400)}" for _ in range(words)] for _ in range(n // 6)]
    out = []
    for i in range(n):
        w = list(random.choice(base))
        for _ in range(random.randrange(0, 8)):
            at = random.randrange(len(w))
            w[at : at + random.randrange(0, 2)] = [f"x{random.randrange(50)}"] * random.randrange(0, 3)
        if random.random() < 0.3:
            w = w[: random.randrange(1, len(w))]
        if random.random() < 0.2:
            half = len(w) // 2
            w = w[half:] + w[:half]
        out.append((f"d{i:03d}", random.choice([" ", "  ", " \n", " "]).join(w)))
    return out


EDGE = [("n1", None), ("n2", ""), ("n3", " \n "), ("s1", "one two"), ("s2", "One  two"), ("s3", "one two three"), ("l1", " ".join(f"long{i}" for i in range(20000))), ("l2", " ".join(f"long{i}" for i in range(19000)))]


def test_kernel_sets():
    texts = ["One two three four five six", None, "", "a b", "É É  x y\x1cz", "b" * 50]
    sizes, found = [], []
    for row, tokens, offsets in K.shingle_sets(pa.array(texts)):
        sizes += list(np.diff(offsets))
        found += [set(tokens[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(offsets) - 1)]
    assert sizes == [len(shingle_set(t)) for t in texts]
    again = [s for _, t, o in K.shingle_sets(pa.array(["one TWO three four\nfive six", "é é x y z"])) for s in [set(t[o[0] : o[1]].tolist()), set(t[o[1] : o[2]].tolist())]]
    assert again[0] == found[0] and again[1] == found[4]


def test_kernel_word_borders():
    texts = ["ab", "cd", "", "e f"]
    data = np.frombuffer(b"abcde f", np.uint8)
    hashes, bounds = K.word_hashes(data, np.array([0, 2, 4, 4, 7]), K.BLANK_WORDS)
    assert list(bounds) == [0, 1, 2, 2, 4] and len(set(hashes.tolist())) == 4 and len(texts) == 4


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.7), (2, 0.8), (3, 0.5)])
def test_near_duplicates_lose_no_link(spark, seed, threshold):
    rows = corpus(seed) + EDGE
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows] + [(*rows[0], 8), (None, "x", 1)], "document_id string, normalized_text string, node int")
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= threshold]
    got = N.near_duplicate_groups(frame, threshold=threshold).collect()
    assert {r.document_id: r.class_id for r in got} == groups_of(sets, links)
    assert {r.document_id: r.links for r in got} == {i: sum(i in x for x in links) for i in sets}
    want = groups_of(sets, links)
    pairs = {(r.document_a, r.document_b) for r in N.group_pairs(N.near_duplicate_groups(frame, threshold=threshold)).collect()}
    assert pairs == {(a, b) for a in want for b in want if a < b and want[a] == want[b]}


@pytest.mark.parametrize("hot", [3, 10**6])
def test_template_corpus_and_long_runs(spark, monkeypatch, hot):
    """Nearly all tokens frequent, runs longer than allowed in a bucket, signatures kept out of buckets."""
    monkeypatch.setattr(N, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(N, "RUN", 8)
    monkeypatch.setattr(N, "FREQUENT_LEAST", 2)
    random.seed(5)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(random.randrange(0, 7)):
            w[random.randrange(80)] = f"y{random.randrange(40)}"
        rows.append((f"d{i:02d}", " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.7]
    got = N.near_duplicate_groups(spark.createDataFrame(rows, "document_id string, normalized_text string"), threshold=0.7).collect()
    assert {r.document_id: r.links for r in got} == {i: sum(i in x for x in links) for i in sets}


def test_sets_without_guarantee_go_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(N, "segments_of_band", lambda band, t: 3)
    rows = corpus(9, n=40)
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.7]
    got = N.near_duplicate_groups(spark.createDataFrame(rows, "document_id string, normalized_text string"), threshold=0.7).collect()
    assert {r.document_id: r.class_id for r in got} == groups_of(sets, links)


def test_hot_signatures_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_DOCUMENTS", 3)
    monkeypatch.setattr(N, "FREQUENT_LEAST", 2)
    rows = corpus(21)
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.7]
    got = N.near_duplicate_groups(spark.createDataFrame(rows, "document_id string, normalized_text string"), threshold=0.7).collect()
    assert {r.document_id: r.links for r in got} == {i: sum(i in x for x in links) for i in sets}


def test_many_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_SIGNATURES", 50)
    rows = corpus(22) + EDGE
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.7]
    got = N.near_duplicate_groups(spark.createDataFrame(rows, "document_id string, normalized_text string"), threshold=0.7).collect()
    assert {r.document_id: r.links for r in got} == {i: sum(i in x for x in links) for i in sets}


def test_sets_without_a_guarantee_go_against_all(spark):
    rows = corpus(23)
    nodes = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows) if t and t.strip()], "node long, text string")
    short = nodes.filter("node % 2 = 0").select("node")
    got = {(r.a, r.b) for r in N._against_all(nodes, short, 5, 0.7).collect()}
    sets = {r.node: shingle_set(r.text) for r in nodes.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and (a % 2 == 0 or b % 2 == 0) and similarity(sets[a], sets[b]) >= 0.7}
    assert want and want <= got
    assert N._against_all(nodes, short.limit(0), 5, 0.7) is None


def test_block_count_follows_the_threshold():
    for t in (0.3, 0.5, 0.7, 0.9):
        assert (1 - t**C.LANES_A_BLOCK) ** C.block_count(t) <= C.MISS
    with pytest.raises(ValueError):
        C.block_count(0.1)


def test_hot_keys_are_joined_in_parts(spark):
    from clausemill.llm.components import block_join, class_pairs

    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("one", 7), ("alone", 8)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(20)] + [("one", 3), ("other", 4)], "k string, b int")
    got = [tuple(r) for r in block_join(left, right, "k", 6).select("k", "a", "b").collect()]
    assert len(got) == len(set(got)) == 1001 and ("one", 7, 3) in got
    pairs = [(r.a, r.b) for r in class_pairs(left, "k", "a", 6).collect()]
    assert sorted(pairs) == [(a, b) for a in range(50) for b in range(a + 1, 50)]


def test_empty_and_threshold(spark):
    empty = spark.createDataFrame([], "document_id string, normalized_text string")
    assert N.near_duplicate_groups(empty).count() == 0
    with pytest.raises(ValueError):
        N.similar_texts(empty, 0.3)


def test_segments_reach_the_guarantee():
    for band in range(6, 14):
        m = N.segments_of_band(band, 0.7)
        assert 2**band * 0.5 < m < 2**band * 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    frame = spark.createDataFrame(edges + [(None, 3)], "a int, b int")
    found = {r.node: r.root for r in components(frame).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(frame.limit(0)).count() == 0


def words(t):
    t = re.sub("[­​]", "", unicodedata.normalize("NFKC", t or "")).lower()
    return re.findall(r"[^\W_]+", t)


def test_leaks_match_brute_force(spark):
    random.seed(4)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randrange(5, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "a b c"), (3, None)]
    docs = []
    for i in range(120):
        w = [random.choice(vocabulary) for _ in range(random.randrange(0, 80))]
        if random.random() < 0.7:
            source = random.choice(items[:25])[1].split()
            n = random.choice([11, 12, 13, 20, 40])
            at = random.randrange(max(1, len(source) - n + 1))
            p = random.randrange(len(w) + 1)
            w[p:p] = source[at : at + n]
        text = random.choice([" ", ", ", "\n", "-"]).join(w)
        if i % 3 == 0:
            text = text.upper().replace("V1", "Ｖ1").replace("V2", "V­2")
        docs.append((f"d{i}", text))
    docs += [("null", None), ("empty", ""), ("d0", docs[0][1]), (None, docs[1][1])]
    runs = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs if d for i, x in items if runs(t) & runs(x)}
    found = L.leaks(spark.createDataFrame([(*d, 0) for d in docs], "document_id string, normalized_text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.document_id, r.item_id) for r in found.collect()} == want and len(want) > 20


def test_leaks_empty_and_unsearched(spark):
    items = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(15)), "held") for i in range(4)] + [(8, "too short", "held"), (9, None, "held"), (10, "open", "other")], "item_id long, text string, document_id string")
    docs = spark.createDataFrame([("a", " ".join(f"q2x{j}" for j in range(15)))], "document_id string, normalized_text string")
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [("a", 2)]
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
    config = spark.createDataFrame([((["held"],),)], "exclusion struct<blocked_from_training_document_ids: array<string>>")
    assert {tuple(r) for r in L.unsearched(items, config).collect()} == {(8, "short"), (9, "short"), (10, "not_blocked")}


def test_shift_never_passes_over_a_pattern(monkeypatch):
    """Every window of an item that a text holds is stopped at, in any lane and with slots that clash."""
    random.seed(8)
    monkeypatch.setattr(L, "LANE", 7)
    run, bits = 12, 6
    item = [f"i{i}" for i in range(40)]
    text = []
    for _ in range(30):
        text += [f"t{random.randrange(500)}" for _ in range(random.randrange(30))]
        at = random.randrange(28)
        text += item[at : at + random.randrange(1, 29)]
    hashes = lambda w: K.word_hashes(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]), K.ALNUM_WORDS)
    known, bounds = hashes(item)
    places = np.arange(len(item) - L.BLOCK + 1)
    shifts = np.full(1 << bits, run - L.BLOCK + 1, np.uint8)
    np.minimum.at(shifts, (L.blocks_at(known, places) >> np.uint64(64 - bits)).astype(int), np.maximum(0, run - places - L.BLOCK).astype(np.uint8))
    words, bounds = hashes(text)
    stops = set(L.search(words, bounds, shifts, bits, run)[1].tolist())
    patterns = {tuple(item[i : i + run]) for i in range(len(item) - run + 1)}
    want = {i for i in range(len(text) - run + 1) if tuple(text[i : i + run]) in patterns}
    assert want and want <= stops and len(stops) < len(text) - run


SIDES = {"train": "t", " Training": "t", "VAL": "h", "dev ": "h", "test": "h", "testing": "h", None: None, "other": None}


def test_cross_split_matches_brute_force(spark):
    random.seed(8)
    texts = [t for _, t in corpus(11, n=300)] + ["", "one two", "One two"]
    records = []
    for i, t in enumerate(texts):
        half = len(t.split()) // 2
        parts = {"b": " ".join(t.split()[half:]), "a": " ".join(t.split()[:half])} if i % 3 == 0 else {"z": t}
        records.append((f"r{i:03d}", random.choice(list(SIDES)), parts, f"s{i % 3}"))
    records += [records[5], ("rx", "train", None, "s"), (None, "test", {"a": "x"}, None)]
    text = {r[0]: "\n".join(r[2][k] for k in sorted(r[2])) for r in records if r[0] and r[2]}
    side = {r[0]: SIDES[r[1]] for r in records}
    want = {tuple(sorted((a, b))) for a in text for b in text if side[a] == "t" and side[b] == "h" and similarity(shingle_set(text[a]), shingle_set(text[b])) >= 0.7}
    frame = spark.createDataFrame([(*r, 1) for r in records], "record_id string, split string, source_texts map<string,string>, source_name string, node int")
    pairs = C.cross_split_pairs(frame, 0.7)
    assert {(r.record_a, r.record_b) for r in C.ordered_pairs(pairs).collect()} == want and len(want) > 5
    report = C.overlap_report(frame, pairs).collect()
    assert sum(r.pairs for r in report) == len(want)
    assert C.cross_split_pairs(frame.limit(0), 0.7).count() == 0


def test_codes_follow_similarity():
    a = K.mix(np.arange(1, 301, dtype=np.uint64))
    b = K.mix(np.arange(53, 353, dtype=np.uint64))  # 248 of 352 shared: 0.70
    c = K.mix(np.arange(1000, 1300, dtype=np.uint64))
    x = C.codes(np.concatenate([np.sort(a), np.sort(b), np.sort(c)]), np.array([0, 300, 600, 900]), C.block_count(0.70) * C.LANES_A_BLOCK)
    bits = lambda p, q: int(np.bitwise_count(x[p] ^ x[q]).sum())
    assert bits(0, 1) <= C.radius(0.70) < bits(0, 2)
