"""Exact dedup, near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np

from tickloom.llm import exact_dedup, near_dedup, suffix_dedup


def exact(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[ \t\n\v\f\r]", "", t or ""), []).append((-len(t or ""), i))
    return {k: (sorted(v)[0][1], len(v)) for k, v in groups.items()}


EXACT = [
    (0, None), (1, ""), (2, " \n\t\v\f\r"), (3, "a b c"), (4, "abc"), (5, "a  b c"), (6, "a\u00a0bc"), (7, "abc "), (8, "x" * 100_000),
    (9, "x" * 50_000 + " " + "x" * 50_000), (10, "é è"), (11, "éè"), *((20 + i, "same text") for i in range(300)),
]


def test_exact_dedup_matches_brute_force(documents):
    want = exact(EXACT)
    got = exact_dedup.decide(documents(EXACT)).collect()
    assert len(got) == len(EXACT)
    by_id = dict(EXACT)
    for r in got:
        norm = re.sub(r"[ \t\n\v\f\r]", "", by_id[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == want[norm]
        assert r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_keeps_one_of_repeated_rows(documents):
    got = exact_dedup.decide(documents([(7, "twice"), (7, "twice"), (8, "once")])).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(7, False), (7, True), (8, True)]
    docs = documents([(7, "twice"), (7, "twice"), (8, "once"), (9, None), (10, " ")])
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8, 10]


def test_exact_dedup_of_nothing(documents):
    assert exact_dedup.decide(documents([])).count() == 0
    assert exact_dedup.keep(documents([])).count() == 0


def test_bitmap_holds_exactly_the_repeated_cells(spark):
    df = spark.createDataFrame([(f"h{i % 700}",) for i in range(1000)], "h string")
    cells = exact_dedup.n_cells(1000)
    flagged = exact_dedup.probe(df, "h", exact_dedup.repeated_cells(df, "h", cells), cells, "maybe")
    assert flagged.where("maybe").count() >= 600  # no repeated hash is missed
    assert flagged.where("not maybe").count() >= 350  # and few others pass


def jaccard_groups(texts, threshold=0.8):
    sets = {}
    for i, t in texts:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids, parent, links = sorted(sets), {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b:
                u = len(sets[a] | sets[b])
                if u == 0 or len(sets[a] & sets[b]) / u >= threshold:
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near_texts(n=150, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 40, 200]))] for _ in range(25)]
    out = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "long " * 20_000)]
    for i in range(5, n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i, " ".join(t)))
    return out


def test_near_duplicates_match_brute_force(documents, stored):
    texts = near_texts()
    want = jaccard_groups(texts)
    for df, scan in ((documents(texts), False), (stored(texts), True)):
        got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.join_similar(df, scan=scan).collect()}
        assert got == want


def test_large_components_are_cut_into_tiles(stored, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    texts = near_texts(120, 5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.join_similar(stored(texts), scan=True).collect()}
    assert got == jaccard_groups(texts)


def test_near_duplicates_keep_one_of_each_group(documents):
    texts = near_texts(80)
    docs = documents([*texts, (7, texts[7][1])])
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in jaccard_groups(texts).values()})
    assert near_dedup.keep(documents([])).count() == 0


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype(np.uint64)) for _ in range(60)]
    got = near_dedup.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_prefix_shortens_until_the_target_recall():
    d = near_dedup.prefix_depth(0.8, 0.999)
    assert near_dedup.expected_recall(0.8, d) >= 0.999 > near_dedup.expected_recall(0.8, d + 1)


def repeated(texts, n=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - n + 1):
            if raw[s : s + n] in seen:
                gone[s : s + n] = True
            seen.add(raw[s : s + n])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def passage_texts(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(6)]
    out = []
    for i in range(60):
        t, k = rng.choice(base), rng.randrange(8)
        p = rng.randrange(300)
        t = [
            "a" * rng.randint(90, 1500), "ab" * rng.randint(45, 500) + "xyz" + "ab" * 100, t[p:], t[:p] + "Z" + t[p + 1 :],
            t[100:250] + rng.choice(base)[50:200] + t[30:180], None if i % 2 else "", t[:100], t,
        ][k]
        out.append((i, t))
    return out


def test_repeated_passages_match_brute_force(documents, stored):
    texts = passage_texts()
    want = repeated(texts)
    for df, scan in ((documents(texts, partitions=4), False), (stored(texts, partitions=1), True)):
        rows = suffix_dedup.repeated_runs(df, scan=scan).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
        assert len(rows) == len(texts) and got == want


def test_repeated_passages_of_nothing_and_of_repeated_rows(documents):
    assert suffix_dedup.repeated_runs(documents([])).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(150))
    rows = suffix_dedup.repeated_runs(documents([(1, text), (1, text)])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 150]


def test_copies_in_a_block_are_all_but_the_earliest():
    rng = np.random.default_rng(21)
    for _ in range(20):
        n = int(rng.integers(0, 300))
        doc = np.sort(rng.integers(0, 30, n))
        ids = rng.integers(-5, 20, 30)
        anchor, whole = rng.integers(0, 9, n).astype(np.uint64), rng.integers(0, 6, n).astype(np.uint64)
        got = suffix_dedup._copies_in_block(anchor, whole, doc, ids)
        seen, want = set(), [False] * n
        for k in sorted(range(n), key=lambda k: (ids[doc[k]], doc[k], k)):
            want[k] = (anchor[k], whole[k]) in seen
            seen.add((anchor[k], whole[k]))
        assert got.tolist() == want


def test_rows_keep_their_numbers_when_files_are_split_otherwise(spark, documents, tmp_path):
    rng = random.Random(5)
    path = str(tmp_path / "split.parquet")
    texts = [(i // 2 or None, "".join(rng.choice("abcdef ") for _ in range(300))) for i in range(4000)]
    documents(texts, partitions=2).sortWithinPartitions("text").write.option("parquet.block.size", 1 << 16).parquet(path)
    seen = {}
    try:
        for size in ("64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            df = suffix_dedup.numbered(spark.read.parquet(path), "doc_id", "text")
            seen[df.rdd.getNumPartitions()] = sorted((bytes(r.row), r.text) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    few, many = (seen[n] for n in sorted(seen))
    assert few == many and len({r for r, _ in few}) == len(texts)


def test_levels_stay_logarithmic_and_find_the_earliest_start():
    rng = np.random.default_rng(2)
    family, first, at = suffix_dedup.LevelFamily(), {}, 0
    for _ in range(100):
        keys = rng.integers(0, 3000, 50).astype(np.uint64)
        starts = np.arange(at, at + 50)
        seen = family.add(keys, starts, np.zeros(50, np.uint32))
        for k, s in zip(keys.tolist(), starts.tolist()):
            first.setdefault(k, s)
        at += 50
        assert all(first[k] == s for k, s in zip(keys.tolist(), seen.tolist()))
        assert len(family.levels) <= 8


def test_strings_of_one_key_are_told_apart_by_their_check():
    rng = np.random.default_rng(3)
    family, first, at = suffix_dedup.LevelFamily(), {}, 0
    for n in [0, *rng.integers(1, 60, 80)]:
        keys, checks = rng.integers(0, 8, n).astype(np.uint64), rng.integers(0, 6, n).astype(np.uint32)
        starts = at + rng.permutation(n)
        for pair, s in zip(zip(keys.tolist(), checks.tolist()), starts.tolist()):
            first[pair] = min(s, first.get(pair, s))
        seen = family.add(keys, starts, checks)
        assert [first[p] for p in zip(keys.tolist(), checks.tolist())] == seen.tolist()
        at += n
    lone = suffix_dedup.LevelFamily()
    lone.add(np.array([5], np.uint64), np.array([0]), np.array([1], np.uint32))
    assert lone.earliest(np.array([5, 9], np.uint64), np.array([7, 7]), np.array([2, 1], np.uint32)).tolist() == [7, 7]


def test_packed_numbers_come_back():
    for kind, top in ((suffix_dedup.DOC, 1 << 16), (suffix_dedup.PLACE, 1 << 32)):
        for n in (0, 1, 1000):
            x = np.random.default_rng(n).integers(0, top, n).astype(kind)
            assert (suffix_dedup.unpack(suffix_dedup.pack(x, kind), kind) == x).all()


def test_order_numbers_follow_id_block_document_and_place():
    rng = np.random.default_rng(6)
    slices, blocks, rows = [], [], []
    for block in (3, 1 << 33, 7):
        ids = rng.integers(-3, 4, 20)
        doc = np.sort(rng.integers(0, 20, 200))
        place = rng.permutation(1 << 20)[:200]
        slices.append((ids[doc], doc.astype(np.uint16), place.astype(np.uint32)))
        blocks.append(block)
        rows += list(zip(ids[doc].tolist(), [block] * 200, doc.tolist(), place.tolist()))
    got = suffix_dedup.order_numbers(slices, blocks)
    assert sorted(range(600), key=lambda i: rows[i]) == np.argsort(got, kind="stable").tolist()


def test_measured_recall_counts_the_classes_that_met_none():
    assert near_dedup.measured_recall({}) == 0 and near_dedup.measured_recall({0: 50}) == 0
    assert near_dedup.measured_recall({16: 100}) == 1
    assert near_dedup.measured_recall({1: 10, 2: 5, 9: 85}) == 100 / (100 + 10)


def test_runs_hold_their_smallest_class_at_every_depth(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted((int(t), bytes(v.astype(">u2").tobytes()), int(n)) for n, (t, *v) in enumerate(np.column_stack([rng.integers(0, 2, 900), rng.integers(0, 3, (900, near_dedup.DEPTH))])) for v in [np.array(v)])

    def batches():
        for a in range(0, 900, 70):
            part = rows[a : a + 70]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.int64())], ["tree", "prefix", "node"])

    for slab in (10**6, 100):
        monkeypatch.setattr(near_dedup, "SLAB", slab)
        out = [r for b in near_dedup._runs(batches(), 2) for r in b.to_pylist()]
        for i, d in enumerate(range(2, near_dedup.DEPTH + 1)):
            want = {}
            for t, prefix, n in rows:
                want.setdefault((t, prefix[: 2 * d]), []).append(n)
            best = {}
            for r in out:  # pieces of a run that slabs cut meet by their label
                if r["depth"] == d:
                    best[r["label"]] = min(best.get(r["label"], 10**9), r["node"])
            ends = {r["node"]: best[r["label"]] for r in out if r["depth"] == d}
            heads = {(r["node"], ends.get(r["heads"][i], r["heads"][i])) for r in out if r["heads"] and r["heads"][i] is not None}
            whole = {(n, min(v)) for v in want.values() if len(v) > 1 for n in v}
            assert heads | {(n, b) for n, b in ends.items() if b != n} | {(b, b) for b in best.values()} >= whole
            assert all(b in ns and n in ns for n, b in heads for ns in [next(v for v in want.values() if n in v)])


def test_a_large_group_of_near_copies_loses_no_link(stored, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for i in range(400):  # most copies are near the first, some are far from it, some drift away
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 3, 5, 6, 8])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append((i, " ".join(t[: rng.choice([200, 200, 200, 170, 140])])))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dedup.join_similar(stored(texts), scan=True).collect()}
    assert got == jaccard_groups(texts)


def test_near_duplicates_of_null_and_repeated_ids(documents):
    rng = random.Random(2)
    a, b = (" ".join(rng.choice(WORDS_20) for _ in range(60)) for _ in range(2))
    rows = [(None, a), (None, a), (3, a), (3, a), (3, b), (4, b + " x"), (None, "alone here"), (9, None), (9, "")]
    docs = documents(rows)
    out = near_dedup.join_similar(docs).collect()
    assert len(out) == len(rows) and {r.class_id for r in out if r.doc_id == 4} == {3}
    assert sorted((r.n_links for r in out if r.class_id == 3)) == [1, 1, 3, 3, 3, 3]
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (3, b), (None, "alone here"), (9, None)], key=str) or sorted(
        ((r.doc_id, r.text or "") for r in kept.collect()), key=str
    ) == sorted([(3, a), (3, b), (None, "alone here"), (9, "")], key=str)


WORDS_20 = [f"w{k}" for k in range(200)]


def test_components_reach_the_smallest_node(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_exact_dedup_in_slices_gives_the_same_rows(documents, monkeypatch):
    want = sorted(map(tuple, exact_dedup.decide(documents(EXACT)).collect()), key=str)
    kept = sorted(r.doc_id for r in exact_dedup.keep(documents(EXACT)).collect())
    assert kept == sorted({k for k, _ in exact(EXACT).values()})
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", 1 << 12)
    assert exact_dedup.n_slices(len(EXACT)) == 4 and exact_dedup.n_cells(10**9) == 1 << 12
    assert sorted(map(tuple, exact_dedup.decide(documents(EXACT)).collect()), key=str) == want
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_GROUPS", 0)
    assert sorted(r.doc_id for r in exact_dedup.keep(documents(EXACT)).collect()) == kept


def test_exact_dedup_of_null_and_least_ids(spark):
    rows = [(None, "a b"), (None, "ab"), (-(2**63), "ab"), (2**63 - 1, "ab"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(docs).collect()), key=str)
    assert got == sorted([(None, None, 4, True), (None, None, 4, False), (-(2**63), None, 4, False), (2**63 - 1, None, 4, False), (None, None, 2, True), (None, None, 2, False)], key=str)
    assert sorted(r.text for r in exact_dedup.keep(docs).collect()) == ["a b", "c"]
