"""URL rules, coding, packing and fingerprints."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import byte_bpe, fingerprint, packing, url_filter

URLS = [
    (0, None), (1, "no scheme"), (2, "http://A.Example.COM/en/77?x#y"), (3, "https://example.com/en/6"), (4, "http://notexample.com/en/7"),
    (5, "ftp://example.net/de/8x"), (6, "http://www.example.net/de/9"), (7, "http://org/es/"), (8, "http://x.org/es"), (9, "http://com?/en/"),
    (10, "://com/en/"), (11, "http://É.com/en/1"), (12, "http://"), (13, "a://b.net/de/" + "x" * 50_000), (2, "http://A.Example.COM/en/77?x#y"),
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules_match_brute_force(spark, documents):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, html string, rule string")
    want = sorted(((i, *judged(u)) for i, u in URLS), key=str)
    assert sorted(map(tuple, url_filter.judge_pages(pages, url_filter.RULES).collect()), key=str) == want
    assert {r.verdict for r in url_filter.judge_pages(pages, []).collect()} == {"allow"}
    assert url_filter.judge_pages(pages.limit(0), url_filter.RULES).count() == 0


def test_url_join_gives_the_same_verdicts(spark, documents, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_INDEX_RULES", 0)
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    got = sorted(map(tuple, url_filter.judge_pages(pages, url_filter.RULES).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u in URLS), key=str)


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k, *_: 7)
    path = str(tmp_path / "rules")
    url_filter.DigestIndex.write(url_filter.RULES, path)
    rules, verdicts = url_filter.DigestIndex(path).judge(["a.com", "b.net", "c.fr"], ["/en/1", "/de/1", "/en/1"])
    assert rules == ["com/en/", "net/de/", None] and verdicts == ["block", "allow", "allow"]


ODD = "ab cd's've'll d12 ,.!?\n\t\r  é ü'S'ſ“”…x²½ªº \u0085\x1c 日本😀"


def odd_texts(n, seed=1, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("long", [5, 20_000])
def test_cutting_at_safe_boundaries_changes_no_id(monkeypatch, long):
    monkeypatch.setattr(byte_bpe, "LONG", long)
    bpe = byte_bpe.ByteBPE()
    for t in odd_texts(2000):
        ids = bpe.encode(t)
        assert ids.tolist() == bpe.encoding.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_encode_and_decode_round_trip(documents):
    texts = [(0, None), (1, ""), (2, "word " * 30_000), *enumerate(odd_texts(50), 3)]
    encoded = byte_bpe.encode_docs(documents(texts))
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode_docs(encoded).collect()}
    assert back == {i: (t or "").encode() for i, t in texts}
    assert byte_bpe.encode_docs(documents([])).count() == 0


def test_ranks_give_the_ids_of_the_tokenizers_file():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    bpe = byte_bpe.ByteBPE()
    texts = [*odd_texts(1000, 2), "<|endoftext|> is text", "The quick brown fox's 1234 jumps"]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(text).tolist() == e.ids


def test_packing_is_whole_gapless_and_near_the_bound(documents):
    rng = random.Random(4)
    texts = [(0, None), (1, ""), (2, "tok " * 5000), *((i, "word " * rng.randint(0, 700)) for i in range(3, 150)), (3, "again")]
    pieces = packing.pack(packing.cut_pieces(documents(texts))).toPandas()
    bpe = byte_bpe.ByteBPE()
    for i, t in dict(texts[:-1]).items():
        if i == 3:
            continue
        ids = np.append(bpe.encode(t), 2).astype("<u4")
        mine = pieces[pieces.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == np.cumsum([0, *mine.length[:-1]]).tolist() and mine.length.sum() == len(ids)
        assert (mine.length.iloc[1:] == 1024).all() and mine.length.max() <= 1024
        for p in mine.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() <= 1024
    assert pieces.sequence_id.nunique() <= -(-pieces.length.sum() // 1024) + 2
    assert packing.pack(packing.cut_pieces(documents([]))).count() == 0


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(documents=3), packing.Capacity(attention=300_000, weights=(1, 0.5, 0.5)), packing.Capacity(score="norm", weights=(1, 1, 1))])
def test_every_capacity_holds(cap):
    rng = np.random.default_rng(3)
    counts = dict(Counter(rng.integers(1, 540, 3000).tolist()))
    groups = packing.pack_lengths(counts, cap)
    packed = Counter()
    for n, lengths in groups:
        assert sum(lengths) <= cap.tokens and len(lengths) <= cap.documents and sum(x * x for x in lengths) <= cap.attention
        for x in lengths:
            packed[x] += n
    assert packed == counts


def test_fingerprints_match_brute_force(documents):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [(0, None), (1, ""), (2, "one"), (3, "x " * 40_000), *((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 300)))) for i in range(4, 60))]
    sampler = fingerprint.WeightedSampler.shared()
    got = {r.doc_id: r for r in fingerprint.compare_with_next(documents(texts)).collect()}
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        r, a, b, c = got[i], sampler.of_text(t), sampler.of_text(edited), sampler.of_text(following)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.to_string(a), fingerprint.to_string(b))
        assert r.near_edited == pytest.approx((a == b).mean()) and r.near_next == pytest.approx((a == c).mean())
    assert fingerprint.compare_with_next(documents([])).count() == 0
    assert fingerprint.compare_with_next(documents([(5, "alone here")])).first().near_next == 1.0


def test_next_documents_of_repeated_and_missing_ids(spark):
    """Hot ids fill several ranges; the order is by id, descending, then by the hash of the text, and other columns may clash."""
    from pyspark.sql import functions as F

    rng = random.Random(16)
    rows = [(rng.choice([None, 7, 7, 7, 10**9, -(2**63), 2**63 - 1, i]), f"text {rng.randrange(150)} of {rng.randrange(9)}", "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string, `range` int").repartition(5)
    ties = {r.text: r.tie for r in docs.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(((i, t) for i, t, *_ in rows), key=lambda r: (-r[0] if r[0] is not None else 2**63, ties[r[1]]))
    sampler = fingerprint.WeightedSampler.shared()
    want = Counter()
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        want[i, fingerprint.to_string(sampler.of_text(t)), hashlib.sha256(fingerprint.edited_text(t, following).encode()).hexdigest()] += 1
    got = fingerprint.compare_with_next(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.edited_sha256) for r in got) == want


def test_every_range_has_a_task_of_its_own(spark):
    """As many tasks as ranges have rows, and none more than about its share of the bytes."""
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('word ', cast(1 + pmod(id * 7, 90) as int)) text")
    n = len(fingerprint.shard_keys(spark))
    out = fingerprint.compare_with_next(docs).selectExpr("spark_partition_id() p", "n_chars").groupBy("p").agg({"n_chars": "sum", "*": "count"}).collect()
    assert len(out) == n
    total = sum(r["sum(n_chars)"] for r in out)
    assert max(r["sum(n_chars)"] for r in out) < 1.5 * total / n


def test_slots_rise_with_the_key_and_split_hot_keys(spark):
    from pyspark.sql import functions as F

    edges = [1, 5, 5, 5, 5, 9, 9, 12]
    rows = [(k, h) for k in range(15) for h in (-(2**63), -(2**62) - 1, -5, 0, 2**62, 2**63 - 1)]
    df = spark.createDataFrame(rows, "k long, h long").withColumn("slot", fingerprint._slot(F.col("k"), F.col("h"), edges))
    by_order = [(r.k, r.slot) for r in sorted(df.collect(), key=lambda r: (r.k, -r.h))]
    assert [s for _, s in by_order] == sorted(s for _, s in by_order)
    assert len({s for k, s in by_order if k == 5}) == 4 and len({s for k, s in by_order if k == 9}) == 2
    assert len({s for k, s in by_order if k in (2, 3, 4)}) == 1


def test_ranges_hold_about_equal_weights():
    rng = random.Random(3)
    for n in (1, 2, 7, 50):
        slots = [(3 * s, rng.choice([1, 5, 400])) for s in range(8 * n)]
        ranges = fingerprint._ranges(slots, n)
        assert [ranges[s] for s, _ in slots] == sorted(ranges.values()) and 0 <= min(ranges.values()) and max(ranges.values()) < n
        sums = Counter()
        for s, w in slots:
            sums[ranges[s]] += w
        assert max(sums.values()) <= sum(w for _, w in slots) / n + 400


def test_texts_of_very_many_words_have_no_forced_collisions():
    """200,000 and 300,000 words, more than a table has rows: likeness estimates their Jaccard similarity all the same."""
    sampler = fingerprint.WeightedSampler(seed=1, samples=256)
    a, b = (sampler.signature(dict.fromkeys((f"w{k}" for k in range(*r)), 1)) for r in ((0, 200_000), (100_000, 300_000)))
    assert fingerprint.likeness(a, b) == pytest.approx(1 / 3, abs=0.12)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 30])
def test_ranges_count_the_edges_below(spark, n):
    from pyspark.sql import functions as F

    edges = [3 * i for i in range(n)]
    df = spark.range(-1, 3 * n + 2).select("id", fingerprint._edges_below(F.col("id"), edges).alias("k"))
    assert all(r.k == sum(e < r.id for e in edges) for r in df.collect())


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(8)
    errors = []
    for seed in range(40):
        s = fingerprint.WeightedSampler(seed=seed, samples=256)
        a, b = ({f"w{rng.randrange(40)}": rng.randint(1, 40) for _ in range(25)} for _ in range(2))
        keys = a.keys() | b.keys()
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        errors.append(fingerprint.likeness(s.signature(a), s.signature(b)) - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_rules_of_very_many_lengths_all_fit(spark):
    rules = spark.range(11_999, -1, -1).selectExpr("'a.com' rule_host", "'/' || repeat('x', cast(id as int)) rule_path", "'block' rule_verdict")
    parts = spark.range(200).selectExpr("id page_id", "'a.com' host", "'/' || repeat('x', cast(id as int)) path")
    rows = url_filter.judge_by_join(parts, rules).collect()
    assert len(rows) == 200 and all(r.rule == r.host + r.path for r in rows)


def test_all_capacities_tell_bins_apart_and_cost_no_sequence():
    rng = np.random.default_rng(9)
    for _ in range(4):
        counts = dict(Counter(np.minimum(rng.geometric(1 / rng.integers(60, 500), 4000), 1023).tolist()))
        n = {w: sum(k for k, _ in packing.pack_lengths(counts, packing.Capacity(weights=w))) for w in ((1.0, 0.0, 0.0), packing.Capacity().weights)}
        assert n[packing.Capacity().weights] <= n[1.0, 0.0, 0.0]
    assert min(packing.Capacity().weights) > 0
    # two bins with room for 24 tokens each: one of one long document, one of two; the third goes where less attention is left
    groups = packing.pack_lengths({1000: 1, 500: 2, 24: 1})
    assert sorted((n, sorted(x)) for n, x in groups) == [(1, [24, 1000]), (1, [500, 500])]
    groups = packing.pack_lengths({1000: 1, 500: 2, 24: 1}, packing.Capacity(weights=(1.0, 4.0, 0.0)))
    assert sorted((n, sorted(x)) for n, x in groups) == [(1, [24, 500, 500]), (1, [1000])]
