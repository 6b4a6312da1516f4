"""Quality, toxicity and personal data, and the pipeline over them."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import byte_bpe, pii, quality_lm, toxicity


def sentences(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = [a + b for a in ("ba", "de", "gi", "ko", "lu", "mar", "ne") for b in ("ta", "ro", "sil", "on", "ex")]


def corpus(seed=1):
    rng = random.Random(seed)
    good = [(i, sentences(rng, rng.randint(5, 80), WORDS)) for i in range(120)]
    junk = [(200 + i, "!! ".join(w.upper() for w in sentences(rng, 60, WORDS).split())) for i in range(20)]
    return [*good, *junk, (300, None), (301, ""), (302, "long tail " * 20_000)], [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(5)]


def brute_force_lm(texts, trusted):
    """Log-probabilities by the textbook formulas, a trusted document without its own counts."""
    tokens = {i: quality_lm._TOKEN.findall(t or "") for i, t in texts}
    total = Counter(w for i in trusted for w in tokens[i])
    n = sum(total.values())
    vocab = quality_lm.Vocabulary(sorted(w for w, c in total.items() if c >= quality_lm.SHARE * n))
    ids = {i: vocab.encode(t or "").tolist() for i, t in texts}
    pairs = {i: Counter(zip(x, x[1:])) for i, x in ids.items()}
    counts = Counter(p for i in trusted for p in pairs[i])  # once a document
    context, kinds, cont = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in counts.items():
        context[a] += c
        kinds[a][min(c, 3)] += 1
        cont[b] += 1

    def discounts(values):
        n1, n2, n3, n4 = (max(1.0, float(sum(v == k for v in values))) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return [0.0, *(min(max(j - (j + 1) * y * b / a, 0.05), j - 0.05) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]

    d, low = discounts(counts.values()), discounts(cont.values())
    total_cont = sum(cont.values())
    spare = sum(low[min(c, 3)] for c in cont.values()) / total_cont / vocab.size
    uni = {b: (cont[b] - low[min(cont[b], 3)]) / total_cont + spare for b in range(vocab.size)}
    out = {}
    for i, c in pairs.items():
        s = 0.0
        for (a, b), tf in c.items():
            n_ab = max(0, counts[a, b] - (i in trusted))
            gamma = sum(d[k] * m for k, m in kinds[a].items())
            p = (n_ab - d[min(n_ab, 3)] + gamma * uni[b]) / context[a] if context[a] else uni[b]
            s += tf * math.log(p)
        out[i] = s
    return out


def test_kneser_ney_matches_brute_force(spark, documents):
    texts, labels = corpus()
    table = spark.createDataFrame([*labels, labels[0]], "doc_id long, quality int, toxic int")
    rows = quality_lm.decide(documents(texts), table).collect()
    want = brute_force_lm(texts, {i for i, q, _ in labels if q})
    assert len(rows) == len(texts)
    for r in rows:
        assert r.log_prob == pytest.approx(want[r.doc_id], rel=1e-9)
    kept = {r.doc_id for r in rows if r.keep}
    assert {i for i, _ in texts if i < 120} <= kept and {300, 301} <= kept
    assert not kept & set(range(200, 220))


def test_quality_of_nothing_and_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_lm.decide(documents([]), labels).count() == 0
    docs = documents([(1, "some text"), (2, None), (1, "some text")])
    assert quality_lm.keep(docs, labels).count() == 3
    assert quality_lm.keep(docs, labels).columns == docs.columns


def toxic_corpus(seed=2, n=400):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = sentences(rng, rng.randint(4, 120), WORDS).split()
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyish" + rng.choice(WORDS), "rudeone"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_toxicity_on_held_out_documents(spark, documents):
    texts, labels = toxic_corpus()
    docs = documents([*texts, (900, None), (901, ""), (902, "tail " * 30_000)])
    train = spark.createDataFrame(labels[:260], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_docs(docs, toxicity.fit(docs, train)).collect()}
    assert len(got) == len(texts) + 3
    held = [(bool(t), got[i].toxic) for i, _, t in labels[260:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert not got[900].toxic and not got[901].toxic
    severe = [got[i].severity for i, _, t in labels if t]
    assert min(severe) > max(got[i].severity for i, _, t in labels[260:] if not t) - 0.5


def test_toxicity_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "x"), (1, "x"), (2, None)])
    rows = toxicity.score_docs(docs, toxicity.fit(docs, none)).collect()
    assert [(r.severity, r.grade, r.toxic) for r in rows] == [(0.0, 0, False)] * 3
    assert toxicity.score_docs(documents([]), None).count() == 0


def test_gradient_of_the_ordinal_model_recovers_order():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        docs.append([f"n{rng.integers(0, 30)}" for _ in range(5)] + ["mild"] * (g >= 1) + ["strong"] * (g == 2))
        y.append(g)
    m = toxicity.CumulativeLink().fit([sorted(set(d)) for d in docs], np.array(y))
    p = m.grades_of(np.array([m.score(["n1"]), m.score(["mild"]), m.score(["mild", "strong"])]))
    assert p.argmax(axis=1).tolist() == [0, 1, 2] and m.theta[0] < m.theta[1]
    assert np.allclose(p.sum(axis=1), 1)


def luhn(s):
    t = 0
    for j, c in enumerate(reversed(s)):
        x = int(c) * (2 if j % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


PII = [
    "a@b.com_x@d.org y@z", "é1.2.3.4.5.6.7.8 999.1.1.1 0001.002.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 x +12 +123456789012345678",
    "a" * 5000 + "@" + "b" * 20 + ".c", "1" * 4000, "1-" * 3000, "+" + "1 " * 9, "😀x@y.zz 😀 +49 170 1234567", "", "a.b@c-d.e.f.@g.h", "1.1.1.1@2.2.2.2",
]


def pii_texts():
    rng = random.Random(9)
    parts = ["@", "a.b", "x-y.org", "10.", "192.168.1.1", "4111111111111111", " ", "+49 ", "(030) ", "12-34", "é", "😀", "\n", "token = \"0a1b2c3d4e5f60718293\"", "7"]
    rest = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    return [(0, None), *enumerate([*PII, *rest], 1)]


def test_base_spans_match_brute_force_and_stay(documents):
    texts = pii_texts()
    rows = {r.doc_id: r for r in pii.find(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in texts:
        name = lambda spans: [(pii.KINDS[s.kind], s.start, s.end) for s in spans]
        assert name(rows[i].base) == base_spans(t or ""), t
        assert set(name(rows[i].base)) <= set(name(rows[i].spans))
        assert name(rows[i].spans) == sorted(name(rows[i].spans), key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))


def test_redaction_removes_every_base_span(documents):
    texts = pii_texts()
    docs = documents(texts)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    for i, t in texts:
        secrets = {t[a:z] for _, a, z in base_spans(t or "")}
        assert all(len(s) < 8 or s not in got[i].text for s in secrets)
        if not secrets and t and "token" not in t and "(" not in t:  # nothing the looser patterns could match
            assert got[i].text == t
        assert got[i].spans == i and (t is not None or got[i].text is None)
    assert pii.redact(documents([])).count() == 0


def test_em_trusts_the_reliable_labelers():
    rng = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        real = rng.random() < 0.4
        vote = lambda p: (1 if real else -1) if rng.random() < p else (-1 if real else 1)
        counts[(0, (vote(0.95), vote(0.9), rng.choice([-1, 0, 1]), vote(0.8), vote(0.6)))] += 1
    post = pii.expectation_maximisation([(k, v, n) for (k, v), n in counts.items()])
    assert post[0, (1, 1, 0, 1, 1)] > 0.95 and post[0, (-1, -1, 0, -1, -1)] < 0.05
    assert post[0, (1, 1, -1, 1, -1)] > 0.5 > post[0, (-1, -1, 1, -1, 1)]


def test_pipeline_matches_brute_force(spark, documents, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import exact, jaccard_groups

    texts, labels = corpus(5)
    texts += [(400, texts[3][1]), (401, texts[4][1] + " "), (402, texts[5][1] + " mail me at joe@mail.example.com"), (403, "call +1 (017) 555-7713 " + texts[6][1])]
    sf = str(tmp_path)
    documents(texts).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        path = f"{sf}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id: getattr(r, "text", None) for r in docs.collect()})
    quality, single, near, redacted, packed = seen
    assert not set(quality) & set(range(200, 220)) and set(range(120)) <= set(quality)
    assert set(single) == {k for k, _ in exact(list(quality.items())).values()}
    assert set(near) == {c for c, _ in jaccard_groups(list(single.items())).values()}
    assert all(not base_spans(t or "") for t in redacted.values()) and set(redacted) == set(near)
    assert set(packed) == set(redacted)
    tokens = sum(len(byte_bpe.ByteBPE().encode(t)) + 1 for t in redacted.values())
    assert sum(r.length for r in docs.collect()) == tokens
    rows = corpus_pipeline.run(spark, sf).collect()
    digest = lambda rs: hashlib.sha256(str(sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rs)).encode()).hexdigest()
    assert digest(rows) == digest(docs.collect())


def test_letter_gibberish_is_rejected(spark, documents):
    rng = random.Random(8)

    def text(rare):
        return " ".join(rng.choice(WORDS) if rng.random() < 0.5 else rare() for _ in range(80))

    def word():
        return "".join(rng.choice(WORDS) for _ in range(3))

    def letters():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(len(word())))

    texts = [(i, text(word)) for i in range(350)]  # the last 50 aren't trusted
    texts += [(1000 + i, text(letters)) for i in range(50)] + [(2000 + i, " ".join(letters() for _ in range(200))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = quality_lm.decide(documents(texts, langs={i: "en" for i, _ in texts}), labels).collect()
    kept = {r.doc_id for r in rows if r.keep}
    assert not [i for i in kept if i >= 1000]
    assert len([i for i in kept if 300 <= i < 350]) >= 48 and len([i for i in kept if i < 300]) >= 297


def test_spelling_is_a_distribution_and_leaves_own_counts_out():
    keys, counts = np.unique(quality_lm.four_grams([*WORDS, *WORDS[:9], "Été", "42", "!?"])[0], return_counts=True)
    m = quality_lm.Spelling(keys, counts)
    start = quality_lm.spelt("x")[:3]
    for head in (start, start[:2] + b"b", b"sil", b"qqq", b"qba"):
        p = np.exp(m.log_prob(np.array([int.from_bytes(head + bytes([b])) for b in range(256)], np.uint32)))
        assert p.min() > 0 and p.sum() == pytest.approx(1)
    free, own = m.tokens(["bata", "marsil"]), m.tokens(["bata", "marsil"], {"bata"})
    assert own[0] < free[0] and m.tokens(["bat"])[0] > m.tokens(["xqz"])[0]
    assert np.allclose(m.tokens(["bata"]), free[:1]) and len(m.tokens([])) == 0
    assert quality_lm.Spelling(keys[:0], counts[:0]).tokens(["ab"])[0] == pytest.approx(-3 * math.log(256))


def test_words_outside_the_vocabulary_have_exact_counts(spark, documents):
    common = "common " * 3000
    texts = [(i, common + ("bataro " if i < 5 else "") + ("kosil " if i == 5 else "")) for i in range(8)]
    texts = [(i, t.replace("bataro", "bataro gilu" if i < 1 else "bataro")) for i, t in texts] + [(100, "bataro"), (101, "gilu"), (102, "unseen"), (103, "kosil")]
    trusted = documents(texts).where("doc_id < 8")
    sums = quality_lm.word_table(trusted)
    old = quality_lm.SHARE
    quality_lm.SHARE = 1 / 2000
    try:
        vocab, rare = quality_lm.frequent(sums), quality_lm.rare_words(sums)
    finally:
        quality_lm.SHARE = old
    assert list(vocab.ids) == ["common"]
    words, spelt = ["bataro", "gilu", "kosil", "unseen"], np.log([1e-4, 2e-4, 3e-4, 4e-4])
    n, shape = np.array([5, 1, 1, 0]), [quality_lm.LOWER] * 4
    d = quality_lm.discounts([2, 0, 0, 0])
    back = (d[3] + 2 * d[1]) / 7
    assert np.exp(rare.log_prob(words, shape, spelt)) == pytest.approx((n - d[np.minimum(n, 3)]) / 7 + back * np.exp(spelt))
    n = np.array([4, 0, 0, 0])
    assert np.exp(rare.log_prob(words, shape, spelt, 1)) == pytest.approx((n - d[np.minimum(n, 3)]) / 7 + back * np.exp(spelt))
    assert rare.log_prob(["X"], [quality_lm.TITLE], spelt[:1]) == pytest.approx(spelt[:1])  # no word of the shape


def spelling_sums(texts, trusted, share, monkeypatch):
    """Sums of the block rows of scoring, those of the formulas a document at a time, and keys looked up in tables."""
    tokens = [quality_lm._TOKEN.findall(t) for t in texts]
    n, docs = Counter(), Counter()
    for t, good in zip(tokens, trusted):
        if good:
            n.update(t)
            docs.update(set(t))
    vocab = quality_lm.Vocabulary(sorted(w for w in n if n[w] >= share))
    grams, lengths = quality_lm.four_grams(docs)
    keys, at = np.unique(grams, return_inverse=True)
    model = quality_lm.Spelling(keys, np.bincount(at, np.repeat([*docs.values()], lengths)))
    rare = [w for w in docs if w not in vocab.ids]
    words = quality_lm.RareWords(np.array([*map(quality_lm.word_hash, rare)], np.uint64), np.array([docs[w] for w in rare]), np.array([*map(quality_lm.shape_of, rare)]))
    want = []
    for t, good in zip(tokens, trusted):
        mine = Counter(w for w in t if w not in vocab.ids)
        p = model.tokens([*mine], set(t) if good else None)
        p = words.log_prob([*mine], [*map(quality_lm.shape_of, mine)], p, int(good)) if mine else p
        want.append(sum(p * [*mine.values()]))
    looked_up, look_up = [0], quality_lm._look_up

    def counted(known, values, keys):
        looked_up[0] += len(keys)
        return look_up(known, values, keys)

    monkeypatch.setattr(quality_lm, "_look_up", counted)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    k = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(k)), pa.array(texts), pa.array(trusted), pa.array(range(k)), pa.array(["en"] * k)], [*"abcde"])
    got = []
    for out in quality_lm._blocks(iter([batch]), vocab, [0, 1], model, words):
        for docs, keys, tfs in zip(*(out.column(i).to_pylist() for i in (2, 3, 4))):
            if keys is None:
                m = len(tfs) // 4
                got += np.frombuffer(docs[9 * m : 17 * m], "<f8").tolist()
    return got, want, looked_up[0]


def test_spellings_of_blocks_match_those_of_single_documents(monkeypatch):
    rng = random.Random(4)
    extra = ["Été", "été", "ÉTÉ", "naïveX", "日本語", "x_1", "½", "42", "!?", "—", "Z", "ab" * 30]
    texts = [" ".join(rng.choice([*WORDS, *extra, rng.choice(WORDS) + rng.choice(WORDS)]) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["", WORDS[0], "zzz unseen zzz 7"]
    trusted = [i % 3 != 1 for i in range(60)] + [False] * 3
    for block, kept in ((1000, 200_000), (7, 200_000), (7, 30)):
        with monkeypatch.context() as m:
            m.setattr(quality_lm, "BLOCK_DOCS", block)
            m.setattr(quality_lm, "LEXICON", kept, raising=False)
            m.setattr(quality_lm, "SLICE", 50 * block)
            got, want, _ = spelling_sums(texts, trusted, 30, m)
        assert got == pytest.approx(want, rel=1e-9) and len({*want}) > 50


def test_a_block_looks_up_what_its_documents_share_once(monkeypatch):
    text = " ".join(a + b for a in WORDS for b in WORDS[:8])
    with monkeypatch.context() as m:
        once = spelling_sums([text], [True], 10**9, m)[2]
    with monkeypatch.context() as m:
        got, want, often = spelling_sums([text] * 50, [True] * 50, 10**9, m)
    assert got == pytest.approx(want, rel=1e-9)
    assert often == once > 0


def test_long_secrets_go_whole(spark):
    secret = "Ab3" * 70
    df = spark.createDataFrame([(f'login config\ntoken = "{secret}" end',)], "text string")
    found = df.select(pii.found(F.col("text"), pii.SECRET).alias("x")).first()["x"]
    assert [x["s"] for x in found] == [f'token = "{secret}"']


def test_vocabulary_counts_words_over_all_tasks(spark):
    texts = ["common " * 99_994 + "rarely " * 6, "common " * 19_988 + "rarely " * 12]  # 18 of 120,000: more than SHARE
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    assert "rarely" in quality_lm.vocabulary(docs).ids


def test_rows_of_one_id_are_judged_each(spark):
    texts, labels = corpus(3)
    junk = texts[125][1]
    rows = [(i, t, "en") for i, t in texts if i < 200] + [(90, junk, "de"), (None, junk, "en"), (None, texts[70][1], None), (91, junk, None), (91, texts[71][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_lm.decide(docs, table).collect()
    assert len(out) == len(rows) and {r.lang for r in out if r.doc_id == 90} == {"en", "de"}
    kept = [(r.doc_id, r.text, r.lang) for r in quality_lm.keep(docs, table).collect()]
    assert (90, dict(texts)[90], "en") in kept and (91, texts[71][1], "en") in kept and (None, texts[70][1], None) in kept
    assert not [t for _, t, _ in kept if t == junk] and len(kept) == len(rows) - 3
    for r in out:  # a threshold is a quantile of the language's trusted rows, or of all, plus a margin
        assert r.keep == (r.perplexity <= r.threshold)


def spans_by_plain_code(texts):
    """Known spans of texts that the model has to accept or reject."""
    rng = random.Random(4)
    out = []
    for i in range(texts):
        a, b = (f"4{rng.randrange(10**14):014d}" for _ in range(2))
        a, b = (x + next(str(d) for d in range(10) if luhn(x + str(d))) for x in (a, b))
        bad = a[:-1] + str((int(a[-1]) + 1) % 10)
        out += [f"pay {a} now", f"order {bad} ok", f"cards {a} {b} here", f"ring +1 (826) 555-{rng.randrange(10**4):04d} 190.137.223.{rng.randrange(200)} then"]
    return out


def test_the_model_accepts_parts_and_rejects_impostors(documents):
    texts = list(enumerate(spans_by_plain_code(30)))
    rows = {r.doc_id: r for r in pii.find(documents(texts)).collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(documents(texts)).collect()}
    for i, t in texts:
        got = sorted(t[s.start : s.end] for s in rows[i].spans)
        base = [(pii.KINDS[s.kind], s.start, s.end) for s in rows[i].base]
        assert base == base_spans(t)
        words = t.split()
        if words[0] == "order":
            assert not got and redacted[i] == t
        elif words[0] == "cards" and not base:
            assert got == sorted(words[1:3]) and redacted[i] == "cards <CARD> <CARD> here"
        elif words[0] == "ring":
            assert redacted[i] == "ring <PHONE> <IP> then"
        marks = [(s.start, s.end) for s in rows[i].spans]
        inside = {k for a, z in marks for k in range(a, z)}
        outside = "".join(c for k, c in enumerate(t) if k not in inside)
        assert re.sub("<[A-Z]+>", "", redacted[i]) == outside  # exactly the spans went


def test_em_equals_one_that_takes_every_item_alone():
    rng = random.Random(5)
    items = [(rng.randrange(3), tuple(rng.choice([-1, 0, 1]) for _ in pii.LABELERS)) for _ in range(400)]
    post = [1 / (1 + math.exp(-sum(w * x for w, x in zip(pii.WEIGHTS.values(), v)))) for _, v in items]
    for _ in range(40):
        like = [[[(1.0 if x * (2 * c - 1) > 0 else 0.5) for x in (-1, 0, 1)] for _ in pii.LABELERS] for c in (0, 1)]
        for c in (0, 1):  # the anchored rule
            like[c][0][2 * c] += pii.SOUND * len(items)
            like[c][0][2 - 2 * c] += (1 - pii.SOUND) * len(items)
        prior = [[1.0, 1.0] for _ in pii.KINDS]
        for (k, v), p in zip(items, post):
            for c, share in ((0, 1 - p), (1, p)):
                prior[k][c] += share
                for j, x in enumerate(v):
                    like[c][j][x + 1] += share
        like = [[[y / sum(t) for y in t] for t in side] for side in like]
        odds = [math.log(prior[k][1] / prior[k][0]) + sum(math.log(like[1][j][x + 1] / like[0][j][x + 1]) for j, x in enumerate(v)) for k, v in items]
        post = [1 / (1 + math.exp(-max(-30, min(30, z)))) for z in odds]
    got = pii.expectation_maximisation([(k, v, n) for (k, v), n in Counter(items).items()])
    assert all(got[i] == pytest.approx(p, abs=1e-9) for i, p in zip(items, post))


def test_classifier_finds_the_best_weights():
    rng = np.random.default_rng(3)
    rows = [(tuple(int(rng.integers(n)) for _, n in pii.FEATURES), float(rng.integers(1, 40)), 0.0) for _ in range(80)]
    rows = [(x, n, n * float(rng.random())) for x, n, _ in rows]
    bias, w = pii.fit_classifier(rows)

    def loss(bias, w):
        out = pii.RIDGE / 2 * (bias**2 + sum(a * a for u in w for a in u))
        for x, n, p in rows:
            z = bias + sum(w[j][i] for j, i in enumerate(x))
            out += n * math.log1p(math.exp(z)) - p * z
        return out

    best = loss(bias, w)
    for _ in range(50):
        assert loss(bias + rng.normal(0, 0.05), [[a + rng.normal(0, 0.05) for a in u] for u in w]) > best


def test_personal_data_of_nothing_and_of_long_texts(documents):
    assert pii.find(documents([])).count() == 0
    long = "x " * 200_000 + "joe@example.com " + "y " * 10
    r = pii.find(documents([(1, long)])).first()
    assert [(s.kind, s.start, s.end) for s in r.spans] == [(0, 400_000, 400_015)]
