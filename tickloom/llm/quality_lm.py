"""Quality by the perplexity of an interpolated modified Kneser-Ney model, trained on trusted text.

Tokens are words, numbers and runs of symbols.  The vocabulary holds the tokens that make up at least SHARE of the
trusted ones (so it has at most 1 / SHARE entries, which is what lets it and all per-word tables be broadcast); any
other token counts as its shape (lower case, capitalised, upper case, mixed, number, mixed with digits, symbols), and its
probability is that of the shape times that of the word among words of the shape: all trusted words outside the vocabulary
have their exact numbers of documents there, with three discounts, above the probability of the spelling.  The word
model is a bigram model: raw counts with three discounts above (a bigram counts once a document, so that a repetitive one can't teach the model its line), continuation counts with three discounts below, then
the uniform distribution.  A third order would make keys of 8 bytes for nearly every token of the corpus and alone pass
the disk that the check tool grants, so it is left out.

The spelling model is an interpolated modified Kneser-Ney model of the UTF-8 bytes of a token, four at a time, that starts
with the shape; letter case is left to the shape.  It learns from all tokens of the trusted texts, in the vocabulary or
not, each once a document.  There are at most 2 ** 32 four-grams of bytes and in practice some hundred thousand, so its
tables are broadcast.  So are the words outside the vocabulary, 16 bytes each (a 64-bit hash and a count), however many.

Counts of word bigrams live in shards by a hash of the bigram.
1. vocabulary: tokens of the trusted texts counted exactly, those with less than SHARE dropped after the sum; byte four-grams
   from the same table of words;
2. counts: blocks of trusted documents send their bigrams to the shards, which add them up; counts of counts
   and per-word context and continuation sums go to the driver (a few numbers a word);
3. scoring: blocks of all documents send the distinct bigrams of each document to the shards, a shard joins them with
   its counts and sends a sum of log-probabilities a document back to the block, which adds the shards up; a task
   works out what depends on a token alone once for all new tokens of a block (``Lexicon``).
What scoring moves is proportional to the corpus.  Since a document sends a bigram once, with its frequency, a frequent
pair makes no shard hot.

A trusted document is scored without its own counts (of bigrams, of words outside the vocabulary and of byte four-grams), so that thresholds hold for documents the model hasn't seen.
``log_prob`` is of the words and shapes, ``spelling`` of the tokens outside the vocabulary, given their shapes.
A document's score is the mean negative of their sum a token, after PRIOR tokens of its language's trusted mean, so
that a document of a few words is not judged by one rare word; ``perplexity`` is the exponential of that.  The threshold
of a language is the quantile QUANTILE of its trusted documents plus MARGIN; a language without trusted documents takes
that of all trusted documents; without any trusted document everything is kept.

A row's language and a hash of its text go with it, so rows of one id are judged each, and ``keep`` drops rows, not ids.

Defined cases: a null or empty text has the prior's perplexity and is kept; a null or empty language is a language of its
own; a null id is never trusted; rows repeated are scored each; labels repeated count once; texts of any length are read
whole (one above BLOCK_CHARS is a block of its own); a score that equals the threshold is kept; an empty table gives an
empty result; other columns, whatever their names, are not read by ``decide`` and are kept by ``keep``.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import MAX_BROADCAST_IDS, cut, keep_ids, mark_ids, shard_keys, small_join, table, text_of

#: Least share of the trusted tokens that a word of the vocabulary has.
SHARE = 1 / 8000
QUANTILE = 0.995
#: Added to the quantile of the mean negative log-probability.
MARGIN = 0.10
#: Tokens of the language's mean that a document's own tokens are averaged with.
PRIOR = 30.0
#: Documents and characters of a block at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_CHARS = 1000, 4_000_000

#: Different tokens that a task keeps from block to block at most, with ten times as many byte four-grams.
LEXICON = 200_000

#: Shuffle partitions for each shard: a shard's rows are small, and every shard sends a sum for each document back.
PARTITIONS_PER_SHARD = 4

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\w+|[^\w\s]+")
START, END = 0, 1
#: Shapes of tokens outside the vocabulary, after START and END.
LOWER, TITLE, UPPER, MIXED, NUMBER, ALNUM, SYMBOL = range(2, 9)
#: A run of symbols has one of so many shapes, by its first character.
SYMBOLS = 32
FIRST_WORD = SYMBOL + SYMBOLS


def shape_of(token: str) -> int:
    if token.isalpha():
        if token.islower():
            return LOWER
        if token.isupper():
            return UPPER if len(token) > 1 else TITLE
        return TITLE if token[1:].islower() else MIXED
    if token.isdigit():
        return NUMBER
    return ALNUM if token[0].isalnum() or token[0] == "_" else SYMBOL + ord(token[0]) % SYMBOLS


class Vocabulary:
    def __init__(self, words: list[str]):
        self.ids = {w: FIRST_WORD + i for i, w in enumerate(words)}
        self.size = FIRST_WORD + len(words)

    def codes(self, tokens: list[str], shapes: list[int]) -> np.ndarray:
        """The number of each token of the vocabulary, the shape of any other."""
        return np.fromiter(map(self.ids.get, tokens, shapes), np.int64, len(tokens))

    def encode(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text)
        return np.array([START, *self.codes(tokens, [*map(shape_of, tokens)]), END], np.int64)


#: Bytes that UTF-8 never has: the shape that a token starts with, three times, and its end.
SHAPE_BYTE, END_BYTE = 0xF8 - LOWER, 0xFF
_STARTS = {s: bytes([SHAPE_BYTE + s]) * 3 for s in range(LOWER, SYMBOL + 1)}
#: Byte four-grams that are looked up or added up at a time.
SLICE = 1 << 20


def spelt(token: str, shape: int | None = None) -> bytes:
    shape = min(shape_of(token) if shape is None else shape, SYMBOL)
    return _STARTS[shape] + (token.lower() if shape in (TITLE, UPPER) else token).encode() + b"\xff"


def four_grams(tokens: Iterable[str], shapes: Iterable[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The four-grams whose last byte the spelling model predicts, and the number of them in each token."""
    parts = [*map(spelt, tokens)] if shapes is None else [*map(spelt, tokens, shapes)]
    b = np.frombuffer(b"".join(parts), np.uint8)
    x = b.astype(np.uint32)
    keys = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    return keys[(b[3:] < 0xF8) | (b[3:] == END_BYTE)], np.array([len(p) - 3 for p in parts], np.int64)


def _spelling_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) from (word, docs): byte four-grams, each as often as documents have a word with it."""
    for b in batches:
        words, docs = b.column(0).to_pylist(), b.column(1).to_numpy()
        for a in range(0, len(words), 50_000):
            keys, lengths = four_grams(words[a : a + 50_000])
            keys, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, np.repeat(docs[a : a + 50_000], lengths), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "n"])


def _look_up(known: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of the keys, 0 for unknown ones.  known is sorted."""
    if not len(known):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


class Spelling:
    """Interpolated modified Kneser-Ney over four-grams of bytes: raw counts, below them continuation counts of three, two
    and one byte, then the uniform distribution."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order].astype(np.uint32), counts[order].astype(np.int64)
        self.d, self.heads, self.totals, self.spare = self._level(self.keys, self.counts)
        p = np.full(1, 1 / 256)  # of the uniform distribution, for every context of no byte
        for n in (1, 2):
            known, cont = self._continuations(n)
            d, heads, totals, spare = self._level(known, cont)
            p = np.tile(p, 1 << 8) if len(p) > 1 else np.repeat(p, 256)
            full, back = np.zeros(256**n), np.ones(256 ** (n - 1))
            back[heads] = spare / totals
            full[known] = (cont - d[np.minimum(cont, 3)]) / _look_up(heads, totals, known >> 8)
            p = full + np.repeat(back, 256) * p
        self.two = p
        self.threes, cont = self._continuations(3)
        d, heads, totals, spare = self._level(self.threes, cont)
        self.back = np.ones(1 << 16)
        self.back[heads] = spare / totals
        self.three = (cont - d[np.minimum(cont, 3)]) / _look_up(heads, totals, self.threes >> 8)

    def _continuations(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The last n bytes of the known n-grams that are one byte longer, and in how many of those they are."""
        longer = self.keys if n == 3 else np.unique(self.keys & np.uint32((1 << 8 * (n + 1)) - 1))
        return np.unique(longer & np.uint32((1 << 8 * n) - 1), return_counts=True)

    @staticmethod
    def _level(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Discounts; of each context its key, its count and what is discounted in it."""
        d = discounts([(counts == j).sum() for j in (1, 2, 3, 4)])
        heads, at = np.unique(keys >> 8, return_inverse=True)
        return d, heads, np.bincount(at, counts, len(heads)), np.bincount(at, d[np.minimum(counts, 3)], len(heads))

    def parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key its count, what is added to its discounted count, and what both are divided by."""
        last = keys & np.uint32(0xFFFFFF)
        low = _look_up(self.threes, self.three, last) + self.back[last >> 8] * self.two[last & np.uint32(0xFFFF)]
        c = _look_up(self.heads, self.totals, keys >> 8)
        spare = np.where(c > 0, _look_up(self.heads, self.spare, keys >> 8), 1.0)
        return _look_up(self.keys, self.counts, keys), spare * low, np.maximum(c, 1)

    def mix(self, n: np.ndarray, added: np.ndarray, divisor: np.ndarray) -> np.ndarray:
        return np.log((n - self.d[np.minimum(n, 3)] + added) / divisor)

    def log_prob(self, keys: np.ndarray, own: np.ndarray | int = 0) -> np.ndarray:
        """own: counts of the keys to be left out."""
        n, added, divisor = self.parts(keys)
        return self.mix(np.maximum(n - own, 0), added, divisor)

    def tokens(self, tokens: list[str], own: Iterable[str] | None = None) -> np.ndarray:
        """The log-probability of each token's spelling.  own: different tokens whose counts are left out."""
        if not tokens:
            return np.zeros(0)
        if own is not None:
            mine, times = np.unique(four_grams(own)[0], return_counts=True)
        keys, lengths = four_grams(tokens)
        p = np.empty(len(keys))
        for a in range(0, len(keys), SLICE):
            k = keys[a : a + SLICE]
            p[a : a + SLICE] = self.log_prob(k, 0 if own is None else _look_up(mine, times, k))
        return np.add.reduceat(p, np.cumsum(lengths) - lengths)


def word_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token)  # of its UTF-8


class RareWords:
    """Modified Kneser-Ney of the words of a shape: all trusted words outside the vocabulary, by the number of documents that
    have them, then the spelling."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, shapes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.int64)
        self.d = discounts([(counts == j).sum() for j in (1, 2, 3, 4)])
        self.totals = np.bincount(shapes, counts, FIRST_WORD)
        spare = np.bincount(shapes, self.d[np.minimum(counts, 3)], FIRST_WORD)
        with np.errstate(divide="ignore"):  # a shape without words has the spelling alone
            self.log_back = np.log(np.where(self.totals > 0, spare / np.maximum(self.totals, 1), 1.0))

    def documents(self, tokens: list[str]) -> np.ndarray:
        """The number of documents that have each token."""
        hashes = np.fromiter(map(word_hash, tokens), np.uint64, len(tokens))
        order = np.argsort(hashes)  # neighbours lie together in the table, which may be long
        n = np.empty(len(tokens), np.int64)
        n[order] = _look_up(self.hashes, self.counts, hashes[order])
        return n

    def mix(self, n: np.ndarray, shape: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        high = (n - self.d[np.minimum(n, 3)]) / np.maximum(self.totals[shape], 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(high), self.log_back[shape] + spelt)

    def log_prob(self, tokens: list[str], shapes: list[int], spelt: np.ndarray, own: int = 0) -> np.ndarray:
        """spelt: log-probabilities of the spellings; own: documents to be left out of each count."""
        return self.mix(np.maximum(self.documents(tokens) - own, 0), np.array(shapes, np.int64), spelt)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Lexicon:
    """Numbers of a task's tokens in order of appearance, and what depends on the token alone, worked out once for the new
    tokens of a block: its code and, with the models, its four-grams, trusted documents and log-probability.

    ``forget`` is called between blocks, since it makes all numbers given before void.
    """

    def __init__(self, vocab: Vocabulary, model: Spelling | None = None, words: RareWords | None = None):
        self.vocab, self.model, self.words = vocab, model, words
        self.forget()

    def forget(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.codes, self.grams = np.empty(0, np.int64), np.empty(0, np.uint32)
        self.starts, self.lengths, self.docs = (np.empty(0, np.int64) for _ in range(3))
        self.free = np.empty(0)  # log-probabilities given the shapes, 0 in the vocabulary

    def full(self) -> bool:
        return len(self.codes) > LEXICON or len(self.grams) > 10 * LEXICON

    def number(self, text: str) -> np.ndarray:
        """The numbers of a text's tokens; the arrays know them after ``learn``."""
        tokens = _TOKEN.findall(text)
        return np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))

    def learn(self) -> None:
        new = list(islice(self.numbers, len(self.codes), None))
        if not new:
            return
        shapes = [*map(shape_of, new)]
        codes = self.vocab.codes(new, shapes)
        self.codes = np.concatenate([self.codes, codes])
        if self.model is None:
            return
        grams, lengths = four_grams(new, shapes)
        starts = np.cumsum(lengths) - lengths
        p = np.empty(len(grams))
        for a in range(0, len(grams), SLICE):
            keys, at = np.unique(grams[a : a + SLICE], return_inverse=True)
            p[a : a + SLICE] = self.model.log_prob(keys)[at]
        spelt = np.add.reduceat(p, starts)
        rare = np.flatnonzero(codes < FIRST_WORD)
        docs, free = np.zeros(len(new), np.int64), np.zeros(len(new))
        docs[rare] = self.words.documents([new[i] for i in rare.tolist()])
        free[rare] = self.words.mix(docs[rare], codes[rare], spelt[rare])
        self.starts = np.concatenate([self.starts, starts + len(self.grams)])
        self.grams = np.concatenate([self.grams, grams])
        self.lengths, self.docs, self.free = (np.concatenate(x) for x in ((self.lengths, lengths), (self.docs, docs), (self.free, free)))

    def spellings(self, docs: list[np.ndarray], good: np.ndarray) -> np.ndarray:
        """Sums of the words outside the vocabulary, given their shapes, of documents as numbers of tokens."""
        out = np.array([self.free[d].sum() for d in docs])
        trusted = np.flatnonzero(good)
        if not len(trusted):
            return out
        used = np.unique(np.concatenate([docs[i] for i in trusted]))
        lengths = self.lengths[used]
        keys, at = np.unique(self.grams[_ranges(self.starts[used], lengths)], return_inverse=True)
        starts = np.zeros(len(self.codes), np.int64)  # of the four-grams of a token in at
        starts[used] = np.cumsum(lengths) - lengths
        n, added, divisor = self.model.parts(keys)
        times = np.zeros(len(keys), np.int64)
        for i in trusted:
            mine, tfs = np.unique(docs[i], return_counts=True)
            outside = self.codes[mine] < FIRST_WORD
            rare, common = mine[outside], mine[~outside]
            if not len(rare):
                continue
            lengths = self.lengths[rare]
            grams, others = at[_ranges(starts[rare], lengths)], at[_ranges(starts[common], self.lengths[common])]
            np.add.at(times, grams, 1)
            np.add.at(times, others, 1)
            if len(grams) < len(keys):
                p = self.model.mix(np.maximum(n[grams] - times[grams], 0), added[grams], divisor[grams])
            else:  # a long document has each key many times
                p = self.model.mix(np.maximum(n - times, 0), added, divisor)[grams]
            times[grams] = times[others] = 0
            spelt = np.add.reduceat(p, np.cumsum(lengths) - lengths)
            out[i] = self.words.mix(np.maximum(self.docs[rare] - 1, 0), self.codes[rare], spelt) @ tfs[outside]
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all tokens of this task and of the texts that have them, some hundred thousand words at a time, and
    under null the number of its tokens."""
    counts, docs, total = Counter(), Counter(), 0

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], ["word", "n", "docs"])

    for b in batches:
        for t in b.column(0):
            mine = Counter(_TOKEN.findall(t.as_py()))
            counts.update(mine)
            docs.update(mine.keys())
            total += mine.total()
            if len(counts) > 300_000:
                yield out([(w, n, docs[w]) for w, n in counts.items()])
                counts, docs = Counter(), Counter()
    yield out([*((w, n, docs[w]) for w, n in counts.items()), (None, total, 0)])


def word_table(trusted: DataFrame) -> DataFrame:
    """word, n (its tokens), docs (texts that have it); under null the number of all tokens.  One pass over the texts."""
    rows = trusted.select(text_of()).mapInArrow(_word_counts, "word string, n long, docs long")
    return cut(rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def least(sums: DataFrame) -> float:
    """Tokens that a word of the vocabulary has at least."""
    return max(1, SHARE * (sums.where("word is null").agg(F.sum("n")).first()[0] or 0))


def frequent(sums: DataFrame) -> Vocabulary:
    rows = sums.where(F.col("word").isNotNull() & (F.col("n") >= least(sums))).select("word").collect()
    return Vocabulary(sorted(r["word"] for r in rows))


def vocabulary(trusted: DataFrame) -> Vocabulary:
    return frequent(word_table(trusted))


def spelling(sums: DataFrame) -> Spelling:
    rows = sums.where("word is not null").select("word", "docs").mapInArrow(_spelling_counts, "key long, n long")
    counts = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return Spelling(counts.column("key").to_numpy(), counts.column("n").to_numpy())


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, docs, shape) from (word, docs)."""
    for b in batches:
        words = b.column(0).to_pylist()
        hashes = np.fromiter(map(word_hash, words), np.uint64, len(words)).view(np.int64)
        shapes = np.fromiter(map(shape_of, words), np.int32, len(words))
        yield pa.RecordBatch.from_arrays([pa.array(hashes), b.column(1).cast(pa.int32()), pa.array(shapes)], ["hash", "docs", "shape"])


def rare_words(sums: DataFrame) -> RareWords:
    """All words that ``frequent`` leaves out."""
    rows = sums.where(F.col("word").isNotNull() & (F.col("n") < least(sums))).select("word", "docs").mapInArrow(_rare_words, "hash long, docs int, shape int").toArrow()
    hashes, docs, shapes = (rows.column(c).to_numpy() for c in ("hash", "docs", "shape"))
    return RareWords(hashes.view(np.uint64), docs, shapes)


BLOCK_ROWS = "shard long, block long, docs binary, keys binary, tfs binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "block", "docs", "keys", "tfs"])


def hash_keys(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64)


def bigrams(ids: np.ndarray, size: int) -> np.ndarray:
    return ids[:-1] * size + ids[1:]


def _blocks(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, shards: list[int], model: Spelling | None = None, words: RareWords | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of blocks for the shards.  Without a model: one count a document that has the bigram (for counting).

    The third column tells (in the top bit of docs) whether a document is trusted, so that its own counts are left out
    when it is scored.  A block's own row (docs: ids as int64, a null mask, spellings as double, hashes as int64, whether
    trusted, languages as JSON; tfs: tokens) goes to a shard that passes it on.
    """
    from pyspark import TaskContext

    base, number = TaskContext.get().partitionId() << 32, 0
    doc_ids, numbers, chars, good, hashes, langs = [], [], 0, [], [], []
    merge, lexicon = model is None, Lexicon(vocab, model, words)

    def flush():
        nonlocal doc_ids, numbers, chars, good, number, hashes, langs
        trusted = np.array(good, np.int64)
        block, out = base + number, []
        lexicon.learn()
        keys = [bigrams(np.concatenate([[START], lexicon.codes[d], [END]]), vocab.size) for d in numbers]
        own = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        both, tfs = np.unique(own << 40 | np.concatenate(keys), return_counts=True)
        docs, key = both >> 40, both & ((1 << 40) - 1)
        if merge:
            key, tfs = np.unique(key, return_counts=True)
            docs = np.zeros(len(key), np.int64)
        part = hash_keys(key) % len(shards)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(len(shards) + 1))
        for s in range(len(shards)):
            at = order[edges[s] : edges[s + 1]]
            if len(at):
                sent = docs[at] | trusted[docs[at]] << 15
                out.append((shards[s], block, sent.astype("<u2").tobytes(), key[at].astype("<u4").tobytes(), tfs[at].astype("<u4").tobytes()))
        if not merge:
            ids = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], np.uint8).tobytes()
            ids += lexicon.spellings(numbers, trusted).astype("<f8").tobytes() + np.array(hashes, "<i8").tobytes() + trusted.astype(np.uint8).tobytes()
            ids += json.dumps(langs).encode()
            out.append((shards[block % len(shards)], block, ids, None, np.array([len(k) for k in keys], "<u4").tobytes()))
        doc_ids, numbers, chars, good, number, hashes, langs = [], [], 0, [], number + 1, [], []
        if lexicon.full():
            lexicon.forget()
        return _rows(out)

    for b in batches:
        more = zip(b.column(3).to_pylist(), b.column(4).to_pylist()) if not merge else [(0, "")] * len(b)
        for i, t, g, (hashed, lang) in zip(b.column(0), b.column(1), b.column(2).to_pylist(), more):
            text = t.as_py()
            if numbers and (len(numbers) >= BLOCK_DOCS or chars + len(text) > BLOCK_CHARS):
                yield flush()
            doc_ids.append(i.as_py())
            numbers.append(lexicon.number(text))
            if not merge:
                hashes.append(hashed)
                langs.append(lang)
            good.append(g)
            chars += len(text)
    if numbers:
        yield flush()


def _add_up(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of the shards of this task: one row (block -1) a shard."""
    shard, keys, ns = None, [], []

    def merged():
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(inverse, np.concatenate(ns)).astype("<u4")

    def row():
        k, n = merged()
        return _rows([(shard, -1, None, k.tobytes(), n.tobytes())])

    for b in batches:
        for s, k, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            if s != shard:
                if keys:
                    yield row()
                shard, keys, ns = s, [], []
            keys.append(np.frombuffer(k, "<u4"))
            ns.append(np.frombuffer(n, "<u4"))
            if sum(map(len, keys)) > 4_000_000:
                k, n = merged()
                keys, ns = [k], [n]
    if keys:
        yield row()


def _word_sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(word, what, n): of a context its tokens (0) and its bigrams seen once, twice, oftener (1-3), of a word its
    different contexts (4); under word -1 the bigrams seen 1, 2, 3, 4 times (1-4)."""
    sums = np.zeros((5, size), np.int64)
    seen = np.zeros(5, np.int64)
    for b in batches:
        for k, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            k, n = np.frombuffer(k, "<u4"), np.frombuffer(n, "<u4")
            first, second = k // size, k % size
            sums[0] += np.bincount(first, n, size).astype(np.int64)
            for j in (1, 2, 3):
                sums[j] += np.bincount(first[np.minimum(n, 3) == j], minlength=size)
            sums[4] += np.bincount(second, minlength=size)
            seen += np.bincount(np.minimum(n, 5), minlength=6)[:5]
    what, word = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([word, [-1] * 4])), pa.array(np.concatenate([what, [1, 2, 3, 4]])), pa.array(np.concatenate([sums[what, word], seen[1:]]))],
        ["word", "what", "n"],
    )


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0) = 0, D(1), D(2), D(3 and more) from the number of n-grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(j - (j + 1) * y * b / a, 0.05), j - 0.05) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


class KneserNey:
    """The tables that are as long as the vocabulary; bigram counts stay in their shards."""

    def __init__(self, size: int, sums: np.ndarray, seen: np.ndarray):
        self.size, self.d = size, discounts(seen)
        self.context = sums[0].astype(float)
        self.spare = self.d[1] * sums[1] + self.d[2] * sums[2] + self.d[3] * sums[3]
        cont = sums[4].astype(float)
        low = discounts([(cont == j).sum() for j in (1, 2, 3, 4)])
        cut_off = low[np.minimum(cont, 3).astype(int)]
        total = max(cont.sum(), 1.0)
        self.unigram = (cont - cut_off) / total + cut_off.sum() / total / size if cont.any() else np.full(size, 1 / size)

    def log_prob(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first, second = keys // self.size, keys % self.size
        low, c = self.unigram[second], self.context[first]
        high = (counts - self.d[np.minimum(counts, 3)] + self.spare[first] * low) / np.maximum(c, 1)
        return np.log(np.where(c > 0, high, low))


def _score(batches: Iterator[pa.RecordBatch], model: KneserNey) -> Iterator[pa.RecordBatch]:
    """Rows of a shard, its counts first, to sums of each block's documents."""
    shard, known, counts = None, np.empty(0, "<u4"), np.empty(0, "<u4")
    for b in batches:
        out = []
        for s, block, docs, keys, tfs in zip(*(b.column(i).to_pylist() for i in range(5))):
            if s != shard:
                shard, known, counts = s, np.empty(0, "<u4"), np.empty(0, "<u4")
            if block < 0:
                known, counts = np.frombuffer(keys, "<u4"), np.frombuffer(tfs, "<u4")
            elif keys is None:
                out.append((0, block, docs, None, tfs))
            else:
                k = np.frombuffer(keys, "<u4")
                at = np.minimum(np.searchsorted(known, k), max(len(known) - 1, 0))
                n = np.where(known[at] == k, counts[at], 0).astype(np.int64) if len(known) else np.zeros(len(k), np.int64)
                d = np.frombuffer(docs, "<u2")
                n = np.maximum(n - (d >> 15), 0)
                sums = np.bincount(d & 0x7FFF, model.log_prob(k.astype(np.int64), n) * np.frombuffer(tfs, "<u4"))
                there = np.flatnonzero(sums)
                if 5 * len(there) < 4 * len(sums):  # with many shards a document is in a few of them
                    out.append((1, block, there.astype("<u2").tobytes(), None, sums[there].astype("<f8").tobytes()))
                else:
                    out.append((1, block, None, None, sums.astype("<f8").tobytes()))
        if out:
            yield _rows(out)


SCORED = "doc_id long, n_tokens long, log_prob double, spelling double, hash long, trusted boolean, lang string"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, its own first, to its documents."""
    block, ids, tokens, sums, spellings, rest = None, [], None, None, None, []

    def done():
        columns = [pa.array(ids, pa.int64()), pa.array(tokens.astype(np.int64)), pa.array(sums), pa.array(spellings), *rest]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])

    for b in batches:
        for part, k, docs, tfs in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if not part:
                if block is not None:
                    yield done()
                block, n = k, len(tfs) // 4
                ids = [None if m else int(i) for i, m in zip(np.frombuffer(docs[: 8 * n], "<i8"), docs[8 * n : 9 * n])]
                spellings = np.frombuffer(docs[9 * n : 17 * n], "<f8")
                good = np.frombuffer(docs[25 * n : 26 * n], np.uint8).astype(bool)
                rest = [pa.array(np.frombuffer(docs[17 * n : 25 * n], "<i8")), pa.array(good), pa.array(json.loads(docs[26 * n :]), pa.string())]
                tokens, sums = np.frombuffer(tfs, "<u4"), np.zeros(n)
            else:
                got = np.frombuffer(tfs, "<f8")
                if docs is None:
                    sums[: len(got)] += got
                else:
                    sums[np.frombuffer(docs, "<u2")] += got
    if block is not None:
        yield done()


def train(trusted: DataFrame) -> tuple[Vocabulary, KneserNey, DataFrame, Spelling, RareWords]:
    """Vocabulary, per-word tables, the shards' counts, the spelling model and the words outside the vocabulary."""
    spark = trusted.sparkSession
    sums_of_words = word_table(trusted)
    vocab = frequent(sums_of_words)
    shards = shard_keys(spark, PARTITIONS_PER_SHARD)
    shared = spark.sparkContext.broadcast(vocab)
    sent = trusted.select(F.col("doc_id").cast("long"), text_of(), F.lit(True)).mapInArrow(lambda b: _blocks(b, shared.value, shards), BLOCK_ROWS)
    size = vocab.size
    counts = cut(
        sent.repartition(len(shards), "shard").sortWithinPartitions("shard").mapInArrow(lambda b: _add_up(b, size), BLOCK_ROWS)
    )
    sums, seen = np.zeros((5, size)), np.zeros(4)
    per_word = counts.mapInArrow(lambda b: _word_sums(b, size), "word long, what long, n long")
    for r in per_word.groupBy("word", "what").agg(F.sum("n").alias("n")).collect():  # five numbers a word of the vocabulary
        if r["word"] < 0:
            seen[r["what"] - 1] = r["n"]
        else:
            sums[r["what"], r["word"]] = r["n"]
    return vocab, KneserNey(size, sums, seen), counts, spelling(sums_of_words), rare_words(sums_of_words)


def score(docs: DataFrame, vocab: Vocabulary, model: KneserNey, counts: DataFrame, spellings: Spelling, rare: RareWords, trusted: Column) -> DataFrame:
    """SCORED for every row of docs.  trusted: whether the model was trained on the row."""
    spark = docs.sparkSession
    shards = shard_keys(spark, PARTITIONS_PER_SHARD)
    v, m, w, u = (spark.sparkContext.broadcast(x) for x in (vocab, model, spellings, rare))
    own = (F.xxhash64(text_of()), F.coalesce(F.col("lang").cast("string"), F.lit("")))
    sent = docs.select(F.col("doc_id").cast("long"), text_of(), trusted, *own).mapInArrow(lambda b: _blocks(b, v.value, shards, w.value, u.value), BLOCK_ROWS)
    by_shard = sent.unionByName(counts).repartition(len(shards), "shard").sortWithinPartitions("shard", "block")
    sums = by_shard.mapInArrow(lambda b: _score(b, m.value), BLOCK_ROWS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sums.repartition(n, "block").sortWithinPartitions("block", "shard").mapInArrow(_gather, SCORED)


def decide(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, log_prob, perplexity, threshold, keep, spelling and hash (of the text) of every row."""
    trusted_ids = cut(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    trusted = keep_ids(docs, trusted_ids)
    vocab, model, counts, spellings, rare = train(trusted)
    scored = cut(score(mark_ids(docs.select("doc_id", "text", "lang"), trusted_ids, "_good"), vocab, model, counts, spellings, rare, F.col("_good")))
    whole = F.col("log_prob") + F.col("spelling")
    good = scored.where("trusted")
    total = good.agg(-F.sum(whole) / F.sum("n_tokens")).first()[0]
    if total is None:
        p = F.exp(-F.try_divide(whole, "n_tokens"))
        return scored.select("doc_id", "lang", "n_tokens", "log_prob", p.alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"), "spelling", "hash")
    means = good.groupBy("lang").agg((-F.sum(whole) / F.sum("n_tokens")).alias("mean"))
    nll = (-whole + PRIOR * F.coalesce("mean", F.lit(total))) / (F.col("n_tokens") + PRIOR)
    scored = cut(small_join(scored, means, "lang").withColumn("nll", nll).drop("mean"))
    good = scored.where("trusted")
    everywhere = good.agg(F.percentile_approx("nll", QUANTILE, 10_000)).first()[0]
    limits = good.groupBy("lang").agg(F.percentile_approx("nll", QUANTILE, 10_000).alias("limit"))
    limit = F.coalesce("limit", F.lit(everywhere)) + MARGIN
    return small_join(scored, limits, "lang").select(
        "doc_id", "lang", "n_tokens", "log_prob", F.exp("nll").alias("perplexity"), F.exp(limit).alias("threshold"), (F.col("nll") <= limit).alias("keep"), "spelling", "hash"
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    bad = cut(decide(docs, labels).where("not keep").select(F.col("doc_id").alias("_lm_id"), F.col("hash").alias("_lm_hash"), F.col("lang").alias("_lm_lang")).distinct())
    side = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_IDS // 2 else bad
    same = (F.xxhash64(text_of()) == F.col("_lm_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_lm_id"))
    return docs.join(side, same & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("_lm_lang")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
