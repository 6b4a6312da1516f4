"""Document fingerprints by improved consistent weighted sampling.

The terms of a text are its blank-separated words, weighted by how often they occur.  For sample k a term has three
consistent random numbers, r and c from Gamma(2, 1) and beta uniform; with weight w it gets

    t = floor(ln w / r + beta),  y = exp(r (t - beta)),  a = c / (y exp(r)),

and the sample is the (term, t) of the smallest a.  Two texts agree in a sample with a probability that equals their
generalised Jaccard similarity sum(min) / sum(max), so the share of equal samples estimates it; a fingerprint keeps 16
bits of each of SAMPLES samples.

The random numbers come from two tables of 2**16 rows, (r, beta) and c, that 32 bits of a hash of term and sample index,
16 bits each, so that two terms share a triple with a probability of 2**-32, however many words a text has.  a and t are
tabulated for the weights up to TABLED: a sample of a term costs a product and two lookups.

Each document is also compared with the next one by descending id.  Documents are put into slots by quantiles of their
ids (the rows of an id that fills several quantiles into slots by the hash of their text), and neighbouring slots are
joined into ranges of about equal bytes, which are sorted.  The first document of a range is sent to the range before it
as well, so the texts move once and no task sees more than its range.

Defined cases: a null or empty text has no words and the fingerprint of the empty text; two texts without words are
alike (1.0); a null id comes last; rows of equal id are ordered by a hash of their text (so rows of equal id and text
lie in one range, which handles them one by one); a very long text is handled whole, CHUNK words at once; other columns
are left alone, whatever their names; a single document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import shard_keys, table, text_of

SAMPLES = 128
#: Weights for which a and t are tabulated.
TABLED = 16
#: Terms handled at once.
CHUNK = 2048


class WeightedSampler:
    """Signatures of weighted sets.  seed fixes the random numbers, so fingerprints of one seed may be compared."""

    _open: dict[int, WeightedSampler] = {}

    def __init__(self, seed: int = 7, samples: int = SAMPLES):
        rng = np.random.default_rng(seed)
        n = 1 << 16
        self.r, self.c, self.beta = rng.gamma(2.0, size=n), rng.gamma(2.0, size=n), rng.random(n)
        a, t = zip(*(self.sample(np.float64(w), slice(None)) for w in range(1, TABLED + 1)))
        self.a, self.t = np.concatenate(a).astype(np.float32), np.concatenate(t).astype(np.int32)
        self.c = self.c.astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, samples, np.uint64)
        self.samples = samples

    @classmethod
    def shared(cls) -> WeightedSampler:
        if 0 not in cls._open:
            cls._open[0] = cls()
        return cls._open[0]

    def sample(self, w, at):
        """a without its factor c, and t."""
        r, beta = self.r[at], self.beta[at]
        t = np.floor(np.log(w) / r + beta)
        return np.exp(-r * (t - beta) - r), t

    def signature(self, weights: dict[str, int]) -> np.ndarray:
        """16 bits of each sample, as unsigned integers."""
        if not weights:
            return np.zeros(self.samples, np.uint16)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in weights), np.uint64, len(weights))
        w = np.fromiter(weights.values(), np.int64, len(weights))
        best = np.full(self.samples, np.inf, np.float32)
        term, level = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int32)
        k = np.arange(self.samples)
        order = np.argsort(h)  # ties of a go to the smallest hash, whatever the order of the words
        for begin in range(0, len(h), CHUNK):
            part = order[begin : begin + CHUNK]
            hp, wp = h[part], w[part]
            mixed = hp[:, None] * self.odd + self.add
            row = (mixed >> np.uint64(48)).astype(np.int64)
            tabled = row + ((np.minimum(wp, TABLED) - 1) << 16)[:, None]
            a = self.a.take(tabled)
            big = np.flatnonzero(wp > TABLED)
            if len(big):
                a_big, t_big = self.sample(wp[big][:, None].astype(float), row[big])
                a[big] = a_big
            a *= self.c.take(((mixed >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64))
            at = a.argmin(axis=0)
            found = a[at, k]
            t = self.t[tabled[at, k]]
            if len(big):
                place = np.searchsorted(big, at)
                is_big = (place < len(big)) & (big[np.minimum(place, len(big) - 1)] == at)
                t[is_big] = t_big[place[is_big], k[is_big]].astype(np.int32)
            better = found < best
            best[better], term[better], level[better] = found[better], hp[at[better]], t[better]
        mixed = (term ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(48)).astype(np.uint16)

    def of_text(self, text: str) -> np.ndarray:
        return self.signature(Counter(text.split()))


def to_string(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler.shared()
        for b in batches:
            made = [to_string(sampler.of_text(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(run, "doc_id long, fingerprint string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The last third of text replaced by as many first characters of the following one."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler, last = WeightedSampler.shared(), None  # last: range, id, text, signature
    for b in batches:
        rows = []
        for place, extra, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            text = text.as_py()
            sig = None
            if last and last[0] == place:
                sig = sampler.of_text(text)
                edited = edited_text(last[2], text)
                esig = sampler.of_text(edited)
                rows.append((
                    last[1], len(last[2]), hashlib.sha256(edited.encode()).hexdigest(), to_string(last[3]), to_string(esig),
                    likeness(last[3], esig), likeness(last[3], sig),
                ))
            last = None if extra else (place, i, text, sig if sig is not None else sampler.of_text(text))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [c.split()[0] for c in COMPARED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _edges_below(key: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are below key, in two steps of about the square root of their number."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges) - 1) + 1
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    c = F.size(F.filter(F.array(*(F.lit(g[0]) for g in groups)), lambda e: e < key))
    group = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(c, F.lit(1)))
    return F.when(c == 0, 0).otherwise((c - 1) * step + F.size(F.filter(group, lambda e: e < key)))


#: Slots a range: the more, the closer the ranges come to equal bytes.
SLOTS = 8
#: What a row weighs beside the bytes of its text.
ROW_BYTES = 200


def _slot(key: Column, tie: Column, edges: list[int]) -> Column:
    """Numbers that rise with key and, for a key that is m > 1 of the edges, fall with tie in m steps."""
    own = sorted(set(edges))
    if not own:
        return F.lit(0).cast("long")
    most = max(edges.count(e) for e in own) if len(own) < len(edges) else 1
    place = _edges_below(key, own).cast("long")
    if most == 1:
        return place
    often = {e: m for e, m in Counter(edges).items() if m > 1}
    names, counts = F.lit(",".join(map(str, often))), F.lit(",".join(map(str, often.values())))
    at = F.array_position(F.split(names, ",").cast("array<bigint>"), key)
    m = F.when(at > 0, F.element_at(F.split(counts, ",").cast("array<bigint>"), F.greatest(at, F.lit(1)).cast("int"))).otherwise(0)
    step = F.shiftright((F.shiftright(tie, 33) + (1 << 30)) * m, 31)
    return place * (most + 1) + F.when(m > 0, m - step).otherwise(0)


def _ranges(slots: list[tuple[int, int]], n: int) -> dict[int, int]:
    """At most n ranges of neighbouring slots of about equal weight; slots: (slot, weight)."""
    total, before, out = sum(w for _, w in slots), 0, {}
    for slot, w in sorted(slots):
        out[slot] = min(n - 1, (2 * before + w) * n // (2 * total))  # by the middle of the slot
        before += w
    return out


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, in the columns of COMPARED."""
    spark = docs.sparkSession
    places = shard_keys(spark)
    n = len(places)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    d = d.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    k = SLOTS * n
    shares = [(j + 1) / k for j in range(k - 1)]
    edges = list(d.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), 20 * n)).first()[0] or [])
    d = d.withColumn("slot", _slot(F.col("key"), F.col("tie"), edges))
    weight = F.sum(F.octet_length("text").cast("long") + ROW_BYTES)
    # a row a slot; the head of a slot is its first document
    heads = {r["slot"]: r for r in d.groupBy("slot").agg(weight.alias("weight"), F.max(F.struct("key", (-1 - F.col("tie")).alias("tie"))).alias("head")).collect()}
    ranges = _ranges([(r["slot"], r["weight"]) for r in heads.values()], n)
    tops = {ranges[slot]: slot for slot in sorted(ranges)}  # the slot that a range begins with
    used = sorted(tops)
    # the first document of a range follows the last one of the next higher range, and the very first that of the lowest
    also = {tops[j]: used[(i + 1) % len(used)] for i, j in enumerate(used)}
    rows = [(slot, j, heads[slot]["head"]["key"], -1 - heads[slot]["head"]["tie"], also.get(slot)) for slot, j in ranges.items()]
    slots = F.broadcast(spark.createDataFrame(rows, "slot long, range int, head long, head_tie long, also int"))  # some rows a range
    place = F.element_at(F.array(*map(F.lit, places)).cast("array<bigint>"), F.col("to.range") + 1)  # a hash tells int from long
    is_head = (F.col("key") == F.col("head")) & (F.col("tie") == F.col("head_tie"))
    sent = (
        d.join(slots, "slot")
        .withColumn("to", F.explode(F.filter(
            F.array(F.struct(F.col("range"), F.lit(0).alias("extra")), F.struct(F.when(is_head, F.col("also")).alias("range"), F.lit(1).alias("extra"))),
            lambda x: x["range"].isNotNull(),
        )))
        .select(place.alias("place"), F.col("to.extra").alias("extra"), "doc_id", "text", "key", "tie")
    )
    return (
        sent.repartition(n, "place")
        .sortWithinPartitions("place", "extra", F.col("key").desc(), "tie")
        .select("place", "extra", "doc_id", "text")
        .mapInArrow(_compare, COMPARED)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
