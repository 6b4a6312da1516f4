"""Jaccard similarity join of word 5-grams by a MinHash LSH forest, with exact verification.

1. Texts become sets of hashed word 5-grams (a text of fewer words is one gram) and MinHash signatures; texts of equal
   sets form one class, and only classes go on, so copies are never paired.
2. The forest: TREES tries over signature prefixes of DEPTH values, each held as a sorted array: (tree, prefix, class) is
   dealt by ranges and sorted, and the longest common prefix of neighbours tells where they part.  Classes that share a
   prefix are a run of the array and link to the smallest class of the run, one row a member; a run that a range cuts is
   joined again by its label.
3. Matching starts at the full DEPTH.  From the number of trees in which each class has met another the number of classes
   that have a partner and met none is estimated (Chao's estimator: f1 ** 2 / 2 f2), which measures recall on the data
   itself; while it is below TARGET the prefix is shortened, down to the depth whose expected recall is TARGET even for
   pairs right at the threshold.  The connected components of the links hold the candidates.
4. Verification: the sets of a component of at most TILE classes meet in one tile, which counts every intersection
   exactly: common grams by a matrix product, rarer ones by their postings.  In a larger component each class is first
   compared with the component's hub H.  With x grams of H missing and y others, two classes are surely alike if
   (x + t y) + (x' + t y') <= (1 - t) |H|, and surely not if the bounds of sizes and overlaps say so.  Classes lie in
   bands by x + t y; pairs of bands that are surely alike are counted from the sizes of the bands, pairs that are surely
   not are left out, and only what is between meets in tiles of at most 2 x TILE classes.  No task sees more than that.
   What is sent on is, for each class, the number of partners with a similarity of THRESHOLD or more and its smallest
   partner chain, never pairs.

A group is a connected component of verified links; its id is the smallest doc_id in it.  Rows are found again by id and
a hash of the text, never by their place in a scan.

Defined cases: null and empty texts are one class (the empty set) and alike; repeated rows are copies; a null id comes
first when the smallest is taken only if the whole group has none; an empty table gives an empty result; ties need no
rule, since links are symmetric and counted; columns of any name beside id and text are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import MAX_BROADCAST_IDS, cut, join_groups, table, text_of

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH, TARGET = 16, 6, 0.999
#: Classes of a block of a large component, and grams that a block may hold.
TILE, TILE_GRAMS = 128, 2_000_000
#: Grams in at most so many sets of a tile are counted by their postings.
RARE = 16
#: Bands of classes that are near their hub, and of others.
NEAR_BANDS, FAR_BANDS = 64, 16
#: Entries of the sorted arrays that a task holds at once.
SLAB = 1_000_000

_rng = np.random.default_rng(5)
_WORD_MIX = [np.uint64(x) for x in _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)]
_ODD = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def expected_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """The longest prefix with which the forest finds pairs at the threshold with the target recall: the shortest one
    that matching may come down to."""
    depth = DEPTH
    while depth > 1 and expected_recall(threshold, depth) < target:
        depth -= 1
    return depth


def measured_recall(met: dict[int, int]) -> float:
    """The share of the classes with a partner that have met one, from how many classes met others in so many trees."""
    seen, f1, f2 = sum(n for trees, n in met.items() if trees), met.get(1, 0), met.get(2, 0)
    if not seen:
        return 0.0
    return seen / (seen + (f1 * f1 / (2 * f2) if f2 else f1 * (f1 - 1) / 2))


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word 5-grams."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    x = h[:n] * _WORD_MIX[0]
    for i in range(1, WORDS):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] * _WORD_MIX[i]
    return np.unique(x ^ (x >> np.uint64(32)))


def minhash(x: np.ndarray) -> np.ndarray:
    """The signature: DEPTH values of 16 bits for each tree."""
    out = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for b in range(0, len(x), 1024):
        out = np.minimum(out, ((x[b : b + 1024, None] * _ODD + _ADD) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return (out & np.uint32(0xFFFF)).astype(">u2").reshape(TREES, DEPTH)


SLIM = "row long, doc_id long, hash long, setkey binary, n long, signature binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, ns, signatures = [], [], []
        for t in b.column(3):
            x = grams(t.as_py())
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            ns.append(len(x))
            signatures.append(minhash(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(3)), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(signatures, pa.binary())],
            ["row", "doc_id", "hash", "setkey", "n", "signature"],
        )


MET = "node long, heads array<long>, depth int, label binary"


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From sorted (tree, prefix, node): for each class and tree the smallest class of its run at the depths least to
    DEPTH (null where it is alone), and, as rows with a label, the ends of each slab, where a run may go on elsewhere."""
    depths = range(least, DEPTH + 1)

    def slab(tree, prefix, node):
        n = len(node)
        values = np.frombuffer(prefix, ">u2").reshape(n, DEPTH)
        same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)  # the longest common prefix with the entry before
        heads, ends = [], []
        for d in depths:
            begins = np.flatnonzero(np.append(True, shared < d))
            size = np.diff(np.append(begins, n))
            least_of = np.minimum.reduceat(node, begins)
            heads.append(pa.array(np.repeat(least_of, size), pa.int64(), mask=np.repeat(size, size) == 1))
            for k in {0, len(begins) - 1}:
                at = begins[k]
                ends.append((int(least_of[k]), d, bytes([int(tree[at])]) + prefix[2 * DEPTH * at : 2 * (DEPTH * at + d)]))
        met = ~np.logical_and.reduce([h.is_null().to_numpy(zero_copy_only=False) for h in heads])
        flat = np.stack([h.fill_null(-1).to_numpy() for h in heads], axis=1)[met].ravel()
        offsets = pa.array(np.arange(0, len(flat) + 1, len(depths)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64(), mask=flat < 0))
        k, m = int(met.sum()), len(ends)
        yield pa.RecordBatch.from_arrays([pa.array(node[met]), lists, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["node", "heads", "depth", "label"])
        cols = list(zip(*ends))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
            ["node", "heads", "depth", "label"],
        )

    held, n = [], 0

    def out():
        tree, node = (np.concatenate([h[i] for h in held]) for i in (0, 2))
        return slab(tree, b"".join(h[1] for h in held), node)

    for b in batches:
        if len(b):
            held.append((b.column(0).to_numpy(), b"".join(b.column(1).to_pylist()), b.column(2).to_numpy()))
            n += len(b)
        if n >= SLAB:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def forest_edges(classes: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Links (a, b) between classes (node, signature) whose prefixes match in a tree; a class has one link at least with
    the smallest class that it has met, and the heads of its runs have one each."""
    least = prefix_depth(threshold, target)
    entries = classes.where("signature is not null").select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    entries = entries.select("tree", F.substring("signature", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("prefix"), "node")
    met = cut(
        entries.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node").mapInArrow(lambda b: _runs(b, least), MET)
    )
    depths = list(range(least, DEPTH + 1))
    inner = met.where("label is null")
    per = cut(inner.groupBy("node").agg(*(F.collect_set(F.col("heads")[i]).alias(f"h{d}") for i, d in enumerate(depths)), *(F.count(F.col("heads")[i]).cast("int").alias(f"c{d}") for i, d in enumerate(depths))))
    histogram = per.groupBy(*(f"c{d}" for d in depths)).agg(F.count("*").alias("n")).collect()  # at most 17 ** 3 rows
    depth = DEPTH
    while depth > least:
        trees = {}
        for r in histogram:
            trees[r[f"c{depth}"]] = trees.get(r[f"c{depth}"], 0) + r["n"]
        if measured_recall(trees) >= target:
            break
        depth -= 1
    hubs = per.where(F.size(f"h{depth}") > 0).select("node", F.col(f"h{depth}").alias("hubs"), F.array_min(f"h{depth}").alias("least"))
    own = hubs.select(F.col("node").alias("a"), F.col("least").alias("b"))
    others = hubs.select(F.explode("hubs").alias("a"), F.col("least").alias("b"))
    ends = met.where(F.col("depth") == depth).select("label", F.col("node").alias("a"))
    ends = ends.join(ends.groupBy("label").agg(F.min("a").alias("b")), "label").select("a", "b")
    return own.unionByName(others).unionByName(ends).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): the smallest node that it is connected with.

    Each round every node points to its smallest neighbour, pointers are followed to their ends (each step doubles their
    reach), and only edges between different ends are left.  An end takes in one node at least, so rounds are
    logarithmic, too; the members of a star are done after one.
    """
    left = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
        moved = True
        while moved:
            next_to = to.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
            to = cut(to.join(next_to, F.col("comp") == F.col("_node")).select("node", F.col("_comp").alias("comp"), (F.col("comp") != F.col("_comp")).alias("moved")))
            moved = not to.where("moved").isEmpty()
            to = to.drop("moved")
        step = to.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
        labels = to if labels is None else cut(labels.join(step, F.col("comp") == F.col("_node"), "left").select("node", F.coalesce("_comp", "comp").alias("comp")))
        a = left.join(step, F.col("a") == F.col("_node")).select(F.col("_comp").alias("a"), "b")
        b = a.join(step, F.col("b") == F.col("_node")).select("a", F.col("_comp").alias("b")).where("a != b")
        left = cut(b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return left.select(F.col("a").alias("node"), F.col("a").alias("comp")) if labels is None else labels


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The size of every pairwise intersection, exactly."""
    g = len(sets)
    out = np.zeros((g, g), np.float32)
    if not g:
        return out
    of = np.repeat(np.arange(g), [len(s) for s in sets])
    _, gram, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(gram, kind="stable")
    of, df_of = of[order], df[gram[order]]
    common = df_of > RARE
    if common.any():
        col = np.cumsum(np.append(True, np.diff(gram[order][common]) != 0)) - 1
        row, n = of[common], int(col[-1]) + 1
        for b in range(0, n, 4096):
            at = slice(*np.searchsorted(col, [b, b + 4096]))
            m = np.zeros((g, min(4096, n - b)), np.float32)
            m[row[at], col[at] - b] = 1
            out += m @ m.T
    for f in range(2, RARE + 1):
        rows = of[df_of == f].reshape(-1, f)
        for i in range(f):
            for j in range(f):
                if i != j and len(rows):
                    out += np.bincount(rows[:, i] * g + rows[:, j], minlength=g * g).reshape(g, g) if len(rows) > g * g // 4 else _sparse(rows[:, i], rows[:, j], g)
    return out


def _sparse(a, b, g):
    at, n = np.unique(a * g + b, return_counts=True)
    m = np.zeros(g * g, np.float32)
    m[at] = n
    return m.reshape(g, g)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of different sets are at least threshold alike."""
    both = intersections(sets)
    n = np.array([len(s) for s in sets], np.float64)
    out = both >= threshold * (n[:, None] + n[None] - both) - 1e-6
    np.fill_diagonal(out, False)
    return out


def _chains(nodes: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The smallest node that each is connected with."""
    label = nodes.copy()
    while True:
        best = np.where(link, label[None], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(label, best)
        if (new == label).all():
            return label
        label = new


COUNTED = "node long, texts long, docs long, chain long"
SETS = "comp long, hub boolean, node long, copies long, blocks int, grams binary"


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 500):
            part = b.slice(at, 500)
            sets = [grams(t.as_py()).tobytes() for t in part.column(5)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(sets, pa.binary())], [c.split()[0] for c in SETS.split(", ")])


DELTAS = "comp long, node long, copies long, h long, x long, y long, n long, grams binary"


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the pieces of large components, the hub's set first: each set with the number of the hub's grams that it
    lacks (x) and of others that it has (y)."""
    where, hub, last = None, None, None
    for b in batches:
        out = []
        for comp, piece, is_hub, node, copies, raw in zip(*(b.column(i).to_pylist() for i in range(6))):
            x = np.frombuffer(raw, "<u8")
            if (comp, piece) != where:
                where, hub, last = (comp, piece), x, None
            if is_hub or node == last:  # a row repeated with id and text comes twice
                continue
            last = node
            at = np.minimum(np.searchsorted(hub, x), len(hub) - 1)
            both = int((hub[at] == x).sum())
            out.append((comp, node, copies, len(hub), len(hub) - both, len(x) - both, len(x), raw))
        cols = list(zip(*out)) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(cols)], [c.split()[0] for c in DELTAS.split(", ")])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """From (comp, ti, tj, node, block, copies, grams), sorted by tile and node: links of each class within the tile."""

    def tile(rows):
        node, block, copies = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        link = linked([np.frombuffer(r[6], "<u8") for r in rows], threshold)
        if rows[0][1] != rows[0][2]:  # two blocks: only pairs across
            link &= block[:, None] != block[None]
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(link.sum(axis=1).astype(np.int64)), pa.array((link @ copies).astype(np.int64)), pa.array(_chains(node, link))],
            ["node", "texts", "docs", "chain"],
        )

    rows = []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(7))):
            if rows and r[:3] != rows[0][:3]:
                yield tile(rows)
                rows = []
            if not rows or r[3] != rows[-1][3]:  # a row repeated with id and text comes twice
                rows.append(r)
    if rows:
        yield tile(rows)


def _tiles(rows: DataFrame, threshold: float) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("comp", "ti", "tj", "node", "block", "copies", "grams")
    return rows.repartition(n, "comp", "ti", "tj").sortWithinPartitions("comp", "ti", "tj", "node").mapInArrow(lambda b: _verify(b, threshold), COUNTED)


def _count_large(sets: DataFrame, threshold: float) -> DataFrame:
    """COUNTED of the classes of large components (SETS)."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    spread = sets.unionByName(sets.where("hub").withColumn("hub", F.lit(False))).select("comp", F.explode(pieces).alias("piece"), "hub", "node", "copies", "grams")
    deltas = cut(spread.repartition(n, "comp", "piece").sortWithinPartitions("comp", "piece", F.desc("hub"), "node").mapInArrow(_deltas, DELTAS))
    far = F.col("x") + threshold * F.col("y")
    limit = (1 - threshold) * F.col("h")
    band = F.when(far <= limit, F.ceil(NEAR_BANDS * far / limit)).otherwise(NEAR_BANDS + 1 + F.floor(FAR_BANDS * F.col("x") / F.col("h")))
    banded = deltas.withColumn("band", band.cast("int"))
    bands = cut(
        banded.groupBy("comp", "band").agg(
            F.count("*").alias("size"), F.sum("copies").alias("docs"), F.max(far).alias("far"), F.min("x").alias("x"), F.max("y").alias("y"),
            F.min("n").alias("small"), F.max("n").alias("big"), F.max(limit).alias("limit"), F.max("h").alias("h"),
            F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_GRAMS)).cast("int").alias("blocks"),
        )
    )
    other = bands.select(F.col("comp").alias("_comp"), *(F.col(c).alias(f"_{c}") for c in ("band", "size", "docs", "far", "x", "y", "small", "big", "blocks")))
    # at most (NEAR_BANDS + FAR_BANDS + 2) ** 2 pairs of bands a component
    pairs = bands.join(other, F.col("comp") == F.col("_comp"))
    alike = F.col("far") + F.col("_far") <= F.col("limit") - 1e-6
    most = F.col("h") - F.greatest("x", "_x") + F.least("y", "_y")
    least = threshold * F.greatest("small", "_small") - 1e-6
    never = (most < least) | (F.least("big", "_big") < least)
    pairs = pairs.groupBy("comp", "band", "blocks").agg(
        F.coalesce(F.sum(F.when(alike, F.col("_size"))), F.lit(0)).alias("texts"), F.coalesce(F.sum(F.when(alike, F.col("_docs"))), F.lit(0)).alias("docs"),
        F.max(F.when(F.col("band") == F.col("_band"), alike)).alias("inside"),
        F.collect_list(F.when(~alike & ~never, F.struct(F.col("_band").alias("band"), F.col("_blocks").alias("blocks")))).alias("open"),
    )
    pairs = cut(pairs.withColumn("rows", F.lit(0)))
    placed = banded.join(F.broadcast(pairs) if pairs.count() <= 100_000 else pairs, ["comp", "band"])
    one = F.when(F.col("inside"), 1).otherwise(0)
    sure = placed.select(
        "node", (F.col("texts") - one).cast("long").alias("texts"), (F.col("docs") - one * F.col("copies")).cast("long").alias("docs"),
        F.when(F.col("band") <= NEAR_BANDS, F.least("node", "comp")).otherwise(F.col("node")).alias("chain"),
    )
    here = F.col("band").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))
    there = F.flatten(F.transform("open", lambda o: F.transform(F.sequence(F.lit(0), o["blocks"] - 1), lambda i: o["band"].cast("long") * (1 << 32) + i)))
    tiles = placed.where(F.size("open") > 0).withColumn("block", here).withColumn("with", F.explode(there))
    tiles = tiles.withColumn("ti", F.least("block", "with")).withColumn("tj", F.greatest("block", "with"))
    return sure.unionByName(_tiles(tiles, threshold))


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", scan: bool = False) -> DataFrame:
    """row (a number), doc_id, hash (of the text), class_id (smallest doc_id of the group), n_links (other documents at
    least threshold alike, copies among them), n_texts (different sets among those), group_row (row of the group's first document).

    scan: docs is cheap to read again, as a plain scan of files is; else it is written first.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    docs = (docs if scan else cut(docs)).withColumn("hash", F.xxhash64("text"))
    slim = cut(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "hash", "text").mapInArrow(_sign, SLIM))
    n_rows = slim.count()
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"), F.col("hash").alias("hash"))
    classes = cut(
        slim.groupBy("setkey").agg(F.count("*").alias("copies"), F.min(first).alias("f"), F.first("n").alias("n"), F.first("signature").alias("signature"))
        .select("setkey", "copies", F.col("f.row").alias("node"), F.col("f.id").alias("first_id"), F.col("f.hash").alias("first_hash"), "n", "signature")
    )
    comps = components(forest_edges(classes, threshold))
    sizes = cut(
        comps.join(classes.select("node", "n"), "node").groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
        .select("comp", "size", F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("grams") / TILE_GRAMS)).cast("int").alias("blocks"))
    )
    todo = cut(
        join_groups(comps, sizes, "comp", "size", n_rows).join(classes.select("node", "copies", "first_id", "first_hash"), "node")
        .select("node", "comp", "blocks", "copies", "first_id", "first_hash")
    )
    side = F.broadcast(todo) if todo.count() <= MAX_BROADCAST_IDS // 4 else todo
    found = docs.join(side, (F.col("hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    sets = found.select("comp", (F.col("node") == F.col("comp")).alias("hub"), "node", "copies", "blocks", "text").mapInArrow(_to_sets, SETS)
    sets = cut(sets)
    zero = F.lit(0).cast("long")
    small = _tiles(sets.where("blocks = 1").withColumns({"ti": zero, "tj": zero, "block": zero}), threshold)
    counted = cut(small.unionByName(_count_large(sets.where("blocks > 1"), threshold)))
    chains = counted.where("chain != node").select(F.col("node").alias("a"), F.col("chain").alias("b"))
    groups = components(chains)
    links = counted.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    full = (
        classes.select("setkey", "copies", "node", "first_id")
        .join(links, "node", "left")
        .join(groups, "node", "left")
        .select("setkey", "copies", "node", "first_id", F.coalesce("comp", "node").alias("comp"), F.coalesce("texts", F.lit(0)).alias("n_texts"),
                (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    full = cut(full)
    head = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("node").alias("row"))
    heads = cut(full.groupBy("comp").agg(F.min(head).alias("h"), F.count("*").alias("members")).select("comp", "members", F.col("h.id").alias("class_id"), F.col("h.row").alias("group_row")))
    named = cut(join_groups(full, heads, "comp", "members", n_rows).select("setkey", "copies", "class_id", "group_row", "n_links", "n_texts"))
    return join_groups(slim.select("row", "doc_id", "hash", "setkey"), named, "setkey", "copies", n_rows).select("row", "doc_id", "hash", "class_id", "n_links", "n_texts", "group_row")


def keep(docs: DataFrame, scan: bool = False) -> DataFrame:
    """The rows of docs without near duplicates: of each group its document of smallest id stays, once."""
    docs = docs if scan else cut(docs)
    rows = join_similar(docs, scan=True)
    keys = rows.groupBy("doc_id", "hash").agg(F.max(F.col("row") == F.col("group_row")).alias("_nd_stays"), F.count("*").alias("n"))
    keys = cut(keys.where("not _nd_stays or n > 1").select(F.col("doc_id").alias("_nd_id"), F.col("hash").alias("_nd_hash"), "_nd_stays"))
    side = F.broadcast(keys) if keys.count() <= MAX_BROADCAST_IDS else keys
    same = (F.xxhash64(text_of()) == F.col("_nd_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_nd_id"))
    marked = docs.join(side, same, "left")
    through = marked.where("_nd_stays is null")
    repeated = marked.where("_nd_stays").dropDuplicates(["_nd_id", "_nd_hash"])  # rows that are there more than once
    return through.unionByName(repeated).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"), scan=True).select("doc_id", "class_id", "n_links", "n_texts")
