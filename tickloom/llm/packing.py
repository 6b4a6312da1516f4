"""Best-fit packing of documents into training sequences under several capacities.

A document is its ids followed by END.  One longer than a sequence is cut into whole sequences; its first piece takes
the rest and may be shorter.  Pieces of whole length fill sequences of their own; the others are packed by vector
best-fit decreasing: every bin has residual capacities of tokens, documents and attention cost (the sum of squared
piece lengths), an item goes to the bin whose residuals it fits under every constraint and that scores best, by the
weighted dot product of demand and residual (``score="dot"``) or by the smallest residual norm left (``score="norm"``),
each relative to the capacities; a new bin is opened only if none fits.

Pieces of equal length are interchangeable, so the packer never sees documents, only how many pieces there are of each
length (at most max_tokens - 1 rows, whatever the corpus).  Bins in the same state are kept as one group with a count
and are filled together.  Each step either uses up a length or moves a whole group, and a group splits only when a
length is used up, so the plan has a few rows per length: it is small enough to broadcast.  Each piece then gets its
rank among the pieces of its length (counts per length and hash bucket are summed first, so a length that a third of
the rows share is ranked by many tasks) and looks its place up in the plan.

Ids: those of ``tokenizers`` with byte_bpe_50k.json; byte_bpe_50k.tiktoken holds the same vocabulary as ranks and gives
the same ids, three times as fast, so tiktoken encodes (tests hold the two against each other).

Defined cases: a null or empty text is one piece that holds END alone; repeated rows are packed each; ties of length
are ranked by bucket and row; an empty table gives no sequences; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.byte_bpe import ByteBPE
from tickloom.llm.common import cut, table, text_of

END = 2


def n_buckets(n_rows: int) -> int:
    """Hash buckets in which the pieces of one length are ranked."""
    return max(64, n_rows // 4000)


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and what each capacity weighs in the choice of a bin.

    The defaults for documents and attention follow from the tokens, so tokens bind first; they still tell bins with the
    same room for tokens apart (fewer, longer documents are left to bins of their like), which costs no sequence.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    #: Weights of tokens, documents and attention in the score.
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    #: "dot": weighted dot product of demand and residual, the least that fits; "norm": weighted norm of what is left.
    score: str = "dot"


def pack_lengths(counts: dict[int, int], cap: Capacity = Capacity()) -> list[tuple[int, list[int]]]:
    """Groups (number of bins, lengths in each of them) that hold counts[length] pieces of every length.

    Bins are kept by state (residual tokens, documents, attention); of the states that an item fits, the best by score
    takes as many items as it has bins, then the next best.
    """
    if counts and max(counts) > cap.tokens:
        raise ValueError("a piece is longer than a sequence")
    states: dict[tuple[int, int, int], list[list]] = defaultdict(list)  # state: [number of bins, lengths]
    closed: list[tuple[int, list[int]]] = []
    caps = np.array([cap.tokens, cap.documents, cap.attention], float)
    w = np.array(cap.weights)
    full = (cap.tokens, cap.documents, cap.attention)

    def put(state, n, lengths):
        if state[0] and state[1] and state[2]:
            states[state].append([n, lengths])
        else:
            closed.append((n, lengths))

    for length in sorted(counts, reverse=True):
        left, need = counts[length], np.array([length, 1, length * length])
        if need[2] > cap.attention:
            raise ValueError("a piece's attention cost is above the capacity")
        while left:
            fits = np.array([s for s in states], np.int64).reshape(-1, 3)
            fits = fits[(fits >= need).all(axis=1)]
            if len(fits):
                if cap.score == "dot":
                    value = (fits / caps * w * (need / caps)).sum(axis=1)
                else:
                    value = (((fits - need) / caps) ** 2 * w).sum(axis=1)
                state = tuple(int(x) for x in fits[np.lexsort((fits[:, 2], fits[:, 1], fits[:, 0], value))[0]])
                group = states[state][-1]
                n = min(left, group[0])
                group[0] -= n
                if not group[0]:
                    states[state].pop()
                    if not states[state]:
                        del states[state]
                put(tuple(int(x) for x in np.array(state) - need), n, [*group[1], length])
                left -= n
            else:
                each = int(min(cap.tokens // length, cap.documents, cap.attention // need[2], left))
                n = left // each  # whole bins of this length, as one by one best-fit would leave them
                put(tuple(int(x) for x in np.array(full) - need * each), n, [length] * each)
                left -= n * each
    return closed + [(n, lengths) for groups in states.values() for n, lengths in groups]


def plan_table(groups: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    rows, rank, sequence = [], defaultdict(int), 0
    for n, lengths in groups:
        at = 0
        for length in lengths:
            rows.append((length, rank[length], sequence, at))
            rank[length] += n
            at += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    bpe, end = ByteBPE(), np.array([END], "<u4")
    for b in batches:
        ids_of, rows = b.column(0).to_pylist(), []
        for i, t in enumerate(b.column(1)):
            ids = np.concatenate([bpe.encode(t.as_py()).astype("<u4"), end])
            raw, n = ids.tobytes(), len(ids)
            cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
            rows += [(ids_of[i], k, a, z - a, zlib.crc32(raw[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, _KINDS)],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def cut_pieces(docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(lambda b: _pieces(b, size), schema)


def _place(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    rows = plan.value
    key = rows[:, 0] << 40 | rows[:, 1]
    for b in batches:
        length, rank = (b.column(i).to_numpy() for i in (3, 7))
        at = np.searchsorted(key, length << 40 | rank, "right") - 1
        sequence = rows[at, 2] + rank - rows[at, 1]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(rows[at, 3])],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """pieces with sequence_id and offset.  Whole-length pieces get negative sequence ids, one each."""
    spark = pieces.sparkSession
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == cap.tokens).select(
        *pieces.columns[:5], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < cap.tokens).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets(pieces.count()))))
    cells = cut(rest.groupBy("length", "bucket").agg(F.count("*").alias("n")))  # at most 1023 rows a bucket
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_table(pack_lengths(counts, cap)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = (
        rest.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")))
        .join(firsts, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", "row", "bucket", (F.col("first") + F.col("k") - 1).alias("rank"))
    )
    return whole.unionByName(ranked.mapInArrow(lambda b: _place(b, plan), PACKED))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents")))
