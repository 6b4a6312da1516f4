"""Exact dedup by two passes over Bloom-filter cells.

Texts are equal when they agree after deleting blanks (space, tab, line feed, vertical tab, form feed, carriage
return).  Of equal texts the row with the most code points in its original text stays, then the smallest id.

Pass 1 hashes every normalised text into one of ``m`` cells and counts the rows of each cell; tasks combine their rows
first, so a cell costs a task one row, whatever its text's copies.  The cells that two or more rows hit become a bitmap of ``m`` bits, cut
into 4 KB rows.  Pass 2 probes the bitmap: a row with a cell of its own has no equal and passes straight through; only
the rest ("possibly repeated") shuffle, and are grouped by the SHA-256 of the normalised text, so a false positive of the
filter costs a shuffled row and nothing else.

``m`` follows the number of rows.  A filter has at most MAX_CELLS cells (a 32 MB broadcast): hash space is cut into as
many slices as that takes, and each slice, a part of its own of the table of hashes, is passed through both passes by
itself, so no filter fills up at any number of rows.

``keep`` filters the texts themselves by two cells for each hash that is truly repeated, so texts move only if theirs
may be one.

Defined cases: a null text is empty; an empty text equals every text of blanks only; a text of any length is hashed whole;
a null id loses ties; of rows repeated with id and text exactly one stays; an empty table gives an empty result; columns
other than id and text, whatever their names, are not read by ``decide`` and are kept by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, join_groups, table, text_of

#: Blanks that comparison ignores.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bits of a Bloom filter at most: 2**28 bits are 32 MB.
MAX_CELLS = 1 << 28
#: Cells for each row: one of so many other texts shares a row's cell.
CELLS_PER_ROW = 32
#: Repeated hashes that may be broadcast (some 80 bytes each).
MAX_BROADCAST_GROUPS = 200_000


def normalised_sha(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, BLANKS, ""), 256)


def _cell(sha: Column, which: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(which)), F.lit(cells))


def n_cells(n_rows: int) -> int:
    return min(MAX_CELLS, 1 << max(15, (max(n_rows, 1) * CELLS_PER_ROW - 1).bit_length()))


def n_slices(n_rows: int) -> int:
    """Slices of hash space whose rows a filter of MAX_CELLS serves; a power of two."""
    return 1 << max(0, -(-n_rows * CELLS_PER_ROW // MAX_CELLS) - 1).bit_length()


def _bitmap(cells: DataFrame) -> DataFrame:
    """(bucket, bits) of the column cell: rows of 4 KB."""
    return cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def repeated_cells(shas: DataFrame, sha: str, cells: int) -> DataFrame:
    """Bitmap of the cells that at least two rows hit: at most cells / 32768 rows."""
    return _bitmap(shas.select(_cell(F.col(sha), 0, cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))


def probe(df: DataFrame, sha: str, bitmap: DataFrame, cells: int, flag: str, hashes: int = 1) -> DataFrame:
    """df with a boolean column flag: all of the cells of the row's hash are in the bitmap."""
    out, tests = df, F.lit(True)
    for i in range(hashes):
        cell = _cell(F.col(sha), i, cells)
        side = F.broadcast(bitmap.select(F.col("bucket").alias(f"_bf_bucket{i}"), F.col("bits").alias(f"_bf_bits{i}")))
        out = out.join(side, F.bitmap_bucket_number(cell) == F.col(f"_bf_bucket{i}"), "left")
        at = F.bitmap_bit_position(cell)
        byte = F.substring(F.col(f"_bf_bits{i}"), (at / 8).cast("int") + 1, F.lit(1))
        tests = tests & F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1, F.lit(False))
    return out.withColumn(flag, tests).drop(*(f"_bf_{c}{i}" for i in range(hashes) for c in ("bucket", "bits")))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_of(text_col)
    return cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.length(t).cast("long").alias("n_chars"), normalised_sha(t).alias("text_sha256")
        ).withColumn("row", F.monotonically_increasing_id())
    )


def _groups(candidates: DataFrame) -> DataFrame:
    """One row for each hash: its rows and the one that stays."""
    first = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    return candidates.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(first).alias("best")).select(
        "text_sha256", "group_size", "best.keep_id", "best.keep_row", (-F.col("best.chars")).alias("keep_chars")
    )


def _slices(slim: DataFrame, n: int) -> list[DataFrame]:
    """slim in parts by hash, so that no filter is larger than MAX_CELLS."""
    k = n_slices(n)
    if k == 1:
        return [slim]
    parted = cut(slim.withColumn("slice", F.pmod(F.xxhash64("text_sha256", F.lit(2)), F.lit(k)).cast("int")), "slice")
    return [parted.where(F.col("slice") == i).drop("slice") for i in range(k)]


def _split(part: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows that have no equal, and the possibly repeated ones."""
    bitmap = cut(repeated_cells(part, "text_sha256", n_cells(n)))
    probed = probe(part, "text_sha256", bitmap, n_cells(n), "maybe")
    return probed.where("not maybe").drop("maybe"), probed.where("maybe").drop("maybe")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = _slim(docs, id_col, text_col)
    n = slim.count()
    parts = _slices(slim, n)
    out = None
    for part in parts:
        alone, candidates = _split(part, -(-n // len(parts)))
        alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        groups = cut(_groups(candidates))
        decided = join_groups(candidates, groups, "text_sha256", "group_size", n).select(
            "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
        )
        both = alone.unionByName(decided)
        both = both if len(parts) == 1 else cut(both)
        out = both if out is None else out.unionByName(both)
    return out


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that the filter of truly repeated hashes clears pass straight through.  The others meet the kept id of their
    group on (hash, id), a key that no hot group makes frequent.
    """
    slim = _slim(docs, id_col, text_col)
    n = slim.count()
    parts = _slices(slim, n)
    repeated = None
    for part in parts:
        groups = cut(_groups(_split(part, -(-n // len(parts)))[1]).where("group_size > 1").select(F.col("text_sha256").alias("_xd_keep_sha"), F.col("keep_id").alias("_xd_keep_id"), F.col("keep_chars").alias("_xd_keep_chars")))
        repeated = groups if repeated is None else repeated.unionByName(groups)
    cells = n_cells(repeated.count())
    both = F.array(_cell(F.col("_xd_keep_sha"), 0, cells), _cell(F.col("_xd_keep_sha"), 1, cells))
    bitmap = cut(_bitmap(repeated.select(F.explode(both).alias("cell"))))
    full = probe(docs.withColumn("_xd_sha", normalised_sha(text_of(text_col))), "_xd_sha", bitmap, cells, "_xd_maybe", 2)
    through = full.where("not _xd_maybe")
    named = full.where("_xd_maybe").join(F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST_GROUPS else repeated, F.col("_xd_sha") == F.col("_xd_keep_sha"), "left")
    lone = named.where("_xd_keep_sha is null")  # false positives of the filter
    stays = F.col(id_col).eqNullSafe(F.col("_xd_keep_id")) & (F.length(text_of(text_col)) == F.col("_xd_keep_chars"))
    chosen = named.where(F.col("_xd_keep_sha").isNotNull() & stays).dropDuplicates(["_xd_sha"])
    return through.unionByName(lone.select(*through.columns)).unionByName(chosen.select(*through.columns)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
