"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ship_code

#: Where no cluster names a shared folder (local runs and tests).
LOCAL_SHARED_DIR = "/tmp/checkpoints/tickloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and driver and
    executors are one process; on a cluster it has to be set, since executors would write to disks of their own."""
    conf = spark.sparkContext.getConf()
    d = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[[^,]*(,[0-9]+)?\])?", spark.sparkContext.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = LOCAL_SHARED_DIR
    return d.rstrip("/")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write df as a table (in parts by columns, if given) in the shared folder and read it back, so that lost executors
    never cost its lineage.

    Tables lie in a folder of the application, which may be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_limit(n_rows: int) -> int:
    """Groups above this many rows count as hot; at most 5,000 groups can be, so a table of them may be broadcast."""
    return max(200, n_rows // 5000)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """rows joined with one row per key of groups (size: its number of rows), without sending a hot key to one task.

    Hot groups (see heavy_limit: at most 5,000) are broadcast; the others are joined by a shuffle of both sides.
    """
    limit = heavy_limit(n_rows)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


#: Rows of an id list that may be broadcast: 16 MB of ids.
MAX_BROADCAST_IDS = 1_000_000


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    small = ids.count() <= MAX_BROADCAST_IDS
    side = ids.select(F.col(ids.columns[0]).alias("_only_id"))
    return docs.join(F.broadcast(side) if small else side, F.col("doc_id") == F.col("_only_id"), how)


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in the one column of ids; a long list is joined by a shuffle."""
    return _by_id(docs, ids, "left_semi")


def mark_ids(docs: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """docs with a boolean column: doc_id is in the one column of ids."""
    return _by_id(docs, ids, "left").withColumn(flag, F.col("_only_id").isNotNull()).drop("_only_id")


def small_join(rows: DataFrame, groups: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """rows left-joined with one row a key; broadcast if there are few keys, so that a frequent key stays spread."""
    groups = cut(groups)
    return rows.join(F.broadcast(groups) if groups.count() <= most else groups, key, "left")


def shard_keys(spark: SparkSession, per_shard: int = 1) -> list[int]:
    """Longs that repartition(len, key) deals to a partition each: one for so many shuffle partitions, 8 at least."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(min(n, 8), n // per_shard)
    to = F.pmod(F.hash("id"), F.lit(n))
    rows = spark.range(0, 40 * n + 200).groupBy(to.alias("to")).agg(F.min("id").alias("id")).collect()
    return sorted(r["id"] for r in rows)
