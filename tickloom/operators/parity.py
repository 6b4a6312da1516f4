"""How far two feature tables agree."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import is_close

KEYS = ["ticker", "ts_ns"]
RTOL, ATOL, WORST = 1e-3, 1e-6, 10


def key_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a, only_b, matched distinct keys; one full join of the key sets."""
    ka = a.select(*KEYS).distinct().withColumn("_a", F.lit(1))
    kb = b.select(*KEYS).distinct().withColumn("_b", F.lit(1))
    both = ka.join(kb, KEYS, "full")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"),
    )


def of_tickers(df: DataFrame, tickers: Iterable[str] | None) -> DataFrame:
    """Rows of the tickers; all rows for None."""
    return df if tickers is None else df.where(F.col("ticker").isin(*tickers))


def cells(a: DataFrame, b: DataFrame, names: Iterable[str] | None = None, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """feature, position, cells, mismatches, max_abs_diff over the keys that both sides have.

    The features are those of side A; one missing on side B raises.  Cells are compared and summed per feature before
    anything is unpivoted, so one row a feature and task is shuffled.
    """
    names = [x for x in (names or a.columns) if x in a.columns and x not in KEYS]
    missing = [x for x in names if x not in b.columns]
    if missing:
        raise ValueError(f"features missing on side B: {missing}")
    renamed = b.select(*KEYS, *(F.col(x).alias(f"{x}__b") for x in names))
    j = a.select(*KEYS, *names).join(renamed, KEYS)
    aggs = []
    for x in names:
        bad = ~is_close(F.col(x), F.col(f"{x}__b"), rtol, atol)
        aggs += [F.count_if(bad).alias(f"{x}__n"), F.max(F.when(bad, F.abs(F.col(x) - F.col(f"{x}__b")))).alias(f"{x}__d")]
    one = j.agg(F.count("*").alias("_cells"), *aggs)
    rows = F.array(*(
        F.struct(F.lit(x).alias("feature"), F.lit(i).alias("position"), F.col(f"{x}__n").alias("mismatches"), F.col(f"{x}__d").alias("max_abs_diff"))
        for i, x in enumerate(names)
    ))
    return one.select("_cells", F.explode(rows).alias("r")).select("r.feature", "r.position", F.col("_cells").alias("cells"), "r.mismatches", "r.max_abs_diff")


def summary(a: DataFrame, b: DataFrame, rtol: float = RTOL, atol: float = ATOL, tickers: Iterable[str] | None = None) -> DataFrame:
    """One row: key counts, cells, mismatches and match_pct (NULL without cells); of some tickers, if given."""
    a, b = of_tickers(a, tickers), of_tickers(b, tickers)
    total = cells(a, b, rtol=rtol, atol=atol).agg(F.sum("cells").alias("cells"), F.sum("mismatches").alias("mismatches"))
    pct = F.when(F.col("cells") > 0, 100.0 * (1 - F.col("mismatches") / F.col("cells")))
    return key_counts(a, b).crossJoin(total).withColumn("match_pct", pct)  # one row by one row


def worst(a: DataFrame, b: DataFrame, n: int = WORST, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """The features with most mismatches, most first, then in vector order."""
    return cells(a, b, rtol=rtol, atol=atol).where("mismatches > 0").orderBy(F.col("mismatches").desc(), "position").limit(n)
