"""Rolling, running and exponential statistics as window columns.

Missing is NULL inside the engine: aggregates skip it, as a statistic skips what is never pushed.  ``w`` is always a
window with partition and order and no frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a chunk of the exponential mean, and the longest span it serves: with 64 a chunk's start weighs 1e-14.
CHUNK, MAX_SPAN = 1024, 64


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    if n < 1:
        raise ValueError("a window has at least one row")
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling_sum(x: Column, w: WindowSpec, n: int) -> Column:
    return F.sum(x).over(last_n(w, n))


def rolling_mean(x: Column, w: WindowSpec, n: int) -> Column:
    return F.avg(x).over(last_n(w, n))


def rolling_count(x: Column, w: WindowSpec, n: int) -> Column:
    return F.count(x).over(last_n(w, n))


def rolling_std(x: Column, w: WindowSpec, n: int) -> Column:
    """Population deviation; NULL below two values."""
    f = last_n(w, n)
    return F.when(F.count(x).over(f) >= 2, F.stddev_pop(x).over(f))


def rolling_max(x: Column, w: WindowSpec, n: int) -> Column:
    return F.max(x).over(last_n(w, n))


def rolling_min(x: Column, w: WindowSpec, n: int) -> Column:
    return F.min(x).over(last_n(w, n))


def rolling_array(x: Column, w: WindowSpec, n: int) -> Column:
    return F.collect_list(x).over(last_n(w, n))


def session_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(so_far(w))


def session_mean(x: Column, w: WindowSpec) -> Column:
    return F.avg(x).over(so_far(w))


def running_max(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(so_far(w))


def running_min(x: Column, w: WindowSpec) -> Column:
    return F.min(x).over(so_far(w))


def running_var(x: Column, w: WindowSpec) -> Column:
    """Population variance since the start; NULL below two values."""
    f = so_far(w)
    return F.when(F.count(x).over(f) >= 2, F.var_pop(x).over(f))


def running_std(x: Column, w: WindowSpec) -> Column:
    return F.sqrt(running_var(x, w))


def pushes(df: DataFrame, x: str, keys: list[str], order: list[Column | str], seq: str) -> DataFrame:
    """df with the number of values of x so far, the order of windows that count values instead of rows."""
    return df.withColumn(seq, F.count(x).over(so_far(Window.partitionBy(*keys).orderBy(*order))))


def by_pushes(keys: list[str], seq: str, n: int) -> WindowSpec:
    """The last n values: rows without a value carry NULL and share the order number of the value before them."""
    return Window.partitionBy(*keys).orderBy(seq).rangeBetween(-(n - 1), 0)


def chunk_of(n: Column) -> Column:
    """The chunk of a row with which n values have come."""
    return F.greatest(F.call_function("div", n - 1, F.lit(CHUNK)), F.lit(0))


def with_chunks(df: DataFrame, x: str, keys: list[str], order: list[Column | str], chunk: str) -> DataFrame:
    """df with the number of its chunk: so many values of x have come before, over CHUNK."""
    return df.withColumn(chunk, chunk_of(F.count(x).over(so_far(Window.partitionBy(*keys).orderBy(*order)))))


def with_ewma(df: DataFrame, specs: dict[str, tuple[str, int]], keys: list[str], order: list[Column | str], chunk: str) -> DataFrame:
    """df with exponential means: name -> (column, span); alpha = 2 / (span + 1), seeded by the first value.

    e_i = a * sum_j b**(i-j) x_j within chunks (see with_chunks), each seeded with the end of the chunk before, so sums
    stay in range however long the sequence; what reaches past a whole chunk weighs 1e-14.  Rows without a value carry
    the last mean.  All means share the windows ``partition by keys order by chunk, order`` and ``partition by keys,
    chunk order by order``, which one sort serves.
    """
    whole = Window.partitionBy(*keys).orderBy(chunk, *order)
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sources = sorted({c for c, _ in specs.values()})
    for _, span in specs.values():
        if not 0 < span <= MAX_SPAN:
            raise ValueError(f"span must be above 0 and at most {MAX_SPAN}")
    df = df.withColumns({f"_i_{c}": F.count(c).over(inside) for c in sources} | {f"_n_{c}": F.count(c).over(so_far(whole)) for c in sources})
    decay = {name: 1.0 - 2.0 / (span + 1) for name, (_, span) in specs.items()}
    local = {}
    for name, (c, span) in specs.items():
        i, b = F.col(f"_i_{c}"), F.lit(decay[name])
        weight = F.when(F.col(f"_n_{c}") == 1, F.lit(1.0)).otherwise(F.lit(2.0 / (span + 1)))  # the first value counts in full
        local[f"_l_{name}"] = F.pow(b, i) * F.coalesce(F.sum(weight * F.col(c) * F.pow(b, -i)).over(inside), F.lit(0.0))
    df = df.withColumns(local)
    new = F.col(chunk) != F.lag(chunk).over(whole)
    df = df.withColumns({f"_c_{name}": F.when(new, F.lag(f"_l_{name}").over(whole)) for name in specs})
    out = {}
    for name, (c, _) in specs.items():
        carried = F.coalesce(F.first(f"_c_{name}", ignorenulls=True).over(inside), F.lit(0.0))
        out[name] = F.when(F.col(f"_n_{c}") > 0, F.col(f"_l_{name}") + F.pow(F.lit(decay[name]), F.col(f"_i_{c}")) * carried)
    drop = [f"_{p}_{c}" for c in sources for p in "in"] + [f"_{p}_{n}" for n in specs for p in "lc"]
    return df.withColumns(out).drop(*drop)
