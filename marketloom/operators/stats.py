"""Robust and order statistics of groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketloom.sources.io import bounded


@lru_cache(300)
def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def median_slope(t: np.ndarray, y: np.ndarray, most: int = 4_000_000) -> float | None:
    """Median over all pairs of points, in order of t, of the difference of y by that of t; NaN counts as the greatest, None for fewer than two points.

    Up to `most` slopes are held at once. Of more, the middle ranks are found digit by digit of the slopes' bits, which makes them anew in each pass.
    """
    n = len(t)
    if n < 2:
        return None

    def blocks(size: int) -> Iterator[np.ndarray]:
        held, count = [], 0
        for lag in range(1, n):
            with np.errstate(invalid="ignore", over="ignore"):
                held.append((y[lag:] - y[:-lag]) / (t[lag:] - t[:-lag]))
            count += n - lag
            if count >= size or lag == n - 1:
                yield np.concatenate(held)
                held, count = [], 0

    pairs = n * (n - 1) // 2
    ranks = (pairs - 1) // 2, pairs // 2
    if n <= 256:  # short series: all differences at once, of which the upper triangle counts
        upper = _upper(n)
        with np.errstate(invalid="ignore", over="ignore"):
            own = (y[None, :] - y[:, None])[upper] / (t[None, :] - t[:, None])[upper]
        own.partition(ranks)
        return float((own[ranks[0]] + own[ranks[1]]) / 2)
    if pairs <= most:
        own = np.partition(next(blocks(pairs)), ranks)
        return float((own[ranks[0]] + own[ranks[1]]) / 2)

    def at(rank: int) -> float:
        found = np.uint64(0)
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for x in blocks(most):
                bits = np.where(np.isnan(x), np.nan, x).view(np.uint64)
                bits = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))  # in the order of the numbers
                if shift < 48:
                    bits = bits[bits >> np.uint64(shift + 16) == found]
                counts += np.bincount((bits >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            ends = np.cumsum(counts)
            digit = int(np.searchsorted(ends, rank, "right"))
            rank -= int(ends[digit - 1]) if digit else 0
            found = found << np.uint64(16) | np.uint64(digit)
        found = found ^ np.uint64(1 << 63) if found >> np.uint64(63) == 1 else ~found
        return float(np.array([found], np.uint64).view(np.float64)[0])

    return (at(ranks[0]) + at(ranks[1])) / 2


@F.pandas_udf(StructType([StructField("short", DoubleType()), StructField("whole", DoubleType())]))
def median_slopes_of_both(t: pd.Series, y: pd.Series, last: pd.Series) -> pd.DataFrame:
    """median_slope of the last `last` points and of all points of two arrays in each row; taken once where these are the same."""
    out = []
    for a, b, k in zip(t, y, last, strict=True):
        a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
        whole = median_slope(a, b)
        out.append((whole if k >= len(a) else median_slope(a[len(a) - k :], b[len(b) - k :]), whole))
    return pd.DataFrame(out, columns=["short", "whole"], dtype="Float64")


def theil_sen_slope(obs: DataFrame, keys: list[str], day: str = "day", value: str = "price") -> DataFrame:
    """(keys, slope): median over pairs of points of the log return by day. For short windows: a group's points are squared."""
    points = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.datediff(day, F.lit("1970-01-01")).alias("t"), F.log(value).alias("y")))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["t"] > a["t"]), lambda b: (b["y"] - a["y"]) / (b["t"] - a["t"]))))
    return points.select(*keys, F.explode(pairs).alias("s")).groupBy(*keys).agg(F.percentile("s", 0.5).alias("slope"))


def mad_volatility(obs: DataFrame, keys: list[str], day: str = "day", value: str = "price") -> DataFrame:
    """(keys, volatility): 1.4826 times the median absolute deviation of root-time log returns."""
    w = Window.partitionBy(*keys).orderBy(day)
    gap = F.datediff(day, F.lag(day).over(w))
    steps = obs.select(*keys, (F.log(F.col(value) / F.lag(value).over(w)) / F.sqrt(gap)).alias("r"), gap.alias("g")).where("g > 0")
    centred = steps.withColumn("c", F.percentile("r", 0.5).over(Window.partitionBy(*keys)))
    return centred.groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col("r") - F.col("c")), 0.5)).alias("volatility"))


def max_drawdown(obs: DataFrame, keys: list[str], day: str = "day", value: str = "price") -> DataFrame:
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return obs.select(*keys, ((peak - F.col(value)) / peak).alias("d")).groupBy(*keys).agg(F.max("d").alias("max_drawdown"))


def history_density(obs: DataFrame, keys: list[str], start: Column, end: Column, step_days: int = 1, day: str = "day") -> DataFrame:
    expected = F.floor(F.datediff(end, start) / step_days) + 1
    return obs.where(F.col(day).between(start, end)).groupBy(*keys).agg(F.least(F.lit(1.0), F.count_distinct(day) / F.first(expected)).alias("density"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, fraction: float = 0.1, name: str = "trimmed_mean") -> DataFrame:
    """(keys, name, n): mean without floor(n * fraction) values at each end, by rank windows, which sort on disk where
    a group is large."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("__r"), F.count("*").over(w).alias("__n"))
    cut = F.floor(F.col("__n") * fraction)
    return ranked.groupBy(*keys).agg(F.avg(F.when((F.col("__r") > cut) & (F.col("__r") <= F.col("__n") - cut), F.col(value))).alias(name), F.first("__n").alias("n"))


def trimmed_mean_of_large(df: DataFrame, keys: list[str], value: str, fraction: float = 0.1, name: str = "trimmed_mean", cell: float = 1e-3) -> DataFrame:
    """As trimmed_mean, exactly, for groups that are too large for one task.

    Values are counted and summed by cells of width `cell`, which combines before the shuffle. A cell that lies inside the kept ranks gives its sum;
    only the at most two cells of a group that a cut runs through are ranked row by row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), F.floor(F.col(value) / cell).alias("__cell"))
    cells = rows.groupBy(*keys, "__cell").agg(F.count("*").alias("__c"), F.sum("__v").alias("__s"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    w = Window.partitionBy(*keys)
    n, before = F.sum("__c").over(w), F.sum("__c").over(w.orderBy("__cell")) - F.col("__c")
    placed = cells.withColumns({"__n": n, "__b": before}).withColumn("__cut", F.floor(F.col("__n") * fraction))
    taken = F.greatest(F.lit(0), F.least(F.col("__b") + F.col("__c"), F.col("__n") - F.col("__cut")) - F.greatest("__b", "__cut"))
    placed = placed.withColumn("__take", taken)
    part = (F.col("__take") > 0) & (F.col("__take") < F.col("__c")) & (F.col("__lo") < F.col("__hi"))
    whole = placed.select(*keys, "__n", "__cut", F.when(part, 0.0).when(F.col("__take") == F.col("__c"), F.col("__s")).otherwise(F.col("__take") * F.col("__lo")).alias("__x"))
    split = placed.where(part).select(*keys, "__cell", "__n", "__cut", "__b")
    ranked = rows.join(split, [*keys, "__cell"]).withColumn("__r", F.col("__b") + F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy("__v")) - 1)
    cut = ranked.where((F.col("__r") >= F.col("__cut")) & (F.col("__r") < F.col("__n") - F.col("__cut"))).select(*keys, "__n", "__cut", F.col("__v").alias("__x"))
    return whole.unionByName(cut).groupBy(*keys).agg((F.sum("__x") / F.first(F.col("__n") - 2 * F.col("__cut"))).alias(name), F.first("__n").alias("n"))


def empirical_quantile(df: DataFrame, keys: list[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear interpolation at p (n - 1)."""
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return join_same(groups, quantile_of_large(df, keys, value, {f"q{round(p * 100):02d}": p for p in probs}), keys)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """left with right's other columns where all keys are the same, null with null."""
    own = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    if not keys:
        return left.crossJoin(F.broadcast(own))  # right has one row
    same = [left[k].eqNullSafe(own[f"__k_{k}"]) for k in keys]
    return left.join(own, same, how).drop(*[f"__k_{k}" for k in keys])


def quantile_of_large(df: DataFrame, keys: Sequence[str], value: Column | str, quantiles: dict[str, float], steps: int = 1024, few: bool = False) -> DataFrame:
    """(keys, one column for each quantile): as quantiles_of_large, of one value."""
    return quantiles_of_large(df, keys, {q: (value, p) for q, p in quantiles.items()}, steps, few)


def quantiles_of_large(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column | str, float]], steps: int = 1024, few: bool = False) -> DataFrame:
    """(keys, one column for each name of `wanted`): linear interpolation at p (n - 1), for groups that are too large for one task.

    wanted has a value and p for each name; all values are counted in one pass. Values are counted by narrow cells, `steps` to a factor of e,
    which combines before the shuffle. The counts tell in which cells the wanted ranks fall; only those cells' rows are ranked, and not even
    these where all values of a cell are equal. Nulls and NaN are left out.

    few: there are few groups. The wanted cells are written first, and the rows are filtered by them where they are read instead of being shuffled
    (counted, so that more cells than a broadcast holds are joined as else). Fewer `steps` keep the counts of many groups small.
    """
    keys, values, of = list(keys), [], {}
    for name, (value, p) in wanted.items():
        column = F.col(value) if isinstance(value, str) else value
        text = str(column._jc.toString()) if hasattr(column, "_jc") else str(column)
        if text not in [t for t, _ in values]:
            values.append((text, column))
        of[name] = ([t for t, _ in values].index(text), p)
    if len(values) == 1:
        rows = df.select(*keys, F.lit(0).alias("__of"), values[0][1].cast("double").alias("__v"))
    else:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), c.cast("double").alias("v")) for k, (_, c) in enumerate(values)]))
        rows = df.select(*keys, each.alias("__x")).select(*keys, F.col("__x.of").alias("__of"), F.col("__x.v").alias("__v"))
    rows = rows.where("__v is not null and not isnan(__v)")
    # grows with the value, and keeps the order of values of both signs: of the absolute value, as the logarithm behind asinh cancels below zero
    rows = rows.withColumn("__cell", F.floor(F.signum("__v") * F.asinh(F.abs("__v") * 1e6) * steps))
    group = [*keys, "__of"]
    cells = rows.groupBy(*group, "__cell").agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    w = Window.partitionBy(*group)
    placed = cells.withColumn("__n", F.sum("__c").over(w)).withColumn("__b", F.sum("__c").over(w.orderBy("__cell")) - F.col("__c"))
    at = {q: (F.col("__of") == k, p * (F.col("__n") - 1)) for q, (k, p) in of.items()}
    ranks = F.array_distinct(F.array_compact(F.array(*[F.when(own, r.cast("long")) for own, x in at.values() for r in (F.floor(x), F.ceil(x))])))
    needed = placed.withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__b")) & (r < F.col("__b") + F.col("__c")))).where(F.size("__ranks") > 0)
    if few:
        needed = bounded(needed)
    even = needed.where("__lo = __hi").select(*group, "__n", F.explode("__ranks").alias("__r"), F.col("__lo").alias("__v"))
    split = needed.where("__lo < __hi").select(*group, "__cell", "__n", "__b", "__ranks")
    met = join_same(rows, split, [*group, "__cell"], "inner")
    ranked = met.withColumn("__r", F.col("__b") + F.row_number().over(Window.partitionBy(*group, "__cell").orderBy("__v")) - 1)
    found = even.unionByName(ranked.where(F.array_contains("__ranks", F.col("__r"))).select(*group, "__n", "__r", "__v"))
    pick = lambda own, r: F.max(F.when(own & (F.col("__r") == r.cast("long")), F.col("__v")))
    out = found.groupBy(*keys).agg(*[x for q, (own, a) in at.items() for x in (pick(own, F.floor(a)).alias(f"__a_{q}"), pick(own, F.ceil(a)).alias(f"__b_{q}"), F.max(F.when(own, a - F.floor(a))).alias(f"__f_{q}"))])
    return out.select(*keys, *[_between(F.col(f"__a_{q}"), F.col(f"__b_{q}"), F.col(f"__f_{q}")).alias(q) for q in at])


def _between(a: Column, b: Column, share: Column) -> Column:
    """The value at a share of the way from a to b; either may be infinite."""
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    return F.when((share == 0) | (a == b), a).when(infinite, a * (1 - share) + b * share).otherwise(a + (b - a) * share)


def lower_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at rank floor(p (n - 1)), no interpolation."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("__r"), F.count("*").over(w).alias("__n"))
    return ranked.where(F.col("__r") == F.floor(p * (F.col("__n") - 1))).select(*keys, F.col(value).alias("lower_percentile"))


def leave_one_out_quantile(df: DataFrame, keys: list[str], key: str, value: str, p: float = 0.5) -> DataFrame:
    """(keys, key, others): the quantile of each group without the row itself, by shifted ranks, not by a self-join of rows.

    Without the row of rank r, the i-th of the others is rank i for i < r, else i + 1. So only three neighbouring values of a group
    are ever needed, which the same window picks: one shuffle.
    """
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, key, value, (F.row_number().over(w.orderBy(value, key)) - 1).cast("long").alias("r"), F.count("*").over(w).alias("n"))
    at = p * (F.col("n") - 2)
    lo, hi = F.floor(at).cast("long"), F.ceil(at).cast("long")
    one = lambda k: F.max(F.when(F.col("r") == k, F.col(value))).over(w)
    near = ranked.withColumns({"v0": one(lo), "v1": one(lo + 1), "v2": one(lo + 2)})
    kept = lambda i: F.when(i < F.col("r"), F.when(i == lo, F.col("v0")).otherwise(F.col("v1"))).otherwise(F.when(i == lo, F.col("v1")).otherwise(F.col("v2")))
    return near.where("n > 1").select(*keys, key, (kept(lo) + (kept(hi) - kept(lo)) * (at - lo)).alias("others"))


def tercile_bucket(df: DataFrame, keys: list[str], value: str, few: bool = False) -> DataFrame:
    cuts = quantile_of_large(df, keys, value, {"q33": 1 / 3, "q67": 2 / 3}, few=few)
    cuts = bounded(cuts) if few else cuts
    label = F.when(F.col(value).isNull(), "unknown").when(F.col(value) <= F.col("q33"), "low").when(F.col(value) <= F.col("q67"), "mid").otherwise("high")
    return join_same(df, cuts, keys).withColumn("bucket", label).drop("q33", "q67")


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with scaled: (value - median) / (interquartile range / 1.349)."""
    q = quantile_of_large(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    spread = (F.col("q75") - F.col("q25")) / 1.349
    return join_same(df, q, keys).withColumn("scaled", F.when(spread > 0, (F.col(value) - F.col("q50")) / spread)).drop("q25", "q50", "q75")


def target_encoding(df: DataFrame, level: str, target: str, smoothing: float = 10.0, least_rows: int = 3) -> DataFrame:
    """(level, encoding): smoothed mean of the target minus its global median."""
    g = quantile_of_large(df, [], target, {"g": 0.5})
    sums = df.groupBy(level).agg(F.sum(target).alias("s"), F.count(target).alias("n")).where(F.col("n") >= least_rows)
    return sums.join(F.broadcast(g)).select(level, ((F.col("s") + smoothing * F.col("g")) / (F.col("n") + smoothing) - F.col("g")).alias("encoding"))


def categorical_top_k(df: DataFrame, keys: list[str], field: str, k: int = 20) -> DataFrame:
    counts = df.where(F.col(field).isNotNull()).groupBy(*keys, field).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), field)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gram_matrix(df: DataFrame, keys: list[str], x: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """(keys, n, xx_i_j for i <= j, xy_i): weighted sums of products, one aggregate whatever the rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(c) for c in x]]
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i, j in combinations_with_replacement(range(len(cols)), 2)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *[F.sum(w * c * F.col(y)).alias(f"xy_{i}") for i, c in enumerate(cols)])


def model_weights(losses: DataFrame, keys: list[str], model: str, loss: str, least: float = 0.05) -> DataFrame:
    """(keys, model, weight): exp(-loss / median loss), at least `least`, normalised within keys."""
    w = Window.partitionBy(*keys)
    raw = F.greatest(F.lit(least), F.exp(-F.col(loss) / F.percentile(loss, 0.5).over(w)))
    return losses.select(*keys, model, raw.alias("__w")).select(*keys, model, (F.col("__w") / F.sum("__w").over(w)).alias("weight"))
