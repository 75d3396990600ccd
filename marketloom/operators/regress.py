"""Regressions whose heavy sums are Spark aggregates: only p x p sums come back, one small row for each key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import fold_of
from marketloom.operators.stats import gram_matrix, quantile_of_large
from marketloom.sources.io import bounded


def solved(xx: np.ndarray, xy: np.ndarray, ridge: float, tries: int = 6) -> np.ndarray:
    """Coefficients of the normal equations; the ridge grows a hundredfold until they can be solved, else the mean alone."""
    for k in range(tries):
        try:
            a = xx + np.diag([0.0] + [ridge * 100**k * max(1.0, xx[0, 0])] * (len(xy) - 1))
            out = np.linalg.solve(a, xy)
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            continue
    return np.array([xy[0] / xx[0, 0], *[0.0] * (len(xy) - 1)]) if xx[0, 0] else np.zeros(len(xy))


def coefficients(sums: DataFrame, keys: list[str], p: int, ridge: float = 1e-6) -> DataFrame:
    """(keys, beta array<double>) from the sums of gram_matrix: each key's p x p system is one small row."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = row._asdict()
                xx = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        xx[i, j] = xx[j, i] = own[f"xx_{i}_{j}"]
                out.append([float(b) for b in solved(xx, np.array([own[f"xy_{i}"] for i in range(p)]), ridge)])
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.Series(out, name="beta", dtype=object)], axis=1)

    types = dict(sums.dtypes)
    return sums.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", beta array<double>")


def predicted(x: Sequence[str]) -> Column:
    """The prediction from column beta and the feature columns."""
    out = F.get("beta", F.lit(0))
    for i, c in enumerate(x):
        out = out + F.get("beta", F.lit(i + 1)) * F.col(c)
    return out


def hedonic_fit(df: DataFrame, key: str, group: str, x: Sequence[str], y: str, folds: int = 5, ridge: float = 1e-6) -> DataFrame:
    """(key, n, rmse, r2): k-fold fit by whole groups, in one pass over the rows for the sums.

    Sums are taken by (key, fold); a fold's training sums are the key's total less the fold's own.
    """
    rows = df.withColumn("fold", fold_of(F.col(group), folds))
    by_fold = gram_matrix(rows, [key, "fold"], x, y)
    sums = [c for c in by_fold.columns if c.startswith("x")]
    total = by_fold.groupBy(key).agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    train = by_fold.join(total, key).select(key, "fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in sums])
    beta = coefficients(train, [key, "fold"], len(x) + 1, ridge)
    # one row for each key and fold
    scored = rows.join(beta, [key, "fold"]).withColumn("e", F.col(y) - predicted(x))
    return scored.groupBy(key).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (1 - F.avg(F.col("e") * F.col("e")) / F.var_pop(y)).alias("r2"))


def robust_fair_value(df: DataFrame, key: str, x: Sequence[str], y: str, rounds: int = 3, huber: float = 1.345, ridge: float = 1e-6) -> DataFrame:
    """df with fair and position: a Huber regression by reweighting; each round is one aggregate of sums and one of the spread.

    What a round hands on is a small frame of its own, a row for each key, so that no round's plan holds the one before it.
    """
    names = df.columns
    rows = df.withColumn("w", F.lit(1.0))
    for _ in range(rounds):
        beta = bounded(coefficients(gram_matrix(rows, [key], x, y, "w"), [key], len(x) + 1, ridge))
        fitted = df.join(beta, key).withColumn("fair", predicted(x)).withColumn("e", F.col(y) - F.col("fair"))
        spread = bounded(quantile_of_large(fitted, [key], F.abs("e"), {"s": 0.5}).withColumn("s", 1.4826 * F.col("s")))
        fitted = fitted.join(spread, key)
        u = F.abs(F.col("e")) / F.greatest("s", F.lit(1e-9))
        rows = fitted.withColumn("w", F.when(u <= huber, 1.0).otherwise(huber / u))
    position = F.when(F.col("e") > F.col("s"), "above").when(F.col("e") < -F.col("s"), "below").otherwise("within")
    return rows.select(*names, "fair", position.alias("position"))
