"""Price regressions on attributes: one-hot levels and numbers, held-out sets, and a robust fair value with a calibration block.

A row's features are a short array of (term, value). Sums of products are kept in long form, (key, term, term, sum), so that a level costs
only the pairs in which it occurs; levels are chosen before, so that a key's sums are bounded by the features and not by the rows. Only
these sums reach the task that solves a key's system.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import fold_of
from marketloom.operators.stats import join_same, quantiles_of_large
from marketloom.sources.io import bounded, settled

#: The terms of the constant and of the target.
ONE, TARGET = "", "=y"

#: Tries of a singular system and the factor by which its ridge grows, and the least pivot.
TRIES, GROWTH, LEAST_PIVOT = 6, 100.0, 1e-10


def level_terms(fields: Sequence[str]) -> Column:
    """array of (field, level term) of a row; a null or empty level is `unknown`."""
    level = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    each = [F.struct(F.lit(c).alias("field"), F.concat(F.lit(f"{c}="), level(c)).alias("i")) for c in fields]
    return F.array(*each) if each else F.expr("cast(array() as array<struct<field:string,i:string>>)")


def number_terms(fields: Sequence[str]) -> Column:
    """array of (term, value) of a row's constant and numbers; what is not finite counts as 0."""
    value = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).otherwise(0.0).cast("double")
    return F.array(F.struct(F.lit(ONE).alias("i"), F.lit(1.0).alias("x")), *[F.struct(F.lit(c).alias("i"), value(c).alias("x")) for c in fields])


def sparse_gram(rows: DataFrame, keys: Sequence[str], terms: str, y: str, weight: Column | None = None) -> DataFrame:
    """(keys, i, j, s) for i <= j: sums of products of all pairs of terms of a row, the target among them."""
    every = F.concat(F.col(terms), F.array(F.struct(F.lit(TARGET).alias("i"), F.col(y).cast("double").alias("x"))))
    of = lambda v: F.flatten(F.transform(v, lambda a: F.transform(F.filter(v, lambda b: b["i"] >= a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["x"] * b["x"]).alias("x")))))
    own = rows.select(*keys, every.alias("__t"), (F.lit(1.0) if weight is None else weight).alias("__w"))
    return own.select(*keys, "__w", F.explode(of(F.col("__t"))).alias("p")).groupBy(*keys, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum(F.col("__w") * F.col("p.x")).alias("s"))


def ridge_solution(gram: np.ndarray, xy: np.ndarray, ridge: float, spare_first: bool) -> tuple[np.ndarray, bool]:
    """Coefficients, and whether only the mean was left: the ridge grows until the system can be solved."""
    add = np.ones(len(xy))
    add[0] = 0.0 if spare_first else 1.0
    for k in range(TRIES):
        a = gram + np.diag(add * (ridge * GROWTH**k if ridge > 0 else (GROWTH**k if k else 0.0)))
        if np.isfinite(a).all() and np.linalg.svd(a, compute_uv=False)[-1] >= LEAST_PIVOT:
            out = np.linalg.solve(a, xy)
            if np.isfinite(out).all():
                return out, False
    return np.array([xy[0] / gram[0, 0] if gram[0, 0] else 0.0, *[0.0] * (len(xy) - 1)]), True


def solutions(sums: DataFrame, keys: list[str], ridge: float, spare_first: bool = False) -> DataFrame:
    """(keys, beta map<string,double>, fallback) from the long sums of each key, which are bounded by its features."""
    types = dict(sums.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        terms = sorted(set(pdf["i"]) - {TARGET})
        at = {t: k for k, t in enumerate(terms)}
        gram, xy = np.zeros((len(terms), len(terms))), np.zeros(len(terms))
        for i, j, s in zip(pdf["i"], pdf["j"], pdf["s"], strict=True):
            if TARGET in (i, j):
                other = j if i == TARGET else i
                if other != TARGET:
                    xy[at[other]] = s
            else:
                gram[at[i], at[j]] = gram[at[j], at[i]] = s
        beta, fallback = ridge_solution(gram, xy, ridge, spare_first)
        row = {k: [pdf[k].iloc[0]] for k in keys} | {"term": [terms], "value": [beta.tolist()], "fallback": [fallback]}
        return pd.DataFrame(row)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", term array<string>, value array<double>, fallback boolean"
    return sums.groupBy(*keys).applyInPandas(solve, schema).select(*keys, F.map_from_arrays("term", "value").alias("beta"), "fallback")


def dot(beta: Column, terms: Column) -> Column:
    """The prediction; terms without a coefficient count nothing."""
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["x"] * F.coalesce(F.try_element_at(beta, t["i"]), F.lit(0.0)))


class HedonicModel(NamedTuple):
    """metrics: key, n_folds, n, n_groups, n_features, covered, rmse, r2, fallback_folds, mae_by_kind, covered_by_kind.
    coefficients: key, beta (term to value), fallback. held_out: the rows that a fold left out with their prediction."""

    metrics: DataFrame
    coefficients: DataFrame
    held_out: DataFrame


def hedonic_model(df: DataFrame, key: str, group: str, categorical: Sequence[str], continuous: Sequence[str], y: str, kind: str | None = None, folds: int = 5, top_k: int = 20, ridge: float = 1e-6) -> HedonicModel:
    """A least-squares fit of y for each key, judged on whole groups that it did not see, and refitted on all rows.

    Each field's top_k levels (by rows, then name) of the training rows get a term; other levels have none. Rows go to folds by the hash of their group, with
    no more folds than groups and two at least. Sums are taken once, by (key, own fold); a fold's training sums are the
    total less its own. A fold without other rows is not covered. Null y is left out.
    """
    n_groups = df.where(F.col(y).isNotNull()).groupBy(key).agg(F.count_distinct(group).alias("n_groups"), F.count("*").alias("n"))
    sizes = bounded(n_groups.withColumn("n_folds", F.greatest(F.lit(2), F.least(F.lit(folds), F.col("n_groups")))))
    rows = join_same(df.where(F.col(y).isNotNull()), sizes.select(key, "n_folds"), [key], "inner")
    rows = rows.withColumn("__fold", fold_of(F.col(group), F.col("n_folds"))).withColumns({"__levels": level_terms(categorical), "__numbers": number_terms(continuous)})
    rows = rows.select(*df.columns, "__fold", "__levels", "__numbers")
    # levels that a fold's training rows (or all rows: fold -1) have most of
    counts = rows.select(key, "__fold", F.explode("__levels").alias("l")).groupBy(key, "__fold", "l.field", "l.i").agg(F.count("*").alias("c"))
    total = counts.groupBy(key, "field", "i").agg(F.sum("c").alias("c"))
    fits = sizes.select(key, F.explode(F.sequence(F.lit(-1), F.col("n_folds") - 1)).alias("fit"))
    trained = join_same(join_same(total, fits, [key], "inner"), counts.select(key, F.col("__fold").alias("fit"), "i", F.col("c").alias("own")), [key, "fit", "i"])
    trained = trained.withColumn("c", F.col("c") - F.coalesce("own", F.lit(0))).where("c > 0")
    ranked = trained.withColumn("rank", F.row_number().over(Window.partitionBy(key, "fit", "field").orderBy(F.desc("c"), "i"))).where(F.col("rank") <= top_k)
    kept = bounded(ranked.groupBy(key, "fit").agg(F.collect_list("i").alias("kept")))  # at most top_k times the fields
    any_fit = kept.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("kept"))).alias("__any"))
    known = join_same(rows, bounded(any_fit), [key])
    terms = F.concat("__numbers", F.transform(F.filter("__levels", lambda t: F.coalesce(F.array_contains("__any", t["i"]), F.lit(False))), lambda t: F.struct(t["i"].alias("i"), F.lit(1.0).alias("x"))))
    known = known.withColumn("__terms", terms).drop("__any", "__levels", "__numbers")
    own = settled(sparse_gram(known, [key, "__fold"], "__terms", y))
    every = own.groupBy(key, "i", "j").agg(F.sum("s").alias("s"))
    fit_sums = join_same(join_same(every, fits, [key], "inner"), own.select(key, F.col("__fold").alias("fit"), "i", "j", F.col("s").alias("own")), [key, "fit", "i", "j"])
    fit_sums = join_same(fit_sums.select(key, "fit", "i", "j", (F.col("s") - F.coalesce("own", F.lit(0.0))).alias("s")), kept, [key, "fit"])
    fixed = [ONE, TARGET, *continuous]
    stays = lambda c: F.col(c).isin(*fixed) | F.coalesce(F.array_contains("kept", F.col(c)), F.lit(False))
    fit_sums = fit_sums.where(stays("i") & stays("j")).drop("kept")
    some = fit_sums.where((F.col("i") == ONE) & (F.col("j") == ONE) & (F.col("s") > 0.5)).select(key, "fit")
    beta = settled(solutions(join_same(fit_sums, some, [key, "fit"], "inner"), [key, "fit"], ridge))
    scored = join_same(known, beta.withColumnRenamed("fit", "__fold"), [key, "__fold"], "inner").withColumn("predicted", dot(F.col("beta"), F.col("__terms")))
    held_out = scored.select(*df.columns, F.col("__fold").alias("fold"), "predicted")
    e = F.col(y) - F.col("predicted")
    kinds = F.coalesce(F.nullif(F.col(kind).cast("string"), F.lit("")), F.lit("unknown")) if kind else F.lit("unknown")
    # sums by kind give the sums of the key
    by_kind = held_out.groupBy(key, kinds.alias("kind")).agg(F.count("*").alias("c"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("ss"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", v))))
    whole = F.sum("c")
    mean = F.sum(F.col("c") * F.col("m")) / whole
    spread = F.sum(F.col("c") * (F.col("v") + F.col("m") * F.col("m"))) - whole * mean * mean
    scores = by_kind.groupBy(key).agg(
        whole.alias("covered"), F.sqrt(F.sum("ss") / whole).alias("rmse"), F.when(spread > 1e-12, 1 - F.sum("ss") / spread).alias("r2"), entry((F.col("a") / F.col("c")).alias("mae")).alias("mae_by_kind"), entry(F.col("c")).alias("covered_by_kind")
    )
    fits_of = beta.groupBy(key).agg(F.sum((F.col("fallback") & (F.col("fit") >= 0)).cast("int")).alias("fallback_folds"), F.max(F.when(F.col("fit") < 0, F.size("beta"))).alias("n_features"))
    metrics = join_same(join_same(sizes, fits_of, [key]), scores, [key])
    metrics = metrics.select(key, "n_folds", "n", "n_groups", "n_features", F.coalesce("covered", F.lit(0)).alias("covered"), "rmse", "r2", "fallback_folds", "mae_by_kind", "covered_by_kind")
    return HedonicModel(metrics, beta.where("fit < 0").select(key, "beta", "fallback"), held_out)


def hedonic_predict(df: DataFrame, coefficients: DataFrame, key: str, categorical: Sequence[str], continuous: Sequence[str]) -> DataFrame:
    """df with hedonic_log, from the coefficients of hedonic_model; null for a key without a model."""
    terms = F.concat(number_terms(continuous), F.transform(level_terms(categorical), lambda t: F.struct(t["i"].alias("i"), F.lit(1.0).alias("x"))))
    own = join_same(df, bounded(coefficients.select(key, F.col("beta").alias("__beta"))), [key])
    return own.withColumn("hedonic_log", F.when(F.col("__beta").isNotNull(), dot(F.col("__beta"), terms))).drop("__beta")


class FairValuePolicy(NamedTuple):
    """Fixed values of the robust fair value."""

    training_rows: int = 40
    calibration_rows: int = 12
    calibration_share: float = 0.25
    ridge: float = 2.0
    level_rows: int = 3
    huber: float = 1.5
    rounds: int = 3
    features: int = 240


QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


class FairValue(NamedTuple):
    """models: key, n_training, n_calibration, beta, centres, scales, q10..q90 of the calibration residuals, status, reasons. blocks: the eligible rows with their block."""

    models: DataFrame
    blocks: DataFrame


def time_blocks(rows: DataFrame, keys: list[str], at: str, row_id: str, share: float) -> DataFrame:
    """rows with block: of each key the last floor(n share) rows in order of (at, id), one at least and never all, are `calibrate`, the others `train`.

    Dates are counted first; only the rows of the one date through which the cut runs are ranked.
    """
    w = Window.partitionBy(*keys)
    days = rows.groupBy(*keys, at).agg(F.count("*").alias("__c")).withColumns({"__n": F.sum("__c").over(w), "__b": F.sum("__c").over(w.orderBy(at)) - F.col("__c")})
    late = F.least(F.greatest(F.lit(1), F.floor(F.col("__n") * share)), F.col("__n") - 1)
    days = days.withColumn("__cut", F.col("__n") - late - F.col("__b"))  # how many rows of this date still train
    placed = join_same(rows, days.select(*keys, at, "__c", "__cut"), [*keys, at])
    split = (F.col("__cut") > 0) & (F.col("__cut") < F.col("__c"))
    ranked = placed.where(split).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, at).orderBy(row_id)))
    block = lambda c: F.when(c, "train").otherwise("calibrate")
    out = placed.where(~split).withColumn("block", block(F.col("__cut") > 0))
    return out.unionByName(ranked.withColumn("block", block(F.col("__r") <= F.col("__cut"))).drop("__r")).drop("__c", "__cut")


def fair_value(df: DataFrame, key: str, row_id: str, at: str, available: str, price: str, cutoff: Column, numeric: Sequence[str], categorical: Sequence[str], policy: FairValuePolicy = FairValuePolicy()) -> FairValue:
    """A ridge regression of log price for each key, made robust by Huber weights, on the early rows before the cutoff, with residual quantiles of the later ones.

    A number is centred on its median and scaled by its interquartile range, both of the training rows; a missing one is 0 with an
    indicator. Levels of level_rows training rows get a term, in order of field and level as far as `features` go. Each round is one pass for the sums and two
    for the spread; what it hands on is a row for each key. Fewer rows than the policy asks for quarantine the model, with the reason; a key of one row has none.
    """
    rows = df.where((F.col(at) < cutoff) & (F.col(available) <= cutoff) & (F.col(price) > 0))
    rows = settled(time_blocks(rows, [key], at, row_id, policy.calibration_share))
    train = rows.where("block = 'train'")
    sizes = rows.groupBy(key).agg(F.count_if(F.col("block") == "train").alias("n_training"), F.count_if(F.col("block") == "calibrate").alias("n_calibration"))
    sizes = sizes.where("n_training + n_calibration > 1")
    wanted = {f"{c}|{q}": (c, p) for c in numeric for q, p in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))}
    scaled = join_same(sizes, quantiles_of_large(train, [key], wanted), [key]) if numeric else sizes
    if numeric:
        scaled = join_same(scaled, train.groupBy(key).agg(*[F.count(c).alias(f"{c}|n") for c in numeric]), [key])
    q = lambda c, part: F.col(f"`{c}|{part}`")
    centres = F.array(*[F.coalesce(q(c, "mid"), F.lit(0.0)) for c in numeric])
    scales = F.array(*[F.when(q(c, "n") >= 2, F.greatest(F.abs(q(c, "hi") - q(c, "lo")) / 1.349, F.lit(1e-6))).otherwise(1.0) for c in numeric])
    levels = train.select(key, F.explode(level_terms_known(categorical)).alias("i")).groupBy(key, "i").agg(F.count("*").alias("c")).where(F.col("c") >= policy.level_rows)
    most = max(0, policy.features - 1 - 2 * len(numeric))
    levels = levels.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("i"))).where(F.col("r") <= most)
    levels = levels.groupBy(key).agg(F.collect_list("i").alias("levels"))  # at most `features`
    facts = join_same(scaled.select(key, "n_training", "n_calibration", centres.cast("array<double>").alias("centres"), scales.cast("array<double>").alias("scales")), levels, [key])
    facts = bounded(facts.withColumn("levels", F.coalesce("levels", F.expr("cast(array() as array<string>)"))))
    design = join_same(rows, facts.select(key, "centres", "scales", "levels"), [key], "inner")
    design = settled(design.select(*df.columns, "block", design_terms(numeric, categorical).alias("__terms"), F.log(price).alias("__y")))
    training, beta = design.where("block = 'train'"), None
    for _ in range(policy.rounds):
        weight = None
        if beta is not None:
            away = F.abs(F.col("__y") - dot(F.col("beta"), F.col("__terms")) - F.col("centre"))
            weight = F.when(away <= F.col("limit"), 1.0).otherwise(F.col("limit") / away)
        seen = training if beta is None else join_same(training, beta, [key], "inner")
        solved = bounded(solutions(sparse_gram(seen, [key], "__terms", "__y", weight), [key], policy.ridge, spare_first=True).select(key, "beta"))
        residual = join_same(training, solved, [key], "inner").select(key, (F.col("__y") - dot(F.col("beta"), F.col("__terms"))).alias("e"))
        centre = bounded(quantiles_of_large(residual, [key], {"centre": ("e", 0.5)}))
        off = join_same(residual, centre, [key], "inner").select(key, F.abs(F.col("e") - F.col("centre")).alias("off"))
        spread = quantiles_of_large(off, [key], {"spread": ("off", 0.5)})
        limit = policy.huber * F.greatest(F.lit(1e-6), 1.4826 * F.col("spread"))
        beta = bounded(join_same(join_same(solved, centre, [key]), spread, [key]).select(key, "beta", "centre", limit.alias("limit")))
    late = join_same(design.where("block = 'calibrate'"), beta, [key], "inner").select(key, (F.col("__y") - dot(F.col("beta"), F.col("__terms"))).alias("e"))
    bands = quantiles_of_large(late, [key], {name: ("e", p) for name, p in QUANTILES.items()})
    few = {"insufficient_training_rows": F.col("n_training") < policy.training_rows, "insufficient_calibration_rows": F.col("n_calibration") < policy.calibration_rows}
    reasons = F.array_compact(F.array(F.lit("structural_model_only"), F.lit("operator_model_review_required"), *[F.when(bad, name) for name, bad in few.items()]))
    models = join_same(join_same(facts, beta.select(key, "beta"), [key], "inner"), bands, [key])
    status = F.when(few["insufficient_training_rows"] | few["insufficient_calibration_rows"], "quarantined").otherwise("research_only")
    return FairValue(models.select(key, "n_training", "n_calibration", "beta", "centres", "scales", "levels", *QUANTILES, status.alias("status"), reasons.alias("reasons")), design.select(*df.columns, "block"))


def level_terms_known(fields: Sequence[str]) -> Column:
    """The level terms of a row, blanks trimmed; a null or empty level has none."""
    each = [F.concat(F.lit(f"{c}="), F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))) for c in fields]
    return F.array_compact(F.array(*each)) if each else F.expr("cast(array() as array<string>)")


def design_terms(numeric: Sequence[str], categorical: Sequence[str]) -> Column:
    """The terms of a row that has its key's centres, scales and levels."""
    found = [F.struct(F.lit(ONE).alias("i"), F.lit(1.0).alias("x"))]
    for k, c in enumerate(numeric):
        own = (F.col(c).cast("double") - F.get("centres", F.lit(k))) / F.get("scales", F.lit(k))
        found += [F.struct(F.lit(c).alias("i"), F.coalesce(own, F.lit(0.0)).alias("x")), F.struct(F.lit(f"{c}|missing").alias("i"), F.col(c).isNull().cast("double").alias("x"))]
    kept = F.filter(level_terms_known(categorical), lambda i: F.array_contains("levels", i))
    return F.concat(F.array(*found), F.transform(kept, lambda i: F.struct(i.alias("i"), F.lit(1.0).alias("x"))))


def fair_estimates(df: DataFrame, models: DataFrame, key: str, price: str, quality: str, numeric: Sequence[str], categorical: Sequence[str], policy: FairValuePolicy = FairValuePolicy()) -> DataFrame:
    """df with q10..q90 of the fair price, position (of the price against the inner range), confidence, status and reasons; keys without a model have nulls."""
    own = join_same(df, bounded(models), [key])
    centre = dot(F.col("beta"), design_terms(numeric, categorical))
    ordered = F.array_sort(F.array(*[F.exp(centre + F.col(q)) for q in QUANTILES]))
    out = own.withColumn("__o", F.when(F.col("beta").isNotNull(), ordered))
    out = out.select(*df.columns, *[F.get("__o", F.lit(k)).alias(q) for k, q in enumerate(QUANTILES)], "status", "reasons", "n_training", "n_calibration")
    position = F.when(F.col(price) < F.col("q25"), "below_range").when(F.col(price) > F.col("q75"), "above_range").when(F.col("q50").isNotNull(), "within_range")
    support = F.least(F.lit(1.0), F.col("n_training") / (2 * policy.training_rows), F.col("n_calibration") / (2 * policy.calibration_rows))
    confidence = F.when(F.col("status") == "quarantined", 0.0).otherwise(F.least(F.lit(79.0), 100 * F.col(quality) * support))
    return out.withColumns({"position": position, "confidence": confidence}).drop("n_training", "n_calibration")
