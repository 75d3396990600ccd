"""As-of, carry-forward, interval and similarity joins without inequality joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance_days: int | None = None) -> DataFrame:
    """left with value and value_at of right's last row at or before left's `at`.

    Both sides are stacked and one window carries the last right row forward: one shuffle on keys.
    """
    names = left.columns
    a = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.union(b).withColumn("__last", F.last(F.when(F.col("__side") == 0, F.struct(F.col("__at").alias("at"), F.col("__v").alias("v"))), ignorenulls=True).over(w)).where("__side = 1")
    near = F.lit(True) if tolerance_days is None else F.datediff("__at", "__last.at") <= tolerance_days
    return found.select(*[F.col(f"__row.{c}").alias(c) for c in names], F.when(near, F.col("__last.v")).alias(value), F.when(near, F.col("__last.at")).alias(f"{value}_at"))


def carry_forward(points: DataFrame, grid: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, at, value): the last known value at each grid date, for each key."""
    cells = points.select(*keys).distinct().join(F.broadcast(grid.select(at)))
    return asof_backward(cells, points, keys, at, value).select(*keys, at, value)


def event_age(targets: DataFrame, events: DataFrame, as_of: Column, key: str, at: str) -> DataFrame:
    """targets with event_age_days since the newest event at or before as_of."""
    newest = events.where(F.col(at) <= as_of).groupBy(key).agg(F.max(at).alias("__e"))
    return targets.join(newest, key, "left").withColumn("event_age_days", F.datediff(as_of, "__e")).drop("__e")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, at: str, cell_days: int = 7) -> DataFrame:
    """Pairs with lo <= at <= hi: equi-joined on cells of days, so that a key's rows do not all meet."""
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / cell_days)
    a = left.withColumn("__cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))
    b = right.withColumn("__cell", cell(F.col(at)))
    return a.join(b, [*keys, "__cell"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__cell")


def select_exact(items: DataFrame, candidates: DataFrame, fields: list[str], newest: str, id_: str) -> DataFrame:
    """items with the id of the candidate that equals them in every field: the newest, or none if identities differ."""
    best = candidates.groupBy(*fields).agg(F.count_distinct("identity").alias("n"), F.max_by(id_, F.struct(newest, id_)).alias(id_)).where("n = 1").drop("n")
    return items.join(best, fields, "left")
