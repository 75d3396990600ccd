"""Nested market indices from trimmed mean returns, and the release-age curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.stats import join_same, trimmed_mean
from marketloom.operators.windows import step_returns
from marketloom.sources.io import bounded, settled


LEVELS = ("market", "category", "group")


def level_means(steps: DataFrame, fraction: float = 0.1, cell: float = 1e-3) -> DataFrame:
    """(level, category, grp, t, mean): trimmed mean step returns of the market, each category and each group at each t at which any price was seen.

    A date of the market is too much for one task, so all three levels go by cells of the return in one aggregate, which combines before the shuffle. Cells inside
    the kept ranks give their sums; the two of each date that a cut runs through are ranked row by row.
    """
    none = F.lit(None).cast("string")
    category, grp = F.col("category").cast("string"), F.col("grp").cast("string")
    each = [F.struct(F.lit(0).alias("level"), none.alias("category"), none.alias("grp")), F.struct(F.lit(1).alias("level"), category.alias("category"), none.alias("grp")), F.struct(F.lit(2).alias("level"), category.alias("category"), grp.alias("grp"))]
    rows = steps.select(F.explode(F.array(*each)).alias("k"), "t", F.col("r").cast("double").alias("r")).select("k.level", "k.category", "k.grp", "t", "r", F.floor(F.col("r") / cell).alias("cell"))
    keys = ["level", "category", "grp", "t"]
    cells = rows.groupBy(*keys, "cell").agg(F.count("r").alias("c"), F.sum("r").alias("s"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    w = Window.partitionBy(*keys)
    placed = cells.withColumns({"n": F.sum("c").over(w), "b": F.sum("c").over(w.orderBy("cell")) - F.col("c")}).withColumn("cut", F.floor(F.col("n") * fraction))
    take = F.greatest(F.lit(0), F.least(F.col("b") + F.col("c"), F.col("n") - F.col("cut")) - F.greatest("b", "cut"))
    # which cells are split is read twice: for the sums, and for the rows that are ranked
    placed = settled(placed.withColumn("take", take).withColumn("split", (F.col("take") > 0) & (F.col("take") < F.col("c")) & (F.col("lo") < F.col("hi"))))
    whole = placed.select(*keys, F.when(F.col("split"), 0.0).when(F.col("take") == F.col("c"), F.col("s")).otherwise(F.col("take") * F.col("lo")).alias("x"), (F.col("n") - 2 * F.col("cut")).alias("kept"))
    cut_cells = placed.where("split").select(*keys, "cell", "b", "cut", "n")
    ranked = join_same(rows.where("r is not null"), cut_cells, [*keys, "cell"], "inner").withColumn("i", F.col("b") + F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("r")) - 1)
    inside = ranked.where((F.col("i") >= F.col("cut")) & (F.col("i") < F.col("n") - F.col("cut"))).select(*keys, F.col("r").alias("x"), (F.col("n") - 2 * F.col("cut")).alias("kept"))
    means = whole.unionByName(inside).groupBy(*keys).agg((F.sum("x") / F.max(F.when(F.col("kept") > 0, F.col("kept")))).alias("mean"))
    return means.withColumn("level", F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")))


def index_levels(panel: DataFrame, keys: list[str], fraction: float = 0.1) -> DataFrame:
    """(level, category, grp, t, step, idx): cumulative market return, a category's excess over it, a group's over its category.

    A level has a row for each t at which any price was seen; without returns it carries its value, and a group starts at 0
    when first seen. The trimmed means of all levels are written once; what follows works on dates and groups only, never on series.
    """
    means = bounded(level_means(step_returns(panel, keys).select("category", "grp", "t", "r"), fraction))
    of = lambda level, name, *own: means.where(F.col("level") == level).select(*own, "t", F.col("mean").alias(name))
    market, category, group = of("market", "m"), of("category", "c", "category"), of("group", "g", "category", "grp")
    grid = market.select("t")  # the dates of the panel
    none = F.lit(None).cast("string")
    rows_m = market.select(F.lit("market").alias("level"), none.alias("category"), none.alias("grp"), "t", F.coalesce("m", F.lit(0.0)).alias("step"))
    cats = join_same(category.select("category").distinct().join(grid), category, ["category", "t"]).join(market, "t", "left")
    rows_c = cats.select(F.lit("category").alias("level"), "category", none.alias("grp"), "t", F.when(F.col("c").isNotNull(), F.col("c") - F.coalesce("m", F.lit(0.0))).otherwise(0.0).alias("step"))
    first = group.groupBy("category", "grp").agg(F.min("t").alias("t0")).join(grid).where("t >= t0").drop("t0")
    groups = join_same(join_same(first, group, ["category", "grp", "t"]), category, ["category", "t"])
    rows_g = groups.select(F.lit("group").alias("level"), "category", "grp", "t", F.when(F.col("g").isNotNull(), F.col("g") - F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("step"))
    w = Window.partitionBy("level", "category", "grp").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows_m.union(rows_c).union(rows_g).withColumn("idx", F.sum("step").over(w))


def lifecycle_curve(steps: DataFrame, released: DataFrame, up_to: int | None = None, max_age: int = 260, fraction: float = 0.1) -> DataFrame:
    """(age, curve, n): trimmed mean of groups' step returns by steps since release. steps: category, grp, t, step."""
    aged = steps.join(released, ["category", "grp"]).withColumn("age", F.col("t") - F.col("released")).where(F.col("age").between(1, max_age))
    if up_to is not None:
        aged = aged.where(F.col("t") <= up_to)
    return trimmed_mean(aged, ["age"], "step", fraction, "curve")


def cohort_return(curve: DataFrame, ages: DataFrame, steps: int) -> DataFrame:
    """ages with cohort_return: the curve's sum over age + 1 to age + steps, missing ages counting 0."""
    ahead = ages.select("age").distinct().select("age", F.explode(F.sequence(F.col("age") + 1, F.col("age") + steps)).alias("__at"))
    sums = ahead.join(curve.select(F.col("age").alias("__at"), "curve"), "__at", "left").groupBy("age").agg(F.sum(F.coalesce("curve", F.lit(0.0))).alias("cohort_return"))
    return ages.join(sums, "age")
