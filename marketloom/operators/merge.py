"""Change-detecting merges, scope deletes, two-sided sync and retention, as new snapshots of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import shard_of


def upsert_changed(current: DataFrame, batch: DataFrame, keys: list[str], values: list[str], day: Column) -> DataFrame:
    """The table after the batch: first_seen stays, changed_on moves only where a value differs; action tells what happened."""
    c = current.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.col("first_seen").alias("__first"), F.col("changed_on").alias("__changed"), F.lit(True).alias("__old"))
    b = batch.select(*keys, *values, F.lit(True).alias("__new"))
    j = c.join(b, keys, "outer")
    differs = ~reduce(lambda x, y: x & y, [F.col(v).eqNullSafe(F.col(f"__{v}")) for v in values])
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "keep").when(differs, "update").otherwise("same")
    pick = lambda v: F.when(F.col("__new").isNull(), F.col(f"__{v}")).otherwise(F.col(v)).alias(v)
    return j.withColumn("action", action).select(
        *keys, *[pick(v) for v in values], F.coalesce("__first", day).alias("first_seen"), F.when(F.col("action").isin("insert", "update"), day).otherwise(F.col("__changed")).alias("changed_on"), "action"
    )


def delete_missing_in_scope(current: DataFrame, batch: DataFrame, keys: list[str], scope: str, scopes: DataFrame) -> DataFrame:
    """current without the rows of a complete scope that the batch lacks."""
    gone = current.join(scopes.select(scope).distinct(), scope, "left_semi").select(*keys).join(batch.select(*keys), keys, "left_anti")
    return current.join(gone, keys, "left_anti")


def apply_if_newer(current: DataFrame, batch: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """batch rows whose stamp is later than the table's for their keys: older ones are not applied."""
    c = current.select(*keys, F.col(stamp).alias("__s"))
    return batch.join(c, keys, "left").where(F.col("__s").isNull() | (F.col(stamp) > F.col("__s"))).drop("__s")


def replay_guard(sealed: DataFrame, batch: DataFrame, batch_id: str) -> DataFrame:
    """batch rows of batches that were not sealed before."""
    return batch.join(sealed.select(batch_id), batch_id, "left_anti")


def lww_merge(a: DataFrame, b: DataFrame, tombstones: DataFrame, key: str, stamp: str) -> DataFrame:
    """Last writer wins; a row with a tombstone at or after its stamp goes; b wins a tie."""
    rest = [c for c in a.columns if c != key]
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(stamp, "__side")).alias("w")).select(key, *[F.col(f"w.{c}").alias(c) for c in rest])
    dead = tombstones.groupBy(key).agg(F.max("deleted_at").alias("__d"))
    return newest.join(dead, key, "left").where(F.col("__d").isNull() | (F.col(stamp) > F.col("__d"))).drop("__d")


def merge_snapshots(rebuilt: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: observed before rebuilt."""
    rest = [c for c in observed.columns if c not in keys]
    both = rebuilt.withColumn("__p", F.lit(0)).unionByName(observed.withColumn("__p", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest, "__p"), "__p").alias("w")).select(*keys, *[F.col(f"w.{c}").alias(c) for c in rest], F.when(F.col("w.__p") == 1, "observed").otherwise("rebuilt").alias("origin"))


def append_revision(ledger: DataFrame, obs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """obs rows that differ from the ledger's newest value for their keys, with the revision number they get."""
    now = ledger.groupBy(*keys).agg(F.max_by(value, "revision").alias("__v"), F.max("revision").alias("__r"))
    return obs.join(now, keys, "left").where(F.col("__r").isNull() | ~F.col(value).eqNullSafe(F.col("__v"))).withColumn("revision", F.coalesce(F.col("__r") + 1, F.lit(1))).drop("__v", "__r")


def refresh_plan(current: DataFrame, known: DataFrame, key: str, value: str, day_number: int, cycle: int = 7) -> DataFrame:
    """(key, reasons): new, changed, gone, or due for its turn in a rotating audit."""
    j = current.select(key, F.col(value).alias("__c")).join(known.select(key, F.col(value).alias("__k")), key, "outer")
    turn = shard_of(F.col(key), cycle) == day_number % cycle
    reasons = F.array_compact(
        F.array(F.when(F.col("__k").isNull(), "new"), F.when(F.col("__c").isNull(), "gone"), F.when(F.col("__c").isNotNull() & F.col("__k").isNotNull() & (F.col("__c") != F.col("__k")), "changed"), F.when(turn, "audit"))
    )
    return j.select(key, reasons.alias("reasons")).where(F.size("reasons") > 0)


def prune(df: DataFrame, at: str, today: Column, days: int) -> DataFrame:
    if days < 30:
        raise ValueError("retention must be at least 30 days")
    return df.where(F.datediff(today, at) <= days)


def erase_user(tables: dict[str, DataFrame], erased: DataFrame, user: str) -> dict[str, DataFrame]:
    return {name: df.join(erased.select(user), user, "left_anti") for name, df in tables.items()}


def exact_cover(supplied: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: missing, unexpected and repeated keys."""
    s = supplied.groupBy(key).agg(F.count("*").alias("n"))
    j = s.join(expected.select(key).distinct().withColumn("e", F.lit(True)), key, "outer")
    return j.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"))
