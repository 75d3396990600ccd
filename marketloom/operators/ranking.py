"""Ordering, top-k, search and deterministic samples."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import card_prefixes, hash_similarity, query_norm, shard_of, text_similarity
from marketloom.sources.io import bounded


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def hash_sample(df: DataFrame, keys: list[str], id_: Column, n: int) -> DataFrame:
    """n rows of each key, those of least SHA-256."""
    return top_per_key(df.withColumn("__h", F.sha2(id_.cast("string"), 256)), keys, [F.col("__h")], n, "sample_rank").drop("__h")


def last_n_dates(df: DataFrame, keys: list[str], at: str, n: int = 80) -> DataFrame:
    return df.withColumn("__r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).where(F.col("__r") <= n).drop("__r")


def prune_cache(df: DataFrame, now: Column, ttl_days: int, most: int = 250) -> DataFrame:
    """Rows within their time, the newest `most` of them."""
    return df.where(F.datediff(now, "stored_on") <= ttl_days).orderBy(F.desc("stored_on"), "key").limit(most)


def rank_hits(items: DataFrame, query: str) -> DataFrame:
    """items (id, name, detail, number) with score: similarity of name or detail, plus 0.12 for the exact number."""
    q = F.lit(query)
    exact = F.array_contains(F.split(query_norm(q), " "), query_norm(F.col("number")))
    # a text is compared once, however many items share it
    compared = lambda c, weight: bounded(items.select(c).distinct().select(F.col(c).alias(f"__k_{c}"), (weight * text_similarity(F.col(c), q)).alias(f"__s_{c}")))
    own = items
    for c, weight in (("name", 1.0), ("detail", 0.92)):
        own = own.join(compared(c, weight), F.col(c).eqNullSafe(F.col(f"__k_{c}")), "left")
    score = F.greatest("__s_name", "__s_detail") + F.when(exact & (query_norm(F.col("number")) != ""), 0.12).otherwise(0.0)
    best = own.select("id", "name", F.least(F.lit(1.0), score).alias("score")).groupBy("id").agg(F.max_by(F.struct("name", "score"), F.struct("score", "name")).alias("b"))
    return best.select("id", "b.name", "b.score")


def filter_sets(sets: DataFrame, query: str, least: float = 0.35) -> DataFrame:
    """sets (id, name) that fit: 4 same, 3 begins with, 2 contains, else similarity."""
    name, q = query_norm(F.col("name")), query_norm(F.lit(query))
    score = F.when(name == q, 4.0).when(name.startswith(q), 3.0).when(name.contains(q), 2.0).otherwise(text_similarity(F.col("name"), F.lit(query)))
    return sets.withColumn("score", score).where(F.col("score") >= least)


def prefix_index(products: DataFrame, id_: str, name: str, shards: int = 64, category: str | None = None) -> DataFrame:
    """(shard, prefix, id, name, and category if named): a row for each prefix of a product, to be written by write_prefix_index."""
    kept = [id_, name, *([category] if category else [])]
    return products.select(F.explode(card_prefixes(F.col(name))).alias("prefix"), *kept).withColumn("shard", shard_of(F.col("prefix"), shards))


def write_prefix_index(index: DataFrame, path: str, name: str, category: str | None = None) -> None:
    """The index as Parquet, a folder for each category and shard, sorted by prefix and name, so that a search reads one folder and few row groups of it."""
    folders = [*([category] if category else []), "shard"]
    index.repartition(*folders).sortWithinPartitions(*folders, "prefix", name).write.partitionBy(*folders).parquet(path)


def prefix_search(index: DataFrame, query: str, id_: str, name: str, after: tuple[str, object] | None = None, limit: int = 25, category: tuple[str, object] | None = None, shards: int | None = None) -> DataFrame:
    """The first `limit` products by (name, id) that contain the query, after the (name, id) at which the last page ended.

    Only the rows of the query's first prefix are read; with `shards` (as the index was made) and category (column, value) only their folder.
    A query of fewer than 3 or more than 120 characters is refused.
    """
    text = " ".join(query.lower().split())
    if not 3 <= len(text) <= 120:
        raise ValueError("a query has 3 to 120 characters")
    first = next((t for t in text.split(" ") if len(t) >= 3), text)[:3]
    found = index.where(F.col("prefix") == first)
    if shards is not None:
        # taken here, so that the plan has a constant to choose folders by
        found = found.where(F.col("shard") == int(hashlib.sha256(first.encode()).hexdigest()[:8], 16) % shards)
    if category is not None:
        found = found.where(F.col(category[0]) == category[1])
    found = found.where(F.instr(query_norm(F.col(name)), text) > 0)
    if after is not None:
        found = found.where((F.col(name) > after[0]) | ((F.col(name) == after[0]) & (F.col(id_) > after[1])))
    return found.select(id_, name).distinct().orderBy(name, id_).limit(limit)


def hamming_topk(queries: DataFrame, base: DataFrame, k: int = 24, least: float = 0.72, block_rows: int = 5_000) -> DataFrame:
    """(query_id, id, similarity, rank): the nearest 64-bit hashes with similarity at least `least`.

    So many bits may differ that no band must agree, so the stated queries go against all rows, in blocks of about
    block_rows; a block is what is broadcast, and each block keeps only its k best.
    """
    blocks = max(1, -(-queries.count() // block_rows))
    out = None
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select(F.col("id").alias("query_id"), F.col("hash").alias("__q"))
        found = base.select("id", F.col("hash").alias("__b")).join(F.broadcast(own)).withColumn("similarity", hash_similarity(F.col("__q"), F.col("__b"))).where((F.col("similarity") >= least) & (F.col("id") != F.col("query_id")))
        best = top_per_key(found.select("query_id", "id", "similarity"), ["query_id"], [F.desc("similarity"), F.col("id")], k)
        out = best if out is None else out.union(best)
    return out


def pick_cover(df: DataFrame, key: str, name: str, id_: str) -> DataFrame:
    """One id for each key: by keyword tier, then the lowest id."""
    tier = F.when(F.lower(name).contains("booster"), 0).when(F.lower(name).contains("box"), 1).otherwise(2)
    return df.groupBy(key).agg(F.min_by(id_, F.struct(tier, F.col(id_))).alias("cover"))
