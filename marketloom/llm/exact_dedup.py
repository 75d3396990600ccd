"""Exact dedup with DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space.
Documents are grouped by the 128-bit hash of that text *and* the text itself, so the aggregate
compares bytes inside a hash group and two texts that share a hash stay apart. The smallest doc_id of
a group stays. Copies meet in the map-side part of the aggregate, so a group that holds a third of all
rows sends one row from each task. Texts cross the network once, as grouping keys; the join
that brings groups back to documents carries only digests (MD5 and XXH64; SHA-256 is taken once for a group), and
adaptive execution splits its hot keys.

Null text counts as empty. A null doc_id never stays while its group has another; a group of null ids
only has a null keep_id and keeps its rows. Rows that repeat the doc_id that stays are the same document
and stay with it. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import content_key, only


def squeezed(text: Column) -> Column:
    """The text with each run of ASCII white space as one space. Single spaces, by far the most
    common, are not matched, which spares copying them one at a time."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def labelled(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, key (the content key of the text as it is), h, x, keep_id, group_size, sha for every row."""
    docs = df.select(F.col(doc_id).alias("doc_id"), content_key(F.col(text)).alias("key"), squeezed(F.col(text)).alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    classes = (
        docs.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.xxhash64("norm").alias("x"), F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    # (h, x) names a group of equal bytes: were it ever shared by two, the job must stop
    groups = classes.groupBy("h", "x").agg(
        F.min("keep_id").alias("keep_id"),
        F.when(F.count("*") == 1, F.sum("group_size")).otherwise(F.raise_error(F.lit("two texts share an MD5 and an XXH64"))).cast("long").alias("group_size"),
        F.min("sha").alias("sha"),
    )
    keys = docs.select("doc_id", "key", "h", F.xxhash64("norm").alias("x"))
    return keys.join(groups, ["h", "x"])


def exact_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return labelled(df, text, doc_id).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df that stay, found by doc_id and text together: one document of each group, also where
    doc_ids are null or stand for several texts. Of texts under the doc_id that stays which differ in white space only,
    the one of least hash stays; rows that repeat it are the same document and stay with it."""
    first = labelled(df, text, doc_id).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h", "x").agg(F.min("keep_id").alias("__id"), F.min("key").alias("__key"))
    return only(df, first.select("__id", "__key"), text, doc_id)
