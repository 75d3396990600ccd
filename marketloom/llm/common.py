"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id where a key must not be null; such rows sort after all others.
NULL_ID = 9223372036854775807

#: Rows and bytes of an Arrow batch of texts at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 8_000_000

#: Short rows (or parts of rows) that may be broadcast, once they are counted.
SMALL_ROWS = 50_000

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into short slices, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of bounded size: texts are long, and Spark's default of 10,000 rows a batch would
    make a worker's memory follow the length of documents. Spark reads both settings when the plan runs, so they stay
    set in the session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The column's values as text, null as empty; bytes that are not UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in utf8(column)]


def keyed_texts(documents: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): a join key that is never null and that repeated rows share.

    k1 is doc_id, or NULL_ID; k2 tells different texts under one doc_id apart.
    """
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"),
        content_key(F.col("text")).alias("k2"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; make one only where none is named, on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marketloom-checkpoint-"))
    own = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())
    own.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(own)  # when the application ends


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def content_key(text: Column) -> Column:
    """Tells different texts under one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def only(df: DataFrame, keys: DataFrame, text: str = "text", doc_id: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The rows of df whose (doc_id, content key) is one of `keys` (columns __id, __key), or, left_anti, is none of them."""
    same = df[doc_id].eqNullSafe(keys["__id"]) & (content_key(df[text]) == keys["__key"])
    return df.join(keys, same, how)


def bounded(df: DataFrame, weight: Column | None = None, most: int = SMALL_ROWS) -> DataFrame:
    """The frame, cut; marked for a broadcast only if its rows (or the sum of `weight` over them) were counted as at most `most`."""
    own = cut(df)
    total = own.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(own) if total <= most else own
