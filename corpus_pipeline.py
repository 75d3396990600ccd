"""The corpus pipeline: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

In every stage a null text counts as empty, texts are read whole whatever their length, and an empty table gives an empty
result. Extra columns are kept and may have any name that documents has once. A document is named by doc_id and text together:
rows that repeat both are one document and share its fate, while null or repeated doc_ids of different texts are judged apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, decontam, exact_dedup, near_copies, simhash, toxicity
from marketloom.llm.common import ensure_checkpoint_dir, table
from marketloom.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or higher go. Empty texts score as any other, by the model's
    constant; without labels of both kinds nothing is learnt and all stay."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, a null one only where there is no other; all empty texts are one group."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, a null one only where there is no other. Near copies are texts whose
    SimHash fingerprints differ in 4 bits or fewer, as op2 links them, and texts whose sets of 5-word shingles have Jaccard
    similarity 0.8 or more, which 4 bits miss; a group is what links of both kinds connect. Texts without words are one group; a
    text of fewer than five words is one shingle."""
    return near_copies.keep_one(docs, bits=simhash.DISTANCE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Texts without words hold none; items without words have none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the hash of what the ids decode to; a row for each row, empty texts without ids."""
    found = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: No SQL: three stages hash, score or tokenise in ways that SQL lacks; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, through Parquet in the shared checkpoint folder. A stage's output goes when the next one's is written;
    the last one's, which the result reads, goes when the application ends."""
    ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(root)
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        own = f"{root.toString()}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if last:
            files.delete(jvm.org.apache.hadoop.fs.Path(last), True)
        last = own
    return docs
