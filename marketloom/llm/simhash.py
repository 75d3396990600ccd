"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
text's shingles of lower-cased words. Two fingerprints link when they differ in `distance` bits or
fewer. With the bits cut into `blocks` blocks, such a pair agrees on at least blocks - distance
whole blocks, so every choice of that many blocks is a key on which one true pair or another meets.

Work is on distinct fingerprints: copies are one node, however many there are. A key's members are
compared by a search that leaves a spanning forest instead of all pairs: a member is compared
with those not yet reached, so a dense group shrinks quickly. Keys with over `chunk` members are
dealt out as pairs of chunks, so that no task holds more than two chunks of one key.

Null and empty texts, and texts of blanks, have fingerprint 0 and link like any other. Repeated rows
each keep a row. A null doc_id is never a component's name unless its whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import content_key, cut, map_arrow, only, slices, utf8
from marketloom.llm.graph import components

BLOCKS, DISTANCE, WORDS, CHUNK = 7, 4, 4, 20_000
ALL_BITS = (1 << 64) - 1


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    found = text.lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[start : start + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS) -> DataFrame:
    """`keep` and fp long (the fingerprint's bits as a signed number)."""
    kept = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bits = np.array([fingerprint(t, words) for t in utf8(part.column(len(keep)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(bits)], names=[*keep, "fp"])

    return map_arrow(kept, run, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks - distance blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, c) for c in combinations(own, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that join what is within `distance` bits: inside left, or between left and right.

    A breadth-first search: each reached member is compared with those not yet reached. With two
    chunks, only pairs across them count; pairs inside a chunk are another unit's.
    """
    todo = [left] if right is None else [left, right]
    links: list[tuple[int, int]] = []
    while len(todo[0]):
        start, todo[0] = todo[0][0], todo[0][1:]
        queue = [(0, start)]
        while queue:
            side, x = queue.pop()
            other = 0 if right is None else 1 - side
            near = np.bitwise_count(todo[other] ^ x) <= distance
            if near.any():
                found = todo[other][near]
                todo[other] = todo[other][~near]
                links += [(int(x), int(y)) for y in found]
                queue += [(other, y) for y in found]
    return links


def near_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints in column fp, enough to connect all that are within
    `distance` bits. Their number follows the number of fingerprints, not of pairs."""
    masks = [signed(m) for m in block_masks(blocks, distance)]
    keyed = (
        fps.select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x"))
        .select(F.xxhash64("x.c", "x.k").alias("key"), "fp")
    )
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    units = keyed.join(crowded, "key", "left").withColumn("own", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), "chunks")).cast("int"))
    units = units.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))).alias("other"))
    units = units.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0) | (np.diff(rows[:, 2]) != 0)) + 1
            bounds = np.concatenate(([0], edges, [len(rows)]))
            found: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                unit = rows[bounds[i] : bounds[i + 1]]
                same, fp = unit[0, 1] == unit[0, 2], unit[:, 4]
                if len(fp) == 2:
                    if (int(fp[0] ^ fp[1]) & ALL_BITS).bit_count() <= distance and (same or unit[0, 3] != unit[1, 3]):
                        found.append((int(fp[0]), int(fp[1])))
                elif same:
                    found += forest(fp.view(np.uint64), None, distance)
                else:
                    found += forest(fp[unit[:, 3] == 0].view(np.uint64), fp[unit[:, 3] == 1].view(np.uint64), distance)
            ends = np.array(found, dtype=object).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.array([int(x) & ALL_BITS for x in ends[:, j]], np.uint64).view(np.int64)) for j in (0, 1)], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not len(rows):
                continue
            # the last unit of a batch may go on in the next
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield solve(np.concatenate([*held, rows[:end]]))
                held = [rows[end:]]
            elif held and (held[0][0, :3] != rows[0, :3]).any():
                yield solve(np.concatenate(held))
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield solve(np.concatenate(held))

    dealt = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return map_arrow(dealt, run, "a long, b long").distinct()


def labelled(df: DataFrame, text: str, doc_id: str, distance: int, blocks: int, words: int, chunk: int) -> DataFrame:
    """doc_id, key (content key), fp, first: (no id, doc_id, key) of the component's first document."""
    ids = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), content_key(F.col(text)).alias("key"))
    docs = cut(fingerprints(ids, keep=("doc_id", "key"), words=words))
    classes = docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    found = components(near_links(docs, distance, blocks, chunk)).withColumnRenamed("node", "fp")
    # only linked fingerprints have a component; the others are alone
    named = found.join(classes, "fp").groupBy("component").agg(F.min("first").alias("least"))
    linked = found.join(named, "component").select("fp", "least")
    reps = classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))
    return docs.join(reps, "fp").select("doc_id", "key", "fp", "first")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, blocks: int = BLOCKS, words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp long, component_id: the smallest doc_id reachable over links, itself included."""
    return labelled(df, text, doc_id, distance, blocks, words, chunk).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, blocks: int = BLOCKS, words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """The rows of df whose document, by doc_id and text together, is the first of its component: least doc_id, null
    last, then least hash of the text. Rows that repeat it are the same document and stay with it."""
    first = labelled(df, text, doc_id, distance, blocks, words, chunk).select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key")).distinct()
    return only(df, first, text, doc_id)
