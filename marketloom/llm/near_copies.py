"""Near copies by Jaccard similarity: MinHash bands find candidates, the shingle sets decide.

A text is the set of its shingles of lower-cased words (a text of fewer words is one shingle). Two texts
link when the Jaccard similarity of their sets is `least` or more. Candidates meet on bands of MinHash
values: with 36 bands of 7 values a pair at similarity 0.8 meets with probability 0.9998, at 0.85 with
0.999998; SimHash fingerprints of 64 bits tell such pairs apart by 5 to 13 bits, which no choice of blocks finds.

Equal sets are one node. Only the bands leave the first pass over the texts; a second pass makes the sets again, of those
documents only that share a band with another. A band's members come to one task with their sets, and are searched breadth
first as in simhash.forest, comparing sets, so every link is a pair that was verified and the links
connect all verified pairs of the band. Bands with equal members are searched once; bands with over
`chunk_bytes` of sets are dealt out as pairs of chunks. Sets are compared by the low 32 bits of the
shingles' XXH64 (seed 42).

With `bits`, texts whose SimHash fingerprints (simhash.py: 4-word shingles with repeats) differ in so many bits or fewer
link as well, found by that operator's blocks, and components are taken over the links of both kinds.

Null and empty texts, and texts of blanks, are one set. Repeated rows each keep a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import simhash
from marketloom.llm.common import bounded, cut, keyed_texts, map_arrow, only, slices, utf8
from marketloom.llm.graph import components

WORDS, LEAST, BANDS, VALUES, CHUNK_BYTES = 5, 0.8, 36, 7, 16_000_000

_RANDOM = np.random.default_rng(20240601)
FACTORS = _RANDOM.integers(0, 1 << 31, (BANDS * VALUES, 1), np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _RANDOM.integers(0, 1 << 32, (BANDS * VALUES, 1), np.uint32)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    import xxhash

    found = text.lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    shingles = {b" ".join(found)} if len(found) <= words else set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles], "<u8"))


def node_of(hashes: np.ndarray) -> bytes:
    """A name of the set in 128 bits, so that no two of some 10^12 sets are likely to share one."""
    import xxhash

    return xxhash.xxh128_digest(hashes.tobytes(), 7)


def bands_of(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    import xxhash

    low, least = hashes.astype(np.uint32), np.full(BANDS * VALUES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 1024):
        np.minimum(least, (FACTORS * low[start : start + 1024] + OFFSETS).min(axis=1), out=least)
    raw = least.astype("<u4").tobytes()
    keys = [xxhash.xxh64_intdigest(raw[4 * VALUES * i : 4 * VALUES * (i + 1)], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, words: int = WORDS, fingerprints: bool = False) -> DataFrame:
    """k1, k2, doc_id, node (equal for equal sets), size (shingles), bands and, if asked for, fp (SimHash, signed) of keyed texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = utf8(part.column(3))
            sets = [shingle_set(t, words) for t in texts]
            nodes = [node_of(s) for s in sets]
            fps = [simhash.signed(simhash.fingerprint(t)) for t in texts] if fingerprints else [None] * len(texts)
            columns = [pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands_of(s) for s in sets], pa.list_(pa.int64())), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), *columns], names=["k1", "k2", "doc_id", "node", "size", "bands", "fp"])

    return map_arrow(docs, run, "k1 long, k2 long, doc_id long, node binary, size long, bands array<long>, fp long")


def shingle_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """node and the set, as sorted 32-bit numbers, of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingle_set(t, words).astype("<u4")).tobytes() for t in utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return map_arrow(texts, run, "node binary, shingles binary")


def forest(nodes: list[bytes], sides: list[int], sets: list[np.ndarray], same: bool, least: float) -> list[tuple[bytes, bytes]]:
    """Verified links that connect all pairs of similarity `least` or more; unless `same`, only pairs across the sides count."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, side = sizes[order], np.array(sides)[order]
    sets, nodes = [sets[i] for i in order], [nodes[i] for i in order]
    todo = np.ones(len(nodes), bool)
    links: list[tuple[bytes, bytes]] = []
    for start in range(len(nodes)):
        if not todo[start]:
            continue
        todo[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            n = int(sizes[x])
            # sizes are in order, and sets whose sizes differ more cannot be so similar
            lo, hi = np.searchsorted(sizes, np.floor(n * least)), np.searchsorted(sizes, np.ceil(n / least), "right")
            near = lo + np.flatnonzero(todo[lo:hi] if same else todo[lo:hi] & (side[lo:hi] != side[x]))
            for at in range(0, len(near), 512):
                some = near[at : at + 512]
                ends = np.cumsum(sizes[some])
                every = np.concatenate([sets[i] for i in some])
                place = np.minimum(np.searchsorted(sets[x], every), n - 1)
                both = np.add.reduceat((sets[x][place] == every).astype(np.int64), np.concatenate(([0], ends[:-1])))
                for y in some[both >= least * (n + sizes[some] - both) - 1e-9].tolist():
                    todo[y] = False
                    links.append((nodes[x], nodes[y]))
                    queue.append(y)
    return links


def near_links(docs: DataFrame, classes: DataFrame, words: int = WORDS, least: float = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(a, b): links between distinct nodes, each of similarity `least` or more. docs has k1, k2 and text, classes node, size,
    bands and the keys (first) of one document of the node."""
    banded = classes.select("node", "size", F.explode("bands").alias("key"))
    # counted with a map-side aggregate, so that a band of very many nodes fills no task; a band that one node has goes no further
    digest = lambda seed: F.sum(F.shiftright(F.xxhash64("node", F.lit(seed)), 20))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), digest(1).alias("m1"), digest(2).alias("m2")).where("n > 1")
    # bands with the same members find the same links
    once = shared.groupBy("n", "total", "m1", "m2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("total") * 4 / chunk_bytes).cast("int").alias("chunks"))
    units = cut(banded.join(bounded(once), "key").select("key", "node", "chunks", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("own")))
    asked = units.select("node").distinct().join(classes.select("node", "first.k1", "first.k2"), "node")
    texts = docs.select("k1", "k2", "text").join(bounded(asked), ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])
    dealt = units.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node")
    dealt = dealt.join(shingle_sets(texts, words), "node").select("key", "lo", "hi", "side", "node", "shingles").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def solve() -> pa.RecordBatch:
            found = forest([x[0] for x in held], [x[1] for x in held], [np.frombuffer(x[2], "<u4") for x in held], unit[1] == unit[2], least) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], names=["a", "b"])

        for part in slices(batches):
            for key, lo, hi, side, node, shingles in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (key, lo, hi) != unit:
                    if held:
                        yield solve()
                    unit, held = (key, lo, hi), []
                held.append((node, side, shingles))
        if held:
            yield solve()

    return map_arrow(dealt, run, "a binary, b binary").distinct()


def fingerprint_links(sketched: DataFrame, bits: int) -> DataFrame:
    """(a, b): links between nodes, enough to connect all whose fingerprints differ in `bits` bits or fewer. A fingerprint's
    nodes hang on the least of them, and these are linked as simhash links the fingerprints."""
    own = cut(sketched.select("fp", "node").distinct())
    least = cut(own.groupBy("fp").agg(F.min("node").alias("least")))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}"))
    near = simhash.near_links(least, bits).join(end("a"), "a").join(end("b"), "b").select("node_a", "node_b")
    return own.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).union(near)


def labelled(df: DataFrame, words: int, least: float, chunk_bytes: int, bits: int | None = None) -> DataFrame:
    """doc_id, k1, k2, node, first: the keys and doc_id of the component's first document."""
    docs = keyed_texts(df)
    sketched = cut(sketches(docs, words, bits is not None))
    classes = cut(sketched.groupBy("node").agg(F.min(F.struct("k1", "k2", "doc_id")).alias("first"), F.min("size").alias("size"), F.min("bands").alias("bands")))
    links = near_links(docs, classes, words, least, chunk_bytes)
    found = components(links if bits is None else links.union(fingerprint_links(sketched, bits)))
    firsts = classes.select("node", "first")
    named = found.join(firsts, "node").groupBy("component").agg(F.min("first").alias("least"))
    linked = found.join(named, "component").select("node", "least")
    reps = firsts.join(linked, "node", "left").select("node", F.coalesce("least", "first").alias("first"))
    return sketched.select("doc_id", "k1", "k2", "node").join(reps, "node").select("doc_id", "k1", "k2", "node", "first")


def near_duplicates(df: DataFrame, words: int = WORDS, least: float = LEAST, chunk_bytes: int = CHUNK_BYTES, bits: int | None = None) -> DataFrame:
    """doc_id, node, component_id: the smallest doc_id reachable over links, itself included. df has doc_id and text."""
    return labelled(df, words, least, chunk_bytes, bits).select("doc_id", "node", F.col("first.doc_id").alias("component_id"))


def keep_one(df: DataFrame, words: int = WORDS, least: float = LEAST, chunk_bytes: int = CHUNK_BYTES, bits: int | None = None) -> DataFrame:
    """The rows of df whose document, by doc_id and text together, is the first of its component: least doc_id, null
    last, then least hash of the text. Rows that repeat it are the same document and stay with it."""
    first = labelled(df, words, least, chunk_bytes, bits).select(F.col("first.doc_id").alias("__id"), F.col("first.k2").alias("__key")).distinct()
    return only(df, first)
