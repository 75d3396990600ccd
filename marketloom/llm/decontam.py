"""Benchmark decontamination by a distributed positional inverted index.

`postings` is the index: a row (term, k1, k2, pos) for each place of a term in the training texts.
`contamination` looks benchmark items up in it. For each window of consecutive item words it
takes the rarest terms by count over all documents; a posting of such a term at pos, with the term at
place q of an item, votes for the alignment (document, item, pos - q). Alignments on which the lists
of a window's rarest terms intersect are read through, word by word, against the document, which
gives the exact phrase matches. `proximity` intersects lists within a distance instead.

Items are taken in blocks of bounded size, each against all documents; only a block's terms and their
counts come to the driver. Alignments follow true overlaps, so a passage that a third of the
documents share is spread over those documents' keys.

A word is a run of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Null and
empty texts have no words. An item of fewer words than a window is one window; one without words has
none. Repeated rows each get a row. Items that share an item_id count once. A null item_id is read as ''.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded, keyed_texts, map_arrow, only, slices, utf8

WINDOW, RAREST, BLOCK_BYTES = 10, 2, 16_000_000

#: Bytes of words as they are, A-Z lower-cased, all others as spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def term_counts(docs: DataFrame, terms: frozenset[bytes]) -> dict[bytes, int]:
    """How often each of the terms occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for part in slices(batches):
            total.update(chain.from_iterable(filter(terms.__contains__, words_of(t)) for t in utf8(part.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    found = map_arrow(docs.select("text"), run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["term"]): r["n"] for r in found}


def postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(term int, k1, k2, pos int): every place of the given terms (word to number) in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, term, pos = [], [], []
            for i, text in enumerate(utf8(part.column(2))):
                words = words_of(text)
                if terms.keys().isdisjoint(words):
                    continue
                for p, w in enumerate(words):
                    if w in terms:
                        rows.append(i)
                        term.append(terms[w])
                        pos.append(p)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(pos, pa.int32())], names=["term", "k1", "k2", "pos"])

    return map_arrow(docs.select("k1", "k2", "text"), run, "term int, k1 long, k2 long, pos int")


def proximity(index: DataFrame, first: int, second: int, distance: int) -> DataFrame:
    """(k1, k2, pos, other): places of the term `first` with the term `second` at most `distance` words off."""
    a = index.where(F.col("term") == first).select("k1", "k2", "pos", F.explode(F.array(*[(F.col("pos") / distance).cast("int") + d for d in (-1, 0, 1)])).alias("cell"))
    b = index.where(F.col("term") == second).select("k1", "k2", F.col("pos").alias("other"), (F.col("pos") / distance).cast("int").alias("cell"))
    return a.join(b, ["k1", "k2", "cell"]).where((F.abs(F.col("pos") - F.col("other")) <= distance) & (F.col("pos") != F.col("other"))).select("k1", "k2", "pos", "other")


def rare_places(items: list[list[bytes]], counts: dict[bytes, int], window: int, rarest: int) -> list[tuple[int, int]]:
    """(item, place) of the rarest words of every window."""
    found = set()
    for i, words in enumerate(items):
        n = min(window, len(words))
        order = [(counts.get(w, 0), p) for p, w in enumerate(words)]
        for start in range(len(words) - n + 1):
            found.update((i, p) for _, p in sorted(order[start : start + n])[:rarest])
    return sorted(found)


def hit_runs(words: list[bytes], items: list[list[bytes]], aligned: list[tuple[int, int]], window: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Document ranges that windows cover, and the items of those windows, from (item, shift) pairs."""
    runs, hit = [], set()
    for item, shift in aligned:
        own = items[item]
        need, lo, hi = min(window, len(own)), max(0, -shift), min(len(own), len(words) - shift)
        start = lo
        for q in range(lo, hi + 1):
            if q == hi or own[q] != words[q + shift]:
                if q - start >= need:
                    runs.append((start + shift, q + shift))
                    hit.add(item)
                start = q + 1
    merged: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, hit


def block_hits(docs: DataFrame, named: list[tuple[str, list[bytes]]], window: int, rarest: int) -> DataFrame:
    """doc_id, k1, k2, n_words, starts, ends, items for every document against one block of items."""
    spark = docs.sparkSession
    ids, items = [n for n, _ in named], [w for _, w in named]
    counts = term_counts(docs, frozenset(w for words in items for w in words))
    # a word that no document has rules its windows out
    places = [(i, p) for i, p in rare_places(items, counts, window, rarest) if counts.get(items[i][p], 0)]
    terms = {w: k for k, w in enumerate(sorted({items[i][p] for i, p in places}))}
    # bounded by the words of a block
    lookup = spark.createDataFrame([(terms[items[i][p]], i, p, min(rarest, len(items[i]))) for i, p in places], "term int, item int, place int, need int")
    aligned = (
        postings(docs, terms)
        .join(F.broadcast(lookup), "term")
        .groupBy("k1", "k2", "item", (F.col("pos") - F.col("place")).alias("shift"))
        .agg(F.count_distinct("pos").alias("n"), F.first("need").alias("need"))
        .where("n >= need")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("item", "shift")).alias("aligned"))
    )
    # alignments are few beside texts: counted, and sent to the texts where they are; otherwise both are shuffled
    aligned = bounded(aligned, F.size("aligned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_words, starts, ends, hits = [], [], [], []
            for text, aligned in zip(utf8(part.column(3)), part.column(4).to_pylist(), strict=True):
                words = words_of(text)
                runs, hit = hit_runs(words, items, [(x["item"], x["shift"]) for x in aligned or ()], window)
                n_words.append(len(words))
                starts.append([a for a, _ in runs])
                ends.append([b for _, b in runs])
                hits.append(sorted({ids[i] for i in hit}))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(3)), pa.array(n_words, pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array(hits, pa.list_(pa.string()))],
                names=["doc_id", "k1", "k2", "n_words", "starts", "ends", "items"],
            )

    joined = docs.join(aligned, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "aligned")
    return map_arrow(joined, run, "doc_id long, k1 long, k2 long, n_words long, starts array<int>, ends array<int>, items array<string>")


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about block_bytes: (item_id, words)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = [(r["item_id"], words_of(r["text"].encode("utf-8"))) for r in own.distinct().collect()]
        yield [x for x in sorted(found) if x[1]]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST, block_bytes: int = BLOCK_BYTES, keys: bool = False) -> DataFrame:
    """doc_id, n_words, starts, ends (word ranges that windows cover, apart and in order), items; with `keys` also k1 and
    k2, which name a document by id and text."""
    gone = () if keys else ("k1", "k2")
    docs = keyed_texts(documents)
    parts = [block_hits(docs, block, window, rarest) for block in item_blocks(benchmark, block_bytes)]
    if len(parts) == 1:
        return parts[0].drop(*gone)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  one row for each block
    grouped = every.groupBy("doc_id", "k1", "k2").agg(F.first("n_words").alias("n_words"), flat("starts"), flat("ends"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows"))
    merged = grouped.withColumn(
        "runs",
        F.aggregate(
            F.array_sort(F.arrays_zip("starts", "ends")),
            F.expr("cast(array() as array<struct<starts:int,ends:int>>)"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (x["starts"] <= F.try_element_at(acc, F.lit(-1))["ends"]),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["starts"].alias("starts"), F.greatest(F.try_element_at(acc, F.lit(-1))["ends"], x["ends"]).alias("ends")))),
            ).otherwise(F.concat(acc, F.array(x))),
        ),
    )
    return merged.select("doc_id", "k1", "k2", "n_words", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"), "items", F.explode(F.sequence(F.lit(1), (F.col("rows") / len(parts)).cast("int"))).alias("copy")).drop("copy", *gone)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, judged by doc_id and text together. An empty table of items keeps all."""
    hit = contamination(documents, benchmark, window, keys=True).where(F.size("starts") > 0).select(F.col("doc_id").alias("__id"), F.col("k2").alias("__key")).distinct()
    return only(documents, bounded(hit), how="left_anti")
