"""Ranked lexical search: best-first over document intervals, bounded by range maxima of posting lists.

One pass over the texts writes, for each document, its length and its places in the posting lists of the items' terms; corpus
counts come from that table. Then every task turns the documents it reads into blocks of posting lists ordered by document, each entry
with its impact (what the term adds to the document's score), and a sparse table of range maxima over each list.

An interval of documents is bounded by the sum of its lists' maxima. The intervals of highest bound are taken first; each is split at the document
that holds its largest maximum, which is scored from the lists, and the two remaining intervals get new bounds. An item is
done when no interval is bounded above its k-th score; that score is carried from block to block. A block gives at most k documents
for an item, so only those travel; postings are never shuffled. Documents whose lists agree in every entry have equal scores, and share one place in
a block with their k smallest ids.

A term is a run of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Null and empty texts have none and are neither counted nor found. Repeated
rows are documents of their own. Equal scores go by ascending doc_id, a null one last. Rows of items that repeat item_id and text are one
item; a null item_id is read as ''. An item without terms, or whose terms no document holds, gives no row, as do empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import NULL_ID, cut, map_arrow, slices, utf8
from marketloom.llm.decontam import item_blocks, words_of

#: Documents returned for an item, and bytes of items that are searched in one pass.
BEST, ITEM_BYTES = 10, 16_000_000

#: Entries of a block's posting lists: with the sparse tables about 100 bytes each.
BLOCK_ENTRIES = 1_000_000

#: Intervals of one item that are split together.
WAVE = 64


def posting_rows(documents: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text with repeats), terms (ascending numbers) and tfs, for every text that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, sizes, found, tfs = [], [], [], []
            for i, text in enumerate(utf8(part.column(1))):
                words = words_of(text)
                if not words:
                    continue
                held = sorted(Counter(k for k in map(terms.get, words) if k is not None).items())
                rows.append(i)
                sizes.append(len(words))
                found.append([k for k, _ in held])
                tfs.append([n for _, n in held])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, ints), pa.array(tfs, ints)], names=["doc_id", "n", "terms", "tfs"])

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(n_docs: int, dfs: dict[int, int], n_terms: int) -> np.ndarray:
    """A term's weight by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs.get(t, 0) + 1))) for t in range(n_terms)], np.int64)


class Block:
    """Posting lists of some documents with their sparse tables."""

    def __init__(self, ids: list[list[int]], sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, places: np.ndarray, w: np.ndarray, n_docs: int, n_words: int) -> None:
        order = np.lexsort((places, terms))
        self.ids, self.n = ids, len(ids)
        self.doc, term, tf = places[order], terms[order], tfs[order].astype(np.int64)
        m = 25 + (75 * sizes * n_docs) // n_words
        self.impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.key = term.astype(np.int64) * self.n + self.doc
        bounds = np.searchsorted(term, np.arange(len(w) + 1))
        self.start, self.end = bounds[:-1], bounds[1:]
        longest = int((self.end - self.start).max(initial=0))
        #: row k, place p: where the (leftmost) largest impact of the 2^k entries from p on stands
        self.tables = [np.arange(len(term), dtype=np.int32)]
        while 2 << (len(self.tables) - 1) <= longest:
            last, step = self.tables[-1], 1 << (len(self.tables) - 1)
            right = np.append(last[step:], last[-step:])
            self.tables.append(np.where(self.impact[last] >= self.impact[right], last, right))
        self.table = np.stack(self.tables)

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest impact of the entries a to b of each list, and its place; 0 where there are none."""
        size = b - a
        some = size > 0
        level = np.frexp(np.where(some, size, 1))[1] - 1
        left = self.table[level, np.where(some, a, 0)]
        right = self.table[level, np.where(some, b - (1 << level), 0)]
        place = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(some, self.impact[place], 0), place

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, place) of every document that can be among the k best with a score of at least `least`, and of some others."""
        held = self.end[terms] > self.start[terms]
        terms, times = terms[held], times[held]
        if not len(terms):
            return []
        found: list[tuple[int, int]] = []
        best = np.empty(0, np.int64)
        a, b = self.start[terms][None, :], self.end[terms][None, :]
        value, place = self.maxima(a, b)
        value = value * times
        bound, at = value.sum(1), self.doc[place[np.arange(1), value.argmax(1)]]
        base = terms.astype(np.int64) * self.n
        while True:
            open_ = np.flatnonzero(bound >= max(1, least))
            if not len(open_):
                return found
            if len(open_) > WAVE:
                take = np.argpartition(bound[open_], len(open_) - WAVE)[-WAVE:]
                now, later = open_[take], np.delete(open_, take)
            else:
                now, later = open_, open_[:0]
            # the split document's place in every list
            d = at[now]
            cut_at = np.searchsorted(self.key, base + d[:, None])
            inside = (cut_at < b[now]) & (self.doc[np.minimum(cut_at, len(self.doc) - 1)] == d[:, None])
            score = np.where(inside, self.impact[np.minimum(cut_at, len(self.doc) - 1)] * times, 0).sum(1)
            found += zip(score.tolist(), d.tolist(), strict=True)
            copies = np.repeat(score, [min(k, len(self.ids[x])) for x in d.tolist()])
            best = np.sort(np.concatenate([best, copies]))[-k:]
            if len(best) == k:
                least = max(least, int(best[0]))
            # what is left on either side
            next_a = np.concatenate([a[now], cut_at + inside])
            next_b = np.concatenate([cut_at, b[now]])
            value, place = self.maxima(next_a, next_b)
            value = value * times
            next_at = self.doc[place[np.arange(len(value)), value.argmax(1)]]
            a, b = np.concatenate([a[later], next_a]), np.concatenate([b[later], next_b])
            bound, at = np.concatenate([bound[later], value.sum(1)]), np.concatenate([at[later], next_at])


def block_of(rows: list[pa.RecordBatch], w: np.ndarray, n_docs: int, n_words: int, k: int) -> Block:
    """The documents in the order of their length, those with equal lists at one place."""
    places: dict[tuple[int, bytes, bytes], list[int]] = {}
    for part in rows:
        ids = part.column(0).fill_null(NULL_ID).to_pylist()
        cuts = part.column(2).offsets.to_numpy()
        terms, tfs = part.column(2).values.to_numpy().astype("<i4"), part.column(3).values.to_numpy().astype("<i4")
        for i, (one, n) in enumerate(zip(ids, part.column(1).to_pylist(), strict=True)):
            s = slice(cuts[i], cuts[i + 1])
            places.setdefault((n, terms[s].tobytes(), tfs[s].tobytes()), []).append(one)
    ordered = sorted(((key, sorted(ids)[:k]) for key, ids in places.items()), key=lambda x: (x[0][0], x[1][0]))
    terms, tfs = (np.frombuffer(b"".join(key[j] for key, _ in ordered), "<i4") for j in (1, 2))
    place = np.repeat(np.arange(len(ordered), dtype=np.int32), [len(key[1]) // 4 for key, _ in ordered])
    return Block([ids for _, ids in ordered], np.array([key[0] for key, _ in ordered], np.int64), terms, tfs, place, w, n_docs, n_words)


def searched(rows: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, n_docs: int, n_words: int, k: int, block_entries: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]  # (-score, doc_id), best first

        def search(held: list[pa.RecordBatch]) -> None:
            block = block_of(held, w, n_docs, n_words, k)
            for i, (terms, times) in enumerate(items):
                found = block.search(terms, times, k, -best[i][-1][0] if len(best[i]) == k else 1)
                if found:
                    best[i] = sorted(best[i] + [(-score, one) for score, place in found if score for one in block.ids[place]])[:k]

        held, entries = [], 0
        for part in slices(batches):
            size = len(part.column(2).flatten())
            if held and entries + size > block_entries:
                search(held)
                held, entries = [], 0
            if size:
                rows_with = part.filter(pa.array(np.diff(part.column(2).offsets.to_numpy()) > 0))
                held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows_with.columns], names=part.schema.names))
                entries += size
        if held:
            search(held)
        flat = [(i, one, -score) for i, own in enumerate(best) for score, one in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return map_arrow(rows, run, "item int, doc_id long, score long")


def ranked(documents: DataFrame, items: DataFrame, k: int = BEST, item_bytes: int = ITEM_BYTES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of every item.

    Items are taken in blocks of item_bytes (columns item_id and text), each against all documents.
    """
    spark, parts = documents.sparkSession, []
    for block in item_blocks(items, item_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, words in block for t in words}))}
        rows = cut(posting_rows(documents, vocabulary))
        n_docs, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # bounded by the terms of a block
        dfs = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        counted = [Counter(vocabulary[t] for t in words) for _, words in block]
        asked = [(np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for c in counted]
        found = searched(rows, asked, weights(n_docs, dfs, len(vocabulary)), n_docs, n_words, k, block_entries)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], "item int, item_id string")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # bounded by the items of a block
        parts.append(first.join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score"))
    return reduce(DataFrame.union, parts)
