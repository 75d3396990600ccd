"""Repeated substrings by merging shard Burrows-Wheeler transforms.

Every byte covered by a `length`-byte string that also starts earlier is removed; earlier means a
smaller doc_id, or an earlier start in the same document. Matches never cross documents.

1. Anchors. The k-gram with the least hash in a window of `length` bytes is the window's
   anchor (leftmost of equals), so equal windows have equal anchors at equal places. Windows with
   the same anchor place are consecutive and make one segment.
2. Candidates. A window whose anchor hash occurs once in all texts cannot repeat. Anchors are dealt out by hash,
   and only those seen twice go back to their documents. This drops text that is provably unique, nothing else.
3. Segments of repeated anchors are dealt out by hash. Byte-identical segments of an anchor collapse to
   the earliest one (the others are covered whole), so copies cost one string. An anchor with very many places is not
   left to one task: its distinct segments are cut again, by the least-hash gram of almost the window's length in each
   window, and dealt out by that gram. Equal windows still meet, and each gram leaves only a few bytes to differ.
4. Merging. The strings of a unit are cut into shards; each shard's suffixes are sorted once, which gives its
   Burrows-Wheeler transform, and the transforms are merged by iterative interleave refinement: the
   interleave starts as shard after shard and each round deals it out by the transforms' symbols, stably, which orders it by one
   more symbol of prefix. Block borders found in round k are common prefixes of length k - 1. After
   `length` rounds a block is an interval of suffixes with a common prefix of at least `length`. No suffix is sorted again.
5. In each interval the earliest start stays; the others' windows are covered. Ranges go back to their documents.

Null and empty texts have no bytes. Rows with a null doc_id come last. Rows that share doc_id and text are
one document that is given several times: each gets the same result, and they do not cover one another.
Rows that share a doc_id but not the text are ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import cut, map_arrow, slices, utf8

LENGTH, GRAM = 100, 32
#: Anchors and ranges are dealt out in packets by bucket; a task works bucket by bucket. There are so many, or one for
#: so many bytes of text, so that a bucket does not grow with the input.
LEAST_BUCKETS, BUCKET_BYTES = 2048, 64_000_000
#: Places that make an anchor hot, and hot anchors at most: beyond, the number of places rises, so that the list that tasks get
#: of them has a fixed bound.
HOT_PLACES, HOT_ANCHORS = 50_000, 2_000_000
#: Bytes by which a hot anchor's grams are shorter than the window.
HOT_SLACK = 4
#: Bytes of one shard's strings, and of the strings merged at a time.
SHARD_BYTES, UNIT_BYTES = 128_000, 1_000_000
#: Bytes of texts whose packets a task builds, and whose equal parts it collapses, at a time; records it holds before it sends.
PACK_BYTES, SEGMENT_BYTES, SEND_RECORDS = 16_000_000, 8_000_000, 1_000_000

_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

#: In place of a place: the hash was seen more than once in some task.
WITNESS = 0xFFFFFFFF
ANCHOR = np.dtype([("h", "<u8"), ("k1", "<i8"), ("k2", "<u4"), ("at", "<u4")])


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes (GRAM or more) from each place on: by doubling, then from overlapping parts."""
    if gram > GRAM:
        own, n = gram_hashes(data), len(data) - gram + 1
        h = np.full(n, gram, np.uint64)
        for at in (*range(0, gram - GRAM, GRAM), gram - GRAM):
            h *= _ODD[1]
            h += own[at : at + n]
        h ^= h >> np.uint64(31)
        h *= _ODD[2]
        h ^= h >> np.uint64(29)
        return h
    h = _RANDOM[data]
    for step, odd in zip((1, 2, 4, 8, 16), _ODD, strict=True):
        tail = h[step:]
        h = h[:-step] * odd
        h += tail
    h ^= h >> np.uint64(29)
    h *= _ODD[0]
    h ^= h >> np.uint64(32)
    return h


def segments_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor place, first window start, last window start) of each segment.

    data holds documents one after another, ends their ends; windows stay inside a document.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data, gram)
    v = h & np.uint64(0xFFFFFFFF00000000)
    v |= np.arange(len(h), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    v = np.minimum(v[: len(v) - (width - reach)], v[width - reach :])  # v[s]: least over the window from s on
    at = v.astype(np.uint32)
    inside = np.ones(len(at) + 1, bool)
    for e in ends.tolist():
        inside[max(0, e - length + 1) : e] = False  # windows that would cross the document's end
    inside[-1] = False
    change = np.ones(len(at) + 1, bool)
    np.not_equal(at[1:], at[:-1], out=change[1:-1])
    change[1:] |= ~inside[:-1]
    first = np.flatnonzero(change[:-1] & inside[:-1])
    change[:-1] |= ~inside[:-1]
    last = np.flatnonzero((change[1:] | ~inside[1:]) & inside[:-1])
    place = at[first].astype(np.int64)
    return h[place], place, first, last


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def keyed(documents: DataFrame) -> DataFrame:
    """k1, k2 name a document; a null doc_id's k1 is a hash above all ids."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("k1"), F.crc32(text).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def packets(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(bucket[rows[0]]), [c[rows] for c in columns]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The rows of each bucket, as lists of the columns' values; rows come in order of their bucket."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now:
                if held:
                    yield held
                now, held = row[0], []
            held.append(row)
    if held:
        yield held


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, packet, done): anchor records by hash; and, done, places of anchors that a task saw twice, by document.

    A hash is sent once from each chunk of documents however often it occurs there, so a passage that a third of all documents
    share doesn't fill one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def pack() -> pa.RecordBatch:
            every = np.concatenate(found)
            every = every[np.argsort(every["h"], kind="stable")]
            same = np.zeros(len(every) + 1, bool)
            same[1:-1] = every["h"][1:] == every["h"][:-1]
            here = same[:-1] | same[1:]
            # seen twice here already: the places are known, and one witness tells the other tasks
            places = np.empty(int(here.sum()), PLACE)
            for c in PLACE.names:
                places[c] = every[c][here]
            witness = every[here & ~same[:-1]].copy()
            witness["k1"], witness["at"] = 0, WITNESS
            witness["k2"] = np.diff(np.append(np.flatnonzero((here & ~same[:-1])[here]), len(places)))  # how many
            told = np.concatenate((every[~here], witness))
            own = [(b, rows, False) for b, (rows,) in packets((told["h"] % np.uint64(buckets)).astype(np.int32), told)]
            own += [(b, rows, True) for b, (rows,) in packets(document_bucket(places, buckets), places)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int32()), pa.array([blob_of(x[1]) for x in own], pa.binary()), pa.array([x[2] for x in own])], names=["bucket", "packet", "done"])

        for part in slices(batches, 64):
            texts = utf8(part.column(2))
            data, ends = joined(texts)
            h, at, _, _ = segments_of(data, ends, length)
            doc = np.searchsorted(ends, at, side="right")
            begin = ends - np.array([len(t) for t in texts])
            own = np.empty(len(h), ANCHOR)
            own["h"], own["at"] = h, at - begin[doc] if len(h) else at
            own["k1"], own["k2"] = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
            found.append(own)
            held += len(data)
            if held >= PACK_BYTES:
                yield pack()
                found, held = [], 0
        if found:
            yield pack()

    return map_arrow(docs.select("k1", "k2", "text"), run, "bucket int, packet binary, done boolean")


PLACE = np.dtype([("k1", "<i8"), ("k2", "<u4"), ("at", "<u4")])
COVER = np.dtype([("k1", "<i8"), ("k2", "<u4"), ("a", "<u4"), ("b", "<u4")])
RANGE = np.dtype([("a", "<u4"), ("b", "<u4")])


def blob_of(rows: np.ndarray) -> bytes:
    """The records' first bytes, then their second bytes, and so on, which compresses better than record by record."""
    return np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T).tobytes()


def unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def document_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (rows["k1"].astype(np.uint64) * _ODD[0] >> np.uint64(32)) ^ rows["k2"]
    return (mixed % np.uint64(buckets)).astype(np.int32)


def by_documents(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, packet): records packed by a hash of their document."""
    found = list(packets(document_bucket(rows, buckets), rows))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([blob_of(r) for _, (r,) in found], pa.binary())], names=["bucket", "packet"])


def gathered(packed: DataFrame, kind: np.dtype, values: list[str]) -> DataFrame:
    """(k1, k2, packet): one row for each document, with all its records' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            every = np.concatenate([unpacked(x[1], kind) for x in rows])
            every = every[np.lexsort((every["k2"], every["k1"]))]
            first = np.concatenate(([0], np.flatnonzero((np.diff(every["k1"]) != 0) | (np.diff(every["k2"].astype(np.int64)) != 0)) + 1))
            plain = np.ascontiguousarray(np.stack([every[v] for v in values], axis=1))
            for start in range(0, len(first), 2048):
                own = first[start : start + 2048]
                ends = np.append(first[start + 1 : start + 1 + len(own)], len(every))[: len(own)]
                blobs = [plain[a:b].tobytes() for a, b in zip(own.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(every["k1"][own], pa.int64()), pa.array(every["k2"][own].astype(np.int64), pa.int64()), pa.array(blobs, pa.binary())], names=["k1", "k2", "packet"])

    return map_arrow(dealt(packed), run, "k1 long, k2 long, packet binary")


def repeated_anchors(found: DataFrame, buckets: int, hot_places: int) -> DataFrame:
    """(bucket, packet): places of anchors whose hash is seen at two places or more, by document; under bucket -1, the
    hashes with hot_places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for rows in by_bucket(batches):
            done = [x for x in rows if x[2]]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], names=["bucket", "packet"])
            if len(done) == len(rows):
                continue
            every = np.concatenate([unpacked(x[1], ANCHOR) for x in rows if not x[2]])
            every = every[np.argsort(every["h"], kind="stable")]
            same = np.zeros(len(every) + 1, bool)
            same[1:-1] = every["h"][1:] == every["h"][:-1]
            told = every["at"] == WITNESS
            first = np.flatnonzero(~same[:-1])
            hot = every["h"][first[np.add.reduceat(np.where(told, every["k2"], 1).astype(np.int64), first) >= hot_places]]
            if len(hot):
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([hot.tobytes()], pa.binary())], names=["bucket", "packet"])
            keep = every[(same[:-1] | same[1:]) & ~told]
            places = np.empty(len(keep), PLACE)
            for c in PLACE.names:
                places[c] = keep[c]
            kept.append(places)
            held += len(places)
            if held >= SEND_RECORDS:
                yield by_documents(np.concatenate(kept), buckets)
                kept, held = [], 0
        if held:
            yield by_documents(np.concatenate(kept), buckets)

    return map_arrow(dealt(found), run, "bucket int, packet binary")


def cut_again(every: np.ndarray, strings: list[bytes], hot: np.ndarray, length: int) -> tuple[np.ndarray, list[bytes]]:
    """The segments, those of hot anchors cut by the least of the longer grams of each window."""
    live = np.isin(every["h"], hot)
    if not live.any():
        return every, strings
    at = np.flatnonzero(live)
    data, ends = joined([strings[i] for i in at])
    begin = np.concatenate(([0], ends[:-1]))
    h, place, first, last = segments_of(data, ends, length, length - HOT_SLACK)
    owner = np.searchsorted(ends, place, side="right")
    parts = every[at[owner]].copy()
    parts["h"], parts["start"], parts["size"] = h, parts["start"] + (first - begin[owner]), last - first + length
    whole, rest = data.tobytes(), np.flatnonzero(~live)
    return np.concatenate((every[rest], parts)), [strings[i] for i in rest] + [whole[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]


def candidate_segments(docs: DataFrame, repeated: DataFrame, length: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, heads, bytes, done): distinct segments of repeated anchors by hash; and, done, ranges that an equal segment
    of the same chunk covers, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies, held = [], [], 0

        def pack() -> pa.RecordBatch:
            every = np.concatenate(heads)
            # of equal segments in this chunk the earliest goes on, the others are covered whole
            order = np.lexsort((every["start"], every["k2"], every["k1"]))
            first: dict[bytes, int] = {}
            covered, before = [], None
            for i, *me in zip(order.tolist(), *(every[c][order].tolist() for c in ("k1", "k2", "start")), strict=True):
                if me == before:  # a repeated row
                    continue
                before = me
                if first.setdefault(bodies[i], i) != i:
                    covered.append(i)
            stay = np.fromiter(first.values(), np.int64, len(first))
            own_heads, own_strings = cut_again(every[stay], list(first), hot, length)
            strings = np.array([*own_strings, b""], dtype=object)[:-1]
            own = [(b, blob_of(rows), b"".join(s), False) for b, (rows, s) in packets((own_heads["h"] % np.uint64(buckets)).astype(np.int32), own_heads, strings)]
            ranges = whole_cover(every[covered])
            own += [(b, blob_of(rows), b"", True) for b, (rows,) in packets(document_bucket(ranges, buckets), ranges)]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate(kinds)], names=["bucket", "heads", "bytes", "done"])

        for part in slices(batches, 64):
            texts = utf8(part.column(2))
            data, ends = joined(texts)
            begin = ends - np.array([len(t) for t in texts])
            h, at, first, last = segments_of(data, ends, length)
            if len(h):
                doc = np.searchsorted(ends, at, side="right")
                wanted = [np.frombuffer(x, "<u4").astype(np.int64) + b for x, b in zip(part.column(3).to_pylist(), begin, strict=True)]
                live = np.isin(at, np.concatenate(wanted))
                own = np.empty(int(live.sum()), SEGMENT)
                doc, first, last = doc[live], first[live], last[live]
                own["h"], own["start"], own["size"] = h[live], first - begin[doc], last - first + length
                own["k1"], own["k2"] = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
                heads.append(own)
                whole = data.tobytes()
                bodies += [whole[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
            held += len(data)
            if held >= SEGMENT_BYTES and heads:
                yield pack()
                heads, bodies, held = [], [], 0
        if heads:
            yield pack()

    with_places = docs.join(gathered(repeated, PLACE, ["at"]), ["k1", "k2"]).select("k1", "k2", "text", "packet", "doc_id")  # doc_id: the same columns as in the last join, so that one exchange serves both
    return map_arrow(with_places, run, "bucket int, heads binary, bytes binary, done boolean")


SEGMENT = np.dtype([("h", "<u8"), ("k1", "<i8"), ("k2", "<u4"), ("start", "<u4"), ("size", "<u4")])


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler symbols) of strings that each end in their own terminator.

    Symbols are byte + 1, a terminator is 0; terminators sort first, by string.
    """
    m = len(strings)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + m
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    symbols = (text - m + 1).astype(np.uint16)
    symbols[ends] = 0
    rank = text
    rank[ends] = np.arange(m)
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(len(key), np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = fresh
        if rank[order[-1]] == len(rank) - 1:
            break
        step *= 2
    before = order - 1  # before a string's start stands its terminator
    begins = np.concatenate(([0], ends[:-1] + 1))
    starts = np.zeros(len(symbols), bool)
    starts[begins] = True
    return order, np.where(starts[order], np.uint16(0), symbols[before])


def merged_blocks(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shards' concatenated transforms, block) in merged order after `rounds` rounds, of the
    suffixes that share their block with another.

    Suffixes of one block have a common prefix of `rounds`
    symbols. A terminator equals no other symbol, so a suffix shorter than that is alone. A suffix that is alone in its block
    is left out of later rounds: what stands before it is alone too.
    """
    whole = np.concatenate(transforms)
    # where each suffix's predecessor stands in its own shard: the last-to-first mapping
    back, begin = np.empty(len(whole), np.int32), 0
    for bwt in transforms:
        back[begin + np.argsort(bwt, kind="stable")] = np.arange(begin, begin + len(bwt), dtype=np.int32)
        begin += len(bwt)
    used, symbol_of = np.unique(whole, return_inverse=True)
    whole = symbol_of.astype(np.uint8 if len(used) <= 256 else np.uint16)
    place = np.arange(len(whole), dtype=np.int32)
    block = np.zeros(len(whole), np.int32)
    for _ in range(rounds):
        if not len(place):
            break
        symbol = whole[place]
        order = np.argsort(symbol, kind="stable")
        symbol, old = symbol[order], block[order]
        place = back[place[order]]
        border = np.ones(len(place) + 1, bool)
        np.not_equal(old[1:], old[:-1], out=border[1:-1])
        border[1:-1] |= symbol[1:] != symbol[:-1]
        border[:-1] |= symbol == 0  # what begins with a terminator is alone
        border[1:] |= symbol == 0
        shared = ~(border[:-1] & border[1:])
        block = np.cumsum(border[:-1], dtype=np.int32)[shared]
        place = place[shared]
    return place, block


def repeats(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, string, offset) of every suffix that shares its first `length` bytes with another."""
    shards, held = [[]], 0
    for i, s in enumerate(strings):
        if held and held + len(s) > shard_bytes:
            shards.append([])
            held = 0
        shards[-1].append(i)
        held += len(s)
    transforms, owners, offsets = [], [], []
    for own in shards:
        order, bwt = transform([strings[i] for i in own])
        sizes = np.array([len(strings[i]) + 1 for i in own])
        begins = np.cumsum(sizes) - sizes
        transforms.append(bwt)
        owners.append(np.repeat(np.array(own), sizes)[order])
        offset = np.arange(sizes.sum()) - np.repeat(begins, sizes)
        offsets.append(offset[order])
    place, block = merged_blocks(transforms, length)
    return block, np.concatenate(owners)[place], np.concatenate(offsets)[place]


def covered_ranges(segments: DataFrame, length: int, shard_bytes: int, unit_bytes: int, buckets: int) -> DataFrame:
    """(bucket, packet): covered ranges, by document."""

    def unit(heads: np.ndarray, strings: list[bytes]) -> np.ndarray:
        block, owner, offset = repeats(strings, length, shard_bytes)
        own = heads[owner]
        start = own["start"].astype(np.int64) + offset
        order = np.lexsort((start, own["k2"], own["k1"], block))
        later = np.concatenate(([False], np.diff(block[order]) == 0)) if len(order) else np.zeros(0, bool)
        hit = order[later]
        out = np.empty(len(hit), COVER)
        out["k1"], out["k2"], out["a"], out["b"] = own["k1"][hit], own["k2"][hit], start[hit], start[hit] + length
        return merged_ranges(out)

    def distinct(heads: np.ndarray, strings: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """For each anchor: the earliest of each of its strings, where there are two or more; and copies that are covered whole."""
        order = np.lexsort((heads["start"], heads["k2"], heads["k1"], heads["h"]))
        first: dict[bytes, int] = {}
        copies: list[int] = []
        anchor = before = None
        identity = (order.tolist(), *(heads[c][order].tolist() for c in ("h", "k1", "k2", "start")))
        for i, h, *me in zip(*identity, strict=True):
            if h != anchor:
                yield (list(first.values()) if len(first) > 1 else []), copies
                first, copies, anchor = {}, [], h
            if strings[i] not in first:
                first[strings[i]] = i
            elif me != before:  # not a repeated row
                copies.append(i)
            before = me
        yield (list(first.values()) if len(first) > 1 else []), copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers: list[np.ndarray] = []
        own_heads: list[np.ndarray] = []
        own_strings: list[bytes] = []
        held = 0

        def merge() -> None:
            nonlocal held
            if own_strings:
                covers.append(unit(np.concatenate(own_heads), own_strings))
            own_heads.clear()
            own_strings.clear()
            held = 0

        for rows in by_bucket(batches):
            done = [x for x in rows if x[3]]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], names=["bucket", "packet"])
            if len(done) == len(rows):
                continue
            heads = np.concatenate([unpacked(x[1], SEGMENT) for x in rows if not x[3]])
            body = b"".join(x[2] for x in rows if not x[3])
            cuts = np.concatenate(([0], np.cumsum(heads["size"].astype(np.int64)))).tolist()
            strings = [body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            del body, rows
            for kept, copies in distinct(heads, strings):
                if kept:
                    own_heads.append(heads[kept])
                    own_strings += [strings[i] for i in kept]
                    held += sum(len(strings[i]) for i in kept)
                if copies:
                    covers.append(whole_cover(heads[copies]))
                if held >= unit_bytes:
                    merge()
            if sum(map(len, covers)) >= SEND_RECORDS:
                yield by_documents(merged_ranges(np.concatenate(covers)), buckets)
                covers = []
        merge()
        if covers:
            yield by_documents(merged_ranges(np.concatenate(covers)), buckets)

    return map_arrow(dealt(segments), run, "bucket int, packet binary")


def merged_ranges(ranges: np.ndarray) -> np.ndarray:
    """Ranges of each document joined where they overlap or touch."""
    if not len(ranges):
        return ranges
    r = ranges[np.lexsort((ranges["a"], ranges["k2"], ranges["k1"]))]
    fresh = np.concatenate(([True], (np.diff(r["k1"]) != 0) | (np.diff(r["k2"].astype(np.int64)) != 0)))
    group = np.cumsum(fresh)
    # running end within a document: shift documents apart so that one running maximum serves all
    reach = np.maximum.accumulate(group * (1 << 33) + r["b"].astype(np.int64)) - group * (1 << 33)
    start = fresh.copy()
    start[1:] |= r["a"][1:].astype(np.int64) > reach[:-1]
    first = np.flatnonzero(start)
    out = r[first].copy()
    out["b"] = reach[np.append(first[1:], len(r)) - 1]
    return out


def whole_cover(segments: np.ndarray) -> np.ndarray:
    """The ranges of whole segments."""
    out = np.empty(len(segments), COVER)
    out["k1"], out["k2"], out["a"], out["b"] = segments["k1"], segments["k2"], segments["start"], segments["start"].astype(np.int64) + segments["size"]
    return merged_ranges(out)


def removal(text: bytes, packet: bytes | None) -> tuple[int, int, bytes]:
    """(bytes removed, spans, what stays)."""
    found = np.frombuffer(packet or b"", RANGE)
    every = np.zeros(len(found), COVER)
    every["a"], every["b"] = found["a"], found["b"]
    kept, place, removed = [], 0, 0
    spans = merged_ranges(every)
    for a, b in zip(spans["a"].tolist(), spans["b"].tolist(), strict=True):
        kept.append(text[place:a])
        removed += b - a
        place = b
    return removed, len(spans), b"".join([*kept, text[place:]])


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, unit_bytes: int = UNIT_BYTES, with_text: bool = True, least_buckets: int = LEAST_BUCKETS, hot_places: int = HOT_PLACES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary: removal may cut a character)
    unless with_text is False. length is at least 64."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    docs = keyed(documents)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(least_buckets, -(-total // BUCKET_BYTES))
    # there are fewer places than bytes, so no more than HOT_ANCHORS hashes can be hot
    hot_places = max(hot_places, -(-total // HOT_ANCHORS))
    repeated = cut(repeated_anchors(anchors(docs, length, buckets), buckets, hot_places))
    hot = np.array(sorted(h for r in repeated.where("bucket < 0").select("packet").collect() for h in np.frombuffer(r[0], np.uint64).tolist()), np.uint64)
    segments = candidate_segments(docs, repeated.where("bucket >= 0"), length, buckets, hot)
    ranges = gathered(covered_ranges(segments, length, shard_bytes, unit_bytes, buckets), COVER, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = utf8(part.column(1))
            done = [removal(t, p) for t, p in zip(texts, part.column(2).to_pylist(), strict=True)]
            out = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out.append(pa.array([d[2] for d in done], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*names, *(["kept"] * with_text)])

    joined_back = docs.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "packet")
    return map_arrow(joined_back, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
