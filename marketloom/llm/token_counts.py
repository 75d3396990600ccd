"""Token counts by a two-tier lookup inside the tasks that read the texts.

A SentencePiece BPE model writes a space as U+2581 and puts one before the text. Where no piece of the vocabulary holds that
mark after another character (checked when the model is loaded), no merge crosses from one pre-token to the next, so a text has
the sum of its pre-tokens' tokens. Pre-tokens begin at a mark that follows another character. A vocabulary in which merges
cross is counted text by text.

The first tier is a table of frequent pre-tokens and their lengths. Every task counts the pre-tokens of all its texts in bounded
memory and passes on those that make up a share of at least `SHARE` of its own, at most 1 / SHARE rows of short strings; of these, the ones
with that share of the whole are the table, whose size has the same bound. It is packed and broadcast. The second tier
encodes what the table lacks and remembers it in the worker. Pre-tokens are never shuffled, and the table changes speed only.

Null and empty texts have no tokens. Whole texts are counted, of any length; strings of special tokens inside a text are ordinary
text. Repeated rows each get a row, null ids stay null, an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import cut, map_arrow, slices, strings

MARK = "▁"

#: A pre-token is frequent from this share of all pre-tokens on; longer strings than LONGEST are left to the second tier.
SHARE, LONGEST = 1e-5, 64

#: Strings that a task counts at once (it keeps the more frequent half when there are more), and characters that a worker remembers.
COUNTED, REMEMBERED = 400_000, 8_000_000

#: Longer texts are split stretch by stretch, so that their pre-tokens are not all held at once.
STRETCH = 1_000_000

#: A pre-token ends before a space that follows another character; this space stands for its first mark and is left out.
NEXT = re.compile("(?<=[^ ]) ")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first mark; together with those marks they give the text back."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    return NEXT.split(text) if "  " in text or text[0] == " " else text.split(" ")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text cut at ends of pre-tokens into parts of at least `size` characters. An empty part is a mark alone."""
    text, start = text.replace(MARK, " "), 0
    while len(text) - start > size and (end := NEXT.search(text, start + size)):
        yield text[start : end.start()]
        start = end.end()
    yield text[start:]


class Pieces:
    """One SentencePiece model: the lengths of pre-tokens. Made once in each Python worker."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        crossing = any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size()))
        #: spaces count one by one, the text gets one in front, and nothing else is rewritten
        plain = self.model.normalize(" a  b ") == MARK.join(("", "", "a", "", "b", ""))
        self.whole = crossing or not plain
        #: a mark that stands alone, as at the end of "a "
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def lengths(self, found: Iterable[str]) -> list[int]:
        own = list(found)
        return [len(ids) if piece or self.whole else self.alone for piece, ids in zip(own, self.model.encode(own, num_threads=1), strict=True)]


class Lookup:
    """Both tiers of one worker."""

    def __init__(self, pieces: Pieces, table: dict[str, int]) -> None:
        self.pieces, self.table = pieces, table
        self.memo: dict[str, int] = {}
        self.characters = 0

    def totals(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        if self.pieces.whole:
            return self.pieces.lengths(texts)
        short = iter(self.sums([pre_tokens(t) for t in texts if len(t) <= STRETCH]))
        return [next(short) if len(t) <= STRETCH else sum(self.sums([pre_tokens(p) or [""]])[0] for p in stretches(t)) for t in texts]

    def sums(self, split: list[list[str]]) -> list[int]:
        """The tokens of each list of pre-tokens."""
        found = [list(map(self.table.get, own)) for own in split]
        rest = [[p for p, n in zip(own, got, strict=True) if n is None] if None in got else [] for own, got in zip(split, found, strict=True)]
        self.learn(set().union(*rest))
        return [sum(filter(None, got)) + sum(map(self.memo.__getitem__, own)) for got, own in zip(found, rest, strict=True)]

    def learn(self, needed: set[str]) -> None:
        new = list(needed.difference(self.memo))
        self.characters += sum(map(len, new))
        if self.characters > REMEMBERED:
            self.memo.clear()
            new, self.characters = list(needed), sum(map(len, needed))
        self.memo.update(zip(new, self.pieces.lengths(new), strict=True))


@lru_cache(maxsize=4)
def pieces_of(model: str) -> Pieces:
    return Pieces(model)


def packed(table: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The table as text, sizes in characters, and lengths: three runs of bytes."""
    return "".join(table).encode("utf-8", "surrogatepass"), np.array([len(w) for w in table], "u1").tobytes(), np.array(list(table.values()), "<u2").tobytes()


def unpacked(blob: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    words, ends = blob[0].decode("utf-8", "surrogatepass"), np.cumsum(np.frombuffer(blob[1], "u1"), dtype=np.int64).tolist()
    return {words[a:b]: n for a, b, n in zip([0, *ends], ends, np.frombuffer(blob[2], "<u2").tolist(), strict=False)}


#: The last lookup of this worker, under its broadcast's number and model.
_LOOKUP: dict[tuple[int, str], Lookup] = {}


def lookup_of(sent: Broadcast, number: int, model: str) -> Lookup:
    if (number, model) not in _LOOKUP:
        _LOOKUP.clear()
        _LOOKUP[number, model] = Lookup(pieces_of(model), unpacked(sent.value))
    return _LOOKUP[number, model]


def frequent(texts: DataFrame, model: str, share: float = SHARE) -> dict[str, int]:
    """Pre-tokens that make up at least `share` of all pre-tokens of the texts, with their lengths in tokens: at most 1 / share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        total = 0
        for part in slices(batches):
            for text in strings(part.column(0)):
                for own in map(pre_tokens, stretches(text)) if len(text) > STRETCH else (pre_tokens(text),):
                    total += len(own)
                    found.update(own)
            if len(found) > COUNTED:
                found = Counter(dict(found.most_common(COUNTED // 2)))
        kept = {w: n for w, n in found.items() if n >= share * total and len(w) <= LONGEST}
        yield pa.RecordBatch.from_arrays([pa.array(["", *kept], pa.string()), pa.array([total, *kept.values()], pa.int64()), pa.array([True] + [False] * len(kept))], names=["word", "n", "every"])

    counts = cut(map_arrow(texts, run, "word string, n long, every boolean").groupBy("every", "word").agg(F.sum("n").alias("n")))
    # one row holds the number of all pre-tokens; words under the share are left behind on the executors
    whole = F.sum(F.when(F.col("every"), F.col("n")))
    rows = counts.withColumn("whole", F.lit(counts.agg(whole).first()[0] or 0)).where(~F.col("every") & (F.col("n") >= F.col("whole") * share)).select("word").collect()
    words = sorted(r["word"] for r in rows)
    return dict(zip(words, pieces_of(model).lengths(words), strict=True))


def count_tokens(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes long and n_tokens long for every row.

    model is the path of a SentencePiece file, the same on all machines.
    """
    kept = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", n_bytes long, n_tokens long"
    table = {} if pieces_of(model).whole else frequent(kept.select("__text"), model)
    sent = df.sparkSession.sparkContext.broadcast(packed(table))
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lookup_of(sent, number, model)
        for part in slices(batches):
            texts = strings(part.column(len(keep)))
            sizes = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), sizes, pa.array(own.totals(texts), pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return map_arrow(kept, run, schema)
