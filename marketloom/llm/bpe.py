"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

`encode` splits every text with the vocabulary's pattern, encodes each piece through the tokenizers
library's BPE model (a bounded memo keeps pieces that return), and gives ids
and, if asked, the character span of each token. `decode` reverses the byte table: token strings are
written in stand-in characters, one for each byte, and a character whose bytes are split over several
tokens comes back whole because bytes are joined before UTF-8 is read.

Null and empty texts give no ids and decode to no bytes. Repeated rows are encoded independently.
Rows keep their own columns' order; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import map_arrow, slices, strings

#: Pieces that a task remembers; the memo is emptied when it is full, which only costs time.
MEMO_PIECES = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 bytes stand for
    themselves, the others are numbered upwards from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class Codec:
    """One vocabulary: text to ids and back. Made once in each Python worker."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        self.model = tokenizer.model
        self.split = regex.compile(pattern).findall
        characters = byte_characters()
        self.stand_ins = dict(enumerate(characters))
        of_char = {c: b for b, c in enumerate(characters)}
        words = tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (1 + max(words.values()))
        for word, i in words.items():
            if all(c in of_char for c in word):
                self.bytes_of[i] = bytes(of_char[c] for c in word)
        self.memo: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        word = piece.encode("utf-8").decode("latin-1").translate(self.stand_ins)
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        memo, pieces = self.memo, self.split(text)
        new = set(pieces).difference(memo)
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = set(pieces)
        for p in new:
            memo[p] = self.piece(p)
        return b"".join(map(memo.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), "<u4")

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """The character span of each token; tokens that share a character share its span."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_of = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_offsets: bool = False) -> DataFrame:
    """`keep`, ids array<int>, decoded binary, and with offsets starts and ends array<int>.

    vocabulary is the path of a tokenizers JSON file, pattern the regular expression that splits text
    before the merges. decoded is what the ids give back through the reversed byte table.
    """
    kept = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", ids array<int>, decoded binary" + ", starts array<int>, ends array<int>" * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for part in slices(batches):
            texts = strings(part.column(len(keep)))
            ids = [own.encode(t).tolist() for t in texts]
            out = [part.column(i) for i in range(len(keep))]
            out += [pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode_bytes(x) for x in ids], pa.binary())]
            if with_offsets:
                spans = [own.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                out += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "ids", "decoded", *(["starts", "ends"] * with_offsets)])

    return map_arrow(kept, run, schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and text string: bytes are joined over the whole row before they are read as UTF-8, and
    bytes that form no character become U+FFFD. Null ids give an empty text."""
    kept = df.select(*keep, F.col(ids).cast("array<int>").alias("__ids"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for part in slices(batches):
            texts = [own.decode_bytes(x or []).decode("utf-8", "replace") for x in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_arrow(kept, run, schema)


def digests(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what `encode` gives, digested where it is made
    so that neither ids nor decoded bytes travel."""
    kept = df.select("doc_id", F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for part in slices(batches):
            packed = [own.encode_packed(t) for t in strings(part.column(1))]
            decoded = (own.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in packed)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(kept, run, f"doc_id {dict(kept.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
