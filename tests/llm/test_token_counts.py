import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from marketloom.llm import token_counts as t

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def texts(r, n):
    alphabet = ["a", "the", "e", " ", " ", "  ", "\n", "\t", ".", "▁", "<s>", "</s>", "<unk>", "é", "ñ", "漢字", "🙂", "　", " ", "ﬁ", "\x00", "1", "23", "<0x0A>"]
    return ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(n)]


def test_pre_tokens_give_the_text_back():
    for text in texts(random.Random(1), 500):
        plain = text.replace(t.MARK, " ")
        assert " ".join(t.pre_tokens(text)) == plain
        assert not any(x[:1] != " " and " " in x for x in t.pre_tokens(text))
        parts = list(t.stretches(text, 7))
        assert " ".join(parts) == plain and [p for part in parts for p in (t.pre_tokens(part) if part else [""] * bool(text))] == t.pre_tokens(text)


@pytest.mark.parametrize("remembered, stretch", [(8_000_000, 1_000_000), (40, 25)])
def test_lookup_equals_the_library(library, monkeypatch, remembered, stretch):
    monkeypatch.setattr(t, "REMEMBERED", remembered)
    monkeypatch.setattr(t, "STRETCH", stretch)
    pieces = t.Pieces(MODEL)
    assert not pieces.whole
    table = {w: n for w, n in zip(["the", "", "a\n"], pieces.lengths(["the", "", "a\n"]), strict=True)}
    assert t.unpacked(t.packed(table)) == table
    lookup = t.Lookup(pieces, table)
    every = ["", " ", "  ", "a ", " a", "a  b", "\n", "▁", "▁▁ a▁", "<s>x</s>", "x" * 3000, *texts(random.Random(2), 600)]
    assert lookup.totals(every) == [len(x) for x in library.encode(every)]


def test_query_over_rows(spark, library):
    every = [None, "", "The cat sat on the mat. " * 9000, *texts(random.Random(3), 80)]
    rows = [(i if i % 9 else None, x, 1) for i, x in enumerate(every)] * 2
    got = t.count_tokens(spark.createDataFrame(rows, SCHEMA), MODEL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted((i or -1, len((x or "").encode()), len(library.encode(x or ""))) for i, x, _ in rows)
    assert sorted((x[0] or -1, x[1], x[2]) for x in got.collect()) == want
    assert t.count_tokens(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_frequent_pre_tokens(spark, library, monkeypatch):
    frame = spark.createDataFrame([("a b " * 500,), ("b c",), ("d",)], "text string")
    assert set(t.frequent(frame, MODEL, share=0.2)) == {"a", "b"}
    monkeypatch.setattr(t, "COUNTED", 2)  # the table may then be smaller; counts of tokens do not depend on it
    assert set(t.frequent(frame, MODEL, share=0.2)) <= {"a", "b"}


def test_query_on_given_documents(spark, library):
    from marketloom.llm.queries import op13_token_counts

    folder = "/root/testdata/sf0.001"
    given = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op13_token_counts(spark, folder).collect()
    assert {x["doc_id"]: x["n_tokens"] for x in got} == {i: len(library.encode(x)) for i, x in given.items()}
    assert all(x["over_limit"] == (x["n_tokens"] > 4096) and x["n_bytes"] == len(given[x["doc_id"]].encode()) for x in got)
