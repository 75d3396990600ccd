import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from marketloom.llm import graph, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words)} if len(words) <= 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def copies():
    """Texts of 300 words and copies with 1 to 11 words changed, at similarity 0.67 to 0.97, each from its text only."""
    r = random.Random(21)
    text = lambda n: [r.choice("abcdefghij") * r.randint(1, 3) + str(r.randrange(900)) for _ in range(n)]
    docs = []
    for k in range(110):
        base = text(300)
        other = list(base)
        for place in r.sample(range(5, 295), k % 11 + 1):
            other[place] = "changed"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    return docs


def test_stage_drops_copies_at_080_to_095(spark):
    docs = copies()
    similar = {b: jaccard(ta, tb) for (_, ta), (b, tb) in zip(docs[::2], docs[1::2], strict=True)}
    assert sum(0.8 <= s <= 0.95 for s in similar.values()) > 40 and sum(s < 0.8 for s in similar.values()) > 20
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == {i for i, _ in docs} - {b for b, s in similar.items() if s >= 0.8}


@pytest.mark.parametrize("chunk", [3_000, 16_000_000])
def test_links_equal_brute_force(spark, chunk):
    r = random.Random(4)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for _ in range(40):  # one crowded group, whose members differ from one another
        words = list(template)
        for place in r.sample(range(120), r.randint(0, 4)):
            words[place] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [t for _, t in copies()[:30]] + ["", " ", "a b", "A  b", "a b c d e f"]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = spark.createDataFrame([(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= 0.8], "a long, b long")
    want = {x["node"]: x["component"] for x in graph.components(want).collect()}
    got = {x["doc_id"]: x["component_id"] for x in near_copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk).collect()}
    assert got == {i: want.get(i, i) for i, _ in rows}


def exact_pairs(sets, least):
    """All pairs of distinct sets at `least` or more, by a prefix filter: of two such sets the rarest parts share a shingle."""
    count = Counter(x for s in sets for x in s)
    ordered = [sorted(s, key=lambda x: (count[x], x)) for s in sets]
    filed, found = {}, set()
    for i, own in enumerate(ordered):
        met = set()
        for x in own[: len(own) - math.ceil(least * len(own)) + 1]:
            met.update(filed.setdefault(x, []))
            filed[x].append(i)
        found |= {(j, i) for j in met if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}
    return found


@pytest.mark.parametrize("sf, least_pairs", [("sf0.01", 5), ("sf0.1", 40)])
def test_recall_on_given_documents(spark, sf, least_pairs):
    """Every pair of distinct shingle sets at 0.8 or more is in one component."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    sets = {}
    for x in docs.collect():
        sets.setdefault(near_copies.shingle_set((x["text"] or "").encode()).tobytes(), x["doc_id"])
    ids, keys = list(sets.values()), [frozenset(np.frombuffer(k, "<u8").tolist()) for k in sets]
    pairs = exact_pairs(keys, 0.8)
    assert len(pairs) >= least_pairs
    component = {x["doc_id"]: x["component_id"] for x in near_copies.near_duplicates(docs).collect()}
    assert all(component[ids[a]] == component[ids[b]] for a, b in pairs)


def test_edge_rows(spark):
    rows = [(5, None), (2, ""), (9, " \n"), (3, "one two three four five"), (1, "ONE two  three four five"), (1, "ONE two  three four five"), (None, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] or 0 for x in near_copies.keep_one(df).collect()) == [0, 1, 1, 2]
    assert near_copies.keep_one(df.where("false")).count() == 0


def test_stage_links_fingerprints_too(spark):
    line = [f"line{i}" for i in range(11)] * 10
    a, b = (" ".join([*line, *[f"{x}{i}" for i in range(40)]]) for x in "ab")
    c = " ".join([*b.split()[:-1], "end"])
    assert jaccard(a, b) < 0.3 and jaccard(a, c) < 0.3 and jaccard(b, c) >= 0.8
    bits = (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
    assert 0 < bits <= 4
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((4, a), (2, b), (7, c), (9, "something else that stays here"))], SCHEMA)
    assert sorted(x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [2, 9]
    assert sorted(x["doc_id"] for x in near_copies.keep_one(df).collect()) == [2, 4, 9]
