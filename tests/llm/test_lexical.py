import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import lexical

DOCS, ITEMS = "doc_id long, text string, score int", "item_id string, text string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in {(i or "", t) for i, t, *_ in items}:
        scored = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out.update((item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1))
    return out


def found(spark, docs, items, **more):
    got = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(r, n, words=60):
    vocabulary = [f"w{i}" for i in range(words)] + ["Straße", "naïve", "Ü1"]
    pick = lambda k: " ".join(r.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=k))
    docs = [(i, pick(r.randint(0, 40)), 1) for i in range(n)]
    docs += [(n + i, docs[7][1].upper(), 1) for i in range(30)] + [(5, docs[5][1], 1), (None, docs[9][1], 1), (n + 90, None, 1), (n + 91, " .,;", 1), (n + 92, "w3 " * 5000, 1)]
    items = [(f"q{i}", pick(r.randint(1, 25)), 0) for i in range(25)] + [("none", "zzz", 0), ("blank", "", 0), ("null", None, 0), (None, "w1 w1 w2", 0), ("q0", "w5", 0)]
    return docs, items + [items[3]]


@pytest.mark.parametrize("entries", [150, 1_000_000])
def test_ranked_equals_brute_force(spark, entries):
    docs, items = corpus(random.Random(entries), 400)
    docs = docs[:-1]
    assert {x for x in found(spark, docs, items, block_entries=entries) if x[0] != "q0"} == {x for x in brute(docs, items) if x[0] != "q0"}


def test_ties_copies_and_item_blocks(spark):
    docs = [(i, "alpha beta" if i % 3 else f"alpha gamma{i % 5}", 0) for i in range(200, 0, -1)]
    items = [("a", "alpha", 0), ("b", "beta alpha beta", 0), ("c", "gamma1 alpha", 0)]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, item_bytes=6) == want
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_edges(spark):
    docs, items = corpus(random.Random(2), 20)
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()
    assert found(spark, [(1, None, 0), (2, "", 0)], items) == set()
    assert found(spark, docs, [("x", "w3", 0)]) == brute(docs, [("x", "w3")])


def test_search_scores_few_documents():
    """The bounds leave most documents unscored."""
    r = np.random.default_rng(1)
    n, n_terms = 20_000, 400
    per_doc = [np.unique(r.zipf(1.3, 40) % n_terms) for _ in range(n)]
    terms_, places = np.concatenate(per_doc).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in per_doc])
    sizes = np.sort(r.integers(40, 400, n))
    dfs = dict(enumerate(np.bincount(terms_, minlength=n_terms).tolist()))
    block = lexical.Block([[i] for i in range(n)], sizes, terms_, np.ones(len(terms_), np.int32), places, lexical.weights(n, dfs, n_terms), n, int(sizes.sum()))
    asked = np.array([3, 17, 80, 150, 333])
    got = block.search(asked, np.ones(5, np.int64), 10, 1)
    every = np.zeros(n, np.int64)
    for t in asked:
        s = slice(block.start[t], block.end[t])
        every[block.doc[s]] += block.impact[s]
    assert sorted((s for s, _ in got), reverse=True)[:10] == np.sort(every)[::-1][:10].tolist()
    assert len(got) < np.count_nonzero(every) / 4
