import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import exact_dedup, graph, near_copies, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, fp string, component_id int"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def brute_components(nodes, near):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (7, 7)]
    near = {(min(e), max(e)) for e in edges}
    linked = {x for e in near for x in e if e[0] != e[1]}
    want = {n: c for n, c in brute_components(sorted(linked), lambda a, b: (a, b) in near).items()}
    got = {x["node"]: x["component"] for x in graph.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(frame(spark, [], "a long, b long")).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    def slow(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for text in ("", "  \n", "One", "a b c d", "The quick\tbrown fox\n jumps over the lazy dog", "É x y z q r s", "a b c d " * 3000):
        assert simhash.fingerprint(text.encode()) == slow(text)


@pytest.mark.parametrize("chunk", [5, 20_000])
def test_near_links_equal_brute_force(spark, chunk):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(25)]
    fps = set(base)
    for b in base[:8]:
        x = b
        for _ in range(12):
            for bit in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    hub = r.getrandbits(64)
    fps |= {hub ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(60)}
    fps |= {0, 1, (1 << 64) - 1}
    want = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    df = frame(spark, [(simhash.signed(x),) for x in fps], "fp long")
    links = simhash.near_links(df, chunk=chunk)
    for x in links.collect():
        assert ((x["a"] ^ x["b"]) & simhash.ALL_BITS).bit_count() <= 4
    got = {x["node"] & simhash.ALL_BITS: x["component"] & simhash.ALL_BITS for x in graph.components(links).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_simhash_edge_rows(spark):
    rows = [(5, None), (2, ""), (9, " \n"), (3, "one two three four five"), (1, "ONE two  three four five"), (1, "ONE two  three four five"), (None, "quite another text with many words in it")]
    df = frame(spark, [(*x, "c", 0) for x in rows], SCHEMA)
    got = sorted(((x["doc_id"] or 0, x["component_id"]) for x in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (9, 2), (3, 1), (1, 1), (1, 1), (0, None)], key=str)
    assert sorted(x["doc_id"] or 0 for x in simhash.keep_one(df).collect()) == [0, 1, 1, 2]
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_exact_dedup(spark):
    rows = [(4, "a  b"), (2, "a\n b"), (7, "a b"), (3, None), (1, ""), (None, "z"), (8, " a b"), (9, "a b"), (2, "a\n b")]
    got = {(x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.exact_groups(frame(spark, [(*x, "c", 0) for x in rows], SCHEMA)).collect()}
    assert got == {(4, 2, 4, False), (2, 2, 4, True), (7, 2, 4, False), (3, 1, 2, False), (1, 1, 2, True), (None, None, 1, True), (8, 8, 1, True), (9, 9, 1, True)}
    sha = {x["doc_id"]: x["text_sha256"] for x in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert sha[4] == hashlib.sha256(b"a b").hexdigest() and sha[8] == hashlib.sha256(b" a b").hexdigest()
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert sorted(x["doc_id"] or 0 for x in exact_dedup.keep_first(frame(spark, rows)).collect()) == [0, 1, 2, 2, 8, 9]


def brute_removal(docs, length):
    seen, out = set(), {}
    for i, t in docs:
        data, hit = t.encode(), bytearray(len(t.encode()))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                hit[s : s + length] = b"\1" * length
            seen.add(data[s : s + length])
        kept = bytes(c for c, h in zip(data, hit) if not h)
        out[i] = (len(data), sum(hit), sum(1 for k in range(len(hit)) if hit[k] and (k == 0 or not hit[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard, unit", [(10**9, 10**9), (600, 3000), (150, 400)])
def test_suffix_dedup_equals_brute_force(spark, shard, unit):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 5)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 80)
            parts += [p[a : a + r.randint(20, 200)], " ".join(word() for _ in range(r.randint(0, 15)))]
        docs.append((i, " ".join(parts)))
    docs += [(60, "ab" * 300), (61, "x" * 500), (62, docs[0][1]), (63, "")]
    got = {x[0]: tuple(x[1:]) for x in suffix_dedup.remove_repeats(frame(spark, docs), shard_bytes=shard, unit_bytes=unit, with_text=False).collect()}
    assert got == brute_removal(docs, 100)


@pytest.mark.parametrize("hot", [2, 20, 10**6])
def test_suffix_dedup_of_one_line_in_many_contexts(spark, hot):
    """A line that all documents hold between different words: no task gets all of its contexts."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    line = " all rights are reserved by the owners of it "
    shared = [text(40) for _ in range(5)]
    docs = [(i, text(30) + line + (r.choice(shared) if i % 3 == 0 else text(30)) + line + text(5)) for i in range(150)]
    got = {x[0]: tuple(x[1:]) for x in suffix_dedup.remove_repeats(frame(spark, docs), hot_places=hot, unit_bytes=20_000, shard_bytes=5_000, with_text=False).collect()}
    assert got == brute_removal(docs, 100)


def test_hot_anchor_is_split(spark):
    r = random.Random(14)
    line = "this one line stands in every page of it"
    docs = [(i, "".join(r.choice("abcdefghij ") for _ in range(80)) + line + "".join(r.choice("abcdefghij ") for _ in range(80))) for i in range(10_000)]
    keyed = suffix_dedup.keyed(frame(spark, docs))
    repeated = suffix_dedup.repeated_anchors(suffix_dedup.anchors(keyed, 100, 2048), 2048, 1000).cache()
    hot = np.array([h for x in repeated.where("bucket < 0").collect() for h in np.frombuffer(x["packet"], np.uint64).tolist()], np.uint64)
    assert 0 < len(hot) <= 9
    size = lambda hot: suffix_dedup.candidate_segments(keyed, repeated.where("bucket >= 0"), 100, 2048, hot).groupBy("bucket").agg(F.sum(F.length("bytes")).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    whole, parts = size(hot[:0]), size(hot)
    assert whole["most"] > whole["all"] / 20
    assert parts["most"] < parts["all"] / 200


def test_suffix_many_documents_without_id(spark):
    r = random.Random(15)
    texts = ["".join(r.choice("abcdefgh") for _ in range(300)) for _ in range(40)]
    rows = [(None, t) for t in texts] + [(7, texts[0]), (7, texts[1] + "x"), (8, texts[1])]
    got = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"]) for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([(0, 300, 300)] * 2 + [(0, 300, 0)] * 38 + [(7, 300, 0), (7, 301, 0), (8, 300, 300)])


def test_suffix_edge_rows(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    rows = [(1, long), (1, long), (2, "q" + long), (None, long), (3, None), (4, "short")]
    got = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"]) for x in suffix_dedup.remove_repeats(frame(spark, [(*x, "c", 0) for x in rows], SCHEMA)).collect())
    one = brute_removal([(1, long)], 100)[1][1]
    assert got == sorted([(1, 3000, one), (1, 3000, one), (2, 3001, 3000), (0, 3000, 3000), (3, 0, 0), (4, 5, 0)])
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_merged_transforms_equal_one_sort():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 50))) for _ in range(60)]
    want = {}
    for i, s in enumerate(strings):
        for j in range(len(s) - 7):
            want.setdefault(s[j : j + 8], set()).add((i, j))
    for shard in (10**6, 200, 40):
        got = {}
        for block, i, j in zip(*suffix_dedup.repeats(strings, 8, shard), strict=True):
            got.setdefault(int(block), set()).add((int(i), int(j)))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


REPEATED_IDS = [(1, "alpha beta gamma"), (None, "alpha beta gamma"), (None, "zeta eta theta"), (5, "alpha beta gamma"), (5, "iota kappa"), (7, "iota  kappa"), (7, "lambda mu"), (7, "lambda mu")]


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_one, near_copies.keep_one])
def test_null_and_repeated_ids_of_different_texts(spark, keep):
    extra = frame(spark, [(*x, "c", 0) for x in REPEATED_IDS], SCHEMA)
    got = sorted((str(x["doc_id"]), x["text"]) for x in keep(extra).collect())
    assert got == sorted([("1", "alpha beta gamma"), ("None", "zeta eta theta"), ("5", "iota kappa"), ("7", "lambda mu"), ("7", "lambda mu")])
    assert keep(extra).columns == extra.columns
    assert keep(extra.where("false")).count() == 0


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, near_copies.keep_one])
def test_one_of_two_spellings_under_one_id(spark, keep):
    got = keep(frame(spark, [(3, "a b"), (3, "a  b"), (4, "a b")])).collect()
    assert [x["doc_id"] for x in got] == [3]


def test_very_long_texts(spark):
    long = "word " * 400_000
    rows = [(2, long), (1, long.replace(" ", "\n")), (3, long + "end")]
    assert {(x["doc_id"], x["keep_id"]) for x in exact_dedup.exact_groups(frame(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert [x["doc_id"] for x in simhash.keep_one(frame(spark, rows)).collect()] == [1]
