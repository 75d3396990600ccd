import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marketloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are written."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("alphabet", ["a1.@-_+ (2", "0123456789. -+()", "1 4+@.", "é1@.a-"])
def test_base_equals_the_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(8000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "@a" * 50_000):
        pii.base_spans(text)


def test_field_finds_what_patterns_miss():
    f = pii.fitted()
    test = pii.generated(200, seed=77)
    hit = wrong = missed = 0
    for text, gold in test:
        got = {s for a, b in pii.islands(text) for s in f.decode(text, a, b)}
        hit, wrong, missed = hit + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95
    assert ("phone", 5, 19) in pii.all_spans("call (415) 555-2671 now", f)


def test_decode_is_the_best_segmentation():
    """Against all segmentations of short strings."""
    f = pii.fitted()

    def best(begins, i, n):
        if i == n:
            return 0.0
        top = best(begins, i + 1, n)
        for j, feats in begins[i]:
            top = max(top, max(f.score(k, feats) for k in pii.KINDS) + best(begins, j, n))
        return top

    for text in ("12-345 6789", "a@b.co 1.2.3.4", "+1 234 5678"):
        tokens, begins = pii.candidates(text, 0, len(text))
        spans = f.decode(text, 0, len(text))
        at = {a: i for i, (a, _) in enumerate(tokens)}
        to = {e: i + 1 for i, (_, e) in enumerate(tokens)}
        score = sum(f.score(k, dict((j, x) for j, x in begins[at[a]])[to[b]]) for k, a, b in spans)
        assert score == pytest.approx(best(begins, 0, len(tokens)))


def test_bounds_change_no_result():
    """Bounded segments of many texts against the plain search of each."""
    f = pii.fitted()
    r = random.Random(8)
    texts = [text for text, _ in pii.generated(150, seed=5)]
    alphabets = ["0123456789 -.()+", "12 a@.b,;é٣", "4 (1)-+", "a@b.c 1"]
    texts += ["".join(r.choice(a) for _ in range(r.randint(0, 90))) for a in alphabets for _ in range(120)]
    texts += ["12,34,56;" * 60, "a@" * 90, "+1 (212) 555-0123" * 5, "4111 1111 1111 1111 " * 4, "1" * 300, "1-" * 100, "7 " * 200]
    for text in texts:
        plain = [s for a, b in pii.islands(text) for s in f.decode(text, a, b)]
        quick = pii.decode_islands(f, pii.bounds_of(f), [(text, a, b) for a, b in pii.islands(text)])
        assert [s for own in quick for s in own] == plain, text
    together = pii.decode_islands(f, pii.bounds_of(f), [(t, a, b) for t in texts for a, b in pii.islands(t)])
    assert [s for own in together for s in own] == [s for t in texts for a, b in pii.islands(t) for s in f.decode(t, a, b)]


def test_texts_full_of_numbers_are_quick():
    """1 MB of numbers, separators and @ signs each: minutes by the plain search."""
    f = pii.fitted()
    r = random.Random(3)
    for text in ("12,34,56;" * 110_000, "a@" * 500_000, " ".join(str(r.randint(0, 99_999)) for _ in range(180_000)), ";".join(f"{r.random():.3f}" for _ in range(160_000))):
        began = time.perf_counter()
        pii.all_spans(text, f)
        assert time.perf_counter() - began < 30  # a few seconds alone; wide for a machine under load


def test_kinds_of_phone_that_patterns_miss():
    f = pii.fitted()
    for phone in ("(415) 555-2671", "020 7946 0958", "06 12 34 56 78", "212-555-0199"):
        text = f"call {phone} now"
        assert ("phone", 5, 5 + len(phone)) in pii.all_spans(text, f), phone
    for other in ("12 34 56 78", "2024-10-12 10:31:22", "1,204.55 and 99", "v1.2.3", "12,34,56,78,90", "ISBN 0"):
        assert pii.all_spans(f"see {other} there", f) == [], other


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (3, "a@b.co", "x"), (3, "a@b.co", "x"), (4, "é" * 50_000 + " 10.0.0.1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"] or 0, [tuple(s) for s in r["base"]]) for r in pii.find(df).collect()))
    assert got == [(0, [("email", 0, 6)]), (1, []), (2, []), (3, [("email", 0, 6)]), (3, [("email", 0, 6)]), (4, [("ip", 50_001, 50_009)])]
    assert pii.find(df.where(F.lit(False))).count() == 0
