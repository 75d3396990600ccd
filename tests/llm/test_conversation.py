import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from marketloom.llm import conversation as c

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def least(initials, faults):
    """Cost and edits by uniform-cost search over whole edit strings: the definition, written out."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        tail = said[-1:]
        if i == len(initials) and (not said or (tail == "a" and said.lstrip("s") != "")):
            return cost, audit
        if (i, said[-1:] or "0") in seen:
            continue
        seen.add((i, said[-1:] or "0"))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        for t in "ua":
            if t in follows:
                heapq.heappush(heap, (cost + 3, audit + "I", i, said + t))
        if i < len(initials):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, said))
            if faults[i] in "t-":
                more = 3 if faults[i] == "t" else 0
                if initials[i] in follows:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, said + initials[i]))
                for t in "ua":
                    if t in follows and t != initials[i]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, said + t))


def written_out(rows):
    """The scores of one conversation's damaged rows (turn, role, text), in order."""
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults, seen = "", set()
    for _, role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        faults += "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-"
        seen.add((role, text))
    initials = "".join(role[:1] if role[:1] in ("s", "u", "a") and role else "x" for _, role, _ in rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit = least(initials, faults)
    out, i, last = [], 0, ""
    for e in audit:
        name = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if e == "D":
            i += 1
            continue
        if e == "I":
            out.append((name, ""))
        else:
            out.append((rows[i][1] if e == "K" else name, rows[i][2]))
            i += 1
        last = out[-1][0][0]
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate:
            text = "" if fate == 1 else text.translate({46: None, 33: None, 63: None}) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def conversations(r, n, longest):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randint(0, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = r.choice(["Yes.", "No", f"Say {turn}!", f"so {turn}", " \t", "", None, f"Is it {turn}?\n"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text, 1))
    return rows


def test_search_equals_the_definition():
    r = random.Random(5)
    for _ in range(400):
        n = r.randint(0, 12)
        initials, faults = "".join(r.choice("suuuaaax") for _ in range(n)), "".join(r.choice("----tbd") for _ in range(n))
        assert c.cheapest(initials, faults) == least(initials, faults), (initials, faults)
        for entry, leave, cost, audit in c.crossings(initials, faults):
            assert cost >= c.least_costs(initials, faults)[0] and len(audit) - audit.count("I") == n and 0 <= entry <= leave or leave >= 2


def test_long_conversations_stay_cheap():
    r = random.Random(6)
    initials, faults = "".join(r.choice("suax") for _ in range(c.PIECE)), "".join(r.choice("--tbd") for _ in range(c.PIECE))
    assert c.cheapest(initials, faults) == least(initials, faults)
    assert c.cheapest("u" * 400, "-" * 400) == (600, least("u" * 400, "-" * 400)[1])


def run_query(spark, rows):
    got = c.repair(c.damaged(spark.createDataFrame(rows, SCHEMA)), gone=c.F.col("gone")).collect()
    assert len(got) == len({x["conv_id"] for x in got})
    return {x["conv_id"]: tuple(x[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for x in got}


def expected(rows):
    after = damaged(rows)
    return {conv: written_out([x[1:] for x in after if x[0] == conv])[0] for conv in {x[0] for x in rows}}


@pytest.mark.parametrize("piece", [3, 512])
def test_query_equals_the_definition(spark, monkeypatch, piece):
    monkeypatch.setattr(c, "PIECE", piece)  # small pieces: most conversations are joined from several
    rows = conversations(random.Random(piece), 60, 14)
    r = random.Random(9)
    rows += [(1000, t if t % 7 else None, r.choice(["user", "assistant"]), r.choice([f"a {t}.", "same.", "open"]), 2) for t in range(300)]
    assert run_query(spark, rows) == expected(rows)


def test_messages(spark):
    rows = [x for x in conversations(random.Random(4), 30, 9) if x[1] is not None]
    made = [(conv, t, role, text) for conv, t, role, text in damaged([(a, b, d, e) for a, b, d, e, _ in rows])]
    got = {}
    for x in c.messages(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).orderBy("piece", "place").collect():
        got.setdefault(x["conv_id"], []).append((x["role"], x["text"]))
    for conv in {x[0] for x in made}:
        assert got.get(conv, []) == written_out([x[1:] for x in made if x[0] == conv])[1]


def test_edges(spark):
    assert c.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = run_query(spark, [(gone, 0, "user", "Hello.", 0)])
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    same = [(None, None, "user", "x" * 200_000 + ".", 0)] * 40 + [(3, 1, None, None, 0), (4, -5, "user", "Q?", 0), (4, 9, "assistant", "A.", 0)]
    assert run_query(spark, same) == expected(same)
    clash = spark.createDataFrame([(1, 0, "user", "a.", 5, True, 7)], "conv_id long, turn long, role string, text string, piece int, whole boolean, place int")
    assert c.repair(clash).first()["audit"] == "KI"
