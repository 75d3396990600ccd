"""Repair of conversation structure by iterative-deepening A*.

A conversation's rows go by turn (nulls first), rows of equal turn by role, by the first characters of their text and then by a
hash of it. Each row may have one fault: blank (nothing but white space), duplicate (role and text were seen earlier), truncated (its last
character that is not white space ends no sentence). The cheapest edits make the role initials an optional s and then one or more ua, or nothing: Keep
costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user or assistant row 3; blank and duplicate rows must go, a truncated row that stays adds 3.
Of equally cheap edit strings (initials D, I, K, R) the least one in ASCII order is taken.

`cheapest` searches depth first in that order under a cost bound. Rows still to come have a lower bound of their cost (what each row
needs alone, and what disjoint pairs of rows that cannot follow each other need besides); a state that failed is kept in a transposition table with the cost that it
is now known to need, and the next bound is what the start needs. The first accepting path is the answer.

Rows are dealt out by ranges of (conversation, turn, role, text), so that a conversation lies together and a huge one is spread over tasks.
Conversations inside a range are repaired as they pass by. Those at the edge of a range, or of more than PIECE rows, are cut into pieces; each piece is searched from every
state in which it may be entered to every state in which it may be left, and the pieces are joined in order. The joined edits are the least
ones: of two edit strings over the same rows with equal cost neither begins the other, so the lesser piece decides.

Null roles and texts count as one space. A role whose initial is none of s, u, a cannot be kept. A null conv_id is a conversation of its own. Repeated rows are
duplicates. Rows marked by `gone` take no part but keep their conversation in the result; without rows it has zeros, an empty audit and the hash of nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import cut, map_arrow, slices

#: Rows, and characters, of a conversation that a task holds at once.
PIECE, PIECE_CHARACTERS = 512, 8_000_000

#: Characters of a text that order rows of equal turn and role.
HEAD = 256

BLANK = " \t\n\v\f\r"

#: States: nothing yet, after system, after user, after assistant. What follows each by a rerole or an insert.
START, SYSTEM, USER, ASSISTANT = range(4)
TURN_TO = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
ENDS = frozenset((START, ASSISTANT))
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = frozenset(("su", "ua", "au"))


def least_costs(initials: str, faults: str) -> list[int]:
    """For each place a lower bound of what the rows from there on cost: what each needs alone, and the most that disjoint
    pairs of neighbours need besides. A pair that may not stand needs an edit of 3; if one of its rows is truncated, deleting it needs only 1 more."""
    alone = {"b": 4, "d": 4, "t": 3, "-": 0}
    base, pairs = [0], [0]
    last, after = None, 0  # the next row that may stay, and the bound of pairs beyond it
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        own = alone[fault]
        best = pairs[-1]
        if fault in "t-":
            if initial == "x":
                own = 4 if fault == "t" else 3
            elif last and last[0] != "x" and initial + last[0] not in LEGAL:
                best = max(best, after + (1 if "t" in (fault, last[1]) else 3))
            last, after = (initial, fault), pairs[-1]
        base.append(base[-1] + own)
        pairs.append(best)
    return [b + p for b, p in zip(reversed(base), reversed(pairs), strict=True)]


def cheapest(initials: str, faults: str, entry: int = START, ends: frozenset[int] = ENDS) -> tuple[int, str]:
    """Cost and edits from `entry` to one of `ends` over all rows."""
    n, bounds = len(initials), least_costs(initials, faults)
    needs: dict[int, int] = {}  # what a failed state is known to need; its place * 4 + state

    def need(i: int, q: int) -> int:
        return needs.get(i * 4 + q) or (bounds[i] if i < n else 0 if q in ends else 3)

    def edits(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, next place, next state, cost) in ASCII order."""
        if i < n:
            yield "D", i + 1, q, 4
        yield "I", i, TURN_TO[q], 3
        if i < n and faults[i] in "t-":
            more, kept = 3 * (faults[i] == "t"), KEEPS.get((q, initials[i]))
            if kept is not None:
                yield "K", i + 1, kept, more
            if kept != TURN_TO[q]:
                yield "R", i + 1, TURN_TO[q], 3 + more

    while True:
        bound = need(0, entry)
        path: list[str] = []
        stack = [(0, entry, 0, edits(0, entry))]
        raised = [1 << 60]  # for each state on the stack, the least cost of the edits that failed
        if n == 0 and entry in ends:
            return 0, ""
        while stack:
            i, q, spent, rest = stack[-1]
            for edit, j, p, cost in rest:
                total = cost + need(j, p)
                if spent + total > bound:
                    raised[-1] = min(raised[-1], total)
                    continue
                path.append(edit)
                if j == n and p in ends:
                    return spent + cost, "".join(path)
                stack.append((j, p, spent + cost, edits(j, p)))
                raised.append(1 << 60)
                break
            else:
                stack.pop()
                needs[i * 4 + q] = max(need(i, q), raised.pop())
                if stack:
                    path.pop()
                    raised[-1] = min(raised[-1], spent - stack[-1][2] + needs[i * 4 + q])


def crossings(initials: str, faults: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, edits) of a piece for every way through it."""
    found = []
    starts = any(i == "s" and f in "t-" for i, f in zip(initials, faults, strict=True))
    for entry, leave in itertools.product(range(4), range(4)):
        possible = leave >= USER or (leave == START and entry == START) or (leave == SYSTEM and (entry == SYSTEM or (entry == START and starts)))
        if possible:
            found.append((entry, leave, *cheapest(initials, faults, entry, frozenset((leave,)))))
    return found


def repaired(rows: list[tuple[str, str]], initials: str, audit: str, q: int = START) -> list[tuple[str, str]]:
    """The rows after the edits: (role, text)."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
        elif edit == "I":
            q = TURN_TO[q]
            out.append((NAMES[q], ""))
        else:
            q = KEEPS[q, initials[i]] if edit == "K" else TURN_TO[q]
            out.append((rows[i][0] if edit == "K" else NAMES[q], rows[i][1]))
            i += 1
    return out


def initial_of(role: str) -> str:
    return role[0] if role and role[0] in "sua" else "x"


def fault_of(text: str) -> str:
    kept = text.rstrip(BLANK)
    return "b" if not kept else "-" if kept[-1] in ".!?" else "t"


class Turns(NamedTuple):
    """First and last turn that is not null, and how many there are."""

    first: int | None
    last: int | None
    distinct: int

    def then(self, other: Turns) -> Turns:
        if self.first is None or other.first is None:
            return other if self.first is None else self
        return Turns(self.first, other.last, self.distinct + other.distinct - (self.last == other.first))

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def turns_of(turns: Iterable[int | None]) -> Turns:
    known = [t for t in turns if t is not None]
    return Turns(known[0], known[-1], len(set(known))) if known else Turns(None, None, 0)


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))


def lines(messages: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in messages).encode("utf-8")


SCORES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECES = "piece long, initials string, faults string, first long, last long, distinct long"


def with_schema(names: str) -> Callable[[list[list]], pa.RecordBatch]:
    """Rows of the named columns as a batch."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [c.split() for c in names.split(", ")]
    return lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def ordered(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, gone in ranges of their order, sorted inside each."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("gone"))
    own = own.withColumns({"head": F.substring("text", 1, HEAD), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "head", "hash")]
    return own.repartitionByRange(*keys, "row").sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "gone")


def passed(rows: DataFrame, gone: Column | None, messages: bool) -> DataFrame:
    """What each range gives: for a conversation inside it the scores, and the digest or the messages; of any other the rows themselves, with their piece and place."""
    kind = dict(rows.dtypes)["conv_id"]
    fields = f"whole boolean, piece long, place int, turn long, role string, text string, {SCORES}, repaired_sha256 string"
    made = with_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no = TaskContext.get().partitionId()
        numbers = itertools.count(part_no << 32)
        out_ids: list = []
        out: list[list] = []

        def put(conv: object, row: list) -> None:
            out_ids.append(conv)
            out.append(row)

        def give(conv: object, held: list[tuple], split: bool) -> None:
            present = [r for r in held if not r[3]]
            if split:
                piece = next(numbers)
                for place, (turn, role, text, _) in enumerate(present):
                    put(conv, [False, piece, place, turn, role, text, *[None] * 8])
                if not present:
                    put(conv, [False, piece, -1, *[None] * 11])
                return
            pairs = [(role, text) for _, role, text, _ in present]
            initials, seen, faults = "".join(initial_of(role) for role, _ in pairs), set(), ""
            for pair in pairs:
                fault = fault_of(pair[1])
                faults += "d" if fault != "b" and pair in seen else fault
                seen.add(pair)
            cost, audit = cheapest(initials, faults)
            after = repaired(pairs, initials, audit)
            if messages:
                for place, (role, text) in enumerate(after):
                    put(conv, [True, None, place, None, role, text, *[None] * 8])
                return
            counts = [turns_of(r[0] for r in present).gaps, *(faults.count(f) for f in "bdt"), illegal_pairs(initials), cost, audit]
            put(conv, [True, *[None] * 5, *counts, hashlib.sha256(lines(after)).hexdigest()])

        def taken() -> pa.RecordBatch:
            batch = made(out)
            batch = pa.RecordBatch.from_arrays([pa.array(out_ids, id_type), *batch.columns], names=["conv_id", *batch.schema.names])
            out_ids.clear()
            out.clear()
            return batch

        held: list[tuple] = []
        now, size, begun, cut_up = None, 0, False, True  # the first conversation of a range may have begun before it
        id_type = None
        for part in slices(batches):
            id_type = part.schema.field(0).type
            for conv, turn, role, text, is_gone in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if begun and conv != now:
                    give(now, held, cut_up)
                    held, size, cut_up = [], 0, False
                elif held and (len(held) >= PIECE or size + len(text) > PIECE_CHARACTERS):
                    give(now, held, True)
                    held, size, cut_up = [], 0, True
                begun, now, size = True, conv, size + len(text)
                held.append((turn, role, text, is_gone))
            if out:
                yield taken()
        if begun:
            give(now, held, True)  # the last one may go on after it
            yield taken()

    return map_arrow(ordered(rows, gone), run, f"conv_id {kind}, {fields}")


def pieces_of(split: DataFrame) -> DataFrame:
    """conv_id and PIECES for every piece of the split conversations, with duplicates known across pieces."""
    at = F.struct("piece", "place")
    text_key = F.sha2("text", 256)
    first = split.where("place >= 0").groupBy("conv_id", "role", text_key.alias("key")).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("key").alias("__key"), "first")
    same = split["conv_id"].eqNullSafe(first["__conv"]) & (split["role"] == first["__role"]) & (text_key == first["__key"])
    kept = F.translate("text", BLANK, "")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    fault = F.when(F.col("place") < 0, "").when(kept == "", "b").when(F.col("first") < at, "d").when(F.right(kept, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    rows = split.join(first, same, "left").select("conv_id", "piece", "place", "turn", F.when(F.col("place") < 0, "").otherwise(initial).alias("i"), F.coalesce(fault, F.lit("t")).alias("f"))
    # a piece has at most PIECE rows
    grouped = rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "i", "f"))).alias("own"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_distinct("turn").alias("distinct"))
    return grouped.select("conv_id", "piece", F.array_join("own.i", "").alias("initials"), F.array_join("own.f", "").alias("faults"), "first", "last", "distinct")


def joined(pieces: DataFrame) -> DataFrame:
    """For every piece its entry state and edits, and on the last piece of a conversation its scores."""
    kind = dict(pieces.dtypes)["conv_id"]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for part in slices(batches):
            found = [[dict(zip(("entry", "leave", "cost", "audit"), x, strict=True)) for x in crossings(i, f)] for i, f in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, ways)], names=[*part.schema.names, "ways"])

    crossed = map_arrow(pieces, cross, f"conv_id {kind}, {PIECES}, ways array<struct<entry:int,leave:int,cost:long,audit:string>>")
    fields = f"piece long, entry int, edits string, closing boolean, {SCORES.removesuffix(', audit string')}"
    made = with_schema(fields)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(conv: list, at: dict[int, tuple]) -> pa.RecordBatch:
            total, _, chain = min((at[q] for q in ENDS if q in at), key=lambda x: x[:2])
            steps = []
            while chain:
                chain, step = chain
                steps.append(step)
            counts = [conv[1].gaps, *conv[2], total]
            rows = [[*step, k == 0, *(counts if k == 0 else [None] * 6)] for k, step in enumerate(steps)]
            batch = made(rows)
            return pa.RecordBatch.from_arrays([pa.array([conv[0]] * len(rows), id_type), *batch.columns], names=["conv_id", *batch.schema.names])

        conv: list | None = None
        at: dict[int, tuple] = {}
        edge, id_type = "", None
        for part in slices(batches):
            id_type = part.schema.field(0).type
            for one, piece, initials, faults, first, last, distinct, ways in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if conv is None or conv[0] != one:
                    if conv is not None:
                        yield close(conv, at)
                    # per state: cost, its edits beyond those that all states share, and the chain of pieces
                    conv, at, edge = [one, Turns(None, None, 0), [0, 0, 0, 0]], {START: (0, "", None)}, ""
                conv[1] = conv[1].then(Turns(first, last, distinct))
                conv[2] = [n + m for n, m in zip(conv[2], (*(faults.count(f) for f in "bdt"), illegal_pairs(edge + initials)), strict=True)]
                edge = initials[-1:] or edge
                options = [(at[w["entry"]][0] + w["cost"], at[w["entry"]][1] + w["audit"], w["leave"], w["entry"], w["audit"]) for w in ways if w["entry"] in at]
                best: dict[int, tuple] = {}
                for option in sorted(options):
                    best.setdefault(option[2], option)
                shared = len(os.path.commonprefix([x[1] for x in best.values()]))
                at = {q: (x[0], x[1][shared:], (at[x[3]][2], (piece, x[3], x[4]))) for q, x in best.items()}
        if conv is not None:
            yield close(conv, at)

    dealt = crossed.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece")
    return map_arrow(dealt, compose, f"conv_id {kind}, {fields}")


def edited(split: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, piece, messages array<struct<role,text>> and the edits of every piece."""
    kind = dict(split.dtypes)["conv_id"]
    # a piece has at most PIECE rows
    rows = split.where("place >= 0").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("own"))
    both = edits.join(rows, "piece", "left").select("conv_id", "piece", "entry", "edits", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        messages = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for part in slices(batches, 16):
            out = []
            for entry, audit, own in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                rows = [(x["role"], x["text"]) for x in own or ()]
                out.append([{"role": r, "text": t} for r, t in repaired(rows, "".join(initial_of(r) for r, _ in rows), audit, entry)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(out, messages)], names=["conv_id", "piece", "edits", "messages"])

    return map_arrow(both, run, f"conv_id {kind}, piece long, edits string, messages array<struct<role:string,text:string>>")


def hashed(parts: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of split conversations, streamed piece by piece."""
    kind = dict(parts.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        now, begun, audit, digest, some, id_type = None, False, [], hashlib.sha256(), False, None
        for part in slices(batches, 16):
            id_type = part.schema.field(0).type
            for conv, _, edits, messages in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if begun and conv != now:
                    yield close()
                    audit, digest, some = [], hashlib.sha256(), False
                now, begun = conv, True
                audit.append(edits)
                if messages:
                    digest.update((b"\n" if some else b"") + lines([(m["role"], m["text"]) for m in messages]))
                    some = True
        if begun:
            yield close()

    dealt = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece")
    return map_arrow(dealt, run, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of `role:text` lines) for every conversation."""
    found = cut(passed(conversations, gone, messages=False))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    split = found.where("not whole").select("conv_id", "piece", "place", "turn", "role", "text")
    edits = cut(joined(pieces_of(split)))
    scores = edits.where("closing").select(F.col("conv_id").alias("__conv"), *names)
    late = hashed(edited(split, edits))
    late = late.join(scores, late["conv_id"].eqNullSafe(scores["__conv"])).select("conv_id", *names, "audit", "repaired_sha256")
    return found.where("whole").select("conv_id", *names, "audit", "repaired_sha256").union(late)


def messages(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, piece, place, role, text: the rows of the repaired conversations, by piece and place."""
    found = cut(passed(conversations, gone, messages=True))
    split = found.where("not whole").select("conv_id", "piece", "place", "turn", "role", "text")
    late = edited(split, joined(pieces_of(split))).select("conv_id", "piece", F.posexplode("messages").alias("place", "m"))
    whole = found.where("whole").select("conv_id", F.lit(0).cast("long").alias("piece"), "place", "role", "text")
    return whole.union(late.select("conv_id", "piece", "place", "m.role", "m.text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 marks a row as `gone`, 1 empties its text, 2 takes away its
    sentence marks, 3 repeats it, 4 makes it a user's. Nulls count as one space, but for conv_id and turn outside the key."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")), F.lit(20))
    own = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("fate") == 0, F.when(F.col("fate") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("gone"))
