"""Personal data: base patterns and a semi-Markov conditional random field.

The base finds emails, IPv4 addresses, payment cards and international phone numbers by pattern and
check. The field adds what patterns miss, such as phone numbers without a country code: a text's runs
of chunks with digits or @ are cut into tokens, every segment of at most `MAX_TOKENS` tokens with a digit or @ is a candidate,
whole-span features (digit groups, length, checksum, neighbours) score each type for it, and
bounded-entity dynamic programming chooses boundaries and types together. Text without a digit or @
scores nothing and is skipped, so the cost follows the candidates. Base spans stay; a decoded span
is added when it overlaps none of them.

The field's weights are fitted on the driver by gradient ascent on the log-likelihood of a fixed
number of generated labelled strings; no table is sampled.

Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows are searched
independently.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import map_arrow, slices, utf8

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS = 16, 64
TRAIN_STRINGS, EPOCHS = 500, 10

Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The base patterns. Possessive where giving back cannot help, so that long runs stay linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS_OR_AT = bytes(b"0123456789@")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping emails. Each has one @, so the search goes from @ to @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at)):
            yield ("email", start, found.end())
            done = found.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    spans = list(emails(text))
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
ISLAND_AT = re.compile(r"[0-9@]")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks with a digit or @, chunks parted by one blank, brackets included."""
    end = -1
    begin = None
    for m in ISLAND_AT.finditer(text):
        if m.start() < end:
            continue
        a, b = m.start(), m.end()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if begin is not None and a - end <= 1:
            end = b
            continue
        if begin is not None:
            yield begin, end
        begin, end = a, b
    if begin is not None:
        yield begin, end


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate segment and its neighbours."""
    s = text[start:end]
    digits = digits_of(s)
    n = len(digits)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    kind = lambda c: "e" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c
    separators = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", s))))
    out = [
        "digits=" + str(min(n, 20)),
        "groups=" + "-".join(map(str, groups[:6])),
        "n_groups=" + str(min(len(groups), 7)),
        "separators=" + separators[:6],
        "zero=" + str(s[0] == "0"),
        "first=" + kind(s[0]),
        "last=" + kind(s[-1]),
        "before=" + kind(before),
        "after=" + kind(after),
        "letters=" + str(any(c.isalpha() for c in s)),
        "length=" + str(len(s) // 4),
    ]
    if "@" in s:
        out.append("at=" + str(bool(re.fullmatch(r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+", s))))
    if 12 <= n <= 19 and not any(c.isalpha() for c in s):
        out.append("luhn=" + str(luhn(digits)))
    if len(groups) == 4 and separators == ".":
        out.append("octets=" + str(all(int(g) <= 255 for g in re.findall("[0-9]{1,4}", s))))
    if "(" in s or ")" in s:
        out.append("balanced=" + str(s.count("(") == s.count(")") and (s.startswith("(") or s.startswith("+"))))
    return out


def candidates(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, list[str]]]]]:
    """Tokens of text[a:b], and for each token the candidate segments that begin there as (end token, features)."""
    tokens = [(a + m.start(), a + m.end()) for m in TOKEN.finditer(text[a:b])]
    begins: list[list[tuple[int, list[str]]]] = []
    for i, (start, _) in enumerate(tokens):
        own = []
        if not text[start].isspace():
            marked = False
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                end = tokens[j][1]
                if end - start > MAX_CHARS:
                    break
                marked = marked or text[tokens[j][0]].isdigit() or text[tokens[j][0]] == "@"
                if marked and not text[end - 1].isspace() and end - start >= 7:
                    own.append((j + 1, span_features(text, start, end)))
        begins.append(own)
    return tokens, begins


class SemiMarkovField:
    """Weights of (kind, feature), of two kinds side by side, and of tokens outside segments."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, kind: str, features: list[str]) -> float:
        w = self.weights
        return w.get((kind, "bias"), 0.0) + sum(w.get((kind, f), 0.0) for f in features)

    def segments(self, begins: list) -> list[list[tuple[int, str, float, list[str]]]]:
        return [[(j, k, self.score(k, f), f) for j, f in own for k in KINDS] for own in begins]

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation; a token outside segments scores 0."""
        tokens, begins = candidates(text, a, b)
        n = len(tokens)
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i, own in enumerate(begins):
            if best[i] > best[i + 1]:
                best[i + 1], back[i + 1] = best[i], (i, None)
            for j, f in own:
                for k in KINDS:
                    s = best[i] + self.score(k, f)
                    if s > best[j]:
                        best[j], back[j] = s, (i, k)
        spans, j = [], n
        while j:
            i, k = back[j]
            if k:
                spans.append((k, tokens[i][0], tokens[j - 1][1]))
            j = i
        return spans[::-1]

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-3) -> SemiMarkovField:
        """Stochastic gradient ascent on the log-likelihood, by forward and backward sums over segmentations."""
        ready = []
        for text, spans in examples:
            for a, b in islands(text):
                tokens, begins = candidates(text, a, b)
                at = {s: i for i, (s, _) in enumerate(tokens)}
                to = {e: i + 1 for i, (_, e) in enumerate(tokens)}
                gold = {(at[s], to[e], k) for k, s, e in spans if a <= s and e <= b and s in at and e in to}
                ready.append((len(tokens), begins, gold))
        squares: dict[tuple[str, str], float] = {}
        order = random.Random(5)
        for _ in range(epochs):
            order.shuffle(ready)
            for n, begins, gold in ready:
                scored = self.segments(begins)
                forward = [0.0] + [-math.inf] * n
                for i in range(n):
                    forward[i + 1] = log_add(forward[i + 1], forward[i])
                    for j, _, s, _ in scored[i]:
                        forward[j] = log_add(forward[j], forward[i] + s)
                backward = [-math.inf] * n + [0.0]
                for i in range(n - 1, -1, -1):
                    backward[i] = backward[i + 1]
                    for j, _, s, _ in scored[i]:
                        backward[i] = log_add(backward[i], s + backward[j])
                gradient: dict[tuple[str, str], float] = {}
                for i in range(n):
                    for j, k, s, features in scored[i]:
                        slope = ((i, j, k) in gold) - math.exp(forward[i] + s + backward[j] - forward[n])
                        if abs(slope) > 1e-4:
                            for f in ("bias", *features):
                                gradient[k, f] = gradient.get((k, f), 0.0) + slope
                for key, g in gradient.items():
                    g -= l2 * self.weights.get(key, 0.0)
                    squares[key] = squares.get(key, 0.0) + g * g
                    self.weights[key] = self.weights.get(key, 0.0) + rate * g / math.sqrt(squares[key] + 1e-8)
        return self


#: Stands for the end of a text beside an island; no character has this number.
EDGE = 0x110000
#: Tokens whose segments are bounded at a time.
BOUND_TOKENS = 32_768


class Bounds:
    """Upper bounds of a field's segment scores, over arrays of characters."""

    def __init__(self, field: SemiMarkovField) -> None:
        w = field.weights
        of = lambda name: {k: {f[len(name) :]: v for (kk, f), v in w.items() if kk == k and f.startswith(name)} for k in KINDS}
        counted = lambda name, most: np.array([[of(name)[k].get(str(i), 0.0) for i in range(most + 1)] for k in KINDS])
        self.bias = np.array([w.get((k, "bias"), 0.0) for k in KINDS])
        self.digits, self.n_groups, self.length = counted("digits=", 20), counted("n_groups=", 7), counted("length=", MAX_CHARS // 4)
        self.letters, self.zero = (np.array([[of(name)[k].get(str(x), 0.0) for x in (False, True)] for k in KINDS]) for name in ("letters=", "zero="))
        # kinds of a character beside or at the end of a segment: one of four classes, or the character itself
        ends = {name: of(name) for name in ("first=", "last=", "before=", "after=")}
        self.marks = {c: 5 + i for i, c in enumerate(sorted({c for x in ends.values() for k in KINDS for c in x[k]} - {"e", "d", "a", "s"}))}
        codes = {"e": 0, "d": 1, "a": 2, "s": 3} | self.marks
        self.ends = {}
        for name, x in ends.items():
            self.ends[name] = np.zeros((len(KINDS), 5 + len(self.marks)))
            for i, k in enumerate(KINDS):
                for c, v in x[k].items():
                    self.ends[name][i, codes[c]] = v
        # separators as sets of bits; a character that no weight names is the bit beside them
        known = of("separators=")
        letters = sorted({c for k in KINDS for s in known[k] for c in s})
        self.bit = {c: 1 << i for i, c in enumerate(letters)}
        self.strange = 1 << len(letters)
        self.separators = {sum(self.bit[c] for c in s): np.array([known[k].get(s, 0.0) for k in KINDS]) for s in {s for k in KINDS for s in known[k]}}
        self.most_separators = np.array([max([0.0, *known[k].values()]) for k in KINDS])
        # the first six digit groups, their sizes in six bits each
        sizes = of("groups=")
        code = lambda x: sum((min(int(n), 62) + 1) << (6 * t) for t, n in enumerate(n for n in x.split("-") if n))
        self.groups = {code(x): np.array([sizes[k].get(x, 0.0) for k in KINDS]) for x in {x for k in KINDS for x in sizes[k]}}
        most = lambda name: np.array([max([0.0, *of(name)[k].values()]) for k in KINDS])
        self.at, self.luhn, self.octets, self.balanced = most("at="), most("luhn="), most("octets="), most("balanced=")

    def classes(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each character: end class, separator bit, and whether it is an ASCII digit, any digit, any letter, white space."""
        kinds, place = np.unique(codes, return_inverse=True)
        ends, bits, ascii_digit, digit, letter, space = (np.zeros(len(kinds), np.int64) for _ in range(6))
        for i, n in enumerate(kinds.tolist()):
            if n == EDGE:
                continue
            c = chr(n)
            ends[i] = 1 if c.isdigit() else 2 if c.isalpha() else 3 if c.isspace() else self.marks.get(c, 4)
            ascii_digit[i], digit[i], letter[i], space[i] = "0" <= c <= "9", c.isdigit(), c.isalpha(), c.isspace()
            bits[i] = 0 if c.isascii() and c.isalnum() else self.bit.get(c, self.strange)
        return tuple(x[place] for x in (ends, bits, ascii_digit, digit, letter, space))

    def promising(self, codes: np.ndarray, island: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and ends of all tokens, and the segments (first token, token after, kinds as bits) whose bound is above 0. codes has an extra character on
        either side of each island, where island is -1."""
        ends, bits, ascii_digit, digit, letter, space = self.classes(codes)
        plain = np.where(ascii_digit == 1, 2, np.where((letter == 1) & (codes < 128), 1, 0))
        new = (plain == 0) | (plain != np.concatenate([[0], plain[:-1]])) | (island != np.concatenate([[-1], island[:-1]]))
        start = np.flatnonzero(new & (island >= 0))
        nxt = np.append(np.flatnonzero(new | (island < 0)), len(codes))
        end = nxt[np.searchsorted(nxt, start, "right")]
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        n_digit, n_letter, n_at, n_bracket = total(ascii_digit), total(letter), total(codes == ord("@")), total((codes == ord("(")) | (codes == ord(")")))
        group_token = ascii_digit[start] == 1
        group_size = np.append(np.minimum(end - start, 62)[group_token] + 1, np.zeros(6, np.int64))
        n_group, marked = total(group_token), total((digit[start] == 1) | (codes[start] == ord("@")))
        begins, stops, kinds = [], [], []
        for lo in range(0, len(start), BOUND_TOKENS):
            i = np.arange(lo, min(lo + BOUND_TOKENS, len(start)))
            i = i[space[start[i]] == 0]
            mask = np.zeros(len(i), np.int64)
            for size in range(1, MAX_TOKENS + 1):
                j = i + size - 1
                inside = j < len(start)
                i, j, mask = i[inside], j[inside], mask[inside]
                same = island[start[j]] == island[start[i]]
                i, j, mask = i[same], j[same], mask[same]
                a, b = start[i], end[j]
                mask = mask | bits[start[j]]
                short = b - a <= MAX_CHARS
                i, j, mask, a, b = i[short], j[short], mask[short], a[short], b[short]
                fit = (b - a >= 7) & (marked[j + 1] > marked[i]) & (space[b - 1] == 0)
                x, y, m, a, b = i[fit], j[fit], mask[fit], a[fit], b[fit]
                if not len(x):
                    continue
                n, g = n_digit[b] - n_digit[a], n_group[y + 1] - n_group[x]
                few_n, few_g, alpha = np.minimum(n, 20), np.minimum(g, 7), (n_letter[b] > n_letter[a]).astype(np.int64)
                bound = self.bias[:, None] + self.digits[:, few_n] + self.n_groups[:, few_g] + self.length[:, (b - a) // 4] + self.letters[:, alpha] + self.zero[:, (codes[a] == ord("0")).astype(np.int64)]
                for name, at in (("first=", a), ("last=", b - 1), ("before=", a - 1), ("after=", b)):
                    bound += self.ends[name][:, ends[at]]
                code = np.zeros(len(x), np.int64)
                for t in range(6):
                    code |= np.where(t < g, group_size[np.minimum(n_group[x] + t, len(group_size) - 1)], 0) << (6 * t)
                named, where = np.unique(code, return_inverse=True)
                bound += np.stack([self.groups.get(c, np.zeros(len(KINDS))) for c in named.tolist()], 1)[:, where]
                sets, where = np.unique(m, return_inverse=True)
                bound += np.stack([self.separators.get(s, np.zeros(len(KINDS))) if s.bit_count() <= 6 else self.most_separators for s in sets.tolist()], 1)[:, where]
                bound += self.at[:, None] * (n_at[b] > n_at[a]) + self.luhn[:, None] * ((n >= 12) & (n <= 19) & (alpha == 0)) + self.octets[:, None] * (g == 4) + self.balanced[:, None] * (n_bracket[b] > n_bracket[a])
                good = (bound > -1e-9).any(0)
                begins.append(x[good])
                stops.append(y[good] + 1)
                kinds.append(((bound > -1e-9) * (1 << np.arange(len(KINDS)))[:, None]).sum(0)[good])
        none = np.empty(0, np.int64)
        return start, end, *(np.concatenate([none, *found]) for found in (begins, stops, kinds))


def decode_islands(field: SemiMarkovField, bounds: Bounds, pieces: list[tuple[str, int, int]]) -> list[list[Span]]:
    """For each (text, start, end) what field.decode gives."""
    if not pieces:
        return []
    shown, of = [], []
    for k, (text, a, b) in enumerate(pieces):
        own = np.frombuffer(text[max(0, a - 1) : b + 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        own = own if a else np.concatenate([[EDGE], own])
        shown.append(own if b < len(text) else np.append(own, EDGE))
        mark = np.full(len(shown[-1]), k)
        mark[0] = mark[-1] = -1
        of.append(mark)
    codes, island = np.concatenate(shown), np.concatenate(of)
    begun = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
    start, end, first, after, kinds = bounds.promising(codes, island)
    order = np.lexsort((after, first))
    spans: list[list[Span]] = [[] for _ in pieces]
    # the tokens of an island lie together; only what can be chosen is stepped through
    home = island[start[first[order]]] if len(order) else order
    for k in np.unique(home).tolist():
        text, a, _ = pieces[k]
        shift = a - int(begun[k]) - 1
        own = order[np.searchsorted(home, k) : np.searchsorted(home, k, "right")]
        best: dict[int, float] = {}
        chain: dict[int, tuple | None] = {}
        top, link = 0.0, None
        waiting: list[int] = []
        for i, j, possible in zip(first[own].tolist(), after[own].tolist(), kinds[own].tolist(), strict=True):
            while waiting and waiting[0] <= i:
                e = heapq.heappop(waiting)
                if best[e] >= top:  # as in decode, a segment that ends here goes before what leads up to here
                    top, link = best[e], chain[e]
            s0, e0 = int(start[i]) + shift, int(end[j - 1]) + shift
            features = span_features(text, s0, e0)
            score, kind = max((field.score(c, features), -n, c) for n, c in enumerate(KINDS) if possible >> n & 1)[::2]
            if score > 0 and top + score > best.get(j, -math.inf):
                if j not in best:
                    heapq.heappush(waiting, j)
                best[j], chain[j] = top + score, (link, (kind, s0, e0))
        while waiting:
            e = heapq.heappop(waiting)
            if best[e] >= top:
                top, link = best[e], chain[e]
        while link:
            link, span = link
            spans[k].append(span)
        spans[k].reverse()
    return spans


def log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def generated(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Labelled strings: personal data in several formats beside numbers that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = "4" + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-", "."])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(r.randint(200, 999)), num(3), num(4)
        pairs = " ".join([f"0{r.randint(1, 9)}", *(num(2) for _ in range(4))])
        near = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(4)} {num(6)}", pairs]
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+49 {num(3)} {num(7)}", *near])

    ip = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    email = lambda: f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice(['', num(2)])}@{word()}{num(1)}.{word()}.{r.choice(['com', 'org', 'net'])}"
    other = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1, 999)},{num(3)}.{num(2)}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 32, 40]))),
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(16)),
        lambda: f"password={num(3)}{word()}{num(3)}{word()}{num(2)}",
        lambda: num(r.choice([4, 5, 6, 8, 9, 10, 11, 13, 16])),
        lambda: f"{r.randint(100, 999)}.{r.randint(256, 999)}.{r.randint(0, 99)}.{r.randint(256, 999)}",
        lambda: f"{r.randint(1, 12)}:{num(2)}:{num(2)}",
        lambda: f"@{word()}{num(2)}",
        lambda: f"{num(4)}-{num(4)}-{num(4)}",
        lambda: f"{r.randint(1, 9)}.{r.randint(1, 9)}. {num(2)}",
        lambda: f"{num(2)}/{num(2)}/{num(4)}",
        lambda: f"{num(3)}-{num(2)}",
        lambda: " ".join(str(r.randint(10, 99)) for _ in range(r.randint(3, 8))),
        lambda: ",".join(str(r.randint(0, 999)) for _ in range(r.randint(3, 9))),
        lambda: r.choice(";, ").join(f"{r.randint(0, 20)}.{num(r.randint(1, 4))}" for _ in range(r.randint(2, 6))),
        lambda: " ".join(str(r.randint(1000, 9999)) for _ in range(r.randint(2, 3))),
    )
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = word() + " ", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                k = r.choice(KINDS)
                piece = makers[k]()
                spans.append((k, len(text), len(text) + len(piece)))
            else:
                piece = r.choice(other)()
            text += piece + r.choice([" ", " ", " ", ". ", ", "]) + r.choice(["", word() + " "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def fitted(n: int = TRAIN_STRINGS, epochs: int = EPOCHS) -> SemiMarkovField:
    return SemiMarkovField().fit(generated(n), epochs)


@lru_cache(maxsize=2)
def bounds_of(field: SemiMarkovField) -> Bounds:
    return Bounds(field)


def all_spans_of(texts: list[str], field: SemiMarkovField, bases: list[list[Span]]) -> list[list[Span]]:
    """For each text its base spans, and decoded spans that overlap none of them."""
    pieces = [(k, a, b) for k, text in enumerate(texts) for a, b in islands(text)]
    found = decode_islands(field, bounds_of(field), [(texts[k], a, b) for k, a, b in pieces])
    added: list[list[Span]] = [[] for _ in texts]
    for (k, _, _), spans in zip(pieces, found, strict=True):
        added[k] += spans
    out = []
    for text, base, more in zip(texts, bases, added, strict=True):
        if more:
            covered = bytearray(len(text))
            for _, a, b in base:
                covered[a:b] = b"\1" * (b - a)
            more = [x for x in more if not any(covered[x[1] : x[2]])]
        out.append(sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
    return out


def all_spans(text: str, field: SemiMarkovField) -> list[Span]:
    return all_spans_of([text], field, [base_spans(text)])[0]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), field: SemiMarkovField | None = None) -> DataFrame:
    """`keep`, base and spans: arrays of struct<kind, start, end>."""
    own = field or fitted()
    kept = df.select(*keep, F.col(text).cast("string").alias("__text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [data.decode("utf-8", "replace") if len(data.translate(None, DIGITS_OR_AT)) < len(data) else "" for data in utf8(part.column(len(keep)))]
            found = [base_spans(t) for t in texts]
            structs = lambda lists: [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in lists]
            bases, every = structs(found), structs(all_spans_of(texts, own, found))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(bases, span), pa.array(every, span)], names=[*keep, "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return map_arrow(kept, run, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + f", base {spans}, spans {spans}")
