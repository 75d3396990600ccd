"""URL filters: pattern rules indexed by their rarest literal token.

A pattern rule has a regular expression, a verdict and the literal tokens without which it cannot
match. Each rule is filed under the one of its tokens that is rarest over all URLs of the table; a
URL's tokens fetch the rules filed under them, and only those run their expressions. Host rules
(`org/`, `example.org/es/`) fit a host and its subdomains by path prefix, the longest wins and
overrules patterns. Of patterns an important block goes before an allow, and an allow (an exception of a list) before a block. Where nothing
speaks, the verdict is allow.

Rules may come from a filter list of many thousands of lines (list_rules), which also says how many lines it left out and why; those of
PATTERN_RULES, one for each word and place, are the default.

Null and empty URLs, and URLs without `://`, have empty host and path, fit no host rule and are judged by
patterns alone. Repeated rows are judged independently.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import map_arrow, slices, strings


class PatternRule(NamedTuple):
    pattern: str
    tokens: tuple[str, ...]
    verdict: str


def word_rule(word: str, verdict: str = "block") -> PatternRule:
    """A rule on a whole word in a host's labels."""
    return PatternRule(rf"://([^/?#]*[.-])?{re.escape(word)}[.-]", (word,), verdict)


#: Options of a list's line that a page's own address can meet, and what they ask for.
PAGE_OPTIONS = frozenset(("all", "doc", "document", "popup", "first-party", "1p", "~third-party", "~3p", "important"))


def list_rule(line: str) -> PatternRule | str | None:
    """One line of a filter list: `||host^` for a host and its subdomains, `|` for the URL's start or end, `^` for a separator, `*` for
    anything, `/.../` for a regular expression, `@@` before a rule that allows, options after `$`. None for a blank line, a comment (!) or a header; a
    string says why a rule is left out.

    Options that a page's own address can meet are read (`important` makes a block that exceptions do not lift); a rule for other kinds of
    request, for third parties or for pages of certain sites never meets one. A token is needed only where nothing can extend it: both its
    neighbours in the rule are separators or the rule's anchors.
    """
    text = line.strip().lower()
    if not text or text[0] in "![":
        return None
    if any(mark in text for mark in ("##", "#@#", "#?#", "#$#")):
        return "element rule"
    verdict, text = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    if len(text) > 1 and text[0] == "/" and text.rstrip("/") != text and text.count("/") == 2:
        return "regular expression"
    if "$" in text:
        text, _, options = text.rpartition("$")
        named = {o.strip() for o in options.split(",")}
        if not named <= PAGE_OPTIONS:
            return "option " + min(o.partition("=")[0] for o in named - PAGE_OPTIONS)
        if "important" in named and verdict == "block":
            verdict = "important"
    head, text = (r"://([^/?#]*\.)?", text[2:]) if text.startswith("||") else ("^", text[1:]) if text.startswith("|") else ("", text)
    tail, text = ("$", text[:-1]) if text.endswith("|") else ("", text)
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    pattern = head + "".join(parts.get(c, re.escape(c)) for c in text) + tail
    open_ended = ("" if head else "*") + text + ("" if tail else "*")
    tokens = [m.group() for m in re.finditer("[a-z0-9]+", open_ended) if open_ended[m.start() - 1 : m.start()] != "*" and open_ended[m.end() : m.end() + 1] != "*"]
    return PatternRule(pattern, tuple(tokens), verdict) if tokens else "no literal token"


class FilterList(NamedTuple):
    rules: tuple[PatternRule, ...]
    left_out: dict[str, int]  # lines by the reason for which they are not read


def list_rules(spark: SparkSession, path: str, most: int = 200_000) -> FilterList:
    """The rules of a filter list in a file that Spark can read. Rules are sent to every task, so a list of over `most` lines is refused."""
    lines = [r["value"] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rules")
    found = [list_rule(x) for x in lines]
    return FilterList(tuple(dict.fromkeys(r for r in found if isinstance(r, PatternRule))), dict(Counter(r for r in found if isinstance(r, str))))


#: Words of hosts and paths that a corpus leaves out, where no filter list is given.
BLOCKED_WORDS = tuple(
    (
        "adult bets betting bingo cams camgirls casino casinos doorway escort escorts fetish gambling hentai jackpot keygen lottery nsfw nude nudes "
        "phishing pills poker porn porno pornos roulette sexcam slots spam sportsbet torrents viagra warez webcams xxx"
    ).split()
)


def path_rule(word: str, verdict: str = "block") -> PatternRule:
    """A rule on a whole segment of a path."""
    return PatternRule(rf"://[^?#]*/{re.escape(word)}([/?#]|$)", (word,), verdict)


PATTERN_RULES: tuple[PatternRule, ...] = (
    *(rule(w) for w in BLOCKED_WORDS for rule in (word_rule, path_rule)),
    PatternRule(r"://[^?#]*/wp-login\.php", ("wp", "login"), "block"),
    PatternRule(r"://[^?#]*/(cart|checkout)/[^?#]*\?session=", ("session",), "block"),
)

#: Fixed values: (host and path, verdict).
HOST_RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = HOST_RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # the last condition put in front wins
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def token_counts(urls: DataFrame, tokens: frozenset[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs. Bounded by the rules."""
    each = urls.select(F.explode(F.array_distinct(F.split(ascii_lower(F.col("url")), "[^a-z0-9]+"))).alias("t"))
    return {r["t"]: r["n"] for r in each.where(F.col("t").isin(*tokens)).groupBy("t").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[PatternRule]]:
    index: dict[str, list[PatternRule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index


def judge(urls: DataFrame, keep: tuple[str, ...] = ("page_id",), rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """`keep`, url, pattern_verdict (block if a fetched important rule matches, else allow if an allow rule
    does, else block if a block rule does, else null) and fetched (how many rules' expressions ran)."""
    index = rule_index(rules, token_counts(urls, frozenset(t for r in rules for t in r.tokens)))
    kept = urls.select(*keep, F.col("url").cast("string").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = {t: [(re.compile(r.pattern), r.verdict) for r in found] for t, found in index.items()}
        tokens = re.compile("[a-z0-9]+").findall
        upper = {c: c + 32 for c in range(65, 91)}
        for part in slices(batches, 4096):
            verdicts, fetched = [], []
            for url in strings(part.column(len(keep))):
                low = url.translate(upper)
                own = [x for t in set(tokens(low)) if t in filed for x in filed[t]]
                said = {verdict for pattern, verdict in own if pattern.search(low)}
                verdicts.append("block" if "important" in said else "allow" if "allow" in said else "block" if said else None)
                fetched.append(len(own))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(verdicts, pa.string()), pa.array(fetched, pa.int32())], names=[*keep, "url", "pattern_verdict", "fetched"])

    return map_arrow(kept, run, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", pattern_verdict string, fetched int")


def filter_urls(pages: DataFrame, rules: tuple[PatternRule, ...] = PATTERN_RULES, host_rules: tuple[tuple[str, str], ...] = HOST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, fetched for every row."""
    verdict_of = F.create_map(*[F.lit(x) for pair in host_rules for x in pair])
    out = judge(pages, rules=rules).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("rule", host_rule(F.col("host"), F.col("path"), host_rules))
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.try_element_at(verdict_of, "rule"), "pattern_verdict", F.lit("allow")).alias("verdict"), "fetched")
