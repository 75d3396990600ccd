"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, conversation, decontam, exact_dedup, html_text, lexical, pii, sharding, simhash, suffix_dedup, token_counts, toxicity, url_filter
from marketloom.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_pii, op2_simhash, op3_html_text, op4_exact_dedup, op5_toxicity, op6_url_filter, op7_sharding, op8_suffix_dedup, op9_decontamination)
    return {f.__name__: f for f in (*numbered, op10_bpe, op11_conversations, op12_lexical, op13_token_counts)}


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOW("coalesce(text, '')"))

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


def op6_sql() -> str:
    rules = sorted(url_filter.HOST_RULES, key=lambda r: -len(r[0]))
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format(r.partition("/")[0], r[r.index("/") :])
    longest = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    blocks = " OR ".join("regexp_matches(low, '{}')".format(r.pattern) for r in url_filter.PATTERN_RULES if r.verdict == "block")
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, {_LOW("coalesce(url, '')")} AS low FROM pages),
p AS (SELECT page_id, low, {_LOW("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")} AS host,
  regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {longest} END AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(CASE rule {said} END, CASE WHEN {blocks} THEN 'block' END, 'allow') AS verdict FROM r
"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM
  (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM
  (SELECT d.doc_id, d.w, lens.n, unnest(generate_series(1, len(d.w) - lens.n + 1)) AS s FROM d, lens WHERE len(d.w) >= lens.n)),
occ AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sized AS (SELECT doc_id, row_number() OVER () AS doc, len(w) AS n, w FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sized),
i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY item_id, term),
held AS (SELECT doc_id, doc, n, term, count(*) AS tf FROM (SELECT doc_id, doc, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, doc, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, corpus GROUP BY term),
impact AS (SELECT doc_id, doc, held.term, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))) AS v FROM held JOIN weight ON held.term = weight.term, corpus),
scored AS (SELECT item_id, doc, max(doc_id) AS doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM asked JOIN impact ON asked.term = impact.term GROUP BY item_id, doc)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_url_filter": op6_sql(), "op9_decontamination": OP9_SQL, "op12_lexical": OP12_SQL}
