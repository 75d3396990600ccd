"""Column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import scalars as s
from marketloom.operators import ranking
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query
from marketloom.sources.io import work_folder

_QN = "trim(regexp_replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))".format


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS market_identity FROM part")
def market_identity(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.market_identity(F.concat("p_name", F.lit(" / "), "p_type")).alias("market_identity"))


@query(f"SELECT doc_id, md5({_QN('text')}) AS query_norm FROM documents")
def query_norm(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", F.md5(s.query_norm(F.col("text"))).alias("query_norm"))


_NUM = "upper(p_brand) || '-EN0' || p_partkey || '/0' || p_size"


@query(f"""SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NUM}, '\\s+', '', 'g'), '/\\d+$', ''), '-([A-Z]{{1,3}})(\\d)', '-\\2', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') AS number FROM part""")
def collector_number_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.upper("p_brand"), F.lit("-EN0"), F.col("p_partkey").cast("string"), F.lit("/0"), F.col("p_size").cast("string"))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.collector_number_norm(raw).alias("number"))


@query(f"""WITH n AS (SELECT p_partkey AS id, {_QN("p_name || ' ' || p_type")} AS q FROM part)
SELECT id, array_to_string(list_sort(list_distinct(list_concat([x[1:3] FOR x IN string_split(q, ' ') IF length(x) >= 3], CASE WHEN length(q) >= 3 THEN [q[1:3]] ELSE [] END)))[1:16], ',') AS prefixes FROM n""")
def card_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(s.card_prefixes(F.col("p_name"), F.col("p_type")), ",").alias("prefixes"))


def _grams(c: str) -> str:
    return f"list_distinct([{c}[i:i + 2] FOR i IN generate_series(1, greatest(1, length({c}) - 2))])"


@query(f"""WITH p AS (SELECT a.p_partkey AS a_id, z.p_partkey AS b_id, {_QN("a.p_name")} AS a, {_QN("z.p_name")} AS b FROM part a JOIN part z ON z.p_partkey = a.p_partkey + 1),
t AS (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb, {_grams("a")} AS ga, {_grams("b")} AS gb FROM p),
j AS (SELECT *, len(list_intersect(list_distinct(ta), tb)) / len(list_distinct(list_concat(ta, tb))) AS jac, 2 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) AS dice FROM t)
SELECT a_id, b_id, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE greatest(jac, 0.55 * jac + 0.45 * dice) END, 6) + 0.0 AS similarity FROM j""")
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    a = p.select((F.col("p_partkey") + 1).alias("b_id"), F.col("p_partkey").alias("a_id"), F.col("p_name").alias("a"))
    j = a.join(p.select(F.col("p_partkey").alias("b_id"), F.col("p_name").alias("b")), "b_id")
    return rounded(j.select("a_id", "b_id", s.text_similarity(F.col("a"), F.col("b")).alias("similarity")))


@query("SELECT doc_id, ('0x' || sha256(CAST(doc_id AS VARCHAR))[1:8])::BIGINT % 64 AS shard FROM documents")
def shard_of(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", s.shard_of(F.col("doc_id"), 64).cast("long").alias("shard"))


@query("SELECT p_partkey AS id, list_reduce(list_prepend(0::BIGINT, [('0x' || h)::BIGINT FOR h IN string_split(sha256(CAST(p_partkey AS VARCHAR)), '')]), lambda a, x: (a * 16 + x) % 5) AS fold FROM part")
def fold_of(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.fold_of(F.col("p_partkey"), 5).cast("long").alias("fold"))


@query("""SELECT p_partkey AS id, sha256(p_type || '|' || p_brand || '|' || p_partkey || '|' || p_size) AS series_hash,
sha256('{"high":null,"low":"' || CAST(CAST(p_retailprice AS DECIMAL(16,4)) AS VARCHAR) || '"}') AS tuple_hash FROM part""")
def series_hash(spark: SparkSession, d: str) -> DataFrame:
    low, none = F.col("p_retailprice").cast("decimal(16,4)"), F.lit(None).cast("decimal(16,4)")
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.series_hash(F.col("p_type"), F.col("p_brand"), F.col("p_partkey"), F.col("p_size")).alias("series_hash"), s.tuple_hash(low=low, high=none).alias("tuple_hash"))


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS market, CASE WHEN l_linenumber % 3 = 0 THEN l_discount END AS mid, l_quantity AS low FROM lineitem)
SELECT id, coalesce(market, mid, low) AS price, CASE WHEN market IS NOT NULL THEN 'market' WHEN mid IS NOT NULL THEN 'mid' ELSE 'low' END AS field FROM x""")
def first_available_price(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    p = s.first_available_price(market=F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")), mid=F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount")), low=F.col("l_quantity"))
    return x.select("id", p.alias("p")).select("id", "p.price", "p.field")


_WORDS = "['booster box', 'elite trainer box', 'theme deck', 'tin', 'gift set', 'card case', 'commander masters', 'promo judge', 'plain']"


@query(f"""WITH x AS (SELECT p_partkey AS id, {_WORDS}[1 + p_partkey % 9] AS name, CASE WHEN p_size % 3 = 0 THEN 'unknown' WHEN p_size % 3 = 1 THEN 'single' ELSE 'sealed' END AS kind FROM part)
SELECT id, kind, CASE WHEN kind = 'unknown' THEN 'unknown' WHEN kind <> 'sealed' THEN 'single' WHEN name = 'card case' THEN 'case' WHEN name = 'elite trainer box' THEN 'elite-trainer-box' WHEN name = 'booster box' THEN 'booster-box' WHEN name = 'gift set' THEN 'bundle-collection-box' WHEN name = 'tin' THEN 'tin' WHEN name = 'theme deck' THEN 'deck' ELSE 'sealed-other' END AS format,
CASE name WHEN 'commander masters' THEN 'commander' WHEN 'theme deck' THEN 'preconstructed' WHEN 'promo judge' THEN 'promos' WHEN 'gift set' THEN 'collections' ELSE CASE WHEN id % 2 = 0 THEN 'other-supplemental' ELSE 'main' END END AS family FROM x""")
def product_format(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(w) for w in ("booster box", "elite trainer box", "theme deck", "tin", "gift set", "card case", "commander masters", "promo judge", "plain")])
    size = F.col("p_size") % 3
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(names, F.col("p_partkey") % 9).alias("name"), s.product_kind(F.when(size == 1, F.lit("7")), F.lit(None), size != 0).alias("kind"))
    return p.select("id", "kind", s.product_format(F.col("name"), F.col("kind")).alias("format"), s.set_family(F.col("name"), F.col("id") % 2 == 0).alias("family"))


@query("""SELECT o_orderkey AS id, CASE WHEN DATE '1999-01-01' - CAST(o_orderdate AS DATE) >= 0 THEN CAST(floor((DATE '1999-01-01' - CAST(o_orderdate AS DATE)) / 7) AS BIGINT) END AS weeks,
CAST(greatest(1, round_even((o_orderkey % 100) / 7.0, 0)) AS BIGINT) AS steps FROM orders""")
def release_age_weeks(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), s.release_age_weeks(F.to_date("o_orderdate"), F.lit("1999-01-01").cast("date")).alias("weeks"), s.horizon_steps(F.col("o_orderkey") % 100).cast("long").alias("steps"))


@query("""WITH x AS (SELECT p_partkey AS id, p_size / 200.0 AS p, 1 + p_partkey % 50 AS n FROM part)
SELECT id, round(1 - pow(1 - p, n), 6) + 0.0 AS hit, CAST(greatest(1, ceil(ln(1 - 0.9) / ln(1 - p) - 1e-12)) AS BIGINT) AS packs FROM x""")
def pull_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 200.0).alias("p"), (1 + F.col("p_partkey") % 50).alias("n"))
    return rounded(x.select("id", s.hit_probability(F.col("p"), F.col("n")).alias("hit"), s.packs_for(F.col("p"), F.lit(0.9)).alias("packs")))


_ERFT = "(1 / (1 + 0.3275911 * abs(x) / sqrt(2)))"


@query(f"""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_quantity - 25) / 8 AS x FROM lineitem), p AS (SELECT id, x, 1 - ({_ERFT} * (0.254829592 + {_ERFT} * (-0.284496736 + {_ERFT} * (1.421413741 + {_ERFT} * (-1.453152027 + {_ERFT} * 1.061405429))))) * exp(-x * x / 2) AS e FROM v)
SELECT id, round(CASE WHEN x >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END, 6) + 0.0 AS cdf FROM p""")
def normal_cdf(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_quantity") - 25) / 8).alias("x"))
    return rounded(x.select("id", s.normal_cdf(F.col("x")).alias("cdf")))


@query("""SELECT o_orderkey AS id, CASE WHEN age < 1 THEN 'today' WHEN age <= CASE p WHEN 'scryfall' THEN 2 WHEN 'custom' THEN 30 ELSE 7 END THEN 'recent' ELSE 'stale' END AS state,
round(CASE WHEN age * 24 <= 24 THEN 1 WHEN age * 24 >= 168 THEN 0 ELSE 1 - (age * 24 - 24) / 144 END, 6) + 0.0 AS score
FROM (SELECT o_orderkey, (o_orderkey % 40) / 2.0 AS age, ['scryfall', 'custom', 'other'][1 + o_orderkey % 3] AS p FROM orders)""")
def price_freshness(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40 / 2.0).alias("age"), F.get(F.array(F.lit("Scryfall "), F.lit("custom"), F.lit("other")), F.col("o_orderkey") % 3).alias("p"))
    return rounded(o.select("id", s.price_freshness(F.col("p"), F.col("age")).alias("state"), s.freshness_score(F.col("age") * 24).alias("score")))


@query("""SELECT o_orderkey AS id, ['near-mint', 'lightly-played', 'damaged', ''][1 + o_orderkey % 4] AS condition, ['en', 'ja', 'klingon'][1 + o_orderkey % 3] AS language FROM orders""")
def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.get(F.array(F.lit("Near Mint"), F.lit("LP"), F.lit("Poor"), F.lit("weird")), k % 4)
    lang = F.get(F.array(F.lit("English"), F.lit("Japanese"), F.lit("Klingon")), k % 3)
    return b.table(spark, d, "orders").select(k.alias("id"), s.market_condition_canon(raw).alias("condition"), s.language_canon(lang).alias("language"))


_BITS = "list_sum([CASE WHEN embedding[i] > embedding[1 + i % 64] THEN 1::HUGEINT << CAST(i - 1 AS INTEGER) ELSE 0 END FOR i IN generate_series(1, 64)])"
_HASHES = f"h AS (SELECT vec_id AS id, CAST({_BITS} AS UBIGINT) AS hash FROM embeddings)"


@query(f"WITH {_HASHES} SELECT id, lpad(lower(to_hex(hash)), 16, '0') AS hash FROM h")
def diff_hash(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lower(F.lpad(F.hex(s.diff_hash(F.col("embedding"))), 16, "0")).alias("hash"))


@query(f"""WITH {_HASHES}, p AS (SELECT q.id AS query_id, x.id, 1 - bit_count(xor(q.hash, x.hash)) / 64.0 AS similarity FROM h q JOIN h x ON q.id <> x.id WHERE q.id % 100 = 0)
SELECT query_id, id, round(similarity, 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.6 QUALIFY rank <= 5""")
def hamming_topk(spark: SparkSession, d: str) -> DataFrame:
    h = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), s.diff_hash(F.col("embedding")).alias("hash"))
    return rounded(ranking.hamming_topk(h.where("id % 100 = 0"), h, 5, 0.6))


@query("SELECT p_partkey AS id, 'card-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || 'a' AS natural_key FROM part")
def natural_key(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.natural_key(F.concat(F.lit("Card-"), F.col("p_partkey").cast("string"), F.lit("A"))).alias("natural_key"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size || '/102' WHEN p_partkey % 3 = 1 THEN p_size || 'b' ELSE '' END AS number FROM part""")
def extract_collector_number(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.col("p_name"), F.lit("\nno. "), size, F.lit("/102"))).when(k % 3 == 1, F.concat(F.lit("1999\n# "), size, F.lit("b"))).otherwise(F.lit("a plain line"))
    return b.table(spark, d, "part").select(k.alias("id"), s.extract_collector_number(text).alias("number"))


@query("""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount AS a, l_tax AS b, l_quantity AS c FROM lineitem) SELECT id, a <= b AND b <= c AS ordered, list_sort([a, b, c])[2] AS middle FROM q""")
def quantile_check(spark: SparkSession, d: str) -> DataFrame:
    q = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")]
    return b.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), s.quantile_check(*q).alias("ordered"), F.get(s.quantile_rearrange(*q), F.lit(1)).alias("middle"))


@query("""SELECT s_suppkey AS id, s_acctbal > 0 AND s_nationkey % 2 = 0 AND DATE '2020-01-01' + CAST(s_suppkey AS INTEGER) <= DATE '2020-02-15' AND s_suppkey % 3 <> 0 AS eligible FROM supplier""")
def publication_eligibility(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    e = s.publication_eligibility(F.when(F.col("s_acctbal") > 0, "approved").otherwise("rejected"), F.col("s_nationkey") % 2 == 0, F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")), F.lit("2021-01-01").cast("date"), k % 3 != 0, F.lit("2020-02-15").cast("date"))
    return b.table(spark, d, "supplier").select(k.alias("id"), e.alias("eligible"))


@query(f"""WITH n AS (SELECT p_partkey AS id, p_name AS name, {_QN("p_name")} AS q FROM part), x AS (SELECT id, name, unnest(list_distinct(list_concat([w[1:3] FOR w IN string_split(q, ' ') IF length(w) >= 3], [q[1:3]]))) AS prefix FROM n)
SELECT prefix, count(*) AS n, ('0x' || sha256(prefix)[1:8])::BIGINT % 16 AS shard FROM x GROUP BY prefix""")
def prefix_index(spark: SparkSession, d: str) -> DataFrame:
    x = ranking.prefix_index(b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id", "name", 16)
    return x.groupBy("prefix").agg(F.count("*").alias("n"), F.first("shard").cast("long").alias("shard"))


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'red widget') ORDER BY p_name, p_partkey LIMIT 25""")
def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    x = ranking.prefix_index(b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id", "name", 16)
    return ranking.prefix_search(x, "red widget", "id", "name")


@query("""WITH f AS (SELECT p_type AS category, p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS r FROM part WHERE contains(lower(p_name), 'wid') AND p_type IN ('ECONOMY', 'SMALL'))
SELECT category, CAST((r - 1) // 10 AS INTEGER) AS page, id, name FROM f WHERE r <= 30""")
def prefix_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of ten in each of two categories, from the written index."""
    folder = work_folder(spark)
    x = ranking.prefix_index(b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category")), "id", "name", 16, "category")
    ranking.write_prefix_index(x, folder, "name", "category")
    index, pages = spark.read.parquet(folder), []
    for category in ("ECONOMY", "SMALL"):
        after = None
        for page in range(3):
            # a page of ten is what a client holds
            rows = ranking.prefix_search(index, "wid", "id", "name", after, 10, ("category", category), 16).collect()
            pages += [(category, page, r["id"], r["name"]) for r in rows]
            after = (rows[-1]["name"], rows[-1]["id"]) if rows else after
    return spark.createDataFrame(pages, "category string, page int, id long, name string")


@query("""WITH r AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) AS sample_rank FROM orders) SELECT * FROM r WHERE sample_rank <= 3""")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return rounded(ranking.hash_sample(o, ["custkey"], F.col("orderkey"), 3))


@query("""SELECT p_brand AS brand, arg_min(p_partkey, (CASE WHEN contains(lower(p_name), 'booster') THEN 0 WHEN contains(lower(p_name), 'box') THEN 1 ELSE 2 END) * 1000000000 + p_partkey) AS cover FROM part GROUP BY 1""")
def pick_cover(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return ranking.pick_cover(p, "brand", "name", "id")


@query(f"""WITH n AS (SELECT p_partkey AS id, {_QN("p_name")} AS name, 'red widgets' AS q FROM part), g AS (SELECT *, string_split(name, ' ') AS ta, string_split(q, ' ') AS tb, {_grams("name")} AS ga, {_grams("q")} AS gb FROM n),
j AS (SELECT *, len(list_intersect(list_distinct(ta), tb)) / len(list_distinct(list_concat(ta, tb))) AS jac, 2 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) AS dice FROM g),
s AS (SELECT id, CASE WHEN name = q THEN 4 WHEN starts_with(name, q) THEN 3 WHEN contains(name, q) THEN 2 ELSE greatest(jac, 0.55 * jac + 0.45 * dice) END AS score FROM j)
SELECT id, round(score, 6) + 0.0 AS score FROM s WHERE score >= 0.35""")
def filter_sets(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return rounded(ranking.filter_sets(p, "red widgets").select("id", "score"))


@query("""SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS stored_on FROM orders WHERE DATE '2002-01-01' - CAST(o_orderdate AS DATE) <= 2000 ORDER BY 2 DESC, 1 LIMIT 250""")
def prune_cache(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("stored_on"))
    return ranking.prune_cache(o, F.lit("2002-01-01").cast("date"), 2000)
