import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.operators import resolve
from marketloom.plans import registry


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sides():
    """Names of one make, of which many are one or two edits apart, and changed ones."""
    r = random.Random(4)
    name = lambda: f"customer 0000{r.randrange(1000):05d}"

    def changed(n):
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(n))
            n = r.choice([n[:i] + n[i + 1 :], n[:i] + r.choice("019x ") + n[i:], n[:i] + r.choice("019x") + n[i + 1 :]])
        return n

    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(r.randrange(100))
    g = [(i % 2, i, name(), day()) for i in range(90)] + [(0, 90, "a", day()), (1, 91, "", day()), (0, 92, "ab", day()), (0, 93, "customer number 000000001 of 9", day())]
    s = [(i % 2, 1000 + i, changed(name()), day()) for i in range(120)] + [(0, 1500, "b", day()), (1, 1501, "", day()), (0, 1502, "ba", day()), (0, 1503, "customer number 0000000010 f 9", day())]
    return g, s


def pairs(g, s, least, days=45):
    out = []
    for c, gid, n, d in g:
        for k, sid, m, e in s:
            if c == k and abs((d - e).days) <= days:
                edits, longer = edit_distance(n, m), max(len(n), len(m))
                score = 1 - edits / longer if longer else 1.0
                if score >= least:
                    out.append((gid, sid, edits, score))
    return out


def frames(spark, g, s):
    return spark.createDataFrame(g, "category int, group_id long, n string, d date"), spark.createDataFrame(s, "category int, set_id long, sn string, sd date")


@pytest.mark.parametrize("least", [0.3, 0.5, 0.88, 0.9, 1.0])
def test_near_names_of_one_make(spark, least):
    g, s = sides()
    want = pairs(g, s, least)
    got = resolve.near_names(*frames(spark, g, s), least, 45).collect()
    assert len(got) == len(want) and {(x["group_id"], x["set_id"]): x["score"] for x in got} == pytest.approx({(a, b): x for a, b, _, x in want})
    few = {(x["group_id"], x["set_id"]) for x in resolve.near_names(*frames(spark, g, s), least, 45, few=True).collect()}
    assert few == {(a, b) for a, b, e, _ in want if e <= 1 and max(len(dict((i, n) for _, i, n, _ in x)[k]) for x, k in ((g, a), (s, b))) <= resolve.short_length(least)}
    assert least != 0.88 or {e for _, _, e, _ in want} >= {0, 1, 2}


def test_only_names_two_edits_apart_share_a_key(spark):
    names = spark.range(3000).select(F.format_string("customer 000%06d", F.col("id") * 331).alias("n"))
    shapes = resolve.name_shapes(names, "n", 24)
    left = resolve.edit_keys(names, "n", shapes, shapes, 0.88, 2, False)
    met = left.join(resolve.edit_keys(names.withColumnRenamed("n", "sn"), "sn", shapes, shapes, 0.88, 2, True), "key").where("n <> sn")
    x = met.agg(F.count("*").alias("n"), F.max(F.levenshtein("n", "sn")).alias("edits")).first()
    assert x["edits"] == 2 and x["n"] < 100_000  # 9,000,000 pairs share a gram
    assert left.groupBy("n").count().agg(F.max("count")).first()[0] <= 15 + 18 and shapes == {18: "customer 000" + "\x01" * 6}


@pytest.mark.parametrize("margin", [0.02, 0.07, 0.3])
def test_best_names_equal_brute_force(spark, margin):
    g, s = sides()
    want = {}
    for gid in {x[1] for x in g}:
        own = [(b, x) for a, b, _, x in pairs(g, s, 0.88) if a == gid]
        near = [b for b, x in own if x >= max(y for _, y in own) - margin]
        if near:
            want[gid] = (min(near), max(near))
    left, right = frames(spark, g, s)
    got = resolve.best_names(left, right.withColumn("set_id", F.struct(F.col("set_id").alias("lo"), F.col("set_id").alias("hi"))), 0.88, 45, margin)
    assert {x["group_id"]: (x["lo"], x["hi"]) for x in got.collect()} == want
    assert len({lo == hi for lo, hi in want.values()}) == 2


def test_the_query_compares_similar_names(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, f"Customer#{i:09d}", r.randrange(25), 0.0, "M") for i in range(400)]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(path)
    got = {tuple(x) for x in registry.queries()["match_sets"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{path}/*.parquet'")
    assert got == set(con.execute(registry.oracle_sql()["match_sets"]).fetchall())
    assert {m for _, m, _ in got} >= {"name", "code", "similar", "ambiguous"}  # no names of this length are 0.97 alike
