import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions.scalars import query_norm, text_similarity
from marketloom.operators import ranking


def test_pages_join_without_a_gap_and_read_one_folder(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"{r.choice(['red', 'blue', 'Old Red', 'kit'])} {r.choice(['dragon', 'Widget', 'dra'])} {i % 7}", r.choice(["a", "b"])) for i in range(400)]
    products = spark.createDataFrame([*rows, (900, None, "a"), (901, "", "b")], "id long, name string, category string")
    path = str(tmp_path / "index")
    ranking.write_prefix_index(ranking.prefix_index(products, "id", "name", 8, "category"), path, "name", "category")
    index = spark.read.parquet(path)
    for category, query in (("a", "red dra"), ("b", "widget"), ("a", "nothing")):
        got, after = [], None
        while page := ranking.prefix_search(index, query, "id", "name", after, 9, ("category", category), 8).collect():
            got += [(x["name"], x["id"]) for x in page]
            after = got[-1]
        assert got == sorted((n, i) for i, n, c in rows if c == category and query in n.lower())
    plan = ranking.prefix_search(index, "red dra", "id", "name", None, 9, ("category", "a"), 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan.replace("\n", " ") and "(category" in plan and "EqualTo(prefix,red)" in plan
    with pytest.raises(ValueError, match="3 to 120"):
        ranking.prefix_search(index, "ab", "id", "name")


def test_rank_hits_compares_a_text_once(spark):
    names = ["red widget", "Red  Widget 7", "blue kit", "", None]
    rows = [(i % 190, names[i % 5], f"{names[i % 5]} {i % 3}" if i % 4 else None, str(i % 9) if i % 6 else None) for i in range(200)]
    items = spark.createDataFrame(rows, "id long, name string, detail string, number string")
    q = F.lit("red widget 7")
    exact = F.when((query_norm(F.col("number")) == "7"), 0.12).otherwise(0.0)
    each = items.withColumn("score", F.least(F.lit(1.0), F.greatest(text_similarity(F.col("name"), q), 0.92 * text_similarity(F.col("detail"), q)) + exact))
    want = {}
    for x in each.collect():
        want.setdefault(x["id"], []).append((x["score"], x["name"] or ""))
    found = ranking.rank_hits(items, "red widget 7")
    assert {x["id"]: (x["score"], x["name"] or "") for x in found.collect()} == {k: max(v) for k, v in want.items()}
    # the similarities are written by text before, so no item's row computes one
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
