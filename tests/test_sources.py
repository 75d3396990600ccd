import datetime as dt
import json
import random

import numpy as np
import pytest

from marketloom.sources import io


def document(path, results, success=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"success": success, "results": results}))


def row(product, subtype="Normal", market=1.5, low=1.0):
    return {"productId": product, "subTypeName": subtype, "marketPrice": market, "lowPrice": low, "midPrice": None, "highPrice": None, "directLowPrice": None}


def test_archive(spark, tmp_path):
    document(tmp_path / "2024-01-02/3/10/prices", [row(1), row(2, market=None)])
    document(tmp_path / "2024-01-02/4/11/prices", [row(5)])
    rows = {r["product_id"]: r for r in io.read_price_archive(spark, str(tmp_path), [3]).collect()}
    assert set(rows) == {1, 2} and rows[1]["group_id"] == 10 and rows[2]["best"]["field"] == "low"
    assert rows[1]["archive_date"] == dt.date(2024, 1, 2)
    with pytest.raises(ValueError, match="without documents"):
        io.read_price_archive(spark, str(tmp_path), [3, 9])


def test_archive_refuses_repeats_and_failures(spark, tmp_path):
    document(tmp_path / "a/2024-01-02/3/10/prices", [row(1), row(1)])
    with pytest.raises(ValueError, match="twice"):
        io.read_price_archive(spark, str(tmp_path / "a"), [3])
    document(tmp_path / "b/2024-01-02/3/10/prices", [row(1)], success=False)
    with pytest.raises(ValueError, match="without success"):
        io.read_price_archive(spark, str(tmp_path / "b"), [3])


def test_lenient_panel_counts_reasons(spark, tmp_path):
    document(tmp_path / "2024-01-02/3/10/prices", [row(1), row(1), row(0), row(2, subtype=" "), row(3, market=None, low=None)])
    (tmp_path / "2024-01-02/3/12").mkdir()
    (tmp_path / "2024-01-02/3/12/prices").write_text("not json")
    rows, rejects = io.read_panel_members(spark, str(tmp_path), [3])
    assert rows.count() == 1
    assert {r["reason"]: r["n"] for r in rejects.collect()} == {"duplicate_series": 1, "invalid_product_id": 1, "missing_subtype_name": 1, "no_price_data": 1, "invalid_member_json": 1}
    receipt = io.archive_receipt(rows, rejects).first()
    assert (receipt["rows"], receipt["rejects"]) == (1, 5)


def test_history_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1, 2, 3, "n", 1.0), (dt.date(2024, 1, 2), 1, 2, 3, "n", 2.0)], "archive_date date, category_id int, group_id int, product_id long, subtype_name string, price double")
    path = str(tmp_path / "h")
    assert io.write_price_history(df, path) == 2
    assert io.read_price_history(spark, path).where("archive_date = '2024-01-02'").first()["price"] == 2.0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        io.write_price_history(df, path)
    assert io.read_weekly_panel(spark, path, where=None).count() == 2


def test_documents_split_by_bytes(spark):
    df = spark.createDataFrame([("g", i, "x" * (500 if i == 3 else 20)) for i in range(6)], "g string, id int, v string")
    docs = io.publish_grouped_documents(df, ["g"], ["id"], ["id", "v"], max_bytes=100)
    found = docs.orderBy("part").collect()
    assert [x["id"] for d in found for x in json.loads(d["body"])] == list(range(6))
    assert [d["oversized"] for d in found].count(True) == 1 and all(d["bytes"] <= 100 or d["rows"] == 1 for d in found)
    m = io.publish_manifest(docs, ["g"]).first()
    assert m["rows"] == 6 and m["parts"] == len(found)


def test_csv_guard(spark):
    got = [r["v"] for r in io.safe_cells(spark.createDataFrame([("=1+1",), (" @x",), ("ok",), ("-3",), (None,)], "v string")).collect()]
    assert got == ["'=1+1", "' @x", "ok", "'-3", None]


def test_catalog(spark):
    p = spark.createDataFrame([(1, " Card ", "card", [("Number", "12/99"), ("rarity", "Rare"), ("CardType", "Unit")])], "productId long, name string, cleanName string, extendedData array<struct<name:string,value:string>>")
    r = io.normalize_product(p).first()
    assert (r["name"], r["number"], r["rarity"], r["card_type"]) == ("Card", "12/99", "Rare", "Unit")
    f = spark.createDataFrame([("Rare", "foil"), ("Rare", "normal")], "rarity string, finish string")
    c = spark.createDataFrame([("s", 1, "Rare"), ("s", 2, "Odd")], "set_id string, card_id int, rarity string")
    assert sorted((r["card_id"], r["finish"]) for r in io.seed_catalog(c, f).collect()) == [(1, "foil"), (1, "normal"), (2, "unspecified")]


def test_nested_history(spark):
    body = json.dumps({"v": {"foil": [{"date": "2024-01-01", "price": 2.5}]}})
    df = spark.createDataFrame([("p", dt.datetime(2024, 1, 5), body)], "provider_id string, retrieved_at timestamp, body string")
    r = io.provider_history_records(df).first()
    assert (r["finish"], r["price"], r["observed_on"]) == ("foil", 2.5, dt.date(2024, 1, 1))


def test_pageviews(spark):
    items = [{"article": "A", "timestamp": f"202401{d:02d}00", "views": v} for d, v in ((1, 5), (2, -1), (3, 7), (3, 8), (9, 1))] + [{"article": "B", "timestamp": "2024010100", "views": 3}]
    df = spark.createDataFrame([(json.dumps({"items": items}),)], "body string")
    assert [(r["day"].day, r["views"]) for r in io.parse_pageviews(df, "A", "2024-01-01", "2024-01-05").collect()] == [(1, 5)]


def test_archive_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 3, 10, 1, "Normal", 1.5, 1.0), (dt.date(2024, 1, 1), 3, 11, 2, "Foil", None, 2.0)], "archive_date date, category_id int, group_id int, product_id long, subtype_name string, marketPrice double, lowPrice double")
    io.write_price_archive(df, str(tmp_path / "a"))
    rows = {r["product_id"]: (r["group_id"], r["subtype_name"], float(r["best"]["price"]), r["best"]["field"]) for r in io.read_price_archive(spark, str(tmp_path / "a"), [3]).collect()}
    assert rows == {1: (10, "Normal", 1.5, "market"), 2: (11, "Foil", 2.0, "low")}


def test_manifest_names_excluded_groups(spark):
    df = spark.createDataFrame([("c", 1, "x"), ("c", 1, "y")], "category string, grp int, v string")
    docs = io.publish_grouped_documents(df, ["category", "grp"], ["v"], ["v"])
    manifest = io.publish_manifest(docs, ["category", "grp"], spark.createDataFrame([("c", 1), ("c", 2), ("d", 3)], "category string, grp int"))
    assert {r["grp"]: (r["status"], r["rows"]) for r in manifest.collect()} == {1: ("published", 2), 2: ("excluded", 0), 3: ("excluded", 0)}
    assert {r["category"]: (r["published"], r["excluded"], r["rows"]) for r in io.manifest_totals(manifest, "category").collect()} == {"c": (1, 1, 2), "d": (0, 1, 0)}


def test_table_over_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(driver["driver"])
    except Exception:  # noqa: BLE001  no such database on the class path
        pytest.skip("Derby is not there")
    spark.range(100).selectExpr("id", "id * 2 as v").write.format("jdbc").options(url=url, dbtable="t", **driver).save()
    got = io.read_state_table(spark, url, "t", "id", 0, 100, parts=4, **driver)
    assert got.rdd.getNumPartitions() == 4 and got.agg({"v": "sum"}).first()[0] == 9900


def folded(sizes, most):
    """Parts by a fold over the rows."""
    parts, part, used = [], 0, 0
    for b in sizes:
        if used and used + b > most:
            part, used = part + 1, 0
        used += b
        parts.append(part)
    return parts, used


def test_runs_compose_to_the_fold():
    r = random.Random(6)
    for _ in range(300):
        sizes, most = [r.choice([1, 5, 30, 90, 130]) for _ in range(r.randint(1, 60))], r.choice([60, 100, 131])
        cuts = sorted(r.sample(range(1, len(sizes)), min(len(sizes) - 1, r.randint(0, 6))))
        part = used = 0
        for a, z in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            more, used = io.carried(used, *io.carry_table(np.array(sizes[a:z]), most))
            part += more
        parts, left = folded(sizes, most)
        assert (part, used) == (parts[-1], left)


def test_a_huge_group_is_spread_and_cut_as_by_the_fold(spark):
    r = random.Random(7)
    rows = [("big", i, "x" * r.choice([3, 20, 60, 300])) for i in range(5_000)] + [(g, i, "y" * (i % 90)) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id int, v string")
    docs = io.publish_grouped_documents(df, ["g"], ["id"], ["id", "v"], max_bytes=200).collect()
    got = {}
    for x in docs:
        assert x["rows"] == len(json.loads(x["body"])) and x["oversized"] == (x["bytes"] > 200)
        got.setdefault(x["g"], {})[x["part"]] = [y["id"] for y in json.loads(x["body"])]
        if x["oversized"]:
            assert x["rows"] == 1
    for g in ("big", "a", "b", None):
        own = [x for x in rows if x[0] == g]
        parts, _ = folded([len(json.dumps({"id": i, "v": v}, separators=(",", ":"))) + 1 for _, i, v in own], 200)
        want = {}
        for (_, i, _), p in zip(own, parts, strict=True):
            want.setdefault(p, []).append(i)
        assert got[g] == want and {x["parts_total"] for x in docs if x["g"] == g} == {len(want)}
    assert io.publish_grouped_documents(df.where("false"), ["g"], ["id"], ["id", "v"]).count() == 0
