"""Readers and writers: price archives, typed history, panels, grouped documents, manifests, safe CSV."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import first_available_price, series_hash, tuple_hash

PRICES = ("lowPrice", "midPrice", "highPrice", "marketPrice", "directLowPrice")
MEMBER = "success boolean, results array<struct<productId:long,subTypeName:string," + ",".join(f"{p}:decimal(16,4)" for p in PRICES) + ">>"
#: .../<date>/<category>/<group>/prices, also as <name>=<value>
PATH = r"/(?:\w+=)?(\d{4}-\d{2}-\d{2})/(?:\w+=)?(\d+)/(?:\w+=)?(\d+)/[^/]+$"


#: Folders that are in use, innermost last; the first is the application's own.
_SPACES: list[tuple[str, str]] = []


def _path(spark: SparkSession, folder: str) -> tuple[object, object]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _new_space(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; on one machine, if none is named, a temporary one. It is deleted when
    the application ends, if not before."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = checkpoints.get() if checkpoints.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="marketloom-")
    folder = f"{named}/work-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    return folder


def work_folder(spark: SparkSession) -> str:
    """A new name below the innermost work space, or the application's."""
    app = spark.sparkContext.applicationId
    _SPACES[:] = [x for x in _SPACES if x[0] == app]
    if not _SPACES:
        _SPACES.append((app, _new_space(spark)))
    return f"{_SPACES[-1][1]}/{uuid.uuid4().hex}"


@contextmanager
def work_space(spark: SparkSession) -> Iterator[str]:
    """What is written by `settled` inside is deleted at the end, so results have to be written or collected before: for applications that live long."""
    work_folder(spark)  # the application's own comes first
    folder = _new_space(spark)
    _SPACES.append((spark.sparkContext.applicationId, folder))
    try:
        yield folder
    finally:
        _SPACES[:] = [x for x in _SPACES if x[1] != folder]
        path, files = _path(spark, folder)
        files.delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """The frame, written once as Parquet in a work folder and read from there: for what several later parts use."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The frame, written once, and marked for a broadcast only if it was counted as at most `most` rows: for the small side of a join whose size
    follows the data (groups, categories, dates)."""
    own = settled(df)
    return F.broadcast(own) if own.limit(most + 1).count() <= most else own


def write_price_archive(df: DataFrame, path: str) -> None:
    """One JSON document for each (archive_date, category_id, group_id) of rows with product_id, subtype_name and prices: what
    read_price_archive reads."""
    keys = ["archive_date", "category_id", "group_id"]
    prices = [F.col(p).cast("decimal(16,4)").alias(p) if p in df.columns else F.lit(None).cast("decimal(16,4)").alias(p) for p in PRICES]
    each = F.struct(F.col("product_id").alias("productId"), F.col("subtype_name").alias("subTypeName"), *prices)
    docs = df.groupBy(*keys).agg(F.to_json(F.struct(F.lit(True).alias("success"), F.array_sort(F.collect_list(each)).alias("results"))).alias("value"))
    docs.repartition(*keys).write.partitionBy(*keys).text(path)


def _members(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    part = lambda i, t: F.regexp_extract("file", PATH, i).cast(t)
    return raw.select("file", part(1, "date").alias("archive_date"), part(2, "int").alias("category_id"), part(3, "int").alias("group_id"), F.from_json("value", MEMBER, {"mode": "PERMISSIVE"}).alias("m"))


def _rows(members: DataFrame) -> DataFrame:
    each = members.select("archive_date", "category_id", "group_id", F.explode("m.results").alias("r"))
    prices = {p: F.col(f"r.{p}") for p in PRICES}
    return each.select(
        "archive_date",
        "category_id",
        "group_id",
        F.col("r.productId").alias("product_id"),
        F.trim("r.subTypeName").alias("subtype_name"),
        *[c.alias(p) for p, c in prices.items()],
        first_available_price(market=prices["marketPrice"], mid=prices["midPrice"], low=prices["lowPrice"], directLow=prices["directLowPrice"], high=prices["highPrice"]).alias("best"),
        series_hash(F.col("category_id"), F.col("group_id"), F.col("r.productId"), F.trim("r.subTypeName")).alias("series_sha256"),
        tuple_hash(**prices).alias("price_tuple_sha256"),
    )


def read_price_archive(spark: SparkSession, path: str, categories: Sequence[int], allowed_missing: Sequence[int] = ()) -> DataFrame:
    """Price facts of one document per (date, category, group) path; the path gives the keys.

    Fails if a document is not marked a success, a category is absent that may not be, nothing is left, or a series occurs twice in
    a document.
    """
    members = _members(spark, path).where(F.col("category_id").isin(*categories))
    bad = members.where(F.col("m").isNull() | ~F.coalesce(F.col("m.success"), F.lit(False))).select("file").take(3)
    if bad:
        raise ValueError(f"documents without success: {[r['file'] for r in bad]}")
    there = {r["category_id"] for r in members.select("category_id").distinct().collect()}  # at most the categories asked for
    if missing := set(categories) - there - set(allowed_missing):
        raise ValueError(f"categories without documents: {sorted(missing)}")
    rows = _rows(members)
    twice = rows.groupBy("archive_date", "category_id", "group_id", "product_id", "subtype_name").agg(F.count("*").alias("n")).where("n > 1").take(1)
    if twice:
        raise ValueError(f"a series occurs twice: {twice[0].asDict()}")
    if rows.isEmpty():
        raise ValueError("no price rows")
    return rows


def read_panel_members(spark: SparkSession, path: str, categories: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the lenient form; what is left out is counted by date, category and reason."""
    members = _members(spark, path).where(F.col("category_id").isin(*categories))
    broken = members.where(F.col("m").isNull() | F.col("m.results").isNull()).select("archive_date", "category_id", F.lit("invalid_member_json").alias("reason"))
    rows = _rows(members.where(F.col("m.results").isNotNull()))
    w = Window.partitionBy("archive_date", "category_id", "group_id", "product_id", "subtype_name").orderBy("price_tuple_sha256")
    reason = (
        F.when(F.col("product_id").isNull() | (F.col("product_id") <= 0), "invalid_product_id")
        .when(F.coalesce("subtype_name", F.lit("")) == "", "missing_subtype_name")
        .when(F.length("subtype_name") > 200, "subtype_name_too_long")
        .when(F.col("best.price").isNull(), "no_price_data")
        .when(F.col("best.price") < 0, "invalid_price")
        .when(F.row_number().over(w) > 1, "duplicate_series")
    )
    judged = rows.withColumn("reason", reason)
    rejects = judged.where("reason is not null").select("archive_date", "category_id", "reason").union(broken).groupBy("archive_date", "category_id", "reason").agg(F.count("*").alias("n"))
    return judged.where("reason is null").drop("reason"), rejects


def write_price_history(df: DataFrame, path: str, keys: Sequence[str] = ("category_id", "group_id", "product_id", "subtype_name"), partition: str = "archive_date") -> int:
    """Write sorted zstd Parquet by date, refusing to overwrite; the rows read back must be the rows written."""
    n = df.count()
    df.repartition(partition, *keys[:2]).sortWithinPartitions(partition, *keys).write.partitionBy(partition).option("compression", "zstd").mode("errorifexists").parquet(path)
    if (back := df.sparkSession.read.parquet(path).count()) != n:
        raise RuntimeError(f"{n} rows written, {back} read")
    return n


def read_price_history(spark: SparkSession, *paths: str) -> DataFrame:
    """History objects by column name; older ones may lack columns."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_weekly_panel(spark: SparkSession, path: str, price: str = "price", where: Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.where((F.col(price) > 0) & ~F.isnan(price) & (F.col(price) < float("inf")))


def publish_grouped_documents(df: DataFrame, keys: list[str], order: list[str], payload: list[str], max_bytes: int = 131_072) -> DataFrame:
    """(keys, part, parts_total, rows, bytes, oversized, body): JSON documents of a group's rows in order, none over max_bytes
    unless it is one row. A part closes when the next row would overflow it.

    Rows are dealt out by ranges of (keys, order), so a huge group is spread over tasks. Where a part ends depends on the bytes that the open part has when
    a range begins; each range gives that as a function (carry_table), these are composed in order, and the ranges number their rows with the bytes they begin with. Only
    the rows of one part come together, at most max_bytes or one row.
    """
    rows = df.select(*keys, F.struct(*order).alias("o"), F.to_json(F.struct(*payload)).alias("j")).withColumn("b", (F.octet_length("j") + 1).cast("long"))
    by = [F.col(c).asc_nulls_first() for c in keys]
    # rows that are equal in keys, order and size are dealt out together
    ranged = rows.repartitionByRange(*by, "o", "b").sortWithinPartitions(*by, "o", "b", "j")
    placed = settled(ranged.withColumns({"pid": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    runs = placed.groupBy(*keys, "pid").agg(F.min("place").alias("first"))
    by_range = placed.select(*keys, "pid", "place", "b").repartition("pid").sortWithinPartitions("pid", "place")
    kinds = {c: t for c, t in df.dtypes if c in keys}
    own = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, sizes in _runs(batches, keys):
            yield pd.DataFrame([[*key, *carry_table(np.array(sizes, np.int64), max_bytes)]], columns=[*keys, "pid", "bounds", "cuts", "left", "whole", "fresh_cuts", "fresh_left"])

    functions = settled(by_range.mapInPandas(tables, f"{own}, pid int, bounds array<long>, cuts array<long>, left array<long>, whole long, fresh_cuts long, fresh_left long"))

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, used = None, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(None if pd.isna(x) else x for x in row[: len(keys)])
                if key != now:
                    now, part, used = key, 0, 0
                out.append([*row[: len(keys) + 1], part, used])
                more, used = carried(used, *row[len(keys) + 1 :])
                part += more
            yield pd.DataFrame(out, columns=[*keys, "pid", "part", "used"])

    dealt = functions.repartition(*keys).sortWithinPartitions(*by, "pid")
    entries = dealt.mapInPandas(compose, f"{own}, pid int, part long, used long")
    # the state in which a range takes up a group goes before the group's first row in it
    marked = join_on(entries, runs, [*keys, "pid"]).select(*keys, "pid", F.col("first").alias("place"), F.lit(-1).cast("long").alias("b"), "part", "used")
    stream = placed.select(*keys, "pid", "place", "b", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("used")).unionByName(marked)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = used = 0
        for pdf in batches:
            places, parts = [], []
            for place, size, entry, taken in zip(pdf["place"], pdf["b"], pdf["part"], pdf["used"], strict=True):
                if size < 0:
                    part, used = entry, taken
                    continue
                if used and used + size > max_bytes:
                    part, used = part + 1, 0
                used += size
                places.append(place)
                parts.append(part)
            yield pd.DataFrame({"place": places, "part": parts})

    parts = stream.repartition("pid").sortWithinPartitions("pid", "place", "b").mapInPandas(number, "place long, part long")
    docs = placed.join(parts, "place").groupBy(*keys, "part").agg(F.count("*").alias("rows"), F.sum("b").alias("bytes"), F.array_sort(F.collect_list(F.struct("o", "b", "j"))).alias("d"))
    body = F.concat(F.lit("["), F.array_join(F.transform("d", lambda x: x["j"]), ","), F.lit("]"))
    made = settled(docs.select(*keys, F.col("part").cast("int").alias("part"), "rows", "bytes", (F.col("bytes") > max_bytes).alias("oversized"), body.alias("body")))
    totals = made.groupBy(*keys).agg((F.max("part") + 1).alias("parts_total"))
    return join_on(made, totals, keys).select(*keys, "part", "parts_total", "rows", "bytes", "oversized", "body")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join where all keys are the same, null with null."""
    own = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [left[k].eqNullSafe(own[f"__k_{k}"]) for k in keys]
    return left.join(own, same).drop(*[f"__k_{k}" for k in keys])


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[int]]]:
    """((keys, pid), sizes) of rows that come by pid and place."""
    now, sizes = None, []
    for pdf in batches:
        for row in pdf[[*keys, "pid", "b"]].itertuples(index=False):
            key = tuple(None if pd.isna(x) else x for x in row[:-1])
            if key != now:
                if sizes:
                    yield now, sizes
                now, sizes = key, []
            sizes.append(row[-1])
    if sizes:
        yield now, sizes


def carry_table(sizes: np.ndarray, most: int) -> tuple[list[int], list[int], list[int], int, int, int]:
    """What a run of rows does to an open part, as a function of its bytes: (bounds, cuts, left, whole, fresh_cuts, fresh_left).

    If the open part has more than bounds[i] bytes (the first such i), it closes before row i, and the run makes cuts[i] cuts in all and leaves left[i] bytes open. With no
    such i it only grows by `whole`. An empty part gives the fresh values. After its first cut a run goes on in one way for each row, taken from the end.
    """
    n, ends = len(sizes), np.cumsum(sizes)
    starts = ends - sizes
    # of a part that begins with row i: the row that closes it
    closing = np.maximum(np.searchsorted(ends, starts + most, "right"), np.arange(n) + 1)
    cuts, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = closing[i]
        cuts[i], left[i] = (1 + cuts[j], left[j]) if j < n else (0, ends[-1] - starts[i])
    reach = int(np.searchsorted(starts, most, "right"))  # a part that is open has a byte at least
    return (most - ends[:reach]).tolist(), (1 + cuts[:reach]).tolist(), left[:reach].tolist(), int(ends[-1]), int(cuts[0]), int(left[0])


def carried(used: int, bounds: Sequence[int], cuts: Sequence[int], left: Sequence[int], whole: int, fresh_cuts: int, fresh_left: int) -> tuple[int, int]:
    """(cuts, bytes left open) after a run that begins with `used` bytes."""
    if not used:
        return fresh_cuts, fresh_left
    over = np.flatnonzero(used > np.asarray(bounds))
    return (cuts[over[0]], left[over[0]]) if len(over) else (0, used + whole)


def publish_manifest(docs: DataFrame, keys: list[str], expected: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Per group: status, parts, rows, bytes and a hash over the parts' hashes; with `dates` (keys, day) also first and last.

    `expected` (keys) names all groups that there are: those without documents are excluded, with no part. Otherwise all are published.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", F.sha2("body", 256).alias("h"))))
    own = docs.groupBy(*keys).agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(parts, lambda x: x["h"]), "\n"), 256).alias("content_sha256"))
    if expected is not None:
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("parts", "rows", "bytes")}
        own = expected.select(*keys).distinct().join(own, keys, "left").withColumns(zero)
    if dates is not None:
        own = own.join(dates.groupBy(*keys).agg(F.min("day").alias("first"), F.max("day").alias("last")), keys, "left")
    return own.withColumn("status", F.when(F.col("parts") > 0, "published").otherwise("excluded"))


def manifest_totals(manifest: DataFrame, category: str) -> DataFrame:
    """Per category: groups published and excluded, parts, rows and bytes."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("published", "excluded")]
    return manifest.groupBy(category).agg(*counts, *[F.sum(c).alias(c) for c in ("parts", "rows", "bytes")])


def safe_cells(df: DataFrame) -> DataFrame:
    """String cells that a spreadsheet would run as a formula get a leading apostrophe."""
    guard = lambda c: F.when(F.col(c).rlike(r"^[\x00-\x20]*[=+\-@]|^[\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)
    return df.select(*[guard(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str) -> None:
    safe_cells(df).write.option("header", True).csv(path)


def panel_coverage(panel: DataFrame, category: str, day: str, variant: Sequence[str]) -> DataFrame:
    return panel.groupBy(category).agg(F.count_distinct(day).alias("dates"), F.count("*").alias("rows"), F.count_distinct(F.struct(*variant)).alias("variants"), F.min(day).alias("first"), F.max(day).alias("last"))


def archive_receipt(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per (date, category): groups, rows, rejects and a digest of the groups' digests."""
    per_group = rows.groupBy("archive_date", "category_id", "group_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("price_tuple_sha256")), "\n"), 256).alias("h"))
    r = per_group.groupBy("archive_date", "category_id").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))
    bad = rejects.groupBy("archive_date", "category_id").agg(F.sum("n").alias("rejects"))
    return r.join(bad, ["archive_date", "category_id"], "left").withColumn("rejects", F.coalesce("rejects", F.lit(0)))


def extended_value(data: Column, *names: str) -> Column:
    """The value of the first entry of an array of {name, value} whose name is one of names, whatever its case."""
    return F.trim(F.get(F.filter(data, lambda x: F.lower(x["name"]).isin(*[n.lower() for n in names])), F.lit(0))["value"])


def normalize_product(df: DataFrame) -> DataFrame:
    """Catalog products (productId, name, cleanName, extendedData) with number, rarity, card type and a semantic hash."""
    out = df.select(F.col("productId").alias("product_id"), F.substring(F.trim("name"), 1, 300).alias("name"), F.substring(F.trim("cleanName"), 1, 300).alias("clean_name"), extended_value(F.col("extendedData"), "Number").alias("number"), extended_value(F.col("extendedData"), "Rarity").alias("rarity"), extended_value(F.col("extendedData"), "Card Type", "CardType").alias("card_type"))
    return out.withColumn("semantic_sha256", F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("name", "clean_name", "number", "rarity", "card_type")]), 256))


def normalize_group(df: DataFrame) -> DataFrame:
    return df.select(F.col("groupId").alias("group_id"), F.substring(F.trim("name"), 1, 200).alias("name"), F.upper(F.trim("abbreviation")).alias("abbreviation"), F.to_date(F.substring("publishedOn", 1, 10)).alias("published_on"), F.coalesce("isSupplemental", F.lit(False)).alias("is_supplemental"))


def normalize_category(df: DataFrame) -> DataFrame:
    """Catalog categories (categoryId, name, displayName, popularity, isScannable) with trimmed names, a card flag and a semantic hash;
    rows without an id are dropped, of repeated ids the newest by modifiedOn stays."""
    one = df.where("categoryId is not null").groupBy("categoryId").agg(F.max_by(F.struct("name", "displayName", "popularity"), "modifiedOn").alias("w"))
    name, label = F.substring(F.trim("w.name"), 1, 200), F.substring(F.trim(F.coalesce("w.displayName", "w.name")), 1, 200)
    out = one.select(F.col("categoryId").cast("int").alias("category_id"), name.alias("name"), label.alias("display_name"), F.coalesce("w.popularity", F.lit(0)).alias("popularity"))
    out = out.withColumn("is_card", classify_card_category(F.col("display_name"), F.col("name")))
    return out.withColumn("semantic_sha256", F.sha2(F.concat_ws("\x1f", "name", "display_name"), 256))


def classify_card_category(label: Column, name: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    n = F.lower(F.coalesce(name, F.lit("")))
    return low.contains("card") | low.contains("single") | n.contains(" tcg") | n.contains(" ccg")


def parse_pageviews(df: DataFrame, article: str, first: str, last: str) -> DataFrame:
    """(day, views) from rows with a JSON text `body` of items {article, timestamp, views}; items out of the window or of another
    article, negative counts and repeated days are dropped."""
    items = df.select(F.explode(F.from_json("body", "items array<struct<article:string,timestamp:string,views:long>>")["items"]).alias("i"))
    day = F.to_date(F.substring("i.timestamp", 1, 8), "yyyyMMdd")
    rows = items.where(F.col("i.article") == article).select(day.alias("day"), F.col("i.views").alias("views")).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("views") >= 0))
    return rows.groupBy("day").agg(F.count("*").alias("__n"), F.first("views").alias("views")).where("__n = 1").drop("__n")


def seed_catalog(cards: DataFrame, finishes: DataFrame) -> DataFrame:
    """cards (set_id, card_id, rarity) by the finishes of their rarity (rarity, finish), else `unspecified`."""
    f = finishes.groupBy("rarity").agg(F.array_sort(F.collect_set("finish")).alias("f"))
    return cards.join(f, "rarity", "left").select("set_id", "card_id", "rarity", F.explode(F.coalesce("f", F.array(F.lit("unspecified")))).alias("finish"))


def provider_history_records(df: DataFrame, quality: float = 0.85) -> DataFrame:
    """Flat records from rows (provider_id, retrieved_at, body), body being JSON: vendor to finish to dated points."""
    schema = "map<string,map<string,array<struct<date:string,price:double>>>>"
    v = df.select("provider_id", "retrieved_at", F.explode(F.from_json("body", schema)).alias("vendor", "by_finish"))
    f = v.select("provider_id", "retrieved_at", "vendor", F.explode("by_finish").alias("finish", "points"))
    p = f.select("provider_id", "retrieved_at", "vendor", "finish", F.explode("points").alias("p"))
    return p.select("provider_id", "vendor", "finish", F.to_date("p.date").alias("observed_on"), F.col("p.price").alias("price"), F.col("retrieved_at").alias("available_at"), F.lit(quality).alias("quality"))


def read_state_table(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int = 16, **options: str) -> DataFrame:
    """A database table over JDBC, read in ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options).load()


def catalog_snapshot(tables: dict[str, DataFrame], keys: dict[str, str], eligible: dict[str, Column] | None = None) -> dict[str, DataFrame]:
    """For each table one row: rows, distinct keys and an order-free hash, so that two reads can be told to be of one state; with
    rules (reason to the condition under which a row is not eligible, reason names starting with the table's), how many rows each rule excludes."""
    rules = eligible or {}
    count = lambda n: [F.count_if(F.coalesce(c, F.lit(True))).alias(r.split(":", 1)[1]) for r, c in rules.items() if r.split(":", 1)[0] == n]
    return {n: df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content"), F.count_distinct(keys[n]).alias("keys"), *count(n)) for n, df in tables.items()}
