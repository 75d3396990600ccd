import random

import corpus_pipeline
from marketloom.llm import decontam, simhash


def tables(spark, path):
    r = random.Random(12)
    words = [f"tok{i}" for i in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, text(20)) for k in range(5)]
    docs = [(i, text(60)) for i in range(80)]
    docs += [(100 + i, docs[i][1].replace(" ", "  ")) for i in range(10)]  # equal after white space
    docs += [(200 + i, text(20) + " " + items[i][1] + " " + text(20)) for i in range(5)]  # leaks
    docs += [(300 + i, text(30) + " moron " + text(30)) for i in range(40)]  # toxic
    long = [text(900) for _ in range(5)]
    docs += [(400 + i, t) for i, t in enumerate(long)] + [(450 + i, t + " tail") for i, t in enumerate(long)]  # near copies
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(300 <= i < 400)) for i, _ in docs if i < 80 or 300 <= i < 330]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_run(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    near = {450 + i for i in range(5) if (simhash.fingerprint(dict(docs)[400 + i].encode()) ^ simhash.fingerprint(dict(docs)[450 + i].encode())).bit_count() <= 4}
    assert near
    assert set(out) == {*range(80), *range(400, 405), *({450 + i for i in range(5)} - near)}
    assert all(x["n_tokens"] == len(x["ids"]) > 0 for x in out.values())


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert decontam.WINDOW == 10


STAGE_ROWS = [(1, None), (2, ""), (None, "tok1 tok2 tok3 tok4 tok5 tok6"), (None, "another text of several words"), (9, "another text of several words"), (9, "tok9 tok8"), (9, "tok9 tok8"), (11, "word " * 300_000)]


def test_stages_on_nulls_repeats_and_long_texts(spark, tmp_path):
    tables(spark, str(tmp_path))
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, k1 int, __key string"
    docs = spark.createDataFrame([(*x, None, None, None, "x", 1, "y") for x in STAGE_ROWS], schema)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), str(tmp_path))
        out = stage(spark, docs, str(tmp_path))
        assert none.count() == 0
        if name == "bpe":
            assert out.count() == len(STAGE_ROWS)
            continue
        assert out.columns == docs.columns
        got = sorted((str(x["doc_id"]), len(x["text"] or "")) for x in out.collect())
        want = [("1", 0), ("2", 0), ("None", 29), ("None", 29), ("9", 29), ("9", 9), ("9", 9), ("11", 1_500_000)]
        if name.endswith("dedup"):
            want = [x for x in want if x != ("2", 0)]
            want.remove(("None", 29))
        assert got == sorted(want), name
