"""The corpus pipeline's stages on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def test_stages_take_effect(spark, tmp_path):
    item, base = words(40, 1), words(100, 2)
    docs = [(i, " ".join(words(60, 100 + i) + (["vile"] if i % 4 == 0 else []))) for i in range(200)]
    docs += [(500, " ".join(base)), (501, " ".join(base)), (502, " ".join(base[:-1] + ["x"])), (503, " ".join(words(30, 3) + item)),
             (504, " ".join(words(30, 4)) + " me@here.example"), (505, None), (506, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == df.columns, name
        kept.append({r.doc_id for r in now.collect()})
    clean = {i for i in range(200) if i % 4}
    assert kept[0] == clean | {500, 501, 502, 503, 504, 505, 506}
    assert kept[1] == clean | {500, 503, 504, 505}
    assert kept[2] == kept[3] == clean | {500, 504, 505}
    assert now.where("doc_id = 504").first().text.endswith(" [EMAIL]")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept[3]
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_stages_with_an_empty_table_and_clashing_names(spark, tmp_path, empty):
    rows = [(1, " ".join(words(40, 1)), "s"), (2, " ".join(words(40, 1)), None), (2, " ".join(words(40, 1)), None), (None, None, None), (3, "", "s"),
            (4, "a@b.c", "s"), (5, " ".join(words(30_000, 9)), "s")]
    names = ["key", "row", "p", "found", "terms", "text_key", "class_key", "id", "begin"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    data = {"documents": ([(i, t, "en", s, len(t or ""), *names) for i, t, s in rows], schema),
            "labels": ([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"),
            "benchmark": ([(0, " ".join(words(20, 30))), (1, None)], "item_id long, text string")}
    for name, (values, types) in data.items():
        spark.createDataFrame([] if name == empty else values, types).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns, name
        assert all(tuple(r)[5:] == tuple(names) for r in now.collect()), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    if empty == "documents":
        assert not pieces
    elif empty == "labels":     # no label, no toxic document; one of the equal ones stays
        assert {r.doc_id for r in pieces} == {1, 3, 4, 5}
