"""Each stage of the pipeline does what its operator decides, and the whole keeps clean documents."""

import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from srcloom.functions.shared import written  # noqa: E402
from srcloom.sources.tables import table  # noqa: E402


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    columns, labels = docs.columns, {r.doc_id: r for r in table(spark, folder, "labels").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, before, folder), f"test-{k}")
        kept, had = ids(docs), ids(before)
        assert kept <= had
        if name == "best-fit packing":
            assert kept == had
            continue
        assert docs.columns == columns
        clean = {i for i in had if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
        if name in ("quality classifier", "toxicity"):
            assert len(clean - kept) <= 0.03 * len(clean)
        if name == "line dedup":
            assert kept == had


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    table(spark, folder, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, folder, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_with_null_and_repeated_ids(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [
        (None, text("unique")),
        (None, text("shared")), (7, text("shared")), (8, text("shared") + " more"),
        (None, text("nameless")), (None, text("nameless")),
        (3, text("repeated")), (3, text("repeated")), (3, text("repeated")), (4, text("repeated")),
        (5, text("one")), (5, text("other")),
        (6, ""), (6, ""), (9, None), (None, ""), (None, ""),
    ]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = [(None, text("unique")), (7, text("shared")), (None, text("nameless")), (3, text("repeated")), (5, text("one")), (5, text("other")), (6, ""), (9, None), (None, ""), (None, "")]
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def test_packing_stage_gives_the_ids(spark, folder):
    rows = corpus_pipeline.packing_stage(spark, table(spark, folder, "documents"), folder).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_columns_of_any_name_come_back_as_they_were(spark, folder):
    names = ["_every", "_goes", "_judged", "_a", "_b", "_n", "score", "predicted", "n_dropped", "n_lines", "component", "fp", "_carried", "a.b", "row"]
    docs = table(spark, folder, "documents")
    extra = docs.select("*", *[F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, folder)
        assert out.columns == extra.columns, name
        rows = out.collect()
        assert len(rows) > docs.count() // 2, name
        for r in rows:
            assert list(r[len(docs.columns) :]) == [f"{k}:{r.doc_id}" for k in range(len(names))], name
