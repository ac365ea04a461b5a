"""Edge cases of the pipeline's stages: odd rows, clashing columns, nothing to learn from."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
LONG = "the line goes on and on, and then some more of it. " * 8000


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(9001, None), (9002, ""), (9003, "12 !!"), (9004, LONG), (9005, "Zqxj " * 400), (9006, "Avec."), (None, "A line of words, and then another one of them."), (9007, "Dup of it, and of it."), (9007, "Dup of it, and of it.")]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], docs.schema)
    # columns of the names that stages give to their own results
    return docs.union(extra).withColumns({"score": F.lit(-5.0), "Lang_Pred": F.lit("mine"), "predicted": F.lit(7), "grams": F.lit("g"), "n_tokens": F.lit("t"), "root": F.lit("r")})


def test_every_stage_keeps_the_table_as_it_is(spark, odd):
    now = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut_lineage(stage(spark, now, SF))
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        assert out.where("score <> -5.0 OR Lang_Pred <> 'mine' OR predicted <> 7 OR grams <> 'g' OR n_tokens <> 't' OR root <> 'r'").isEmpty(), name
        assert out.exceptAll(now).isEmpty(), name  # rows of the stage before, none changed
        now = out
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.count() == now.count() and {"ids", "ids_sha256", "decoded_sha256"} <= set(last.columns)
    # what the encoding gives back is the text
    digests = now.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d"))
    assert last.select("decoded_sha256").exceptAll(digests).isEmpty()


def test_language_stage_rejects(spark, odd):
    kept = corpus_pipeline.in_a_language(spark, odd, SF).where("doc_id > 9000 OR doc_id IS NULL").collect()
    # no letter, or long and like no language; a short text stays however small its cosine is
    assert sorted([r.doc_id for r in kept], key=str) == [9004, 9006, 9007, 9007, None]


def test_language_stage_leaves_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.in_a_language(spark, docs, "/root/testdata/sf0.1").select("doc_id")
    gone = docs.join(kept, "doc_id", "left_anti").select("doc_id")
    assert 0 < gone.count() < 0.002 * docs.count()
    assert gone.join(labels.where("quality = 1"), "doc_id").isEmpty()


def test_no_labels_and_no_rows(spark, odd, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"all-{t}.parquet")
    spark.read.parquet(str(tmp_path / "all-labels.parquet")).limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(str(tmp_path / "all-benchmark.parquet")).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.of_quality(spark, odd, str(tmp_path)).exceptAll(odd).isEmpty()
    assert corpus_pipeline.of_quality(spark, odd, str(tmp_path)).count() == odd.count()
    now = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0
