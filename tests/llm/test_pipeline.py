import random

import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))
    item, base = text(30), text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, text(120), "en", "src1", 0, "x") for i in range(20)]
    rows += [(30, base, "en", "src1", 0, "x"), (31, base, "en", "src2", 0, "y"), (32, " ".join(near), "en", "src1", 0, "x"), (33, f"{text(60)} {item} {text(60)}", "en", "src1", 0, "x"), (34, "too short", "en", "src1", 0, None)]
    rows += [(35, f'{text(80)} token = "0123456789abcdef0123456789abcdef" {text(10)}', None, None, None, None), (36, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scans", "mixing"]
    kept = docs
    want = [{*range(20), 30, 31, 32, 33, 35}, {*range(20), 30, 33, 35}, {*range(20), 30, 35}, {*range(20), 30, 35}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        assert {r[0] for r in kept.collect()} == ids
    masked = {r[0]: r for r in kept.collect()}[35]
    assert "0123456789abcdef" not in masked[1] and "[secret]" in masked[1] and masked[4] == len(masked[1])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= want[-1] and out


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id(spark, tmp_path):
    """One row of an id stays after near duplicates, whether its texts agree or not; rows without an id stay."""
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(60))
    a, b = text(), text()
    rows = [(1, a), (1, a), (2, b), (2, text()), (3, text()), (None, text()), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 3, None, None] and {r.text for r in got if r.doc_id == 1} == {a}


def test_run_leaves_its_result_alone(spark, tmp_path):
    import os

    from lexarium.llm.common import shared_dir

    base = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    spark.createDataFrame([(1, "word " * 90, "en", "s", 450)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(base)) - before) == 1
