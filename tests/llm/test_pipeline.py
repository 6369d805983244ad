"""The pipeline's stages, one after the other, on a small table."""

import os
import random

import pytest

import corpus_pipeline

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "sa", "ti", "ro") for b in ("ban", "dor", "fil", "gum", "hest", "jin")]


@pytest.fixture
def folder(spark, tmp_path):
    pick = random.Random(1)
    line = lambda n: " ".join(pick.choice(WORDS) for _ in range(n))
    clean = ["\n".join(line(30) for _ in range(5)) for _ in range(60)]
    bench = [line(30) for _ in range(3)]
    toxic = [" ".join(w if pick.random() > 0.1 else "vequil" for w in line(150).split()) for _ in range(40)]
    texts = clean + toxic + [clean[3], clean[4].replace(clean[4].split()[7], "changed", 1), bench[0] + " " + line(5), None, ""]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(0, 100, 2)] + [(i, 1, int(60 <= i < 100)) for i in range(1, 100, 4)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        kept[name] = [r["doc_id"] for r in docs.collect()]
    clean, toxic = set(range(60)), set(range(60, 100))
    assert len(clean - set(kept["quality_classifier"])) <= 1 and len(toxic & set(kept["quality_classifier"])) <= 1
    assert sorted(kept["line_dedup"]) == sorted(kept["quality_classifier"])
    assert len({100, 103, 104} & set(kept["simhash_near_dedup"])) == 1  # lines of 100 all went: one of the empty texts stays
    assert 102 not in kept["benchmark_decontamination"]
    assert set(kept["best_fit_packing"]) == set(kept["benchmark_decontamination"])


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).toPandas()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024
    assert len(rows) > 40
    assert corpus_pipeline.ORACLE_SQL is None and os.path.isdir(folder)


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.withColumn("doc_id", docs["doc_id"] + 7).withColumn("__kn_rk", docs["lang"])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, odd.limit(0), folder)
        assert empty.count() == 0 and (i == 4 or empty.columns == odd.columns)


def test_without_labels_and_benchmark_all_pass(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"none/{name}.parquet"))
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.benchmark_decontamination):
        assert stage(spark, docs, str(tmp_path / "none")).count() == docs.count()
