"""The stages of the pipeline, each against a plain version on what the stage before it kept."""

import re

import brute
import corpus
import corpus_pipeline

from boardmill.llm.storage import written


def test_stages(spark, tmp_path):
    rows = corpus.rows(7, 80)
    texts = {i: t for i, t, *_ in rows}
    junk = [(10_000 + k, " ".join(f"w{k}x{j}$$$ |" for j in range(40)), "en", "src1", 0) for k in range(30)]
    item = "the quick brown foxes of the seventh benchmark passage jump over several lazy dogs today"
    leak = (20_000, "some words before " + item.upper() + " and some after it", "en", "src2", 0)
    docs = rows + junk + [leak]
    labels = [(i, int(i < 10_000), 0) for i, *_ in docs if i % 3]
    spark.createDataFrame(docs, corpus.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in df.collect()}
        df = written(stage(spark, df, str(tmp_path)), "stage")
        kept.append({r.doc_id for r in df.collect()})
        if name == "quality classifier":
            assert not kept[-1] & {j[0] for j in junk} and len(kept[-1] & texts.keys()) > 0.9 * len(texts)
        elif name == "exact dedup":
            first = {}
            for i, t in before.items():
                key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                first[key] = min(first.get(key, i), i)
            assert kept[-1] == set(first.values())
        elif name == "n-gram Jaccard join":
            assert kept[-1] == {c for _, _, c in brute.link_components(list(before.items()))}
        elif name == "benchmark decontamination":
            assert kept[-1] == before.keys() - {20_000}
        else:
            assert kept[-1] == before.keys() and "mix_position" in df.columns
    assert len(kept) == 5
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[-1])


def test_stages_keep_columns_that_clash(spark, tmp_path):
    extra = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n long"
    docs = spark.createDataFrame([(1, "a b c d e f", "en", None, 5, "s", "k", 1), (2, "a b c d  e f", "en", "x", 5, "s", "k", 2), (None, None, None, None, None, None, None, None), (2, "a b c d  e f", "en", "x", 5, "s", "k", 2)], extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.score, r.kept) for r in got) == [("1", "s", "k"), ("None", None, None)]
