import pytest

import corpus_pipeline as pipeline

from .cases import no_docs, odd_docs


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        out.append((name, pipeline.cut(stage(spark, out[-1][1], sf_dir))))
    return out


def test_stages_keep_the_columns(stages):
    for name, df in stages[:-1]:
        assert df.columns == stages[0][1].columns, name
    assert [n for n, _ in stages[1:]] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_each_stage_only_takes_away(stages):
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for _, df in stages]
    for before, after in zip(ids, ids[1:]):
        assert after <= before
    assert len(ids[-1]) > 0.8 * len(ids[0]) and ids[-1] == ids[-2]


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = pipeline.run(spark, sf_dir)
    assert got.agg({"length": "sum"}).first()[0] == stages[-1][1].agg({"length": "sum"}).first()[0]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_rows(spark, sf_dir, name, stage):
    assert stage(spark, no_docs(spark), sf_dir).count() == 0
    assert stage(spark, odd_docs(spark), sf_dir).count() > 0
