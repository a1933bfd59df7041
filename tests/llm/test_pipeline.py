import corpus_pipeline
from samplewright.llm import packing, pivots, quality, secret_scan
from tests.llm.helpers import near_groups, odd_docs, shingle_print
from tests.llm.test_learned import plain_base

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "secret_scan", "packing"]
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{tmp_path}/{name}")
        out.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(df.columns == docs.columns for df in out[:4])
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    first = out[1].collect()
    assert {r.doc_id for r in first} == good
    roots = near_groups([shingle_print(r.text) for r in first])
    least = {}
    for r, root in zip(first, roots):
        least[root] = min(r.doc_id, least.get(root, r.doc_id))
    second = out[2].collect()
    assert sorted(r.doc_id for r in second) == sorted(least.values())
    before = {r.doc_id: r for r in second}
    for r in out[3].collect():
        assert r == before[r.doc_id] or (secret_scan.MASK in r.text and r.n_chars == len(r.text))
        assert not plain_base(r.text)
    assert {r.doc_id for r in out[4].collect()} == set(before)
    assert corpus_pipeline.run(spark, SF).count() == out[4].count()


def test_stages_take_odd_rows(spark, tmp_path):
    for k, df in enumerate((odd_docs(spark), odd_docs(spark, []))):
        columns = df.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).write.parquet(f"{tmp_path}/{k}-{name}")
            df = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert name == "packing" or df.columns == columns
        assert (df.count() > 0) == (k == 0)
