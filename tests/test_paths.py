import pytest
from pyspark.sql import functions as F

from samplewright.functions import paths as p

CASES = [
    ("Figure 1/intrav_sim_final.mph", ("comsol-model", "zenodo", "MDL", "intrav_sim_final.mph")),
    ("Figure 2/movie1.tif", ("excluded-movie", "skip", "", "")),
    ("Figure 2/velocity sims/Fused-dev-3.tif", ("velocity-sim", "zenodo", "D.SIM", "velsim-dev-3.tif")),
    ("Figure 3/abc dev 1.oib", ("imaging-raw", "omero", "D.IMG", "abc-dev-1_t.oib")),
    ("Figure 3/dev-1_0002/ROI3_02.oib", ("imaging-tile", "omero", "D.IMG", "dev-1_c0002_R3_02.oib")),
    ("Figure 5/231-day9-dev-1_0001/ROI1_01.oib.csv", ("quantification", "zenodo", "A.IMG", "231-day9-gel-dev-1_c0001_R1_01.csv")),
    ("Figure 6/ImgLib/a.png", ("storm-density", "zenodo", "A.IMG", "a.png")),
    ("Figure 7/Figure 3/x.oib", ("duplicate", "skip", "", "")),
    ("Figure 4/unknown.xyz", ("unknown", "skip", "", "")),
    ("Figure 4/231-day7-TC1000-dev2/016_01.oib", ("imaging-tile", "omero", "D.IMG", "231-day7-TC1000-dev2_c0001_T016_01.oib")),
]


def test_classify_cases(spark):
    df = p.classify_paths(spark.createDataFrame([(c[0],) for c in CASES], "path string"))
    got = {r["path"]: (r["category"], r["target_storage"], r["sampletype"], r["target_filename"]) for r in df.collect()}
    assert got == dict(CASES)


def test_unknown_reason(spark):
    row = p.classify_paths(spark.createDataFrame([("Figure 4/unknown.xyz",)], "path string")).first()
    assert row["skip_reason"] == "unrecognized pattern: Figure 4/unknown.xyz"


@pytest.mark.parametrize("stem,want", [
    ("D7 1000TCS__dev-1", "d7-1000TCs-dev-1"), ("  é_Egfp MVN ", "EGFP-MVN"), ("tc-1000 tc-10", "TC1000-TC10")])
def test_normalize_stem(spark, stem, want):
    assert spark.range(1).select(p.normalize_stem(F.lit(stem)).alias("v")).first()["v"] == want


@pytest.mark.parametrize("path,want", [
    ("Figure 2/a.csv", 2), ("Figure 2 - secondary/a.csv", 2), ("Figure x/a.csv", None), ("Source Data/a.csv", None),
    ("Figure 2/Figure3_D.CSV/a.csv", 2)])
def test_figure_of(spark, path, want):
    assert spark.range(1).select(p.figure_of(F.lit(path)).alias("v")).first()["v"] == want


def test_filter_on_result_does_not_copy_the_rules(spark):
    """A filter on a classification column must stay above it: the rules appear once in the plan."""
    df = p.classify_paths(spark.createDataFrame([("a",)], "path string")).where("category <> 'unknown'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("comsol-model") == 1
