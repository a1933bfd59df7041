import pytest
from pyspark.sql import functions as F

from samplewright.functions import text as t


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("kind,lab,date,n,want", [
    ("RNA", "KAM", "260527", 1, "RNA-260527KAM-1"), ("D.SEQ", "ENG", "260514", 42, "D.SEQ-260514ENG-42")])
def test_mint_uid(spark, kind, lab, date, n, want):
    assert one(spark, t.mint_uid(kind, lab, date, n)) == want


@pytest.mark.parametrize("uid,want", [("D.SEQ-1X-2", "D.SEQ"), ("NHP-220630FLY-1-PUB", "NHP"), ("plain", None)])
def test_uid_type(spark, uid, want):
    assert one(spark, t.uid_type("u"), u=uid) == want


@pytest.mark.parametrize("uid,want", [("RNA-260527KAM-12", 12), ("RNA-260527KAM-1-PUB", None), ("RNA-260528KAM-3", None)])
def test_uid_index(spark, uid, want):
    assert one(spark, t.uid_index("u", F.lit("RNA"), "KAM", "260527"), u=uid) == want


@pytest.mark.parametrize("cell,want", [
    (None, "empty"), ("", "empty"), (" ", "non_url"), ("https://Zenodo.org/x", "zenodo"), ("https://omero.x/zenodo.org", "zenodo"),
    ("my omero link", "omero"), ("https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi", "geo"), ("HTTP://x", "other_url"), ("file", "non_url")])
def test_url_type(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(t.url_type("c").alias("v")).first()["v"] == want


def test_strip_takes_all_white_space(spark):
    assert one(spark, t.strip("c"), c="\t a b\r\n ") == "a b"
    assert one(spark, t.split_list("c"), c=" a;; \tb ; ") == ["a", "b"]


@pytest.mark.parametrize("text,want", [
    ('{"a":"b","n":1}', {"a": "b", "n": "1"}), ("[1]", None), ("5", None), ('{"a":', None), ('{"a":"b"} tail', None),
    ('{"a":1},{"b":2}', None), ("{'a':1}", None), ("  ", None), ("{}", {})])
def test_payload(spark, text, want):
    assert one(spark, t.payload("c"), c=text) == want


def test_summary_and_markers(spark):
    assert one(spark, t.summary("c"), c="x" * 80) == "x" * 80
    assert one(spark, t.summary("c"), c="x" * 81) == "x" * 80 + "…"
    assert one(spark, t.marker_count("c", "***PLACEHOLDER"), c="***PLACEHOLDER ***PLACEHOLDER") == 2
    assert one(spark, t.sentinel_flag("c", "???"), c="what???") is True


@pytest.mark.parametrize("title,want", [
    ("lib_D389001", "D389001"), ("spot (D22-0123) left", "D22-0123"), ("a_D1_x", None), ("(D22-12)", None)])
def test_roster_id(spark, title, want):
    assert one(spark, t.roster_id("c"), c=title) == want


def test_image_urls(spark):
    assert one(spark, t.image_detail_url("https://h", "i", "d"), i=5, d=7) == "https://h/webclient/img_detail/5/?dataset=7"
    assert one(spark, t.image_detail_url("https://h", "i", "d"), i=5, d=0) == "https://h/webclient/img_detail/5/"
    assert one(spark, t.image_show_url("https://h", "i"), i=5) == "https://h/webclient/?show=image-5"


def test_candidates_in_order(spark):
    got = one(spark, t.candidate_ids("c", ["19", "20"], ["_Frzn"]), c="19-12_Frzn")
    assert got == ["19-12_Frzn", "19-12", "20-12"]


def test_headers_fold(spark):
    df = spark.createDataFrame([("a", "b")], "` UID` string, Sample_Type string")
    assert t.with_canonical_headers(df).columns == ["uid", "sampletype"]
    with pytest.raises(ValueError):
        t.with_canonical_headers(spark.createDataFrame([("a", "b")], "`UID ` string, uid string"))
