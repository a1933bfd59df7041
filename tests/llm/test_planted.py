"""Planted cases among the rows of the given tables: linked vectors, repeated and long pages, against the registered SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from samplewright.llm import queries, vectors, warc

SF = "/root/testdata/sf0.01"


def planted_vectors(spark, pairs, low, high, n=6000, seed=4):
    """Rows like the table's with pairs at cosines between two bounds: the table's own vectors, and partners turned away from them."""
    real = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()], float)
    rng = np.random.default_rng(seed)
    base = np.concatenate([real, rng.standard_normal((n, real.shape[1]))])
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((pairs, base.shape[1]))
    away -= (away * base[:pairs]).sum(1, keepdims=True) * base[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(low, high, (pairs, 1))
    x = np.concatenate([base, cosine * base[:pairs] + np.sqrt(1 - cosine**2) * away]).astype(np.float32)
    rows = [(i, (v * (1 + i % 3)).tolist(), 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(8), len(base)


def test_recall_of_the_default_plan(spark):
    df, first = planted_vectors(spark, 400, 0.9005, 0.906)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    found = [got[first + i].n_links > 0 and got[first + i].component_id == min(i, got[i].component_id) for i in range(400)]
    assert np.mean(found) >= 0.95 and len(got) == df.count()


def test_links_like_the_sql(spark):
    near, _ = planted_vectors(spark, 40, 0.905, 0.99, n=300)
    below, first = planted_vectors(spark, 40, 0.88, 0.895, n=300, seed=9)
    df = near.union(below.withColumn("vec_id", F.col("vec_id") + 100_000)).union(near.where("vec_id < 5").withColumn("vec_id", F.col("vec_id") + 500_000))
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.execute(queries.book.sql["op5_embedding_near_dedup"]).fetchall()
    got = [tuple(r) for r in vectors.near_duplicates(df, recall=0.99999).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in want) > 80


def test_plan_costs_little_more_than_the_rows():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(2 - 2 * (x @ x.T)[np.triu_indices(800, 1)])
    count, edges = np.histogram(d, 200, (0, 2))
    law = (edges[1:] + edges[:-1]) / 2, count / count.sum()
    cost = []
    for rows in (10_000, 50_000, 250_000):
        width, k, tables = vectors.plan(rows, law=law)
        near = vectors.same_cell(np.sqrt(0.2), width)
        met = rows * sum(s * vectors.same_cell(a, width)**k for a, s in zip(*law, strict=True) if s)
        assert 1 - (1 - near**k)**tables >= 0.97
        cost.append(rows * tables * (1 + met))
    assert np.log(cost[1] / cost[0]) / np.log(5) < 1.6 and np.log(cost[2] / cost[1]) / np.log(5) < 1.6


def test_repeated_and_long_pages_like_the_sql(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet")
    long = "<p>wide déjà vu 漢字</p>\r\n" * 5000
    more = spark.createDataFrame([(900_000, "u", long), (900_001, "u", long), (900_002, None, None), (900_003, "u", ""), (900_004, "u", long + "x" * 300_000)],
                                 "page_id bigint, url string, html string")
    df = real.select("page_id", "url", "html").union(more).union(real.limit(30).select(F.col("page_id") + 1_000_000, "url", "html"))
    df = df.repartition(6).cache()
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    want = con.execute(queries.book.sql["op8_warc"]).fetchall()
    got = [tuple(r) for r in warc.written_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[3] == "revisit" for r in want) > 20
