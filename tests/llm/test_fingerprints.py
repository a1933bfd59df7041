import hashlib
import random

from pyspark.sql import functions as F

from samplewright.llm import common, components, pivots, simhash
from tests.llm.helpers import ROWS, group, near_groups, odd_docs, shingle_print

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_edited(got, rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        changed = t[:len(t) - q] + after[:q]
        a, b, c = (shingle_print(x, 2, lambda t: min(16, len(t))) for x in (t, changed, after))
        like = lambda x, y: 1 - (x ^ y).bit_count() / 64
        want.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", like(a, b), like(a, c)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_edited_fingerprints_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_edited(simhash.edited(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edited_fingerprints_of_odd_rows(spark):
    check_edited(simhash.edited(odd_docs(spark)).collect(), ROWS)
    check_edited(simhash.edited(odd_docs(spark, [(4, "the only text there is")])).collect(), [(4, "the only text there is")])
    assert simhash.edited(odd_docs(spark, [])).count() == 0


def test_edits_are_nearer_than_strangers(spark):
    row = simhash.edited(spark.read.parquet(f"{SF}/documents.parquet")).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert row[0] > 0.7 > 0.55 > row[1]


def test_buckets_are_ordered_and_whole(spark):
    rng = random.Random(1)
    ids = [rng.choice([rng.randint(-(1 << 62), 1 << 62), rng.randint(0, 50)]) for _ in range(500)] + [None]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    cuts = common.cut_points(df, "id", 16)
    for i, b in df.select("id", common.bucket_of(F.col("id"), cuts)).collect():
        assert b == (0 if i is None else sum(c <= i for c in cuts))


def test_search_within_a_radius(spark):
    rng = random.Random(2)
    prints = []
    for _ in range(60):
        x = rng.getrandbits(64)
        prints += [x] + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(4)]
    df = spark.createDataFrame([(signed(x),) for x in prints] + [(None,)], "fingerprint bigint")
    for radius in (0, 3):
        got = {tuple(r) for r in simhash.within_radius(df.limit(40), df, radius).collect()}
        assert got == {(signed(a), signed(b), (a ^ b).bit_count()) for a in prints[:40] for b in prints if (a ^ b).bit_count() <= radius}


        index = df.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
        for run in (3, 1024):
            counts = {tuple(r) for r in simhash.count_within(df.limit(40), index, radius, run=run).collect()}
            assert counts == {(signed(a), sum((a ^ b).bit_count() <= radius for b in prints)) for a in prints[:40]}


def test_searched_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, rows, every in ((docs, [(r.doc_id, r.text or "") for r in docs.collect()], 50), (odd_docs(spark), ROWS, 2), (odd_docs(spark, []), [], 2)):
        prints = [(i, shingle_print(t or "", 2, lambda term: min(16, len(term)))) for i, t in rows]
        want = [(str(i), f"{p:016x}", str(sum((p ^ o).bit_count() <= 3 for _, o in prints) - 1 if i is not None and i % every == 0 else None)) for i, p in prints]
        got = simhash.edited_and_searched(df, every=every).select("doc_id", "fingerprint", "n_within").collect()
        assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == sorted(want)


def test_links_sparse_and_dense_give_the_same_groups(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        prints |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)}
    prints = sorted(prints)
    want = near_groups(prints)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint bigint")
    place = {signed(x): i for i, x in enumerate(prints)}
    for dense in (1, 64):
        got = group(len(prints), [(place[r.a], place[r.b]) for r in pivots.links(df, dense).collect()])
        assert got == want


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)] + [(0, i) for i in range(1, 60)]
    df = spark.createDataFrame([*pairs, (None, 3), (5, 5)], "a bigint, b bigint")
    roots = group(361, pairs)
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert {tuple(r) for r in components.components(df).collect()} == {(i, roots[i]) for i in linked}
    assert components.components(df.where("a is null")).count() == 0


def plain_groups(rows):
    prints = [shingle_print(t) for _, t in rows]
    roots = near_groups(prints)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted((str(i), f"{p:016x}", str(least.get(r))) for (i, _), p, r in zip(rows, prints, roots))


def test_near_duplicates_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd_docs(spark), ROWS)):
        assert sorted(tuple(map(str, r)) for r in pivots.near_duplicates(df).collect()) == plain_groups(rows)
    assert pivots.near_duplicates(odd_docs(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = pivots.keep_first(docs)
    assert kept.columns == docs.columns
    groups = plain_groups(ROWS)
    assert kept.count() == len({p if c == "None" else c for _, p, c in groups})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({int(c) for i, _, c in groups if c != "None"})
