"""The registered query of each operator, over its whole table, and SQL where SQL can state it."""

from __future__ import annotations

from samplewright.llm import bpe, languages, packing, phrases, pivots, quality, secret_scan, simhash, token_counts, token_files, vectors, warc, whitening
from samplewright.llm.common import table
from samplewright.plans.base import Book

book = Book()


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is on this machine; every operator takes the path as a parameter."""
    from public_tokenizers import path

    return path(name)


@book.query()
def op1_document_fingerprints(spark, sf_dir):
    return simhash.edited_and_searched(table(spark, sf_dir, "documents"))


@book.query()
def op2_simhash_near_dedup(spark, sf_dir):
    return pivots.near_duplicates(table(spark, sf_dir, "documents"))


@book.query()
def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@book.query()
def op4_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@book.query("""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
         good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_dot_product(e, e) > 0),
         unit AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM good),
         link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
         reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
         least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
         deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
    SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, least(v.vec_id, coalesce(least.y, v.vec_id)) AS component_id,
           v.vec_id = least(v.vec_id, coalesce(least.y, v.vec_id)) AS kept
    FROM v LEFT JOIN deg ON deg.x = v.vec_id LEFT JOIN least ON least.x = v.vec_id""")
def op5_embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@book.query()
def op6_token_id_files(spark, sf_dir):
    return token_files.written_and_read(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end=1)


@book.query()
def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@book.query("""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
         d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS digest FROM p),
         w AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS most FROM d)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 1000 AND page_id <> most THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id <> most THEN most END AS refers_to
    FROM w""")
def op8_warc(spark, sf_dir):
    return warc.written_and_read(table(spark, sf_dir, "pages"))


@book.query()
def op9_bpe_encoding(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@book.query()
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end=2, grain=packing.GRAIN)


@book.query(r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
         piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
         w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM piece),
         g AS (SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
               UNION ALL SELECT lang, s, array_to_string(ws[i:i + s - 1], ' ') FROM (
                   SELECT lang, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM w, (VALUES (2), (3), (4)) v(s) WHERE len(ws) >= s)),
         f AS (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
         total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
         c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= 30),
         k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
         s AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, l.n AS l, r.n AS r, (k.a::HUGEINT * 2000000 // (l.n::HUGEINT + r.n))::BIGINT AS score
               FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k.k], ' ')
                      JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k.k + 1:k.size], ' ')),
         m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
         inner_ AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM (
                        SELECT lang, ws, a, j, unnest(range(1, size - j + 2)) AS i FROM c, (VALUES (2), (3)) v(j) WHERE size > j) GROUP BY ALL),
         o AS (SELECT m.* FROM m LEFT JOIN inner_ i USING (lang, phrase)
               WHERE m.o = 1 AND (i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * m.a::HUGEINT)),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op11_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@book.query()
def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return languages.predict(docs, languages.fit(docs))


@book.query()
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
