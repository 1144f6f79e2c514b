"""Queries of the operators: ``QUERIES`` and, where SQL can express one, ``ORACLES``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from depthkit.llm import ball_search, bpe, filter_audit, fixity, langid, lexical, lsh, minhash, packing, pii, quality, tokenfile, toxicity
from depthkit.llm.base import read

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_weak_pii(spark, sf_dir):
    return pii.find(read(spark, sf_dir, "documents"))


@query
def op2_merkle_fixity(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.damaged(pages, "url", "html"), "page_id", ["page_id", "url", "html"])


ORACLES["op2_merkle_fixity"] = """
WITH sides AS (
  SELECT page_id, url, html, 1 AS a, 0 AS b FROM pages
  UNION ALL
  SELECT page_id, url, CASE WHEN substr(sha256(url), 1, 2) = '00' THEN substr(html, 2) || '~' ELSE html END, 0,
         CASE WHEN substr(sha256(url), 1, 2) = '02' THEN 2 ELSE 1 END
  FROM pages WHERE coalesce(substr(sha256(url), 1, 2), '') <> '01'
), hashed AS (
  SELECT page_id, a, b, sha256(concat_ws('|',
    coalesce(strlen(page_id::VARCHAR) || ':' || page_id, '-'), coalesce(strlen(url) || ':' || url, '-'),
    coalesce(strlen(html) || ':' || html, '-'))) AS record_sha256
  FROM sides
)
SELECT page_id, record_sha256, sum(a)::BIGINT AS n_primary, sum(b)::BIGINT AS n_replica
FROM hashed GROUP BY 1, 2 HAVING sum(a) <> sum(b)
"""


@query
def op3_compression_bands(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.assess(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op5_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), word_vocabulary())


@query
def op6_language_crf(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op7_cross_polytope(spark, sf_dir):
    return lsh.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op8_bpe(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"), word_vocabulary())


@query
def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), fold_copies=True)


@query
def op10_token_file(spark, sf_dir):
    return tokenfile.round_trip(read(spark, sf_dir, "documents"), byte_vocabulary())


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM docs
), bits AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS bits
  FROM split
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1
), marked AS (
  SELECT part, bits, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM bits LEFT JOIN said USING (doc_id)
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS seq
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), places AS (
  SELECT filter_order, k.step::INT AS step, seq[k.step] AS bit, coalesce(list_sum(seq[1:k.step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k
), steps AS (
  SELECT part, filter_order, step, bit,
    count(*) FILTER (WHERE bits & (bit | before) = 0) AS kept,
    count(*) FILTER (WHERE bits & bit <> 0 AND bits & before = 0) AS removed,
    count(*) FILTER (WHERE bits & bit <> 0 AND bits & before <> 0) AS redundant,
    count(*) FILTER (WHERE bits = bit) AS unique_fails,
    count(*) FILTER (WHERE bits & bit <> 0 AND bits & before = 0 AND good = 1) AS good_lost,
    count(*) FILTER (WHERE bits & bit <> 0 AND bits & before = 0 AND bad = 1) AS toxic_lost
  FROM marked, places GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM steps
"""


@query
def op12_bag_search(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op12_bag_search"] = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS doc FROM documents
), sizes AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM cut WHERE len(terms) > 0),
held AS (
  SELECT doc, doc_id, 75 + (25 * len(terms) * nn) // ll AS m, unnest(terms) AS term FROM cut, sizes
), tf AS (SELECT doc, doc_id, m, term, count(*) AS tf FROM held GROUP BY ALL),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), q AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, sizes),
scored AS (
  SELECT item_id, doc, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""


@query
def op13_ball_tree(spark, sf_dir):
    return ball_search.top_k(read(spark, sf_dir, "embeddings"))


ORACLES["op13_ball_tree"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
