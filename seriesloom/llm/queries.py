"""Registered queries of this subpackage, each over its whole tables, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import exact_dedup, language_id, language_model, merkle, packing, pii, ranked_search, sentencepiece_codec, sharding, simhash, suffix_dedup, topk, toxicity
from seriesloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_sharding")
def op1(spark, folder):
    return sharding.balanced_digest(table(spark, folder, "documents"), 8)


@query("op2_packing")
def op2(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), path, 2048)


@query(
    "op3_topk",
    """
    WITH v AS (
        SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
        WHERE embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op3(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query(
    "op4_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op4(spark, folder):
    return exact_dedup.marks(table(spark, folder, "documents"))


@query("op5_sentencepiece")
def op5(spark, folder):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.digest(table(spark, folder, "documents"), path)


@query("op6_simhash")
def op6(spark, folder):
    return simhash.digest(table(spark, folder, "documents"), words=3, radius=2)


@query(
    "op7_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    k AS (SELECT doc_id, 256 * c AS origin, substr(h, 512 * c + 1, 710) AS p FROM d, unnest(range(0, (length(h) + 511) // 512)) AS u(c)),
    e AS (
        SELECT doc_id, origin + i AS b, substr(p, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 200 <= length(p) THEN md5(substr(p, 2 * i + 1, 200)) END AS win
        FROM k, unnest(range(0, least(256, length(p) // 2))) AS u(i)
    ),
    r AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, b) > 1 AS again FROM e),
    g AS (
        SELECT doc_id, b, x, coalesce(
            bool_or(again) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone
        FROM r
    ),
    o AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY b) AS opens FROM g),
    m AS (
        SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
            sha256(unhex(coalesce(string_agg(x, '' ORDER BY b) FILTER (NOT gone), ''))) AS kept_sha256
        FROM o GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
        coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
    FROM d LEFT JOIN m USING (doc_id)
    """,
)
def op7(spark, folder):
    return suffix_dedup.removals(table(spark, folder, "documents"), 100).drop("spans")


@query("op8_language_model")
def op8(spark, folder):
    return language_model.digest(table(spark, folder, "documents"))


@query("op9_language_id")
def op9(spark, folder):
    return language_id.digest(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark, folder):
    return toxicity.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op11_merkle_manifest",
    """
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS n, doc_id, lang,
            coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
            || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
            CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS given,
            CASE WHEN text IS NULL THEN '-'
                ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS altered,
        FROM documents
    ),
    crc_step AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i)
        UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_step WHERE k < 8),
    crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
    crc AS (
        SELECT doc_id, xor(list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
            lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS crc
        FROM (SELECT DISTINCT doc_id FROM d), crc_table
    ),
    leaves AS MATERIALIZED (
        SELECT n, doc_id, lang, sha256(head || given) AS leaf,
            sha256(head || CASE WHEN coalesce(crc, 0) % 3 = 0 THEN altered ELSE given END) AS offered
        FROM d LEFT JOIN crc USING (doc_id)
    ),
    placed AS MATERIALIZED (
        SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
        FROM leaves
    ),
    nodes AS (
        SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS alive FROM placed
        UNION ALL
        SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(alive) + 7) // 8
        FROM nodes WHERE alive > 1 GROUP BY tree, level, place // 8
    ),
    kept AS MATERIALIZED (SELECT * FROM nodes),
    subroots AS MATERIALIZED (SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot FROM kept GROUP BY tree),
    upper AS (
        SELECT 0 AS level, tree AS place, subroot AS digest, count(*) OVER () AS alive FROM subroots
        UNION ALL
        SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(alive) + 7) // 8
        FROM upper WHERE alive > 1 GROUP BY level, place // 8
    ),
    kept_upper AS MATERIALIZED (SELECT * FROM upper),
    top AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM kept_upper),
    beside AS MATERIALIZED (
        SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
            coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
        FROM kept a JOIN kept b ON a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8 GROUP BY ALL
    ),
    beside_upper AS MATERIALIZED (
        SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
            coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
        FROM kept_upper a JOIN kept_upper b ON a.level = b.level AND a.place // 8 = b.place // 8 GROUP BY ALL
    ),
    sides AS MATERIALIZED (
        SELECT p.n, b.level, b.l, b.r FROM placed p JOIN subroots s USING (tree)
        JOIN beside b ON b.tree = p.tree AND b.level < s.height AND b.place = p.place // CAST(pow(8, b.level) AS BIGINT)
        UNION ALL
        SELECT p.n, s.height + b.level, b.l, b.r FROM placed p JOIN subroots s USING (tree), top t
        JOIN beside_upper b ON b.level < t.height AND b.place = p.tree // CAST(pow(8, b.level) AS BIGINT)
    ),
    proofs AS (SELECT n, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256, count(*) AS steps FROM sides GROUP BY n),
    folds AS (
        SELECT n, 0 AS level, offered AS digest FROM placed
        UNION ALL
        SELECT f.n, f.level + 1, sha256(s.l || f.digest || s.r) FROM folds f JOIN sides s ON s.n = f.n AND s.level = f.level
    ),
    folded AS (SELECT n, arg_max(digest, level) AS folded_root FROM folds GROUP BY n)
    SELECT p.doc_id, p.leaf, s.subroot, t.root, coalesce(r.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.root AS verified
    FROM placed p JOIN subroots s USING (tree) JOIN folded f USING (n) LEFT JOIN proofs r USING (n), top t
    """,
)
def op11(spark, folder):
    return merkle.digest(table(spark, folder, "documents"))


@query(
    "op12_ranked_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
    ),
    s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
    q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ),
    p AS (SELECT nr, unnest(terms) AS term FROM d),
    f AS (SELECT nr, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM f, s GROUP BY term
    ),
    m AS (SELECT nr, doc_id, 100 - 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM d, s),
    c AS (
        SELECT q.item_id, m.nr, m.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m))) AS BIGINT) AS score
        FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (nr) GROUP BY ALL
    ),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
    """,
)
def op12(spark, folder):
    return ranked_search.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 50)


@query("op13_personal_data")
def op13(spark, folder):
    return pii.digest(table(spark, folder, "documents"))
