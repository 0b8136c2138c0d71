"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def piece_model() -> str:
    """Where the public merge-type vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0).drop("payload")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), piece_model(), keep=["doc_id"])


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_components

    return near_components(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).drop("glob")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .sharding import shard_documents

    rows, smap = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(smap.version).alias("map_version"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_pieces": op4_pieces,
    "op5_hmm": op5_hmm,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_minhash": op8_minhash,
    "op9_url_filter": op9_url_filter,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_nearest": op12_nearest,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op6_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0),
        f AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM s),
        t AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM f) AS l ON len(w) >= n),
        o AS (SELECT r, t.n, p, item FROM (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM t) AS t JOIN f ON f.n = t.n AND f.k = t.k),
        h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM o) GROUP BY r),
        g AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(g.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)""",
    "op3_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p),
        b AS (SELECT page_id, n, first, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS d FROM f)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op12_nearest": r"""
        WITH c AS (SELECT DISTINCT vec_id, embedding AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)), lambda x, y: x + y)) AS score
              FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score, vec_id) AS rank FROM d)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: unicode(z)::BIGINT)),
                     lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h FROM t GROUP BY conv_id),
        f AS (SELECT c.conv_id AS c, t.i AS p, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h
              UNION ALL
              SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(b.n, 0)), r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 5),
        p AS (SELECT c, p AS d, strlen(x) AS size, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ORDER BY p) OVER (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING)) AS k FROM f
              UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        e AS (SELECT *, max(d) OVER (PARTITION BY c) = d AS ends, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM p),
        n AS (SELECT k, any_value(up) AS up, any_value(d) AS d, any_value(size) AS size, count(*) AS n, min(c) AS c, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends FROM e GROUP BY k),
        m AS (SELECT n.*, coalesce(b.kids, 0) AS kids FROM n LEFT JOIN (SELECT up, count(*) AS kids FROM n GROUP BY up) AS b ON b.up = n.k),
        s AS (SELECT p.k, sum((m.n - 1) * m.size)::BIGINT AS saved, count(*) FILTER (WHERE m.kids = 0) AS leaves FROM m JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY p.k)
        SELECT m.c AS conv_id, m.d AS depth, u.c AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, m.ends AS ends_sha256
        FROM m JOIN s USING (k) LEFT JOIN m AS u ON u.k = m.up""",
}
