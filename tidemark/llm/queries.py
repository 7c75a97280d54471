"""One query per operator over the whole test tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    compression,
    discriminant,
    filter_audit,
    mixing,
    near,
    pages,
    phrases,
    pieces,
    secret_scan,
    toxicity,
    urls,
    vectors,
)

BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
)
# Parts of the host names in the list of blocked hosts.
BLOCKED = "(^|[.-])(adult|bets|casino|pills)([.-]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_bands(table(spark, sf_dir, "documents"))


def op2_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents")).documents
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    host, _ = urls.host_and_path(F.col("url"))
    blocked = rows.select(host.alias("host")).distinct().where(F.col("host").rlike(BLOCKED))
    return urls.url_filter(rows, blocked, RULES)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_counts(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_template_text,
        op3_token_counts,
        op4_source_mix,
        op5_sentencepiece,
        op6_toxicity,
        op7_quality,
        op8_url_filter,
        op9_top_k,
        op10_near_duplicates,
        op11_secret_scan,
        op12_filter_audit,
        op13_phrases,
    )
}

ORACLE: dict[str, str] = {
    "op8_url_filter": rf"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
                regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM cut
        ), hosts AS (
            SELECT page_id, path,
                translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
            FROM parts
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
                    THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
                    THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
            END AS rule
            FROM hosts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, '{BLOCKED}') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM p
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op12_filter_audit": r"""
        WITH words AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
            FROM documents
        ), known AS (
            SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
            FROM labels GROUP BY doc_id
        ), masks AS (
            SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
            FROM words
        ), counts AS (
            SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
            FROM masks LEFT JOIN known USING (doc_id) GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), places AS (
            SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
        ), steps AS (
            SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS b,
                CAST(list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, 6) IF i < step]) AS BIGINT) AS e
            FROM places
        ), cases AS (
            SELECT c.*, filter_order, step, b, c.mask & b <> 0 AS fails, c.mask & coalesce(e, 0) <> 0 AS earlier
            FROM counts c, steps
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step,
            CAST(sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
            CAST(sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
            CAST(sum(CASE WHEN mask = b THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN fails AND NOT earlier THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
            CAST(sum(CASE WHEN fails AND NOT earlier THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
            CAST(sum(CASE WHEN fails THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
        FROM cases GROUP BY part, filter_order, step
    """,
    "op13_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), one AS (
            SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM words) GROUP BY ALL
        ), sizes AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang
        ), two AS (
            SELECT lang, x, y, count(*) AS f FROM (
                SELECT lang, unnest([w[i] FOR i IN range(1, len(w))]) AS x, unnest([w[i + 1] FOR i IN range(1, len(w))]) AS y
                FROM words)
            GROUP BY ALL HAVING count(*) >= 10
        ), three AS (
            SELECT lang, x, y, z, count(*) AS f FROM (
                SELECT lang, unnest([w[i] FOR i IN range(1, len(w) - 1)]) AS x,
                    unnest([w[i + 1] FOR i IN range(1, len(w) - 1)]) AS y,
                    unnest([w[i + 2] FOR i IN range(1, len(w) - 1)]) AS z
                FROM words)
            GROUP BY ALL HAVING count(*) >= 10
        ), longer AS (
            SELECT lang, x, y, max(f) AS f FROM (
                SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three)
            GROUP BY ALL
        ), cuts AS (
            SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, p.f AS l, q.f AS r, 1 AS k
            FROM two t JOIN one p ON t.lang = p.lang AND t.x = p.x JOIN one q ON t.lang = q.lang AND t.y = q.x
                LEFT JOIN longer g ON t.lang = g.lang AND t.x = g.x AND t.y = g.y
            WHERE g.f IS NULL OR 100 * g.f < 50 * t.f
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, p.f, q.f, 1
            FROM three t JOIN one p ON t.lang = p.lang AND t.x = p.x
                JOIN two q ON t.lang = q.lang AND t.y = q.x AND t.z = q.y
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, p.f, q.f, 2
            FROM three t JOIN two p ON t.lang = p.lang AND t.x = p.x AND t.y = p.y
                JOIN one q ON t.lang = q.lang AND t.z = q.x
        ), scores AS (
            SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
        ), best AS (
            SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
            phrase, a, l, r, n, score
        FROM best JOIN sizes USING (lang)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
}
