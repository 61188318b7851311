"""The registered queries of this package, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from cdcflow.llm import centroids, conversations, extraction, hostrules, langid, mixing, packing, quality, secrets, simhash, syncmers, topk, warc
from cdcflow.llm.common import ship
from cdcflow.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, oracle: str | None = None):
    """Register ``fn(frame of the table, folder)``."""

    def add(fn: Callable[[DataFrame, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark.read.parquet(f"{folder}/{table}.parquet"), folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query(
    "op1_warc",
    "pages",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
    h AS (SELECT digest, max(page_id) AS home FROM d WHERE n >= 1000 GROUP BY digest)
    SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
           CASE WHEN home IS NULL OR home = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN home <> page_id THEN home END AS refers_to
    FROM d LEFT JOIN h ON d.digest = h.digest AND d.n >= 1000
    """,
)
def op1(pages: DataFrame, folder: str) -> DataFrame:
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_simhash", "documents")
def op2(docs: DataFrame, folder: str) -> DataFrame:
    found = simhash.near_duplicates(docs, shingle=3, bits=64, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_secrets", "documents")
def op3(docs: DataFrame, folder: str) -> DataFrame:
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.secrets(docs).select(
        "doc_id",
        *(of(kind) for kind in secrets.KINDS),
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query("op4_language", "documents")
def op4(docs: DataFrame, folder: str) -> DataFrame:
    return langid.identified(docs)


@query(
    "op5_mixing",
    "documents",
    r"""
    WITH d AS (
        SELECT doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
        FROM documents),
    s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
        FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS weight, 3 * source_size AS most FROM s),
    -- filling up: with the k sources of the smallest most / weight stopped, the others share the rest
    o AS (SELECT *, row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, r) AS place FROM w),
    l AS (
        SELECT k.place AS stops,
               CAST(CAST(sum(o.source_size) - sum(CASE WHEN o.place < k.place THEN o.most ELSE 0 END) AS BIGINT) AS DOUBLE)
               / CAST(CAST(sum(CASE WHEN o.place >= k.place THEN o.weight ELSE 0 END) AS BIGINT) AS DOUBLE) AS level
        FROM o, o AS k GROUP BY k.place),
    f AS (
        SELECT max(level) FILTER (fits) AS level FROM (
            SELECT stops, level, level * weight <= CAST(most AS DOUBLE) AS fits FROM l JOIN o ON place = stops
            QUALIFY row_number() OVER (PARTITION BY fits ORDER BY stops) = 1)),
    t AS (SELECT source, source_size, r, least(CAST(most AS DOUBLE), f.level * weight) AS target FROM o, f),
    c AS (
        SELECT doc_id, size, source_size, target, floor(target + 0.5) AS goal,
               coalesce(sum(size) OVER (PARTITION BY r ORDER BY substr(k, 1, 15), k, doc_id, size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - source_size - before))
                + greatest(0, least(size, goal - 2 * source_size - before)) AS BIGINT) AS taken
    FROM c
    """,
)
def op5(docs: DataFrame, folder: str) -> DataFrame:
    sizes = written(docs.select(F.col("doc_id"), F.col("source"), mixing.words("text").alias("n_words"), mixing.digest().alias("place")))
    mixed, names = mixing.mixed(sizes, size="n_words", order="place")
    # What the mix leaves out has no position; its ids keep it from being one range.
    position = F.col(names["position"])
    return mixed.sort(position.asc_nulls_last(), "doc_id").select("doc_id", *(names[c] for c in ("size", "source_size", "target", "taken")))


@query(
    "op6_top_k",
    "embeddings",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id))
    WHERE rank <= 10
    """,
)
def op6(embeddings: DataFrame, folder: str) -> DataFrame:
    return topk.embedding_neighbours(embeddings, k=10, every=100)


@query("op7_extraction", "pages")
def op7(pages: DataFrame, folder: str) -> DataFrame:
    return extraction.extracted(pages)


@query("op8_packing", "documents")
def op8(docs: DataFrame, folder: str) -> DataFrame:
    return packing.packed(docs)


@query("op9_syncmers", "documents")
def op9(docs: DataFrame, folder: str) -> DataFrame:
    return syncmers.edited_pairs(docs).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        syncmers.printed(F.col("anchors")).alias("fingerprint"),
        syncmers.printed(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "next_id",
        "next_chars",
    )


@query("op10_quality", "documents")
def op10(docs: DataFrame, folder: str) -> DataFrame:
    labels = docs.sparkSession.read.parquet(f"{folder}/labels.parquet")
    return quality.sampled(docs, labels).drop("mark")


def _hosts_sql(limit: float) -> str:
    """Counts of each document, then rates of each host by rule, shrunk by the prior that moments give."""
    rules = {
        "short": "n_words < 20",
        "repetitive": "100 * n_repeat_words > 30 * n_words",
        "symbols": "10 * n_symbols > n_words",
        "lines": "100 * n_dup_lines > 30 * n_lines",
    }
    rated = " UNION ALL ".join(f"SELECT source, '{r}' AS rule, count(*) AS n, count(*) FILTER ({c}) AS f FROM q GROUP BY source" for r, c in rules.items())
    return rf"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT r, list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT r, i, w[i : i + 7] AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
    o AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    p AS (SELECT r, count(DISTINCT i + k) AS n FROM o, range(8) AS x(k) GROUP BY r),
    q AS MATERIALIZED (
        SELECT doc_id, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
               coalesce(p.n, 0) AS n_repeat_words
        FROM d JOIN l USING (r) LEFT JOIN p USING (r)),
    h AS (SELECT * FROM ({rated}) WHERE source IS NOT NULL),
    m AS (
        SELECT rule, count(*) - 1 AS others, sum(n) AS rows, sum(f) / sum(n) AS mean, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread,
               sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM h GROUP BY rule),
    s AS (
        SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND room > 0
            THEN greatest(0, least(1, (spread / (mean * (1 - mean)) - others) / room)) ELSE 0 END AS share FROM m),
    v AS (
        SELECT source, bool_and(rate - CASE WHEN share > 0 THEN sqrt(rate * (1 - rate) / (n + 1 / share)) ELSE 0 END <= {limit}) AS host_kept
        FROM (SELECT *, CASE WHEN share > 0 THEN (f + (1 / share - 1) * mean) / (n + (1 / share - 1)) ELSE mean END AS rate
              FROM h JOIN s USING (rule)) GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(host_kept, TRUE) AS kept
    FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q) LEFT JOIN v USING (source)
    """


@query("op11_host_rules", "documents", _hosts_sql(0.5))
def op11(docs: DataFrame, folder: str) -> DataFrame:
    return hostrules.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(
    "op12_conversations",
    "conversations",
    r"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    src AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    way AS (
        SELECT src.*, xor(list_reduce([4294967295] || list_transform(str_split(name, ''), lambda b: CAST(ascii(b) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS way FROM src, crc),
    hurt AS (
        SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
               CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM way, range(2) AS c(copy) WHERE way <> 0 AND (copy = 0 OR way = 3)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || text)) AS k FROM hurt),
    f AS (
        SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM n),
    step(p, i, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
    put(p, q, c, a) AS (
        VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (3, 2, 2, 'I'), (2, 3, 2, 'I'),
               (0, 3, 4, 'II'), (1, 3, 4, 'II')),
    edit AS (
        SELECT conv_id, k, p, p AS q, 3 AS c, 'D' AS a FROM f, (SELECT DISTINCT p FROM put)
        UNION ALL
        SELECT conv_id, k, p, q, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END + CASE e WHEN 'R' THEN 2 ELSE 0 END, e
        FROM f, step, (VALUES ('K'), ('R')) AS v(e)
        WHERE fault NOT IN ('blank', 'duplicate') AND (CASE e WHEN 'K' THEN f.i = step.i ELSE step.i <> 's' END)),
    way_on AS (SELECT conv_id, k, edit.p, put.q, edit.c + put.c AS c, edit.a || put.a AS a FROM edit JOIN put ON put.p = edit.q),
    cell AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS k, q, struct_pack(c := c, a := a) AS best FROM (SELECT DISTINCT conv_id FROM conversations), put WHERE p = 0
        UNION ALL
        SELECT cell.conv_id, w.k, w.q, min(struct_pack(c := best.c + w.c, a := best.a || w.a)) FROM cell
        JOIN way_on w ON cell.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = cell.k + 1 AND w.p = cell.q GROUP BY cell.conv_id, w.k, w.q),
    best AS (SELECT conv_id, arg_max(best, k) AS best FROM (SELECT conv_id, k, min(best) AS best FROM cell WHERE q IN (0, 3) GROUP BY conv_id, k) GROUP BY conv_id),
    letter AS (
        SELECT conv_id, j, best.a[j] AS e, count(*) FILTER (best.a[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS k
        FROM best, LATERAL unnest(range(1, len(best.a) + 1)) AS u(j)),
    stay AS (
        SELECT l.conv_id, j, e, row_number() OVER w AS m, role, CASE e WHEN 'I' THEN '' ELSE text END AS text,
               first_value(e = 'K' AND left(role, 1) = 's') OVER w AS led
        FROM letter l LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.k = f.k WHERE e <> 'D'
        WINDOW w AS (PARTITION BY l.conv_id ORDER BY j)),
    whole AS (
        SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m + CAST(coalesce(led, FALSE) AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                   || ':' || text, chr(10) ORDER BY j) AS t FROM stay GROUP BY conv_id),
    facts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
    SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM best LEFT JOIN facts ON best.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN whole ON best.conv_id IS NOT DISTINCT FROM whole.conv_id
    """,
)
def op12(turns: DataFrame, folder: str) -> DataFrame:
    return conversations.repairs(conversations.damaged(turns), turns)[0]


def _kmeans_sql(rounds: int) -> str:
    """The rounds written out one after the other: assignment depends on the vector alone, so equal ones share it."""
    step = """
    a{i} AS (SELECT x, min(struct_pack(d := d, c := c)) AS best FROM (
        SELECT u.x, c, CAST(list_sum(list_transform(list_zip(u.x, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM u, c{i}) GROUP BY x)"""
    move = """
    s{i} AS (SELECT best.c AS c, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n
             FROM e JOIN a{i} USING (x), range(1, 65) r(k) GROUP BY ALL),
    c{j} AS (SELECT c, coalesce(w, v) AS v FROM c{i} LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS w FROM s{i} GROUP BY c) USING (c))"""
    parts = [step.format(i=i) + "," + move.format(i=i, j=i + 1) for i in range(rounds)]
    return f"""
    WITH e AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    u AS (SELECT DISTINCT x FROM e),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x AS v FROM e QUALIFY c < 16),
    {",".join(parts)},{step.format(i=rounds)},
    f AS (SELECT vec_id, best.c AS c, best.d AS d FROM e JOIN a{rounds} USING (x))
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
    FROM f JOIN c{rounds} USING (c)
    """


@query("op13_centroids", "embeddings", _kmeans_sql(3))
def op13(embeddings: DataFrame, folder: str) -> DataFrame:
    return centroids.clustered(embeddings)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
