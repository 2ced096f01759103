"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import ASK, linked_messages, turns_as_calls
from .common import table
from .counts import token_counts
from .jaccard import similarity_classes
from .mixing import label_topics, mixed_sample
from .packing import packed_tokens
from .quality import quality_rules
from .repair import damaged, repaired, repaired_digest
from .search import ranked_search
from .secrets import RULES, joined, secret_scan
from .sentencepiece import encode
from .substring import substring_dedup
from .urls import labelled_urls, rule_table, url_verdicts


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text again."""
    return encode(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and the digest of what stays."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, counted without encoding."""
    return token_counts(table(spark, sf_dir, "documents"))


def _of_kind(kind: str):
    return lambda span: span.kind == kind


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a ledger that starts empty."""
    found, _ = secret_scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind, *_ in RULES]
    spans = joined(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the classifier is fitted on the table's labels."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest", "probability")


#: Powers of the token shares that op7 and the pipeline aim at, for each dimension.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and draw of every document."""
    return mixed_sample(table(spark, sf_dir, "documents"), label_topics(table(spark, sf_dir, "labels")), POWERS)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and similarity component of every document."""
    return similarity_classes(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message linked, ordered, validated and serialised; user turns stand for tool calls."""
    out = linked_messages(turns_as_calls(table(spark, sf_dir, "conversations")), ASK)
    return out.withColumn("errors", F.array_join("errors", "; "))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 token ids."""
    return packed_tokens(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation, after the set damage."""
    conversations = table(spark, sf_dir, "conversations")
    summary, turns = repaired(damaged(conversations))
    all_ = conversations.select("conv_id").distinct().alias("o")
    out = all_.join(summary.alias("s"), F.expr("o.conv_id <=> s.conv_id"), "left").join(repaired_digest(turns).alias("d"), F.expr("o.conv_id <=> d.conv_id"), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("o.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_verdicts(table(spark, sf_dir, "pages"), labelled_urls(spark), rule_table(spark)).drop("probability")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_nearest_neighbours, op3_substring_dedup, op4_token_counts, op5_secret_scan, op6_quality_rules, op7_source_mixing, op8_jaccard_join, op9_chat_formatting, op10_token_packing, op11_ranked_search, op12_conversation_repair, op13_url_filter)
}

SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
        first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, p FROM win JOIN first USING (k), unnest(range(i, i + 13)) AS r(p) WHERE m < doc_id),
        word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
        kept AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op5_secret_scan": r"""
        WITH rule(kind, k, re, g, least) AS (VALUES
            ('assign', 1, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
            ('access', 2, 'AKIA[A-Z0-9]+', 0, 20),
            ('hex', 3, '[0-9a-f]+', 0, 24)),
        cut AS (
            SELECT doc_id, 'assign' AS kind, 1 AS k, 6 AS least, regexp_split_to_array(text, (SELECT re FROM rule WHERE k = 1)) AS p,
                regexp_extract_all(text, (SELECT re FROM rule WHERE k = 1), 0) AS m, regexp_extract_all(text, (SELECT re FROM rule WHERE k = 1), 2) AS j
            FROM documents
            UNION ALL
            SELECT doc_id, 'access', 2, 20, regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM documents
            UNION ALL
            SELECT doc_id, 'hex', 3, 24, regexp_split_to_array(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM documents),
        part AS (SELECT doc_id, kind, k, least, i, len(p[i]) AS lp, len(m[i]) AS lm, len(j[i]) AS lj FROM cut, unnest(range(1, len(m) + 1)) AS r(i)),
        span AS (
            SELECT doc_id, kind, k, lj >= least AS ok, lm,
                sum(lp + lm) OVER (PARTITION BY doc_id, k ORDER BY i) AS e
            FROM part),
        kept AS (SELECT doc_id, kind, k, CAST(e - lm AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM span WHERE ok),
        out AS (
            SELECT doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
            FROM kept GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN out USING (doc_id)
    """,
    "op9_chat_formatting": r"""
        WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        m AS (
            SELECT *, role = 'user' AS ask, CASE role WHEN 'user' THEN 'ask_' || conv_id || '_' || turn WHEN 'assistant' THEN 'ask_' || conv_id || '_' || (turn - 1) END AS call_id,
                row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text) AS r
            FROM c),
        j AS (
            SELECT m.*, o.role IS NOT NULL AS paired
            FROM m LEFT JOIN m o ON m.r = 1 AND o.r = 1 AND o.call_id = m.call_id AND o.role <> m.role),
        f AS (
            SELECT conv_id, turn, role, call_id,
                CASE WHEN call_id IS NULL THEN 'plain' WHEN paired THEN 'linked' WHEN r > 1 THEN 'duplicate' WHEN ask THEN 'open' ELSE 'orphan' END AS status,
                CASE WHEN ask AND len(text) > 400 THEN 'text is longer than 400' ELSE '' END AS errors,
                CASE WHEN paired AND NOT ask THEN 1 ELSE 0 END AS level,
                CASE WHEN ask THEN CAST(json_object('arguments', json_object('text', text, 'turn', turn), 'call_id', call_id, 'name', 'ask', 'role', role, 'turn', turn) AS VARCHAR)
                    WHEN call_id IS NULL THEN CAST(json_object('content', text, 'role', role, 'turn', turn) AS VARCHAR)
                    ELSE CAST(json_object('call_id', call_id, 'content', text, 'role', role, 'turn', turn) AS VARCHAR) END AS json
            FROM j)
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, level, role, json) AS position FROM f
    """,
    "op11_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, list_aggregate(map_values(h), 'sum') AS n, h
            FROM (SELECT doc_id, list_histogram(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS h FROM documents)
            WHERE cardinality(h) > 0),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
        p AS (SELECT doc_id, n, unnest(map_keys(h)) AS term, CAST(unnest(map_values(h)) AS BIGINT) AS tf FROM d),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
        q AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY item_id, term),
        s AS (
            SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(n AS BIGINT) * docs) // terms)))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10
    """,
    "op12_conversation_repair": r"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
            FROM conversations),
        hit AS (
            SELECT *, (xor(4294967295::UBIGINT, list_reduce(
                list_prepend(4294967295::UBIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::UBIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, j: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))) % 20 AS kind
            FROM raw),
        dam AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hit, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS r(copy)),
        pos AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial
            FROM dam),
        fault AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prev
            FROM pos),
        conv AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (prev || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM fault GROUP BY conv_id),
        grow(q, ins, to_, lines) AS (VALUES
            (0, '', 0, ''), (0, 'I', 2, 'user:' || chr(10)), (0, 'II', 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
            (1, '', 1, ''), (1, 'I', 2, 'user:' || chr(10)), (1, 'II', 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
            (2, '', 2, ''), (2, 'I', 3, 'assistant:' || chr(10)), (2, 'II', 2, 'assistant:' || chr(10) || 'user:' || chr(10)),
            (3, '', 3, ''), (3, 'I', 2, 'user:' || chr(10)), (3, 'II', 3, 'user:' || chr(10) || 'assistant:' || chr(10))),
        keeps(q, initial, to_) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        edit AS (
            SELECT f.conv_id, f.i, g.q, g.ins || e.e AS audit, 3 * len(g.ins) + e.c + CASE WHEN e.e <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost, e.t AS to_,
                g.lines || CASE e.e WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE CASE e.t WHEN 3 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) END AS lines
            FROM fault f, grow g, LATERAL (
                SELECT 'D' AS e, 4 AS c, g.to_ AS t
                UNION ALL SELECT 'R', 3, CASE g.to_ WHEN 2 THEN 3 ELSE 2 END WHERE f.fault NOT IN ('blank', 'duplicate')
                UNION ALL SELECT 'K', 0, k.to_ FROM keeps k WHERE k.q = g.to_ AND k.initial = f.initial AND f.fault NOT IN ('blank', 'duplicate')) e),
        step AS (SELECT conv_id, i, q, to_, min({'cost': cost, 'audit': audit, 'lines': lines}) AS s FROM edit GROUP BY ALL),
        best(conv_id, i, q, s) AS (
            SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} FROM conv
            UNION ALL
            SELECT b.conv_id, b.i + 1, t.to_, min({'cost': b.s.cost + t.s.cost, 'audit': b.s.audit || t.s.audit, 'lines': b.s.lines || t.s.lines})
            FROM best b JOIN step t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1 AND t.q = b.q
            GROUP BY b.conv_id, b.i, t.to_),
        done AS (
            SELECT b.conv_id, min({'cost': b.s.cost + 3 * len(g.ins), 'audit': b.s.audit || g.ins, 'lines': b.s.lines || g.lines}) AS s
            FROM best b JOIN conv c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN grow g ON g.q = b.q AND g.to_ IN (0, 3) GROUP BY b.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(s.cost, 0) AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(s.lines[:-2], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN conv c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
