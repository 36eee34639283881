"""Queries of the training-data operators, registered by ``__spark_entry__``: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bin_completion, conversation_trie, embedding_dedup, filter_audit, jaccard_join, packing, pii, quality_gbdt, sentencepiece_table, simhash, token_counts, url_templates, warc_fixity
from corpusloom.llm.common import bounded_batches, free_name
from corpusloom.plans.lineage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' records against a replica with a changed byte in every 97th page, two bytes more in every 20011th, and every 211th record lost."""
    pages = table(spark, sf_dir, "pages")
    html, hit, longer = F.coalesce("html", F.lit("")), F.pmod(F.col("page_id"), F.lit(97)) == 13, F.pmod(F.col("page_id"), F.lit(20011)) == 5
    replica = pages.withColumn("html", F.when(hit, F.concat(F.lit("X"), F.substring(html, 2, 2_000_000_000))).when(longer, F.concat(html, F.lit("\n\n"))).otherwise(html))
    return warc_fixity.fixity_audit(pages, replica, F.pmod(F.col("page_id"), F.lit(211)) == 7)


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(table(spark, sf_dir, "documents"), simhash.NEAR)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits to every document."""
    docs = table(spark, sf_dir, "documents")
    edits = free_name("edits", docs)
    return token_counts.edited_counts(docs.withColumn(edits, token_counts.sample_edits()), public_tokenizers.path("byte_bpe_50k.tiktoken"), edits)


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_warc_fixity, op3_url_templates, op4_simhash, op5_packing, op6_pii, op7_jaccard_join, op8_quality, op9_embedding_dedup, op10_token_counts, op11_bin_completion, op12_filter_audit, op13_conversation_trie)}


def _fixity_sql() -> str:
    """The layout as SQL; what has become of a record is said by how the replica was made, not by comparing layouts."""
    crlf = "chr(13) || chr(10)"
    h, html = "md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, ''))", "coalesce(html, '')"
    named = f"'urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32]"
    head = f"'WARC/1.1' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Record-ID: <' || {named} || '>' || {crlf} || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf} || 'WARC-Date: {warc_fixity.DATE}' || {crlf} || 'WARC-Payload-Digest: sha256:' || sha256({html}) || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || CAST(strlen({html}) AS VARCHAR) || {crlf} || {crlf} || {html}"
    return f"""SELECT page_id, CAST(file AS VARCHAR) AS file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, record_id, sha256,
        CASE WHEN page_id % 211 = 7 THEN 'missing' WHEN page_id % 97 = 13 OR page_id % 20011 = 5 THEN 'altered' ELSE 'intact' END AS status FROM (
        SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, url, sha256) - 1 AS pos, (row_number() OVER (ORDER BY page_id NULLS FIRST, url, sha256) - 1) // 1024 AS file FROM (
            SELECT page_id, coalesce(url, '') AS url, {named} AS record_id, CAST(strlen({head}) + 4 AS BIGINT) AS length, sha256({head}) AS sha256 FROM pages))"""


def _components_sql(nodes: str, links: str) -> str:
    """CTEs near, reach and comp (node, component) of the CTEs ``nodes`` (node) and ``links`` (a, b, both ways)."""
    return f"reach AS (SELECT node, node AS other FROM {nodes} UNION SELECT r.node, l.b AS other FROM reach r JOIN {links} l ON r.other = l.a), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{url_templates.UPPER}', '{url_templates.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS sh FROM w),
    e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    nodes AS (SELECT doc_id AS node FROM documents), {_components_sql("nodes", "links")}
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component AS component_id FROM s JOIN comp ON s.doc_id = comp.node"""

EMBEDDING_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
    nodes AS (SELECT vec_id AS node FROM embeddings), {_components_sql("nodes", "links")}
    SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component AS component_id, node = component AS kept FROM comp"""


def _templates_sql() -> str:
    rule, verdict = "NULL", "NULL"
    for what, text in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    ext = "lower(regexp_extract(s, '(\\.[A-Za-z][A-Za-z0-9]{0,4})$', 1))"
    stem = "regexp_replace(s, '\\.[A-Za-z][A-Za-z0-9]{0,4}$', '')"
    kind = f"""CASE WHEN regexp_matches({stem}, '^[0-9]{{4}}-[0-9]{{1,2}}(-[0-9]{{1,2}})?$') THEN '<date>' || {ext} WHEN regexp_matches({stem}, '^[0-9]+$') THEN '<n>' || {ext}
        WHEN regexp_matches({stem}, '^[0-9a-fA-F-]{{16,}}$') THEN '<hex>' || {ext} WHEN regexp_matches({stem}, '[0-9]') AND length({stem}) > 3 OR length({stem}) > 40 THEN '<id>' || {ext} ELSE s END"""
    def level(d: int) -> str:
        """CTEs of one level: rows_d are the shapes with more than d segments, done_d those that end with it."""
        n = d + 1
        bits = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END"
        return f"""tok_{n} AS MATERIALIZED (SELECT *, shape[{n}] AS token, coalesce(shape[{n + 1}], '') AS nx, coalesce(shape[{n + 2}], '') AS af FROM rows_{d}),
        node_{n} AS MATERIALIZED (SELECT host, prefix, token, total, good, bad, CASE WHEN starts_with(token, '<') OR token = '**' THEN token WHEN kids > 24 AND total < 0.05 * among THEN '*' END AS seg FROM (
            SELECT *, count(*) OVER (PARTITION BY host, prefix) AS kids, sum(total) OVER (PARTITION BY host, prefix) AS among FROM (SELECT host, prefix, token, sum(n) AS total, sum(good) AS good, sum(bad) AS bad FROM tok_{n} GROUP BY host, prefix, token))),
        plain_{n} AS MATERIALIZED (SELECT host, prefix, token, total, good, bad FROM node_{n} WHERE seg IS NULL),
        next_{n} AS MATERIALIZED (SELECT host, prefix, token, total, CASE WHEN kinds > 24 AND m < 0.05 * total THEN '*' ELSE nx END AS nx, af, n FROM (
            SELECT t.host, t.prefix, t.token, total, nx, af, n, sum(n) OVER (PARTITION BY t.host, t.prefix, t.token, nx) AS m, len(list_distinct(list(nx) OVER (PARTITION BY t.host, t.prefix, t.token))) AS kinds FROM tok_{n} t JOIN plain_{n} USING (host, prefix, token))),
        follow_{n} AS MATERIALIZED (SELECT host, prefix, token, nx || '/' || CASE WHEN n < 0.05 * total THEN '*' ELSE af END AS f, sum(n) / CAST(total AS DOUBLE) AS share FROM (SELECT host, prefix, token, total, nx, af, sum(n) AS n FROM next_{n} GROUP BY ALL) GROUP BY host, prefix, token, f, total),
        known_{n} AS MATERIALIZED (SELECT * FROM plain_{n} JOIN (SELECT host, prefix, token, round(sum(CASE WHEN len(list_filter(string_split(f, '/'), lambda s: s NOT IN ('', '*', '**') AND NOT starts_with(s, '<'))) > 0 THEN share ELSE 0 END), 9) >= 0.5 AS known FROM follow_{n} GROUP BY host, prefix, token) USING (host, prefix, token)),
        pair_{n} AS MATERIALIZED (SELECT a.host, a.prefix, a.token, b.token AS other, a.total AS n, b.total AS m FROM known_{n} a JOIN known_{n} b ON a.host = b.host AND a.prefix = b.prefix AND a.token <> b.token AND a.known AND b.known
            AND (a.good + a.bad = 0 OR b.good + b.bad = 0 OR round(abs(a.good / (a.good + a.bad) - b.good / (b.good + b.bad)), 9) <= 0.2)),
        both_{n} AS MATERIALIZED (SELECT host, prefix, token, other, n, m, f, sum(p) AS p, sum(q) AS q FROM (SELECT q.*, x.f, x.share AS p, 0 AS q FROM pair_{n} q JOIN follow_{n} x USING (host, prefix, token) UNION ALL
            SELECT q.*, y.f, 0 AS p, y.share AS q FROM pair_{n} q JOIN follow_{n} y ON y.host = q.host AND y.prefix = q.prefix AND y.token = q.other) GROUP BY host, prefix, token, other, n, m, f),
        alike_{n} AS MATERIALIZED (SELECT host, prefix, token, other, m FROM both_{n} GROUP BY host, prefix, token, other, n, m HAVING round(sum({bits}), 9) <= least(0.25, round(0.02 + 3 * (count(*) - 1) * (1.0 / n + 1.0 / m) / (8 * ln(2)), 9)) UNION ALL SELECT host, prefix, token, token, total FROM plain_{n}),
        lead_{n} AS MATERIALIZED (SELECT host, prefix, token, arg_max(other, (m, other)) AS leader FROM alike_{n} GROUP BY host, prefix, token),
        seg_{n} AS MATERIALIZED (SELECT host, prefix, token, seg FROM node_{n} WHERE seg IS NOT NULL UNION ALL SELECT host, prefix, unnest(toks) AS token, CASE WHEN len(toks) > 1 THEN '{{' || array_to_string(toks, '|') || '}}' ELSE toks[1] END AS seg FROM (SELECT host, prefix, list_sort(list(token)) AS toks FROM lead_{n} GROUP BY host, prefix, leader)),
        put_{n} AS MATERIALIZED (SELECT host, key, shape, n, good, bad, prefix, seg, mean FROM tok_{n} JOIN seg_{n} USING (host, prefix, token)),
        mean_{n} AS MATERIALIZED (SELECT host, prefix, (coalesce(sum(CASE WHEN good + bad > 0 THEN good / (good + bad) END), 0) + 2 * any_value(mean)) / (count(CASE WHEN good + bad > 0 THEN 1 END) + 2) AS mean FROM (SELECT host, prefix, seg, sum(good) AS good, sum(bad) AS bad, any_value(mean) AS mean FROM put_{n} GROUP BY host, prefix, seg) GROUP BY host, prefix),
        new_{n} AS MATERIALIZED (SELECT p.host, key, shape, n, good, bad, p.prefix || '/' || seg AS prefix, q.mean FROM put_{n} p JOIN mean_{n} q ON p.host = q.host AND p.prefix = q.prefix),
        rows_{n} AS MATERIALIZED (SELECT * FROM new_{n} WHERE len(shape) > {n}), done_{n} AS MATERIALIZED (SELECT host, key, good, bad, prefix, mean FROM new_{n} WHERE len(shape) = {n})"""

    deepest = 17  # 16 segments and what is beyond them
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_templates.UPPER}', '{url_templates.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    u AS (SELECT page_id, host, path, CAST({rule} AS VARCHAR) AS rule, CAST({verdict} AS VARCHAR) AS what, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM p),
    v AS MATERIALIZED (SELECT * EXCLUDE segs, list_concat(list_transform(segs[1:16], lambda s: {kind}), CASE WHEN len(segs) > 16 THEN ['**'] ELSE CAST([] AS VARCHAR[]) END) AS shape FROM u),
    k AS MATERIALIZED (SELECT host, array_to_string(shape, '/') AS key, shape, count(*) AS n, CAST(count(CASE WHEN what = 'allow' THEN 1 END) AS DOUBLE) AS good, CAST(count(CASE WHEN what = 'block' THEN 1 END) AS DOUBLE) AS bad, '' AS prefix, CAST(0.5 AS DOUBLE) AS mean FROM v GROUP BY host, shape),
    rows_0 AS MATERIALIZED (SELECT * FROM k WHERE len(shape) > 0),
    {", ".join(level(d) for d in range(deepest))},
    found AS (SELECT host, key, good, bad, '/' AS prefix, mean FROM k WHERE len(shape) = 0 {" ".join(f"UNION ALL SELECT * FROM done_{d + 1}" for d in range(deepest))}),
    rated AS (SELECT host, prefix, (sum(good) + 2 * any_value(mean)) / (sum(good) + sum(bad) + 2) AS purity FROM found GROUP BY host, prefix)
    SELECT page_id, v.host, path, rule, coalesce(what, CASE WHEN purity < 0.3 THEN 'block' ELSE 'allow' END) AS verdict, rated.prefix AS template, CAST(purity AS DOUBLE) AS purity
    FROM v JOIN found ON v.host = found.host AND array_to_string(v.shape, '/') = found.key JOIN rated ON found.host = rated.host AND found.prefix = rated.prefix"""


AUDIT_SQL = """WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    f AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
    m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, fails, count(*) AS n, count(CASE WHEN good THEN 1 END) AS good, count(CASE WHEN toxic THEN 1 END) AS toxic FROM f LEFT JOIN m ON f.doc_id = m.doc_id GROUP BY part, fails),
    one AS (SELECT unnest(range(1, 6)) AS f),
    orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    steps AS (SELECT o, list_aggregate(list_transform(o, lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step FROM orders),
    x AS (SELECT part, filter_order, step, o[step] AS filter, n, good, toxic, fails[o[step]] AS now, list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])) AS before, len(list_filter(fails, lambda b: b)) AS many FROM c CROSS JOIN steps),
    r AS (SELECT part, filter_order, step, filter, CAST(sum(CASE WHEN NOT now AND NOT coalesce(before, false) THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN now AND NOT coalesce(before, false) THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN now AND before THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN now AND many = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN now AND NOT coalesce(before, false) THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN now AND NOT coalesce(before, false) THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM x GROUP BY part, filter_order, step, filter)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""


def _trie_sql() -> str:
    """Nodes as joined digests of their turns; subtrees are nodes whose digests begin with the node's."""
    return """WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
    bytes AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 1 AS pos, CAST(4294967295 AS BIGINT) AS crc FROM ids UNION ALL
        SELECT conv_id, s, pos + 1, list_reduce(list_prepend(xor(crc, CAST(ascii(s[pos]) AS BIGINT)), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END) FROM bytes WHERE pos <= length(s)),
    h AS (SELECT conv_id, xor(crc, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bytes WHERE pos = length(s) + 1),
    t AS (SELECT conv_id, role, text, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS nr
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
    r AS (SELECT h.conv_id, t.nr AS place, t.key, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.nr <= h.h UNION ALL SELECT h.conv_id, t.nr + 1000000 AS place, t.key, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.nr > h.h),
    paths AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)
        UNION ALL SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM ids),
    ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
    nodes AS (SELECT path, depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM ended GROUP BY path, depth),
    kids AS (SELECT path[1:64 * (depth - 1)] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    under AS (SELECT a.path, a.depth, sum((b.n_convs - 1) * b.words) AS saved, count(CASE WHEN k.n IS NULL THEN 1 END) AS leaves FROM nodes a JOIN nodes b ON b.depth >= a.depth AND starts_with(b.path, a.path) LEFT JOIN kids k ON k.path = b.path AND k.depth = b.depth GROUP BY a.path, a.depth)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN under u ON n.path = u.path AND n.depth = u.depth LEFT JOIN kids k ON k.path = n.path AND k.depth = n.depth LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:64 * p.depth]"""


ORACLE_SQL: dict[str, str] = {"op12_filter_audit": AUDIT_SQL, "op13_conversation_trie": _trie_sql(), "op2_warc_fixity": _fixity_sql(), "op3_url_templates": _templates_sql(), "op7_jaccard_join": JACCARD_SQL, "op9_embedding_dedup": EMBEDDING_SQL}
