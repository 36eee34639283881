"""Registered queries over the given tables, each with the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import html, text, urls, values
from corpusloom.operators import crawl_store, fields, filters, frontier, links, positions, recrawl, rollups, search, segments
from corpusloom.plans import config
from corpusloom.plans.lineage import cut, fresh_path, spread
from corpusloom.sources import exports, files
from corpusloom.streaming import jobs, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(t) if name in ("documents", "pages") else t  # those with texts to work on


def query(sql: str | None = None):
    """Register a function of (tables, spark), where tables('pages') reads a table, and its SQL."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name), spark)
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---- shared SQL ----
R = r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
U = [f"regexp_extract(url, '{R}', {i})" for i in range(1, 6)]
SCHEME, AUTH, PATH, QUERY, FRAG = U
HOST = f"lower(regexp_replace(regexp_replace({AUTH}, '^.*@', ''), ':[0-9]*$', ''))"
TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'))"""
URL_PATH = f"CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END"
TYPE = "CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END"
TOKENS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def page_rows_of(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", html.title(F.col("html")).alias("title"), html.plain_text(F.col("html")).alias("content"))
    return p.select(*values.page_row(F.col("page_id"), F.col("url"), F.col("title"), F.lit("text/html"), F.col("content")))


ROWS_SQL = f"SELECT CAST(page_id AS VARCHAR) AS id, {URL_PATH} AS path, CASE WHEN {TITLE} = '' THEN 'Untitled' ELSE {TITLE} END AS title, {TYPE} AS type, CAST(length({PLAIN}) AS BIGINT) AS size FROM pages"


# ---- page rows ----
@query(ROWS_SQL)
def page_rows(t, spark):
    return page_rows_of(t("pages"))


@query(f"SELECT * FROM ({ROWS_SQL}) WHERE contains(lower(path), '/en') OR contains(lower(title), '/en') OR contains(lower(type), '/en')")
def quick_filter(t, spark):
    return search.table_view(page_rows_of(t("pages")), " /EN ", ("size", "asc"), "id")


@query(f"SELECT * FROM ({ROWS_SQL}) ORDER BY lower(title) DESC, id LIMIT 25")
def table_sort_topk(t, spark):
    return search.table_view(page_rows_of(t("pages")), "", ("title", "desc"), "id", collation=None).limit(25)


@query(f"SELECT id, title, row_number() OVER (ORDER BY lower(title) COLLATE en, id) - 1 AS place FROM (SELECT CAST(page_id AS VARCHAR) AS id, {TITLE} AS title FROM pages) ORDER BY lower(title) COLLATE en, id LIMIT 120")
def table_sort_collated(t, spark):
    """The default collation: titles in their order as words, letters with accents among those without."""
    rows = t("pages").select(F.col("page_id").cast("string").alias("id"), F.lit("/").alias("path"), html.title(F.col("html")).alias("title"), F.lit("html").alias("type"))
    first = search.table_view(rows, "", ("title", "asc"), "id").limit(120).select("id", "title")
    return first.select("*", F.monotonically_increasing_id().alias("place"))  # of one sorted page of rows


@query(f"SELECT * FROM ({ROWS_SQL}) ORDER BY lower(path) DESC, id LIMIT 20")
def table_sort_toggled(t, spark):
    """The sort after two clicks: on another column and back gives path ascending, once more descending."""
    state = search.toggled(search.toggled(search.toggled(("path", "asc"), "size"), "path"), "path")
    return search.table_view(page_rows_of(t("pages")), "", state, "id", collation=None).limit(20)


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def title_extract(t, spark):
    return t("pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {PLAIN} AS content FROM pages")
def html_to_text(t, spark):
    return t("pages").select("page_id", html.plain_text(F.col("html")).alias("content"))


@query("SELECT page_id, 'description' AS name, 'd' || page_id || CASE WHEN page_id % 3 = 0 THEN '|second' ELSE '' END AS contents FROM pages UNION ALL SELECT page_id, 'og:title' AS name, 'T & ' || page_id % 7 AS contents FROM pages")
def meta_fields(t, spark):
    """All named meta tags of the pages. The given pages have none, so some are put before them: quoted in both ways, by name and property, one twice."""
    tags = F.concat(F.lit('<meta name="Description" content="d'), "page_id", F.lit("\">\n<META property='og:title' content='T & "), F.col("page_id") % 7, F.lit("'>"), F.when(F.col("page_id") % 3 == 0, "<meta content=second name=description>").otherwise(""))
    m = t("pages").select("page_id", F.explode(html.meta_fields(F.concat(tags, "html"))).alias("name", "values"))
    return m.select("page_id", "name", F.array_join("values", "|").alias("contents"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/og/' || page_id WHEN 1 THEN '/i/' || page_id END AS image FROM pages")
def featured_images(t, spark):
    """og:image before the first img; the given pages have neither, so they get one, the other or none."""
    tag = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<img src='/x'><meta property='og:image' content='/og/"), "page_id", F.lit("'>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<p><img alt='a' src='/i/"), "page_id", F.lit("'><img src='/late'>"))).otherwise("")
    return t("pages").select("page_id", html.featured_image(F.concat(tag, "html")).alias("image"))


@query(f"SELECT * REPLACE (CASE WHEN ct LIKE '%pdf%' OR lower(url) LIKE '%.pdf' THEN 'pdf' WHEN ct LIKE '%html%' OR ct LIKE '%text/%' THEN 'html' ELSE 'doc' END AS type) FROM (SELECT page_id, '' AS type, CASE WHEN page_id % 4 = 3 THEN url || '.PDF' ELSE url END AS url, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/xml' ELSE '' END AS ct FROM pages)")
def page_types(t, spark):
    """Types by content type or the url's end."""
    k = F.col("page_id") % 4
    p = t("pages").select("page_id", F.when(k == 3, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url")).alias("url"), F.when(k == 0, "application/pdf").when(k == 1, "text/plain").when(k == 2, "application/xml").otherwise("").alias("ct"))
    return p.select("page_id", "url", "ct", values.page_type(F.upper("ct"), F.col("url")).alias("type"))


@query(f"SELECT page_id, CASE WHEN length({PLAIN}) // 1024 >= 0 THEN CAST(greatest(1, CAST(floor(length({PLAIN}) / 1024.0 + 0.5) AS BIGINT)) AS VARCHAR) || ' KB' END AS label FROM pages")
def size_labels(t, spark):
    return t("pages").select("page_id", values.format_kb(values.text_size(html.plain_text(F.col("html")))).alias("label"))


# ---- exports: documents as raw hits ----
def raw_hits(t) -> DataFrame:
    d = t("documents")
    m = F.map_from_arrays(F.array(*map(F.lit, ("s365:title", "dc:title", "og:description", "content", "collector.depth", "document.contentType"))), F.array(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), "doc_id")), "source", "lang", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")), (F.col("doc_id") % 4).cast("string"), F.lit("text/plain")))
    return d.select(F.concat(F.lit("doc/"), "doc_id").alias("_id"), m.alias("_source"), F.col("doc_id").alias("load_seq"))


@query("""SELECT 'doc/' || doc_id AS _id, 'doc/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN coalesce(nullif(source, ''), 'Untitled') ELSE 't' || doc_id END AS title, coalesce(lang, '') AS description,
    CASE WHEN doc_id % 5 = 0 OR text IS NULL OR text = '' THEN coalesce(lang, '') ELSE text END AS content, CAST(doc_id % 4 AS VARCHAR) AS depth, 'text/plain' AS content_type FROM documents""")
def clean_documents(t, spark):
    return exports.clean(raw_hits(t)).select("_id", "url", "title", "description", "content", F.col("metadata.depth").alias("depth"), F.col("metadata.contentType").alias("content_type"))


@query("SELECT source AS _id, max(doc_id) AS load_seq, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def upsert_last_wins(t, spark):
    return exports.last_wins(t("documents").select(F.col("source").alias("_id"), F.col("doc_id").alias("load_seq"), "lang", "n_chars"))


@query("""SELECT doc_id AS _id, n_chars, 'old' AS version FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 2 = 0
    UNION ALL SELECT doc_id AS _id, n_chars, 'new' AS version FROM documents WHERE doc_id % 4 = 0""")
def upsert_merge(t, spark):
    d = t("documents").select(F.col("doc_id").alias("_id"), "n_chars")
    old = d.where("_id % 2 = 0").withColumn("version", F.lit("old"))
    return exports.upsert(old, d.where("_id % 4 = 0").select("*", F.lit("new").alias("version"), F.lit(1).alias("load_seq")))


@query("SELECT source AS batch, count(*) AS items, count(CASE WHEN n_chars < 60 THEN 1 END) AS failed, CASE WHEN count(CASE WHEN n_chars < 60 THEN 1 END) > 0 THEN 0 ELSE count(*) END AS loaded FROM documents GROUP BY source")
def load_report(t, spark):
    return exports.load_report(t("documents"), F.col("n_chars") >= 60, F.col("source"))


@query("""SELECT '{"index":{"_index":"docs","_id":' || doc_id || '}}' AS value FROM documents
    UNION ALL SELECT '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS value FROM documents""")
def bulk_lines(t, spark):
    return exports.bulk_lines(t("documents").select("doc_id", "lang", "n_chars"), "docs", "doc_id")


@query("SELECT doc_id, lang, 'loom' AS SITE FROM documents")
def field_taggers(t, spark):
    d = fields.add_constant(t("documents"), SITE="loom")
    return fields.keep_only(fields.delete_matching(d, "n_.*|text"), "doc_id, lang, SITE, absent")


# ---- url rules ----
def _param_sql(inner: str) -> str:
    """SQL of a url whose query's parameters, the list ps, become ``inner``."""
    ps = f"string_split(substring({QUERY}, 2), '&')"
    joined = f"array_to_string({inner.format(ps=ps)}, '&')"
    return f"{SCHEME} || {AUTH} || {PATH} || CASE WHEN {QUERY} IN ('', '?') THEN {QUERY} WHEN {joined} = '' THEN '' ELSE '?' || {joined} END || {FRAG}"


def _path_sql(inner: str) -> str:
    return f"{SCHEME} || {AUTH} || {inner} || {QUERY} || {FRAG}"


_HEX = "'%[0-9A-Fa-f]{2}'"
RULE_SQL = {
    "lower_case_scheme_host": f"lower({SCHEME}) || regexp_extract({AUTH}, '^(.*@)?') || lower(regexp_replace({AUTH}, '^.*@', '')) || {PATH} || {QUERY} || {FRAG}",
    "encode_spaces": "replace(url, ' ', '%20')",
    "remove_default_port": r"regexp_replace(regexp_replace(url, '^(?i)(http://[^/?#:]+):80([/?#]|$)', '\1\2'), '^(?i)(https://[^/?#:]+):443([/?#]|$)', '\1\2')",
    "remove_fragment": "regexp_replace(url, '(?s)#.*$', '')",
    "remove_trailing_fragment": "regexp_replace(url, '#[^/#]*$', '')",
    "remove_trailing_hash": "regexp_replace(url, '#$', '')",
    "remove_trailing_question_mark": r"regexp_replace(url, '\?$', '')",
    "remove_query_string": r"regexp_replace(url, '(?s)\?.*$', '')",
    "remove_empty_parameters": _param_sql("list_filter({ps}, lambda p: p <> '' AND p NOT LIKE '%=' AND contains(p, '='))"),
    "sort_query_parameters": _param_sql("list_sort({ps})"),
    "remove_duplicate_slashes": _path_sql(f"regexp_replace({PATH}, '/{{2,}}', '/', 'g')"),
    "remove_directory_index": _path_sql(rf"regexp_replace({PATH}, '/(?:index|default)\.(?:html?|php|jsp|asp|aspx)$', '/')"),
    "add_directory_trailing_slash": _path_sql(f"CASE WHEN regexp_matches({PATH}, '/[^/.]+$') THEN {PATH} || '/' ELSE {PATH} END"),
    "add_domain_trailing_slash": _path_sql(f"CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END"),
    "remove_trailing_slash": _path_sql(f"regexp_replace({PATH}, '/$', '')"),
    "add_www": f"{SCHEME} || CASE WHEN starts_with({AUTH}, 'www.') OR {AUTH} = '' THEN '' ELSE 'www.' END || {AUTH} || {PATH} || {QUERY} || {FRAG}",
    "remove_www": rf"{SCHEME} || regexp_replace({AUTH}, '^www\.', '') || {PATH} || {QUERY} || {FRAG}",
    "secure_scheme": "regexp_replace(url, '^(?i)http://', 'https://')",
    "unsecure_scheme": "regexp_replace(url, '^(?i)https://', 'http://')",
    "lower_case": "lower(url)",
    "lower_case_path": _path_sql(f"lower({PATH})"),
    "lower_case_query": f"{SCHEME} || {AUTH} || {PATH} || lower({QUERY}) || {FRAG}",
    "lower_case_query_parameter_names": _param_sql("list_transform({ps}, lambda p: lower(regexp_extract(p, '(?s)^([^=]*)(.*)$', 1)) || regexp_extract(p, '(?s)^([^=]*)(.*)$', 2))"),
    "lower_case_query_parameter_values": _param_sql("list_transform({ps}, lambda p: regexp_extract(p, '(?s)^([^=]*)(.*)$', 1) || lower(regexp_extract(p, '(?s)^([^=]*)(.*)$', 2)))"),
}
#: What the given urls lack is put in before a rule is applied, so that it has something to do; and its SQL after the rule.
RULE_INPUT = {
    "lower_case_scheme_host": (lambda u: F.upper(u), "upper(url)"),
    "encode_spaces": (lambda u: F.concat(u, F.lit("a b c")), "url || 'a b c'"),
    "remove_default_port": (lambda u: F.regexp_replace(u, "^(https?)(://[^/]*)", "$1$2:443"), r"regexp_replace(url, '^(https?)(://[^/]*)', '\1\2:443')"),
    "remove_trailing_hash": (lambda u: F.concat(u, F.lit("#")), "url || '#'"),
    "remove_trailing_question_mark": (lambda u: F.concat(u, F.lit("?")), "url || '?'"),
    "remove_empty_parameters": (lambda u: F.concat(urls.remove_fragment(urls.remove_query_string(u)), F.lit("?a=&b=1&c&d=")), r"regexp_replace(regexp_replace(url, '\?.*$', ''), '#.*$', '') || '?a=&b=1&c&d='"),
    "remove_duplicate_slashes": (lambda u: F.concat(urls.remove_fragment(urls.remove_query_string(u)), F.lit("//a///b")), r"regexp_replace(regexp_replace(url, '\?.*$', ''), '#.*$', '') || '//a///b'"),
    "remove_directory_index": (lambda u: F.concat(urls.remove_fragment(urls.remove_query_string(u)), F.lit("/index.html")), r"regexp_replace(regexp_replace(url, '\?.*$', ''), '#.*$', '') || '/index.html'"),
    "add_domain_trailing_slash": (lambda u: F.regexp_replace(u, "^(https?://[^/]*).*$", "$1?q"), r"regexp_replace(url, '^(https?://[^/]*).*$', '\1?q')"),
    "lower_case": (lambda u: F.upper(u), "upper(url)"),
    "lower_case_path": (lambda u: F.upper(u), "upper(url)"),
    "lower_case_query": (lambda u: F.upper(u), "upper(url)"),
    "lower_case_query_parameter_names": (lambda u: F.upper(u), "upper(url)"),
    "lower_case_query_parameter_values": (lambda u: F.upper(u), "upper(url)"),
}
_BARE = r"regexp_replace(regexp_replace(url, '\?.*$', ''), '#.*$', '')"
#: What is put behind a url without query and fragment, by the url's length, and what the rule makes of it, for rules that the other engine can't say.
RULE_FORMS = {
    "upper_case_escape_sequence": [("%3a%2Fx%e9", "%3A%2Fx%E9"), ("/%zz%1%aa", "/%zz%1%AA"), ("?q=%c3%a9&%b", "?q=%C3%A9&%b"), ("#%ff", "#%FF")],
    "decode_unreserved_characters": [("%41%2e%2F%7e%30", "A.%2F~0"), ("/%5f%2D%25", "/_-%25"), ("?a=%61b%C3%A9", "?a=ab%C3%A9"), ("%2541", "%2541")],
    "encode_non_uri_characters": [("/ä b", "/%C3%A4%20b"), ("/<x>|y", "/%3Cx%3E%7Cy"), ("?q=日", "?q=%E6%97%A5"), ("/a-b_~c!", "/a-b_~c!")],
    "remove_session_ids": [(";jsessionid=AB12?x=1&PHPSESSID=99&y=2", "?x=1&y=2"), ("?sid=9", ""), ("?aspsessionidabc=1&z=2#f", "?z=2#f"), (";JSESSIONID=0/next", "/next")],
    "remove_dot_segments": [("/a/../b/./c/..", "/b/"), ("/./x", "/x"), ("/q/r/../../s?t=/../u", "/s?t=/../u"), ("/..a/b.", "/..a/b.")],
}


def _register_rule(name: str) -> None:
    change, before = RULE_INPUT.get(name, (lambda u: u, "url"))
    forms = RULE_FORMS.get(name)
    if forms:
        change = lambda u: F.concat(urls.remove_fragment(urls.remove_query_string(u)), F.get(F.array(*[F.lit(a) for a, _ in forms]), F.length(u) % len(forms)))
        sql = f"regexp_replace({_BARE}, '/$', '/') || {[b for _, b in forms]}[length(url) % {len(forms)} + 1]"
        if name == "remove_dot_segments":  # two slashes are a segment, so none may be at the end
            bare = change
            change = lambda u: bare(F.regexp_replace(u, "/(?=$|[?#])", "x"))
            sql = sql.replace("'/$', '/'", "'/$', 'x'")
        before, rule = "url", sql
    else:
        rule = RULE_SQL[name]

    def run(t, spark):
        return t("pages").where("url is not null").select("page_id", urls.RULES[name](change(F.col("url"))).alias("url"))

    run.__name__ = f"url_{name}"
    query(f"SELECT page_id, {rule} AS url FROM (SELECT page_id, {before} AS url FROM pages WHERE url IS NOT NULL)")(run)


for _name in urls.RULES:
    _register_rule(_name)

CHAIN = ["lower_case_scheme_host", "remove_fragment", "remove_query_string", "remove_www", "secure_scheme", "remove_trailing_slash"]
CHAIN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', ''), '^(https?://)www\.', '\1'), '^http://', 'https://'), '/$', '')"


@query(f"SELECT page_id, regexp_replace({CHAIN_SQL}, '/([a-z]+)/([0-9]+)$', '/\\2/\\1') AS url FROM pages")
def url_normalize_chain(t, spark):
    return t("pages").select("page_id", urls.normalize(F.col("url"), [*CHAIN, urls.replacing("/([a-z]+)/([0-9]+)$", "/$2/$1")]).alias("url"))


# ---- filters ----
@query(r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https?://[^/?#]*[^?#]*/[^/?#]*\.html([?#].*)?$')")
def ext_filter(t, spark):
    return t("pages").where(filters.accepted([filters.Filter(filters.has_extension(F.col("url"), "html,zip,PDF"), "exclude")])).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://.*/(en|fr)/.*$') AND NOT contains(url, 'utm_')")
def regex_filter(t, spark):
    u = F.col("url")
    return t("pages").where(filters.accepted([filters.Filter(filters.matches(u, "https://.*/(en|fr)/.*")), filters.Filter(filters.matches(u, "*utm_*", "wildcard"), "exclude")])).select("page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE len(list_filter(string_split({PATH}, '/'), lambda s: s <> '')) >= 2")
def segment_filter(t, spark):
    return t("pages").where(filters.segment_count(F.col("url"), 2)).select("page_id", "url")


@query(f"SELECT page_id FROM (SELECT page_id, string_split(regexp_replace({PATH}, '/$', '') || '/' || substring({PATH}, 2, 2) || '/x', '/') AS segs FROM pages) WHERE len(list_filter(segs, lambda s: s <> '' AND len(list_filter(segs, lambda y: y = s)) >= 2)) > 0 AND page_id % 2 = 0 OR len(list_filter(segs, lambda s: s <> '')) >= 5")
def segment_duplicates(t, spark):
    """Paths with their first two letters put behind them: every second page is asked for segments that come twice, all for five segments."""
    _, _, path, _, _ = urls.parts(F.col("url"))
    u = F.concat(F.lit("http://h"), F.regexp_replace(path, "/$", ""), F.lit("/"), F.substring(path, 2, 2), F.lit("/x"))
    return t("pages").where(filters.segment_count(u, 2, duplicates=True) & (F.col("page_id") % 2 == 0) | filters.segment_count(u, 5)).select("page_id")


@query(f"SELECT page_id, url FROM pages WHERE ({HOST} = 'example.com' OR {HOST} LIKE '%.example.com') AND {SCHEME} = 'https://'")
def scope_filter(t, spark):
    return t("pages").where(filters.in_scope(F.lit("https://example.com/"), F.col("url"), protocol=True, port=True, subdomains=True)).select("page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE (starts_with({PATH}, '/en/') OR starts_with({PATH}, '/de/')) AND NOT starts_with({PATH}, '/en/1')")
def prefix_filter(t, spark):
    path = values.url_path(F.col("url"))
    return t("pages").where(filters.prefixes(path, ["/en/", "/de/"], ["/en/1"])).select("page_id", "url")


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 40")
def most_documents(t, spark):
    return filters.most_documents(t("pages").select("page_id", "url"), 40, "url", "page_id")


ROBOTS = [("disallow", "/en/"), ("allow", "/en/7"), ("disallow", "*?page="), ("disallow", "/de/*8$"), ("allow", "/")]


@query(f"""SELECT page_id, url, r.pattern AS robots_rule, coalesce(r.kind = 'allow', true) AS allowed FROM (SELECT page_id, url, {HOST} AS host, CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || {QUERY} AS p FROM pages) u
    LEFT JOIN LATERAL (SELECT kind, pattern FROM (VALUES {', '.join(str(x) for x in [(k, p, '^' + p.replace('?', '[?]').replace('*', '.*')) for k, p in ROBOTS])}) AS v(kind, pattern, regex)
        WHERE u.host LIKE '%example.net' AND regexp_matches(u.p, regex) ORDER BY length(pattern) DESC, kind LIMIT 1) r ON true""")
def robots_rules(t, spark):
    """The rules of one robots.txt on all hosts of a domain: of those that match, with wildcards and end marks, the longest decides."""
    hosts = t("pages").select(urls.host(F.col("url")).alias("host")).where("endswith(host, 'example.net')").distinct()
    rules = hosts.select("host", F.lit("*").alias("agent"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern")) for k, p in ROBOTS])).alias("r")).select("host", "agent", "r.kind", "r.pattern")
    return filters.robots_allowed(t("pages"), rules, "loom").select("page_id", "url", "robots_rule", "allowed")


@query("SELECT page_id, url, page_id % 7 <> 0 AS is_canonical, page_id % 11 = 0 AS noindex, page_id % 13 = 0 AS nofollow FROM pages")
def page_directives(t, spark):
    """Directives put into the pages' heads, since the given pages have none: other canonical urls, robots tags."""
    tag = F.concat(F.when(F.col("page_id") % 7 == 0, "<link rel='canonical' href='https://other.example.org/x'>").otherwise(""), F.when((F.col("page_id") % 11 == 0) & (F.col("page_id") % 13 == 0), '<meta name="robots" content="none">').when(F.col("page_id") % 11 == 0, '<META content="noindex, follow" name=Robots>').when(F.col("page_id") % 13 == 0, '<meta name="robots" content="index,nofollow">').otherwise(""))
    p = t("pages").withColumn("html", F.concat(tag, "html"))
    robots = html.robots_meta(F.col("html"))
    return p.select("page_id", "url", filters.is_canonical(F.col("url"), F.col("html")).alias("is_canonical"), robots["noindex"].alias("noindex"), robots["nofollow"].alias("nofollow"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")
def property_restriction(t, spark):
    m = t("documents").withColumn("meta", F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source")))
    return m.where(filters.restricted(F.col("meta"), "lang", "EN", "basic", ignore_case=True) & filters.restricted(F.col("meta"), "source", "src1, src2, src3", "csv")).select("doc_id", "lang")


# ---- text index and search ----
@query(f"SELECT doc_id, 'text' AS field, token, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n FROM documents) GROUP BY doc_id, token")
def postings(t, spark):
    return search.postings(t("documents"), ["text"])


@query(f"SELECT 'text' AS field, token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def doc_freq(t, spark):
    # distinct tokens of a document are found in its row: nothing is shuffled but partial counts
    return search.field_tokens(t("documents"), ["text"]).select("field", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, 'text' AS field, CAST(len({TOKENS.format('text')}) AS BIGINT) AS length FROM documents")
def doc_len(t, spark):
    return search.document_lengths(t("documents"), ["text"])


def _bm25_sql(tokens_of: str, terms: list[str]) -> str:
    """(doc_id, field, score) of SQL that gives doc_id, field and the list toks."""
    names = ", ".join(f"'{x}'" for x in terms)
    return f"""SELECT p.doc_id, p.field, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.len / s.mean))) AS score
        FROM (SELECT doc_id, field, token, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, field, len(toks) AS len, unnest(toks) AS token FROM ({tokens_of})) WHERE token IN ({names}) GROUP BY doc_id, field, token) p
        JOIN (SELECT field, token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, field, unnest(toks) AS token FROM ({tokens_of})) WHERE token IN ({names}) GROUP BY field, token) d ON p.field = d.field AND p.token = d.token
        JOIN (SELECT field, count(*) AS n, avg(len(toks)) AS mean FROM ({tokens_of}) GROUP BY field) s ON p.field = s.field
        GROUP BY p.doc_id, p.field"""


DOC_TOKENS = f"SELECT doc_id, 'text' AS field, {TOKENS.format('text')} AS toks FROM documents"
H1 = PLAIN.replace("html,", "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1),", 1)
PAGE_TEXTS = f"SELECT page_id, url, {TITLE} AS title, {H1} AS description, {PLAIN} AS content FROM pages"
PAGE_TOKENS = " UNION ALL ".join(f"SELECT page_id AS doc_id, '{f}' AS field, {TOKENS.format(f)} AS toks FROM ({PAGE_TEXTS})" for f in ("title", "description", "content"))
BOOSTS = {"title": 3.0, "description": 2.0, "content": 1.0}


def page_texts(t) -> DataFrame:
    h = F.col("html")
    return t("pages").select("page_id", "url", html.title(h).alias("title"), html.heading(h).alias("description"), html.plain_text(h).alias("content"))


@query(f"SELECT doc_id, round(score, 6) AS _score FROM ({_bm25_sql(DOC_TOKENS, ['the', 'licensed'])}) WHERE field = 'text'")
def bm25_single(t, spark):
    s = search.field_scores(search.index_of(t("documents"), ["text"], ["the", "licensed"]), ["the", "licensed"])
    return s.select("doc_id", F.round("score", 6).alias("_score"))


@query(f"""SELECT page_id, url, title, _score FROM (SELECT doc_id, round(max(score * CASE field WHEN 'title' THEN 3 WHEN 'description' THEN 2 ELSE 1 END), 6) AS _score FROM ({_bm25_sql(PAGE_TOKENS, ['of', 'home', 'about'])}) GROUP BY doc_id)
    JOIN ({PAGE_TEXTS}) ON doc_id = page_id ORDER BY _score DESC, page_id LIMIT 50""")
def search_best_fields(t, spark):
    hits = search.search(page_texts(t), "Home of, about!", BOOSTS, 50, fuzzy=False, key="page_id", marked=False)
    return hits.select("page_id", "url", "title", F.round("_score", 6).alias("_score"))


def three_commits(t, spark) -> segments.SegmentedIndex:
    """The pages in three commits: those of even ids, with some that are deleted afterwards; all odd ids and other texts for every tenth; the first texts of these again."""
    p = cut(page_texts(t))
    fields = list(BOOSTS)
    index = segments.SegmentedIndex(spark, fresh_path(spark, "segments"), 8, 8)
    index = index.commit(p.where("page_id % 2 = 0").unionByName(p.where("page_id % 4 = 1").withColumn("content", F.lit("gone about home"))), fields, "page_id")
    index = index.commit(p.where("page_id % 4 = 3 or page_id % 10 = 0").withColumn("title", F.when(F.col("page_id") % 10 == 0, "home of an other text").otherwise(F.col("title"))), fields, "page_id", deletes=p.where("page_id % 4 = 1").select(F.col("page_id").alias("doc_id")))
    return index.commit(p.where("page_id % 4 = 1 or page_id % 10 = 0"), fields, "page_id")


@query(f"""SELECT page_id, _score FROM (SELECT doc_id AS page_id, round(max(score * CASE field WHEN 'title' THEN 3 WHEN 'description' THEN 2 ELSE 1 END), 6) AS _score FROM ({_bm25_sql(PAGE_TOKENS, ['of', 'home', 'about'])}) GROUP BY doc_id) ORDER BY _score DESC, page_id LIMIT 20""")
def search_pruned(t, spark):
    """The best hits of a segmented index after replacements and deletions, by blocks that can hold one of them: those of an index made anew."""
    found = three_commits(t, spark).search(["of", "home", "about"], BOOSTS, 20)
    return found.select(F.col("doc_id").alias("page_id"), F.round("_score", 6).alias("_score"))


@query(f"""SELECT field, token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, field, token, count(*) AS tf FROM (SELECT doc_id, field, unnest(toks) AS token FROM ({PAGE_TOKENS})) GROUP BY ALL) GROUP BY field, token""")
def index_segments(t, spark):
    """Words of a segmented index after three commits and a merge."""
    words = three_commits(t, spark).merge(into_one=True).live_words().select("doc_id", "field", F.explode("words").alias("w"))
    return words.groupBy("field", "w.token").agg(F.count(F.lit(1)).alias("df"), F.sum("w.tf").alias("tf"))


def _near_sql(tokens_of: str, terms: list[str]) -> str:
    """(term, field, token, edits) of SQL that gives field and the list toks: nearest tokens of each term and field, 50 at most.

    The function counts bytes and the terms are ASCII, so other characters are made one byte first.
    """
    return f"""SELECT term, field, token, edits FROM (SELECT term, field, token, edits, row_number() OVER (PARTITION BY term, field ORDER BY edits, token) AS place FROM (
            SELECT term, field, token, CAST(damerau_levenshtein(regexp_replace(token, '[^ -~]', '?', 'g'), term) AS INTEGER) AS edits FROM (SELECT DISTINCT field, unnest(toks) AS token FROM ({tokens_of})), (SELECT unnest({terms}) AS term))
        WHERE edits <= CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END) WHERE place <= 50"""


def _fuzzy_bm25_sql(tokens_of: str, terms: list[str]) -> str:
    """(doc_id, field, score): BM25 over the tokens near the terms, each by its own frequency."""
    return f"""SELECT p.doc_id, p.field, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.len / s.mean))) AS score
        FROM (SELECT doc_id, field, token, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, field, len(toks) AS len, unnest(toks) AS token FROM ({tokens_of})) WHERE (field, token) IN (SELECT (field, token) FROM ({_near_sql(tokens_of, terms)})) GROUP BY doc_id, field, token) p
        JOIN (SELECT field, token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, field, unnest(toks) AS token FROM ({tokens_of})) GROUP BY field, token) d ON p.field = d.field AND p.token = d.token
        JOIN (SELECT field, count(*) AS n, avg(len(toks)) AS mean FROM ({tokens_of}) GROUP BY field) s ON p.field = s.field GROUP BY p.doc_id, p.field"""


@query(_near_sql(DOC_TOKENS, ["licence", "thats", "or", "verison", "htat", "ilcensde"]))
def fuzzy_terms(t, spark):
    """Tokens within the edits that a search allows; an exchange of neighbours is one edit."""
    vocabulary = search.field_tokens(t("documents"), ["text"]).select("field", F.explode(F.array_distinct("tokens")).alias("token"))
    return search.fuzzy_terms(vocabulary, ["licence", "thats", "or", "verison", "htat", "ilcensde"])


_BOOST = "CASE field WHEN 'title' THEN 3 WHEN 'description' THEN 2 ELSE 1 END"


@query(f"""SELECT page_id, title, _score FROM (SELECT doc_id, round(max(score * {_BOOST}), 6) AS _score FROM ({_fuzzy_bm25_sql(PAGE_TOKENS, ['htat', 'wiht'])}) GROUP BY doc_id) JOIN ({PAGE_TEXTS}) ON doc_id = page_id ORDER BY _score DESC, page_id LIMIT 100""")
def search_fuzzy(t, spark):
    """Typo-tolerant search over an index that is written first: both words are misspelt."""
    pages, path = page_texts(t), fresh_path(spark, "index")
    search.write_index(pages, list(BOOSTS), path, "page_id", buckets=8, tasks_a_bucket=1)
    hits = search.search(pages, "htat wiht", BOOSTS, 100, key="page_id", index=search.Index.read(spark, path), marked=False)
    return hits.select("page_id", "title", F.round("_score", 6).alias("_score"))


@query(f"""SELECT id, path, title, type, size FROM (SELECT doc_id, max(score * {_BOOST}) AS _score FROM ({_bm25_sql(PAGE_TOKENS, ['of'])}) GROUP BY doc_id ORDER BY _score DESC, doc_id LIMIT 100)
    JOIN ({ROWS_SQL}) ON id = CAST(doc_id AS VARCHAR) WHERE contains(lower(path), 'of') OR contains(lower(title), 'of') OR contains(type, 'of')""")
def search_then_filter(t, spark):
    """Page rows of the hits that hold the query text itself: the quick filter over the ranked search."""
    hits = search.search(page_texts(t), "of", BOOSTS, 100, fuzzy=True, key="page_id", marked=False)
    rows = hits.select(*values.page_row(F.col("page_id"), F.col("url"), F.col("title"), F.lit("text/html"), F.col("content")), "_score")
    return search.table_view(rows, "of", ("title", "asc"), "_score").select("id", "path", "title", "type", "size")


@query(f"""SELECT page_id, _score FROM (SELECT doc_id AS page_id, round(max(score), 6) AS _score FROM ({_bm25_sql(PAGE_TOKENS, ['home', 'with'])}) GROUP BY doc_id) ORDER BY _score DESC, page_id LIMIT 30""")
def uri_search(t, spark):
    """``?q=home with&size=30``: all fields alike, no typos."""
    return search.uri_search(page_texts(t), "home with", list(BOOSTS), 30, "page_id").select("page_id", F.round("_score", 6).alias("_score"))


@query(f"SELECT count(DISTINCT doc_id) AS total, least(count(DISTINCT doc_id), 25) AS hits, true AS timed FROM ({_fuzzy_bm25_sql(PAGE_TOKENS, ['abuot', 'that'])})")
def search_response(t, spark):
    """The parts of a service's answer: all hits' number, how many came back, and that it tells its time."""
    r = search.response(page_texts(t), "abuot that", BOOSTS, 25, "page_id")
    return spark.createDataFrame([(r["total"], len(r["hits"]), r["took"] >= 0)], "total long, hits long, timed boolean")


_PIECES = r"list_transform(list_zip(regexp_extract_all(text, '(?s)(\S.{0,149})(?:\s|$)|(\S{1,150})', 1), regexp_extract_all(text, '(?s)(\S.{0,149})(?:\s|$)|(\S{1,150})', 2)), lambda z: coalesce(nullif(z[1], ''), z[2]))"


def _is_term(word: str, terms: list[str]) -> str:
    return f"translate({word}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ('{"', '".join(terms)}')"


def _marked_sql(of: str, terms: list[str]) -> str:
    """SQL of a text with its words out of ``terms`` marked. The engine's \\b knows ASCII alone and would find one before a letter with an accent, so the text is dealt into words and what is between them."""
    return rf"array_to_string(list_transform(regexp_extract_all({of}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), lambda w: CASE WHEN {_is_term('w', terms)} THEN '<em>' || w || '</em>' ELSE w END), '')"


_TERMS = ["licensed", "under", "version"]


@query(rf"""SELECT doc_id, array_to_string(list_transform(list_sort(list_filter(list_transform(range(1, len(ps) + 1), lambda i: {{'n': -len(list_filter(regexp_extract_all(ps[i], '[\p{{L}}\p{{N}}]+'), lambda w: {_is_term('w', _TERMS)})), 'i': i}}), lambda r: r.n < 0))[1:2],
    lambda r: {_marked_sql('ps[r.i]', _TERMS)}), ' ... ') AS fragments FROM (SELECT doc_id, {_PIECES} AS ps FROM documents WHERE contains(lower(text), 'licensed'))""")
def content_fragments(t, spark):
    """The two best pieces of 150 characters of each text that holds the word."""
    d = t("documents").where(F.contains(F.lower("text"), F.lit("licensed")))
    return d.select("doc_id", F.array_join(text.fragments(F.col("text"), ["licensed", "under", "version"]), " ... ").alias("fragments"))


def _fragments_sql(terms: list[str], size: int, number: int) -> str:
    """Windows of the occurrences' offsets, best first; the next one is chosen from what doesn't overlap those before it. Words are marked by a pattern."""
    w = r"[\p{L}\p{N}]"
    steps = ""
    for k in range(number):
        of = f"c{k}"
        steps += f""",
    p{k} AS (SELECT doc_id, {k} AS k, f, l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, n, f, l) AS r FROM {of}) WHERE r = 1),
    c{k + 1} AS (SELECT c.* FROM {of} c JOIN p{k} p USING (doc_id) WHERE c.l <= p.f OR c.f >= p.l)"""
    picked = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(number))
    words = "|".join(terms)
    return rf"""WITH pieces AS (SELECT doc_id, lead, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, length(regexp_extract(text, '^[^\p{{L}}\p{{N}}]*')) AS lead, regexp_extract_all(text, '{w}+[^\p{{L}}\p{{N}}]*') AS ps FROM documents)),
    placed AS (SELECT doc_id, regexp_extract(p, '^{w}+') AS word, CAST(lead + sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(p) AS BIGINT) AS a FROM pieces),
    occ AS (SELECT doc_id, lower(word) AS token, a, a + length(word) AS z FROM placed WHERE lower(word) IN ('{"', '".join(terms)}')),
    own AS (SELECT x.doc_id, x.a, -count(DISTINCT y.token) AS d, -count(*) AS n, max(y.z) AS e FROM occ x JOIN occ y ON x.doc_id = y.doc_id AND y.a >= x.a AND y.z <= greatest(x.a + {size}, x.z) GROUP BY x.doc_id, x.a, x.z),
    c0 AS (SELECT doc_id, d, n, f, greatest(f + {size}, e) AS l FROM (SELECT *, greatest(0, a - greatest(0, {size} - (e - a)) // 2) AS f FROM own)){steps},
    ends AS (SELECT doc_id, k, text, f + CASE WHEN f > 0 AND regexp_matches(substr(text, f, 1), '{w}') THEN length(regexp_extract(substr(text, f + 1, l - f), '^{w}*')) ELSE 0 END AS lo,
        CASE WHEN length(text) > l AND regexp_matches(substr(text, l + 1, 1), '{w}') THEN l - length(regexp_extract(substr(text, f + 1, l - f), '{w}*$')) ELSE least(l, length(text)) END AS hi FROM ({picked}) JOIN documents USING (doc_id))
    SELECT doc_id, string_agg(trim(regexp_replace(substr(text, lo + 1, hi - lo), '(?i)\b({words})\b', '<em>\1</em>', 'g'), E' \t\r\n'), ' ... ' ORDER BY k) AS fragments FROM ends GROUP BY doc_id"""


@query(_fragments_sql(["licensed", "under", "version"], 100, 5))
def field_fragments(t, spark):
    """Up to five fragments of 100 characters of each text that holds a term, chosen by the terms' stored places."""
    d, terms, path = t("documents").select("doc_id", "text"), ["licensed", "under", "version"], fresh_path(spark, "places")
    positions.write_places(d, ["text"], path, buckets=8, tasks_a_bucket=2)
    found = positions.field_fragments(d, positions.read_places(spark, path, terms), ["text"])
    return found.select("doc_id", F.array_join("fragments", " ... ").alias("fragments"))


@query(f"SELECT doc_id, CAST(place AS BIGINT) AS place, row_number() OVER (PARTITION BY doc_id, token ORDER BY place) AS nth FROM (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS place FROM (SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents)) WHERE token = 'the'")
def word_places(t, spark):
    """Every place of a word, and which of the document's it is."""
    found = positions.places(t("documents"), ["text"]).where("token = 'the'")
    return found.select("doc_id", F.col("at").cast("long").alias("place"), F.row_number().over(Window.partitionBy("doc_id", "token").orderBy("at")).cast("long").alias("nth"))


@query("SELECT doc_id, 1.0::DOUBLE AS _score FROM documents ORDER BY doc_id LIMIT 50")
def match_all(t, spark):
    return search.match_all(t("documents"), 50).select("doc_id", "_score")


@query(f"SELECT count(DISTINCT doc_id) AS total FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) WHERE token IN ('licensed', 'version')")
def hit_count(t, spark):
    return search.total_hits(search.index_of(t("documents"), ["text"], ["licensed", "version"]), ["licensed", "version"])


@query("SELECT 'green' AS health, 'documents' AS index, count(CASE WHEN doc_id % 10 <> 0 THEN 1 END) AS docs_count, count(CASE WHEN doc_id % 10 = 0 THEN 1 END) AS docs_deleted, CAST(sum(length(text)) AS BIGINT) AS store_size FROM documents")
def index_stats(t, spark):
    """Every tenth document is marked as deleted."""
    return search.index_stats(t("documents"), "documents", ["text"], F.col("doc_id") % 10 == 0)


@query(rf"SELECT doc_id, {_marked_sql('text', ['licensed', 'under', 'the'])} AS text FROM documents WHERE len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda w: {_is_term('w', ['licensed'])})) > 0")
def highlighted(t, spark):
    d = t("documents").where(F.col("text").rlike(text.whole_words(["licensed"])))
    return d.select("doc_id", text.highlight(F.col("text"), ["licensed", "under", "the"]).alias("text"))


# ---- links and frontier ----
HREFS = r"regexp_extract_all(html, '(?is)<a\s[^>]*?href=\"([^\"]*)\"', 1)".replace('\\"', '"')
ABS = f"CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN {SCHEME} || {AUTH} || href ELSE {SCHEME} || {AUTH} || CASE WHEN regexp_replace({PATH}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '[^/]*$', '') END || href END"
EDGES = f"SELECT url AS src, regexp_replace({ABS}, '#.*$', '') AS dst FROM (SELECT url, unnest({HREFS}) AS href FROM pages) WHERE href <> ''"


def page_edges(t) -> DataFrame:
    return links.edges(t("pages"))


@query(EDGES)
def page_links(t, spark):
    return page_edges(t).select("src", "dst")


@query(f"SELECT src AS url, 'URLS_EXTRACTED' AS event, count(*) AS links FROM ({EDGES}) GROUP BY src")
def link_counts(t, spark):
    return links.link_events(page_edges(t))


@query(f"""SELECT src, dst, CASE WHEN NOT starts_with(dst, 'https://') THEN 'OUTSCOPE' WHEN page_id % 3 >= 2 THEN 'MAXDEPTH' ELSE 'INSCOPE' END AS class
    FROM ({EDGES}) JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) ON src = url""")
def links_scope_class(t, spark):
    depths = t("pages").groupBy("url").agg((F.min("page_id") % 3).alias("depth"))
    return links.classified(page_edges(t), F.col("dst").startswith("https://"), depths, 2).select("src", "dst", "class")


@query(f"SELECT dst AS url, arg_min(src, (page_id % 3, src)) AS referrer FROM ({EDGES}) JOIN pages ON url = src GROUP BY dst")
def first_referrers(t, spark):
    """Of pages at three depths the shallowest refers."""
    depths = t("pages").select("url", (F.col("page_id") % 3).alias("depth"))
    return links.referrers(page_edges(t), depths).select("url", "referrer")


_SECTION = "regexp_replace({0}, '^(https?://[^/]*/[^/?#]*).*$', '\\1')"
_ROOT = "regexp_replace({0}, '^(https?://[^/?#]*).*$', '\\1/')"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, {_SECTION.format('dst')} AS dst FROM ({EDGES}) UNION SELECT {_SECTION.format('url')} AS src, url AS dst FROM pages UNION SELECT {_ROOT.format('url')} AS src, {_SECTION.format('url')} AS dst FROM pages),
    d AS (SELECT DISTINCT {_ROOT.format('url')} AS url, 0 AS depth FROM pages UNION SELECT e.dst AS url, depth + 1 AS depth FROM d JOIN e ON d.url = e.src WHERE depth < 8) SELECT url, min(depth) AS depth FROM d GROUP BY url""")
def frontier_bfs(t, spark):
    """From every host's root until a depth is empty. Links point at pages that are not stored, so sections, which link to their pages, stand between."""
    section = lambda c: F.regexp_replace(c, "^(https?://[^/]*/[^/?#]*).*$", "$1")
    root = F.regexp_replace("url", "^(https?://[^/?#]*).*$", "$1/")
    p = t("pages")
    e = page_edges(t).select("src", section("dst").alias("dst")).union(p.select(section("url").alias("src"), F.col("url").alias("dst"))).union(p.select(root.alias("src"), section("url").alias("dst")))
    return frontier.breadth_first(p.select(root.alias("url")), e, -1).select("url", "depth")


@query(f"SELECT url, min(depth) AS depth FROM (SELECT regexp_replace({CHAIN_SQL}, '$', '') AS url, CAST(page_id % 4 AS INTEGER) AS depth FROM pages) WHERE starts_with(url, 'https://') AND contains(url, '/en/') AND depth <= 2 GROUP BY url")
def queue_pipeline(t, spark):
    c = t("pages").select("url", (F.col("page_id") % 4).cast("int").alias("depth"))
    return frontier.queue_pipeline(c, CHAIN, F.col("url").startswith("https://"), [filters.Filter(F.col("url").contains("/en/"))], 2)


@query("SELECT CAST(page_id AS VARCHAR) AS url, CAST(page_id - page_id % 4 AS VARCHAR) AS target, CAST(page_id % 4 AS BIGINT) AS hops, true AS complete FROM pages WHERE page_id % 4 <> 0")
def redirect_trails(t, spark):
    """Chains of up to three redirects, each page to the one before it."""
    r = t("pages").where("page_id % 4 <> 0").select(F.col("page_id").cast("string").alias("url"), (F.col("page_id") - 1).cast("string").alias("target"))
    return frontier.redirect_trails(r).select("url", "target", F.size("trail").cast("long").alias("hops"), "complete")


@query("SELECT page_id, url FROM pages WHERE page_id % 3 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 <> 0)")
def orphans(t, spark):
    p = t("pages").select("page_id", "url")
    return frontier.orphans(p.where("page_id % 3 = 0"), p.where("page_id % 3 <> 0"))


@query("""SELECT page_id, url AS loc, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS lastmod, CASE page_id % 3 WHEN 0 THEN 'DAILY' WHEN 1 THEN 'NEVER' ELSE 'WEEKLY' END AS changefreq, CAST(page_id % 10 / 10.0 AS FLOAT) AS priority FROM pages
    UNION ALL SELECT page_id, url || '/sitemap.xml' AS loc, NULL AS lastmod, NULL AS changefreq, NULL AS priority FROM pages WHERE page_id % 4 = 3""")
def sitemap_entries(t, spark):
    """Pages as sitemaps of one entry each, and some as index files, read back; an entry without a place is left out."""
    i = F.col("page_id")
    xml = F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc><lastmod>2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod><changefreq>"), F.element_at(F.array(*map(F.lit, ("daily", "never", "weekly"))), (i % 3 + 1).cast("int")), F.lit("</changefreq><priority>"), (i % 10 / 10).cast("string"), F.lit("</priority></url><url><loc> </loc></url></urlset>"))
    xml = F.concat(xml, F.when(i % 4 == 3, F.concat(F.lit("<sitemapindex>\n<sitemap><loc> "), "url", F.lit("/sitemap.xml</loc></sitemap></sitemapindex>"))).otherwise(""))
    return t("pages").select("page_id", F.explode(frontier.sitemap_entries(xml)).alias("e")).select("page_id", "e.loc", "e.lastmod", "e.changefreq", "e.priority")


@query("SELECT crawler_id, count(*) AS docs FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS crawler_id FROM pages) GROUP BY crawler_id")
def multi_crawler(t, spark):
    p = t("pages").select("page_id", "url")
    return frontier.with_crawler(even=p.where("page_id % 2 = 0"), odd=p.where("page_id % 2 = 1")).groupBy("crawler_id").agg(F.count(F.lit(1)).alias("docs"))


# ---- recrawl ----
@query("SELECT min(doc_id) AS doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def dedup_checksum(t, spark):
    d = t("documents").where("text is not null").select("doc_id", recrawl.content_checksum(F.col("text")).alias("checksum"))
    return recrawl.without_duplicates(d, F.col("checksum"), "doc_id")


@query("""SELECT user_id, last_crawl, epoch(TIMESTAMP '2100-01-01') - epoch(last_crawl) >= CASE WHEN user_id % 10 = 1 THEN 864000000000 WHEN user_id % 2 = 0 THEN 86400 ELSE 0 END AS due
    FROM (SELECT user_id, max(ts) AS last_crawl FROM events GROUP BY user_id)""")
def recrawl_due(t, spark):
    last = t("events").groupBy("user_id").agg(F.max("ts").alias("last_crawl")).withColumn("url", F.concat(F.lit("u/"), "user_id"))
    rules = [("url", "u/.*1", timedelta(days=10_000_000)), ("url", "u/.*[02468]", timedelta(days=1))]
    return recrawl.recrawl_due(last, rules, F.lit("2100-01-01").cast("timestamp")).select("user_id", "last_crawl", "due")


@query(f"""SELECT page_id, url, delay_ms, CAST(coalesce(sum(delay_ms) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
    FROM (SELECT page_id, url, {HOST} AS host, CAST(CASE WHEN contains(url, '/en/') THEN 250 ELSE 1000 END AS BIGINT) AS delay_ms FROM pages)""")
def delay_schedule(t, spark):
    delay = recrawl.delay_ms(F.col("url"), F.lit("2024-01-01").cast("timestamp"), 1000, patterns=[(".*/en/.*", 250)])
    return recrawl.fetch_schedule(t("pages").select("page_id", "url"), delay, ["page_id"])


# ---- jobs and events ----
def _crawl_sql() -> str:
    """Three crawls of the pages and what becomes of their urls, crawl by crawl."""
    crawls = {
        1: "SELECT url, md5(html) AS c FROM pages WHERE page_id % 3 <> 0",
        2: "SELECT CASE WHEN page_id % 7 = 0 THEN url || '?moved' ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN md5(html || 'x') ELSE md5(html) END AS c FROM pages WHERE page_id % 3 <> 1",
        3: "SELECT url, md5(html) AS c FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url || '?copy' AS url, md5(html) AS c FROM pages WHERE page_id % 6 = 0",
    }
    parts = ["s0 AS (SELECT NULL AS url, NULL AS c WHERE false)"]
    for k, sql in crawls.items():
        parts.append(f"s{k} AS (SELECT url, min(c) AS c FROM ({sql}) WHERE url IS NOT NULL GROUP BY url)")
        old, new = f"s{k - 1}", f"s{k}"
        parts.append(f"""left{k} AS (SELECT c, min(url) AS url FROM {old} WHERE url NOT IN (SELECT url FROM {new}) GROUP BY c), copy{k} AS (SELECT {old}.c, min({old}.url) AS url FROM {old} JOIN {new} ON {old}.url = {new}.url AND {old}.c = {new}.c GROUP BY {old}.c),
            r{k} AS (SELECT n.url, CASE WHEN o.url IS NOT NULL THEN CASE WHEN o.c = n.c THEN 'unchanged' ELSE 'changed' END WHEN l.url IS NOT NULL THEN 'moved' WHEN d.url IS NOT NULL THEN 'duplicate' ELSE 'new' END AS status, CASE WHEN o.url IS NULL THEN coalesce(l.url, d.url) END AS other
                FROM {new} n LEFT JOIN {old} o ON n.url = o.url LEFT JOIN left{k} l ON n.c = l.c LEFT JOIN copy{k} d ON n.c = d.c UNION ALL SELECT url, 'gone' AS status, NULL AS other FROM {old} WHERE url NOT IN (SELECT url FROM {new}))""")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS crawl, url, status, CAST(other AS VARCHAR) AS other FROM r{k}" for k in crawls)


@query(_crawl_sql())
def crawl_changes(t, spark):
    """Three crawls merged into a store one after the other: what is new, changed, moved, a duplicate or gone each time."""
    p = t("pages").select("page_id", "url", "html")
    one = p.where("page_id % 3 <> 0").select("url", F.md5("html").alias("checksum"))
    moved, new = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("?moved"))).otherwise(F.col("url")), F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    two = p.where("page_id % 3 <> 1").select(moved.alias("url"), F.md5(new).alias("checksum"))
    three = p.where("page_id % 2 = 0").select("url", F.md5("html").alias("checksum")).union(p.where("page_id % 6 = 0").select(F.concat("url", F.lit("?copy")), F.md5("html")))
    store, out = crawl_store.CrawlStore(spark, buckets=8), None
    for k, crawl in enumerate((one, two, three), 1):
        part = cut(store.merge(crawl, k))
        out = part if out is None else out.union(part)
    store.drop()
    return out


_LINKS = "SELECT url || '#' || page_id AS url, (CASE WHEN page_id % 64 <> 0 THEN lag(url || '#' || page_id) OVER (ORDER BY page_id) WHEN page_id % 128 = 64 THEN max(CASE WHEN page_id % 64 = 63 THEN url || '#' || page_id END) OVER (PARTITION BY page_id // 64) END) AS target FROM pages"


@query(f"""WITH RECURSIVE l AS ({_LINKS}), step AS (SELECT url, target FROM l WHERE target IS NOT NULL), walk AS (SELECT url, url AS place, CAST(0 AS BIGINT) AS hops FROM l UNION ALL SELECT w.url, s.target AS place, w.hops + 1 AS hops FROM walk w JOIN step s ON w.place = s.url WHERE w.hops < 200),
    ended AS (SELECT url, place AS canonical, hops, false AS loop FROM walk WHERE place NOT IN (SELECT url FROM step)),
    looped AS (SELECT url, min(place) AS canonical, CAST(NULL AS BIGINT) AS hops, true AS loop FROM walk WHERE hops >= 100 AND url NOT IN (SELECT url FROM ended) GROUP BY url)
    SELECT * FROM ended UNION ALL SELECT * FROM looped""")
def canonical_groups(t, spark):
    """Redirects and canonical links of the pages in chains of up to 63 hops, every second of them a loop."""
    p = t("pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    before = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("previous"))
    last = p.where("page_id % 64 = 63").select((F.col("page_id") - 63).alias("page_id"), F.col("url").alias("closing"))
    linked = p.join(before.hint("merge"), "page_id", "left").join(last.hint("merge"), "page_id", "left")  # as large as the pages
    target = F.when(F.col("page_id") % 64 != 0, F.col("previous")).when(F.col("page_id") % 128 == 64, F.col("closing"))
    return frontier.canonical_groups(linked.select("url", target.alias("target")))


@query("""WITH v AS (SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, ts)
    SELECT e.event_id, e.user_id, v.version FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'signup')) e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def version_held(t, spark):
    """The version that held when something happened: of each user's purchases and sign-ups, the last page event not after it."""
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    versions = e.where("event_type in ('click', 'view')").select("user_id", "ts", F.col("event_id").alias("version"))
    return recrawl.as_of(e.where("event_type in ('purchase', 'signup')").drop("event_type"), versions, "user_id", "ts", ["version"]).select("event_id", "user_id", "version")


def job_events(t) -> DataFrame:
    """The event table as jobs of users: their first event starts a job, clicks and views are pages, a purchase finishes it."""
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type").isin("click", "view"), "page").when(F.col("event_type") == "purchase", "finished")
    run = F.col("user_id").cast("string")
    target = F.concat(F.when(F.col("user_id") % 5 == 0, "http://error/").otherwise("http://site/"), run)
    page = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("path"), F.lit("t").alias("title"), F.lit("html").alias("type"), F.lit(1).cast("long").alias("size"))
    e = t("events").select(run.alias("run_id"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("at"), kind.alias("kind"), target.alias("target_url"), page.alias("page"))
    return e.where("kind is not null")


STATES_SQL = """SELECT run_id, target_url, CASE WHEN finished THEN CASE WHEN contains(coalesce(target_url, ''), 'error') THEN 'failed' ELSE 'complete' END WHEN pages > 0 THEN 'running' ELSE 'pending' END AS status,
    CAST(least(100, pages * 100 // 10) AS INTEGER) AS progress, pages AS num_pages_indexed, started_at FROM (
    SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN count(CASE WHEN event_type = 'signup' THEN 1 END) > 0 THEN CASE WHEN user_id % 5 = 0 THEN 'http://error/' ELSE 'http://site/' END || user_id END AS target_url,
        count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS pages, count(CASE WHEN event_type = 'purchase' THEN 1 END) > 0 AS finished, CAST(floor(epoch(min(CASE WHEN event_type = 'signup' THEN ts END))) AS DOUBLE) AS started_at
    FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase') GROUP BY user_id)"""


@query(STATES_SQL)
def job_status(t, spark):
    return jobs.job_states(job_events(t)).drop("error_message")


@query(f"SELECT target_url AS url, run_id AS \"runId\", CAST(num_pages_indexed AS INTEGER) AS pages, status FROM ({STATES_SQL}) WHERE started_at IS NOT NULL ORDER BY started_at DESC, run_id LIMIT 20")
def recent_runs(t, spark):
    return jobs.recent_runs(jobs.job_states(job_events(t)).where("started_at is not null"), 20)


@query(f"SELECT run_id, CAST(event_id AS VARCHAR) AS id, event_type AS path FROM events JOIN ({STATES_SQL}) ON run_id = CAST(user_id AS VARCHAR) WHERE event_type IN ('click', 'view') AND status IN ('running', 'complete')")
def job_results(t, spark):
    e = job_events(t)
    return jobs.page_results(e, jobs.job_states(e)).select("run_id", "page.id", "page.path")


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 100 // count(*) OVER (PARTITION BY user_id) AS INTEGER) AS progress
    FROM events WHERE event_type IN ('click', 'view')""")
def job_progress(t, spark):
    return jobs.progress_events(job_events(t).where("kind = 'page'").select("run_id", "seq"), ["seq"])


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS time, upper(event_type) AS level, 200 + CAST(event_id % 5 AS INTEGER) AS status, 'GET' AS method, '/p/' || user_id AS path, CAST(event_id * 7 AS BIGINT) AS bytes FROM events")
def log_parse(t, spark):
    """Events written as log lines and parsed again."""
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" ["), F.upper("event_type"), F.lit("] status="), (F.col("event_id") % 5 + 200).cast("string"), F.lit(" method=GET path=/p/"), "user_id", F.lit(" bytes="), (F.col("event_id") * 7).cast("string"))
    return t("events").select("event_id", *jobs.parse_log(line))


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY event_type")
def event_counts(t, spark):
    return jobs.event_counts(t("events").withColumnRenamed("event_type", "event"))


@query("""WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    g AS (SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, max(CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 5 = 0 THEN 'http://error/' ELSE 'http://site/' END || user_id END) AS target_url,
        count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS pages, bool_or(event_type = 'purchase') AS finished FROM s GROUP BY user_id, k)
    SELECT run_id, session_start, session_end, target_url, pages, CAST(least(100, pages * 100 // 10) AS INTEGER) AS progress, CASE WHEN finished AND NOT contains(coalesce(target_url, ''), 'error') THEN 'complete' ELSE 'failed' END AS status,
    CASE WHEN NOT finished THEN 'silent for 21600 seconds' WHEN contains(coalesce(target_url, ''), 'error') THEN 'crawl failed: ' || target_url END AS error_message
    FROM g WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase'))""")
def run_sessions(t, spark):
    """Runs by silence of six hours, as far as they have ended when events may come an hour late."""
    e = job_events(t).join(t("events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at_time")), "seq")
    return sessions.ended(sessions.run_sessions(e, 6 * 3600), e, "1 hour")


@query("""SELECT event_type, crawler, CAST(grouping(event_type, crawler) AS BIGINT) AS level, count(*) AS events, count(DISTINCT user_id) AS "distinct"
    FROM (SELECT event_type, 'c' || user_id % 3 AS crawler, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21') GROUP BY GROUPING SETS ((event_type, crawler), (event_type), (crawler), ())""")
def event_cube(t, spark):
    """Events and distinct users of 16 days by type and crawler, from kept days, of which two are counted twice."""
    e = t("events").select("ts", "user_id", "event_type", F.concat(F.lit("c"), F.col("user_id") % 3).alias("crawler"))
    path = fresh_path(spark, "days")
    rollups.keep(rollups.by_day(e, ["event_type", "crawler"], "user_id"), path)
    rollups.keep(rollups.by_day(e.where("ts >= '2024-01-10' and ts < '2024-01-12'"), ["event_type", "crawler"], "user_id"), path)
    return rollups.cube(rollups.kept(spark, path, "2024-01-05", "2024-01-20"), [["event_type", "crawler"], ["event_type"], ["crawler"], []])


@query("SELECT event_id, url, status, crawler_id FROM (SELECT event_id, 'u/' || user_id AS url, CASE event_type WHEN 'error' THEN 500 + CAST(event_id % 4 AS INTEGER) ELSE 200 END AS status, 'c' || user_id % 3 AS crawler_id FROM events) WHERE (status = 404 OR status BETWEEN 500 AND 502) AND crawler_id IN ('c0', 'c2')")
def url_status(t, spark):
    e = t("events").select("event_id", F.concat(F.lit("u/"), "user_id").alias("url"), F.when(F.col("event_type") == "error", 500 + (F.col("event_id") % 4).cast("int")).otherwise(200).alias("status"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("crawler_id"))
    return files.url_status(e, "404,500-502", ["c0", "c2"])


# ---- whole pipelines ----
@query(f"""SELECT min(u) AS url, any_value(title) AS title, sha256(content) AS checksum FROM (SELECT url AS u, {TITLE} AS title, {PLAIN} AS content FROM pages WHERE page_id % 11 <> 0 AND page_id % 7 <> 0) GROUP BY content""")
def import_pipeline(t, spark):
    """The configured steps as they are: robots tag, canonical, text, duplicates. Some pages get a tag that one of the first two refuses."""
    tag = F.when(F.col("page_id") % 11 == 0, '<meta name="robots" content="noindex">').when(F.col("page_id") % 7 == 0, "<link rel=canonical href='https://other.example.org/x'>").otherwise("")
    kept = config.import_pages(t("pages").select("url", F.concat(tag, "html").alias("html")))
    return kept.select("url", "title", recrawl.content_checksum(F.col("content")).alias("checksum"))


@query("SELECT page_id, url, 'loom' AS \"SITE\" FROM pages WHERE regexp_matches(url, '/(en|de)/')")
def configured_steps(t, spark):
    steps = [{"class": "com.example.ReferenceFilter", "pattern": ".*/(en|de)/.*"}, {"class": "ConstantTagger", "SITE": "loom"}, {"class": "DeleteTagger", "pattern": "html"}]
    return t("pages").transform(config.STEPS.pipeline(steps))
