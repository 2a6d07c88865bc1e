"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import text as X
from weblens.functions import urls as U
from weblens.session import table

MAX_YEAR = 2027
_P = r"regexp_extract(trim(url), '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', {0})"
_HOST = f"lower(split_part(list_extract(string_split({_P.format(2)}, '@'), -1), ':', 1))"
_TOK = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '([a-z0-9]{{2,}})', 1))"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits")


def url_parts(spark, d):
    u = F.col("url")
    return _hits(spark, d).where("url is not null").select("hit_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.mask(u).alias("masked"))


def norm_url(spark, d):
    return _hits(spark, d).where("url is not null").select("hit_id", U.norm_url(F.col("url")).alias("norm_url"))


def url_date(spark, d):
    return _hits(spark, d).where("url is not null").select("hit_id", U.url_date(F.col("url"), MAX_YEAR).alias("url_date"))


def authoritative(spark, d):
    return _hits(spark, d).where("url is not null").select("hit_id", U.is_authoritative(F.col("url")).alias("authoritative"))


def validate_url(spark, d):
    return _hits(spark, d).where("url is not null").select("hit_id", U.is_valid(F.col("url")).alias("valid"), U.is_pdf(F.col("url")).alias("pdf"))


def registrable_domain(spark, d):
    return _hits(spark, d).where("url is not null").select("hit_id", U.registrable_domain(U.host(F.col("url"))).alias("domain"))


def host_matches(spark, d):
    """Sources fetched from the host they were asked for, or a sub-domain either way."""
    s = table(spark, d, "research_sources").where("url is not null and final_url is not null")
    a, b = U.host(F.col("url")), U.host(F.col("final_url"))
    return s.select("src_id", U.same_host(a, b).alias("same_host"), U.host_matches(a, U.registrable_domain(b)).alias("in_domain")).distinct()


def cache_key(spark, d):
    return table(spark, d, "documents").where("url is not null").select("doc_id", U.cache_key(F.col("url"), F.lit('{"format": "markdown"}')).alias("key"))


def content_signature(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("signature"))


def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(X.tokens(F.col("text"))).alias("tokens"))


def norm_title(spark, d):
    return _hits(spark, d).select("hit_id", X.norm_title(F.col("title")).alias("title"))


def sentences(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def scorer_sentences(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.scorer_sentences(F.col("text"))).alias("pos", "unit"))


def sanitize_md(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.sanitize(F.col("text")).alias("plain"))


def html_escape(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.html_escape(F.col("text")).alias("escaped"))


def char_cap(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.substring(t, 1, 500).alias("content"), (F.length(t) > 500).alias("truncated"), F.length(t).alias("full_chars"))


def hms_format(spark, d):
    return table(spark, d, "events").select("event_id", X.hms(F.col("value") * 100).alias("hms"))


def token_overlap(spark, d):
    h = _hits(spark, d).select("hit_id", X.tokens(F.col("title")).alias("a"), X.tokens(F.col("snippet")).alias("b"))
    return h.select("hit_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_title"), F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def is_conceptual(spark, d):
    return table(spark, d, "eval_items").select("item_id", X.is_conceptual(F.col("query")).alias("conceptual"))


def strict_date(spark, d):
    return table(spark, d, "ff_calendar_sample").select("event_id", "date", X.iso_date(F.col("date")).alias("day")).distinct()


def clamp_score(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1)).alias("score"))


def pct_change(spark, d):
    o = table(spark, d, "lineitem")
    return o.select("l_orderkey", "l_linenumber", F.round(F.try_divide((F.col("l_extendedprice") - F.col("l_quantity")) * 100, F.col("l_quantity")), 1).alias("pct"))


def redirect_changes(spark, d):
    """Hosts that answer from another host, with how often."""
    s = table(spark, d, "research_sources").where("url is not null and final_url is not null").select("src_id", U.host(F.col("url")).alias("asked"), U.host(F.col("final_url")).alias("answered")).distinct()
    return s.where("asked <> answered").groupBy("asked", "answered").agg(F.count("*").alias("n"))


def page_metadata(spark, d):
    """Title, language and host of raw pages, by pattern."""
    p = table(spark, d, "fetched_pages").where("html is not null")
    return p.select("page_id", F.nullif(F.trim(F.regexp_extract("html", "(?is)<title>([^<]*)", 1)), F.lit("")).alias("title"), F.nullif(F.regexp_extract("html", '(?i)<html[^>]*lang="([^"]*)"', 1), F.lit("")).alias("lang"), U.host(F.col("final_url")).alias("host")).distinct()


def meta_charset(spark, d):
    p = table(spark, d, "fetched_pages").where("html is not null")
    return p.select("page_id", F.lower(F.nullif(F.regexp_extract(F.substring("html", 1, 2048), "(?i)<meta[^>]+?charset=[\"']?\\s*([A-Za-z0-9_.:-]+)", 1), F.lit(""))).alias("charset")).distinct()


def visible_text_len(spark, d):
    p = table(spark, d, "fetched_pages").where("html is not null")
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), "(?s)<[^>]*>", " ")
    return p.select("page_id", F.length(F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))).alias("chars")).distinct()


QUERIES = {f.__name__: f for f in (url_parts, norm_url, url_date, authoritative, validate_url, registrable_domain, host_matches, cache_key, content_signature, tokens, norm_title, sentences, scorer_sentences, sanitize_md, html_escape, char_cap, hms_format, token_overlap, is_conceptual, strict_date, clamp_score, pct_change, redirect_changes, page_metadata, meta_charset, visible_text_len)}

_AUTH = "|".join((s if s.startswith(".") else "." + s).replace(".", r"\.") for s in U.AUTHORITY_SUFFIXES)
_SUFFIX = f"(CASE WHEN array_to_string(list_slice(string_split({{0}}, '.'), -2, -1), '.') IN {_LIST(U.TWO_LABEL_SUFFIXES)} THEN array_to_string(list_slice(string_split({{0}}, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split({{0}}, '.'), -2, -1), '.') END)"
_F = _HOST.replace("url", "final_url")


def _date(pattern: str) -> str:
    p = _P.format(3)
    parts = [f"regexp_extract_all({p}, '{pattern}', {i})" for i in (1, 2, 3)]
    return f"""list_extract(list_filter(list_transform(generate_series(1, len({parts[0]})), lambda i: CASE WHEN CAST({parts[0]}[i] AS INT) BETWEEN 1995 AND {MAX_YEAR}
      AND TRY_CAST({parts[0]}[i] || '-' || {parts[1]}[i] || '-' || CASE WHEN {parts[2]}[i] = '' THEN '01' ELSE {parts[2]}[i] END AS DATE) IS NOT NULL
      THEN {parts[0]}[i] || '-' || {parts[1]}[i] || CASE WHEN {parts[2]}[i] = '' THEN '' ELSE '-' || {parts[2]}[i] END END), lambda x: x IS NOT NULL), 1)"""


_GLYPH = "regexp_replace(text, ' *— *', ' - ', 'g')"
for _a, _b in X.GLYPHS.items():
    _GLYPH = f"replace({_GLYPH}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
ORACLES = {
    "url_parts": f"SELECT hit_id, lower({_P.format(1)}) AS scheme, {_HOST} AS host, {_P.format(3)} AS path, lower({_P.format(1)}) || '://' || {_HOST} || '/***' AS masked FROM search_hits WHERE url IS NOT NULL",
    "norm_url": f"""WITH p AS (SELECT hit_id, lower(regexp_replace({_P.format(2)} || {_P.format(3)}, '/+$', '')) AS base,
      array_to_string(list_sort(list_filter(string_split({_P.format(4)}, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN {_LIST(U.TRACKING_PARAMS)})), '&') AS qs FROM search_hits WHERE url IS NOT NULL)
      SELECT hit_id, CASE WHEN qs = '' THEN base ELSE base || '?' || qs END AS norm_url FROM p""",
    "url_date": rf"SELECT hit_id, coalesce({_date(r'/(\d{4})/(\d{2})(?:/(\d{2}))?(?:/|$)')}, {_date(r'/(\d{4})-(\d{2})-(\d{2})(?:\D|$)')}, {_date(r'/(\d{4})(\d{2})(\d{2})(?:/|$)')}) AS url_date FROM search_hits WHERE url IS NOT NULL",
    "authoritative": rf"SELECT hit_id, regexp_matches(regexp_replace({_HOST}, '^www\.', ''), '^(?:{'|'.join(p.replace('.', r'\.') for p in U.AUTHORITY_PREFIXES)})') OR regexp_matches('.' || regexp_replace({_HOST}, '^www\.', ''), '(?:{_AUTH})$') AS authoritative FROM search_hits WHERE url IS NOT NULL",
    "validate_url": rf"""SELECT hit_id, lower({_P.format(1)}) IN ('http', 'https') AND {_HOST} <> '' AND (regexp_extract({_P.format(2)}, ':([^:\]]*)$', 1) = '' OR coalesce(TRY_CAST(regexp_extract({_P.format(2)}, ':(\d{{1,5}})$', 1) AS INT) <= 65535, false)) AS valid,
      ends_with(lower({_P.format(3)}), '.pdf') AS pdf FROM search_hits WHERE url IS NOT NULL""",
    "registrable_domain": f"SELECT hit_id, {_SUFFIX.format('h')} AS domain FROM (SELECT hit_id, regexp_replace({_HOST}, '[.]+$', '') AS h FROM search_hits WHERE url IS NOT NULL)",
    "host_matches": f"SELECT DISTINCT src_id, a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a) AS same_host, a <> '' AND dom <> '' AND (a = dom OR ends_with(a, '.' || dom)) AS in_domain FROM (SELECT src_id, {_HOST} AS a, {_F} AS b, {_SUFFIX.format(f'regexp_replace({_F}, $$[.]+$$||chr(36), $$$$)')} AS dom FROM research_sources WHERE url IS NOT NULL AND final_url IS NOT NULL)",
    "cache_key": f"""SELECT doc_id, sha256(lower({_P.format(1)}) || '://' || lower({_P.format(2)}) || {_P.format(3)} || CASE WHEN {_P.format(4)} <> '' THEN '?' || {_P.format(4)} ELSE '' END || '|' || '{{"format": "markdown"}}') AS key FROM documents WHERE url IS NOT NULL""",
    "content_signature": "SELECT doc_id, sha256(coalesce(text, '')) AS signature FROM documents",
    "tokens": f"SELECT doc_id, list_sort({_TOK.format('text')}) AS tokens FROM documents",
    "norm_title": r"SELECT hit_id, trim(regexp_replace(lower(coalesce(title, '')), '[\s\x{00a0}]+', ' ', 'g')) AS title FROM search_hits",
    "char_cap": "SELECT doc_id, substring(text, 1, 500) AS content, length(text) > 500 AS truncated, length(text) AS full_chars FROM documents WHERE text IS NOT NULL",
    "scorer_sentences": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?\n]+'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda s: len(string_split(s, ' ')) >= 4) AS u FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(generate_subscripts(u, 1) - 1 AS INT) AS pos, unnest(u) AS unit FROM p""",
    "sentences": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: len(list_filter(regexp_split_to_array(s, '[ \t\n\r\f\v]+'), lambda w: w <> '')) >= 4) AS u FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(generate_subscripts(u, 1) - 1 AS INT) AS pos, unnest(u) AS sentence FROM p""",
    "sanitize_md": f"SELECT doc_id, {_GLYPH} AS plain FROM documents WHERE text IS NOT NULL",
    "html_escape": "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped FROM documents WHERE text IS NOT NULL",
    "hms_format": "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS hms FROM (SELECT event_id, CAST(trunc(value * 100) AS BIGINT) AS s FROM events)",
    "token_overlap": f"""SELECT hit_id, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_title,
      round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM (SELECT hit_id, {_TOK.format('title')} AS a, {_TOK.format('snippet')} AS b FROM search_hits)""",
    "is_conceptual": r"SELECT item_id, regexp_matches(lower(trim(query)), '^(?:how|what|why)\b') OR contains(lower(query), ' vs ') OR contains(lower(query), 'explained') AS conceptual FROM eval_items",
    "strict_date": "SELECT DISTINCT event_id, date, CASE WHEN regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(date AS DATE) END AS day FROM ff_calendar_sample",
    "clamp_score": "SELECT event_id, greatest(-1.0, least(1.0, value / 50 - 1)) AS score FROM events",
    "pct_change": "SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_quantity) * 100 / nullif(l_quantity, 0), 1) AS pct FROM lineitem",
    "redirect_changes": f"SELECT asked, answered, count(*) AS n FROM (SELECT DISTINCT src_id, {_HOST} AS asked, {_F} AS answered FROM research_sources WHERE url IS NOT NULL AND final_url IS NOT NULL) WHERE asked <> answered GROUP BY asked, answered",
    "page_metadata": f"""SELECT DISTINCT page_id, nullif(trim(regexp_extract(html, '(?is)<title>([^<]*)', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1), '') AS lang, {_F} AS host FROM fetched_pages WHERE html IS NOT NULL""",
    "meta_charset": """SELECT DISTINCT page_id, lower(nullif(regexp_extract(substring(html, 1, 2048), '(?i)<meta[^>]+?charset=["'']?\\s*([A-Za-z0-9_.:-]+)', 1), '')) AS charset FROM fetched_pages WHERE html IS NOT NULL""",
    "visible_text_len": r"SELECT DISTINCT page_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS INT) AS chars FROM fetched_pages WHERE html IS NOT NULL",
}
