"""Further operators: tools, mappers, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.functions import text as X
from weblens.functions import urls as U
from weblens.operators import mapping as M
from weblens.operators.html import arms, fixed_markdown
from weblens.operators.ranking import map_text
from weblens.plans import tools
from weblens.queries.pages import _pages
from weblens.queries.ranking import _hits, _queries
from weblens.queries.scalars import _HOST, _P, _TOK
from weblens.session import table


def scan_pages(spark, d):
    return table(spark, d, "fetched_pages").select("page_id", "status", F.length("content").alias("chars")).distinct()


def _src(spark, d):
    return table(spark, d, "research_sources").dropDuplicates(["src_id"])


def looks_blocked(spark, d):
    """Sources' text as a page; the marker stands outside scripts or within one."""
    page = F.concat(F.lit("<html><script>var x='access denied'</script><body>"), F.coalesce("content", F.lit("")), F.when(F.col("src_id") % 6 == 0, "<p class='cf-browser-verification'>").otherwise(""), F.lit("</body></html>"))
    return _src(spark, d).select("src_id", M.looks_blocked(page, F.col("status")).alias("blocked"))


def failover(spark, d):
    h = _hits(spark, d).select("qid", "hit_id", "engine")
    return M.failover(h.where("engine = 'papers'"), h.where("engine = 'findra'"), "qid").select("qid", "hit_id", "degraded")


def redirect_resolve(spark, d):
    s = _src(spark, d).where("url is not null and final_url is not null")
    edges = s.where("url <> final_url").groupBy(F.col("url").alias("src")).agg(F.min("final_url").alias("dst"))
    return M.follow_redirects(edges, s.select("url").distinct())




def robots_sitemaps(spark, d):
    """A robots file for each hit, naming its address among rules."""
    robots = F.concat(F.lit("User-agent: *\nSITEMAP:  "), "url", F.lit(" # main\nDisallow: /x\n  sitemap: https://a.example/t.xml\nNot-sitemap: https://a.example/u.xml"))
    return _hits(spark, d).where("url is not null").select("hit_id", F.explode(M.robots_sitemaps(robots)).alias("url")).distinct()


def site_query(spark, d):
    return table(spark, d, "eval_items").where("query is not null").select("item_id", M.site_query(F.col("query"), ["a.example", ".b.test", "bad domain"]).alias("q"))


def raw_query(spark, d):
    f = table(spark, d, "eval_items").where("query is not null")
    return f.select("item_id", M.raw_query(F.col("query"), F.lit("2024-02-01").cast("date"), F.lit("2024-02-29").cast("date")).alias("q"))


def route_by_type(spark, d):
    h = _hits(spark, d).where("url is not null")
    return h.select("hit_id", F.when(U.is_pdf(F.col("url")), "pdf").when(F.endswith(U.path(F.col("url")), F.lit(".html")), "page").otherwise("sniff").alias("route"))


def is_pdf_url(spark, d):
    return _hits(spark, d).where("url is not null").groupBy(U.is_pdf(F.col("url")).alias("pdf")).agg(F.count("*").alias("n"))


def pdf_links(spark, d):
    h = _hits(spark, d).where("url is not null")
    return h.where(U.is_pdf(F.col("url")) | U.path(F.col("url")).contains("/download/") | U.path(F.col("url")).rlike("^/[a-c]")).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("idx"))).where("n <= 2").select("qid", "hit_id", "n")


def select_with_reasons(spark, d):
    """Documents behind a comment, without it; the first rule against each."""
    t = table(spark, d, "documents").withColumn("text", M.without_comment(F.concat(F.lit("<!-- gold\nfile -->\n"), "text")))
    rules = [("no text", F.col("text").isNull()), ("short", F.length("text") < 200), ("no language", F.col("lang").isNull())]
    return M.select_with_reasons(t, rules).select("doc_id", "reason", F.length("text").alias("chars"))


def watch_content(spark, d):
    """The first of a page's texts, and its signature."""
    p = table(spark, d, "fetched_pages").select("page_id", "content", "html", "url").distinct()
    return p.select("page_id", F.sha2(M.content_of(F.when(F.col("page_id") % 3 > 0, F.col("content")), F.col("html"), F.col("url")), 256).alias("signature")).distinct()


def same_site_links(spark, d):
    s = _src(spark, d).where("url is not null and final_url is not null")
    return s.where(U.registrable_domain(U.host(F.col("url"))) == U.registrable_domain(U.host(F.col("final_url")))).select("src_id")


def config_validators(spark, d):
    """Settings made of hits: a proxy's address, a list, two cookies, a number."""
    h = _hits(spark, d)
    proxy = F.concat(F.when(F.col("hit_id") % 5 == 0, "https://").otherwise("http://"), F.when(F.col("hit_id") % 7 == 0, "u@").otherwise(""), F.lit("proxy"), F.when(F.col("hit_id") % 3 > 0, F.concat(F.lit(":"), (F.col("hit_id") % 70000).cast("string"))).otherwise(""))
    items = F.concat_ws(" , ", "engine", F.lit(" "), "engine", F.lit("x"))
    cookie = F.repeat(F.when(F.col("hit_id") % 11 == 0, "a;").otherwise("a_"), (F.col("hit_id") % 20).cast("int"))
    number = F.when(F.col("hit_id") % 2 == 0, F.concat(F.lit(" "), (F.col("hit_id") % 40).cast("string"))).otherwise("thirty")
    return h.select("hit_id", M.valid_proxy(proxy).alias("proxy_ok"), M.listed(items).alias("items"), M.valid_cookies(cookie, F.lit("b" * 16)).alias("cookies_ok"), M.setting_int(number, 30).alias("least_words"))


def substring_any(spark, d):
    """Messages that are noise, renders whose process is gone, requests from the machine itself."""
    t = table(spark, d, "documents")
    message = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 4 == 0, "Target CLOSED by peer"))
    return t.select("doc_id", M.contains_any(F.col("text"), ["price", "kurs", "цен"]).alias("hit"), M.browser_dead(F.col("doc_id") % 3 == 0, message).alias("dead"), M.is_loopback(F.concat(F.lit("127.0.0."), (F.col("doc_id") % 3).cast("string"))).alias("own"))


def find_similar(spark, d):
    return tools.find_similar(table(spark, d, "embeddings"), 1).select("vec_id", "rank", F.round("sim", 4).alias("sim"))


def shared_strings(spark, d):
    """Cells that hold a number of the string table get its text, other cells a blank."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("at"))
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return l.join(p, l["at"] == p["p_partkey"], "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("")).alias("value"))


def sweep_by_category(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def quantile_linear(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.round(F.percentile("o_totalprice", q), 4).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.95)])


def content_recall(spark, d):
    """Whether each source's title words stand together in its content."""
    s = _src(spark, d)
    import re

    present = lambda t, c: M.snippet_present(re.findall("[0-9a-z]+", c.lower()), re.findall("[0-9a-z]+", t.lower()))
    return M.map_pairs(s, ["src_id"], "title", "content", present, "present", T.BooleanType())


def rouge_l(spark, d):
    h = _hits(spark, d)
    return M.map_pairs(h, ["hit_id"], "title", "snippet", lambda a, b: round(M.rouge_l(a, b), 6), "rouge", T.DoubleType())


def jaccard(spark, d):
    return _src(spark, d).select("src_id", F.round(X.jaccard(X.tokens(F.col("title")), X.tokens(F.col("url"))), 6).alias("jaccard"))


def ab_rerank(spark, d):
    """Mean change of the best hit's similarity by reranking."""
    sem = F.coalesce(F.when(~F.isnan("_sem_score"), F.col("_sem_score")), F.lit(0.0))
    h = _hits(spark, d)
    a = h.where("idx = 1").select("qid", sem.alias("a"))
    from weblens.operators import ranking as R

    b = R.rerank_lexical(h, _queries(spark, d)).where("rank = 1").select("qid", sem.alias("b"))
    return a.join(b, "qid").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"), F.round(F.avg((F.col("a") != F.col("b")).cast("int")), 6).alias("changed"))


def engine_hits(spark, d):
    return _hits(spark, d).groupBy("engine").agg(F.count("*").alias("n"))


def batch_cap(spark, d):
    return M.batch_capped(_hits(spark, d), "qid", ["idx"], 5)


def clamp(spark, d):
    """Timeouts within the ceiling of the tool that is asked; unknown ones have the lowest."""
    tool = F.element_at(F.array(*[F.lit(t) for t in [*M.TOOL_CEILINGS, "other"]]), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", tool.alias("tool"), F.col("value") * 5 - 20)
    return e.toDF("event_id", "tool", "asked").select("event_id", M.clamp_timeout(F.col("tool"), F.col("asked")).alias("timeout"))


def title_overlap(spark, d):
    q = _hits(spark, d).join(_queries(spark, d), "qid")
    a, b = X.tokens(F.col("query")), X.tokens(F.col("title"))
    return q.select("hit_id", F.round(F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0), 6).alias("overlap"))


def json_depth(spark, d):
    """Properties nested in others, with brackets within strings."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"a": ['), "props", F.lit('], "s": "}]\\\\"[["}]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", M.json_depth(text).alias("depth"))


def parse_judge(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"0": '), F.round("value", 2).cast("string"), F.lit(', "9": 1, "x": 2, "1": -4}')).alias("raw"))
    return e.select("event_id", F.explode(M.parse_judge(F.col("raw"), 5)).alias("s")).select("event_id", "s.idx", F.round("s.score", 2).alias("score"))


def zip_guard(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", M.zip_is_safe(F.col("event_id") * 3, F.col("event_id") * 50000, F.col("user_id") * 2000).alias("safe"))


def bundle_sim(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"), F.col("value").alias("finish"), (F.col("event_type") != "error").alias("ok"))
    return M.bundle_order(e, "user_id", 5).select("user_id", "event_id", "pos")


def read_pages(spark, d):
    return tools.read(_pages(spark, d)).select("page_id", "title", "word_count", "full_chars", "truncated", "error")


def smart_search_route(spark, d):
    q = table(spark, d, "eval_items").select("item_id", "query")
    return tools.smart_search(q).groupBy("route").agg(F.count("*").alias("n"))


def batch_read(spark, d):
    urls = _hits(spark, d).where("url is not null").groupBy("url").agg(F.min("hit_id").alias("n"))
    pages = _src(spark, d).where("url is not null").groupBy("url").agg(F.max("content").alias("content"))
    return tools.batch_read(urls, pages, "n").select("n", "url", "ok")


def research_quick(spark, d):
    return tools.research(_hits(spark, d), _queries(spark, d), _src(spark, d), 3, quick=True).select("qid", "hit_id", "pos")


def research_deep(spark, d):
    """The sources read for each query as its hits, with their texts."""
    s = _src(spark, d).where("qid is not null and final_url is not null")
    idx = F.row_number().over(Window.partitionBy("qid").orderBy("src_id"))
    hits = s.select("qid", idx.alias("idx"), "title", F.col("final_url").alias("url"), F.col("content").alias("snippet"), "published", F.lit(None).cast("string").alias("date_source"))
    return tools.research(hits, _queries(spark, d), s, 3).select("qid", "src_id", "source_no", "word_count")


def map_urls(spark, d):
    return tools.map_urls(_pages(spark, d), F.lit("garstonforum.example"))


def mask_url(spark, d):
    return _src(spark, d).where("url is not null").select("src_id", U.mask(F.col("url")).alias("webhook"))


def dom_text(spark, d):
    from weblens.operators.html import tree

    return map_text(_pages(spark, d), "page_id", "html", lambda h: tree(h).text(), "text", T.StringType())


def news_feed(spark, d):
    return M.news_items(_hits(spark, d), "_sem_score").select("qid", "idx", "title", "published", "date_source", F.round("score", 6).alias("score"))


def token_similarities(spark, d):
    h = _hits(spark, d)
    return M.similarities(h, "title", "snippet").select("hit_id", F.round("sim", 6).alias("sim"))


def tally_three(spark, d):
    """Verdicts of three arms over their joined rows: counts of found and mean breadth."""
    h = _hits(spark, d)
    arms = h.groupBy("qid").agg(*[F.count_if(F.col("engine") == e).alias(e) for e in ("papers", "findra", "lumo")])
    return arms.agg(F.count("*").alias("n"), *[F.count_if(F.col(e) > 0).alias(f"{e}_found") for e in ("papers", "findra", "lumo")], *[F.round(F.avg(e), 2).alias(f"{e}_breadth") for e in ("papers", "findra", "lumo")])


def boilerplate_rejection(spark, d):
    """Of four phrases for each source (three of its hit's words, one of its own) the share that its text lacks, and the harmonic mean with the share of its title's words found."""
    s = _src(spark, d).where("content is not null")
    own = F.split(F.coalesce("title", F.lit("")), " ")
    phrases = F.array(F.upper(F.get(own, F.lit(0))), F.get(own, F.lit(1)), F.lit("cookie"), F.lit(""))
    words = X.tokens(F.col("title"))
    recall = F.when(F.size(words) > 0, F.size(F.array_intersect(words, X.tokens(F.col("content")))) / F.size(words)).otherwise(1.0)
    absent = M.absent_share(F.col("content"), phrases)
    return s.select("src_id", F.round(absent, 6).alias("absent"), F.round(M.harmonic(absent, recall), 6).alias("both"))


def registry_roundtrip(spark, d):
    """Watches written as JSON with a column the registry does not know, and read back."""
    from weblens.session import shared_path
    from weblens.sources.sinks import write_json
    from weblens.sources.tables import watch_registry

    w = _src(spark, d).where("url is not null").select(F.sha2("url", 256).alias("id"), "url", (F.col("src_id") % 7 * 60).alias("interval_s"), F.lit("extra").alias("unknown")).dropDuplicates(["id"])
    path = shared_path(spark, "registry")
    write_json(w, path)
    return watch_registry(spark, path).select("id", "url", F.col("last_check").isNull().alias("never_checked"))


def fix_markdown(spark, d):
    """A text, a fence and a table without what the page tells of them."""
    t = table(spark, d, "documents").where("source is not null")
    page = F.concat(F.lit('<div class="highlight-'), F.when(F.col("doc_id") % 3 == 0, "default").otherwise("python"), F.lit('"><div><pre>a = 1\nb = 2</pre></div></div><pre><code class="x lang-sql">SELECT '), "doc_id", F.lit("</code></pre>"))
    md = F.concat(F.lit("# "), "source", F.lit("\n```\na = 1\nb = 2\n```\n`SELECT "), "doc_id", F.lit("`\n\n| x \\| y | z |\n| 1 | 2 |"))
    return fixed_markdown(t.select("doc_id", page.alias("html"), md.alias("md")), "doc_id", "md", "html")


def extractor_arms(spark, d):
    return arms(_pages(spark, d), "page_id", "html").select("page_id", "arm", F.length("content").alias("chars"), "error")


def cache_put(spark, d):
    """Texts put into a cache twice, long ones apart, and got back."""
    from weblens.sources import sinks

    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.expr("repeat(text, cast(doc_id % 3 * 40 + 1 as int))").alias("payload"))
    first = sinks.cache_put(None, t.where("doc_id % 2 = 0").withColumns({"payload": F.lit("old"), "at": F.lit(1)}), "doc_id", "at", "payload")
    kept = sinks.cache_put(first, t.withColumn("at", F.lit(2)), "doc_id", "at", "payload")
    kept = kept.withColumn("apart", F.col("blob").isNotNull())
    return sinks.cache_get(kept, "payload").select("doc_id", "apart", F.sha2("payload", 256).alias("payload"))


def render_report(spark, d):
    """A report written as text and read back."""
    from weblens.session import shared_path
    from weblens.sources import sinks

    path = shared_path(spark, "report")
    sinks.report(table(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name"], path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def fetch_bytes(spark, d):
    """The tables' own files as bytes."""
    from weblens.sources.tables import binary_documents

    files = binary_documents(spark, d, "*.parquet")
    return files.select(F.element_at(F.split("url", "/"), -1).alias("name"), F.octet_length("body").alias("bytes"))


_FUNCTIONS = (cache_put, render_report, fetch_bytes, fix_markdown, extractor_arms, news_feed, token_similarities, tally_three, boilerplate_rejection, registry_roundtrip, scan_pages, looks_blocked, failover, redirect_resolve, robots_sitemaps, site_query, raw_query, route_by_type, is_pdf_url, pdf_links, select_with_reasons, watch_content, same_site_links, config_validators, substring_any, find_similar, shared_strings, sweep_by_category, quantile_linear, content_recall, rouge_l, jaccard, ab_rerank, engine_hits, batch_cap, clamp, title_overlap, json_depth, parse_judge, zip_guard, bundle_sim, read_pages, smart_search_route, batch_read, research_quick, research_deep, map_urls, mask_url, dom_text)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
from weblens.queries.ranking import _H, _Q, _SERP, RERANKED, ORACLES as _R  # noqa: E402
from weblens.queries.scalars import _F, _SUFFIX  # noqa: E402

_S1 = "s AS (SELECT DISTINCT ON (src_id) * FROM research_sources)"
_HD = f"WITH {_H} "
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_SEM = "coalesce(CASE WHEN NOT isnan(_sem_score) THEN _sem_score END, 0.0)"
ORACLES = {
    "ab_rerank": RERANKED + f", x AS (SELECT qid, {_SEM} AS a FROM h WHERE idx = 1), y AS (SELECT qid, {_SEM} AS b FROM ranked WHERE rank = 1) SELECT count(*) AS n, round(avg(b - a), 6) AS delta, round(avg(CAST(a <> b AS INT)), 6) AS changed FROM x JOIN y USING (qid)",
    "research_quick": RERANKED + f", d AS (SELECT qid, hit_id, url, rank, row_number() OVER (PARTITION BY qid, url ORDER BY rank) AS n FROM ranked WHERE rank <= 9 AND url <> ''), e AS (SELECT qid, hit_id, rank, row_number() OVER (PARTITION BY qid, {_HOST} ORDER BY rank) - 1 AS n FROM d WHERE n = 1 AND NOT ({_SERP})) SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY n >= 2, least(n, 2), rank) AS pos FROM e QUALIFY pos <= 3",
    "cache_put": "SELECT doc_id, strlen(repeat(text, doc_id % 3 * 40 + 1)) > 32768 AS apart, sha256(repeat(text, doc_id % 3 * 40 + 1)) AS payload FROM documents WHERE text IS NOT NULL",
    "render_report": "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT unnest(['| n_nationkey | n_name |', '| --- | --- |'])",
    "fix_markdown": r"SELECT doc_id, '# ' || source || chr(10) || '```' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'python' END || chr(10) || 'a = 1' || chr(10) || 'b = 2' || chr(10) || '```' || chr(10) || '```sql' || chr(10) || 'SELECT ' || doc_id || chr(10) || '```' || chr(10) || chr(10) || '| x \| y | z |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' AS fixed FROM documents WHERE source IS NOT NULL",
    "news_feed": _HD + "SELECT qid, idx, coalesce(title, '') AS title, nullif(published, '') AS published, CASE WHEN nullif(published, '') IS NOT NULL THEN nullif(date_source, '') END AS date_source, round(CASE WHEN NOT isnan(_sem_score) THEN greatest(-1.0, least(1.0, _sem_score)) END, 6) AS score FROM h",
    "token_similarities": f"WITH {_H}, k AS (SELECT hit_id, {_TOK.format('title')} AS a, {_TOK.format('snippet')} AS b FROM h) SELECT hit_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / sqrt(CAST(len(a) AS DOUBLE) * len(b)) ELSE 0.0 END, 6) AS sim FROM k",
    "tally_three": _HD + ", g AS (SELECT qid, " + ", ".join(f"count(*) FILTER (WHERE engine = '{e}') AS {e}" for e in ("papers", "findra", "lumo")) + " FROM h GROUP BY qid) SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {e} > 0) AS {e}_found, round(avg({e}), 2) AS {e}_breadth" for e in ("papers", "findra", "lumo")) + " FROM g",
    "boilerplate_rejection": f"WITH {_S1}, k AS (SELECT src_id, content, list_filter([split_part(coalesce(title, ''), ' ', 1), split_part(coalesce(title, ''), ' ', 2), 'cookie'], lambda x: x <> '') AS p, {_TOK.format('title')} AS w, {_TOK.format('content')} AS c FROM s WHERE content IS NOT NULL), m AS (SELECT src_id, len(list_filter(p, lambda x: NOT contains(lower(content), lower(x)))) / len(p) AS a, CASE WHEN len(w) > 0 THEN len(list_intersect(w, c)) / len(w) ELSE 1.0 END AS r FROM k) SELECT src_id, round(a, 6) AS absent, round(CASE WHEN a + r > 0 THEN 2 * a * r / (a + r) ELSE 0.0 END, 6) AS both FROM m",
    "registry_roundtrip": "SELECT DISTINCT sha256(url) AS id, url, true AS never_checked FROM research_sources WHERE url IS NOT NULL",
    "scan_pages": "SELECT DISTINCT page_id, status, length(content) AS chars FROM fetched_pages",
    "looks_blocked": f"WITH {_S1}, k AS (SELECT src_id, status, coalesce(content, '') AS t, regexp_replace(lower(coalesce(content, '')), '<script.*?(?:</script>|$)', ' ', 'gs') AS m FROM s) SELECT src_id, coalesce(status IN (403, 429, 503), false) OR (length(trim(regexp_replace(regexp_replace('<body>' || t || '</body>', '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) < 3000 AND (src_id % 6 = 0 OR regexp_matches(m, 'just a moment|checking your browser|cf-browser-verification|attention required|access denied|enable javascript and cookies|verify you are human|complete the following challenge|performing security verification'))) AS blocked FROM k",
    "failover": _HD + "SELECT qid, hit_id, engine = 'findra' AS degraded FROM h WHERE engine = 'papers' OR (engine = 'findra' AND qid NOT IN (SELECT qid FROM h WHERE engine = 'papers'))",
    "redirect_resolve": "WITH RECURSIVE e AS (SELECT url AS src, min(final_url) AS dst FROM research_sources WHERE url <> final_url GROUP BY 1), r AS (SELECT DISTINCT url, url AS final, 0 AS hops FROM research_sources WHERE url IS NOT NULL AND final_url IS NOT NULL UNION ALL SELECT r.url, e.dst, hops + 1 FROM r JOIN e ON r.final = e.src WHERE hops < 5) SELECT url, arg_max(final, hops) AS final, max(hops) AS hops FROM r GROUP BY url",
    "robots_sitemaps": _HD + r"SELECT DISTINCT hit_id, unnest([regexp_extract(url, '^\s*(\S+)', 1), 'https://a.example/t.xml']) AS url FROM h WHERE regexp_matches(url, '\S') UNION ALL SELECT hit_id, unnest(['#', 'https://a.example/t.xml']) FROM h WHERE url IS NOT NULL AND NOT regexp_matches(url, '\S')",
    "site_query": "SELECT item_id, query || ' (site:a.example OR site:b.test)' AS q FROM eval_items WHERE query IS NOT NULL",
    "raw_query": "SELECT item_id, query || ' since:2024-02-01 until:2024-03-01' AS q FROM eval_items WHERE query IS NOT NULL",
    "route_by_type": _HD + f"SELECT hit_id, CASE WHEN ends_with(lower({_P.format(3)}), '.pdf') THEN 'pdf' WHEN ends_with({_P.format(3)}, '.html') THEN 'page' ELSE 'sniff' END AS route FROM h WHERE url IS NOT NULL",
    "is_pdf_url": _HD + f"SELECT ends_with(lower({_P.format(3)}), '.pdf') AS pdf, count(*) AS n FROM h WHERE url IS NOT NULL GROUP BY 1",
    "pdf_links": _HD + f"SELECT qid, hit_id, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idx) AS n FROM h WHERE url IS NOT NULL AND (ends_with(lower({_P.format(3)}), '.pdf') OR contains({_P.format(3)}, '/download/') OR regexp_matches({_P.format(3)}, '^/[a-c]'))) WHERE n <= 2",
    "select_with_reasons": "SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN length(ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 200 THEN 'short' WHEN lang IS NULL THEN 'no language' END AS reason, length(ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS chars FROM documents",
    "watch_content": "SELECT DISTINCT page_id, sha256(coalesce(CASE WHEN page_id % 3 > 0 THEN content END, html, url, '')) AS signature FROM fetched_pages",
    "same_site_links": f"WITH {_S1} SELECT src_id FROM (SELECT src_id, {_HOST} AS a, {_F} AS b FROM s WHERE url IS NOT NULL AND final_url IS NOT NULL) WHERE {_SUFFIX.format('rtrim(a, $$.$$)')} = {_SUFFIX.format('rtrim(b, $$.$$)')}",
    "config_validators": _HD + "SELECT hit_id, hit_id % 5 <> 0 AND hit_id % 7 <> 0 AND (hit_id % 3 = 0 OR hit_id % 70000 BETWEEN 1 AND 65535) AS proxy_ok, list_filter([engine, 'x'], lambda e: e IS NOT NULL) AS items, hit_id % 11 <> 0 AND hit_id % 20 >= 8 AS cookies_ok, CASE WHEN hit_id % 2 = 0 THEN hit_id % 40 ELSE 30 END AS least_words FROM h",
    "substring_any": "SELECT doc_id, contains(coalesce(text, ''), 'price') OR contains(coalesce(text, ''), 'kurs') OR contains(coalesce(text, ''), 'цен') AS hit, doc_id % 3 <> 0 AND doc_id % 4 = 0 AS dead, doc_id % 3 = 1 AS own FROM documents",
    "find_similar": "WITH p AS (SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id = 1) SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank, round(sim, 4) AS sim FROM p ORDER BY rank LIMIT 10",
    "shared_strings": "SELECT l_orderkey, l_linenumber, coalesce(p_name, '') AS value FROM lineitem LEFT JOIN part ON CASE WHEN l_linenumber % 2 = 0 THEN -l_partkey ELSE l_partkey END = p_partkey",
    "sweep_by_category": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "quantile_linear": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.95), 4) AS q95 FROM orders GROUP BY 1",
    "jaccard": f"WITH {_S1}, k AS (SELECT src_id, {_TOK.format('title')} AS a, {_TOK.format('url')} AS b FROM s) SELECT src_id, round({_JAC.format('a', 'b')}, 6) AS jaccard FROM k",
    "engine_hits": _HD + "SELECT engine, count(*) AS n FROM h GROUP BY 1",
    "batch_cap": _HD + "SELECT qid, count(*) AS asked, least(count(*), 5) AS kept, count(*) > 5 AS capped FROM h GROUP BY 1",
    "clamp": "SELECT event_id, greatest(1.0, least(value * 5 - 20, CASE event_id % 4 WHEN 0 THEN 60.0 WHEN 1 THEN 120.0 WHEN 2 THEN 300.0 ELSE 60.0 END)) AS timeout FROM events",
    "title_overlap": f"WITH {_H}, {_Q}, k AS (SELECT hit_id, {_TOK.format('query')} AS a, {_TOK.format('title')} AS b FROM h JOIN q USING (qid)) SELECT hit_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END, 6) AS overlap FROM k",
    "json_depth": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS depth FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, NULL FROM events WHERE props IS NULL",
    "parse_judge": "SELECT event_id, 0 AS idx, round(greatest(0.0, least(3.0, round(value, 2))), 2) AS score FROM events UNION ALL SELECT event_id, 1, 0.0 FROM events",
    "zip_guard": "SELECT event_id, event_id * 3 <= 10000 AND event_id * 50000 <= 209715200 AND event_id * 50000 <= user_id * 2000 * 200 AS safe FROM events",
    "smart_search_route": f"SELECT route, count(*) AS n FROM ({_R['classify_query']}) GROUP BY route",
    "batch_read": _HD + "SELECT n, url, url IN (SELECT url FROM research_sources WHERE content IS NOT NULL AND url IS NOT NULL) AS ok FROM (SELECT url, min(hit_id) AS n FROM h WHERE url IS NOT NULL GROUP BY url ORDER BY n LIMIT 200)",
    "mask_url": f"WITH {_S1} SELECT src_id, lower({_P.format(1)}) || '://' || {_HOST} || '/***' AS webhook FROM s WHERE url IS NOT NULL",
    "bundle_sim": "WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, value AS finish, event_type <> 'error' AS ok FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY finish, rank) AS f FROM e WHERE ok), l AS (SELECT *, min(CASE WHEN f = 5 THEN finish END) OVER (PARTITION BY user_id) + 3 AS lim FROM g) SELECT user_id, event_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS pos FROM l WHERE lim IS NULL OR finish <= lim) WHERE pos <= 5",
}
