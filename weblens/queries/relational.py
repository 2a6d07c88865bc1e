"""Vectors, joins, aggregates, record mappers and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weblens.functions import text as X
from weblens.functions import urls as U
from weblens.operators import ranking as R
from weblens.operators import records as P
from weblens.operators import state as S
from weblens.operators import vectors as V
from weblens.queries.scalars import _HOST, _TOK
from weblens.session import table


def vector_topk(spark, d):
    """Every vector whose id is divisible by 50 against all vectors."""
    e = table(spark, d, "embeddings")
    return V.top_k(e, e.where("vec_id % 50 = 0"), 10).select("seed", "vec_id", "rank", F.round("sim", 6).alias("sim"))


def cosine_pairs(spark, d):
    """Each vector against the mean vector of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("centre")), 4).alias("sim"))


def pairwise_auc(spark, d):
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where("qid is not null and _sem_score is not null and not isnan(_sem_score)")
    return V.group_auc(h.withColumn("rel", F.coalesce(F.col("published").isNotNull(), F.lit(False))), "qid", "_sem_score", "rel")


def chart_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2)).withColumnsRenamed({"F": "f", "O": "o"})


def three_way_join(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.groupBy(F.coalesce("n_name", F.lit("none")).alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def completeness_check(spark, d):
    """Customers without an urgent order."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def condition_aggregate(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.median("l_extendedprice"), 4).alias("median"), F.round(F.percentile("l_discount", 0.9), 6).alias("p90"), F.count("*").alias("n"))


def revenue_by_region(spark, d):
    l, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def median_skip_null(spark, d):
    return table(spark, d, "research_sources").dropDuplicates(["src_id"]).groupBy("status").agg(F.median("word_count").alias("median"), F.count("word_count").alias("known"))


def floor_calibration(spark, d):
    g = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.percentile("n_chars", 0.05).alias("low"), F.percentile("n_chars", 0.95).alias("high"))
    return g.select("lang", (F.floor(F.col("low") / 20) * 20).cast("bigint").alias("low"), (F.floor(F.col("high") / 20) * 20).cast("bigint").alias("high"))


def token_f1(spark, d):
    """Multiset overlap of each hit's title with its snippet."""
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where("title is not null and snippet is not null")
    bag = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    a = h.select("hit_id", F.explode(bag(F.col("title"))).alias("w")).groupBy("hit_id", "w").agg(F.count("*").alias("a"))
    b = h.select("hit_id", F.explode(bag(F.col("snippet"))).alias("w")).groupBy("hit_id", "w").agg(F.count("*").alias("b"))
    both = a.join(b, ["hit_id", "w"]).groupBy("hit_id").agg(F.sum(F.least("a", "b")).alias("n"))
    s = h.select("hit_id", F.size(bag(F.col("title"))).alias("p"), F.size(bag(F.col("snippet"))).alias("g")).join(both, "hit_id", "left")
    return s.select("hit_id", F.round(F.coalesce(2 * F.col("n") / (F.col("p") + F.col("g")), F.lit(0.0)), 6).alias("f1"))


def truncation(spark, d):
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where("title is not null and snippet is not null")
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return h.select("hit_id", F.round(F.when(n(F.col("snippet")) == 0, 1.0).otherwise(F.least(F.lit(1.0), n(F.col("title")) / n(F.col("snippet")))), 6).alias("complete"))


def top_sentences(spark, d):
    """Per source the three sentences that share most words with its title."""
    s = table(spark, d, "research_sources").dropDuplicates(["src_id"]).where("content is not null and title is not null")
    e = s.select("src_id", X.tokens(F.col("title")).alias("q"), F.posexplode(X.sentences(F.col("content"))).alias("pos", "sentence"))
    e = e.withColumn("score", F.size(F.array_intersect("q", X.tokens(F.col("sentence")))))
    w = Window.partitionBy("src_id").orderBy(F.desc("score"), "pos")
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("src_id", "pos", "score", "rank")


def scholar_rerank(spark, d):
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).where("qid is not null and title is not null")
    h = h.withColumn("citations", F.length("snippet")).withColumn("idx", F.col("hit_id"))
    return R.scholar_rerank(h, F.lit("price report market crop estimate")).select("qid", "hit_id", "rank")


def inverted_index_text(spark, d):
    t = table(spark, d, "eval_items").where("passage is not null").select("item_id", F.posexplode(F.split("passage", " ")).alias("p", "w"))
    index = t.groupBy("item_id", "w").agg(F.collect_list("p").alias("pos")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "pos"))).alias("index"))
    return P.inverted_index_text(index, "item_id", "index")


def ff_calendar(spark, d):
    return P.calendar(table(spark, d, "ff_calendar_sample").dropDuplicates(["event_id"]).where("country is not null")).select("event_id", "currency", "event", "impact", "actual", "forecast", "previous")


def cot_parse(spark, d):
    """Report lines made of orders, parsed again."""
    o = table(spark, d, "orders")
    line = F.concat_ws(",", F.concat(F.lit('"M'), F.col("o_orderkey").cast("string"), F.lit('"')), F.lit("x"), F.date_format("o_orderdate", "yyyy-MM-dd"), *[F.lit(" ")] * 4, F.concat(F.lit("  "), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string"), F.lit("n/a"), F.lit("7"), F.lit("8"), F.lit("9"), F.lit(""), F.lit(""), F.lit("10"), F.lit("11"))
    return P.cot_rows(o.select(line.alias("line")), "line")


def cot_drift(spark, d):
    return P.cot_drift(cot_parse(spark, d))


def outcome_odds(spark, d):
    m = table(spark, d, "market_event").dropDuplicates(["slug"]).select("slug", F.lit('["Yes", "No"]').alias("outcomes"), F.concat(F.lit('["'), F.coalesce(F.round(F.col("liquidity") / F.col("volume"), 4).cast("string"), F.lit("NaN")), F.lit('", "0.5"]')).alias("prices"))
    return P.outcome_odds(m).groupBy("outcome").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


def error_classify(spark, d):
    """Reads that failed by status, by a wall, by the clock or for a reason unknown."""
    s = table(spark, d, "research_sources").dropDuplicates(["src_id"])
    reason = F.when(F.col("src_id") % 5 == 0, "blocked_by_antibot").when(F.col("src_id") % 5 == 1, "timeout").when(F.col("src_id") % 5 == 2, F.col("render_path"))
    return s.select("src_id", P.error_record(F.when(F.col("src_id") % 2 == 0, F.col("status")), reason).alias("e")).select("src_id", "e.*")


def status_to_code(spark, d):
    s = table(spark, d, "research_sources").where("status is not null")
    return s.select("status", P.status_code_record(F.col("status")).alias("code")).distinct()


def reach_ok(spark, d):
    s = table(spark, d, "research_sources").where("final_url is not null").dropDuplicates(["src_id"])
    return s.groupBy(U.host(F.col("final_url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("status") < 400).alias("ok"))


def snowflake_window(spark, d):
    p = table(spark, d, "post").select("id").distinct().withColumn("ms", P.snowflake_ms(F.col("id")))
    return p.where(F.col("ms").isNull() | F.col("ms").between(1717900000000, 1718000000000))


def x_target(spark, d):
    p = table(spark, d, "post").where("url is not null").select(F.regexp_replace("url", r"^https?://x\.example", "https://x.com").alias("url")).distinct()
    return p.select("url", U.x_target(F.col("url")).alias("t")).select("url", F.col("t.kind").alias("kind"), F.col("t.value").alias("value"))


def blocked_ip(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("event_id") % 199).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("1")).alias("ip"))
    return e.select("event_id", "ip", P.is_blocked_v4(F.col("ip")).alias("blocked"))


def block_on_any(spark, d):
    b = blocked_ip(spark, d)
    return b.join(table(spark, d, "events").select("event_id", "user_id"), "event_id").groupBy("user_id").agg(F.bool_or("blocked").alias("blocked"))


def sniff_kind(spark, d):
    """Documents with a content type, first bytes or an extension that says what they are."""
    pick = lambda values, n: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("doc_id") % n).cast("int"))
    ctype = pick(["application/pdf", "TEXT/CSV; charset=x", "application/vnd.api+json", "application/rss+xml", None, "application/octet-stream", None, None], 8)
    head = pick(["", "", "", "", "504B030414", "20255044462D31", "89504E470D0A1A0A", "6162"], 8)
    t = table(spark, d, "documents")
    return t.select("doc_id", P.sniff_kind(ctype, head, pick(["pdf", "rss", "tsv", "txt", "docx"], 5)).alias("kind"))


def xlsx_col(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.upper(F.substring("n_name", 1, 2)), F.col("n_nationkey").cast("string")).alias("ref"))
    return n.select("ref", X.xlsx_col(F.col("ref")).alias("col"))


def parse_pages(spark, d):
    n = table(spark, d, "events").select("event_id", F.concat_ws("-", F.when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("event_id") % 13).cast("string")), (F.col("user_id") % 9).cast("string")).alias("spec"))
    return n.select("event_id", X.page_range(F.col("spec"), F.lit(7)).alias("pages"))


def lenient_int(spark, d):
    f = table(spark, d, "ff_calendar_sample").where("previous is not null")
    return f.select("previous", X.lenient_int(F.regexp_replace("previous", "[.][0-9]*[KMB%]?$", ",000")).alias("n")).distinct()


def markdown_table(spark, d):
    return P.markdown_table(table(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name"])


def csv_caps(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("rows_total"))
    return g.select("l_returnflag", "rows_total", F.least("rows_total", F.lit(2000)).alias("rows_returned"), (F.col("rows_total") > 2000).alias("truncated"))


def comment_tree(spark, d):
    """Customers of nations of regions as a forest."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("parent"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("bigint").alias("id"), (F.col("s_nationkey") + 100).cast("bigint").alias("parent"))
    nodes = r.unionByName(n).unionByName(s)
    return P.comment_tree(nodes, cap=20).join(P.tree_sizes(nodes), "root").select("root", "id", "depth", "pos", "total")


def crawl_bfs(spark, d):
    """Reach over hosts that answer for each other's queries."""
    s = table(spark, d, "research_sources").where("qid is not null and final_url is not null").select("qid", U.host(F.col("final_url")).alias("h")).distinct()
    w = Window.partitionBy("qid").orderBy("h")
    edges = s.select(F.col("h").alias("src"), F.lead("h").over(w).alias("dst")).where("dst is not null").distinct()
    seeds = edges.agg(F.min("src").alias("page"))
    return P.reach(edges, seeds, 3, 200)


def fetch_ladder(spark, d):
    """One copy of each url, by tier of how it was read."""
    tier = F.when(F.col("render_path") == "api", 0).when(F.col("render_path") == "static", 1).when(F.col("render_path") == "browser", 2).when(F.col("render_path") == "archive", 3).otherwise(4)
    s = table(spark, d, "research_sources").where("url is not null").withColumn("tier", tier)
    w = Window.partitionBy("url").orderBy("tier", "src_id", "fetched_at")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("url", "src_id", "tier")


def archive_latest(spark, d):
    return table(spark, d, "research_sources").where("url is not null and fetched_at is not null").groupBy("url").agg(F.max(F.struct("fetched_at", "src_id"))["src_id"].alias("src_id"))


def first_nonempty_backend(spark, d):
    s = table(spark, d, "search_hits").where("qid is not null").withColumn("b", F.when(F.col("engine") == "papers", 0).when(F.col("engine") == "findra", 1).otherwise(2)).select("qid", "hit_id", "b").distinct()
    return s.withColumn("_m", F.min("b").over(Window.partitionBy("qid"))).where("b = _m").select("qid", "hit_id")


def watch_upsert(spark, d):
    """Watches by the hash of their url, the first delivery kept."""
    s = table(spark, d, "search_hits").where("url is not null").select(F.sha2("url", 256).alias("id"), "hit_id")
    return s.groupBy("id").agg(F.min("hit_id").alias("hit_id"))


def unwatch(spark, d):
    return watch_upsert(spark, d).join(table(spark, d, "research_sources").where("url is not null").select(F.sha2("url", 256).alias("id")), "id", "left_anti")


def paged_scan_stop(spark, d):
    """New URLs on each page of a query's hits (five a page)."""
    h = table(spark, d, "search_hits").where("url is not null and qid is not null").dropDuplicates(["hit_id"])
    h = h.withColumn("page", F.floor(F.col("idx") / 5).cast("int")).withColumn("_n", F.row_number().over(Window.partitionBy("qid", "url").orderBy("idx", "hit_id")))
    return h.groupBy("qid", "page").agg(F.count_if(F.col("_n") == 1).alias("added"))


def calendar_stale(spark, d):
    """Each calendar delivery with the age in seconds of its country's one before."""
    f = table(spark, d, "ff_calendar_sample").where("country is not null and ingested_at is not null").select("country", F.unix_seconds(F.col("ingested_at").cast("timestamp")).alias("s")).distinct()
    aged = S.previous(f, "country", "s", 86400)
    return aged.select("country", "s", (F.col("s") - F.col("previous") <= 21600).alias("usable"))


def answer_context(spark, d):
    s = table(spark, d, "research_sources").dropDuplicates(["src_id"]).where("qid is not null and content is not null and title is not null")
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("src_id"))).where("n <= 3")
    part = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "title", F.lit(": "), F.substring("content", 1, 4000))
    return s.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]), "\n").alias("context"))


_FUNCTIONS = (vector_topk, cosine_pairs, pairwise_auc, chart_pivot, three_way_join, completeness_check, condition_aggregate, revenue_by_region, median_skip_null, floor_calibration, token_f1, truncation, top_sentences, scholar_rerank, inverted_index_text, ff_calendar, cot_parse, cot_drift, outcome_odds, error_classify, status_to_code, reach_ok, snowflake_window, x_target, blocked_ip, block_on_any, sniff_kind, xlsx_col, parse_pages, lenient_int, markdown_table, csv_caps, comment_tree, crawl_bfs, fetch_ladder, archive_latest, first_nonempty_backend, watch_upsert, unwatch, paged_scan_stop, calendar_stale, answer_context)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_U = "h AS (SELECT DISTINCT ON (hit_id) * FROM search_hits)"
_SRC = "s AS (SELECT DISTINCT ON (src_id) * FROM research_sources)"
_WS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_IP = "(event_id % 256) || '.' || (event_id % 199) || '.' || (user_id % 256) || '.1'"
_NUM = "((event_id % 256) * 16777216 + (event_id % 199) * 65536 + (user_id % 256) * 256 + 1)"


def _nets() -> str:
    out = []
    for net in P.BLOCKED_V4:
        base, bits = net.split("/")
        a, b, c, e = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + e
        out.append(f"{_NUM} BETWEEN {low} AND {low + 2 ** (32 - int(bits)) - 1}")
    return " OR ".join(out)


ORACLES = {
    "sniff_kind": "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'feed' WHEN 4 THEN 'zip' WHEN 5 THEN 'pdf' WHEN 6 THEN 'image' ELSE CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'feed' WHEN 2 THEN 'csv' WHEN 4 THEN 'docx' END END AS kind FROM documents",
    "vector_topk": "WITH p AS (SELECT a.vec_id AS seed, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, vec_id) AS rank FROM p) SELECT seed, vec_id, rank, round(sim, 6) AS sim FROM r WHERE rank <= 10",
    "cosine_pairs": "WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM u GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 4) AS sim FROM embeddings JOIN c USING (label)",
    "pairwise_auc": f"WITH {_U}, k AS (SELECT qid, _sem_score AS s, published IS NOT NULL AS r FROM h WHERE qid IS NOT NULL AND _sem_score IS NOT NULL AND NOT isnan(_sem_score)), p AS (SELECT a.qid, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM k a JOIN k b ON a.qid = b.qid AND a.r AND NOT b.r GROUP BY a.qid) SELECT q.qid, round(auc, 6) AS auc FROM (SELECT DISTINCT qid FROM k) q LEFT JOIN p USING (qid)",
    "chart_pivot": "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS f, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o FROM lineitem GROUP BY 1",
    "three_way_join": "SELECT coalesce(n_name, 'none') AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "completeness_check": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "condition_aggregate": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_discount, 0.9), 6) AS p90, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "revenue_by_region": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "median_skip_null": f"WITH {_SRC} SELECT status, median(word_count) AS median, count(word_count) AS known FROM s GROUP BY status",
    "floor_calibration": "SELECT lang, CAST(floor(quantile_cont(n_chars, 0.05) / 20) * 20 AS BIGINT) AS low, CAST(floor(quantile_cont(n_chars, 0.95) / 20) * 20 AS BIGINT) AS high FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "token_f1": f"WITH {_U}, k AS (SELECT hit_id, {_WS.format('lower(title)')} AS p, {_WS.format('lower(snippet)')} AS g FROM h WHERE title IS NOT NULL AND snippet IS NOT NULL), a AS (SELECT hit_id, w, count(*) AS a FROM (SELECT hit_id, unnest(p) AS w FROM k) GROUP BY ALL), b AS (SELECT hit_id, w, count(*) AS b FROM (SELECT hit_id, unnest(g) AS w FROM k) GROUP BY ALL), o AS (SELECT hit_id, sum(least(a, b)) AS n FROM a JOIN b USING (hit_id, w) GROUP BY 1) SELECT hit_id, round(coalesce(2 * n / (len(p) + len(g)), 0.0), 6) AS f1 FROM k LEFT JOIN o USING (hit_id)",
    "truncation": f"WITH {_U} SELECT hit_id, round(CASE WHEN len({_WS.format('snippet')}) = 0 THEN 1.0 ELSE least(1.0, len({_WS.format('title')}) / len({_WS.format('snippet')})) END, 6) AS complete FROM h WHERE title IS NOT NULL AND snippet IS NOT NULL",
    "top_sentences": rf"""WITH {_SRC}, p AS (SELECT src_id, {_TOK.format('title')} AS q, list_filter(list_transform(regexp_split_to_array(regexp_replace(content, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '[ \t\n\r\f\v]+'), lambda w: w <> '')) >= 4) AS u FROM s WHERE content IS NOT NULL AND title IS NOT NULL),
      e AS (SELECT src_id, q, CAST(generate_subscripts(u, 1) - 1 AS INT) AS pos, unnest(u) AS sentence FROM p), c AS (SELECT src_id, pos, len(list_intersect(q, {_TOK.format('sentence')})) AS score FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY score DESC, pos) AS rank FROM c) SELECT src_id, pos, score, rank FROM r WHERE rank <= 3""",
    "scholar_rerank": f"WITH {_U}, k AS (SELECT qid, hit_id, {_TOK.format('title')} AS t, list_value('price', 'report', 'market', 'crop', 'estimate') AS q, coalesce(length(snippet), -1) AS c FROM h WHERE qid IS NOT NULL AND title IS NOT NULL), r AS (SELECT *, len(list_intersect(q, t)) / 5 + CASE WHEN len(t) > 0 THEN len(list_intersect(q, t)) / len(t) ELSE 0.0 END * log10(1 + greatest(c, 0)) * 0.1 AS s FROM k) SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, c DESC, hit_id) AS rank FROM r",
    "inverted_index_text": "SELECT item_id, passage AS text FROM eval_items WHERE passage IS NOT NULL",
    "ff_calendar": "WITH f AS (SELECT DISTINCT ON (event_id) * FROM ff_calendar_sample) SELECT event_id, nullif(trim(country), '') AS currency, nullif(trim(title), '') AS event, CASE lower(trim(impact)) WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' WHEN 'holiday' THEN 'Holiday' ELSE coalesce(nullif(trim(impact), ''), 'Holiday') END AS impact, nullif(trim(actual), '') AS actual, nullif(trim(forecast), '') AS forecast, nullif(trim(previous), '') AS previous FROM f WHERE country IS NOT NULL",
    "cot_parse": "SELECT 'M' || o_orderkey AS market, strftime(o_orderdate, '%Y-%m-%d') AS report_date, o_custkey AS open_interest, o_orderkey AS noncommercial_long, CAST(NULL AS BIGINT) AS noncommercial_short, CAST(7 AS BIGINT) AS noncommercial_spreads, CAST(8 AS BIGINT) AS commercial_long, CAST(9 AS BIGINT) AS commercial_short, CAST(10 AS BIGINT) AS nonreportable_long, CAST(11 AS BIGINT) AS nonreportable_short FROM orders",
    "cot_drift": "SELECT count(*) FILTER (WHERE o_custkey <> o_orderkey + 7 + 8 + 10) AS identity_failures, 0 AS bad_dates FROM orders",
    "outcome_odds": "WITH m AS (SELECT DISTINCT slug FROM market_event), v AS (SELECT DISTINCT ON (slug) * FROM market_event) SELECT 'Yes' AS outcome, count(*) AS n, count(CASE WHEN NOT isnan(liquidity / volume) AND NOT isinf(liquidity / volume) THEN 1 END) AS priced FROM v UNION ALL SELECT 'No', count(*), count(*) FROM m",
    "error_classify": f"WITH {_SRC}, k AS (SELECT src_id, CASE WHEN src_id % 2 = 0 THEN status END AS st, CASE src_id % 5 WHEN 0 THEN 'blocked_by_antibot' WHEN 1 THEN 'timeout' WHEN 2 THEN render_path END AS r FROM s) SELECT src_id, CASE WHEN r = 'blocked_by_antibot' THEN 'blocked_by_antibot' ELSE 'fetch_failed' END AS code, coalesce('http_' || st, r, 'fetch_failed') AS reason, coalesce(st, 0) >= 500 OR coalesce(st, 0) = 429 OR (st IS NULL AND coalesce(r, '') IN ('timeout', 'transport', 'circuit_open')) AS retryable FROM k",
    "status_to_code": "SELECT DISTINCT status, CASE WHEN status = 429 THEN 'x_rate_limited' WHEN status IN (401, 301, 302) THEN 'x_account_expired' WHEN status = 403 THEN 'x_account_rejected' ELSE 'x_backend_error' END AS code FROM research_sources WHERE status IS NOT NULL",
    "reach_ok": f"WITH {_SRC} SELECT {_HOST.replace('url', 'final_url')} AS host, count(*) AS n, count(*) FILTER (WHERE status < 400) AS ok FROM s WHERE final_url IS NOT NULL GROUP BY 1",
    "snowflake_window": "WITH p AS (SELECT DISTINCT id, CASE WHEN TRY_CAST(id AS BIGINT) >= 30000000000 THEN (TRY_CAST(id AS BIGINT) >> 22) + 1288834974657 END AS ms FROM post) SELECT * FROM p WHERE ms IS NULL OR ms BETWEEN 1717900000000 AND 1718000000000",
    "x_target": r"WITH u AS (SELECT DISTINCT regexp_replace(url, '^https?://x\.example', 'https://x.com') AS url FROM post WHERE url IS NOT NULL), p AS (SELECT url, regexp_extract(url, '^https?://x\.com/[^/]+/status(?:es)?/(\d+)', 1) AS s, regexp_extract(url, '^https?://x\.com/@?([A-Za-z0-9_]{1,15})/?$', 1) AS h FROM u) SELECT url, CASE WHEN s <> '' THEN 'status' WHEN h <> '' THEN 'user' END AS kind, CASE WHEN s <> '' THEN s WHEN h <> '' THEN h END AS value FROM p",
    "blocked_ip": f"SELECT event_id, {_IP} AS ip, {_nets()} AS blocked FROM events",
    "block_on_any": f"SELECT user_id, bool_or({_nets()}) AS blocked FROM events GROUP BY user_id",
    "xlsx_col": "SELECT ref, (ascii(ref[1]) - 64) * 26 + ascii(ref[2]) - 64 - 1 AS col FROM (SELECT upper(substring(n_name, 1, 2)) || n_nationkey AS ref FROM nation)",
    "parse_pages": "SELECT event_id, CASE WHEN event_id % 11 <> 0 AND greatest(least(a, b), 1) <= least(greatest(a, b), 7) THEN generate_series(greatest(least(a, b), 1) - 1, least(greatest(a, b), 7) - 1) END AS pages FROM (SELECT event_id, event_id % 13 AS a, user_id % 9 AS b FROM events)",
    "lenient_int": "SELECT DISTINCT previous, TRY_CAST(replace(trim(regexp_replace(previous, '[.][0-9]*[KMB%]?$', ',000')), ',', '') AS BIGINT) AS n FROM ff_calendar_sample WHERE previous IS NOT NULL",
    "markdown_table": "SELECT 0 AS line_no, '| n_nationkey | n_name |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT n_nationkey + 2, '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation",
    "csv_caps": "SELECT l_returnflag, count(*) AS rows_total, least(count(*), 2000) AS rows_returned, count(*) > 2000 AS truncated FROM lineitem GROUP BY 1",
    "comment_tree": "WITH RECURSIVE n AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100 FROM supplier), t AS (SELECT id AS root, id, 0 AS depth, [id] AS path FROM n WHERE parent IS NULL UNION ALL SELECT t.root, n.id, t.depth + 1, list_append(t.path, n.id) FROM t JOIN n ON n.parent = t.id) SELECT root, id, depth, row_number() OVER (PARTITION BY root ORDER BY path) AS pos, count(*) OVER (PARTITION BY root) AS total FROM t QUALIFY pos <= 20",
    "crawl_bfs": f"WITH RECURSIVE s AS (SELECT DISTINCT qid, {_HOST.replace('url', 'final_url')} AS h FROM research_sources WHERE qid IS NOT NULL AND final_url IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM (SELECT h AS src, lead(h) OVER (PARTITION BY qid ORDER BY h) AS dst FROM s) WHERE dst IS NOT NULL), b AS (SELECT min(src) AS page, 0 AS depth FROM e UNION SELECT dst, depth + 1 FROM b JOIN e ON src = page WHERE depth < 3) SELECT page, min(depth) AS depth FROM b GROUP BY page ORDER BY 2, 1 LIMIT 200",
    "fetch_ladder": "WITH t AS (SELECT *, CASE render_path WHEN 'api' THEN 0 WHEN 'static' THEN 1 WHEN 'browser' THEN 2 WHEN 'archive' THEN 3 ELSE 4 END AS tier FROM research_sources WHERE url IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY tier, src_id) AS n FROM t) SELECT url, src_id, tier FROM r WHERE n = 1",
    "archive_latest": "SELECT url, (max({'t': fetched_at, 's': src_id})).s AS src_id FROM research_sources WHERE url IS NOT NULL AND fetched_at IS NOT NULL GROUP BY url",
    "first_nonempty_backend": "WITH s AS (SELECT DISTINCT qid, hit_id, CASE engine WHEN 'papers' THEN 0 WHEN 'findra' THEN 1 ELSE 2 END AS b FROM search_hits WHERE qid IS NOT NULL) SELECT qid, hit_id FROM s QUALIFY b = min(b) OVER (PARTITION BY qid)",
    "watch_upsert": "SELECT sha256(url) AS id, min(hit_id) AS hit_id FROM search_hits WHERE url IS NOT NULL GROUP BY 1",
    "unwatch": "SELECT sha256(url) AS id, min(hit_id) AS hit_id FROM search_hits WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM research_sources WHERE url IS NOT NULL) GROUP BY 1",
    "paged_scan_stop": f"WITH {_U}, n AS (SELECT *, CAST(floor(idx / 5) AS INT) AS page, row_number() OVER (PARTITION BY qid, url ORDER BY idx, hit_id) AS n FROM h WHERE url IS NOT NULL AND qid IS NOT NULL) SELECT qid, page, count(*) FILTER (WHERE n = 1) AS added FROM n GROUP BY 1, 2",
    "calendar_stale": "WITH f AS (SELECT DISTINCT country, epoch_us(ingested_at) // 1000000 AS s FROM ff_calendar_sample WHERE country IS NOT NULL AND ingested_at IS NOT NULL) SELECT country, s, s - lag(s) OVER (PARTITION BY country ORDER BY s) <= 21600 AS usable FROM f",
    "answer_context": f"WITH {_SRC}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY src_id) AS n FROM s WHERE qid IS NOT NULL AND content IS NOT NULL AND title IS NOT NULL) SELECT qid, string_agg('[' || n || '] ' || title || ': ' || substring(content, 1, 4000), chr(10) ORDER BY n) AS context FROM n WHERE n <= 3 GROUP BY qid",
}
ORACLES["post_mapper"] = "WITH p AS (SELECT DISTINCT ON (id) * FROM post) SELECT id, author.handle AS handle, metrics.likes AS likes, coalesce(metrics.views, 0) AS views, length(text) AS chars FROM p"
