"""Search: ranking, fusion, deduplication. Query texts are those of eval_items, given to the qids in turn."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.functions import urls as U
from weblens.functions.text import GENERIC_TOKENS, STOPWORDS
from weblens.operators import ranking as R
from weblens.operators import routing
from weblens.queries.scalars import _AUTH, _HOST, _LIST, _P, _TOK, ORACLES as _S
from weblens.session import table


def _hits(spark, d):
    """Search hits, each delivered once, positions made unique within a query."""
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"])
    return h.withColumn("idx", F.row_number().over(Window.partitionBy("qid").orderBy("idx", "hit_id"))).where("qid is not null")


def _queries(spark, d):
    items = table(spark, d, "eval_items")
    numbered = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("n"), "query")  # the fixed set of held-out items
    qids = table(spark, d, "search_hits").where("qid is not null").select("qid").distinct()
    return qids.withColumn("n", F.pmod("qid", items.select(F.count("*")).scalar())).join(numbered, "n").select("qid", "query")


def rerank_lexical(spark, d):
    return R.rerank_lexical(_hits(spark, d), _queries(spark, d), recency=True).select("qid", "hit_id", "rank", F.round("lex", 6).alias("score"))


def rerank_hybrid(spark, d):
    return R.rerank_hybrid(_hits(spark, d), _queries(spark, d), "_sem_score").select("qid", "hit_id", "rank", F.round("blended", 6).alias("score"))


def lexical_scores(spark, d):
    return R.lexical_scores(_hits(spark, d), _queries(spark, d), recency=True).select("hit_id", F.round("lex", 6).alias("score"), "fresh_rank", "has_overlap")


def rel_floor(spark, d):
    s = R.lexical_scores(_hits(spark, d), _queries(spark, d)).withColumn("_all", F.lit(True))
    return R.keep_and_floor(s, "lex", "_all").select("qid", "hit_id", "rank")


def greedy_dedup(spark, d):
    return R.greedy_dedup(_hits(spark, d))


def low_relevance(spark, d):
    return R.low_relevance(_hits(spark, d), _queries(spark, d))


def rrf_fusion(spark, d):
    h = _hits(spark, d)
    sem = F.when(~F.isnan("_sem_score"), F.col("_sem_score"))
    a = h.select("qid", F.lit(0).alias("list_id"), F.col("idx").alias("rank"), "hit_id")
    b = h.select("qid", F.lit(1).alias("list_id"), F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last(sem), "hit_id")).alias("rank"), "hit_id")
    return R.rrf(a.unionByName(b), "hit_id")


def dedup_results(spark, d):
    return R.dedup_results(_hits(spark, d), 8).select("qid", "hit_id", "pos")


def diversify_hosts(spark, d):
    return R.diversify(_hits(spark, d)).select("qid", "hit_id", "pos")


def filter_domains(spark, d):
    return R.filter_domains(_hits(spark, d), ["example", "test"], ["garstonforum.example", ".nerdanpost.test"]).select("hit_id")


def ndcg(spark, d):
    h = R.rerank_lexical(_hits(spark, d), _queries(spark, d), recency=True)
    rel = F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan("_sem_score"), F.col("_sem_score")), F.lit(0.0)))
    return R.ndcg(h.withColumn("rel", rel), _hits(spark, d).withColumn("rel", rel), 5)


def is_serp(spark, d):
    rows = [("https://a.example/search?q=x",), ("https://a.example/?q=x",), ("https://a.example/?q=",), ("https://a.example/item?q=x",), ("https://a.example/results.html?s=1",), ("https://a.example/a?id=3",), ("https://a.example/search?query=%20",)]
    return spark.createDataFrame(rows, "url string").select("url", U.is_serp(F.col("url")).alias("serp"))


def map_result(spark, d):
    h = _hits(spark, d)
    found = U.url_date(F.col("url"), 2027)
    sent = F.nullif(F.col("published"), F.lit(""))
    return h.select("hit_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(sent, found).alias("published"), F.when(sent.isNull() & found.isNotNull(), "url").alias("date_source"))


def engines_used(spark, d):
    return _hits(spark, d).groupBy("qid").agg(F.array_sort(F.collect_set(F.nullif(F.col("engine"), F.lit("")))).alias("engines"))


def engine_distribution(spark, d):
    e = _hits(spark, d).select("qid", F.explode("engines").alias("engine")).where("engine <> ''").distinct()
    return e.groupBy("engine").agg(F.count("*").alias("queries"))


def rank_bucket_share(spark, d):
    h = _hits(spark, d).where("url is not null").withColumn("bucket", F.floor((F.col("idx") - 1) / 5).cast("int"))
    return h.groupBy("bucket").agg(F.round(F.avg(U.is_authoritative(F.col("url")).cast("int")), 6).alias("share"), F.count("*").alias("n"))


def shared_domains(spark, d):
    """Hosts that both the hits and the sources of a query name."""
    a = _hits(spark, d).where("url is not null").groupBy("qid").agg(F.collect_set(U.host(F.col("url"))).alias("a"))
    b = table(spark, d, "research_sources").where("final_url is not null").groupBy("qid").agg(F.collect_set(U.host(F.col("final_url"))).alias("b"))
    return a.join(b, "qid").select("qid", F.size(F.array_intersect("a", "b")).alias("shared"))


def deep_bundle(spark, d):
    """Per query the three best-ranked sources with enough words, by host diversity of the hits."""
    s = table(spark, d, "research_sources").dropDuplicates(["src_id"]).where("qid is not null and coalesce(word_count, 0) >= 30")
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("src_id"))).where("pos <= 3").select("qid", "src_id", "pos")


def gate_content(spark, d):
    s = table(spark, d, "research_sources").dropDuplicates(["src_id"])
    n = F.coalesce("word_count", F.lit(0))
    return s.select("src_id", F.when(n == 0, "empty_content").when(n < 30, "low_content").otherwise("ok").alias("gate"))


def classify_query(spark, d):
    return table(spark, d, "eval_items").select("item_id", routing.classify(F.col("query")).alias("route"))


def dedup_blocks(spark, d):
    return R.map_text(table(spark, d, "research_sources").dropDuplicates(["src_id"]), "src_id", "content", R.dedup_blocks, "content", T.StringType())


_FUNCTIONS = (rerank_lexical, rerank_hybrid, lexical_scores, rel_floor, greedy_dedup, low_relevance, rrf_fusion, dedup_results, diversify_hosts, filter_domains, ndcg, is_serp, map_result, engines_used, engine_distribution, rank_bucket_share, shared_domains, deep_bundle, gate_content, classify_query, dedup_blocks)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_H = "h0 AS (SELECT DISTINCT ON (hit_id) * FROM search_hits), h AS (SELECT * REPLACE (row_number() OVER (PARTITION BY qid ORDER BY idx, hit_id) AS idx) FROM h0 WHERE qid IS NOT NULL)"
_Q = "q AS (SELECT DISTINCT qid, query FROM search_hits s JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS n, query FROM eval_items) ON ((s.qid % 160) + 160) % 160 = n)"
_IS_AUTH = _S["authoritative"].split("SELECT hit_id, ")[1].split(" AS authoritative")[0]
_SCORE = f"""t AS (SELECT x.*, {_TOK.format('query')} AS qt, {_TOK.format('title')} AS tt, {_TOK.format('snippet')} AS st FROM h x JOIN q USING (qid)),
m AS (SELECT *, list_intersect(qt, list_distinct(list_concat(tt, st))) AS mm, coalesce(published, '') <> '' AND coalesce(date_source, '') <> 'url' AS fresh FROM t),
s AS (SELECT *, len(mm) > 0 AS has_overlap, CASE WHEN fresh THEN 0 ELSE 1 END AS fresh_rank,
  (CASE WHEN len(qt) = 0 THEN 0.0 ELSE 2.0 * (len(list_intersect(qt, tt)) / len(qt)) + len(list_intersect(qt, st)) / len(qt) END + CASE WHEN {{0}} AND fresh AND len(mm) > 0 THEN 0.5 ELSE 0.0 END
   + CASE WHEN len(mm) > 0 AND ({_IS_AUTH.replace('url', "coalesce(url, '')")}) THEN 0.5 ELSE 0.0 END)
  * CASE WHEN len(mm) > 0 AND len(list_filter(mm, lambda x: x NOT IN {_LIST(GENERIC_TOKENS)})) = 0 THEN 0.5 ELSE 1.0 END AS lex FROM m)"""
_FLOOR = """k1 AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY qid) AS nk, row_number() OVER (PARTITION BY qid, keep ORDER BY idx) AS fill FROM b),
k2 AS (SELECT * FROM k1 WHERE keep OR fill <= greatest(0, 3 - nk)),
k3 AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY qid) AS n, max(sc) OVER (PARTITION BY qid) AS top FROM k2 WINDOW w AS (PARTITION BY qid ORDER BY sc DESC, fresh_rank, idx)),
k4 AS (SELECT *, sum(CASE WHEN sc < 0.25 * top THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS k FROM k3),
k5 AS (SELECT *, CASE WHEN n > 3 AND top > 0 THEN least(k, n - 3) ELSE 0 END AS g FROM k4),
k6 AS (SELECT * FROM k5 WHERE r <= n - k OR r > n - k + g)"""
_DEDUP = f"""nk AS (SELECT qid, idx, u, t FROM (SELECT h.qid, h.idx, trim(regexp_replace(lower(coalesce(title, '')), '[\\s\\x{{00a0}}]+', ' ', 'g')) AS t,
  CASE WHEN qs = '' THEN base ELSE base || '?' || qs END AS u FROM h JOIN (SELECT hit_id, lower(regexp_replace({_P.format(2)} || {_P.format(3)}, '/+$', '')) AS base,
  array_to_string(list_sort(list_filter(string_split({_P.format(4)}, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN {_LIST(U.TRACKING_PARAMS)})), '&') AS qs
  FROM (SELECT hit_id, coalesce(url, '') AS url FROM h)) USING (hit_id))),
rec AS (SELECT qid, idx, CASE WHEN u <> '' THEN [u] ELSE []::VARCHAR[] END AS us, CASE WHEN t <> '' THEN [t] ELSE []::VARCHAR[] END AS ts, true AS kept FROM nk WHERE idx = 1
  UNION ALL SELECT nk.qid, nk.idx, CASE WHEN dup OR nk.u = '' THEN us ELSE list_append(us, nk.u) END, CASE WHEN dup OR nk.t = '' THEN ts ELSE list_append(ts, nk.t) END, NOT dup
  FROM rec JOIN nk ON nk.qid = rec.qid AND nk.idx = rec.idx + 1, LATERAL (SELECT list_contains(us, nk.u) OR list_contains(ts, nk.t) AS dup)),
hd AS (SELECT h.* FROM h JOIN rec USING (qid, idx) WHERE kept)"""
_SERP = f"""len(list_filter(string_split({_P.format(4)}, '&'), lambda p: lower(split_part(p, '=', 1)) IN {_LIST(U.SERP_PARAMS)} AND contains(p, '=') AND trim(regexp_replace(regexp_replace(p, '^[^=]*=', ''), '\\+|%20', ' ', 'g')) <> '')) > 0
        AND (len(list_filter(string_split({_P.format(3)}, '/'), lambda x: x <> '')) = 0 OR len(list_filter(string_split({_P.format(3)}, '/'), lambda x: lower(split_part(x, '.', 1)) IN ('search', 'results'))) > 0)"""
_D = f"WITH RECURSIVE {_H}, {_Q}, {_DEDUP}, "
_RL = _D + _SCORE.replace("FROM h x JOIN q", "FROM hd x JOIN q").replace("{0}", "true")
ORACLES = {
    "lexical_scores": f"WITH {_H}, {_Q}, {_SCORE.replace('{0}', 'true')} SELECT hit_id, round(lex, 6) AS score, fresh_rank, has_overlap FROM s",
    "rel_floor": f"WITH {_H}, {_Q}, {_SCORE.replace('{0}', 'false')}, b AS (SELECT *, lex AS sc, true AS keep FROM s), {_FLOOR} SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, fresh_rank, idx) AS rank FROM k6",
    "greedy_dedup": _D.rstrip(", ") + " SELECT qid, idx FROM hd",
    "rerank_lexical": _RL + f", b AS (SELECT *, lex AS sc, has_overlap AS keep FROM s), {_FLOOR} SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, fresh_rank, idx) AS rank, round(sc, 6) AS score FROM k6",
    "rerank_hybrid": _D + _SCORE.replace("FROM h x JOIN q", "FROM hd x JOIN q").replace("{0}", "false") + f""", s2 AS (SELECT *, coalesce(CASE WHEN isnan(_sem_score) THEN NULL ELSE _sem_score END, 0.0) AS sem, max(lex) OVER (PARTITION BY qid) AS ml FROM s),
      s3 AS (SELECT *, has_overlap OR sem >= 0.4 AS keep FROM s2), b AS (SELECT *, 0.6 * sem + (1 - 0.6) * CASE WHEN ml > 0 THEN lex / ml ELSE 0.0 END + CASE WHEN keep AND ({_IS_AUTH.replace('url', "coalesce(url, '')")}) THEN 0.08 ELSE 0.0 END AS sc FROM s3),
      {_FLOOR} SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, fresh_rank, idx) AS rank, round(sc, 6) AS score FROM k6""",
    "low_relevance": f"""WITH {_H}, {_Q}, q1 AS (SELECT qid, list_filter({_TOK.format('query')}, lambda x: x NOT IN {_LIST(STOPWORDS)}) AS qt FROM q), q2 AS (SELECT qid, qt, list_filter(qt, lambda x: x NOT IN {_LIST(GENERIC_TOKENS)}) AS g0 FROM q1),
      q3 AS (SELECT qid, CASE WHEN len(g0) > 0 THEN g0 ELSE qt END AS g FROM q2 WHERE len(qt) > 0)
      SELECT qid, sum(CASE WHEN len(list_intersect(g, list_concat({_TOK.format('title')}, {_TOK.format('snippet')}))) >= CASE WHEN len(g) >= 4 THEN 2 ELSE 1 END THEN 1 ELSE 0 END) * 2 < count(*) AS low FROM h JOIN q3 USING (qid) GROUP BY qid""",
    "rrf_fusion": f"""WITH {_H}, r AS (SELECT qid, 0 AS l, idx AS r, hit_id FROM h UNION ALL SELECT qid, 1, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN isnan(_sem_score) THEN NULL ELSE _sem_score END DESC NULLS LAST, hit_id), hit_id FROM h),
      f AS (SELECT qid, hit_id, sum(1.0::DOUBLE / (60 + r)) AS s, min(l * 1000000 + r) AS first FROM r GROUP BY qid, hit_id)
      SELECT qid, hit_id, round(s, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, first) AS fused FROM f""",
    "diversify_hosts": f"""WITH {_H}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, {_HOST.replace('url', "coalesce(url, '')")} ORDER BY idx) - 1 AS n FROM h)
      SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY n >= 2, least(n, 2), idx) AS pos FROM n""",
    "filter_domains": f"""SELECT hit_id FROM (SELECT DISTINCT hit_id, coalesce({_HOST}, '') AS h FROM search_hits WHERE qid IS NOT NULL) WHERE (h = 'example' OR ends_with(h, '.example') OR h = 'test' OR ends_with(h, '.test'))
      AND NOT (h = 'garstonforum.example' OR ends_with(h, '.garstonforum.example') OR h = 'nerdanpost.test' OR ends_with(h, '.nerdanpost.test'))""",
    "ndcg": _RL + f""", b AS (SELECT *, lex AS sc, has_overlap AS keep FROM s), {_FLOOR},
      rk AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, fresh_rank, idx) AS rank, greatest(0.0, coalesce(CASE WHEN isnan(_sem_score) THEN NULL ELSE _sem_score END, 0.0)) AS rel FROM k6),
      id AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS rank, rel FROM (SELECT qid, greatest(0.0, coalesce(CASE WHEN isnan(_sem_score) THEN NULL ELSE _sem_score END, 0.0)) AS rel FROM h)),
      i AS (SELECT qid, sum(rel / log2(rank + 1)) AS ideal FROM id WHERE rank <= 5 GROUP BY qid), d AS (SELECT qid, sum(rel / log2(rank + 1)) AS dcg FROM rk WHERE rank <= 5 GROUP BY qid)
      SELECT qid, round(CASE WHEN ideal = 0 THEN 0.0 ELSE coalesce(dcg, 0.0) / ideal END, 6) AS ndcg FROM i LEFT JOIN d USING (qid)""",
    "is_serp": "SELECT * FROM (VALUES ('https://a.example/search?q=x', true), ('https://a.example/?q=x', true), ('https://a.example/?q=', false), ('https://a.example/item?q=x', false), ('https://a.example/results.html?s=1', true), ('https://a.example/a?id=3', false), ('https://a.example/search?query=%20', false)) t(url, serp)",
    "engines_used": f"WITH {_H} SELECT qid, list_sort(coalesce(list(DISTINCT engine) FILTER (WHERE engine <> ''), [])) AS engines FROM h GROUP BY qid",
    "engine_distribution": f"WITH {_H} SELECT engine, count(DISTINCT qid) AS queries FROM (SELECT qid, unnest(engines) AS engine FROM h) WHERE engine <> '' GROUP BY engine",
    "rank_bucket_share": f"WITH {_H} SELECT CAST((idx - 1) // 5 AS INT) AS bucket, round(avg(CAST({_IS_AUTH} AS INT)), 6) AS share, count(*) AS n FROM h WHERE url IS NOT NULL GROUP BY 1",
    "shared_domains": f"WITH {_H}, a AS (SELECT qid, list(DISTINCT {_HOST}) AS a FROM h WHERE url IS NOT NULL GROUP BY qid), b AS (SELECT qid, list(DISTINCT {_HOST.replace('url', 'final_url')}) AS b FROM research_sources WHERE final_url IS NOT NULL GROUP BY qid) SELECT qid, len(list_intersect(a, b)) AS shared FROM a JOIN b USING (qid)",
    "deep_bundle": "WITH s AS (SELECT DISTINCT ON (src_id) * FROM research_sources), r AS (SELECT qid, src_id, row_number() OVER (PARTITION BY qid ORDER BY src_id) AS pos FROM s WHERE qid IS NOT NULL AND coalesce(word_count, 0) >= 30) SELECT * FROM r WHERE pos <= 3",
    "gate_content": "SELECT DISTINCT src_id, CASE WHEN coalesce(word_count, 0) = 0 THEN 'empty_content' WHEN word_count < 30 THEN 'low_content' ELSE 'ok' END AS gate FROM research_sources",
    "dedup_results": f"""WITH {_H}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY idx) AS n FROM h WHERE url <> ''),
      k AS (SELECT * FROM n WHERE n = 1 AND NOT ({_SERP}))
      SELECT qid, hit_id, pos FROM (SELECT qid, hit_id, row_number() OVER (PARTITION BY qid ORDER BY idx) AS pos FROM k) WHERE pos <= 8""",
    "map_result": _S["url_date"].replace("SELECT hit_id, coalesce(", f"WITH {_H}, d AS (SELECT hit_id, coalesce(").replace("FROM search_hits WHERE url IS NOT NULL", "FROM h WHERE url IS NOT NULL) SELECT hit_id, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(nullif(published, ''), url_date) AS published, CASE WHEN nullif(published, '') IS NULL AND url_date IS NOT NULL THEN 'url' END AS date_source FROM h LEFT JOIN d USING (hit_id)"),
}


def _classify_sql() -> str:
    def case(route: str) -> str:
        parts = [f"CASE WHEN list_contains(t, '{w}') THEN {n} ELSE 0 END" for w, n in routing.TOKENS[route].items()]
        parts += [f"CASE WHEN contains(q, '{phrase}') THEN {n} ELSE 0 END" for phrase, n in routing.PHRASES[route]]
        if route == "news":
            parts += [f"CASE WHEN regexp_matches(q, '{pattern}') THEN {n} ELSE 0 END" for pattern, n in routing.NEWS_PATTERNS]
        return " + ".join(parts)

    scores = ", ".join(f"{case(r)} AS {r}0" for r in routing.PRIORITY)
    best = "greatest(" + ", ".join(f"{r}1" for r in routing.PRIORITY) + ")"
    year = ", ".join(f"{r}0 + CASE WHEN {r}0 > 0 AND regexp_matches(q, '{routing.YEAR[0]}') THEN 3 ELSE 0 END AS {r}1" if r == "news" else f"{r}0 AS {r}1" for r in routing.PRIORITY)
    pick = " ".join(f"WHEN {r}1 = {best} THEN '{r}'" for r in routing.PRIORITY)
    return f"""WITH n AS (SELECT item_id, trim(regexp_replace(lower(coalesce(query, '')), '\\s+', ' ', 'g')) AS q FROM eval_items), k AS (SELECT *, regexp_extract_all(q, '([a-z0-9+#]+)', 1) AS t FROM n),
      s AS (SELECT *, {scores} FROM k), y AS (SELECT *, {year} FROM s) SELECT item_id, CASE WHEN {best} = 0 THEN 'general' {pick} END AS route FROM y"""


ORACLES["classify_query"] = _classify_sql()
#: The lexical rerank without recency, as k6 with the rank, for the queries that go on from it.
RERANKED = _D + _SCORE.replace("FROM h x JOIN q", "FROM hd x JOIN q").replace("{0}", "false") + f", b AS (SELECT *, lex AS sc, has_overlap AS keep FROM s), {_FLOOR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, fresh_rank, idx) AS rank FROM k6)"
