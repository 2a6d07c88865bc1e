"""Markup: articles, links and selectors over the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.operators import html as H
from weblens.operators.ranking import map_text
from weblens.session import table


def _pages(spark, d):
    return table(spark, d, "fetched_pages").dropDuplicates(["page_id"]).where("html is not null")


def extract_article(spark, d):
    return H.articles(_pages(spark, d), "page_id", "html")


def page_links(spark, d):
    return H.page_links(_pages(spark, d), "page_id", "final_url", "html", same_domain=True)


def extract_selectors(spark, d):
    """Title and first headline, by selector."""
    schema = {"title": {"selector": "title", "required": True}, "headline": "h1"}
    s = H.selected(_pages(spark, d), "page_id", "html", schema)
    return s.select("page_id", F.get_json_object("data", "$.title").alias("title"), "valid")


def demark(spark, d):
    return map_text(table(spark, d, "documents"), "doc_id", "text", H.demark, "plain", T.StringType())


def search_pipeline(spark, d):
    """Fusion, domain filter, rerank and the first five of each query."""
    from weblens.queries.ranking import _hits, _queries
    from weblens.operators import ranking as R

    hits = R.filter_domains(_hits(spark, d), [], ["garstonforum.example"])
    return R.rerank_lexical(hits, _queries(spark, d), recency=True).where("rank <= 5").select("qid", "hit_id", "rank", F.round("lex", 6).alias("score"))


QUERIES = {f.__name__: f for f in (extract_article, page_links, extract_selectors, demark, search_pipeline)}
ORACLES = {"extract_selectors": "SELECT DISTINCT page_id, nullif(trim(regexp_extract(html, '(?is)<title>([^<]*)', 1)), '') AS title, regexp_extract(html, '(?is)<title>([^<]*)', 1) <> '' AS valid FROM fetched_pages WHERE html IS NOT NULL"}


def _search_sql() -> str:
    """The rerank's SQL over the hits that the domain filter leaves."""
    from weblens.queries.ranking import ORACLES as ranked
    from weblens.queries.scalars import _HOST

    host = f"coalesce({_HOST}, '')"
    kept = f"FROM h0 WHERE qid IS NOT NULL AND NOT ({host} = 'garstonforum.example' OR ends_with({host}, '.garstonforum.example'))"
    return f"SELECT * FROM ({ranked['rerank_lexical'].replace('FROM h0 WHERE qid IS NOT NULL', kept, 1)}) WHERE rank <= 5"


ORACLES["search_pipeline"] = _search_sql()
