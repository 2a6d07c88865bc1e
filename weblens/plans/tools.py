"""The public tools as functions from tables to a table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import urls as U
from weblens.operators import html as H
from weblens.operators import mapping as M
from weblens.operators import ranking as R
from weblens.operators import records as P
from weblens.operators import routing
from weblens.operators import vectors as V
from weblens.sources.tables import fetch_pages


def read(pages: DataFrame, key: str = "page_id", markup: str = "html", max_chars: int = 20_000) -> DataFrame:
    """Articles of pages with a flagged character cap; pages without text become error rows."""
    a = H.articles(pages, key, markup)
    n = F.length("content")
    code = F.when(F.col("word_count") == 0, "empty_content")
    return a.withColumns({"full_chars": n, "truncated": n > max_chars, "content": F.substring("content", 1, max_chars), "error": code})


def search(hits: DataFrame, queries: DataFrame, count: int = 10, include: list[str] | None = None, exclude: list[str] | None = None, recency: bool = False) -> DataFrame:
    """Domain filter, greedy deduplication, lexical rerank, first `count`, and the relevance guard as `degraded`."""
    ranked = R.rerank_lexical(R.filter_domains(hits, include or [], exclude or []), queries, recency).where(F.col("rank") <= count)
    low = R.low_relevance(ranked.drop("query"), queries).withColumnRenamed("low", "degraded")
    return ranked.join(low, "qid", "left")


def smart_search(queries: DataFrame) -> DataFrame:
    return queries.withColumn("route", routing.classify(F.col("query")))


def batch_read(urls: DataFrame, pages: DataFrame, order: str, cap: int = 200) -> DataFrame:
    """The first `cap` urls in order with their page or an error, in order."""
    asked = urls.orderBy(order).limit(cap)
    return asked.join(pages, "url", "left").withColumn("ok", F.col("content").isNotNull())


def extract_structured(pages: DataFrame, schema: dict, key: str = "page_id", markup: str = "html") -> DataFrame:
    return H.selected(pages, key, markup, schema)


def crawl(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_pages: int = 50) -> DataFrame:
    return P.reach(edges, seeds, max(0, min(5, depth)), max(1, min(200, max_pages)))


def research(hits: DataFrame, queries: DataFrame, sources: DataFrame, max_sources: int = 5, quick: bool = False) -> DataFrame:
    """Search for three times as many hits, distinct and diversified by host; quick: these, else the best-ranked sources with enough words."""
    found = search(hits, queries, 3 * max_sources).withColumn("idx", F.col("rank"))
    spread = R.diversify(R.dedup_results(found, 3 * max_sources).drop("pos"))
    if quick:
        return spread.where(F.col("pos") <= max_sources)
    good = sources.where(F.coalesce("word_count", F.lit(0)) >= 30).select(U.norm_url(F.col("final_url")).alias("_u"), "src_id", "content", "word_count").dropDuplicates(["_u"])
    joined = spread.withColumn("_u", U.norm_url(F.col("url"))).join(good, "_u")
    from pyspark.sql import Window

    return joined.withColumn("source_no", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("source_no") <= max_sources).drop("_u")


def research_live(hits: DataFrame, queries: DataFrame, fetch: Callable[[str], tuple[str, int, str]], max_sources: int = 5, least_words: int = 30) -> DataFrame:
    """research with the pages fetched by the caller's function: found, spread over hosts, fetched in the tasks, read as articles; those too short or failed give way to the next."""
    spread = research(hits, queries, hits, 3 * max_sources, quick=True)
    pages = fetch_pages(spread.select("url").where("url <> ''"), fetch).where("error is null and status < 400")
    read_ = H.articles(pages, "url", "html").where(F.col("word_count") >= least_words).select("url", "content", "word_count")
    joined = spread.select("qid", "hit_id", "url", "pos").join(read_, "url")
    return joined.withColumn("source_no", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("source_no") <= max_sources)


def answers(contexts: DataFrame, model: Callable[[str], str] | None = None, context: str = "context") -> DataFrame:
    """contexts with `answer` and `answer_error`: the caller's model over each context in Arrow batches. No model, or no context, is never asked; a failure keeps the row."""
    if model is None:
        return contexts.withColumns({"answer": F.lit(None).cast("string"), "answer_error": F.lit(None).cast("string")})

    @F.pandas_udf("answer string, error string")
    def ask(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                out.append((model(text) if text else None, None))
            except Exception as e:  # noqa: BLE001 - the sources stay without an answer
                out.append((None, type(e).__name__))
        return pd.DataFrame(out, columns=["answer", "error"])

    return contexts.withColumn("_a", ask(F.col(context))).withColumns({"answer": F.col("_a.answer"), "answer_error": F.col("_a.error")}).drop("_a")


def map_urls(pages: DataFrame, seed: Column, url: str = "final_url", key: str = "page_id", markup: str = "html", subdomains: bool = True) -> DataFrame:
    """Distinct links of the pages within the seed's registrable domain."""
    links = H.page_links(pages, key, url, markup)
    own = U.registrable_domain(U.host(F.col("link"))) == U.registrable_domain(seed) if subdomains else U.host(F.col("link")) == F.lower(seed)
    return links.where(own).select(F.col("link").alias("url")).distinct()


def find_similar(vectors: DataFrame, seed_key: int, count: int = 10) -> DataFrame:
    return V.top_k(vectors, vectors.where(F.col("vec_id") == seed_key), count)


def watches_add(watches: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent by the hash of url and selector; the earlier one stays."""
    ids = new.withColumn("id", F.sha2(F.concat_ws("|", "url", F.coalesce("selector", F.lit(""))), 256))
    return M.failover(watches, ids.select(watches.columns).dropDuplicates(["id"]), "id").drop("degraded")


def watches_remove(watches: DataFrame, ids: DataFrame) -> DataFrame:
    return watches.join(ids.select("id"), "id", "left_anti")


def watches_list(watches: DataFrame) -> DataFrame:
    return watches.withColumn("webhook", U.mask(F.col("webhook")))
