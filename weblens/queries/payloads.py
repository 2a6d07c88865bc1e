"""Mappers of API payloads over whole tables.

The tables hold no payloads, so each row is written as one in its service's shape
and mapped back; the SQL works from the table's own columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.functions.text import html_escape
from weblens.operators import payloads as P
from weblens.queries.ranking import _hits
from weblens.session import table


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _graph(h: DataFrame) -> Column:
    pdf = F.when(F.col("hit_id") % 3 == 0, F.struct(F.col("url").alias("url")))
    return _json(
        F.col("title"), F.transform("engines", lambda e: F.struct(e.alias("name"))).alias("authors"), (F.col("hit_id") % 45 + 1980).alias("year"), F.col("engine").alias("venue"), F.length("snippet").alias("citationCount"),
        F.struct(F.concat(F.lit("10.1/"), "hit_id").alias("DOI")).alias("externalIds"), F.col("url"), F.col("snippet").alias("abstract"), pdf.alias("openAccessPdf"),
    )


def _registry(h: DataFrame) -> Column:
    links = F.array(F.struct(F.lit("ftp://a.example/x").alias("URL"), F.lit("application/pdf").alias("content-type")), F.struct(F.col("url").alias("URL"), F.when(F.col("hit_id") % 2 == 0, "application/pdf").otherwise("text/html").alias("content-type")))
    authors = F.array(F.struct(F.concat(F.lit("A"), (F.col("hit_id") % 7).cast("string")).alias("given"), F.col("engine").alias("family")))
    return _json(
        F.array("title").alias("title"), authors.alias("author"), F.struct(F.array(F.array((F.col("hit_id") % 45 + 1980).cast("int"), F.lit(5))).alias("date-parts")).alias("published"), F.array("engine").alias("container-title"), F.length("snippet").alias("is-referenced-by-count"),
        F.concat(F.lit("10.2/"), "hit_id").alias("DOI"), F.col("url").alias("URL"), F.concat(F.lit("<jats:p>"), "snippet", F.lit("</jats:p>")).alias("abstract"), links.alias("link"),
    )


def _catalog(h: DataFrame) -> Column:
    words = F.split("snippet", " ")
    index = F.map_from_arrays(F.array_distinct(words), F.transform(F.array_distinct(words), lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))
    place = F.struct(F.when(F.col("hit_id") % 2 == 0, F.struct(F.col("engine").alias("display_name"))).alias("source"), F.lit("raw venue").alias("raw_source_name"), F.when(F.col("hit_id") % 3 == 0, F.col("url")).alias("landing_page_url"))
    return _json(
        F.concat(F.lit("https://catalog.example/W"), "hit_id").alias("id"), F.col("title").alias("display_name"), F.transform("engines", lambda e: F.struct(F.struct(e.alias("display_name")).alias("author"))).alias("authorships"), (F.col("hit_id") % 45 + 1980).alias("publication_year"),
        place.alias("primary_location"), F.length("snippet").alias("cited_by_count"), F.concat(F.lit("https://doi.org/10.3/"), "hit_id").alias("doi"), index.alias("abstract_inverted_index"), F.struct(F.col("url").alias("pdf_url")).alias("best_oa_location"),
    )


def _papers(spark, d, payload, mapper) -> DataFrame:
    h = _hits(spark, d)
    return h.select("qid", "hit_id", "engine", payload(h).alias("_p")).select("qid", "hit_id", "engine", mapper(F.col("_p")).alias("r")).select("qid", "hit_id", "engine", "r.*")


def paper_graph(spark, d):
    return _papers(spark, d, _graph, P.paper_from_graph).drop("qid", "engine")


def paper_registry(spark, d):
    return _papers(spark, d, _registry, P.paper_from_registry).drop("qid", "engine")


def paper_catalog(spark, d):
    return _papers(spark, d, _catalog, P.paper_from_catalog).drop("qid", "engine")


def unify_papers(spark, d):
    """Three backends in one shape; for each query only those of the first backend that answers."""
    parts = [
        _papers(spark, d, _graph, P.paper_from_graph).where("engine = 'papers'").withColumn("backend", F.lit(0)),
        _papers(spark, d, _registry, P.paper_from_registry).where("engine = 'findra'").withColumn("backend", F.lit(1)),
        _papers(spark, d, _catalog, P.paper_from_catalog).where("engine not in ('papers', 'findra')").withColumn("backend", F.lit(2)),
    ]
    return P.first_answering(reduce(DataFrame.unionByName, parts), "qid", "backend").select("qid", "hit_id", "backend", "title", "venue", "year", "doi")


def paper_filters(spark, d):
    return P.filter_papers(paper_graph(spark, d), year_from=2010, open_access=True).select("hit_id", "year", "open_access_pdf")


def code_repository(spark, d):
    payload = _json(
        F.concat_ws("/", "engine", F.lit("r"), F.col("qid").cast("string")).alias("full_name"), F.col("snippet").alias("description"), F.col("url").alias("html_url"), F.when(F.col("hit_id") % 4 > 0, F.length("snippet")).alias("stargazers_count"), F.col("idx").alias("forks_count"),
        F.col("engine").alias("language"), F.col("engines").alias("topics"), F.when(F.col("hit_id") % 3 > 0, F.struct(F.col("engine").alias("login"))).alias("owner"), F.col("published").alias("updated_at"),
    )
    return _hits(spark, d).select("hit_id", P.code_repository(payload).alias("r")).select("hit_id", "r.*")


def code_file(spark, d):
    payload = _json(F.struct(F.col("engine").alias("full_name")).alias("repository"), F.concat(F.lit("src/"), "hit_id").alias("path"), F.col("title").alias("name"), F.col("url").alias("html_url"))
    return _hits(spark, d).select("hit_id", P.code_file(payload).alias("r")).select("hit_id", "r.*")


def map_issue(spark, d):
    api = F.when(F.col("hit_id") % 2 == 0, F.concat(F.lit("https://api.example/repos/"), F.coalesce("engine", F.lit("none")), F.lit("/r"), F.col("qid").cast("string")))
    payload = _json(F.col("title"), F.col("url").alias("html_url"), api.alias("repository_url"), F.col("hit_id").alias("number"), F.when(F.col("hit_id") % 5 == 0, "closed").otherwise("open").alias("state"), F.col("idx").alias("comments"), F.col("published").alias("created_at"))
    pull = F.concat(F.expr("left(p, length(p) - 1)"), F.lit(', "pull_request": null}'))
    h = _hits(spark, d).select("hit_id", payload.alias("p")).select("hit_id", F.when(F.col("hit_id") % 3 == 0, pull).otherwise(F.col("p")).alias("p"))
    return h.select("hit_id", P.code_issue(F.col("p")).alias("r")).select("hit_id", "r.*")


def _posts(spark, d):
    """Posts, the least text of a post that comes twice."""
    p = table(spark, d, "post").where("id is not null and text is not null")
    return p.groupBy("id").agg(F.min_by(F.struct("url", "text", "lang", "author", "metrics"), F.struct("text", "url", F.col("author.handle"))).alias("r")).select("id", "r.*")


def post_mapper(spark, d):
    m, a = F.col("metrics"), F.col("author")
    base = [
        F.col("id"), F.col("url"), F.col("text"), (F.col("id").cast("bigint") % 1_000_000_000).cast("double").alias("created_timestamp"), F.col("lang"),
        F.struct(a["handle"].alias("screen_name"), a["name"].alias("name"), a["followers"].alias("followers"), F.struct(a["verified"].alias("verified")).alias("verification")).alias("author"),
        m["replies"].alias("replies"), m["reposts"].alias("retweets"), m["likes"].alias("likes"), m["quotes"].alias("quotes"), m["views"].alias("views"), m["bookmarks"].alias("bookmarks"),
        F.struct(F.array(F.struct(F.lit("photo").alias("type"), F.col("url"))).alias("all")).alias("media"),
    ]
    quote = F.when(F.col("id").cast("bigint") % 4 == 0, F.struct(F.concat(F.lit("q"), "id").alias("id"), F.lit("quoted text").alias("text")))
    payload = _json(F.when(F.col("id").cast("bigint") % 10 == 0, 404).otherwise(200).alias("code"), F.struct(*base, quote.alias("quote")).alias("tweet"))
    p = _posts(spark, d).select(P.post_from_lookup(payload).alias("r")).where("r is not null")
    return p.select("r.id", "r.created_at", "r.text", F.col("r.author.handle").alias("handle"), F.col("r.author.verified").alias("verified"), F.col("r.metrics.reposts").alias("reposts"), F.col("r.metrics.views").alias("views"), F.get("r.media", F.lit(0))["url"].alias("media_url"), F.col("r.quoted.id").alias("quoted_id"))


def _timelines(spark, d) -> DataFrame:
    """A timeline for each post: a promoted item, the post, the post again, the post within a visibility wrapper under another id, a repost of a protected author, and the cursor."""
    a, m = F.col("author"), F.col("metrics")

    def tweet(key: Column, *legacy: Column, protected: Column | None = None) -> list[Column]:
        user = F.struct(F.struct(F.struct(a["handle"].alias("screen_name"), a["name"].alias("name")).alias("core"), F.struct((F.lit(False) if protected is None else protected).alias("protected"), a["followers"].alias("followers_count")).alias("legacy")).alias("result"))
        links = F.struct(F.array(F.struct(F.concat(F.lit("https://t.co/"), "id").alias("url"), F.col("url").alias("expanded_url"))).alias("urls"))
        clips = F.array(F.struct(F.lit("video/mp4").alias("content_type"), F.lit(1).alias("bitrate"), F.lit("low").alias("url")), F.struct(F.lit("video/mp4").alias("content_type"), F.lit(9).alias("bitrate"), F.lit("high").alias("url")))
        media = F.array(F.struct(F.lit("video").alias("type"), F.lit("https://t.co/m").alias("url"), F.lit("still").alias("media_url_https"), F.struct(clips.alias("variants")).alias("video_info")))
        text = F.concat(html_escape(F.col("text")), F.lit(" https://t.co/"), "id", F.lit(" https://t.co/m"))
        own = [text.alias("full_text"), F.lit("Wed Oct 30 08:00:00 +0200 2024").alias("created_at"), F.col("lang"), m["likes"].alias("favorite_count"), links.alias("entities"), F.struct(media.alias("media")).alias("extended_entities"), *legacy]
        return [key.alias("rest_id"), F.struct(user.alias("user_results")).alias("core"), F.struct(F.lit("12").alias("count")).alias("views"), F.struct(*own).alias("legacy")]

    result = lambda r: F.struct(F.struct(r.alias("result")).alias("tweet_results"))
    post = F.struct(*tweet(F.col("id")))
    hidden = F.struct(F.lit("TweetWithVisibilityResults").alias("__typename"), F.struct(*tweet(F.concat("id", F.lit("b")))).alias("tweet"))
    repost = F.struct(*tweet(F.concat("id", F.lit("r")), F.struct(F.struct(*tweet(F.concat("id", F.lit("o")), protected=F.col("id").cast("bigint") % 3 == 0)).alias("result")).alias("retweeted_status_result")))
    promoted = F.struct(F.struct(F.struct(*tweet(F.lit("ad"))).alias("result")).alias("tweet_results"), F.struct(F.lit("x").alias("advertiser")).alias("promotedMetadata"))
    entry = lambda item: F.to_json(F.struct(F.struct(item.alias("itemContent")).alias("content")))
    module = F.concat(F.lit('{"content": {"items": ['), F.concat_ws(", ", *[F.to_json(F.struct(F.struct(result(x).alias("itemContent")).alias("item"))) for x in (post, hidden, repost)]), F.lit("]}}"))
    cursor = F.concat(F.lit('{"content": {"cursorType": "Bottom", "value": "c'), "id", F.lit('"}}'))
    payload = F.concat(F.lit('{"instructions": [{"entries": ['), F.concat_ws(", ", entry(promoted), entry(result(post)), module, cursor), F.lit("]}]}"))
    return _posts(spark, d).select("id", payload.alias("payload"))


def post_timeline(spark, d):
    t = P.timeline_posts(_timelines(spark, d), "id", "payload")
    return t.select(F.col("id").alias("timeline"), "pos", F.col("post.id").alias("id"), "post.text", "post.url", "post.created_at", F.col("post.author.handle").alias("handle"), F.col("post.metrics.likes").alias("likes"), F.get("post.media", F.lit(0))["url"].alias("clip"), "post.reposted_by")


def timeline_cursor(spark, d):
    return P.timeline_cursors(_timelines(spark, d), "id", "payload")


def thread_split(spark, d):
    """Posts above and below the focal one of each timeline."""
    t = P.timeline_posts(_timelines(spark, d), "id", "payload").withColumn("focal", F.concat("id", F.lit("b")))
    return P.around_focal(t, "id", "focal").select(F.col("id").alias("timeline"), F.col("post.id").alias("id"), "side")


def expand_links(spark, d):
    links = F.array(F.struct(F.concat(F.lit("https://t.co/"), "id").alias("url"), F.col("url").alias("expanded_url")), F.struct(F.lit("https://t.co/").alias("url"), F.lit(None).cast("string").alias("expanded_url")))
    return _posts(spark, d).select("id", P.expand_links(F.concat("text", F.lit(" https://t.co/"), "id", F.lit(" https://t.co/")), links).alias("text"))


def timeline_scan(spark, d):
    """The first eight distinct addresses of three pages of a query, five hits a page."""
    h = _hits(spark, d).where("url is not null").withColumn("page", (F.floor((F.col("idx") - 1) / 5) + 1).cast("int"))
    return P.scan_pages(h, "qid", "page", "idx", "url", 8)


def enrich_topup(spark, d):
    """Hits looked up in rank order among those with a date, until three are found."""
    h = _hits(spark, d)
    return P.enrich_topup(h.select("qid", "idx", "hit_id"), h.where("published is not null").select("hit_id"), "qid", "idx", "hit_id", 3)


def question_page(spark, d):
    items = F.array(*[F.struct(((F.col("doc_id") * (k + 3)) % 11).alias("score"), (F.col("doc_id") % 7 == k).alias("is_accepted"), F.lit(f"<p>b{k}</p>").alias("body")) for k in range(7)])
    question = _json(F.col("source").alias("title"), F.col("text").alias("body"))
    docs = table(spark, d, "documents").where("source is not null")
    return docs.select("doc_id", F.sha2(P.question_page(question, _json(items.alias("items"))), 256).alias("page"))


def question_target(spark, d):
    urls = F.concat(F.when(F.col("doc_id") % 3 == 0, "https://www.stackoverflow.com").when(F.col("doc_id") % 3 == 1, "https://unix.stackexchange.com").otherwise("https://other.example"), F.lit("/questions/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "/title?x=1").otherwise(""))
    t = table(spark, d, "documents").select("doc_id", P.question_target(urls).alias("t"))
    return t.where("t is not null").select("doc_id", "t.site", "t.question")


def package_page(spark, d):
    url = F.concat(F.lit("https://www.npmjs.com/package/"), F.when(F.col("doc_id") % 2 == 0, "@scope/").otherwise(""), F.lit("p"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "?activeTab=code").otherwise(""))
    payload = _json(F.struct(F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("1."), "doc_id")).alias("latest")).alias("dist-tags"), F.col("source").alias("description"), F.col("url").alias("homepage"), F.col("text").alias("readme"))
    return table(spark, d, "documents").select("doc_id", P.package_target(url).alias("name"), F.sha2(P.package_page(P.package_target(url), P.package_record(payload)), 256).alias("page"))


def thread_feed(spark, d):
    e = lambda c: html_escape(F.coalesce(c, F.lit("")))
    entry = lambda title, author, body: F.concat(F.lit("<entry><title>"), title, F.lit("</title><author><name>"), author, F.lit("</name></author><updated>2024-05-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit('T01:02:03+00:00</updated><content type="html">'), body, F.lit("</content></entry>"))
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>'), entry(e(F.col("source")), e(F.col("lang")), F.lit("&lt;p&gt;post&lt;/p&gt; &lt;!-- SC_ON --&gt; trailer")), entry(F.lit("re"), F.concat(F.lit("u"), F.col("doc_id").cast("string")), F.lit("&lt;p&gt;first&lt;/p&gt;")), F.lit("</feed>"))
    return P.thread_feed(table(spark, d, "documents").select("doc_id", xml.alias("xml")), "doc_id", "xml")


def _stories(spark, d) -> DataFrame:
    """A story a document: a chain of ten replies (or two), then a second comment."""
    chain = lambda n: '{"author": "deep", "created_at": "2024-05-01T10:00:00Z", "text": "t", "children": [' * n + "]}" * n
    second = F.concat(F.lit(', {"author": null, "created_at": "2024-05-02T10:00:00Z", "text": '), F.to_json(F.array(F.coalesce("source", F.lit("")))), F.lit("}"))
    second = F.regexp_replace(F.regexp_replace(second, r'"text": \["', '"text": "'), r'"\]\}$', '"}')
    head = F.concat(F.lit('{"id": '), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(', "title": "T'), "doc_id", F.lit('"'))).otherwise(""), F.when(F.col("doc_id") % 2 == 0, ', "url": "https://a.example/x"').otherwise(', "url": "javascript:x"'), F.lit(', "points": 4, "author": "", "created_at": "2024-05-03T10:00:00Z", "children": ['))
    return table(spark, d, "documents").select("doc_id", F.concat(head, F.when(F.col("doc_id") % 5 == 0, chain(10)).otherwise(chain(2)), second, F.lit("]}")).alias("json"))


def story_record(spark, d):
    return _stories(spark, d).select(P.story_record(F.col("json")).alias("r")).select("r.*")


def story_comments(spark, d):
    return P.story_comments(_stories(spark, d), "doc_id", "json")


def channel_posts(spark, d):
    e = html_escape
    post = lambda number, when, media: F.concat(F.lit('<div class="tgme_widget_message text_not" data-post="chan/'), number, F.lit('"><div class="tgme_widget_message_text js-message_text">'), e(F.coalesce("source", F.lit(""))), F.lit("<br>second</div>" + ('<a class="tgme_widget_message_photo_wrap"></a>' if media else "") + '<a class="tgme_widget_message_date" href="'), F.lit("https://t.me/chan/x" if media else "/x"), F.lit(f'"><time datetime="{when}"></time></a><span class="tgme_widget_message_views">1.2K</span></div>'))
    page = F.concat(F.lit("<html><body>"), post(F.col("doc_id").cast("string"), "2024-05-01", True), F.when(F.col("doc_id") % 2 == 0, post((F.col("doc_id") + 7).cast("string"), "2024-05-02", False)).otherwise(""), F.lit('<div class="tgme_widget_message" data-post="chan/no"></div></body></html>'))
    return P.channel_posts(table(spark, d, "documents").select("doc_id", page.alias("html")), "doc_id", "html")


def _positions(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    number = lambda c: F.format_number(c, 0)  # noqa: E731 - thousands are set apart
    payload = _json(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("market_and_exchange_names"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.000").alias("report_date_as_yyyy_mm_dd"), number(F.col("o_totalprice")).alias("open_interest_all"), F.col("o_custkey").cast("string").alias("noncomm_positions_long_all"), F.lit(".").alias("noncomm_positions_short_all"), F.lit("7").alias("noncomm_postions_spread_all"))
    return o.select("o_orderkey", P.positions_from_api(payload).alias("r")).select("o_orderkey", "r.*")


def cot_api(spark, d):
    return _positions(spark, d).select("o_orderkey", "market", "report_date", "open_interest", "noncommercial_long", "noncommercial_short", "noncommercial_spreads", "commercial_long")


def cot_latest_week(spark, d):
    return P.latest_week(_positions(spark, d), "report_date", group="market").select("o_orderkey", "market", "report_date")


def jsonld_product(spark, d):
    thing = F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.col("p_name").alias("name"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("brand"), F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("price"), (F.col("p_size") + 1).alias("lowPrice"), F.lit("EUR").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"))).alias("offers"))
    graph = F.when(F.col("p_partkey") % 5 == 0, F.lit("{not json")).otherwise(_json(F.array(thing).alias("@graph")))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), graph, F.lit("</script></head><body><p>x</p></body></html>"))
    p = P.products(table(spark, d, "part").select("p_partkey", page.alias("html")), "p_partkey", "html")
    return p.select("p_partkey", *[F.col("product")[n].alias(n) for n in ("name", "brand", "price", "currency", "availability")])


def crawl_shape(spark, d):
    """Queries as pages, their hits as links; queries of an even id were read."""
    h = _hits(spark, d)
    pages = h.select(F.col("qid").cast("string").alias("url")).distinct().select("url", F.concat(F.lit("t"), "url").alias("title"), F.lit("c").alias("content"), F.when(F.col("url").cast("bigint") % 4 == 0, 2).alias("depth"), (F.col("url").cast("bigint") % 2 == 0).alias("ok"))
    links = h.select(F.col("qid").cast("string").alias("url"), F.col("idx").alias("pos"), F.col("url").alias("child"))
    return P.crawl_shape(pages, links)


def sitemap_locs(spark, d):
    """A sitemap index a query with three maps, the query's hits in these by their place."""
    h = _hits(spark, d).where("url is not null")
    name = lambda k: F.concat(F.lit("map-"), F.col("qid").cast("string"), F.lit("-"), k)
    loc = lambda u: F.concat(F.lit("<url><loc> "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = h.groupBy("qid", (F.col("idx") % 3).alias("k")).agg(F.array_join(F.collect_list(loc(F.col("url"))), "").alias("x")).select(name(F.col("k").cast("string")).alias("url"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("xml"))
    index = h.select("qid").distinct().select(name(F.lit("i")).alias("url"), F.concat(F.lit('<sitemapindex xmlns="x">'), *[F.concat(F.lit("<sitemap><loc>"), name(F.lit(str(k))), F.lit("</loc></sitemap>")) for k in range(3)], F.lit("</sitemapindex>")).alias("xml"))
    return P.sitemap_tree(maps.unionByName(index), index.select("url"))


_FUNCTIONS = (paper_graph, paper_registry, paper_catalog, unify_papers, paper_filters, code_repository, code_file, map_issue, post_mapper, post_timeline, timeline_cursor, thread_split, expand_links, timeline_scan, enrich_topup, question_page, question_target, package_page, thread_feed, story_record, story_comments, channel_posts, cot_api, cot_latest_week, jsonld_product, crawl_shape, sitemap_locs)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_H = "WITH h AS (SELECT * EXCLUDE (idx), row_number() OVER (PARTITION BY qid ORDER BY idx, hit_id) AS idx FROM (SELECT DISTINCT ON (hit_id) * FROM search_hits) WHERE qid IS NOT NULL) "
_AUTHORS = "list_transform(coalesce(engines, []), lambda e: coalesce(e, ''))"
_YEAR = "CAST(hit_id % 45 + 1980 AS INT)"
_CITED = "CAST(length(snippet) AS BIGINT)"
_WEB = "CASE WHEN regexp_matches(url, '^https?://') THEN url END"
_POSTS = "WITH p AS (SELECT id, unnest(arg_min({'url': url, 'text': text, 'lang': lang, 'author': author, 'metrics': metrics}, (text, url, author.handle))) FROM post WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id) "
_TEXT = "trim(text || ' ' || url || ' ')"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_T = "SELECT id AS timeline, {pos} AS pos, id || '{suffix}' AS id, regexp_replace(text || ' ' || coalesce(url, 'https://t.co/' || id) || ' ', '^\\s+|\\s+$', '', 'g') AS text, 'https://x.com/' || coalesce(author.handle, '') || '/status/' || id || '{suffix}' AS url, '2024-10-30T06:00:00Z' AS created_at, coalesce(author.handle, '') AS handle, metrics.likes AS likes, 'high' AS clip, {by} AS reposted_by FROM p"
_TIMELINE = " UNION ALL ".join([_T.format(pos=1, suffix="", by="NULL"), _T.format(pos=4, suffix="b", by="NULL"), _T.format(pos=5, suffix="o", by="author.handle") + " WHERE CAST(id AS BIGINT) % 3 <> 0"])
_DOCS = "(SELECT DISTINCT doc_id, source, lang, text, url FROM documents)"
ORACLES = {
    "paper_graph": _H + f"SELECT hit_id, title, {_AUTHORS} AS authors, {_YEAR} AS year, engine AS venue, {_CITED} AS citations, '10.1/' || hit_id AS doi, url, snippet AS abstract, CASE WHEN hit_id % 3 = 0 THEN url END AS open_access_pdf FROM h",
    "paper_registry": _H + f"SELECT hit_id, title, [trim('A' || (hit_id % 7) || ' ' || coalesce(engine, ''))] AS authors, {_YEAR} AS year, engine AS venue, {_CITED} AS citations, '10.2/' || hit_id AS doi, url, trim(regexp_replace(snippet, '<[^>]+>', '', 'g')) AS abstract, CASE WHEN hit_id % 2 = 0 THEN {_WEB} END AS open_access_pdf FROM h",
    "paper_catalog": _H + f"SELECT hit_id, title, {_AUTHORS} AS authors, {_YEAR} AS year, CASE WHEN hit_id % 2 = 0 AND engine IS NOT NULL THEN engine ELSE 'raw venue' END AS venue, {_CITED} AS citations, '10.3/' || hit_id AS doi, coalesce(CASE WHEN hit_id % 3 = 0 THEN url END, 'https://catalog.example/W' || hit_id) AS url, snippet AS abstract, {_WEB} AS open_access_pdf FROM h",
    "unify_papers": _H + f", b AS (SELECT qid, hit_id, CASE engine WHEN 'papers' THEN 0 WHEN 'findra' THEN 1 ELSE 2 END AS backend, title, CASE WHEN engine IN ('papers', 'findra') OR hit_id % 2 = 0 THEN engine ELSE 'raw venue' END AS venue, {_YEAR} AS year FROM h WHERE engine IS NOT NULL) SELECT qid, hit_id, backend, title, venue, year, '10.' || (backend + 1) || '/' || hit_id AS doi FROM b QUALIFY backend = min(backend) OVER (PARTITION BY qid)",
    "paper_filters": _H + f"SELECT hit_id, {_YEAR} AS year, url AS open_access_pdf FROM h WHERE hit_id % 45 + 1980 >= 2010 AND hit_id % 3 = 0 AND url <> ''",
    "code_repository": _H + "SELECT hit_id, concat_ws('/', engine, 'r', qid) AS full_name, snippet AS description, coalesce(url, '') AS url, coalesce(CASE WHEN hit_id % 4 > 0 THEN length(snippet) END, 0) AS stars, coalesce(idx, 0) AS forks, engine AS language, coalesce(engines, []) AS topics, CASE WHEN hit_id % 3 > 0 THEN coalesce(engine, '') ELSE '' END AS owner, published AS updated FROM h",
    "code_file": _H + "SELECT hit_id, coalesce(engine, '') AS repo, 'src/' || hit_id AS path, coalesce(title, '') AS name, coalesce(url, '') AS url FROM h",
    "map_issue": _H + "SELECT hit_id, coalesce(title, '') AS title, coalesce(url, '') AS url, CASE WHEN hit_id % 2 = 0 THEN coalesce(engine, 'none') || '/r' || qid ELSE coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/+([^/?#]+/[^/?#]+)', 1), '') END AS repo, hit_id AS number, CASE WHEN hit_id % 5 = 0 THEN 'closed' ELSE 'open' END AS state, idx AS comments, hit_id % 3 = 0 AS is_pull_request, published AS created, CAST(NULL AS VARCHAR) AS updated FROM h",
    "post_mapper": _POSTS + "SELECT id, strftime(to_timestamp(CAST(id AS BIGINT) % 1000000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created_at, text, coalesce(author.handle, '') AS handle, coalesce(author.verified, false) AS verified, metrics.reposts AS reposts, metrics.views AS views, url AS media_url, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'q' || id END AS quoted_id FROM p WHERE CAST(id AS BIGINT) % 10 <> 0",
    "post_timeline": _POSTS + _TIMELINE,
    "timeline_cursor": _POSTS + "SELECT id, 'c' || id AS cursor FROM p",
    "thread_split": _POSTS + f", t AS ({_TIMELINE}) SELECT timeline, id, CASE WHEN pos < 4 THEN 'thread' WHEN pos > 4 THEN 'reply' ELSE 'focal' END AS side FROM t",
    "expand_links": _POSTS + "SELECT id, text || ' ' || coalesce(nullif(url, ''), 'https://t.co/' || id) || ' https://t.co/' AS text FROM p",
    "timeline_scan": _H + ", f AS (SELECT qid, url, min(idx) AS i FROM h WHERE url IS NOT NULL AND idx <= 15 GROUP BY qid, url) SELECT qid, url, row_number() OVER (PARTITION BY qid ORDER BY i) AS place FROM f QUALIFY place <= 8",
    "enrich_topup": _H + ", k AS (SELECT qid, hit_id, idx, published IS NOT NULL AS hit FROM h), t AS (SELECT qid, nth_value(idx, 3) OVER (PARTITION BY qid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM k WHERE hit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY idx) = 1), a AS (SELECT k.qid, count(*) AS attempted, count(*) FILTER (WHERE hit) AS got FROM k LEFT JOIN t USING (qid) WHERE idx <= coalesce(third, 1000000) GROUP BY k.qid) SELECT k.qid, k.hit_id, row_number() OVER (PARTITION BY k.qid ORDER BY idx) AS place, attempted, got * 2 < attempted AS partial FROM k JOIN a USING (qid) WHERE hit QUALIFY place <= 3",
    "question_page": "WITH a AS (SELECT d.doc_id, k, (d.doc_id * (k + 3)) % 11 AS s FROM documents d, range(7) r(k)), b AS (SELECT doc_id, string_agg('<h3>Answer (score ' || s || CASE WHEN doc_id % 7 = k THEN ', accepted' ELSE '' END || ')</h3><p>b' || k || '</p>', '' ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, k) AS n FROM a) WHERE n <= 5 GROUP BY doc_id) SELECT doc_id, sha256('<html><head><title>' || source || '</title></head><body><article><h1>' || source || '</h1>' || coalesce(text, '') || '<h2>Answers</h2>' || x || '</article></body></html>') AS page FROM documents JOIN b USING (doc_id) WHERE source IS NOT NULL",
    "question_target": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stackoverflow' ELSE 'unix' END AS site, CAST(doc_id AS VARCHAR) AS question FROM documents WHERE doc_id % 3 < 2",
    "package_page": f"WITH k AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '@scope/' ELSE '' END || 'p' || doc_id AS name FROM documents) SELECT doc_id, name, sha256('<html><head><title>' || name || '</title></head><body><article><h1>' || name || '</h1><p>' || {_ESC.format('coalesce(source, $$$$)')} || '</p>' || CASE WHEN doc_id % 5 > 0 THEN '<p>Latest version: 1.' || doc_id || '</p>' ELSE '' END || CASE WHEN coalesce(url, '') <> '' THEN '<p>Homepage: <a href=\"' || {_ESC.format('url')} || '\">' || {_ESC.format('url')} || '</a></p>' ELSE '' END || '<pre>' || {_ESC.format('coalesce(text, $$$$)')} || '</pre></article></body></html>') AS page FROM k",
    "thread_feed": "SELECT doc_id, 0 AS pos, coalesce(source, '') AS title, coalesce(lang, '') AS author, '2024-05-0' || (doc_id % 9 + 1) AS day, '<p>post</p> ' AS body FROM documents UNION ALL SELECT doc_id, 1, 're', 'u' || doc_id, '2024-05-0' || (doc_id % 9 + 1), '<p>first</p>' FROM documents",
    "story_record": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id ELSE 'item ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/x' END AS url, 4 AS points, '[deleted]' AS author, '2024-05-03' AS day FROM documents",
    "story_comments": "WITH k AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 2 END AS n FROM documents) SELECT doc_id, CAST(i AS INT) AS pos, CAST(i + 1 AS INT) AS depth, 'deep' AS author, '2024-05-01' AS day, 't' AS text, n + 1 AS total FROM k, range(8) r(i) WHERE i < n UNION ALL SELECT doc_id, least(n, 8), 1, '[deleted]', '2024-05-02', coalesce(source, ''), n + 1 FROM k",
    "channel_posts": "WITH k AS (SELECT doc_id, doc_id AS post_id, 'https://t.me/chan/x' AS url, '2024-05-01' AS date, '1.2K' AS views, coalesce(source, '') || chr(10) || 'second' AS text, true AS media FROM documents UNION ALL SELECT doc_id, doc_id + 7, 'https://t.me/chan/' || (doc_id + 7), '2024-05-02', '1.2K', coalesce(source, '') || chr(10) || 'second', false FROM documents WHERE doc_id % 2 = 0) SELECT * REPLACE (ltrim(text, chr(10)) AS text), row_number() OVER (PARTITION BY doc_id ORDER BY post_id DESC) AS place, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS older FROM k",
    "cot_api": "SELECT o_orderkey, o_orderpriority AS market, strftime(o_orderdate, '%Y-%m-%d') AS report_date, CAST(round_even(o_totalprice, 0) AS BIGINT) AS open_interest, o_custkey AS noncommercial_long, CAST(NULL AS BIGINT) AS noncommercial_short, 7 AS noncommercial_spreads, CAST(NULL AS BIGINT) AS commercial_long FROM orders",
    "cot_latest_week": "SELECT o_orderkey, o_orderpriority AS market, strftime(o_orderdate, '%Y-%m-%d') AS report_date FROM orders QUALIFY report_date = max(report_date) OVER (PARTITION BY o_orderpriority)",
    "jsonld_product": "SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(CASE WHEN p_partkey % 2 = 0 AND p_size <> 0 THEN p_size ELSE p_size + 1 END AS VARCHAR) AS price, 'EUR' AS currency, 'InStock' AS availability FROM part WHERE p_partkey % 5 <> 0",
    "crawl_shape": _H + "SELECT CAST(qid AS VARCHAR) AS url, 't' || qid AS title, 'c' AS content, CASE WHEN qid % 4 = 0 THEN 2 ELSE 0 END AS depth, coalesce(list(url ORDER BY idx) FILTER (WHERE url <> ''), []) AS children FROM h WHERE qid % 2 = 0 GROUP BY qid",
    "sitemap_locs": _H + "SELECT DISTINCT 'map-' || qid || '-i' AS root, replace(regexp_extract(ltrim(replace(url, '&', '&amp;')), '^([^<\\]\\s]+)', 1), '&amp;', '&') AS loc FROM h WHERE regexp_matches(url, '^\\s*[^<\\]\\s]')",
}
