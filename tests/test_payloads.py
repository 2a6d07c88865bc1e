"""Payload mappers, converters and the pieces around them on damaged, empty and nested input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weblens.operators import documents as D
from weblens.operators import html as H
from weblens.operators import mapping as M
from weblens.operators import payloads as P
from weblens.operators import state as S
from weblens.operators import vectors as V
from weblens.plans import tools
from weblens.sources import sinks, tables


def mapped(spark, mapper, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    return [r["r"] for r in df.select("i", mapper(F.col("p")).alias("r")).orderBy("i").collect()]


MAPPERS = [P.paper_from_graph, P.paper_from_registry, P.paper_from_catalog, P.code_repository, P.code_file, P.code_issue, P.post_from_lookup, P.package_record, P.story_record, P.positions_from_api]


@pytest.mark.parametrize("mapper", MAPPERS, ids=lambda m: m.__name__)
def test_damaged_payloads_do_not_fail(spark, mapper):
    assert len(mapped(spark, mapper, [None, "", "[1]", "{", "{}", '{"title": {"x": 1}, "author": 5}', "x" * 50_000])) == 7


def test_registry_paper_keeps_case_of_fields(spark):
    work = {"title": ["A <b>"], "author": [{"given": "G"}, {"family": "F"}, {}], "published": {"date-parts": [[]]}, "URL": "https://a.example", "DOI": "10/x", "abstract": "<p>t</p>", "link": [{"URL": 5, "content-type": "application/pdf"}]}
    r = mapped(spark, P.paper_from_registry, [json.dumps(work)])[0]
    assert (r["title"], r["authors"], r["year"], r["doi"], r["abstract"], r["open_access_pdf"]) == ("A <b>", ["G", "F", ""], None, "10/x", "t", None)


def test_index_text_takes_the_last_word_of_a_place(spark):
    work = {"abstract_inverted_index": {"b": [1, 3], "a": [0], "c": [1]}}
    assert mapped(spark, P.paper_from_catalog, [json.dumps(work), json.dumps({"abstract_inverted_index": {}})])[0]["abstract"] == "a c b"


def test_timelines_skip_what_is_no_post(spark):
    tweet = {"rest_id": "1", "core": {"user_results": {"result": {"legacy": {"screen_name": "h"}}}}, "legacy": {"full_text": "a &amp;lt; b", "created_at": "no date"}}
    quoted = {**tweet, "rest_id": "2", "quoted_status_result": {"result": {**tweet, "rest_id": "3"}}}
    items = [{"tweet_results": {"result": x}} for x in (tweet, {"rest_id": "9"}, quoted, None)]
    payload = {"instructions": [{"entries": [{"content": {"itemContent": i}} for i in items]}, {"entry": {"content": {"cursorType": "Bottom", "value": "z"}}}, {}]}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, None), (3, "{"), (4, "{}")], "k int, p string")
    got = P.timeline_posts(df, "k", "p").orderBy("pos").collect()
    assert [(r["k"], r["post"]["id"], r["post"]["text"], r["post"]["created_at"], r["post"]["quoted"] and r["post"]["quoted"]["id"]) for r in got] == [(1, "1", "a &lt; b", None, None), (1, "2", "a &lt; b", None, "3")]
    assert {r["k"]: r["cursor"] for r in P.timeline_cursors(df, "k", "p").collect()}[1] == "z"


def test_comments_beyond_the_limits_are_counted(spark):
    wide = {"id": 1, "children": [{"text": str(i), "children": [{"text": "x"}]} for i in range(400)]}
    df = spark.createDataFrame([(1, json.dumps(wide)), (2, "{"), (3, None), (4, "[]")], "k int, p string")
    rows = P.story_comments(df, "k", "p").orderBy("pos").collect()
    assert len(rows) == 500 and {r["total"] for r in rows} == {800} and [r["depth"] for r in rows[:3]] == [1, 2, 1]


def test_topup_stops_at_the_limit(spark):
    rng = random.Random(1)
    rows = [(g, i, f"{g}-{i}", rng.random() < 0.5) for g in range(30) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, r int, k string, hit boolean")
    got = {}
    for r in P.enrich_topup(df.select("g", "r", "k"), df.where("hit").select("k"), "g", "r", "k", 2).collect():
        got.setdefault(r["g"], []).append((r["place"], r["k"], r["attempted"]))
    for g in range(30):
        own = [(k, hit) for gg, _, k, hit in rows if gg == g]
        hits, asked = [], 0
        for k, hit in own:
            if len(hits) == 2:
                break
            asked += 1
            hits += [k] if hit else []
        assert sorted(got.get(g, [])) == [(i + 1, k, asked) for i, k in enumerate(hits)]


def test_sitemaps_end_at_the_depth(spark):
    maps = [("a", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>"), ("b", "<urlset><url><loc><![CDATA[https://x.example/1]]></loc></url></urlset>"), ("c", None)]
    got = P.sitemap_tree(spark.createDataFrame(maps, "url string, xml string"), spark.createDataFrame([("a",), ("zz",)], "url string"))
    assert [tuple(r) for r in got.collect()] == [("a", "https://x.example/1")]


def test_converter_rows_with_errors(spark):
    rows = [(1, "docx", b"PK broken"), (2, "pdf", b"x"), (3, "csv", None), (4, None, b"x"), (5, "feed", b"<rss><!DOCTYPE x></rss>"), (6, "feed", b"<rss"), (7, "json", b'{"a": 1}'), (8, "json", b"not json"), (9, "csv", b"")]
    got = {r["k"]: (r["error"], r["content"]) for r in D.convert_documents(spark.createDataFrame(rows, "k int, kind string, body binary"), "k", "kind", "body").collect()}
    assert [got[k][0] for k in range(1, 10)] == ["not an archive", "unknown kind", "no document", "unknown kind", "document type declarations are refused", "damaged document", None, None, None]
    assert got[8][1] == "```json\nnot json\n```"


def test_top_k_over_many_batches(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {(r["seed"], r["rank"]): r["vec_id"] for r in V.top_k(df, df.where("vec_id < 4"), 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sim(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    for s in range(4):
        best = sorted((-sim(rows[s][1], v), k) for k, v in rows if k != s)[:5]
        assert [got[s, i + 1] for i in range(5)] == [k for _, k in best]


def test_running_totals_and_times_before(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 50), i, rng.choice([None, 1.0, 2.5])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double")
    got = {r["i"]: (r["n"], r["total"]) for r in S.running_totals(df, "k", F.floor(F.col("t") / 7), ["t", "i"], "v").collect()}
    for k in ("a", "b", None):
        seen = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            seen.append(r[3])
            known = [x for x in seen if x is not None]
            assert got[r[2]] == (len(seen), sum(known) if known else None)
    times = spark.createDataFrame(sorted({(r[0], r[1]) for r in rows if r[0]}), "k string, t int")
    before = {(r["k"], r["t"]): r["previous"] for r in S.previous(times, "k", "t", 10).collect()}
    for k, t in before:
        assert before[k, t] == max((x for kk, x in before if kk == k and x < t), default=None)


def test_states_go_on_over_batches(spark):
    rows = [(1, float(i), i) for i in range(100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["i"]: r["due"] for r in S.poll_due(spark.createDataFrame(rows, "k int, t double, i int"), "k", "t", "i", 10.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [i for i, due in got.items() if due] == list(range(0, 100, 10))


def fetcher():
    def fetch(url):
        if "bad" in url:
            raise ValueError(url)
        words = " ".join(f"word{i}" for i in range(60))
        return url, 200, f"<html><body><article><h1>T</h1><p>{words}.</p></article></body></html>"

    return fetch


def test_pages_are_fetched_in_the_tasks(spark):
    urls = [(f"https://h{i % 2}.example/{'bad' if i == 3 else i}",) for i in range(40)] + [(None,), ("no address",)]
    got = {r["url"]: (r["status"], r["error"]) for r in tables.fetch_pages(spark.createDataFrame(urls, "url string"), fetcher(), chunk=5).collect()}
    assert len(got) == 41 and got["https://h1.example/bad"] == (None, "ValueError") and got["https://h0.example/0"] == (200, None)


def test_research_with_the_callers_fetch(spark):
    hits = [(1, i, i, "alpha beta", f"https://h{i}.example/{'bad' if i == 1 else i}", "alpha", None, None) for i in range(1, 7)]
    h = spark.createDataFrame(hits, "qid int, idx int, hit_id int, title string, url string, snippet string, published string, date_source string").withColumn("title", F.concat("title", F.lit(" "), F.col("idx").cast("string")))
    got = tools.research_live(h, spark.createDataFrame([(1, "alpha beta")], "qid int, query string"), fetcher(), 3).orderBy("source_no").collect()
    assert len(got) == 3 and all("bad" not in r["url"] and r["word_count"] >= 30 for r in got)


def test_answers_keep_rows_without_one(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "")], "k int, context string")

    def model(text):
        if text == "bad":
            raise RuntimeError
        return text.upper()

    assert [(r["answer"], r["answer_error"]) for r in tools.answers(df, model).orderBy("k").collect()] == [("GOOD", None), (None, "RuntimeError"), (None, None), (None, None)]
    assert {r["answer"] for r in tools.answers(df).collect()} == {None}


def test_registry_survives_damage(spark, tmp_path):
    path = str(tmp_path / "w")
    assert tables.watch_registry(spark, path).count() == 0
    new = spark.createDataFrame([("https://a.example", "x", 60, "https://hook.example", None, None)] * 2, "url string, selector string, interval_s bigint, webhook string, last_hash string, last_check double")
    sinks.persist_watches(tables.watch_registry(spark, path), new, path)
    sinks.persist_watches(tables.watch_registry(spark, path), new, path)
    (tmp_path / "w" / "more.json").write_text('{"id": "i", "url": "u", "unknown": 1}\n{broken\n{"id": "no url"}\n')
    assert sorted(r["url"] for r in tables.watch_registry(spark, path).collect()) == ["https://a.example", "u"]


def test_markdown_edges():
    assert H.fix_markdown("```\nx", "<pre>x</pre>") == "```\nx"
    assert H.fix_markdown("| a | b |\n|---|---|\n| 1 | 2 |", "") == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert H.fix_markdown("`" * 5000, "<pre>x</pre>") == "`" * 5000


def test_schema_of_fields():
    got = M.struct_of({"a": "int", "b": "list", "c": "anything", "d": "number", "e": "bool"})
    assert [f.dataType.simpleString() for f in got] == ["bigint", "array<string>", "string", "double", "boolean"]


def test_embedding_hook(spark):
    import pandas as pd

    df = spark.createDataFrame([("aa", "a"), ("b", "a"), (None, "a")], "q string, t string")
    embed = lambda texts: pd.Series([[float(t.count("a")), float(t.count("b"))] for t in texts])
    assert [r["sim"] for r in M.similarities(df, "q", "t", embed).collect()] == [1.0, 0.0, 0.0]
    assert [r["sim"] for r in M.similarities(df, "q", "t").collect()] == [0.0, 0.0, 0.0]


def test_clusters_need_a_shared_folder():
    from weblens import session as X

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": lambda self: type("C", (), {"get": staticmethod(lambda *_: None)})()})()

    with pytest.raises(RuntimeError):
        X.shared_dir(Fake())


def test_upsert_asks_the_file_system(spark, tmp_path):
    from weblens.streaming import events as E

    write = E.upsert_latest(f"file://{tmp_path}/up", "k", "t")
    for number, rows in enumerate([[(1, 1, "a")], [(2, 1, "b")], [(1, 2, "c")]]):
        write(spark.createDataFrame(rows, "k int, t int, v string"), number)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/up/v2").collect()) == [(1, 2, "c"), (2, 1, "b")]
    assert not (tmp_path / "up" / "v0").exists()


def test_trees_of_any_depth_are_counted(spark):
    from weblens.operators.records import comment_tree, tree_sizes

    chain = [(1, None)] + [(i, i - 1) for i in range(2, 40)] + [(100, None), (101, 100), (102, 100), (200, 201), (201, 200)]  # the last two are in no tree
    df = spark.createDataFrame(chain, "id long, parent long")
    assert {tuple(r) for r in tree_sizes(df).collect()} == {(1, 39), (100, 3)}
    got = sorted(tuple(r) for r in comment_tree(df, max_depth=3, cap=2).select("root", "id", "depth", "pos").collect())
    assert got == [(1, 1, 0, 1), (1, 2, 1, 2), (100, 100, 0, 1), (100, 101, 1, 2)]
