"""Operators against plain loops, round trips and generated files."""

import io
import re
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weblens.functions import urls as U
from weblens.operators import documents as D
from weblens.operators import html as H
from weblens.operators import ranking as R
from weblens.operators import state as S


def floor_loop(scores):
    """Best to worst: below a quarter of the best goes while more than three stay."""
    kept, left = [], len(scores)
    for s in scores:
        if scores[0] > 0 and s < 0.25 * scores[0] and left > 3:
            left -= 1
        else:
            kept.append(s)
    return kept


def test_relative_floor_matches_a_loop(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for q in range(60):
        scores = sorted((round(rng.random() ** 3 * 3, 3) for _ in range(rng.randint(1, 9))), reverse=True)
        rows += [(q, i, s, 0, True) for i, s in enumerate(scores)]
        want[q] = floor_loop(scores)
    df = spark.createDataFrame(rows, "qid int, idx int, lex double, fresh_rank int, keep boolean")
    got: dict = {}
    for r in R.keep_and_floor(df, "lex", "keep").orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["lex"])
    assert got == want


def test_greedy_dedup_does_not_register_dropped_keys(spark):
    rows = [(1, 1, "t1", "https://a.example/1"), (1, 2, "t2", "http://a.example/1/"), (1, 3, "t2", "https://a.example/3"), (1, 4, None, None), (1, 5, None, None)]
    df = spark.createDataFrame(rows, "qid int, idx int, title string, url string")
    assert sorted(r["idx"] for r in R.greedy_dedup(df).collect()) == [1, 3, 4, 5]


def by_backreference(letters):
    """Blocks of one letter each; a regular expression finds the longest run that is repeated behind itself."""
    out, at = [], 0
    while at < len(letters):
        m = re.compile(r"(.+)\1").match(letters, at)
        run = m[1] if m else letters[at]
        out += run
        at += 2 * len(run) if m else 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="pqr", max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_block_runs(letters, blanks):
    assert R.dedup_blocks("\n\n".join(letters)) == "\n\n".join(by_backreference(letters))
    spread = list(letters)
    for i in blanks:
        spread.insert(min(i, len(spread)), " \t")
    got = R.dedup_blocks("\n\n".join(spread)).split("\n\n")
    assert [b for b in got if b.strip()] == by_backreference(letters) and got.count(" \t") == len(blanks)


def test_block_runs_of_long_texts():
    text = "\n\n".join(["same"] * 4000)
    assert R.dedup_blocks(text) == "\n\n".join(["same"] * 2000)
    assert R.dedup_blocks("\n\n".join(map(str, range(50_000)))).count("\n\n") == 49_999


def test_throttle_slots_match_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(h, i, round(rng.random() * 30, 2)) for h in range(4) for i in range(25)]
    df = spark.createDataFrame(rows, "host int, i int, t double")
    got = {(r["host"], r["i"]): round(r["slot"], 6) for r in S.throttle_slots(df, "host", "t", "i", 1.5).collect()}
    for h in range(4):
        last = None
        for _, i, t in sorted((r for r in rows if r[0] == h), key=lambda r: (r[2], r[1])):
            last = t if last is None else max(t, last + 1.5)
            assert got[h, i] == round(last, 6)


def test_asof_misses_at_exactly_ttl(spark):
    probes = spark.createDataFrame([(1, 100), (1, 110), (1, 5), (2, 7)], "k int, t int")
    entries = spark.createDataFrame([(1, 10, "a"), (1, 100, "b")], "k int, c int, v string")
    got = {(r["k"], r["t"]): r["hit"] for r in S.asof_lookup(probes, entries, "k", "t", "c", "v", 10).collect()}
    assert got == {(1, 100): "b", (1, 110): None, (1, 5): None, (2, 7): None}


def test_url_functions(spark):
    rows = [("https://User@WWW.Example.org:8080/a/B/?utm_source=x&b=2&a=1#f",), ("/only/path",), ("",), (None,)]
    df = spark.createDataFrame(rows, "u string")
    got = [tuple(r) for r in df.select(U.host(F.col("u")), U.norm_url(F.col("u")), U.is_valid(F.col("u"))).collect()]
    assert got[0] == ("www.example.org", "user@www.example.org:8080/a/b?a=1&b=2", True)
    assert got[1] == ("", "/only/path", False)
    assert got[3][0] is None


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_documents():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = office({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a|b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x|y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert D.convert("docx", docx)[0] == "# Top\n\na|b\n\n| x\\|y |\n| --- |"
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    xlsx = office({"xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>hi</t></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'})
    text, meta = D.convert("xlsx", xlsx)
    assert text == "## S\n\n| hi | 5 |\n| --- | --- |" and meta["rows_total"] == 1 and not D.truncated(meta)


def test_feed_csv_json():
    rss = "<rss><channel><item><title>T</title><link>https://a.example/1</link><description>&lt;b&gt;x&lt;/b&gt; y</description></item><item><title>U</title><link>javascript:x</link></item></channel></rss>"
    assert [(i["title"], i["url"]) for i in D.from_feed(rss)] == [("T", "https://a.example/1"), ("U", None)]
    assert D.convert("csv", b"a;b\n1;2\n")[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert D.from_json('{"a": [1]}').startswith("```json\n{\n")
    assert D.truncated({"rows_total": 3, "rows_returned": 2})


def test_markup():
    page = "<html lang=en><head><title>T</title></head><body><nav><a href=/x>nav</a></nav><ARTICLE class='a b'><h1>Head</h1><p>One two three.<p>Four <a href='/y#z'>five</a>.<table><tr><td>1<td>2</table></article>"
    assert H.links(page, "https://a.example/q")["links"] == [{"url": "https://a.example/x", "text": "nav"}, {"url": "https://a.example/y", "text": "five"}]
    assert H.extract(page, {"h": {"selector": "article.b > h1", "required": True}, "p": {"selector": "p", "many": True}})["data"]["h"] == "Head"
    a = H.article(page)
    assert a["title"] == "Head" and "nav" not in a["content"] and "One two three." in a["content"] and a["lang"] == "en"
    assert H.article("")["content"] == ""
    assert H.demark("# A\n```\n# b\n```\n[x](y) **z**") == "A\n# b\nx z"


def test_cache_takes_payloads_of_any_length(spark):
    import gzip

    from weblens.sources import sinks

    long = "Zażółć gęślą jaźń, цены\n" * 200_000
    new = spark.createDataFrame([(1, 2, "короткий"), (2, 2, long), (3, 2, None), (4, 2, "")], "k int, at int, payload string")
    kept = sinks.cache_put(sinks.cache_put(None, new.withColumn("at", F.lit(1)).withColumn("payload", F.lit("old")), "k", "at", "payload"), new, "k", "at", "payload")
    damaged = [(5, gzip.compress(b"whole")[:-9]), (6, b"no gzip"), (7, gzip.compress(b"\xff no text"))]
    kept = kept.unionByName(spark.createDataFrame([(k, 2, None, b) for k, b in damaged], "k int, at int, inline string, blob binary"))
    got = sinks.cache_get(kept, "payload")
    assert {r["k"]: r["payload"] for r in got.collect()} == {1: "короткий", 2: long, 3: None, 4: "", 5: None, 6: None, 7: None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # an Arrow batch holds ten thousand payloads at once
