"""Documents of every format over whole tables: each row is packed as a document and read back; the SQL works from the row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.operators.documents import convert_documents, paged_documents
from weblens.session import table

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_C = "http://schemas.openxmlformats.org/drawingml/2006/chart"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"


def pack(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(number: int, name: str, part: int) -> bytes:
    p = lambda text, style="": f'<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cells = "".join(f"<w:tc>{p(x)}</w:tc>" for x in ("a|b", name))
    return pack({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{p(name, "<w:pPr><w:pStyle w:val=%sHeading2%s/></w:pPr>" % (chr(34), chr(34)))}{p("item", "<w:pPr><w:numPr/></w:pPr>")}{p(str(number))}<w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>'})


def _pptx(number: int, name: str, part: int) -> bytes:
    slide = lambda n, text: f'<p:sld xmlns:p="x" xmlns:a="{_A}" xmlns:r="{_R}" xmlns:c="{_C}"><a:p><a:r><a:t>{text}</a:t></a:r></a:p><p:pic><p:cNvPr descr="picture {n}"/></p:pic><c:chart r:id="r1"/></p:sld>'
    rels = f'<Relationships xmlns="{_P}"><Relationship Id="r1" Target="../charts/chart1.xml"/></Relationships>'
    pt = lambda i, v: f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>'
    chart = f'<c:chartSpace xmlns:c="{_C}"><c:ser><c:tx><c:v>one</c:v></c:tx><c:cat>{pt(0, "x")}{pt(1, "y")}</c:cat><c:val>{pt(0, number)}</c:val></c:ser><c:ser><c:tx><c:v>two</c:v></c:tx><c:val>{pt(1, part)}</c:val></c:ser></c:chartSpace>'
    return pack({"ppt/slides/slide10.xml": slide(10, "last"), "ppt/slides/slide2.xml": slide(2, name), "ppt/slides/_rels/slide10.xml.rels": rels, "ppt/slides/_rels/slide2.xml.rels": rels, "ppt/charts/chart1.xml": chart})


def _xlsx(number: int, name: str, part: int) -> bytes:
    rows = f'<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>{number}</v></c><c r="D2" t="inlineStr"><is><t>{part}</t></is></c></row>'
    return pack({
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="Own" r:id="r7"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_P}"><Relationship Id="r7" Target="worksheets/other.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_S}"><si><t>key</t></si><si><r><t>{name}</t></r><r><t>!</t></r></si></sst>', "xl/worksheets/other.xml": f'<worksheet xmlns="{_S}"><sheetData>{rows}</sheetData></worksheet>',
    })


def _epub(number: int, name: str, part: int) -> bytes:
    page = lambda title, text: f"<html><head><title>t</title></head><body><h1>{title}</h1><p>{text}</p></body></html>"
    package = '<package><metadata><title>Book</title></metadata><manifest><item id="b" href="text/two.xhtml"/><item id="a" href="text/one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    return pack({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>', "OEBPS/p.opf": package, "OEBPS/text/one.xhtml": page("One", name), "OEBPS/text/two.xhtml": page("Two", str(number))})


def _text(kind: str, number: int, name: str, part: int) -> bytes:
    if kind == "csv":
        return ("a;b\n" + f"{name};{number}\n" * (part % 50 * 50)).encode()
    if kind == "json":
        return f'{{"n": {number}, "s": ["{name}"]}}'.encode()
    if kind == "xml":
        return f"<cfg><v>{name}</v></cfg>".encode()
    item = f"<item><title>{name}</title><link>https://a.example/{number}</link><description>&lt;b&gt;about&lt;/b&gt; it</description></item>"
    return f"<rss><channel>{item * (1 + part % 3 * 150)}</channel></rss>".encode()


def _packed(spark, d, kind: str) -> DataFrame:
    """Suppliers as documents of one kind; every seventh archive is cut off and every eleventh body missing."""
    make = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "epub": _epub}.get(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for number, name, part in zip(b["s_suppkey"].tolist(), b["s_name"].tolist(), b["s_nationkey"].tolist()):
                body = make(number, name, part) if make else _text(kind, number, name, part)
                rows.append((number, kind, None if number % 11 == 0 else body[:40] if make and number % 7 == 0 else body))
            yield pd.DataFrame(rows, columns=["s_suppkey", "kind", "body"])

    return table(spark, d, "supplier").mapInPandas(run, "s_suppkey bigint, kind string, body binary")


def _converted(kind: str):
    def query(spark, d):
        return convert_documents(_packed(spark, d, kind), "s_suppkey", "kind", "body")

    query.__name__ = f"doc_{kind}"
    return query


def doc_truncation_flag(spark, d):
    """Tables and feeds that a limit cuts, by kind."""
    both = _packed(spark, d, "csv").unionByName(_packed(spark, d, "feed"))
    return convert_documents(both, "s_suppkey", "kind", "body").where("error is null").select("s_suppkey", "doc_type", "truncated")


def pdf_page_caps(spark, d):
    """The lines of a source as a document's pages, of which a range or all are asked for; six at most, numbered from four on."""
    s = table(spark, d, "research_sources").where("content is not null").groupBy("src_id").agg(F.min("content").alias("content"))
    spec = F.when(F.col("src_id") % 5 == 1, "2-5").when(F.col("src_id") % 5 == 2, " 9 - 3 ").when(F.col("src_id") % 5 == 3, "first").when(F.col("src_id") % 5 == 4, "900")
    pages = s.select("src_id", spec.alias("spec"), F.posexplode(F.split("content", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return paged_documents(pages, "src_id", "page", "text", "spec", cap=6, fast=4)


QUERIES = {f"doc_{k}": _converted(k) for k in ("docx", "pptx", "xlsx", "epub", "csv", "json", "xml", "feed")} | {"doc_truncation_flag": doc_truncation_flag, "pdf_page_caps": pdf_page_caps}

_N = "s_suppkey"


def _sql(kind: str, content: str, truncated: str = "false", archive: bool = False) -> str:
    bad = "WHEN s_suppkey % 7 = 0 THEN 'not an archive' " if archive else ""
    fine = f"{_N} % 11 <> 0" + (f" AND {_N} % 7 <> 0" if archive else "")
    return f"SELECT {_N}, '{kind}' AS doc_type, CASE WHEN {fine} THEN {content} END AS content, {fine} AND {truncated} AS truncated, CASE WHEN {_N} % 11 = 0 THEN 'no document' {bad}END AS error FROM supplier"


_NL = "chr(10)"
_PARA = "chr(10) || chr(10)"
_CHART = "'|  | one | two |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| x | ' || s_suppkey || ' |  |' || chr(10) || '| y |  | ' || s_nationkey || ' |'"
_ITEM = "'## [' || s_name || '](https://a.example/' || s_suppkey || ')' || chr(10) || chr(10) || 'about it'"
_PAGES = """WITH s AS (SELECT src_id, string_split(min(content), chr(10)) AS t FROM research_sources WHERE content IS NOT NULL GROUP BY src_id),
r AS (SELECT src_id, list_transform(t, lambda x: trim(x)) AS t, len(t) AS n, CASE src_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 900 END AS a, CASE src_id % 5 WHEN 0 THEN len(t) WHEN 1 THEN least(5, len(t)) WHEN 2 THEN least(9, len(t)) WHEN 4 THEN least(900, len(t)) END AS b FROM s),
w AS (SELECT *, a IS NULL OR a > b AS bad, list_slice(t, a, least(b, a + 5)) AS x FROM r)
SELECT src_id, n AS pages_total, CASE WHEN bad THEN 0 ELSE len(x) END AS pages_returned, NOT bad AND b - a + 1 > 6 AS capped, CASE WHEN NOT bad THEN len(list_filter(x, lambda y: y = '')) END AS empty,
  CASE WHEN bad THEN NULL WHEN len(x) >= 4 THEN array_to_string(list_transform(x, lambda y, i: '## Page ' || (a + i - 1) || chr(10) || chr(10) || y), chr(10) || chr(10)) ELSE array_to_string(x, chr(10) || chr(10)) END AS content, CASE WHEN bad THEN 'bad_pages' END AS error FROM w"""
ORACLES = {
    "pdf_page_caps": _PAGES,
    "doc_docx": _sql("docx", f"'## ' || s_name || {_PARA} || '- item' || {_PARA} || s_suppkey || {_PARA} || '| a\\|b | ' || s_name || ' |' || {_NL} || '| --- | --- |'", archive=True),
    "doc_pptx": _sql("pptx", f"'## Slide 2' || {_PARA} || s_name || {_PARA} || '![picture 2](image)' || {_PARA} || {_CHART} || {_PARA} || '## Slide 10' || {_PARA} || 'last' || {_PARA} || '![picture 10](image)' || {_PARA} || '(same chart as slide 2)'", archive=True),
    "doc_xlsx": _sql("xlsx", f"'## Own' || {_PARA} || '| key | ' || s_name || '! |  |' || {_NL} || '| --- | --- | --- |' || {_NL} || '| ' || s_suppkey || ' |  | ' || s_nationkey || ' |'", archive=True),
    "doc_epub": _sql("epub", f"'# One' || {_PARA} || s_name || {_PARA} || '# Two' || {_PARA} || s_suppkey", archive=True),
    "doc_csv": _sql("csv", f"'| a | b |' || {_NL} || '| --- | --- |' || repeat({_NL} || '| ' || s_name || ' | ' || s_suppkey || ' |', least(1999, s_nationkey % 50 * 50))", "s_nationkey % 50 * 50 + 1 > 2000"),
    "doc_json": _sql("json", f"'```json' || {_NL} || '{{' || {_NL} || '  \"n\": ' || s_suppkey || ',' || {_NL} || '  \"s\": [' || {_NL} || '    \"' || s_name || '\"' || {_NL} || '  ]' || {_NL} || '}}' || {_NL} || '```'"),
    "doc_xml": _sql("xml", f"'```xml' || {_NL} || '<cfg><v>' || s_name || '</v></cfg>' || {_NL} || '```'"),
    "doc_feed": _sql("feed", f"{_ITEM} || repeat({_PARA} || {_ITEM}, least(199, s_nationkey % 3 * 150))", "s_nationkey % 3 * 150 + 1 > 200"),
    "doc_truncation_flag": f"SELECT {_N}, 'csv' AS doc_type, s_nationkey % 50 * 50 + 1 > 2000 AS truncated FROM supplier WHERE {_N} % 11 <> 0 UNION ALL SELECT {_N}, 'feed', s_nationkey % 3 * 150 + 1 > 200 FROM supplier WHERE {_N} % 11 <> 0",
}
