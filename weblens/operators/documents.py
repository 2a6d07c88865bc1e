"""Documents of other formats as markdown: word processor, slides, sheets, books, feeds, CSV, JSON and XML.

convert_documents turns a table of bytes into a table of markdown, in Arrow
batches. Defined results: NULL bodies and unknown kinds, damaged or unsafe
documents are rows with an error and no content; what is cut by a limit is
flagged; repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.functions.text import page_range
from weblens.operators.html import markdown, tree

# Fixed limits that results depend on.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO, MAX_PART = 10_000, 200 * 2**20, 200, 32 * 2**20
MAX_ROWS, MAX_COLUMNS, MAX_SHEETS, MAX_ITEMS, MAX_CHAPTERS, MAX_CHARS = 2000, 200, 50, 200, 300, 5_000_000


class BadDocument(ValueError):
    """A document that is damaged or unsafe to open."""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def open_zip(data: bytes) -> zipfile.ZipFile:
    """An archive within the limits of entries, size and compression."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise BadDocument("not an archive") from e
    infos = archive.infolist()
    total = sum(i.file_size for i in infos)
    if len(infos) > MAX_ENTRIES or total > MAX_BYTES or total > MAX_RATIO * max(1, sum(i.compress_size for i in infos)):
        raise BadDocument("archive beyond limits")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element:
    if archive.getinfo(name).file_size > MAX_PART:
        raise BadDocument("part beyond limits")
    text = archive.read(name)
    if b"<!DOCTYPE" in text or b"<!ENTITY" in text:
        raise BadDocument("document type declarations are refused")
    return ET.fromstring(text)


def table(rows: list[list[str]]) -> str:
    """A pipe table; bars escaped, line ends as spaces, short rows filled."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def from_csv(text: str) -> tuple[str, dict]:
    head = text[:4096]
    delimiter = max(",;\t|", key=lambda d: (min((line.count(d) for line in head.splitlines()[:5] if line), default=0), -",;\t|".index(d)))
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    kept = [r[:MAX_COLUMNS] for r in rows[:MAX_ROWS]]
    return table(kept), {"rows_total": len(rows), "rows_returned": len(kept), "cols_total": max(map(len, rows), default=0), "cols_returned": max(map(len, kept), default=0)}


def from_docx(data: bytes) -> tuple[str, dict]:
    body = _xml(open_zip(data), "word/document.xml")
    out: list[str] = []

    def paragraph(p: ET.Element) -> str:
        text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")
        style = next((v for s in p.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
        level = re.fullmatch(r"[Hh]eading\s?(\d)", style)
        listed = any(_local(s.tag) == "numPr" for s in p.iter())
        return "#" * int(level[1]) + " " + text if level and text else "- " + text if listed and text else text

    for child in next((b for b in body.iter() if _local(b.tag) == "body"), body):
        if _local(child.tag) == "p":
            out.append(paragraph(child))
        elif _local(child.tag) == "tbl":
            rows = [["".join(t.text or "" for t in c.iter() if _local(t.tag) == "t") for c in r if _local(c.tag) == "tc"] for r in child if _local(r.tag) == "tr"]
            out.append(table(rows))
    return "\n\n".join(x for x in out if x.strip()), {}


def relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id -> path of the part it points to."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in archive.namelist():
        return {}
    return {r.attrib["Id"]: posixpath.normpath(r.attrib["Target"].lstrip("/") if r.attrib["Target"].startswith("/") else posixpath.join(folder, r.attrib["Target"])) for r in _xml(archive, path) if r.attrib.get("Target") and r.attrib.get("TargetMode") != "External"}


def chart_table(root: ET.Element) -> str:
    """A chart's series beside each other by the number of the point; a value that a series lacks is blank."""
    heads, points, labels = [], [], {}
    for series in (e for e in root.iter() if _local(e.tag) == "ser"):
        parts = {_local(c.tag): c for c in series}
        heads.append("".join(v.text or "" for v in parts["tx"].iter() if _local(v.tag) == "v") if "tx" in parts else "")
        read = lambda e: {int(pt.attrib.get("idx", 0)): "".join(v.text or "" for v in pt if _local(v.tag) == "v") for pt in e.iter() if _local(pt.tag) == "pt"} if e is not None else {}
        labels = {**read(parts.get("cat")), **labels}
        points.append(read(parts.get("val")))
    rows = sorted({*labels, *(i for p in points for i in p)})
    return table([["", *heads], *[[labels.get(i, ""), *[p.get(i, "") for p in points]] for i in rows]]) if heads else ""


def from_pptx(data: bytes) -> tuple[str, dict]:
    """Slides in the order of their numbers: text, picture descriptions and charts; a chart on several slides is printed once and then named."""
    archive = open_zip(data)
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out, printed, total, kept = [], {}, 0, 0
    for name in names:
        number, links = int(re.search(r"(\d+)\.xml", name)[1]), relations(archive, name)
        lines = [f"## Slide {number}"]
        for e in _xml(archive, name).iter():
            kind = _local(e.tag)
            if kind == "p":
                lines.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t").strip())
            elif kind == "cNvPr" and e.attrib.get("descr", "").strip():
                lines.append(f"![{' '.join(e.attrib['descr'].split())}](image)")
            elif kind == "chart":
                total += 1
                path = next((links.get(v) for k, v in e.attrib.items() if _local(k) == "id"), None)
                if path in printed:
                    lines.append(f"(same chart as slide {printed[path]})")
                elif path in archive.NameToInfo:
                    printed[path] = number
                    lines.append(chart_table(_xml(archive, path)))
                kept += path in printed
        out.append("\n\n".join(x for x in lines if x))
    return "\n\n".join(out), {"charts_total": total, "charts_returned": kept}


def _page(markup: str) -> str:
    root = tree(markup)
    return markdown(next((n for n in root.walk() if n.tag == "body"), root))


def from_epub(data: bytes) -> tuple[str, dict]:
    """Chapters of a book in reading order, as the package's spine has them; title and author in the counts."""
    archive = open_zip(data)
    package = next(e.attrib["full-path"] for e in _xml(archive, "META-INF/container.xml").iter() if _local(e.tag) == "rootfile")
    root, folder = _xml(archive, package), posixpath.dirname(package)
    named = {_local(e.tag): (e.text or "").strip() for e in root.iter() if _local(e.tag) in ("title", "creator")}
    files = {e.attrib["id"]: posixpath.normpath(posixpath.join(folder, e.attrib["href"])) for e in root.iter() if _local(e.tag) == "item"}
    chapters = [files[e.attrib["idref"]] for e in root.iter() if _local(e.tag) == "itemref" and e.attrib.get("idref") in files]
    texts = [_page(archive.read(c).decode("utf-8", "replace")) for c in chapters[:MAX_CHAPTERS] if c in archive.NameToInfo and archive.getinfo(c).file_size <= MAX_PART]
    return "\n\n".join(x for x in texts if x), {"title": named.get("title"), "author": named.get("creator"), "pages_total": len(chapters), "pages_returned": len(texts)}


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def from_xlsx(data: bytes) -> tuple[str, dict]:
    archive = open_zip(data)
    names = archive.namelist()
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _xml(archive, "xl/sharedStrings.xml") if _local(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    targets = relations(archive, "xl/workbook.xml")
    sheets = [s for s in _xml(archive, "xl/workbook.xml").iter() if _local(s.tag) == "sheet"]
    out, total, kept = [], 0, 0
    for i, sheet in enumerate(sheets[:MAX_SHEETS], 1):
        rid = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), "")
        path = targets.get(rid, f"xl/worksheets/sheet{i}.xml")
        if path not in names:
            continue
        grid: list[dict[int, str]] = []
        for row in (r for r in _xml(archive, path).iter() if _local(r.tag) == "row"):
            total += 1
            if len(grid) >= MAX_ROWS:
                continue
            cells: dict[int, str] = {}
            for n, c in enumerate(c for c in row if _local(c.tag) == "c"):
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                cells[column_number(c.attrib["r"]) if c.attrib.get("r") else n] = value
            grid.append(cells)
        kept += len(grid)
        used = sorted({k for cells in grid for k, v in cells.items() if v})[:MAX_COLUMNS]  # columns without values are left out
        out.append(f"## {sheet.attrib.get('name', i)}\n\n" + table([[cells.get(k, "") for k in used] for cells in grid]))
    return "\n\n".join(out), {"rows_total": total, "rows_returned": kept, "sheets_total": len(sheets), "sheets_returned": min(len(sheets), MAX_SHEETS)}


def from_feed(text: str) -> list[dict]:
    """title, url, published and summary of feed items of any dialect, by local names; only web links."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise BadDocument("document type declarations are refused")
    root = ET.fromstring(text.encode() if text.lstrip().startswith("<?xml") else text)
    out = []
    for item in root.iter():
        if _local(item.tag) not in ("item", "entry"):
            continue
        own: dict[str, str] = {}
        for c in item:
            name = _local(c.tag)
            value = c.attrib.get("href") if name == "link" and c.attrib.get("href") else "".join(c.itertext()).strip()
            if name == "link" and c.attrib.get("rel", "alternate") != "alternate":
                continue
            own.setdefault(name, value or "")
        url = own.get("link", "")
        summary = re.sub(r"<[^<>]*>", " ", own.get("description") or own.get("summary") or own.get("content") or "")
        out.append({"title": own.get("title", ""), "url": url if url.startswith(("http://", "https://")) else None, "published": own.get("pubDate") or own.get("published") or own.get("updated") or own.get("date"), "summary": " ".join(summary.split())})
    return out


def from_json(text: str) -> str:
    """Pretty JSON in a fence, or the text as it is beyond 1 MiB or 16 levels."""
    def depth(x, n=1):
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        return n if n > 16 else max((depth(v, n + 1) for v in inner), default=n)

    try:
        value = json.loads(text) if len(text) <= 1 << 20 else None
    except (ValueError, RecursionError):
        value = None
    pretty = json.dumps(value, indent=2, ensure_ascii=False) if value is not None and depth(value) <= 16 else text
    return f"```json\n{pretty}\n```"


def truncated(meta: dict) -> bool:
    """Whether any total differs from what was returned."""
    return any(meta[k] != meta.get(k.replace("_total", "_returned")) for k in meta if k.endswith("_total"))


def convert(kind: str, data: bytes) -> tuple[str, dict]:
    """(markdown, counts) by kind."""
    if kind == "csv":
        return from_csv(data.decode("utf-8", "replace"))
    if kind == "json":
        return from_json(data.decode("utf-8", "replace")), {}
    if kind == "feed":
        items = from_feed(data.decode("utf-8", "replace"))
        lines = [f"## [{i['title']}]({i['url']})\n\n{i['summary']}" if i["url"] else f"## {i['title']}\n\n{i['summary']}" for i in items[:MAX_ITEMS]]
        return "\n\n".join(lines), {"items_total": len(items), "items_returned": min(len(items), MAX_ITEMS)}
    if kind == "xml":
        return f"```xml\n{data.decode('utf-8', 'replace')}\n```", {}
    if kind not in ("docx", "pptx", "xlsx", "epub"):
        raise BadDocument("unknown kind")
    return {"docx": from_docx, "pptx": from_pptx, "xlsx": from_xlsx, "epub": from_epub}[kind](data)


def convert_documents(documents: DataFrame, key: str, kind: str, body: str) -> DataFrame:
    """(key, doc_type, content, truncated, error) of a table of bytes by their kind."""
    schema = T.StructType([documents.schema[key], *[T.StructField(n, T.StringType()) for n in ("doc_type", "content")], T.StructField("truncated", T.BooleanType()), T.StructField("error", T.StringType())])

    def one(own_kind: str | None, data: bytes | None) -> tuple:
        if data is None:
            return own_kind, None, False, "no document"
        try:
            text, meta = convert(own_kind, bytes(data))
        except BadDocument as e:
            return own_kind, None, False, str(e)
        except (ET.ParseError, KeyError, StopIteration, ValueError, zipfile.BadZipFile, csv.Error):
            return own_kind, None, False, "damaged document"
        return own_kind, text[:MAX_CHARS], truncated(meta) or len(text) > MAX_CHARS, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *one(own_kind, data)) for k, own_kind, data in zip(b[key], b[kind], b[body])], columns=[f.name for f in schema])

    return documents.select(key, kind, F.col(body)).mapInPandas(run, schema)


def paged_documents(pages: DataFrame, key: str, page: str, text: str, spec: str, cap: int = 300, fast: int = 20) -> DataFrame:
    """(key, pages_total, pages_returned, capped, empty, content, error) of documents whose pages are rows, numbered from 1.

    spec (one a document, NULL for all pages) asks for `a` or `a-b`; what lies outside
    the document is cut off, what is no such text or wholly outside is an error. At
    most cap pages are returned; from `fast` pages on each has its number as a
    heading. empty counts returned pages without text.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.trim(F.coalesce(text, F.lit(""))).alias("t"))))
    d = pages.groupBy(key).agg(F.count("*").cast("int").alias("pages_total"), F.max(spec).alias("_spec"), rows.alias("_rows"))
    d = d.withColumn("_wanted", F.when(F.col("_spec").isNull(), F.sequence(F.lit(0), F.col("pages_total") - 1)).otherwise(page_range(F.col("_spec"), F.col("pages_total"))))
    d = d.withColumn("_read", F.transform(F.slice("_wanted", 1, cap), lambda i: F.get("_rows", i)))
    numbered = F.transform("_read", lambda r: F.concat(F.lit("## Page "), r["p"].cast("string"), F.lit("\n\n"), r["t"]))
    content = F.when(F.size("_read") >= fast, F.array_join(numbered, "\n\n")).otherwise(F.array_join(F.transform("_read", lambda r: r["t"]), "\n\n"))
    bad = F.col("_wanted").isNull()
    returned = F.when(bad, 0).otherwise(F.size("_read"))
    empty = F.when(~bad, F.size(F.filter("_read", lambda r: r["t"] == "")))
    return d.select(key, "pages_total", returned.alias("pages_returned"), (~bad & (F.size("_wanted") > cap)).alias("capped"), empty.alias("empty"), content.alias("content"), F.when(bad, "bad_pages").alias("error"))
