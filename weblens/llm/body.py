"""Main body of web pages: consensus host paths.

Each page is read once. A tolerant tokenizer (unclosed, upper-case and truncated
markup) gives its text runs with the open containers; the lines of the text dump
are laid on these runs by their characters, so every line knows its region (the
outermost container below wrappers that hold nearly all text), the tag and the
class path of the region with generated class names generalised, and its role.
What is written is this structure, without text.

Every page then scores its regions: sentence characters and a headline for,
link characters against. The regions' paths get votes within their site, summed
in Spark, and the lines are extracted again from the structure: a page's body is
the region that is best by its score and the share of its site's votes for its
path. Within the body, link-only and bare fragments, asides, widget headings and
prompts are left out; headline, author and date lines, sentences, subheadings,
lists, tables, code and quotations stay.

Lines that lie on no markup (none, or cut off) are judged by what other pages
made of the same normalised line and by their place among the sentences.

Plan: one scan, a narrow structure in the shared folder, votes combined before
the shuffle (a hot site has few paths), all windows within one page. Votes join
by broadcast when counted small, else salted.

Defined results: blank lines are numbered but never given; NULL and empty content
has no lines; pages without a site vote for themselves alone; repeated rows count
once; an empty table gives an empty one; other columns are ignored; pages of any
length are read whole.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.llm.common import join_few, site
from weblens.session import write_shared

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(script|style|head|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)(?:>|\Z)|([^<]+|<)", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CONTAINERS = frozenset("div section article aside header footer nav main table tbody thead tr td th ul ol dl form figure".split())
_LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 span button blockquote pre dt dd figcaption label caption".split())
_SPACE = re.compile(r"[\s|]+")  # a dump may set cells of a row apart with bars
_GENERATED = re.compile(r"^([a-z]{1,4}[-_])[a-z0-9]{4,}$|^[a-z]*\d[a-z0-9]*$", re.I)
_COMMENT = re.compile(r"^\s*[^\W\d_]{3,20}\d{1,4}: ")
_DATED = re.compile(r"\b\d{1,2}\.? [^\W\d_]{3,12}\.? (?:de )?\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\b[A-Z][a-z]{2,8} \d{1,2}, \d{4}\b")
_BYLINE = re.compile(r"^\s*(?:by|von|oleh|par|por|de|text|teks|autor|author|автор|tekst|written by|door)\b:?\s+[A-ZА-ЯŁŚŻŹ]", re.I)
_ENDS = re.compile(r"[.!?…。][\"”“»')\]]*\s*$")
#: Share of a page's text from which a container without text of its own is a wrapper.
WRAPPER = 0.85
#: Characters from which a line may be looked for in the whole rest of a page, if it occurs there once.
UNIQUE = 40
_CAPITALISED = re.compile(r"(?<![\w])[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐÉĘĚĞÍŁŃŇŐŘŚŞŠŤŮŰŹŻŽА-ЯЁ][\w-]*")
#: A form of which only masks are left says nothing.
_MASKS = re.compile(r"(?:\bx\b|0|\W)*")
#: Longest line that may be an author or date line, in characters.
BYLINE_CHARS = 100

def _general(name: str) -> str:
    return " ".join(sorted({(m[1] or "") + "*" if (m := _GENERATED.match(c)) else c.lower() for c in name.split()}))


def text_runs(markup: str) -> list[tuple[tuple[int, ...], list[str], str, bool, str]]:
    """(ids of the open containers, their names, leaf tag, within a link, text without white space) in page order."""
    stack: list[tuple[str, str, int]] = []
    out, ids, names, leaf, link, number = [], (), [], "", False, 0
    for m in _TOKEN.finditer(markup):
        text, tag = m[5], m[3]
        if text is not None:
            bare = _SPACE.sub("", html_lib.unescape(text) if "&" in text else text)
            if bare:
                out.append((ids, names, leaf, link, bare))
        elif tag:
            tag = tag.lower()
            if tag == "a":
                link = not m[2]
            elif tag in _CONTAINERS:
                if m[2]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                else:
                    if tag in ("td", "th", "tr"):  # an open cell or row of the same table ends
                        closes = ("td", "th") if tag != "tr" else ("tr",)
                        for i in range(len(stack) - 1, -1, -1):
                            if stack[i][0] == "table":
                                break
                            if stack[i][0] in closes:
                                del stack[i:]
                                break
                    number += 1
                    c = _CLASS.search(m[4])
                    stack.append((tag, f"{tag}.{_general(c[1] or c[2] or c[3] or '')}" if c else tag, number))
                ids, names, leaf, link = tuple(x[2] for x in stack), [x[1] for x in stack], "", False
            elif tag in _LEAVES:
                leaf, link = ("" if m[2] else tag), False
            elif tag == "br":
                leaf = "" if leaf in ("h1", "h2", "h3", "h4", "h5", "h6", "button") else leaf
    return out


def _depth(runs: list) -> int:
    """Number of wrapper containers above the regions."""
    total, depth = sum(len(r[4]) for r in runs), 0
    while True:
        inner: dict[int, int] = {}
        own = 0
        for ids, _, _, _, text in runs:
            if len(ids) > depth:
                inner[ids[depth]] = inner.get(ids[depth], 0) + len(text)
            else:
                own += len(text)
        if not inner:
            return depth
        top = max(inner, key=inner.get)
        if inner[top] < WRAPPER * total or own:
            return depth
        direct = sum(len(r[4]) for r in runs if len(r[0]) == depth + 1 and r[0][depth] == top)
        if direct:
            return depth
        depth += 1


def _region(ids: tuple, names: list[str], depth: int) -> int:
    """Index after the region's own container: below wrappers, through tables that lay out the page."""
    end = min(len(ids), depth + 1)
    if end and names[end - 1].split(".")[0] in ("table", "tbody", "thead", "tr"):
        while end < len(ids) and names[end - 1].split(".")[0] not in ("td", "th"):
            end += 1
    return end


def _role(line: str, leaf: str, inner: list[str], linked: bool) -> str:
    """h headline, s subheading, w widget heading, p sentences, b author or date line, q code or quotation, l list, t table, c comment, k link only, n link item outside a list, a aside, f fragment."""
    tags = {x.split(".")[0] for x in inner}
    if leaf == "h1":
        return "h"
    if tags & {"aside", "nav", "footer", "form"}:
        return "a"
    if leaf in ("pre", "blockquote"):
        return "q"
    if leaf in ("button", "label"):
        return "f"
    if "table" in tags:
        return "t"
    if leaf in ("h3", "h4", "h5", "h6"):
        return "w"
    if leaf == "h2":
        return "s"
    if _COMMENT.match(line):
        return "c"
    if tags & {"ul", "ol", "dl"}:
        return "l"
    if linked:
        return "n" if leaf == "li" else "k"
    if _ENDS.search(line) and len(line) >= 25:
        return "p"
    if len(line) <= BYLINE_CHARS and (_DATED.search(line) or _BYLINE.match(line)):
        return "b"
    return "p" if len(line) >= 160 else "f"


def structure(markup: str | None, content: str) -> list[tuple[int, int, str, str, int]]:
    """(line_no, region, path, role, chars) of the non-blank lines of content."""
    runs = text_runs(markup) if markup else []
    depth = _depth(runs)
    stream = "".join(r[4] for r in runs)
    starts, at = [], 0
    for r in runs:
        starts.append(at)
        at += len(r[4])
    out, pos, lost = [], 0, []

    def laid(number: int, line: str, here: int, size: int) -> tuple[int, int, str, str, int]:
        first, last = bisect_right(starts, here) - 1, bisect_right(starts, here + size - 1) - 1
        ids, names, leaf, _, _ = runs[first]
        end = _region(ids, names, depth)
        linked = all(runs[i][3] for i in range(first, last + 1))
        if leaf == "li" and not linked and not any(x.split(".")[0] in ("ul", "ol") for x in names[end:]):
            leaf = ""
        return number, ids[end - 1] if end else 0, "/".join(names[:end]), _role(line, leaf, names[end:], linked), size

    for number, line in enumerate(content.split("\n"), 1):
        bare = _SPACE.sub("", line)
        if not bare and not line.strip():
            continue
        window = pos + 4000 + len(bare)
        here = -1 if not bare else pos if stream.startswith(bare, pos) else stream.find(bare, pos, window) if pos < len(stream) else -1
        if here < 0 and len(bare) >= UNIQUE and window < len(stream):
            here = stream.find(bare, pos)
            if here >= 0 and stream.find(bare, here + 1) < 0:  # the lines before it lie before it
                end = here
                for at, text, own in reversed(lost):
                    found = stream.rfind(own, max(pos, end - 4000 - len(own)), end) if own else -1
                    if found >= 0:
                        out[at], end = laid(out[at][0], text, found, len(own)), found
            else:
                here = -1
        if here < 0:
            lost.append((len(out), line, bare))
            out.append((number, -1, "", _role(line, "", [], False), len(bare)))
            continue
        pos, lost = here + len(bare), []
        out.append(laid(number, line, here, len(bare)))
    for i in range(2, len(out)):  # a sentence between the heading and the link items of a widget is its teaser
        if out[i][3] == "n" and out[i - 1][3] == "p" and out[i - 2][3] in ("w", "f") and out[i][1] == out[i - 1][1] == out[i - 2][1]:
            out[i - 1] = (*out[i - 1][:3], "e", out[i - 1][4])
    return out


def _normal(line: str) -> str:
    return re.sub("[0-9]+", "0", " ".join(line.lower().split()))


def _hashes(texts: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.asarray(texts, dtype=object), categorize=False).view(np.int64) if texts else np.zeros(0, np.int64)


def page_lines(df: DataFrame, key: str, url: str, markup: str, content: str) -> DataFrame:
    """(key, site, line_no, region, path, role, chars, h, form): the structure of all pages, region -1 without markup; h and form are hashes of the normalised line, form with capitalised words masked; 0 for forms of masks alone."""
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("site", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("line_no", "region")), *(T.StructField(n, T.StringType()) for n in ("path", "role")), T.StructField("chars", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("h", "form"))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, rows, norms, forms = [], [], [], []
            for markup_, content_ in zip(batch["_markup"], batch["_content"]):
                own = structure(markup_, content_)
                counts.append(len(own))
                rows += own
                text = content_.split("\n")
                for row in own:
                    line = text[row[0] - 1]
                    norms.append(_normal(line))
                    form = _normal(_CAPITALISED.sub("X", line))
                    forms.append("" if _MASKS.fullmatch(form) else form)
            out = pd.DataFrame(rows, columns=["line_no", "region", "path", "role", "chars"])
            for name in ("_key", "site"):
                out[name] = batch[name].repeat(counts).to_numpy()
            out["h"], out["form"] = _hashes(norms), _hashes(forms)
            for name, texts in (("h", norms), ("form", forms)):
                out.loc[[not t for t in texts], name] = 0
            yield out[[f.name for f in schema]]

    own = df.where(F.col(content).isNotNull()).select(F.col(key).alias("_key"), site(F.col(url)).alias("site"), F.col(markup).alias("_markup"), F.col(content).alias("_content"))
    return own.mapInPandas(read, schema).withColumnRenamed("_key", key)


def _score() -> Column:
    """For sentences, subheadings, quotations and a headline; against links, fragments and comments."""
    return F.when(F.col("role") == "h", 400).when(F.col("role").isin("p", "q"), F.col("chars")).when(F.col("role").isin("s", "b"), 20).when(F.col("role").isin("k", "n", "w", "c", "a", "f", "e"), -F.col("chars")).otherwise(0)


def judge_unmarked(lines: list[dict]) -> list[int]:
    """Numbers of the body's lines on a page of which lines lie on no markup, by their place and by what other pages made of the same line.

    lines: line_no, region, role, main (NULL without markup), furniture and head
    (furniture that other pages have as a heading of widgets).
    """
    page = list({x["line_no"]: x for x in lines}.values())
    page.sort(key=lambda x: x["line_no"])
    n = len(page)
    roles, furniture, label = [x["role"] for x in page], [x["furniture"] for x in page], [x["main"] for x in page]
    talk = next((i for i in range(n) if roles[i] == "c"), n)  # reader comments end the body
    teasers = {i for i in range(1, n - 1) if roles[i] == "p" and page[i - 1]["head"] and roles[i + 1] == "f"}
    body = [i for i in range(talk) if roles[i] == "p" and not furniture[i] and label[i] is not False and i not in teasers]
    if body:
        first, last, widget = body[0], body[-1], False
        for i in range(n):
            if label[i] is not None:
                continue
            if i < first or i > last or roles[i] == "c":
                label[i] = False
            elif furniture[i]:
                label[i], widget = False, True
            elif i in teasers:
                label[i] = False
            elif roles[i] == "p":
                label[i], widget = True, False
            else:
                label[i] = roles[i] == "b" or not widget
        i = first - 1  # headline and author line stand before the first sentence
        while i >= 0 and label[i] is False and page[i]["region"] < 0:
            if roles[i] == "b":
                label[i] = True
            elif not furniture[i] and roles[i] != "c":
                label[i] = True
                break
            i -= 1
        i = last + 1  # a list or table may end the body
        while i < n and page[i]["region"] < 0 and not furniture[i] and roles[i] in ("f", "b"):
            label[i] = True
            i += 1
    return [x["line_no"] for x, main in zip(page, label) if main]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _judged(pages: pd.Series) -> pd.Series:
    return pd.Series([judge_unmarked([dict(x) for x in page]) for page in pages], dtype=object)


def labelled_lines(df: DataFrame, key: str, url: str, markup: str, content: str) -> DataFrame:
    """(key, line_no, main): every non-blank line with whether it is of the main body."""
    rows = write_shared(page_lines(df, key, url, markup, content))
    marked = rows.where("region >= 0")
    regions = marked.groupBy(key, "site", "region", "path").agg(F.sum(_score()).alias("score"), F.count_if(F.col("role") == "h").alias("heads"))
    regions = regions.withColumn("score", F.greatest("score", F.lit(0)))
    page = Window.partitionBy(key)
    top = regions.withColumn("_top", F.max(F.struct("score", -F.col("region"))).over(page)).withColumn("_share", F.when((F.col("_top.score") == F.col("score")) & (F.col("score") > 0), 1).otherwise(0))
    top = write_shared(top.withColumn("_vote", F.xxhash64("site", "path")).drop("_top"))
    votes = top.where("site is not null").groupBy("_vote").agg(F.sum("_share").alias("votes"))
    voted = join_few(top, votes, ["_vote"], "left", key)
    weight = F.col("score") * (F.coalesce(F.col("votes"), F.lit(0)) + 1)
    best = voted.groupBy(key).agg(F.max(F.struct(weight.alias("w"), "score", -F.col("region"), "region", "path")).alias("b")).where("b.w > 0").select(key, F.col("b.region").alias("_body"))
    body_role = F.col("role").isin("h", "s", "p", "b", "q", "l", "t")
    lines = rows.join(best, key, "left").withColumn("main", F.when(F.col("region") >= 0, F.coalesce(F.col("region") == F.col("_body"), F.lit(False)) & body_role))
    lines = lines.withColumn("_open", F.max((F.col("region") < 0).cast("int")).over(page))
    whole, cut_off = lines.where("_open = 0"), lines.where("_open = 1")
    judged = marked.where("h != 0").join(best, key, "left").select("h", "form", (F.coalesce(F.col("region") == F.col("_body"), F.lit(False)) & body_role).cast("double").alias("_in"), (F.col("role") == "w").cast("double").alias("_w"))
    by_line = judged.groupBy("h").agg(F.avg("_in").alias("_h"), F.count("*").alias("_n"), F.avg("_w").alias("_wh")).where("_h < 0.02 and _n >= 5").select("h", "_h", "_wh")
    by_form = judged.where("form != 0").groupBy("form").agg(F.avg("_in").alias("_f"), F.count("*").alias("_n"), F.avg("_w").alias("_wf")).where("_f < 0.1 and _n >= 5").select("form", "_f", "_wf")
    cut_off = join_few(join_few(cut_off, by_line, ["h"], "left", key), by_form, ["form"], "left", key)
    cut_off = cut_off.select(key, "line_no", "region", "role", (F.col("_h").isNotNull() | F.col("_f").isNotNull()).alias("furniture"), (F.greatest(F.coalesce("_wh", F.lit(0.0)), F.coalesce("_wf", F.lit(0.0))) > 0.2).alias("head"), "main")
    placed = cut_off.groupBy(key).agg(F.collect_list(F.struct("line_no", "region", "role", "furniture", "head", "main")).alias("_page"))  # the lines of one page
    placed = placed.select(key, F.col("_page.line_no").alias("_all"), _judged("_page").alias("_body")).select(key, F.explode(F.array_distinct("_all")).alias("line_no"), "_body")
    placed = placed.select(key, "line_no", F.array_contains("_body", F.col("line_no")).alias("main"))
    return whole.select(key, "line_no", "main").unionByName(placed).distinct()


def outside_body(df: DataFrame, key: str, url: str, markup: str, content: str) -> DataFrame:
    """(key, line_no): the non-blank lines that are not of the main body."""
    return labelled_lines(df, key, url, markup, content).where(~F.col("main")).select(key, "line_no")


def main_body(df: DataFrame, key: str, url: str, markup: str, content: str) -> DataFrame:
    """(key, body): the main body's lines of each page with content."""
    out = outside_body(df, key, url, markup, content).groupBy(F.col(key).alias("_key")).agg(F.collect_set("line_no").alias("_drop"))
    joined = df.where(F.col(content).isNotNull()).select(key, content).join(out, F.col(key) == F.col("_key"), "left")
    kept = F.filter(F.split(content, "\n"), lambda x, i: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), i + 1) & (F.trim(x) != ""))
    return joined.select(key, F.array_join(kept, "\n").alias("body")).distinct()
