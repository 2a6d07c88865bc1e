"""Reading markup with the standard library: links, selectors, articles, markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset("script style noscript template svg".split())
FURNITURE = frozenset("nav aside footer header form button".split())
BLOCKS = frozenset("p div section article main li ul ol table tr td th h1 h2 h3 h4 h5 h6 pre blockquote br figure figcaption header footer aside nav form button title".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in SKIP:
                todo += reversed(node.children)
        return " ".join("".join(out).split())


class _Builder(HTMLParser):
    """A tree from any markup; unknown ends are ignored, p and li end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "td", "th", "tr", "option") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def links(markup: str, base: str, same_domain: bool = False, cap: int = 500) -> dict:
    """Distinct absolute web links in page order with their text, images (src, data-src or srcset), and whether either list was cut."""
    root, found, images = tree(markup), {}, {}
    own = (urlsplit(base).hostname or "").lower()
    for node in root.walk():
        if node.tag == "a" and node.attrs.get("href"):
            try:
                url = urldefrag(urljoin(base, node.attrs["href"].strip()))[0]
                host = (urlsplit(url).hostname or "").lower()
            except ValueError:
                continue
            near = host == own or host.endswith("." + own) or own.endswith("." + host)
            if url.startswith(("http://", "https://")) and (near or not same_domain):
                found.setdefault(url, node.text())
        elif node.tag == "img":
            src = node.attrs.get("src") or node.attrs.get("data-src") or node.attrs.get("srcset", "").split(",")[0].strip().split(" ")[0]
            if src and not src.startswith("data:"):
                images.setdefault(urljoin(base, src), node.attrs.get("alt", ""))
    cut = lambda d: [{"url": u, "text": t} for u, t in list(d.items())[:cap]]
    return {"links": cut(found), "images": cut(images), "truncated": len(found) > cap or len(images) > cap}


_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([~^$*|]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def _matches(node: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m or (m[1] and m[1] != "*" and node.tag != m[1].lower()):
        return False
    for kind, name, attr, op, value in _PART.findall(m[2]):
        if kind == "." and name not in node.attrs.get("class", "").split():
            return False
        if kind == "#" and node.attrs.get("id") != name:
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None:
                return False
            tests = {"=": have == value, "~=": value in have.split(), "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have, "|=": have == value or have.startswith(value + "-")}
            if op and not tests[op]:
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """A CSS subset: tag, class, id, attribute tests, descendant, child and alternatives."""
    out, seen = [], set()
    for alternative in selector.split(","):
        steps = re.sub(r"\s*>\s*", " > ", alternative.strip()).split()
        for node in root.walk():
            at, i, ok = node, len(steps) - 1, bool(steps) and _matches(node, steps[-1])
            while ok and i > 0:
                direct = steps[i - 1] == ">"
                i -= 2 if direct else 1
                at = at.parent
                while at is not None and not direct and not _matches(at, steps[i]):
                    at = at.parent
                ok = at is not None and _matches(at, steps[i])
            if ok and id(node) not in seen:
                seen.add(id(node))
                out.append(node)
    return out


def extract(markup: str, schema: dict) -> dict:
    """{data, valid}: fields by selector; many, attr and required as given."""
    root, data, valid = tree(markup), {}, True
    for field, spec in schema.items():
        spec = {"selector": spec} if isinstance(spec, str) else spec
        values = [n.attrs.get(spec["attr"]) if spec.get("attr") else n.text() for n in select(root, spec["selector"])]
        values = [v for v in values if v]
        data[field] = values if spec.get("many") else (values[0] if values else None)
        valid = valid and not (spec.get("required") and not data[field])
    return {"data": data, "valid": valid}


def _lengths(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """Characters of each node's text and of the links in it, by the node's id; children before parents, so each node is read once."""
    own: dict[int, int] = {}
    linked: dict[int, int] = {}
    for node in reversed(list(root.walk())):
        own[id(node)] = linked[id(node)] = 0
        if node.tag in SKIP:
            continue
        for c in node.children:
            own[id(node)] += len(" ".join(c.split())) if isinstance(c, str) else own[id(c)]
            linked[id(node)] += 0 if isinstance(c, str) else linked[id(c)]
        if node.tag == "a":
            linked[id(node)] = own[id(node)]
    return own, linked


def article(markup: str) -> dict:
    """{title, content, word_count, lang, published, author}: the container with most sentence text and few links, furniture left out, as markdown."""
    root = tree(markup)
    title = next((n.text() for n in root.walk() if n.tag == "h1"), None) or next((n.text() for n in root.walk() if n.tag == "title"), None)
    metas = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content") for n in root.walk() if n.tag == "meta"}
    lang = next((n.attrs.get("lang") for n in root.walk() if n.tag == "html"), None)
    structured: dict = {}
    for n in root.walk():
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            try:
                todo = [json.loads("".join(c for c in n.children if isinstance(c, str)))]
            except ValueError:
                continue
            while todo:
                x = todo.pop()
                if isinstance(x, list):
                    todo += x
                elif isinstance(x, dict):
                    todo += [x["@graph"]] if "@graph" in x else []
                    structured = structured or x
    own, linked = _lengths(root)
    best, top = None, 0.0
    for node in root.walk():
        if node.tag not in ("article", "main", "section", "div", "td", "body"):
            continue
        score = 0.0
        for child in node.children:
            if isinstance(child, str):
                score += len(child.strip())
            elif child.tag in ("p", "h1", "h2", "pre", "blockquote", "ul", "ol", "table", "div"):
                if child.tag != "div" or not any(isinstance(c, Node) and c.tag in BLOCKS for c in child.children):
                    score += max(0, own[id(child)] - 2 * linked[id(child)])
        score *= 1.3 if node.tag in ("article", "main") else 1.0
        if score > top:
            best, top = node, score
    content = markdown(best) if best is not None else ""
    return {
        "title": title, "content": content, "word_count": len(content.split()), "lang": lang,
        "published": metas.get("article:published_time") or metas.get("date") or structured.get("datePublished"), "author": metas.get("author") or (structured.get("author") if isinstance(structured.get("author"), str) else None),
    }


def markdown(node: Node) -> str:
    """Headings, lists, code, quotations and tables of a node as markdown; furniture and scripts left out."""
    out: list[str] = []

    def visit(n: Node, inside: str = "") -> None:
        buffer: list[str] = []

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(text)
            buffer.clear()

        for c in n.children:
            if isinstance(c, str):
                buffer.append(c)
            elif c.tag in SKIP or c.tag in FURNITURE:
                continue
            elif re.fullmatch("h[1-6]", c.tag):
                flush()
                out.append("#" * int(c.tag[1]) + " " + c.text())
            elif c.tag == "li":
                flush()
                out.append("- " + c.text())
            elif c.tag == "pre":
                flush()
                out.append("```\n" + "".join(x if isinstance(x, str) else x.text() for x in c.children).strip("\n") + "\n```")
            elif c.tag == "blockquote":
                flush()
                out.append("> " + c.text())
            elif c.tag == "table":
                flush()
                rows = [[x.text().replace("|", "\\|") for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
                rows = [r for r in rows if r]
                if rows:
                    out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *["| " + " | ".join(r) + " |" for r in rows[1:]]]))
            elif c.tag in BLOCKS:
                flush()
                if c.tag != "br":
                    visit(c)
            else:
                buffer.append(" " + c.text() + " ")
        flush()

    visit(node)
    return "\n\n".join(out)


def demark(md: str) -> str:
    """Markdown as plain text; code stays, lines over 2000 characters are left alone."""
    out, fence = [], False
    for line in md.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
            continue
        if not fence and len(line) <= 2000:
            if re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", line) and "-" in line:
                continue
            line = re.sub(r"^\s{0,3}#{1,6}\s+", "", line)
            line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
            line = re.sub(r"(\*\*|__|~~)(.+?)\1", r"\2", line)
            line = re.sub(r"`([^`]*)`", r"\1", line)
        out.append(line)
    return "\n".join(out)


# Fixed values that results depend on: classes that name the language of code, and names that say that it has none.
_LANGUAGE = re.compile(r"(?:^|\s)(?:language|lang|highlight(?:-source)?)-([\w+#.-]+)")
_WRAPPED = re.compile(r"(?:^|\s)highlight(?:-source)?-([\w+#.-]+)")
PLAIN_CODE = ["default", "none", "text", "plain", "plaintext"]


def code_languages(root: Node) -> dict[str, str]:
    """Text of each preformatted block -> its language, named by a class of its code, its own or one of two wrappers; '' for none."""
    out: dict[str, str] = {}
    for pre in root.walk():
        if pre.tag != "pre":
            continue
        near = [n for n in pre.children if isinstance(n, Node) and n.tag == "code"] + [pre]
        around = [n for n in (pre.parent, pre.parent.parent if pre.parent else None) if n is not None]
        names = [m[1] for nodes, pattern in ((near, _LANGUAGE), (around, _WRAPPED)) for n in nodes if (m := pattern.search(n.attrs.get("class", "")))]
        text = "".join(c for n in pre.walk() for c in n.children if isinstance(c, str))
        out.setdefault(text.strip(), names[0] if names and names[0].lower() not in PLAIN_CODE else "")
    return out


def fix_markdown(md: str, markup: str) -> str:
    """Markdown with what an extractor lost put back from the page: the language of a fence, the fence of code of one line, the line under the first row of a table."""
    languages = code_languages(tree(markup)) if "<pre" in markup.lower() else {}
    lines, out, at = md.split("\n"), [], 0
    while at < len(lines):
        line = lines[at]
        ticks = re.match("`{3,}", line)
        if ticks:
            end = next((i for i in range(at + 1, len(lines)) if lines[i] == ticks[0]), len(lines))
            known = languages.get("\n".join(lines[at + 1 : end]).strip(), "")
            out += [line + known if line == ticks[0] and end < len(lines) else line, *lines[at + 1 : end + 1]]
            at = end + 1
            continue
        bare = line.strip("`").strip() if len(line) <= 2000 else ""
        if bare and bare in languages and line in (bare, f"`{bare}`", f"``{bare}``", f"`` {bare} ``"):
            out += ["```" + languages[bare], bare, "```"]
        else:
            out.append(line)
            first = line.startswith("|") and not (at and lines[at - 1].startswith("|"))
            if first and not re.match(r"\|(?:\s*:?-+:?\s*\|)+\s*$", lines[at + 1] if at + 1 < len(lines) else ""):
                out.append("|" + "---|" * (len(re.findall(r"(?<!\\)\|", line)) - 1))
        at += 1
    return "\n".join(out)


def fixed_markdown(rows: DataFrame, key: str, md: str, markup: str, name: str = "fixed") -> DataFrame:
    """(key, name) of rows with markdown; a page that is NULL tells nothing."""
    schema = T.StructType([rows.schema[key], T.StructField(name, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], name: [fix_markdown(m, h or "") for m, h in zip(b[md], b[markup])]})

    return rows.where(rows[md].isNotNull()).select(key, md, markup).mapInPandas(run, schema)


def _title(markup: str) -> str:
    return next((n.text() for n in tree(markup).walk() if n.tag == "title"), "")


#: Extractors under one interface, markup -> text; arms() runs any such set.
EXTRACTORS = {"article": lambda markup: article(markup)["content"], "text": lambda markup: tree(markup).text(), "title": _title}


def arms(pages: DataFrame, key: str, markup: str, extractors: dict | None = None) -> DataFrame:
    """(key, arm, content, error): every page through every extractor; one that fails is a row with an error."""
    own = EXTRACTORS if extractors is None else extractors
    schema = T.StructType([pages.schema[key], *[T.StructField(n, T.StringType()) for n in ("arm", "content", "error")]])

    def one(extractor, text: str) -> tuple:
        try:
            return extractor(text), None
        except Exception as e:  # noqa: BLE001 - an arm's failure is its result
            return None, type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, name, *one(f, m)) for k, m in zip(b[key], b[markup]) for name, f in own.items()], columns=[f.name for f in schema])

    return pages.where(pages[markup].isNotNull()).select(key, markup).mapInPandas(run, schema)


ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("word_count", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("published", T.StringType()), T.StructField("author", T.StringType())])


def articles(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, title, content, word_count, lang, published, author) of every page with markup."""
    schema = T.StructType([pages.schema[key], *ARTICLE.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{key: k, **article(m)} for k, m in zip(b[key], b[markup])]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return pages.where(pages[markup].isNotNull()).select(key, markup).mapInPandas(run, schema)


def page_links(pages: DataFrame, key: str, url: str, markup: str, same_domain: bool = False, cap: int = 500) -> DataFrame:
    """(key, pos, url, text): links of every page in order."""
    schema = T.StructType([pages.schema[key], T.StructField("pos", T.IntegerType()), T.StructField("link", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, x["url"], x["text"]) for k, u, m in zip(b[key], b[url], b[markup]) for i, x in enumerate(links(m, u or "", same_domain, cap)["links"])]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return pages.where(pages[markup].isNotNull()).select(key, url, markup).mapInPandas(run, schema)


def selected(pages: DataFrame, key: str, markup: str, schema_: dict) -> DataFrame:
    """(key, data, valid): selector fields as JSON."""
    out = T.StructType([pages.schema[key], T.StructField("data", T.StringType()), T.StructField("valid", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, json.dumps(x["data"], ensure_ascii=False, sort_keys=True), bool(x["valid"])) for k, m in zip(b[key], b[markup]) for x in [extract(m, schema_)]]
            yield pd.DataFrame(rows, columns=[f.name for f in out])

    return pages.where(pages[markup].isNotNull()).select(key, markup).mapInPandas(run, out)
