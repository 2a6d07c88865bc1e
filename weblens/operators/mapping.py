"""More record mappers and predicates: papers, issues, threads, failover, classifier of pages, robots and sitemaps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on.
BLOCK_STATUSES = [403, 429, 503]
BLOCK_MARKERS = [
    "just a moment", "checking your browser", "cf-browser-verification", "attention required", "access denied", "enable javascript and cookies", "verify you are human",
    "complete the following challenge", "performing security verification",
]
DEAD_MARKERS = ["has been closed", "browser has disconnected", "target closed"]
TOOL_CEILINGS = {"search": 60, "read": 120, "crawl": 300}
CHALLENGE_TEXT_MAX = 3000


def visible_text(markup: Column) -> Column:
    """Text between the tags, scripts and styles left out, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(markup, "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def looks_blocked(markup: Column, status: Column) -> Column:
    """A blocking status, or a marker outside scripts on a page of little visible text. Markers may be names of classes, so the markup is searched."""
    outside = F.lower(F.regexp_replace(F.coalesce(markup, F.lit("")), "(?is)<script.*?(?:</script>|\\z)", " "))
    thin = F.length(visible_text(F.coalesce(markup, F.lit("")))) < CHALLENGE_TEXT_MAX
    return F.coalesce(status.isin(BLOCK_STATUSES), F.lit(False)) | (thin & contains_any(outside, BLOCK_MARKERS))


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether any of the parts occurs; NULL text has none."""
    out = F.lit(False)
    for part in parts:
        out = out | F.coalesce(text.contains(part), F.lit(False))
    return out


def browser_dead(ok: Column, message: Column) -> Column:
    """A failed render whose message says that its process is gone."""
    return ~F.coalesce(ok, F.lit(True)) & contains_any(F.lower(message), DEAD_MARKERS)


def is_loopback(host: Column) -> Column:
    return F.coalesce(host.isin("127.0.0.1", "::1"), F.lit(False))


def valid_proxy(url: Column) -> Column:
    """http://host[:port] without credentials; a port is 1 to 65535."""
    port = F.regexp_extract(url, r"^http://[^/?#@:]+:(\d{1,6})(?:[/?#]|$)", 1)
    return F.coalesce(url.rlike(r"^http://[^/?#@:]+(?:[/?#]|$)") | port.try_cast("int").between(1, 65535), F.lit(False))


def valid_cookies(token: Column, csrf: Column) -> Column:
    """Whether both values are 16 to 512 letters, digits or %_.- signs."""
    shape = "^[A-Za-z0-9%_.-]{16,512}$"
    return F.coalesce(token.rlike(shape) & csrf.rlike(shape), F.lit(False))


def listed(text: Column) -> Column:
    """The trimmed, non-blank items of a comma-separated setting, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def setting_int(text: Column, default: int) -> Column:
    """A whole number, the default where there is none."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


def clamp_timeout(tool: Column, asked: Column) -> Column:
    """Seconds within 1 and the tool's ceiling, the lowest one for unknown tools."""
    ceilings = F.create_map(*[F.lit(x) for name, most in TOOL_CEILINGS.items() for x in (name, float(most))])
    return F.greatest(F.lit(1.0), F.least(asked, F.coalesce(F.try_element_at(ceilings, tool), F.lit(float(min(TOOL_CEILINGS.values()))))))


def absent_share(text: Column, phrases: Column) -> Column:
    """Share of the phrases that do not occur, whatever their case; 1 without phrases."""
    known = F.filter(phrases, lambda x: x.isNotNull() & (x != ""))
    out = F.size(F.filter(known, lambda x: ~F.lower(text).contains(F.lower(x))))
    return F.when(F.size(known) == 0, 1.0).otherwise(out / F.size(known))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def without_comment(text: Column) -> Column:
    """text without a markup comment at its beginning."""
    return F.regexp_replace(text, r"(?s)\A\s*<!--.*?-->\s*", "")


def select_with_reasons(rows: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """rows with the first rule that speaks against them, NULL for those to take."""
    reason = F.lit(None).cast("string")
    for label, against in reversed(rules):
        reason = F.when(F.coalesce(against, F.lit(False)), label).otherwise(reason)
    return rows.withColumn(name, reason)


def content_of(*values: Column) -> Column:
    """The first text there is, else an empty one."""
    return F.coalesce(*values, F.lit(""))


def json_depth(text: Column) -> Column:
    """Nesting depth of a JSON text: its brackets outside strings, opened and not closed at most."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step, lambda s: s["most"])


def batch_capped(rows: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """(group, asked, kept, capped) with the first `cap` of each group's rows kept; counted, as which ones they are does not matter here."""
    return rows.groupBy(group).agg(F.count("*").alias("asked"), F.least(F.count("*"), F.lit(cap)).alias("kept"), (F.count("*") > cap).alias("capped"))


def news_items(hits: DataFrame, score: str | None = None) -> DataFrame:
    """(qid, idx, title, url, snippet, published, date_source, score): hits as news; how the date was found only where there is a date, scores held to -1..1, no number is NULL."""
    text = lambda c: F.coalesce(c, F.lit(""))
    dated = F.nullif(F.col("published"), F.lit(""))
    value = F.lit(None).cast("double") if score is None else F.when(F.col(score).isNotNull() & ~F.isnan(score), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(score))))
    return hits.select("qid", "idx", text("title").alias("title"), text("url").alias("url"), text("snippet").alias("snippet"), dated.alias("published"), F.when(dated.isNotNull(), F.nullif("date_source", F.lit(""))).alias("date_source"), value.alias("score"))


def token_similarity(a: Column, b: Column) -> Column:
    """Cosine of two token sets, what stands in for a model's similarity where none is given; 0 for an empty one."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(0.0)


def similarities(rows: DataFrame, query: str, text: str, embed=None, name: str = "sim") -> DataFrame:
    """rows with the similarity of two texts: by embed, a function from a pandas Series of texts to vectors run in Arrow batches, else by their tokens."""
    from weblens.functions.text import cosine, tokens

    if embed is None:
        return rows.withColumn(name, token_similarity(tokens(F.col(query)), tokens(F.col(text))))
    vector = F.pandas_udf(embed, T.ArrayType(T.DoubleType()))
    return rows.withColumn(name, cosine(vector(F.coalesce(query, F.lit(""))), vector(F.coalesce(text, F.lit("")))))


def failover(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the primary; for keys without any, those of the fallback, flagged degraded."""
    rest = fallback.join(primary.select(key).distinct(), key, "left_anti").withColumn("degraded", F.lit(True))
    return primary.withColumn("degraded", F.lit(False)).unionByName(rest)


def follow_redirects(edges: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """(url, final, hops): each start followed along (src, dst) edges, at most `hops`; one join a hop, loops end at the limit."""
    at = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"))
    for _ in range(hops):
        step = at.join(edges, F.col("final") == F.col("src"), "left")
        at = step.select("url", F.coalesce("dst", "final").alias("final"), (F.col("hops") + F.col("dst").isNotNull().cast("int")).alias("hops"))
    return at


def robots_sitemaps(text: Column, cap: int = 10) -> Column:
    """Sitemap addresses of a robots file, at most `cap`."""
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), lambda u: F.trim(u)), 1, cap)


def site_query(text: Column, domains: list[str]) -> Column:
    """The query with site: terms of up to five valid domains, grouped by OR."""
    import re

    good = [d for d in (x.strip().lower().lstrip(".") for x in domains) if re.fullmatch(r"[a-z0-9.-]+\.[a-z]{2,}", d)][:5]
    terms = " OR ".join(f"site:{d}" for d in good)
    return F.concat(text, F.lit(f" ({terms})" if len(good) > 1 else f" {terms}")) if good else text


def raw_query(text: Column, since: Column, until: Column) -> Column:
    """Date terms added; the inclusive end becomes the day after."""
    return F.concat_ws(" ", text, F.concat(F.lit("since:"), since.cast("string")), F.concat(F.lit("until:"), F.date_add(until, 1).cast("string")))


def zip_is_safe(entries: Column, size: Column, packed: Column) -> Column:
    return (entries <= 10_000) & (size <= 200 * 2**20) & (size <= packed * 200)


def parse_judge(raw: Column, pool: int) -> Column:
    """Scores of a judge's JSON object {index: score}: indices in range, scores clamped to 0..3; NULL if it is no object."""
    parsed = F.from_json(raw, "map<string,double>")
    inside = F.filter(F.map_entries(parsed), lambda e: e["key"].rlike(r"^\d+$") & (e["key"].try_cast("int") < pool) & e["value"].isNotNull())
    return F.transform(inside, lambda e: F.struct(e["key"].cast("int").alias("idx"), F.greatest(F.lit(0.0), F.least(F.lit(3.0), e["value"])).alias("score")))


def rouge_l(prediction: str, gold: str) -> float:
    """F1 of the longest common subsequence of white-space tokens, by bit rows (Hyyrö): one word operation a token."""
    p, g = prediction.lower().split(), gold.lower().split()
    if not p or not g:
        return 0.0
    where: dict[str, int] = {}
    for i, w in enumerate(g):
        where[w] = where.get(w, 0) | 1 << i
    row, mask = (1 << len(g)) - 1, (1 << len(g)) - 1
    for w in p:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & mask
    lcs = len(g) - row.bit_count()
    return 2 * lcs / (len(p) + len(g))


def snippet_present(words: list[str], snippet: list[str], share: float = 0.8) -> bool:
    """Whether a window of the snippet's length has that share of its words, counted with repeats; the window's overlap is kept up step by step."""
    n, need = len(snippet), Counter(snippet)
    if not n:
        return True
    have: Counter = Counter()
    overlap = 0
    for i, w in enumerate(words):
        if have[w] < need[w]:
            overlap += 1
        have[w] += 1
        if i >= n:
            old = words[i - n]
            have[old] -= 1
            if have[old] < need[old]:
                overlap -= 1
        if (i >= n - 1 or i == len(words) - 1) and overlap >= share * n:
            return True
    return False


def map_pairs(df: DataFrame, keys: list[str], a: str, b: str, function, name: str, kind: T.DataType) -> DataFrame:
    """(keys, name): a Python function of two texts, in Arrow batches."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(name, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            out[name] = [function(x, y) for x, y in zip(batch[a], batch[b])]
            yield out

    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b).mapInPandas(run, schema)


def bundle_order(rows: DataFrame, group: str, want: int, grace: float = 3.0) -> DataFrame:
    """Replays first-done-wins: of the good rows (rank, finish), by finish time, a later one of better rank may still come within the grace after the want-th; the best-ranked `want` of these stay."""
    good = rows.where("ok").withColumn("_f", F.row_number().over(Window.partitionBy(group).orderBy("finish", "rank")))
    limit = F.min(F.when(F.col("_f") == want, F.col("finish"))).over(Window.partitionBy(group)) + grace
    good = good.withColumn("_limit", limit).where(F.col("_limit").isNull() | (F.col("finish") <= F.col("_limit")))
    return good.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("rank"))).where(F.col("pos") <= want).drop("_f", "_limit")


def struct_of(fields: dict[str, str]) -> T.StructType:
    """A schema from field names and type names; unknown types are text."""
    kinds = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "bool": T.BooleanType(), "list": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(k, kinds.get(v, T.StringType())) for k, v in fields.items()])
