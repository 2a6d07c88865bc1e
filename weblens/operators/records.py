"""Record mappers, parsers and classifiers as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions.text import lenient_int

# Fixed values that results depend on: positions of the headerless report, and its identity.
COT_COLUMNS = {"market": 0, "report_date": 2, "open_interest": 7, "noncommercial_long": 8, "noncommercial_short": 9, "noncommercial_spreads": 10, "commercial_long": 11, "commercial_short": 12, "nonreportable_long": 15, "nonreportable_short": 16}
CONTENT_KINDS = {
    "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/epub+zip": "epub", "text/csv": "csv", "application/csv": "csv", "application/json": "json",
    "application/rss+xml": "feed", "application/atom+xml": "feed", "application/rdf+xml": "feed", "text/xml": "xml", "application/xml": "xml",
}
BLOCKED_V4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def calendar(events: DataFrame) -> DataFrame:
    """Seven text columns; blanks are NULL; impact is mapped by its lower case, unknown labels pass, empty ones are holidays."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in (("low", "Low"), ("medium", "Medium"), ("high", "High"), ("holiday", "Holiday")) for x in pair])
    impact = F.coalesce(F.try_element_at(known, F.lower(blank("impact"))), blank("impact"), F.lit("Holiday"))
    return events.select("event_id", blank("date").alias("time"), blank("country").alias("currency"), blank("title").alias("event"), impact.alias("impact"), blank("actual").alias("actual"), blank("forecast").alias("forecast"), blank("previous").alias("previous"))


def cot_rows(lines: DataFrame, line: str) -> DataFrame:
    """Report rows from comma-separated lines; short lines are skipped, numbers that do not parse are NULL."""
    cells = F.transform(F.split(F.replace(F.col(line), F.lit('"'), F.lit("")), ","), lambda c: F.trim(c))
    d = lines.withColumn("_c", cells).where(F.size("_c") > max(COT_COLUMNS.values()))
    cell = lambda n: F.get("_c", F.lit(n))
    return d.select(*[(cell(i) if name in ("market", "report_date") else lenient_int(cell(i))).alias(name) for name, i in COT_COLUMNS.items()])


def cot_drift(rows: DataFrame) -> DataFrame:
    """Counts of rows that break the open-interest identity (where all parts are known) or have no ISO date."""
    total = F.col("noncommercial_long") + F.col("noncommercial_spreads") + F.col("commercial_long") + F.col("nonreportable_long")
    return rows.agg(F.count_if(F.col("open_interest") != total).alias("identity_failures"), F.count_if(F.col("report_date").try_cast("date").isNull() | ~F.col("report_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("bad_dates"))


def outcome_odds(markets: DataFrame) -> DataFrame:
    """(slug, outcome, price): two JSON lists zipped; markets whose lists do not parse or differ in length are skipped, prices that are no finite number are NULL."""
    o, p = F.from_json("outcomes", "array<string>"), F.from_json("prices", "array<string>")
    d = markets.select("slug", o.alias("o"), p.alias("p")).where(F.size("o") == F.size("p"))
    z = d.select("slug", F.explode(F.arrays_zip("o", "p")).alias("z"))
    price = F.col("z.p").try_cast("double")
    return z.select("slug", F.col("z.o").alias("outcome"), F.when(~F.isnan(price) & (F.abs(price) < 1e308), price).alias("price"))


def error_record(status: Column, reason: Column) -> Column:
    """STRUCT<code, reason, retryable> of a failed fetch."""
    why = F.coalesce(F.when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string"))), reason, F.lit("fetch_failed"))
    again = why.isin("timeout", "transport", "circuit_open") | (F.coalesce(status, F.lit(0)) >= 500) | (F.coalesce(status, F.lit(0)) == 429)
    code = F.when(reason == "blocked_by_antibot", "blocked_by_antibot").otherwise("fetch_failed")
    return F.struct(code.alias("code"), why.alias("reason"), again.alias("retryable"))


def status_code_record(status: Column) -> Column:
    return F.when(status == 429, "x_rate_limited").when(status.isin(401, 301, 302), "x_account_expired").when(status == 403, "x_account_rejected").otherwise("x_backend_error")


def sniff_kind(content_type: Column, head_hex: Column, extension: Column) -> Column:
    """Kind by content type, then first bytes (hex), then file extension; NULL if none says."""
    ctype = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CONTENT_KINDS.items() for x in pair]), ctype), F.when(F.endswith(ctype, F.lit("+json")), "json").when(F.endswith(ctype, F.lit("+xml")), "xml"))
    magic = F.when(head_hex.startswith("504B0304"), "zip").when(head_hex.contains("255044462D"), "pdf").when(head_hex.rlike("^(?:89504E470D0A1A0A|FFD8FF|474946383[79]61|49492A00|4D4D002A)"), "image")
    ext = F.when(extension.isin("pdf", "docx", "pptx", "xlsx", "epub", "csv", "json", "xml"), extension).when(extension.isin("rss", "atom"), "feed").when(extension == "tsv", "csv")
    return F.coalesce(named, magic, ext)


def ipv4_number(ip: Column) -> Column:
    """The address as a number, NULL if it is none."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), p.cast("int")))
    fine = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull() | (p > 255))
    return F.when(fine, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p))


def is_blocked_v4(ip: Column) -> Column:
    """Private, loopback, link-local, shared, reserved or multicast."""
    number = ipv4_number(ip)
    out = F.lit(False)
    for net in BLOCKED_V4:
        base, bits = net.split("/")
        a, b, c, d = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out = out | number.between(low, low + 2 ** (32 - int(bits)) - 1)
    return out


def snowflake_ms(post_id: Column) -> Column:
    """Creation time in ms of an id, NULL for ids older than the scheme."""
    n = post_id.try_cast("bigint")
    return F.when(n >= 30_000_000_000, F.shiftright(n, 22) + F.lit(1288834974657))


def markdown_table(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(line_no, line): a pipe table with header and separator; bars escaped, line ends as spaces."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    body = rows.select((F.col(order).cast("bigint") + 2).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "line_no bigint, line string")
    return head.unionByName(body)


def inverted_index_text(index: DataFrame, key: str, words: str) -> DataFrame:
    """(key, text): map of word to positions, back in order."""
    e = index.select(key, F.explode(words).alias("w", "pos")).select(key, "w", F.explode("pos").alias("p"))
    return e.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias("text"))


def tree_sizes(nodes: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(root, total): nodes of each tree of a forest, of any depth. Every node's link upwards is doubled in each round, until all end at a root; nodes without a root are in no tree."""
    from weblens.session import cut

    up = nodes.select(F.col(key).alias("_id"), F.coalesce(parent, key).alias("_top"))
    for _ in range(32):  # enough for any depth; only nodes in a circle never come to an end
        step = up.select(F.col("_id").alias("_i"), F.col("_top").alias("_t"))
        doubled = cut(up.join(step, F.col("_top") == F.col("_i"), "left").select("_id", F.coalesce("_t", "_top").alias("_top"), (F.col("_t") != F.col("_top")).alias("_moved")))
        up = doubled.select("_id", "_top")
        if doubled.where("_moved").isEmpty():
            break
    roots = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("root"))
    return up.join(roots, F.col("_top") == F.col("root")).groupBy("root").agg(F.count("*").alias("total"))


def comment_tree(nodes: DataFrame, key: str = "id", parent: str = "parent", max_depth: int = 8, cap: int = 500) -> DataFrame:
    """(root, id, depth, pos): each tree in pre-order, children by id, to max_depth and its first `cap` nodes; tree_sizes tells what is left out.

    One join a level; the path of ids orders a tree, of which no task keeps more than cap nodes.
    """
    wide = lambda c: F.lpad(c.cast("string"), 20, "0")
    level = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("root"), key, F.lit(0).alias("depth"), wide(F.col(key)).alias("path"))
    out = level
    for depth in range(1, max_depth + 1):
        above = level.select("root", F.col(key).alias("_p"), F.col("path").alias("_path"))
        level = nodes.join(above, F.col(parent) == F.col("_p")).select("root", key, F.lit(depth).alias("depth"), F.concat_ws("/", "_path", wide(F.col(key))).alias("path"))
        out = out.unionByName(level)
    pos = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    return out.withColumn("pos", pos).where(F.col("pos") <= cap).drop("path")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, max_pages: int) -> DataFrame:
    """(page, depth): breadth-first pages reached from the seeds, at most max_pages by depth and name.

    The frontier alone is joined each round; what was seen is anti-joined.
    """
    from weblens.session import cut

    seen = frontier = seeds.select("page").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = edges.join(frontier, F.col("src") == F.col("page")).select(F.col("dst").alias("page")).distinct()
        frontier = cut(step.join(seen, "page", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "page").limit(max_pages)
