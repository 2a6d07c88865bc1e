"""Text functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
STOPWORDS = ["the", "to", "of", "in", "on", "for", "and", "or", "is", "are", "be", "an", "with", "at", "by", "from", "as", "it", "this", "that", "what", "which", "how", "do", "does", "can"]
GENERIC_TOKENS = ["guide", "best", "how", "top", "manager", "component", "tutorial", "example", "overview", "introduction", "fast", "fastest", "way", "difference", "explained", "simply", "status", "comparison"]
GLYPHS = {"—": " - ", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", " ": " ", "→": "->", "←": "<-", "≥": ">=", "≤": "<=", "×": "x", "•": "-", "·": "-"}


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits, of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), F.lit(1)))


def words(text: Column) -> Column:
    """Lower-case ASCII words, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("([0-9a-z]+)"), F.lit(1))


def norm_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[\\s\\u00a0]+", " "))


def sentences(text: Column, least: int = 4) -> Column:
    """Sentences of at least so many words: split behind .!? before white space, and at line ends."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least)


def scorer_sentences(text: Column) -> Column:
    """Lower-case units between .!? and line ends, white space collapsed, of four words or more."""
    parts = F.transform(F.split(F.lower(text), r"[.!?\n]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: F.size(F.split(s, " ")) >= 4)


def sanitize(text: Column) -> Column:
    """Typographic glyphs as ASCII."""
    out = F.regexp_replace(text, r" *— *", " - ")
    for glyph, plain in GLYPHS.items():
        out = F.replace(out, F.lit(glyph), F.lit(plain))
    return out


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def hms(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = seconds.cast("bigint")
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(s >= 3600, long).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def md_link(label: Column, url: Column) -> Column:
    safe = F.replace(F.replace(label, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return F.concat(F.lit("["), safe, F.lit("]("), url, F.lit(")"))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_conceptual(query: Column) -> Column:
    q = F.lower(F.trim(query))
    return q.rlike(r"^(?:how|what|why)\b") | q.contains(" vs ") | q.contains("explained")


def xlsx_col(ref: Column) -> Column:
    """Zero-based column of a cell reference like AB12."""
    letters = F.split(F.regexp_extract(ref, "^([A-Z]+)", 1), "")
    return F.aggregate(letters, F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64)) - 1


def lenient_int(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("bigint")


def iso_date(value: Column) -> Column:
    """A strict ASCII YYYY-MM-DD that is a real date, else NULL."""
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value.try_cast("date"))


def page_range(spec: Column, total: Column) -> Column:
    """Zero-based pages of `a` or `a-b`, swapped and clamped; NULL for anything else or out of range."""
    lo = F.regexp_extract(spec, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1).try_cast("int")
    hi = F.coalesce(F.nullif(F.regexp_extract(spec, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 2), F.lit("")).try_cast("int"), lo)
    a, b = F.greatest(F.least(lo, hi), F.lit(1)), F.least(F.greatest(lo, hi), total)
    return F.when(lo.isNotNull() & (a <= b), F.transform(F.sequence(a, b), lambda x: x - 1))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
