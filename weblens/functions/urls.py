"""URL functions as built-in expressions (RFC 3986 appendix B; no java.net.URI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# Fixed values that results depend on.
TRACKING_PARAMS = ["fbclid", "gclid", "msclkid", "srsltid", "ref", "ref_src", "spm"]
AUTHORITY_PREFIXES = ["docs.", "doc.", "developer.", "developers.", "learn.", "wiki.", "api."]
AUTHORITY_SUFFIXES = [
    ".gov", ".edu", ".org", ".go.id", ".ac.id", ".ac.uk", ".edu.au", ".int",
    "wikipedia.org", "arxiv.org", "doi.org", "github.com", "gitlab.com", "readthedocs.io",
    "stackoverflow.com", "stackexchange.com", "python.org", "mozilla.org", "microsoft.com",
    "google.com", "apple.com", "espressif.com", "react.dev", "nextjs.org", "pydata.org",
    "redis.io", "openssl.org", "pydantic.dev", "nature.com", "science.org", "ieee.org",
    "acm.org", "reuters.com", "bloomberg.com", "ft.com", "wsj.com", "nytimes.com",
    "theguardian.com", "bbc.co.uk", "bbc.com", "iea.org", "nist.gov", "europa.eu",
]
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "gov.uk", "ac.uk", "co.jp", "or.jp", "ne.jp", "com.au", "net.au", "org.au",
    "co.nz", "co.za", "com.br", "com.cn", "com.sg", "github.io", "gitlab.io", "netlify.app", "vercel.app", "pages.dev",
]
SERP_PARAMS = ["q", "query", "search_query", "s", "keyword", "keywords", "k"]
SERP_SEGMENTS = ["search", "results"]
PATH_DATES = [r"/(\d{4})/(\d{2})(?:/(\d{2}))?(?=/|$)", r"/(\d{4})-(\d{2})-(\d{2})(?!\d)", r"/(\d{4})(\d{2})(\d{2})(?=/|$)"]


def _part(url: Column, number: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, number)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.split_part(F.substring_index(netloc(url), "@", -1), F.lit(":"), F.lit(1)))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def mask(url: Column) -> Column:
    """Scheme and host; the rest hidden."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/***"))


def norm_url(url: Column) -> Column:
    """Key for deduplication: no scheme, fragment, trailing slash or tracking parameters; parameters sorted; host and path lower case."""
    base = F.lower(F.regexp_replace(F.concat(netloc(url), path(url)), "/+$", ""))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING_PARAMS))
    text = F.array_join(F.array_sort(kept), "&")
    return F.when(text == "", base).otherwise(F.concat(base, F.lit("?"), text))


def host_matches(host_: Column, domain: Column) -> Column:
    """Equal, or a sub-domain by whole labels; leading dots of domain are ignored and blanks never match."""
    clean = F.regexp_replace(F.lower(F.trim(domain)), r"^\.+", "")
    return (clean != "") & (host_ != "") & ((host_ == clean) | F.endswith(host_, F.concat(F.lit("."), clean)))


def is_authoritative(url: Column) -> Column:
    own = F.regexp_replace(host(url), r"^www\.", "")
    dotted = F.concat(F.lit("."), own)
    suffixes = "|".join((s if s.startswith(".") else "." + s).replace(".", r"\.") for s in AUTHORITY_SUFFIXES)
    prefixes = "|".join(p.replace(".", r"\.") for p in AUTHORITY_PREFIXES)
    return own.rlike(f"^(?:{prefixes})") | dotted.rlike(f"(?:{suffixes})$")


def registrable_domain(host_: Column) -> Column:
    """Last two labels, three behind a known two-label suffix."""
    own = F.regexp_replace(F.lower(host_), r"\.+$", "")
    two, three = F.substring_index(own, ".", -2), F.substring_index(own, ".", -3)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), three).otherwise(two)


def same_host(a: Column, b: Column) -> Column:
    """Equal or either a sub-domain of the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def is_valid(url: Column) -> Column:
    """http or https, a host, and a port in range if any."""
    port = F.regexp_extract(netloc(url), r":([^:\]]*)$", 1)
    fine = (port == "") | (port.rlike(r"^\d{1,5}$") & (port.try_cast("int") <= 65535))
    return scheme(url).isin("http", "https") & (host(url) != "") & fine


def is_pdf(url: Column) -> Column:
    return F.endswith(F.lower(path(url)), F.lit(".pdf"))


def is_serp(url: Column) -> Column:
    """A page of search results: a search parameter with a value, and a search segment or the root path."""
    asked = F.exists(F.split(query(url), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(SERP_PARAMS) & p.contains("=") & (F.trim(F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), r"\+|%20", " ")) != ""))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return asked & ((F.size(segments) == 0) | F.exists(segments, lambda s: F.lower(F.substring_index(s, ".", 1)).isin(SERP_SEGMENTS)))


def url_date(url: Column, max_year: int, min_year: int = 1995) -> Column:
    """Date in the path: /YYYY/MM[/DD], /YYYY-MM-DD or /YYYYMMDD; only real dates, months allowed."""
    text = path(url)

    def first(pattern: str) -> Column:
        y, m, d = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
        found = F.arrays_zip(y.alias("y"), m.alias("m"), d.alias("d"))
        real = F.filter(found, lambda x: x["y"].cast("int").between(min_year, max_year) & F.concat_ws("-", x["y"], x["m"], F.when(x["d"] == "", "01").otherwise(x["d"])).try_cast("date").isNotNull())
        one = F.get(real, F.lit(0))
        return F.when(one["d"] == "", F.concat_ws("-", one["y"], one["m"])).otherwise(F.concat_ws("-", one["y"], one["m"], F.nullif(one["d"], F.lit(""))))

    return F.coalesce(*[F.nullif(first(p), F.lit("")) for p in PATH_DATES])


def cache_key(url: Column, options_json: Column) -> Column:
    """sha256 of the URL with scheme and host in lower case, and the options as key-sorted JSON."""
    canonical = F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    return F.sha2(F.concat(canonical, F.lit("|"), options_json), 256)


def x_target(url: Column) -> Column:
    """STRUCT<kind, value>: status and id, or user and handle, of a post or profile address; NULL otherwise."""
    ours = host(url).rlike(r"^(?:www\.|mobile\.)?(?:x|twitter)\.com$")
    status = F.regexp_extract(path(url), r"^/[^/]+/status(?:es)?/(\d+)", 1)
    user = F.regexp_extract(path(url), r"^/@?([A-Za-z0-9_]{1,15})/?$", 1)
    reserved = F.lower(user).isin("home", "explore", "search", "notifications", "messages", "settings", "i", "login", "signup", "intent", "hashtag", "share", "compose")
    kind = F.when(ours & (status != ""), "status").when(ours & (user != "") & ~reserved, "user")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(status != "", status).otherwise(user).alias("value")))
