"""Lines that one site repeats over its documents.

A line is cut into shingles of five words (a shorter line is one shingle); bands
of ROWS MinHash values put it, within its site, into buckets.

Near: numbers, month and weekday names, the site's own name and the
names of persons (NAME, beyond the first word) are masked. Of masked lines alike
to SIMILARITY two fail to share one of BANDS buckets with a chance of
(1 - 0.8 ** ROWS) ** BANDS (0.16 %). The different
masked lines of a bucket are compared with each other, all pairs that can reach
SIMILARITY, buckets of the same lines once; the links of all buckets, and those of equal normalised lines, are
put together to connected clusters, and the documents of a cluster are counted.

Exact: equal lines always lie in one cluster, so of the lines of clusters in
`least` documents those are kept whose normalised text is in so many itself.

Plan: documents are read twice, their line keys (no text) are
written to the shared folder; counting is a distinct and a count, combined
before the shuffle, so a hot site or line never lies in one task. The text of a
masked line is fetched from one place of it, and only of lines that share a
bucket. The different masked lines of one bucket do lie in one task.

Defined results: NULL or empty content, and rows without a site, give no line;
blank lines are numbered but never found; repeated rows of a key count once;
the numbers of a line found are distinct; an empty table gives an empty one;
other columns are ignored; very long lines are processed whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.llm.common import folded, lines, one_spaced, repeated_lines, join_few
from weblens.llm.minhash import bands, shingle_hashes
from weblens.operators.instants import MONTHS
from weblens.session import write_shared

BANDS, ROWS = 9, 3
SIMILARITY = 0.8
WORDS = 5
#: Texts up to which all pairs are compared at once, as that is cheaper than looking up rare shingles.
_FEW = 16


#: Weekdays of the texts' languages in full, and short ones that are no other word.
_WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag"
    " senin selasa rabu kamis jumat jum'at sabtu minggu lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo"
    " segunda-feira terça-feira quarta-feira quinta-feira sexta-feira понедельник вторник среда среду четверг пятница пятницу суббота субботу воскресенье"
    " poniedziałek wtorek środa środę czwartek piątek sobota sobotę niedziela niedzielę"
)
#: Words of dates, masked before shingles are made.
_DATES = dict.fromkeys([n for names in MONTHS for n in names.split()] + _WEEKDAYS.split(), "<d>")


def _signature(number: int):
    """The line's band values, `number` of 32 bits as fields b0, b1, ...; rows that share a value by chance are told apart later."""
    names = [f"b{i}" for i in range(number)]

    @F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in names]))
    def signature(line: pd.Series) -> pd.DataFrame:
        codes, unique = pd.factorize(line)
        values = (bands(unique.tolist(), number, ROWS, WORDS, _DATES) & 0xFFFFFFFF).astype("uint32").view("int32")
        return pd.DataFrame(values[codes], columns=names)

    return signature


def _site_masked(norm: Column, own_site: Column) -> Column:
    """A normalised line (numbers masked) with the site's name masked; a function of that line, so equal lines stay equal. Dates are masked word by word later."""
    return F.replace(norm, F.substring_index(own_site, ".", 1), F.lit("<n>"))


_WORD = r"\p{Lu}(?:['’]?\p{L}{0,2}\p{Ll}[\p{L}\p{M}'’-]*+|\.)"
_RUN = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}'’-])(?<!\p{{Lu}}[\p{{L}}\p{{M}}'’.-]{{0,30}}\s{{1,3}})(?!{_WORD}(?:\s+{_WORD}){{3}}){_WORD}"
#: Two or three capitalised words or initials in a row; one alone may be any noun, and more are a heading in capitals.
NAME = rf"{_RUN}(?:\s+{_WORD}){{1,2}}"
#: In a byline, one alone is a name, too.
_BYLINE = r"^\W*(?:(?i:by|von|oleh|par|por|de|autor|tekst|text|teks|written by)\b|[Аа]втор|[Тт]екст)"
BYLINE_NAME = rf"{_RUN}(?:\s+{_WORD}){{0,2}}"
#: What any NAME has: a capitalised word and a capital after it.
_TWO = r"\p{Lu}[\p{L}\p{M}'’.-]*+\s++\p{Lu}"
_FIRST = r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+[’'-]?"


def masked(each: DataFrame) -> DataFrame:
    """each (site, line, ...) with `norm` and `masked`: the line normalised, and so after its names are masked, with the site's name masked; dates are masked word by word later.

    Steps are columns of their own, so that none is worked out twice.
    """
    byline = F.col("line").rlike(_BYLINE)
    each = each.withColumns({"_spaced": one_spaced(F.col("line")), "_byline": byline, "_some": byline | F.col("line").rlike(_TWO)})
    # a line without words in small letters or numbers is a heading, if no byline
    each = each.withColumn("_some", F.col("_some") & (F.col("_byline") | F.col("line").rlike(r"(?<![\p{L}\p{N}'’-])[\p{Ll}0-9]")))
    each = each.withColumn("_first", F.when(F.col("_some"), F.regexp_extract("_spaced", _FIRST, 0)))
    rest = F.substring("_spaced", F.length("_first") + 1, F.length("_spaced"))
    named = F.concat("_first", F.when(F.col("_byline"), F.regexp_replace(rest, BYLINE_NAME, "<n>")).otherwise(F.regexp_replace(rest, NAME, "<n>")))
    each = each.withColumns({"_named": F.when(F.col("_some"), named).otherwise(F.col("_spaced")), "norm": folded(F.col("_spaced"))})
    masked_ = F.when(F.col("_named") != F.col("_spaced"), folded(F.col("_named"))).otherwise(F.col("norm"))
    return each.withColumn("masked", _site_masked(masked_, F.col("site"))).drop("_first", "_byline", "_some", "_named", "_spaced")


def _shingles(text: str) -> frozenset:
    w = [_DATES.get(x.strip(".,;:()"), x) for x in text.split()]
    return frozenset(tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1)))


def links(texts: list[str]) -> list[tuple[int, int]]:
    """(first of its cluster, other) of the clusters in which all pairs of texts alike to SIMILARITY are connected.

    Two such texts share one of the rarest shingles of each (all but SIMILARITY
    of them and one), so only texts under the same rare shingle are compared, and
    those of a cluster already joined are passed over.
    """
    return _set_links([_shingles(x) for x in texts])


def _set_links(sets: list[frozenset]) -> list[tuple[int, int]]:
    """links of texts given by their shingles, or hashes of them."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def alike(i: int, j: int) -> bool:
        both = len(sets[i] & sets[j])
        return both >= SIMILARITY * (len(sets[i]) + len(sets[j]) - both) - 1e-9

    if len(sets) <= _FEW:
        for i in range(len(sets)):
            for j in range(i):
                if root(j) != root(i) and alike(i, j):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        return [(root(i), i) for i in range(len(sets)) if root(i) != i]
    counts = Counter(x for s in sets for x in s)
    under: dict = {}
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = sets[i]
        rare = sorted(own, key=lambda x: (counts[x], x))[: len(own) - math.ceil(SIMILARITY * len(own) - 1e-9) + 1]
        seen = set()
        for x in rare:
            for j in under.get(x, ()):
                if j not in seen and root(j) != root(i):
                    seen.add(j)
                    if alike(i, j):
                        parent[max(root(i), root(j))] = min(root(i), root(j))
            under.setdefault(x, []).append(i)
    return [(root(i), i) for i in range(len(sets)) if root(i) != i]


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b): the links of each bucket; the rows come sorted by bucket."""
    bucket, m, sets = None, [], []
    for batch in batches:
        out: list[tuple[int, int]] = []
        texts = batch["masked"].tolist()
        hashes, first = shingle_hashes(texts, WORDS, _DATES)
        ends = np.append(first[1:], len(hashes))
        for at, own, low, high in zip(batch["bucket"].tolist(), batch["m"].tolist(), first, ends):
            if at != bucket:
                out += [(m[i], m[j]) for i, j in _set_links(sets)]
                bucket, m, sets = at, [], []
            m.append(own)
            sets.append(frozenset(hashes[low:high].tolist()))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    yield pd.DataFrame([(m[i], m[j]) for i, j in _set_links(sets)], columns=["a", "b"], dtype="int64")


def clusters(edges: DataFrame) -> DataFrame:
    """(m, c): every node of edges (a, b) that is not the smallest of its connected cluster, with the smallest.

    Links go to the smallest neighbour in turns, from larger nodes and from
    smaller ones, until none changes; no node's links lie in one row.
    """
    edges = write_shared(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c"))
        edges = write_shared(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("c").alias("b")).distinct())
        least = edges.groupBy("a").agg(F.min("b").alias("c"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("c").alias("b")).where("a != b")
        edges = write_shared(small.unionByName(least.select("a", F.col("c").alias("b"))).distinct())
        if edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == before:
            return edges.select(F.col("a").alias("m"), F.col("b").alias("c"))


def clustered(df: DataFrame, key: str, url: str, content: str, least: int) -> DataFrame:
    """(key, line_no, h): lines of near-duplicate clusters that reach at least `least` documents of their site; h is a hash of site and normalised line."""
    text = lines(df, key, url, content)
    own = masked(text)
    own = own.select(key, "line_no", F.xxhash64("site").alias("_s"), F.xxhash64("site", "norm").alias("h"), F.xxhash64("site", "masked").alias("m"), _signature(BANDS)("masked").alias("_b"))
    values = [f"b{i}" for i in range(BANDS)]
    keys = write_shared(own.select(key, "line_no", "_s", "h", "m", "_b.*"))
    # single numbers, so that groups are hashed and not sorted
    distinct = write_shared(keys.groupBy("m").agg(*[F.first(c).alias(c) for c in ("_s", *values)], F.min(key).alias("_key"), F.min_by("line_no", key).alias("_line")))
    each = distinct.select("m", F.explode(F.array(*[F.xxhash64("_s", F.lit(i), c) for i, c in enumerate(values)])).alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("m")).alias("_x"), F.bit_xor(F.xxhash64("m", F.lit(1))).alias("_y")).where("_n > 1")
    shared = shared.groupBy("_n", "_x", "_y").agg(F.min("bucket").alias("bucket")).select("bucket")  # buckets of the same lines: one of them
    several = write_shared(join_few(each, shared, ["bucket"], "inner", "m"))
    places = join_few(distinct, several.select("m").distinct(), ["m"], "inner", "m").select(F.col("_key").alias(key), F.col("_line").alias("line_no"), F.col("m").alias("_m"))
    fetched = masked(join_few(text, places, [key, "line_no"], "inner", "line"))
    same = F.when(F.xxhash64("site", "masked") == F.col("_m"), F.col("masked"))  # in the aggregate, as a filter would be worked out before the join
    texts = fetched.groupBy(F.col("_m").alias("m")).agg(F.min(same).alias("masked")).where("masked is not null")
    alike = several.join(texts, "m").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_bucket_links, "a long, b long")
    forms = keys.groupBy("h").agg(F.min("m").alias("a"), F.max("m").alias("_z")).where("a != _z").select("h", "a")  # equal lines whose capitals differ
    equal = join_few(keys.select("h", "m"), forms, ["h"], "inner", "m").select("a", F.col("m").alias("b"))
    rows = join_few(keys.select(key, "line_no", "h", "m"), clusters(alike.unionByName(equal)), ["m"], "left", key).select(key, "line_no", "h", F.coalesce("c", "m").alias("c"))
    often = repeated_lines(rows.select(key, "c"), key, least, ["c"]).select("c")
    return join_few(rows, often, ["c"], "inner", key).select(key, "line_no", "h")


def repeated_near(df: DataFrame, key: str, url: str, content: str, least: int = 5) -> DataFrame:
    """(key, line_no): lines of near-duplicate clusters that reach at least `least` documents of their site."""
    return clustered(df, key, url, content, least).select(key, "line_no").distinct()


def repeated_exact(df: DataFrame, key: str, url: str, content: str, least: int = 5) -> DataFrame:
    """(key, line_no): of the lines of near-duplicate clusters, those whose normalised text is in at least `least` documents of their site."""
    found = write_shared(clustered(df, key, url, content, least))
    often = repeated_lines(found.select(key, "h"), key, least, ["h"]).select("h")
    return join_few(found, often, ["h"], "inner", key).select(key, "line_no").distinct()


def without_lines(df: DataFrame, found: DataFrame, key: str, content: str) -> DataFrame:
    """df with the found lines taken out of content; line order and all other columns stay."""
    drop = found.groupBy(F.col(key).alias("_key")).agg(F.collect_set("line_no").alias("_drop"))
    joined = df.join(drop, F.col(key) == F.col("_key"), "left")
    kept = F.filter(F.split(content, "\n"), lambda x, i: ~F.array_contains("_drop", i + 1))
    return joined.withColumn(content, F.when(F.col("_drop").isNull(), F.col(content)).otherwise(F.array_join(kept, "\n"))).drop("_key", "_drop")
