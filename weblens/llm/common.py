"""Expressions shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.session import write_shared

#: Salts that spread the rows of a hot key over tasks.
SALTS = 16
#: Most rows of a table of hashes and counts that is broadcast (about 32 MB).
BROADCAST_ROWS = 1_000_000


def site(url: Column) -> Column:
    """Last two labels of the host of an http or https URL, lower case, without port and trailing dot; else NULL."""
    host = F.regexp_extract(F.lower(url), r"^\s*https?://(?:[^/?#]*@)?([^/?#:@]*)", 1)
    return F.nullif(F.regexp_extract(host, r"([^.\s]+(?:\.[^.\s]+)?)\.*\s*$", 1), F.lit(""))


#: White space as Java and Unicode have it, without the plain space.
_WS = "\\t\\n\\u000b\\f\\r\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _odd_space(line: Column) -> Column:
    """Whether white space other than single plain spaces occurs; one plain search for each range, as a class of many ranges is tested slowly."""
    odd = line.contains("  ")
    for low, high in (("\\t", "\\r"), ("\\x1c", "\\x1f"), ("\\x{2000}", "\\x{200a}"), ("\\x{2028}", "\\x{2029}")):
        odd = odd | line.rlike(f"[{low}-{high}]")
    for one in "\x85\xa0\u1680\u202f\u205f\u3000":
        odd = odd | line.contains(one)
    return odd


def one_spaced(line: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.when(_odd_space(line), F.regexp_replace(line, f"[ {_WS}]+", " ")).otherwise(line))


def folded(spaced: Column) -> Column:
    """Lower case, digit runs to one 0."""
    return F.regexp_replace(F.lower(spaced), "[0-9]+", "0")


def normal_line(line: Column) -> Column:
    """Lower case, white space runs to one space, trimmed, digit runs to one 0."""
    return folded(one_spaced(line))


def lines(df: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """(key, site, line_no, line): the non-blank lines of content, numbered from 1; rows without a site or content have none."""
    own = df.select(F.col(key), site(F.col(url)).alias("site"), F.col(content).alias("_content")).where(F.col("site").isNotNull() & F.col("_content").isNotNull())
    each = own.select(key, "site", F.posexplode(F.split("_content", "\n")).alias("_pos", "line")).where(F.col("line").rlike(f"[^ {_WS}]"))
    return each.select(key, "site", (F.col("_pos") + 1).alias("line_no"), "line")


def repeated_lines(counted: DataFrame, key: str, least: int, by: list[str]) -> DataFrame:
    """(*by, df): the groups that hold at least `least` different keys.

    Distinct first, so that a group of any size is combined on the map side and
    no task gathers a group's rows.
    """
    return counted.groupBy(*by, key).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count("*").alias("df")).where(F.col("df") >= least)


def join_few(rows: DataFrame, few: DataFrame, on: list[str], how: str, spread: str) -> DataFrame:
    """rows joined with few (one narrow row a key) on keys of which one may hold a large part of rows.

    few is written first and counted: up to BROADCAST_ROWS it is broadcast and
    rows stay where they are. A larger one is repeated for every salt and rows
    get the salt of a hash of `spread`, so that a hot key's rows fall into SALTS
    partitions.
    """
    few = write_shared(few)
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), on, how)
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(few, [*on, "_salt"], how).drop("_salt")
