"""Writers: keyed upserts, purges and reports."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("_r")).select("_r.*")


#: Bytes of a payload from which it is kept compressed and apart.
INLINE_BYTES = 32_768


# Plain functions: they get rows a hundred at a time (spark.sql.execution.python.udf.maxRecordsPerBatch); an Arrow batch has ten thousand, however long each payload is.
@F.udf(T.BinaryType(), useArrow=False)
def _packed(text: str | None) -> bytes | None:
    return None if text is None else gzip.compress(text.encode(), mtime=0)


@F.udf(T.BinaryType(), useArrow=False)
def _unpacked(blob: bytes | None) -> bytes | None:
    try:
        return None if blob is None else gzip.decompress(bytes(blob))
    except (OSError, EOFError):  # a damaged entry is a miss
        return None


def cache_put(old: DataFrame | None, new: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Entries with `inline` or, beyond INLINE_BYTES, `blob` in place of the payload; the newest of each key, of old entries of that form and new ones."""
    big = F.octet_length(payload) > INLINE_BYTES
    rows = new.withColumns({"inline": F.when(~big, F.col(payload)), "blob": _packed(F.when(big, F.col(payload)))}).drop(payload)
    rows = rows if old is None else old.unionByName(rows)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")


def cache_get(entries: DataFrame, payload: str) -> DataFrame:
    """Entries with their payload again; NULL for a damaged one."""
    return entries.withColumn(payload, F.coalesce("inline", F.try_validate_utf8(_unpacked(F.col("blob")).cast("string")))).drop("inline", "blob")


def purge(entries: DataFrame, created: str, cutoff: Column) -> DataFrame:
    """Entries not older than the cutoff."""
    return entries.where(F.col(created) >= cutoff)


def orphans(files: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    return files.join(entries.select(path), path, "left_anti")


def report(rows: DataFrame, order: str, columns: list[str], path: str) -> None:
    """A markdown table as text, one ordered part; reports are small by their query."""
    from weblens.operators.records import markdown_table

    markdown_table(rows, order, columns).orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; a failed write leaves no part behind, as the committer moves what is whole."""
    rows.write.mode("overwrite").json(path)


def persist_watches(watches: DataFrame, new: DataFrame, path: str) -> None:
    """The registry with new watches added once each, written beside the old one and then in its place."""
    from weblens.plans.tools import watches_add
    from weblens.session import file_system

    write_json(watches_add(watches, new), path + ".new")
    fs, own = file_system(watches.sparkSession, path)
    fs.delete(own, True)
    fs.rename(file_system(watches.sparkSession, path + ".new")[1], own)
