"""Readers: tables, files, and a plug-in source for pages fetched by the caller's own function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WATCH_SCHEMA = "id string, url string, selector string, interval_s bigint, webhook string, last_hash string, last_check double"
PAGE_SCHEMA = "url string, final_url string, status int, html string, error string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def binary_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(url, body) of files, for the document converters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))


def csv_text(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A headerless CSV with text columns _c0, _c1, ...; short rows are filled with NULL."""
    return spark.read.schema(", ".join(f"_c{i} string" for i in range(columns))).option("mode", "PERMISSIVE").csv(path)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a known schema; damaged ones become NULL rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def watch_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registered watches of JSON lines; unknown fields are ignored, rows without an id or address are damaged and left out, a missing file is an empty registry."""
    from weblens.session import file_system

    fs, own = file_system(spark, path)
    if not fs.exists(own):
        return spark.createDataFrame([], WATCH_SCHEMA)
    return spark.read.schema(WATCH_SCHEMA).option("mode", "PERMISSIVE").json(path).where("id is not null and url is not null")


def fetch_pages(urls: DataFrame, fetch: Callable[[str], tuple[str, int, str]], url: str = "url", chunk: int = 1000) -> DataFrame:
    """(url, final_url, status, html, error) of a table of addresses of any size, fetched by the caller's function in the tasks.

    Addresses of a host stay together up to about `chunk` of them, so a task keeps
    to a host's pace and a host with very many has several tasks.
    """
    rows = urls.select(F.col(url).alias("url")).where("url is not null").distinct()
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1))
    sizes = rows.groupBy(host.alias("host")).agg(F.ceil(F.count("*") / chunk).alias("_parts"))
    placed = rows.withColumn("host", host).join(sizes, "host").withColumn("_part", F.pmod(F.xxhash64("url"), "_parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b["url"]:
                try:
                    final, status, html = fetch(u)
                    out.append((u, final, status, html, None))
                except Exception as e:  # noqa: BLE001 - a failed fetch is a row
                    out.append((u, None, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["url", "final_url", "status", "html", "error"]).astype({"status": "Int32"})

    return placed.repartition("host", "_part").select("url").mapInPandas(run, PAGE_SCHEMA)


def fetch_source(fetch: Callable[[str], tuple[str, int, str]]) -> type[DataSource]:
    """A batch source over a short list of urls (option `urls`, one a line; fetch_pages takes a table): a partition a host, so one task keeps to a host's pace; failures are rows with an error."""

    class HostPartition(InputPartition):
        def __init__(self, urls: list[str]):
            self.urls = urls

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.urls = [u for u in options.get("urls", "").split("\n") if u]

        def partitions(self):
            hosts: dict[str, list[str]] = {}
            for u in self.urls:
                hosts.setdefault(u.split("/")[2].lower() if u.count("/") >= 2 else "", []).append(u)
            return [HostPartition(x) for x in hosts.values()]

        def read(self, partition) -> Iterator[tuple]:
            for u in partition.urls:
                try:
                    final, status, html = fetch(u)
                    yield (u, final, status, html, None)
                except Exception as e:  # noqa: BLE001 - a failed fetch is a row
                    yield (u, None, None, None, type(e).__name__)

    class Fetch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "weblens_fetch"

        def schema(self) -> str:
            return PAGE_SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(dict(self.options))

    return Fetch
