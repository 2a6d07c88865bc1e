"""Mixing sources to target weights.

Hierarchical budgeting: the token budget goes down a tree domain - language -
source in proportion to the target shares. A node gets at most what its sources
can give with their repeats; what a source cannot use goes to its siblings of the
same language and domain first, then to the other languages of the domain, then
to the other domains. Each source is used in whole seeded epochs and a prefix, by
tokens, of the next epoch's seeded order.

Plan: one pass counts the tokens of every whole text with a public tokenizer and
writes (key, source, tokens). Everything after that works on this narrow table:
sums for each source (as many rows as targets) give the budgets; the prefix is
found by hashing documents into PREFIX_BUCKETS slices of the order, of which only
the one where the budget ends is ordered in a window; no task gets a source.

Defined results: sources without a target and NULL sources are not used; a target
source without tokens reaches 0 and its share is redistributed; NULL and empty
texts have no tokens and are left out; a key that comes twice counts once (the
largest source and count); the prefix ends before the document that would exceed
it, so a source misses its budget by less than one document; ties of the order go
to the smaller key; shares may sum to anything positive; an empty table gives an
empty mixture; max_repeats NULL or below 1 counts as 1; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.session import write_shared

#: The public pattern that splits text before byte-pair merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PREFIX_BUCKETS = 4096
#: Most target sources; their sums come to the driver.
MAX_TARGETS = 100_000
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """docs with text replaced by n_tokens."""
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for batch in batches:
            n = [len(x) for x in encoding.encode_ordinary_batch(batch.pop(text).tolist(), num_threads=1)]
            yield batch.assign(n_tokens=n)

    return docs.mapInPandas(count, schema)


def budgets(leaves: list[dict], total: float) -> dict[str, float]:
    """Tokens for each source. leaves: source, share, capacity and path (domain, language)."""

    def fill(nodes: list[tuple[float, float]], amount: float) -> list[float]:
        """Amounts in proportion to weight, none above its capacity, shortages spread over the rest."""
        out, open_ = [0.0] * len(nodes), [i for i, (w, c) in enumerate(nodes) if w > 0 and c > 0]
        left = min(amount, sum(nodes[i][1] for i in open_))
        while open_ and left > 1e-9:
            weight = sum(nodes[i][0] for i in open_)
            full = [i for i in open_ if nodes[i][1] - out[i] <= left * nodes[i][0] / weight]
            if not full:
                for i in open_:
                    out[i] += left * nodes[i][0] / weight
                break
            for i in full:
                left -= nodes[i][1] - out[i]
                out[i] = nodes[i][1]
            open_ = [i for i in open_ if i not in full]
        return out

    def down(own: list[dict], depth: int, amount: float) -> dict[str, float]:
        if depth == len(own[0]["path"]):
            return dict(zip((x["source"] for x in own), fill([(x["share"], x["capacity"]) for x in own], amount)))
        parts: dict[str, list[dict]] = {}
        for x in own:
            parts.setdefault(x["path"][depth], []).append(x)
        amounts = fill([(sum(x["share"] for x in p), sum(x["capacity"] for x in p)) for p in parts.values()], amount)
        return {k: v for p, a in zip(parts.values(), amounts) for k, v in down(p, depth + 1, a).items()}

    return down(sorted(leaves, key=lambda x: x["source"]), 0, total) if leaves else {}


def _unit(key: str, seed: int, epoch: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), epoch), 11)


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", domains: dict[str, str] | None = None, total: float | None = None, seed: int = 0, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(rows, shares): rows (key, source, epoch, n_tokens), a row for each use; shares by source with the share really reached.

    total: tokens of the mixture; without it, what the target sources hold once.
    """
    spark = docs.sparkSession
    wanted = {r["source"]: r for r in targets.where(F.col("source").isNotNull()).dropDuplicates(["source"]).limit(MAX_TARGETS + 1).collect()}
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    named = F.broadcast(spark.createDataFrame([(x,) for x in wanted], "source string"))  # at most MAX_TARGETS rows
    own = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).join(named, "source", "left_semi").select(key, "source", F.lower(F.substring("lang", 1, 2)).alias("lang"), text)
    counted = token_counts(own, text, path).groupBy(key).agg(F.max(F.struct("source", "n_tokens", "lang")).alias("_r")).select(key, "_r.*").where("n_tokens > 0")
    counted = write_shared(counted)
    by_lang = counted.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).groupBy("source").agg(F.sum("n").alias("n"), F.max_by("lang", F.struct("n", "lang")).alias("lang"))
    have = {r["source"]: r for r in by_lang.collect()}
    leaves = []
    for source, t in wanted.items():
        n = have[source]["n"] if source in have else 0
        place = ((domains or {}).get(source, "other"), (have[source]["lang"] if source in have else None) or "und")
        leaves.append({"source": source, "share": max(0.0, t["target_share"] or 0.0), "capacity": float(n * max(1, t["max_repeats"] or 1)), "n": n, "path": place})
    total = float(sum(x["n"] for x in leaves)) if total is None else total
    given = budgets(leaves, total)
    plan = [(x["source"], int(given[x["source"]] // x["n"]) if x["n"] else 0, float(given[x["source"]] % x["n"]) if x["n"] else 0.0, x["share"], given[x["source"]]) for x in leaves]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("_epochs", T.IntegerType()), T.StructField("_rest", T.DoubleType()), T.StructField("target_share", T.DoubleType()), T.StructField("budget", T.DoubleType())])
    table = F.broadcast(spark.createDataFrame(plan, schema))  # at most MAX_TARGETS rows
    rows = counted.select(key, "source", "n_tokens").join(table.select("source", "_epochs", "_rest"), "source")
    whole = rows.where("_epochs > 0").select(key, "source", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)).alias("epoch"), "n_tokens")
    part = rows.where("_rest > 0").withColumn("_u", _unit(key, seed, F.col("_epochs"))).withColumn("_slice", F.pmod("_u", F.lit(PREFIX_BUCKETS)).cast("int"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = part.groupBy("source", "_slice", "_rest").agg(F.sum("n_tokens").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    edges = slices.where(F.col("_before") + F.col("_n") > F.col("_rest")).groupBy("source").agg(F.min(F.struct("_slice", "_before")).alias("_e"))
    edges = edges.select("source", F.col("_e._slice").alias("_edge"), F.col("_e._before").alias("_before"))
    part = part.join(F.broadcast(edges), "source", "left")  # at most MAX_TARGETS rows
    inside = part.where(F.col("_edge").isNull() | (F.col("_slice") < F.col("_edge")))
    edge = part.where(F.col("_slice") == F.col("_edge"))
    order = Window.partitionBy("source", "_slice").orderBy("_u", key).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_sum", F.sum("n_tokens").over(order)).where(F.col("_before") + F.col("_sum") <= F.col("_rest"))
    cols = [F.col(key), F.col("source"), F.col("_epochs").alias("epoch"), F.col("n_tokens")]
    out = whole.unionByName(inside.select(*cols)).unionByName(edge.select(*cols))
    sums = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("epoch") + 1).alias("epochs"))
    sums = table.join(sums, "source", "left").select("source", "target_share", "budget", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("epochs", F.lit(0)).alias("epochs"))
    return out, sums.withColumn("reached_share", F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())))
