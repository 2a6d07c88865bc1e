"""Vector similarity over embedding columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_k(vectors: DataFrame, seeds: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block: int = 4096) -> DataFrame:
    """(seed, key, sim, rank): the k nearest of all vectors to each seed by cosine, ties to the smaller key; a seed is not its own neighbour.

    seeds are a stated query set: they go to the tasks in blocks of at most
    `block` vectors, each task keeps its k best of every seed, and only those are
    shuffled. A zero vector has similarity 0.
    """
    spark, result = vectors.sparkSession, None
    schema = T.StructType([T.StructField("seed", seeds.schema[key].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("sim", T.DoubleType())])

    def search(batches: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
        keys, units = sent.value
        own = np.asarray(keys)
        best_s, best_id = np.full((len(keys), 0), -2.0), np.zeros((len(keys), 0), own.dtype)
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack([np.asarray(v, np.float64) for v in batch[column]])
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            sims = np.round(units @ np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).T, 9)
            ids = batch[key].to_numpy()
            sims[own[:, None] == ids[None, :]] = -2.0
            all_s, all_id = np.hstack([best_s, sims]), np.hstack([best_id, np.broadcast_to(ids, sims.shape)])
            order = np.lexsort((all_id, -all_s), axis=1)[:, :k]  # ties to the smaller key
            best_s, best_id = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_id, order, 1)
        real = best_s > -2
        yield pd.DataFrame({"seed": np.repeat(own, real.sum(axis=1)), key: best_id[real], "sim": best_s[real]})

    def run(rows: list) -> DataFrame:
        m = np.stack([np.asarray(r[column], np.float64) for r in rows])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast(([r[key] for r in rows], np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))
        return vectors.where(F.col(column).isNotNull()).select(key, column).mapInPandas(lambda b: search(b, sent), schema)

    part: list = []
    for row in seeds.where(F.col(column).isNotNull()).select(key, column).toLocalIterator():
        part.append(row)
        if len(part) == block:
            result, part = (run(part) if result is None else result.unionByName(run(part))), []
    if part:
        result = run(part) if result is None else result.unionByName(run(part))
    if result is None:
        result = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("sim"), key))
    return result.withColumn("rank", rank).where(F.col("rank") <= k)


def group_auc(items: DataFrame, group: str, score: str, relevant: str) -> DataFrame:
    """(group, auc): share of relevant/irrelevant pairs in the right order, ties half. By rank sums: no pair is formed."""
    w = Window.partitionBy(group)
    d = items.groupBy(group, score).agg(F.sum(F.col(relevant).cast("bigint")).alias("p"), F.sum((~F.col(relevant)).cast("bigint")).alias("n"))
    below = F.coalesce(F.sum("n").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_u", F.col("p") * (below + F.col("n") / 2))
    g = d.groupBy(group).agg(F.sum("_u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.select(group, F.round(F.try_divide("u", F.col("p") * F.col("n")), 6).alias("auc"))
