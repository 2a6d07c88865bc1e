"""Capping the records of dominant contributors.

Quality-weighted reservoir sampling without replacement: every record gets the
exponential key E / w with w = exp(score / temperature), and a contributor keeps
the records of the best keys. The key is held in its logarithm,
score / temperature - ln E, of which the largest are kept; E comes from a hash of
the record's key and the seed, so a lost task gives the same sample again. At
temperature 0 the noise vanishes and the best scores are kept.

Plan: one narrow shuffle on the record key removes repeated deliveries; each
partition then ranks its own rows and keeps only the cap best of each
contributor (Spark's window group limit) before anything moves, so a contributor
with a third of all rows sends at most cap rows a partition, first to salted
groups and then to its own. Caps beyond LOCAL_CAP are ranked by a range sort
over all tasks with counts of the ranges before, so no task gets a whole group.

Defined results: NULL and NaN scores rank equally below every number; ties go
to the smaller key; records without a contributor are never capped; rows with a
NULL key are treated as one record; repeated rows count once (of several scores
or contributors of a key the largest pair counts); an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import SALTS
from weblens.session import cut

#: Largest cap that is ranked partition by partition; Spark's group limit works up to 1000.
LOCAL_CAP = 1000


def reservoir_key(score: Column, key: Column, temperature: float, seed: int) -> Column:
    """score / temperature - ln(E): the logarithm of an exponential key scaled by exp(score / temperature)."""
    if temperature == 0:
        return score
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.coalesce(score, F.lit(0.0)) / F.lit(float(temperature)) - F.log(-F.log(unit))


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `_rank` within `_by` in the given order, for groups of any size; every row is in one range of a sort over all tasks."""
    spread = cut(df.repartitionByRange("_by", *order).sortWithinPartitions("_by", *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("_by", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = Window.partitionBy("_by", "_part").orderBy(*order)
    return spread.withColumn("_rank", F.row_number().over(own)).join(counts.select("_by", "_part", "_before"), ["_by", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))


def cap_contributors(df: DataFrame, contributor: Column, key: str, score: str, cap: int | None = None, share: float | None = None, temperature: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): record keys with `contributor`; each contributor keeps at most cap records and at most share of all records."""
    number = F.when(~F.isnan(F.col(score)), F.col(score)).cast("double")
    rows = df.select(F.col(key).alias("_key"), contributor.alias("_by"), number.alias("_score"))
    rows = rows.groupBy("_key").agg(F.max(F.struct("_by", F.col("_score").isNotNull().alias("_has"), F.coalesce("_score", F.lit(0.0)).alias("_score"))).alias("_r")).select("_key", "_r.*")
    if share is not None:
        most = int(share * rows.count())
        cap = most if cap is None else min(cap, most)
    rows = rows.withColumn("_order", reservoir_key(F.col("_score"), F.col("_key"), temperature, seed))
    order = [F.desc("_has"), F.desc("_order"), F.asc("_key")]
    capped, free = rows.where(F.col("_by").isNotNull()), rows.where(F.col("_by").isNull())
    if cap <= LOCAL_CAP:
        salted = capped.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
        best = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_by", "_salt").orderBy(*order))).where(F.col("_rank") <= cap)
        best = best.withColumn("_rank", F.row_number().over(Window.partitionBy("_by").orderBy(*order))).where(F.col("_rank") <= cap)
    else:
        best = _ranked(capped, order).where(F.col("_rank") <= cap)
    out = lambda x: x.select(F.col("_key").alias(key), F.col("_by").alias("contributor"))
    return out(best).unionByName(out(free)), out(capped.join(best.select("_key"), "_key", "left_anti"))
