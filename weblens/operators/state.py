"""State machines of polling, throttling and caching as window functions over event rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def changes(polls: DataFrame, key: str, ts: str, order: str, content: str) -> DataFrame:
    """`changed`: the content's hash differs from the last known one; the first is a baseline, NULL content (an error) keeps the last."""
    h = F.sha2(F.col(content), 256)
    past = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    d = polls.withColumn("_h", F.when(F.col(content).isNotNull(), h))
    return d.withColumn("_last", F.last("_h", ignorenulls=True).over(past)).withColumn("changed", F.coalesce(F.col("_last").isNotNull() & F.col("_h").isNotNull() & (F.col("_h") != F.col("_last")), F.lit(False))).drop("_h", "_last")


def throttle_slots(requests: DataFrame, key: str, seconds: str, order: str, interval: float) -> DataFrame:
    """`slot`: the time a request may go, slot = max(now, last slot + interval); closed form: a running maximum of now - n * interval, plus n * interval."""
    w = Window.partitionBy(key).orderBy(seconds, order)
    n = F.row_number().over(w) - 1
    d = requests.withColumn("_n", n)
    return d.withColumn("slot", F.max(F.col(seconds) - F.col("_n") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * interval).drop("_n")


def failure_runs(calls: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """`run`: consecutive failures up to and with this row; 0 on success."""
    w = Window.partitionBy(key).orderBy(*order)
    d = calls.withColumn("_f", failed).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("run", F.when(F.col("_f"), run).otherwise(0)).drop("_f", "_g")


def two_strikes(runs: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Rows where this and the run before failed."""
    d = runs.withColumn("_f", failed).withColumn("_before", F.lag("_f").over(Window.partitionBy(key).orderBy(*order)))
    return d.where(F.col("_f") & F.col("_before")).drop("_f", "_before")


def rate_window(calls: DataFrame, key: str, seconds: str, spans: dict[str, int]) -> DataFrame:
    """A count for each trailing span of seconds, the row itself included, and the wait until the oldest in the first span leaves."""
    for name, span in spans.items():
        calls = calls.withColumn(name, F.count("*").over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-span, 0)))
    first = next(iter(spans.values()))
    return calls.withColumn("wait", F.min(seconds).over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-first, 0)) + first - F.col(seconds))


def asof_lookup(probes: DataFrame, entries: DataFrame, key: str, at: str, created: str, value: str, ttl: float) -> DataFrame:
    """probes with the newest entry created at or before the probe, if younger than ttl (a miss at exactly ttl).

    Both sides go through one window by key and time, so nothing is joined on a
    range. Keys whose history is long are still read in order by one task: the
    history of a single key.
    """
    a = probes.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"), F.lit(None).cast(entries.schema[value].dataType).alias("_v"), F.lit(None).cast(entries.schema[created].dataType).alias("_c"))
    b = entries.select(F.col(key).alias("_k"), F.col(created).alias("_t"), F.lit(0).alias("_probe"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.col(created).alias("_c"))
    w = Window.partitionBy("_k").orderBy("_t", "_probe", F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionByName(b).withColumn("_last", F.last(F.when(F.col("_probe") == 0, F.struct("_v", "_c")), ignorenulls=True).over(w)).where("_probe = 1")
    fresh = F.col("_t") - F.col("_last._c") < ttl
    return d.select("_row.*", F.when(fresh, F.col("_last._v")).alias("hit"))


def fold(df: DataFrame, key: str, order: list[str], columns: list[str], start, step, name: str, kind: T.DataType) -> DataFrame:
    """One value a row from a state machine over each key's rows in order: step(state, row) gives (state, value).

    Rows come sorted in Arrow batches and only the state is carried on, so a key's
    history need not fit into memory. Rows without a key are left out.
    """
    names = list(dict.fromkeys([key, *order, *columns]))
    schema = T.StructType([*[df.schema[n] for n in (key, *order)], T.StructField(name, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, met = None, None, False
        for b in batches:
            values = []
            for row in zip(*[b[n].tolist() for n in names]):
                r = dict(zip(names, row))
                if not met or r[key] != own:
                    own, state, met = r[key], start(), True
                state, value = step(state, r)
                values.append(value)
            yield b[[key, *order]].assign(**{name: values})

    return df.where(F.col(key).isNotNull()).select(*names).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def circuit_breaker(calls: DataFrame, key: str, seconds: str, order: str, failed: str, threshold: int = 5, cooldown: float = 60.0) -> DataFrame:
    """`state` met by each call: closed, open (refused; the outcome does not count) or trial (the one call after the cooldown)."""

    def step(state, r):
        failures, opened = state
        now = r[seconds]
        if opened is not None and now - opened < cooldown:
            return state, "open"
        met, opened = ("closed", None) if opened is None else ("trial", now)
        if not r[failed]:
            return (0, None), met
        return (failures + 1, now if failures + 1 >= threshold else opened), met

    return fold(calls, key, [seconds, order], [failed], lambda: (0, None), step, "state", T.StringType())


def engine_bench(reports: DataFrame, key: str, seconds: str, order: str, answered: str, base: float = 120.0, most: float = 3600.0) -> DataFrame:
    """`until`: when a benched engine may be used again: base * 2^strikes, at most `most`; not raised while benched; an answer clears it."""

    def step(state, r):
        strikes, until = state
        if r[answered]:
            return (0, 0.0), 0.0
        if until > r[seconds]:
            return state, float(until)
        until = float(r[seconds] + min(base * 2.0**strikes, most))
        return (strikes + 1, until), until

    return fold(reports, key, [seconds, order], [answered], lambda: (0, 0.0), step, "until", T.DoubleType())


def paragraphs(cues: DataFrame, key: str, seconds: str, order: str, span: float = 30.0) -> DataFrame:
    """`start`: anchored grouping; a paragraph begins with the first cue at least `span` after the last paragraph's first cue."""

    def step(anchor, r):
        anchor = r[seconds] if anchor is None or r[seconds] - anchor >= span else anchor
        return anchor, float(anchor)

    return fold(cues, key, [seconds, order], [], lambda: None, step, "start", T.DoubleType())


def poll_due(checks: DataFrame, key: str, seconds: str, order: str, interval: float) -> DataFrame:
    """`due`: a watch never checked, or last checked at least `interval` seconds before; a due check always moves that time on."""

    def step(last, r):
        due = last is None or r[seconds] - last >= interval
        return (r[seconds] if due else last), due

    return fold(checks, key, [seconds, order], [], lambda: None, step, "due", T.BooleanType())


def running_totals(rows: DataFrame, key: str, bucket: Column, order: list[str], value: str) -> DataFrame:
    """rows with `n` and `total`, count and sum of the key's rows up to this one.

    Rows are summed within buckets of the order (bucket must grow with it), and
    the buckets' sums before are added, so no task gets all rows of a hot key.
    """
    d = rows.withColumn("_bucket", bucket)
    sums = d.groupBy(F.col(key).alias("_k"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_sum").over(before).alias("_s0"))
    own = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_n1": F.count("*").over(own), "_s1": F.sum(value).over(own)})
    d = d.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    total = F.when(F.col("_s0").isNull(), F.col("_s1")).otherwise(F.col("_s0") + F.coalesce("_s1", F.lit(0.0)))
    return d.withColumns({"n": F.col("_n0") + F.col("_n1"), "total": total}).drop("_bucket", "_k", "_b", "_n0", "_s0", "_n1", "_s1")


def previous(rows: DataFrame, key: str, seconds: str, span: int) -> DataFrame:
    """rows (key, whole seconds; distinct) with `previous`, the time before in the key's order: within spans of so many seconds, and for the first of a span the last time of the span before; no task gets all rows of a hot key."""
    d = rows.withColumn("_span", F.floor(F.col(seconds) / span))
    lasts = d.groupBy(F.col(key).alias("_k"), F.col("_span").alias("_p")).agg(F.max(seconds).alias("_last"))
    lasts = lasts.withColumn("_last", F.lag("_last").over(Window.partitionBy("_k").orderBy("_p")))
    d = d.withColumn("_own", F.lag(seconds).over(Window.partitionBy(key, "_span").orderBy(seconds)))
    d = d.join(lasts, (F.col(key) == F.col("_k")) & (F.col("_span") == F.col("_p")))
    return d.withColumn("previous", F.coalesce("_own", "_last")).drop("_span", "_k", "_p", "_last", "_own")
