"""Polling, throttling, caching and metrics over the event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weblens.operators import state as S
from weblens.session import table


def _events(spark, d):
    """Events with whole seconds since 1970 as `s`."""
    return table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def scan_events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


def watch_changes(spark, d):
    e = _events(spark, d).withColumn("content", F.when(F.col("event_type") != "error", F.col("event_type")))
    return S.changes(e, "user_id", "ts", "event_id", "content").select("event_id", "changed")


def throttle_slots(spark, d):
    return S.throttle_slots(_events(spark, d), "user_id", "s", "event_id", 3600.0).select("event_id", F.round("slot", 3).alias("slot"))


def failure_runs(spark, d):
    return S.failure_runs(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "run")


def two_strikes(spark, d):
    return S.two_strikes(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id")


def rate_window(spark, d):
    e = _events(spark, d).withColumn("sec", F.floor("s").cast("bigint"))
    return S.rate_window(e, "user_id", "sec", {"last_900": 900, "last_day": 86400}).select("event_id", "last_900", "last_day", "wait")


def asof_cache(spark, d):
    e = _events(spark, d).withColumn("sec", F.floor("s").cast("bigint"))
    probes = e.where("event_type = 'view'").select("event_id", "user_id", "sec")
    entries = e.where("event_type = 'purchase'").select("user_id", F.col("sec").alias("created"), F.col("event_id").alias("entry"))
    return S.asof_lookup(probes, entries, "user_id", "sec", "created", "entry", 86400).select("event_id", "hit")


def negative_cache(spark, d):
    """Views that fall within 600 seconds of the user's last error."""
    e = _events(spark, d).withColumn("sec", F.floor("s").cast("bigint"))
    probes = e.where("event_type = 'view'").select("event_id", "user_id", "sec")
    errors = e.where("event_type = 'error'").select("user_id", F.col("sec").alias("created"), F.col("event_id").alias("entry"))
    return S.asof_lookup(probes, errors, "user_id", "sec", "created", "entry", 600).where("hit is not null").select("event_id", "hit")


def cache_purge(spark, d):
    return _events(spark, d).where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("kept"))


def circuit_breaker(spark, d):
    e = _events(spark, d).withColumn("failed", F.col("event_type").isin("error", "click"))
    return S.circuit_breaker(e, "user_id", "s", "event_id", "failed", threshold=3, cooldown=7200.0).select("event_id", "state")


def engine_bench(spark, d):
    e = _events(spark, d).withColumn("answered", F.col("event_type") != "error")
    return S.engine_bench(e, "user_id", "s", "event_id", "answered").select("event_id", F.round("until", 3).alias("until"))


def transcript_paragraphs(spark, d):
    return S.paragraphs(_events(spark, d), "user_id", "s", "event_id", 86400.0).select("event_id", F.round("start", 3).alias("start"))


def stage_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def bounded_labels(spark, d):
    label = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("unknown")
    return table(spark, d, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def cumulative_metrics(spark, d):
    e = table(spark, d, "events")
    return S.running_totals(e, "event_type", F.date_trunc("day", "ts"), ["ts", "event_id"], "value").select("event_id", "n", F.round("total", 4).alias("total"))


def watch_poll(spark, d):
    """Which of a user's events, taken as polls, are due after a day."""
    return S.poll_due(_events(spark, d), "user_id", "s", "event_id", 86400.0).select("event_id", "due")


def watch_poll_stream(spark, d):
    """The same as a stream over the event files."""
    from weblens.streaming import events as E

    schema = table(spark, d, "events").schema
    stream = E.read(spark, f"{d}/events.parquet*", schema)
    return E.run_once(E.poll_due(stream, 86400.0), "polls").select("event_id", "due")


def latency_percentiles(spark, d):
    """Nearest rank over the last 500 values of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, d, "events").withColumn("_n", F.row_number().over(w)).where("_n <= 500")
    g = last.groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("v"))
    at = lambda k: F.get("v", F.least(F.floor(F.size("v") * k), F.size("v") - 1).cast("int"))
    return g.select("event_type", F.size("v").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.array_min("v").alias("low"), F.array_max("v").alias("high"))


def metrics_exposition(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select(F.concat(F.lit('calls_total{tool="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))


def sweep_aggregate(spark, d):
    """Rates, linear percentiles and means, overall and by type."""
    pct = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 1)
    e = table(spark, d, "events")
    return e.rollup("event_type").agg(F.count("*").alias("n"), pct(F.col("value") > 50).alias("over_pct"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95"), F.round(F.avg("value"), 4).alias("mean"))


def cell_aggregate(spark, d):
    e = table(spark, d, "events").withColumn("day", F.dayofweek("ts"))
    return e.cube("event_type", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def flag_findings(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))
    reasons = F.array_compact(F.array(F.when(F.col("errors") * 4 > F.col("n"), "errors"), F.when(F.col("mean") > 50, "slow")))
    return g.select("user_id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def burst_summary(spark, d):
    ok = F.col("event_type") != "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 4).alias("ok_rate"), F.round(F.avg(F.when(ok, F.col("value"))), 4).alias("mean_ok"), F.median("value").alias("median"))


def tool_surface(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("runs"), F.array_sort(F.collect_set("event_type")).alias("types"), F.round(F.max("value"), 4).alias("top"))


def ab_tally(spark, d):
    """Per user the arms side by side, winner by mean; users lacking an arm left out."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.avg("value")).where("view is not null and click is not null")
    return p.select(F.when(F.col("view") > F.col("click"), "view").when(F.col("view") < F.col("click"), "click").otherwise("tie").alias("winner")).groupBy("winner").agg(F.count("*").alias("n"))


def worst_n(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("mean"))
    return g.orderBy(F.desc("errors"), F.desc("mean"), "user_id").limit(10)


def tumbling_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def sliding_counts(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "n")


def session_counts(spark, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "12 hours")
    return table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_seconds("w.start").alias("start_s"), "n")


def batch_deadline(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") > 90, "timeout").when(F.col("event_type") == "error", "fetch_failed").otherwise("ok").alias("outcome"))


def date_range_filter(spark, d):
    a, b = F.lit("2024-01-20"), F.lit("2024-01-05")
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, d, "events").where(day.between(F.least(a, b), F.greatest(a, b))).select("event_id")


def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


_FUNCTIONS = (scan_events, watch_changes, throttle_slots, failure_runs, two_strikes, rate_window, asof_cache, negative_cache, cache_purge, circuit_breaker, engine_bench, transcript_paragraphs, stage_counts, bounded_labels, cumulative_metrics, watch_poll, watch_poll_stream, latency_percentiles, metrics_exposition, sweep_aggregate, cell_aggregate, flag_findings, burst_summary, tool_surface, ab_tally, worst_n, tumbling_counts, sliding_counts, session_counts, batch_deadline, date_range_filter, json_props)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_E = "e AS (SELECT *, epoch_us(ts) / 1e6 AS s, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec FROM events)"
ORACLES = {
    "scan_events": "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events",
    "watch_changes": "WITH c AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS c FROM events) SELECT event_id, coalesce(c <> last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS changed FROM c",
    "throttle_slots": f"WITH RECURSIVE {_E}, n AS (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM e), r AS (SELECT event_id, user_id, n, s AS slot FROM n WHERE n = 1 UNION ALL SELECT n.event_id, n.user_id, n.n, greatest(n.s, r.slot + 3600.0) FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1) SELECT event_id, round(slot, 3) AS slot FROM r",
    "failure_runs": "WITH g AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT event_id, CASE WHEN f THEN sum(CAST(f AS INT)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) ELSE 0 END AS run FROM g",
    "two_strikes": "SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type = 'error' AND p = 'error'",
    "rate_window": f"WITH {_E} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS last_900, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day, min(sec) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) + 900 - sec AS wait FROM e",
    "asof_cache": f"WITH {_E}, p AS (SELECT user_id, sec AS created, max(event_id) AS entry FROM e WHERE event_type = 'purchase' GROUP BY user_id, sec), v AS (SELECT event_id, user_id, sec FROM e WHERE event_type = 'view') SELECT event_id, CASE WHEN sec - created < 86400 THEN entry END AS hit FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.sec >= p.created",
    "negative_cache": f"WITH {_E}, p AS (SELECT user_id, sec AS created, max(event_id) AS entry FROM e WHERE event_type = 'error' GROUP BY user_id, sec), v AS (SELECT event_id, user_id, sec FROM e WHERE event_type = 'view') SELECT event_id, entry AS hit FROM v ASOF JOIN p ON v.user_id = p.user_id AND v.sec >= p.created WHERE sec - created < 600",
    "cache_purge": "SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1",
    "transcript_paragraphs": f"WITH RECURSIVE {_E}, n AS (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM e), r AS (SELECT event_id, user_id, n, s AS a FROM n WHERE n = 1 UNION ALL SELECT n.event_id, n.user_id, n.n, CASE WHEN n.s - r.a >= 86400.0 THEN n.s ELSE r.a END FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1) SELECT event_id, round(a, 3) AS start FROM r",
    "engine_bench": f"WITH RECURSIVE {_E}, n AS (SELECT event_id, user_id, s, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM e), z AS (SELECT DISTINCT user_id FROM e), r AS (SELECT CAST(NULL AS BIGINT) AS event_id, user_id, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS until, 0 AS k FROM z UNION ALL SELECT n.event_id, n.user_id, n.n, CASE WHEN ok THEN 0.0 WHEN r.until <= n.s THEN n.s + least(120.0 * pow(2.0, k), 3600.0) ELSE r.until END, CASE WHEN ok THEN 0 WHEN r.until <= n.s THEN k + 1 ELSE k END FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1) SELECT event_id, round(until, 3) AS until FROM r WHERE n > 0",
    "circuit_breaker": f"WITH RECURSIVE {_E}, n AS (SELECT event_id, user_id, s, event_type IN ('error', 'click') AS f, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM e), z AS (SELECT DISTINCT user_id FROM e), r AS (SELECT CAST(NULL AS BIGINT) AS event_id, user_id, CAST(0 AS BIGINT) AS n, 0 AS fails, CAST(NULL AS DOUBLE) AS opened, 'closed' AS state FROM z UNION ALL SELECT n.event_id, n.user_id, n.n, CASE WHEN opened IS NOT NULL AND n.s - opened < 7200 THEN fails WHEN f THEN fails + 1 ELSE 0 END, CASE WHEN opened IS NOT NULL AND n.s - opened < 7200 THEN opened WHEN f AND fails + 1 >= 3 THEN n.s WHEN f AND opened IS NOT NULL THEN n.s WHEN f THEN opened ELSE NULL END, CASE WHEN opened IS NULL THEN 'closed' WHEN n.s - opened < 7200 THEN 'open' ELSE 'trial' END FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1) SELECT event_id, state FROM r WHERE n > 0",
    "watch_poll": f"WITH RECURSIVE {_E}, n AS (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM e), r AS (SELECT event_id, user_id, n, s AS a, true AS due FROM n WHERE n = 1 UNION ALL SELECT n.event_id, n.user_id, n.n, CASE WHEN n.s - r.a >= 86400.0 THEN n.s ELSE r.a END, n.s - r.a >= 86400.0 FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1) SELECT event_id, due FROM r",
    "watch_poll_stream": f"WITH RECURSIVE {_E}, n AS (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM e), r AS (SELECT event_id, user_id, n, s AS a, true AS due FROM n WHERE n = 1 UNION ALL SELECT n.event_id, n.user_id, n.n, CASE WHEN n.s - r.a >= 86400.0 THEN n.s ELSE r.a END, n.s - r.a >= 86400.0 FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1) SELECT event_id, due FROM r",
    "stage_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "bounded_labels": "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS label, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "cumulative_metrics": "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "latency_percentiles": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), g AS (SELECT event_type, list_sort(list(value)) AS v FROM l WHERE r <= 500 GROUP BY 1) SELECT event_type, len(v) AS n, v[CAST(least(floor(len(v) * 0.5), len(v) - 1) AS INT) + 1] AS p50, v[CAST(least(floor(len(v) * 0.9), len(v) - 1) AS INT) + 1] AS p90, v[CAST(least(floor(len(v) * 0.99), len(v) - 1) AS INT) + 1] AS p99, v[1] AS low, v[len(v)] AS high FROM g",
    "metrics_exposition": """SELECT 'calls_total{tool="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "sweep_aggregate": "SELECT event_type, count(*) AS n, round(100 * count(*) FILTER (WHERE value > 50) / count(*), 1) AS over_pct, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(avg(value), 4) AS mean FROM events GROUP BY ROLLUP (event_type)",
    "cell_aggregate": "SELECT event_type, CAST(dayofweek(ts) + 1 AS INT) AS day, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY CUBE (event_type, 2)",
    "flag_findings": "SELECT user_id, concat_ws(',', CASE WHEN count(*) FILTER (WHERE event_type = 'error') * 4 > count(*) THEN 'errors' END, CASE WHEN avg(value) > 50 THEN 'slow' END) AS reasons FROM events GROUP BY user_id HAVING reasons <> ''",
    "burst_summary": "SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 4) AS ok_rate, round(avg(CASE WHEN event_type <> 'error' THEN value END), 4) AS mean_ok, median(value) AS median FROM events GROUP BY user_id",
    "tool_surface": "SELECT user_id, count(*) AS runs, list_sort(list(DISTINCT event_type)) AS types, round(max(value), 4) AS top FROM events GROUP BY user_id",
    "ab_tally": "WITH p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS v, avg(value) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY user_id) SELECT CASE WHEN v > c THEN 'view' WHEN v < c THEN 'click' ELSE 'tie' END AS winner, count(*) AS n FROM p WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1",
    "worst_n": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS mean FROM events GROUP BY user_id ORDER BY errors DESC, mean DESC, user_id LIMIT 10",
    "tumbling_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_counts": "SELECT start_s, count(*) AS n FROM (SELECT unnest([epoch_us(date_trunc('hour', ts)) // 1000000, epoch_us(date_trunc('hour', ts)) // 1000000 - 3600]) AS start_s FROM events) GROUP BY 1",
    "session_counts": "WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT user_id, min(epoch_us(ts)) // 1000000 AS start_s, count(*) AS n FROM g GROUP BY user_id, g",
    "batch_deadline": "SELECT event_id, CASE WHEN value > 90 THEN 'timeout' WHEN event_type = 'error' THEN 'fetch_failed' ELSE 'ok' END AS outcome FROM events",
    "date_range_filter": "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
}
