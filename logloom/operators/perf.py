"""Latency and throughput tables over run records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from . import metrics
from .ranking import Scan, quantiles

STAGES = ("producer_to_broker", "broker_to_consumer", "engine_update", "scoring", "alert_publish", "total")


def stage_latencies(records: DataFrame) -> DataFrame:
    """(run, session_key, stage, ms): five stages and the total of each live alert, a row each."""
    c = F.col
    broker = c("t_broker_ms") * 1_000_000
    spans = [(c("t_send_ns"), broker), (broker, c("t_recv_ns")), (c("t_recv_ns"), c("t_scored_ns") - c("score_ns")), (F.lit(0), c("score_ns")), (c("t_scored_ns"), c("t_alert_ns")), (c("t_send_ns"), c("t_alert_ns"))]
    live = records.filter(S.is_live(c("alerted"), c("kind"), c("t_broker_ms")))
    each = F.array(*[F.struct(F.lit(n).alias("stage"), S.stage_ms(a, b).alias("ms")) for n, (a, b) in zip(STAGES, spans)])
    return live.select("run", "session_key", F.inline(each))


def series_per_second(samples: DataFrame) -> DataFrame:
    """(run, second, rate_eps, lag, workers): sums over workers, nulls as 0."""
    add = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return samples.groupBy("run", S.second(F.col("ts_ns")).alias("second")).agg(add("rate_eps"), add("lag"), F.count_distinct("worker").alias("workers"))


def busy_rate(series: DataFrame, lag: float = 1000) -> DataFrame:
    """(run, busy_rate): median rate of the seconds with a backlog."""
    return quantiles(series.filter(F.col("lag") > lag), ["run"], "rate_eps", [0.5]).select("run", F.col("q")[0].alias("busy_rate"))


def keeps_up(achieved: Column, offered: Column, drain_s: Column, p99_ms: Column) -> Column:
    return (achieved >= 0.97 * offered) & (drain_s <= 1) & (p99_ms.isNull() | (p99_ms <= 500))


def saturation(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and saturation: the highest offered rate that, like all lower ones, keeps up; null if the lowest does not."""
    ok = keeps_up(*(F.col(c) for c in ("achieved", "offered", "drain_s", "p99_ms")))
    so_far = F.min(ok.cast("int")).over(Window.partitionBy(*by).orderBy("offered").rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_ok", so_far).groupBy(*by).agg(F.max(F.when(F.col("_ok") == 1, F.col("offered"))).alias("saturation"))


def upper_median_saturation(rows: DataFrame, by: list[str]) -> DataFrame:
    """``saturation`` of the upper medians of each rate's repeats; a missing p99 counts as 0."""
    filled = rows.withColumn("p99_ms", F.coalesce("p99_ms", F.lit(0.0)))
    keys = [*by, "offered"]
    medians = [quantiles(filled, keys, c, [0.5]).select(*keys, F.col("above")[0].alias(c)) for c in ("achieved", "drain_s", "p99_ms")]
    return saturation(medians[0].join(medians[1], keys).join(medians[2], keys), by)


def held_over(samples: DataFrame, threshold: float, hold_s: float, cooldown_s: float = 10.0, most: int = 4, start: int = 1) -> DataFrame:
    """(run, t): when a backlog above the threshold has lasted ``hold_s``, at most once a cooldown and up to ``most`` workers.

    Every further worker takes one aggregation, the first held second after the last decision's cooldown.
    """
    steps = Scan(samples.select("run", "t", (F.col("lag") > threshold).alias("_over")), ["run"], ["t"]).lag(_was="_over")
    steps.derive(_since=F.when(F.col("_over") & ~F.coalesce("_was", F.lit(False)), F.col("t"))).running(_since=("max", "_since"))
    held = cut(steps.done().filter(F.col("_over") & (F.col("t") - F.col("_since") >= hold_s)).select("run", "t"))
    taken = []
    for _ in range(most - start):
        left = held if not taken else held.join(taken[-1].select("run", F.col("t").alias("_last")), "run").filter(F.col("t") - F.col("_last") >= cooldown_s)
        taken.append(cut(left.groupBy("run").agg(F.min("t").alias("t"))))
    out = held.limit(0)
    for one in taken:
        out = out.unionByName(one)
    return out.select("run", F.col("t").cast("double").alias("t"))


def recovery_seconds(series: DataFrame, spike_end: str = "spike_end", base: str = "base_lag") -> DataFrame:
    """(run, recovery_s): from the spike's end to the first second from which no backlog exceeds max(1000, base)."""
    rows = Scan(series.filter(F.col("t") >= F.col(spike_end)), ["run"], ["t"]).later(_later=("max", "lag")).done()
    return rows.filter(F.col("_later") <= F.greatest(F.lit(1000.0), F.col(base))).groupBy("run").agg(F.min(F.col("t") - F.col(spike_end)).alias("recovery_s"))


#: A bin of each level is so many times as wide as one of the level below.
STEP = 4


def _level(low: Column, high: Column, width: float) -> Column:
    """The level whose bins a span covers at most ``STEP`` + 1 of."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(STEP), F.greatest((high - low) / (width * STEP), F.lit(1e-9))))).cast("int")


def range_join(points: DataFrame, spans: DataFrame, t: str, low: str, high: str, on: list[str], width: float = 10.0) -> DataFrame:
    """Points inside closed spans of the same ``on``: an equi-join on bins of time, then the exact condition.

    Long spans take wide bins, so that a span of any length makes a few rows; points stand in a bin of each level that spans have.
    """
    leveled = spans.withColumn("_level", _level(F.col(low), F.col(high), width))
    wide = lambda level: width * F.pow(F.lit(float(STEP)), level)
    bins = F.sequence(F.floor(F.col(low) / wide(F.col("_level"))), F.floor(F.col(high) / wide(F.col("_level"))))
    placed = leveled.filter(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect() if r[0] is not None)  # some twenty at most
    each = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col(t) / (width * STEP**k)).alias("_bin")) for k in levels or [0]])
    binned = points.withColumn("_at", F.explode(each)).select(*points.columns, "_at._level", "_at._bin")
    return binned.join(placed, [*on, "_level", "_bin"]).filter((F.col(t) >= F.col(low)) & (F.col(t) <= F.col(high))).drop("_level", "_bin")


def windowed_p99(alerts: DataFrame, segments: DataFrame) -> DataFrame:
    """(run, segment, n, p99): alerts with a latency, and the quantile of it, of those sent in each segment [low, high]."""
    hit = range_join(alerts, segments, "t", "low", "high", ["run"])
    return quantiles(hit, ["run", "segment"], "ms", [0.99]).select("run", "segment", "n", F.col("q")[0].alias("p99"))


def pooled_latency(alerts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n, p50, p95, p99, p99_9 and over_500, the share above 500 ms, over all runs."""
    table = metrics.percentile_table(alerts, by, "ms", (0.5, 0.95, 0.99, 0.999))
    return table.join(alerts.groupBy(*by).agg(F.avg((F.col("ms") > 500).cast("double")).alias("over_500")), by)


def aligned_curve(series: DataFrame, runs: int) -> DataFrame:
    """(offset, median, min, max, n) of the backlog at seconds since each run's start, where max(2, runs // 2) runs have one."""
    starts = series.groupBy("run").agg(F.min("second").alias("_start"))
    rows = series.join(starts, "run").withColumn("offset", F.col("second") - F.col("_start"))
    return metrics.cell_stats(rows, ["offset"], "lag").filter(F.col("n") >= max(2, runs // 2))


def excursions(alerts: DataFrame, slow_ms: float = 300.0, gap_s: float = 1.0) -> DataFrame:
    """(run, nth, low, high, until, n, max_ms): slow alerts (run, t, ms) in clusters of at most ``gap_s`` between them.

    With stages (see ``STAGES``) in columns of those names, also the mean of each over the cluster's alerts, as <stage>_mean.
    """
    steps = Scan(alerts.filter(F.col("ms") >= slow_ms), ["run"], ["t"]).lag(_before="t")
    steps.derive(_new=F.coalesce((F.col("t") - F.col("_before") > gap_s).cast("int"), F.lit(1))).running(nth=("sum", "_new"))
    means = [F.avg(c).alias(f"{c}_mean") for c in STAGES if c in alerts.columns]
    marked = steps.done().withColumn("nth", F.col("nth").cast("int"))
    return marked.groupBy("run", "nth").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max(F.col("t") + F.col("ms") / 1000).alias("until"), F.count("*").alias("n"), F.max("ms").alias("max_ms"), *means)


def interval_features(samples: DataFrame, pauses: DataFrame, spans: DataFrame) -> DataFrame:
    """(run, nth, n, cpu_max, busy_max, freq_min, pause_max) of each span [low, until]: samples within half a second, pauses that overlap."""
    wide = spans.select("run", "nth", "low", "until", (F.col("low") - 0.5).alias("_low"), (F.col("until") + 0.5).alias("_high"))
    near = range_join(samples, wide, "t", "_low", "_high", ["run"]).groupBy("run", "nth").agg(
        F.count("*").alias("n"), F.max("other_cpu").alias("cpu_max"), F.max("busy").alias("busy_max"), F.min("freq").alias("freq_min"))
    # Two spans meet where one of them begins inside the other.
    stops = pauses.select("run", (F.col("t") - F.col("ms") / 1000).alias("_start"), F.col("t").alias("_stop"), "ms")
    begun = range_join(stops, spans.select("run", "nth", "low", "until"), "_start", "low", "until", ["run"]).select("run", "nth", "ms")
    inside = range_join(spans.select("run", "nth", "low"), stops, "low", "_start", "_stop", ["run"]).select("run", "nth", "ms")
    hit = begun.unionByName(inside).groupBy("run", "nth").agg(F.max("ms").alias("pause_max"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return spans.select("run", "nth").join(near, ["run", "nth"], "left").join(hit, ["run", "nth"], "left").select("run", "nth", F.coalesce("n", F.lit(0)).alias("n"), *map(zero, ("cpu_max", "busy_max", "freq_min", "pause_max")))


#: Bins that a row is exploded to at a time.
BLOCK = 10_000


def normal_bins(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """(run, t): one-second bins [t, t + 1] from a second after each run's start to its end that touch no span [low, until].

    Runs are first cut into blocks of bins, which are dealt out, so that a long run is not one task's.
    """
    n = F.floor(F.col("end") - F.col("start")).cast("long")
    blocks = runs.withColumn("_n", n).filter("_n >= 1").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / BLOCK)))).repartition("run", "_block")
    k = F.explode(F.sequence(F.greatest(F.lit(1), F.col("_block") * BLOCK), F.least(F.col("_n"), F.col("_block") * BLOCK + BLOCK - 1)))
    bins = blocks.withColumn("k", k).filter(F.col("start") + F.col("k") + 1 <= F.col("end")).select("run", (F.col("start") + F.col("k")).alias("t"))
    taken = range_join(bins, spans.select("run", (F.col("low") - 1).alias("_low"), "until"), "t", "_low", "until", ["run"]).select("run", "t").distinct()
    return bins.join(taken, ["run", "t"], "left_anti")


def compare_windows(normal: DataFrame, slow: DataFrame, features: list[str]) -> DataFrame:
    """(feature, p50, p95, p99, slow_median, slow_max): a row per feature."""
    long = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])))
    a = metrics.percentile_table(long(normal), ["feature"], "v").drop("n")
    b = quantiles(long(slow), ["feature"], "v", [0.5]).select("feature", F.col("q")[0].alias("slow_median"), F.col("high").alias("slow_max"))
    return a.join(b, "feature", "full")


def overlap_shares(normal: DataFrame, slow: DataFrame, pause: str = "pause_max") -> DataFrame:
    """(slow, slow_paused, slow_share, normal, normal_paused, normal_share): windows of either sort that overlap a pause; one row, null shares of none."""
    def share(rows: DataFrame, name: str) -> DataFrame:
        n, hit = F.count("*"), F.coalesce(F.sum((F.col(pause) > 0).cast("long")), F.lit(0))
        return rows.agg(n.alias(name), hit.alias(f"{name}_paused"), F.when(n > 0, hit / n).alias(f"{name}_share"))

    return share(slow, "slow").crossJoin(share(normal, "normal"))


def good_runs(runs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Complete and warm runs that are not excluded."""
    return runs.filter(F.col("complete") & ~F.col("cold")).join(excluded, "run", "left_anti")


def merge_runs(original: DataFrame, repeats: DataFrame) -> DataFrame:
    return original.unionByName(repeats, allowMissingColumns=True)


def against_baseline(rows: DataFrame, by: list[str], value: str, baseline: Column) -> DataFrame:
    """``by``, median, min, max, n and ratio of each cell's median to the baseline cell's."""
    cells = metrics.cell_stats(rows, by, value)
    base = quantiles(rows.filter(baseline), [], value, [0.5]).select(F.col("q")[0].alias("_base"))  # one row
    return cells.crossJoin(base).withColumn("ratio", F.when(F.col("_base") != 0, F.col("median") / F.col("_base"))).drop("_base")


def scaling(rows: DataFrame, value: str, workers: str = "workers") -> DataFrame:
    """(workers, median, min, max, n, speedup, efficiency) against one worker."""
    out = against_baseline(rows, [workers], value, F.col(workers) == 1).withColumnRenamed("ratio", "speedup")
    return out.withColumn("efficiency", F.col("speedup") / F.col(workers))


def alert_analysis(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """(live_alerts, sessions, true_alarms, false_alarms, p50, p95, p99): a session without a label is a false alarm; latencies of incremental alerts."""
    live = alerts.filter(F.col("kind") != "deadline_eos")
    sessions = live.select("session_key").distinct().join(labels, F.col("session_key") == F.col("session_id"), "left")
    counts = sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("true_alarms")).withColumn("false_alarms", F.col("sessions") - F.col("true_alarms"))
    p = quantiles(live.filter("kind = 'incremental'"), [], "ms", [0.5, 0.95, 0.99]).select(F.col("q").alias("_p"))
    n = live.agg(F.count("*").alias("live_alerts"))
    return n.crossJoin(counts).crossJoin(p).select("live_alerts", "sessions", "true_alarms", "false_alarms", *[F.col("_p")[k].alias(x) for k, x in enumerate(("p50", "p95", "p99"))])  # one row each


def side_by_side(a: DataFrame, b: DataFrame, on: str = "rate") -> DataFrame:
    """Cells at the rates that both engines ran."""
    rest = lambda df, tag: df.select(on, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c != on])
    return rest(a, "a").join(rest(b, "b"), on)


def counter_utilisation(samples: DataFrame) -> DataFrame:
    """``samples`` (run, core, t, busy, total) with util, busy over total since the core's last sample; 0 if no time has passed."""
    rows = Scan(samples, ["run", "core"], ["t"]).lag(_busy="busy", _total="total").done()
    busy, total = F.col("busy") - F.col("_busy"), F.col("total") - F.col("_total")
    return rows.withColumn("util", F.when(total.isNull(), F.lit(None)).when(total > 0, busy / total).otherwise(0.0)).drop("_busy", "_total")


def plan_segments(rate: float, seconds: float, spike: float | None = None) -> list[tuple[str, int]]:
    """Events of each segment of a run: one steady segment, or 40 % before, 20 % at ``spike`` times the rate, 40 % after."""
    if spike is None:
        return [("steady", round(rate * seconds))]
    parts = (("before", 0.4, 1), ("spike", 0.2, spike), ("after", 0.4, 1))
    return [(name, round(rate * factor * seconds * share)) for name, share, factor in parts]


def assign_segments(rows: DataFrame, segments: list[tuple[str, int]], at: str = "at") -> DataFrame:
    """``rows`` with segment, by their place from 0 in the order of sending; rows beyond the plan are left out."""
    end, name = 0, F.lit(None).cast("string")
    bounds = []
    for segment, n in segments:
        end += n
        bounds.append((segment, end))
    for segment, stop in reversed(bounds):
        name = F.when(F.col(at) < stop, segment).otherwise(name)
    return rows.withColumn("segment", name).filter(F.col("segment").isNotNull())


def total_lag(samples: DataFrame, now_ns: Column, fresh_s: float = 3.0) -> DataFrame:
    """(run, lag): the newest sample of each worker, if fresh, summed; nulls as 0."""
    last = samples.groupBy("run", "worker").agg(F.max_by("lag", "ts_ns").alias("lag"), F.max("ts_ns").alias("ts_ns"))
    return last.filter(F.col("ts_ns") >= now_ns - int(fresh_s * 1e9)).groupBy("run").agg(F.sum(F.coalesce("lag", F.lit(0))).alias("lag"))


def run_rollup(records: DataFrame) -> DataFrame:
    """(run, consumed, sent, span_s, rate, drain_s, complete, n_<kind>): one pass over per-event records."""
    span = (F.max("t_recv_ns") - F.min("t_recv_ns")) / 1e9
    kinds = [F.sum((F.col("alerted") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in ("incremental", "deadline", "deadline_eos")]
    out = records.groupBy("run").agg(F.count("t_recv_ns").alias("consumed"), F.count("t_send_ns").alias("sent"), span.alias("span_s"), ((F.max("t_recv_ns") - F.max("t_send_ns")) / 1e9).alias("drain_s"), *kinds)
    return out.withColumns({"rate": F.when(F.col("span_s") > 0, F.col("consumed") / F.col("span_s")), "complete": F.col("consumed") == F.col("sent")})
