"""The alert, metric and model store: inserts, lifecycle and queries on snapshots held as DataFrames."""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import quantiles

# The moves that an alert's status may make.
MOVES = {"open": ["acknowledged", "resolved", "false_positive"], "acknowledged": ["open", "resolved", "false_positive"], "resolved": ["open"], "false_positive": ["open"]}
RETENTION_NS = 6 * 3600 * 1_000_000_000


def insert_alerts(store: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The rows of ``batch`` to append: the first of each (run, session_key) that the store lacks, with ingest_lag_ms."""
    first = Window.partitionBy("run", "session_key").orderBy(arrival)
    fresh = batch.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn").join(store.select("run", "session_key"), ["run", "session_key"], "left_anti")
    sent = F.nullif(F.col("t_send_ns"), F.lit(0))
    return fresh.withColumn("ingest_lag_ms", (F.col("ingested_ns") - sent) / 1e6)


def insert_metrics(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The new snapshot: both together, without samples older than six hours before the newest."""
    both = store.unionByName(batch)
    newest = both.agg(F.max("ts_ns").alias("newest"))
    return both.crossJoin(F.broadcast(newest)).filter(F.col("ts_ns") >= F.col("newest") - RETENTION_NS).drop("newest")  # one row


def list_alerts(alerts: DataFrame, where: Column | None = None, after: int | None = None, ascending: bool = False, limit: int = 100) -> tuple[DataFrame, int | None]:
    """A page of at most 500 rows by id, and the cursor of the next if the page is full and ascending."""
    limit = max(1, min(500, limit))
    rows = alerts if where is None else alerts.filter(where)
    rows = rows if after is None else rows.filter(F.col("id") > after)
    page = rows.orderBy(F.asc("id") if ascending else F.desc("id")).limit(limit)
    if not ascending:
        return page, None
    last = page.agg(F.count("*"), F.max("id")).first()
    return page, last[1] if last[0] == limit else None


def with_trail(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """``alerts`` with trail, their status changes in order."""
    trail = events.groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("ts_ns", "from_status", "to_status", "actor", "note"))).alias("trail"))
    return alerts.join(trail, alerts.id == trail.alert_id, "left").drop("alert_id")


def change_status(alerts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts after it, audit rows, rejected commands) for ``commands`` (alert_id, to_status, actor, note, ts_ns), one for each alert."""
    pairs = [(a, b) for a, to in MOVES.items() for b in to]
    moves = alerts.sparkSession.createDataFrame(pairs, "from_status string, to_status string")
    asked = commands.join(alerts.select(F.col("id").alias("alert_id"), F.col("status").alias("from_status")), "alert_id", "left")
    valid = asked.join(F.broadcast(moves), ["from_status", "to_status"], "left_semi")
    rejected = asked.join(F.broadcast(moves), ["from_status", "to_status"], "left_anti")
    done = valid.select(F.col("alert_id").alias("id"), F.col("to_status").alias("_to"), F.nullif(F.trim("note"), F.lit("")).alias("_note"))
    after = alerts.join(done, "id", "left").withColumn("status", F.coalesce("_to", "status"))
    if "note" in alerts.columns:
        after = after.withColumn("note", F.coalesce("_note", "note"))
    return after.drop("_to", "_note"), valid.select("alert_id", "ts_ns", "from_status", "to_status", "actor", "note"), rejected.select("alert_id", "ts_ns", "from_status", "to_status", "actor", "note")


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and upper_median: the value at index n // 2 of the sorted ones, nulls left out."""
    return quantiles(rows.filter(F.col(value).isNotNull()), by, value, [0.5]).select(*by, F.col("above")[0].alias("upper_median"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """(dimension, item, n): alerts in all and by status, kind and run, in one pass."""
    sets = alerts.groupingSets([[F.col("status")], [F.col("kind")], [F.col("run")], []], F.col("status"), F.col("kind"), F.col("run"))
    grouped = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "kind").when(F.col("g") == 6, "run").otherwise("total")
    return grouped.select(name.alias("dimension"), F.coalesce("status", "kind", "run", F.lit("all")).alias("item"), "n")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """(fp_share): false positives among triaged alerts, 0 if none is."""
    fp, done = (F.sum(F.col("status").isin(x).cast("long")) for x in (["false_positive"], ["false_positive", "resolved"]))
    return alerts.agg(F.when(done > 0, fp / done).otherwise(0.0).alias("fp_share"))


def metric_series(samples: DataFrame, run: str | None = None, newest: int = 600) -> DataFrame:
    """Per second over all workers: sums of rates and backlogs, maxima of percentiles and watermarks; the newest, ascending."""
    rows = samples if run is None else samples.filter(F.col("run") == run)
    sums, most = ("rate_eps", "lag", "open_sessions", "alerts"), ("p95_ms", "p99_ms", "watermark")
    grouped = rows.groupBy(S.second(F.col("ts_ns")).alias("second")).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])
    return grouped.orderBy(F.desc("second")).limit(newest).orderBy("second")


def latest_watermark(samples: DataFrame, now_ns: Column, max_age_s: float = 15.0) -> DataFrame:
    return samples.filter(F.col("ts_ns") >= now_ns - int(max_age_s * 1e9)).agg(F.max("watermark").alias("watermark"))


def score_histogram(alerts: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, low, n): equal bins of score over threshold, the last one closed; width 1 if all are equal; no rows without alerts."""
    ratios = alerts.select(S.score_ratio(F.col("score"), F.col("threshold")).alias("r")).filter("r is not null")
    span = ratios.agg(F.min("r").alias("low"), ((F.max("r") - F.min("r")) / bins).alias("width")).withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(1.0))
    placed = ratios.crossJoin(F.broadcast(span)).groupBy(F.least(F.lit(bins - 1), F.floor((F.col("r") - F.col("low")) / F.col("width"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # span: one row
    every = span.filter("low is not null").select("low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(placed, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def injection_results(injections: DataFrame, alerts: DataFrame) -> DataFrame:
    """(id, scenario, injected, detected, p50_ms, max_ms): upper median and longest time from an injection to its alerts."""
    keys = injections.select("id", "run", "t_ns", F.explode("keys").alias("session_key"))
    hits = keys.join(alerts.select("run", "session_key", "created_ns"), ["run", "session_key"]).withColumn("ms", (F.col("created_ns") - F.col("t_ns")) / 1e6)
    found = hits.groupBy("id").agg(F.count("*").alias("detected"), F.max("ms").alias("max_ms"))
    out = injections.select("id", "scenario", F.size("keys").alias("injected")).join(found, "id", "left").join(upper_median(hits, ["id"], "ms").withColumnRenamed("upper_median", "p50_ms"), "id", "left")
    return out.select("id", "scenario", "injected", F.coalesce("detected", F.lit(0)).alias("detected"), "p50_ms", "max_ms")


def register_models(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``registry`` and ``new`` (name, order, ..) with the next versions of their names, as registered."""
    last = registry.groupBy("name").agg(F.max("version").alias("last"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("nth"))
    added = new.withColumn("_k", nth).join(last, "name", "left").withColumn("version", (F.coalesce("last", F.lit(0)) + F.col("_k")).cast("int")).withColumn("status", F.lit("registered")).drop("_k", "last", "nth")
    return registry.unionByName(added, allowMissingColumns=True)


def activate_model(registry: DataFrame, name: str, version: int) -> DataFrame:
    """Exactly one active model for the model's dataset; the one before is registered again."""
    chosen = (F.col("name") == name) & (F.col("version") == version)
    dataset = registry.filter(chosen).select(F.col("dataset").alias("_dataset")).limit(1)
    return registry.join(F.broadcast(dataset), F.col("dataset") == F.col("_dataset"), "left").withColumn(
        "status", F.when(chosen, "active").when(F.col("_dataset").isNotNull() & (F.col("status") == "active"), "registered").otherwise(F.col("status"))).drop("_dataset")


def active_model(registry: DataFrame, dataset: str) -> DataFrame:
    return registry.filter((F.col("dataset") == dataset) & (F.col("status") == "active"))


def promote(source: DataFrame, target: DataFrame, name: str, version: int, activate: bool = False) -> DataFrame:
    """``target`` with a copy of one of ``source``'s models, as its next version."""
    row = source.filter((F.col("name") == name) & (F.col("version") == version)).drop("version", "status").withColumn("nth", F.lit(1))
    out = register_models(target, row)
    if activate:
        newest = out.filter(F.col("name") == name).agg(F.max("version")).first()[0]
        out = activate_model(out, name, newest)
    return out


# Fixed value: what a caller may change of a run.
RUN_COLUMNS = ("status", "summary", "model_id", "pid")


def update_run(runs: DataFrame, run: str, now_ns: int, **changes: object) -> DataFrame:
    """``runs`` with columns of one run set, and its updated_ns; only ``RUN_COLUMNS`` may change. A summary is kept as JSON."""
    if bad := set(changes) - {*RUN_COLUMNS}:
        raise KeyError(f"no such run column to update: {sorted(bad)}")
    plain = {c: json.dumps(v) if c == "summary" and v is not None else v for c, v in changes.items()} | {"updated_ns": now_ns}
    hit = F.col("id") == run
    return runs.withColumns({c: F.when(hit, F.lit(v).cast(runs.schema[c].dataType)).otherwise(F.col(c)) for c, v in plain.items()})


def list_runs(runs: DataFrame, kind: str | None = None) -> DataFrame:
    """Runs, of one kind if given, the newest first; of equal times the greater id."""
    return (runs if kind is None else runs.filter(F.col("kind") == kind)).orderBy(F.desc("created_ns"), F.desc("id"))


def list_models(registry: DataFrame, dataset: str | None = None) -> DataFrame:
    """Registered models, of one dataset if given, by name and version."""
    return (registry if dataset is None else registry.filter(F.col("dataset") == dataset)).orderBy("name", "version")


def to_delete(rows: DataFrame, keep_newest: int | None = None, older_than_ns: int | None = None, ids: list | None = None, protected: Column | None = None, created: str = "created_ns") -> DataFrame:
    """The rows to delete: by id, beyond the newest so many, or before a time; never protected ones."""
    wanted, place = F.lit(False), F.struct(created, "id")
    if ids is not None:
        wanted = wanted | F.col("id").isin(ids)
    if keep_newest is not None:
        # One row: the oldest of those that stay, if there are so many.
        edge = rows.select(place.alias("_place")).orderBy(F.desc("_place")).limit(keep_newest).agg(F.count("*").alias("_n"), F.min("_place").alias("_edge"))
        rows = rows.crossJoin(F.broadcast(edge))
        wanted = wanted | (F.col("_n") == keep_newest) & F.coalesce(place < F.col("_edge"), F.lit(keep_newest == 0))
    if older_than_ns is not None:
        wanted = wanted | (F.col(created) < older_than_ns)
    return rows.filter(wanted if protected is None else wanted & ~protected).drop("_n", "_edge")


def delete_with(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is among ``gone``: deletion that cascades."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def false_positive_keys(alerts: DataFrame, run: str | None = None) -> DataFrame:
    rows = alerts.filter("status = 'false_positive'")
    return (rows if run is None else rows.filter(F.col("run") == run)).select("session_key").distinct()


def fold_feedback(sessions: DataFrame, keys: DataFrame, least: int = 10) -> tuple[DataFrame, int, int]:
    """(``sessions`` with matched ones as normal train sessions, matched, unmatched); unchanged below ``least`` matches."""
    matched = sessions.join(keys.withColumnRenamed("session_key", "session_id"), "session_id", "left_semi").count()
    total = keys.count()
    if matched < least:
        return sessions, matched, total - matched
    marked = sessions.join(keys.select(F.col("session_key").alias("session_id"), F.lit(True).alias("_fp")), "session_id", "left")
    return marked.withColumn("split", F.when(F.col("_fp"), "train").otherwise(F.col("split"))).drop("_fp"), matched, total - matched
