"""Thresholds, ranking metrics and evaluation tables over scores (s DOUBLE) and labels (y INT 0/1)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranking import quantiles, with_rank

INFINITY = float("inf")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def percentile_threshold(scores: DataFrame, q: float = 0.99, s: str = "s") -> DataFrame:
    """(threshold): linear between ranks."""
    return quantiles(scores, [], s, [q]).select(F.col("q")[0].alias("threshold"))


def three_sigma(scores: DataFrame, s: str = "s") -> DataFrame:
    """(threshold): mean and three population deviations."""
    return scores.agg((F.avg(s) + 3 * F.stddev_pop(s)).alias("threshold"))


def curve(scores: DataFrame, s: str = "s", y: str = "y") -> DataFrame:
    """(threshold, rank, tp, fp, tp_before, fp_before, p, n): a row per distinct score, descending, for the rule score >= threshold."""
    grouped = scores.groupBy(F.col(s).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("all")).withColumn("neg", F.col("all") - F.col("pos"))
    grouped = cut(grouped)
    totals = grouped.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"), F.count("*").alias("thresholds"))
    ranked = with_rank(grouped, F.desc("threshold"), rank="rank", sums={"tp": "pos", "fp": "neg"})
    return ranked.crossJoin(F.broadcast(totals)).select("threshold", "rank", "tp", "fp", (F.col("tp") - F.col("pos")).alias("tp_before"), (F.col("fp") - F.col("neg")).alias("fp_before"), "p", "n", "thresholds")  # totals: one row


def best_threshold(scores: DataFrame, s: str = "s", y: str = "y") -> DataFrame:
    """(threshold, f1): the best F1 of score >= threshold, ties to the lowest threshold; infinity and 0 without positives."""
    points = curve(scores, s, y).select("threshold", f1(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp")).alias("f1"), "p")
    best = points.filter("p > 0").agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))
    return best.select(F.coalesce("threshold", F.lit(INFINITY)).alias("threshold"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def sampled_curve(scores: DataFrame, points: int = 200, s: str = "s", y: str = "y") -> DataFrame:
    """(threshold, precision, recall) at no more than ``points`` thresholds, evenly by index in ascending order."""
    at = F.col("thresholds") - 1 - F.col("rank")
    n = F.least(F.col("thresholds"), F.lit(points))
    # Index at is among floor(k (thresholds - 1) / (n - 1)) for k = 0 .. n - 1.
    k = F.ceil(at * (n - 1) / F.greatest(F.col("thresholds") - 1, F.lit(1)))
    keep = F.floor(k * (F.col("thresholds") - 1) / F.greatest(n - 1, F.lit(1))) == at
    return curve(scores, s, y).filter(keep).select("threshold", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("p")).alias("recall"))


def ranking_metrics(scores: DataFrame, s: str = "s", y: str = "y") -> DataFrame:
    """(roc_auc, average_precision): ties count half; average precision sums recall steps; NaN if a class is missing."""
    c = curve(scores, s, y)
    area = (F.col("fp") - F.col("fp_before")) * (F.col("tp") + F.col("tp_before")) / 2
    steps = (F.col("tp") - F.col("tp_before")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    both = (F.max("p") > 0) & (F.max("n") > 0)
    return c.agg(F.when(both, F.sum(area) / (F.max("p") * F.max("n"))).otherwise(float("nan")).alias("roc_auc"), F.when(both, F.sum(steps) / F.max("p")).otherwise(float("nan")).alias("average_precision"))


def confusion(scores: DataFrame, flag: Column, y: str = "y", by: list[str] | None = None) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1) of a boolean flag, for each group of ``by``; 0 on empty denominators."""
    yes, true = F.coalesce(flag, F.lit(False)), F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    counts = scores.groupBy(*(by or [])).agg(n(yes & true).alias("tp"), n(yes & ~true).alias("fp"), n(~yes & true).alias("fn"), n(~yes & ~true).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": f1(tp, fp, fn)})


def union_rule(scores: DataFrame, inc: str = "inc", snap: str = "snap", y: str = "y", candidates: int | None = 400) -> DataFrame:
    """(threshold, f1): the best F1 of ``inc`` or snap >= threshold over every max(1, n // candidates)-th distinct score, over all without ``candidates``; ties to the first."""
    base = scores.agg(F.sum((F.col(inc) & (F.col(y) == 1)).cast("long")).alias("tp0"), F.sum((F.col(inc) & (F.col(y) == 0)).cast("long")).alias("fp0"), F.sum((F.col(y) == 1).cast("long")).alias("p0"))
    free = scores.withColumn("_y", F.when(F.col(inc), F.lit(0)).otherwise(F.col(y))).withColumn("_w", (~F.col(inc)).cast("long"))
    grouped = cut(free.groupBy(F.col(snap).alias("threshold")).agg(F.sum((F.col("_y") * F.col("_w")).cast("long")).alias("pos"), F.sum(((1 - F.col("_y")) * F.col("_w")).cast("long")).alias("neg")))
    ranked = with_rank(grouped, F.desc("threshold"), rank="rank", total="n", sums={"tp": "pos", "fp": "neg"})
    ascending = F.col("n") - 1 - F.col("rank")
    step = F.lit(1) if candidates is None else F.greatest(F.lit(1), F.floor(F.col("n") / candidates))
    tried = ranked.filter(F.pmod(ascending, step) == 0).crossJoin(F.broadcast(base))  # base: one row
    tp, fp = F.col("tp") + F.col("tp0"), F.col("fp") + F.col("fp0")
    scored = tried.select("threshold", f1(tp, fp, F.col("p0") - tp).alias("f1"))
    return scored.agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def seed_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, mean and population deviation over seeds; no deviation for a single one."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_pop(value)).alias("std"))


def cell_rows(cells: DataFrame) -> DataFrame:
    """A row for each run and threshold rule of ``cells`` (.., runs ARRAY<STRUCT<seed, thresholds MAP<STRING, DOUBLE>, oracle DOUBLE>>), and one for the oracle."""
    rest = [c for c in cells.columns if c != "runs"]
    runs = cells.select(*rest, F.explode("runs").alias("run"))
    rules = runs.select(*rest, "run.seed", F.explode("run.thresholds").alias("rule", "f1"))
    return rules.unionByName(runs.select(*rest, "run.seed", F.lit("oracle").alias("rule"), F.col("run.oracle").alias("f1")))


def pivot_by(rows: DataFrame, by: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Mean of ``value``, a column for each of ``values``."""
    return rows.groupBy(*by).pivot(column, values).agg(F.avg(value))


def prevalence(rows: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """``by``, prevalence and degenerate_f1, the F1 of flagging everything."""
    p = F.col("prevalence")
    return rows.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("prevalence")).withColumn("degenerate_f1", 2 * p / (1 + p))


def cell_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, median, min, max and n of the values that are not null."""
    return quantiles(rows, by, value, [0.5]).select(*by, F.col("q")[0].alias("median"), F.col("low").alias("min"), F.col("high").alias("max"), "n")


def percentile_table(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``by``, n and one column for each percentile, p50 p95 p99 p99_9; null where there is no value."""
    return quantiles(rows, by, value, points).select(*by, "n", *[F.col("q")[k].alias(f"p{100 * x:g}".replace(".", "_")) for k, x in enumerate(points)])


def pick_first(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in ``order``: model selection by any rule."""
    best = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def shortest_age(rows: DataFrame, reference_f1: float, slack: float = 0.01) -> DataFrame:
    """The row (.., age, val_f1) of the shortest age whose F1 is at most ``slack`` below the reference, ties to the best F1; none if there is none."""
    return rows.filter(F.col("val_f1") >= reference_f1 - slack).orderBy("age", F.desc("val_f1")).limit(1)


def early_rule(rows: DataFrame, age: int, threshold: float) -> DataFrame:
    """(precision, recall, f1, delay_p50, delay_p95, tp ..) for rows (inc_delay, snap, y): an alert by lines, or at ``age`` by its snapshot.

    Delays are over true detections.
    """
    delay = F.least(F.coalesce("inc_delay", F.lit(INFINITY)), F.when(F.col("snap") >= threshold, F.lit(float(age))).otherwise(INFINITY))
    timed = rows.withColumn("delay", delay)
    counts = confusion(timed, F.col("delay") < INFINITY)
    delays = quantiles(timed.filter((F.col("y") == 1) & (F.col("delay") < INFINITY)), [], "delay", [0.5, 0.95]).select(F.col("q")[0].alias("delay_p50"), F.col("q")[1].alias("delay_p95"))
    return counts.crossJoin(delays)  # one row each


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
