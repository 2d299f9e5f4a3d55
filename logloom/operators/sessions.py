"""Sessions by key and by time window, splits and session-level tables, kept as rows (session_id, line_id, line)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import Scan, with_rank


def keyed_lines(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, label, line_id, line): each line under every distinct key it mentions; keys without a label are dropped."""
    return lines.withColumn("session_id", F.explode(S.all_keys(F.col("line")))).join(labels, "session_id").select("session_id", "label", "line_id", "line")


def sessions_by_key(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, label, ts, lines): ``ts`` is the number of the first line, ``lines`` are in order."""
    rows = keyed_lines(lines, labels)
    grouped = rows.groupBy("session_id").agg(F.max("label").alias("label"), F.min("line_id").alias("ts"), F.sort_array(F.collect_list(F.struct("line_id", "line"))).alias("l"))
    return grouped.select("session_id", "label", "ts", F.col("l.line").alias("lines"))


def windowed_sessions(lines: DataFrame, seconds: int, min_lines: int = 1, mode: str = "fixed") -> DataFrame:
    """(session_id, label, ts, n) of ``lines`` (line_id, ts, label): fixed windows, labelled if any of their lines is.

    ``consecutive`` starts a session wherever the window changes in line order, so that unordered input repeats ids. Lines that
    share a number are taken by window, and belong to the sessions that stand when all of them have been seen, as in SQL's running sums.
    Lines without a number share one behind all others.
    """
    rows = lines.withColumn("win", F.floor(F.col("ts") / seconds))
    keys = ["win"]
    if mode == "consecutive":
        # Islands: a line whose predecessor has another window starts one. Lines of one number are peers and lie in the same islands.
        scan = Scan(rows.withColumn("_none", F.col("line_id").isNull()), [], ["_none", "line_id"], ties=["win"]).lag(last="win")
        scan = scan.derive(new=(~F.col("last").eqNullSafe(F.col("win"))).cast("long")).running(island=("sum", "new"))
        rows, keys = scan.done(), ["win", "island"]
    out = rows.groupBy(*keys).agg(F.max("label").alias("label"), F.count("*").alias("n")).filter(F.col("n") >= min_lines)
    return out.select(F.concat(F.lit("w"), F.col("win").cast("string")).alias("session_id"), "label", (F.col("win") * seconds).alias("ts"), "n")


def split(sessions: DataFrame, train: float = 0.6, val: float = 0.2, mode: str = "chronological", seed: int = 0) -> DataFrame:
    """``sessions`` with ``split``: cut by rank in time, or by a seeded hash; anomalies that land in train are dropped after the cut."""
    order = [F.col("ts"), F.col("session_id")] if mode == "chronological" else [F.xxhash64(F.lit(seed), F.col("session_id")), F.col("session_id")]
    ranked = with_rank(sessions, *order, rank="_rank", total="_n")
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val))
    name = F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "val").otherwise("test")
    return ranked.withColumn("split", name).filter((F.col("split") != "train") | (F.col("label") == 0)).drop("_rank", "_n")


def split_summary(sessions: DataFrame) -> DataFrame:
    """(split, n, anomalies, n_lines)."""
    return sessions.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("anomalies"), F.sum("n_lines").alias("n_lines"))


def sequences(rows: DataFrame, time: str = "t") -> DataFrame:
    """``rows`` (session_id, line_id, ...) with pos from 0 and dt since the session's first line."""
    order = Window.partitionBy("session_id").orderBy("line_id")
    return rows.withColumn("pos", F.row_number().over(order) - 1).withColumn("dt", F.col(time) - F.first(time).over(order))


def interleave(rows: DataFrame) -> DataFrame:
    """Line j of every session before line j + 1 of any: rows (session_id, session_idx, pos, ...) in that order, with ``at``."""
    return with_rank(rows, F.col("pos"), F.col("session_idx"), rank="at")


def clone_sessions(rows: DataFrame, count: int, time: int, tag: str, seed: int = 0) -> DataFrame:
    """``count`` sessions drawn with replacement from ``rows`` (session_id, session_idx from 0, pos, line), under new keys and one time."""
    n = rows.agg(F.max("session_idx")).first()[0]
    draws = rows.sparkSession.range(count if n is not None else 0).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit((n or 0) + 1)).alias("session_idx"))
    key = F.concat(F.lit(f"blk_9{tag}"), F.col("draw").cast("string"))
    stamp = S.format_log_time(F.lit(time))
    line = F.concat(stamp, F.expr("substring(replace(line, session_id, new_id), 14)"))
    return draws.join(rows, "session_idx").withColumn("new_id", key).withColumn("line", line).select(F.col("new_id").alias("session_id"), F.col("draw").alias("session_idx"), "pos", "line")


def any_label(label: Column) -> Column:
    return F.max(label)
