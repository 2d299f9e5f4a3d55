"""Online detection with keyed state: at most one alert per session, by its lines so far or by its age.

A micro-batch is first summed up for each session: its span of times and its lines by column, in all and within ``age_s`` of
the session's first time. The sums are added to those of the state, so the order of rows in a batch makes no difference. Then
one rule decides: a session alerts if it has ``min_lines`` lines and their score reaches the threshold, and, once, when the
watermark has passed its first time by more than ``age_s``, if the score of its early lines reaches theirs. A session without
new lines is woken for the second by a timer. An earlier first time in a later batch moves the due time, but does not take
early lines back. Lines count however late they are, within ``lateness`` of the watermark; a line without a time counts as
one at the session's last time.

State is a map of a session's columns, of which a batch writes those that it changes, and a few values. A session that has alerted
gives its columns up and keeps the values, so that it does not alert again. All of it ends when the watermark has passed the session's last
time by ``keep_s`` (a session without any time: by the watermark when it was first seen); lines of its key that come or are dated after that begin another session.
So the state holds live sessions alone, however long the stream runs. It is kept in RocksDB, not in the executors' heaps.
"""

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S
from ..operators import ranking
from ..session import cut, shared_path
from ..sources import logs

ALERT = "session_key string, kind string, score double, n_lines long, evidence_s long, threshold double, sent_ns long"
#: The values of a session besides its map of columns; ``timer``: whether the timer of its end is set.
KNOWN = "first long, last long, sent_ns long, alerted boolean, looked boolean, timer boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Scorer:
    """What a task needs to score counts: weights and detector; all of bounded size, so it is broadcast."""

    idf: dict[int, float]
    detector: object
    threshold: float
    age_s: int | None = None
    snap_idf: dict[int, float] | None = None
    snap_detector: object = None
    snap_threshold: float = float("inf")

    def _score(self, counts: dict[int, int], idf: dict[int, float], detector) -> float:
        w = {c: (1 + np.log(n)) * idf[c] for c, n in counts.items() if n > 0 and c in idf}
        norm = np.sqrt(sum(v * v for v in w.values()))
        x = np.zeros((1, len(detector.columns)))
        for c, v in w.items():
            if c in detector.columns and norm > 0:
                x[0, detector.columns[c]] = v / norm
        return float(detector.score_matrix(x)[0])

    def full(self, counts: dict[int, int]) -> float:
        return self._score(counts, self.idf, self.detector)

    def snapshot(self, counts: dict[int, int]) -> float:
        return self._score(counts, self.snap_idf or self.idf, self.snap_detector or self.detector)


def scorer(model) -> Scorer:
    """Collect a fitted model's column weights, one row per column."""
    early = model.early
    out = Scorer(dict(model.idf.collect()), model.detector, model.threshold)
    if early:
        out.age_s, out.snap_idf, out.snap_detector, out.snap_threshold = early.age_s, dict(early.idf.collect()), early.detector, early.threshold
    return out


@dataclass
class Session:
    """What is known of a session; lines by column are (in all, early)."""

    lines: dict[int, tuple[int, int]] = field(default_factory=dict)
    first: int | None = None
    last: int | None = None
    sent_ns: int | None = None
    alerted: bool = False
    looked: bool = False

    def add(self, cols: np.ndarray, times: np.ndarray, sent: np.ndarray, age_s: int | None, many: np.ndarray | None = None) -> None:
        """The lines of a batch: whole columns, times with NaN where a line has none, and how often each row stands."""
        timed = times[~np.isnan(times)]
        if len(timed):
            low, high = int(timed.min()), int(timed.max())
            self.first, self.last = (low, high) if self.first is None else (min(self.first, low), max(self.last, high))
        ages = np.where(np.isnan(times), (self.last or 0) - (self.first or 0), times - (self.first or 0))
        many = np.ones(len(cols), np.int64) if many is None else many
        early = many * (np.zeros(len(cols), bool) if age_s is None else ages <= age_s)
        names, at = np.unique(cols, return_inverse=True)
        for col, n, m in zip(names.tolist(), np.bincount(at, many).astype(int).tolist(), np.bincount(at, early).astype(int).tolist()):
            had = self.lines.get(col, (0, 0))
            self.lines[col] = had[0] + n, had[1] + m
        sent = sent[~np.isnan(sent)]
        if len(sent):
            self.sent_ns = max(self.sent_ns or 0, int(sent.max()))

    def due(self, age_s: int | None) -> int | None:
        """The millisecond of event time from which on the early lines may be looked at; none if that is done or not wanted."""
        return None if age_s is None or self.looked or self.first is None else (self.first + age_s + 1) * 1000

    def judge(self, model: Scorer, min_lines: int, now_ms: int) -> tuple[str, float, float] | None:
        """(kind, score, threshold) of an alert that is due now; marks what has been done."""
        whole = {c: n for c, (n, _) in self.lines.items()}
        found = []
        if not self.alerted and sum(whole.values()) >= min_lines:
            found.append(("incremental", model.full(whole), model.threshold))
        due = self.due(model.age_s)
        if due is not None and due <= now_ms:
            self.looked = True
            if not self.alerted:
                found.append(("deadline", model.snapshot({c: m for c, (_, m) in self.lines.items() if m}), model.snap_threshold))
        alert = next((x for x in found if x[1] >= x[2]), None)
        self.alerted = self.alerted or alert is not None
        return alert


def event_time(lines: DataFrame) -> DataFrame:
    """``lines`` (key, line) with log_t and event_time, its place on the clock that watermarks run on; malformed times are null."""
    return lines.withColumn("log_t", S.log_time(F.col("line"))).withColumn("event_time", F.timestamp_seconds("log_t"))


def _summed(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns, times, times of sending and numbers of the distinct rows of ``frames``, added up frame by frame."""
    held = np.zeros((0, 4))
    for df in frames:
        rows = np.column_stack([df[c].to_numpy(float, na_value=np.nan) for c in ("col", "log_t", "sent_ns")] + [np.ones(len(df))])
        held = np.concatenate([held, rows])
        # A session's last time of sending is all that is needed of them, so rows differ by column and time alone.
        order = np.lexsort((held[:, 1], held[:, 0]))
        held = held[order]
        same = (held[1:, 0] == held[:-1, 0]) & ((held[1:, 1] == held[:-1, 1]) | np.isnan(held[1:, 1]) & np.isnan(held[:-1, 1]))
        starts = np.flatnonzero(np.append(True, ~same))
        held = np.column_stack([held[starts, 0], held[starts, 1], np.fmax.reduceat(held[:, 2], starts), np.add.reduceat(held[:, 3], starts)])
    return held[:, 0].astype(int), held[:, 1], held[:, 2], held[:, 3].astype(np.int64)


def ship(spark: SparkSession, model: Scorer) -> str:
    """Writes the model into the shared folder and has Spark fetch it to every executor; the name that ``_shipped`` takes.

    A broadcast does not do: Spark's driver asks the processor for its state's schema in a Python process that has none.
    """
    path = f"{shared_path(spark)}/scorer-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(pickle.dumps(model))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


@lru_cache(maxsize=2)
def _shipped(name: str) -> Scorer:
    with open(SparkFiles.get(name), "rb") as f:
        return pickle.load(f)


class Sessions(StatefulProcessor):
    """The state of each session, its alert, its timer of age and its end."""

    def __init__(self, name: str, min_lines: int, keep_s: int):
        self.name, self.min_lines, self.keep_s = name, min_lines, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "col int", "n long, early long")
        self.known = handle.getValueState("known", KNOWN)

    def model(self) -> Scorer:
        return _shipped(self.name)

    def _read(self) -> tuple[Session, bool]:
        if not self.known.exists():
            return Session(), False
        *values, timer = self.known.get()
        return Session({} if values[3] else {k[0]: (v[0], v[1]) for k, v in self.lines.iterator()}, *values), timer

    def _after(self, key: tuple, session: Session, before: dict, had_timer: bool, now_ms: int) -> Iterator[pd.DataFrame]:
        """Judges the session, stores what has changed and sets its timers."""
        model, done = self.model(), session.alerted
        alert = session.judge(model, self.min_lines, now_ms)
        if session.alerted:
            if not done and before:
                self.lines.clear()
        else:
            for col, n in session.lines.items():
                if before.get(col) != n:
                    self.lines.updateValue((col,), n)
        end = self._end(session, now_ms)
        if not had_timer:
            self.handle.registerTimer(end)
        due = session.due(model.age_s)
        if due is not None and not session.alerted and due < end:
            self.handle.registerTimer(due)
        self.known.update((session.first, session.last, session.sent_ns, session.alerted, session.looked, True))
        if alert:
            rows = [(key[0], alert[0], alert[1], sum(n for n, _ in session.lines.values()), (session.last or 0) - (session.first or 0), alert[2], session.sent_ns)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALERT.split(", ")]).astype({"sent_ns": "Int64"})

    def _end(self, session: Session, now_ms: int) -> int:
        return (session.last + self.keep_s + 1) * 1000 if session.last is not None else now_ms + (self.keep_s + 1) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        session, timer = self._read()
        cols, times, sent, many = _summed(rows)
        if session.last is not None and np.nanmin(np.append(times, np.inf)) > session.last + self.keep_s:  # it had ended before these lines
            session = Session()
            self.lines.clear()
        before = dict(session.lines)
        session.add(cols, times, sent, self.model().age_s, many)
        yield from self._after(key, session, before, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        session, _ = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        ended = session.last is None or self._end(session, now) <= now
        # A timer of age comes with its own time; that of the end is set anew if the session has gone on.
        if session.due(self.model().age_s) is not None or not ended:
            yield from self._after(key, session, dict(session.lines), not self._is_end(expiredTimerInfo, session), now)
        if ended:
            self.lines.clear()
            self.known.clear()

    def _is_end(self, info, session: Session) -> bool:
        """Whether the timer that has run out is not that of the session's age."""
        due = session.due(self.model().age_s)
        return due is None or info.getExpiryTimeInMs() != due

    def close(self) -> None:
        pass


def detect(events: DataFrame, model: Scorer, min_lines: int = 10, lateness: str = "2 hours", keep_s: int = 86_400) -> DataFrame:
    """Alerts of a stream of (key, col, log_t, event_time), with sent_ns if the events have it; append mode.

    The session's state store is set to RocksDB, which this operator needs.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if "sent_ns" not in events.columns:
        events = events.withColumn("sent_ns", F.lit(None).cast("long"))
    keyed = events.withWatermark("event_time", lateness).groupBy("key")
    return keyed.transformWithStateInPandas(Sessions(ship(spark, model), min_lines, keep_s), ALERT, "append", "eventTime")


def payload(alerts: DataFrame, run: str, model: str) -> DataFrame:
    """``alerts`` as they are sent: with an id that is the same in every attempt, the run and the model's name."""
    return alerts.select(F.concat_ws(":", F.lit(run), "session_key").alias("id"), F.lit(run).alias("run"), F.lit(model).alias("model"), *alerts.columns)


def start(alerts: DataFrame, checkpoint: str, format: str = "parquet", once: bool = False, **options: str) -> StreamingQuery:
    """Writes a stream of alerts to files or a Kafka topic; ``once``: what is there now, then it ends."""
    writer = alerts.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint).options(**options)
    return (writer.trigger(availableNow=True) if once else writer).start()


def send(alerts: DataFrame, checkpoint: str, run: str, model: str, format: str = "kafka", once: bool = False, **options: str) -> StreamingQuery:
    """Writes a stream of alerts as messages, (key, value) with the session's key and a JSON object, to a Kafka topic or files."""
    return start(logs.encode_alerts(payload(alerts, run, model)), checkpoint, format, once, **options)


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, first, last, sent_ns, alerted, looked) of the sessions that a stream's state holds, read from its checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "known").load()
    return rows.select("key.key", "value.first", "value.last", "value.sent_ns", "value.alerted", "value.looked")


def finalise(scores: DataFrame, snapshots: DataFrame, alerts: DataFrame, snap_threshold: float) -> DataFrame:
    """(session_id, score, kind, alert_score): every session's final score with its alert; checks still open at the end fire as deadline_eos.

    ``scores`` and ``snapshots``: (session_id, score); ``alerts``: (session_key, kind, score) so far.
    """
    known = alerts.select(F.col("session_key").alias("session_id"), F.col("kind"), F.col("score").alias("alert_score"))
    out = scores.join(known, "session_id", "left").join(snapshots.withColumnRenamed("score", "_snap"), "session_id", "left")
    fires = F.col("kind").isNull() & (F.col("_snap") >= snap_threshold)
    return out.select("session_id", "score", F.when(fires, "deadline_eos").otherwise(F.col("kind")).alias("kind"), F.when(fires, F.col("_snap")).otherwise(F.col("alert_score")).alias("alert_score"))


def summarise(final: DataFrame, labels: DataFrame, offline: DataFrame) -> DataFrame:
    """(sessions, unlabelled, tp, fp, fn, same, diff_median, diff_max): alerts against labels, final scores against offline ones."""
    joined = final.join(labels, "session_id", "left").join(offline.select("session_id", F.col("score").alias("_off")), "session_id", "left")
    hit, y = F.col("kind").isNotNull(), F.col("label")
    joined = cut(joined.withColumn("_diff", F.abs(F.col("score") - F.col("_off"))))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    spread = ranking.quantiles(joined, [], "_diff", [0.5]).select(F.col("q")[0].alias("diff_median"), F.col("high").alias("diff_max"))
    return joined.agg(F.count("*").alias("sessions"), n(y.isNull()).alias("unlabelled"), n(hit & (y == 1)).alias("tp"), n(hit & (y == 0)).alias("fp"), n(~hit & (y == 1)).alias("fn"),
                      F.avg((F.col("_diff") < 1e-6).cast("double")).alias("same")).crossJoin(spread)  # one row each


def run_report(alerts: DataFrame, labels: DataFrame, sizes: DataFrame, expected: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: coverage, alerts by kind, and quantiles of true alerts' evidence and of the part of its lines that a session had.

    ``alerts``: (session_key, kind, evidence_s, n_lines); ``sizes``: (session_id, n); ``expected``, ``scored``: (session_id).
    """
    known = alerts.withColumnRenamed("session_key", "session_id").join(labels, "session_id", "left").join(sizes, "session_id", "left")
    kinds = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ("incremental", "deadline", "deadline_eos")]
    known = cut(known.withColumns({"_delay": F.when(F.col("label") == 1, F.col("evidence_s")), "_part": F.col("n_lines") / F.col("n")}))
    delay, part = (ranking.quantiles(known, [], c, [0.5, 0.95]).select(F.col("q").alias(name)) for c, name in (("_delay", "_d"), ("_part", "_p")))
    both = expected.agg(F.count("*").alias("sessions")).crossJoin(expected.join(scored, "session_id", "left_semi").agg(F.count("*").alias("scored")))  # one row each
    out = both.crossJoin(known.agg(F.count("*").alias("alerts"), *kinds)).crossJoin(delay).crossJoin(part)
    return out.select("sessions", "scored", F.when(F.col("sessions") > 0, F.col("scored") / F.col("sessions")).alias("coverage"), "alerts", *[f"n_{k}" for k in ("incremental", "deadline", "deadline_eos")],
                      F.col("_d")[0].alias("evidence_p50"), F.col("_d")[1].alias("evidence_p95"), F.col("_p")[0].alias("lines_p50"), F.col("_p")[1].alias("lines_p95"))
