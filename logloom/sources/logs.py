"""Log and label scans, stream decoding and sinks."""

import json
from collections import deque
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import scalars as S
from ..operators.ranking import quantiles
from ..session import cut


def valid_text(value: Column) -> Column:
    """``value`` without the bytes that are part of no UTF-8 character; a U+FFFD that was written stays."""
    mark = "\U0010fffe"  # stands for written ones in lines with other bytes, where this noncharacter would become one
    cleaned = F.replace(F.make_valid_utf8(F.replace(value, F.lit("\ufffd"), F.lit(mark))), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(cleaned, F.lit(mark), F.lit("\ufffd")))


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """(line_id, line): lines numbered from 0 in the order of files by path and of lines in them; the first ``max_lines`` if given.

    A first pass counts the lines of every split of a file; their running sum tells where each split's numbers begin.
    """
    at = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    raw = spark.read.text(path).select("value", *[c.alias(n) for n, c in at.items()])
    splits = raw.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = cut(splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    lines = raw.join(offsets, ["_file", "_block"]).select((F.col("_id") + F.col("_shift")).alias("line_id"), valid_text(F.col("value")).alias("line"))
    return lines if max_lines is None else lines.filter(F.col("line_id") < max_lines)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, label) of a CSV file BlockId, Label."""
    return label_rows(spark.read.option("header", True).csv(path))


def label_rows(raw: DataFrame, id_col: str = "BlockId", label_col: str = "Label") -> DataFrame:
    return raw.select(F.col(id_col).alias("session_id"), F.coalesce((F.col(label_col) == "Anomaly").cast("int"), F.lit(0)).alias("label"))


def prefixed_lines(lines: DataFrame) -> DataFrame:
    """(line_id, ts, label, line) of lines '<label> <epoch> <rest>'; others are dropped; a label other than - is an anomaly."""
    parts = F.split("line", " ", 3)
    rows = lines.filter((F.size(parts) == 3) & parts[1].rlike(r"^\d+$"))
    return rows.select("line_id", parts[1].cast("long").alias("ts"), (parts[0] != "-").cast("int").alias("label"), "line")


def write_sessions(sessions: DataFrame, path: str) -> None:
    sessions.write.mode("overwrite").partitionBy("split").parquet(path)


def read_sessions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Sessions written before; one split reads only its own files."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written first if it is not there."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def replay_slice(lines: DataFrame, allowed: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines, in order, whose first key is allowed."""
    keyed = lines.withColumn("session_id", S.first_key(F.col("line")))
    return keyed.join(allowed.select("session_id"), "session_id", "left_semi").orderBy("line_id").limit(n)


def anomaly_pool(sessions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` anomalous test sessions in a seeded order."""
    return sessions.filter("split = 'test' AND label = 1").orderBy(F.xxhash64(F.lit(seed), "session_id"), "session_id").limit(n)


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """(key, value, timestamp) from the earliest offsets, so many rows a trigger; lost data does not stop the query."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false"}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def kafka_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All rows of a topic up to now, with the broker's timestamps."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "endingOffsets": "latest"}
    return spark.read.format("kafka").options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


# The fields of a message.
WIRE = "i long, t long, l string, eos int"


def decode_wire(raw: DataFrame) -> DataFrame:
    """(key, i, t, line) of JSON values {i, t, l}; end markers and values without a line are dropped."""
    parsed = raw.withColumn("v", F.from_json("value", WIRE))
    return parsed.filter("v.l is not null and v.eos is null").select("key", F.col("v.i").alias("i"), F.col("v.t").alias("t"), F.col("v.l").alias("line"))


def decode_alerts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good values are objects with an id and a score that reads as a number; bad ones keep their text."""
    v = F.from_json("value", "map<string,string>")
    marked = raw.withColumn("v", v).withColumn("id", F.col("v")["id"]).withColumn("score", F.col("v")["score"].try_cast("double"))
    ok = F.trim("value").startswith("{") & F.col("id").isNotNull() & F.col("score").isNotNull()
    marked = marked.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return marked.filter("ok").drop("ok"), marked.filter("not ok").select("value")


def decode_metrics(raw: DataFrame, schema: str = "run string, worker int, ts_ns long, rate_eps double, lag double, open_sessions long, alerts long, p95_ms double, p99_ms double, watermark long") -> DataFrame:
    """Metric samples; values without run and ts_ns are dropped silently."""
    return raw.select(F.from_json("value", schema).alias("v")).select("v.*").filter("run is not null and ts_ns is not null")


def encode_alerts(alerts: DataFrame, key: str = "session_key") -> DataFrame:
    return alerts.select(F.col(key).alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


# How the JVM's unified log writes a time, a collector's pause and a safepoint.
PAUSE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
PAUSE_STAMP, GC_MARK, SAFEPOINT_MARK = r"^\[([0-9T:.+-]{28})\]", "Pause ", 'Safepoint "'


def parse_pauses(lines: DataFrame) -> DataFrame:
    """(t, ms, kind) of garbage-collector and safepoint log lines; a line that has both marks is the collector's.

    A collector's pause is the number before the line's last ``ms``; a safepoint's time is the number of nanoseconds after ``Total:``.
    """
    line = F.rtrim("line")
    stamp = F.to_timestamp(F.nullif(F.regexp_extract("line", PAUSE_STAMP, 1), F.lit("")), PAUSE_TIME)
    word = lambda text: F.nullif(F.regexp_extract(text, r"^[A-Za-z0-9_]+", 0), F.lit(""))
    after = lambda mark: F.when(F.instr("line", mark) > 0, F.substring_index(F.col("line"), mark, -1))
    gc = F.struct(F.concat(F.lit("gc:"), word(after(GC_MARK))).alias("kind"), F.when(line.endswith("ms"), F.regexp_extract(line, r"([0-9.]+)ms$", 1)).try_cast("double").alias("ms"))
    ns = F.element_at(F.split(F.trim(after("Total:")), " "), 1).try_cast("double")
    safe = F.struct(F.concat(F.lit("safepoint:"), word(after(SAFEPOINT_MARK))).alias("kind"), (ns / 1e6).alias("ms"))
    found = F.when(gc["kind"].isNotNull() & gc["ms"].isNotNull(), gc).when(safe["kind"].isNotNull() & safe["ms"].isNotNull(), safe)
    return lines.select((F.unix_micros(stamp) / 1e6).alias("t"), found.alias("found")).filter("t is not null and found is not null").select("t", "found.ms", "found.kind")


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records: JSON files, one record each, with the file's name as ``source``."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))


def import_runs(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """``runs`` and, as finished, the summaries whose id is new."""
    fresh = summaries.dropDuplicates(["id"]).join(runs.select("id"), "id", "left_anti").withColumn("status", F.lit("finished"))
    return runs.unionByName(fresh, allowMissingColumns=True)


def export_report(rows: DataFrame, path: str) -> None:
    """Report rows (experiment, cell, metric, median, min, max, n) as CSV."""
    rows.select("experiment", "cell", "metric", "median", "min", "max", "n").write.mode("overwrite").option("header", True).csv(path)


def to_markdown(rows: DataFrame, limit: int = 200) -> str:
    """A report table of at most ``limit`` rows."""
    out = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(out + ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.limit(limit).collect()])


#: Buckets of a store's keys.
BUCKETS = 64


def _place(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop knows them."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``store_batch`` has written to ``path``, with ``schema``; none if there is no store yet."""
    rows = f"{path}/rows"
    full = StructType([*schema.fields, StructField("bucket", IntegerType())])
    return spark.read.schema(full).parquet(rows) if exists(spark, rows) else spark.createDataFrame([], full)


def store_batch(insert: Callable[[DataFrame, DataFrame], DataFrame], path: str, query: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends what ``insert`` returns for the store at ``path`` and the batch, each row once.

    The store is partitioned by a hash of ``keys``, so that a batch is compared with its own buckets only; a null key is a key.
    When its rows are written, a batch leaves an empty file named after ``query`` and its number. A batch that is replayed after that
    is left out without reading anything; one that was stopped before it finds the rows that it has written, as ``insert`` lets no key in twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = f"{path}/batches/{query}/{batch_id}"
        if exists(spark, done):
            return
        fresh = cut(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        store = read_store(spark, path, batch.schema).filter(F.col("bucket").isin(touched))
        out = cut(insert(store.drop("bucket"), fresh.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        out.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")
        fs, place = _place(spark, done)
        fs.create(place).close()

    return write


PROGRESS = "query string, batch_id long, ts timestamp, rows long, duration_s double, watermark timestamp, lag_s double, state_rows long, state_bytes long, late_rows long, offsets_behind long"


def progress_row(p: dict) -> tuple:
    """A row of ``PROGRESS`` from what a query reports of a batch; ``lag_s``: from the newest event back to the watermark."""
    time = lambda s: datetime.fromisoformat(s.replace("Z", "+00:00")) if s else None
    event, state = p.get("eventTime") or {}, p.get("stateOperators") or []
    mark, newest = time(event.get("watermark")), time(event.get("max"))
    behind = [int(float(m["maxOffsetsBehindLatest"])) for m in (s.get("metrics") or {} for s in p.get("sources") or []) if m.get("maxOffsetsBehindLatest") is not None]
    total = lambda k: sum(int(s.get(k) or 0) for s in state)
    return (str(p.get("runId") or p.get("id") or ""), p["batchId"], time(p.get("timestamp")), p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000, mark,
            (newest - mark).total_seconds() if newest and mark else None, total("numRowsTotal"), total("memoryUsedBytes"), total("numRowsDroppedByWatermark"), max(behind, default=None))


def progress_rows(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """A streaming query's recent progress as a table, see ``PROGRESS``, with rows_per_s."""
    df = spark.createDataFrame([progress_row(p) for p in progress], PROGRESS)
    return df.withColumn("rows_per_s", F.when(F.col("duration_s") > 0, F.col("rows") / F.col("duration_s")))


class Metrics(StreamingQueryListener):
    """Keeps the last ``most`` batches of all queries of a session: ``spark.streams.addListener(Metrics())``."""

    def __init__(self, most: int = 3600):
        self.progress: deque[dict] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.progress.append(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        return progress_rows(spark, [*self.progress])


def per_second(progress: DataFrame, alerts: DataFrame) -> DataFrame:
    """(second, rows, rows_per_s, batches, state_rows, lag_s, alerts, p50_ms, p95_ms, p99_ms): seconds in which a batch or an alert (ts, ms) was.

    A batch counts for the second in which it started; state and lag are the last batch's. Latencies are exact quantiles.
    """
    second = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).alias("second")
    newest = lambda c: F.max_by(c, "ts").alias(c)
    batches = progress.groupBy(second("ts")).agg(F.sum("rows").alias("rows"), F.sum("duration_s").alias("_busy"), F.count("*").alias("batches"), newest("state_rows"), newest("lag_s"))
    timed = quantiles(alerts.select(second("ts"), "ms"), ["second"], "ms", [0.5, 0.95, 0.99])
    points = [F.col("q")[k].alias(c) for k, c in enumerate(("p50_ms", "p95_ms", "p99_ms"))]
    both = batches.join(alerts.groupBy(second("ts")).agg(F.count("*").alias("alerts")).join(timed.select("second", *points), "second"), "second", "full")
    rate = F.when(F.col("_busy") > 0, F.col("rows") / F.col("_busy")).alias("rows_per_s")
    return both.select("second", F.coalesce("rows", F.lit(0)).alias("rows"), rate, F.coalesce("batches", F.lit(0)).alias("batches"), "state_rows", "lag_s", F.coalesce("alerts", F.lit(0)).alias("alerts"), "p50_ms", "p95_ms", "p99_ms")


def capacity(progress: DataFrame) -> DataFrame:
    """(rows, busy_s, capacity): rows over the seconds of batches that had rows."""
    busy = progress.filter("rows > 0")
    return busy.agg(F.sum("rows").alias("rows"), F.sum("duration_s").alias("busy_s"), (F.sum("rows") / F.sum("duration_s")).alias("capacity"))

