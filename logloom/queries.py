"""Registered queries: each applies operators to the given tables, or to views of them, with its DuckDB counterpart."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import detectors, drift, features, metrics, perf, sessions, store, templates
from .plans import anomaly
from .session import cut, shared_path
from .sources import logs
from .streaming import detect
from .views import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns of sums of whole numbers.
LONG_SUMS = {
    "split_summary": "anomalies n_lines", "regex_topk": "freq", "column_counts": "cnt", "confusion": "tp fp fn tn", "early_rule": "tp fp fn", "metric_series": "open_sessions alerts",
    "chunk_metrics": "tp fp", "alert_analysis": "true_alarms false_alarms", "run_rollup": "n_incremental",
}

HEADER = 4
AGE, GATE = 86_400, 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            # DuckDB sums whole numbers to 128 bits; Spark to 64.
            names = LONG_SUMS.get(f.__name__, "").split()
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- SQL fragments --------------------------------------------------------------------------------------

# The mask's patterns, told again for an engine without lookbehind.
LEXER = r"blk_-?\d+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b|\b0x[0-9a-fA-F]+\b|[A-Za-z][0-9-]?|-?\d+(?:\.\d+)?|(?s:.)"
MASKED = r"blk_-?\d+|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?|0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?"


def mask_sql(x: str) -> str:
    """The mask without lookbehind: lex the text, then replace whole tokens."""
    lexed = f"array_to_string(list_transform(regexp_extract_all({x}, '{LEXER}'), lambda t: CASE WHEN regexp_full_match(t, '{MASKED}') THEN '<*>' ELSE t END), '')"
    return rf"trim(regexp_replace({lexed}, '\s+', ' ', 'g'))"


def content_sql(x: str, n: int) -> str:
    head = rf"^\s*(?:\S+\s+){{{n}}}"
    return rf"CASE WHEN regexp_matches({x}, '{head}\S') THEN regexp_replace({x}, '{head}', '') ELSE '' END"


TERMS = f"""terms AS (SELECT k AS session_id, line_id, {mask_sql(content_sql("line", HEADER))} AS term FROM loglines),
counts AS (SELECT session_id, term, count(*) AS cnt, min(line_id) AS first_line FROM terms GROUP BY ALL),
vocab AS (SELECT term, row_number() OVER (ORDER BY min(first_line), term) - 1 AS term_id FROM counts GROUP BY term)"""
SPLITS = """ranked AS (SELECT *, row_number() OVER (ORDER BY ts, session_id) - 1 AS rk, count(*) OVER () AS n FROM sessions),
cut AS (SELECT session_id, label, ts, n_lines, CASE WHEN rk < floor(n * 0.6::DOUBLE) THEN 'train' WHEN rk < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked),
splits AS (SELECT * FROM cut WHERE split <> 'train' OR label = 0)"""
COLS = """freq AS (SELECT term, sum(cnt) AS freq FROM counts WHERE session_id IN (SELECT session_id FROM splits WHERE split = 'train') GROUP BY term),
cols AS (SELECT term, row_number() OVER (ORDER BY freq DESC, term_id) AS col FROM freq JOIN vocab USING (term) QUALIFY row_number() OVER (ORDER BY freq DESC, term_id) <= 3),
bycol AS (SELECT session_id, coalesce(col, 0) AS col, sum(cnt) AS cnt FROM counts LEFT JOIN cols USING (term) GROUP BY ALL)"""
IDF = """ntrain AS (SELECT count(*) AS n FROM splits WHERE split = 'train'),
df AS (SELECT col, count(*) AS df FROM bycol WHERE session_id IN (SELECT session_id FROM splits WHERE split = 'train') GROUP BY col),
allcols AS (SELECT col FROM cols UNION SELECT 0),
idf AS (SELECT col, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM allcols LEFT JOIN df USING (col), ntrain)"""
TFIDF = """raw AS (SELECT session_id, b.col, (1 + ln(cnt)) * idf AS x FROM bycol b JOIN idf i ON b.col = i.col),
tfidf AS (SELECT session_id, col, x / sqrt(sum(x * x) OVER (PARTITION BY session_id)) AS w FROM raw)"""
SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_id) - 1 AS pos, t - first_value(t) OVER (PARTITION BY session_id ORDER BY line_id) AS dt FROM typed)"
def curve_sql(s: str) -> str:
    return f"""grouped AS (SELECT {s} AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY {s}),
curve AS (SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM grouped WINDOW w AS (ORDER BY s DESC))"""


CURVE = curve_sql("s")
F1 = "CASE WHEN 2 * tp + fp + (p - tp) > 0 THEN 2.0 * tp / (2 * tp + fp + (p - tp)) ELSE 0 END"


# ---- shared steps ----------------------------------------------------------------------------------------

def _rows(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "loglines").withColumnRenamed("k", "session_id")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return features.message_counts(_rows(spark, d), HEADER)


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return cut(sessions.split(view(spark, d, "sessions")))


def _firsts(counts: DataFrame) -> DataFrame:
    """(term, term_id): what orders terms as their numbers would, without numbering them all."""
    return counts.groupBy("term").agg(F.min("first_line").alias("first_line")).select("term", F.struct("first_line", "term").alias("term_id"))


def _columns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts, splits = cut(_counts(spark, d)), _splits(spark, d)
    columns = cut(features.top_terms(features.train_frequency(counts, splits), _firsts(counts), 3))
    return cut(features.to_columns(counts, columns)), splits, columns


def _seq(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sequences(view(spark, d, "typed"))


# ---- scalars and sources -----------------------------------------------------------------------------------

@query(rf"""SELECT doc_id, nth, m AS masked FROM (SELECT doc_id, {mask_sql("line")} AS m, nth FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents))""")
def mask_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("nth"), S.mask(F.col("line")).alias("masked"))


@query(duck(f"SELECT line_id, {content_sql('line', 4)} AS hdfs, {content_sql('line', 9)} AS bgl, {content_sql('line', 40)} AS short FROM loglines", "loglines"))
def content_strip(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return view(spark, d, "loglines").select("line_id", S.content(line, 4).alias("hdfs"), S.content(line, 9).alias("bgl"), S.content(line, 40).alias("short"))


@query(duck("""SELECT line_id, t, concat(lpad(CAST(t // 32140800 AS STRING), 2, '0'), lpad(CAST((t // 86400) % 372 // 31 AS STRING), 2, '0'), lpad(CAST((t // 86400) % 31 AS STRING), 2, '0'), ' ',
  lpad(CAST(t % 86400 // 3600 AS STRING), 2, '0'), lpad(CAST(t % 3600 // 60 AS STRING), 2, '0'), lpad(CAST(t % 60 AS STRING), 2, '0')) AS stamp FROM
  (SELECT line_id, (CAST(substr(line, 5, 2) AS BIGINT) + 31 * CAST(substr(line, 3, 2) AS BIGINT) + 372 * CAST(substr(line, 1, 2) AS BIGINT)) * 86400
   + CAST(substr(line, 8, 2) AS BIGINT) * 3600 + CAST(substr(line, 10, 2) AS BIGINT) * 60 + CAST(substr(line, 12, 2) AS BIGINT) AS t FROM loglines)""", "loglines"))
def log_time(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "loglines").select("line_id", S.log_time(F.col("line")).alias("t")).withColumn("stamp", S.format_log_time(F.col("t")))


@query(duck(r"SELECT line_id, nullif(regexp_extract(line, 'blk_-?\d+', 0), '') AS key, len(list_distinct(regexp_extract_all(line || ' blk_7 blk_7', 'blk_-?\d+'))) AS n_keys FROM loglines", "loglines"))
def first_key(spark: SparkSession, d: str) -> DataFrame:
    twice = F.concat("line", F.lit(" blk_7 blk_7"))
    return view(spark, d, "loglines").select("line_id", S.first_key(F.col("line")).alias("key"), F.size(S.all_keys(twice)).cast("long").alias("n_keys"))


@query(duck("SELECT id, CASE WHEN threshold IS NOT NULL AND threshold <> 0 THEN score / threshold ELSE score END AS ratio FROM alerts", "alerts"))
def score_ratio(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "alerts").select("id", S.score_ratio(F.col("score"), F.col("threshold")).alias("ratio"))


@query(duck("SELECT k AS key, line_id AS i, line FROM loglines WHERE line_id % 5 <> 0 AND line_id % 7 <> 0", "loglines"))
def wire_decode(spark: SparkSession, d: str) -> DataFrame:
    """Encodes the lines as wire messages, some of them end markers or without a line, and decodes them again."""
    lines = view(spark, d, "loglines")
    value = F.to_json(F.struct(F.col("line_id").alias("i"), F.col("line_id").alias("t"), F.when(F.col("line_id") % 5 != 0, F.col("line")).alias("l"), F.when(F.col("line_id") % 7 == 0, F.lit(1)).alias("eos")))
    return logs.decode_wire(lines.select(F.col("k").alias("key"), value.alias("value"))).select("key", "i", "line")


@query(duck("SELECT id % 6 NOT IN (0, 1) AS good, count(*) AS n FROM alerts GROUP BY 1", "alerts"))
def alert_decode(spark: SparkSession, d: str) -> DataFrame:
    """Alerts as JSON, every sixth cut short and every sixth with a score that is no number; good and bad values are counted."""
    rows = view(spark, d, "alerts")
    text = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 6 == 1, F.lit("high")).otherwise(F.col("score").cast("string")).alias("score")))
    good, bad = logs.decode_alerts(rows.select(F.when(F.col("id") % 6 == 0, F.substring(text, 2, 9)).otherwise(text).alias("value")))
    counts = good.select(F.lit(True).alias("good")).union(bad.select(F.lit(False)))
    return counts.groupBy("good").agg(F.count("*").alias("n"))


@query(duck("SELECT run, ts_ns, lag FROM samples WHERE worker <> 3", "samples"))
def metric_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "samples")
    value = F.to_json(F.struct(F.when(F.col("worker") != 3, F.col("run")).alias("run"), "ts_ns", "lag"))
    return logs.decode_metrics(rows.select(value.alias("value"))).select("run", "ts_ns", "lag")


@query(duck("SELECT user_id AS session_id, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS label, count(*) AS n FROM ev GROUP BY ALL"))
def label_scan(spark: SparkSession, d: str) -> DataFrame:
    raw = view(spark, d, "ev").select("user_id", F.when(F.col("event_type") == "error", "Anomaly").when(F.col("event_type") != "view", "Normal").alias("label"))
    return logs.label_rows(raw, "user_id", "label").groupBy("session_id", "label").agg(F.count("*").alias("n"))


@query(duck("SELECT event_id AS line_id, us // 1000000 AS ts, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS label FROM ev WHERE event_id % 10 <> 0"))
def prefixed_scan(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("event_type") == "error", "FATAL").otherwise("-")
    stamp = F.when(F.col("event_id") % 10 == 0, F.lit("x")).otherwise(F.floor(F.col("us") / 1000000).cast("string"))
    lines = view(spark, d, "ev").select(F.col("event_id").alias("line_id"), F.concat_ws(" ", tag, stamp, "event_type", F.lit("done")).alias("line"))
    return logs.prefixed_lines(lines).select("line_id", "ts", "label")


@query(duck("SELECT line_id, k AS key FROM loglines WHERE k IN (SELECT 'blk_' || user_id FROM ev WHERE user_id % 3 = 0) ORDER BY line_id LIMIT 500", "loglines"))
def replay_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 lines of the allowed sessions: the limit is the operator."""
    allowed = view(spark, d, "ev").filter("user_id % 3 = 0").select(F.concat(F.lit("blk_"), F.col("user_id").cast("string")).alias("session_id")).distinct()
    return logs.replay_slice(view(spark, d, "loglines"), allowed, 500).select("line_id", F.col("session_id").alias("key"))


@query(duck("""SELECT event_id AS id, us / 1e6 AS t, CAST(event_id % 40 AS DOUBLE) + 0.5 AS ms, CASE WHEN event_id % 2 = 0 THEN 'gc:Young' ELSE 'safepoint:Cleanup' END AS kind
FROM (SELECT event_id, (us // 1000) * 1000 AS us FROM ev WHERE event_id % 3 <> 0)"""))
def pause_lines(spark: SparkSession, d: str) -> DataFrame:
    """Renders events as pause-log lines, every third without a stamp, and parses them back."""
    ms = F.col("event_id") % 40 + 0.5
    stamp = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSZ")
    young = F.concat(F.lit("["), stamp, F.lit("] GC(1) Pause Young (Normal) 4M->2M(9M) "), ms.cast("string"), F.lit("ms"))
    safe = F.concat(F.lit("["), stamp, F.lit('] Safepoint "Cleanup", Time since last: 1 ns, Total: '), (ms * 1000000).cast("long").cast("string"), F.lit(" ns"))
    lines = view(spark, d, "ev").select("event_id", F.when(F.col("event_id") % 3 == 0, "no stamp").when(F.col("event_id") % 2 == 0, young).otherwise(safe).alias("line"))
    lines = cut(lines)  # rendered once: filters that are pushed down would render each line again for every part that they read
    kept = lines.filter("event_id % 3 <> 0")
    parsed = logs.parse_pauses(lines.select("line"))
    # The parser keeps no id: lines are matched again by what they say, so that ids show none was lost. Equal lines count once on
    # the parsed side and the pause is part of the key, so that a time that many lines share costs each of them one match.
    key = kept.withColumn("t0", F.regexp_extract("line", r"^\[(.*?)\]", 1))
    at = F.unix_micros(F.to_timestamp("t0", "yyyy-MM-dd'T'HH:mm:ss.SSSZ")) / 1e6
    ids = key.select(F.col("event_id").alias("id"), at.alias("t"), (F.col("event_id") % 40 + 0.5).cast("double").alias("ms"))
    return ids.join(parsed.distinct(), ["t", "ms"]).select("id", "t", "ms", "kind")


@query(duck("""SELECT run, session_key, arrival, round((ingested_ns - nullif(t_send_ns, 0)) / 1e6, 6) AS ingest_lag_ms FROM
(SELECT *, row_number() OVER (PARTITION BY run, session_key ORDER BY arrival) AS rn FROM alerts WHERE arrival % 10 <> 0) a
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM alerts b WHERE b.arrival % 10 = 0 AND b.run = a.run AND b.session_key = a.session_key)""", "alerts"))
def alert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth alert is stored already; all others arrive."""
    alerts = view(spark, d, "alerts")
    out = store.insert_alerts(alerts.filter("arrival % 10 = 0"), alerts.filter("arrival % 10 <> 0"))
    return out.select("run", "session_key", "arrival", r6("ingest_lag_ms").alias("ingest_lag_ms"))


@query(duck("SELECT run, session_key, arrival, round((ingested_ns - nullif(t_send_ns, 0)) / 1e6, 6) AS ingest_lag_ms FROM (SELECT *, row_number() OVER (PARTITION BY run, session_key ORDER BY arrival) AS rn FROM alerts) WHERE rn = 1", "alerts"))
def alert_store(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds after three batches of alerts, in order of arrival, of which the second came twice."""
    alerts, path = view(spark, d, "alerts"), f"{shared_path(spark)}/store"
    write = logs.store_batch(store.insert_alerts, path, "ingest", ["run", "session_key"])
    last = alerts.agg(F.max("arrival")).first()[0] or 0
    part = F.least(F.lit(2), F.floor(F.col("arrival") * 3 / (last + 1)))
    for k in (0, 1, 1, 2):
        write(alerts.filter(part == k), k)
    return logs.read_store(spark, path, alerts.withColumn("ingest_lag_ms", F.lit(0.0)).schema).select("run", "session_key", "arrival", r6("ingest_lag_ms").alias("ingest_lag_ms"))


@query(duck("SELECT session_key AS key, concat('r9:', session_key) AS id, kind, score, CAST(threshold AS VARCHAR) IS NOT NULL AS has_threshold FROM alerts", "alerts"))
def alert_messages(spark: SparkSession, d: str) -> DataFrame:
    """Alerts as the messages that are sent, read again by the decoder."""
    alerts = view(spark, d, "alerts").select("session_key", "kind", "score", "threshold")
    good, _ = logs.decode_alerts(logs.encode_alerts(detect.payload(alerts, "r9", "pca")))
    return good.select("key", "id", F.col("v")["kind"].alias("kind"), "score", F.col("v")["threshold"].isNotNull().alias("has_threshold"))


@query(duck("SELECT run, worker, created_ns FROM (SELECT *, max(created_ns) OVER () AS newest FROM (SELECT run, CAST(id % 4 AS INT) AS worker, created_ns FROM alerts)) WHERE created_ns >= newest - 21600000000000", "alerts"))
def metric_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "alerts").select("run", (F.col("id") % 4).cast("int").alias("worker"), F.col("created_ns").alias("ts_ns"), "id")
    out = store.insert_metrics(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"))
    return out.select("run", "worker", F.col("ts_ns").alias("created_ns"))


# ---- sessions and features -----------------------------------------------------------------------------------

@query(duck("SELECT k AS session_id, min(line_id) AS ts, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line_id)) AS lines FROM loglines GROUP BY k", "loglines"))
def sessions_by_key(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "loglines")
    labels = lines.groupBy(F.col("k").alias("session_id")).agg(F.max("label").alias("label"))
    out = sessions.sessions_by_key(lines.select("line_id", "line"), labels)
    return out.select("session_id", "ts", F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n")).alias("lines"))


WINDOWS = """SELECT 'w' || win AS session_id, CAST(max(label) AS INT) AS label, win * 3600 AS ts, count(*) AS n FROM
(SELECT us // 1000000 // 3600 AS win, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM ev) GROUP BY win HAVING count(*) >= 3"""


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ev").select(F.col("event_id").alias("line_id"), F.floor(F.col("us") / 1000000).alias("ts"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), "user_id")


@query(duck(WINDOWS))
def window_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.windowed_sessions(_timed(spark, d), 3600, 3)


@query(duck("""SELECT 'w' || win AS session_id, CAST(max(label) AS INT) AS label, win * 3600 AS ts, count(*) AS n FROM
(SELECT *, sum(new) OVER (ORDER BY line_id) AS island FROM (SELECT *, CASE WHEN win IS NOT DISTINCT FROM lag(win) OVER (ORDER BY line_id) THEN 0 ELSE 1 END AS new FROM
(SELECT user_id * 100000 + event_id AS line_id, us // 1000000 // 3600 AS win, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM ev))) GROUP BY win, island"""))
def window_sessions_consecutive(spark: SparkSession, d: str) -> DataFrame:
    """Lines in order of users, so that windows come back and repeat their ids."""
    lines = _timed(spark, d)
    return sessions.windowed_sessions(lines.withColumn("line_id", F.col("user_id") * 100000 + F.col("line_id")), 3600, 1, "consecutive")


@query(duck(f"WITH {SPLITS} SELECT session_id, label, split FROM splits", "sessions"))
def split_chrono(spark: SparkSession, d: str) -> DataFrame:
    return sessions.split(view(spark, d, "sessions")).select("session_id", "label", "split")


@query(duck(f"WITH {SPLITS} SELECT split, count(*) AS n, sum(label) AS anomalies, sum(n_lines) AS n_lines FROM splits GROUP BY split", "sessions"))
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return sessions.split_summary(sessions.split(view(spark, d, "sessions")))


@query(duck(f"WITH {SEQ} SELECT session_id, line_id, pos, dt, col FROM seq", "typed"))
def session_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _seq(spark, d).select("session_id", "line_id", F.col("pos").cast("long").alias("pos"), "dt", "col")


@query(duck(f"WITH {SEQ} SELECT session_id, pos, row_number() OVER (ORDER BY pos, CAST(substr(session_id, 5) AS BIGINT)) - 1 AS at FROM seq", "typed"))
def interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = _seq(spark, d).withColumn("session_idx", F.substring("session_id", 5, 20).cast("long"))
    return sessions.interleave(rows).select("session_id", F.col("pos").cast("long").alias("pos"), F.col("at").cast("long").alias("at"))


@query(duck(f"WITH {TERMS} SELECT session_id, term, cnt, first_line FROM counts", "loglines"))
def vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).select("session_id", "term", "cnt", "first_line")


@query(duck(f"WITH {TERMS} SELECT term, term_id FROM vocab", "loglines"))
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return features.vocabulary(_counts(spark, d)).select("term", F.col("term_id").cast("long").alias("term_id"))


@query(f"""WITH lines AS (SELECT doc_id, {mask_sql("line")} AS term FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT term, count(*) AS freq, min(doc_id) AS first_doc FROM lines WHERE term <> '' GROUP BY term)
SELECT term, freq, row_number() OVER (ORDER BY freq DESC, first_doc, term) AS rank FROM n QUALIFY rank <= 100""")
def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most frequent masked lines of all documents: the report's length is the only limit."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    terms = lines.groupBy(S.mask(F.col("line")).alias("term")).agg(F.sum("n").alias("freq"), F.min("doc_id").alias("first_line")).filter("term <> ''")
    best = features.top_terms(terms.select("term", "freq"), terms.select("term", F.struct("first_line", "term").alias("term_id")), 100)
    return best.join(terms, "term").select("term", "freq", F.col("col").cast("long").alias("rank"))


@query(duck(f"WITH {TERMS}, {SPLITS}, {COLS} SELECT term, freq, cols.col FROM cols JOIN freq USING (term)", "loglines", "sessions"))
def regex_topk(spark: SparkSession, d: str) -> DataFrame:
    counts = cut(_counts(spark, d))
    freq = features.train_frequency(counts, _splits(spark, d))
    return features.top_terms(freq, _firsts(counts), 3).join(freq, "term").select("term", "freq", F.col("col").cast("long").alias("col"))


@query(duck(f"WITH {TERMS}, {SPLITS}, {COLS} SELECT session_id, col, cnt FROM bycol", "loglines", "sessions"))
def column_counts(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d)[0].select("session_id", F.col("col").cast("long").alias("col"), "cnt")


@query(duck(f"WITH {TERMS}, {SPLITS}, {COLS}, {IDF} SELECT col, round(idf, 6) AS idf FROM idf", "loglines", "sessions"))
def idf_fit(spark: SparkSession, d: str) -> DataFrame:
    counts, splits, columns = _columns(spark, d)
    return features.fit_idf(counts, splits, columns).select(F.col("col").cast("long").alias("col"), r6("idf").alias("idf"))


@query(duck(f"WITH {TERMS}, {SPLITS}, {COLS}, {IDF}, {TFIDF} SELECT session_id, col, round(w, 6) AS w FROM tfidf", "loglines", "sessions"))
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    counts, splits, columns = _columns(spark, d)
    return features.tfidf(counts, features.fit_idf(counts, splits, columns)).select("session_id", F.col("col").cast("long").alias("col"), r6("w").alias("w"))


@query(duck(f"""WITH {TERMS}, {SPLITS}, {COLS}, {IDF}, x AS (SELECT session_id, b.col, cnt * idf AS x FROM bycol b JOIN idf i ON b.col = i.col)
SELECT session_id, col, round(x / sqrt(sum(x * x) OVER (PARTITION BY session_id)), 6) AS w FROM x""", "loglines", "sessions"))
def tfidf_plain(spark: SparkSession, d: str) -> DataFrame:
    counts, splits, columns = _columns(spark, d)
    return features.tfidf(counts, features.fit_idf(counts, splits, columns), "plain").select("session_id", F.col("col").cast("long").alias("col"), r6("w").alias("w"))


@query(duck(f"WITH {SEQ} SELECT session_id, col, count(*) AS cnt FROM seq WHERE dt <= {AGE} GROUP BY ALL", "typed"))
def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.snapshot_counts(_seq(spark, d), AGE)


@query(duck(f"WITH {SEQ} SELECT session_id, pos, dt, col, row_number() OVER (PARTITION BY session_id, col ORDER BY pos) AS cnt FROM seq WHERE pos < 64", "typed"))
def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.prefix_counts(_seq(spark, d)).select("session_id", F.col("pos").cast("long").alias("pos"), "dt", "col", F.col("cnt").cast("long").alias("cnt"))


def _crc_sql(x: str) -> str:
    """CRC-32 of an ASCII text: a table of 256 numbers from the polynomial, then a step for each byte."""
    table = "SELECT i, i AS x FROM (SELECT unnest(range(256)) AS i)"
    for _ in range(8):
        table = f"SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({table})"
    bytes_ = f"list_concat([4294967295], list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT)))"
    step = "xor(a >> 8, t[1 + (xor(a, b) & 255)])"
    return f"crc_table AS ({table}), crc AS (SELECT *, xor(list_reduce({bytes_}, lambda a, b: {step}), 4294967295) AS crc FROM lines, (SELECT list(x ORDER BY i) AS t FROM crc_table))"


@query(duck(f"""WITH lines AS (SELECT k AS session_id, {content_sql("line", HEADER)} AS text FROM loglines), {_crc_sql("text")}
SELECT session_id, CAST(crc % {S.BUCKETS} AS INT) AS bucket, count(*) AS cnt FROM crc GROUP BY ALL""", "loglines"))
def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    return features.bucket_counts(_rows(spark, d), HEADER)


# ---- detectors and templates ----------------------------------------------------------------------------------

#: A fixed model for the scores that SQL can follow: means and two components over columns 0 to 3.
MEAN = {0: 0.1, 1: 0.3, 2: 0.2, 3: 0.4}
LOADINGS = {0: {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5}, 1: {0: 0.7, 1: -0.7, 2: 0.1, 3: -0.1}}


def _literal(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    mean = spark.createDataFrame([(c, m) for c, m in MEAN.items()], "col long, m double")
    loadings = spark.createDataFrame([(k, c, v) for k, row in LOADINGS.items() for c, v in row.items()], "comp int, col long, v double")
    return mean, loadings


_PCA = " ".join(
    f"- power({' + '.join(f'{v} * (coalesce(x[{c}], 0) - {MEAN[c]})' for c, v in row.items())}, 2)" for row in LOADINGS.values()
)
PCA = f"""xs AS (SELECT session_id, map_from_entries(list((CAST(col AS INT), w))) AS x FROM tfidf GROUP BY session_id),
pca AS (SELECT session_id, greatest(0, {' + '.join(f'power(coalesce(x[{c}], 0) - {m}, 2)' for c, m in MEAN.items())} {_PCA}) AS score FROM xs)"""


def _pca(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts, splits, columns = _columns(spark, d)
    vectors = cut(features.tfidf(counts, features.fit_idf(counts, splits, columns)).withColumn("col", F.col("col").cast("long")))
    mean, loadings = _literal(spark)
    return detectors.pca_residual(vectors, mean, loadings, vectors.select("session_id").distinct()), splits


@query(duck(f"WITH {TERMS}, {SPLITS}, {COLS}, {IDF}, {TFIDF}, {PCA} SELECT session_id, round(score, 6) AS score FROM pca", "loglines", "sessions"))
def pca_score_literal(spark: SparkSession, d: str) -> DataFrame:
    return _pca(spark, d)[0].select("session_id", r6("score").alias("score"))


def _detector(kind: str, **params: object) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        counts = cut(_counts(spark, d))
        model = anomaly.train_counts(counts, _splits(spark, d), "regex", kind, header_tokens=HEADER, **params)
        return model.flagged(model.column_counts(counts))

    return run


QUERIES |= {"pca_score": _detector("pca"), "iforest_score": _detector("iforest", n_estimators=100), "ae_score": _detector("autoencoder", max_iter=5)}


@query()
def drain_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of the masked lines of all documents, most frequent lines first."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    freq = lines.groupBy(S.mask(F.col("line")).alias("term")).agg(F.sum("n").alias("freq")).filter("term <> ''").withColumn("term_id", F.xxhash64("term"))
    return templates.fit_templates(freq).select("n_tokens", "head", "nth", F.array_join("template", " ").alias("template"))


@query()
def template_grid(spark: SparkSession, d: str) -> DataFrame:
    """Similarity and depth of the templates against threshold and accuracy of a model of their columns."""
    return anomaly.grid(_rows(spark, d), _splits(spark, d), {"parser": ["drain"], "similarity": [0.4, 0.7], "depth": [3, 5]}, header_tokens=HEADER)


# ---- thresholds and evaluation ----------------------------------------------------------------------------------

def _scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scored")


@query(duck("SELECT round(quantile_cont(snap, 0.99), 6) AS threshold FROM scored", "scored"))
def thr_p99(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentile_threshold(_scored(spark, d), s="snap").select(r6("threshold").alias("threshold"))


@query(duck("SELECT round(avg(snap) + 3 * stddev_pop(snap), 6) AS threshold FROM scored", "scored"))
def thr_3sigma(spark: SparkSession, d: str) -> DataFrame:
    return metrics.three_sigma(_scored(spark, d), "snap").select(r6("threshold").alias("threshold"))


@query(duck(f"WITH {CURVE} SELECT s AS threshold, round({F1}, 6) AS f1 FROM curve ORDER BY {F1} DESC, s LIMIT 1", "scored"))
def thr_tuned(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_threshold(_scored(spark, d)).select("threshold", r6("f1").alias("f1"))


@query(duck("""WITH c AS (SELECT cell, sum(CASE WHEN s >= 30 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s >= 30 AND y = 0 THEN 1 ELSE 0 END) AS fp,
sum(CASE WHEN s < 30 AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN s < 30 AND y = 0 THEN 1 ELSE 0 END) AS tn FROM scored GROUP BY cell)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""", "scored"))
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_scored(spark, d), F.col("s") >= 30, by=["cell"]).select("cell", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(duck(f"WITH {CURVE} SELECT round(sum(neg * (2 * tp - pos) / 2) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM curve", "scored"))
def roc_ap(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranking_metrics(_scored(spark, d)).select(*[r6(c).alias(c) for c in ("roc_auc", "average_precision")])


@query(duck(f"""WITH {curve_sql("snap")}, i AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS nth, count(*) OVER () AS t FROM curve),
keep AS (SELECT DISTINCT (k * (t - 1)) // greatest(least(t, 200) - 1, 1) AS nth FROM (SELECT max(t) AS t FROM i), (SELECT unnest(range(200)) AS k) WHERE k < least(t, 200))
SELECT s AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM i WHERE nth IN (SELECT nth FROM keep)""", "scored"))
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    """200 of the thresholds, evenly by index: the operator's own sampling."""
    return metrics.sampled_curve(_scored(spark, d), 200, s="snap").select("threshold", *[r6(c).alias(c) for c in ("precision", "recall")])


@query(duck("""WITH d AS (SELECT DISTINCT snap FROM scored), n AS (SELECT snap, row_number() OVER (ORDER BY snap) - 1 AS rn, count(*) OVER () AS n FROM d),
c AS (SELECT snap AS threshold FROM n WHERE rn % greatest(1, n // 400) = 0),
b AS (SELECT sum(CASE WHEN inc AND y = 1 THEN 1 ELSE 0 END) AS tp0, sum(CASE WHEN inc AND y = 0 THEN 1 ELSE 0 END) AS fp0, sum(y) AS p FROM scored),
h AS (SELECT snap, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored WHERE NOT inc GROUP BY snap),
f AS (SELECT threshold, tp0 + coalesce(sum(pos), 0) AS tp, fp0 + coalesce(sum(neg), 0) AS fp, max(p) AS p FROM c LEFT JOIN h ON h.snap >= threshold, b GROUP BY threshold, tp0, fp0)
SELECT threshold, round(2 * tp / (2 * tp + fp + (p - tp)), 6) AS f1 FROM f ORDER BY 2 * tp / (2 * tp + fp + (p - tp)) DESC, threshold LIMIT 1""", "scored"))
def union_rule(spark: SparkSession, d: str) -> DataFrame:
    return metrics.union_rule(_scored(spark, d)).select("threshold", r6("f1").alias("f1"))


@query(duck("SELECT cell, parser, round(avg(snap), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(snap) END, 6) AS std FROM scored GROUP BY ALL", "scored"))
def seed_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.seed_stats(_scored(spark, d), ["cell", "parser"], "snap").select("cell", "parser", r6("mean").alias("mean"), r6("std").alias("std"))


@query(duck("""WITH m AS (SELECT cell, seed, avg(CASE WHEN parser = 'click' THEN snap END) AS a, avg(CASE WHEN parser = 'view' THEN snap END) AS b, max(snap) AS o FROM scored GROUP BY ALL)
SELECT cell, seed, 'p99' AS rule, round(a, 6) AS f1 FROM m UNION ALL SELECT cell, seed, 'sigma', round(b, 6) FROM m UNION ALL SELECT cell, seed, 'oracle', round(o, 6) FROM m""", "scored"))
def cell_explode(spark: SparkSession, d: str) -> DataFrame:
    at = lambda p: F.avg(F.when(F.col("parser") == p, F.col("snap")))
    runs = _scored(spark, d).groupBy("cell", "seed").agg(F.create_map(F.lit("p99"), at("click"), F.lit("sigma"), at("view")).alias("thresholds"), F.max("snap").alias("oracle"))
    cells = runs.groupBy("cell").agg(F.collect_list(F.struct("seed", "thresholds", "oracle")).alias("runs"))
    return metrics.cell_rows(cells).select("cell", "seed", "rule", r6("f1").alias("f1"))


@query(duck("SELECT cell, " + ", ".join(f"round(avg(CASE WHEN parser = '{p}' THEN snap END), 6) AS {p}" for p in ("click", "view", "error")) + " FROM scored GROUP BY cell", "scored"))
def parser_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = ["click", "view", "error"]
    return metrics.pivot_by(_scored(spark, d), ["cell"], "parser", names, "snap").select("cell", *[r6(n).alias(n) for n in names])


@query(duck("SELECT cell, round(avg(y), 6) AS prevalence, round(2 * avg(y) / (1 + avg(y)), 6) AS degenerate_f1 FROM scored GROUP BY cell", "scored"))
def prevalence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prevalence(_scored(spark, d), ["cell"]).select("cell", r6("prevalence").alias("prevalence"), r6("degenerate_f1").alias("degenerate_f1"))


@query(duck("SELECT cell, round(median(p99_ms), 6) AS median, min(p99_ms) AS min, max(p99_ms) AS max, count(p99_ms) AS n FROM sweep GROUP BY cell", "sweep"))
def cell_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cell_stats(view(spark, d, "sweep"), ["cell"], "p99_ms").withColumn("median", r6("median"))


@query(duck("SELECT cell, parser, snap AS best FROM scored QUALIFY row_number() OVER (PARTITION BY cell ORDER BY snap DESC, id) = 1", "scored"))
def model_selection(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pick_first(_scored(spark, d), ["cell"], F.desc("snap"), F.col("id")).select("cell", "parser", F.col("snap").alias("best"))


@query(duck("""WITH e AS (SELECT y, least(CASE WHEN inc THEN snap ELSE 'Infinity'::DOUBLE END, CASE WHEN s >= 45 THEN 30.0 ELSE 'Infinity'::DOUBLE END) AS delay FROM scored),
c AS (SELECT sum(CASE WHEN delay < 'Infinity'::DOUBLE AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN delay < 'Infinity'::DOUBLE AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN delay = 'Infinity'::DOUBLE AND y = 1 THEN 1 ELSE 0 END) AS fn FROM e)
SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, (SELECT round(quantile_cont(delay, 0.5), 6) FROM e WHERE y = 1 AND delay < 'Infinity'::DOUBLE) AS delay_p50 FROM c""", "scored"))
def early_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select(F.when(F.col("inc"), F.col("snap")).alias("inc_delay"), F.col("s").alias("snap"), "y")
    return metrics.early_rule(rows, 30, 45.0).select("tp", "fp", "fn", r6("f1").alias("f1"), r6("delay_p50").alias("delay_p50"))


# ---- store, feedback, drift ----------------------------------------------------------------------------------------

@query(duck("SELECT id, run, session_key, status, score FROM alerts WHERE status = 'open' AND score >= 20 AND id > 1000 ORDER BY id LIMIT 100", "alerts"))
def alert_page(spark: SparkSession, d: str) -> DataFrame:
    page, _ = store.list_alerts(view(spark, d, "alerts"), (F.col("status") == "open") & (F.col("score") >= 20), after=1000, ascending=True, limit=100)
    return page.select("id", "run", "session_key", "status", "score")


@query(duck("""SELECT a.id, count(b.id) AS n_events, md5(coalesce(string_agg(CAST(b.id AS STRING), ',' ORDER BY b.created_ns, b.id), '')) AS trail FROM alerts a
LEFT JOIN alerts b ON b.run = a.run AND b.session_key = a.session_key AND b.id > a.id GROUP BY a.id""", "alerts"))
def alert_trail(spark: SparkSession, d: str) -> DataFrame:
    """Each alert with the later ones of its session as its trail."""
    alerts = view(spark, d, "alerts").select("id", "run", "session_key", "created_ns")
    later = alerts.withColumnsRenamed({"id": "id2", "created_ns": "ts_ns"})
    events = alerts.select("id", "run", "session_key").join(later, ["run", "session_key"]).filter("id2 > id")
    events = events.select(F.col("id").alias("alert_id"), "ts_ns", F.col("id2").alias("from_status"), F.lit("").alias("to_status"), F.lit("").alias("actor"), F.lit("").alias("note"))
    out = store.with_trail(alerts.select("id"), events)
    ids = F.coalesce(F.array_join(F.transform("trail", lambda e: e["from_status"].cast("string")), ","), F.lit(""))
    return out.select("id", F.coalesce(F.size("trail"), F.lit(0)).cast("long").alias("n_events"), F.md5(ids).alias("trail")).withColumn("n_events", F.greatest(F.col("n_events"), F.lit(0)))


@query(duck("""WITH m(f, t) AS (VALUES ('open', 'acknowledged'), ('open', 'resolved'), ('open', 'false_positive'), ('acknowledged', 'open'), ('acknowledged', 'resolved'), ('acknowledged', 'false_positive'), ('resolved', 'open'), ('false_positive', 'open')),
c AS (SELECT id, status, CASE id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'acknowledged' END AS t FROM alerts WHERE id % 2 = 0)
SELECT a.id, CASE WHEN m.f IS NOT NULL THEN c.t ELSE a.status END AS status, c.id IS NOT NULL AND m.f IS NULL AS rejected FROM alerts a LEFT JOIN c ON a.id = c.id LEFT JOIN m ON m.f = c.status AND m.t = c.t""", "alerts"))
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    alerts = view(spark, d, "alerts")
    to = F.when(F.col("id") % 3 == 0, "resolved").when(F.col("id") % 3 == 1, "open").otherwise("acknowledged")
    commands = alerts.filter("id % 2 = 0").select(F.col("id").alias("alert_id"), to.alias("to_status"), F.lit("me").alias("actor"), F.lit(" ").alias("note"), F.col("created_ns").alias("ts_ns"))
    after, _, rejected = store.change_status(alerts, commands)
    return after.join(rejected.select(F.col("alert_id").alias("id"), F.lit(True).alias("rejected")), "id", "left").select("id", "status", F.coalesce("rejected", F.lit(False)).alias("rejected"))


@query(duck("""SELECT 'total' AS dimension, 'all' AS item, count(*) AS n FROM alerts UNION ALL SELECT 'status', status, count(*) FROM alerts GROUP BY status
UNION ALL SELECT 'kind', kind, count(*) FROM alerts GROUP BY kind UNION ALL SELECT 'run', run, count(*) FROM alerts GROUP BY run""", "alerts"))
def alert_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.alert_counts(view(spark, d, "alerts"))


@query(duck("""WITH l AS (SELECT run, (ingested_ns - nullif(t_send_ns, 0)) / 1e6 AS ms FROM alerts WHERE nullif(t_send_ns, 0) IS NOT NULL)
SELECT run, round(ms, 6) AS upper_median FROM l QUALIFY row_number() OVER (PARTITION BY run ORDER BY ms) = count(*) OVER (PARTITION BY run) // 2 + 1""", "alerts"))
def ingest_lag(spark: SparkSession, d: str) -> DataFrame:
    lag = (F.col("ingested_ns") - F.nullif(F.col("t_send_ns"), F.lit(0))) / 1e6
    return store.upper_median(view(spark, d, "alerts").select("run", lag.alias("ms")), ["run"], "ms").withColumn("upper_median", r6("upper_median"))


@query(duck("SELECT round(sum(CASE WHEN status = 'false_positive' THEN 1 ELSE 0 END) / sum(CASE WHEN status IN ('false_positive', 'resolved') THEN 1 ELSE 0 END), 6) AS fp_share FROM alerts", "alerts"))
def fp_share(spark: SparkSession, d: str) -> DataFrame:
    return store.alert_summary(view(spark, d, "alerts")).select(r6("fp_share").alias("fp_share"))


@query(duck("""SELECT ts_ns // 1000000000 AS second, round(sum(rate_eps), 6) AS rate_eps, sum(lag) AS lag, sum(open_sessions) AS open_sessions, sum(alerts) AS alerts, max(p99_ms) AS p99_ms, max(watermark) AS watermark
FROM samples WHERE run = 'run1' GROUP BY 1 ORDER BY 1 DESC LIMIT 300""", "samples"))
def metric_series(spark: SparkSession, d: str) -> DataFrame:
    return store.metric_series(view(spark, d, "samples"), "run1", 300).select("second", r6("rate_eps").alias("rate_eps"), "lag", "open_sessions", "alerts", "p99_ms", "watermark")


@query(duck("SELECT max(watermark) AS watermark FROM samples WHERE ts_ns >= 300000000000 - 15000000000 AND ts_ns <= 300000000000", "samples"))
def latest_watermark(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_watermark(view(spark, d, "samples").filter("ts_ns <= 300000000000"), F.lit(300_000_000_000))


@query(duck("""WITH r AS (SELECT CASE WHEN threshold IS NOT NULL AND threshold <> 0 THEN score / threshold ELSE score END AS r FROM alerts),
b AS (SELECT min(r) AS low, CASE WHEN max(r) > min(r) THEN (max(r) - min(r)) / 20 ELSE 1 END AS width FROM r),
p AS (SELECT least(19, CAST(floor((r - low) / width) AS INT)) AS bin, count(*) AS n FROM r, b GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, round(low + g.bin * width, 6) AS low, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) g LEFT JOIN p ON g.bin = p.bin, b""", "alerts"))
def score_hist(spark: SparkSession, d: str) -> DataFrame:
    return store.score_histogram(view(spark, d, "alerts")).select("bin", r6("low").alias("low"), "n")


@query(duck("""WITH k AS (SELECT id, run, t_ns, 'blk_' || unnest([user_id, user_id + 1, user_id + 3]) AS session_key FROM injections),
f AS (SELECT run, session_key, min(created_ns) AS created_ns FROM alerts GROUP BY ALL), h AS (SELECT k.id, (created_ns - t_ns) / 1e6 AS ms FROM k JOIN f ON k.run = f.run AND k.session_key = f.session_key),
u AS (SELECT id, ms FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY ms) = count(*) OVER (PARTITION BY id) // 2 + 1)
SELECT i.id, i.scenario, CAST(3 AS INT) AS injected, coalesce(n, 0) AS detected, round(u.ms, 6) AS p50_ms, round(mx, 6) AS max_ms FROM injections i
LEFT JOIN (SELECT id, count(*) AS n, max(ms) AS mx FROM h GROUP BY id) c ON c.id = i.id LEFT JOIN u ON u.id = i.id""", "alerts", "injections"))
def injection_results(spark: SparkSession, d: str) -> DataFrame:
    keys = F.transform(F.array(*[F.col("user_id") + k for k in (0, 1, 3)]), lambda u: F.concat(F.lit("blk_"), u.cast("string")))
    injections = view(spark, d, "injections").withColumn("keys", keys)
    first = view(spark, d, "alerts").groupBy("run", "session_key").agg(F.min("created_ns").alias("created_ns"))
    return store.injection_results(injections, first).select("id", "scenario", "injected", "detected", r6("p50_ms").alias("p50_ms"), r6("max_ms").alias("max_ms"))


@query(duck("SELECT cell AS name, id, CAST(row_number() OVER (PARTITION BY cell ORDER BY id % 2, id) AS INT) AS version FROM scored", "scored"))
def registry_versions(spark: SparkSession, d: str) -> DataFrame:
    """Even ids stand in the registry; odd ones are registered after them, name by name."""
    rows = _scored(spark, d).select(F.col("cell").alias("name"), "id", F.col("parser").alias("dataset"))
    empty = rows.limit(0).select("*", F.lit(0).alias("version"), F.lit("").alias("status"))
    have = store.register_models(empty, rows.filter("id % 2 = 0").withColumn("nth", F.col("id")))
    return store.register_models(cut(have), rows.filter("id % 2 = 1").withColumn("nth", F.col("id"))).select("name", "id", "version")


@query(duck("SELECT cell AS name, id, CASE WHEN cell = 'g1' AND rn = 3 THEN 'active' ELSE 'registered' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY id) AS rn FROM scored)", "scored"))
def registry_active(spark: SparkSession, d: str) -> DataFrame:
    """Two activations one after the other, in one dataset: only the last model is active."""
    rows = _scored(spark, d).select(F.col("cell").alias("name"), "id", F.lit("logs").alias("dataset"))
    empty = rows.limit(0).select("*", F.lit(0).alias("version"), F.lit("").alias("status"))
    have = cut(store.register_models(empty, rows.withColumn("nth", F.col("id"))))
    return store.activate_model(store.activate_model(have, "g0", 1), "g1", 3).select("name", "id", "status")


@query(duck("SELECT id FROM (SELECT *, row_number() OVER (ORDER BY created_ns DESC, id DESC) AS rn FROM alerts) WHERE rn > 500 AND status <> 'open'", "alerts"))
def retention_keep_n(spark: SparkSession, d: str) -> DataFrame:
    return store.to_delete(view(spark, d, "alerts"), keep_newest=500, protected=F.col("status") == "open").select("id")


@query(duck(f"""WITH {SPLITS}, fp AS (SELECT DISTINCT session_key FROM alerts WHERE status = 'false_positive' AND run = 'run1')
SELECT session_id, label, CASE WHEN fp.session_key IS NOT NULL THEN 'train' ELSE split END AS split FROM splits LEFT JOIN fp ON fp.session_key = session_id""", "sessions", "alerts"))
def fp_fold(spark: SparkSession, d: str) -> DataFrame:
    keys = store.false_positive_keys(view(spark, d, "alerts"), "run1")
    return store.fold_feedback(_splits(spark, d), keys, 1)[0].select("session_id", "label", "split")


@query(duck(f"""WITH {TERMS}, share AS (SELECT term, sum(cnt) / (SELECT sum(cnt) FROM counts) AS share FROM counts GROUP BY term),
top AS (SELECT term FROM share JOIN vocab USING (term) ORDER BY share DESC, term_id LIMIT 2)
SELECT term, CASE WHEN term IN (SELECT term FROM top) THEN term || ' status=ok' ELSE term END AS term_after, round(share, 6) AS share FROM share""", "loglines"))
def drift_map(spark: SparkSession, d: str) -> DataFrame:
    counts = cut(_counts(spark, d))
    total = counts.agg(F.sum("cnt").alias("all"))
    share = counts.groupBy("term").agg(F.sum("cnt").alias("n")).crossJoin(total).select("term", (F.col("n") / F.col("all")).alias("share"))  # total: one row
    return drift.drift_map(features.vocabulary(counts), share, 2).select("term", "term_after", r6("share").alias("share"))


@query(duck("SELECT session_id, CAST(ntile(10) OVER (ORDER BY ts, session_id) - 1 AS INT) AS chunk FROM sessions", "sessions"))
def chunks_ntile(spark: SparkSession, d: str) -> DataFrame:
    return drift.chunks(view(spark, d, "sessions")).select("session_id", "chunk")


@query(duck(f"""WITH {TERMS}, {SPLITS}, {COLS}, ch AS (SELECT session_id, CAST(ntile(10) OVER (ORDER BY ts, session_id) - 1 AS INT) AS chunk FROM sessions)
SELECT chunk, round(sum(CASE WHEN col = 0 THEN cnt ELSE 0 END) / sum(cnt), 6) AS unk_share FROM bycol JOIN ch USING (session_id) GROUP BY chunk""", "loglines", "sessions"))
def unk_share(spark: SparkSession, d: str) -> DataFrame:
    chunk = drift.chunks(view(spark, d, "sessions")).select("session_id", "chunk")
    return drift.unknown_share(_columns(spark, d)[0].join(chunk, "session_id"), ["chunk"]).select("chunk", r6("unk_share").alias("unk_share"))


@query(duck("""WITH c AS (SELECT CAST(id % 10 AS INT) AS chunk, s, y FROM scored), k AS (SELECT chunk, sum(CASE WHEN s >= 30 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s >= 30 AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(y) AS p, count(*) AS n FROM c GROUP BY chunk),
g AS (SELECT chunk, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM c GROUP BY ALL), a AS (SELECT chunk, sum(pos * (coalesce(under, 0) + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM
(SELECT *, sum(neg) OVER (PARTITION BY chunk ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM g) GROUP BY chunk)
SELECT chunk, tp, fp, round(fp / (n - p), 6) AS fpr, round((tp + fp) / n, 6) AS alert_rate, round(auc, 6) AS roc_auc FROM k JOIN a USING (chunk)""", "scored"))
def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("chunk", (F.col("id") % 10).cast("int"))
    return drift.chunk_metrics(rows, 30.0).select("chunk", "tp", "fp", *[r6(c).alias(c) for c in ("fpr", "alert_rate", "roc_auc")])


@query(duck("""WITH m AS (SELECT cell AS arm, parser AS condition, CAST(id % 10 AS INT) AS chunk, avg(snap) AS f1 FROM scored GROUP BY ALL)
SELECT o.arm, o.condition, round(avg(b.f1 - o.f1), 6) AS penalty FROM m o JOIN m b ON b.condition = 'view' AND b.arm = o.arm AND b.chunk = o.chunk WHERE o.condition <> 'view' AND o.chunk >= 5 GROUP BY ALL""", "scored"))
def penalty(spark: SparkSession, d: str) -> DataFrame:
    table = _scored(spark, d).groupBy(F.col("cell").alias("arm"), F.col("parser").alias("condition"), (F.col("id") % 10).cast("int").alias("chunk")).agg(F.avg("snap").alias("f1"))
    return drift.penalty(table, "view", 5).withColumn("penalty", r6("penalty"))


# ---- latency and throughput -----------------------------------------------------------------------------------------

_LAT = """lat AS (SELECT run, session_key, unnest(['producer_to_broker', 'broker_to_consumer', 'engine_update', 'scoring', 'alert_publish', 'total']) AS stage,
unnest([t_broker_ms * 1000000 - t_send_ns, t_recv_ns - t_broker_ms * 1000000, t_scored_ns - score_ns - t_recv_ns, score_ns, t_alert_ns - t_scored_ns, t_alert_ns - t_send_ns]) AS ns
FROM records WHERE alerted AND kind <> 'deadline_eos' AND t_broker_ms IS NOT NULL)"""


@query(duck(f"WITH {_LAT} SELECT run, session_key, stage, round(greatest(0, ns / 1e6), 6) AS ms FROM lat", "records"))
def stage_latency(spark: SparkSession, d: str) -> DataFrame:
    return perf.stage_latencies(view(spark, d, "records")).withColumn("ms", r6("ms"))


@query(duck(f"""WITH {_LAT}, x AS (SELECT stage, greatest(0, ns / 1e6) AS ms FROM lat) SELECT stage, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95,
round(quantile_cont(ms, 0.99), 6) AS p99, round(quantile_cont(ms, 0.999), 6) AS p99_9, round(avg(CASE WHEN ms > 500 THEN 1 ELSE 0 END), 6) AS over_500 FROM x GROUP BY stage""", "records"))
def pooled_latency(spark: SparkSession, d: str) -> DataFrame:
    out = perf.pooled_latency(perf.stage_latencies(view(spark, d, "records")), ["stage"])
    return out.select("stage", "n", *[r6(c).alias(c) for c in ("p50", "p95", "p99", "p99_9", "over_500")])


_SERIES = "series AS (SELECT run, ts_ns // 1000000000 AS second, sum(rate_eps) AS rate_eps, sum(coalesce(lag, 0)) AS lag, count(DISTINCT worker) AS workers FROM samples GROUP BY ALL)"


@query(duck(f"WITH {_SERIES} SELECT run, second, round(rate_eps, 6) AS rate_eps, lag, workers FROM series", "samples"))
def series_per_second(spark: SparkSession, d: str) -> DataFrame:
    return perf.series_per_second(view(spark, d, "samples")).withColumn("rate_eps", r6("rate_eps"))


@query(duck(f"WITH {_SERIES} SELECT run, round(median(rate_eps), 6) AS busy_rate FROM series WHERE lag > 1000 GROUP BY run", "samples"))
def busy_rate(spark: SparkSession, d: str) -> DataFrame:
    return perf.busy_rate(perf.series_per_second(view(spark, d, "samples"))).withColumn("busy_rate", r6("busy_rate"))


_OK = "achieved >= 0.97::DOUBLE * offered AND drain_s <= 1 AND (p99_ms IS NULL OR p99_ms <= 500)"


@query(duck(f"""WITH m AS (SELECT cell, offered, avg(achieved) AS achieved, avg(drain_s) AS drain_s, max(p99_ms) - 50 AS p99_ms FROM sweep GROUP BY ALL),
r AS (SELECT *, bool_and({_OK}) OVER (PARTITION BY cell ORDER BY offered) AS ok FROM m) SELECT cell, max(CASE WHEN ok THEN offered END) AS saturation FROM r GROUP BY cell""", "sweep"))
def saturation(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sweep").groupBy("cell", "offered").agg(F.avg("achieved").alias("achieved"), F.avg("drain_s").alias("drain_s"), (F.max("p99_ms") - 50).alias("p99_ms"))
    return perf.saturation(rows, ["cell"])


def _upper(c: str) -> str:
    return f"list_sort(list({c}))[count(*) // 2 + 1]"


@query(duck(f"""WITH m AS (SELECT cell, offered, {_upper("achieved")} AS achieved, {_upper("drain_s")} AS drain_s, {_upper("coalesce(p99_ms, 0)")} AS p99_ms FROM sweep GROUP BY ALL),
r AS (SELECT *, bool_and({_OK}) OVER (PARTITION BY cell ORDER BY offered) AS ok FROM m) SELECT cell, max(CASE WHEN ok THEN offered END) AS saturation FROM r GROUP BY cell""", "sweep"))
def saturation_median(spark: SparkSession, d: str) -> DataFrame:
    return perf.upper_median_saturation(view(spark, d, "sweep"), ["cell"])


@query(duck(f"""WITH {_SERIES}, b AS (SELECT run, second, lag, max(lag) OVER (PARTITION BY run ORDER BY second ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM series WHERE second >= 200)
SELECT run, min(second - 200) AS recovery_s FROM b WHERE later <= 9000 GROUP BY run""", "samples"))
def recovery(spark: SparkSession, d: str) -> DataFrame:
    rows = perf.series_per_second(view(spark, d, "samples")).select("run", F.col("second").alias("t"), "lag", F.lit(200).cast("long").alias("spike_end"), F.lit(9000.0).alias("base_lag"))
    return perf.recovery_seconds(rows)


_WINS = """marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY run ORDER BY t) <= 1 THEN 0 ELSE 1 END AS new FROM slow WHERE ms >= 300),
isl AS (SELECT *, CAST(sum(new) OVER (PARTITION BY run ORDER BY t) AS INT) AS nth FROM marked),
wins AS (SELECT run, nth, min(t) AS low, max(t) AS high, max(t + ms / 1000) AS until, count(*) AS n, max(ms) AS max_ms FROM isl GROUP BY run, nth)"""


@query(duck(f"WITH {_WINS} SELECT run, nth, low, high, round(until, 6) AS until, n, max_ms FROM wins", "slow"))
def excursions(spark: SparkSession, d: str) -> DataFrame:
    return perf.excursions(view(spark, d, "slow")).withColumn("until", r6("until"))


_PROBES = "probes AS (SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, CAST(event_id AS DOUBLE) / 4 + 0.1 AS t, value AS other_cpu, CAST(user_id AS DOUBLE) AS busy, CAST(event_id % 3000 AS DOUBLE) AS freq FROM ev WHERE event_id % 2 = 1)"
_STOPS = "stops AS (SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, CAST(event_id AS DOUBLE) / 4 AS t, CAST(event_id % 900 AS DOUBLE) AS ms FROM ev WHERE event_id % 5 = 0)"


def _probes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = view(spark, d, "ev").withColumn("run", F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string"))).withColumn("t", F.col("event_id").cast("double") / 4)
    probes = e.filter("event_id % 2 = 1").select("run", (F.col("t") + 0.1).alias("t"), F.col("value").alias("other_cpu"), F.col("user_id").cast("double").alias("busy"), (F.col("event_id") % 3000).cast("double").alias("freq"))
    return probes, e.filter("event_id % 5 = 0").select("run", "t", (F.col("event_id") % 900).cast("double").alias("ms"))


@query(duck(f"""WITH {_WINS}, {_PROBES}, {_STOPS}, a AS (SELECT w.run, w.nth, count(p.t) AS n, max(other_cpu) AS cpu_max, max(busy) AS busy_max, min(freq) AS freq_min FROM wins w LEFT JOIN probes p ON p.run = w.run AND p.t BETWEEN w.low - 0.5 AND w.until + 0.5 GROUP BY ALL),
b AS (SELECT w.run, w.nth, max(s.ms) AS pause_max FROM wins w JOIN stops s ON s.run = w.run AND w.low <= s.t AND s.t - s.ms / 1000 <= w.until GROUP BY ALL)
SELECT a.run, a.nth, n, coalesce(cpu_max, 0) AS cpu_max, coalesce(busy_max, 0) AS busy_max, coalesce(freq_min, 0) AS freq_min, coalesce(pause_max, 0) AS pause_max FROM a LEFT JOIN b ON a.run = b.run AND a.nth = b.nth""", "slow"))
def interval_features(spark: SparkSession, d: str) -> DataFrame:
    probes, stops = _probes(spark, d)
    return perf.interval_features(probes, stops, cut(perf.excursions(view(spark, d, "slow"))))


@query(duck(f"""WITH {_WINS}, r AS (SELECT run, min(t) AS s, max(t) AS e FROM slow GROUP BY run), bins AS (SELECT run, s + k AS t FROM r, (SELECT unnest(range(1, 1000000)) AS k) WHERE s + k + 1 <= e)
SELECT run, t FROM bins b WHERE NOT EXISTS (SELECT 1 FROM wins w WHERE w.run = b.run AND w.low <= b.t + 1 AND w.until >= b.t)""", "slow"))
def normal_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "slow")
    runs = rows.groupBy("run").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return perf.normal_bins(runs, cut(perf.excursions(rows)))


_FREE = """r AS (SELECT run, min(t) AS s, max(t) AS e FROM slow GROUP BY run), bins AS (SELECT run, s + k AS t FROM r, (SELECT unnest(range(1, 1000000)) AS k) WHERE s + k + 1 <= e),
free AS (SELECT run, t FROM bins b WHERE NOT EXISTS (SELECT 1 FROM wins w WHERE w.run = b.run AND w.low <= b.t + 1 AND w.until >= b.t)),
spans AS (SELECT 'slow' AS sort, run, low, until FROM wins UNION ALL SELECT 'normal', run, t, t + 1 FROM free),
seen AS (SELECT sort, s.run, low, until, coalesce(max(other_cpu), 0) AS cpu_max, coalesce(min(freq), 0) AS freq_min FROM spans s LEFT JOIN probes p ON p.run = s.run AND p.t BETWEEN low - 0.5 AND until + 0.5 GROUP BY ALL),
halted AS (SELECT sort, s.run, low, until, coalesce(max(o.ms), 0) AS pause_max FROM spans s LEFT JOIN stops o ON o.run = s.run AND low <= o.t AND o.t - o.ms / 1000 <= until GROUP BY ALL)"""


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Features of the bins without slow alerts and of the clusters of slow ones."""
    rows = view(spark, d, "slow")
    probes, stops = _probes(spark, d)
    wins = cut(perf.excursions(rows))
    free = perf.normal_bins(rows.groupBy("run").agg(F.min("t").alias("start"), F.max("t").alias("end")), wins)
    free = cut(free.select("run", (F.col("t") * 4).cast("long").alias("nth"), F.col("t").alias("low"), (F.col("t") + 1).alias("until")))
    return cut(perf.interval_features(probes, stops, free)), cut(perf.interval_features(probes, stops, wins))


@query(duck(f"""WITH {_WINS}, {_PROBES}, {_STOPS}, {_FREE}, f AS (SELECT sort, unnest(['cpu_max', 'freq_min']) AS feature, unnest([cpu_max, freq_min]) AS v FROM seen UNION ALL SELECT sort, 'pause_max', pause_max FROM halted)
SELECT feature, round(quantile_cont(v, 0.5) FILTER (sort = 'normal'), 6) AS p50, round(quantile_cont(v, 0.95) FILTER (sort = 'normal'), 6) AS p95, round(quantile_cont(v, 0.99) FILTER (sort = 'normal'), 6) AS p99,
round(quantile_cont(v, 0.5) FILTER (sort = 'slow'), 6) AS slow_median, round(max(v) FILTER (sort = 'slow'), 6) AS slow_max FROM f GROUP BY feature""", "slow"))
def window_compare(spark: SparkSession, d: str) -> DataFrame:
    """Processor, frequency and pauses in normal seconds against those in clusters of slow alerts."""
    normal, slow = _windows(spark, d)
    out = perf.compare_windows(normal, slow, ["cpu_max", "freq_min", "pause_max"])
    return out.select("feature", *[r6(c).alias(c) for c in ("p50", "p95", "p99", "slow_median", "slow_max")])


@query(duck(f"""WITH {_WINS}, {_PROBES}, {_STOPS}, {_FREE} SELECT count(*) FILTER (sort = 'slow') AS slow, count(*) FILTER (sort = 'slow' AND pause_max > 0) AS slow_paused,
round(count(*) FILTER (sort = 'slow' AND pause_max > 0) / nullif(count(*) FILTER (sort = 'slow'), 0), 6) AS slow_share, count(*) FILTER (sort = 'normal') AS normal, count(*) FILTER (sort = 'normal' AND pause_max > 0) AS normal_paused,
round(count(*) FILTER (sort = 'normal' AND pause_max > 0) / nullif(count(*) FILTER (sort = 'normal'), 0), 6) AS normal_share FROM halted""", "slow"))
def overlap_shares(spark: SparkSession, d: str) -> DataFrame:
    """How many clusters of slow alerts, and how many normal seconds, overlap a pause."""
    normal, slow = _windows(spark, d)
    return perf.overlap_shares(normal, slow).withColumns({c: r6(c) for c in ("slow_share", "normal_share")})


@query(duck(f"WITH {_WINS} SELECT run, nth, n, round(m1, 6) AS engine_update_mean, round(m2, 6) AS scoring_mean FROM (SELECT run, nth, count(*) AS n, avg(ms / 4) AS m1, avg(ms % 50) AS m2 FROM isl GROUP BY run, nth)", "slow"))
def excursion_stages(spark: SparkSession, d: str) -> DataFrame:
    """Means of two stages in each cluster of slow alerts."""
    rows = view(spark, d, "slow").withColumns({"engine_update": F.col("ms") / 4, "scoring": F.col("ms") % 50})
    return perf.excursions(rows).select("run", "nth", "n", r6("engine_update_mean").alias("engine_update_mean"), r6("scoring_mean").alias("scoring_mean"))


@query(duck("""WITH c AS (SELECT CAST(offered / 1000 AS INT) AS workers, median(achieved) AS median, min(achieved) AS min, max(achieved) AS max, count(achieved) AS n FROM sweep GROUP BY 1),
b AS (SELECT median AS base FROM c WHERE workers = 1)
SELECT workers, round(median, 6) AS median, min, max, n, round(median / base, 6) AS speedup, round(median / base / workers, 6) AS efficiency FROM c, b""", "sweep"))
def worker_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Rates reached at each number of workers against one worker."""
    rows = view(spark, d, "sweep").withColumn("workers", (F.col("offered") / 1000).cast("int"))
    return perf.scaling(rows, "achieved").select("workers", r6("median").alias("median"), "min", "max", "n", r6("speedup").alias("speedup"), r6("efficiency").alias("efficiency"))


@query(duck("""WITH ends AS (SELECT run, CAST(floor(max(t) / 300) AS BIGINT) AS final FROM slow GROUP BY run),
seg AS (SELECT run, s AS segment, s * 300.0 AS low, s * 300.0 + 200.0 AS high FROM (SELECT run, unnest(range(final + 1)) AS s FROM ends))
SELECT a.run, segment, count(*) AS n, round(quantile_cont(ms, 0.99), 6) AS p99 FROM slow a JOIN seg ON seg.run = a.run AND t BETWEEN low AND high GROUP BY ALL""", "slow"))
def windowed_p99(spark: SparkSession, d: str) -> DataFrame:
    """Segments of 200 seconds every 300, up to the end of each run."""
    rows = view(spark, d, "slow")
    ends = rows.groupBy("run").agg(F.floor(F.max("t") / 300).alias("final"))
    segments = ends.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("final")))).select("run", "segment", (F.col("segment") * 300.0).alias("low"), (F.col("segment") * 300.0 + 200.0).alias("high"))
    return perf.windowed_p99(rows, segments).withColumn("p99", r6("p99"))


@query(duck(f"WITH {_SERIES}, o AS (SELECT second - min(second) OVER (PARTITION BY run) AS \"offset\", lag FROM series) SELECT \"offset\", round(median(lag), 6) AS median, min(lag) AS min, max(lag) AS max, count(lag) AS n FROM o GROUP BY 1 HAVING count(lag) >= 2", "samples"))
def aligned_curve(spark: SparkSession, d: str) -> DataFrame:
    return perf.aligned_curve(perf.series_per_second(view(spark, d, "samples")), 3).withColumn("median", r6("median"))


@query(duck("""WITH live AS (SELECT * FROM alerts WHERE kind <> 'deadline_eos'), l AS (SELECT concat('blk_', CAST(user_id AS STRING)) AS session_id, CAST(user_id % 2 AS INT) AS label FROM ev WHERE user_id % 5 <> 0 GROUP BY ALL),
s AS (SELECT DISTINCT session_key, label FROM live LEFT JOIN l ON session_key = session_id)
SELECT (SELECT count(*) FROM live) AS live_alerts, count(*) AS sessions, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS true_alarms, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS false_alarms,
(SELECT round(quantile_cont(ms, 0.5), 6) FROM live WHERE kind = 'incremental') AS p50, (SELECT round(quantile_cont(ms, 0.99), 6) FROM live WHERE kind = 'incremental') AS p99 FROM s""", "alerts"))
def alert_analysis(spark: SparkSession, d: str) -> DataFrame:
    labels = view(spark, d, "ev").filter("user_id % 5 <> 0").select(F.concat(F.lit("blk_"), F.col("user_id").cast("string")).alias("session_id"), (F.col("user_id") % 2).cast("int").alias("label")).distinct()
    return perf.alert_analysis(view(spark, d, "alerts"), labels).select("live_alerts", "sessions", "true_alarms", "false_alarms", r6("p50").alias("p50"), r6("p99").alias("p99"))


@query(duck("""WITH c AS (SELECT 'run' || user_id % 3 AS run, CAST(user_id % 4 AS INT) AS core, event_id AS t, sum(value) OVER w AS busy, sum(event_id % 3 * 60) OVER w AS total FROM ev WINDOW w AS (PARTITION BY user_id % 3, user_id % 4 ORDER BY event_id)),
x AS (SELECT *, busy - lag(busy) OVER w AS db, total - lag(total) OVER w AS dt FROM c WINDOW w AS (PARTITION BY run, core ORDER BY t))
SELECT run, core, t, round(CASE WHEN dt IS NULL THEN NULL WHEN dt > 0 THEN db / dt ELSE 0 END, 6) AS util FROM x"""))
def counter_delta(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run", "core").orderBy("t")
    e = view(spark, d, "ev").select(F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run"), (F.col("user_id") % 4).cast("int").alias("core"), F.col("event_id").alias("t"), "value")
    counters = e.withColumn("busy", F.sum("value").over(w)).withColumn("total", F.sum(F.col("t") % 3 * 60).over(w))
    return perf.counter_utilisation(counters).select("run", "core", "t", r6("util").alias("util"))


@query(duck("""WITH l AS (SELECT run, worker, max_by(coalesce(lag, 0), ts_ns) AS lag, max(ts_ns) AS ts FROM samples WHERE ts_ns <= 300000000000 GROUP BY ALL) SELECT run, sum(lag) AS lag FROM l WHERE ts >= 300000000000 - 3000000000 GROUP BY run""", "samples"))
def total_lag(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "samples").filter("ts_ns <= 300000000000").withColumn("lag", F.coalesce("lag", F.lit(0.0)))
    return perf.total_lag(rows, F.lit(300_000_000_000))


@query(duck("""SELECT run, count(t_recv_ns) AS consumed, count(t_send_ns) AS sent, round((max(t_recv_ns) - min(t_recv_ns)) / 1e9, 6) AS span_s, round((max(t_recv_ns) - max(t_send_ns)) / 1e9, 6) AS drain_s,
sum(CASE WHEN alerted AND kind = 'incremental' THEN 1 ELSE 0 END) AS n_incremental, count(t_recv_ns) = count(t_send_ns) AS complete FROM records GROUP BY run""", "records"))
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    return perf.run_rollup(view(spark, d, "records")).select("run", "consumed", "sent", r6("span_s").alias("span_s"), r6("drain_s").alias("drain_s"), "n_incremental", "complete")


@query(duck("""WITH b AS (SELECT median(achieved) AS b FROM sweep WHERE offered = 1000) SELECT offered, round(median(achieved), 6) AS median, count(achieved) AS n, round(median(achieved) / max(b), 6) AS ratio FROM sweep, b GROUP BY offered""", "sweep"))
def against_baseline(spark: SparkSession, d: str) -> DataFrame:
    return perf.against_baseline(view(spark, d, "sweep"), ["offered"], "achieved", F.col("offered") == 1000).select("offered", r6("median").alias("median"), "n", r6("ratio").alias("ratio"))


@query(duck("""WITH m AS (SELECT cell, offered AS rate, round(avg(achieved), 6) AS v FROM sweep GROUP BY ALL) SELECT a.rate, a.v AS v_a, b.v AS v_b FROM m a JOIN m b ON a.rate = b.rate WHERE a.cell = 'c1' AND b.cell = 'c2' AND b.rate > 2000""", "sweep"))
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "sweep").groupBy("cell", F.col("offered").alias("rate")).agg(r6(F.avg("achieved")).alias("v"))
    return perf.side_by_side(m.filter("cell = 'c1'").drop("cell"), m.filter("cell = 'c2' and rate > 2000").drop("cell"))


@query(duck("SELECT run, count(*) AS n FROM alerts WHERE id % 2 = 0 AND id % 3 <> 0 AND run <> 'run2' GROUP BY run", "alerts"))
def good_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "alerts").select("run", (F.col("id") % 2 == 0).alias("complete"), (F.col("id") % 3 == 0).alias("cold"))
    return perf.good_runs(rows, rows.filter("run = 'run2'").select("run").distinct()).groupBy("run").agg(F.count("*").alias("n"))


@query(duck("""WITH n AS (SELECT max(event_id) + 1 AS n FROM ev), p AS (SELECT CAST(n * 40 // 280 AS BIGINT) AS a, CAST(n * 240 // 280 AS BIGINT) AS b FROM n)
SELECT CASE WHEN event_id < a THEN 'before' WHEN event_id < b THEN 'spike' ELSE 'after' END AS segment, count(*) AS n FROM ev, p GROUP BY 1"""))
def rate_segments(spark: SparkSession, d: str) -> DataFrame:
    """All events as one run of 40 % before, 20 % at ten times the rate and 40 % after: 40, 200 and 40 of 280 parts."""
    rows = view(spark, d, "ev").select(F.col("event_id").alias("at"))
    n = (rows.agg(F.max("at")).first()[0] or 0) + 1
    ends = [n * 40 // 280, n * 240 // 280, n]
    return perf.assign_segments(rows, [(name, b - a) for name, a, b in zip(("before", "spike", "after"), [0, *ends], ends)]).groupBy("segment").agg(F.count("*").alias("n"))


@query(duck(f"""WITH RECURSIVE {_SERIES}, o AS (SELECT run, CAST(second AS DOUBLE) AS t, lag > 2000 AS above FROM series),
i AS (SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY t) AS island FROM o),
h AS (SELECT run, t FROM (SELECT *, min(t) OVER (PARTITION BY run, island) AS since FROM i WHERE above) WHERE t - since >= 2),
pick AS (SELECT run, min(t) AS t, 1 AS k FROM h GROUP BY run UNION ALL SELECT p.run, min(h.t), p.k + 1 FROM pick p JOIN h ON h.run = p.run AND h.t >= p.t + 10 WHERE p.k < 3 GROUP BY p.run, p.k)
SELECT run, t FROM pick""", "samples"))
def held_over(spark: SparkSession, d: str) -> DataFrame:
    rows = perf.series_per_second(view(spark, d, "samples")).select("run", F.col("second").cast("double").alias("t"), "lag")
    return perf.held_over(rows, 2000, 2)


# ---- streaming ---------------------------------------------------------------------------------------------------------

def in_order(events: DataFrame, batches: int) -> list[DataFrame]:
    """``events`` in ranges of log_t, ascending, each to be a batch of the stream; rows without a time come first."""
    events = cut(events)
    marks = sorted(set(events.select(F.percentile_approx("log_t", [k / batches for k in range(1, batches)], 10_000)).first()[0] or []))
    at = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m <= F.col("log_t"))) if marks else F.lit(0)
    ranged = events.withColumn("_at", F.when(F.col("log_t").isNull(), 0).otherwise(at))
    return [ranged.filter(F.col("_at") == k).drop("_at") for k in range(len(marks) + 1)]


def run_stream(events: DataFrame, scorer: detect.Scorer, min_lines: int, lateness: str, batches: int = 4) -> DataFrame:
    """Alerts for ``events`` (key, col, log_t, event_time): each range of time is written by all tasks, then the stream takes it as a batch."""
    spark = events.sparkSession
    path = shared_path(spark)
    events.limit(0).write.parquet(f"{path}/in")  # the folder, for the reader
    found = detect.detect(spark.readStream.schema(events.schema).parquet(f"{path}/in"), scorer, min_lines, lateness)
    for part in in_order(events, batches):
        part.write.mode("append").parquet(f"{path}/in")
        detect.start(found, f"{path}/state", once=True, path=f"{path}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def _trained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, anomaly.AnomalyModel, DataFrame]:
    """All lines with their columns, splits, a model trained on the first sessions, and its scores."""
    # Each line is rendered and masked once; counts, columns and times come from what is written here.
    lines = cut(_rows(spark, d).select("session_id", "line_id", S.mask(S.content(F.col("line"), HEADER)).alias("term"), S.log_time(F.col("line")).alias("t"), "line"))
    splits = _splits(spark, d)
    counts = cut(lines.groupBy("session_id", "term").agg(F.count("*").alias("cnt"), F.min("line_id").alias("first_line")))
    model = anomaly.train_counts(counts, splits, "regex", "pca", header_tokens=HEADER)
    typed = cut(lines.join(model.columns, "term", "left").select("session_id", "line_id", F.coalesce("col", F.lit(0)).cast("int").alias("col"), "t", "line"))
    scores = cut(model.score_counts(model.column_counts(counts)).select("session_id", "score"))
    return typed, splits, model, scores


@query()
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Incremental and age alerts of a stream of all log lines, by a model trained on the first sessions."""
    typed, splits, model, scores = _trained(spark, d)
    anomaly.attach_early(model, sessions.sequences(typed), splits, scores, AGE, gate=GATE)
    events = detect.event_time(typed.select(F.col("session_id").alias("key"), "col", "line")).drop("line")
    return detect.payload(run_stream(events, detect.scorer(model), GATE, "2 hours"), "run0", "pca").drop("sent_ns")


@query()
def early_study(spark: SparkSession, d: str) -> DataFrame:
    """Rules for early alerts on the test sessions: by lines, or also at an age, with and without a model."""
    typed, splits, model, scores = _trained(spark, d)
    return anomaly.early_study(model, sessions.sequences(typed), splits, scores, [AGE], gate=GATE)


@query()
def drift_study(spark: SparkSession, d: str) -> DataFrame:
    """Retraining policies over four chunks of the test sessions; the five terms of most lines are reworded from the third on."""
    counts, splits = cut(_counts(spark, d)), _splits(spark, d)
    test = drift.chunks(splits.filter("split = 'test'"), 4).select("session_id", "chunk")
    named = cut(splits.join(test, "session_id", "left"))
    lines = counts.agg(F.sum("cnt").alias("lines"))  # one row
    share = counts.groupBy("term").agg(F.sum("cnt").alias("n")).crossJoin(lines).select("term", (F.col("n") / F.col("lines")).alias("share"))
    mapping = drift.drift_map(features.vocabulary(counts), share, 5)
    firsts = counts.groupBy("session_id").agg(F.min("first_line").alias("first_line"))
    drifted = drift.apply_drift(counts, mapping, named.select("session_id", F.coalesce("chunk", F.lit(0)).alias("chunk")), 2).join(firsts, "session_id")
    return anomaly.drift_study(drifted, named)
