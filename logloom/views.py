"""Views of the given tables in the shapes that the operators read: log lines, sessions, alerts, metric samples, run records.

One SELECT serves Spark and DuckDB; only what differs between them (times, formatting) is written twice.
"""

from pyspark.sql import DataFrame, SparkSession

EV_SPARK = """SELECT event_id, user_id, event_type, value, get_json_object(props, '$.k') AS k_prop, date_format(ts, 'yyMMdd HHmmss') AS stamp,
  timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS us FROM {events}"""
EV_DUCK = """SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k') AS k_prop, strftime(ts, '%y%m%d %H%M%S') AS stamp,
  epoch_us(ts) AS us FROM events"""

#: Each over ``ev``.
VIEWS = {
    "loglines": """SELECT event_id AS line_id, concat('blk_', CAST(user_id AS STRING)) AS k, concat(stamp, ' ', CAST(user_id % 7 AS STRING), ' ',
      CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, ' app.', event_type, ': handled ', event_type, ' for blk_', CAST(user_id AS STRING),
      ' from 10.0.0.', CAST(user_id % 250 AS STRING), ':50010 seq ', CAST(event_id AS STRING), ' k ', k_prop) AS line,
      CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS label FROM {ev}""",
    "sessions": """SELECT concat('blk_', CAST(user_id AS STRING)) AS session_id, CAST(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS INT) AS label,
      min(event_id) AS ts, count(*) AS n_lines FROM {ev} GROUP BY user_id""",
    "typed": """SELECT concat('blk_', CAST(user_id AS STRING)) AS session_id, event_id AS line_id, CAST(floor(us / 1000000) AS BIGINT) AS t,
      CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 0 END AS INT) AS col FROM {ev}""",
    "scored": """SELECT event_id AS id, CAST(floor(value) AS DOUBLE) AS s, value AS snap, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS y,
      event_id % 10 = 0 AS inc, concat('g', CAST(user_id % 5 AS STRING)) AS cell, CAST(user_id % 3 AS INT) AS seed, event_type AS parser FROM {ev}""",
    "alerts": """SELECT event_id AS id, concat('run', CAST(user_id % 3 AS STRING)) AS run, concat('blk_', CAST(user_id AS STRING)) AS session_key,
      CASE event_id % 3 WHEN 0 THEN 'incremental' WHEN 1 THEN 'deadline' ELSE 'deadline_eos' END AS kind,
      CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved' ELSE 'false_positive' END AS status,
      value AS score, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(20 + user_id % 20 AS DOUBLE) END AS threshold,
      us * 1000 AS created_ns, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 ELSE us * 1000 END AS t_send_ns,
      us * 1000 + (event_id % 50) * 1000000 AS ingested_ns, event_id AS arrival, CAST(event_id % 997 AS DOUBLE) AS ms FROM {ev} WHERE event_type = 'error'""",
    "samples": """SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, CAST(user_id % 4 AS INT) AS worker, (event_id % 600) * 1000000000 + user_id AS ts_ns,
      value AS rate_eps, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST((event_id * 37) % 2000 AS DOUBLE) END AS lag, user_id AS open_sessions,
      event_id % 5 AS alerts, value AS p95_ms, value * 2 AS p99_ms, event_id % 600 AS watermark FROM {ev}""",
    "records": """SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, concat('blk_', CAST(user_id AS STRING), '_', CAST(event_id AS STRING)) AS session_key, event_id % 2 = 0 AS alerted,
      CASE event_id % 3 WHEN 0 THEN 'incremental' WHEN 1 THEN 'deadline' ELSE 'deadline_eos' END AS kind, us * 1000 AS t_send_ns,
      CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(us / 1000) AS BIGINT) + event_id % 5 - 1 END AS t_broker_ms,
      us * 1000 + (event_id % 20) * 1000000 AS t_recv_ns, us * 1000 + (event_id % 20 + event_id % 7) * 1000000 AS t_scored_ns, (event_id % 3) * 1000000 AS score_ns,
      us * 1000 + (event_id % 20 + event_id % 7 + event_id % 4) * 1000000 AS t_alert_ns FROM {ev}""",
    "sweep": """SELECT concat('c', CAST(user_id % 5 AS STRING)) AS cell, CAST(event_id % 8 + 1 AS DOUBLE) * 1000 AS offered,
      (CAST(event_id % 8 + 1 AS DOUBLE) * 1000) * (1.0 - (event_id % 8) * (user_id % 5) / 500.0) AS achieved, CAST(event_id % 10 AS DOUBLE) / 8 AS drain_s,
      CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 520 AS DOUBLE) END AS p99_ms FROM {ev}""",
    "slow": """SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, CAST(event_id AS DOUBLE) / 4 AS t, CAST((event_id * 7919) % 400 AS DOUBLE) AS ms FROM {ev} WHERE event_id % 2 = 0""",
    "injections": """SELECT event_id AS id, concat('run', CAST(user_id % 3 AS STRING)) AS run, CASE WHEN event_id % 2 = 0 THEN 'burst' ELSE 'trickle' END AS scenario, us * 1000 AS t_ns, user_id FROM {ev} WHERE event_id % 97 = 0""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev = spark.sql(EV_SPARK, events=events)
    return ev if name == "ev" else spark.sql(VIEWS[name], ev=ev)


def duck(sql: str, *views: str) -> str:
    """``sql`` for DuckDB behind the views it reads."""
    named = [f"ev AS ({EV_DUCK})", *[f"{v} AS ({VIEWS[v].format(ev='ev')})" for v in views]]
    rest = sql.strip()
    word = "WITH RECURSIVE " if rest.startswith("WITH RECURSIVE ") else "WITH "
    return f"{word}{', '.join(named)}" + (f", {rest[len(word):]}" if rest.startswith(word) else f" {rest}")
