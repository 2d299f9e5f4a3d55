"""The driver's contract: queries run, their columns match their SQL, and batch and stream agree."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logloom import queries as base
from logloom.operators import detectors
from logloom.streaming import detect


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tfidf", "split_chrono", "roc_ap", "alert_stats", "excursions", "window_sessions_consecutive"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(base.SQL[name])
    got = base.QUERIES[name](spark, sf)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    flat = lambda rows: sorted(str([round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r]) for r in rows)
    assert flat(tuple(r) for r in got.select(*order).collect()) == flat(want.select(*[f'"{c}"' for c in order]).fetchall())


def test_stream_alerts_once_and_as_in_batch(spark):
    """One alert a session: by its lines where the whole session is odd, by its age where it stays short."""
    model = detectors.PCADetector()
    model.columns, model.mean = {1: 0, 2: 1}, __import__("numpy").array([1.0, 0.0])
    model.loadings = __import__("numpy").array([[1.0, 0.0]])
    scorer = detect.Scorer({1: 1.0, 2: 1.0}, model, threshold=0.5, age_s=10, snap_threshold=0.3)
    rows = []
    for t in range(12):
        rows += [("good", 1, 1000 + t), ("odd", 2, 1000 + t)]
    rows += [("short", 2, 1001), ("short", 2, 1002), ("end", 1, 3000), ("end", 1, 9000)]
    events = spark.createDataFrame(rows, "key string, col int, log_t long").withColumn("event_time", F.timestamp_seconds("log_t"))
    for batches in (1, 4, 4):
        events = events.repartition(batches + 2)  # rows of a batch come in any order
        got = {(r.session_key, r.kind) for r in base.run_stream(events, scorer, 5, "1 second", batches).collect()}
        assert got == {("odd", "incremental"), ("short", "deadline")}


def test_stream_equals_sessions_one_after_the_other(spark):
    """Alerts of random sessions, also on both sides of their age, as plain Python gives them with the watermark of each batch."""
    import random

    import numpy as np

    model = detectors.PCADetector()
    model.columns, model.mean, model.loadings = {1: 0, 2: 1, 3: 2}, np.array([0.9, 0.1, 0.0]), np.array([[1.0, 0.0, 0.0]])
    scorer = detect.Scorer({1: 1.0, 2: 1.3, 3: 2.0}, model, threshold=0.45, age_s=30, snap_threshold=0.3)
    rng = random.Random(8)
    rows = []
    for k in range(60):
        t, odd = rng.randrange(1000, 3000), rng.random() < 0.5
        for _ in range(rng.randint(1, 12)):
            rows.append((f"s{k}", rng.choice([1, 1, 2, 3] if odd else [1, 1, 1, 2]), t))
            t += rng.choice([0, 1, 5, 40])
    events = spark.createDataFrame(rows, "key string, col int, log_t long").withColumn("event_time", F.timestamp_seconds("log_t"))
    parts = [[(r.key, r.col, r.log_t) for r in p.collect()] for p in base.in_order(events, 4)]
    held, want, mark = {}, {}, 0

    def judge(key):
        session = held[key]
        alert = session.judge(scorer, 5, mark)
        if alert:
            want[key] = (alert[0], round(alert[1], 9), sum(n for n, _ in session.lines.values()))

    for part in parts:
        for key in sorted({r[0] for r in part}):
            mine = [r for r in part if r[0] == key]
            held.setdefault(key, detect.Session()).add(np.array([r[1] for r in mine]), np.array([float(r[2]) for r in mine]), np.full(len(mine), np.nan), 30)
            judge(key)
        mark = max(mark, (max(r[2] for r in part) - 10) * 1000)  # the next batch, without rows, goes by it
        for key, session in held.items():
            if not session.alerted and (session.due(30) or mark + 1) <= mark:
                judge(key)
    got = {r.session_key: (r.kind, round(r.score, 9), r.n_lines) for r in base.run_stream(events, scorer, 5, "10 seconds").collect()}
    assert got == want and {k for k, _, _ in want.values()} == {"incremental", "deadline"}


def test_state_ends_with_its_sessions(spark, tmp_path):
    """Three waves of sessions: the state holds the last ones alone, an ended key begins anew, an alerted one stays silent until then."""
    model = detectors.PCADetector()
    model.columns, model.mean = {1: 0, 2: 1}, __import__("numpy").array([1.0, 0.0])
    model.loadings = __import__("numpy").array([[1.0, 0.0]])
    scorer = detect.Scorer({1: 1.0, 2: 1.0}, model, threshold=0.5, age_s=10, snap_threshold=0.3)
    waves, live = [], []
    for wave in range(3):
        t0 = 1000 + 5000 * wave
        rows = [(f"good{wave}-{k}", 1, t0 + j) for k in range(20) for j in range(4)]
        rows += [("odd", 2, t0 + j) for j in range(6)] + [("odd", 2, t0 + 400)]  # alerts once a wave
        waves.append(rows + [(f"clock{wave}", 1, t0 + 500)])
    schema = "key string, col int, log_t long, event_time timestamp"
    path, state = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.parquet(path)
    found = detect.detect(spark.readStream.schema(schema).parquet(path), scorer, 5, "1 second", keep_s=1000)
    for rows in waves:
        df = spark.createDataFrame(rows, "key string, col int, log_t long").withColumn("event_time", F.timestamp_seconds("log_t"))
        df.repartition(2).write.mode("append").parquet(path)
        query = detect.start(found, str(tmp_path / "state"), once=True, path=str(tmp_path / "out"))
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        live.append(sorted(r.key for r in detect.open_sessions(spark, str(tmp_path / "state")).collect()))
    alerts = spark.read.parquet(str(tmp_path / "out")).filter("session_key = 'odd'").collect()
    assert [(r.kind, r.n_lines) for r in alerts] == [("incremental", 7)] * 3
    assert {r.session_key for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"odd"}
    assert live == [sorted({r[0] for r in rows}) for rows in waves]
    assert state[1] <= state[0] + 2 and state[2] <= state[0] + 2  # it does not grow with the waves


def test_session_is_the_same_in_any_order_of_rows():
    import numpy as np

    cols, times, sent = np.array([1, 2, 1, 3]), np.array([50.0, 10.0, np.nan, 21.0]), np.full(4, np.nan)
    stored = []
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        s = detect.Session()
        s.add(cols[order], times[order], sent, 10)
        s.add(np.array([4]), np.array([15.0]), np.array([7.0]), 10)
        stored.append((sorted(s.lines.items()), s.first, s.last, s.sent_ns))
    assert stored[0] == stored[1] == stored[2] == ([(1, (2, 0)), (2, (1, 1)), (3, (1, 0)), (4, (1, 1))], 10, 50, 7)


def test_stream_scores_equal_batch_scores(spark, sf):
    from logloom.plans import anomaly

    rows, splits = base._rows(spark, sf), base._splits(spark, sf)
    model = anomaly.train(rows, splits, "regex", "pca", max_events=3)
    scorer, counts = detect.scorer(model), {}
    for r in model.counts(rows).collect():
        counts.setdefault(r.session_id, {})[r.col] = r.cnt
    for r in model.score_counts(model.counts(rows)).collect():
        assert abs(scorer.full(counts[r.session_id]) - r.score) < 1e-6


def test_payload_and_report(spark):
    alerts = spark.createDataFrame([("a", "incremental", 0.7, 3, 5, 0.5, None), ("b", "deadline", 0.9, 2, 9, 0.5, 1)], detect.ALERT)
    sent = {r.id: (r.run, r.model, r.session_key) for r in detect.payload(alerts, "r1", "m").collect()}
    assert sent == {"r1:a": ("r1", "m", "a"), "r1:b": ("r1", "m", "b")}
    ids = spark.createDataFrame([("a", 1, 6), ("b", 0, 2), ("c", 0, 4)], "session_id string, label int, n long")
    r = detect.run_report(alerts, ids.drop("n"), ids.drop("label"), ids.select("session_id"), ids.filter("label = 0").select("session_id")).first()
    assert (r.sessions, r.scored, r.alerts, r.n_incremental, r.n_deadline, r.evidence_p50, r.lines_p50) == (3, 2, 2, 1, 1, 5.0, 0.75)


def test_pause_lines(spark):
    from logloom.sources import logs

    stamp = "[2024-01-02T03:04:05.678+0000]"
    lines = [f"{stamp} GC(1) Pause Young (Normal) 4M->2M(9M) 1.25ms", f'{stamp} Safepoint "Cleanup", Time since last: 1 ns, Total: 2500000 ns', "Pause Young 1ms", f"{stamp} other", f"{stamp} Pause Full 3 s"]
    got = logs.parse_pauses(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert sorted((round(r.t, 3), r.ms, r.kind) for r in got) == [(1704164645.678, 1.25, "gc:Young"), (1704164645.678, 2.5, "safepoint:Cleanup")]


def test_pause_lines_of_one_time_and_repeated_rows(spark, tmp_path):
    """Lines that share a time are matched once each, not with all the others."""
    import datetime

    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678_000)
    ids = [*range(4000), 4, 4]
    spark.createDataFrame([(k, at, 1, "click", 1.0, "{}") for k in ids], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    out = base.QUERIES["pause_lines"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, out.select("id", "t", "ms", "kind").collect())) == sorted(con.sql(f"SELECT id, t, ms, kind FROM ({base.SQL['pause_lines']})").fetchall())


def test_finalise_and_summary(spark):
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.2)], "session_id string, score double")
    snaps = spark.createDataFrame([("b", 0.8), ("c", 0.0)], "session_id string, score double")
    alerts = spark.createDataFrame([("a", "incremental", 0.7)], "session_key string, kind string, score double")
    final = detect.finalise(scores, snaps, alerts, 0.5)
    assert {r.session_id: r.kind for r in final.collect()} == {"a": "incremental", "b": "deadline_eos", "c": None}
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "session_id string, label int")
    s = detect.summarise(final, labels, scores).first()
    assert (s.sessions, s.unlabelled, s.tp, s.fp, s.fn, s.same) == (3, 1, 1, 1, 0, 1.0)


def test_model_tables_round_trip(spark, sf, tmp_path):
    from logloom.plans import anomaly

    rows, splits = base._rows(spark, sf), base._splits(spark, sf)
    model = anomaly.train(rows, splits, "drain", "pca")
    model.early = anomaly.EarlyCheck(60, model.idf, model.detector, 0.25)
    model.save(str(tmp_path / "m"))
    again = anomaly.AnomalyModel.load(spark, str(tmp_path / "m"))
    a, b = ({r.session_id: (round(r.score, 9), r.flagged) for r in m.transform(rows).collect()} for m in (model, again))
    assert a == b and a
    assert (again.early.age_s, again.early.threshold) == (60, 0.25) and detect.scorer(again).snap_idf == detect.scorer(model).snap_idf


def test_stream_batches_rise_with_time(spark):
    rows = [(f"k{n}", n % 3, float((n * 7919) % 20_000), "x" * (400 if (n * 7919) % 20_000 < 5000 else 1)) for n in range(20_000)] + [("odd", 1, None, "")]
    parts = base.in_order(spark.createDataFrame(rows, "key string, col int, log_t double, line string").repartition(4), 4)
    spans = [p.selectExpr("min(log_t)", "max(log_t)", "count(*)").first() for p in parts]
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(s[2] for s in spans) == len(rows)


def _study(spark, n=60):
    """Sessions of the terms a and b, twenty for training; from two thirds on a is reworded to c; every tenth has x instead."""
    rows, sess = [], []
    for k in range(n):
        odd = k % 10 == 9
        split, chunk = ("train", None) if k < n // 3 else ("val", None) if k < n // 2 else ("test", 0 if k < 2 * n // 3 else 1 if k < 5 * n // 6 else 2)
        for term in ["x"] * 5 if odd else ["c" if k >= 2 * n // 3 else "a"] * 3 + ["b"] * (1 + k % 3):
            rows.append((f"s{k}", term, k))
        if not (odd and split == "train"):
            sess.append((f"s{k}", int(odd), split, chunk))
    return spark.createDataFrame(rows, "session_id string, term string, line_id long"), spark.createDataFrame(sess, "session_id string, label int, split string, chunk int")


def test_drift_policies_fit_and_score(spark):
    from logloom.plans import anomaly

    rows, sess = _study(spark)
    counts = rows.groupBy("session_id", "term").agg(F.count("*").alias("cnt"), F.min("line_id").alias("first_line"))
    got = {(r.policy, r.chunk): r for r in anomaly.drift_study(counts, sess, window=1, trigger=0.2).collect()}
    assert set(got) == {(p, c) for p in anomaly.POLICIES for c in range(3)}
    assert all(got[p, 0].fit_from is None and (p == "static_tuned" or got[p, 0].threshold == got["static_p99", 0].threshold) for p in anomaly.POLICIES)
    assert [(got["periodic", c].fit_from, got["periodic", c].fit_to) for c in (1, 2)] == [(0, 0), (1, 1)]
    # Chunk 0 knows its terms but the odd session's; chunk 1 is reworded, so that chunk 2 has a new fit.
    assert got["static_p99", 0].unk_share < 0.2 < got["static_p99", 1].unk_share
    assert got["triggered", 1].fit_from is None and got["triggered", 2].fit_from == 1
    assert got["triggered", 2].threshold == got["periodic", 2].threshold and got["periodic", 2].unk_share == 0
    assert got["oracle", 2].unk_share > 0  # anomalies, and so their terms, are not among its sessions
    assert all(r.tp + r.fn == 1 and r.fp + r.tn == 9 for r in got.values())


def test_drift_study_reads_columns_once_for_each_model_and_chunk(spark, monkeypatch):
    from logloom.plans import anomaly

    calls, made = [], anomaly.features.to_columns
    monkeypatch.setattr(anomaly.features, "to_columns", lambda counts, columns: calls.append(1) or made(counts, columns))
    rows, sess = _study(spark)
    counts = rows.groupBy("session_id", "term").agg(F.count("*").alias("cnt"), F.min("line_id").alias("first_line"))
    anomaly.drift_study(counts, sess.withColumn("chunk", F.when(F.col("chunk") > 0, 1).otherwise(F.col("chunk"))), window=1, trigger=0.2)
    # Fits: static, and two for chunk 1. Scores: validation, static on both chunks, two fits on chunk 1.
    assert len(calls) == 3 + 1 + 2 + 2


def test_early_rules_and_selection(spark):
    from logloom.operators import metrics
    from logloom.plans import anomaly

    lines, sess = _study(spark)
    rows = lines.select("session_id", "line_id", F.concat(F.lit("h "), "term").alias("line"))
    model = anomaly.train(rows, sess, "regex", "pca", header_tokens=1, rule="tuned", weighting="binary")
    assert model.weighting == "binary"
    order = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("session_id").orderBy("term")
    seq = lines.join(model.columns, "term", "left").select("session_id", (F.row_number().over(order) - 1).alias("pos"), F.coalesce("col", F.lit(0)).alias("col")).withColumn("dt", F.col("pos") * 10)
    scores = model.score_counts(model.counts(rows)).select("session_id", "score")
    got = anomaly.early_study(model, seq, sess, scores, [15, 100], gate=5).collect()
    assert sorted((r.rule, r.age or 0) for r in got) == [("lines", 0), ("short", 15), ("short", 100), ("snapshot", 15), ("snapshot", 100)]
    by = {(r.rule, r.age): r for r in got}
    assert all(r.tp + r.fn == 3 for r in got)
    assert by["lines", None].tp == 3 and by["lines", None].delay_p50 == 40  # the fifth line
    assert by["short", 15].tp == 3 and by["short", 15].fp == 27 and by["short", 15].delay_p50 == 15
    # At 15 s only one term is known, which one component spans: the detector sees nothing, and validation tells so.
    val = {r.session_id: r.label for r in sess.filter("split = 'val'").collect()}
    flags = [(r.score >= model.threshold, val[r.session_id]) for r in scores.collect() if r.session_id in val]
    whole = 2 * sum(f and y for f, y in flags) / (sum(f for f, _ in flags) + sum(y for _, y in flags))
    fits = [r for r in got if r.val_f1 is not None and r.val_f1 >= whole - 0.01]
    assert whole == 1.0 and by["snapshot", 100].val_f1 == 1.0
    assert [(r.age, r.kind) for r in got if r.selected] == [min((r.age, r.kind) for r in fits)]
    ages = spark.createDataFrame([(5, 0.5), (10, 0.9), (10, 0.95), (20, 1.0), (1, None)], "age int, val_f1 double")
    assert metrics.shortest_age(ages, 0.91).first() == (10, 0.95) and metrics.shortest_age(ages, 2.0).count() == 0


def test_training_masks_each_line_once(spark, sf, monkeypatch):
    calls, mask = [], base.S.mask
    monkeypatch.setattr(base.S, "mask", lambda text: calls.append(1) or mask(text))
    typed, _, model, scores = base._trained(spark, sf)
    assert len(calls) == 1
    assert typed.count() == base._rows(spark, sf).count() and scores.count() == typed.select("session_id").distinct().count()
    assert typed.filter("col > 0").count() > 0 and model.meta["n_columns"] > 0


def test_consecutive_windows_of_lines_without_a_number_or_type(spark, tmp_path):
    """Lines of no user come last, as in SQL, and a missing type is no error."""
    con, name = duckdb.connect(), "window_sessions_consecutive"
    path = f"{tmp_path}/events.parquet"
    con.sql(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 7 <> 3 THEN user_id END AS user_id, CASE WHEN event_id % 5 <> 1 THEN event_type END AS event_type)
      FROM '/root/testdata/sf0.001/events.parquet') TO '{path}'""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = sorted(map(str, map(tuple, base.QUERIES[name](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, con.sql(base.SQL[name]).fetchall()))
