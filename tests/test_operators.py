"""Hand-computed cases for the log-anomaly operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions import scalars as S
from logloom.operators import detectors, drift, features, metrics, perf, ranking, sessions, store, templates
from logloom.sources import logs


def col(spark, values, kind, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").withColumn("y", f(F.col("x"))).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


def test_content_drops_headers_and_labels(spark):
    lines = ["081109 203518 143 INFO dfs.X: got  blk_1", "a b c", "- 1 2 3 4 5 6 7 8 the message", "", None]
    assert col(spark, lines, "string", lambda c: S.content(c, 4)) == ["dfs.X: got  blk_1", "", "4 5 6 7 8 the message", "", None]


def test_mask(spark):
    texts = ["Received blk_-1608 of size 91178 from /10.250.10.6:50010", "job_2015_001 took 15ms", "at 0xDEADbeef  and  -3.5 ", "abc1 x-2"]
    assert col(spark, texts, "string", S.mask) == ["Received <*> of size <*> from /<*>", "job_<*>_<*> took <*>ms", "at <*> and <*>", "abc1 x-<*>"]


def test_log_time_and_back(spark):
    stamps = ["081109 203518 x", "bad", None]
    t = col(spark, stamps, "string", S.log_time)
    assert t == [(9 + 31 * 11 + 372 * 8) * 86400 + 20 * 3600 + 35 * 60 + 18, None, None]
    assert col(spark, [t[0]], "long", S.format_log_time) == ["081109 203518"]


def test_keys_and_buckets(spark):
    assert col(spark, ["x blk_-5 blk_7 blk_-5", "none"], "string", S.first_key) == ["blk_-5", None]
    assert col(spark, ["x blk_-5 blk_7 blk_-5"], "string", S.all_keys) == [["blk_-5", "blk_7"]]
    import zlib

    assert col(spark, ["abc"], "string", S.hash_bucket) == [zlib.crc32(b"abc") % 4096]


def test_rank_is_the_same_for_any_partitioning(spark):
    values = random.Random(0).sample(range(1000), 200)
    want = {v: (k, sum(sorted(values)[: k + 1])) for k, v in enumerate(sorted(values))}
    for parts in (1, 7):
        df = spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)
        got = ranking.with_rank(df, F.col("v"), rank="r", total="n", sums={"s": "v"}, parts=5).collect()
        assert {r.v: (r.r, r.s) for r in got} == want and {r.n for r in got} == {200}
    assert ranking.with_rank(df.limit(0), F.col("v")).count() == 0


def test_quantiles_of_groups_and_of_all_rows(spark):
    import numpy as np

    rng = random.Random(1)
    rows = [(g, rng.choice([None, rng.randrange(9), rng.random()])) for g in ["hot"] * 300 + ["a", "b", None] * 7] + [("empty", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    points = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: r for r in ranking.quantiles(df, ["g"], "v", points, parts=7).collect()}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g].n == len(v)
        if v:
            assert got[g].q == pytest.approx(np.percentile(v, [100 * p for p in points])) and (got[g].low, got[g].high) == (v[0], v[-1])
            assert got[g].above[2] == v[len(v) // 2]
        else:
            assert got[g].q == [None] * 5 and got[g].low is None
    whole = ranking.quantiles(df, [], "v", [0.5], parts=3).collect()
    assert len(whole) == 1 and whole[0].q == df.agg(F.array(F.percentile("v", 0.5))).first()[0]
    none = ranking.quantiles(df.limit(0), [], "v", [0.5]).collect()
    assert [(r.n, r.q) for r in none] == [(0, [None])] and ranking.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_scan_equals_windows_over_whole_groups(spark, parts):
    """A group with most rows, small ones, one without a name; ties, nulls among values; and no window over a whole group."""
    rng = random.Random(parts)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice(["x", None]), rng.randrange(60), rng.choice([None, 1, 2, -3]), k) for k in range(400)] + [("c", "x", 5, None, 400)]
    df = spark.createDataFrame(rows, "g string, h string, t int, v int, k int").repartition(3)
    scan = ranking.Scan(df, ["g", "h"], ["t"], parts=parts).running(total=("sum", "v"), low=("min", "v")).later(rest=("sum", "v"), high=("max", "v"))
    got = {r.k: (r.total, r.low, r.rest, r.high) for r in scan.done().collect()}
    for g, h, t, _, k in rows:
        mine = [r for r in rows if r[:2] == (g, h) and r[3] is not None]
        upto, after = [r[3] for r in mine if r[2] <= t], [r[3] for r in mine if r[2] >= t]
        assert got[k] == (sum(upto) if upto else None, min(upto, default=None), sum(after) if after else None, max(after, default=None)), (g, h, t)
    lags = ranking.Scan(df, ["g", "h"], ["t", "k"], parts=parts).lag(before="v", at="k").done()
    order = {}
    for r in sorted(rows, key=lambda r: (r[2], r[4])):
        order.setdefault(r[:2], []).append(r)
    want = {r[4]: (p[3], p[4]) if p else (None, None) for g in order.values() for p, r in zip([None, *g], g)}
    assert {r.k: (r.before, r.at) for r in lags.collect()} == want
    for done in (scan.done(), lags):
        for line in done._jdf.queryExecution().analyzed().toString().split("\n"):
            assert "windowspecdefinition(g#" not in line


def test_no_rows_to_scan(spark):
    df = spark.createDataFrame([], "g string, t int, v int")
    assert ranking.Scan(df, ["g"], ["t"]).lag(a="v").running(b=("sum", "v")).later(c=("max", "v")).done().count() == 0


def test_sessions_share_lines(spark):
    lines = spark.createDataFrame([(0, "a blk_1"), (1, "b blk_1 blk_2"), (2, "c blk_9"), (3, "d blk_2 blk_2"), (4, "e blk_1")], "line_id long, line string")
    labels = spark.createDataFrame([("blk_1", 1), ("blk_2", 0)], "session_id string, label int")
    got = {r.session_id: (r.label, r.ts, r.lines) for r in sessions.sessions_by_key(lines, labels).collect()}
    assert got == {"blk_1": (1, 0, ["a blk_1", "b blk_1 blk_2", "e blk_1"]), "blk_2": (0, 1, ["b blk_1 blk_2", "d blk_2 blk_2"])}


def test_windows(spark):
    raw = spark.createDataFrame([(0, "- 3600 x y"), (1, "FATAL 3700 x"), (2, "garbage"), (3, "- 7300 x"), (4, "- x1 y z"), (5, "- 3800 late")], "line_id long, line string")
    lines = logs.prefixed_lines(raw)
    assert [(r.line_id, r.label) for r in lines.orderBy("line_id").collect()] == [(0, 0), (1, 1), (3, 0), (5, 0)]
    fixed = {(r.session_id, r.label, r.n) for r in sessions.windowed_sessions(lines, 3600).collect()}
    assert fixed == {("w1", 1, 3), ("w2", 0, 1)}
    runs = sorted((r.session_id, r.label, r.n) for r in sessions.windowed_sessions(lines, 3600, mode="consecutive").collect())
    assert runs == [("w1", 0, 1), ("w1", 1, 2), ("w2", 0, 1)]


def test_split_drops_train_anomalies(spark):
    df = spark.createDataFrame([(f"s{k}", int(k in (1, 8)), k) for k in range(10)], "session_id string, label int, ts long")
    got = {r.session_id: r.split for r in sessions.split(df, 0.6, 0.1).collect()}
    assert got == {**{f"s{k}": "train" for k in (0, 2, 3, 4, 5)}, "s6": "val", "s7": "test", "s8": "test", "s9": "test"}
    again = {r.session_id for r in sessions.split(df, mode="random", seed=3).collect()}
    assert again == {r.session_id for r in sessions.split(df.repartition(5), mode="random", seed=3).collect()}


def test_clones_keep_lines_and_change_keys(spark):
    rows = spark.createDataFrame([("blk_1", 0, 0, "081109 203518 a blk_1"), ("blk_1", 0, 1, "081109 203519 b blk_1")], "session_id string, session_idx long, pos long, line string")
    got = sessions.clone_sessions(rows, 3, (9 + 31 * 11 + 372 * 8) * 86400, "7").orderBy("session_idx", "pos").collect()
    assert len(got) == 6 and got[0].line == "081109 000000 a blk_970" and got[5].session_id == "blk_972"


def test_columns_and_weights(spark):
    counts = spark.createDataFrame([("a", "x", 3, 0), ("a", "y", 1, 1), ("b", "x", 1, 2), ("c", "z", 2, 3)], "session_id string, term string, cnt long, first_line long")
    splits = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "session_id string, split string")
    columns = features.top_terms(features.train_frequency(counts, splits), features.vocabulary(counts))
    assert {r.term: r.col for r in columns.collect()} == {"x": 1, "y": 2}
    by_col = features.to_columns(counts, columns)
    assert {(r.session_id, r.col): r.cnt for r in by_col.collect()} == {("a", 1): 3, ("a", 2): 1, ("b", 1): 1, ("c", 0): 2}
    idf = {r.col: r.idf for r in features.fit_idf(by_col, splits, columns).collect()}
    assert idf[0] == pytest.approx(math.log(3) + 1) and idf[1] == pytest.approx(1) and idf[2] == pytest.approx(math.log(1.5) + 1)
    w = {(r.session_id, r.col): r.w for r in features.tfidf(by_col, features.fit_idf(by_col, splits, columns)).collect()}
    x, y = (1 + math.log(3)) * idf[1], idf[2]
    assert w["a", 1] == pytest.approx(x / math.hypot(x, y)) and w["c", 0] == pytest.approx(1)


def test_templates_of_hot_leaves_and_single_lines(spark, tmp_path):
    from logloom import queries

    text = "\n".join(f"send w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} to node" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, "only one line here once")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {"send <*> to node", "only one line here once"}
    assert [*sorted(r.template for r in queries.QUERIES["drain_templates"](spark, str(tmp_path)).collect())] == sorted(want)


def _greedy(terms, similarity, layers):
    """Drain's pass over terms in order, one leaf after the other."""
    leaves = {}
    for term in terms:
        tokens = term.split()
        head = " ".join("<*>" if any(c.isdigit() for c in t) else t for t in tokens[:layers])
        mine = leaves.setdefault((len(tokens), head), [])
        equal = lambda t: sum(a == b != "<*>" for a, b in zip(t, tokens))
        best = max(mine, key=lambda t: (equal(t), t.count("<*>")), default=None)
        if best is not None and equal(best) / len(tokens) >= similarity:
            best[:] = [a if a == b else "<*>" for a, b in zip(best, tokens)]
        else:
            mine.append(tokens)
    return {(n, head, k, *t) for (n, head), ts in leaves.items() for k, t in enumerate(ts)}


def _terms(n, seed):
    rng = random.Random(seed)
    words = ["get", "put", "node", "block", "to", "<*>", "a7", "x", "y"]
    return list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(n)))


@pytest.mark.parametrize("depth", [3, 4, 5, 9])
def test_templates_are_one_greedy_pass(spark, depth):
    terms = _terms(500, depth)
    freq = spark.createDataFrame([(t, len(terms) - k, k) for k, t in enumerate(terms)], "term string, freq long, term_id long").repartition(4)
    got = templates.fit_templates(freq, 0.5, depth).collect()
    assert {(r.n_tokens, r.head, r.nth, *r.template) for r in got} == _greedy(terms, 0.5, depth - 3)


def test_trie_equals_the_join(spark):
    terms = _terms(600, 1)
    freq = spark.createDataFrame([(t, 1, k) for k, t in enumerate(terms[:200])], "term string, freq long, term_id long")
    for depth in (3, 4, 5):
        fitted = templates.cut(templates.fit_templates(freq, 0.5, depth))
        asked = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, k int").repartition(3)
        trie, joined = (sorted(map(tuple, templates.match_templates(asked, fitted, depth, size).select("k", "term", "n_tokens", "head", "nth").collect())) for size in (None, -1))
        assert trie == joined and 200 <= sum(r[-1] is not None for r in trie) < len(terms)


def test_templates(spark):
    freq = spark.createDataFrame([("send block <*> to node a", 50, 0), ("send block <*> to node b", 10, 1), ("delete file now", 5, 2), ("never seen here", 0, 3)], "term string, freq long, term_id long")
    columns, named = templates.template_columns(freq.select("term", "freq"), freq.select("term", "term_id"))
    got = {r.term: r.col for r in columns.collect()}
    assert got == {"send block <*> to node a": 1, "send block <*> to node b": 1, "delete file now": 2}
    new = spark.createDataFrame([("send block <*> to node zz",), ("unheard of",)], "term string")
    assert {r.term: r.col for r in templates.serve_columns(new, columns, named).collect()} == {"send block <*> to node zz": 1, "unheard of": 0}


def scored(spark, s, y):
    return spark.createDataFrame([*zip(map(float, s), y)], "s double, y int")


def test_thresholds(spark):
    df = scored(spark, range(100), [int(k >= 90) for k in range(100)])
    assert metrics.best_threshold(df).first() == (90.0, 1.0)
    assert metrics.best_threshold(scored(spark, range(5), [0] * 5)).first() == (math.inf, 0.0)
    assert metrics.three_sigma(df).first()[0] == pytest.approx(49.5 + 3 * math.sqrt((100**2 - 1) / 12))
    assert metrics.percentile_threshold(df).first()[0] == pytest.approx(98.01)


def test_confusion_and_ranking(spark):
    df = scored(spark, [0.1, 0.2, 0.8, 0.9], [0, 1, 0, 1])
    r = metrics.confusion(df, F.col("s") >= 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1) == (1, 1, 1, 1, 0.5)
    assert metrics.ranking_metrics(df).first()[0] == pytest.approx(0.75)
    assert math.isnan(metrics.ranking_metrics(scored(spark, [1, 2], [1, 1])).first()[0])
    rng = random.Random(1)
    s, y = [rng.randint(0, 8) for _ in range(80)], [rng.randint(0, 1) for _ in range(80)]
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.ranking_metrics(scored(spark, s, y)).first()[0] == pytest.approx(auc)
    assert metrics.sampled_curve(scored(spark, range(50), [k % 2 for k in range(50)]), 10).count() == 10


def test_detectors_tell_anomalies(spark):
    rng = random.Random(2)
    rows = []
    for k in range(240):
        odd = k >= 200
        for c in range(5):
            rows.append((f"s{k}", c, 1.0 + (0.3 * rng.gauss(0, 1) if c < 2 else 0.02 * rng.gauss(0, 1))))
        rows.append((f"s{k}", 5, rng.gauss(1.5 if odd else 0.2, 0.05)))
    df = spark.createDataFrame(rows, "session_id string, col int, w double")
    normal = df.filter("cast(substring(session_id, 2) as int) < 150")
    for name, params in (("pca", {}), ("iforest", {"n_estimators": 30}), ("autoencoder", {"max_iter": 3})):
        model = detectors.MODELS[name](**params).fit(normal)
        out = model.score(df).withColumn("y", (F.substring("session_id", 2, 9).cast("int") >= 200).cast("int"))
        assert metrics.ranking_metrics(out, "score").first()[0] > 0.8, name


def _vectors(spark, n, d, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"s{k}", c, rng.random()) for k in range(n) for c in rng.sample(range(d), rng.randint(1, 5))], "session_id string, col int, w double").repartition(3)


@pytest.mark.parametrize("kind", ["pca", "iforest", "autoencoder"])
def test_sparse_scores_equal_those_of_the_matrix(spark, kind, monkeypatch):
    """Also for sessions with unknown columns alone, and a few rows at a time."""
    import numpy as np

    vectors = _vectors(spark, 120, 30)
    model = detectors.MODELS[kind](**({"n_estimators": 20} if kind == "iforest" else {"max_iter": 2} if kind == "autoencoder" else {})).fit(vectors.filter("col < 25"))
    odd = vectors.union(spark.createDataFrame([("none", 999, 1.0), ("none", -3, 2.0)], vectors.schema))
    rows = {}
    for r in odd.collect():
        rows.setdefault(r.session_id, {})[r.col] = r.w
    dense = np.array([[row.get(c, 0.0) for c in model.columns] for row in rows.values()])
    want = dict(zip(rows, model.score_matrix(dense)))
    got = {r.session_id: r.score for r in model.score(odd).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    lists = __import__("pyarrow").array([[{"col": c, "w": w} for c, w in row.items()] for row in rows.values()])
    monkeypatch.setattr(detectors, "CELLS", 100)
    assert model.score_sparse(detectors.Sparse.read(lists, model.columns)) == pytest.approx([*want.values()], rel=1e-9, abs=1e-9)
    assert len(model.score_sparse(detectors.Sparse.read(lists[:0], model.columns))) == 0


def test_trees_draw_from_all_sessions(spark, monkeypatch):
    """No sample of the sessions stands before that of each tree."""
    monkeypatch.setattr(detectors, "FIT_ROWS", 5)
    monkeypatch.setattr(detectors, "sample_sessions", None)
    model = detectors.IForestDetector(n_estimators=10, subsample=16).fit(_vectors(spark, 100, 10))
    assert model.size == 16 and len(model.trees) == 10


def test_sampled_sessions(spark):
    """Exactly so many, the same for any partitioning, others for another seed; all if there are fewer."""
    vectors = _vectors(spark, 50, 10)
    pick = lambda df, n, seed: sorted(r[0] for r in detectors.sample_sessions(df, n, seed).collect())
    one = pick(vectors, 20, 1)
    assert len(one) == len(set(one)) == 20 and one == pick(vectors.repartition(7), 20, 1) != pick(vectors, 20, 2)
    assert pick(vectors, 80, 1) == sorted(f"s{k}" for k in range(50))


def test_pca_as_joins_equals_the_matrix_form(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"s{k}", c, rng.random()) for k in range(30) for c in range(6) if rng.random() < 0.7], "session_id string, col int, w double")
    model = detectors.PCADetector(variance=0.6).fit(df)
    names = {v: k for k, v in model.columns.items()}
    mean = spark.createDataFrame([(names[k], float(m)) for k, m in enumerate(model.mean)], "col int, m double")
    loadings = spark.createDataFrame([(c, names[k], float(v)) for c, row in enumerate(model.loadings) for k, v in enumerate(row)], "comp int, col int, v double")
    a = {r.session_id: r.score for r in model.score(df).collect()}
    b = {r.session_id: r.score for r in detectors.pca_residual(df, mean, loadings, df.select("session_id").distinct()).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_alerts_are_inserted_once(spark):
    cols = "id long, run string, session_key string, t_send_ns long, ingested_ns long, arrival long"
    empty = spark.createDataFrame([], cols)
    batch = spark.createDataFrame([(1, "r", "a", 1_000_000, 6_000_000, 0), (2, "r", "a", 5, 9, 1), (3, "r", "b", 0, 9, 2)], cols)
    first = store.insert_alerts(empty, batch).collect()
    assert {(r.id, r.ingest_lag_ms) for r in first} == {(1, 5.0), (3, None)}
    assert store.insert_alerts(batch, batch).count() == 0
    assert store.insert_alerts(batch, batch.withColumn("run", F.lit("q"))).count() == 2


def test_lifecycle(spark):
    alerts = spark.createDataFrame([(1, "open"), (2, "resolved"), (3, "resolved")], "id long, status string")
    commands = spark.createDataFrame([(1, "acknowledged", "me", " seen ", 5), (2, "acknowledged", "me", "", 6), (3, "open", "me", "", 7), (9, "open", "me", "", 8)], "alert_id long, to_status string, actor string, note string, ts_ns long")
    after, audit, rejected = store.change_status(alerts, commands)
    assert {r.id: r.status for r in after.collect()} == {1: "acknowledged", 2: "resolved", 3: "open"}
    assert {r.alert_id for r in audit.collect()} == {1, 3} and {r.alert_id for r in rejected.collect()} == {2, 9}


def test_histogram(spark):
    df = spark.createDataFrame([(k / 10, 0.0) for k in range(1, 11)], "score double, threshold double")
    n = [r.n for r in store.score_histogram(df, 5).orderBy("bin").collect()]
    assert sum(n) == 10 and n[0] == 2
    mixed = spark.createDataFrame([(4.0, 2.0), (6.0, 3.0)], "score double, threshold double")
    rows = store.score_histogram(mixed, 4).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 0, 0, 0] and rows[0].low == 2.0
    assert store.score_histogram(df.limit(0)).count() == 0


def test_feedback(spark):
    df = spark.createDataFrame([(f"s{k}", "test", 0) for k in range(12)], "session_id string, split string, label int")
    keys = spark.createDataFrame([(f"s{k}",) for k in range(11)] + [("gone",)], "session_key string")
    folded, matched, unmatched = store.fold_feedback(df, keys)
    assert (matched, unmatched) == (11, 1) and folded.filter("split = 'train'").count() == 11
    assert store.fold_feedback(df, keys, 12)[0].filter("split = 'train'").count() == 0


def test_chunks_and_drift(spark):
    df = spark.createDataFrame([(f"s{k:02}", k) for k in range(23)], "session_id string, ts long")
    assert sorted((r.chunk, r["count"]) for r in drift.chunks(df).groupBy("chunk").count().collect()) == [(k, 3 if k < 3 else 2) for k in range(10)]
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "term string, term_id long")
    share = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.05)], "term string, share double")
    mapping = drift.drift_map(vocab, share, 2)
    assert {r.term for r in mapping.filter("drifted").collect()} == {"a", "b"}
    counts = spark.createDataFrame([("s00", t, n) for t, n in zip("abcd", (3, 2, 1, 4))], "session_id string, term string, cnt long")
    chunk = spark.createDataFrame([("s00", 6)], "session_id string, chunk int")
    after = {r.term: r.cnt for r in drift.apply_drift(counts, mapping, chunk, 5).collect()}
    assert after == {"a status=ok": 3, "b status=ok": 2, "c": 1, "d": 4}
    assert {r.term for r in drift.apply_drift(counts, mapping, chunk, 7).collect()} == set("abcd")


def test_saturation_ignores_luck(spark):
    rows = [("c", 1000.0, 1000.0, 0.1, 10.0), ("c", 2000.0, 1990.0, 0.1, None), ("c", 4000.0, 3000.0, 5.0, 900.0), ("c", 8000.0, 8000.0, 0.1, 10.0)]
    df = spark.createDataFrame(rows, "cell string, offered double, achieved double, drain_s double, p99_ms double")
    assert perf.saturation(df, ["cell"]).first().saturation == 2000 and perf.upper_median_saturation(df, ["cell"]).first().saturation == 2000


def test_stage_latencies(spark):
    row = ("r", "k", True, "incremental", 100_000_000, 106, 120_000_000, 131_000_000, 8_000_000, 132_000_000)
    cols = "run string, session_key string, alerted boolean, kind string, t_send_ns long, t_broker_ms long, t_recv_ns long, t_scored_ns long, score_ns long, t_alert_ns long"
    got = {r.stage: r.ms for r in perf.stage_latencies(spark.createDataFrame([row, ("r", "l", True, "deadline_eos", *row[4:])], cols)).collect()}
    assert got == {"producer_to_broker": 6.0, "broker_to_consumer": 14.0, "engine_update": 3.0, "scoring": 8.0, "alert_publish": 1.0, "total": 32.0}


def test_held_backlog(spark):
    lags = [0, 50, 50, 50, 50, 0, *[50] * 30]
    df = spark.createDataFrame([("r", float(k), float(v)) for k, v in enumerate(lags)], "run string, t double, lag double")
    assert [r.t for r in perf.held_over(df, 10, 2, 10, 3).orderBy("t").collect()] == [3.0, 13.0]


def test_excursions_and_recovery(spark):
    df = spark.createDataFrame([("r", t, ms) for t, ms in ((1.0, 400.0), (2.0, 350.0), (3.1, 300.0), (3.2, 10.0), (4.1, 500.0))], "run string, t double, ms double")
    assert sorted((r.low, r.high, r.n) for r in perf.excursions(df).collect()) == [(1.0, 2.0, 2), (3.1, 4.1, 2)]
    series = spark.createDataFrame([("r", t, float(v), 2, 0.0) for t, v in enumerate([0, 9000, 9000, 500, 2000, 900, 10])], "run string, t long, lag double, spike_end long, base_lag double")
    assert perf.recovery_seconds(series).first().recovery_s == 3


def test_stage_means_of_excursions(spark):
    rows = [("r", 1.0, 400.0, 10.0), ("r", 1.5, 500.0, 20.0), ("r", 1.7, 100.0, 999.0), ("r", 9.0, 301.0, None), ("s", 1.2, 300.0, 7.0)]
    out = perf.excursions(spark.createDataFrame(rows, "run string, t double, ms double, scoring double")).collect()
    assert sorted((r.run, r.nth, r.low, r.high, r.n, r.max_ms, r.scoring_mean) for r in out) == [("r", 1, 1.0, 1.5, 2, 500.0, 15.0), ("r", 2, 9.0, 9.0, 1, 301.0, None), ("s", 1, 1.2, 1.2, 1, 300.0, 7.0)]


def test_utilisation_between_samples(spark):
    rows = [("r", 0, 1, 10.0, 100.0), ("r", 0, 2, 30.0, 150.0), ("r", 0, 3, 30.0, 150.0), ("r", 1, 1, 0.0, 0.0), ("r", 1, 5, 8.0, 16.0)]
    out = perf.counter_utilisation(spark.createDataFrame(rows, "run string, core int, t int, busy double, total double")).collect()
    assert sorted((r.core, r.t, r.util) for r in out if r.util is not None) == [(0, 2, 0.4), (0, 3, 0.0), (1, 5, 0.5)]
    assert sorted((r.core, r.t) for r in out if r.util is None) == [(0, 1), (1, 1)]


def test_upper_median(spark):
    rows = [("a", v) for v in (5, 1, 3, 9)] + [("b", 7), ("b", None), (None, 2), (None, 4)]
    got = store.upper_median(spark.createDataFrame(rows, "run string, v int"), ["run"], "v")
    assert {r.run: r.upper_median for r in got.collect()} == {"a": 5, "b": 7, None: 4}


def test_tolerant_decode(spark):
    values = ['{"id": "a", "score": 1.5}', '{"id": "b", "score": "2"}', '{"score": 1}', '{"id": "c", "score": "x"}', "[1]", "oops"]
    good, bad = logs.decode_alerts(spark.createDataFrame([(v,) for v in values], "value string"))
    assert {r.id: r.score for r in good.collect()} == {"a": 1.5, "b": 2.0} and bad.count() == 4


def test_pauses(spark):
    lines = ["[2024-01-01T00:00:00.500+0000][info] GC(1) Pause Young (Normal) 4M->2M(9M) 3.5ms", '[2024-01-01T00:00:01.000+0000] Safepoint "Cleanup", Total: 4000000 ns', "[2024-01-01T00:00:02.000+0000] GC(2) Pause Full (G1) 812.5ms", "no stamp Pause Young 1ms"]
    got = logs.parse_pauses(spark.createDataFrame([(v,) for v in lines], "line string")).orderBy("t").collect()
    assert [(r.kind, r.ms) for r in got] == [("gc:Young", 3.5), ("safepoint:Cleanup", 4.0), ("gc:Full", 812.5)] and got[0].t == 1704067200.5


def test_registry(spark):
    empty = spark.createDataFrame([], "name string, dataset string, version int, status string")
    new = spark.createDataFrame([("a", "d", 0), ("a", "d", 1), ("b", "d", 2)], "name string, dataset string, nth int")
    have = store.register_models(empty, new)
    assert sorted((r.name, r.version) for r in have.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    on = store.activate_model(store.activate_model(have, "a", 1), "b", 1)
    assert [(r.name, r.version) for r in store.active_model(on, "d").collect()] == [("b", 1)]
    out = store.promote(on, have, "b", 1, activate=True)
    assert [(r.name, r.version) for r in store.active_model(out, "d").collect()] == [("b", 2)]


def test_session_files_are_pruned_by_split(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "session_id string, split string")
    logs.write_sessions(df, f"{tmp_path}/s")
    assert [r.session_id for r in logs.read_sessions(spark, f"{tmp_path}/s", "test").collect()] == ["b"]
    made = []
    build = lambda: made.append(1) or df
    for _ in range(2):
        assert logs.load_or_build(spark, f"{tmp_path}/t", build).count() == 2
    assert made == [1]


def test_listing_and_update_of_runs(spark):
    runs = spark.createDataFrame([("a", "stream", 5, "running", None, None, None, 5), ("b", "grid", 9, "running", None, None, None, 9), ("c", "stream", 7, "done", None, None, None, 7)],
                                 "id string, kind string, created_ns long, status string, summary string, model_id int, pid int, updated_ns long")
    assert [r.id for r in store.list_runs(runs).collect()] == ["b", "c", "a"] and [r.id for r in store.list_runs(runs, "stream").collect()] == ["c", "a"]
    after = {r.id: r for r in store.update_run(runs, "a", 11, status="finished", summary={"n": 3}, model_id=4).collect()}
    assert (after["a"].status, after["a"].summary, after["a"].model_id, after["a"].updated_ns) == ("finished", '{"n": 3}', 4, 11)
    assert (after["b"].status, after["b"].updated_ns, after["c"].summary) == ("running", 9, None)
    with pytest.raises(KeyError):
        store.update_run(runs, "a", 11, created_ns=1)


def test_listing_of_models(spark):
    models = spark.createDataFrame([("m", 2, "x"), ("m", 1, "x"), ("k", 1, "y")], "name string, version int, dataset string")
    assert [(r.name, r.version) for r in store.list_models(models).collect()] == [("k", 1), ("m", 1), ("m", 2)]
    assert [(r.name, r.version) for r in store.list_models(models, "x").collect()] == [("m", 1), ("m", 2)]


def test_pause_shares_and_compared_windows(spark):
    df = lambda rows: spark.createDataFrame(rows, "pause_max double, cpu_max double")
    slow, normal = df([(5.0, 90.0), (0.0, 70.0), (1.0, 80.0)]), df([(0.0, 10.0), (0.0, 20.0), (2.0, 30.0), (0.0, 40.0)])
    assert perf.overlap_shares(normal, slow).first() == (3, 2, pytest.approx(2 / 3), 4, 1, 0.25)
    assert perf.overlap_shares(normal, slow.limit(0)).first()[:3] == (0, 0, None)
    row = perf.compare_windows(normal, slow, ["cpu_max"]).first()
    assert (row.feature, row.p50, row.slow_median, row.slow_max) == ("cpu_max", 25.0, 80.0, 90.0)


def test_scaling_against_one_worker(spark):
    rows = spark.createDataFrame([(1, 10.0), (1, 12.0), (1, 11.0), (2, 20.0), (2, 24.0), (4, 22.0)], "workers int, rate double")
    got = {r.workers: (r.median, r.speedup, r.efficiency) for r in perf.scaling(rows, "rate").collect()}
    assert got == {1: (11.0, 1.0, 1.0), 2: (22.0, 2.0, 1.0), 4: (22.0, 2.0, 0.5)}


def test_merged_and_imported_runs(spark):
    runs, more = spark.createDataFrame([("a", 1)], "id string, n int"), spark.createDataFrame([("b", "x")], "id string, note string")
    assert sorted(map(tuple, perf.merge_runs(runs, more).collect())) == [("a", 1, None), ("b", None, "x")]
    known = spark.createDataFrame([("a", "running")], "id string, status string")
    new = spark.createDataFrame([("a", 3.0), ("b", 4.0), ("b", 4.0)], "id string, p99 double")
    assert sorted(map(tuple, logs.import_runs(known, new).collect())) == [("a", "running", None), ("b", "finished", 4.0)]


def test_run_records_and_report_files(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    for name, text in (("one.json", '{"rate": 5,\n "worker": 1}'), ("two.json", '{"rate": 7, "worker": 2}')):
        (tmp_path / "runs" / name).write_text(text)
    assert sorted((r.source, r.rate) for r in logs.read_runs(spark, f"{tmp_path}/runs/*.json").collect()) == [("one.json", 5), ("two.json", 7)]
    rows = spark.createDataFrame([("e1", "c", "p99", 1.5, 1.0, None, 3, "dropped")], "experiment string, cell string, metric string, median double, min double, max double, n int, more string")
    logs.export_report(rows, f"{tmp_path}/report")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/report").collect()] == [("e1", "c", "p99", "1.5", "1.0", None, "3")]
    assert logs.to_markdown(rows.select("cell", "median", "max")) == "| cell | median | max |\n|---|---|---|\n| c | 1.5 |  |"


def test_anomaly_pool_and_replay(spark):
    rows = [(f"s{k}", "test" if k % 2 else "val", int(k % 3 == 0)) for k in range(30)]
    df = spark.createDataFrame(rows, "session_id string, split string, label int")
    one = [r.session_id for r in logs.anomaly_pool(df, 3, 1).collect()]
    fits = {i for i, s, y in rows if s == "test" and y}
    assert len(one) == 3 and {*one} <= fits and one == [r.session_id for r in logs.anomaly_pool(df.repartition(5), 3, 1).collect()]
    assert {r.session_id for r in logs.anomaly_pool(df, 99, 2).collect()} == fits


def test_time_falls_back_on_the_watermark(spark):
    rows = spark.createDataFrame([("081109 203518 x", 5), ("bad", 7), ("bad", None)], "line string, mark long")
    got = [r[0] for r in rows.select(S.time_or_watermark(F.col("line"), F.col("mark"))).collect()]
    assert got == [(9 + 31 * 11 + 372 * 8) * 86400 + 20 * 3600 + 35 * 60 + 18, 7, 0]


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    """Two files in many splits; bytes that are no UTF-8 go, a written U+FFFD stays, also beside them."""
    (tmp_path / "logs").mkdir()
    want = []
    for name, n in (("b.log", 700), ("a.log", 900), ("c.log", 1)):
        (tmp_path / "logs" / name).write_bytes(b"".join(f"{name} line {k} {'x' * (k % 50)}\n".encode() for k in range(n)))
    for name, n in (("a.log", 900), ("b.log", 700), ("c.log", 1)):
        want += [f"{name} line {k} {'x' * (k % 50)}" for k in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = logs.read_lines(spark, f"{tmp_path}/logs")
        got = {r.line_id: r.line for r in lines.collect()}
        assert lines.rdd.getNumPartitions() > 8 and got == dict(enumerate(want))
        assert sorted(r.line_id for r in logs.read_lines(spark, f"{tmp_path}/logs", 905).collect()) == [*range(905)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "odd.log").write_bytes(b"good \xef\xbf\xbd\nbad \xff\xfe here\nboth \xef\xbf\xbd \xc3(\n\n\xe4\xb8\xad\n")
    assert [r.line for r in logs.read_lines(spark, f"{tmp_path}/odd.log").orderBy("line_id").collect()] == ["good \ufffd", "bad  here", "both \ufffd (", "", "中"]


def test_spans_of_any_length_make_few_rows(spark):
    """Points in spans from no length to ten million seconds, against all pairs."""
    rng = random.Random(4)
    spans = [(f"r{k % 2}", k, low, low + rng.choice([0, 1, 30, 4000, 10**7])) for k, low in enumerate(rng.uniform(-1e5, 1e5) for _ in range(60))] + [("r0", 99, 5.0, 4.0)]
    points = [(f"r{k % 2}", k, rng.uniform(-1e5, 1.2e7) if k % 2 else rng.uniform(-1e5, 1e5)) for k in range(300)] + [("r0", 900, spans[0][2]), ("r0", 901, spans[0][3])]
    a, b = spark.createDataFrame(points, "run string, p int, t double"), spark.createDataFrame(spans, "run string, nth int, low double, high double")
    joined = perf.range_join(a, b, "t", "low", "high", ["run"])
    assert sorted((r.p, r.nth) for r in joined.collect()) == sorted((p, n) for run, p, t in points for g, n, low, high in spans if run == g and low <= t <= high)
    one = spark.createDataFrame([("r", 0.0, 1e7)], "run string, low double, high double")
    level = one.select(perf._level(F.col("low"), F.col("high"), 10.0)).first()[0]
    assert 1e7 / (10 * perf.STEP**level) <= perf.STEP


def test_bins_of_a_long_run(spark, monkeypatch):
    monkeypatch.setattr(perf, "BLOCK", 7)
    runs = spark.createDataFrame([("a", 0.5, 60.9), ("b", 0.0, 0.5), ("c", 10.0, 12.0)], "run string, start double, end double")
    spans = spark.createDataFrame([("a", 10.2, 12.4), ("a", 30.0, 30.0)], "run string, low double, until double")
    got = sorted(map(tuple, perf.normal_bins(runs, spans).select("run", "t").collect()))
    want = [("a", 0.5 + k) for k in range(1, 60) if 0.5 + k + 1 <= 60.9 and not any(low <= 0.5 + k + 1 and until >= 0.5 + k for low, until in ((10.2, 12.4), (30.0, 30.0)))]
    assert got == sorted([*want, ("c", 11.0)])


def test_consecutive_windows_of_lines_that_share_a_number(spark):
    """As SQL's running sum has it: peers lie in the island that stands after all of them, apart from the lines before."""
    rows = [(1, 0, 0), (1, 10, 0), (2, 20, 1), (2, 3700, 0), (3, 3800, 0), (4, 30, 0), (5, 40, 1)]
    lines = spark.createDataFrame(rows, "line_id long, ts long, label int").repartition(3)
    got = sessions.windowed_sessions(lines, 3600, 1, "consecutive").collect()
    # The second number opens window 1 after window 0 has gone on: its line of window 0 is no longer with the first two.
    assert sorted((r.session_id, r.label, r.n) for r in got) == [("w0", 0, 2), ("w0", 1, 1), ("w0", 1, 2), ("w1", 0, 2)]


def test_forest_does_not_cut_at_last_bits(spark):
    """Weights that differ by the order of their sums alone grow the same trees."""
    rows = [(f"s{k}", c, 0.1 * (k % 3 + 1) + 0.2 * c) for k in range(60) for c in range(3)]
    forests = []
    for noise in (0.0, 1e-16):
        moved = [(s, c, w + noise * ((int(s[1:]) // 3 + c) % 3)) for s, c, w in rows]
        forests.append(detectors.IForestDetector(n_estimators=4).fit(spark.createDataFrame(moved, "session_id string, col int, w double")).trees)
    assert all(np.array_equal(a, b) for s, t in zip(*forests) for a, b in zip(s, t))


@pytest.mark.parametrize("similarity", [0.0, 0.4, 0.7, 1.0, 1.1])
def test_templates_near_a_term_are_all_that_can_win(monkeypatch, similarity):
    """A leaf that looks only at templates near a term, from the first on, ends as one that looks at all."""
    rng = random.Random(3)
    terms = [["<*>" if rng.random() < 0.1 else f"w{int(rng.paretovariate(0.7))}" for _ in range(7)] for _ in range(400)]
    found, looked = [], []
    near = templates.Leaf._near
    monkeypatch.setattr(templates.Leaf, "_near", lambda self, codes: looked.append((self.n, got := near(self, codes))) or got)
    for few in (10**9, 0):
        monkeypatch.setattr(templates, "FEW", few)
        leaf = templates.Leaf(7, similarity)
        looked.clear()
        for term in terms:
            leaf.add(term)
        found.append(leaf.templates())
    assert found[0] == found[1]
    assert similarity == 0 or sum(len(got) for _, got in looked) < sum(n for n, _ in looked)


def test_grid_masks_lines_once(spark, monkeypatch):
    from logloom.plans import anomaly

    rows = spark.createDataFrame([(f"s{k}", k * 5 + j, f"h {'abcde'[j]} {'x' if k % 10 == 9 else 'y'} z") for k in range(40) for j in range(5)], "session_id string, line_id long, line string")
    sess = spark.createDataFrame([(f"s{k}", int(k % 10 == 9), "train" if k < 20 else "test") for k in range(40) if k % 10 != 9 or k >= 20], "session_id string, label int, split string")
    calls, counted = [], anomaly.features.message_counts
    monkeypatch.setattr(anomaly.features, "message_counts", lambda *a: calls.append(1) or counted(*a))
    got = anomaly.grid(rows, sess, {"parser": ["regex", "drain"], "weighting": ["binary"]}, header_tokens=1).collect()
    assert len(calls) == 1 and [(r.tp + r.fn, r.fp + r.tn) for r in got] == [(2, 18), (2, 18)]


def test_fits_read_all_sessions(spark, monkeypatch):
    """Of 26,000, with 40 rare columns of one session each: the models know all columns, and PCA's means and axes are those of all rows."""
    every = spark.range(26_000).select(F.concat(F.lit("s"), "id").alias("session_id"), F.when(F.col("id") % 650 == 7, F.lit(0)).otherwise(1).alias("rare"), "id")
    rare = every.filter("rare = 0").select("session_id", (2 + F.floor(F.col("id") / 650)).cast("int").alias("col"), F.lit(1.0).alias("w"))
    vectors = every.select("session_id", F.lit(0).alias("col"), (F.col("id") % 10 / 10).alias("w")).union(every.filter("id % 3 = 0").select("session_id", F.lit(1), F.lit(0.5))).union(rare)
    monkeypatch.setattr(detectors, "CELLS", 5000)  # a few rows at a time
    model = detectors.PCADetector(variance=0.7).fit(vectors)
    assert sorted(model.columns) == list(range(42))
    x = np.zeros((26_000, 42))
    k = np.arange(26_000)
    x[:, 0], x[::3, 1] = k % 10 / 10, 0.5
    x[k[k % 650 == 7], 2 + k[k % 650 == 7] // 650] = 1
    assert model.mean == pytest.approx(x.mean(axis=0))
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.abs(model.loadings @ axes[:, ::-1][:, : len(model.loadings)]) == pytest.approx(np.eye(len(model.loadings)), abs=1e-6)
    assert sorted(detectors.AEDetector(max_iter=1).fit(vectors).columns) == list(range(42))


def test_early_thresholds_are_the_best_of_all_scores(spark):
    """Of 1,700 distinct scores of the validation split none is passed over."""
    from logloom.plans import anomaly

    sessions_ = spark.createDataFrame([(f"s{k}", int(k >= 40 and random.Random(k).random() < k / 1800), "train" if k < 40 else "val") for k in range(1740)], "session_id string, label int, split string")
    lines = spark.range(1740).selectExpr("concat('s', id) AS session_id", "explode(concat(array_repeat(1, cast(1 + id % 45 AS int)), array_repeat(2, cast(1 + id div 45 AS int)))) AS col")
    seq = lines.selectExpr("session_id", "col", "0L AS dt", "0L AS pos")
    detector = detectors.PCADetector()
    model = anomaly.AnomalyModel("regex", 4, spark.createDataFrame([("a", 1), ("b", 2)], "term string, col int"), None, None, detector)
    scores = sessions_.select("session_id", F.lit(0.0).alias("score"))
    early = anomaly.attach_early(model, seq, sessions_, scores, 10, max_components=1, variance=0.1)
    _, fitted, vectors = anomaly._fit_snapshot(model, seq, sessions_, 10, "pca", max_components=1, variance=0.1)
    held = [(r.score, r.label) for r in fitted.score(vectors).join(sessions_.filter("split = 'val'"), "session_id").collect()]
    assert len({s for s, _ in held}) > 800

    def f1(least):
        tp, fp, p = sum(s > least - 1e-12 and y for s, y in held), sum(s > least - 1e-12 and not y for s, y in held), sum(y for _, y in held)
        return 2 * tp / (tp + fp + p)

    assert f1(early.threshold) == max(f1(s) for s, _ in held)
    assert early.detector.mean == pytest.approx(fitted.mean)


def test_grid_fits_on_all_train_sessions(spark):
    """Of 24,000 sessions, 30 with a message of their own in place of one: every cell's model and threshold know them, as a fit on all rows does."""
    from logloom.plans import anomaly
    from logloom.session import cut

    every = spark.range(24_400).withColumn("session_id", F.concat(F.lit("s"), "id"))
    term = F.when(F.col("id") % 800 == 3, F.concat(F.lit("rare "), F.chr(97 + F.floor(F.col("id") / 800)), F.lit(" q"))).otherwise(F.lit("often seen z"))
    counts = every.filter("id < 24000 OR id % 2 = 0").select("session_id", term.alias("term"), F.col("id").alias("first_line"), F.lit(1).cast("long").alias("cnt")).union(
        every.filter("id % 4 <> 3").select("session_id", F.lit("other words y"), F.col("id"), (1 + F.col("id") % 3)))
    sess = every.select("session_id", (F.col("id") >= 24_200).cast("int").alias("label"), F.when(F.col("id") < 24_000, "train").otherwise("test").alias("split"))
    counts = cut(counts)
    for parser in ("regex", "drain"):
        model = anomaly.train_counts(counts, sess, parser, "pca", similarity=0.9)
        assert sorted(model.detector.columns) == list(range(1, 33))
        x = anomaly.features.tfidf(model.column_counts(counts), model.idf).join(sess.filter("split = 'train'"), "session_id").groupBy("col").agg((F.sum("w") / 24_000).alias("m")).collect()
        means = {r.col: r.m for r in x}
        assert model.detector.mean == pytest.approx(np.array([means[c] for c in model.detector.columns]))
        assert model.meta["n_train"] == 24_000
