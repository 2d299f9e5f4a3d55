"""The anomaly model: train sessions to columns, weights, detector and threshold; saved as tables.

``rows`` are (session_id, line_id, line), ``sessions`` (session_id, label, split); everything is fitted on normal train sessions.
"""

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, drift, features, metrics, store, templates
from ..session import cut

INFINITY = float("inf")
THRESHOLDS = ("percentile", "three_sigma", "tuned")
POLICIES = ("static_tuned", "static_p99", "periodic", "triggered", "oracle")


@dataclass
class AnomalyModel:
    parser: str
    header_tokens: int
    columns: DataFrame  # (term, col)
    templates: DataFrame | None
    idf: DataFrame  # (col, idf)
    detector: detectors.Detector
    threshold: float = float("inf")
    meta: dict = field(default_factory=dict)
    early: "EarlyCheck | None" = None
    weighting: str = "tfidf"
    depth: int = 4  # of the tree of templates

    def counts(self, rows: DataFrame) -> DataFrame:
        """(session_id, col, cnt) of any rows, by the columns of the train strings."""
        return self.column_counts(features.message_counts(rows, self.header_tokens))

    def column_counts(self, counts: DataFrame) -> DataFrame:
        """The same of messages that are counted by term already."""
        columns = self.columns
        if self.templates is not None:
            columns = templates.serve_columns(counts.select("term").distinct(), self.columns, self.templates, self.depth)
        return features.to_columns(counts, columns)

    def score_counts(self, counts: DataFrame) -> DataFrame:
        """(session_id, score)."""
        return self.detector.score(features.vectors(counts, self.idf, self.weighting))

    def transform(self, rows: DataFrame) -> DataFrame:
        """(session_id, score, flagged)."""
        return self.flagged(self.counts(rows))

    def flagged(self, by_column: DataFrame) -> DataFrame:
        """(session_id, score, flagged) of counts by column."""
        return self.score_counts(by_column).withColumn("flagged", F.col("score") >= self.threshold)

    def save(self, path: str) -> None:
        tables = {"columns": self.columns, "idf": self.idf}
        spec = {"parser": self.parser, "header_tokens": self.header_tokens, "threshold": self.threshold, "meta": self.meta, "weighting": self.weighting, "depth": self.depth, **_detector_spec(self.detector)}
        if self.templates is not None:
            tables["templates"] = self.templates
        if self.early is not None:
            tables["early_idf"] = self.early.idf
            spec["early"] = {"age_s": self.early.age_s, "threshold": self.early.threshold, **_detector_spec(self.early.detector)}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.columns.sparkSession
        spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyModel":
        spec = json.loads(spark.read.parquet(f"{path}/spec").first()[0])
        table = lambda name: spark.read.parquet(f"{path}/{name}")
        early = spec.get("early")
        check = early and EarlyCheck(early["age_s"], table("early_idf"), _read_detector(early), early["threshold"])
        templates = table("templates") if spec["parser"] == "drain" else None
        return AnomalyModel(spec["parser"], spec["header_tokens"], table("columns"), templates, table("idf"), _read_detector(spec), spec["threshold"], spec["meta"], check or None, spec["weighting"], spec.get("depth", 4))


def _detector_spec(detector: detectors.Detector) -> dict:
    kind = next(k for k, v in detectors.MODELS.items() if isinstance(detector, v))
    return {"kind": kind, "detector": {k: _plain(v) for k, v in vars(detector).items()}}


def _read_detector(spec: dict) -> detectors.Detector:
    detector = detectors.MODELS[spec["kind"]]()
    for k, v in spec["detector"].items():
        setattr(detector, k, _value(v))
    return detector


def _plain(v: object) -> object:
    if isinstance(v, np.ndarray):
        return {"array": v.tolist(), "dtype": str(v.dtype)}
    if isinstance(v, dict):
        return {"map": [[int(a), int(b)] for a, b in v.items()]}
    if isinstance(v, (list, tuple)):
        return {"list": [_plain(x) for x in v]}
    return v


def _value(v: object) -> object:
    if isinstance(v, dict):
        if "array" in v:
            return np.array(v["array"], v["dtype"])
        return {a: b for a, b in v["map"]} if "map" in v else [_value(x) for x in v["list"]]
    return v


@dataclass
class EarlyCheck:
    age_s: int
    idf: DataFrame
    detector: detectors.Detector
    threshold: float


def train(rows: DataFrame, sessions: DataFrame, parser: str = "regex", model: str = "pca", rule: str = "percentile", header_tokens: int = 4, max_events: int = 5000, weighting: str = "tfidf", similarity: float = 0.4, depth: int = 4, **params: object) -> AnomalyModel:
    """Frequencies, columns, weights, detector and threshold, in this order; ``rule`` tuned reads the validation split."""
    counts = cut(features.message_counts(rows, header_tokens))
    return train_counts(counts, sessions, parser, model, rule, header_tokens, max_events, weighting, similarity, depth, **params)


def train_counts(counts: DataFrame, sessions: DataFrame, parser: str = "regex", model: str = "pca", rule: str = "percentile", header_tokens: int = 4, max_events: int = 5000, weighting: str = "tfidf", similarity: float = 0.4, depth: int = 4, **params: object) -> AnomalyModel:
    """``train`` on messages that are masked and counted already, written (session_id, term, first_line, cnt)."""
    normal = sessions.filter("split = 'train' AND label = 0")
    vocab = cut(features.vocabulary(counts))
    freq = cut(features.train_frequency(counts, normal))
    named = None
    if parser == "drain":
        columns, named = templates.template_columns(freq, vocab, similarity, depth, max_events)
    else:
        columns = features.top_terms(freq, vocab, max_events)
    columns = cut(columns)
    by_column = cut(features.to_columns(counts, columns))
    idf = cut(features.fit_idf(by_column, normal, columns))
    vectors = cut(features.vectors(by_column, idf, weighting))
    fit_on = vectors.join(normal.select("session_id"), "session_id", "left_semi")
    detector = detectors.MODELS[model](**params).fit(fit_on)
    out = AnomalyModel(parser, header_tokens, columns, named, idf, detector, weighting=weighting, depth=depth)
    scores = cut(detector.score(vectors).join(sessions, "session_id"))
    chosen = scores.filter("split = 'train' AND label = 0").select(F.col("score").alias("s"))
    if rule == "percentile":
        found = metrics.percentile_threshold(chosen)
    elif rule == "three_sigma":
        found = metrics.three_sigma(chosen)
    else:
        found = metrics.best_threshold(scores.filter("split = 'val'").select(F.col("score").alias("s"), F.col("label").alias("y"))).select("threshold")
    out.threshold = found.first()[0]
    out.meta = {"parser": parser, "model": model, "rule": rule, "n_train": normal.count(), "n_columns": columns.agg(F.max("col")).first()[0] or 0}
    return out


def _fit_snapshot(model: AnomalyModel, seq: DataFrame, sessions: DataFrame, age_s: int, kind: str, **params: object) -> tuple[DataFrame, detectors.Detector, DataFrame]:
    """Weights and a detector for the first ``age_s`` seconds of normal train sessions, and all sessions' vectors at that age."""
    snapshot = cut(features.snapshot_counts(seq, age_s))
    normal = sessions.filter("split = 'train' AND label = 0")
    idf = cut(features.fit_idf(snapshot, normal, model.columns))
    vectors = cut(features.tfidf(snapshot, idf))
    return idf, detectors.MODELS[kind](**params).fit(vectors.join(normal.select("session_id"), "session_id", "left_semi")), vectors


def attach_early(model: AnomalyModel, seq: DataFrame, sessions: DataFrame, scores: DataFrame, age_s: int, kind: str = "pca", gate: int = 13, **params: object) -> EarlyCheck:
    """Fit a detector on the first ``age_s`` seconds of normal train sessions; its threshold goes best with the incremental rule.

    ``seq``: (session_id, pos, dt, col); ``scores``: (session_id, score) of whole sessions.
    """
    idf, detector, vectors = _fit_snapshot(model, seq, sessions, age_s, kind, **params)
    n = seq.groupBy("session_id").agg(F.count("*").alias("n"))
    val = detector.score(vectors).withColumnRenamed("score", "snap").join(sessions.filter("split = 'val'"), "session_id").join(scores, "session_id").join(n, "session_id")
    rows = val.select(((F.col("n") >= gate) & (F.col("score") >= model.threshold)).alias("inc"), "snap", F.col("label").alias("y"))
    model.early = EarlyCheck(age_s, idf, detector, metrics.union_rule(cut(rows), candidates=None).first()["threshold"])
    return model.early


def incremental_alerts(seq: DataFrame, model: AnomalyModel, gate: int = 13, longest: int = 64) -> DataFrame:
    """(session_id, dt): when the gated rule first fires on a prefix of at most ``longest`` lines; longer sessions are looked at once more at their end.

    Prefixes of one session share its counts: each is rebuilt from the first lines, ``longest`` at most.
    """
    sized = features.first_lines(seq, longest)
    ends = sized.filter(F.col("pos") >= gate - 1).select("session_id", F.col("pos").alias("end"), F.col("dt").alias("at"))
    prefix = ends.join(sized, "session_id").filter("pos <= end").groupBy("session_id", "end", "at", "col").agg(F.count("*").alias("cnt"))
    last = seq.groupBy("session_id").agg(F.max("dt").alias("at"), F.max("pos").alias("end")).filter(F.col("end") >= longest)
    whole = seq.join(last, "session_id").groupBy("session_id", "end", "at", "col").agg(F.count("*").alias("cnt"))
    every = prefix.unionByName(whole).withColumn("id", F.concat_ws("\u0000", "session_id", F.col("end").cast("string")))
    scored = model.score_counts(every.select(F.col("id").alias("session_id"), "col", "cnt")).filter(F.col("score") >= model.threshold)
    hits = scored.withColumnRenamed("session_id", "id").join(every.select("id", "session_id", "at").distinct(), "id")
    return hits.groupBy("session_id").agg(F.min("at").alias("dt"))


def early_study(model: AnomalyModel, seq: DataFrame, sessions: DataFrame, scores: DataFrame, ages: Iterable[int], kinds: Iterable[str] = ("pca",), gate: int = 13, longest: int = 64) -> DataFrame:
    """(rule, kind, age, threshold, val_f1, tp .. f1, delay_p50, delay_p95, selected) on the test split, a row for each rule.

    lines: the incremental rule alone; short: or fewer than ``gate`` lines at the age, without a model; snapshot: or a detector of
    its own for the age, at the threshold of the best F1 on the validation split. ``selected`` by validation alone: the shortest
    age whose F1 is at most 0.01 below that of whole sessions. ``seq``, ``scores`` as for ``attach_early``.
    """
    fired = cut(incremental_alerts(seq, model, gate, longest))
    named = cut(sessions.filter("split in ('val', 'test')").select("session_id", "split", F.col("label").alias("y")).join(fired.withColumnRenamed("dt", "inc_delay"), "session_id", "left"))
    test, val = named.filter("split = 'test'"), named.filter("split = 'val'")
    whole = metrics.confusion(scores.join(val, "session_id"), F.col("score") >= model.threshold).first()["f1"]

    def row(rule: str, kind: str | None, age: int | None, threshold: float, snap: DataFrame, val_f1: float | None) -> DataFrame:
        told = metrics.early_rule(test.join(snap, "session_id", "left"), age or 0, threshold)
        values = {"rule": (rule, "string"), "kind": (kind, "string"), "age": (age, "int"), "threshold": (threshold, "double"), "val_f1": (val_f1, "double")}
        return told.select(*[F.lit(v).cast(t).alias(c) for c, (v, t) in values.items()], *told.columns)

    nothing = seq.select("session_id", F.lit(None).cast("double").alias("snap")).limit(0)
    out = [row("lines", None, None, INFINITY, nothing, None)]
    for age in ages:
        lines = seq.groupBy("session_id").agg(F.sum((F.col("dt") <= age).cast("int")).alias("n"))
        out.append(row("short", None, age, 0.5, lines.select("session_id", (F.col("n") < gate).cast("double").alias("snap")), None))
        for kind in kinds:
            _, detector, vectors = _fit_snapshot(model, seq, sessions, age, kind)
            snap = cut(detector.score(vectors).select("session_id", F.col("score").alias("snap")))
            best = metrics.union_rule(cut(val.join(snap, "session_id").select(F.col("inc_delay").isNotNull().alias("inc"), "snap", "y")), candidates=None).first()
            out.append(row("snapshot", kind, age, INFINITY if best["threshold"] is None else best["threshold"], snap, best["f1"]))
    rows = cut(metrics.union_all(out))
    pick = metrics.shortest_age(rows, whole).select("kind", "age").first()
    return rows.withColumn("selected", F.coalesce((F.col("kind") == pick["kind"]) & (F.col("age") == pick["age"]), F.lit(False)) if pick else F.lit(False))


def grid(rows: DataFrame, sessions: DataFrame, axes: dict[str, list], header_tokens: int = 4) -> DataFrame:
    """A row for each combination of ``axes``: their values, threshold, tp .. f1, roc_auc, average_precision on the test split.

    Axes are parameters of ``train``: parser, model, seed, weighting, similarity and depth (of templates), max_events, variance (PCA),
    bottleneck (autoencoder), rule; one fit after the other, all on lines that are masked and counted once.
    """
    out, counts = [], cut(features.message_counts(rows, header_tokens))
    for values in product(*axes.values()):
        cell = dict(zip(axes, values))
        fitted = train_counts(counts, sessions, header_tokens=header_tokens, **cell)
        test = cut(fitted.flagged(fitted.column_counts(counts.join(sessions.filter("split = 'test'").select("session_id"), "session_id", "left_semi"))).join(sessions.filter("split = 'test'"), "session_id").select(F.col("score").alias("s"), F.col("label").alias("y"), "flagged"))
        found = metrics.confusion(test, F.col("flagged")).crossJoin(metrics.ranking_metrics(test))  # one row each
        out.append(found.select(*[F.lit(v).alias(k) for k, v in cell.items()], F.lit(fitted.threshold).alias("threshold"), *found.columns))
    return metrics.union_all(out)


def retrain_with_feedback(rows: DataFrame, sessions: DataFrame, alerts: DataFrame, least: int = 10, **params: object) -> AnomalyModel | None:
    """A model with sessions that were false positives among its train sessions; none below ``least`` of them."""
    folded, matched, _ = store.fold_feedback(sessions, store.false_positive_keys(alerts), least)
    return train(rows, folded, **params) if matched >= least else None


def _fit_window(counts: DataFrame, vocab: DataFrame, fit_on: DataFrame, window: DataFrame, model: str, max_events: int, **params: object) -> AnomalyModel:
    """Columns, weights and detector from the sessions ``fit_on``, the threshold from all scores of ``window``, which holds them."""
    on = cut(fit_on.select("session_id", F.lit("train").alias("split")))
    columns = cut(features.top_terms(features.train_frequency(counts, on), vocab, max_events))
    by_column = cut(features.to_columns(counts.join(window.select("session_id"), "session_id", "left_semi"), columns))
    idf = cut(features.fit_idf(by_column, on, columns))
    vectors = cut(features.tfidf(by_column, idf))
    detector = detectors.MODELS[model](**params).fit(vectors.join(on, "session_id", "left_semi"))
    threshold = metrics.percentile_threshold(detector.score(vectors), s="score").first()[0]
    return AnomalyModel("regex", 0, columns, None, idf, detector, INFINITY if threshold is None else threshold)


def drift_study(counts: DataFrame, sessions: DataFrame, model: str = "pca", window: int = 2, trigger: float = 0.05, max_events: int = 5000, **params: object) -> DataFrame:
    """(policy, chunk, fit_from, fit_to, threshold, unk_share, tp .. roc_auc): retraining policies over the chunks of the test sessions.

    ``counts`` (session_id, term, first_line, cnt) as they read in their chunk; ``sessions`` (session_id, label, split, chunk from 0).
    static: the fit on normal train sessions, at the best threshold of the validation split or at the 99th percentile; periodic:
    on the ``window`` chunks before; oracle: on these without anomalies, at the threshold of all of them; triggered: on these if the chunk before
    had a larger share than ``trigger`` of lines that its model does not know, else as the chunk before. Chunk 0 is always static.
    Policies are taken chunk by chunk, a fit at a time; what one fit reads is a window.
    """
    counts, sessions = cut(counts), cut(sessions)
    vocab = cut(features.vocabulary(counts))
    test = sessions.filter("split = 'test'")
    of = lambda some: counts.join(some.select("session_id"), "session_id", "left_semi")
    fit = lambda fit_on, all_: _fit_window(counts, vocab, fit_on, all_, model, max_events, **params)
    normal = sessions.filter("split = 'train' AND label = 0")
    static = fit(normal, normal)
    val = sessions.filter("split = 'val'").select("session_id", F.col("label").alias("y"))
    tuned = metrics.best_threshold(cut(static.score_counts(features.to_columns(of(val), static.columns)).join(val, "session_id").select(F.col("score").alias("s"), "y"))).first()[0]
    last = test.agg(F.max("chunk")).first()[0] or 0
    held, out, unheld = (static, static.threshold, None, None), [], None  # the last: the share of the chunk before that ``held`` does not know
    for chunk in range(last + 1):
        first = max(0, chunk - window)
        arms = dict.fromkeys(POLICIES, (static, static.threshold, None, None)) | {"static_tuned": (static, tuned, None, None)}
        if chunk:
            recent = test.filter(F.col("chunk").between(first, chunk - 1))
            periodic = fit(recent, recent)
            arms["periodic"] = (periodic, periodic.threshold, first, chunk - 1)
            pure = fit(recent.filter("label = 0"), recent)
            arms["oracle"] = (pure, pure.threshold, first, chunk - 1)
            if (unheld or 0.0) > trigger:
                held = arms["periodic"]
            arms["triggered"] = held
        now, scored = cut(test.filter(F.col("chunk") == chunk).select("session_id", "chunk", F.col("label").alias("y"))), {}
        for policy, (fitted, threshold, fit_from, fit_to) in arms.items():
            if id(fitted) not in scored:
                by_column = cut(features.to_columns(of(now), fitted.columns))  # read by scores and by the share that is not known
                rated = cut(fitted.score_counts(by_column).join(now, "session_id").select("chunk", F.col("score").alias("s"), "y"))
                scored[id(fitted)] = rated, drift.unknown_share(by_column, []).first()[0]
            rows, unknown = scored[id(fitted)]
            if policy == "triggered":
                unheld = unknown
            told = drift.chunk_metrics(rows, threshold)
            values = {"policy": (policy, "string"), "fit_from": (fit_from, "int"), "fit_to": (fit_to, "int"), "threshold": (threshold, "double"), "unk_share": (unknown, "double")}
            out.append(told.select(*[F.lit(v).cast(t).alias(c) for c, (v, t) in values.items()], *told.columns))
    return metrics.union_all(out)
