"""Anomaly detectors over sparse session vectors (session_id, col, w). Higher scores are more anomalous.

Fits and scores read all sessions; PCA and the autoencoder take fewer where a caller sets ``max_fit_rows``. Models are plain values of bounded size.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import with_rank

#: Sessions that ``FIT_PARTS`` tasks hold at once while an autoencoder is fitted.
FIT_ROWS = 20_000
#: Steps of an autoencoder's task between two averages.
LOCAL_STEPS = 10
#: Tasks of a fit where the results of each are large.
FIT_PARTS = 16


def sample_sessions(vectors: DataFrame, n: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """(session_id): exactly min(n, all) sessions, the same on every run."""
    return vectors.select("session_id").distinct().orderBy(F.xxhash64(F.lit(seed), "session_id"), "session_id").limit(n)


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("session_id").agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("w").cast("double").alias("w"))).alias("x"))


def _fit_rows(vectors: DataFrame, n: int | None, seed: int) -> DataFrame:
    """``_rows`` of all sessions, or of ``n`` that are drawn, written."""
    return cut(_rows(vectors if n is None else vectors.join(sample_sessions(vectors, n, seed), "session_id", "left_semi")))


def _fit_columns(rows: DataFrame) -> dict[int, int]:
    return {c: k for k, c in enumerate(sorted(r[0] for r in rows.select(F.explode("x.col")).distinct().collect()))}


def _dense(x: pd.Series, columns: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(x), len(columns)))
    for k, row in enumerate(x):
        for e in row:
            if (at := columns.get(e["col"])) is not None:
                out[k, at] = e["w"]
    return out


#: Numbers that a task holds at once while it scores, at most or one row's.
CELLS = 2_000_000


@dataclass
class Sparse:
    """Rows of a matrix by their entries: row k has those from ``starts[k]`` up to ``starts[k + 1]``."""

    starts: np.ndarray
    at: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def read(x: pa.ListArray, columns: dict[int, int]) -> "Sparse":
        """Entries of columns that are not among ``columns`` are left out."""
        entries, lengths = x.flatten(), x.value_lengths().fill_null(0).to_numpy()
        names = entries.field("col").to_numpy(zero_copy_only=False)
        known, place = (np.array([*side], np.int64) for side in (columns.keys(), columns.values()))
        order = np.argsort(known)
        found = np.minimum(np.searchsorted(known, names, sorter=order), max(0, len(known) - 1))
        held = known[order[found]] == names if len(known) else np.zeros(len(names), bool)
        row = np.repeat(np.arange(len(lengths)), lengths)[held]
        starts = np.append(0, np.cumsum(np.bincount(row, minlength=len(lengths))))
        at = place[order[found[held]]] if len(known) else np.zeros(0, np.int64)
        return Sparse(starts, at, entries.field("w").to_numpy(zero_copy_only=False)[held], len(columns))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def part(self, low: int, high: int) -> "Sparse":
        a, b = self.starts[low], self.starts[high]
        return Sparse(self.starts[low : high + 1] - a, self.at[a:b], self.values[a:b], self.width)

    def parts(self) -> "Iterator[Sparse]":
        """A few rows at a time, of ``CELLS`` numbers once they are dense."""
        step = max(1, CELLS // max(1, self.width))
        return (self.part(k, min(len(self), k + step)) for k in range(0, len(self), step))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.width))
        out[self.rows(), self.at] = self.values
        return out

    def sums(self, of: np.ndarray) -> np.ndarray:
        """The sum of each row's entries of ``of``."""
        return np.bincount(self.rows(), of, len(self))


def _score_with(vectors: DataFrame, model: "Detector") -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score_sparse(Sparse.read(batch.column("x"), shared.value.columns))
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), pa.array(scores, pa.float64())], ["session_id", "score"])

    return _rows(vectors).mapInArrow(run, "session_id string, score double")


class Detector:
    """fit(vectors) then score(vectors): (session_id, score)."""

    columns: dict[int, int]

    def fit(self, vectors: DataFrame) -> "Detector":
        raise NotImplementedError

    def score_matrix(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def score_sparse(self, x: Sparse) -> np.ndarray:
        """The scores of ``score_matrix``, a few rows at a time, so that memory does not grow with the number of columns."""
        return np.concatenate([np.zeros(0), *(self.score_matrix(part.dense()) for part in x.parts())])

    def score(self, vectors: DataFrame) -> DataFrame:
        return _score_with(vectors, self)


@dataclass
class PCADetector(Detector):
    """Squared distance from the subspace of the leading components (SPE)."""

    variance: float = 0.95
    max_components: int = 64
    max_fit_rows: int | None = None
    seed: int = 0
    columns: dict[int, int] = field(default_factory=dict)
    mean: np.ndarray | None = None
    loadings: np.ndarray | None = None

    def fit(self, vectors: DataFrame) -> "PCADetector":
        """Tasks add up products of columns over all sessions, row by row of the matrix; the driver gets one array for each column."""
        rows = _fit_rows(vectors, self.max_fit_rows, self.seed)
        n = rows.count()
        self.columns = columns = _fit_columns(rows)
        d = len(columns)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((d + 1, d))  # the last row: plain sums
            for batch in batches:
                for part in Sparse.read(batch.column("x"), columns).parts():
                    x = part.dense()
                    sums[:d] += x.T @ x
                    sums[d] += x.sum(axis=0)
            for k in np.flatnonzero(sums.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k].tobytes()])], ["k", "v"])

        def add(df: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": df.k[:1], "v": [sum(np.frombuffer(v) for v in df.v).tobytes()]})

        sums = np.zeros((d + 1, d))
        # A task hands on a whole matrix, so that fewer take part where it is large.
        few = rows.select("x").coalesce(max(FIT_PARTS, CELLS // max(1, d * d)))
        for row in few.mapInArrow(products, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect():
            sums[row.k] = np.frombuffer(row.v)
        self.mean = sums[d] / max(n, 1)
        cov = sums[:d] / max(n, 1) - np.outer(self.mean, self.mean)
        values, axes = np.linalg.eigh(cov)
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        share = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones(d)
        keep = min(int(np.searchsorted(share, self.variance - 1e-12) + 1), self.max_components, d)
        self.loadings = axes[:, : max(1, keep)].T
        return self

    def score_matrix(self, x: np.ndarray) -> np.ndarray:
        c = x - self.mean
        return np.maximum(0, (c**2).sum(axis=1) - ((c @ self.loadings.T) ** 2).sum(axis=1))

    def score_sparse(self, x: Sparse) -> np.ndarray:
        """|x|^2 - 2 x m + |m|^2 - |V x - V m|^2 by entries: the columns that a session lacks cost nothing."""
        loads, shift = np.ascontiguousarray(self.loadings.T), self.loadings @ self.mean
        own = x.sums(x.values**2 - 2 * x.values * self.mean[x.at]) + self.mean @ self.mean
        inside = np.zeros(len(x))
        for k, v in enumerate(loads.T):
            inside += (x.sums(x.values * v[x.at]) - shift[k]) ** 2
        return np.maximum(0, own - inside)


def pca_residual(vectors: DataFrame, mean: DataFrame, loadings: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, score) as joins and sums: ``mean`` (col, m), ``loadings`` (comp, col, v), ``sessions`` all ids to score.

    |x - m|^2 - |V (x - m)|^2, with x - m expanded so that only columns in a session are touched.
    """
    with_mean = vectors.join(mean, "col", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    own = with_mean.groupBy("session_id").agg(F.sum(F.col("w") * F.col("w") - 2 * F.col("w") * F.col("m")).alias("own"))
    all_mean = mean.agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("mm"))
    shift = loadings.join(mean, "col").groupBy("comp").agg(F.sum(F.col("v") * F.col("m")).alias("vm"))
    projected = vectors.join(loadings, "col").groupBy("session_id", "comp").agg(F.sum(F.col("w") * F.col("v")).alias("vx"))
    grid = sessions.select("session_id").crossJoin(F.broadcast(shift))  # components: 64 at most
    length = grid.join(projected, ["session_id", "comp"], "left").groupBy("session_id").agg(F.sum(F.pow(F.coalesce("vx", F.lit(0.0)) - F.col("vm"), 2)).alias("inside"))
    out = sessions.select("session_id").join(own, "session_id", "left").join(length, "session_id", "left").crossJoin(F.broadcast(all_mean))  # one row
    return out.select("session_id", F.greatest(F.lit(0.0), F.coalesce("own", F.lit(0.0)) + F.col("mm") - F.coalesce("inside", F.lit(0.0))).alias("score"))


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IForestDetector(Detector):
    """Isolation forest (Liu, Ting, Zhou, 2008): trees of random cuts through small subsamples; anomalies end early."""

    n_estimators: int = 200
    seed: int = 0
    subsample: int = 256
    columns: dict[int, int] = field(default_factory=dict)
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    size: int = 0

    def fit(self, vectors: DataFrame) -> "IForestDetector":
        """Each tree draws its rows from all sessions, which are numbered, and grows in a group of its own, of ``subsample`` rows."""
        spark = vectors.sparkSession
        every = vectors.select("session_id").distinct().withColumn("_draw", F.xxhash64(F.lit(self.seed), "session_id"))
        numbered = cut(with_rank(every, F.col("_draw"), F.col("session_id"), rank="k").select("session_id", "k"))
        n, seed = numbered.count(), self.seed
        self.size = size = min(self.subsample, n)

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                for tree in df.id:
                    yield pd.DataFrame({"tree": int(tree), "k": np.random.default_rng([seed, int(tree)]).choice(n, size, replace=False)})

        def grow(df: pd.DataFrame) -> pd.DataFrame:
            df = df.sort_values("k")
            tree = int(df.tree.iloc[0])
            names = np.array(sorted({e["col"] for row in df.x for e in row}))
            # Rounded: equal sessions differ in their last bits by the order in which Spark added up, and must not be cut apart there.
            x = np.round(_dense(df.x, {c: k for k, c in enumerate(names.tolist())}), 12)
            rng, nodes, todo = np.random.default_rng([seed, tree, 1]), [], [(np.arange(len(x)), 0)]
            while todo:
                rows, depth = todo.pop(0)
                part = x[rows]
                some = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else np.zeros(0, int)
                if depth >= np.ceil(np.log2(max(2, size))) or not len(some):
                    nodes.append((tree, len(nodes), -1, 0.0, -1, depth + float(_average_path(len(rows)))))
                    continue
                f = int(rng.choice(some))
                at = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                nodes.append((tree, len(nodes), int(names[f]), at, len(nodes) + len(todo) + 1, 0.0))  # children come next to each other
                left = part[:, f] <= at
                todo += [(rows[left], depth + 1), (rows[~left], depth + 1)]
            return pd.DataFrame(nodes, columns=["tree", "node", "feature", "at", "child", "path"])

        dealt = cut(spark.range(self.n_estimators if n else 0).mapInPandas(deal, "tree long, k long"))
        drawn = cut(numbered.join(dealt.select("k").distinct(), "k"))
        rows = _rows(vectors.join(drawn, "session_id", "left_semi")).join(drawn, "session_id").select("k", "x")
        got = dealt.join(rows, "k").groupBy("tree").applyInPandas(grow, "tree long, node int, feature int, at double, child int, path double").toPandas()
        self.columns = {int(c): k for k, c in enumerate(sorted(set(got.feature[got.feature >= 0])))}
        got["feature"] = got.feature.map(self.columns).fillna(-1).astype(int)
        self.trees = [tuple(t.sort_values("node")[c].to_numpy() for c in ("feature", "at", "child", "path")) for _, t in got.groupby("tree")]
        return self

    def score_matrix(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for feature, at, child, path in self.trees:
            node = np.zeros(len(x), int)
            while (inner := np.flatnonzero(feature[node] >= 0)).size:
                n = node[inner]
                node[inner] = child[n] + (x[inner, feature[n]] > at[n])
            depth += path[node]
        return 2.0 ** (-depth / max(1, len(self.trees)) / max(1e-9, float(_average_path(self.size))))


@dataclass
class AEDetector(Detector):
    """Autoencoder with one narrow layer; scores are mean squared errors.

    Fitting goes in rounds. In each, every part of the rows takes ``LOCAL_STEPS`` Adam steps from the same weights, and what they
    come to is averaged, weighed by rows: one job a round. Parts are more where there are more rows; the driver gets one sum of each task.
    """

    bottleneck: int = 16
    max_fit_rows: int | None = None
    max_iter: int = 25
    steps: int = 4
    seed: int = 0
    columns: dict[int, int] = field(default_factory=dict)
    layers: list[np.ndarray] = field(default_factory=list)

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, w in enumerate(self.layers):
            z = np.hstack([out[-1], np.ones((len(x), 1))]) @ w
            out.append(np.maximum(z, 0) if k < len(self.layers) - 1 else z)
        return out

    def _gradient(self, x: np.ndarray) -> list[np.ndarray]:
        acts = self._forward(x)
        delta, grads = 2 * (acts[-1] - x) / x.shape[1], []
        for k in range(len(self.layers) - 1, -1, -1):
            grads.append(np.hstack([acts[k], np.ones((len(x), 1))]).T @ delta)
            if k:
                delta = (delta @ self.layers[k][:-1].T) * (acts[k] > 0)
        return grads[::-1]

    def _stepped(self, x: np.ndarray) -> list[np.ndarray]:
        """The layers after ``LOCAL_STEPS`` Adam steps on the rows of ``x``."""
        m, v = ([np.zeros_like(w) for w in self.layers] for _ in range(2))
        for step in range(1, LOCAL_STEPS + 1):
            for k, g in enumerate(self._gradient(x)):
                g = g / len(x)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.layers[k] = self.layers[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self.layers

    def fit(self, vectors: DataFrame) -> "AEDetector":
        sc = vectors.sparkSession.sparkContext
        rows = _fit_rows(vectors, self.max_fit_rows, self.seed)
        self.columns = _fit_columns(rows)
        parts = max(FIT_PARTS, -(-rows.count() * FIT_PARTS // FIT_ROWS))
        rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(parts))))
        d = len(self.columns)
        hidden = min(128, max(32, d // 2))
        rng, sizes = np.random.default_rng(self.seed), [d, hidden, self.bottleneck, hidden, d]
        self.layers = [np.vstack([rng.normal(0, np.sqrt(2 / max(1, a)), (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]
        for _ in range(-(-self.max_iter * self.steps // LOCAL_STEPS)):
            shared = sc.broadcast(self)

            def run(part: pa.Table) -> pa.Table:
                model = pickle.loads(pickle.dumps(shared.value))  # noqa: B023
                x = Sparse.read(part.column("x").combine_chunks(), model.columns).dense()
                return pa.table({"n": [len(x)], "w": [np.concatenate([w.ravel() for w in model._stepped(x)]).tobytes()]})

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n, flat = 0, 0.0
                for batch in batches:
                    for m, w in zip(batch.column("n").to_pylist(), batch.column("w")):
                        n, flat = n + m, flat + m * np.frombuffer(w.as_buffer())
                if n:
                    yield pa.RecordBatch.from_pydict({"n": [n], "w": [flat.tobytes()]})

            stepped = rows.repartition(FIT_PARTS, "part").groupBy("part").applyInArrow(run, "n long, w binary")
            got = stepped.mapInArrow(add, "n long, w binary").collect()  # at most ``FIT_PARTS`` rows
            shared.unpersist()
            total, at = sum(r.n for r in got), 0
            if not total:
                break
            flat = sum(np.frombuffer(r.w) for r in got) / total
            for k, w in enumerate(self.layers):
                self.layers[k] = flat[at : at + w.size].reshape(w.shape)
                at += w.size
        return self

    def score_matrix(self, x: np.ndarray) -> np.ndarray:
        return ((self._forward(x)[-1] - x) ** 2).mean(axis=1)


MODELS = {"iforest": IForestDetector, "pca": PCADetector, "autoencoder": AEDetector}
