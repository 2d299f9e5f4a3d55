"""Exact top-k by inner product, with candidates in buckets of similar length.

After LEMP (Teflioudi, Gemulla, Mykytiuk, SIGMOD 2015). Candidates fall into buckets by length, and these into blocks of at
most ``BLOCK`` rows, sorted by length. Every query first meets a few blocks of the longest vectors, and the k-th best
product is a floor under its result. A bucket can then beat the floor only at a cosine of at least
floor / (|query| * longest length): above 1 the bucket is left out, at a high threshold candidates are pruned by a few of the
query's largest coordinates with Cauchy-Schwarz on the rest, at a low one by length alone. What remains is multiplied out.
A small table has the bounds of all blocks, and only pairs of blocks that can beat a floor are sent to each other, in joins on
the blocks' numbers; no task holds more than one block of each.

Vectors that are null, empty, or hold null or non-finite components take no part. Shorter vectors count as padded with zeros.
Components and scores beyond 64 bits are held to that range.
Rows with the query's own id are not its candidates. Ties go to smaller ids; repeated rows of an id count each, as queries and
as candidates, but are searched once for each distinct (id, vector), with their number.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BLOCK, QUERIES, BUCKETS = 4096, 512, 16
#: Local cosine threshold above which coordinates prune, and how many of them are looked at.
STEEP, COORDINATES = 0.3, 8
#: Products up to here are whole numbers in double arithmetic.
WHOLE = float(1 << 53)


def vectors(df: DataFrame, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id LONG, v ARRAY<DOUBLE> of whole numbers floor(scale * x), length DOUBLE) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.size(vector_col) > 0
    every = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(scale * c).cast("double"))
    rows = df.filter(F.col(vector_col).isNotNull() & fine & every).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each block, its vectors as one binary, the longest first."""
    schema = ", ".join(f"{k} int" for k in keys) + ", ids binary, many binary, lengths binary, vectors binary, width int, longest double"

    def pack(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "vec_id"], ascending=[False, True])
        width = int(df.v.map(len).max())
        m = np.zeros((len(df), width))
        for k, v in enumerate(df.v):
            m[k, : len(v)] = v
        return pd.DataFrame([[*key, df.vec_id.to_numpy("<i8").tobytes(), df.many.to_numpy("<i8").tobytes(), df.length.to_numpy("<f8").tobytes(), m.astype("<f8").tobytes(), width, float(df.length.max())]], columns=[*keys, "ids", "many", "lengths", "vectors", "width", "longest"])

    return rows.groupBy(*keys).applyInPandas(pack, schema)


def _unpack(row: dict, name: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, lengths = np.frombuffer(row[f"{name}ids"], "<i8"), np.frombuffer(row[f"{name}lengths"], "<f8")
    return ids, lengths, np.frombuffer(row[f"{name}vectors"], "<f8").reshape(len(ids), row[f"{name}width"])


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products; in exact integers where doubles are too narrow."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width < WHOLE:
        return (q @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    product = np.asarray(whole(q) @ whole(c).T, object)
    return np.minimum(np.maximum(product, -(1 << 63)), (1 << 63) - 1).astype(np.int64)


def search_block(q_ids: np.ndarray, q_lengths: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c_lengths: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, its place and the places and scores of a block's candidates that may be among its k best, k at most."""
    longest = c_lengths[0] if len(c_lengths) else 0.0
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_lengths * longest > 0, floors / (q_lengths * longest), np.where(floors > 0, np.inf, -np.inf))
    alive = np.flatnonzero(local <= 1 + slack)
    if not len(alive):
        return
    width = min(q.shape[1], c.shape[1])
    steep = alive[local[alive] > STEEP]
    flat = np.setdiff1d(alive, steep)
    kept: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(flat):  # length pruning: candidates are sorted, so those long enough for any of these queries are a prefix
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floors[flat] > 0, floors[flat] / q_lengths[flat], 0).min()
        end = int(np.searchsorted(-c_lengths, -(need * (1 - slack)), side="right"))
        scores = _products(q[flat], c[:end])
        kept += [(x, np.arange(end), scores[n]) for n, x in enumerate(flat)]
    if len(steep):  # coordinate pruning: a part of the product, and Cauchy-Schwarz on the rest
        squares = c[:, :width] ** 2
        for x in steep:
            top = np.argsort(-np.abs(q[x, :width]))[:COORDINATES]
            part = c[:, top] @ q[x, top]
            rest = np.sqrt(np.maximum(0, c_lengths**2 - squares[:, top].sum(axis=1)) * max(0.0, q_lengths[x] ** 2 - (q[x, top] ** 2).sum()))
            some = np.flatnonzero(part + rest >= floors[x] - slack * abs(floors[x]) - 1e-6)
            if len(some):
                kept.append((x, some, _products(q[x : x + 1], c[some])[0]))
    for x, some, scores in kept:
        ok = (c_ids[some] != q_ids[x]) & (scores >= floors[x])
        some, scores = some[ok], scores[ok]
        if len(some) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            some, scores = some[scores >= least], scores[scores >= least]
            order = np.lexsort((c_ids[some], -scores))[:k]
            some, scores = some[order], scores[order]
        if len(some):
            yield int(x), some, scores


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, many) of the blocks of queries against the blocks of candidates that can win, k at most of each block."""
    bounds = cut(candidates.select("bucket", "block", "longest").join(queries.select("q_block", "need"), F.col("need") <= F.col("longest") * (1 + 1e-9)))  # a row for each pair of blocks
    right = queries.select("q_block", *[F.col(x).alias(f"q_{x}") for x in ("ids", "many", "lengths", "vectors", "width", "floors")])
    pairs = candidates.join(bounds.select("bucket", "block", "q_block"), ["bucket", "block"]).join(right, "q_block").repartition("q_block", "bucket", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {name: batch.column(name)[k_row].as_py() for name in batch.schema.names}
                q, c = _unpack(row, "q_"), _unpack(row)
                found = [*search_block(*q, np.frombuffer(row["q_floors"], "<f8"), *c, k)]
                if found:
                    at = np.repeat(np.array([f[0] for f in found]), [len(f[1]) for f in found])
                    some, scores = (np.concatenate([f[x] for f in found]) for x in (1, 2))
                    many = np.minimum(np.frombuffer(row["q_many"], "<i8")[at].astype(float) * np.frombuffer(row["many"], "<i8")[some], k).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[0][at], c[0][some], scores, many)], ["query_id", "vec_id", "score", "many"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long, many long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The rows that hold each query's ranks up to ``k``: ``many`` of them, or as many as there is room for, after rank ``above``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("above", F.sum("many").over(order) - F.col("many")).filter(F.col("above") < k).withColumn("many", F.least("many", k - F.col("above")))


def top_k(rows: DataFrame, is_query: Callable[[str], object], k: int = 10) -> DataFrame:
    """(query_id LONG, rank INT from 1, vec_id LONG, score LONG): the k best candidates of each query, all if there are fewer.

    ``rows``: from ``vectors()``; ``is_query``: a condition on the id's column.
    """
    rows = cut(rows.groupBy("vec_id", "v").agg(F.first("length").alias("length"), F.count("*").alias("many")))
    marks = rows.select(F.percentile_approx("length", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).first()[0] or []
    bounds = sorted(set(marks), reverse=True)
    bucket = F.aggregate(F.array(*[F.lit(float(b)) for b in bounds]), F.lit(0), lambda a, b: a + (F.col("length") < b).cast("int")) if bounds else F.lit(0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") * 1.2 / BLOCK)).cast("int")
    bucketed = rows.withColumn("bucket", bucket)
    sized = bucketed.join(F.broadcast(bucketed.groupBy("bucket").count().select("bucket", blocks.alias("blocks"))), "bucket")  # at most BUCKETS rows
    candidates = cut(_pack(sized.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")), ["bucket", "block"]))
    asked = rows.filter(is_query("vec_id"))
    n = asked.count()
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-n // QUERIES)))).cast("int"))
    queries = cut(_pack(asked, ["q_block"]))

    def floored(floors: DataFrame | None) -> DataFrame:
        """``queries`` with the floor of each, a product that k candidates reach."""
        if floors is None:
            every = queries.withColumn("floors", F.expr("unhex(repeat('000000000000F0FF', cast(octet_length(ids) / 8 as int)))"))  # minus infinity
            return every.withColumn("need", F.lit(float("-inf")))
        listed = floors.join(asked.select(F.col("vec_id").alias("query_id"), "q_block").distinct(), "query_id").groupBy("q_block").agg(F.collect_list(F.struct("query_id", "floor")).alias("f"))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, needs = [], []
                for ids, lengths, f in zip(*(batch.column(c).to_pylist() for c in ("ids", "lengths", "f"))):
                    known = {x["query_id"]: x["floor"] for x in f or ()}
                    mine, lengths = np.array([known.get(i, -np.inf) for i in np.frombuffer(ids, "<i8").tolist()], "<f8"), np.frombuffer(lengths, "<f8")
                    out.append(mine.tobytes())
                    # The least length that can reach a floor; a floor under zero needs none.
                    needs.append(float(np.where(mine > 0, mine / np.maximum(lengths, 1e-300), -np.inf).min()))
                yield batch.drop_columns(["f"]).append_column("floors", pa.array(out, pa.binary())).append_column("need", pa.array(needs, pa.float64()))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return queries.join(listed, "q_block", "left").mapInArrow(fill, f"{kinds}, floors binary, need double")

    first = (F.col("bucket") == 0) & (F.col("block") == 0)
    start = cut(_best(_meet(floored(None), candidates.filter(first), k), k))
    floors = start.groupBy("query_id").agg(F.sum("many").alias("n"), F.min("score").cast("double").alias("floor")).filter(F.col("n") >= k)
    rest = _meet(cut(floored(floors)), candidates.filter(~first), k)
    best = _best(start.select("query_id", "vec_id", "score", "many").union(rest), k)
    ranks = F.sequence((F.col("above") + 1).cast("int"), (F.col("above") + F.col("many")).cast("int"))
    return best.select("query_id", F.explode(ranks).alias("rank"), "vec_id", "score")
