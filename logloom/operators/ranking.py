"""Global ranks and running sums without putting all rows in one task."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut


def with_rank(df: DataFrame, *order: Column, rank: str = "rank", total: str | None = None, sums: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with the rank from 0 of each row in ``order``, the number of rows and running sums (of earlier rows and its own).

    Rows are range-partitioned once; each partition ranks its own rows, and only one row of totals per partition is
    added up to offsets. ``order`` must be unique for ranks that do not depend on the run.
    """
    sums = sums or {}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as a second run of the sampling behind a range partitioning could draw other borders.
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(inside))
    for new, old in sums.items():
        local = local.withColumn(new, F.sum(old).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(old), F.lit(0)).alias(f"_sum_{new}") for new, old in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"),
                            *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_off_{new}") for new in sums])
    joined = local.join(F.broadcast(offsets), "_part")
    out = joined.withColumn(rank, F.col("_local") + F.col("_before") - 1)
    for new in sums:
        out = out.withColumn(new, F.col(new) + F.col(f"_off_{new}"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_local", "_before", "_total", *[f"_off_{new}" for new in sums])


def quantiles(df: DataFrame, by: list[str], value: str, points: Sequence[float], parts: int | None = None) -> DataFrame:
    """``by``, n (values that are not null), low and high (the least and greatest), q and above: arrays with the exact quantile for
    each of ``points``, linear between ranks, and the value at the next rank from it on (for one half, the upper median).

    Values are counted first. Distinct ones are range-partitioned by group and value, so that a group of any size spreads over
    tasks; each task adds up its own counts, and one row per task and group carries the offset. Groups without a value have nulls;
    without ``by`` there is always one row.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = named.groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    ranged = cut(counted.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()))
    own = ranged.groupBy("_part", *keys).agg(F.sum("_n").alias("_own"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per task and group
    offsets = own.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"{k}o") for k in keys], before.alias("_before"), F.sum("_own").over(group).alias("_total"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}o"))
    inside = Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_end", F.sum("_n").over(inside)).join(offsets, same)
    end = F.col("_end") + F.col("_before")
    start, last = end - F.col("_n"), F.col("_total") - 1
    at = lambda rank: F.max(F.when((start <= rank) & (rank < end), F.col("_v")))
    found = [f(F.lit(float(p)) * last) for p in points for f in (F.floor, F.ceil)]
    ends = placed.groupBy(*keys).agg(F.coalesce(F.max("_total"), F.lit(0)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), *[at(r).alias(f"_q{i}") for i, r in enumerate(found)])
    q = []
    for i, p in enumerate(points):
        place, low, high = F.lit(float(p)) * (F.col("n") - 1), F.col(f"_q{2 * i}").cast("double"), F.col(f"_q{2 * i + 1}").cast("double")
        q.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return ends.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "low", "high", F.array(*q).alias("q"), F.array(*[F.col(f"_q{2 * i + 1}") for i in range(len(points))]).alias("above"))


class Scan:
    """Windows over groups of any size: rows are range-partitioned once by group and order, and a group may lie in many tasks.

    Each method adds columns. A task works on its own rows of a group, and one row for each task and group carries what the
    others must know: the last row, or the sum, least or greatest value of the tasks before it or behind it. Rows of equal order
    are in one task and count as one another's peers; ``lag`` takes them by ``ties``, or else in any order. Null groups are groups like others.
    """

    FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}

    def __init__(self, df: DataFrame, by: list[str], order: list[str], parts: int | None = None, ties: Sequence[str] = ()):
        self.by, self.order, self.ties = by, order, [*ties]
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Written, as a second run of the sampling behind a range partitioning could draw other borders.
        self.rows = cut(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))

    def _carry(self, carried: dict[str, Column], over: dict[str, Callable[[Column, WindowSpec], Column]]) -> DataFrame:
        """The rows with ``carried``, aggregates of each task's part of a group, as ``over`` takes them from the group's other parts."""
        keys = [f"_by{k}" for k in range(len(self.by))]
        own = self.rows.groupBy(F.col("_part").alias("_at"), *[F.col(c).alias(k) for c, k in zip(self.by, keys)]).agg(*[c.alias(n) for n, c in carried.items()])
        group = Window.partitionBy(*keys).orderBy("_at")  # a row for each task and group
        moved = own.select("_at", *keys, *[f(F.col(n), group).alias(n) for n, f in over.items()])
        same = F.col("_part") == F.col("_at")
        for c, k in zip(self.by, keys):
            same = same & F.col(c).eqNullSafe(F.col(k))
        return self.rows.join(moved, same).drop("_at", *keys)

    def _local(self) -> WindowSpec:
        return Window.partitionBy("_part", *self.by).orderBy(*self.order)

    def lag(self, **new: str) -> "Scan":
        """``new`` columns with the value of the row before it in its group, null in the first."""
        names = {f"_end_{n}": c for n, c in new.items()}
        last, local = F.struct(*self.order, *self.ties), Window.partitionBy("_part", *self.by).orderBy(*self.order, *self.ties)
        joined = self._carry({n: F.max_by(F.struct(c), last) for n, c in names.items()}, {n: lambda c, w: F.lag(c).over(w) for n in names})
        first = F.row_number().over(local) == 1
        self.rows = joined.withColumns({n: F.when(first, F.col(f"_end_{n}")[c]).otherwise(F.lag(c).over(local)) for n, c in new.items()}).drop(*names)
        return self

    def _accumulated(self, forward: bool, new: dict[str, tuple[str, str]]) -> "Scan":
        names = {f"_rest_{n}": f for n, f in new.items()}
        here = self._local().rangeBetween(*((Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)))
        rest = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
        joined = self._carry({n: self.FUNCTIONS[f](c) for n, (f, c) in names.items()}, {n: lambda c, w, f=f: self.FUNCTIONS[f](c).over(w.rowsBetween(*rest)) for n, (f, _) in names.items()})

        def both(name: str, how: str, col: str) -> Column:
            own, other = self.FUNCTIONS[how](col).over(here), F.col(f"_rest_{name}")
            if how == "sum":
                return F.when(own.isNull(), other).otherwise(own + F.coalesce(other, F.lit(0)))
            return (F.least if how == "min" else F.greatest)(own, other)

        self.rows = joined.withColumns({n: both(n, *f) for n, f in new.items()}).drop(*names)
        return self

    def running(self, **new: tuple[str, str]) -> "Scan":
        """``new`` columns with (function, column) over a row, its peers and all before them; functions are sum, min and max."""
        return self._accumulated(True, new)

    def later(self, **new: tuple[str, str]) -> "Scan":
        """``new`` columns with (function, column) over a row, its peers and all behind them."""
        return self._accumulated(False, new)

    def derive(self, **new: Column) -> "Scan":
        self.rows = self.rows.withColumns(new)
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_part")
