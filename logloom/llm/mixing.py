"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

A source's documents fall into blocks by a hash of their id, so that any order of blocks is a random order of documents. The
mix takes a source's blocks in a permuted order, a first time and, where its target is above its size, in another order a
second time, until its words reach the target. How many blocks each output shard gets of each source is drawn by a tree: its
root has the exact block quotas of all sources, and each node splits its quotas in two halves with the distribution of a
random deal (multivariate hypergeometric, one source after the other). Leaves are the shards. A source's permuted blocks then
go to the shards as their quotas say, disjointly, and each shard is shuffled by itself.

Only counts are gathered: blocks number at most ``BLOCKS`` and one more for each source, at every input size.

A null text has size 0 and is never taken. A null source is a source, the last one. Rows with equal id and size share their
fate. An empty table gives an empty mix. Columns of the input that bear a name of the output are replaced.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut

BLOCKS = 16_384
BLOCK_WORDS = 16_384
ALL = (1 << 63) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are ``marked``: the quantile ``u`` (over 0, under 1), within 12 deviations of the mode.

    Weights follow from one to the next by their ratio; what lies further out weighs less than a double can tell.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    reach = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), d * k / F.greatest(n, F.lit(1.0)) * (n - k) / F.greatest(n, F.lit(1.0)) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 12)
    low, high = F.greatest(F.lit(0).cast("bigint"), drawn + marked - total, mode - reach), F.least(drawn, marked, mode + reach)

    def after(w: Column, x: Column) -> Column:
        return w * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    def quantile(span: Column) -> Column:
        mass = F.aggregate(span, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), lambda a, x: F.struct(after(a["w"], x).alias("w"), (a["s"] + a["w"]).alias("s")))["s"]
        start = lambda: F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("x"))
        return _let(u * mass, lambda most: F.aggregate(span, start(), lambda a, x: F.struct(after(a["w"], x).alias("w"), (a["s"] + a["w"]).alias("s"), F.when(a["s"] < most, x).otherwise(a["x"]).alias("x")))["x"])

    return _let(F.sequence(low, F.greatest(low, high)), quantile)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard INT, quotas ARRAY<LONG>) from one row with ``quotas``: the leaves of the splitting tree. ``shards``: a power of two."""
    nodes, many = quotas.select(F.lit(0).alias("shard"), "quotas"), 1
    while many < shards:
        def draw(acc: Column, item: Column) -> Column:
            u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(many), F.col("shard"), item["i"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)  # noqa: B023
            x = hypergeometric(acc["total"], item["q"], acc["drawn"], u)
            return _let(x, lambda x: F.struct((acc["total"] - item["q"]).alias("total"), (acc["drawn"] - x).alias("drawn"), F.concat(acc["out"], F.array(x)).alias("out")))

        size = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, q: a + q)
        start = F.struct(size.alias("total"), F.floor(size / 2).alias("drawn"), F.array().cast("array<bigint>").alias("out"))
        left = F.aggregate(F.transform("quotas", lambda q, i: F.struct(i.alias("i"), q.alias("q"))), start, draw)["out"]
        halves = nodes.withColumn("left", left).select("shard", "left", F.zip_with("quotas", "left", lambda q, x: q - x).alias("right"))
        both = F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("quotas")), F.struct((2 * F.col("shard") + 1).alias("shard"), F.col("right").alias("quotas")))
        nodes, many = halves.select(F.inline(both)), 2 * many
        if many < shards:
            nodes = cut(nodes)  # else each level would draw all levels above anew
    return cut(nodes)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``rank`` (from 0, by code point, null last) and ``target``.

    A target is the level times the weight or ``most`` times the size, whichever is less; the level is where targets sum up to
    ``share`` of all sizes. It is the largest of the levels found by filling up sources one after the other, those with the
    least room for their weight first.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)).withColumn("room", most * F.col("source_size"))
    full = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("room").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    leveled = weighed.withColumn("before", before).withColumn("rest", rest).withColumn("all", F.sum("source_size").over(every))
    level = F.max((share * F.col("all") - F.col("before")) / F.col("rest")).over(every)
    return leveled.withColumn("target", F.least(F.col("room"), level * F.col("weight"))).select("source", "source_size", "rank", "target", "all")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 1, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", measured: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target, taken and ``draws``, an array of (shard, place) for each time the mix takes the row.

    ``measured``: the rows already have their size.
    """
    keep = [c for c in docs.columns if c not in ("source_size", "target", "taken", "draws", *(() if measured else ("size",)))]
    size = F.col("size") if measured else F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    # The input travels as one column, so that none of its names can meet those used here.
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    sized = docs.select(row, F.col(source_col).alias("source"), F.col(id_col).alias("id"), size)
    hashes = {"h": F.xxhash64("id", "size", F.lit(seed)), "h2": F.xxhash64("id", "size", F.lit(seed + 1))}
    facts = sized.withColumns(hashes).select("source", "size", "h", "h2")
    facts = cut(facts)
    plan = cut(targets(facts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(BLOCK_WORDS)), F.col("all") / BLOCKS))).cast("bigint")))
    blocked = facts.alias("f").join(plan.alias("p"), F.expr("f.source <=> p.source")).select("p.rank", F.pmod("h", "blocks").alias("block"), "size", "h2", "target")
    blocks = cut(blocked.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target")))

    turns = blocks.filter("words > 0").select("*", F.explode(F.array(*map(F.lit, range(int(-(-most // 1)))))).alias("turn"))
    order = Window.partitionBy("rank").orderBy("turn", F.xxhash64("rank", "block", "turn", F.lit(seed + 2)), "block")
    taken = turns.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"]).filter("before < target")
    taken = cut(taken.withColumn("nth", F.row_number().over(order) - 1).withColumn("rest", F.col("target") - F.col("before")))
    quotas = plan.join(taken.groupBy("rank").count(), "rank", "left").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("count", F.lit(0).cast("bigint")).alias("q")))).alias("r")).select(F.col("r.q").alias("quotas"))
    leaves = split_quotas(quotas, shards, seed).select("shard", F.posexplode("quotas").alias("rank", "q"))
    ends = leaves.withColumn("end", F.sum("q").over(Window.partitionBy("rank").orderBy("shard"))).groupBy("rank").agg(F.array_sort(F.collect_list("end")).alias("ends"))

    last = taken.filter("rest < words").select("rank", "block", "turn", "rest")
    within = Window.partitionBy("rank", "block", "turn").orderBy("h2", "size")
    upto = (blocked.select("rank", "block", "h2", "size").join(last, ["rank", "block"])
        .withColumn("sum", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rank", "block", "turn").agg(F.max(F.when(F.col("sum") - F.col("size") / 2 <= F.col("rest"), F.col("h2"))).alias("h")).select("rank", "block", "turn", F.coalesce("h", F.lit(-ALL - 1)).alias("upto")))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("nth")))
    dealt = taken.join(upto, ["rank", "block", "turn"], "left").join(ends, "rank").select("rank", "block", F.struct("turn", shard.alias("shard"), F.coalesce("upto", F.lit(ALL)).alias("upto")).alias("draw"))
    dealt = cut(dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list("draw")).alias("dealt")))

    placed = sized.withColumns(hashes).alias("d")
    placed = placed.join(plan.select("source", "rank", "source_size", "target", "blocks").alias("p"), F.expr("d.source <=> p.source")).select("d.row", "d.size", "d.h2", "p.rank", "p.source_size", "p.target", F.pmod("h", "blocks").alias("block"))
    drawn = placed.join(dealt, ["rank", "block"], "left")
    mine = F.transform(F.filter("dealt", lambda x: (F.col("h2") <= x["upto"]) & (F.col("size") > 0)), lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64("h2", x["turn"], F.lit(seed + 3)).alias("place")))
    out = drawn.withColumn("draws", F.coalesce(mine, F.array().cast("array<struct<shard:int,place:bigint>>")))
    return out.select("row.*", *(() if measured else ("size",)), "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def shards(mixed: DataFrame) -> DataFrame:
    """The rows of the mix itself, a row for each draw, dealt to their shards and shuffled inside each.

    Adds or replaces: shard, place.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("draws", "shard", "place")]).alias("row")
    rows = mixed.select(row, F.explode("draws").alias("draw")).repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place")
    return rows.select("row.*", "draw.shard", "draw.place")
