"""Near-duplicate groups by the exact Jaccard similarity of word shingles, among the candidates that SimHash links.

A text's shingles are a set of 64-bit hashes. ``simhash.similar_links`` proposes which sets may have a similarity of 4/5 or
more; inside each component of its candidates sets are compared, and only pairs of 4/5 or more become links. So no link is
wrong, and a pair just at 4/5 is missed with the chance that SimHash leaves it apart: ``simhash.LOST`` and twice ``simhash.FAR``
at most, less than 0.01, at every number of rows.

A component above ``BUCKET`` sets is dealt to parts, each with the same few pivots, drawn by a hash: what is linked inside its
part or to a pivot needs no other comparison. Only the sets that are left outside the component's largest group meet all others.

A null text counts as empty. Texts of fewer words than a shingle have one shingle; equal sets are joined once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import cut, steady
from .simhash import _Forest, components, shingles

#: Sets that one task compares, and pivots of a larger component.
BUCKET, PIVOTS = 1024, 64


def _prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 4/5 or more."""
    a, b = len(x), len(y)
    if 5 * min(a, b) < 4 * max(a, b):
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 5 * shared >= 4 * (a + b - shared)


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """The root of each set, after linking all pairs of similarity 4/5 or more.

    Two such sets share one of the first ``n - ceil(4 n / 5) + 1`` members of each, in any order that holds for all sets.
    """
    found, n, tested = _Forest(len(sets)), len(sets), set()
    sizes = np.fromiter(map(len, sets), np.int64, n)
    rows = np.repeat(np.arange(n), sizes)
    _, at, many = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    order = np.lexsort((at, many[at], rows))  # rarest of these sets first
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = order[place < np.repeat([_prefix(s) for s in sizes.tolist()], sizes)]
    key, row = at[kept], rows[kept]
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    while len(row):  # each turn compares the first set of every bucket with the others, then takes it out
        first = np.concatenate([[True], key[1:] != key[:-1]])
        bucket = np.cumsum(first) - 1
        pivot = row[first][bucket]
        for code in np.unique(pivot * n + row).tolist():
            a, b = divmod(code, n)
            if a != b and code not in tested and found.root[a] != found.root[b]:
                tested.add(code)
                if similar(sets[a], sets[b]):
                    found.merge(np.array([a]), np.array([b]))
        root = found.root[row]
        mixed = np.bincount(bucket, root != root[first][bucket]) > 0  # buckets of more than one component
        stay = ~first & mixed[bucket]
        key, row = key[stay], row[stay]
    return found.root


def _compared(dealt: DataFrame, words: int) -> DataFrame:
    """(u LONG, v LONG): links among the rows (root, part, node, text) of equal root and part, as a spanning forest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def out() -> pa.RecordBatch:
            names = np.array(list(held), np.int64)
            root = forest(list(held.values()))
            led = np.flatnonzero(root != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[led]), pa.array(names[root[led]])], ["u", "v"])

        for batch in batches:  # sorted by part
            for root, part, node, text in zip(*(batch.column(c) for c in ("root", "part", "node", "text"))):
                at = (root.as_py(), part.as_py())
                if at != key:
                    if len(held) > 1:
                        yield out()
                    key, held = at, {}
                if (name := node.as_py()) not in held:
                    held[name] = shingles(text.as_py(), words)
        if len(held) > 1:
            yield out()

    return dealt.repartition("root", "part").sortWithinPartitions("root", "part").mapInArrow(steady(run), "u bigint, v bigint").distinct()


def _draw(seed: int, below: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), below)


def links(rows: DataFrame, words: int) -> DataFrame:
    """(u LONG, v LONG): links among ``rows`` (root, node, text) of equal root that join all sets joined by similar pairs."""
    rows = rows.select("root", "node", "text")
    sizes = rows.groupBy("root").agg(F.count("*").alias("size"))
    hot = cut(sizes.filter(F.col("size") > BUCKET).select("root", "size", F.ceil(F.col("size") / BUCKET).alias("parts")))
    if hot.isEmpty():
        return _compared(rows.withColumn("part", F.lit(0).cast("bigint")), words)
    known = rows.join(hot, "root", "left").select("root", "node", "text", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("parts", F.lit(1)).cast("bigint").alias("parts"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    pivot = (F.col("parts") > 1) & (_draw(3, F.col("size")) < PIVOTS)
    dealt = known.withColumn("part", F.explode(F.when(pivot, every).otherwise(F.array(_draw(7, F.col("parts"))))))
    found = cut(_compared(dealt, words))
    joined = cut(rows.select("root", "node").join(hot, "root").join(components(found).withColumnRenamed("root", "sub"), "node", "left").select("root", "node", "parts", F.coalesce("sub", "node").alias("sub")))
    main = joined.groupBy("root", "sub").count().groupBy("root").agg(F.max_by("sub", F.struct("count", "sub")).alias("main"))
    rest = cut(joined.join(main, "root").filter("sub != main").select("root", "node", "parts"))
    if rest.isEmpty():
        return found
    blocks = rest.groupBy("root").agg(F.ceil(F.count("*") / BUCKET).alias("blocks"))
    parted = rows.join(hot.select("root", "parts"), "root").join(blocks, "root").join(rest.select("node", F.lit(1).alias("left")), "node", "left")
    cell = lambda block, part: block * F.col("parts") + part
    mine = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: cell(k, _draw(7, F.col("parts"))))
    asked = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda k: cell(_draw(5, F.col("blocks")), k))
    cells = F.when(F.col("left").isNull(), mine).otherwise(F.array_union(mine, asked))
    return found.union(_compared(parted.withColumn("part", F.explode(cells)).select("root", "part", "node", "text"), words))


def groups(docs: DataFrame, words: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, component_id): the smallest id that each row reaches by links of similarity 4/5 or more."""
    known = cut(simhash.wide_fingerprints(docs, words, text_col, id_col))
    least = cut(known.groupBy("node").agg(F.min(id_col).alias("least"), *[F.first(c).alias(c) for c in simhash.LANES]))
    maybe = components(simhash.similar_links(least))
    maybe = cut(maybe.union(maybe.select("root", "root").distinct()))
    asked = least.join(maybe, "node").select(F.col("least").alias(id_col), "node", "root")
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(asked, id_col).select("root", "node", "text")
    roots = components(links(cut(texts), words)).withColumnRenamed("root", "_root")
    rooted = least.join(roots, "node", "left").select("node", "least", F.coalesce("_root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.select(id_col, "node").join(rooted.join(smallest, "root").select("node", "component_id"), "node").select(id_col, "component_id")
