"""SimHash fingerprints and near-duplicate groups by a binary-trie self-join.

Fingerprints that differ in at most ``budget`` bits agree in one of ``budget + 1`` or more blocks of bits, so rows meet in
buckets of equal blocks. In each bucket the sorted fingerprints are a binary trie whose nodes are ranges. The join starts from
the pair (root, root) and takes pairs of nodes down together, bit by bit, adding up differing bits; a pair is dropped once
they exceed the budget, and two single fingerprints are compared at once. Links are merged inside the task, which returns a
spanning forest and never all pairs of a group. Buckets above ``BUCKET`` rows are salted into a grid of smaller ones, in which
any two rows still meet. Links then become components by alternating large and small stars.

For a similarity of shingle sets instead of a budget, ``similar_links`` takes 128 bits, of which a share of
``acos(2 s / (1 + s)) / pi`` differs at similarity s. No exact choice of buckets reaches that many bits, so buckets are equal
random bits instead, out of ``WIDTH``, in as many tables as leave a pair of similarity s apart with a chance of ``LOST``, at
every number of rows. The number of differing bits varies from pair to pair, so that chance is the mean over its binomial
distribution; more bits to draw from let it vary less and need fewer tables. The 64 and 128 bits compared in a bucket turn away
``FAR`` of such pairs each. Sets of fewer than some 20 shingles can differ in a larger share of bits than the formula says, and
are missed more often. Links are candidates, to be compared by their sets.

A null text counts as empty; texts without words have the fingerprint 0, which links like any other. Equal fingerprints are
joined once, whatever their number. A null id takes part; a component's id is its smallest id that is not null.
"""

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, steady

#: Rows of a bucket that one task joins; larger buckets are salted.
BUCKET = 4096
#: Mean rows of a bucket above which more and smaller blocks are taken.
DENSE = 1024
#: Node pairs that are taken down together, and rows whose buckets are joined together; they bound a task's memory.
FRONTIER, TOGETHER = 1 << 17, 100_000
#: The chances that a pair just at the similarity shares no bucket, and that it has too many differing bits for its bucket's test.
LOST, FAR = 0.007, 0.001
#: Rows of a bucket of random bits on average, and bits of the fingerprints that these are drawn from.
MEAN, WIDTH = 64, 512
#: The columns of a wide fingerprint, 64 bits each.
LANES = [f"f{k}" for k in range(WIDTH // 64)]
#: Rows whose equal buckets are linked before the shuffle.
LOCAL = 50_000


def _fingerprint(text: str | None, words: int) -> int:
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return 0
    joined, width = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Other hashes from hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def node_of(x: np.ndarray) -> int:
    """One signed number for a set of hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), 7)).view(np.int64))


def _majorities(hashes: np.ndarray) -> np.ndarray:
    """``WIDTH`` bits as signed numbers: each says what over half of the hashes have in a bit of one of their remixes."""
    bits = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 4096):
        lanes = [hashes[at : at + 4096]]
        while len(lanes) < len(LANES):
            lanes.append(_mixed(lanes[-1]))
        part = np.column_stack(lanes).astype("<u8").view(np.uint8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")


def wide_fingerprints(docs: DataFrame, words: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, node, ``LANES`` LONG): each text's set of shingles, hashed, and the bits of its SimHash over that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bits = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(LANES)), np.int64)
            for k, t in enumerate(batch.column(1)):
                x = shingles(t.as_py(), words)
                nodes[k], bits[k] = node_of(x), _majorities(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), *(pa.array(c) for c in bits.T.copy())], [id_col, "node", *LANES])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(steady(run), f"`{id_col}` {kind}, node bigint, " + ", ".join(f"{c} bigint" for c in LANES))


def fingerprints(docs: DataFrame, words: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, fp LONG): the 64-bit SimHash over shingles of ``words`` words, repeats included, of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(steady(run), f"`{id_col}` {kind}, fp bigint")


def _tables(n: int, budget: int) -> list[int]:
    """Masks of the bits that a bucket's rows agree in: ever more and smaller blocks, until buckets hold DENSE rows on average."""
    for blocks in range(budget + 1, 4 * budget + 1):
        agreed = blocks - budget
        if n >> (64 * agreed // blocks) <= DENSE:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, agreed)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Forest:
    """Roots of the rows 0..n-1 while links are merged in, many at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root] != root).any():
                root[up] = root[root[up]]


def trie_links(fps: np.ndarray, starts: np.ndarray, budget: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The root of each row, after linking rows of one bucket at most ``budget`` bits apart.

    ``fps``: unsigned, sorted inside buckets; ``starts``: where buckets begin, with the end; ``near``: what else decides on two
    rows within the budget. Pairs of nodes whose rows are all linked to each other already are not taken down.
    """
    forest = _Forest(len(fps))

    def meets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(fps[x] ^ fps[y]) <= budget
        return ok if near is None else ok & near(x, y)

    lo, hi = starts[:-1], starts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    # Most rows of a dense bucket are near its first.
    rows, first = np.concatenate([np.zeros(0, np.int64), *map(np.arange, lo, hi)]).astype(np.int64), np.repeat(lo, hi - lo)
    ok = meets(rows, first)
    forest.merge(rows[ok], first[ok])
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, a, az, b, bz, diff = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(bit, *(x[s] for x in (a, az, b, bz, diff))) for s in (slice(half), slice(half, None))]
            continue
        changes = np.concatenate([[0], np.cumsum(forest.root[1:] != forest.root[:-1])])
        apart = (changes[az - 1] != changes[a]) | (changes[bz - 1] != changes[b]) | (forest.root[a] != forest.root[b])
        a, az, b, bz, diff = (v[apart] for v in (a, az, b, bz, diff))
        leaf = (az - a == 1) & (bz - b == 1)
        if leaf.any():
            x, y = a[leaf], b[leaf]
            ok = (x != y) & meets(x, y)
            forest.merge(x[ok], y[ok])
            a, az, b, bz, diff = (v[~leaf] for v in (a, az, b, bz, diff))
        if not len(a):
            continue
        if bit < 0:  # equal fingerprints
            for x, xz, y, yz in zip(a, az, b, bz):
                rows = np.concatenate([np.arange(x, xz), np.arange(y, yz)])
                forest.merge(rows[1:], np.full(len(rows) - 1, rows[0]))
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        am, bm, same = az - (c[az] - c[a]), bz - (c[bz] - c[b]), a == b
        parts = [(a, am, b, bm, diff), (am, az, bm, bz, diff), (a, am, bm, bz, diff + 1), tuple(v[~same] for v in (am, az, b, bm, diff + 1))]
        kept = []
        for x, xz, y, yz, d in parts:
            ok = (xz > x) & (yz > y) & (d <= budget) & ~((x == y) & (xz - x == 1))
            kept.append([v[ok] for v in (x, xz, y, yz, d)])
        stack.append((bit - 1, *map(np.concatenate, zip(*kept))))
    return forest.root


def _whole_buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Rows that come sorted by their first ``keys`` columns, some ``TOGETHER`` at a time and never a bucket in two."""
    held, size = [], 0
    for batch in batches:
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        size += batch.num_rows
        if size > TOGETHER:
            table = np.concatenate(held)
            end = len(table) - np.argmax((table[::-1, :keys] != table[-1, :keys]).any(axis=1))
            held, size = [table], len(table)
            if end < len(table):
                yield table[:end]
                held, size = [table[end:]], len(table) - end
    if size:
        yield np.concatenate(held)


def links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """(u LONG, v LONG): links between distinct values of ``fps.fp`` at most ``budget`` bits apart, as a spanning forest of each bucket."""
    n = fps.count()
    masks = [_signed(m) for m in _tables(n, budget)]
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    hot = rows.groupBy("mask", "bits").count().filter(F.col("count") > BUCKET).select("mask", "bits", F.ceil(2 * F.col("count") / BUCKET).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("salts")).cast("int")
    pairs = F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: k != salt), lambda k: F.least(k, salt) * F.col("salts") + F.greatest(k, salt))
    )
    dealt = rows.join(hot, ["mask", "bits"], "left").withColumn("part", F.explode(pairs)).select("mask", "bits", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches, 3):
            keys, fp = table[:, :3], table[:, 3].view(np.uint64)
            order = np.lexsort((fp, keys[:, 2], keys[:, 1], keys[:, 0]))
            keys, fp = keys[order], fp[order]
            starts = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)), [len(fp)]])
            root = trie_links(fp, starts, budget)
            led = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (led, root[led])], ["u", "v"])

    found = dealt.repartition("mask", "bits", "part").sortWithinPartitions("mask", "bits", "part").mapInArrow(steady(run), "u bigint, v bigint")
    return found.distinct()


def _differing(bits: int, apart: float) -> np.ndarray:
    """The binomial chances of 0 to ``bits`` differing bits."""
    log_of = lambda k: math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(apart) + (bits - k) * math.log(1 - apart)
    return np.exp([log_of(k) for k in range(bits + 1)])


def _within(bits: int, apart: float) -> int:
    """How many of ``bits`` may differ, so that a chance of FAR at most is beyond."""
    return int(np.flatnonzero(1 - np.cumsum(_differing(bits, apart)) <= FAR)[0])


def _random_tables(n: int, apart: float) -> np.ndarray:
    """Places of WIDTH bits, a row for each table: two rows with a chance of ``apart`` for each bit agree in one table, save for a chance of LOST."""
    bits = max(8, math.ceil(math.log2(max(1, n) / MEAN)))
    differ = np.arange(WIDTH + 1)
    agree = np.prod([np.maximum(0, WIDTH - differ - j) / (WIDTH - j) for j in range(bits)], axis=0)  # in a table, by differing bits
    chance, tables = _differing(WIDTH, apart), 1
    while chance @ (1 - agree) ** tables > LOST:
        tables += 1
    rng, each = np.random.default_rng(1), WIDTH // bits
    turns = [rng.permutation(WIDTH)[: each * bits].reshape(each, bits) for _ in range(-(-tables // each))]
    return np.concatenate(turns)[:tables]


def _masks(tables: np.ndarray) -> np.ndarray:
    """The bits of each table as a mask for each lane."""
    masks = np.zeros((len(tables), len(LANES)), np.uint64)
    for mask, places in zip(masks, tables):
        np.bitwise_or.at(mask, places // 64, np.uint64(1) << (places % 64).astype(np.uint64))
    return masks


def similar_links(nodes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(u LONG, v LONG): links between the rows of ``nodes`` (node, ``LANES``) whose sets may have the Jaccard ``similarity``.

    Of rows that a task has linked before the shuffle, one stands for all in a bucket, so that no bucket grows with a group.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    masks = _masks(_random_tables(nodes.count(), apart))
    budget, both = _within(64, apart), _within(128, apart)
    names = ["key", "node", "a", "b", "u", "v"]

    def forest_rows(node: np.ndarray, root: np.ndarray) -> list[pa.Array]:
        led = np.flatnonzero(root != np.arange(len(node)))
        return [pa.array(node[led]), pa.array(node[root[led]])]

    def near(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a[x] ^ a[y]).astype(np.int16) + np.bitwise_count(b[x] ^ b[y]) <= both

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LOCAL):
                node, *lanes = (c.slice(at, LOCAL).to_numpy(zero_copy_only=False) for c in batch.columns)
                lanes = [c.view(np.uint64) for c in lanes]
                a, b = lanes[:2]
                forest = _Forest(len(node))
                for nth, mask in enumerate(masks):
                    key = np.full(len(node), nth + 1, np.uint64)
                    for lane, bits in zip(lanes, mask):
                        if bits:
                            key = _mixed(key ^ (lane & bits))
                    order = np.argsort(key, kind="stable")
                    sort = key[order]
                    new = np.concatenate([[True], sort[1:] != sort[:-1]])
                    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                    led = (first != order) & near(first, order, a, b)
                    forest.merge(order[led], first[led])
                    stay = order[~led]
                    none = pa.nulls(len(stay), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[stay].view(np.int64)) for x in (key, node, a, b)), none, none], names)
                u, v = forest_rows(node, forest.root)
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, u, v], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.column(0).null_count:
                    linked.append(batch.filter(batch.column(0).is_null()).select(["u", "v"]))
                yield batch.filter(batch.column(0).is_valid()).select(names[:4])

        for table in _whole_buckets(rows(), 1):
            key, node, a, b = table[:, 0], table[:, 1], table[:, 2].view(np.uint64), table[:, 3].view(np.uint64)
            order = np.lexsort((a, key))
            key, node, a, b = key[order], node[order], a[order], b[order]
            starts = np.concatenate([[0], 1 + np.flatnonzero(key[1:] != key[:-1]), [len(key)]])
            yield pa.RecordBatch.from_arrays(forest_rows(node, trie_links(a, starts, budget, lambda x, y: near(x, y, a, b))), ["u", "v"])
            while linked:
                yield linked.pop()
        yield from linked

    made = nodes.select("node", *LANES).mapInArrow(steady(spread), "key bigint, node bigint, a bigint, b bigint, u bigint, v bigint")
    return made.repartition(F.coalesce("key", "u")).sortWithinPartitions("key").mapInArrow(steady(join), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node LONG, root LONG): the smallest node that each node of ``edges`` (u, v) reaches, without the roots themselves."""
    # After Kiveris et al., Connected Components in MapReduce and Beyond, 2014.
    edges, before = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u != v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def groups(docs: DataFrame, words: int = 4, budget: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, fp LONG, component_id): each row's fingerprint and the smallest id that its fingerprint reaches by links."""
    fp = cut(fingerprints(docs, words, text_col, id_col))
    distinct = fp.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(distinct.select("fp"), budget))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
