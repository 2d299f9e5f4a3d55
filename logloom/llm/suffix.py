"""Exact removal of repeated byte strings with suffix arrays by linear grouping.

Every string of ``width`` bytes owns an anchor, the leftmost of its ``GRAM``-byte pieces with the least hash. Equal strings own
equal anchors, so only strings whose anchor is found twice can repeat, and only with strings of the same anchor. Neighbouring
strings with one anchor form a context, a few hundred bytes. Equal contexts are counted and then handled once; where an anchor
has several contexts, a task gets them together and cuts them into phrases whose borders depend on few bytes around them.

The contexts' phrases are one sequence of numbers, whose suffix array is built by grouping (Baier, CPM 2016): suffixes start
out grouped by their first number; groups are taken in descending order, and previous-smaller pointers lead from the members to the
suffixes whose Lyndon prefix they extend, which form new groups right above their old ones. A last pass in ascending order puts each
suffix at the next free place of its group; nothing is renamed or sorted again. Neighbours in the array tell how far the
phrases at a place repeat, which proves most strings. Those that begin or end inside phrases are equal to others of the same
stretch of the array, where all suffixes share the string's whole phrases, if the bytes before and behind these are the same.

Anchors with more than ``GROUP`` contexts are split by the bytes around them: strings whose anchors stand in the same ``STEPS``
places also share the bytes that all of them cover, so that their key grows, up to the whole string, until groups are small.

A null text counts as empty; texts shorter than ``width`` have no strings. Matches never cross texts. Repeated rows repeat each other.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free, steady

WIDTH, GRAM, GROUP = 200, 32, 4000
STEPS = (42, 10, 1)
#: Bits of a position beside the hash in an anchor's order; longer texts are taken in overlapping pieces.
PLACE = 26
#: Phrases end where a hash of their last LOOK bytes has so many zero bits.
LOOK, PHRASE_BITS = 4, 4
BATCH_BYTES = 500_000

_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 9) for b in range(256)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _rolled(data: np.ndarray, reach: int) -> np.ndarray:
    """At each byte, a hash of the ``reach`` (a power of two) bytes that end there."""
    h, have = _TABLE[data], 1
    while have < reach:
        h[have:] += h[:-have] << np.uint64(have)
        have *= 2
    h ^= h >> np.uint64(32)
    h *= _ODD
    return h ^ (h >> np.uint64(29))


def contexts_of(data: bytes, width: int) -> list[tuple[int, int, int, int]]:
    """(start, strings, anchor's offset, anchor's hash) of each run of strings with one anchor."""
    out = []
    span = width - GRAM + 1
    for base in range(0, max(1, len(data) - width + 1), (1 << PLACE) - width):
        piece = np.frombuffer(data, np.uint8)[base : base + (1 << PLACE) - 1]
        if len(piece) < width:
            break
        hashes = _rolled(piece, GRAM)[GRAM - 1 :]
        place = np.uint64((1 << PLACE) - 1)
        least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        have = 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        at = (least & place).astype(np.int64)
        starts = np.concatenate([[0], 1 + np.flatnonzero(at[1:] != at[:-1])])
        sizes = np.diff(np.concatenate([starts, [len(at)]]))
        anchors = at[starts]
        out += zip((starts + base).tolist(), sizes.tolist(), (anchors - starts).tolist(), hashes[anchors].view(np.int64).tolist())
    return out


def suffix_array(s: list[int]) -> np.ndarray:
    """The suffixes of ``s`` in order. Its last number must be its least and appear once."""
    n = len(s)
    group, size, before, seen = [0] * n, [1] * n, [-1] * n, bytearray(n)  # size: of the Lyndon prefix so far
    members: list[list[int]] = []
    for k in np.argsort(np.array(s), kind="stable").tolist():
        if not members or s[members[-1][0]] != s[k]:
            members.append([])
        members[-1].append(k)
        group[k] = len(members) - 1
    lower, upper = [*range(-1, len(members) - 1)], [*range(1, len(members) + 1)]
    final, g = [], len(members) - 1
    while g >= 0:
        mine = [k for k in members[g] if group[k] == g]
        members[g] = mine
        if mine:
            final.append(g)
            for k in mine:
                seen[k] = 1
            extended: dict[int, int] = {}
            for k in mine:
                p = k - 1
                while p >= 0 and seen[p]:
                    p = before[p]
                before[k] = p
                if p >= 0:
                    extended[p] = extended.get(p, 0) + 1
            if extended:
                length = size[mine[0]]
                split: dict[tuple[int, int], list[int]] = {}
                for p, times in extended.items():
                    size[p] += times * length
                    split.setdefault((times, group[p]), []).append(p)
                for (_, old), moved in sorted(split.items(), key=lambda x: -x[0][0]) if len(split) > 1 else split.items():
                    new, above = len(members), upper[old]
                    members.append(moved)
                    lower.append(old)
                    upper.append(above)
                    lower[above], upper[old] = new, new
                    for p in moved:
                        group[p] = new
        g = lower[g]
    free, at = [0] * len(members), 0
    for g in reversed(final):
        free[g] = at
        at += len(members[g])
    behind, others = [-1] * (n + 1), [-1] * n  # the suffixes whose Lyndon prefix ends where another suffix starts
    for k in range(n):
        end = k + size[k]
        others[k], behind[end] = behind[end], k
    order = [-1] * n
    order[0] = n - 1
    for place in range(n):
        k = behind[order[place]]
        while k >= 0:
            g = group[k]
            order[free[g]] = k
            free[g] += 1
            k = others[k]
    return np.array(order)


def _shared_phrases(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and how many phrases neighbours in it share."""
    order = suffix_array(symbols.tolist())
    a, b = order[:-1], order[1:]
    same, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(alive):
        x, y = a[alive] + same[alive], b[alive] + same[alive]
        alive = alive[symbols[x] == symbols[y]]
        same[alive] += 1
    return order, same


def repeats(groups: np.ndarray, texts: list[bytes], many: np.ndarray, width: int) -> list[np.ndarray]:
    """For each context, which of its strings are found more than once among those of its group.

    ``groups``: numbers of the contexts' groups; ``many``: how often each context is found.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = _rolled(data, LOOK) >> np.uint64(64 - PHRASE_BITS) == 0
    natural = np.flatnonzero(cuts) + 1
    cuts[ends - 1] = True
    stops = np.flatnonzero(cuts) + 1
    firsts = np.concatenate([[0], stops[:-1]])
    text = np.searchsorted(ends, firsts, side="right")
    raw, seen = data.tobytes(), {}
    names = [seen.setdefault((g, raw[a:b]), len(seen)) for g, a, b in zip(groups[text].tolist(), firsts.tolist(), stops.tolist())]
    # A separator of its own closes each context; separators are less than all phrases, the last one the least.
    closes = np.flatnonzero(np.diff(np.concatenate([text, [len(texts)]]))) + 1
    symbols = np.insert(np.array(names) + len(texts), closes, len(texts) - 1 - np.arange(len(texts)))
    starts = np.insert(firsts, closes, ends)
    order, shared = _shared_phrases(symbols)
    far = np.zeros(len(symbols), np.int64)  # bytes of whole phrases from each phrase on that are found elsewhere as well
    for at in (order[:-1], order[1:]):
        np.maximum.at(far, at, starts[at + shared] - starts[at])
    windows = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(begins, ends)])
    owner = np.repeat(np.arange(len(texts)), sizes - width + 1)
    phrase = np.searchsorted(starts, windows, side="right") - 1  # the phrase that the string starts in
    sure = (far[phrase] >= windows + width - starts[phrase]) | (many > 1)[owner]
    # The borders that the string's own bytes make are in every string equal to it, and so are the phrases between them.
    bounded = np.concatenate([[-1], natural, [len(data) + 1]])
    first = bounded[np.searchsorted(bounded, windows + LOOK)]
    last = bounded[np.searchsorted(bounded, windows + width, side="right") - 1]
    inside = last > first
    whole = np.minimum(np.searchsorted(starts, first), len(starts) - 1)
    phrases = np.where(inside, np.searchsorted(starts, last) - whole, 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    stretch = -1 - groups[owner]  # without whole phrases the group is all that is known
    for n in np.unique(phrases[inside]).tolist():
        mine = np.flatnonzero(inside & (phrases == n))
        stretch[mine] = np.concatenate([[0], np.cumsum(shared < n)])[rank[whole[mine]]]
    head = np.where(inside, first - windows, 0)
    order = np.lexsort((head, stretch, phrases))
    new = np.concatenate([[True], (phrases[order][1:] != phrases[order][:-1]) | (stretch[order][1:] != stretch[order][:-1]) | (head[order][1:] != head[order][:-1])])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    asked = np.flatnonzero((np.bincount(kind) > 1)[kind] & (np.bincount(kind, ~sure) > 0)[kind])
    ahead = np.where(inside, first, windows + width)
    behind = np.where(inside, last, windows + width)
    before: dict[tuple[int, bytes, bytes], int] = {}
    for k, name, w, x, y in zip(asked.tolist(), kind[asked].tolist(), windows[asked].tolist(), ahead[asked].tolist(), behind[asked].tolist()):
        other = before.setdefault((name, raw[w:x], raw[y : w + width]), k)
        if other != k:
            sure[k] = sure[other] = True
    return np.split(sure, np.cumsum(sizes - width + 1)[:-1])


def _ranges(flags: np.ndarray) -> list[int]:
    """Runs of true values, as first, one behind the last, first, ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


_KEYS = ["gram", "high", "low"]


def _found(docs: DataFrame, width: int) -> DataFrame:
    """(key, start, strings INT, gram, high, low LONG): each context of each text, with its anchor's hash and its own digest."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows, found, digests = [], [], []
                for k, text in enumerate(batch.column(1).slice(at, 500)):
                    data = (text.as_py() or "").encode()
                    contexts = contexts_of(data, width) if len(data) >= width else []
                    rows.extend([at + k] * len(contexts))
                    found.extend(contexts)
                    # The offset tells equal bytes apart whose anchors differ in place.
                    digests.extend([digest(data[s : s + n + width - 1], off) for s, n, off, _ in contexts])
                wide = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                start, strings, _, gram = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int32()), pa.array(strings, pa.int32()), pa.array(gram, pa.int64()), pa.array(wide[:, 0]), pa.array(wide[:, 1])], ["key", "start", "strings", *_KEYS])

    return docs.select("key", "text").mapInArrow(steady(run), f"key {kind}, start int, strings int, gram bigint, high bigint, low bigint")


def _bytes(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(gram, high, low, many, data BINARY) of the contexts in ``wanted``, fetched from one text each."""
    listed = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "strings", *_KEYS, "many")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for text, wanted in zip(batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200).to_pylist()):
                    data = text.encode()
                    out += [(w["gram"], w["high"], w["low"], w["many"], data[w["start"] : w["start"] + w["strings"] + width - 1]) for w in wanted]
                if out:
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*_KEYS, "many", "data"])

    schema = "gram bigint, high bigint, low bigint, many bigint, data binary"
    return docs.join(listed, "key").select("text", "wanted").mapInArrow(steady(run), schema).dropDuplicates(_KEYS)


def _grouped(contexts: DataFrame, width: int) -> DataFrame:
    """(gram, high, low, ranges ARRAY<INT>): the repeated strings of each context, all contexts of an anchor in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            grams = np.array([r[0] for r in rows])
            flags = repeats(np.unique(grams, return_inverse=True)[1], [r[4] for r in rows], np.array([r[3] for r in rows]), width)
            return pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([*map(_ranges, flags)], pa.list_(pa.int32()))], [*_KEYS, "ranges"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH_BYTES and row[0] != held[-1][0]:  # rows come anchor by anchor
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(steady(run), "gram bigint, high bigint, low bigint, ranges array<int>")


def _split(contexts: DataFrame, width: int, step: int) -> DataFrame:
    """Parts of ``contexts`` whose anchors stand in the same ``step`` places: (gram, high, low, many, data, of STRUCT, at INT).

    The new gram stands for the bytes that all strings of such places cover; ``of`` names the context, ``at`` where the part begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, high, low, many, data in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "many", "data"))):
                ((_, strings, anchor, _),) = contexts_of(data, width)
                for x in range(0, width - GRAM + 1, step):  # places x .. x + step - 1
                    low_at, high_at = max(0, anchor - x - step + 1), min(strings, anchor - x + 1)
                    if low_at < high_at:
                        span = data[anchor - x : anchor - x - step + 1 + width]
                        key = xxhash.xxh3_64_intdigest(span, (gram + x) & ((1 << 64) - 1)) - (1 << 63)
                        part = data[low_at : high_at + width - 1]
                        wide = np.frombuffer(xxhash.xxh3_128_digest(part, anchor - low_at), ">i8").tolist()
                        out.append((key, *wide, many, part, {"gram": gram, "high": high, "low": low}, low_at))
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.struct([(k, pa.int64()) for k in _KEYS]), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], [*_KEYS, "many", "data", "of", "at"])

    return contexts.select(*_KEYS, "many", "data").mapInArrow(steady(run), "gram bigint, high bigint, low bigint, many bigint, data binary, of struct<gram: bigint, high: bigint, low: bigint>, at int")


def _solved(contexts: DataFrame, width: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(gram, high, low, ranges ARRAY<INT>): the repeated strings of each of the distinct ``contexts`` (gram, high, low, many, data)."""
    huge = cut(contexts.groupBy("gram").count().filter(F.col("count") > GROUP).select("gram"))
    if huge.isEmpty() or not steps:
        return _grouped(contexts, width)
    parts = cut(_split(contexts.join(huge, "gram", "left_semi"), width, steps[0]))
    distinct = cut(parts.groupBy(*_KEYS).agg(F.sum("many").alias("many"), F.first("data").alias("data")))
    found = cut(_solved(distinct, width, steps[1:]).filter(F.size("ranges") > 0))
    moved = parts.select(*_KEYS, "of", "at").join(found, _KEYS).select("of", F.transform("ranges", lambda r: r + F.col("at")).alias("ranges"))
    back = moved.groupBy("of").agg(F.flatten(F.collect_list("ranges")).alias("ranges")).select("of.*", "ranges")
    return _grouped(contexts.join(huge, "gram", "left_anti"), width).union(back)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, spans ARRAY<STRUCT<start, ranges>>) for ``docs`` (key, text): where its repeated strings start."""
    found = _found(docs, width)
    # Joins read written tables alone, so that Spark can split the rows of a hot key.
    twice = cut(found.groupBy("gram").count().filter("count > 1").select("gram"))
    found = cut(found.join(twice, "gram"))
    contexts = cut(found.groupBy(*_KEYS).agg(F.count("*").alias("many"), F.min(F.struct("key", "start", "strings")).alias("one")).select(*_KEYS, "many", "one.key", "one.start", "one.strings"))
    sizes = cut(contexts.groupBy("gram").agg(F.count("*").alias("contexts")))
    several = contexts.join(sizes.filter("contexts > 1").select("gram"), "gram", "left_semi")
    alone = contexts.join(sizes.filter("contexts = 1").select("gram"), "gram", "left_semi").select(*_KEYS, F.array(F.lit(0), F.col("strings")).alias("ranges"))
    solved = cut(_solved(cut(_bytes(docs, several, width)), width).filter(F.size("ranges") > 0).union(alone))
    spans = found.select("key", "start", *_KEYS).join(solved, _KEYS)
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "ranges")).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept`` BINARY, what remains of the text's UTF-8 bytes, and ``removed``, the spans taken out.

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else in any text. Columns of those names are replaced.
    """
    added = {"kept": T.BinaryType(), "removed": T.ArrayType(T.ArrayType(T.IntegerType()))}
    names = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(*x) for x in added.items()])
    key_col, spans_col = free("_key", names), free("_spans", names)
    keyed = docs.select(*names, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias(key_col))
    spans = repeated_spans(keyed.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")), width)
    joined = keyed.join(spans.withColumnsRenamed({"key": key_col, "spans": spans_col}), key_col, "left").drop(key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, spans in zip(batch.column(text_col), batch.column(spans_col)):
                data, runs = (text.as_py() or "").encode(), []
                pieces = sorted((x["start"] + a, x["start"] + b + width - 1) for x in spans.as_py() or () for a, b in zip(x["ranges"][::2], x["ranges"][1::2]))
                for a, b in pieces:
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                edges = [0, *[e for r in runs for e in r], len(data)]
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
                removed.append(runs)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.list_(pa.int32())))], schema.names)

    return joined.mapInArrow(steady(run), schema)
