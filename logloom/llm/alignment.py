"""Alignment of two tokenizers' tokens over a corpus, with inverted bitmaps of linked pairs.

Texts are encoded by a byte-level vocabulary (A, a space before the text) and a merge-type model (B, which adds that space). Tokens
of A and B are linked where their bytes overlap, and cut into groups at the bytes where tokens of both end.

Documents are numbered inside blocks. For each pair of ids that is linked in a block there are bitmaps of its documents, one for
each bit of how often they hold the link (multiplicity planes). The planes' union is the pair's document bitmap: its ones are the
pair's documents, and the ones of plane k count 2^k links each. A plane is a list of 16-bit places while that is shorter than
a bit for each place of the block. Slices of documents are merged into their block's planes inside the task; blocks
have other documents each, so that the ones of a pair's bitmap add up over blocks, in one aggregation of small numbers.
The counts then go back to the blocks that hold the pair, and its postings give every document its links' counts.

A block is bounded by documents and links, and no pair has more than one row a block, so no key grows with its frequency. What is
shuffled are planes once, and pair numbers. Broadcast are both vocabularies, a few MB of fixed size. What tasks find out about pairs of
tokens stays with them for the worker's next tasks, ``PAIRS`` and ``MOVES`` entries at most and a table of fixed size; words do not.

Texts that are null, empty, or that the tokens do not give back (B cannot tell U+2581 from a space) have no tokens and zeros. Null and repeated ids
are rows like others. An empty table gives no rows. Columns of the input that are named like new ones are refused.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import Vocabulary, _Encoder, _schema, _with_column, slices
from .pieces import Encoder, Pieces
from .shared import cut, steady

#: Documents of a block, whose places have so many bits, and links after which a block ends.
PLACE_BITS, BLOCK_LINKS = 13, 2_000_000
BLOCK = 1 << PLACE_BITS
ID_BITS = 20
#: Words in either half of an encoder's memo, and pairs of A's tokens and steps of its automaton that are remembered.
MEMO, PAIRS, MOVES = 200_000, 400_000, 400_000

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_INDEX = {"block": T.LongType(), "place": T.IntegerType(), **{c: T.LongType() for c in COUNTS}, "groups_sha256": T.StringType(),
          "pair": T.LongType(), "documents": T.LongType(), "links": T.LongType(), "planes": T.ArrayType(T.BinaryType())}


class Aligned:
    """The tokens of a slice of texts, behind one another, and what links them."""

    def __init__(self, a: list[bytes], b: list[bytes], size_a: np.ndarray, size_b: np.ndarray):
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (a, b))
        self.a, self.b = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])  # no token is empty, so both grow
        self.doc_a, self.doc_b = np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)
        ends_a, ends_b = np.zeros((2, 1 + int(end_a[-1]) if len(end_a) else 1), bool)
        ends_a[end_a], ends_b[end_b] = True, True
        closed = np.cumsum(ends_a & ends_b, dtype=np.int32)  # groups that end at a byte or before it
        self.group_a, self.group_b = (closed[e] - (ends_a & ends_b)[e] for e in (end_a, end_b))
        done = np.cumsum(ends_b, dtype=np.int32)  # tokens of B that end there
        first = done[end_a - size_a[self.a]].astype(np.int64)
        many = done[end_a - 1] - first + 1
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.link_a, self.link_b = np.repeat(np.arange(len(many)), many), np.repeat(first, many) + inside
        group_doc = np.zeros(int(closed[-1]), np.int64)
        group_doc[self.group_a] = self.doc_a
        count = lambda of: np.bincount(of, minlength=len(a))
        self.counts = n_a, n_b, count(group_doc), count(self.doc_a[self.link_a])

    def keys(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids with the place of their document, sorted, and how often they are linked there."""
        pair = self.a[self.link_a] << ID_BITS | self.b[self.link_b]
        return np.unique(pair << PLACE_BITS | places[self.doc_a[self.link_a]], return_counts=True)


def _sizes(ids: list[bytes], size: np.ndarray) -> np.ndarray:
    """The bytes of each text's tokens."""
    ends = np.append(0, np.cumsum(size[np.frombuffer(b"".join(ids), "<i4")]))
    stops = np.cumsum([len(x) // 4 for x in ids])
    return np.diff(ends[stops], prepend=0)


class Aligner:
    """Both encoders, and the decimal numbers of their ids with what may follow them."""

    def __init__(self, vocab: Vocabulary, pieces: Pieces):
        vocab.pairs_at_most, vocab.moves_at_most = PAIRS, MOVES
        self.encode_a, self.encode_b = _Encoder(vocab, MEMO), Encoder(pieces, MEMO, keep=True)
        self.encode_a.special, self.encode_a.le = None, {}  # special tokens' strings are plain text
        self.n_a, self.n_b = len(vocab.text), len(pieces.text)
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (vocab.text, pieces.text))
        self.numbers = [b"%d%c" % (k, c) for c in b",|" for k in range(len(vocab.text))] + [b"%d%c" % (k, c) for c in b",;" for k in range(len(pieces.text))]

    def align(self, texts: list[str | None]) -> Aligned:
        spaced = [" " + t if t else "" for t in texts]
        a, b = self.encode_a.encode(spaced), self.encode_b.encode([t or "" for t in texts])
        sizes = np.fromiter((len(t.encode()) for t in spaced), np.int64, len(spaced))
        # Tokens are stretches of the text, except that B spells a mark in it as a space, which is two bytes shorter.
        for k in np.flatnonzero((_sizes(a, self.size_a) != sizes) | (_sizes(b, self.size_b) != sizes)).tolist():
            a[k] = b[k] = b""
        return Aligned(a, b, self.size_a, self.size_b)

    def groups(self, x: Aligned) -> list[bytes]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (x.group_a, x.group_b))
        named = np.empty(len(x.a) + len(x.b), np.int64)  # tokens of A before those of B, group by group
        upto_a, upto_b = (np.append(0, np.cumsum(np.bincount(g))) for g in (x.group_a, x.group_b))  # tokens of the groups before each
        named[np.arange(len(x.a)) + upto_b[x.group_a]] = x.a + self.n_a * last_a
        named[np.arange(len(x.b)) + upto_a[x.group_b + 1]] = 2 * self.n_a + x.b + self.n_b * last_b
        out, at = [], 0
        for n in (x.counts[0] + x.counts[1]).tolist():
            out.append(b"".join(map(self.numbers.__getitem__, named[at : at + n].tolist()))[:-1])
            at += n
        return out


def packed(places: bytes) -> bytes:
    """Sorted 16-bit places as they are, or as a bitmap of the block where that is no longer."""
    if len(places) < BLOCK // 8:
        return places
    bits = np.zeros(BLOCK, bool)
    bits[np.frombuffer(places, "<u2")] = True
    return np.packbits(bits).tobytes()


def unpacked(plane: bytes) -> np.ndarray:
    return np.frombuffer(plane, "<u2") if len(plane) < BLOCK // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(plane, np.uint8)))


def _postings(found: list[tuple[np.ndarray, np.ndarray]], block: int) -> pa.RecordBatch:
    """A row for each pair of a block: its documents, links and planes."""
    keys, many = np.concatenate([k for k, _ in found]), np.concatenate([m for _, m in found])
    order = np.argsort(keys, kind="stable")
    keys, many = keys[order], many[order]
    pairs, of = np.unique(keys >> PLACE_BITS, return_inverse=True)
    deep = int(many.max()).bit_length()
    planes: list[list[bytes]] = [[] for _ in pairs]
    for k in range(deep):
        held = np.flatnonzero(many >> k & 1)
        places, stops = (keys[held] & BLOCK - 1).astype("<u2").tobytes(), 2 * np.cumsum(np.bincount(of[held], minlength=len(pairs)))
        at = 0
        for plane, stop in zip(planes, stops.tolist()):
            plane.append(packed(places[at:stop]))
            at = stop
    for plane in planes:
        while not plane[-1]:
            plane.pop()
    n = len(pairs)
    columns = {"block": pa.array(np.full(n, block)), "pair": pa.array(pairs), "documents": pa.array(np.bincount(of)), "links": pa.array(np.bincount(of, many).astype(np.int64)), "planes": pa.array(planes, pa.list_(pa.binary()))}
    return pa.RecordBatch.from_pydict(columns)


def groups(docs: DataFrame, tokenizer_path: str, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links and ``groups``: the ids of A and of B between common ends, ``a1,a2|b1;a3|b2,b3``."""
    added = {**{c: T.LongType() for c in COUNTS}, "groups": T.StringType()}
    schema = _schema(docs, **added)
    context = docs.sparkSession.sparkContext
    vocab, pieces = context.broadcast(Vocabulary(tokenizer_path)), context.broadcast(Pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocab.value, pieces.value)
        for batch in batches:
            for part in slices(batch, text_col):
                x = aligner.align(part.column(text_col).to_pylist())
                for c, v in zip(COUNTS, x.counts):
                    part = _with_column(part, c, pa.array(v.astype(np.int64)))
                yield _with_column(part, "groups", pa.array([g.decode() for g in aligner.groups(x)], pa.string())).select(schema.names)

    return docs.mapInArrow(steady(run), schema)


def index(docs: DataFrame, tokenizer_path: str, model_path: str, text_col: str = "text") -> DataFrame:
    """A written table of two kinds of rows, told apart by ``pair``: documents (null) and postings.

    Documents have ``docs``' columns but the text, their block and place, n_a, n_b, n_groups, n_links and groups_sha256. Postings have block, pair
    (an A id and a B id, ``ids`` takes them apart), documents, links, and planes, the bitmaps of places by bit of multiplicity.
    """
    kept = [f for f in docs.schema if f.name != text_col]
    if clash := {f.name for f in kept} & {*_INDEX}:
        raise ValueError(f"columns named like new ones: {sorted(clash)}")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField(*x) for x in _INDEX.items()])
    context = docs.sparkSession.sparkContext
    vocab, pieces = context.broadcast(Vocabulary(tokenizer_path)), context.broadcast(Pieces(model_path))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocab.value, pieces.value)
        block, place, links, found = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            for part in slices(batch, text_col):
                if place + part.num_rows > BLOCK or links > BLOCK_LINKS:
                    if links:
                        yield from filled(_postings(found, block))
                    block, place, links, found = block + 1, 0, 0, []
                x = aligner.align(part.column(text_col).to_pylist())
                n = part.num_rows
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in aligner.groups(x)]
                rows = dict(zip(names, map(part.column, names))) | {"block": pa.array(np.full(n, block)), "place": pa.array(np.arange(place, place + n, dtype=np.int32))}
                rows |= {c: pa.array(v.astype(np.int64)) for c, v in zip(COUNTS, x.counts)} | {"groups_sha256": pa.array(digests, pa.string())}
                yield from filled(pa.RecordBatch.from_pydict(rows))
                if len(x.a):
                    found.append(x.keys(np.arange(place, place + n)))
                place, links = place + n, links + int(x.counts[3].sum())
        if links:
            yield from filled(_postings(found, block))

    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def filled(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The rows with all columns of the table, in parts of 50,000."""
        have = {*rows.schema.names}
        full = pa.RecordBatch.from_arrays([rows.column(c) if c in have else pa.nulls(rows.num_rows, t) for c, t in types.items()], names=[*types])
        for k in range(0, full.num_rows, 50_000):
            yield full.slice(k, 50_000)

    return cut(docs.select(*names, text_col).mapInArrow(steady(run), schema))


def ids(pair="pair"):
    """A pair's id of A and id of B."""
    return F.shiftright(F.col(pair), ID_BITS).cast("long"), F.col(pair).bitwiseAND((1 << ID_BITS) - 1)


def pairs(indexed: DataFrame) -> DataFrame:
    """A row for each linked pair of ids: pair, a_id, b_id, documents that hold the link, links, and best: whether no other pair of the B id has more links."""
    a, b = ids()
    postings = indexed.filter("pair IS NOT NULL")
    counted = cut(postings.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")))
    named = counted.select("pair", a.alias("a_id"), b.alias("b_id"), "documents", "links")
    most = named.groupBy("b_id").agg(F.max("links").alias("most"))
    return named.join(most, "b_id").select("pair", "a_id", "b_id", "documents", "links", (F.col("links") == F.col("most")).alias("best"))


def scores(indexed: DataFrame, known: DataFrame) -> DataFrame:
    """The documents of ``indexed`` with n_best and count_sum: their links that are ``best`` in ``known``, and the sum of the links' counts."""
    columns = [f for f in indexed.schema if f.name not in ("block", "place", "pair", "documents", "links", "planes")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in columns] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    counts = known.select(F.col("pair").alias("_pair"), F.col("links").alias("_count"), F.col("best").alias("_best"))
    held = indexed.filter("pair IS NOT NULL").select(F.col("block").alias("_block"), F.col("pair").alias("_pair")).join(counts, "_pair")
    names = [f.name for f in columns]

    def score(rows: pa.Table, counts: pa.Table) -> pa.Table:
        """One block's documents, pairs and the pairs' counts."""
        where = rows.column("pair").is_valid()
        docs, postings = rows.filter(pc.invert(where)), rows.filter(where)
        pair, order = postings.column("pair").to_numpy(), counts.column("_pair").to_numpy()
        at = np.argsort(order, kind="stable")
        at = at[np.searchsorted(order[at], pair)]
        count, best = counts.column("_count").to_numpy()[at], counts.column("_best").to_numpy(zero_copy_only=False)[at]
        sums, bests = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
        for planes, n, is_best in zip(postings.column("planes").to_pylist(), count.tolist(), best.tolist()):
            for k, plane in enumerate(planes):
                places = unpacked(plane)
                sums[places] += n << k
                if is_best:
                    bests[places] += 1 << k
        place = docs.column("place").to_numpy()
        return docs.select(names).append_column("n_best", pa.array(bests[place])).append_column("count_sum", pa.array(sums[place]))

    return indexed.select(*names, "block", "place", "pair", "planes").groupBy("block").cogroup(held.groupBy("_block")).applyInArrow(score, schema)
