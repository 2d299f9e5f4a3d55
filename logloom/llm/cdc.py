"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where its low bits are all zero, so that chunk borders depend on the
``WINDOW`` bytes before them and come back after an insertion. Chunks have ``LEAST`` to ``MOST`` bytes and are compared by a
128-bit digest. Of equal chunks the first stays, that with the smallest id, then the smallest start. Copies go where a run of
copied chunks has at least ``RUN`` bytes: a single short chunk that two texts share by chance is left alone.

Null texts count as empty and have no chunks. A null id sorts first. Removal never cuts a character in two: a span gives back
the bytes of a character that it would split. Repeated rows of an id and text are one text: they get the same result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free, steady

WINDOW, BITS, LEAST, MOST, RUN = 32, 5, 16, 128, 100

_SEED = 0x9E3779B9


def gear_table() -> np.ndarray:
    """A fixed random 32-bit number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), _SEED) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The gear hash h(i) = 2 h(i-1) + table[byte i] at every byte, by doubling the bytes that are summed."""
    h = table[data]
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def borders(data: bytes, table: np.ndarray) -> list[int]:
    """Where the chunks of a text end."""
    if not data:
        return []
    # The top bits of a gear hash take in the most bytes.
    h = gear_hashes(np.frombuffer(data, np.uint8), table)
    marks = (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()
    out, last, size = [], 0, len(data)
    for end in [*marks, size]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == size and end > last:
            out.append(end)
            last = end
    return out


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")


def chunks(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, key LONG, start INT, size INT, high LONG, low LONG): the chunks of each text and their digests."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digest = gear_table(), xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows, starts, sizes, digests = [], [], [], []
                for k, text in enumerate(batch.column(2).slice(at, 500)):
                    data = (text.as_py() or "").encode()
                    ends = borders(data, table)
                    begins = [0, *ends[:-1]] if ends else []
                    rows.extend([at + k] * len(ends))
                    starts.extend(begins)
                    sizes.extend([b - a for a, b in zip(begins, ends)])
                    digests.extend([digest(data[a:b]) for a, b in zip(begins, ends)])
                wide = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(wide[:, 0]), pa.array(wide[:, 1])], ["id", "key", "start", "size", "high", "low"])

    return docs.select(F.col(id_col).alias("id"), _key(id_col, text_col), text_col).mapInArrow(steady(run), f"id {kind}, key bigint, start int, size int, high bigint, low bigint")


def copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(key STRUCT<id, key LONG>, found ARRAY<STRUCT<start, size, copy>>): the chunks of each text that occur more than once.

    ``copy`` marks all but the first. Texts are told apart by their id and a hash of it and the text.
    """
    found = chunks(docs, text_col, id_col)
    firsts = found.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "start")).alias("first")).filter("n > 1")
    firsts = cut(firsts.select("high", "low", "first"))
    again = found.join(firsts, ["high", "low"]).select("id", "key", "start", "size", (F.struct("id", "key", "start") != F.col("first")).alias("copy"))
    grouped = again.groupBy("id", "key").agg(F.array_distinct(F.collect_list(F.struct("start", "size", "copy"))).alias("found"))
    return grouped.select(F.struct("id", "key").alias("key"), "found")


def _runs(pieces: list[tuple[int, int]], data: bytes) -> list[tuple[int, int]]:
    """Adjacent pieces put together, those of RUN bytes and more, drawn in to whole characters."""
    runs: list[list[int]] = []
    for a, b in sorted(pieces):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    out = []
    for a, b in runs:
        if b - a >= RUN:
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            out.append((a, b))
    return out


def dedupe(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept``, the text without its copied runs, ``spans``, the runs removed, and ``shared``, all runs with copies.

    Columns of those names are replaced; any others stay.
    """
    added = {"kept": T.StringType(), "spans": T.ArrayType(T.ArrayType(T.IntegerType())), "shared": T.ArrayType(T.ArrayType(T.IntegerType()))}
    names = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(*x) for x in added.items()])
    key_col, found_col = free("_key", names), free("_found", names)
    keyed = docs.select(*names, F.struct(F.col(id_col).alias("id"), _key(id_col, text_col)).alias(key_col))
    joined = keyed.join(copies(docs, text_col, id_col).withColumnsRenamed({"key": key_col, "found": found_col}), key_col, "left").drop(key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, shared = [], [], []
            for text, found in zip(batch.column(text_col), batch.column(found_col)):
                found = found.as_py()
                if not found:
                    kept.append(text.as_py())
                    spans.append([])
                    shared.append([])
                    continue
                data = text.as_py().encode()
                copied = _runs([(x["start"], x["start"] + x["size"]) for x in found if x["copy"]], data)
                at, parts = 0, []
                for a, b in copied:
                    parts.append(data[at:a])
                    at = b
                kept.append((b"".join(parts) + data[at:]).decode())
                spans.append(copied)
                shared.append(_runs([(x["start"], x["start"] + x["size"]) for x in found], data))
            pairs = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(kept, pa.string()), pa.array([[[*s] for s in x] for x in spans], pairs), pa.array([[[*s] for s in x] for x in shared], pairs)], schema.names)

    return joined.mapInArrow(steady(run), schema)
