"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

A merge-type model joins neighbouring symbols whose text together is a piece, the best score first and the leftmost of equals. Its
result is the one way to cut a text into pieces such that every two neighbours *fit*: merging their joined text anew gives just
these two. So no text is merged as a whole. An Aho-Corasick automaton of all pieces finds the longest piece at every place; from
left to right the longest piece that fits its predecessor is taken, then shorter ones, and where none fits the last piece is given
back and its end is marked in a bitfield as a place that no encoding passes. Each place is marked once, so the work is linear.

Where no piece of the model crosses the border between a character and the mark of a space, or between letters and other characters, texts
are cut into words there and each distinct word is encoded once for a task's memo; models with pieces across such borders are encoded text by text. Nothing is shuffled;
memory is bounded by the vocabulary, one slice of texts and memos of fixed size.

Models must have one mark before the text, keep white space, change no characters and have byte pieces; others are refused. Null
text counts as empty, and empty text has no ids but the end id. A control piece's string in a text is plain text. Repeated rows and
null ids are rows like others; an empty table stays empty; a column named like a new one is replaced, all others stay.
"""

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Batches, _schema, _with_column, slices
from .shared import steady

#: The mark of a space.
MARK = "▁"
#: What a model has to give back as it is.
PROBE = "  ﬁ ½  A\u030a x "
#: Words in either half of a task's memo, and the power of two of the pairs of pieces whose fit a task remembers.
MEMO_WORDS, PAIRS = 250_000, 20
#: Characters of words that are cut side by side: so many, and the word that goes beyond them.
SIDE = 400_000


def kind(char: str) -> str:
    return "mark" if char == MARK else "letter" if char.isalpha() else "other"


class Pieces:
    """A merge-type model's pieces, scores and ids; a few MB of fixed size, broadcast to the tasks.

    ``path`` is opened on the driver alone.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.decode(model.encode(PROBE)) != PROBE or not "".join(model.encode("x", out_type=str)).startswith(MARK):
            raise ValueError("the model changes characters or white space, or puts no mark before a text")
        size = range(model.get_piece_size())
        if any(model.is_unused(k) for k in size):
            raise ValueError("the model has unused pieces, which would have to be split again")
        self.byte_ids = [0] * 256
        self.control, self.scores, self.ids = set(), {}, {}
        self.text: list[bytes] = []
        for k in size:
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k):
                self.control.add(k)
                self.text.append(b"")
            elif model.is_unknown(k):
                self.text.append(model.decode([k]).encode())
            else:
                self.scores[piece], self.ids[piece] = model.get_score(k), k
                self.text.append(piece.replace(MARK, " ").encode())
        if not all(self.byte_ids):
            raise ValueError("the model has no byte pieces")
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.bytes_of = {k: b for b, k in enumerate(self.byte_ids)}
        # Texts fall apart where no piece goes on: before a mark that follows another character, and between letters and what is none.
        inside = {(kind(a), kind(b)) for p in self.ids for a, b in zip(p, p[1:])}
        apart = not {("letter", "mark"), ("other", "mark")} & inside
        letters = apart and not {("letter", "other"), ("other", "letter")} & inside
        numerals = "".join(sorted({c for p in self.ids for c in p if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha()}))
        letter = rf"[^\W\d_{numerals}]"  # of the characters in pieces just the letters; how others are sorted makes no difference
        self.words = (f"{MARK}*(?:{letter}+|(?:(?!{letter})[^{MARK}])+)|{MARK}+" if letters else f"{MARK}+[^{MARK}]*") if apart else "(?s:.+)"
        reached = {p for p in self.ids if self.merge(p) == [p]}
        for p in self.ids.keys() - reached:
            if model.encode(p.removeprefix(MARK), out_type=str) == [p]:
                raise ValueError(f"the model takes {p!r} whole, without merges")
        #: All units that a text can be cut into: the pieces that merges reach, and characters of pieces that are none.
        self.units = sorted(reached) + sorted({c for p in self.ids for c in p} - reached)
        self.number = {u: k for k, u in enumerate(self.units)}
        #: A character of no unit, put between words.
        self.between = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in self.number)
        #: For every unit, the number of the longest other one that begins it, or -1; characters of no unit have the last place.
        begins = lambda u: next((self.number[u[:n]] for n in range(len(u) - 1, 0, -1) if u[:n] in self.number), -1)
        self.shorter = np.array([*map(begins, self.units), -1], np.int32)
        self.lengths = np.array([*map(len, self.units), 1], np.int32)
        #: The table of pairs that the tasks of a worker share, once an encoder keeps it.
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def merge(self, text: str) -> list[str]:
        """``text`` merged step by step, as the model defines it; for pieces and pairs of them, whose length is bounded."""
        parts, scores = [*text], self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def automaton(self) -> ahocorasick.Automaton:
        """All units of two characters or more, with their numbers."""
        made = ahocorasick.Automaton()
        for unit, k in self.number.items():
            if len(unit) > 1:
                made.add_word(unit, k)
        made.make_automaton()
        return made


class Encoder:
    """Texts to ids, a slice at a time. The memo of words has a young and an old half; words that come back stay.

    With ``keep`` the table of pairs, 9 bytes each, stays with ``pieces`` for the worker's next tasks.
    """

    def __init__(self, pieces: Pieces, memo: int = MEMO_WORDS, keep: bool = False):
        self.pieces, self.automaton, self.memo = pieces, pieces.automaton(), memo
        self.other = len(pieces.units)  # any character that no unit has: it merges with nothing
        self.single = np.full(0x110000, self.other, np.int32)
        for unit, k in pieces.number.items():
            if len(unit) == 1:
                self.single[ord(unit)] = k
        #: The id of each unit that is a piece; characters that are none have no single id.
        self.first_id = np.array([pieces.ids.get(u, 0) for u in pieces.units] + [0], np.int32)
        self.n_ids = np.array([int(u in pieces.ids) for u in pieces.units] + [0], np.int64)
        self.keys, self.fitting = pieces.table or (np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool))
        if keep:
            pieces.table = self.keys, self.fitting
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words = re.compile(pieces.words)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of each two units gives just these two; a table of fixed size remembers pairs."""
        keys = left.astype(np.int64) << 32 | right
        slots = (keys ^ keys >> 29) * 2654435761 >> 13 & (1 << PAIRS) - 1
        out = self.fitting[slots]
        unknown = np.flatnonzero(self.keys[slots] != keys)
        if len(unknown):
            units, merge = self.pieces.units, self.pieces.merge
            new, back = np.unique(keys[unknown], return_inverse=True)
            pairs = zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())
            known = np.array([self.other in p or merge(units[p[0]] + units[p[1]]) == [units[p[0]], units[p[1]]] for p in pairs], bool)
            out[unknown] = known[back]
            self.keys[slots[unknown]], self.fitting[slots[unknown]] = keys[unknown], known[back]
        return out

    def _matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The number of the longest unit at every place, and the places that no unit crosses, which are ends of every encoding."""
        longest = self.single[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        stops, units = found[:, 0] + 1, found[:, 1]
        starts = stops - self.pieces.lengths[units]
        longest[starts] = units  # longer ones end later, and what comes later stays
        places = len(text) + 1
        crossing = np.cumsum(np.bincount(starts + 1, minlength=places + 1) - np.bincount(stops, minlength=places + 1))[:places]
        return longest, np.flatnonzero(crossing <= 0)

    def cut(self, words: list[str]) -> list[bytes]:
        """The ids of each word. All stretches that no unit crosses go their way at once, a step of one unit at a time.

        A step takes the unit at hand if it fits the one before it and its end is not marked, else tries the next shorter one; where
        none is left, the place is marked and the unit that ends there is given back.
        """
        text = self.pieces.between.join(words)
        longest, borders = self._matches(text)
        longest = np.append(longest, -1)
        failed = np.zeros(len(text) + 1, bool)  # the places that no encoding passes
        ending = np.full(len(text) + 1, self.other, np.int32)  # the unit taken that ends at a place
        lengths, shorter = self.pieces.lengths, self.pieces.shorter
        start, end = borders[:-1], borders[1:]
        at, unit = start.copy(), longest[start]
        while len(at):
            stop = at + lengths[unit]
            fits = ~failed[stop]
            inner = np.flatnonzero(fits & (at > start))
            fits[inner] = self.fits(ending[at[inner]], unit[inner])
            ending[stop[fits]] = unit[fits]
            at = np.where(fits, stop, at)
            unit = np.where(fits, longest[at], shorter[unit])
            going = at < end
            if not going.all():
                start, end, at, unit = start[going], end[going], at[going], unit[going]
            while len(stuck := np.flatnonzero(unit < 0)):
                failed[at[stuck]] = True
                last = ending[at[stuck]]
                at[stuck] -= lengths[last]
                unit[stuck] = shorter[last]
        return self._collected(words, text, ending)

    def _collected(self, words: list[str], text: str, ending: np.ndarray) -> list[bytes]:
        """The ids of each word: all stretches go back from their ends at once and mark the places where their units end."""
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, stops[:-1] + 1)
        taken, at, low = np.zeros(len(text) + 1, bool), stops, starts
        while len(at):
            taken[at] = True
            at = at - self.pieces.lengths[ending[at]]
            going = at > low
            at, low = at[going], low[going]
        ends = np.flatnonzero(taken)
        units = ending[ends]
        of = np.searchsorted(stops, ends)
        many = self.n_ids[units]
        spelled = np.flatnonzero(many != 1)  # characters that are no pieces
        ids = self.first_id[units]
        if len(spelled):
            codes = [[self.pieces.byte_ids[b] for b in text[k - 1].encode()] for k in ends[spelled].tolist()]
            many[spelled] = [*map(len, codes)]
            ids = np.repeat(ids, many)
            at = np.cumsum(many) - many
            for k, some in zip(at[spelled].tolist(), codes):
                ids[k : k + len(some)] = some
        sizes = 4 * np.cumsum(np.bincount(of, many, len(words)).astype(np.int64))
        raw, out, at = ids.astype("<i4").tobytes(), [], 0
        for stop in sizes.tolist():
            out.append(raw[at:stop])
            at = stop
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.young) + len(words) > self.memo:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        words = [w for w in words if w not in young]
        young.update([(w, old[w]) for w in words if w in old])
        words = sorted([w for w in words if w not in young], key=len)  # words of like length end at the same step
        part, size = [], 0
        for word in [*words, None]:
            if part and (word is None or size > SIDE):
                young.update(zip(part, self.cut(part)))
                part, size = [], 0
            if word is not None:
                part.append(word)
                size += len(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, without an end id."""
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*split))
        get = self.young.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _utf8(raw: bytes) -> str:
    """``raw`` as text; each byte that is part of no UTF-8 character becomes U+FFFD."""
    out, at = [], 0
    while True:
        try:
            return "".join([*out, raw[at:].decode()])
        except UnicodeDecodeError as wrong:
            out.append(raw[at : at + wrong.start].decode() + "\ufffd")
            at += wrong.start + 1


def decoded(ids: Iterable[int], pieces: Pieces) -> str:
    """The text of ``ids``: control pieces are nothing and end a run of byte pieces, one mark before the text goes."""
    ids = list(ids)
    if ids and ids[-1] in pieces.control:
        ids.pop()
    runs: list[list[int]] = [ids]
    if not pieces.control.isdisjoint(ids):
        runs = [[]]
        for k in ids:
            if k in pieces.control:
                runs.append([])
            else:
                runs[-1].append(k)
    raw = [b"".join(map(pieces.text.__getitem__, run)) for run in runs if run]
    first = next((run[0] for run in runs if run), None)
    if first is not None and first not in pieces.bytes_of and first != pieces.unknown:
        raw[0] = raw[0].removeprefix(b" ")
    return "".join(map(_utf8, raw))


def lists(ids: list[bytes], end: bytes = b"") -> pa.Array:
    """Ids in bytes as an array of lists of integers, each with ``end`` behind it."""
    sizes = np.fromiter((len(x) + len(end) for x in ids), np.int64, len(ids)) // 4
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join([x + end for x in ids]), "<i4")))


def _encoded(batches: Batches, pieces: Pieces, text_col: str, ids_col: str, with_end: bool) -> Batches:
    encoder, end = Encoder(pieces), pieces.end.to_bytes(4, "little") if with_end else b""
    for batch in batches:
        for part in slices(batch, text_col):
            ids = encoder.encode([t or "" for t in part.column(text_col).to_pylist()])
            yield _with_column(part, ids_col, lists(ids, end))


def texts_of(ids: pa.ListArray, pieces: Pieces) -> list[str]:
    """``decoded`` of every list, null or empty: "". The pieces' bytes are looked up for all lists at once; only lists that control pieces part
    go id by id."""
    sizes = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat, at = ids.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
    held = np.flatnonzero(sizes)
    last = np.zeros(len(flat), bool)
    last[at[held + 1] - 1] = True
    # A control piece is nothing, but one before the end parts two runs, each of which is decoded by itself.
    parted = np.zeros(len(sizes), bool)
    parted[np.searchsorted(at, np.flatnonzero(np.isin(flat, [*pieces.control]) & ~last), side="right") - 1] = True
    _, ends, raw = pa.array(pieces.text, pa.large_binary()).take(pa.array(flat)).buffers()
    ends, raw = np.frombuffer(ends, np.int64)[at].tolist() if len(flat) else [0] * len(at), memoryview(raw or b"")
    first = np.full(len(sizes), -1, np.int64)
    first[held] = flat[at[held]]
    marked = ~np.isin(first, [-1, pieces.unknown, *pieces.bytes_of])
    out = []
    for k, (some, mark) in enumerate(zip(parted.tolist(), marked.tolist())):
        text = bytes(raw[ends[k] : ends[k + 1]])
        out.append(decoded(flat[at[k] : at[k + 1]].tolist(), pieces) if some else _utf8(text.removeprefix(b" ") if mark else text))
    return out


def _decoded(batches: Batches, pieces: Pieces, ids_col: str, text_col: str) -> Batches:
    for batch in batches:
        yield _with_column(batch, text_col, pa.array(texts_of(batch.column(ids_col), pieces), pa.string()))


_IDS = T.ArrayType(T.IntegerType())


def _mapped(df: DataFrame, run, **added: T.DataType) -> DataFrame:
    schema = _schema(df, **added)

    def selected(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select(schema.names)

    return df.mapInArrow(steady(selected), schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", with_end: bool = True) -> DataFrame:
    """``docs`` with ``ids_col``: the ids of each whole text as an ARRAY<INT>, with the model's end id last unless told otherwise."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))
    return _mapped(docs, lambda batches: _encoded(batches, shared.value, text_col, ids_col, with_end), **{ids_col: _IDS})


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col``: the text of its ids. Null ids: empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model_path))
    return _mapped(encoded, lambda batches: _decoded(batches, shared.value, ids_col, text_col), **{text_col: T.StringType()})


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """What ``decode`` returns for what ``encode`` returns, with one Python worker for both."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches: Batches) -> Batches:
        return _decoded(_encoded(batches, shared.value, text_col, ids_col, True), shared.value, ids_col, decoded_col)

    return _mapped(docs, run, **{ids_col: _IDS, decoded_col: T.StringType()})


def decimal(ids_col: str = "ids"):
    """The ids as decimal numbers, one space between."""
    return F.array_join(F.col(ids_col).cast("array<string>"), " ")
