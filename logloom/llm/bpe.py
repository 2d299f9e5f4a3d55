"""Byte-pair encoding and decoding by a prefix-sharing trie.

The distinct words (pre-tokens) of a task form a trie, held as their sorted list. A depth-first walk keeps, for every prefix, the last token of its
encoding: the one vocabulary token that ends the prefix and is compatible with the last token of what stands before it. Two
neighbouring tokens are compatible if merging their bytes never crosses the border between them. So a prefix that many words
share is encoded once, and a word's ids follow by walking its last tokens back. Documents are then put together from their
words. Nothing is shuffled; memory is bounded by the vocabulary, one Arrow batch and a memo of fixed size.

Null text counts as empty, and empty text has no ids. The special token's string in a text becomes its single id.
"""

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import steady

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words in either half of a task's memo.
MEMO_WORDS = 100_000
#: Pairs of tokens whose compatibility a task remembers, and steps of the automaton; the id of a token has 20 bits at most.
PAIRS, MOVES = 150_000, 150_000
#: Tokens whose edges a task remembers, on either side.
EDGES = 20_000
#: Texts that are encoded together: so many, or so many bytes and the text that goes beyond them.
TOGETHER, BYTES = 500, 2_000_000


@dataclass(frozen=True)
class Limits:
    """What a task holds at most: words of a half of its memo, pairs, steps, and texts and bytes that are encoded together."""

    memo: int = MEMO_WORDS
    pairs: int = PAIRS
    moves: int = MOVES
    rows: int = TOGETHER
    most: int = BYTES


#: For a worker that has run other stages before, as the pipeline's has.
SMALL = Limits(MEMO_WORDS // 2, PAIRS // 2, MOVES // 2, TOGETHER // 2, BYTES // 2)


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary; a few MB of fixed size, broadcast to the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {s: bytes(chars[c] for c in s) for s in model["vocab"]}
        self.text = [b""] * (1 + max([*model["vocab"].values(), *self.specials.values()]))
        for s, k in model["vocab"].items():
            self.text[k] = raw[s]
        for s, k in self.specials.items():
            self.text[k] = s.encode()
        self.single = {raw[s]: k for s, k in model["vocab"].items() if len(raw[s]) == 1}
        self.merges, self.made = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pair, new = (model["vocab"][a], model["vocab"][b]), model["vocab"][a + b]
            self.merges.setdefault(pair, rank)
            self.made.setdefault(new, (rank, *pair))
        self.ranked = {rank: k for k, (rank, _, _) in self.made.items()}
        self.tokens = {t: k for t, k in self.single.items()}
        for k in sorted(self.made, key=lambda k: self.made[k][0]):
            if self._merge_all(self.text[k]) == [k]:  # else no text is ever encoded as k
                self.tokens[self.text[k]] = k
        self.size, self.le = [*map(len, self.text)], [k.to_bytes(4, "little") for k in range(len(self.text))]
        self.pairs_at_most, self.moves_at_most = PAIRS, MOVES
        self.pairs: dict[int, bool] = {}
        self.moves: dict[int, int] = {}
        self.edges: dict[int, list[tuple[int, float]]] = {}
        self._automaton()

    def __getstate__(self):
        return self.__dict__ | {"pairs": {}, "moves": {}, "edges": {}}

    def forget(self) -> None:
        """Drops what was remembered, at the end of a task: the vocabulary itself outlives it in the worker."""
        self.pairs, self.moves, self.edges = {}, {}, {}

    def _edges(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge while ``token`` is being merged, each with the rank of the merge that ends it."""
        key = token << 2 | side
        if (known := self.edges.get(key)) is not None:
            return known
        out, until, made = [(token, float("inf"))], 0, self.made
        while token in made:
            until, token = made[token][0], made[token][side]
            out.append((token, until))
        if len(self.edges) > EDGES:
            self.edges.clear()
        self.edges[key] = out
        return out

    def _merge_all(self, word: bytes) -> list[int]:
        ids, ranked = [self.single[bytes([b])] for b in word], self.ranked
        while len(ids) > 1:
            rank, at = min((self.merges.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [ranked[rank]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` leaves just these two: no merge fits across the border at its time."""
        known = not self._crossed(a, b)
        if len(self.pairs) > self.pairs_at_most:
            self.pairs.clear()
        self.pairs[a << 20 | b] = known
        return known

    def _crossed(self, a: int, b: int) -> bool:
        get, lefts = self.merges.get, self._edges(b, 1)
        for x, x_until in self._edges(a, 2):
            for y, y_until in lefts:
                rank = get((x, y))
                # At equal rank the leftmost merge comes first: one inside a before, one inside b after.
                if rank is not None and rank < x_until and rank <= y_until:
                    return True
        return False

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Each word's ids, as little-endian 32-bit integers."""
        size, le, out = self.size, self.le, {}
        for word, last, _ in self._walk(words):
            ids, depth = [], len(word)
            while depth:
                token = last[depth]
                ids.append(le[token])
                depth -= size[token]
            out[word] = b"".join(ids[::-1])
        return out

    def count_words(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """How many ids each word has: prefixes carry their numbers, so that no word is walked back."""
        return {word: many[len(word)] for word, _, many in self._walk(words)}

    def _walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Each word with the last token and the number of tokens of all its prefixes, in lists that the next word changes."""
        moves, ends, pairs, compatible = self.moves, self.ends, self.pairs, self.compatible
        if len(moves) > self.moves_at_most:
            moves.clear()
        deep = 1 + max(map(len, words), default=0)
        last, many, states, path = [0] * deep, [0] * deep, [0] * deep, b""  # of every prefix of the path
        for word in sorted(words):  # the order in which a depth-first walk of the trie meets its words
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            state, depth = states[shared], shared
            for b in word[shared:] if shared else word:
                depth += 1
                key = state << 8 | b
                state = moves.get(key)
                if state is None:
                    state = moves[key] = self._move(key >> 8, b)
                states[depth] = state
                for token, start in ends[state]:  # the tokens that end here, the longest first
                    start += depth
                    if start:
                        fits = pairs.get(last[start] << 20 | token)
                        if fits is None:
                            fits = compatible(last[start], token)
                        if not fits:
                            continue
                    last[depth] = token
                    many[depth] = many[start] + 1
                    break
            path = word
            yield word, last, many

    def _move(self, state: int, byte: int) -> int:
        """Where ``byte`` leads in the automaton of all tokens: to the longest suffix read that begins a token."""
        while (to := self.steps.get(state << 8 | byte)) is None and state:
            state = self.fails[state]
        return to or 0

    def _automaton(self) -> None:
        steps, ends = {}, [()]
        for text, token in self.tokens.items():
            state = 0
            for b in text:
                to = steps.setdefault(state << 8 | b, len(ends))
                if to == len(ends):
                    ends.append(())
                state = to
            ends[state] = ((token, -len(text)),)
        self.steps, self.fails, self.ends = steps, [0] * len(ends), ends
        children: dict[int, list[int]] = {}
        for key in steps:
            children.setdefault(key >> 8, []).append(key & 255)
        level = [0]
        while level:
            below = []
            for state in level:
                for b in children.get(state, ()):
                    to = steps[state << 8 | b]
                    self.fails[to] = self._move(self.fails[state], b) if state else 0
                    ends[to] += ends[self.fails[to]]
                    below.append(to)
            level = below


_WORDS = regex.compile(PATTERN)

class _Encoder:
    """Texts to ids, a batch at a time. The memo of words has a young and an old half; words that come back stay.

    With ``told``, ``vocab.count_words``, the memo holds that of each word instead of its ids.
    """

    def __init__(self, vocab: Vocabulary, memo: int = MEMO_WORDS, told: Callable[[Iterable[bytes]], dict] | None = None):
        self.vocab, self.memo, self.told = vocab, memo, told or vocab.encode_words
        self.young: dict = {}
        self.old: dict = {}
        names = "|".join(regex.escape(s) for s in sorted(vocab.specials, key=len, reverse=True))
        self.special = regex.compile(f"({names})") if names else None
        self.le = {s: vocab.le[k] for s, k in vocab.specials.items()}

    def learn(self, words: set[str]) -> None:
        if len(self.young) + len(words) > self.memo:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        if not (words := words.difference(young)):
            return
        back = [w for w in words if w in old]
        young.update([(w, old[w]) for w in back])
        told = self.told([w.encode() for w in words.difference(back)])
        young.update([(raw.decode(), x) for raw, x in told.items()])

    def encode(self, texts: list[str]) -> list[bytes]:
        parts, every = [], set()
        for text in texts:
            pieces = self.special.split(text) if self.special and any(s in text for s in self.le) else [text]
            parts.append([p if p in self.le else _WORDS.findall(p) for p in pieces])
            every.update(*[p for p in parts[-1] if not isinstance(p, str)])
        self.learn(every)
        get = self.young.__getitem__
        return [b"".join([self.le[p] if isinstance(p, str) else b"".join(map(get, p)) for p in ps]) for ps in parts]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = batch.schema.names
    if name in names:
        return batch.set_column(names.index(name), name, values)
    return batch.append_column(name, values)


Batches = Iterator[pa.RecordBatch]


def slices(batch: pa.RecordBatch, text_col: str, rows: int = TOGETHER, most: int = BYTES) -> Batches:
    """The batch in parts of at most ``rows`` rows and about ``most`` bytes of text."""
    sizes = np.fromiter((len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(text_col)), np.int64, batch.num_rows)
    at, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        size += n
        if k + 1 - at == rows or size > most:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _encoded(batches: Batches, vocab: Vocabulary, text_col: str, ids_col: str, limits: Limits = Limits()) -> Batches:
    vocab.pairs_at_most, vocab.moves_at_most = limits.pairs, limits.moves
    encoder = _Encoder(vocab, limits.memo)
    try:
        for batch in batches:
            for part in slices(batch, text_col, limits.rows, limits.most):
                ids = encoder.encode([t or "" for t in part.column(text_col).to_pylist()])
                yield _with_column(part, ids_col, pa.array(ids, pa.binary()))
    finally:
        vocab.forget()


def _texts(ids: pa.Array, tokens: list[bytes]) -> list[str]:
    token = tokens.__getitem__
    return [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in ids.to_pylist()]


def _decoded(batches: Batches, tokens: list[bytes], ids_col: str, text_col: str) -> Batches:
    for batch in batches:
        yield _with_column(batch, text_col, pa.array(_texts(batch.column(ids_col), tokens), pa.string()))


def _schema(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in added] + [T.StructField(*x) for x in added.items()])


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the ids of each whole text as a BINARY of little-endian unsigned 32-bit integers.

    A column of that name is replaced; others stay.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    schema = _schema(docs, **{ids_col: T.BinaryType()})
    return docs.mapInArrow(steady(lambda batches: (b.select(schema.names) for b in _encoded(batches, vocab.value, text_col, ids_col))), schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col``: its ids as text, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    tokens = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path).text)
    schema = _schema(encoded, **{text_col: T.StringType()})
    return encoded.mapInArrow(steady(lambda batches: (b.select(schema.names) for b in _decoded(batches, tokens.value, ids_col, text_col))), schema)


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """What ``decode`` returns for what ``encode`` returns, with one Python worker for both."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    schema = _schema(docs, **{ids_col: T.BinaryType(), decoded_col: T.StringType()})

    def run(batches: Batches) -> Batches:
        encoded = _encoded(batches, vocab.value, text_col, ids_col)
        for batch in _decoded(encoded, vocab.value.text, ids_col, decoded_col):
            yield batch.select(schema.names)

    return docs.mapInArrow(steady(run), schema)


def checked(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """What ``encode`` returns, without the text, and whether ``decode`` gives it back: the decoded text never leaves the worker."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    schema = _schema(docs.drop(text_col), **{ids_col: T.BinaryType(), same_col: T.BooleanType()})

    def run(batches: Batches) -> Batches:
        for batch in _encoded(batches, vocab.value, text_col, ids_col, SMALL):
            same = [x == (t or "") for x, t in zip(_texts(batch.column(ids_col), vocab.value.text), batch.column(text_col).to_pylist())]
            yield _with_column(batch, same_col, pa.array(same, pa.bool_())).select(schema.names)

    return docs.mapInArrow(steady(run), schema)


def n_tokens(ids_col: str = "ids"):
    return (F.octet_length(F.col(ids_col)) / 4).cast("long")
