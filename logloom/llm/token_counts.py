"""Token counts that follow edits.

Each document keeps a segment tree over blocks of its pre-tokens (words); a node holds the characters and tokens below it. An
edit goes down the tree to the word where its context starts, three characters before the edit, which is as far as the
pre-tokenizer looks ahead. From there words are cut anew until a cut falls on an old one behind the edit; only these
words are encoded, and only the sums above their blocks change.

Trees travel as their leaves: two 32-bit integers a word, its characters and its tokens. Special tokens' strings count as
ordinary text. A null text counts as empty, and null edits as none. Positions outside the text are moved to its nearest end.
Null ids and repeated rows are rows like any others; no rows give no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _WORDS, Vocabulary, _Encoder, _schema, _with_column, slices
from .shared import steady

BLOCK = 32
#: Characters before an edit that its change can reach: a word looks at two characters after it at most.
CONTEXT = 3


class Tree:
    """Blocks of words with the sums of their characters and tokens above them."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.blocks = [(chars[k : k + BLOCK], tokens[k : k + BLOCK]) for k in range(0, len(chars), BLOCK)] or [([], [])]
        self.base = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (c, t) in enumerate(self.blocks, self.base):
            self.chars[k], self.tokens[k] = sum(c), sum(t)
        for k in range(self.base - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, at: int) -> tuple[int, int, int]:
        """The block, the place in it and the start of the word that holds character ``at``; behind the last, the end of the last block."""
        if at >= self.chars[1]:
            return len(self.blocks) - 1, len(self.blocks[-1][0]), self.chars[1]
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.base
        for k, size in enumerate(self.blocks[block][0]):
            if at < start + size:
                return block, k, start
            start += size
        raise AssertionError

    def replace(self, first: tuple[int, int], last: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """Put words in the place of those from ``first`` up to ``last``, each a block and a place in it."""
        (a, i), (b, j) = first, last
        for block in range(a, b + 1):
            c, t = self.blocks[block]
            low, high = (i if block == a else 0), (j if block == b else len(c))
            c[low:high], t[low:high] = (chars, tokens) if block == a else ([], [])
            node = block + self.base
            self.chars[node], self.tokens[node] = sum(c), sum(t)
            while node > 1:
                node //= 2
                self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaves(self) -> bytes:
        return np.array([[x for c, _ in self.blocks for x in c], [x for _, t in self.blocks for x in t]], "<u4").T.tobytes()


class _Counter:
    """Token counts of words by the trie encoder."""

    def __init__(self, vocab: Vocabulary):
        self.encoder = _Encoder(vocab, told=vocab.count_words)

    def counts(self, texts: list[list[str]]) -> list[list[int]]:
        every: set[str] = set()
        every.update(*texts)
        self.encoder.learn(every)
        many = self.encoder.young.__getitem__
        return [[*map(many, words)] for words in texts]

    def edit(self, text: str, tree: Tree, at: int, cut: int, put: str) -> tuple[str, int]:
        """The edited text and how many words were encoded anew; the tree follows."""
        at = min(max(at, 0), len(text))
        cut = min(max(cut, 0), len(text) - at)
        new, moved = text[:at] + put + text[at + cut :], len(put) - cut
        block, place, start = tree.find(max(0, at - CONTEXT))
        first, words = (block, place), []
        end, old = start, start  # in the new text; in the old one, of the words passed so far
        for m in _WORDS.finditer(new, start):
            if end >= at + len(put):
                while old < end - moved:
                    while place >= len(tree.blocks[block][0]):
                        block, place = block + 1, 0
                    old += tree.blocks[block][0][place]
                    place += 1
                if old == end - moved:
                    break
            words.append(m.group())
            end = m.end()
        else:
            block, place = len(tree.blocks) - 1, len(tree.blocks[-1][0])
        tree.replace(first, (block, place), [*map(len, words)], self.counts([words])[0])
        return new, len(words)


Batches = Iterator[pa.RecordBatch]
_BUILT = {"leaves": T.BinaryType(), "n_tokens": T.LongType()}
_EDITED = {"edited": T.StringType(), "leaves": T.BinaryType(), "n_tokens_before": T.LongType(), "n_tokens": T.LongType(), "n_words": T.LongType(), "n_reencoded": T.LongType()}


def _built(batches: Batches, counter: _Counter, text_col: str) -> Batches:
    for batch in batches:
        for part in slices(batch, text_col):
            words = [_WORDS.findall(t or "") for t in part.column(text_col).to_pylist()]
            counts = counter.counts(words)
            leaves = [np.array([[*map(len, w)], c], "<u4").T.tobytes() for w, c in zip(words, counts)]
            part = _with_column(part, "leaves", pa.array(leaves, pa.binary()))
            yield _with_column(part, "n_tokens", pa.array([*map(sum, counts)], pa.int64()))


def _edited(batches: Batches, counter: _Counter, text_col: str, edits_col: str) -> Batches:
    for batch in batches:
        out = {k: [] for k in _EDITED}
        for text, leaves, edits in zip(*(batch.column(c).to_pylist() for c in (text_col, "leaves", edits_col))):
            chars, tokens = np.frombuffer(leaves or b"", "<u4").reshape(-1, 2).T.tolist() or ([], [])
            tree, text, n = Tree(chars, tokens), text or "", 0
            before = tree.tokens[1]
            for e in edits or ():
                text, many = counter.edit(text, tree, e["at"] or 0, e["cut"] or 0, e["put"] or "")
                n += many
            for k, v in zip(_EDITED, (text, tree.leaves(), before, tree.tokens[1], sum(len(c) for c, _ in tree.blocks), n)):
                out[k].append(v)
        for k, kind in (("edited", pa.string()), ("leaves", pa.binary()), *((k, pa.int64()) for k in [*_EDITED][2:])):
            batch = _with_column(batch, k, pa.array(out[k], kind))
        yield batch


def _forgetting(batches: Batches, vocab: Vocabulary, names: list[str]) -> Batches:
    """The columns ``names`` of ``batches``; what ``vocab`` remembered goes with the task."""
    try:
        for batch in batches:
            yield batch.select(names)
    finally:
        vocab.forget()


def build(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``leaves``, the tree of each whole text, and n_tokens."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    schema = _schema(docs, **_BUILT)
    return docs.mapInArrow(steady(lambda batches: _forgetting(_built(batches, _Counter(vocab.value), text_col), vocab.value, schema.names)), schema)


def apply(built: DataFrame, tokenizer_path: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``built`` after its ``edits_col``, an ARRAY<STRUCT<at INT, cut INT, put STRING>> of edits one after the other.

    Each takes ``cut`` characters from ``at`` (from 0) out of the text as it then is and puts ``put`` there. Adds or replaces:
    edited, leaves, n_tokens_before, n_tokens, n_words and n_reencoded, how many words were encoded anew.
    """
    vocab = built.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    schema = _schema(built, **_EDITED)
    return built.mapInArrow(steady(lambda batches: _forgetting(_edited(batches, _Counter(vocab.value), text_col, edits_col), vocab.value, schema.names)), schema)


def build_and_apply(docs: DataFrame, tokenizer_path: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """What ``apply`` returns for what ``build`` returns, with one Python worker for both."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    schema = _schema(docs, **_EDITED)

    def run(batches: Batches) -> Batches:
        counter = _Counter(vocab.value)  # edits find the words of their texts in its memo
        return _forgetting(_edited(_built(batches, counter, text_col), counter, text_col, edits_col), vocab.value, schema.names)

    return docs.mapInArrow(steady(run), schema)


def with_edits(built: DataFrame, edits: DataFrame, id_col: str = "doc_id", order_col: str = "nth") -> DataFrame:
    """``built`` with the rows of ``edits`` (``id_col``, ``order_col``, at, cut, put) of its id gathered in ``edits``, which is added or replaced."""
    listed = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order_col, "at", "cut", "put"))).alias("e"))
    return built.drop("edits").join(listed.select(id_col, F.transform("e", lambda e: F.struct(e["at"].alias("at"), e["cut"].alias("cut"), e["put"].alias("put"))).alias("edits")), id_col, "left")
