"""Counts of words without their ids, and one memo for texts and their edits."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from logloom.llm import bpe, token_counts
from logloom.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(TOKENIZER)


def test_counts_are_those_of_ids(vocab):
    rng = random.Random(8)
    tokens = [t for t in vocab.text if t]
    words = {b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))) for _ in range(3000)} | {bytes(rng.randrange(256) for _ in range(rng.randint(1, 40))) for _ in range(500)}
    ids = vocab.encode_words(words)
    assert vocab.count_words(words) == {w: len(x) // 4 for w, x in ids.items()} and len(ids) == len(words)


@pytest.mark.parametrize("edges", [3, 20_000])
def test_fit_of_tokens_is_that_of_their_merged_bytes(vocab, monkeypatch, edges):
    """Also where the edges of few tokens are remembered at once."""
    monkeypatch.setattr(bpe, "EDGES", edges)
    vocab.forget()
    rng, known = random.Random(9), [*vocab.tokens.values()]
    for _ in range(3000):
        a, b = rng.choice(known), rng.choice(known)
        assert vocab.compatible(a, b) == (vocab._merge_all(vocab.text[a] + vocab.text[b]) == [a, b])
    assert len(vocab.edges) <= edges + 1


def test_words_are_walked_once_for_a_text_and_its_edits(vocab, monkeypatch):
    walked, walk = Counter(), bpe.Vocabulary._walk
    monkeypatch.setattr(bpe.Vocabulary, "_walk", lambda self, words: walked.update(words) or walk(self, words))
    text = "one qwxz two qwxz'three vbnm four"
    edits = [{"at": 8, "cut": 0, "put": " vbnm"}, {"at": 0, "cut": 1, "put": "O"}]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("cut", pa.int32()), ("put", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array([text, None]), pa.array([edits, None], kind)], ["text", "edits"])
    counter, encoder = token_counts._Counter(vocab), bpe._Encoder(vocab)
    out = pa.Table.from_batches([*token_counts._edited(token_counts._built(iter([batch]), counter, "text"), counter, "text", "edits")])
    for got, want in (("n_tokens_before", [text, ""]), ("n_tokens", ["One qwxz vbnm two qwxz'three vbnm four", ""])):
        assert out[got].to_pylist() == [len(x) // 4 for x in encoder.encode(want)]
    seen = Counter(w for w, n in walked.items() for _ in range(n))
    assert seen[b" qwxz"] == 1 + 1 and seen[b" vbnm"] == 1 + 1  # by the counter, and by the encoder that it is held against
