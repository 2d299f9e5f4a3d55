"""Merge-type encoding by backtracking against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from logloom.llm import pieces
from logloom.llm.queries import PIECES


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECES)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PIECES)


def drawn(model, rng, kind):
    if kind == 0:
        return "".join(rng.choice("ab  \t\n.,the▁é😀中\x00") for _ in range(rng.randint(0, 60)))
    if kind == 1:
        return "".join(rng.choice(model.units) for _ in range(rng.randint(1, 8))).replace("▁", " ")
    if kind == 2:
        return "".join(rng.choice("aeinst") for _ in range(rng.randint(1, 80)))
    return "".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 767), rng.randint(0x4E00, 0x4FFF), rng.randint(0x1F600, 0x1F640)])) for _ in range(rng.randint(1, 20)))


def test_drawn_texts(model, library):
    """Texts that share units, words and marks, encoded one by one and together, at two widths of the step."""
    rng = random.Random(5)
    texts = [drawn(model, rng, k % 4) for k in range(4000)] + ["", " ", "   ", "a" * 3000, " " * 3001, "<s>x</s>", "<0x41>", "▁", "\r\n\t"]
    want = library.encode(texts)
    encoder = pieces.Encoder(model)
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == want
    fresh = pieces.Encoder(model)
    for text, ids in zip(texts[:400] + texts[-9:], want[:400] + want[-9:]):
        got = np.frombuffer(fresh.encode([text])[0], "<i4").tolist()
        assert got == ids and pieces.decoded(got, model) == library.decode(ids) == text.replace("▁", " ")


def test_decode_any_ids(model, library):
    rng = random.Random(6)
    ids = [0, 1, 2, 3, 131, 200, 229, 259, 264, 28705, 28713]
    for _ in range(3000):
        some = [rng.choice(ids) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 7))]
        assert pieces.decoded(some, model) == library.decode(some), some


def test_decode_lists_together(model, library, monkeypatch):
    """Lists are decoded together as they are one by one; those that no control piece parts are not taken apart."""
    rng, slow, one = random.Random(7), [], pieces.decoded
    ids = [0, 1, 2, 3, 131, 200, 229, 259, 264, 28705, 28713]
    some = [[rng.choice(ids) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 7))] for _ in range(2000)]
    some += [[2], [2, 2], [1, 2], [259, 2], [28705, 28705, 2], [229, 2], [0, 2]]
    plain = [library.encode(drawn(model, rng, k % 4), add_eos=True) for k in range(400)]
    monkeypatch.setattr(pieces, "decoded", lambda x, p: slow.append(x) or one(x, p))
    lists = [None, [], *some, *plain, None]
    got = pieces.texts_of(pa.array(lists, pa.list_(pa.int32())), model)
    assert got == ["" if x is None else library.decode(x) for x in lists]
    assert slow and not [x for x in slow if not model.control & {*x[:-1]}]
    assert pieces.texts_of(pa.array(lists, pa.list_(pa.int32())).slice(5, 60), model) == got[5:65]
    assert pieces.texts_of(pa.array([None, []], pa.list_(pa.int32())), model) == ["", ""] and pieces.texts_of(pa.array([], pa.list_(pa.int32())), model) == []


def test_fit_is_remembered_in_a_bounded_table(model):
    """With a table of two places nearly every pair is forgotten and merged again."""
    small, large = pieces.Encoder(model), pieces.Encoder(model)
    words = {f"▁{a}{b}" for a in ("then", "anti", "tion", "zqx") for b in ("ing", "s", "ññ", "中文", "tion")}
    small.keys, small.fitting = small.keys[:], small.fitting[:]
    before = pieces.PAIRS
    pieces.PAIRS = 1
    try:
        got = small.cut(sorted(words))
    finally:
        pieces.PAIRS = before
    assert got == large.cut(sorted(words))


def test_frames(spark, library):
    """Null, empty and repeated rows, other columns, a column named like a new one, with and without an end id."""
    rows = [(1, None, "x"), (1, "a  b", "y"), (None, "a  b", "y"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    key = lambda r: (r[0] or 0, r[1] or "")
    got = sorted([(r.doc_id, r.text, r.ids, r.decoded) for r in out.collect()], key=key)
    assert got == sorted([(i, t, library.encode(t or "", add_eos=True), t or "") for i, t, _ in rows], key=key)
    bare = pieces.encode(docs, PIECES, with_end=False).collect()
    assert sorted(map(len, [r.ids for r in bare])) == sorted(len(library.encode(t or "")) for _, t, _ in rows)
    missing = spark.createDataFrame([(None,)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(missing, PIECES).collect()] == [""]


def test_a_model_that_changes_text_is_refused(monkeypatch):
    monkeypatch.setattr(pieces, "PROBE", "▁")
    with pytest.raises(ValueError):
        pieces.Pieces(PIECES)
