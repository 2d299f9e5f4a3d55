"""Bitmaps of linked pairs against plain counts."""

import random
from collections import Counter

import numpy as np
import pytest

from logloom.llm import alignment
from logloom.llm.queries import PIECES, TOKENIZER

from test_queries import plain_alignment


@pytest.mark.parametrize("size", [0, 1, 300, 511, 512, 513, 8192])
def test_planes(size):
    places = np.sort(np.random.default_rng(size).choice(alignment.BLOCK, size, replace=False)).astype("<u2")
    plane = alignment.packed(places.tobytes())
    assert alignment.unpacked(plane).tolist() == places.tolist() and len(plane) <= alignment.BLOCK // 8


def test_postings_of_a_block():
    """Pairs of any multiplicity come back from their planes, however many documents hold them."""
    rng, want, found = random.Random(1), Counter(), []
    for start in range(0, 6000, 500):
        here = Counter()
        for place in range(start, start + 500):
            for pair in (7, rng.randrange(100, 400), rng.randrange(100, 110)):
                here[pair, place] += rng.choice([1, 1, 2, 5, 300])
        found.append((np.array(sorted(p << alignment.PLACE_BITS | k for p, k in here)), np.array([here[x] for x in sorted(here)])))
        want.update(here)
    got = Counter()
    for row in alignment._postings(found, 3).to_pylist():
        mine = {k: n for (p, k), n in want.items() if p == row["pair"]}
        assert (row["block"], row["documents"], row["links"]) == (3, len(mine), sum(mine.values()))
        held = set()
        for k, plane in enumerate(row["planes"]):
            held |= {*alignment.unpacked(plane).tolist()}
            for place in alignment.unpacked(plane).tolist():
                got[row["pair"], place] += 1 << k
        assert held == {*mine}
    assert got == want


def test_many_blocks(spark):
    """Pairs over several blocks, a pair in nearly all documents, other columns, repeated rows and null ids."""
    rng = random.Random(2)
    words = ["the", " the", "internationalisation", "ünï", "x1", "  ", "zq", "<|endoftext|>", "naïve", "…"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(700)]
    rows = [(k if k % 9 else None, t, k % 3 == 0) for k, t in enumerate(texts)] + [(1, None, True), (1, "a▁b", True), (1, "", False), (1, texts[1], False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, flag boolean").repartition(6)
    indexed = alignment.index(docs, TOKENIZER, PIECES)
    pairs = alignment.pairs(indexed)
    out = alignment.scores(indexed, pairs)
    assert out.columns == ["doc_id", "flag", *alignment.COUNTS, "groups_sha256", "n_best", "count_sum"]
    plain = plain_alignment([t for _, t, _ in rows])
    counts, held, most = Counter(x for p in plain for x in p[3]), Counter(x for p in plain for x in {*p[3]}), Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    got = sorted((r.a_id, r.b_id, r.documents, r.links, r.best) for r in pairs.collect())
    assert got == sorted((a, b, held[a, b], n, n == most[b]) for (a, b), n in counts.items())
    want = Counter((i, f, p[0], p[1], p[2], len(p[3]), sum(counts[x] == most[x[1]] for x in p[3]), sum(counts[x] for x in p[3])) for (i, _, f), p in zip(rows, plain))
    assert Counter((r.doc_id, r.flag, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in out.collect()) == want
    texts = alignment.groups(docs, TOKENIZER, PIECES).collect()
    assert Counter((r.doc_id, r.groups) for r in texts) == Counter((i, p[4]) for (i, _, _), p in zip(rows, plain))
    with pytest.raises(ValueError):
        alignment.index(docs.withColumn("pair", docs.doc_id), TOKENIZER, PIECES)
