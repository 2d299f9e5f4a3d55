"""Inputs whose columns bear the operators' own names, and methods against exhaustive or plain versions of themselves."""

import itertools
import math
import random
import re
import struct
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import cdc, digest, mixing, simhash, suffix, token_counts, toxicity
from logloom.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(70)
    rows = [(k, f"{say(20)} {passage} {say(10)}" if k % 4 == 0 else say(40), None if k % 7 == 0 else f"s{k % 3}") for k in range(60)]
    return spark.createDataFrame([*rows, (None, None, None), rows[5], rows[5]], "doc_id long, text string, source string").repartition(3)


def clashing(docs, names):
    """``docs`` with further columns of text named ``names``."""
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])


def same(plain, wide, names, replaced=()):
    """Both frames hold the same rows but for the added columns, which ``wide`` kept."""
    kept = [n for n in names if n not in replaced]
    rows = wide.select(*plain.columns, *kept).collect()
    assert sorted(map(str, (tuple(r)[: len(plain.columns)] for r in rows))) == sorted(map(str, (tuple(r) for r in plain.collect())))
    for r in rows:
        assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for n in kept)


def test_mixing_with_its_own_names(docs):
    names = ["rank", "block", "blocks", "dealt", "shard", "place", "draw", "row", "id", "h", "h2", "_h", "nth", "size", "all", "taken"]
    wide = mixing.mix(clashing(docs, names))
    same(mixing.mix(docs), wide, names, ("size", "taken"))
    mixed = mixing.shards(wide)
    assert len(mixed.columns) == len(set(mixed.columns))
    same(mixing.shards(mixing.mix(docs)), mixed, names, ("size", "taken", "shard", "place"))


def test_cdc_with_its_own_names(docs):
    names = ["_key", "_found", "KEY", "found", "id", "start", "copy", "spans"]
    same(cdc.dedupe(docs), cdc.dedupe(clashing(docs, names)), names, ("spans",))


def test_suffix_with_its_own_names(docs):
    names = ["_key", "_Spans", "spans", "gram", "key", "removed"]
    same(suffix.remove_repeats(docs), suffix.remove_repeats(clashing(docs, names)), names, ("removed",))


def test_neighbours_with_their_own_names(docs):
    rows = docs.withColumn("tie", F.xxhash64("text"))
    names = ["_range", "_guest", "_head", "top", "to", "c"]
    same(digest.with_next(rows, ["doc_id"], "doc_id", "tie"), digest.with_next(clashing(rows, names), ["doc_id"], "doc_id", "tie"), names)


def test_token_counts_with_their_own_names(spark, docs):
    edits = spark.createDataFrame([(k, 0, 3, 2, "new words") for k in range(0, 60, 2)], "doc_id long, nth int, at int, cut int, put string")
    names = ["leaves", "edits", "edited", "nth", "put", "n_words"]
    run = lambda d: token_counts.apply(token_counts.with_edits(token_counts.build(d, TOKENIZER), edits), TOKENIZER)
    same(run(docs).drop("edits"), run(clashing(docs, names)).drop("edits"), names, ("leaves", "edits", "edited", "n_words"))


def test_every_block_of_the_mix_has_one_shard_a_turn(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    rows = mixing.mix(docs, shards=4, seed=1).withColumn("h", F.xxhash64("doc_id", "size", F.lit(1))).collect()
    total, blocks = sum(r["size"] for r in rows), defaultdict(set)
    for r in rows:
        many = max(1, math.ceil(r.source_size / max(100, total / mixing.BLOCKS)))
        blocks[r.source, r.h % many].add(tuple(d.shard for d in r.draws))
    assert len(blocks) > 15 and len({s for b in blocks.values() for x in b for s in x}) == 4
    for found in blocks.values():  # rows of a block go where it goes; only its last turn may leave some out
        longest = max(found, key=len)
        assert all(x in [longest[:k] for k in range(len(longest) + 1)] for x in found)


def test_restoring_finds_the_best_of_all_readings():
    rng = random.Random(4)
    counts = np.array([rng.randrange(50) if rng.random() < 0.4 else 0 for _ in range(toxicity.SYMBOLS**3)], np.int64)
    restorer = toxicity.Restorer(counts)
    symbol = lambda c: toxicity.BORDER if c == " " else ord(c) - 97 if "a" <= c <= "z" else toxicity.OTHER

    def cost(reading: str, channel: float) -> float:
        line = [toxicity.BORDER] * 2 + [symbol(c) for c in reading] + [toxicity.BORDER]
        return channel + sum(restorer.cost[a][b][c] for a, b, c in zip(line, line[1:], line[2:]))

    for _ in range(300):
        text = "".join(rng.choice("aabbé  013@$!.-|") for _ in range(rng.randint(1, 7)))
        readings = defaultdict(lambda: -math.inf)
        for path in itertools.product(*[restorer._options(text, at) for at in range(len(text))]):
            word = "".join(letter for letter, _ in path)
            readings[word] = max(readings[word], cost(word, sum(p for _, p in path)))
        assert readings[restorer.restore(text)] == pytest.approx(max(readings.values()), abs=1e-9), text


def test_ties_between_readings_go_to_the_last_in_order():
    restorer = toxicity.Restorer(np.zeros(toxicity.SYMBOLS**3, np.int64))
    # Without counts all letters cost the same, so "1" reads as "i" or "l" alike.
    assert restorer.restore("1b") == "lb"


def test_evidence_and_logistic_score_by_hand():
    model = toxicity.Model(np.zeros(toxicity.SYMBOLS**3, np.int64))
    model.classes, model.facts = (10, 90), {"vile": (6, 1), "vile*": (7, 2), "harm": (3, 0)}
    odds = lambda t, o: math.log((t + 0.5) / 11) - math.log((o + 0.5) / 91) - toxicity.Z * math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
    first, second = sorted((max(odds(6, 1), odds(7, 2), 0), max(odds(3, 0), 0)), reverse=True)
    got = model.evidence("vile harm plain vile")
    assert got == pytest.approx([1, first, second, 0, math.log(4), first * math.log(4), 2 / 4])
    model.beta = np.array([-1.0, 0.5, 0.25, 0, 0.1, 0.2, 3])
    assert model.score("vile harm plain vile") == pytest.approx(1 / (1 + math.exp(-float(np.dot(got, model.beta)))))
    own = model.evidence("harm", 1)  # a document's own count is taken out
    assert own[1] == pytest.approx(max(odds(2, 0), 0))
    model.forget()
    assert not model.words and not model.weights


def test_fingerprints_are_xxhash_of_the_canonical_text(spark):
    texts = ["Straße ﬁne", "  A\tb\n\nC ", "É é ÅΩ", "", None, "x" * 5000, "ǅ İ ŉ", "a  b\x85c\x1cd"]

    def plain(text):
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
        canonical = re.sub(r"[\t-\r\x1c-\x20\x85   -     　]+", " ", folded).strip(" ")
        lane = lambda k: xxhash.xxh64_hexdigest(canonical.encode(), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))
        return "".join(map(lane, range(4)))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(digest.fingerprint(digest.canonical(F.col("t")))).collect()] == [plain(t) for t in texts]


@pytest.mark.parametrize("n", [600, 256_000, 15_000_000, 10**9])
def test_pairs_just_at_the_similarity_share_a_bucket_at_every_size(n):
    apart = math.acos(2 * 0.8 / 1.8) / math.pi
    tables = simhash._random_tables(n, apart)
    assert all(len(set(t)) == len(t) for t in tables.tolist())
    differ = np.random.default_rng(5).random((20_000, simhash.WIDTH)) < apart
    met = np.zeros(len(differ), bool)
    for places in tables:
        met |= ~differ[:, places].any(axis=1)
    met &= (differ[:, :64].sum(axis=1) <= simhash._within(64, apart)) & (differ[:, :128].sum(axis=1) <= simhash._within(128, apart))
    assert met.mean() >= 0.99
    masks = simhash._masks(tables)
    assert [sum(int(x).bit_count() for x in m) for m in masks] == [tables.shape[1]] * len(tables)


def test_wide_fingerprints_bit_by_bit():
    rng = np.random.default_rng(2)
    for many in (0, 1, 2, 7, 5000):
        x = rng.integers(0, 2**64, many, dtype=np.uint64)
        lanes = [x]
        while len(lanes) < len(simhash.LANES):
            lanes.append(simhash._mixed(lanes[-1]))
        want = [sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > many) for h in lanes]
        assert simhash._majorities(x).view(np.uint64).tolist() == want
