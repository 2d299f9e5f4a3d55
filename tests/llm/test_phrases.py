"""Collocations against DuckDB's and plain Python's counts."""

import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from logloom.llm import phrases
from logloom.llm.queries import OP13_SQL, op13_phrases


@pytest.mark.parametrize("burst", [2, 7, 1 << 14])
def test_trie(monkeypatch, burst):
    """Whatever bursts and spills, every phrase is counted once for each time it was added, and runs are sorted."""
    monkeypatch.setattr(phrases, "BURST", burst)
    rng, want, got = np.random.default_rng(burst), Counter(), Counter()
    trie = phrases.Node(phrases.WORD_BITS, 0, {})
    for turn in range(40):
        a, b = rng.zipf(1.3, 300) % 50, rng.integers(1, 1 + 10 ** (turn % 4), 300)
        keys, many = np.unique((a << phrases.WORD_BITS | b).astype(np.int64), return_counts=True)
        trie.add(keys, many)
        want.update(dict(zip(keys.tolist(), many.tolist())))
        assert trie.size <= len(want)
        if turn % 10 == 9:
            for keys, many in trie.spilled([100, 0][turn == 39]):
                assert (np.diff(keys) > 0).all()
                for k, n in zip(keys.tolist(), many.tolist()):
                    got[k] += n
    assert got == want and trie.size == 0


def plain(docs, most, least=10):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        fold = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for c in ".,;:!?\n\v\f\r":
            fold = fold.replace(c, "\n")
        for piece in fold.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    common = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    rows = []
    for (lang, *p), a in common.items():
        if any(len(q) == 4 and q[0] == lang and len(p) == 2 and tuple(p) in (q[1:3], q[2:4]) and 100 * b >= 50 * a for q, b in common.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p)))
        rows.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return out


def drawn():
    rng = random.Random(3)
    words = ["the", "of", "New", "York", "city", "state", "A", "b", "ÄÖ", "ä x", "x\x1cy"] + [f"w{k}" for k in range(30)]
    say = lambda n: "".join(rng.choice(words[:6] if rng.random() < 0.5 else words) + rng.choice([" "] * 8 + ["\t ", ", ", ".", "\n"]) for _ in range(n))
    docs = [(say(rng.randint(0, 90)), rng.choice(["en", "de", None])) for _ in range(150)]
    docs += [("new york city " * 400, "en"), (None, "en"), ("", None), ("!?.", "zz"), ("z " * 3000, "fr"), ("only one here", "it")]
    return docs + docs[:20]


def test_collocations(spark):
    docs = drawn()
    df = spark.createDataFrame([(t, g, "x", 1) for t, g in docs], "text string, lang string, phrase string, n int").repartition(5)
    for most in (2000, 7):
        got = sorted(map(tuple, phrases.collocations(df, most=most).collect()))
        assert got == sorted(plain(docs, most))


def test_registered_sql(spark, tmp_path):
    docs = drawn()
    spark.createDataFrame([(k, t, g, None, None) for k, (t, g) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(OP13_SQL).fetchall()) == sorted(map(tuple, op13_phrases(spark, str(tmp_path)).collect())) == sorted(plain(docs, 2000))


@pytest.mark.parametrize("bounds", [(50, 20, 30), (400, 10**6, 10**6)])
def test_runs_of_a_counter_at_any_bound(monkeypatch, bounds):
    """Small bounds of words, phrases and words looked at together give the same sums, and a filter that holds all bits changes nothing."""
    for name, value in zip(("WORDS", "PHRASES", "TOGETHER"), bounds):
        monkeypatch.setattr(phrases, name, value)
    every = phrases.Filter(np.full(phrases.FILTER_BITS // 64, 0xFFFFFFFFFFFFFFFF, np.uint64))
    docs = [(t or "", g or "und") for t, g in drawn()]
    for n in (1, 2, 3):
        counter, got = phrases.Counter(n, every), Counter()
        batches = [b for t, g in docs for b in counter.add(g, [t.encode()])] + [*counter.spill(0)]
        for batch in batches:
            for lang, phrase, many in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n"))):
                got[lang, phrase] += many
        want = Counter()
        for text, lang in docs:
            fold = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()
            for c in ".,;:!?\n":
                fold = fold.replace(c, "\n")
            for piece in fold.split("\n"):
                w = piece.replace("\t", " ").split(" ")
                w = [x for x in w if x]
                want.update((lang, " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
        assert got == want


def test_filter_makes_no_objects_of_rows(spark):
    """The driver holds the filter and a few arrays of numbers, however many phrases are frequent."""
    words = spark.range(250_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), "id").alias("phrase"), F.lit(10).alias("n"))
    tracemalloc.start()
    try:
        found = phrases.filter_of(words, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 240_000 < np.bitwise_count(found.words).sum() <= 250_000
    assert peak < 40_000_000


def test_words_are_split_as_bytes_are():
    for text in (b"", b" \t ", b" a", b"a \xff ", b"  a\t\tb\xff c\x1c\x1f\xc2\xa0d \x00 e\n"):
        assert phrases.split(text).to_pylist() == text.split()
