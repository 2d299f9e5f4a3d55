"""Each operator against a plain version of itself, and on the odd cases: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logloom.llm import bpe, brown, cdc, digest, mixing, simhash, suffix, token_counts, topk, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(70)
    out = [say(60) for _ in range(20)]
    out += [None, "", "   \n\t ", "a", "ÄÖ ü x", "<|endoftext|> b", "don't 123 ab\n\n  c", "x" * 3000, say(6000)]
    out += [f"{say(30)} {passage} {say(30)}", f"{say(40)} {passage} {say(20)}", out[0], out[0], out[1] + " more"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts())]
    rows += [(None, "no id here at all", None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_equals_the_library(docs, none):
    tok = Tokenizer.from_file(PATH)
    rows = bpe.round_trip(docs.withColumnRenamed("lang", "ids"), PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == tok.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).filter("decoded != coalesce(text, '')").count() == 0
    assert bpe.round_trip(none, PATH).count() == 0


def test_cdc_finds_shared_passages(docs, none, spark):
    rows = by_id(cdc.dedupe(docs.withColumnRenamed("lang", "spans")))
    t = texts()
    shared = [k for k, x in enumerate(t) if x and k in (29, 30)]
    assert len(rows[shared[0]].spans) == 0 and len(rows[shared[1]].spans) == 1 and rows[shared[0]].shared
    assert rows[31].kept == "" and rows[32].kept == "" and rows[0].kept == t[0]
    assert not rows[5].spans and rows[20].kept is None and rows[21].kept == ""
    for k, r in rows.items():
        if r.text is not None:
            data = r.text.encode()
            kept = b"".join(data[a:b] for a, b in zip([0, *[s[1] for s in r.spans]], [*[s[0] for s in r.spans], len(data)]))
            assert kept == r.kept.encode(), k
    assert cdc.dedupe(none).count() == 0
    moved = spark.createDataFrame([(1, t[28]), (2, "inserted " + t[28])], "doc_id long, text string")
    assert len(by_id(cdc.dedupe(moved))[2].kept) < 200


def test_cdc_tells_texts_of_equal_hash_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(None, f"{passage} of no id"), (1, f"{passage} one"), (2, " ".join(f"other{k}" for k in range(60))), (3, f"three {passage}"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = by_id(cdc.dedupe(docs))
    monkeypatch.setattr(cdc, "_key", lambda id_col, text_col: F.lit(0).cast("bigint").alias("key"))
    assert by_id(cdc.dedupe(docs)) == expected
    assert not expected[None].spans and expected[1].spans and expected[3].spans and not expected[2].spans


def test_gear_hash_follows_its_recurrence():
    data, table, h, out = random.Random(1).randbytes(500), cdc.gear_table(), 0, []
    for b in data:
        h = (2 * h + int(table[b])) % 2**32
        out.append(h)
    assert cdc.gear_hashes(np.frombuffer(data, np.uint8), table).tolist() == out


def test_topk_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1 + k % 7) for _ in range(9)]) for k in range(400)]
    rows += [(400 + k, rows[7][1]) for k in range(30)] + [(7, rows[7][1])]
    rows += [(500, None), (600, []), (700, [1.0, None]), (800, [float("nan")]), (900, [float("inf")]), (1000, [0.0] * 9), (1100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(topk.vectors(df), lambda c: __import__("pyspark.sql.functions", fromlist=["col"]).col(c) % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in whole:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q))[:10]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == {q for q, _ in whole if q % 100 == 0}
    assert topk.top_k(topk.vectors(df.limit(0)), lambda c: __import__("pyspark.sql.functions", fromlist=["col"]).col(c) % 100 == 0).count() == 0


def test_topk_of_repeated_rows_as_sql(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "QUERIES", 1)
    rng = random.Random(4)
    rows = [(k, [float(rng.randint(-4, 4)) for _ in range(5)]) for k in (100, 200, 300, 1, 2, 3, 4, 5)]
    rows += rows[:1] * 30 + rows[4:5] * 2 + [(200, [1.0] * 5)] * 3  # many copies of few ids: most numbers of blocks stay empty
    got = topk.top_k(topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), lambda c: F.col(c) % 100 == 0).collect()
    want = []
    for q in (100, 200, 300):
        best = sorted((-sum(int(a * 1024) * int(b * 1024) for a, b in zip(v, w)), i) for x, v in rows if x == q for i, w in rows if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_holds_huge_scores_to_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(100, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [2.0, 2.0])]
    got = topk.top_k(topk.vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, length string")), lambda c: F.col(c) % 100 == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got)] == [(1, 1), (2, 3), (3, 2)] and max(r.score for r in got) == (1 << 63) - 1 and min(r.score for r in got) == -(1 << 63)


def test_canonical_folds_case_and_all_white_space(spark):
    pairs = [("STRASSE", "straße"), ("ΟΔΟΣ", "οδος"), ("a\u0085b", "a b"), ("a\x1c\x1d\x1e\x1fb", "a b"), ("ǰ", "J\u030c")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(digest.canonical(df.a), digest.canonical(df.b)).collect():
        assert r[0] == r[1]


def test_mixing_meets_targets(docs, none, spark):
    mixed = mixing.mix(docs.withColumnRenamed("lang", "target"), shards=4)
    rows = mixed.collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.withColumnRenamed("lang", "target"), shards=4).collect()))
    sources = {r.source: r for r in rows}
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
    assert sum(r.target for r in sources.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    for s, r in sources.items():
        own = [x for x in rows if x.source == s]
        assert abs(sum(x.taken for x in own) - r.target) <= max(x.size for x in own)
        assert r.target <= 2 * r.source_size + 1e-9
    out = mixing.shards(mixed).collect()
    assert len(out) == sum(len(r.draws) for r in rows)
    assert mixing.mix(none).count() == 0
    one = spark.createDataFrame([(1, None, "s"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(one).collect()] == [0, 0]


def test_splitting_tree_keeps_quotas(spark):
    quotas = [37, 0, 500, 3]
    leaves = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<bigint>"), 8, 3).collect()
    assert [sum(x) for x in zip(*(r.quotas for r in leaves))] == quotas
    assert {sum(r.quotas) for r in leaves} <= {67, 68} and min(min(r.quotas) for r in leaves) >= 0


def test_hypergeometric_distribution(spark):
    from pyspark.sql import functions as F

    n, k, d = 40, 12, 15
    pmf = [math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) for x in range(k + 1)]
    us = [(i + 0.5) / 400 for i in range(400)]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(d), F.col("u"))).collect()]
    cum = np.cumsum(pmf)
    assert got == [int(np.searchsorted(cum, u)) for u in us]


def test_brown_scores(spark, docs, none):
    from pyspark.sql import functions as F

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    model, counts = brown.fit(docs.filter(~held))
    rows = brown.score(docs, model, counts).collect()
    assert len(rows) == docs.count()
    c, ends, known = Counter(), 0, {}
    for r in docs.collect():
        known[r.doc_id] = (r.text or "").encode().lower().split()
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10:
            c.update(known[r.doc_id])
            ends += 1
    total = sum(c.values()) + ends
    size = total + 0.1 * (len(c) + 2)
    assert model.total == total
    for r in rows:
        w = known[r.doc_id]
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in w) + 1
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / size) for x in w) + math.log10((ends + 0.1) / size))
        assert r.score < 0
    empty, no_counts = brown.fit(none)
    assert brown.score(none, empty, no_counts).count() == 0


def test_brown_classes_beat_the_unigram(spark):
    rng = random.Random(6)
    kinds = [["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) + end for _ in range(60)] for end in "xyz"]
    rows = [(k, " ".join(rng.choice(kinds[n % 3]) for n in range(30))) for k in range(300)]
    model, counts = brown.fit(spark.createDataFrame(rows[:250], "doc_id long, text string"))
    out = brown.score(spark.createDataFrame(rows[250:], "doc_id long, text string"), model, counts).collect()
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.3  # log10 3 is 0.477


@pytest.mark.parametrize("known", [1 << 18, 5])
def test_brown_score_follows_its_formula(docs, monkeypatch, known):
    """Every token by its class, from the model's classes and table alone, whether its word is in the broadcast or joined."""
    monkeypatch.setattr(brown, "KNOWN", known)
    model, counts = brown.fit(docs)
    c = {bytes(r.word): r.n for r in counts.collect()}
    ends, once = docs.count(), Counter()
    total = sum(c.values()) + ends
    size = total + 0.1 * (len(c) + 2)

    def class_of(w):
        return model.cls[model.known[w]] if w in model.known else model.classes[brown._ending(w)]

    room = np.zeros(brown.CLASSES + 1)
    room[brown.CLASSES] = ends + 0.5
    for w, n in c.items():
        room[class_of(w)] += n + 0.5
        once[brown._ending(w)] += n == 1
    for g in range(brown.FREQUENT, brown.END):
        room[model.classes[g]] += 0.5 * (once[g] + 1)
    assert model.trans.sum(axis=1) == pytest.approx(1) and len(model.known) <= known
    got = {}
    for r in brown.score(docs.withColumnRenamed("lang", "score"), model, counts).collect():
        got.setdefault(r.doc_id, r)
    for r in docs.collect():
        words, before, want, base = (r.text or "").encode().lower().split(), brown.CLASSES, 0.0, 0.0
        for w in [*words, None]:
            at, n = (brown.CLASSES, ends) if w is None else (class_of(w), c.get(w, 0))
            base += math.log10((n + 0.1) / size)
            want += math.log10(brown.SHARE * model.trans[before, at] * (n + 0.5) / room[at] + (1 - brown.SHARE) * (n + 0.1) / size)
            before = at
        assert got[r.doc_id].score == pytest.approx(want) and got[r.doc_id].base_score == pytest.approx(base)


def test_brown_words_of_the_second_tier_go_where_their_neighbours_say(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrst"
    often = [[f"{k}{x}{y}" for x in letters for y in letters[:5]] for k in "xyz"]
    seldom = [[f"{a}{b}{c}{k % 7}" for n, (a, b, c) in enumerate((a, b, c) for a in letters for b in letters for c in letters) if n % 3 == k][:2900] for k in range(3)]
    rng.shuffle(seldom)
    say = lambda kind, at: rng.choice(seldom[kind]) if at % 4 == 3 else rng.choice(often[kind])
    rows = [(k, " ".join(say(n % 3, n + k) for n in range(60))) for k in range(4000)]
    model, counts = brown.fit(spark.createDataFrame(rows[:3800], "doc_id long, text string").repartition(4))
    assert len(model.known) > brown.FREQUENT
    kind_of = {w: k for k, words in enumerate(seldom) for w in words}
    classes = {}
    for w, k in model.known.items():
        if k >= brown.FREQUENT and w.decode() in kind_of:
            classes.setdefault(int(model.cls[k]), Counter())[kind_of[w.decode()]] += 1
    assert sum(max(c.values()) for c in classes.values()) > 0.9 * sum(sum(c.values()) for c in classes.values())
    out = brown.score(spark.createDataFrame(rows[3800:], "doc_id long, text string"), model, counts).collect()
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.3  # log10 3 is 0.477


def test_brown_gain_is_the_change_in_likelihood():
    rng = np.random.default_rng(0)
    n, classes = rng.integers(0, 9, (12, 12)).astype(float), rng.integers(0, brown.CLASSES, 12)

    def table(c):
        t = np.zeros((brown.REST + 1,) * 2)
        np.add.at(t, (c[:, None].repeat(12, 1), c[None].repeat(12, 0)), n)
        return t

    def value(t):
        f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    i, t = 4, table(classes)
    left, right = np.bincount(classes, n[:, i], brown.REST + 1), np.bincount(classes, n[i], brown.REST + 1)
    gains = brown._gains(left, right, n[i, i], classes[i], t)
    for to in (0, 7, 63):
        moved = classes.copy()
        moved[i] = to
        assert gains[to] - gains[classes[i]] == pytest.approx(value(table(moved)) - value(t))


def test_toxicity_restores_and_learns(spark, none):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(200)]
    bad = ["grumbold", "snarkish", "vilewort"]
    rows, labels = [], []
    for k in range(400):
        t = [rng.choice(words) for _ in range(40)]
        if k % 4 == 0:
            t[5:5] = [rng.choice(bad), rng.choice(bad)]
        rows.append((k, " ".join(t)))
        labels.append((k, 1 - min(1, k % 4)))
    odd = [(1000, " ".join(rows[1][1].split()[:20]) + " sn4rk1sh gr.u.m.bold"), (1001, rows[2][1]), (1002, None), (1003, ""), (1004, " ".join(words) * 30)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((got[k] >= 0.5) == bool(y) for k, y in labels) >= 390
    assert got[1000] >= 0.5 and all(got[k] < 0.5 for k in (1001, 1002, 1003, 1004)) and all(0 <= s <= 1 for s in got.values())
    assert model.restorer.restore("sn4rk1sh") == "snarkish" and model.restorer.restore("g r u m b o l d") == "grumbold"
    blank = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_toxicity_restores_long_tokens_and_mixed_spacing():
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for word in ("grumbold", "snarkish", "vilewort"):
        c = np.concatenate([[toxicity.BORDER] * 2, toxicity._codes(word), [toxicity.BORDER]])
        np.add.at(counts, c[:-2] * toxicity.SYMBOLS**2 + c[1:-1] * toxicity.SYMBOLS + c[2:], 1000)
    model = toxicity.Model(counts)
    for text in ("gr" + "u" * 60 + "mbold", ".".join("grumbold" + "-" * 30), "g" + "._-" * 20_000 + "rumbold", "g r u m 8 0 l d", "g  r\tu\nm b  o l d"):
        assert "grumbold" in model.tokens(text), text[:80]
    assert model.tokens("1 2 3 4") == {"1", "2", "3", "4"}


def brute_simhash(text: str | None) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash_groups(docs, none, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    out = simhash.groups(docs.withColumnRenamed("lang", "fp")).withColumn("hex", simhash.hexadecimal()).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    fps = {r.doc_id: brute_simhash(r.text) for r in rows}
    root = {f: f for f in fps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    for r in out:
        assert r.hex == f"{fps[r.doc_id]:016x}" and r.component_id == least.get(find(fps[r.doc_id]))
    assert simhash.groups(none).count() == 0


def test_simhash_links_within_buckets():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, 500)]
    for k in range(500):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f[k] ^= np.uint64(1) << np.uint64(b)
    f = np.unique(f)
    root = simhash.trie_links(f, np.array([0, len(f)]), 4)
    want = simhash._Forest(len(f))
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4)
    want.merge(a, b)
    assert (root == want.root).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (200, 100), (-5, -4)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100, 102: 100, 200: 100, -4: -5}


def test_token_counts_follow_edits(docs, none, spark):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    rng = random.Random(4)
    edits = [(k, n, rng.randint(-3, 400), rng.choice([0, 1, 30]), rng.choice(["", "a", " b\n", "'re", "  x "])) for k in range(34) for n in range(6)]
    built = token_counts.build(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), PATH)
    done = token_counts.apply(token_counts.with_edits(built, spark.createDataFrame(edits, "doc_id long, nth int, at int, cut int, put string")), PATH)
    for r in done.collect():
        text = r.text or ""
        assert r.n_tokens_before == len(tok.encode(text, add_special_tokens=False).ids)
        for _, _, at, cut, put in [e for e in edits if e[0] == r.doc_id]:
            at = min(max(at, 0), len(text))
            text = text[:at] + put + text[at + cut :]
        assert r.edited == text and r.n_tokens == len(tok.encode(text, add_special_tokens=False).ids)
        leaves = np.frombuffer(bytes(r.leaves), "<u4").reshape(-1, 2)
        assert leaves[:, 0].sum() == len(text) and leaves[:, 1].sum() == r.n_tokens and r.n_reencoded <= 400
    assert token_counts.build(none, PATH).count() == 0


def test_digest_classes_and_neighbours(docs, none, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(digest, "RANGE_ROWS", 3)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    led = digest.with_next(rows, ["text", "doc_id"], "doc_id", "tie").collect()
    order = sorted(led, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    assert len(order) == docs.count()
    for k, r in enumerate(order):
        assert (r.next_doc_id, r.next_text) == (order[(k + 1) % len(order)].doc_id, order[(k + 1) % len(order)].text)
    least = rows.drop("text").withColumn("tie", F.lit(-(2**63)))  # the least tie there is
    assert sorted(str(r.next_doc_id) for r in digest.with_next(least, ["doc_id"], "doc_id", "tie").collect()) == sorted(str(r.doc_id) for r in least.collect())
    classes = {r.doc_id: r for r in digest.classes(docs).collect()}
    assert {classes[k].class_id for k in (0, 31, 32)} == {0} and classes[0].copies == 3
    assert {classes[k].class_id for k in (20, 21, 22)} == {20} and classes[3].copies == 3 and classes[5].copies == 1
    assert digest.with_next(none.select("doc_id", F.lit(1).alias("tie")), ["doc_id"], "doc_id", "tie").count() == 0
    assert digest.classes(none).count() == 0


def test_canonical_text(spark):
    pairs = [("ﬁne  Text\n", "fine text"), ("é", "é"), (" Ａ", "a"), (None, "")]
    df = spark.createDataFrame([(a,) for a, _ in pairs], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(digest.canonical(F.col("t"))).collect()] == [b for _, b in pairs]


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(1, 50))] + [0]
        assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:])


def test_repeats_are_those_of_brute_force():
    rng = random.Random(8)
    for turn in range(60):
        width, letters = 40, rng.choice([b"ab", b"abcdefgh", bytes(range(256))])
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(20, 70))) for _ in range(4)]
        texts = [b"".join(rng.choice(pieces) for _ in range(rng.randint(2, 4))).ljust(width, b"x") for _ in range(rng.randint(1, 8))]
        groups, many = np.array(sorted(rng.randrange(3) for _ in texts)), np.array([rng.choice([1, 1, 1, 2]) for _ in texts])
        _, groups = np.unique(groups, return_inverse=True)
        seen = Counter()
        for g, t, m in zip(groups.tolist(), texts, many.tolist()):
            for k in range(len(t) - width + 1):
                seen[g, t[k : k + width]] += m
        got = suffix.repeats(groups, texts, many, width)
        for g, t, flags in zip(groups.tolist(), texts, got):
            assert flags.tolist() == [seen[g, t[k : k + width]] > 1 for k in range(len(t) - width + 1)], turn


@pytest.mark.parametrize("group", [4000, 2, 0])
def test_repeats_removed(docs, none, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = docs.collect()
    data = [(r.text or "").encode() for r in rows]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    got = {}
    for r in suffix.remove_repeats(docs.withColumnRenamed("lang", "removed")).collect():
        got.setdefault(r.doc_id, (r.kept, r.removed))
    for r, d in zip(rows, data):
        covered = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        kept, removed = got[r.doc_id]
        assert bytes(kept) == bytes(b for b, c in zip(d, covered) if not c)
        assert len(removed) == sum(1 for x in bytes(covered).split(b"\0") if x)
    assert suffix.remove_repeats(none).count() == 0


def test_small_limits_give_the_same_ids():
    """The pipeline's smaller memo and batches, used up many times, change no ids."""
    import pyarrow as pa

    from logloom.llm import bpe
    from logloom.llm.queries import TOKENIZER

    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"word{k * j} x{j}é" for j in range(9)) for k in range(300)] + [None, ""]})
    ids = lambda limits: [x for b in bpe._encoded(iter([batch]), bpe.Vocabulary(TOKENIZER), "text", "ids", limits) for x in b.column("ids").to_pylist()]
    assert bpe.SMALL.memo < bpe.MEMO_WORDS and ids(bpe.SMALL) == ids(bpe.Limits()) == ids(bpe.Limits(50, 20, 20, 3, 200))
