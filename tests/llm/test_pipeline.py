"""The pipeline's stages: columns, what they keep, and the whole run."""

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from logloom.llm.queries import TOKENIZER, queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_substrings", "mixing", "token_ids"]


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"  # sf0.001 has eleven toxic documents
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    marked = {1: set(), 0: set()}
    for r in labels.filter("toxic is not null").join(docs, "doc_id").select("doc_id", "toxic").collect():
        marked[r.toxic].add(r.doc_id)
    assert len(marked[0] & ids) >= 0.97 * len(marked[0]) and len(marked[1] - ids) >= 0.7 * len(marked[1])


def test_one_of_each_group_stays(spark, docs, sf):
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, None, None, None, None), (9002, "", "en", "x", 0)], docs.schema)
    twice = docs.union(docs.filter("doc_id % 7 = 0")).union(docs.selectExpr("doc_id + 10000", "text", "lang", "source", "n_chars")).union(odd)
    kept = pipeline.drop_near_duplicates(spark, twice, sf)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and max(i or 0 for i in ids) < 9000 and len(ids) >= 0.7 * docs.count()
    assert None in ids  # the first of the empty texts
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_near_duplicates_as_by_brute_force(spark, docs, sf):
    def grams(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def edited(n, at):
        w = [f"{at}w{k}" for k in range(n + 4)]
        return " ".join(w), lambda m: " ".join(["x"] * m + w[m:])

    rows, n = [], 9000
    for at in range(8):  # changes at the beginning take one shingle each: similarity (100 - m) / (100 + m)
        text, change = edited(100, f"t{at}")
        for m in (0, 11, 12, 20)[: 2 + at % 3]:
            rows.append((n, change(m), "en", "x", 0))
            n += 1
    rows += [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.filter("text is not null").limit(150).collect()]
    sets = {r[0]: grams(r[1]) for r in rows}
    root = {k: k for k in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    want = {k for k, v in root.items() if k == v}
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_recall_just_above_the_similarity(spark):
    """Pairs of 0.8 to 0.85, changed at one place or at many: nearly all are found, and nothing below."""
    import random

    from logloom.llm import jaccard

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows, want = [], set()
    for at in range(300):
        w = [word() for _ in range(rng.randint(80, 300))]
        grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        while True:
            v = list(w)
            n = len(w) * rng.randint(15, 30) // 1000 if at % 2 else len(w) * rng.randint(4, 12) // 100
            spots = rng.sample(range(len(w)), max(1, n)) if at % 2 else range(s := rng.randrange(len(w) - n), s + n)
            for k in spots:
                v[k] = word()
            same = len(grams(w) & grams(v)) / len(grams(w) | grams(v))
            if 0.78 <= same <= 0.85:
                break
        rows += [(2 * at, " ".join(w)), (2 * at + 1, " ".join(v))]
        if same >= 0.8:
            want.add(2 * at)
    got = {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k for k in range(0, 600, 2) if got[k + 1] == k}
    assert found <= want and len(want) > 150 and len(found) >= 0.98 * len(want)
    assert all(got[k] == k for k in range(0, 600, 2))


def test_large_components_are_compared_in_parts(spark, monkeypatch):
    """A chain, each text similar to its neighbours alone, and copies that differ little, in parts of few sets."""
    from logloom.llm import jaccard

    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    chain = [" ".join(f"w{k}" for k in range(10 * n, 10 * n + 104)) for n in range(30)]
    family = [" ".join([f"f{k}" for k in range(100)] + [f"own{n}"]) for n in range(40)]
    texts = chain + family + [" ".join(f"z{n}x{k}" for k in range(50)) for n in range(5)]
    rows = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "root long, node long, text string")
    root = {r.node: r.root for r in jaccard.components(jaccard.links(rows, 5)).collect()}
    assert [root.get(n, n) for n in range(75)] == [0] * 30 + [30] * 40 + [70, 71, 72, 73, 74]


def test_substrings_go_but_for_their_first_copy(spark, docs, sf):
    passage = " ".join(f"passage{k}" for k in range(60))
    rows = [(n, f"begin{n} " * 20 + passage + f" end{n}" * 20, "en", "x", 0) for n in range(9000, 9006)]
    out = pipeline.drop_repeated_substrings(spark, docs.union(spark.createDataFrame(rows, docs.schema)), sf)
    assert out.columns == docs.columns and out.count() == docs.count() + 6 and out.filter("n_chars != length(text)").count() == 0
    mine = {r.doc_id: r.text for r in out.filter("doc_id >= 9000").collect()}
    assert passage in mine[9000] and all("passage30" not in mine[n] and f"begin{n}" in mine[n] and f"end{n}" in mine[n] for n in range(9001, 9006))


def test_mix_takes_what_the_targets_say(spark, docs, sf):
    sizes, taken = {}, {}
    for table, rows in ((sizes, docs), (taken, pipeline.mix_sources(spark, docs, sf))):
        assert rows.columns == docs.columns
        for r in rows.collect():
            table[r.source] = table.get(r.source, 0) + len((r.text or "").encode().split())
    longest = {}
    for r in docs.collect():
        longest[r.source] = max(longest.get(r.source, 0), len((r.text or "").encode().split()))
    names = sorted(sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    level, full = 0.0, set()
    while True:  # fill up sources until none is above twice its size
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    for s in names:
        target = 2 * sizes[s] if s in full else level * weight[s]
        assert abs(taken.get(s, 0) - target) <= longest[s]  # a document is taken whole


def test_stages_on_no_rows_and_on_odd_ones(spark, docs, sf):
    from pyspark.sql import functions as F

    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, " \t", "en", "x", 2)], docs.schema)
    clash = docs.limit(20).union(odd).withColumns({c: F.lit("x") for c in ("_row", "node", "root", "kept", "spans", "size", "target", "shard", "_score", "ids", "label")})
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, clash, sf).columns == docs.columns, name
    assert pipeline.to_token_ids(spark, clash, sf).filter("round_trip").count() == 24


def test_run(spark, sf):
    tok = Tokenizer.from_file(TOKENIZER)
    rows = pipeline.run(spark, sf).collect()
    assert rows and all(r.round_trip for r in rows)
    assert len(bytes(rows[0].ids)) == 4 * rows[0].n_tokens
    assert tok.decode([int.from_bytes(bytes(rows[0].ids)[k : k + 4], "little") for k in range(0, 40, 4)])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
