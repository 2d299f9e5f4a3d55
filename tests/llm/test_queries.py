"""The registered queries on a table of odd rows, column by column against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from logloom.llm import cdc
from logloom.llm.bpe import byte_chars
from logloom.llm.queries import PIECES, TOKENIZER, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, key string, node string, kept string, score string, ids string, word string, hash string, edits string"


def table() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, first = say(80), say(60)
    texts = [first, None, "", " \t\n ", "a", "ÄÖ ü Straße x\u00a0y", "<|endoftext|> b", "don't 123 ab\n\n  c", "-" * 900, f"{say(30)} {passage} {say(30)}", f"{say(9)} {passage} {say(50)}", first, first + " more",
             " ".join([say(50_000), passage, say(50_000)]), "STRASSE", "straße", "one two three four five", "x " * 300]
    texts += [say(rng.randint(20, 90)) for _ in range(22)]
    return [*enumerate(texts), (None, "no id here at all"), (0, first), (0, first), (7, "the id of another text")]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    full = [(i, t, "en", None if n % 6 == 0 else f"s{n % 4}", None, *["x"] * 10) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(n, n % 2, n % 3 == 0) for n in range(40)] + [(None, 1, None), (3, None, None)]
    spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def check(spark, name, folder, want):
    """The query's rows, in any order, begin with ``want``'s columns."""
    df = queries()[name](spark, folder)
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r)[: len(want[0])] for r in df.collect()), key=key) == sorted(want, key=key)
    return df.columns


@pytest.mark.parametrize("name", list(queries()))
def test_no_rows(spark, nothing, name):
    assert queries()[name](spark, nothing).count() == 0


def test_op1(spark, folder, rows):
    """Chunks one byte at a time, first copies by smallest id and place, runs of 100 bytes."""
    gears = [int(x) for x in cdc.gear_table()]

    def chunks(data):
        out, h, last = [], 0, 0
        for k, b in enumerate(data):
            h = (2 * h + gears[b]) % 2**32
            if h >> 27 == 0 and k + 1 - last >= 16 or k + 1 - last == 128 or k + 1 == len(data):
                out.append((last, k + 1))
                last = k + 1
        return out

    found, texts = {}, sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda r: (r[0], r[1], xxhash.xxh64_intdigest(r[2].encode(), 42)))
    many = Counter()
    cut = {r: chunks(r[2].encode()) for r in texts}
    for known, i, t in ((i is not None, i or 0, t or "") for i, t in rows):
        many.update(t.encode()[a:b] for a, b in cut[known, i, t])
    for r in texts:
        for a, b in cut[r]:
            found.setdefault(r[2].encode()[a:b], (r, a))
    want = []
    for i, t in rows:
        r, data = (i is not None, i or 0, t or ""), (t or "").encode()

        def runs(some):
            out = []
            for a, b in some:
                if out and out[-1][1] == a:
                    out[-1][1] = b
                else:
                    out.append([a, b])
            return [(a, b) for a, b in out if b - a >= 100]

        copied = runs([(a, b) for a, b in cut[r] if found[data[a:b]] != (r, a)])
        shared = runs([(a, b) for a, b in cut[r] if many[data[a:b]] > 1])
        kept = b"".join(data[a:b] for a, b in zip([0, *[b for _, b in copied]], [*[a for a, _ in copied], len(data)]))
        want.append((i, len(data), sum(b - a for a, b in copied), len(copied), sha(kept), sum(b - a for a, b in shared)))
    check(spark, "op1_cdc", folder, want)


def test_op2(spark, folder, rows):
    tok = Tokenizer.from_file(TOKENIZER)
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    check(spark, "op2_bpe", folder, [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tok.decode(x, skip_special_tokens=False).encode())) for (i, _), x in zip(rows, ids)])


def test_op4(spark, folder, rows):
    out = queries()["op4_mixing"](spark, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r["size"]) for r in out) == sorted((i is not None, i, len((t or "").encode().split())) for i, t in rows)
    again = queries()["op4_mixing"](spark, folder).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    source, total = {}, sum(r["size"] for r in out)
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"])
        source.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), mine in source.items():
        assert size == sum(r["size"] for r in mine) and target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in mine) - target) <= max(r["size"] for r in mine)
    assert sum(t for _, t in source) == pytest.approx(1.5 * total)


def crc(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def test_op5(spark, folder, rows):
    c, ends = Counter(), 0
    lower = lambda t: (t or "").encode().lower().split()
    for i, t in rows:
        if crc(i, 10):
            c.update(lower(t))
            ends += 1
    total = sum(c.values()) + ends
    base = lambda n: math.log10((n + 0.1) / (total + 0.1 * (len(c) + 2)))
    want = {}
    for i, t in rows:
        want.setdefault((i, len(lower(t)) + 1), (crc(i, 10) == 0, 1 + sum(c[w] > 0 for w in lower(t)), total, sum(base(c[w]) for w in lower(t)) + base(ends)))
    out = queries()["op5_brown"](spark, folder).collect()
    assert len(out) == len(rows)
    for r in out:
        held, known, n, score = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, n) and r.base_score == pytest.approx(score) and r.score < 0


def test_op6(spark, folder, rows):
    out = queries()["op6_toxicity"](spark, folder).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op7(spark, folder, rows):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        hs = np.array([xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else [], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int((hs >> np.uint64(b) & np.uint64(1)).sum()) > len(hs))

    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root = [root[b] if x == root[a] else x for x in root]
    least = {}
    for (i, _), x in zip(rows, root):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    check(spark, "op7_simhash", folder, [(i, f"{f:016x}", least.get(x)) for (i, _), f, x in zip(rows, fps, root)])


def test_op8(spark, folder, rows):
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = Counter()
    for i, text in rows:
        t = text or ""
        n = len(t)
        for at, cut, put in ((n // 3, 17, ""), (n // 2, 0, t[:40] if text else ""), (n - 30, 10, (text or "")[max(0, n // 4 - 1) :][: 12 if n // 4 else 11].upper())):
            at = min(max(at, 0), len(t))
            t = t[:at] + put + t[at + cut :]
        want[i, count(text or ""), count(t), sha(t.encode())] += 1
    out = Counter((r.doc_id, r.n_tokens_before, r.n_tokens, r.edited_sha256) for r in queries()["op8_token_counts"](spark, folder).collect())
    assert out == want


def test_op9(spark, folder, rows):
    out = queries()["op9_digest"](spark, folder).collect()
    assert len(out) == len(rows)
    single = Counter(i for i, _ in rows)
    order = sorted((i, t or "") for i, t in rows if i is not None)[::-1]
    by_id = dict(rows)
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {(r.doc_id, r.n_chars): r for r in out}
    for at, (i, t) in enumerate(order):
        lower = [x for x in order if x[0] < i]
        if single[i] == 1 and lower and single[lower[0][0]] in (1, 3):  # repeated rows of id 0 are equal
            r, other = prints[i, len(t)], lower[0][1]
            half = len(t) // 2
            assert r.n_chars == len(t) and r.edited_sha256 == sha((t[: len(t) - half] + other[:half]).encode()), i
            assert r.near_next == float(r.fingerprint == prints[lower[0][0], len(other)].fingerprint)
    same = lambda a, b: prints[a, len(by_id[a] or "")].fingerprint == prints[b, len(by_id[b] or "")].fingerprint
    assert same(14, 15) and same(0, 11) and same(1, 3) and same(1, 2) and not same(4, 14)
    classes = {(r.doc_id, r.n_chars): (r.class_id, r.copies) for r in out}
    assert classes[11, len(by_id[11])] == (0, 4) and classes[14, 7] == classes[15, 6] == (14, 2)


def test_op10(spark, folder, rows):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    want = []
    for (i, _), d in zip(rows, data):
        covered = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        kept = bytes(np.frombuffer(d, np.uint8)[np.frombuffer(bytes(covered), np.uint8) == 0])
        want.append((i, len(d), sum(covered), sum(1 for x in bytes(covered).split(b"\0") if x), sha(kept)))
    check(spark, "op10_suffix", folder, want)


def test_op11(spark, folder, rows):
    model = SentencePieceProcessor(model_file=PIECES)
    ids = [model.encode(t or "", add_eos=True) for _, t in rows]
    check(spark, "op11_pieces", folder, [(i, len(x), sha(" ".join(map(str, x)).encode()), sha(model.decode(x).encode())) for (i, _), x in zip(rows, ids)])


def plain_alignment(texts):
    """Each text's counts, links of ids and groups, one byte at a time."""
    tok, model, chars = Tokenizer.from_file(TOKENIZER), SentencePieceProcessor(model_file=PIECES), byte_chars()
    tok.encode_special_tokens = True
    out = []
    for t in texts:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, model.encode(t)) if t else ([], [])
        raw_a = [bytes(chars[c] for c in tok.id_to_token(k)) for k in a]
        raw_b = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        whole = (" " + t).encode() if t else b""
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            a = b = []
            raw_a = raw_b = []
        owner_a, owner_b = ([k for k, x in enumerate(raw) for _ in x] for raw in (raw_a, raw_b))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b)))]
        groups, i, j = [], 0, 0
        for at in range(len(owner_a)):
            if at + 1 == len(owner_a) or owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1]:
                groups.append(",".join(map(str, a[i : owner_a[at] + 1])) + "|" + ",".join(map(str, b[j : owner_b[at] + 1])))
                i, j = owner_a[at] + 1, owner_b[at] + 1
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
    return out


def test_op12(spark, folder, rows):
    plain = plain_alignment([t for _, t in rows])
    counts = Counter(x for p in plain for x in p[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = [(i, p[0], p[1], p[2], len(p[3]), sum(counts[x] == most[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), sha(p[4].encode()) if p[4] else "") for (i, _), p in zip(rows, plain)]
    check(spark, "op12_alignment", folder, want)
