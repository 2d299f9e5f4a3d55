"""Language-model scores from Brown's class-based bigrams.

Words are counted over all training texts. The ``KNOWN`` most frequent words are items of their own, and go to tasks by a
broadcast of bounded size; every other word, known or not, belongs to one of ``ENDINGS`` items by its last bytes, so that its
class never has to be looked up. Exchange clustering puts items into ``CLASSES`` classes, in two tiers. The ``FREQUENT`` most
frequent words and the endings are moved where the likelihood of the class bigrams grows most, by profiles of the items beside
them; a profile is one row, so rounds read a small table and shuffle nothing. Then each other known word leaves the class of its
ending for the one that its own neighbours' classes make likeliest (to first order), all in one more pass over the texts.

The probability of a word after another is P(class | class before) * P(word | class), mixed with the smoothed unigram
``(c + 0.1) / (N + 0.1 (V + 1))``. In its class a word counts ``c + 0.5``; a class sets aside 0.5 for as many unseen words of
an ending as were seen once, and one.

Tokens outside the broadcast are joined with the table of counts. A null text counts as empty: its only token is the end. Rows
with equal id and text get equal scores, each its row.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, steady

FREQUENT, ENDINGS, CLASSES, ROUNDS = 8192, 512, 64, 4
#: Words of the broadcast, their bytes in all, and the longest of them.
KNOWN, KNOWN_BYTES, LONGEST = 1 << 18, 16_000_000, 1 << 16
END = FREQUENT + ENDINGS
ITEMS = END + 1
#: While clustering: the class of items that have none yet; CLASSES is the end's.
REST = CLASSES + 1
#: Weight of the class model against the unigram.
SHARE = 0.9
TOKENS = 4_000_000


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates


def _ending(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-3:]) % ENDINGS


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word BINARY, n LONG) over all texts, without the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                n.update(_words(text.as_py()))
            if len(n) > 400_000:
                yield out()
                n.clear()
        yield out()

    return docs.select(text_col).mapInArrow(steady(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def item_bigrams(docs: DataFrame, frequent: dict[bytes, int], text_col: str = "text") -> DataFrame:
    """(before INT, item INT, n LONG): how often one item follows another, a text's end before its first and after its last."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, held, size = shared.value.get, [], 0

        def out() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ((codes // ITEMS).astype(np.int32), (codes % ITEMS).astype(np.int32), n)], ["before", "item", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = _words(text.as_py())
                items = [END, *[x if (x := item(w)) is not None else _ending(w) for w in words], END]
                codes = np.array(items, np.int64)
                held.append(codes[:-1] * ITEMS + codes[1:])
                size += len(words)
                if size > TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = docs.select(text_col).mapInArrow(steady(run), "before int, item int, n bigint")
    return rows.groupBy("before", "item").agg(F.sum("n").alias("n"))


def _profile(others: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.bincount(classes[others], counts, minlength=REST + 1)


def _terms(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _likelihood(table: np.ndarray) -> float:
    return float(_terms(table).sum() - _terms(table.sum(axis=0)).sum() - _terms(table.sum(axis=1)).sum())


def _gains(left: np.ndarray, right: np.ndarray, own: float, at: int, table: np.ndarray) -> np.ndarray:
    """How the log likelihood of the class bigrams changes if an item moves from class ``at`` to each class.

    left, right: counts of classes before and after the item; own: counts of the item after itself, in both.
    """
    terms, rest = _terms, table.copy()
    rest[at] -= right
    rest[:, at] -= left
    rest[at, at] += own  # taken off twice
    left, right = left.copy(), right.copy()
    left[at] -= own
    right[at] -= own
    follows, leads, before, after = left.sum() + own, right.sum() + own, rest.sum(axis=0) + right, rest.sum(axis=1) + left
    gain = (terms(rest + right) - terms(rest)).sum(axis=1) + (terms(rest + left[:, None]) - terms(rest)).sum(axis=0)
    d = np.diag(rest)
    gain += terms(d + left + right + own) - terms(d + left) - terms(d + right) + terms(d)
    return gain - (terms(after + leads) - terms(after)) - (terms(before + follows) - terms(before))


def _first_order(left: np.ndarray, right: np.ndarray, here: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For items of few counts (a row each in ``left`` and ``right``): the part of the log likelihood that a class would give them.

    That is the change in likelihood to first order; the class that an item is in is seen without the item's own counts.
    """
    log = np.log(table + 0.5)
    before, after = np.log(table.sum(axis=0) + 0.5), np.log(table.sum(axis=1) + 0.5)
    lefts, rights = left.sum(axis=1), right.sum(axis=1)
    gains = left @ log + right @ log.T - np.outer(lefts, before) - np.outer(rights, after)
    rest = lambda whole, own: np.log(np.maximum(whole - own, 0) + 0.5)
    gains[np.arange(len(here)), here] = ((left * rest(table[:, here].T, left)).sum(axis=1) + (right * rest(table[here], right)).sum(axis=1)
        - lefts * rest(table.sum(axis=0)[here], lefts) - rights * rest(table.sum(axis=1)[here], rights))
    return gains


def exchange(bigrams: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Each item's class, and the counts of class bigrams. The end is a class of its own, the last.

    The most frequent items begin a class each. The others join in batches, each as large as all before it, where they raise
    the likelihood most. Then a quarter of the items at a time may move on, as long as that raises the likelihood.
    """
    sc = bigrams.sparkSession.sparkContext
    both = bigrams.select(F.col("item").alias("i"), F.struct(F.lit(0).alias("side"), F.col("before").alias("other"), "n").alias("x")).union(
        bigrams.select(F.col("before").alias("i"), F.struct(F.lit(1).alias("side"), F.col("item").alias("other"), "n").alias("x")))
    profiles = cut(both.groupBy("i").agg(F.sum(F.when(F.col("x.side") == 0, F.col("x.n"))).alias("many"), F.collect_list("x").alias("x"))
        .select("i", F.coalesce("many", F.lit(0).cast("bigint")).alias("many"), F.expr("transform(x, x -> x.side)").alias("side"), F.expr("transform(x, x -> x.other)").alias("other"), F.expr("transform(x, x -> x.n)").alias("n")))
    ranked = [r[1] for r in sorted(profiles.select("many", "i").filter(F.col("i") != END).collect(), key=lambda r: (-r[0], r[1]))]
    classes = np.full(ITEMS, REST, np.int64)
    classes[END] = CLASSES
    classes[ranked[:CLASSES]] = np.arange(len(ranked[:CLASSES]))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(batch.num_rows):
            yield batch.column("i")[k].as_py(), *[batch.column(c)[k].values.to_numpy() for c in ("side", "other", "n")]

    def table(classes: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = np.zeros((REST + 1, REST + 1))
            for batch in batches:
                for i, side, other, n in rows(batch):
                    t[shared.value[i]] += _profile(other[side == 1], n[side == 1], shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([t.ravel().tolist()], pa.list_(pa.float64()))], ["t"])

        return sum((np.array(r.t) for r in profiles.mapInArrow(steady(run), "t array<double>").collect()), np.zeros((REST + 1) ** 2)).reshape(REST + 1, -1)

    def moves(classes: np.ndarray, t: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The classes after each of ``who`` has gone where it raises the likelihood of table ``t`` most."""
        shared = sc.broadcast((classes, t, who))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, t, who = shared.value
            moved = []
            for batch in batches:
                for i, side, other, n in rows(batch):
                    if who[i]:
                        before, after = side == 0, side == 1
                        gains = _gains(_profile(other[before], n[before], classes), _profile(other[after], n[after], classes), float(n[after & (other == i)].sum()), classes[i], t)
                        to = int(gains[:CLASSES].argmax())
                        if classes[i] == REST or gains[to] > gains[classes[i]] + 1e-6:
                            moved.append((i, to))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in moved], pa.int32()) for k in (0, 1)], ["i", "to"])

        out = classes.copy()
        for i, to in profiles.mapInArrow(steady(run), "i int, to int").collect():
            out[i] = to
        return out

    done = CLASSES
    while done < len(ranked):
        who = np.zeros(ITEMS, bool)
        who[ranked[done : 2 * done]] = True
        classes, done = moves(classes, table(classes), who), 2 * done
    t = table(classes)
    idle = 0
    for turn in range(rounds):
        who = (np.arange(ITEMS) * 2654435761 >> 8) % 4 == turn % 4
        who[END] = False
        tried = moves(classes, t, who & (classes != REST))
        moved = np.flatnonzero(tried != classes)
        while len(moved):  # what is too much at once is halved
            after = table(tried)
            if _likelihood(after) > _likelihood(t):
                classes, t = tried, after
                break
            tried = tried.copy()
            tried[moved[::2]] = classes[moved[::2]]
            moved = moved[1::2]
        idle = 0 if len(moved) else idle + 1
        if idle == 4:
            break
    classes[classes == REST] = 0  # items that never were in a bigram
    return classes, t[: CLASSES + 1, : CLASSES + 1]


def own_classes(docs: DataFrame, known: dict[bytes, int], classes: np.ndarray, table: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The class of each of the ``known`` words (numbered by rank), and the counts of class bigrams after the words' moves.

    Words beyond ``FREQUENT`` are moved by the classes beside them before anyone moves; counts between two that move follow each once.
    """
    first = np.array([k if k < FREQUENT else _ending(w) for w, k in known.items()] + [END])
    at = classes[first]
    width = CLASSES + 2  # the last: the word itself
    shared = docs.sparkSession.sparkContext.broadcast((known, at, classes, table))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, classes, _ = shared.value
        held, size = [], 0

        def out() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((codes // (2 * width)).astype(np.int32)), pa.array((codes % (2 * width)).astype(np.int32)), pa.array(n)], ["w", "slot", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = _words(text.as_py())
                ids = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                mine = np.flatnonzero(ids >= FREQUENT)
                if len(mine):
                    cls = at[ids]
                    rare = np.flatnonzero(ids < 0)
                    cls[rare] = classes[[_ending(words[k]) for k in rare.tolist()]]
                    around, names = np.concatenate([[CLASSES], cls, [CLASSES]]), np.concatenate([[-2], ids, [-2]])
                    for side, step in ((0, 0), (1, 2)):
                        beside = np.where(names[mine + step] == ids[mine], CLASSES + 1, around[mine + step])
                        held.append(ids[mine] * (2 * width) + side * width + beside)
                    size += 2 * len(mine)
                if size > TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, at, _, table = shared.value
        delta = np.zeros_like(table)

        def settle(rows: np.ndarray) -> pa.RecordBatch:
            words, nth = np.unique(rows[:, 0], return_inverse=True)
            counts = np.zeros((len(words), 2 * width))
            np.add.at(counts, (nth, rows[:, 1]), rows[:, 2])
            here, k = at[words], np.arange(len(words))
            left, right = counts[:, : CLASSES + 1].copy(), counts[:, width : width + CLASSES + 1].copy()
            own = counts[:, CLASSES + 1]
            left[k, here] += own
            right[k, here] += own
            gains = _first_order(left, right, here, table)[:, :CLASSES]
            to = gains.argmax(axis=1)
            moved = np.flatnonzero(gains[k, to] > gains[k, here] + 1e-6)
            for place, sign in ((here, -1), (to, 1)):
                np.add.at(delta.T, place[moved], sign * left[moved])
                np.add.at(delta, place[moved], sign * right[moved])
            return pa.RecordBatch.from_arrays([pa.array(words[moved].astype(np.int32)), pa.array(to[moved].astype(np.int32)), pa.nulls(len(moved), pa.list_(pa.float64()))], ["w", "to", "delta"])

        held, size = [np.zeros((0, 3), np.int64)], 0
        for batch in batches:  # sorted by word
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size > 200_000:
                rows = np.concatenate(held)
                end = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if end:
                    yield settle(rows[:end])
                held, size = [rows[end:]], len(rows) - end
        rows = np.concatenate(held)
        if len(rows):
            yield settle(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([delta.ravel().tolist()], pa.list_(pa.float64()))], ["w", "to", "delta"])

    if len(known) <= FREQUENT:
        return at, table
    rows = docs.select(text_col).mapInArrow(steady(profile), "w int, slot int, n bigint")
    at, table = at.copy(), table.copy()
    for w, to, delta in rows.repartition("w").sortWithinPartitions("w").mapInArrow(steady(move), "w int, to int, delta array<double>").collect():  # KNOWN rows and one of each task
        if delta is None:
            at[w] = to
        else:
            table += np.array(delta).reshape(table.shape)
    return at, np.maximum(table, 0)


class Model:
    """All a task needs to score: tables of bounded size, and the most frequent words with their counts."""

    def __init__(self, words: list[tuple[bytes, int]], ends: int, total: int, kinds: int, groups: dict[int, tuple[int, int, int]], classes: np.ndarray, own: np.ndarray, table: np.ndarray):
        """groups: of each ending, its tokens and words outside ``words``, and how many words with it were seen once."""
        self.known = {w: k for k, (w, _) in enumerate(words)}
        self.total, self.size = total, total + 0.1 * (kinds + 1)
        counts = np.array([n for _, n in words] + [ends], float)  # the end comes last
        self.classes, self.cls = classes, own
        self.in_class = np.bincount(own, counts + 0.5, minlength=CLASSES + 1)
        for g in range(FREQUENT, END):
            tokens, others, once = groups.get(g, (0, 0, 0))
            self.in_class[classes[g]] += tokens + 0.5 * others + 0.5 * (once + 1)
        after = table.sum(axis=0) + 1
        self.trans = (table + 50 * after / after.sum()) / (table.sum(axis=1, keepdims=True) + 50)
        self.emit = (counts + 0.5) / self.in_class[own]
        self.unigram = (counts + 0.1) / self.size
        self.is_known = counts > 0

    def score(self, texts: list[str | None], weight: float) -> tuple[np.ndarray, list[int], list[bytes], np.ndarray]:
        """For each text (tokens, known, base, score) over its known words; then for each other token its text, word and factor.

        The factor times c + 0.5 is the class model's part of a token's probability.
        """
        words, last = [_words(t) for t in texts], len(self.known)
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes)
        flat = list(chain.from_iterable(chain(w, (None,)) for w in words))
        ids = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        ids[ends - 1] = last
        rare = np.flatnonzero(ids < 0)
        cls = self.cls[ids]
        cls[rare] = self.classes[np.array([_ending(flat[k]) for k in rare], np.int64)]
        before = np.concatenate([[CLASSES], cls[:-1]])  # a text begins after an end
        trans = weight * self.trans[before, cls]
        p = trans * self.emit[ids] + (1 - weight) * self.unigram[ids]
        base, score, known = np.log10(self.unigram[ids]), np.log10(p), self.is_known[ids].astype(float)
        for x in (base, score, known):
            x[rare] = 0
        sums = np.column_stack([sizes, *(np.add.reduceat(x, ends - sizes) for x in (known, base, score))])
        return sums, np.searchsorted(ends, rare, side="right").tolist(), [flat[k] for k in rare], trans[rare] / self.in_class[cls[rare]]


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model learned from all rows of ``docs``, and the table of word counts (word BINARY, n LONG)."""
    counts = cut(word_counts(docs, text_col))
    ends = docs.count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = counts.filter(F.octet_length("word") <= LONGEST)
    # The least count that so few words exceed, so that only these words are gathered.
    least, many, size = 0, 0, 0
    for n, words_of_n, bytes_of_n in short.groupBy("n").agg(F.count("*"), F.sum(F.octet_length("word"))).orderBy(F.desc("n")).limit(KNOWN + 1).collect():
        many, size = many + words_of_n, size + bytes_of_n
        if many > KNOWN or size > KNOWN_BYTES:
            least = n
            break
    words = sorted(((bytes(r.word), r.n) for r in short.filter(F.col("n") > least).collect()), key=lambda x: (-x[1], x[0]))
    known = {w: k for k, (w, _) in enumerate(words)}
    top = docs.sparkSession.sparkContext.broadcast(known)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((3, ITEMS), np.int64)
        for batch in batches:
            for word, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = _ending(word)
                if word not in top.value:
                    n[:2, g] += many, 1
                n[2, g] += many == 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x[some]) for x in n)], ["g", "n", "others", "once"])

    groups = counts.mapInArrow(steady(group), "g int, n bigint, others bigint, once bigint").groupBy("g").agg(F.sum("n"), F.sum("others"), F.sum("once")).collect()
    classes, table = exchange(cut(item_bigrams(docs, {w: k for w, k in known.items() if k < FREQUENT}, text_col)))
    own, table = own_classes(docs, known, classes, table, text_col)
    return Model(words, ends, total + ends, kinds + (ends > 0), {g: tuple(n) for g, *n in groups}, classes, own, table), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, weight: float = SHARE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, n_tokens, n_known LONG, base_score, score DOUBLE) of each whole text: log10 probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "hash", "sums", "word", "factor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sums, of, words, factors = shared.value.score(part.column(2).to_pylist(), weight)
                none = part.num_rows
                index = pa.array([*range(none), *of], pa.int64())
                # A text's own row goes through the join under a name that no word has, so that these rows spread.
                own = [b" " + h.to_bytes(8, "little", signed=True) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(index), part.column(1).take(index), pa.array([*sums.tolist(), *[None] * len(of)], pa.list_(pa.float64())),
                    pa.array([*own, *words], pa.binary()), pa.array([*[None] * none, *factors.tolist()], pa.float64()),
                ], names)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), text_col).mapInArrow(steady(run), f"id {kind}, hash bigint, sums array<double>, word binary, factor double")
    plain = F.lit((1 - weight) / model.size)
    c = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    joined = rows.join(counts, "word", "left")
    token = F.col("factor").isNotNull()
    known = F.when(token, F.col("n").isNotNull().cast("double")).otherwise(F.col("sums")[1])
    base = F.when(token, F.log10((c + 0.1) / model.size)).otherwise(F.col("sums")[2])
    mixed = F.when(token, F.log10(F.col("factor") * (c + 0.5) + plain * (c + 0.1))).otherwise(F.col("sums")[3])
    out = joined.select("id", "hash", F.col("sums")[0].alias("n_tokens"), known.alias("n_known"), base.alias("base"), mixed.alias("score")).groupBy("id", "hash").agg(
        F.count("n_tokens").alias("rows"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    each = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    per = lambda x: F.col(x) / F.col("rows")
    return each.select(F.col("id").alias(id_col), F.round(per("n_tokens")).cast("long").alias("n_tokens"), F.round(per("n_known")).cast("long").alias("n_known"), per("base").alias("base_score"), per("score").alias("score"))
