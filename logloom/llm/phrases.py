"""Collocations: phrases whose words come together more often than apart, counted with HAT-tries.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words at spaces and tabs; all counts are kept by language.
Phrases of k words are counted in one pass for each k. A task numbers its words and puts phrases, as packed numbers, into a
HAT-trie: hash containers for ranges of first words, which burst into two when they are full, and into a node over the next word
where a single word fills one. At its bound the trie spills its largest subtrees whole, as sorted runs. The runs are written, then range-partitioned by phrase,
so that a partition is a range of prefixes, however hot one is, and merged there by adding up.

A phrase can be frequent only if its parts are, so the pass for k words skips what the pass before has not found frequent. Tasks know this from
a bit filter of fixed size: hashes that fall together let rare phrases pass, which the merged counts then remove. Counts are exact.

A null text counts as empty and a null language as ``und``. Repeated rows and null ids count like others; ties are ranked by count and
then by phrase in byte order. Without rows, or frequent phrases, the result is empty. Other columns are ignored. Counts must stay below 10^16.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .shared import cut, partitions, steady

#: Separators of pieces, as bytes.
SEPARATORS = b".,;:!?\n\v\f\r"
#: Bits of a word's number, of which a phrase has three at most.
WORD_BITS, MOST_WORDS = 21, 3
#: Phrases of a container, phrases of a trie, words that a task numbers and words that are looked at together.
BURST, PHRASES, WORDS, TOGETHER = 1 << 14, 1_000_000, 400_000, 1_000_000
#: Rows, or bytes of text, whose phrases are added up before they go into the trie.
ROWS_BYTES = 5_000, 8_000_000
#: Bits of the filters that a pass leaves for the next one: 8 MB each.
FILTER_BITS = 1 << 26
#: Into so many parts the candidates of a language are dealt before its best are ranked.
DEALT = 64

_END = b"\xff"  # stands for an end of a piece, and is in no UTF-8 text
_FOLD = bytes(0xFF if b in SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Node:
    """Children for ranges of a symbol: hash containers, or nodes over the next symbol."""

    def __init__(self, shift: int, low: int, container: dict[int, int]):
        self.shift, self.lows, self.children, self.size = shift, [low], [container], len(container)

    def add(self, keys: np.ndarray, many: np.ndarray) -> None:
        """Adds ``many`` to the counts of sorted ``keys``."""
        cuts = [0, *np.searchsorted(keys, self.lows[1:]).tolist(), len(keys)]
        for k in range(len(cuts) - 2, -1, -1):  # from the right, as a burst puts a child behind its own
            if cuts[k] < cuts[k + 1]:
                self._add_to(k, keys[cuts[k] : cuts[k + 1]], many[cuts[k] : cuts[k + 1]])
        self.size = sum(c.size if isinstance(c, Node) else len(c) for c in self.children)

    def _add_to(self, k: int, keys: np.ndarray, many: np.ndarray) -> None:
        child = self.children[k]
        if isinstance(child, Node):
            child.add(keys, many)
            return
        get = child.get
        for key, n in zip(keys.tolist(), many.tolist()):
            child[key] = get(key, 0) + n
        if len(child) > BURST:
            self._burst(k)

    def _burst(self, k: int) -> None:
        """Halves a container at the first key of a symbol, or puts a node in the place of one that a symbol has for itself."""
        child = self.children[k]
        keys = np.sort(np.fromiter(child, np.int64, len(child)))
        symbols = keys >> self.shift
        middle = symbols[len(symbols) // 2]
        if middle == symbols[0]:
            middle = symbols[np.searchsorted(symbols, middle, side="right") % len(symbols)]
        if middle == symbols[0]:
            self.children[k] = Node(self.shift - WORD_BITS, int(keys[0]), child)
            self.children[k]._burst(0)
            return
        low = int(middle) << self.shift
        self.children[k : k + 1] = [{x: n for x, n in child.items() if x < low}, {x: n for x, n in child.items() if x >= low}]
        self.lows.insert(k + 1, low)
        for at in (k + 1, k):
            if len(self.children[at]) > BURST:
                self._burst(at)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, sorted, with their counts."""
        parts = [c.items() if isinstance(c, Node) else _sorted(c) for c in self.children]
        return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])

    def spilled(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The largest subtrees, taken out until at most ``least`` phrases stay, each as a sorted run."""
        size = lambda k: self.children[k].size if isinstance(self.children[k], Node) else len(self.children[k])
        for k in sorted(range(len(self.children)), key=size, reverse=True):
            if self.size <= least:
                break
            child = self.children[k]
            self.size -= size(k)
            self.children[k] = {}
            yield child.items() if isinstance(child, Node) else _sorted(child)


def _sorted(container: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys, many = np.fromiter(container, np.int64, len(container)), np.fromiter(container.values(), np.int64, len(container))
    order = np.argsort(keys)
    return keys[order], many[order]


class _Numbers(dict):
    """Numbers of words from 1 on, given as they come; an end of a piece has 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Filter:
    """A bit for the hash of each frequent phrase of one or two words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(FILTER_BITS - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two words from their own."""
    return (left << np.uint64(7) | left >> np.uint64(57)) ^ right


def split(text: bytes) -> pa.Array:
    """The words of ``text`` between ASCII white space, as bytes; no object is made for any of them."""
    text = text.strip()
    if not text:
        return pa.array([], pa.large_binary())
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)])
    return pc.ascii_split_whitespace(whole).flatten().view(pa.large_binary())


class Counter:
    """Counts the phrases of ``n`` words of a task's texts."""

    def __init__(self, n: int, frequent: Filter | None):
        self.n, self.frequent = n, frequent
        self._reset()

    def _reset(self) -> None:
        self.trie = Node(WORD_BITS * (self.n - 1), 0, {})
        self.numbers: dict[str, _Numbers] = {}
        self.words: list[tuple[str, bytes]] = []
        self.hashes = np.zeros(0, np.uint64)

    def _number(self, lang: str, words: pa.Array) -> np.ndarray:
        """Numbers over all languages, and 0 for ends of pieces; each distinct word is looked up once."""
        own = self.numbers.setdefault(lang, _Numbers({_END: 0}))
        before, told = len(own), words.dictionary_encode()
        distinct = told.dictionary.to_pylist()
        local = np.fromiter(map(own.__getitem__, distinct), np.int64, len(distinct))[told.indices.to_numpy()]
        if not hasattr(own, "places"):
            own.places = np.zeros(1, np.int64)
        if len(own) > before:
            new = [*own][before:]
            own.places = np.append(own.places, np.arange(len(new)) + len(self.words) + 1)
            self.words += [(lang, w) for w in new]
            if self.frequent:
                seed = xxhash.xxh64_intdigest(lang.encode(), 42)
                self.hashes = np.append(self.hashes, np.array([xxhash.xxh64_intdigest(w, seed) for w in new], np.uint64))
        return own.places[local]

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        words = split(_END.join(texts).translate(_FOLD).replace(_END, b" \xff "))
        n = self.n
        for k in range(0, len(words), TOGETHER):
            ids = self._number(lang, words[k : k + TOGETHER + n - 1])
            starts = len(ids) - n + 1
            if starts > 0:
                parts = [ids[j : j + starts] for j in range(n)]
                good = np.logical_and.reduce([p > 0 for p in parts])
                good[TOGETHER:] = False
                if n == 2:
                    fine = np.append(False, self.frequent.holds(self.hashes))
                    good &= fine[parts[0]] & fine[parts[1]]
                elif n == 3:
                    at = np.flatnonzero(good)
                    a, b, c = (self.hashes[p[at] - 1] for p in parts)
                    good[at] = self.frequent.holds(joined(a, b)) & self.frequent.holds(joined(b, c))
                key = parts[0][good]
                for p in parts[1:]:
                    key = key << WORD_BITS | p[good]
                self.trie.add(*np.unique(key, return_counts=True))
            if len(self.words) > WORDS:
                yield from self.spill(0)
            elif self.trie.size > PHRASES:
                yield from self.spill(PHRASES // 2)

    def spill(self, least: int) -> Iterator[pa.RecordBatch]:
        self.named = pa.array([lang for lang, _ in self.words], pa.string()), pa.array([w for _, w in self.words], pa.binary())
        for keys, many in self.trie.spilled(least):
            for k in range(0, len(keys), 50_000):
                yield self._run(keys[k : k + 50_000], many[k : k + 50_000])
        if not least:
            self._reset()

    def _run(self, keys: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        mask, (langs, words) = (1 << WORD_BITS) - 1, self.named
        places = [(keys >> WORD_BITS * k & mask) - 1 for k in range(self.n - 1, -1, -1)]
        parts = [words.take(pa.array(x)) for x in places]
        phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if self.n > 1 else parts[0]
        return pa.RecordBatch.from_pydict({"lang": langs.take(pa.array(places[0])), "phrase": phrases.cast(pa.string()), "n": pa.array(many)})


def runs(docs: DataFrame, n: int, frequent: Filter | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, n): the written sorted runs of all tasks, whose numbers of a phrase add up to its count.

    For two and three words ``frequent`` is the filter of frequent words or pairs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(n, shared.value)
        for batch in batches:
            for part in slices(batch, "text", *ROWS_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    by_lang.setdefault(lang, []).append((text or "").encode())
                for lang, texts in by_lang.items():
                    yield from counter.add(lang, texts)
        yield from counter.spill(0)

    narrow = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return cut(narrow.mapInArrow(steady(run), "lang string, phrase string, n bigint"))


def merged(written: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases counted ``least`` times or more, from runs; each partition adds up a range of prefixes."""
    ranged = written.repartitionByRange(partitions(written.sparkSession), "lang", "phrase")
    return cut(ranged.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def word(k: int, phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")[k]


def filter_of(frequent: DataFrame, n: int) -> Filter:
    """The bit filter of merged phrases of ``n`` words, one or two; gathered as Arrow columns of at most ``FILTER_BITS`` bits and their places,
    without an object for any row."""
    at = F.xxhash64("lang", word(0))
    if n == 2:
        at = F.shiftleft(at, 7).bitwiseXOR(F.shiftrightunsigned(at, 57)).bitwiseXOR(F.xxhash64("lang", word(1)))
    bits = frequent.select(at.bitwiseAND(FILTER_BITS - 1).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    rows = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def counts(docs: DataFrame, words: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the words of each language, and for k = 1 to ``words`` the phrases of k words that occur ``least`` times or more."""
    if not 2 <= words <= MOST_WORDS:
        raise ValueError(f"phrases of 2 to {MOST_WORDS} words")
    first = runs(docs, 1, None, text_col, lang_col)
    out = [merged(first, least)]
    for n in range(2, words + 1):
        out.append(merged(runs(docs, n, filter_of(out[-1], n - 1), text_col, lang_col), least))
    return first.groupBy("lang").agg(F.sum("n").alias("n")), out


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact whole numbers."""
    big = lambda c: F.col(c).cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def candidates(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more among ``counts``, by the lowest-scoring cut, the first of equals;
    without those that a longer one contains which has half their count or more."""
    out, longer = [], None
    for k in range(len(found), 1, -1):
        rows = found[k - 1].withColumnRenamed("n", "a")
        if longer is not None:
            rows = rows.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < 50 * F.col("a"))).drop("most")
        for at in range(1, k):
            for side, sub, size in (("l", (0, at), at), ("r", (at, k), k - at)):
                part = F.array_join(F.slice(F.split("phrase", " "), sub[0] + 1, size), " ")
                known = found[size - 1].select("lang", F.col("phrase").alias("_part"), F.col("n").alias(f"_{side}{at}"))
                rows = rows.withColumn("_part", part).join(known, ["lang", "_part"]).drop("_part")
        scored = rows.withColumns({f"_s{at}": _score("a", f"_l{at}", f"_r{at}") for at in range(1, k)})
        best = F.array_min(F.array(*[F.struct(F.col(f"_s{at}").alias("score"), F.lit(at).alias("at"), F.col(f"_l{at}").alias("l"), F.col(f"_r{at}").alias("r")) for at in range(1, k)]))
        out.append(scored.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
        inside = [F.array_join(F.slice(F.split("phrase", " "), j + 1, k - 1), " ") for j in range(2)]
        shorter = found[k - 1].select("lang", F.explode(F.array(*inside)).alias("phrase"), "n")
        longer = shorter.groupBy("lang", "phrase").agg(F.max("n").alias("most")) if k > 2 else None
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    return every


def top(every: DataFrame, totals: DataFrame, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best candidates of each language by score, count and phrase.

    Candidates are dealt into parts first, whose best are then ranked together, so that no task sorts a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = every.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    held = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= most)
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, words: int = 3, least: int = 10, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language, see ``top``."""
    totals, found = counts(docs, words, least, text_col, lang_col)
    return top(candidates(found), totals, most)
