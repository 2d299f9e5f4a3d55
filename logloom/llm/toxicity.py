"""Toxicity by a noisy channel: obfuscated spellings are restored, then the restored text is scored.

A character trigram model is counted over all documents. A token that holds leetspeak, inner separators or a letter three
times in a row, of any length, and any run of three or more single characters that are letters or leetspeak, with any white
space between them and a letter among them, becomes a lattice: each character can stand for the letters it may hide, for
itself or, if it separates or repeats, for nothing. Viterbi finds the path that the channel and the character
model like best. The restored tokens then give evidence: a word and its beginnings weigh their log odds between toxic and other
documents, less ``Z`` standard errors. A document's strongest pieces of evidence enter a logistic model.

Learning reads at most ``LABELLED`` labelled rows, chosen by a hash of their id; the character counts read all documents.
A null text counts as empty and gets the score of no evidence. Without a label of either kind every score is 0.
"""

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, steady

#: Labelled rows that the classifier learns from at most.
LABELLED = 20_000
#: Standard errors that evidence must exceed.
Z = 1.64
#: Toxic documents that a piece of evidence must be in. One is taken out of its own evidence in learning, so one alone shows nothing.
LEAST = 2
#: Lengths of the beginnings of words that are evidence of their own.
STEMS = (4, 5, 6, 7)
TOP = 5
MEMO = 300_000

# Letters that a character may hide.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'^`/\\,"

#: Symbols of the character model: a-z, any other letter, the border of words.
OTHER, BORDER, SYMBOLS = 26, 27, 28
#: Log probabilities of the channel.
HIDDEN, DROPPED, DIGIT, REPEATED, SPACED, BROKEN = -1.0, -3.0, -9.0, -0.5, -0.2, -2.0

_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SINGLE = rf"(?:[^\W\d_]|[{re.escape(''.join(LEET))}])"
_SINGLES = re.compile(rf"(?<!\S)(?:{_SINGLE}\s++){{2,}}{_SINGLE}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")
_EDGE = "\"#%&()*,-./:;<=>?[]^_`{}~'"


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    out = np.full(len(points), BORDER, np.int64)
    out[points >= 128] = OTHER
    letter = (points >= 97) & (points <= 122)
    out[letter] = points[letter] - 97
    return out


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram INT, n LONG): counts of character trigrams over all texts, at most 28 cubed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    c = np.concatenate([[BORDER, BORDER], _codes(text), [BORDER]])
                    n += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["gram", "n"])

    return docs.select(text_col).mapInArrow(steady(run), "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi decoding of one token's lattice under a character trigram model."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        bi = tri.sum(axis=0)
        low = (bi + 1) / (bi + 1).sum(axis=1, keepdims=True)
        p = (tri + 5 * low[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.cost = np.log(p).tolist()

    def _options(self, text: str, at: int) -> list[tuple[str, float]]:
        """What a character may stand for, each with its log probability. A space stands for a border or nothing."""
        c = text[at]
        if c == " ":
            return [("", SPACED), (" ", BROKEN)]
        out = [(letter, HIDDEN) for letter in LEET.get(c, "")]
        if c.isalpha():
            out.append((c, 0.0))
            if at and text[at - 1] == c:
                out.append(("", REPEATED))
        elif c in SEPARATORS:
            out.append(("", HIDDEN))
        else:
            out.append(("", DIGIT if c.isdigit() else DROPPED))
        return out

    def restore(self, text: str) -> str:
        # A path is its last letter and the path before it, so that long texts stay linear.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(BORDER, BORDER): (0.0, None)}
        for at in range(len(text)):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self._options(text, at)
            for (a, b), (score, out) in best.items():
                row = self.cost[a][b]
                for letter, p in options:
                    if letter:
                        s = BORDER if letter == " " else ord(letter) - 97 if "a" <= letter <= "z" else OTHER
                        key, total, grown = (b, s), score + p + row[s], (letter, out)
                    else:
                        key, total, grown = (a, b), score + p, out
                    if key not in step or total > step[key][0]:
                        step[key] = (total, grown)
            best = step
        ends = [(score + self.cost[a][b][BORDER], out) for (a, b), (score, out) in best.items()]
        most = max(score for score, _ in ends)
        return max(self._spelled(out) for score, out in ends if score == most)

    @staticmethod
    def _spelled(path: tuple | None) -> str:
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))


class Model:
    """The character model, the weight of each piece of evidence and the logistic model; all of bounded size."""

    def __init__(self, counts: np.ndarray):
        self.restorer = Restorer(counts)
        self.facts: dict[str, tuple[int, int]] = {}
        self.classes = (0, 0)
        self.beta: np.ndarray | None = None
        self.words: dict[str, tuple[str, ...]] = {}
        self.weights: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"words": {}, "weights": {}}

    def forget(self) -> None:
        """Drops what was remembered, at the end of a task: a broadcast model outlives it in the worker."""
        self.words, self.weights = {}, {}

    def _word(self, token: str) -> tuple[str, ...]:
        """The restored words of a token."""
        core = token.strip(_EDGE)
        if not core:
            return ()
        odd = not core.isalpha()
        if not _LETTER.search(core):
            return (core,)
        if odd or _TRIPLE.search(core):
            core = self.restorer.restore(core)
        return (core,) if core else ()

    def tokens(self, text: str) -> set[str]:
        """The distinct words of a text, after restoring."""
        text = text.lower()
        found = set(text.split())
        for run in _SINGLES.findall(text):
            if _LETTER.search(run):
                found.update(self.restorer.restore(" ".join(run.split())).split())
        words, out = self.words, set()
        if len(words) > MEMO:
            words.clear()
        for t in found:
            w = words.get(t)
            if w is None:
                w = words[t] = self._word(t)
            out.update(w)
        return out

    @staticmethod
    def pieces(word: str) -> list[str]:
        return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]

    def _odds(self, toxic: int, other: int) -> float:
        t, o = self.classes
        return log((toxic + 0.5) / (t + 1)) - log((other + 0.5) / (o + 1)) - Z * sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))

    def _weight(self, word: str, toxic: int, other: int) -> float:
        """The word's strongest piece of evidence; a document that was learned from is taken out of the counts first."""
        found = [self.facts[p] for p in self.pieces(word) if p in self.facts]
        return max([0.0, *[self._odds(a - toxic, b - other) for a, b in found if a > toxic or not toxic]])

    def evidence(self, text: str, label: int | None = None) -> list[float]:
        own, memo, weights = (int(label == 1), int(label == 0)), self.weights, []
        if len(memo) > MEMO:
            memo.clear()
        tokens = self.tokens(text)
        for word in tokens:
            if label is not None:
                w = self._weight(word, *own)
            elif (w := memo.get(word)) is None:
                w = memo[word] = self._weight(word, 0, 0)
            if w:
                weights.append(w)
        top = nlargest(TOP, weights) + [0.0] * TOP
        return [1.0, top[0], top[1], sum(top[2:TOP]), log(1 + len(tokens)), top[0] * log(1 + len(tokens)), len(weights) / (1 + len(tokens))]

    def score(self, text: str) -> float:
        if self.beta is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.evidence(text), self.beta), -500, 500))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
    return beta


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learn from the rows of ``labels`` (``id_col``, ``label_col``) that ``learn`` keeps; null labels teach nothing."""
    spark = docs.sparkSession
    counts = np.zeros(SYMBOLS**3, np.int64)
    for gram, n in character_counts(docs, text_col).collect():
        counts[gram] = n
    model = Model(counts)
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(F.lit(True) if learn is None else learn)
    chosen = cut(rows.select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_label").limit(LABELLED))
    train = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_label"))
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {p for w in shared.value.tokens(text or "") for p in Model.pieces(w)}
                (toxic if label else other).update(found)
            names = [*toxic.keys() | other.keys()]
            shared.value.forget()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([other[x] for x in names], pa.int64())], ["piece", "toxic", "other"])

    many = dict(train.groupBy("_label").count().collect())
    model.classes = many.get(1, 0), many.get(0, 0)
    if not all(model.classes):
        return model
    odds = F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5)) + log((model.classes[1] + 1) / (model.classes[0] + 1)) - Z * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    pieces = train.mapInArrow(steady(count), "piece string, toxic bigint, other bigint").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    model.facts = {p: (a, b) for p, a, b in pieces.filter((F.col("toxic") >= LEAST) & (odds > 0)).collect()}
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.evidence(t or "", y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            shared.value.forget()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = train.mapInArrow(steady(measure), "x array<double>, y int").collect()
    model.beta = _logistic(np.array([r.x for r in got]), np.array([float(r.y) for r in got]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: how likely each whole text is toxic. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema if f.name != score_col] + [T.StructField(score_col, T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                scores = pa.array([shared.value.score(t.as_py() or "") for t in batch.column(text_col)], pa.float64())
                columns = {n: batch.column(n) for n in batch.schema.names} | {score_col: scores}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)
        finally:
            shared.value.forget()

    return docs.mapInArrow(steady(run), schema)
