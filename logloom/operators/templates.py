"""Message templates after He et al., Drain, 2017: greedy clusters of terms with equal length and first tokens.

A leaf of the tree is a length and the first ``depth`` - 3 tokens, those with digits being wild. Leaves are independent of each
other, so Spark deals them out; inside a leaf terms come one after the other, the most frequent first, and the task holds no more than the
leaf's templates. A greater depth splits hot leaves. Other than in the paper a node has children without bound.
"""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import with_rank

WILD = "<*>"
#: Bytes of templates up to which all tasks get a trie of them; beyond, terms and templates are joined by leaf.
TRIE_BYTES = 16_000_000
#: Templates of a leaf below which a term is compared with all of them: that takes less than to look for those near it.
FEW = 3_000
#: Templates of finished leaves that a task holds before it hands them on.
OUT = 5_000


def _keys(term: Column, depth: int) -> dict[str, Column]:
    tokens = F.split(F.trim(term), r"\s+")
    first = F.transform(F.slice(tokens, 1, depth - 3), lambda t: F.when(t.rlike(r"\d"), WILD).otherwise(t))
    return {"tokens": tokens, "n_tokens": F.size(tokens), "head": F.array_join(first, " ")}


class Leaf:
    """The templates of terms of one length, as rows of token numbers of which 0 is wild.

    A term is compared only with templates that can be as similar as asked. ``least`` equal tokens of ``length`` leave out no more than
    ``length`` - ``least`` places, so that such a template opened with the term's token at one of any ``length`` - ``least`` + 1 places:
    those whose tokens the fewest templates opened with. Tokens only turn wild later, so the lists lack none.
    """

    def __init__(self, length: int, similarity: float):
        self.n, self.length = 0, length
        self.least = next((e for e in range(length + 1) if e / length >= similarity), length + 1)
        self.first: list[str] | None = None  # a leaf's only term needs no tables
        self.codes: dict[str, int] = {}

    def _near(self, codes: list[int]) -> np.ndarray:
        """The numbers of all templates with ``least`` tokens of a term or more, and some others, ascending."""
        if self.least > self.length:
            return np.zeros(0, np.int64)
        if self.least == 0 or self.n < FEW:
            return np.arange(self.n)
        lists = sorted((at.get(c, ()) for at, c in zip(self.opened, codes)), key=len)[: self.length - self.least + 1]
        held = [np.frombuffer(x, np.int32) for x in lists if len(x)]
        return np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)

    def add(self, tokens: list[str]) -> None:
        """A term joins the most similar template, of equals the one with the most wild tokens and then the first; or it opens one."""
        if self.first is None:
            self.first, self.n = tokens, 1
            return
        if not self.codes:
            self.codes[WILD] = 0
            self.found = np.zeros((4, self.length), np.int32)
            self.opened: list[dict[int, array]] = [{} for _ in range(self.length)]
            self.n = 0
            self._insert(self.first)
        self._insert(tokens)

    def _insert(self, tokens: list[str]) -> None:
        codes, n = [self.codes.setdefault(t, len(self.codes)) for t in tokens], self.n
        row, near = np.array(codes, np.int32), self._near(codes)
        if len(near):
            rows = self.found[near]
            wild = rows == 0
            equal = ((rows == row) & ~wild).sum(axis=1)
            best = int((equal * (len(row) + 1) + wild.sum(axis=1)).argmax())
            if equal[best] >= self.least:
                k = near[best]
                self.found[k][self.found[k] != row] = 0
                return
        if n == len(self.found):
            self.found = np.concatenate([self.found, np.zeros_like(self.found)])
        self.found[n] = row
        for at, code in zip(self.opened, codes):
            if code:
                at.setdefault(code, array("i")).append(n)
        self.n += 1

    def templates(self) -> list[list[str]]:
        if not self.codes:
            return [self.first]
        names = list(self.codes)
        return [[names[c] for c in row] for row in self.found[: self.n].tolist()]


_TEMPLATES = "n_tokens int, head string, nth int, template array<string>"


def fit_templates(freq: DataFrame, similarity: float = 0.4, depth: int = 4) -> DataFrame:
    """(n_tokens, head, nth, template ARRAY<STRING>) from (term, term_id, freq), most frequent terms first, ties by id.

    A term joins the most similar cluster of its leaf if the share of equal tokens reaches ``similarity``, else it opens one;
    where tokens differ the template turns wild. ``depth`` is at least 3, which leaves leaves of all terms of a length.
    """
    rows = freq.filter("freq > 0").withColumns(_keys(F.col("term"), depth)).select("n_tokens", "head", F.col("freq").cast("long").alias("freq"), F.col("term_id").cast("long").alias("term_id"), "tokens")

    types = {"n_tokens": pa.int32(), "head": pa.string(), "nth": pa.int32(), "template": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaf, held = None, None, ([], [], [], [])

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({c: pa.array(x, t) for (c, t), x in zip(types.items(), held)})
            for x in held:
                x.clear()
            return batch

        def end() -> None:
            for nth, template in enumerate(leaf.templates()):
                for x, v in zip(held, (*key, nth, template)):
                    x.append(v)

        for batch in batches:  # sorted by leaf, so that one is held at a time
            for *here, tokens in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "head", "tokens"))):
                if here != key:
                    if leaf:
                        end()
                        if len(held[0]) >= OUT:
                            yield out()
                    key, leaf = here, Leaf(here[0], similarity)
                leaf.add(tokens)
        if leaf:
            end()
            yield out()

    return rows.repartition("n_tokens", "head").sortWithinPartitions("n_tokens", "head", F.desc("freq"), "term_id").mapInArrow(run, _TEMPLATES)


class Trie:
    """Templates by their leaf and token after token, a wild child beside the others."""

    def __init__(self, rows: list[tuple[int, str, int, list[str]]]):
        self.leaves: dict[tuple[int, str], dict] = {}
        for n, head, nth, template in rows:
            node = self.leaves.setdefault((n, head), {})
            for token in template:
                node = node.setdefault(token, {})
            node[None] = min(nth, node.get(None, nth))

    def match(self, head: str, tokens: list[str]) -> int | None:
        """The nth of the matching template with the fewest wild tokens, of equals the first.

        All ways through the trie are followed at once, token by token; each keeps how many wild tokens it has passed.
        """
        ways = [(self.leaves.get((len(tokens), head)), 0)]
        if ways[0][0] is None:
            return None
        for token in tokens:
            ways = [(node[t], wild + (t == WILD)) for node, wild in ways for t in {token, WILD} if t in node]
        return min(((wild, node[None]) for node, wild in ways), default=(0, None))[1]


def match_templates(terms: DataFrame, templates: DataFrame, depth: int = 4, trie_bytes: int | None = None) -> DataFrame:
    """``terms`` with n_tokens, head, nth: the matching template with the fewest wild tokens, of equals the first, or nulls.

    A template matches if it equals the term token for token but where it is wild. Templates of at most ``trie_bytes``
    (``TRIE_BYTES``), which is measured first, go to all tasks as a trie; more are joined with the terms by leaf. Both give the same.
    """
    limit = TRIE_BYTES if trie_bytes is None else trie_bytes
    templates = templates.select("n_tokens", "head", "nth", "template")
    size = templates.agg(F.coalesce(F.sum(F.length("head") + F.aggregate("template", F.lit(64), lambda n, t: n + F.length(t) + 8)), F.lit(0))).first()[0]
    rows = terms.withColumns(_keys(F.col("term"), depth))
    if size <= limit:
        trie = terms.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in templates.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = trie.value.match
            for batch in batches:
                found = [None if t is None else match(h, t) for h, t in zip(batch.column("head").to_pylist(), batch.column("tokens").to_pylist())]
                yield batch.drop_columns(["tokens"]).append_column("nth", pa.array(found, pa.int32()))

        matched = rows.mapInArrow(run, rows.drop("tokens").withColumn("nth", F.lit(None).cast("int")).schema)
        hit = F.col("nth").isNotNull()
        return matched.withColumns({c: F.when(hit, F.col(c)) for c in ("n_tokens", "head")})
    rows = rows.withColumnRenamed("head", "_head")
    # A template's first tokens may have turned wild, but it stays in the leaf of its first term.
    both = rows.join(templates.withColumnsRenamed({"head": "_head", "n_tokens": "_n"}), ["_head"]).filter("n_tokens = _n")
    fits = both.filter(F.forall(F.arrays_zip("template", "tokens"), lambda x: (x["template"] == WILD) | (x["template"] == x["tokens"])))
    wild = F.size(F.filter("template", lambda t: t == WILD))
    best = fits.groupBy("term").agg(F.min(F.struct(wild.alias("wild"), "nth", F.col("_n").alias("n_tokens"), F.col("_head").alias("head"))).alias("best"))
    return terms.join(best.select("term", "best.n_tokens", "best.head", "best.nth"), "term", "left")


def template_columns(freq: DataFrame, vocab: DataFrame, similarity: float = 0.4, depth: int = 4, max_events: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((term, col from 1) of all vocabulary terms that match, templates with col): columns by train strings alone.

    Templates that no train term ends up in have no column; their terms are unknown. With ``max_events`` only that many templates
    have one, those of the most frequent terms.
    """
    seen = freq.join(vocab, "term")
    templates = cut(fit_templates(seen, similarity, depth))
    trained = match_templates(seen.filter("freq > 0"), templates, depth).filter("nth is not null")
    firsts = trained.groupBy("n_tokens", "head", "nth").agg(F.max(F.struct("freq", -F.col("term_id"))).alias("_first"))
    numbered = with_rank(firsts, F.desc("_first"), rank="_rank").select("n_tokens", "head", "nth", (F.col("_rank") + 1).cast("int").alias("col"))
    numbered = cut(numbered if max_events is None else numbered.filter(F.col("col") <= max_events))
    named = cut(templates.join(numbered, ["n_tokens", "head", "nth"]))
    columns = match_templates(vocab.select("term"), templates, depth).join(numbered, ["n_tokens", "head", "nth"]).select("term", "col")
    return columns, named


def serve_columns(terms: DataFrame, columns: DataFrame, named: DataFrame, depth: int = 4) -> DataFrame:
    """(term, col): known terms by lookup, new ones by matching templates, the rest 0."""
    known = terms.join(columns, "term", "left")
    new = match_templates(known.filter("col is null").select("term"), named, depth).join(named.select("n_tokens", "head", "nth", "col"), ["n_tokens", "head", "nth"], "left")
    return known.filter("col is not null").select("term", "col").union(new.select("term", F.coalesce("col", F.lit(0))))
