"""Toxicity by a learned lexicon whose trie is intersected with Levenshtein automata, weighed by context.

The lexicon comes from labelled rows: stems and words that toxic documents have and others lack. Their trie and the
automata of distance one for every term form one deterministic automaton, built state by state as words ask for it; a
state is the set of (trie node, errors so far). Most words leave it after a few letters. Each hit counts by how it was
found (exact or misspelled) and by the words around it: quotation marks and verbs of saying lower it, an address to a
person raises it. A logistic model over the counts gives the score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, single quotation marks and exclamation marks of a lower-cased text.
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»!]")
QUOTES = frozenset("\"“”„«»")
#: Verbs of saying and nouns for what is said, in the four languages of the labels.
SAYING = frozenset(
    """said says wrote writes called calling quoted quote reported shouted word words term slur insult
    sagte schrieb nannte zitiert wort dit écrit appelé cité mot dijo escribió llamó citado palabra""".split()
)
#: Words that address a person.
ADDRESS = frozenset("you your you're u ur du dich dein deine ihr tu toi ton vous votre tú usted ustedes vosotros".split())
SPAN = 6
MIN_FUZZY = 5
MAX_REMEMBERED = 300_000


@dataclass(frozen=True)
class Term:
    """A lexicon entry; a stem also matches words that go on. ``fuzzy``: a misspelling of distance one counts too."""

    text: str
    stem: bool
    fuzzy: bool = True


class LexiconAutomaton:
    """match(word): (term index, errors) of the best term that accepts the word, or None."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.can_fuzzy: list[bool] = [False]
        for i, t in enumerate(terms):
            node = 0
            fuzzy = t.fuzzy and len(t.text) >= MIN_FUZZY
            for c in t.text:
                self.can_fuzzy[node] = self.can_fuzzy[node] or fuzzy
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(-1)
                    self.can_fuzzy.append(False)
            self.can_fuzzy[node] = self.can_fuzzy[node] or fuzzy
            if self.ends[node] < 0 or t.stem:
                self.ends[node] = i
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.sure: list[tuple[int, int] | None] = []
        self.final: list[tuple[int, int] | None] = []
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, nodes: set[tuple[int, int]]) -> frozenset:
        """Adds what one missing letter of the word allows, and drops what a state without errors makes needless."""
        out = set(nodes)
        for node, errors in nodes:
            if errors == 0 and self.can_fuzzy[node]:
                out.update((child, 1) for child in self.children[node].values() if self.can_fuzzy[child])
        return frozenset(x for x in out if x[1] == 0 or (x[0], 0) not in out)

    def _accepts(self, state: frozenset, stems_only: bool) -> tuple[int, int] | None:
        best = None
        for node, errors in state:
            i = self.ends[node]
            if i < 0 or (stems_only and not self.terms[i].stem):
                continue
            if errors and not (self.terms[i].fuzzy and len(self.terms[i].text) >= MIN_FUZZY):
                continue
            if best is None or (errors, i) < (best[1], best[0]):
                best = (i, errors)
        return best

    def _state(self, nodes: frozenset) -> int:
        if nodes not in self.numbers:
            self.numbers[nodes] = len(self.states)
            self.states.append(nodes)
            self.next.append({})
            self.sure.append(self._accepts(nodes, True))
            self.final.append(self._accepts(nodes, False))
        return self.numbers[nodes]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, errors in self.states[state]:
            child = self.children[node].get(c)
            if child is not None and (errors == 0 or self.can_fuzzy[child]):
                out.add((child, errors))
            if errors == 0 and self.can_fuzzy[node]:
                out.add((node, 1))  # a letter too many
                out.update((x, 1) for x in self.children[node].values() if self.can_fuzzy[x])  # a wrong letter
        number = self._state(self._close(out)) if out else -1
        if len(self.next[state]) < 512:
            self.next[state][c] = number
        return number

    def match(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for c in word:
            following = self.next[state].get(c)
            state = self._step(state, c) if following is None else following
            if state < 0:
                return best
            sure = self.sure[state]
            if sure is not None:
                if sure[1] == 0:
                    return sure
                best = best or sure
        return self.final[state] or best


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray  # of bias, and of features()
    _automaton: LexiconAutomaton | None = field(default=None, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.terms, self.weights

    def __setstate__(self, state):
        self.terms, self.weights = state
        self._automaton, self._known = None, {}

    def hits(self, text: str | None) -> tuple[list[str], list[tuple[int, int, int]]]:
        """Tokens, and (token, term, errors) of each lexicon hit."""
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.terms)
        tokens = TOKEN.findall((text or "").lower())
        known = self._known
        new = set(tokens).difference(known)
        if len(known) > MAX_REMEMBERED:
            known.clear()
            new = set(tokens)
        match = self._automaton.match
        for w in new:
            known[w] = match(w)
        return tokens, [(i, *m) for i, m in enumerate(map(known.__getitem__, tokens)) if m is not None]

    def features(self, text: str | None) -> list[float]:
        """Exact and misspelled hits, each weighed by its context, on a logarithmic scale; their share of the words."""
        return self._features(*self.hits(text))

    @staticmethod
    def _features(tokens: list[str], hits: list[tuple[int, int, int]]) -> list[float]:
        exact = near = 0.0
        for i, _, errors in hits:
            weight = context_weight(tokens, i)
            if errors:
                near += weight
            else:
                exact += weight
        n = max(len(tokens), 1)
        return [math.log1p(exact + NEAR_SHARE * near), math.log1p(100 * (exact + NEAR_SHARE * near) / n)]

    def score(self, text: str | None) -> tuple[float, int]:
        """Probability of label 1, and the number of hits."""
        tokens, hits = self.hits(text)
        z = self.weights[0] + float(np.dot(self.weights[1:], self._features(tokens, hits)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), len(hits)


#: What a misspelled hit counts against an exact one.
NEAR_SHARE = 0.9


def context_weight(tokens: list[str], i: int) -> float:
    """Weight of the hit at token i by the tokens around it: quotation lowers it, an address raises it."""
    before, after = tokens[max(0, i - SPAN) : i], tokens[i + 1 : i + 1 + SPAN]
    quoted = any(t in QUOTES for t in before) and any(t in QUOTES for t in after)
    said = any(t in SAYING for t in before) or any(t in SAYING for t in after)
    address = any(t in ADDRESS for t in before) or any(t in ADDRESS for t in after)
    weight = 0.25 if quoted and said else 0.5 if quoted else 0.8 if said else 1.0
    return weight * (1.25 if address and not quoted else 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(doc, text, y) of at most per_class ids of each label, chosen by a hash of the id; repeats of an id in labels
    count as toxic if one is. The ids' bound makes their broadcast safe."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(per_class) for y in (0, 1)]
    ids = some[0].unionByName(some[1])
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc")


def learn_terms(sample: DataFrame, least_share: float = 0.004, least: int = 4, purity: float = 0.97) -> list[Term]:
    """Stems and words that toxic documents have and others hardly do.

    Counts the sample's distinct texts by each prefix of 4 to 12 letters of their words. Of the prefixes of enough purity
    the shortest are kept, then lengthened as long as they lose no document. A term is a whole word if nearly all its
    documents end there. Every prefix in ``least`` toxic texts and ``least_share`` of them or more is taken; the sample's
    bound is theirs.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)))
    prefixes = F.flatten(
        F.transform(
            F.filter(words, lambda w: F.length(w) >= 4),
            lambda w: F.concat(
                F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(12))), lambda k: F.substring(w, F.lit(1), k)),
                F.when(F.length(w) <= 12, F.array(F.concat(w, F.lit("$")))).otherwise(F.array().cast("array<string>")),
            ),
        )
    )
    # copies of one text say no more than one
    distinct = sample.where("text is not null").groupBy("text").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in distinct.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return []
    floor = max(least, math.ceil(least_share * n[1]))
    counted = (
        distinct.select("y", F.explode(F.array_distinct(prefixes)).alias("p"))
        .groupBy("p")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
        .where((F.col("toxic") >= floor))
    )
    # rates, so that the sample's balance doesn't matter
    share = F.col("toxic") / n[1]
    other = F.col("clean") / max(n.get(0, 0), 1)
    rows = {r["p"]: r["toxic"] for r in counted.where(share / (share + other) >= purity).collect()}
    longer: dict[str, list[str]] = {}
    for p in rows:
        if not p.endswith("$"):
            longer.setdefault(p[:-1], []).append(p)
    terms = []
    for p in sorted((p for p in rows if not p.endswith("$") and p[:-1] not in rows), key=lambda p: (-rows[p], p)):
        at = p
        while following := [q for q in longer.get(at, ()) if rows[q] >= 0.99 * rows[at]]:
            at = min(following)
        terms.append(Term(at, stem=rows.get(at + "$", 0) < 0.95 * rows[at]))
    return terms


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000,
        least_gain: float = 0.004, max_noise: float = 0.004) -> Model:
    """Learns lexicon, which terms may match misspelled, and the logistic weights from at most per_class ids of each
    label; what comes to the driver is bounded by that. Without toxic rows the model scores every text alike, below one
    half. Null ids and labels are left out; an id that labels repeat is toxic if one says so; of rows of docs that repeat
    an id the least text counts."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class).groupBy("doc", "y").agg(F.min("text").alias("text"))
    terms = learn_terms(sample)
    if not terms:
        return Model([], np.array([-3.0, 0.0, 0.0]))
    model = Model(terms, np.array([-3.0, 1.0, 1.0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.hits(t)[1] for t in batch.column(1).to_pylist()]
            own = [pa.array([sorted({term for _, term, errors in f if bool(errors) == e}) for f in found], pa.list_(pa.int32())) for e in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=["y", "exact", "near"])

    found = sample.select("y", "text").mapInArrow(measure, "y int, exact array<int>, near array<int>").where("size(exact) + size(near) > 0").collect()
    kept = cover([r["exact"] for r in found if r["y"] == 1], len(terms), least_gain)
    # a term whose misspellings are common in clean documents matches exactly only
    noise = Counter(t for r in found if r["y"] == 0 for t in r["near"])
    terms = [Term(terms[i].text, terms[i].stem, noise[i] <= max(2, max_noise * per_class)) for i in kept]
    model = Model(terms, np.array([-3.0, 1.0, 1.0]))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["y", "a", "b"])

    got = sample.select("y", "text").mapInArrow(featured, "y int, a double, b double").collect()
    y = np.array([r["y"] for r in got], dtype=float)
    x = np.array([[1.0, r["a"], r["b"]] for r in got])
    weights = logistic(x, y)
    return Model(terms, weights)


def cover(documents: list[list[int]], terms: int, least_gain: float) -> list[int]:
    """Terms chosen one by one for the toxic documents they explain: a document's k-th term counts 0.3 ** (k - 1). Words
    that toxic documents merely share, as copies do, come too late to gain enough. Gains only fall, so a term's old gain
    bounds its new one and few are counted anew at each choice."""
    where: list[list[int]] = [[] for _ in range(terms)]
    for d, own in enumerate(documents):
        for t in own:
            where[t].append(d)
    floor = max(1.5, least_gain * len(documents))
    left, kept = np.ones(len(documents)), []
    queue = [(-float(len(w)), t) for t, w in enumerate(where)]
    heapq.heapify(queue)
    while queue and -queue[0][0] >= floor:
        _, t = heapq.heappop(queue)
        gain = float(left[where[t]].sum())
        if queue and (-gain, t) > queue[0]:
            heapq.heappush(queue, (-gain, t))
        elif gain >= floor:
            kept.append(t)
            left[where[t]] *= 0.3
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton's method for ridge logistic regression with both classes weighed alike; the first column is the bias."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge / 10)
    keep[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score, predicted (1 if score >= 0.5) and hits (lexicon hits, exact or misspelled); columns of these names
    are replaced, others stay, whatever their names. A null text is scored as an empty one. Each row depends on its whole
    text alone: repeated rows get equal results, a null id changes nothing, an empty table gives no rows."""
    own = [c for c in docs.columns if c not in ("score", "predicted", "hits")]

    @F.pandas_udf("score double, hits long")
    def run(texts):
        import pandas as pd

        return pd.DataFrame([model.score(t if isinstance(t, str) else None) for t in texts], columns=["score", "hits"])

    held = F.struct(*[F.col(c) for c in own]) if own else F.struct(F.lit(0).alias("none"))
    found = docs.select(held.alias("_docs"), run(F.col(text_col)).alias("_found"))
    return found.select(*[F.col("_docs")[c].alias(c) for c in own], "_found.score", (F.col("_found.score") >= 0.5).cast("int").alias("predicted"), "_found.hits")
