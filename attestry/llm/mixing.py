"""Mixing documents to target domain weights with soft membership, in DataFrame operations only.

The domains are classes of a labelled table. A naive Bayes classifier over binned text measures and learned word starts,
fitted by grouped counts, gives each document its posterior p over the domains. Then nonnegative rates r are fitted such
that each domain's expected tokens, the sum of r * tokens * p, meet its target. Projected gradient descent solves that
least-squares problem: each step sums a few numbers over all documents and gives each document its new rate from them.

Steps are taken in the metric of the documents' tokens, where the gradient of a document is a sum over the domains of
its posteriors. A step first tries the gap divided by the domains' matrix over the documents whose rate isn't 0 (which
would close the gap if no rate met the bound); if that hardly lessens the gap, the plain step of the weighed problem and
multiples of it are tried in one pass and the best is taken (the problem's matrix has rows that sum to 1, so that length 1
lessens the gap for every input). Steps go on until the
targets are met or the projected gradient is as good as 0, which marks the least-squares rates of targets that can't be
met; the report says which, and how far the last gradient was from 0 where the steps ran out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import materialise, row_key

#: Steps between two written states, which bounds the expressions.
CHAIN = 6
#: Lengths of the steps that are tried where Newton's step fails; the first is the plain one.
LENGTHS = tuple(2.0**i for i in range(10))
#: Domains of a classifier; each is a column of the posteriors.
MOST_DOMAINS = 100


def _bin(x: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (x > e).cast("int")
    return out


def _features(text: Column, words: Column, starts: list[str]) -> dict[str, Column]:
    """Binned measures of one text; each is a whole number."""
    n = F.greatest(F.size(words), F.lit(1))
    out = {
        "length": _bin(F.size(words), (20, 100, 500, 2000)),
        "symbols": _bin(F.regexp_count(text, F.lit("[#*$%&|<>]")) / n, (0.0, 0.1, 0.5)),
        "capitals": _bin(F.regexp_count(text, F.lit("\\p{Lu}")) / F.greatest(F.length(text), F.lit(1)), (0.05, 0.2, 0.4)),
        "exclamations": _bin(F.regexp_count(text, F.lit("!")) / n, (0.0, 0.1, 0.5)),
        "variety": _bin(F.size(F.array_distinct(words)) / F.sqrt(n), (1.0, 2.0, 4.0)),
    }
    if starts:
        own = F.regexp_extract_all(F.lower(text), F.lit("(?<![\\p{L}\\p{N}])(\\p{L}{4})"), F.lit(1))
        out["starts"] = _bin(F.size(F.array_intersect(own, F.array(*[F.lit(s) for s in starts]))), (0, 1, 2))
    return out


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")


class DomainModel:
    """Log priors and log likelihoods of a naive Bayes classifier; posterior() is one JVM expression for each domain."""

    def __init__(self, domains: list[str], priors: dict[str, float], tables: dict[str, dict[int, dict[str, float]]], starts: list[str]):
        self.domains, self.priors, self.tables, self.starts = domains, priors, tables, starts

    def posteriors(self, docs: DataFrame, text_col: str) -> DataFrame:
        """Adds _tokens (words) and _p (an array of the domains' posteriors, in order)."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        binned = docs.withColumn("_words", _words(text)).withColumn("_tokens", F.size("_words").cast("long"))
        features = _features(text, F.col("_words"), self.starts)
        binned = binned.withColumns({f"_f_{k}": v for k, v in features.items()}).drop("_words")
        scores = []
        for d in self.domains:
            score = F.lit(self.priors[d])
            for name, table in self.tables.items():
                likely = F.lit(table[-1][d])
                for b, row in table.items():
                    if b >= 0:
                        likely = F.when(F.col(f"_f_{name}") == b, F.lit(row[d])).otherwise(likely)
                score = score + likely
            scores.append(score)
        scored = binned.withColumn("_s", F.array(*scores)).drop(*[f"_f_{k}" for k in features])
        exp = F.transform("_s", lambda s: F.exp(s - F.array_max(F.col("_s"))))
        scored = scored.withColumn("_e", exp).drop("_s")
        total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
        return scored.withColumn("_p", F.transform("_e", lambda x: x / total)).drop("_e")


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", per_domain: int = 3000, most_starts: int = 64, focus: str | None = "toxic") -> DomainModel:
    """Fits the classifier on at most per_domain labelled ids of each domain (chosen by a hash of the id).

    Ids labelled more than once take their least domain; null ids and null domains are left out. For the domain
    ``focus`` it also learns word starts of four letters that its documents have and others lack, the ``most_starts``
    that tell most. Without any labelled document there is one domain, ``all``. More than MOST_DOMAINS are refused. Of
    rows that repeat an id the least text counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(F.col(id_col).alias("_doc")).agg(F.min(domain_col).alias("_domain"))
    shares = {r["_domain"]: r["n"] for r in known.groupBy("_domain").agg(F.count("*").alias("n")).orderBy("_domain").limit(MOST_DOMAINS + 1).collect()}
    if len(shares) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    if not shares:
        return DomainModel(["all"], {"all": 0.0}, {}, [])
    domains = sorted(shares)
    ids = None
    for d in domains:
        some = known.where(F.col("_domain") == d).orderBy(F.xxhash64("_doc"), "_doc").limit(per_domain)
        ids = some if ids is None else ids.unionByName(some)
    sample = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(ids), "_doc").groupBy("_doc", "_domain").agg(F.min("_text").alias("_text")).select("_text", "_domain")
    count = {r["_domain"]: r["n"] for r in sample.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    domains = [d for d in domains if count.get(d)]
    if not domains:
        return DomainModel(["all"], {"all": 0.0}, {}, [])
    starts: list[str] = []
    if focus in domains and len(domains) > 1:
        own = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit("(?<![\\p{L}\\p{N}])(\\p{L}{4})"), F.lit(1)))
        n, others = count[focus], sum(count[d] for d in domains if d != focus)
        found = (
            sample.select(F.col("_domain") == focus, F.explode(own)).toDF("own", "start").groupBy("start")
            .agg((F.sum(F.col("own").cast("int")) / n).alias("here"), (F.sum((~F.col("own")).cast("int")) / others).alias("there"))
            .where((F.col("here") >= max(0.01, 3 / n)) & (F.col("there") <= 0.03 * F.col("here")))
            .orderBy(F.desc(F.col("here") - F.col("there")), "start")
            .limit(most_starts)
        )
        starts = [r["start"] for r in found.collect()]
    features = _features(F.col("_text"), F.col("_words"), starts)
    rows = sample.withColumn("_words", _words(F.col("_text"))).select("_domain", *[v.alias(k) for k, v in features.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in features]))
    counts = rows.select("_domain", pairs.alias("x")).groupBy("_domain", "x.f", "x.b").agg(F.count("*").alias("n")).collect()
    got = {(r["f"], r["b"], r["_domain"]): r["n"] for r in counts}
    tables: dict[str, dict[int, dict[str, float]]] = {}
    for f in features:
        bins = sorted({b for g, b, _ in got if g == f})
        tables[f] = {b: {d: math.log((got.get((f, b, d), 0) + 0.5) / (count[d] + 0.5 * (len(bins) + 1))) for d in domains} for b in bins}
        tables[f][-1] = {d: math.log(0.5 / (count[d] + 0.5 * (len(bins) + 1))) for d in domains}
    total = sum(shares[d] for d in domains)
    return DomainModel(domains, {d: math.log(shares[d] / total) for d in domains}, tables, starts)


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with a small ridge, for as many unknowns as there are domains."""
    k = len(right)
    ridge = 1e-9 * max([matrix[i][i] for i in range(k)] + [1e-30])
    rows = [[*matrix[i], right[i]] for i in range(k)]
    for i in range(k):
        rows[i][i] += ridge
    for i in range(k):
        best = max(range(i, k), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for j in range(k):
            if j != i:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [rows[i][k] / rows[i][i] for i in range(k)]


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, anchor: str | None = None, steps: int = 60, tolerance: float = 1e-6) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Adds _rate to rows with _tokens and _p, and returns each domain's target and fitted total.

    The target of a domain is its share of ``weights`` (of the domains there are, rescaled to 1) times ``total`` tokens;
    by default the tokens there are, or such that the domain ``anchor`` keeps what it has. Documents that belong to the
    anchor by a posterior of one half or more keep the rate 1; the others are fitted around them. Documents without tokens
    keep the rate 1. The report's ``gradient`` is the domain's part of the projected gradient at the end: 0 within
    ``tolerance`` unless ``steps`` ran out or three of them together gained less than three thousandths; a domain whose fitted total isn't its target can't have more, or less.
    """
    k = len(domains)
    p = [F.get("_p", F.lit(i)) for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    fixed = F.col("_tokens") == 0
    if anchor in domains:
        fixed = fixed | (p[domains.index(anchor)] >= 0.5)

    def measure(frame: DataFrame, rate: Column) -> tuple[list[float], list[list[float]]]:
        """The domains' totals, and their matrix over documents whose rate is free and above 0."""
        live = F.when((rate > 0) & ~F.col("_fixed"), F.col("_tokens")).otherwise(F.lit(0))
        row = frame.agg(*[F.sum(rate * F.col("_tokens") * x) for x in p], *[F.sum(live * p[i] * p[j]) for i, j in cells]).first()
        values = [float(x or 0.0) for x in row]
        matrix = [[0.0] * k for _ in range(k)]
        for (i, j), x in zip(cells, values[k:], strict=True):
            matrix[i][j] = matrix[j][i] = x
        return values[:k], matrix

    state, rate = members.withColumn("_rate", F.lit(1.0)).withColumn("_fixed", fixed), F.col("_rate")
    now, matrix = measure(state, rate)
    natural = now
    share = [max(0.0, weights.get(d, 0.0)) if natural[i] > 0 else 0.0 for i, d in enumerate(domains)]
    if not sum(share):
        share = [1.0 if n > 0 else 0.0 for n in natural]
    share = [x / sum(share) if sum(share) else 0.0 for x in share]
    if total is None:
        total = sum(natural)
        if anchor in domains and share[domains.index(anchor)] > 0:
            total = natural[domains.index(anchor)] / share[domains.index(anchor)]
    target = [x * total for x in share]
    loss = lambda s: sum((x - t) ** 2 / n for x, t, n in zip(s, target, natural, strict=True) if n > 0)

    def slope(s: list[float]) -> list[float]:
        """The plain step of the weighed problem: by how much a document's rate falls, per posterior of each domain."""
        return [(x - t) / n if n > 0 else 0.0 for x, t, n in zip(s, target, natural, strict=True)]

    def apply(x: list[float]) -> Column:
        lower = rate - sum((a * F.lit(float(d)) for a, d in zip(p, x, strict=True)), F.lit(0.0))
        return F.when(F.col("_fixed"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), lower))

    def met(s: list[float]) -> bool:
        return all(abs(x - t) <= tolerance * max(n, 1.0) for x, t, n in zip(s, target, natural, strict=True))

    taken, depth, stalled, left = 0, 0, 0, [0.0] * k
    while not met(now) and taken < steps and stalled < 3:
        moved = apply(_solve(matrix, [s - t for s, t in zip(now, target, strict=True)]))
        then, after = measure(state, moved)
        if loss(then) > 0.9 * loss(now):
            # one pass over the documents tries the plain step and longer ones along the projected gradient
            down = slope(now)
            trials = [apply([length * x for x in down]) for length in LENGTHS]
            row = [float(x or 0.0) for x in state.agg(*[F.sum(t * F.col("_tokens") * x) for t in trials for x in p]).first()]
            found = [row[i * k : (i + 1) * k] for i in range(len(trials))]
            # the totals that the plain step still moves are the projected gradient
            left = [x - y for x, y in zip(found[0], now, strict=True)]
            if all(abs(x) <= 10 * tolerance * max(n, 1.0) for x, n in zip(left, natural, strict=True)):
                left = [0.0] * k
                break
            best = min(range(len(trials)), key=lambda i: loss(found[i]))
            if loss(found[best]) <= loss(then):
                moved = trials[best]
                then, after = measure(state, moved)
        stalled = stalled + 1 if loss(then) > 0.999 * loss(now) else 0
        rate, now, matrix, depth, taken = moved, then, after, depth + 1, taken + 1
        if depth == CHAIN:
            # the first state is the caller's, the others are this function's own
            state = materialise(state.withColumn("_rate", rate), *([state] if taken > CHAIN else []))
            rate, depth = F.col("_rate"), 0
    if met(now):
        left = [0.0] * k
    report = {d: {"natural": natural[i], "target": target[i], "fitted": now[i], "gradient": left[i]} for i, d in enumerate(domains)}
    return state.withColumn("_rate", rate).drop("_fixed"), report


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", total: float | None = None, anchor: str | None = None, per_domain: int = 3000) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """One row per document: the id, n_tokens (words), p_<domain> for each domain, and rate; and the domains' totals.

    A null text has no tokens; its rate is 1. Rows that repeat an id are documents of their own. Null ids are kept.
    Other columns of ``docs`` and ``labels`` are ignored, whatever their names.
    """
    domains, fitted, report = _fitted(docs, labels, weights, id_col, text_col, domain_col, total, anchor, per_domain)
    columns = [F.get("_p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)]
    return fitted.select(F.col("_doc").alias(id_col), F.col("_tokens").alias("n_tokens"), *columns, F.col("_rate").alias("rate")), report


def _fitted(docs, labels, weights, id_col, text_col, domain_col, total, anchor, per_domain):
    model = fit_domains(docs, labels, id_col, text_col, domain_col, per_domain)
    named = docs.select(F.col(id_col).alias("_doc"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    members = materialise(model.posteriors(named, "_text").drop("_text"))
    return model.domains, *fit_rates(members, model.domains, weights, total, anchor)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", total: float | None = None, anchor: str | None = None, per_domain: int = 3000) -> DataFrame:
    """``docs`` with each row as often as its fitted rate says, see copies(); rows of copies 0 are gone. Rows with equal
    id and text have equal rates and copies; a null text has no tokens and stays once, a null id is an id like others; an
    empty table gives no rows. Columns keep their names and values, whatever they are."""
    fitted = _fitted(docs, labels, weights, id_col, text_col, domain_col, total, anchor, per_domain)[1]
    counts = fitted.groupBy("_key").agg(F.max("_rate").alias("_rate")).select("_key", copies(F.col("_rate"), F.col("_key")).alias("_copies")).where("_copies > 0")
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_docs"), row_key(id_col, text_col).alias("_key"))
    joined = held.join(counts.hint("shuffle_hash"), "_key").withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return joined.select(*[F.col("_docs")[c].alias(c) for c in docs.columns])


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate rounded up or down by a hash of the key, so that the mean is the rate. A rate
    of 1 is one copy for certain."""
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1_000_003)) / 1_000_003
    return F.floor(rate + chance).cast("int")
