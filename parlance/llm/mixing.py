"""Mixing sources to target weights with soft membership.

A table of labelled rows says which domain a text is of. A naive Bayes classifier over hashed words, fitted on a bounded sample
of them, gives every document a posterior over the domains. Rates r >= 0 are fitted by projected gradient least squares so
that the expected tokens of each domain, the sum of r * tokens * posterior, match the targets. A step of the fit is one
aggregate of the documents to one number for each domain; a document's rate is a fold of the steps so far, so no rates are
stored. The gradient is scaled by the inverse of the domains' moment matrix (a number for each pair of domains) over
the rates that are not at 0, and by token counts, so that a rate depends on what a document is and not on how
long it is.

All in DataFrame operations; the driver sees only numbers by domain and the classifier's table of fixed size.

Rates have no upper bound unless one is asked for, and a lower bound above 0 only for documents of domains that the
mixture wants more of, if one is asked for; both are part of the projection, so the totals take them into account.

Defined cases: null and empty texts have no tokens, the prior as posterior, and a rate as any other; labels that are null count as none; without labels of a domain
its posterior is 0 and its target is ignored; repeated rows are kept each; an empty table gives an empty result; the
documents' columns travel in a struct, so any names are possible; an id of many rows counts once when the classifier is fitted.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, held, literal

log = logging.getLogger(__name__)
#: Target weights of the domains that quality and toxicity labels make.
TARGETS = {"clean": 0.92, "low": 0.05, "toxic": 0.03}
SAMPLE = 2_000
BUCKETS = 1 << 15
STEPS, TOLERANCE = 60, 1e-6
#: Words seen in fewer labelled rows of a domain, or hardly more often there than elsewhere, weigh nothing.
LEAST_ROWS, LEAST_WEIGHT = 3, 0.7


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, or else low (quality 0), or else clean; rows with a null label that matters are left out."""
    by = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    domain = F.when(F.col("q") == 0, "low").when(F.col("t") == 1, "toxic").when((F.col("q") == 1) & (F.col("t") == 0), "clean")
    return by.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   "), " ", -1), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Classifier:
    """Log weights of word buckets for each domain, and the multinomial logistic function that turns their sums into posteriors."""

    def __init__(self, domains: list[str], weights: np.ndarray, coef: np.ndarray):
        self.domains, self.weights, self.coef = domains, weights, coef

    def evidence(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The table with ``__tokens`` and ``__x``: for each domain the summed weight of the distinct words and whether there is any; then variety, length and 1."""
        d = len(self.domains)
        tables = [literal([f"{x:.4g}" for x in row], "double") for row in self.weights]
        has = literal([int(x) for x in np.abs(self.weights).sum(0) > 0], "int")
        start = F.struct(*[F.lit(0.0).alias(f"d{k}") for k in range(d)])

        def add(acc: Column, b: Column) -> Column:
            return F.struct(*[(acc[f"d{k}"] + F.get(t, b)).alias(f"d{k}") for k, t in enumerate(tables)])

        out = docs.withColumn("__w", words_of(F.col(text_col))).withColumn("__tokens", F.size("__w").cast("long"))
        out = out.withColumn("__b", F.array_distinct(F.transform("__w", bucket)))
        # most words weigh nothing: one look-up for those
        out = out.withColumn("__s", F.aggregate(F.filter("__b", lambda b: F.get(has, b) > 0), start, add))
        n = F.greatest(F.lit(1), F.size("__w"))
        sums = [F.log1p(F.col(f"__s.d{k}")) for k in range(d)]
        x = [*sums, *[F.when(y > 0, 1.0).otherwise(0.0) for y in sums], F.size("__b") / n, F.log1p(n.cast("double")), F.lit(1.0)]
        return out.withColumn("__x", held(F.array(*x))).drop("__w", "__b", "__s")

    def posteriors(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The table with ``__tokens`` and ``__p``."""
        out = self.evidence(docs, text_col)
        rows = [F.aggregate(F.zip_with("__x", literal([repr(float(c)) for c in row], "double"), lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c) for row in self.coef]
        out = out.withColumn("__l", F.array(*rows)).withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
        return out.withColumn("__p", held(F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)))).drop("__x", "__l", "__e")


def multinomial(x: np.ndarray, y: np.ndarray, d: int, ridge: float = 0.3) -> np.ndarray:
    """Ridge multinomial logistic regression by Newton steps; the last column is the constant."""
    n, m = x.shape
    w = np.zeros((d, m))
    shrink = np.array([ridge] * (m - 1) + [1e-3])
    onehot = np.eye(d)[y]

    def loss(w: np.ndarray) -> float:
        z = x @ w.T
        top = z.max(1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(n), y]).sum() + 0.5 * (w * w * shrink).sum())

    for _ in range(40):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - onehot).T @ x + w * shrink
        h = np.zeros((d * m, d * m))
        for i in range(d):
            for j in range(d):
                h[i * m : i * m + m, j * m : j * m + m] = (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
        step, size, old = np.linalg.solve(h + np.diag(np.tile(shrink, d)), g.ravel()).reshape(d, m), 1.0, loss(w)
        while size > 1e-3 and loss(w - size * step) > old:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit_classifier(docs: DataFrame, membership: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Of the labelled table (doc_id, domain): at most ``sample`` rows of each domain, those of the least hash.

    Two thirds of them give the words their weights (how much more often a domain has them than the others, less what few
    rows leave uncertain), the rest the logistic function.
    """
    shares = {r["domain"]: r["n"] for r in membership.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(shares)
    d = len(domains)
    if not d:
        return Classifier([], np.zeros((0, BUCKETS)), np.zeros((0, 3)))
    some = None
    for k in domains:
        part = membership.filter(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = part if some is None else some.unionByName(part)
    some = some.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) == 0)
    # a bounded number of rows of each domain; of rows that share an id, the one of the least text hash
    rows = docs.select("doc_id", docs[f"`{text_col}`"].alias("text")).join(F.broadcast(some), "doc_id")
    rows = cut(rows.groupBy("doc_id", "domain", "half").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    own = rows.filter(~F.col("half"))
    seen = own.select("domain", F.explode(F.array_distinct(F.transform(words_of(F.col("text")), bucket))).alias("b"))
    counts, n = np.zeros((d, BUCKETS)), np.zeros(d)
    for r in own.groupBy("domain").agg(F.count("*").alias("n")).collect():
        n[domains.index(r["domain"])] = r["n"]
    # one row for each domain and bucket at most
    for r in seen.groupBy("domain", "b").agg(F.count("*").alias("n")).collect():
        counts[domains.index(r["domain"]), r["b"]] = r["n"]
    other = counts.sum(0) - counts
    weights = np.log((counts + 0.1) / (n[:, None] + 0.2)) - np.log((other + 0.1) / (n.sum() - n + 0.2)[:, None]) - 1.5 / np.sqrt(counts + 0.1)
    weights = np.round(np.where((counts >= LEAST_ROWS) & (weights > LEAST_WEIGHT), weights, 0), 3)
    model = Classifier(domains, weights, np.zeros((d, 2 * d + 3)))
    rest = model.evidence(rows.filter("half").select("doc_id", "domain", "text")).select("doc_id", "domain", "__x").toPandas().sort_values(["doc_id", "domain"])
    x, y = np.array(rest["__x"].tolist()).reshape(len(rest), 2 * d + 3), np.array([domains.index(k) for k in rest["domain"]], int)
    if len(x):
        model.coef = multinomial(x, y, d)
    # the sample has other shares of the domains than the labelled table
    found = np.bincount(y, minlength=d) + 0.5
    model.coef[:, -1] += np.log([shares[k] for k in domains]) - np.log(found)
    return model


def rate_of(steps: list[np.ndarray], most: float | None = None) -> Column:
    """The rate after some steps: each takes the posterior's share of it off, and the result is brought back above ``floor`` and to ``most``."""
    if not steps:
        return F.greatest(F.lit(1.0), F.col("floor"))
    flat = literal([repr(float(x)) for s in steps for x in s], "double")
    d = len(steps[0])

    def go(r: Column, m: Column) -> Column:
        down = None
        for k in range(d):
            x = F.get(flat, m * d + k) * F.get(F.col("p"), F.lit(k))
            down = x if down is None else down + x
        up = F.greatest(F.col("floor"), r - down)
        return up if most is None else F.least(F.lit(float(most)), up)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), go)


def domain_tokens(members: DataFrame, d: int) -> np.ndarray:
    """The expected tokens of each domain."""
    row = members.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(k))).alias(f"a{k}") for k in range(d)]).first()
    return np.array([x or 0.0 for x in row])


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, most: float | None = None) -> list[np.ndarray]:
    """The steps of the fit over rows of ``tokens``, ``p`` and ``floor``.

    Without ``total``, the mixture is as large as it takes to hold the domain of the greatest target once; the others are scaled to it. The
    fit ends when the targets are met, or when steps no longer bring it nearer (targets out of reach at these rates; logged).
    """
    d = len(domains)
    w = np.array([targets.get(k, 0.0) for k in domains])
    if not d or w.sum() <= 0:
        return []
    w = w / w.sum()
    p = [F.get(F.col("p"), F.lit(k)) for k in range(d)]
    t = F.col("tokens").cast("double")
    has = domain_tokens(members, d)
    if has.sum() <= 0:
        return []
    goal = w * (total if total is not None else max(((x, h / x) for h, x in zip(has, w, strict=True) if h > 0 and x > 0), default=(0, has.sum()))[1])
    off = lambda x: float(np.abs(x - goal).max() / goal.sum())
    miss = lambda x: float(((x - goal) ** 2).sum())

    def look(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The domains' totals under these steps, and the moments of the documents whose rates are free to move: between their
        bounds, or at one from which a further step like the last leads them away."""
        last = literal([repr(float(g)) for g in steps[-1]], "double")
        down = sum((F.get(last, F.lit(k)) * x for k, x in enumerate(p)), F.lit(0.0))
        free = (F.col("r") > F.col("floor")) | (down < 0)
        if most is not None:
            free &= (F.col("r") < most) | (down > 0)
        active = [F.sum(F.when(free, t * p[i] * p[j])).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
        got = members.withColumn("r", rate_of(steps, most)).agg(*[F.sum(F.col("r") * t * x).alias(f"a{i}") for i, x in enumerate(p)], *active).first()
        return np.array([got[f"a{i}"] or 0.0 for i in range(d)]), square(got)

    square = lambda row: np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    whole = square(members.agg(*[F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]).first())
    # a zero step, so that the bounds hold from the start
    best: list[np.ndarray] = [np.zeros(d)]
    now, moment = look(best)[0], whole
    ridge, plain = np.eye(d) * 1e-4 * whole.trace(), np.eye(d) * np.linalg.eigvalsh(whole).max()
    tries = turn = 0
    while tries < STEPS and off(now) > TOLERANCE:
        tries += 1
        # scaled by the free documents' moments, by all documents', shorter; last a plain gradient step, which always descends
        scale, size = [(moment + ridge, 1.0), (whole + ridge, 1.0), (moment + ridge, 0.25), (whole + ridge, 0.25), (moment + ridge, 0.05), (plain, 1.0)][turn]
        step = size * np.linalg.solve(scale, now - goal)
        new, free_now = look([*best, step])
        if miss(new) < (0.999 if turn == 5 else 0.97) * miss(now):
            best, now, moment, turn = [*best, step], new, free_now, 0
        elif turn == 5:  # as near as the bounds allow
            break
        else:  # the step moves documents that were taken as held by a bound, or holds others
            turn += 1
    if (left := off(now)) > 1e-3:
        log.warning("targets missed by up to %.4f of the mixture: wanted %s, got %s tokens", left, dict(zip(domains, goal.round(1).tolist(), strict=True)), dict(zip(domains, now.round(1).tolist(), strict=True)))
    return best


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies: the rate's whole part, and one more for as many ids as its fraction says, by a hash of the id."""
    chance = F.pmod(F.xxhash64(F.lit(11).cast("long"), key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, membership: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, text_col: str = "text", least: float = 0.0, most: float | None = None, carry: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``row`` (the documents' columns, or those of ``carry``), ``tokens``, ``p``, ``rate`` and ``copies``; also the domains in the order of ``p``.

    A document whose likeliest domain has a greater target than share now, or the greatest target of all, has a rate of ``least``
    at least; no rate is above ``most``. Texts are read once for the posteriors, which are kept with the rows.
    """
    targets = targets or TARGETS
    model = fit_classifier(docs, membership, text_col)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry or docs.columns]).alias("row"), docs["doc_id"].alias("key"), docs[f"`{text_col}`"].alias("text"))
    rows = model.posteriors(rows, "text")
    members = cut(rows.select("row", "key", F.col("__tokens").alias("tokens"), F.col("__p").alias("p")))
    floor = F.lit(0.0)
    if least and model.domains:
        has, all_targets = domain_tokens(members, len(model.domains)), sum(targets.get(n, 0.0) for n in model.domains)
        top = max(targets.get(n, 0.0) for n in model.domains)
        wanted = [targets.get(n, 0.0) == top or targets.get(n, 0.0) * has.sum() >= x * all_targets for n, x in zip(model.domains, has, strict=True)]
        likeliest = F.array_position("p", F.array_max("p")).cast("int") - 1
        floor = F.when(F.get(literal([str(w).lower() for w in wanted], "boolean"), likeliest), F.lit(float(least))).otherwise(F.lit(0.0))
    members = members.withColumn("floor", floor)
    # the fit passes over numbers only
    steps = fit_rates(cut(members.select("tokens", "p", "floor")), model.domains, targets, total, most)
    out = members.withColumn("rate", held(rate_of(steps, most)))
    return out.select("row", "tokens", "p", "rate", copies_of(F.col("rate"), F.col("key")).alias("copies")), model.domains


def op2_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target weights of the domains clean, low and toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out, domains = mixed(documents(spark, sf_dir), domain_of_labels(labels), carry=["doc_id"])
    p = [F.get(F.col("p"), F.lit(k)).alias(f"p_{name}") for k, name in enumerate(domains)]
    return out.select("row.doc_id", F.col("tokens").alias("n_tokens"), *p, "rate", "copies")


QUERIES = {"op2_soft_mixture": op2_soft_mixture}
