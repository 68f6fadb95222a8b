"""Operator 5, mixing sources to target weights, in DataFrame operations only.

A classifier, fitted on a labelled table, gives each document soft membership of the domains.  A document of n tokens at
rate r adds r n p tokens to the domains, p its posteriors.  Rates are fitted by projected gradient on

    minimise  (A r - t)' W (A r - t)  over r >= 0,   A = [n p],  t = target weights times all tokens,

from r = 1, with the step taken in the metric that weighs a document by its tokens, so documents of equal posteriors
get equal rates whatever their length.  W is the inverse of A N^-1 A' (domains by domains) over the documents with a
rate above zero, which makes a step right that takes none to zero.  Every step is one sum over all documents, with a few
numbers to the driver.  Where the sums do not come within CLOSE of the targets in the given steps, a warning tells how
far off they are.

Features of a document are its words' first PREFIX characters, once for each of the first three times that they occur
(so inflected forms, and words that recur, tell), hashed into 3 x BUCKETS buckets.  Naive Bayes log ratios of all buckets
form a table; ratios that chance explains are shrunk, none is left out.  The table is joined to documents' features by
bucket; it has 3 x BUCKETS rows at most, whatever the corpus, and is broadcast.  The sums of a document's ratios become
posteriors by a softmax regression on a few numbers, fitted on labelled documents which the ratios it sees have not seen.

The classifier is fitted on a bounded sample: about LABELLED labelled documents, drawn by a hash of their id (the bound
is the parameter labelled); its regression's six numbers for each of them are all that reaches the driver.  A domain is
one of clean, low and toxic: toxic where a label says so, else by quality.

Defined cases: a null or empty text has no tokens and takes no part in the sums, and a text without known features has
the posteriors of such; very long texts are read whole, as one array of words in memory; rows without a label never
train; several labels of a document count as toxic if any is and as low if any is; without labels the posteriors are
equal; a domain that no document belongs to stays short of its target, with a warning; repeated rows are rated alike,
row by row; an empty table gives an empty result; other columns are ignored (rate) or kept (mixed), whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, content_key, materialise, quoted, sized, unused

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.85, "low": 0.10, "toxic": 0.05}
LABELLED = 6000
PREFIX, BUCKETS = 5, 1 << 16
#: Added to seen and expected counts; a ratio z standard errors from chance keeps z^2 / (z^2 + CHANCE) of itself.
SMOOTH, CHANCE = 5.0, 10.0
#: Weight of the penalty on the regression's coefficients.
RIDGE = 0.1
STEPS, CLOSE = 30, 1e-4
#: The bucket of the one feature that every document has.
EVERY = -1


@dataclass
class Classifier:
    """weights: a row (b, w0, w1, ...) a bucket, log ratios of each domain to the first; turn: domains by inputs."""

    weights: DataFrame
    turn: np.ndarray

    def posteriors(self, sums: list[Column], features: Column) -> Column:
        """The domains' posteriors as an array, from the sums of a document's ratios and its number of features."""
        given = _inputs(sums, features)
        logits = []
        for row in self.turn:
            logit = F.lit(0.0)
            for value, x in zip(row.tolist(), given, strict=True):
                logit = logit + F.lit(value) * x
            logits.append(logit)
        most = F.greatest(*logits)
        raised = [F.exp(x - most) for x in logits]
        total = raised[0]
        for x in raised[1:]:
            total = total + x
        return F.array(*[x / total for x in raised])


def _inputs(sums: list[Column], features: Column) -> list[Column]:
    """What the regression sees: each sum as a rate and as a size, the number of features, and one."""
    out = []
    for s in sums:
        out += [s / F.sqrt(features + 10) * 3, F.signum(s) * F.log1p(F.abs(s))]
    return [*out, F.log1p(features) / 5, F.lit(1.0)]


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _featured(rows: DataFrame, text: Column) -> DataFrame:
    """rows (without text) with n_tokens and the array feats, each feature once."""
    kept = rows.columns
    told = rows.select(*kept, tokens_of(text).alias("ws"))
    starts = F.sort_array(F.transform("ws", lambda w: F.pmod(F.xxhash64(F.substring(w, 1, PREFIX)), F.lit(BUCKETS)).cast("int")))
    told = told.select(*kept, F.size("ws").cast("long").alias("n_tokens"), starts.alias("starts"))

    def numbered(b: Column, i: Column) -> Column:
        before = lambda k: F.get(F.col("starts"), i - k) == b
        return b * 3 + F.when((i > 1) & before(2), 2).when((i > 0) & before(1), 1).otherwise(0)

    return told.select(*kept, "n_tokens", F.array_distinct(F.transform("starts", numbered)).alias("feats"))


def _scored(rows: DataFrame, weights: DataFrame, names: list[str], keys: list[str], carried: list[str]) -> DataFrame:
    """keys, the first of each carried column, how many rows share the keys (times), and the sums of the named weights."""
    every = F.array(F.lit(EVERY))
    exploded = rows.select(*keys, *carried, F.explode(F.concat(every, "feats")).alias("b"))
    met = exploded.join(F.broadcast(weights), "b")  # at most 3 x BUCKETS rows and the one of EVERY
    times = F.sum(F.when(F.col("b") == EVERY, 1).otherwise(0))
    sums = [(F.sum(n) / times).alias(n) for n in names]
    return met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], times.cast("int").alias("times"), *sums)


def _log_ratios(counts: DataFrame, halves: tuple[int, ...], totals: Mapping[tuple[int, int], float]) -> list[Column]:
    """For each domain but the first, the log of how much likelier it makes a bucket than the first does."""
    here = lambda d: sum((F.col(f"c{h}_{d}") for h in halves), F.lit(0.0))
    pairs = [sum(totals[h, d] for h in halves) for d in range(len(DOMAINS))]
    together = here(0)
    for d in range(1, len(DOMAINS)):
        together = together + here(d)
    ratios = []
    for d in range(len(DOMAINS)):
        expected = together * F.lit(pairs[d] / max(sum(pairs), 1.0))
        off = here(d) - expected
        sure = off * off / F.greatest(expected, F.lit(0.5))
        ratios.append(F.log((here(d) + SMOOTH) / (expected + SMOOTH)) * sure / (sure + CHANCE))
    return [r - ratios[0] for r in ratios[1:]]


def _softmax_fit(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, *, steps: int = 50) -> np.ndarray:
    """Domains by inputs, by Newton's method; the last input is the constant and goes without penalty."""
    k, d = x.shape[1], len(DOMAINS)
    turn, penalty = np.zeros((d, k)), np.full(k, RIDGE)
    penalty[-1] = 1e-6
    for _ in range(steps):
        logits = x @ turn.T
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - np.eye(d)[y]) * weigh[:, None]).T @ x + penalty * turn
        curve = np.zeros((d * k, d * k))
        for a in range(d):
            for b in range(d):
                curve[a * k : (a + 1) * k, b * k : (b + 1) * k] = (x * (weigh * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
        step = np.linalg.solve(curve + np.diag(np.tile(penalty, d) + 1e-9), slope.ravel()).reshape(d, k)
        turn -= step
        if np.abs(step).max() < 1e-8:
            break
    return turn


def fit_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Classifier:
    """From documents and labels (id, quality, toxic)."""
    domain = F.when(F.max("toxic") > 0, F.lit(2)).when(F.min("quality") < 1, F.lit(1)).otherwise(F.lit(0))
    named = labels.filter(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("id")).agg(domain.alias("domain"))
    known = named.count()
    names = [f"w{d}" for d in range(1, len(DOMAINS))]
    every = [F.lit(EVERY).alias("b"), *[F.lit(0.0).alias(n) for n in names]]
    spark = docs.sparkSession
    if not known:
        return Classifier(spark.range(1).select(*every), np.zeros((len(DOMAINS), 2 * len(names) + 2)))
    share = min(1.0, labelled / known)
    drawn = materialise(named.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003), "mix-drawn")
    # Of copies one speaks; a text's half is drawn by its hash, so that its copies are all in one.
    seen = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(sized(drawn), "id")
    seen = seen.groupBy("text").agg(F.max("domain").alias("domain")).withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit(1), "text"))
    seen = seen.withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    sample = materialise(_featured(seen.select("h", "g", "half", "domain", "text"), F.col("text")).drop("text"), "mix-sample")
    kinds = [(h, d) for h in (0, 1) for d in range(len(DOMAINS))]
    held = F.col("half") * len(DOMAINS) + F.col("domain")
    counts = sample.select(held.alias("kind"), F.explode("feats").alias("b")).groupBy("b")
    counts = materialise(counts.agg(*[F.sum(F.when(F.col("kind") == h * len(DOMAINS) + d, 1.0).otherwise(0.0)).alias(f"c{h}_{d}") for h, d in kinds]), "mix-counts")
    found = counts.agg(*[F.coalesce(F.sum(f"c{h}_{d}"), F.lit(0.0)) for h, d in kinds]).first()
    totals = dict(zip(kinds, map(float, found), strict=True))
    # What a document of one half is worth by the counts of the other, and any document by the counts of both.
    crossed = counts.select("b", *[r.alias(f"{n}_{h}") for h in (0, 1) for n, r in zip(names, _log_ratios(counts, (1 - h,), totals), strict=True)])
    crossed = crossed.union(spark.range(1).select(F.lit(EVERY), *[F.lit(0.0) for _ in range(2 * len(names))]))
    wide = [f"{n}_{h}" for h in (0, 1) for n in names]
    scored = _scored(sample.withColumn("features", F.size("feats").cast("double")), materialise(crossed, "mix-crossed"), wide, ["h", "g"], ["half", "domain", "features"])
    own = [F.when(F.col("half") == 0, F.col(f"{n}_0")).otherwise(F.col(f"{n}_1")) for n in names]
    # About LABELLED rows of a few numbers.
    rows = scored.select("domain", *[x.alias(f"x{i}") for i, x in enumerate(_inputs(own, F.col("features")))]).collect()
    x, y = np.array([[float(v) for v in r[1:]] for r in rows]), np.array([r[0] for r in rows])
    weights = counts.select("b", *[r.alias(n) for n, r in zip(names, _log_ratios(counts, (0, 1), totals), strict=True)]).union(spark.range(1).select(*every))
    turn = _softmax_fit(x, y, np.ones(len(y))) if len(rows) else np.zeros((len(DOMAINS), 2 * len(names) + 2))
    return Classifier(materialise(weights, "mix-weights"), turn)


def classified(docs: DataFrame, classifier: Classifier, *, id_col: str, text_col: str) -> DataFrame:
    """h, g (the row's content key), id, times (rows with that key), n_tokens and p (posteriors)."""
    h, g = content_key(id_col, text_col)
    source = docs.select(h.alias("h"), g.alias("g"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    featured = _featured(source, F.col("text")).withColumn("features", F.size("feats").cast("double"))
    names = [f"w{d}" for d in range(1, len(DOMAINS))]
    scored = _scored(featured.drop("text"), classifier.weights, names, ["h", "g"], ["id", "n_tokens", "features"])
    return scored.select("h", "g", "id", "times", "n_tokens", classifier.posteriors([F.col(n) for n in names], F.col("features")).alias("p"))


def fit_rates(rows: DataFrame, targets: Mapping[str, float] = TARGETS, *, steps: int = STEPS, close: float = CLOSE) -> Column:
    """The rate of each row of a table with n_tokens, times and p, as an expression on those columns."""
    size = len(DOMAINS)
    p = [F.get(F.col("p"), i) for i in range(size)]
    n = F.col("n_tokens") * F.col("times")
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    rate, off, step = F.lit(1.0), np.inf, 0
    while True:
        moving = F.when(rate > 0, n).otherwise(F.lit(0))
        *found, total = rows.agg(*[F.sum(n * p[i] * rate) for i in range(size)], *[F.sum(moving * p[i] * p[j]) for i, j in upper], F.sum(n)).first()
        if not total:
            return rate
        goal = np.array([targets.get(d, 0.0) for d in DOMAINS])
        goal = goal / goal.sum() * total
        reached = np.array(found[:size], dtype=float)
        off = float(np.abs(reached - goal).max() / total)
        if off < close or step == steps:
            break
        step += 1
        gram = np.zeros((size, size))
        for (i, j), v in zip(upper, found[size:], strict=True):
            gram[i, j] = gram[j, i] = v
        slope = F.lit(0.0)
        for i, s in enumerate(np.linalg.pinv(gram, rcond=1e-9) @ (reached - goal)):
            slope = slope + F.lit(float(s)) * p[i]
        rate = F.greatest(F.lit(0.0), rate - slope)
    if off >= close:
        warnings.warn(f"Mixing: after {steps} steps a domain's tokens are {off:.4f} of all tokens off their target.", stacklevel=2)
    return rate


def rate(docs: DataFrame, labels: DataFrame, *, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, steps: int = STEPS) -> DataFrame:
    """id, n_tokens, the posterior of each domain (p_<domain>) and rate of each row."""
    classifier = fit_classifier(docs, labels, id_col=id_col, text_col=text_col, labelled=labelled)
    rows = materialise(classified(docs, classifier, id_col=id_col, text_col=text_col), "mix-rows")
    told = rows.withColumn("rate", fit_rates(rows, targets, steps=steps))
    each = told.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select(F.col("id").alias(id_col), "n_tokens", *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")


def mixed(docs: DataFrame, labels: DataFrame, *, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, steps: int = STEPS) -> DataFrame:
    """The rows of docs, columns as they are, each as often as its rate says.

    The whole part of a rate is sure, the rest is drawn by a hash of the row's id and text, so a rerun gives the same rows.
    """
    classifier = fit_classifier(docs, labels, id_col=id_col, text_col=text_col, labelled=labelled)
    rows = materialise(classified(docs, classifier, id_col=id_col, text_col=text_col), "mix-rows")
    names = {c: unused(docs.columns, f"_mix_{c}") for c in ("h", "g", "copies")}
    fraction = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(fit_rates(rows, targets, steps=steps) + fraction).cast("int")
    wanted = materialise(rows.select(F.col("h").alias(names["h"]), F.col("g").alias(names["g"]), copies.alias(names["copies"])).filter(F.col(names["copies"]) > 0), "mix-copies")
    h, g = content_key(id_col, text_col)
    met = docs.withColumn(names["h"], h).withColumn(names["g"], g).join(sized(wanted), [names["h"], names["g"]])
    # An explode of a short array: a row and its copies stay where they are.
    out = met.withColumn(names["copies"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])
