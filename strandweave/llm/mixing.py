"""Mixing to target weights with soft domain membership, in DataFrame expressions only.

A naive Bayes classifier over hashed words, counted on a bounded sample of the labelled
table, gives each document a posterior over domains. Nonnegative rates per document are
then fitted by projected gradient least squares so that the expected
tokens of each domain, rate times tokens times posterior summed over all documents, match the
targets; the token total is kept. Documents whose posteriors agree to ``DIGITS`` significant digits form a cell with one
rate, so a step reads a row per cell; the sums it fits are those of the unrounded posteriors of every
document, however thinly a domain is spread. A step sends the K domain residuals to the driver, nothing else;
``reached`` reports the shares before and after.

Defined results: null and empty texts have no tokens, the prior as posterior and a rate like any
other; they never change a total. A domain without any mass cannot be raised: least
squares then comes as near as it can. Without labelled rows, or without tokens, every
rate is 1. Repeated rows get equal rates; their random parts are equal too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import bounded_sample, unused_name
from strandweave.session import write_stage

BUCKETS = 1 << 14
DIGITS = 3
STEPS = 60


@dataclass
class DomainModel:
    """``weights`` is a table of ``BUCKETS`` rows at most, ``(bucket, w1, w2, ...)``: log likelihoods of
    hashed words relative to the first domain; ``unseen`` holds those of a word in no row."""

    domains: list[str]
    prior: np.ndarray
    weights: DataFrame | None
    unseen: list[float]


def word_buckets(text: str = "text") -> Column:
    """Hashed lower-cased words of a text, in order, as an array."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_domains(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 3000, smoothing: float = 0.5) -> DomainModel:
    """Count words per domain on at most about ``sample_rows`` rows of each domain of ``labels(doc_id, domain)``.

    The prior is counted over all labelled rows.
    """
    labels = labels.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    shares = {r["domain"]: r["n"] for r in labels.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row per domain
    domains = sorted(shares)
    if not domains:
        return DomainModel([], np.zeros(0), None, [])
    chosen = bounded_sample(labels, "domain", sample_rows)  # about sample_rows x domains narrow rows
    words = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "domain", F.explode(word_buckets()).alias("bucket"))
    counts = write_stage(words.groupBy("bucket").pivot("domain", domains).count().na.fill(0), "words")
    names = [F.col(f"`{d}`") for d in domains]
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"t{i}") for i, c in enumerate(names)]).first()
    logs = [F.log((c + F.lit(smoothing)) / F.lit(totals[i] + smoothing * BUCKETS)) for i, c in enumerate(names)]
    weights = write_stage(counts.select("bucket", *[(x - logs[0]).alias(f"w{i}") for i, x in enumerate(logs) if i]), "weights")
    unseen = [float(np.log((totals[0] + smoothing * BUCKETS) / (totals[i] + smoothing * BUCKETS))) for i in range(1, len(domains))]
    prior = np.array([shares[d] for d in domains], dtype=float)
    return DomainModel(domains, prior / prior.sum(), weights, unseen)


def posteriors(docs: DataFrame, model: DomainModel, keys: dict[str, Column]) -> DataFrame:
    """A row per document: ``keys``, ``_tokens`` and ``_posterior``, an array.

    Words meet their weights in a broadcast join (``BUCKETS`` rows at most) and are summed per
    row before any shuffle. Evidence grows with the square root of the length, as words of one
    text are not independent.
    """
    k = len(model.domains)
    # The row number must be given before the rows are taken apart.
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[c.alias(n) for n, c in keys.items()], word_buckets().alias("_buckets"))
    named = rows.select("_row", *keys, F.explode_outer("_buckets").alias("bucket"))
    if k > 1:
        named = named.join(F.broadcast(model.weights), "bucket", "left")
    sums = [F.sum(F.when(F.col("bucket").isNotNull(), F.coalesce(f"w{i}", F.lit(model.unseen[i - 1]))).otherwise(0.0)).alias(f"_s{i}")
            for i in range(1, k)]
    scored = named.groupBy("_row", *keys).agg(F.count("bucket").cast("double").alias("_tokens"), *sums)
    root = F.sqrt(F.greatest(F.col("_tokens"), F.lit(1.0)))
    logs = [F.lit(float(np.log(model.prior[i]))) + (F.col(f"_s{i}") / root if i else F.lit(0.0)) for i in range(k)]
    scored = scored.withColumn("_logs", F.array(*logs) if k else F.array().cast("array<double>"))
    scored = scored.withColumn("_odds", F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))))
    total = F.aggregate("_odds", F.lit(0.0), lambda acc, x: acc + x)
    return scored.select(*keys, "_tokens", F.transform("_odds", lambda x: x / total).alias("_posterior"))


def cell_of(posterior: Column) -> Column:
    """The posterior to ``DIGITS`` significant digits; only a grouping key and the direction of a step."""
    def short(x: Column) -> Column:
        unit = F.pow(F.lit(10.0), F.floor(F.log10(x)))
        return F.when(x > 1e-300, F.round(x / unit, DIGITS - 1) * unit).otherwise(F.lit(0.0))
    return F.transform(posterior, short)


def rate_of(posterior: Column, steps: list[list[float]]) -> Column:
    """Rate of a posterior's cell after the given gradient steps, each the K residuals as scaled for the step."""
    return _rate_in(cell_of(posterior), steps)


def _rate_in(cell: Column, steps: list[list[float]]) -> Column:
    rate = F.lit(1.0)
    if not steps:
        return rate
    history = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(history, rate, lambda r, h: F.greatest(
        F.lit(0.0), r - sum((cell[i] * h[i] for i in range(len(steps[0]))), F.lit(0.0))))


def fit_rates(scored: DataFrame, model: DomainModel, targets: dict[str, float], relative: bool = False,
              tolerance: float = 1e-5) -> list[list[float]]:
    """Gradient steps that define every document's rate through ``rate_of``.

    ``targets`` are token shares of the domains; with ``relative``, factors on the shares that the
    corpus has by itself. Either are scaled to a sum of 1.

    Residuals are weighted by the inverse of the domains' Gram matrix, taken over the tokens
    whose rate is not held at zero: that gives the least squares unit curvature, so the step
    length is 1 and few steps suffice. Should such a step not come nearer, it is taken back and
    the matrix over all tokens used from there on, for which descent is certain.
    """
    k = len(model.domains)
    if k == 0:
        return []
    cells = scored.groupBy(cell_of(F.col("_posterior")).alias("_cell")).agg(
        F.sum("_tokens").alias("_tokens"), *[F.sum(F.col("_tokens") * F.col("_posterior")[i]).alias(f"_m{i}") for i in range(k)]).where("_tokens > 0").cache()
    p, t, m = F.col("_cell"), F.col("_tokens"), [F.col(f"_m{i}") for i in range(k)]
    wanted = np.array([targets.get(d, 0.0) for d in model.domains], dtype=float)
    goal = np.zeros(k)
    corners = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(steps: list[list[float]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens, residual of each domain's share, inverse Gram matrix of the rows in play."""
        free = F.when(F.col("_r") > 0, 1.0).otherwise(0.0)
        row = cells.select(t, p, *m, _rate_in(p, steps).alias("_r")).agg(
            F.sum(t).alias("total"), *[F.sum(m[i] * F.col("_r")).alias(f"r{i}") for i in range(k)],
            *[F.sum(free * m[i] * m[j] / t).alias(f"g{i}_{j}") for i, j in corners]).first()
        total = row["total"] or 0.0
        if not total:
            return 0.0, goal, goal
        gram = np.zeros((k, k))
        for i, j in corners:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] / total
        return total, np.array([row[f"r{i}"] for i in range(k)]) / total - goal, _inverse(gram)

    steps: list[list[float]] = []
    total, natural, weight = sums(steps)
    goal = wanted * natural if relative else wanted
    goal = goal / max(goal.sum(), 1e-12)
    residual = natural - goal
    every, certain = weight, False
    for _ in range(STEPS if total else 0):
        if (np.abs(residual) <= np.where(goal > 0, np.minimum(tolerance, goal / 100), tolerance)).all():
            break
        steps.append([float(x) for x in (every if certain else weight) @ residual])
        size = residual @ every @ residual
        _, after, weight = sums(steps)
        if after @ every @ after < size * (1 - 1e-6):
            residual = after
        elif certain:  # as near as nonnegative rates come
            break
        else:
            steps.pop()
            certain = True
    cells.unpersist()
    return steps


def _inverse(gram: np.ndarray) -> np.ndarray:
    """Pseudo-inverse at unit diagonal, so that a thinly spread domain is not taken for a dependent one."""
    size = np.sqrt(np.diag(gram))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    return np.outer(scale, scale) * np.linalg.pinv(gram * np.outer(scale, scale), rcond=1e-6, hermitian=True)


def _copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], seed: int = 1,
          relative: bool = False) -> tuple[DataFrame, DomainModel, list[list[float]]]:
    """``(doc_id, text_hash, tokens, posterior, rate, copies)`` of every row, with the model and the steps.

    ``copies`` is the rate's whole part plus one with the probability of the rest, by a hash of the
    row. Posteriors are written once; the fit and the result read them, not the texts.
    """
    model = fit_domains(docs, labels)
    keys = {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text"), "_draw": _draw(seed)}
    scored = write_stage(posteriors(docs, model, keys), "posteriors")
    steps = fit_rates(scored, model, targets, relative)
    rated = scored.withColumn("rate", rate_of(F.col("_posterior"), steps))
    return rated.select("doc_id", "text_hash", F.col("_tokens").cast("long").alias("tokens"), F.col("_posterior").alias("posterior"),
                        "rate", _copies(F.col("rate"), F.col("_draw")).alias("copies")), model, steps


def reached(rated: DataFrame, model: DomainModel) -> DataFrame:
    """``(domain, natural, share)``: token shares of the domains by themselves and at the fitted rates, of ``rates``' rows."""
    each = rated.select("tokens", "rate", F.explode(F.arrays_zip(F.lit(model.domains).cast("array<string>").alias("domain"), F.col("posterior").alias("p"))).alias("x"))
    sums = each.groupBy("x.domain").agg(F.sum(F.col("tokens") * F.col("x.p")).alias("before"), F.sum(F.col("tokens") * F.col("x.p") * F.col("rate")).alias("after"))
    total = rated.agg(F.sum("tokens")).first()[0] or 0
    return sums.select("domain", F.try_divide("before", F.lit(total)).alias("natural"), F.try_divide("after", F.lit(total)).alias("share"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], seed: int = 1, relative: bool = False) -> DataFrame:
    """Every row of ``docs`` as often as its rate says; columns unchanged."""
    rated, _, _ = rates(docs, labels, targets, seed, relative)
    times = unused_name(docs, "_copies")
    # Rows of equal id and text have equal rates and draws.
    copies = rated.where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("copies").alias(times)).distinct()
    found = docs.join(copies, docs["doc_id"].eqNullSafe(copies["_id"]) & (F.xxhash64(docs["text"]) == copies["_hash"]))
    count = unused_name(docs, "_copy")
    return found.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies[times])).alias(count)).drop(count)


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labelled table: toxic, low quality, and good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(
        F.col("quality") == 1, "good").alias("domain"))
