"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their first four and five bytes,
hashed to ``DIMS`` indices. The score is the logistic of a bias, a weight per present term
and a product of ``RANK`` factors for every pair of present terms, so a pair can count for
more than the sum of its terms. Training is stochastic with per-coordinate steps. Terms without
evidence, alone or in pairs, stay at zero, so long clean texts gather no score from many harmless
words: a first machine with factors for every supported term finds those that count with others, also where each of
them is as common in clean texts. Labels are fitted on a bounded sample, ``sample_rows`` per label.

Defined results: null and empty texts get the score of the bias. Without training rows
every score is 0.5 or below (label 0). Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import arrays
from strandweave.llm.common import bounded_sample

DIMS = 1 << 18
RANK = 4
PREFIXES = (4, 5)


@dataclass
class ToxicityModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def term_rows(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row, in order of rows, and row bounds."""
    data = arrays.ASCII_LOWER[texts.data]
    total = texts.prefix_hash(data)
    starts, ends, bounds = texts.words(arrays.ALNUM)
    hashed = [texts.span_hash(total, starts, ends)]
    hashed += [arrays.mix(texts.span_hash(total, starts, np.minimum(starts + n, ends)) + np.uint64(n)) for n in PREFIXES]
    rows = arrays.row_of(bounds).astype(np.uint64)
    keys = np.concatenate([(rows << np.uint64(18)) | (h >> np.uint64(46)) for h in hashed])
    keys = np.unique(keys)
    return (keys & np.uint64(DIMS - 1)).astype(np.int64), np.searchsorted(keys, np.arange(texts.rows + 1, dtype=np.uint64) << np.uint64(18))


def decision(model: ToxicityModel, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bias, linear part and all pairwise products of each row."""
    active = (model.linear[terms] != 0) | (model.factors[terms] != 0).any(axis=1)
    rows, used = arrays.row_of(bounds)[active], terms[active]
    n = len(bounds) - 1
    out = model.bias + np.bincount(rows, weights=model.linear[used], minlength=n)
    for f in range(model.factors.shape[1]):
        v = model.factors[used, f].astype(np.float64)
        out += 0.5 * (np.bincount(rows, weights=v, minlength=n) ** 2 - np.bincount(rows, weights=v * v, minlength=n))
    return out


def telling_terms(rows: list[np.ndarray], labels: np.ndarray, least: float = 3.0) -> np.ndarray:
    """Which terms occur so unevenly between the labels that chance is unlikely: |z| of two proportions."""
    toxic, clean = np.zeros(DIMS), np.zeros(DIMS)
    for idx, y in zip(rows, labels, strict=True):
        (toxic if y == 1 else clean)[idx] += 1
    n1, n0 = max(1.0, float((labels == 1).sum())), max(1.0, float((labels == 0).sum()))
    p = (toxic + clean) / (n1 + n0)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return np.abs(toxic / n1 - clean / n0) / spread >= least


def interacting_terms(rows: list[np.ndarray], labels: np.ndarray, telling: np.ndarray, *, support: int = 20,
                      least: float = 6.0, epochs: int = 6) -> np.ndarray:
    """Which terms count together with others, whether or not they tell anything alone.

    A first machine gives factors to every term of ``support`` rows or more, from small values and without decay. Factors of
    terms without interactions wander about a common length; those at least ``least`` times the median stand out.
    """
    seen = np.bincount(np.concatenate(rows), minlength=DIMS) if rows else np.zeros(DIMS)
    paired = telling | (seen >= support)
    trial = _descend(rows, labels, telling, paired, epochs=epochs, factor_l2=0.0)
    length = np.sqrt((trial.factors ** 2).sum(axis=1))
    return paired & (length >= least * np.median(length[paired])) if paired.any() else paired


def train(rows: list[np.ndarray], labels: np.ndarray, *, epochs: int = 12) -> ToxicityModel:
    """Train on the terms with evidence, alone (``telling_terms``) or with others (``interacting_terms``).

    All of these have a weight and factors; a term's factors move whatever its weight.
    """
    telling = telling_terms(rows, labels)
    chosen = telling | interacting_terms(rows, labels, telling)
    return _descend(rows, labels, chosen, chosen, epochs=epochs)


def _descend(rows: list[np.ndarray], labels: np.ndarray, weighted: np.ndarray, paired: np.ndarray, *, epochs: int, alpha: float = 0.3,
             l1: float = 0.3, l2: float = 1e-3, rate: float = 0.03, factor_l2: float = 1e-3) -> ToxicityModel:
    """Weights of ``weighted`` terms by follow-the-regularised-leader, factors of ``paired`` ones by adaptive gradient steps."""
    terms = [(r[weighted[r]], r[paired[r]]) for r in rows]
    z, n = np.zeros(DIMS), np.zeros(DIMS)
    factors, seen = np.random.default_rng(11).normal(0, 0.02, (DIMS, RANK)), np.full((DIMS, RANK), 1e-2)
    factors[~paired] = 0
    share = min(max(labels.mean() if len(labels) else 0.0, 1e-3), 0.999)
    bias, bias_seen = float(np.log(share / (1 - share))) if len(labels) else -1.0, 1.0
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    order = np.random.default_rng(13)

    def linear_at(idx: np.ndarray) -> np.ndarray:
        return -np.sign(z[idx]) * np.maximum(np.abs(z[idx]) - l1, 0.0) / ((1.0 + np.sqrt(n[idx])) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(terms)):
            idx, live = terms[i]
            w = linear_at(idx)
            v = factors[live]
            total = v.sum(axis=0)
            score = bias + w.sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
            g = (1.0 / (1.0 + np.exp(-np.clip(score, -30, 30))) - labels[i]) * balance[i]
            bias_seen += g * g
            bias -= 0.1 * g / bias_seen ** 0.5
            grown = n[idx] + g * g
            z[idx] += g - (np.sqrt(grown) - np.sqrt(n[idx])) / alpha * w
            n[idx] = grown
            gv = g * (total - v) + factor_l2 * v
            seen[live] += gv * gv
            factors[live] = v - rate * gv / np.sqrt(seen[live])
    return ToxicityModel(bias, linear_at(np.arange(DIMS)), factors)


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[np.ndarray] = []
    labels: list[int] = []
    for batch in batches:
        for texts in arrays.chunks(batch.column(0)):
            terms, bounds = term_rows(texts)
            rows += [terms[bounds[i]:bounds[i + 1]] for i in range(texts.rows)]
        labels += batch.column(1).to_pylist()
    model = train(rows, np.array(labels, dtype=np.float64))
    used = np.flatnonzero((model.linear != 0) | (model.factors != 0).any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.bias], pa.float64()), pa.array([used.astype(np.int32).tobytes()], pa.binary()),
         pa.array([model.linear[used].tobytes()], pa.binary()), pa.array([model.factors[used].astype(np.float32).tobytes()], pa.binary())],
        ["bias", "used", "linear", "factors"])


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4000) -> ToxicityModel:
    """Train on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``, in one task.

    At most about ``sample_rows`` rows of each label are used: few enough to be broadcast.
    """
    labelled = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(bounded_sample(labelled, "toxic", sample_rows))
    sample = (docs.select("doc_id", "text").join(chosen, "doc_id").repartition(1)
              .sortWithinPartitions(F.xxhash64("doc_id"), "text", "toxic"))
    row = sample.select("text", "toxic").mapInArrow(_trainer, "bias double, used binary, linear binary, factors binary").first()
    linear, factors = np.zeros(DIMS, dtype=np.float32), np.zeros((DIMS, RANK), dtype=np.float32)
    if row is None:  # no training rows
        return ToxicityModel(-1.0, linear, factors)
    used = np.frombuffer(row["used"], dtype=np.int32)
    linear[used] = np.frombuffer(row["linear"])
    factors[used] = np.frombuffer(row["factors"], dtype=np.float32).reshape(-1, RANK)
    return ToxicityModel(row["bias"], linear, factors)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row; the model's size is fixed by ``DIMS``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for texts in arrays.chunks(batch.column(1)):
                found.append(decision(shared.value, *term_rows(texts)))
            s = 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(found), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
