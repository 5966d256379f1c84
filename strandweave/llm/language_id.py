"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 code points, Latin letters lower-cased),
weighted by relative frequency times inverse document frequency. Document frequencies are
counted over every training document. The regression is trained per coordinate with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled
rows (``sample_rows`` per language); a held-back fifth of that sample calibrates the
temperature of the probabilities.

Defined results: null text, empty text and text without any letter give ``und`` and
score 0. Repeated rows are scored alike. With no training language at all every text is
``und``. Columns of the input besides the key and the text are ignored.
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

DIMS = 1 << 15
GRAMS = (1, 2, 3)
SCALE = 32.0
UNKNOWN = "und"

_SEEDS = np.array([0x85EBCA6B, 0x9E3779B1, 0xC2B2AE35], dtype=np.uint32)


@dataclass
class LanguageModel:
    """``weights`` has a row per hashed n-gram (idf included) and a column per language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _lowered(points: np.ndarray) -> np.ndarray:
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return points + (upper.astype(np.uint32) << np.uint32(5))


def gram_features(texts: arrays.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: hashed features of a chunk and their row bounds."""
    points, bounds = arrays.code_points(texts)
    points = _lowered(points)
    for n in GRAMS:
        if len(points) < n:
            yield np.zeros(0, dtype=np.int32), np.zeros(texts.rows + 1, dtype=np.int64)
            continue
        count = len(points) - n + 1
        mixed = points[:count] * _SEEDS[0] + np.uint32(n)
        for j in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint32(15))) * _SEEDS[1] + points[j:j + count] * _SEEDS[2]
        mixed = (mixed ^ (mixed >> np.uint32(13))) * _SEEDS[0]
        hashed = (mixed >> np.uint32(17)).astype(np.int32)
        # A window belongs to a row if it ends inside that row.
        starts, stops = bounds[:-1], np.maximum(bounds[1:] - n + 1, bounds[:-1])
        inside = np.zeros(count + 1, dtype=np.int32)
        np.add.at(inside, np.minimum(starts, count), 1)
        np.add.at(inside, np.minimum(stops, count), -1)
        kept = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        sizes = np.concatenate([[0], np.cumsum(stops - starts)])
        yield hashed[kept], sizes


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(DIMS, dtype=np.int64)
    for batch in batches:
        for texts in arrays.chunks(batch.column(0), 1 << 19):
            for low in range(0, texts.rows, 256):
                high = min(low + 256, texts.rows)
                part = arrays.Texts(texts.data[texts.bounds[low]:texts.bounds[high]],
                                    texts.bounds[low:high + 1] - texts.bounds[low], low)
                marks = np.zeros((part.rows, DIMS), dtype=bool)
                flat = marks.reshape(-1)
                for hashed, bounds in gram_features(part):
                    flat[arrays.row_of(bounds) * DIMS + hashed] = True
                seen += marks.sum(axis=0, dtype=np.int64)
    found = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], ["feature", "n"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each hashed n-gram occurs: one partial row per task and feature, summed."""
    partial = texts.select("text").mapInArrow(_document_frequencies, "feature int, n long")
    out = np.zeros(DIMS, dtype=np.float64)
    for row in partial.groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():  # at most DIMS rows
        out[row["feature"]] = row["n"]
    return out


def _sparse_rows(column: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for texts in arrays.chunks(column):
        parts = list(gram_features(texts))
        for i in range(texts.rows):
            grams = [h[b[i]:b[i + 1]] for h, b in parts]
            counts = np.bincount(np.concatenate(grams), minlength=1)
            idx = np.flatnonzero(counts)
            total = max(1, sum(map(len, grams)))
            yield idx, counts[idx] / total * idf[idx] * SCALE


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, *, epochs: int = 4,
               alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate follow-the-regularised-leader; returns weights and bias.

    ``l1`` and ``l2`` are the elastic net: a weight stays zero until its gradient sum leaves
    the ``l1`` band.
    """
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            idx, values = rows[i]
            idx, values = np.append(idx, DIMS), np.append(values, 1.0)
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = values[:, None] * p
            grown = ni + g * g
            z[idx] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[idx] = grown
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the logits with the least negative log likelihood, by golden section."""
    if len(labels) == 0:
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _trainer(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[str] = []
        for batch in batches:
            rows += list(_sparse_rows(batch.column(0), idf))
            names += batch.column(1).to_pylist()
        languages = sorted(set(names))
        labels = np.array([languages.index(x) for x in names], dtype=np.int64)
        back = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
        kept = np.flatnonzero(~back)
        w, b = train_ftrl([rows[i] for i in kept], labels[kept], max(1, len(languages)))
        logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in np.flatnonzero(back)]).reshape(-1, max(1, len(languages)))
        temperature = fit_temperature(logits, labels[back])
        yield pa.RecordBatch.from_arrays(
            [pa.array([languages], pa.list_(pa.string())), pa.array([(w * idf[:, None]).astype(np.float32).tobytes()], pa.binary()),
             pa.array([b.tobytes()], pa.binary()), pa.array([temperature], pa.float64())],
            ["languages", "weights", "bias", "temperature"])
    return run


def fit(training: DataFrame, *, sample_rows: int = 600) -> LanguageModel:
    """Train on ``training(doc_id, text, lang)``.

    Document frequencies use all its rows; the regression uses at most about
    ``sample_rows`` rows of each language (a bounded sample, fitted in one task). Rows
    without text or language are left out.
    """
    training = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    seen = document_frequencies(training)
    idf = np.log((1.0 + seen.max(initial=0.0)) / (1.0 + seen)) + 1.0
    # Few rows: ordering them makes the fit independent of how tasks are scheduled.
    sample = bounded_sample(training, "lang", sample_rows).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text")
    row = sample.select("text", "lang").mapInArrow(
        _trainer(idf), "languages array<string>, weights binary, bias binary, temperature double").first()
    if row is None:  # no training rows
        return LanguageModel([], np.zeros((DIMS, 1), dtype=np.float32), np.zeros(1), 1.0)
    classes = max(1, len(row["languages"]))
    return LanguageModel(list(row["languages"]), np.frombuffer(row["weights"], dtype=np.float32).reshape(DIMS, classes),
                         np.frombuffer(row["bias"], dtype=np.float64), row["temperature"])


def score_column(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language number (``len(languages)`` if unknown) and probability of each text."""
    width = max(1, len(model.languages))
    picks, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for texts in arrays.chunks(column):
        points, point_bounds = arrays.code_points(texts)
        has_letter = arrays.row_sums(arrays.letters()[points].astype(np.int64), point_bounds) > 0
        total, count = np.zeros((texts.rows, width)), np.zeros(texts.rows)
        for hashed, bounds in gram_features(texts):
            rows = arrays.row_of(bounds)
            for k in range(width):
                total[:, k] += np.bincount(rows, weights=model.weights[:, k][hashed], minlength=texts.rows)
            count += np.diff(bounds)
        logits = (total * (SCALE / np.maximum(count, 1))[:, None] + model.bias) / model.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        known = has_letter & (len(model.languages) > 0)
        picks.append(np.where(known, p.argmax(axis=1), len(model.languages)))
        scores.append(np.where(known, p.max(axis=1), 0.0))
    return np.concatenate(picks), np.concatenate(scores)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row; the model (a few MB at most) rides with the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            pick, score = score_column(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[pick], pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose language is known with at least ``min_score``; columns unchanged."""
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick, score = score_column(model, batch.column(text_at))
            yield batch.filter(pa.array((pick < len(model.languages)) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)
