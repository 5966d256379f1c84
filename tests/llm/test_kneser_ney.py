"""The language model against a plain one with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.llm import kneser_ney as kn
from strandweave.llm.common import fold_of

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["</s>"]


def discount(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    y = n[0] / max(n[0] + 2 * n[1], 1)
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k
        out.append(min(max(d, 0), k))
    return out


class Plain:
    def __init__(self, texts):
        self.uni, self.bi, self.after, self.before = Counter(), Counter(), defaultdict(list), Counter()
        for text in texts:
            last = "<s>"
            for t in tokens(text):
                self.uni[t] += 1
                self.bi[last, t] += 1
                last = t
        for (a, b), n in self.bi.items():
            self.after[a].append(n)
            self.before[b] += 1
        self.d2, self.d1 = discount(self.bi.values()), discount(self.before.values())

    def lower(self, w):
        c, total = self.before[w], len(self.bi)
        spared = sum(self.d1[min(v, 3)] for v in self.before.values())
        return max(c - self.d1[min(c, 3)], 0) / total + spared / total / (len(self.uni) + 1)

    def p(self, a, w):
        seen = self.after.get(a)
        if not seen:
            return self.lower(w)
        total, spared = sum(seen), sum(self.d2[min(v, 3)] for v in seen)
        c = self.bi[a, w]
        return max(c - self.d2[min(c, 3)], 0) / total + spared / total * self.lower(w)

    def score(self, text):
        known = tokens(text)
        return sum(math.log10(self.p(a, w)) for a, w in zip(["<s>", *known], known, strict=False))

    def base(self, text):
        n, v = sum(self.uni.values()), len(self.uni)
        return sum(math.log10((self.uni[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))


def compare(docs, training, buckets=None, monkeypatch=None):
    if buckets:
        monkeypatch.setattr(kn, "BUCKET_BYTES", buckets)
    model = kn.train(training)
    plain = Plain([r["text"] for r in training.collect()])
    assert model.words.tokens == sum(plain.uni.values()) and model.words.size == len(plain.uni)
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    got = kn.score(docs, model).collect()
    assert len(got) == sum(texts.values())
    want = sorted((i if i is not None else -1, len(tokens(t)), sum(x in plain.uni for x in tokens(t)), plain.base(t), plain.score(t))
                  for (i, t), n in texts.items() for _ in range(n))
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:3] == b[:3]
        assert b[3:] == pytest.approx(a[3:], rel=1e-9)
    return plain, have


def test_against_plain_model(documents, monkeypatch):
    compare(documents, documents.where(fold_of("doc_id", 10) != 0), 1 << 16, monkeypatch)


def test_odd_rows(odd, clashing, monkeypatch):
    compare(odd, odd, 1 << 14, monkeypatch)
    assert kn.score(clashing, kn.train(odd)).count() == odd.count()


def test_nothing_to_train_on(odd, nothing):
    model = kn.train(nothing)
    assert {r["score"] for r in kn.score(odd, model).collect()} == {0.0}
    assert kn.score(nothing, kn.train(odd)).count() == 0


def test_probabilities_sum_to_one(documents):
    plain = Plain([r["text"] for r in documents.limit(20).collect()])
    for a in ["<s>", *list(plain.uni)[:20], "never seen"]:
        assert sum(plain.p(a, w) for w in plain.uni) + plain.p(a, "unknown") == pytest.approx(1)


def test_small_tallies_are_flushed(documents, monkeypatch):
    monkeypatch.setattr(kn, "FLUSH", 1000)
    compare(documents.where("doc_id < 60"), documents.where("doc_id < 60"), 1 << 16, monkeypatch)


def test_held_out_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = kn.score(docs.where(fold_of("doc_id", 10) == 0), kn.train(docs.where(fold_of("doc_id", 10) != 0)))
    row = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]
    assert zlib.crc32(b"12") % 10 == held.sparkSession.range(12, 13).select(fold_of("id", 10)).first()[0]
