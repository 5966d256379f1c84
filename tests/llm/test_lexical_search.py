"""Ranked search against a plain scan that scores every document for every item."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import lexical_search as ls


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append("".join(x.lower() if x.isascii() else x for x in word))
            word = ""
        else:
            word += c
    return out


def plain_search(docs, items, top=10):
    """``docs`` and ``items`` are (id, text) lists."""
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(plain_terms(text))
    out = {}
    for item, terms in asked.items():
        found = []
        for i, words, tf in held:
            m = 100 - 75 + (75 * len(words) * n) // total
            score = sum(reps * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t, reps in terms.items() if tf[t])
            if score > 0:
                found.append((-score, i is not None, i if i is not None else 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:top], 1):
            out[item, rank] = (i, -score)
    return out


def found(frame):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in frame.collect()}


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(600)] + ["Élan", "ÉLAN", "élan", "naïve", "STRASSE", "straße", "x1", "X1"]
    docs = [(k, rng.choice([" ", "\n", " - ", "_"]).join(rng.choice(words) for _ in range(int(rng.paretovariate(0.7) * 5) % 900)))
            for k in range(n)]
    docs += [(7, docs[7][1]), (1000, docs[9][1]), (1001, docs[9][1]), (None, docs[11][1]), (None, None), (5000, ""), (5001, "?! -"),
             (6000, "w1 " * 30000), (6001, " ".join(f"long{k}" for k in range(9000)) + " w1 élan")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(25)]
    items += [(25, docs[9][1]), (25, "w1 w2"), (26, None), (27, "?"), (28, "neverseen"), (None, "w1 élan"), (29, "w1 w1 w1 W1"), (30, "long17 w1")]
    return docs, items


def test_same_as_a_plain_scan(spark):
    docs, items = corpus()
    d, i = tables(spark, docs, items)
    assert found(ls.search(d.repartition(5), i)) == plain_search(docs, items)


def test_copies_and_a_common_word(spark):
    """A third of all rows are copies, another third hold one word: ties go by id."""
    docs = [(k, "common alpha beta gamma") for k in range(200)] + [(k, f"common filler{k}") for k in range(200, 400)]
    docs += [(k, f"plain{k} text") for k in range(400, 600)]
    items = [(1, "common"), (2, "alpha gamma"), (3, "plain450 text common"), (4, "filler399 filler201")]
    d, i = tables(spark, docs, items)
    assert found(ls.search(d.repartition(9), i)) == plain_search(docs, items)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = corpus(4, 120)
    d, i = tables(spark, docs, items)
    whole = found(ls.search(d, i))
    monkeypatch.setattr(ls, "ITEM_BLOCK", 7)
    monkeypatch.setattr(ls, "TERM_BLOCK", 40)
    assert sum(1 for _ in ls.query_blocks(i)) > 3
    assert found(ls.search(d, i)) == whole == plain_search(docs, items)


def test_bounds_never_fall_below_the_score(spark, monkeypatch):
    """Also where the filters are far too small and nearly every bit is set."""
    docs, items = corpus(5, 150)
    for bits in (8, 1):
        monkeypatch.setattr(ls, "BITS_PER_KEY", bits)
        monkeypatch.setattr(ls, "LEAST_BITS", 8)
        blocks = [row for out in ls._index(iter(_batches(docs))) for row in out.to_pylist()]
        index = ls.Index(None, sum(len(b["ids"]) for b in blocks), sum(sum(b["lens"]) for b in blocks))
        terms = sorted({t.encode() for _, text in items for t in plain_terms(text)})
        counts = np.array([[Counter(plain_terms(text))[t.decode()] for t in terms] for _, text in items])
        queries = ls.Queries([k for k, _ in items], terms, counts, np.arange(len(terms)) + 5)
        bounds = ls._Bounds(queries, index)
        texts = {}
        for k, text in docs:
            texts.setdefault(k, []).append(Counter(plain_terms(text)))
        for b in blocks:
            bound = bounds.of(b["width"], b["rows"], np.array(b["lens"]), np.array(b["tops"]), b["slices"])
            for column, doc in enumerate(b["ids"]):
                tf = next(c for c in texts[doc] if sum(c.values()) == b["lens"][column])
                m = 25 + 75 * b["lens"][column] * index.documents // index.terms
                factor = np.array([1000000000 * tf[t.decode()] // (1000 * tf[t.decode()] + 8 * m) for t in terms])
                assert (bound[:, column] >= (counts * queries.weights) @ factor).all()


def _batches(docs):
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"])


def test_documents_below_the_threshold_are_not_scored(spark):
    """Items that copy a document exclude nearly all others by their bounds alone."""
    rng = random.Random(6)
    docs = [(k, " ".join(f"t{rng.randint(0, 5000)}" for _ in range(60))) for k in range(800)]
    items = [(k, docs[k * 11][1]) for k in range(10)]
    docs += [(2000 + 20 * k + j, docs[k * 11][1] + f" extra{j}") for k in range(10) for j in range(12)]
    d, i = tables(spark, docs, items)
    index = ls.build_index(d)
    queries = ls.weigh(d, index, next(ls.query_blocks(i)))
    assert ls.candidates(d, index, queries).count() <= 0.05 * len(docs) * len(items)
    assert found(ls.search(d, i, index)) == plain_search(docs, items)


@pytest.mark.parametrize("side", ["docs", "items", "both"])
def test_empty_tables(spark, side):
    docs, items = [(1, "a b")], [(1, "a")]
    d, i = tables(spark, [] if side != "items" else docs, [] if side != "docs" else items)
    assert ls.search(d, i).count() == 0


def test_extra_columns_that_clash(spark):
    docs, items = corpus(8, 60)
    d, i = tables(spark, docs, items)
    want = found(ls.search(d, i))
    for name in ("item", "doc", "bound", "items", "rank", "score", "place", "term", "n", "width", "ids", "lens"):
        d, i = d.withColumn(name, F.lit("x")), i.withColumn(name, F.lit("y"))
    i = i.withColumn("doc_id", F.lit(3))
    d = d.withColumn("item_id", F.lit(3))
    assert found(ls.search(d, i)) == want
