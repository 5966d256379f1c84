"""Decontamination against every window of every item, word by word."""

import hashlib
from collections import defaultdict

import pytest
from test_ngram_join import WORD, lowered

from strandweave.llm import decontaminate as dc


def expected(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lowered(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((-1 if doc is None else doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def compare(docs, benchmark, **kw):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    got = dc.contamination(docs, benchmark, **kw).drop("spans").collect()
    want = expected(rows, items)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == want
    clean = sorted(r[0] for r in want if not r[5])
    kept = dc.drop_contaminated(docs, benchmark, **kw)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == clean
    return want


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([
        (1, "two three four five six seven eight nine ten eleven"), (1, "a text without any id at all"), (2, "É, ZOLA"),
        (3, "word word word word word word word word word word word"), (None, "sea"), (4, None), (5, ""), (6, "?!"),
        (7, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    ], "item_id long, text string")


def test_against_every_window(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert sum(r[5] for r in compare(documents, benchmark)) > 0


@pytest.mark.parametrize("block", [dc.BLOCK, 2])
def test_odd_rows_in_one_and_many_blocks(odd, clashing, items, block):
    want = compare(odd, items, block=block)
    assert {r[5] for r in want} == {True, False}
    assert dc.contamination(clashing, items, block=block).count() == odd.count()


def test_empty_tables(odd, nothing, items):
    assert {r["contaminated"] for r in dc.contamination(odd, items.limit(0)).collect()} == {False}
    assert dc.contamination(nothing, items).count() == 0
    assert dc.drop_contaminated(odd, items.limit(0)).count() == odd.count()


def test_dropping_in_one_and_many_blocks(odd, clashing, items, documents):
    for docs in (clashing, documents.where("doc_id < 200")):
        one = sorted(map(str, dc.drop_contaminated(docs, items).collect()))
        assert sorted(map(str, dc.drop_contaminated(docs, items, block=2).collect())) == one
        clean = dc.contamination(docs, items, block=2).where("not contaminated").count()
        assert len(one) == clean
