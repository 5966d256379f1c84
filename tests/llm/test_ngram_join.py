"""The Jaccard join against all pairs of exact shingle sets."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from strandweave.llm import ngram_join as nj

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def shingles(text):
    w = WORD.findall(lowered(text))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def all_links(rows):
    """Links and class of each row number by comparing every pair that shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    common = Counter(p for members in where.values() for p in combinations(members, 2))
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = lambda v: -1 if v is None else v
    first = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        first[r] = min(first.get(r, least(doc)), least(doc))
    return sorted((least(doc), first[root(i)], links[i], len(sets[i])) for i, (doc, _) in enumerate(rows))


def compare(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(-1 if v is None else v for v in r) for r in nj.jaccard_join(docs).collect())
    assert got == all_links(rows)
    return got


def test_against_all_pairs(documents):
    assert sum(r[2] for r in compare(documents)) > 0


def test_odd_rows(odd, clashing):
    compare(odd)
    kept = nj.keep_one(clashing)
    assert kept.columns == clashing.columns
    rows = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    texts = [t for _, t in rows if t]
    assert len(texts) == len(set(texts))
    assert {t for _, t in rows} == {r["text"] or "" for r in odd.collect()}


def test_empty_table(nothing):
    assert nj.jaccard_join(nothing).count() == 0
    assert nj.keep_one(nothing).count() == 0


def near_copies(spark, count):
    """One large group of near copies: each differs from a common text in one or two words."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(count):
        words = list(base)
        words[(k * 7) % 150] = f"x{k}"
        if k % 3 == 0:
            words[(k * 11 + 40) % 150] = f"y{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"z{k}_{i}" for i in range(60))) for k in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [8, 256])
def test_large_group_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    got = compare(near_copies(spark, 60))
    assert sum(r[1] == 0 for r in got) == 60
    assert nj.keep_one(near_copies(spark, 60)).count() == 21


def test_pruning_keeps_what_may_reach_the_threshold():
    for n, m in nj.least_matches(0.8, nj.TOLERANCE):
        assert 0 < m < 0.8 * n
    rng = np.random.default_rng(3)
    sign = rng.integers(0, 2, (50, nj.HASHES), dtype=np.uint32)
    left, right = (x.ravel() for x in np.triu_indices(50, 1))
    kept = set(nj.surviving(sign, sign, left, right, 0.8).tolist())
    for p, (i, j) in enumerate(zip(left, right, strict=True)):
        ok = all((sign[i, :n] == sign[j, :n]).sum() >= m for n, m in nj.least_matches(0.8, nj.TOLERANCE))
        assert ok == (p in kept)
