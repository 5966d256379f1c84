"""Every order applied document by document against the packed sums."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from strandweave.llm import filter_audit


def by_hand(docs, labels):
    """``docs`` are (doc_id, text, source); the filters run one after the other on every document."""
    marks = defaultdict(lambda: [False, False])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id][0] |= quality == 1
            marks[doc_id][1] |= toxic == 1
    rank = lambda d: (d is not None, d or 0)
    fails = []
    for doc_id, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = ""
        found += "A" if len(words) < 50 else ""
        found += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        found += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else ""
        found += "D" if any(c in "#$%&*|" for c in t) else ""
        found += "E" if any(rank(d) < rank(doc_id) and (x or "") == t for d, x, _ in docs) else ""
        fails.append(found)
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        share = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if letter in fails[i]]
                kept = [i for i in left if letter not in fails[i]]
                earlier = set(mine) - set(left)
                share[letter] += len(gone)
                out[part, order, step] = [
                    len(kept), len(gone), sum(letter in fails[i] for i in earlier),
                    sum(fails[i] == letter for i in mine),
                    sum(marks[docs[i][0]][0] for i in gone if docs[i][0] is not None),
                    sum(marks[docs[i][0]][1] for i in gone if docs[i][0] is not None)]
                left = kept
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(share[letter])
    return out


def figures(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in frame.collect()}


def corpus():
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "DELTA", "e#", "zetaé", "x|y", "one", "two", "three"]
    texts = [None, "", " ", "A", "#", "a\x0bb", "a b c"]
    texts += [" ".join(rng.choice(words[:rng.randint(2, 10)]) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    texts += [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k} Q" for k in range(60)), "w " * 3000]
    docs = [(k, rng.choice(texts), rng.choice(["a", "b", "", None])) for k in range(80)]
    docs += [(3, docs[3][1], "b"), docs[4], docs[4], (None, docs[5][1], "a"), (None, docs[5][1], "a"), (None, None, None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 80, 2)] + [(4, 1, 0), (None, 1, 1)]
    return docs, labels


def test_every_order_document_by_document(spark):
    docs, labels = corpus()
    got = figures(filter_audit.audit(
        spark.createDataFrame(docs, "doc_id long, text string, source string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == by_hand(docs, labels)


def test_one_text_in_most_rows(spark):
    """A third of the rows share one text, another third one source."""
    docs = [(k, "the same text", f"s{k % 3}") for k in range(300)] + [(k, f"text {k}", "s0") for k in range(300, 600)]
    rows = figures(filter_audit.audit(
        spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7),
        spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert sum(v[1] for (_, order, step), v in rows.items() if order == "EABCD" and step == 1) == 299
    assert rows["s0", "EABCD", 1][:2] == [100 - 99 + 300, 99]


def test_fields_never_overflow():
    """Sums far beyond 64 bits unpack to the counts that went in."""
    for documents in (1, 255, 256, 65_535, 10**9, 10**25):
        width = filter_audit.field_width(documents)
        packed = filter_audit.packed_masks(width)
        for mask in (0, 1, 19, 31):
            fields = filter_audit.unpack(packed[mask] * documents, width)
            assert fields[-1] == documents and set(fields) <= {0, documents}
            assert sum(f > 0 for f in fields[:-1]) == (120 if mask else 0)


def test_extra_columns_and_empty_tables(spark, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, good string")
    names = ("part", "mask", "digest", "good", "toxic", "n", "low", "first", "unnamed", "least", "source")
    from pyspark.sql import functions as F
    docs = clashing
    for name in names:
        docs = docs.withColumn(name, F.lit("y"))
    plain = clashing.withColumn("source", F.lit("y"))
    assert figures(filter_audit.audit(docs, labels)) == figures(filter_audit.audit(plain, labels))
    assert filter_audit.audit(nothing.withColumn("source", F.lit("x")), labels).count() == 0


@pytest.mark.parametrize("mask", range(32))
def test_a_mask_is_removed_once_per_order(mask):
    fields = filter_audit.unpack(filter_audit.packed_masks(8)[mask], 8)
    for i in range(120):
        assert sum(fields[i * 5:i * 5 + 5]) == (1 if mask else 0)
