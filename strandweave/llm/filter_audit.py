"""How five document filters act on one another, in every order in which they can be applied.

A document's behaviour under all orders follows from its *mask*: which filters it fails. A
mask maps to one wide integer with a packed field for each of the 600 step outcomes (120
orders of five steps: removed by this step or not) and one more that counts the document. Integers of
documents add up field by field, so the sum over a part holds every figure of the audit:

* kept after a step: the count less all removals of the order up to it;
* failing a filter: removed where that filter comes first; so redundant is failing less removed;
* failing that filter only: removed where it comes last.

Sums are exact at any size: a field is as wide as the number of documents of the part needs, so no
field can overflow into its neighbour.

Masks are counted before anything is shuffled by part (at most 128 combinations of mask and labels
in a part), so what a task adds up per part is bounded, however large the part.

Defined results: null texts are empty; null sources are the part ''. A document fails E if some row
of the same whole text has a smaller doc_id; rows of equal text and equal doc_id do not fail each
other. A null doc_id orders below all others and has no labels. Several labels of a document count
as set if any is 1; null labels are not set. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(LETTERS))
STEPS = len(LETTERS)
FIELDS = len(ORDERS) * STEPS

# Fixed limits of the filters.
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"

_RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
           "unique_fails long, good_lost long, toxic_lost long, shapley long, filter string")


def text_mask(text: str = "text"):
    """Bits 0 to 3 of a document's mask: which of the filters A to D its text fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    fails = (
        count < MIN_WORDS,
        distinct.cast("long") * 100 < count.cast("long") * MIN_DISTINCT_PERCENT,
        upper.cast("long") * 100 > F.length(whole).cast("long") * MAX_UPPER_PERCENT,
        whole.rlike(SYMBOLS),
    )
    return sum(F.when(test, 1 << i).otherwise(0) for i, test in enumerate(fails))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents of each mask, E included.

    Texts leave the first scan as digests. Copies are folded by (digest, doc_id) and then by
    digest, both with map-side combine, so a text shared by a third of all rows is a few rows.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_mask().alias("mask"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"),
    )
    # Rows of one id and text first: repeated rows tie and are told apart only by their number.
    labelled = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    cells = labelled.groupBy(
        "digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    ).agg(
        F.sum("n").alias("n"),
        # The least id and the rows that have it; a null id sorts first.
        F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id"))).alias("low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.col("n").alias("at")))).alias("first"),
    )
    least = cells.groupBy("digest").agg(F.min("low").alias("least"))
    first_rows = F.when(~F.col("least.named"), F.col("unnamed")).when(
        F.col("low") == F.col("least"), F.col("first.at")).otherwise(0)
    told = cells.join(least, "digest").select("part", "mask", "good", "toxic", "n", first_rows.alias("first_n"))
    halves = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first_n").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("first_n")).alias("n")),
    )
    return (told.select("part", "good", "toxic", F.explode(halves).alias("h"))
            .where(F.col("h.n") > 0)
            .groupBy("part", F.col("h.mask").alias("mask"), "good", "toxic").agg(F.sum("h.n").alias("n")))


@lru_cache(maxsize=8)
def packed_masks(width: int) -> tuple[int, ...]:
    """The wide integer of each of the 32 masks, with fields of ``width`` bits.

    Field ``order * 5 + step`` is 1 where that step removes the document: its filter is the
    first of the order that the document fails. Field 600 is 1 for every document.
    """
    out = []
    for mask in range(1 << STEPS):
        value = 1 << (FIELDS * width)
        for i, order in enumerate(ORDERS):
            step = next((s for s, letter in enumerate(order) if mask >> LETTERS.index(letter) & 1), None)
            if step is not None:
                value += 1 << ((i * STEPS + step) * width)
        out.append(value)
    return tuple(out)


def unpack(total: int, width: int) -> list[int]:
    """The 600 step outcomes of a sum, and the number of documents last."""
    field = (1 << width) - 1
    if width % 8:
        return [total >> (k * width) & field for k in range(FIELDS + 1)]
    size = width // 8
    raw = total.to_bytes((FIELDS + 1) * size, "little")
    return [int.from_bytes(raw[k * size:(k + 1) * size], "little") for k in range(FIELDS + 1)]


def field_width(documents: int) -> int:
    """Bits of a field that no count of ``documents`` documents can overflow, in whole bytes."""
    return -(-max(1, documents.bit_length()) // 8) * 8


def _audit_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All figures of one part from its (at most 128) counted masks."""
    n = [int(x) for x in rows["n"]]
    width = field_width(sum(n))
    packed = packed_masks(width)
    sums = [0, 0, 0]
    for mask, good, toxic, count in zip(rows["mask"], rows["good"], rows["toxic"], n, strict=True):
        value = packed[int(mask)] * count
        sums[0] += value
        if good:
            sums[1] += value
        if toxic:
            sums[2] += value
    removed, good_lost, toxic_lost = (unpack(s, width) for s in sums)
    fails = {order[0]: removed[i * STEPS] for i, order in enumerate(ORDERS)}
    alone = {order[-1]: removed[i * STEPS + STEPS - 1] for i, order in enumerate(ORDERS)}
    shapley = dict.fromkeys(LETTERS, 0)
    for i, order in enumerate(ORDERS):
        for s, letter in enumerate(order):
            shapley[letter] += removed[i * STEPS + s]
    out = []
    for i, order in enumerate(ORDERS):
        kept = removed[FIELDS]
        for s, letter in enumerate(order):
            k = i * STEPS + s
            kept -= removed[k]
            out.append((key[0], order, s + 1, kept, removed[k], fails[letter] - removed[k], alone[letter],
                        good_lost[k], toxic_lost[k], shapley[letter], letter))
    return pd.DataFrame(out, columns=[f.split(" ")[0] for f in _RESULT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Figures per part, order and step; see the module's text.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley, filter)``: 600 rows for each source value.
    """
    return mask_counts(docs, labels).groupBy("part").applyInPandas(_audit_part, _RESULT)
