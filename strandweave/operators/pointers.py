"""Lists of rows that point at one another: where each one leads to, and how far it is.

Pointer doubling between posts: every row takes over its pointer's pointer until that is a post, a row picked by hash. Posts are
a shorter list, treated alike. Once rows are few enough for one task (``LOCAL_ROWS``), that task follows them to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut_lineage, stacked

# Rows under way that one task may finish, of a few numbers each.
LOCAL_ROWS = 200_000
# One row in so many is a post, at which the pointers of a round stop.
POST_EVERY = 4
HOT_KEYS = 10_000

_ROW = "id long, ptr long, dist long, weight long, done boolean"
_COLUMNS = [c.split(" ")[0] for c in _ROW.split(", ")]


def follow(links: DataFrame, local_rows: int | None = None) -> DataFrame:
    """``(id, ptr, dist, weight, done)``: the end of every row's list, with the sums on the way there.

    A row with ``done`` is an end: its ``ptr`` is what the rows that lead to it receive. Rows that lead
    round in a ring stay not done, wherever they point.
    """
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    return _to_ends(cut_lineage(links.select(*_COLUMNS)), local_rows, 0)


def _to_ends(state: DataFrame, local_rows: int, level: int) -> DataFrame:
    """``follow`` by way of posts, one row in ``POST_EVERY`` picked by hash.

    Pointers double until they lead to a post or an end, so rounds and rows under way depend on the gaps between posts and not
    on the length of lists. The posts are a list of their own; what becomes of them is handed on by one join.
    """
    left = state.where(~F.col("done")).count()
    if left <= local_rows:
        return _finish(state) if left else state

    def at_post(name: str):
        return F.pmod(F.xxhash64(F.col(name), F.lit(level)), F.lit(POST_EVERY)) == 0

    # A round writes only the rows it moved; those that have arrived stay where they are.
    arrived = F.col("done") | at_post("ptr")
    still, settled, moved = ~arrived, None, state
    now = moved.where(still).count()
    while now:
        left = now
        jump = moved if settled is None else stacked(settled, moved)
        jump = jump.where(~at_post("id")).select(F.col("id").alias("ptr"), *[F.col(c).alias(f"{c}2") for c in _COLUMNS[1:]])
        walking = moved.where(still)
        settled = moved.where(arrived) if settled is None else stacked(settled, moved.where(arrived))
        moved = cut_lineage((F.broadcast(walking) if now <= local_rows else walking).join(jump, "ptr").select(
            "id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"),
            (F.col("weight") + F.col("weight2")).alias("weight"), F.col("done2").alias("done")))
        now = moved.where(still).count()
        # While a list is unfinished each round finishes some of its rows, so what no longer shrinks can only be rings.
        if now == left:
            break
    state = moved if settled is None else stacked(settled, moved)
    # A post that leads into a ring without posts is as good as a ring of its own.
    posts = state.where(at_post("id")).withColumn("ptr", F.when(still, F.col("id")).otherwise(F.col("ptr")))
    ends = _to_ends(cut_lineage(posts), local_rows, level + 1)
    rest = state.where(~at_post("id"))
    handed = rest.where(~F.col("done") & at_post("ptr")).join(
        ends.select(F.col("id").alias("ptr"), *[F.col(c).alias(f"{c}2") for c in _COLUMNS[1:]]), "ptr").select(
        "id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"),
        (F.col("weight") + F.col("weight2")).alias("weight"), F.col("done2").alias("done"))
    return cut_lineage(stacked(stacked(rest.where(F.col("done") | ~at_post("ptr")), handed), ends))


def join_by_key(rows: DataFrame, one: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join with a table of one row per ``key``, however many rows one key holds.

    ``size`` of ``one`` is the number of rows of its key and ``total`` that of all. Keys with more than one row in
    ``HOT_KEYS``, fewer than so many keys, are looked up in a broadcast table, so none of them fills a task.
    """
    crowded = F.col(size) * HOT_KEYS > total
    hot, rest = F.broadcast(one.where(crowded)), one.where(~crowded)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def in_one_task(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on rows that are known to be few."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            yield work(pd.concat(held, ignore_index=True))
    return rows.repartition(1).mapInPandas(run, schema)


def _finish(state: DataFrame) -> DataFrame:
    """The rows under way and the ends they point at, at most twice ``LOCAL_ROWS``, in one task."""
    going = state.where(~F.col("done"))
    ends = state.where("done").join(going.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi").select(*_COLUMNS)
    last = in_one_task(going.unionByName(ends), _to_the_end, _ROW)
    return cut_lineage(stacked(state.where("done"), last))


def _to_the_end(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, ptr, dist, weight, done = (rows[c].to_numpy()[order] for c in _COLUMNS)
    ptr, dist, weight, done = ptr.copy(), dist.copy(), weight.copy(), done.astype(bool)
    mine = ~done
    for _ in range(len(ids).bit_length() + 1):
        going = np.flatnonzero(~done)
        if not len(going):
            break
        at = np.searchsorted(ids, ptr[going])
        dist[going] += dist[at]
        weight[going] += weight[at]
        ptr[going], done[going] = ptr[at], done[at]
    # Rows of a ring have gone round it any number of times; only that they never end is told.
    out = pd.DataFrame({"id": ids, "ptr": ptr, "dist": dist, "weight": weight, "done": done})[mine]
    ring = ~out["done"].to_numpy()
    out.loc[ring, ["dist", "weight"]] = 0
    return out


def ring_names(links: DataFrame, local_rows: int | None = None) -> DataFrame:
    """``(id, ring)`` of rows ``(id, ptr)`` that all lie on rings: the least id of each one's ring."""
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    state = cut_lineage(links.select("id", "ptr", F.least("id", "ptr").alias("ring")))
    if state.count() <= local_rows:
        return in_one_task(state, _name_rings, "id long, ring long")
    before = None
    while True:
        now = state.agg(F.sum(F.col("ring").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return state.select("id", "ring")
        before = now
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("ring").alias("ring2"))
        state = cut_lineage(state.join(jump, "ptr").select(
            "id", F.col("ptr2").alias("ptr"), F.least("ring", "ring2").alias("ring")))


def _name_rings(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, ring = ids[order], rows["ring"].to_numpy(np.int64)[order]
    ptr = np.searchsorted(ids, rows["ptr"].to_numpy(np.int64)[order])
    for _ in range(len(ids).bit_length() + 1):
        ring, ptr = np.minimum(ring, ring[ptr]), ptr[ptr]
    return pd.DataFrame({"id": ids, "ring": ring})
