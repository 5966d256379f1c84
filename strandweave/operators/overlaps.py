"""Exact overlaps between reads in either orientation.

An overlap is a diagonal of two reads whose whole common window matches and is at
least L bases long. Such a window always begins at the start of one read (in some
orientation), so the search asks: which reads begin, with their first L bases, inside
which other reads? Ends of reverse strands are asked for in the same way, so only forward strands are searched.

To find them with one equi-join and few shuffled rows, the first L bases are
represented by one k-mer, the one with the least hash (its *anchor*). A read emits
the anchors of all of its L-windows; neighbouring windows mostly share theirs, so a
read shuffles about ``2 * (len - L) / w`` rows instead of ``len - L + 1`` for each strand. Equal
windows have equal anchors, so nothing is missed, and candidates are confirmed on the
sequences carried along with the join at two bits a base.

Anchors shared by very many read starts (adapters, low complexity) would make the
number of candidates quadratic although few of them match. They take another route:
a digest of the whole window, not its anchor, becomes the join key, so every joined row is a
result, confirmed on the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import kmer_runs
from strandweave.functions.anchors import window_anchors
from strandweave.functions.digests import prefix_digests, span_digests, suffix_digests
from strandweave.functions.packing import packed, same_bases
from strandweave.functions.sequence import (
    canonical_kmer,
    is_dna,
    kmer_is_rc,
    kmers,
    reverse_complement,
)
from strandweave.session import cut_lineage

OVERLAP_COLUMNS = ("f", "f_beg", "f_end", "g", "g_beg", "g_end", "rc")

MAX_ANCHOR_WINDOW = 64
ENOUGH_BASES = 21
# A window meets at most this many read starts through its anchor.
HOT_STARTS = 512
MAX_BROADCAST_ANCHORS = 100_000
# Anchors of the reads asked for that are sent to every executor, eight bytes each.
MAX_SOUGHT_ANCHORS = 1_000_000
# Runs of k-mers that may meet in one task for their key.
CROWDED_RUNS = 100_000


def kmer_occurrences(reads: DataFrame, k: int) -> DataFrame:
    """``(kmer, read_id, pos, rc)``: every canonical k-mer occurrence."""
    return reads.select("read_id", F.posexplode(kmers("seq", k)).alias("pos", "word")).select(
        canonical_kmer("word").alias("kmer"), "read_id", "pos", kmer_is_rc("word").alias("rc")
    )


def _read_kmers(reads: DataFrame, k: int) -> DataFrame:
    """``(seq, n)``: texts whose k-mers each occur ``n`` times in one more read.

    A read itself, or, where several rows are one read or letters differ from ACGT, each k-mer of it once.
    """
    repeated = cut_lineage(reads.groupBy("read_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("read_id").alias("again")))
    whole, loose = reads.where(is_dna("seq")), reads.where(~is_dna("seq"))
    if not repeated.isEmpty():
        same = F.col("read_id").eqNullSafe(F.col("again"))
        whole, loose = whole.join(repeated, same, "left_anti"), loose.join(repeated, same, "left_anti").unionByName(
            reads.join(repeated, same, "left_semi"))
    counted = kmer_occurrences(loose, k).groupBy("kmer", "read_id").agg(F.count("*").alias("n"))
    return whole.select("seq", F.lit(1).cast("long").alias("n")).unionByName(counted.select(F.col("kmer").alias("seq"), "n"))


def kmer_counts(reads: DataFrame, k: int, crowded: int = CROWDED_RUNS) -> DataFrame:
    """``(kmer, occurrences, reads)`` per canonical k-mer.

    K-mers travel in runs that share their least m-mer and are counted where all runs of one meet; see
    ``functions.kmer_runs``. K-mers under an m-mer of more than ``crowded`` runs are counted in their batch of reads and dealt one by one.
    """
    texts = _read_kmers(reads, k)
    known, other = texts.where(is_dna("seq")), texts.where(~is_dna("seq"))
    buckets = known.mapInArrow(kmer_runs.crowd(k), "bucket bigint, runs bigint").groupBy("bucket").agg(
        F.sum("runs").alias("runs")).where(F.col("runs") > crowded)
    buckets = [r["bucket"] for r in buckets.collect()]  # as many as have that many runs
    hot = []
    if buckets:
        keys = known.mapInArrow(kmer_runs.crowded_keys(k, buckets), "key bigint, runs bigint").groupBy("key").agg(F.sum("runs").alias("runs"))
        hot = [r["key"] for r in keys.where(F.col("runs") > crowded).select("key").collect()]
    rows = known.mapInArrow(kmer_runs.runs(k, hot), kmer_runs.RUN_TYPE)
    counted = rows.repartition("key").sortWithinPartitions("key").mapInArrow(kmer_runs.counts(k), kmer_runs.COUNT_TYPE)
    rest = other.groupBy(F.col("seq").alias("kmer")).agg(F.sum("n").alias("occurrences"), F.count("*").alias("reads"))
    return counted.unionByName(rest)


def anchor_geometry(min_len: int) -> tuple[int, int]:
    """Number of k-mers per window and k, with ``w + k - 1 = min_len``.

    Wide windows have few anchors; a k of ``ENOUGH_BASES`` tells places of a genome apart.
    """
    w = min(MAX_ANCHOR_WINDOW, max(min_len // 3 + 1, min_len - ENOUGH_BASES + 1))
    return w, min_len - w + 1


def _oriented(reads: DataFrame, min_len: int) -> DataFrame:
    both = F.array(
        F.struct(F.lit(False).alias("flip"), F.col("seq").alias("seq")),
        F.struct(F.lit(True).alias("flip"), reverse_complement("seq").alias("seq")),
    )
    return (
        reads.where(F.length("seq") >= min_len)
        .select("read_id", F.explode(both).alias("o"))
        .select("read_id", "o.flip", "o.seq")
    )


def _starts(reads: DataFrame, min_len: int, ends: bool = True) -> DataFrame:
    """The anchors by which a read is found, three rows: of the first L bases of either strand, and, with ``ends``, of the ``last`` L of the reverse one."""
    strands = [(False, False, F.col("seq"), F.lit(0)), (True, False, F.col("rev"), F.lit(0)), (True, True, F.col("rev"), F.col("b_len") - min_len)]
    strands = strands[:2 + ends]
    # L bases have exactly one window, hence one anchor; all Python of a read is one pass.
    window = window_anchors(*anchor_geometry(min_len))
    found = [window(F.substring(text, at + 1, F.lit(min_len))).alias(f"m{k}") for k, (_, _, text, at) in enumerate(strands)]
    rows = [F.struct(F.lit(flip).alias("flip"), F.lit(last).alias("last"), text.alias("seq"),
                     F.col(f"m{k}")[0]["hash"].alias("anchor"), (at + F.col(f"m{k}")[0]["pos"]).alias("pos"))
            for k, (flip, last, text, at) in enumerate(strands)]
    return (
        reads.where(F.length("seq") >= min_len)
        .select(F.col("read_id").alias("b"), "seq", reverse_complement("seq").alias("rev"), F.length("seq").alias("b_len"))
        .select("b", "seq", "rev", "b_len", packed("seq").alias("b_pack"), *found)
        .select("b", "b_pack", "b_len", F.explode(F.array(*rows)).alias("o"))
        .select("b", "b_pack", "b_len", F.col("o.flip").alias("b_flip"), "o.last", F.col("o.seq").alias("b_seq"), "o.anchor",
                F.col("o.pos").alias("b_pos"))
    )


def _windows(reads: DataFrame, min_len: int, flip: bool = False) -> DataFrame:
    """One row per read and anchor of its windows."""
    text = reverse_complement("seq") if flip else F.col("seq")
    return (
        reads.where(F.length("seq") >= min_len)
        .select(F.col("read_id").alias("a"), F.lit(flip).alias("a_flip"), F.length("seq").alias("a_len"),
                packed("seq").alias("a_pack"), window_anchors(*anchor_geometry(min_len))(text).alias("ms"))
        .select("a", "a_flip", "a_len", "a_pack", F.explode("ms").alias("m"))
        .select("a", "a_flip", "a_len", "a_pack", F.col("m.hash").alias("anchor"), F.col("m.pos").alias("a_pos"))
    )


def _to_overlap(a_len: Column, p: Column, n: Column, b_len: Column) -> list[Column]:
    """Overlap columns of oriented read a, matched from ``p`` for ``n`` bases by the start of b."""
    a_beg = F.when(F.col("a_flip"), a_len - p - n).otherwise(p)
    b_beg = F.when(F.col("b_flip"), b_len - n).otherwise(F.lit(0))
    a = F.struct(F.col("a").alias("id"), a_beg.cast("int").alias("beg"), a_len.alias("len"))
    b = F.struct(F.col("b").alias("id"), b_beg.cast("int").alias("beg"), b_len.alias("len"))
    # Lower read id first; a self-overlap starts lower on its first side.
    lower, upper = F.least(a, b), F.greatest(a, b)
    return [
        lower["id"].alias("f"), lower["beg"].alias("f_beg"),
        upper["id"].alias("g"), upper["beg"].alias("g_beg"),
        lower["len"].alias("f_len"), upper["len"].alias("g_len"),
        n.cast("int").alias("n"), (F.col("a_flip") != F.col("b_flip")).alias("rc"),
    ]


def _each_once(p: Column, a_rest: Column, b_len: Column) -> Column:
    """Keep one of the mirrored descriptions of the same overlap.

    Reverse-complement dovetails appear from both reads, so the one with a < b stays;
    containment is reported by the forward container; equal reads by the lower id.
    """
    a, b = F.col("a"), F.col("b")
    a_flip, b_flip = F.col("a_flip"), F.col("b_flip")
    dovetail = (p > 0) & (a_rest < b_len) & ((a_flip == b_flip) | (a < b))
    inside = ~a_flip & (b_len <= a_rest) & (a != b) & ((p > 0) | (b_len < a_rest) | (a < b))
    return ~(a_flip & b_flip) & ~((a == b) & (a_flip != b_flip)) & (dovetail | inside)


def _met(windows: DataFrame, starts: DataFrame, min_len: int, inside: bool = False) -> DataFrame:
    """Overlaps of the reads of ``windows`` with those of ``starts``, by a join on the anchor.

    Where a read starts in a window, the window's read is side a. Where its reverse strand ends there, that strand is side a
    and the window's read starts in it. With both, windows of the forward strands find every overlap.
    With ``inside``, only those in which b lies wholly inside a.
    """
    last = F.col("last")

    def side(of_end: str, of_start: str, name: str) -> Column:
        return F.when(last, F.col(of_end)).otherwise(F.col(of_start)).alias(name)

    both = windows.join(starts, "anchor").select(
        *[side(f"b{c}", f"a{c}", f"a{c}") for c in ("", "_flip", "_pack", "_len")],
        *[side(f"a{c}", f"b{c}", f"b{c}") for c in ("", "_flip", "_pack", "_len")],
        F.when(last, F.col("b_pos") - F.col("a_pos")).otherwise(F.col("a_pos") - F.col("b_pos")).alias("p"))
    p, a_len, b_len = F.col("p"), F.col("a_len"), F.col("b_len")
    n = F.least(a_len - p, b_len)
    if inside:
        both = both.where(n == b_len)
    matches = (
        (p >= 0) & (n >= min_len) & _each_once(p, a_len - p, b_len)
        & same_bases("a_pack", "a_flip", p, "b_pack", "b_flip", n)
    )
    return both.where(matches).select(*_to_overlap(a_len, p, n, b_len))


def _near(rows: DataFrame, sought: DataFrame) -> DataFrame:
    """The rows that share an anchor with some of ``sought``, or all if those have very many."""
    anchors = cut_lineage(sought.select("anchor").distinct())
    few = anchors.count() <= MAX_SOUGHT_ANCHORS
    return rows.join(F.broadcast(anchors), "anchor", "left_semi") if few else rows


def _anchored(reads: DataFrame, others: DataFrame, min_len: int, hot: DataFrame | None = None,
              few_reads: bool = False, few_others: bool = False) -> DataFrame:
    """Overlaps found by joining window anchors of ``reads`` with start anchors of ``others``, hot ones left out."""
    windows, starts = _windows(reads, min_len), _starts(others, min_len)
    if few_others:
        windows = _near(windows, starts)
    if few_reads:
        starts = _near(starts, windows)
    if hot is None:
        return _met(windows, starts, min_len)
    # The digests know a hot anchor as that of a start. Strands whose last anchor is hot are searched for starts instead.
    ends = starts.where("last").join(hot, "anchor", "left_semi").select(F.col("b").alias("read_id")).distinct()
    turned = _windows(others.join(ends, "read_id", "left_semi"), min_len, flip=True)
    forward = _starts(reads, min_len).where(~F.col("last") & ~F.col("b_flip"))
    rows = [t.join(hot, "anchor", "left_anti") for t in (windows, starts, turned, forward)]
    return _met(rows[0], rows[1], min_len).unionByName(_met(rows[2], rows[3], min_len))


def _whole_window(reads: DataFrame, starts: DataFrame, hot: DataFrame, min_len: int, inside: bool = False) -> DataFrame:
    """Overlaps at hot anchors, keyed by a digest of the entire common window.

    Rows and work grow with read length, never with the number of reads that share an anchor:
    every digest comes from prefix hashes of its read, and windows travel without
    text. What joins is confirmed on the text, once per result.
    """
    geometry = anchor_geometry(min_len)
    hot_starts = cut_lineage(starts.where(~F.col("last")).join(hot, "anchor").select(
        "anchor", "b", "b_flip", F.length("b_seq").alias("b_len"), F.posexplode(prefix_digests()("b_seq")).alias("n", "digest")
    ).where(F.col("n") >= min_len - 1).withColumn("n", F.col("n") + 1))
    windows = cut_lineage(
        _oriented(reads, min_len)
        .select(F.col("read_id").alias("a"), F.col("flip").alias("a_flip"), F.length("seq").alias("a_len"),
                F.posexplode(suffix_digests(*geometry)("seq")).alias("p", "m"))
        .select("a", "a_flip", "a_len", "p", F.col("m.anchor").alias("anchor"), F.col("m.digest").alias("digest"))
        .join(hot, "anchor")
    )
    rest = F.col("a_len") - F.col("p")
    cols = ["a", "a_flip", "p", "a_len", "n", "b", "b_flip", "b_len"]
    suffixes = windows.where(F.col("p") > 0).select("a", "a_flip", "p", "a_len", rest.alias("n"), "digest")
    dovetails = suffixes.join(hot_starts.where(F.col("n") < F.col("b_len")), ["n", "digest"]).select(*cols)

    # Which lengths of contained reads each forward window has to be compared with; then one pass per read.
    wholes = hot_starts.where(F.col("n") == F.col("b_len"))
    hot_lens = wholes.select("anchor", F.col("b_len").alias("n")).distinct()
    asked = windows.where(~F.col("a_flip")).join(hot_lens, "anchor").where(F.col("n") <= rest)
    spans = asked.groupBy("a").agg(F.collect_list(F.struct("p", "n")).alias("s"))
    inner = (
        spans.join(reads.select(F.col("read_id").alias("a"), "seq"), "a")
        .select("a", F.length("seq").alias("a_len"), "s", span_digests()("seq", F.col("s.p"), F.col("s.n")).alias("d"))
        .select("a", "a_len", F.explode(F.arrays_zip("s", "d")).alias("x"))
        .select("a", F.lit(False).alias("a_flip"), F.col("x.s.p").alias("p"), "a_len", F.col("x.s.n").alias("n"), F.col("x.d").alias("digest"))
    )
    contained = inner.join(wholes, ["n", "digest"]).select(*cols)
    found = (contained if inside else dovetails.unionByName(contained)).where(
        _each_once(F.col("p"), F.col("a_len") - F.col("p"), F.col("b_len")))
    return _confirmed(found, reads).select(*_to_overlap(F.col("a_len"), F.col("p"), F.col("n"), F.col("b_len")))


def _confirmed(found: DataFrame, reads: DataFrame) -> DataFrame:
    """Windows whose letters are indeed the same."""
    def side(name: str) -> DataFrame:
        return reads.select(F.col("read_id").alias(name), F.col("seq").alias(f"{name}_seq"))

    def oriented(name: str) -> Column:
        return F.when(F.col(f"{name}_flip"), reverse_complement(f"{name}_seq")).otherwise(F.col(f"{name}_seq"))

    same = F.substring(oriented("a"), F.col("p") + 1, F.col("n")) == F.substring(oriented("b"), F.lit(1), F.col("n"))
    return found.join(side("a"), "a").join(side("b"), "b").where(same)


def hot_anchors(starts: DataFrame, threshold: int) -> DataFrame:
    """``(anchor)`` at which more than ``threshold`` oriented reads begin, or reverse strands end."""
    counts = starts.groupBy("anchor", "last").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > threshold).select("anchor").distinct()


def _touched(found: DataFrame, touching: DataFrame) -> DataFrame:
    f, g = (touching.select(F.col("read_id").alias(c), F.lit(True).alias(f"has_{c}")) for c in "fg")
    return found.join(f, "f", "left").join(g, "g", "left").where("has_f OR has_g").drop("has_f", "has_g")


def overlap_candidates(reads: DataFrame, min_len: int, hot_threshold: int = HOT_STARTS,
                       touching: DataFrame | None = None) -> DataFrame:
    """All matching windows ``(f, f_beg, f_len, g, g_beg, g_len, n, rc)`` before one is kept per type.

    With ``touching``, distinct read ids, only those of pairs with at least one of these reads.
    """
    starts = _starts(reads, min_len)
    hot = cut_lineage(hot_anchors(starts.select("anchor", "last"), hot_threshold))
    num_hot = hot.count()
    known = None
    if num_hot:
        known = F.broadcast(hot) if num_hot <= MAX_BROADCAST_ANCHORS else hot
    if touching is None:
        cold = _anchored(reads, reads, min_len, known)
    else:
        asked, rest = reads.join(touching, "read_id", "left_semi"), reads.join(touching, "read_id", "left_anti")
        cold = _anchored(reads, asked, min_len, known, few_others=True).unionByName(
            _anchored(asked, rest, min_len, known, few_reads=True))
    if known is None:
        return cold
    whole = _whole_window(reads, starts, known, min_len)
    return cold.unionByName(whole if touching is None else _touched(whole, touching))


def _length_steps(reads: DataFrame, min_len: int) -> list[int]:
    """Least lengths of the classes in which contained reads are searched, doubled from the shortest read's on."""
    size = F.length("seq")
    low, high = reads.where(size >= min_len).agg(F.min(size), F.max(size)).first()
    steps = []
    while low is not None and low <= high:
        steps.append(low)
        low *= 2
    return steps


def _inside_candidates(reads: DataFrame, step: int, hot_threshold: int) -> DataFrame:
    """Matching windows that are all of a read of ``step`` to ``2 * step - 1`` bases."""
    inner = reads.where(F.length("seq").between(step, 2 * step - 1))
    starts, windows = _starts(inner, step, ends=False), _windows(reads, step)
    hot = cut_lineage(hot_anchors(starts.select("anchor", "last"), hot_threshold))
    num_hot = hot.count()
    if not num_hot:
        return _met(windows, starts, step, inside=True)
    known = F.broadcast(hot) if num_hot <= MAX_BROADCAST_ANCHORS else hot
    cold = _met(*[t.join(known, "anchor", "left_anti") for t in (windows, starts)], step, inside=True)
    return cold.unionByName(_whole_window(reads, starts, known, step, inside=True))


def containing_overlaps(reads: DataFrame, min_len: int, hot_threshold: int = HOT_STARTS) -> DataFrame:
    """The rows of ``compute_overlaps`` in which one of two reads of different letters lies wholly inside the other.

    A contained read matches with all its bases, so its anchor may be that of as many as the shortest read
    has: such windows have fewer anchors than those of ``min_len`` bases. Lengths further apart are searched class by class.
    """
    found = [_inside_candidates(reads, step, hot_threshold) for step in _length_steps(reads, min_len)]
    if not found:
        return compute_overlaps(reads.limit(0), min_len)
    # A whole read is the longest window of its pair and type, so shorter ones could not replace it.
    return overlap_dedup(reduce(DataFrame.unionByName, found))


def overlap_dedup(candidates: DataFrame) -> DataFrame:
    """Longest window per (f, g, f_beg > 0, rc); ties go to the lowest (f_beg, g_beg)."""
    # A window starts one of its reads: if not f, then it is g, and where that is follows from the length.
    # Rank and lengths are two numbers, so windows are merged in hash tables and travel as narrow rows.
    longest = F.lit((1 << 31) - 1).cast("long")
    place = F.when(F.col("f_beg") > 0, F.col("f_beg")).otherwise(F.col("g_beg"))
    rank = F.shiftleft(longest - F.col("n"), 32) + place
    kind = F.when(F.col("f_beg") > 0, 2).otherwise(0) + F.when(F.col("rc"), 1).otherwise(0)
    lens = F.shiftleft(F.col("f_len").cast("long"), 32) + F.col("g_len")
    at = F.col("rank").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    n, later, rc = F.col("n"), F.col("kind") >= 2, F.col("kind") % 2 == 1
    return (
        candidates.groupBy("f", "g", kind.alias("kind")).agg(F.min(rank).alias("rank"), F.max(lens).alias("lens"))
        .select("f", "g", "kind", at.alias("at"), (longest - F.shiftright("rank", 32)).cast("int").alias("n"),
                F.shiftright("lens", 32).cast("int").alias("f_len"), F.col("lens").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("g_len"))
        .select("f", "g", "n", "f_len", "g_len", rc.alias("rc"), F.when(later, F.col("at")).otherwise(0).alias("f_beg"),
                F.when(~later, F.col("at")).when(rc, F.col("g_len") - n).otherwise(0).alias("g_beg"))
        .select("f", "f_beg", (F.col("f_beg") + n - 1).alias("f_end"), "g", "g_beg", (F.col("g_beg") + n - 1).alias("g_end"),
                "rc", "f_len", "g_len")
    )


def compute_overlaps(reads: DataFrame, min_len: int = 25, max_edits: int = 0,
                     hot_threshold: int = HOT_STARTS, touching: DataFrame | None = None) -> DataFrame:
    """Overlap relation of ``(read_id, seq)``.

    ``(f, f_beg, f_end, g, g_beg, g_end, rc)`` with 0-based inclusive ends on the
    original strands, and the read lengths ``f_len, g_len`` that later stages test. With ``touching``, only
    overlaps of at least one of those ``(read_id)``.
    """
    if max_edits:
        raise NotImplementedError("inexact overlaps are not supported")
    if min_len < 1:
        raise ValueError("min_len must be positive")
    if touching is not None:
        touching = cut_lineage(touching.select("read_id").distinct())
    return overlap_dedup(overlap_candidates(reads, min_len, hot_threshold, touching))


def seed_pair_counts(reads: DataFrame, k: int) -> DataFrame:
    """Number of read pairs per canonical k-mer that a pairwise seed search would look at.

    The count follows from the occurrence count, so no pair is ever built.
    """
    n = F.col("occurrences")
    return kmer_counts(reads, k).select("kmer", (n * (n - 1) / 2).cast("long").alias("pairs"))


def overlap_violations(reads: DataFrame, overlaps: DataFrame, min_len: int) -> DataFrame:
    """Overlap rows that break a rule, with the first broken rule; empty for a valid set."""
    f = reads.select(F.col("read_id").alias("f"), F.col("seq").alias("f_seq"))
    g = reads.select(F.col("read_id").alias("g"), F.col("seq").alias("g_seq"))
    joined = overlaps.join(f, "f", "left").join(g, "g", "left")
    n = F.col("f_end") - F.col("f_beg") + 1
    f_part = F.substring(F.col("f_seq"), F.col("f_beg") + 1, n)
    g_part = F.substring(F.col("g_seq"), F.col("g_beg") + 1, n)
    g_as_f = F.when(F.col("rc"), reverse_complement(g_part)).otherwise(g_part)
    f_last, g_last = F.length("f_seq") - 1, F.length("g_seq") - 1
    g_lo = F.when(F.col("rc"), g_last - F.col("g_end")).otherwise(F.col("g_beg"))
    g_hi = F.when(F.col("rc"), g_last - F.col("g_beg")).otherwise(F.col("g_end"))
    one_sided = ((F.col("f_beg") == 0) & (g_lo == 0)) | ((F.col("f_end") == f_last) & (g_hi == g_last))
    rule = (
        F.when(F.col("f_seq").isNull() | F.col("g_seq").isNull() | (F.col("f") > F.col("g")), "reads")
        .when((F.col("f_beg") < 0) | (F.col("g_beg") < 0) | (F.col("f_end") > f_last)
              | (F.col("g_end") > g_last) | (F.col("f_beg") > F.col("f_end"))
              | (F.col("g_beg") > F.col("g_end")), "range")
        .when(n != F.col("g_end") - F.col("g_beg") + 1, "lengths")
        .when(n < min_len, "too short")
        .when((F.col("f") == F.col("g")) & (F.col("f_beg") == F.col("g_beg"))
              & (F.col("f_end") == F.col("g_end")), "same region")
        .when(f_part != g_as_f, "mismatch")
        .when(one_sided & (n != f_last + 1) & (n != g_last + 1), "layout")
    )
    return joined.select(*OVERLAP_COLUMNS, rule.alias("rule")).where(F.col("rule").isNotNull())
