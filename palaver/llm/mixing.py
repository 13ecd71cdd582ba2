"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies, the target of its source over the source's size. The whole part
is taken; the fractions are settled by pivoting: two fractional documents of a source meet, and words move at random
from one to the other until one of them holds none or one whole copy. Expectations and the source's words are kept
at each step. Documents are dealt over buckets by a hash of the id; each bucket leaves at most one fractional
document per source, and these meet again in a reduction tree of ``FAN_IN`` until one is left. That last one
goes to the nearer whole number; what a source then misses, at most half a document, is made up as far as turning over some of
the documents settled last, the smallest, brings it nearer.

Defined results: words are counted where a text is read, however long it is, and a document of nearly all words of a source is one document; a null or empty text has size 0 and takes no words (its row is copied by the whole part of its source's rate); a null source is a source of its own, last in
order; a null id is an id like any other; repeated rows are separate documents, told by a number within theirs, so that many of them are dealt over buckets; an empty table gives an empty result; further columns are ignored by
``mix`` and kept by ``mixed``, whatever they are called.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ranked, save, spare

WORD = r"[^\x20\x09-\x0D]+"
#: Documents a bucket holds on average, and buckets that meet in a node of the tree.
BUCKET_ROWS, FAN_IN = 20_000, 32
#: The smallest documents of a source that the last step may turn over.
KEPT = 256
M64 = (1 << 64) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, n_docs, target. Sources are ranked across partitions, and nothing but sums comes to the driver.

    All sources get the same words per unit of weight; those that this takes past their cap stop there, and the rest is shared anew, until no further one does.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = ranked(totals, "rank", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = save(rank.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-sources")
    every = (known.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    unit, stopped = 0.0, -1
    while True:
        full = F.col("most") < F.lit(unit) * F.col("weight")
        sums = known.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("left")).first()
        if sums["n"] == stopped or not sums["left"]:
            break
        unit, stopped = max(unit, (every - (sums["given"] or 0.0)) / sums["left"]), sums["n"]
    if sums["left"]:
        target = F.least("most", F.lit(unit) * F.col("weight"))
    else:
        target = F.col("most")
    return known.select("source", "source_size", "n_docs", target.alias("target"))


def uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on its arguments alone (splitmix64)."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Move words between documents of ``s`` and ``t`` words and fractions ``p`` and ``q``, until one is settled."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:  # the first gains
        return (1.0, q - up / t) if (1 - p) * s <= q * t else (p + up / s, 0.0)
    return (0.0, q + down / t) if p * s <= (1 - q) * t else (p - down / s, 1.0)


OUT = "bucket long, source string, doc_id long, size long, base long, p double"
NAMES = ["bucket", "source", "doc_id", "size", "base", "p"]
EDGE = 1e-12


def repair(settled: list[tuple[int, int, float]], lacking: float) -> dict[int, float]:
    """Which of some settled documents (row, size, p) to turn over, large ones first, while that brings the source's words nearer to its target."""
    turned = {}
    for row, size, p in sorted(settled, key=lambda r: -r[1]):
        if 0 < size < 2 * abs(lacking) and p == (0.0 if lacking > 0 else 1.0):
            lacking -= size if lacking > 0 else -size
            turned[row] = 1.0 - p
    return turned


class Pivots:
    """Settles the rows of one (bucket, source), which come from large to small documents; rows are numbers of the task's own."""

    def __init__(self, seed: int, last: bool):
        self.seed, self.last = seed, last
        self.held: tuple[int, float, int, int] | None = None  # row, p, size, and a number for the draws
        self.settled: deque[tuple[int, int, float]] = deque(maxlen=KEPT)  # the smallest ones that are settled
        self.p: dict[int, float] = {}

    def done(self, row: int, size: int, p: float) -> None:
        p = float(round(p))
        self.p[row] = p
        if self.last and size:
            self.settled.append((row, size, p))

    def take(self, row: int, p: float, size: int, key: int) -> None:
        if self.held is not None and EDGE < p < 1 - EDGE:
            other, q, large, own = self.held
            q, p = pivot(q, large, p, size, uniform(self.seed, own, key))
            self.held = (other, q, large, own)
            if not EDGE < q < 1 - EDGE:
                self.done(other, large, q)
                self.held = None
        if self.held is None and EDGE < p < 1 - EDGE:
            self.held = (row, p, size, key)
        else:
            self.done(row, size, p)

    def close(self) -> None:
        if self.held is not None:
            row, p, size, _ = self.held
            if self.last:
                nearer = float(p >= 0.5)
                self.p |= repair(list(self.settled), (p - nearer) * size)
                p = nearer
            self.p[row] = p


def settle(seed: int, last: bool) -> Callable:
    """Pivots each (bucket, source), whose rows arrive together, from large to small documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, pa.RecordBatch]] = []  # batches with rows that aren't settled, and the first row's number
        own, group, n = Pivots(seed, last), None, 0
        settled: dict[int, float] = {}

        def ready(all_: bool) -> Iterator[pa.RecordBatch]:
            while waiting and (all_ or group_start >= waiting[0][0] + waiting[0][1].num_rows):
                first, batch = waiting.pop(0)
                p = [settled.pop(i) for i in range(first, first + batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(p, pa.float64())], NAMES)

        group_start = 0
        for batch in batches:
            waiting.append((n, batch))
            for key in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True):
                if key[:2] != group:
                    own.close()
                    settled |= own.p
                    own, group, group_start = Pivots(seed, last), key[:2], n
                own.take(n, key[4], key[3], key[2] or 0)
                n += 1
            yield from ready(False)
        own.close()
        settled |= own.p
        yield from ready(True)

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, repeats counted) of every document."""
    sized = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    # rows that are equal are one row with a number, in parts that a bucket can hold
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    first = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BUCKET_ROWS).cast("long"))
    alike = counted.select("doc_id", "source", "size", "n", F.explode(first).alias("part")).withColumn("n", F.least(F.col("n") - F.col("part"), F.lit(BUCKET_ROWS).cast("long")))
    targets = save(source_targets(sized, weights, share, cap), "mix-targets")
    rows = targets.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    units = alike.alias("d").join(targets.alias("t"), same).select(
        F.pmod(F.xxhash64("d.doc_id", "d.size", "d.part"), F.lit(buckets)).alias("bucket"), "d.source", "d.doc_id", "d.size",
        F.floor(rate).alias("base"), F.when(F.col("d.size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)).alias("p"), "d.n",
    )
    done, level, left = None, 0, units
    while True:
        last = buckets == 1
        # a bucket holds about BUCKET_ROWS rows of all sources, so a hot source is spread over all buckets
        dealt = left.repartition(buckets, "bucket").sortWithinPartitions(
            "bucket", "source", F.col("size").desc(), F.xxhash64("doc_id"), "doc_id"
        )
        if level == 0:
            dealt = dealt.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
        out = save(dealt.mapInArrow(settle(seed + level, last), OUT), f"mix-level{level}")
        settled = out.where((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
        left = out.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    copies = (F.col("base") + F.col("p").cast("long")).cast("long")
    return done.alias("d").join(targets.alias("t"), same).select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all columns. Rows are numbered in a written table."""
    row = spare(docs, "row")
    numbered = save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered.select(F.col(row).alias("doc_id"), "source", "text"), **options).where("copies > 0")
    copies = taken.select(F.col("doc_id").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(spare(docs, "copies")))
    repeated = numbered.join(copies, row)
    return repeated.withColumn(row, F.explode(copies.columns[1])).select(*docs.columns)
