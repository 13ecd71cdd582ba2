"""Near copies by the exact Jaccard similarity of their word shingles.

Words as in ``simhash`` (A-Z lower-cased, between ASCII white space); a text is the set of its ``SHINGLE``-word shingles, hashed to 64 bits, a
shorter one its words as one shingle. Texts link at a similarity of ``SIMILARITY`` or more; components of links are one group.

Equal sets are one entry. Two things propose what is compared. SimHash fingerprints of the same shingles go through the index of ``simhash``, its tree over Gray order: the components of
fingerprints within ``simhash.MAX_BITS`` are proposed. Pairs at 0.8 mostly differ in more bits than that; so MinHash signatures cut into bands propose, too: entries with an equal
band are joined to the smallest of them, never paired, and the components of that hold all pairs that share a band. A pair at 0.8 shares none of the bands of a level
(``LEVELS``) once in 300,000 times, a closer one less often. Proposals are then verified on the shingles: first each entry against its component's smallest
one, which deals large groups out. Components with an entry left over are visited by links, each in a task if it has ``TOGETHER`` entries at most. Bands of few values propose
pairs that are far from similar, and many such pairs make large components; so the entries of larger ones are proposed again by bands of more values. What is
large and left over then is visited bucket by bucket, and the links that are found make the components.

Defined results: null and empty texts and texts of white space are copies of each other; repeated rows are judged each; a very long text is a set of 8 bytes a word in its task; an
empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import save, spare
from .simhash import LOWER, fingerprint, links

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and values of each, level by level: at 0.8, (1 - 0.8 ** values) ** bands is about 3e-6.
LEVELS = ((24, 4), (69, 8))
#: Entries of a component that one task visits.
TOGETHER = 5000
#: Shingles that are signed in one step.
STEP = 1 << 17
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS, SHIFTS = np.random.default_rng(17).integers(0, 1 << 63, (2, max(n * values for n, values in LEVELS)), dtype=np.uint64)
FACTORS = FACTORS * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    code = h[: len(h) - width + 1]
    for i in range(1, width):
        code = _mixed(code) + h[i : len(h) - width + 1 + i]
    return np.unique(_mixed(code))


def bands(sets: list[np.ndarray], level: int = 0) -> np.ndarray:
    """Keys of the bands of each set; none of the sets is empty."""
    n, values = LEVELS[level]
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint64)
    for band in range(n):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * values, band * values + values):
            key = _mixed(key) + np.minimum.reduceat((flat ^ SHIFTS[k]) * FACTORS[k], starts)
        out[:, band] = _mixed(key)
    return out


def _signed(width: int, level: int) -> Callable:
    """row, a hash of the set, its fingerprint (at the first level), and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                sets, codes, size, start = [], [], 0, at
                while at < b.num_rows and size < STEP:
                    text = b.column(1)[at].as_py()
                    sets.append(shingles(text, width))
                    codes.append(fingerprint(text, width) if level == 0 else 0)
                    size, at = size + len(sets[-1]), at + 1
                full = [s for s in sets if len(s)]
                keys = bands(full, level).ravel() if full else np.empty(0, np.uint64)
                ends = np.cumsum([0, *(LEVELS[level][0] * (len(s) > 0) for s in sets)]).astype(np.int32)
                same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, at - start), pa.array(same.view(np.int64)), pa.array(np.array(codes, np.uint64).view(np.int64)), lists], ["row", "s", "f", "ks"])

    return run


def near(size: np.ndarray, other: int, shared: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, with so many hashes shared with one of ``other``, are similar."""
    return shared >= similarity * (size + other - shared) - 1e-9


def groups(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Smallest index of each set's component under all links between the sets."""
    label = np.arange(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    rest = np.arange(len(sets))
    flat, owner = (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.repeat(rest, size)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        keep = owner != queue[0]
        flat, owner = flat[keep], owner[keep]
        root = queue[0]
        while queue and len(rest):
            own = sets[queue.pop()]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.bincount(owner[own[at] == flat], minlength=len(sets))[rest]
            hit = near(size[rest], len(own), shared, similarity)
            if hit.any():
                label[rest[hit]] = root
                queue += rest[hit].tolist()
                rest = rest[~hit]
                left = np.isin(owner, rest)
                flat, owner = flat[left], owner[left]
    return label


def _beside(width: int, similarity: float) -> Callable:
    """root, row and whether the row's text is near the root's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root_set = None, None
        for b in batches:
            ok = []
            for root, text, root_text in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if root != last:
                    last, root_set = root, shingles(root_text.as_py(), width)
                own = shingles(text.as_py(), width)
                shared = np.intersect1d(own, root_set, assume_unique=True).size
                ok.append(bool(near(np.array(len(own)), len(root_set), np.array(shared), similarity)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["root", "row", "near"])

    return run


def _visited(width: int, similarity: float) -> Callable:
    """Rows come sorted by key and row; those that aren't the smallest of their group, with the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, sets = None, [], []

        def out() -> pa.RecordBatch:
            label = groups(sets, similarity)
            gone, own = np.flatnonzero(label != np.arange(len(sets))), np.array(rows, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[gone]), pa.array(own[label[gone]])], ["row", "kept"])

        for b in batches:
            for key, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if key != last:
                    yield out()
                    last, rows, sets = key, [], []
                rows.append(row)
                sets.append(shingles(text.as_py(), width))
        yield out()

    return run


def _visit(keyed: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """row and kept of the near copies among the rows of each key."""
    together = keyed.join(texts, "row").select("key", "row", "text").repartition("key").sortWithinPartitions("key", "row")
    return together.mapInArrow(_visited(shingle, similarity), "row long, kept long")


def alike(codes: DataFrame) -> DataFrame:
    """u, v: of codes (row, f), the rows whose fingerprints are in one component, each with the smallest of them."""
    roots = components(links(codes.select("f").distinct()))
    rooted = codes.join(roots, codes["f"] == roots["node"], "left").select("row", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rooted.join(least, "root").where("row != v").select(F.col("row").alias("u"), "v")


def _level(entries: DataFrame, also: DataFrame | None, texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of entries (row, ks), which bands and ``also`` (u, v) propose: the rows that are near the smallest one of their component, where all of it is; the components (root, row) that are left, with their sizes; the bands (row, k)."""
    dealt = save(entries.select("row", F.explode("ks").alias("k")), "near-dealt")
    least = dealt.groupBy("k").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    proposed = dealt.join(least, "k").where("row != v").select(F.col("row").alias("u"), "v")
    proposed = proposed if also is None else proposed.unionByName(also)
    members = save(components(proposed).select(F.col("node").alias("row"), "root"), "near-members")
    beside = members.join(texts, "row").join(texts.select(F.col("row").alias("root"), F.col("text").alias("root_text")), "root")
    beside = save(beside.select("root", "row", "text", "root_text").mapInArrow(_beside(shingle, similarity), "root long, row long, near boolean"), "near-beside")
    open_ = save(beside.groupBy("root").agg(F.count_if(~F.col("near")).alias("far"), (F.count(F.lit(1)) + 1).alias("size")).where("far > 0").drop("far"), "near-open")
    settled = beside.join(open_, "root", "left_anti").select("row")
    left = members.unionByName(open_.select(F.col("root").alias("row"), "root")).join(open_, "root")
    return settled, left, dealt


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, the first of a written numbering, with all columns of ``docs``."""
    own = spare(docs, "row")
    numbered = save(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(own).alias("row"), "text")
    signed = lambda rows, level: save(rows.mapInArrow(_signed(shingle, level), "row long, s long, f long, ks array<long>"), "near-bands")
    every = signed(texts, 0)
    first = save(every.groupBy("s").agg(F.min("row").alias("first")), "near-first")
    gone = every.select("s", "row").join(first, "s").where("row != first").select("row")  # copies

    entries = every.select("row", "f", "ks").join(first.select(F.col("first").alias("row")), "row", "left_semi")
    also = alike(save(entries.where(F.size("ks") > 0).select("row", "f"), "near-codes"))  # texts without words are one entry already
    for level in range(len(LEVELS)):
        settled, left, dealt = _level(entries, also if level == 0 else None, texts, shingle, similarity)
        small = left.where(F.col("size") <= TOGETHER).select(F.col("root").alias("key"), "row")
        gone = gone.unionByName(settled).unionByName(_visit(small, texts, shingle, similarity).select("row"))
        large = left.where(F.col("size") > TOGETHER).select("row")
        if large.isEmpty():
            break
        large = save(large, "near-large")
        if level + 1 < len(LEVELS):
            entries = signed(texts.join(large, "row", "left_semi"), level + 1).select("row", "ks")
        else:
            buckets = dealt.join(large, "row", "left_semi").withColumnRenamed("k", "key")
            found = save(_visit(buckets, texts, shingle, similarity).select(F.col("row").alias("u"), F.col("kept").alias("v")), "near-links")
            gone = gone.unionByName(components(found).select(F.col("node").alias("row")))
    gone = save(gone, "near-gone").select(F.col("row").alias(own))
    return numbered.join(gone, own, "left_anti").select(*docs.columns)
