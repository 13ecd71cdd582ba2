"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: whole texts, A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats, XXH64 with
seed 42, a bit is set if it is set in over half the hashes. Two fingerprints link at ``MAX_BITS`` or fewer
differing bits.

Equal fingerprints are one entry. With at most 3 differing bits, one of four 16-bit blocks is equal, so each entry is
dealt to four groups, one per (block, value); groups of over ``SPLIT`` entries are dealt again by the same argument
over the bits that are left (48, then 36 and 27 of them), as often as there are such groups.

Within its groups a task sorts the entries by Gray rank, so that neighbours differ in few bits, and builds a tree over them: ``FAN`` neighbours are a node, ``FAN``
neighbouring nodes are one, and so on. A node's mask are the bits that all its entries share, wherever these are, and its pattern is their values: what
is shared is factored into upper nodes. Pairs of nodes go down the tree; the differences of their patterns under both masks accumulate on the way
down as masks grow, and pairs are dropped as whole groups once these exceed the bound; nodes whose entries all lie within it are linked as a whole; nodes
already joined are skipped. A group returns at most one link per entry, so copies never become pairs.

Defined results: a very long text is hashed ``CHUNK`` words at a time, its words are held in its task; null and empty texts and texts of white space have fingerprint zero, linked like any other; repeated
rows are returned each; a null id takes part but is never a component's id unless all its ids are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import save, spare

MAX_BITS, SHINGLE, SEED = 3, 3, 42
#: Entries of a group beyond which it is dealt again; children of a node; words hashed at a time; entries, and pairs of nodes, looked at in one step.
SPLIT, FAN, CHUNK, ENTRIES, PAIRS = 4096, 8, 1 << 16, 1 << 18, 1 << 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : min(len(words), at + CHUNK + width - 1)]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["doc_id", "f"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f, the fingerprint as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, f long")


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    r = f.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] numbers each, one after another."""
    offset = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(offset - starts, counts)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest entry known to be connected, once a and b are connected."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up


class Tree:
    """Levels of nodes over sorted entries, the roots (one a group) first: first entry, entries, what all entries have and what any has, children."""

    def __init__(self, group: np.ndarray, f: np.ndarray):
        starts, own = np.arange(len(f)), group
        self.levels: list[tuple[np.ndarray, ...]] = [self.level(f, starts)]
        self.child: list[tuple[np.ndarray, np.ndarray]] = []  # first child and number of children
        while (own[1:] == own[:-1]).any():
            run = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(run, np.diff(np.r_[run, len(own)]))
            first = np.flatnonzero(place % FAN == 0)
            self.child.insert(0, (first, np.diff(np.r_[first, len(own)])))
            starts, own = starts[first], own[first]
            self.levels.insert(0, self.level(f, starts))

    @staticmethod
    def level(f: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        return starts, np.diff(np.r_[starts, len(f)]), np.bitwise_and.reduceat(f, starts), np.bitwise_or.reduceat(f, starts)


def group_links(group: np.ndarray, f: np.ndarray, bits: int = MAX_BITS, rank: Callable = gray_rank, looked_at: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the entries of each group as all pairs within ``bits`` would; at most one per entry. ``looked_at`` gets the pairs of nodes of each step."""
    order = np.lexsort((rank(f), group))
    g, f = group[order], f[order]
    n = len(f)
    if not n:
        return f, f
    tree = Tree(g, f)
    label = np.arange(n)
    roots = np.flatnonzero(tree.levels[0][1] > 1)
    stack = [(0, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if not len(a):
            continue
        first, count = tree.child[depth]
        weight = np.cumsum(count[a] * count[b])
        if weight[-1] > PAIRS and len(a) > 1:
            cut = min(max(1, int(np.searchsorted(weight, PAIRS))), len(a) - 1)
            stack.append((depth, a[cut:], b[cut:]))
            a, b = a[:cut], b[:cut]
        x = _spread(first[a], count[a])
        per = np.repeat(count[b], count[a])
        y = _spread(np.repeat(first[b], count[a]), per)
        x = np.repeat(x, per)
        below, size, ands, ors = tree.levels[depth + 1]
        keep = (x < y) | ((x == y) & (size[x] > 1))
        x, y = x[keep], y[keep]
        if looked_at is not None:
            looked_at.append(len(x))
        # bits that all have on one side and none has on the other
        apart = (ands[x] & ~ors[y]) | (ands[y] & ~ors[x])
        keep = np.bitwise_count(apart) <= bits
        x, y = x[keep], y[keep]
        i, j = below[x], below[y]
        whole = np.bitwise_count((ors[x] | ors[y]) & ~(ands[x] & ands[y])) <= bits
        if whole.any():
            p, q = x[whole], y[whole]
            own = np.unique(np.r_[p, q])
            inner = own[size[own] > 1]
            ends = _spread(below[inner], size[inner])
            label = _merge(label, np.r_[i[whole], np.repeat(below[inner], size[inner])], np.r_[j[whole], ends])
        x, y, i, j = x[~whole], y[~whole], i[~whole], j[~whole]
        if len(x):  # skip pairs of nodes that are one component already
            one = np.minimum.reduceat(label, below) == np.maximum.reduceat(label, below)
            keep = ~(one[x] & one[y] & (label[i] == label[j]))
            near = x[keep] == y[keep]
            stack.append((depth + 1, x[keep][~near], y[keep][~near]))
            stack.append((depth + 1, x[keep][near], y[keep][near]))  # within a node first: it joins most
    moved = np.flatnonzero(label != np.arange(n))
    return f[moved], f[label[moved]]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are gathered until there are ENTRIES of them."""
    keys, codes = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        u, v = group_links(k, c)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for b in batches:
        keys = np.r_[keys, b.column(0).to_numpy()]
        codes = np.r_[codes, b.column(1).to_numpy().view(np.uint64)]
        if len(keys) >= ENTRIES and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield out(keys[:cut], codes[:cut])
            keys, codes = keys[cut:], codes[cut:]
    yield out(keys, codes)


def _deal(rows: DataFrame, width: int) -> DataFrame:
    """Rows (f, rest, key) once for each of four blocks of ``rest``'s ``width`` bits, with the bits that are left and a key of the block's value."""
    dealt = []
    for low, high in zip((0, width // 4, width // 2, width * 3 // 4), (width // 4, width // 2, width * 3 // 4, width), strict=True):
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", high), low) if high < 64 else F.lit(0).cast("long")
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1)))
        dealt.append(F.struct(rest.alias("rest"), F.xxhash64("key", F.lit(low), value).alias("key")))
    return rows.select("f", F.explode(F.array(*dealt)).alias("b")).select("f", "b.rest", "b.key")


def links(codes: DataFrame) -> DataFrame:
    """u, v: links that connect distinct codes (column f) as all pairs within MAX_BITS would."""
    width, done = 64, None
    rows = codes.select("f", F.col("f").alias("rest"), F.lit(0).cast("long").alias("key"))
    while True:
        rows = save(_deal(rows, width), "simhash-dealt")
        width -= width // 4 if width > 32 else width  # what is left is at most the largest three blocks
        sizes = save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")  # entries alone in a group have no partner there
        again = width > 0 and (sizes.agg(F.max("n")).first()[0] or 0) > SPLIT
        ready = rows.join(sizes.where(F.col("n") <= SPLIT) if again else sizes, "key").select("key", "f")
        done = ready if done is None else done.unionByName(ready)
        if not again:
            break
        rows = rows.join(sizes.where(F.col("n") > SPLIT), "key").select("f", "rest", "key")
    return done.repartition("key").sortWithinPartitions("key").mapInArrow(_index, "u long, v long")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns of ``docs``.

    Rows are numbered in a written table, so that repeated and null ids need no rule of their own; the row with the
    smallest number stays. What goes is usually a small list, which Spark broadcasts only if it is.
    """
    row = spare(docs, "row")
    numbered = save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, f and component_id of every row."""
    every = save(fingerprints(docs), "fingerprints")
    codes = every.groupBy("f").agg(F.min("doc_id").alias("least"))
    roots = components(links(codes.select("f")))
    rooted = save(codes.join(roots, codes["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_code = rooted.join(ids, "root").select("f", "component_id")
    return every.join(by_code, "f").select("doc_id", "f", "component_id")
