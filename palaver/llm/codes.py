"""Vector code compression: product quantisation in whole numbers, with partial-distance search.

Each component x becomes floor(SCALE * x); a vector is cut into ``PARTS`` equal parts, and each part is coded by the nearest entry of its position's codebook.
A codebook starts as that part of the vectors of smallest ids and is moved to the means of its parts ``ROUNDS`` times. Codebooks are the only thing that goes to the
driver and to all tasks: PARTS * ENTRIES parts, whatever the number of vectors. Sums for the means are added up in each task, then by Spark.

Search goes through a part's dimensions in the order of the codebook's variance, largest first: pairs of vectors and entries are dropped by a mask once their
distance so far strictly exceeds the vector's best complete distance. That starts with the entry nearest in the first dimension and is lowered by each block of entries. As ties
aren't dropped, the lowest index among the nearest is found.

Defined results: a vector that is null or empty or holds null or non-finite components has no code, and neither has one whose length isn't the commonest length that can be cut (the
shorter of equally common ones); null ids come after all others, vectors of one id by their components; repeated rows are coded each; null labels are one label; an empty table gives
an empty result; other columns are ignored. Whole numbers beyond 2 ** 62 are held there; distances are exact, and told as 2 ** 63 - 1 from there on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST, LONGEST = 1 << 62, (1 << 63) - 1
#: Vectors and entries that are compared together.
ROWS, BLOCK = 4096, 16


def whole_numbers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and v, the whole numbers of each vector that can be coded, as a written table."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    within = lambda c: F.when(c >= float(LARGEST), F.lit(LARGEST)).when(c <= -float(LARGEST), F.lit(-LARGEST)).otherwise(F.floor(c))
    v = F.transform(x, lambda c: within(c * F.lit(float(SCALE))))
    table = save(vectors.where(good).select("vec_id", "label", v.alias("v")), "vectors")
    size = F.size("v").alias("size")
    usual = table.groupBy(size).agg(F.count(F.lit(1)).alias("n")).where(F.col("size") % parts == 0).orderBy(F.col("n").desc(), "size").first()
    return table.where(F.size("v") == usual["size"]) if usual else table.limit(0)


def _exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type that holds all squared distances."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    return (x, book) if (2 * most) ** 2 * x.shape[1] < LARGEST else (x.astype(object), book.astype(object))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest row of ``book`` to each row of ``x``; ties go to the lower index."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = _exact(x[:, order], book[:, order])
    # the entry nearest in the first dimension
    by_first = np.argsort(book[:, 0], kind="stable")
    right = np.searchsorted(book[by_first, 0].astype(np.float64), x[:, 0].astype(np.float64)).clip(1, max(1, len(book) - 1))
    low, high = by_first[right - 1], by_first[np.minimum(right, len(book) - 1)]
    at = np.where(np.abs(x[:, 0] - book[low, 0]) <= np.abs(book[high, 0] - x[:, 0]), low, high)
    best = ((x - book[at]) ** 2).sum(axis=1)
    for start in range(0, len(book), BLOCK):
        block = book[start : start + BLOCK]
        far = (x[:, :1] - block[None, :, 0]) ** 2
        rows, cols = np.nonzero(far <= best[:, None])
        far = far[rows, cols]
        for k in range(1, x.shape[1]):
            far = far + (x[rows, k] - block[cols, k]) ** 2
            live = (far <= best[rows]).astype(bool)
            rows, cols, far = rows[live], cols[live], far[live]
        if len(rows):
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            least = np.minimum.reduceat(far, first)
            each = np.diff(np.r_[first, len(rows)])
            hit = np.flatnonzero(far == np.repeat(least, each))
            hit = hit[np.r_[True, rows[hit][1:] != rows[hit][:-1]]]  # the lowest index of each vector
            row, index = rows[first], cols[hit] + start
            better = ((least < best[row]) | ((least == best[row]) & (index < at[row]))).astype(bool)
            at[row[better]], best[row[better]] = index[better], least[better]
    return at, best


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows and their vectors, cut: (rows, parts, places)."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            b = batch.slice(low, ROWS)
            v = b.column(b.num_columns - 1).flatten().to_numpy()
            yield b, v.reshape(b.num_rows, parts, -1)


#: Digits of sums, which are added up as two numbers each.
LOW = 31


def _sums(books: np.ndarray) -> Callable:
    """Sums of the parts that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, v in _blocks(batches, len(books)):
            for p, book in enumerate(books):
                at, _ = nearest(v[:, p], book)
                np.add.at(high[p], at, v[:, p] >> LOW)
                np.add.at(low[p], at, v[:, p] & ((1 << LOW) - 1))
                n[p] += np.bincount(at, minlength=len(book))
        part, entry, place = np.nonzero(np.broadcast_to(n[:, :, None] > 0, books.shape))
        columns = [pa.array(c, pa.int64()) for c in (part, entry, place, high[part, entry, place], low[part, entry, place], n[part, entry])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "high", "low", "n"])

    return run


def codebooks(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """(parts, entries, places) whole numbers; None without vectors."""
    first = table.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        each = table.select("v").mapInArrow(_sums(books), "part long, entry long, place long, high long, low long, n long")
        sums = each.groupBy("part", "entry", "place").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(c) for c in ("high", "low")], F.sum("n").alias("n"))
        moved = books.copy()
        for r in sums.collect():
            moved[r.part, r.entry, r.place] = ((int(r.high) << LOW) + int(r.low)) // r.n
        books = moved
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _codes(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in _blocks(batches, len(books)):
            found = [nearest(v[:, p], book) for p, book in enumerate(books)]
            code = np.stack([at for at, _ in found], axis=1)
            width = 2 if books.shape[1] <= 256 else len(f"{books.shape[1] - 1:x}")
            error = [min(e, LONGEST) for e in np.stack([d.astype(object) for _, d in found], axis=1).sum(axis=1).tolist()]
            text = ["".join(f"{c:0{width}x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (two hex digits a part, or as many as an index needs), error, label_error (of all vectors with that label) and codebooks_sha256 of each vector that can be coded."""
    table = whole_numbers(vectors, parts)
    books = codebooks(table, parts, entries, rounds)
    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if books is None:
        coded = vectors.sparkSession.createDataFrame([], schema)
    else:
        coded = save(table.select("vec_id", "label", "v").mapInArrow(_codes(books), schema), "codes")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONGEST).cast("decimal(30,0)")).cast("long").alias("label_error"))
    joined = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("c.vec_id", "c.label", "c.code", "c.error", "s.label_error", F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
