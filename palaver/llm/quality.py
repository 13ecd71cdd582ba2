"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's rating is its grade of ``0 .. GRADES - 1``; for the labels table, 0 if it is toxic, else 1, or 2 if it is of quality. One weight vector over hashed
words is shared by all grades and ordered thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score).
Scoring gives the expected grade and the tail probability P(grade >= top), by which documents are selected.

Words are split at white space. Each distinct word gives itself, lower-cased and without punctuation at its ends, and the first ``STEM`` of them as hashed features of value one;
hashed shape features hold the shares of the distinct words that end in a symbol (by symbol) or are in capitals, the share of words
that repeat the word before, and the share of words that occur again. A lasso leaves most weights at zero, so that long texts
gather no noise from neutral words.

The model is fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id, which have ``FIT_VALUES`` features in all at most (or on the first alone);
everything else covers all rows. The fit is 100 quasi-Newton steps at most, each a pass or two on the driver and ends when a step wins little. Scoring is narrow; only the weights (those that are not zero of ``2 ** BITS``, whatever the corpus) go to the executors.

Defined results: a null or empty text has score 0 before thresholds (it is graded by the thresholds alone); labels with a
null that leaves the grade open are left out, of repeated labels the lowest counts; without any labels nothing is rejected and all probabilities are 1;
repeated rows are scored each; a very long text is scored by its words in its task, which takes some ten times its size; an empty table gives an empty result; other columns are passed through by ``select`` and ignored by ``score``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

BITS, GRADES, MIN_TAIL = 22, 3, 0.5
#: Labelled rows that the model is fitted on at most, and their features (8 bytes each); lasso; rows of the sample that a feature occurs in at least.
FIT_ROWS, FIT_VALUES, LASSO, MIN_ROWS = 8_000, 8_000_000, 1e-3, 3
#: Steps of the fit at most, the share of the loss that a step must win, and the steps that it knows the curvature from.
STEPS, LEAST_GAIN, KNOWN = 100, 1e-5, 10
STEM = 4
EDGES = "!?#$%&*|;:~=+<>^@/\\.,()[]{}\"'`-_"
#: Words whose features a task keeps at hand.
MEMO = 1 << 20
SYMBOLS = "!?#$%&*|;:~=+<>^@/\\"


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


#: Shape features: a word's class; 0 is none.
SHAPES = ["", "capitals", *(f"end{c}" for c in SYMBOLS)]
SHAPE_FEATURES = np.array([hashed(f"shape {s}") for s in [*SHAPES, "repeat", "again"]], np.int64)
SCALE = 30.0


def shape(word: str) -> int:
    if word[-1] in SYMBOLS:
        return 2 + SYMBOLS.index(word[-1])
    return int(len(word) > 2 and word.isupper())


def word_features(word: str) -> tuple[int, int]:
    """Of the whole word, and of how it begins, which inflected forms share."""
    core = word.strip(EDGES).lower()
    return hashed("word " + core), hashed("stem " + core[:STEM])


def shares(words: list[str], distinct: set[str], classes: Iterable[int]) -> np.ndarray:
    """Values of SHAPE_FEATURES."""
    n = max(1, len(words))
    own = np.bincount(np.fromiter(classes, np.int64, len(distinct)), minlength=len(SHAPES)) / max(1, len(distinct))
    return SCALE * np.r_[0, own[1:], sum(map(eq, words, words[1:])) / n, (len(words) - len(distinct)) / n / SCALE]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (sorted) and their values."""
    words = (text or "").split()
    distinct = set(words)
    dense = shares(words, distinct, map(shape, distinct))
    index, count = np.unique(np.fromiter(chain.from_iterable(map(word_features, distinct)), np.int64, 2 * len(distinct)), return_counts=True)
    held = np.flatnonzero(dense)
    return np.r_[index, SHAPE_FEATURES[held]].astype(np.int32), np.r_[count, dense[held]].astype(np.float64)


@dataclass
class Ordinal:
    index: np.ndarray  # features whose weights aren't zero, sorted
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1 of them

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score (rows) and k < GRADES - 1 (columns)."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def minimised(smooth: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    """Least of smooth(x)[0] + sum(lasso * |x|) from x on: quasi-Newton steps within an orthant.

    ``smooth`` gives a value and its gradient. Where x is zero, the lasso holds it there unless the gradient is steeper; a step ends at zero where it would change a sign.
    """
    loss, g = smooth(x)
    total, steps = loss + lasso @ np.abs(x), []
    for _ in range(STEPS):
        pull = np.where(x != 0, g + lasso * np.sign(x), np.sign(g) * np.maximum(0, np.abs(g) - lasso))
        d, kept = -pull, []
        for s, y, r in reversed(steps):
            kept.append(r * (s @ d))
            d = d - kept[-1] * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            d = d + (a - r * (y @ d)) * s
        d[(d * pull >= 0) & (lasso > 0)] = 0
        side = np.where(x != 0, np.sign(x), -np.sign(pull))
        length = 1.0 if steps else 1 / max(1.0, float(np.abs(pull).sum()))
        for _ in range(20):
            new = x + length * d
            new[(new * side < 0) & (lasso > 0)] = 0
            new_loss, new_g = smooth(new)
            new_total = new_loss + lasso @ np.abs(new)
            if new_total <= total + 1e-4 * (pull @ (new - x)):
                break
            length /= 2
        else:
            return x
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            steps = [*steps[1 - KNOWN :], (s, y, 1 / (s @ y))]
        gained, x, g, total = total - new_total, new, new_g, new_total
        if gained < LEAST_GAIN * total:
            break
    return x


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Ordinal:
    """Maximum likelihood with a lasso; each step takes a pass or two over the rows."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    used, index, often = np.unique(index, return_inverse=True, return_counts=True)
    common = np.flatnonzero(often >= MIN_ROWS)
    place = np.full(len(used), -1)
    place[common] = np.arange(len(common))
    keep = place[index] >= 0
    row, index, value, used = row[keep], place[index[keep]].astype(np.int32), value[keep].astype(np.float64), used[common]
    n, k, width = len(grades), np.arange(len(grades)), len(used)

    def thresholds(z: np.ndarray) -> np.ndarray:  # the logs of the gaps keep them in order
        return np.cumsum(np.r_[z[0], np.exp(np.clip(z[1:], -20, 5))])

    def smooth(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = x[:width], x[width:]
        s = np.bincount(row, weights=value * w[index], minlength=n)
        cdf = 1 / (1 + np.exp(-np.clip(np.r_[0, thresholds(z), 0][None, :] - s[:, None], -60, 60)))
        cdf[:, 0], cdf[:, -1] = 0, 1
        up, down = cdf[k, grades + 1], cdf[k, grades]
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        gw = np.bincount(index, weights=value * (du - dd)[row], minlength=width) / n
        gt = np.array([(dd[grades == j + 1].sum() - du[grades == j].sum()) / n for j in range(GRADES - 1)])
        gz = np.array([gt[j:].sum() for j in range(GRADES - 1)]) * np.r_[1.0, np.exp(np.clip(z[1:], -20, 5))]
        return float(-np.log(p).mean()), np.r_[gw, gz]

    at = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    t = np.sort(np.log(at / (1 - at))) + np.arange(GRADES - 1) * 1e-2
    x = minimised(smooth, np.r_[np.zeros(width), t[0], np.log(np.diff(t))], np.r_[np.full(width, LASSO), np.zeros(GRADES - 1)])
    held = np.flatnonzero(x[:width])
    return Ordinal(used[held].astype(np.int64), x[held], thresholds(x[width:]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade, one row per labelled document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1))
    return labels.select(F.col("doc_id").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [vector(t) for t in b.column(0).to_pylist()]
        columns = [pa.array([i.tolist() for i, _ in got], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in got], pa.list_(pa.float32())), b.column(1), b.column(2), b.column(3), pa.array([len(i) for i, _ in got], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "v", "grade", "rank", "tie", "size"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ordinal | None:
    """A model fitted on at most ``rows`` labelled documents; None where there are no labels."""
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` pairs of numbers
    ranked = own.select("text", "grade", F.xxhash64("doc_id").alias("rank"), F.xxhash64("text").alias("tie"))
    made = save(ranked.mapInArrow(_vectors, "i array<int>, v array<float>, grade int, rank long, tie long, size long"), "quality-vectors")
    # repeated ids may give more rows than labels: the first ``rows`` again, as far as their features stay within the bound
    sizes = made.select("rank", "tie", "size").orderBy("rank", "tie", "size").limit(rows).collect()
    if not sizes:
        return None
    within = max(1, int(np.searchsorted(np.cumsum([r.size for r in sizes]), FIT_VALUES, side="right")))
    seen = made.orderBy("rank", "tie", "size").limit(within).select("i", "v", "grade").toArrow()
    lists = [(seen.column(c).combine_chunks()) for c in ("i", "v")]
    ends = lists[0].offsets.to_numpy()
    i, v = (x.values.to_numpy(zero_copy_only=False) for x in lists)
    got = [(i[a:b], v[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    # an order of their own makes the result independent of how the rows were dealt
    order = sorted(range(len(got)), key=lambda k: (int(seen.column("grade")[k].as_py()), zlib.crc32(got[k][0].tobytes()), zlib.crc32(got[k][1].tobytes())))
    return fit([got[k] for k in order], np.array([seen.column("grade")[k].as_py() for k in order]))


def scorer(model: Ordinal | None) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """Expected grade and tail probability of texts."""
    if model is not None:
        weight_of = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))
        dense = np.array([weight_of.get(f, 0.0) for f in SHAPE_FEATURES.tolist()])
    weights: dict[str, float] = {}
    shapes: dict[str, int] = {}

    def one(text: str | None) -> float:
        words = (text or "").split()
        distinct = set(words)
        if len(weights) > MEMO:
            weights.clear()
            shapes.clear()
        for word in distinct.difference(weights):
            weights[word], shapes[word] = sum(weight_of.get(f, 0.0) for f in word_features(word)), shape(word)
        return math.fsum(map(weights.__getitem__, distinct)) + float(dense @ shares(words, distinct, map(shapes.__getitem__, distinct)))

    def run(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if model is None:
            return np.full(len(texts), GRADES - 1.0), np.ones(len(texts))
        below = model.below(np.array([one(t) for t in texts]))
        return (1 - below).sum(1), 1 - below[:, -1]

    return run


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """doc_id, expected_grade and tail_probability of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade = scorer(held.value)
        for b in batches:
            expected, tail = grade(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "tail_probability"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def select(docs: DataFrame, model: Ordinal | None, min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows whose tail probability is ``min_tail`` at least, with all their columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade = scorer(held.value)
        for b in batches:
            yield b.filter(pa.array(grade(b.column(at).to_pylist())[1] >= min_tail))

    return docs.mapInArrow(run, docs.schema)
