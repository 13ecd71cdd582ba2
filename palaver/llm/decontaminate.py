"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased words (``\\w+``). Every word 3-gram of a passage is a seed, however many documents hold it: neither
copies nor edits of a passage decide where it is looked for. A pass joins documents to passages on the seeds and aligns the
words around each seed with the passage (match 2, mismatch -1, gap -1). The score is the best alignment over that of a
perfect copy; a document leaks a passage from ``MIN_SCORE`` on. So copies with words changed, dropped or added are found
as well as exact ones, as long as three words in a row are left of them. A window that shares too few words with its passage to reach the score is not aligned.

The pass is narrow: documents are never shuffled, and the benchmark comes to them in blocks of ``BLOCK_CHARS``
characters, which bounds what is broadcast. Passages of over ``PIECE`` words are cut into overlapping pieces, each
searched for by itself. Seeds are followed up some at a time, within a document, too: parts of a document overlap by ``OVERLAP`` words, more than an alignment of
a score above 0 can span, so each lies in one part. Of a gram's places in a piece the first and the last tell all, as windows of one seed and piece always meet. So
memory hangs on the benchmark's block, and on a text by its words' codes alone.

Defined results: a very long text is cut into parts as said; null and empty texts leak nothing; an item with fewer than 3 words, or null, matches nothing; items with a null id
are one item, found with a null id; repeated rows are judged each; empty tables give an empty result; other columns are passed through by ``clean`` and ignored by ``leaks``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

WORD = re.compile(r"\w+")
GRAM, MIN_SCORE = 3, 0.4
PIECE, BLOCK_CHARS = 256, 8_000_000
#: Alignments made in one step, and words of a batch of documents and places of seeds looked up in one step.
LANES, STEP_WORDS, OCCURRENCES = 256, 1 << 20, 1 << 20
#: An alignment has PIECE matches at most, worth 2 each, and every other word costs 1.
OVERLAP = 4 * PIECE
#: Characters of a text from which on its words are read one by one.
LONG = 1 << 22


@dataclass
class Passages:
    """Pieces of benchmark items as word codes; grams as sorted codes, each with the places where it occurs."""

    items: list[int | None]  # item of each piece
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    grams: np.ndarray  # sorted, distinct
    gram_of: np.ndarray  # occurrences, sorted by gram: index into grams,
    piece_of: np.ndarray  # piece
    place_of: np.ndarray  # and word


def passages(rows: list[tuple[int, str]]) -> Passages:
    items, words, vocabulary = [], [], {}
    for item, text in rows:
        coded = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall((text or "").lower())]
        for at in range(0, max(1, len(coded) - PIECE // 2), PIECE // 2):
            if len(coded[at : at + PIECE]) >= GRAM:
                items.append(item)
                words.append(np.array(coded[at : at + PIECE], np.int32))
    codes = [gram_codes(w, len(vocabulary))[0] for w in words]
    piece = np.repeat(np.arange(len(words)), [len(c) for c in codes])
    place = np.concatenate([np.arange(len(c)) for c in codes]) if words else np.empty(0, np.int64)
    grams, of = np.unique(np.concatenate(codes) if words else np.empty(0, np.int64), return_inverse=True)
    # the first and the last place of each gram in each piece
    order = np.lexsort((place, piece, of))
    of, piece, place = of[order], piece[order], place[order]
    other = (of[1:] != of[:-1]) | (piece[1:] != piece[:-1])
    ends = np.r_[True, other] | np.r_[other, True] if len(of) else np.empty(0, bool)
    return Passages(items, words, vocabulary, grams, of[ends], piece[ends], place[ends])


def gram_codes(w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams of known words, and where they begin."""
    if len(w) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = w >= 0
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    x = w.astype(np.int64)
    return (x[at] * size + x[at + 1]) * size + x[at + 2], at


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman score of each (passage, words), as a share of a perfect copy's."""
    out = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        tall, wide = (max(len(pairs[i][k]) for i in lanes) for k in (0, 1))
        a, b = np.full((len(lanes), tall), -2, np.int32), np.full((len(lanes), wide), -1, np.int32)
        for k, i in enumerate(lanes):
            a[k, : len(pairs[i][0])], b[k, : len(pairs[i][1])] = pairs[i]
        slope = np.arange(wide, dtype=np.int32)
        row, best = np.zeros((len(lanes), wide + 1), np.int32), np.zeros(len(lanes), np.int32)
        for i in range(tall):
            step = np.maximum(row[:, :-1] + np.where(b == a[:, i : i + 1], 2, -1), row[:, 1:] - 1)
            np.maximum(step, 0, out=step)
            row[:, 1:] = np.maximum.accumulate(step + slope, axis=1) - slope
            np.maximum(best, row.max(1), out=best)
        out[lanes] = best / np.array([2 * len(pairs[i][0]) for i in lanes])
    return out


def _coded(texts: list[str | None], p: Passages) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of some texts at a time: the first's index, all words' codes, and where each text begins (a gap follows it)."""
    got, starts, first, known = [], [], 0, p.vocabulary.get
    for i, text in enumerate(texts):
        starts.append(len(got))
        text = (text or "").lower()
        got.extend(map(known, WORD.findall(text) if len(text) < LONG else (m[0] for m in WORD.finditer(text)), repeat(-1)))
        got.append(-1)
        if len(got) >= STEP_WORDS or i + 1 == len(texts):
            yield first, np.array(got, np.int32), np.array(starts)
            got, starts, first = [], [], i + 1


def _lookup(words: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    codes, at = gram_codes(words, len(p.vocabulary))
    if not len(p.grams):
        return codes[:0], at[:0]
    index = np.minimum(np.searchsorted(p.grams, codes), len(p.grams) - 1)
    hit = p.grams[index] == codes
    return index[hit], at[hit]


def _able(words: np.ndarray, p: Passages, pieces: np.ndarray, low: np.ndarray, high: np.ndarray, min_score: float) -> np.ndarray:
    """Whether the words that each window holds of its piece could reach the score if all were matched without a gap."""
    out, held, last = np.empty(len(pieces), bool), np.zeros(len(p.vocabulary) + 1, bool), None
    for i in np.argsort(pieces, kind="stable"):
        own = p.words[pieces[i]]
        if last is not own:
            held[:] = False
            held[own], last = True, own
        out[i] = np.count_nonzero(held[words[low[i] : high[i]]]) / len(own) >= min_score
    return out


def _best(best: dict, first: int, words: np.ndarray, starts: np.ndarray, p: Passages, min_score: float, index: np.ndarray, at: np.ndarray) -> None:
    """Put the leaks that seeds (index) at some words (at) lead to into best."""
    low = np.searchsorted(p.gram_of, index)
    many = np.searchsorted(p.gram_of, index, side="right") - low
    offset = np.cumsum(many) - many
    occ = np.arange(many.sum()) - np.repeat(offset - low, many)
    at = np.repeat(at, many)
    doc = np.searchsorted(starts, at, side="right") - 1
    piece, shift = p.piece_of[occ], at - p.place_of[occ]
    order = np.lexsort((shift, piece, doc))
    doc, piece, shift = doc[order], piece[order], shift[order]
    ends = np.r_[starts[1:], len(words)] - 1
    length = np.array([len(w) for w in p.words])[piece]
    # seeds whose windows overlap share one
    new = np.r_[True, (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1]) | (shift[1:] - shift[:-1] > length[1:])]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(doc)] - 1
    d, q = doc[head], piece[head]
    slack = length[head] // 2
    low = np.maximum(starts[d], shift[head] - slack)
    high = np.minimum(ends[d], shift[tail] + length[head] + slack)
    able = _able(words, p, q, low, high, min_score)
    d, q, low, high = d[able], q[able], low[able], high[able]
    pairs = [(p.words[k], words[x:y]) for k, x, y in zip(q, low, high, strict=True)]
    for i, k, x, y, score in zip(d, q, low, high, align(pairs), strict=True):
        key = (first + int(i), p.items[k])
        if score >= min_score and (key not in best or best[key][0] < score):
            best[key] = (float(score), int(x - starts[i]), int(y - starts[i]))


def _parts(index: np.ndarray, at: np.ndarray, starts: np.ndarray, p: Passages) -> Iterator[tuple[int, int]]:
    """Runs of seeds with ``OCCURRENCES`` places in the passages, or with ``2 * OVERLAP`` words. They end between documents if they can; within one they overlap."""
    total = np.cumsum(np.searchsorted(p.gram_of, index, side="right") - np.searchsorted(p.gram_of, index))
    doc = np.searchsorted(starts, at, side="right")
    low, n = 0, len(index)
    while low < n:
        high = int(np.searchsorted(total, (total[low - 1] if low else 0) + OCCURRENCES, "right"))
        high = max(high, int(np.searchsorted(at, at[low] + 2 * OVERLAP)))
        if high >= n:
            yield low, n
            return
        begin = int(np.searchsorted(doc, doc[high]))  # the first seed of the document that the run would end in
        if begin > low:
            yield low, begin
            low = begin
        else:
            yield low, high
            low = int(np.searchsorted(at, at[high] - OVERLAP))


def find(texts: list[str | None], p: Passages, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(index of text, item, score, first word, end word) of each leak, the best place of an item in a text."""
    best: dict[tuple[int, int], tuple] = {}
    for first, words, starts in _coded(texts, p):
        index, at = _lookup(words, p)
        if not len(index):
            continue
        for low, high in _parts(index, at, starts, p):
            _best(best, first, words, starts, p, min_score, index[low:high], at[low:high])
    return [(*k, *v) for k, v in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[Passages]:
    """The benchmark's passages, some at a time."""
    items = save(benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text"), "benchmark")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for i in range(n):
        yield passages([tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).sort("item_id").toLocalIterator()])


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score and the window's first and end word of every leak."""

    def pairs(held: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = find(b.column(1).to_pylist(), held.value, min_score)
                own = b.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                rest = [pa.array([g[k] for g in got], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([own, *rest], ["doc_id", "item_id", "score", "first_word", "end_word"])

        return run

    out, rows = None, docs.select(F.col("doc_id").cast("long"), "text")
    for p in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(p)
        part = save(rows.mapInArrow(pairs(held), "doc_id long, item_id long, score double, first_word long, end_word long"), "leaks")
        held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; all columns are kept."""
    at = docs.columns.index("text")

    def keep(held: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                ok[[g[0] for g in find(b.column(at).to_pylist(), held.value, min_score)]] = False
                yield b.filter(pa.array(ok))

        return run

    out = docs
    for p in _blocks(benchmark):
        out = out.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(p)), docs.schema)
    return out
