"""Line dedup by a deletion-neighbourhood join over words.

A line is its words, joined by one space; blank lines are left alone. Of equal lines the earliest (by doc_id, then line) stays. A
line of ``MIN_WORDS`` words or more also goes if an earlier line that stays, of whatever length, is within one edit of a word (one put in, dropped or changed). All variants within the
bound, the line itself and the line without each of its words, are emitted as hashed keys; lines that share a key and the deleted place, or
of which one is whole, are within one edit; that is verified on the words.

So whether a line goes hangs on the earlier lines beside it, and that is settled in rounds over the groups of lines that share a key (``settled``): a line with no undecided line before it in
any of its groups stays, and a line with one that stays before it goes. There are as many rounds as lines hang on one another, two or three as a rule, each a written table. The reason told is the
earliest line that stays, so no line goes for a line that it doesn't resemble.

Only lines that can have a partner emit variants: one edit leaves the first or the second half of a line as it is, so lines whose
halves (for their own length and for one word less) occur in no other line have none. That loses no pair. Halves that lines share are marked in a bitmap
of fixed size, which lets the second scan pass over most lines before any exchange; an exact join follows. Groups of equal keys are
aggregated to their earliest line, never paired, so a passage in a third of all documents costs its rows once.

Defined results: null and empty texts have no lines; a null doc_id comes before all others; repeated rows have equal places, so neither's lines are
earlier, and both stay as they are; a very long text is cut into lines in its task, and a very long line into as many variants as it has words, in batches; an empty table gives an empty result; other columns are passed through by ``clean`` and ignored by ``repeats``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save, spare

MIN_WORDS = 8
#: Bits of the filter that the second scan gets, as a power of two (4 MB).
FILTER_BITS = 25
MASK = (1 << FILTER_BITS) - 1
#: Base of the rolling hash, odd, and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Rows of variants in one batch.
ROWS = 1 << 17


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def halves(words: list[bytes]) -> list[int]:
    """Keys of both halves, for the line's length and for one word less."""
    n, keys = len(words), []
    for m in (n, n - 1):
        low = m // 2
        keys += [_hash(b"first %d " % m + b" ".join(words[:low])), _hash(b"second %d " % m + b" ".join(words[n - m + low :]))]
    return keys


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, list[bytes]]]:
    """doc_id, line_no and words of each line that isn't blank."""
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        for i, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
            if words := line.split():
                yield doc_id, i, words


def _signed(values: list[int | None]) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


def _keys(min_words: int) -> Callable:
    """Keys of each line; those of its halves once for each line and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for doc_id, i, words in _lines(b):
                h = _hash(b" ".join(words))
                new = len(words) >= min_words - 1 and h not in seen  # one word less may be a partner's
                if new:
                    seen.add(h)
                rows.append((doc_id, i, h, *(halves(words) if new else (None,) * 4)))
            if len(seen) > 1 << 20:
                seen.clear()
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(2)] + [_signed([r[k] for r in rows]) for k in range(2, 7)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "h", "k0", "k1", "k2", "k3"])

    return run


def _hopeful(min_words: int, held: Broadcast) -> Callable:
    """Lines with a half whose bit is set, and those halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            rows = []
            for doc_id, i, words in _lines(b):
                if len(words) >= min_words - 1:
                    hits = [k for k in halves(words) if bits[(k & MASK) >> 3] >> (k & 7) & 1]
                    if hits:
                        line = b" ".join(words)
                        rows.append((doc_id, i, _hash(line), line.decode("utf-8", "surrogatepass"), hits))
            flat = _signed([k for r in rows for k in r[4]])
            ends = np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), _signed([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "h", "line", "ks"])

    return run


def bitmap(keys: DataFrame) -> bytes:
    """Bits of the keys k, by their low digits: ``2 ** FILTER_BITS`` of them whatever the number of keys."""
    low = F.col("k").bitwiseAND(F.lit(MASK))
    set_ = keys.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[set_.column("w").to_numpy()] = set_.column("b").to_numpy()
    return out.tobytes()


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def variants(words: list[str]) -> np.ndarray:
    """Keys of the whole line and of the line without each word."""
    w = _word_hashes(words)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(w) - 1, BASE)])
    before = np.r_[np.uint64(0), np.cumsum(w * power)]
    return np.r_[before[-1], before[:-1] + (before[-1] - before[1:]) * INVERSE]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate([k for _, _, k in held])
            each = [len(k) for _, _, k in held]
            place = np.concatenate([np.arange(-1, n - 1) for n in each])
            doc = pa.array([d for d, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), each)))
            line = pa.array(np.repeat([x for _, x, _ in held], each), pa.int64())
            words = pa.array(np.repeat(each, each) - 1, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(place, pa.int64()), doc, line, words], ["key", "place", "doc_id", "line_no", "words"])

        for doc, line, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append((doc, line, variants(text.split(" "))))
            size += len(held[-1][2])
            if size > ROWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word put in, dropped or changed makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [within_one(x.split(" "), y.split(" ")) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
        yield b.filter(pa.array(ok, pa.bool_())).select(["doc_id", "line_no", "kept_doc_id", "kept_line_no"])


GROUP = ("key", "sub")


def links(emitted: DataFrame, min_words: int) -> DataFrame:
    """key and sub of a group, own (place of a line) and stays (whether it is too short to go): lines of a group are within one edit of each other.

    Groups are lines with the same key and the same word left out, and each line with a line that has its key with a word left out. A hot passage is one group, whose lines are rows.
    """
    own = F.struct("doc_id", "line_no")
    rows = emitted.select("key", "place", own.alias("own"), (F.col("words") < min_words).alias("stays"))
    less = rows.where("place >= 0")
    several = less.groupBy("key", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    changed = less.join(several, ["key", "place"]).select("key", F.xxhash64("place").alias("sub"), "own", "stays")
    whole = rows.where("place < 0").select("key", F.col("own").alias("whole"), F.col("stays").alias("whole_stays"))
    both = F.array(F.struct("own", "stays"), F.struct(F.col("whole").alias("own"), F.col("whole_stays").alias("stays")))
    put_in = less.join(whole, "key").select("key", F.xxhash64(F.lit("whole"), "own.doc_id", "own.line_no").alias("sub"), F.explode(both).alias("x")).select("key", "sub", "x.own", "x.stays")
    return changed.unionByName(put_in)


def settled(members: DataFrame) -> DataFrame:
    """Those rows of ``members`` whose line stays: of the lines in order, each that is in no group with an earlier one that stays."""
    while not members.where("NOT stays").isEmpty():
        first = F.min(F.when(F.col("stays"), F.col("own"))).alias("kept"), F.min(F.when(~F.col("stays"), F.col("own"))).alias("open")
        groups = members.groupBy(*GROUP).agg(*first)
        open_ = members.where("NOT stays").join(groups, list(GROUP))
        before = lambda c: F.max(F.coalesce(F.col(c) < F.col("own"), F.lit(False)))
        verdict = open_.groupBy("own").agg(before("kept").alias("goes"), before("open").alias("waits")).select(F.col("own").alias("at"), "goes", "waits")
        told = members.join(verdict, F.col("own").eqNullSafe(F.col("at")), "left").where(F.coalesce(~F.col("goes"), F.lit(True)))
        members = save(told.select(*GROUP, "own", (F.col("stays") | ~F.coalesce("waits", F.lit(False))).alias("stays")), "line-rounds")
    return members


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line_no, kept_doc_id, kept_line_no and edits (0 for equal lines, 1 for those within one edit) of each line that goes, with the earliest line that stays for it."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, line_no long, h long, k0 long, k1 long, k2 long, k3 long"
    keys = save(texts.mapInArrow(_keys(min_words), schema), "line-keys")
    place = F.struct("doc_id", "line_no")
    first = save(keys.groupBy("h").agg(F.min(place).alias("first")), "line-first")

    half = keys.where("k0 IS NOT NULL").select("h", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = save(half.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("k"), "line-halves")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(shared))
    hopeful = save(texts.mapInArrow(_hopeful(min_words, held), "doc_id long, line_no long, h long, line string, ks array<long>"), "line-hopeful")
    sure = hopeful.select("h", F.explode("ks").alias("k")).join(shared, "k", "left_semi").select("h").distinct().join(first, "h")
    sure = sure.select("h", F.col("first.doc_id").alias("fd"), F.col("first.line_no").alias("fl"))
    chosen = hopeful.drop("ks").join(sure, "h").where(F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("line_no") == F.col("fl")))
    chosen = save(chosen.select("h", "doc_id", "line_no", "line").dropDuplicates(["h"]), "line-chosen")

    emitted = save(chosen.select("doc_id", "line_no", "line").mapInArrow(_emit, "key long, place long, doc_id long, line_no long, words long"), "line-variants")
    members = save(links(emitted, min_words), "line-links")
    stay = settled(members)
    kept = stay.groupBy(*GROUP).agg(F.min("own").alias("kept"))
    near = members.where("NOT stays").join(kept, list(GROUP)).where("kept < own").groupBy("own").agg(F.min("kept").alias("kept"))
    near = near.join(stay.select(F.col("own").alias("at")).distinct(), F.col("own").eqNullSafe(F.col("at")), "left_anti")
    texts = chosen.select(F.struct("doc_id", "line_no").alias("at"), "line")
    pairs = near.join(texts.withColumnRenamed("line", "a"), F.col("own").eqNullSafe(F.col("at"))).drop("at")
    pairs = pairs.join(texts.withColumnRenamed("line", "b"), F.col("kept").eqNullSafe(F.col("at"))).drop("at")
    pairs = pairs.select("own.doc_id", "own.line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "a", "b")
    verified = pairs.mapInArrow(_verify, "doc_id long, line_no long, kept_doc_id long, kept_line_no long")
    near = save(verified.select(F.struct("doc_id", "line_no").alias("near_own"), F.struct(F.col("kept_doc_id").alias("doc_id"), F.col("kept_line_no").alias("line_no")).alias("near_kept")), "line-near")

    verdict = first.join(near, F.col("first").eqNullSafe(F.col("near_own")), "left").select("h", "first", "near_kept")
    judged = keys.select("h", place.alias("own")).join(verdict, "h")  # a hot line's rows are split
    exact = ~F.col("own").eqNullSafe(F.col("first"))
    kept = F.coalesce("near_kept", F.when(exact, F.col("first")))
    return judged.select("own", kept.alias("kept"), F.when(F.col("near_kept").isNotNull(), 1).otherwise(0).alias("edits")).where("kept IS NOT NULL").select(
        "own.doc_id", "own.line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "edits"
    )


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that go; all columns are kept, and so are rows without text."""
    name = spare(docs, "gone")
    gone = repeats(docs, min_words).groupBy("doc_id").agg(F.collect_set("line_no").alias(name))
    joined = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    left = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains(F.col(f"g.{name}"), i.cast("long")))
    text = F.when(F.col(f"g.{name}").isNull() | F.col("d.text").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"d.{c}") for c in docs.columns])
