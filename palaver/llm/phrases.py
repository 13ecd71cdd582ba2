"""Phrase collocation mining: phrases whose words stand together more often than apart, for each language.

All n-grams of 1 to ``max_n`` words become rows, which are aggregated by language and phrase; each way to cut a phrase in two joins the counts of its two parts;
scores are exact decimals; phrases that a phrase of one word more accounts for go by an anti-join; a window ranks what is left.

A phrase is no more frequent than its parts, so from three words on only n-grams whose two parts of one word less are frequent enough can count. Those parts are
marked in a bitmap of fixed size (``lines.bitmap``), and other n-grams make no rows. Where two parts share a bit a row too many is made; none is missed, and
counts come from the rows alone. A task counts equal n-grams of ``PLACES`` places before it makes rows, and they are added up again before the exchange, so neither a hot
language nor a hot phrase travels more than once a task and slice.

Phrases are told by one blank between words, which no word can hold. A row without words holds a language's number of words.

Defined results: a null language is ``und``; null and empty texts have no words; repeated rows count each; equal scores are ranked by count, then phrase in the order of its
UTF-8 bytes; an empty table gives an empty result; other columns are ignored. A long text is cut into words as a whole, which takes some six times its size in a
task, and into n-grams slice by slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import BASE, MASK, bitmap
from .shared import save

MAX_N, LEAST, SHARE, TOP = 3, 10, 50, 2000
SCORE_UNIT = 1_000_000
UNKNOWN = "und"
PIECE_END, BLANKS = "[.,;:!?\n-\r]", "[ \t]+"
#: Bytes of text that are cut into words together, and places whose n-grams are counted together.
BYTES, PLACES = 4 << 20, 1 << 19


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of ``most`` bytes each, or of one row."""
    out, low = [], 0
    ends = np.cumsum(sizes)
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        out.append((low, high))
        low = high
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and how many words are left in its piece from each word on."""
    pieces = pc.list_flatten(pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string())), PIECE_END))
    split = pc.split_pattern_regex(pieces, BLANKS)
    flat, piece = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(flat, "")
    flat, piece = flat.filter(real), piece[real.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(np.bincount(piece, minlength=len(split))) if len(piece) else np.zeros(1, np.int64)
    return flat, ends[piece] - np.arange(len(piece))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams from each place on, of hashes of words."""
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * BASE + words[j : len(words) - n + 1 + j]
    return out


def _counted(words: pa.DictionaryArray, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct n-grams at the places ``at``, and their counts."""
    w, size = words.indices.to_numpy(), len(words.dictionary)
    ids = w[at].astype(np.int64)
    for j in range(1, n):
        ids = pa.array(ids * size + w[at + j]).dictionary_encode().indices.to_numpy().astype(np.int64)
    if n == 1:
        ids = pa.array(ids).dictionary_encode().indices.to_numpy()
    counts = np.bincount(ids)
    first = np.empty(len(counts), np.int64)
    first[ids[::-1]] = at[::-1]
    parts = [words.dictionary.take(pa.array(w[first + j])) for j in range(n)]
    return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]), counts


def _slice(words: pa.Array, left: np.ndarray, sizes: tuple[int, ...], lang: str, bits: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Distinct n-grams and counts of the n-grams that begin in each slice."""
    for low in range(0, len(words), PLACES):
        here = words.slice(low, PLACES + max(sizes) - 1).dictionary_encode()
        begins = left[low : low + PLACES]
        hashes = None
        if bits is not None:
            salt = np.uint64(_hash(lang))
            hashes = np.fromiter(map(_hash, here.dictionary.to_pylist()), np.uint64, len(here.dictionary))[here.indices.to_numpy()]
        for n in sizes:
            ok = begins >= n
            if hashes is not None and len(here) >= n:
                low_bits = ((_rolled(hashes, n - 1) ^ salt) & np.uint64(MASK)).astype(np.int64)
                marked = np.zeros(len(here) + 1, bool)
                marked[: len(low_bits)] = bits[low_bits >> 3] >> (low_bits & 7) & 1
                ok = ok & marked[: len(begins)] & marked[1 : len(begins) + 1]
            at = np.flatnonzero(ok)
            if len(at):
                yield _counted(here, at, n)


def _rows(sizes: tuple[int, ...], held: Broadcast | None) -> Callable:
    """lang, phrase and count; with single words, the number of all words beside the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if held is None else np.frombuffer(held.value, np.uint8)

        def out(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int64))), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for low, high in _cuts(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), BYTES):
                b = batch.slice(low, high - low)
                langs = b.column(0).dictionary_encode()
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    words, left = words_of(b.column(1).filter(pc.equal(langs.indices, i)).drop_null())
                    if 1 in sizes and len(words):
                        yield out(lang, pa.array([""]), np.array([len(words)]))
                    for phrases, counts in _slice(words, left, sizes, lang, bits):
                        yield out(lang, phrases, counts)

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for lang, phrase in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = np.fromiter(map(_hash, phrase.split(" ")), np.uint64)
            keys.append(int((_rolled(words, len(words)) ^ np.uint64(_hash(lang)))[0].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["k"])


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, phrase, f and size of the phrases of up to ``max_n`` words with f >= ``least``; size 0 is a language's number of words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    levels: list[DataFrame] = []
    for sizes in ((1, 2), *((n,) for n in range(3, max_n + 1))):
        held = None
        if levels:
            parts = levels[-1].where(F.col("size") == sizes[0] - 1).select("lang", "phrase")
            held = docs.sparkSession.sparkContext.broadcast(bitmap(parts.mapInArrow(_marks, "k long")))
        rows = texts.mapInArrow(_rows(sizes, held), "lang string, phrase string, f long")
        summed = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
        levels.append(save(summed.withColumn("size", size), f"phrases-{sizes[-1]}"))
        if held is not None:
            held.destroy()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


#: The whole part of ``SCORE_UNIT`` * a * a / (l * r), exact while counts are below 10 ** 15.
SCORE = f"""(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST({SCORE_UNIT} AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"""


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_n`` words that occur ``least`` times, by the score of their lowest cut.

    A phrase goes if a longer one that holds it has ``share`` percent of its occurrences or more.
    """
    found = frequent(docs, max_n, least)
    phrases = found.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), "size")
    counts = found.where("size >= 1")
    part = lambda k, from_: F.concat_ws(" ", F.slice(F.split("phrase", " "), *from_(k)))
    cut = lambda k: F.struct(k.alias("k"), part(k, lambda k: (1, k)).alias("first"), part(k, lambda k: (k + 1, F.col("size") - k)).alias("rest"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")
    for name, of in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(of), F.col("f").alias(name)), ["lang", of])
    lowest = cuts.select("lang", "phrase", "a", F.struct(F.expr(SCORE).alias("score"), "k", "l", "r").alias("cut"))
    lowest = lowest.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    inner = F.array(part(None, lambda _: (1, F.col("size") - 1)), part(None, lambda _: (2, F.col("size") - 1)))
    longer = phrases.where("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    same = (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase"))
    kept = lowest.alias("c").join(longer.alias("x"), same & (100 * F.col("x.longer") >= share * F.col("c.a")), "left_anti")

    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
