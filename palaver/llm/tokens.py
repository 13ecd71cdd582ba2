"""Token-ID output: whole texts as ids in range-coded, checksummed blocks, and back.

Documents are dealt by ranges of their ids and sorted, so that files in order hold all ids in ascending doc_id order. A task encodes its
texts with the tokenizers library, appends the end id to each, cuts the stream into blocks of ``BLOCK`` ids that are coded by
``coder`` each from a fresh state, and writes one file to the shared folder. A file that a lost task left is not in the
manifest, which Spark commits; each attempt has a file name of its own.

File: ``PALID3\\n``; then sections, each a 4-byte kind, a length (u64) and that many bytes: ``BLKS`` has for each block how many ids and bytes it has
and the crc32 of its bytes and of its ids (u32 each), then the blocks' bytes; ``DOCS`` has the documents' ids, nulls, and lengths
(zlib), with a crc32 before. Every block can be decoded by itself.

Where white space never joins tokens in the vocabulary's rules, a word's ids are the same in any text: words are encoded once by the
library and kept at hand, for as long as a worker lives. Where its normalizer and splitter leave words of Latin letters whole, these go straight to the
library's model. Vocabularies with other rules get whole texts.

Defined results: a very long text is cut into words as a whole, which takes some ten times its size in a task, and its ids into blocks as others are; a null or empty text is the end id alone; a null doc_id comes before all others; repeated rows are written each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coder
from .shared import filesystem, save, scratch

MAGIC, END, OTHER = b"PALID3\n", 1, -1
#: What a splitter's pattern that never crosses white space begins with: words, digits, and whatever is neither.
SPLIT = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Ids in a block; blocks that go in step, the last ones of a file by half more; words kept at hand; bytes of texts whose words are looked up together.
BLOCK, LANES, MEMO, STEP = 4096, 1024, 500_000, 12 << 20
#: Letters of one code point that stay as they are but for case.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
ALL_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
SMALL = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


class Encoder:
    """Ids of whole texts, as 16-bit numbers.

    How a vocabulary may be used is read from its rules. If white space always parts words, words are encoded one by one and kept. If letters and
    what follows them are tokens of their own and case is folded, too, a word of Latin letters goes straight to the library's model. Otherwise whole texts
    go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        if self.vocabulary > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        rules = json.loads(self.library.to_str())
        self.by_word, self.by_model = parted(rules), folded(rules)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in SMALL}
        self.special = "|".join(re.escape(t["content"]) for t in rules.get("added_tokens", [])) or r"\z."
        self.forget()

    def forget(self) -> None:
        """Empty what is kept: words and which unit each is, the units' ids and where each begins; of other units, their ids' bytes."""
        self.cores, self.units, self.hits = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.starts = np.empty(0, np.uint16), np.zeros(1, np.int64)
        self.words: dict[str, bytes] = {}

    def trim(self) -> None:
        """Keep the words that were met in several steps, as far as they are not too many."""
        keep = self.hits > 1
        own = self.units[keep]
        if len(own) > MEMO // 2:
            self.forget()
            return
        letters = own != OTHER
        self.flat, ends = gathered(self.flat, self.starts, own[letters])
        self.starts = np.r_[0, ends].astype(np.int64)
        own[letters] = np.arange(np.count_nonzero(letters))
        self.cores, self.units, self.hits = self.cores.filter(pa.array(keep)), own, np.zeros(len(own), np.int64)

    def direct(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word, which holds no white space."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = self.direct(word)
        return ids

    def learn(self, new: pa.Array) -> None:
        """Keep the ids of words of Latin letters only; other words are kept as ``OTHER``."""
        cores = new.to_pylist()
        pieces, unit = [], np.full(len(cores), OTHER)
        for k, core in enumerate(cores):
            if core.isascii() and core.isalpha():
                unit[k] = len(pieces)
                pieces.append(core.lower())
            elif LETTERS.fullmatch(core):
                unit[k] = len(pieces)
                pieces.append(core.lower().translate(self.pieces))
        tokenize = self.library.model.tokenize
        flat, sizes = [], []
        collects = gc.isenabled()
        gc.disable()  # the lists hold no cycles
        for piece in pieces:
            own = tokenize(piece)
            sizes.append(len(own))
            flat += [t.id for t in own]
        if collects:
            gc.enable()
        unit[unit != OTHER] += len(self.starts) - 1
        self.cores, self.units, self.hits = pa.concat_arrays([self.cores, new]), np.r_[self.units, unit], np.r_[self.hits, np.zeros(len(unit), np.int64)]
        self.flat = np.r_[self.flat, np.array(flat, np.uint16)]
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)]

    def unit_of(self, cores: pa.Array) -> np.ndarray:
        """The unit of each of some distinct words, which are learned if they are new."""
        found = pc.index_in(cores, value_set=self.cores)
        if found.null_count:
            at = np.flatnonzero(found.is_null())
            known = len(self.cores)
            self.learn(cores.take(pa.array(at)))
            place = found.fill_null(0).to_numpy().astype(np.int64)
            place[at] = known + np.arange(len(at))
        else:
            place = found.to_numpy()
        self.hits[place] += 1
        return self.units[place]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and where each word's begin and the last one's end.

        A word is one or two units: a core of letters and what follows it, or the whole word.
        """
        if len(self.words) > MEMO:
            self.forget()
        elif len(self.cores) > MEMO:
            self.trim()
        if not self.by_model:
            own = list(map(self.word, words.to_pylist()))
            return np.frombuffer(b"".join(own), "<u2"), np.r_[0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) // 2)]
        core = pc.ascii_rtrim(words, characters=string.punctuation)  # after letters these are one token of their own
        distinct = core.dictionary_encode()
        first = self.unit_of(distinct.dictionary)[distinct.indices.to_numpy()]
        longer = pc.binary_length(words).to_numpy() > pc.binary_length(core).to_numpy()
        known, others = len(self.starts) - 1, [""]
        second = np.full(len(words), known)
        for held, unit, of in ((np.flatnonzero(longer & (first != OTHER)), second, lambda w: pc.utf8_ltrim(w, characters=ALL_LETTERS)), (np.flatnonzero(first == OTHER), first, lambda w: w)):
            if len(held):
                rest = of(words.take(pa.array(held))).dictionary_encode()
                unit[held] = known + len(others) + rest.indices.to_numpy()
                others += rest.dictionary.to_pylist()
        got = list(map(self.word, others))
        flat = np.r_[self.flat, np.frombuffer(b"".join(got), "<u2")]
        starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 2)]
        ids, ends = gathered(flat, starts, np.column_stack([first, second]).ravel())
        return ids, np.r_[0, ends[1::2]]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if not self.by_word:
            got = [self.direct(t.as_py() or "") for t in texts]
            return np.frombuffer(b"".join(got), "<u2"), np.array([len(g) // 2 for g in got], np.int64)
        texts = pc.fill_null(texts, "")
        if self.by_model and not pc.any(pc.match_substring_regex(texts, self.special, ignore_case=True)).as_py():
            texts = pc.ascii_lower(texts)  # as the normalizer does; the marks that the library takes for special ones could come to be otherwise
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        flat, starts = self.of_words(words.dictionary)
        ids, ends = gathered(flat, starts, words.indices.to_numpy())
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.diff(np.r_[0, ends][bounds])


def gathered(flat: np.ndarray, starts: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of some parts (part k is flat[starts[k] : starts[k + 1]]), one after another, and where each ends."""
    starts = starts.astype(np.int32)  # there are far fewer values than that
    many = (starts[1:] - starts[:-1])[parts]
    ends = np.cumsum(many, dtype=np.int32)
    shift = starts[parts]
    shift -= ends
    shift += many
    at = np.repeat(shift, many)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], ends


def parted(rules: dict) -> bool:
    """Whether white space parts words whatever stands beside it, by rules that are known to do so."""
    kinds, splits = _rules(rules)
    return kinds <= {"NFC", "Lowercase", "Replace"} and len(splits) == 2 and SPLIT in str(splits[0].get("pattern")) and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]


def folded(rules: dict) -> bool:
    """Whether letters are tokens apart from what isn't one, folded to lower case, and go to the model as bytes."""
    kinds, _ = _rules(rules)
    return parted(rules) and "Lowercase" in kinds and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")


def _rules(rules: dict) -> tuple[set[str], list[dict]]:
    """Kinds of normalizers, and the steps of the splitter: a pattern, then bytes."""
    normalizer, splitter = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    kinds = {n["type"] for n in normalizer.get("normalizers", [normalizer] if normalizer else [])}
    steps = splitter.get("pretokenizers", [])
    return kinds, steps if [s["type"] for s in steps] == ["Split", "ByteLevel"] else []


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def section(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<Q", len(body)) + body


def pack(blocks: list[np.ndarray]) -> bytes:
    coded = coder.encode(blocks)
    heads = [struct.pack("<IIII", len(b), len(c), zlib.crc32(c), zlib.crc32(b.astype("<u4"))) for b, c in zip(blocks, coded, strict=True)]
    return section(b"BLKS", struct.pack("<I", len(blocks)) + b"".join(heads) + b"".join(coded))


def unpack(body: bytes) -> list[np.ndarray]:
    """The blocks of a section; raises ValueError where a checksum differs."""
    (n,) = struct.unpack_from("<I", body)
    heads = [struct.unpack_from("<IIII", body, 4 + 16 * i) for i in range(n)]
    at, coded = 4 + 16 * n, []
    for _, size, crc, _ in heads:
        coded.append(body[at : at + size])
        at += size
        if zlib.crc32(coded[-1]) != crc:
            raise ValueError("a block's bytes differ from their checksum")
    blocks = coder.decode(coded, [h[0] for h in heads])
    for b, (*_, crc) in zip(blocks, heads, strict=True):
        if zlib.crc32(b.astype("<u4")) != crc:
            raise ValueError("a block's ids differ from their checksum")
    return blocks


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts of about ``STEP`` bytes at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // STEP)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            yield texts.slice(low, high - low)


def _write(folder: str, tokenizer: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, encode = TaskContext.get().partitionId(), None, None
        ids, sizes, held, count, total = [], [], [], 0, 0
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        with contextlib.ExitStack() as opened:
            for b in batches:
                if b.num_rows and out is None:
                    fs, at = filesystem(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out, encode = opened.enter_context(fs.open_output_stream(at, compression=None)), encoder(tokenizer)
                    out.write(MAGIC)
                ids += b.column(0).to_pylist()
                for texts in slices(b.column(1)):
                    got, many = encode.texts(texts)
                    held.append(np.insert(got, np.cumsum(many), np.uint16(END)))  # after each text
                    sizes.append(many + 1)
                    count += len(held[-1])
                    while count >= BLOCK * (LANES + LANES // 2):  # so that the last blocks of a file go in step with many others, too
                        stream = np.concatenate(held)
                        out.write(pack(np.split(stream[: BLOCK * LANES], LANES)))
                        held, count, total = [stream[BLOCK * LANES :]], count - BLOCK * LANES, total + BLOCK * LANES
            if out is None:
                return
            if count:
                out.write(pack(np.split(np.concatenate(held), range(BLOCK, count, BLOCK))))
            body = zlib.compress(np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes() + np.concatenate(sizes).astype("<i8").tobytes())
            out.write(section(b"DOCS", struct.pack("<QI", len(ids), zlib.crc32(body)) + body))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(ids)], "n_ids": [total + count]})

    return run


def write(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files; returns the manifest: part, path, n_docs, n_ids and start, the ids before the file."""
    spark = docs.sparkSession
    # the part only splits ranges where an id repeats; the pass that finds ranges reads no texts
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    dealt = rows.repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part", F.xxhash64("text")).select("doc_id", "text")
    files = save(dealt.mapInArrow(_write(scratch(spark, "ids"), tokenizer), "part long, path string, n_docs long, n_ids long"), "ids-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def documents(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a file."""
    index = next(body for kind, body in sections_of(path, b"DOCS"))
    n, crc = struct.unpack_from("<QI", index)
    if zlib.crc32(index[12:]) != crc:
        raise ValueError("the index's checksum differs")
    raw = zlib.decompress(index[12:])
    ids, nulls, sizes = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)
    stream = (np.concatenate(unpack(body)) for _, body in sections_of(path, b"BLKS"))
    held, have = [], 0
    for doc_id, null, size in zip(ids.tolist(), nulls.tolist(), sizes.tolist(), strict=True):
        while have < size:
            held.append(next(stream))
            have += len(held[-1])
        if len(held) > 1 and len(held[0]) < size:
            held = [np.concatenate(held)]
        elif not len(held[0]):
            held.pop(0)
        yield (None if null else doc_id), held[0][:size]
        held[0], have = held[0][size:], have - size


def sections_of(path: str, kind: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Sections of one kind; others are passed over unread."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no id file")
        while head := f.read(12):
            size = struct.unpack("<Q", head[4:])[0]
            if head[:4] == kind:
                yield kind, f.read(size)
            else:
                f.seek(f.tell() + size)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc_id, ids in documents(path):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                start += len(ids)
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    files = manifest.select("path", "start")
    return files.repartition(max(1, files.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
