"""Exact round trips: archives, media and id files."""

import hashlib
import io
import random
import wave
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palaver.llm import coder, media, tokens, warc

LONG = "a long text, " * 4000


@pytest.mark.parametrize("step", [37, 1 << 20])
def test_warc(spark, step):
    rows = [(1, "u", "a" * 2000, 1), (2, None, "a" * 2000, 2), (3, "w", "b" * 999, 3), (4, "w\r\nX: y", "b" * 999, 4), (5, "x", None, 5), (None, "z", "c" * 5000, 6), (6, "y", "c" * 5000, 7), (6, "y", "c" * 5000, 8), (7, "é", LONG, 9), (8, "", "", 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").coalesce(2)
    got = warc.read(warc.write(pages), True, step).collect()
    want = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        equal = [p for p, _, h, _ in rows if h == html and len(data) >= 1000]
        keeper = max((p for p in equal if p is not None), default=None)
        revisit = keeper is not None and page != keeper
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None, None if revisit else data))
    key = lambda r: tuple(map(repr, r))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert {r.page_id: r.url for r in got}[4] == "w%0D%0AX:%20y"


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(empty)).count() == 0


def test_warc_magic_inside_a_payload(tmp_path):
    members = [warc.record(i, "u", b"\x1f\x8b\x08 no member", hashlib.sha1(b"\x1f\x8b\x08 no member").hexdigest(), 13, None, False) for i in range(5)]
    junk = b"\x1f\x8b\x08\x00junk" * 3
    (tmp_path / "a.warc.gz").write_bytes(junk + b"".join(members))
    size = (tmp_path / "a.warc.gz").stat().st_size
    found = [n["warc-record-id"] for at in range(0, size, 100) for n, _ in warc.records(str(tmp_path / "a.warc.gz"), at, min(size, at + 100))]
    assert found == [warc.record_id(i) for i in range(5)]


def test_media(spark):
    texts = ["hello", None, "", "é" * 288, LONG, "hello", "x" * 576, "x" * 577]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    stored = media.store(docs)
    got = {r.doc_id: r for r in media.analyse(stored).collect()}
    for r in stored.collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        with wave.open(io.BytesIO(r.media)) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        row = got[r.doc_id]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert row.media_sha256 == hashlib.sha256(r.media).hexdigest() and row.media_bytes == len(r.media)
        assert len(row.times) == len(row.codes) and list(row.times) == sorted(row.times)
    assert got[0].codes == got[5].codes and got[1].codes == got[2].codes == [] and len(got[4].codes) > 100
    assert media.analyse(media.store(docs.limit(0))).count() == 0


def test_peaks_of_a_tone():
    t = np.arange(576 * 4)
    tone = (128 + 100 * np.sin(2 * np.pi * 50 * t / 576)).astype(np.uint8)
    assert (media.peaks(tone)[:, 0] == 50).all()


def test_coder():
    rng = np.random.default_rng(0)
    for trial in range(6):
        blocks = [rng.integers(0, 1 << 16, rng.integers(1, 300)) if trial % 2 else rng.zipf(1.3, rng.integers(1, 4097)) % 49408 for _ in range(rng.integers(1, 20))]
        coded = coder.encode(blocks)
        back = coder.decode(coded, [len(b) for b in blocks])
        assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
        assert coder.encode(blocks[:1])[0] == coded[0]  # a block's bytes don't depend on its neighbours
    edges = [np.zeros(4096, np.int64), np.arange(4096) * 16, rng.permutation(4096), np.array([65535]), np.tile([7, 65535, 0], 1365)]
    coded = coder.encode(edges)
    assert all(np.array_equal(a, b) for a, b in zip(edges, coder.decode(coded, [len(b) for b in edges]), strict=True))
    assert len(coded[0]) < 200 and len(coded[4]) < 200
    for bad in ([np.arange(0)], [np.arange(4097)]):
        with pytest.raises(ValueError):
            coder.encode(bad)


def test_all_three_orders_predict():
    """Each order's structure is made use of: few bytes where only that order tells the next id."""
    rng = np.random.default_rng(1)
    size = lambda ids: len(coder.encode([np.asarray(ids)])[0])
    plain = size(rng.integers(0, 256, 4096))  # nothing to know: 8 digits an id
    assert 4000 < plain < 4700
    skewed = np.minimum(rng.geometric(0.3, 4096), 255)
    assert size(skewed) < 0.5 * plain
    following = rng.permutation(256)  # the last id tells the next, but for one in ten
    chain = [0]
    for jump in rng.random(4095) < 0.1:
        chain.append(int(rng.integers(0, 256)) if jump else int(following[chain[-1]]))
    assert size(chain) < 0.5 * plain
    table = rng.integers(0, 40, (40, 40))  # the last two do
    pair = [1, 2]
    for jump in rng.random(4094) < 0.02:
        pair.append(int(rng.integers(0, 40)) if jump else int(table[pair[-2], pair[-1]]))
    assert size(pair) < 0.75 * size(rng.permutation(pair))


def test_only_coders_that_need_a_word_read_one():
    """A step's work goes with the words that are due, not with all coders."""
    taken = []

    class Words(np.ndarray):
        def take(self, at, **options):
            taken.append(np.size(at))
            return np.asarray(self).take(at, **options)

    words = np.arange(1, 401, dtype=np.uint16)
    reader = coder.Reader(words.view(Words), np.arange(0, 400, 4))
    before, due = np.asarray(reader.code).copy(), np.arange(100) % 25 == 7
    reader.code[due] = before[due] = 5
    reader.width[due] = 9
    reader.fill()
    assert sum(taken) == 4
    assert reader.width[due].tolist() == [9 * 65536.0] * 4 and (reader.width[~due] == coder.FULL - 1).all()
    assert np.asarray(reader.code)[due].tolist() == (5 * 65536.0 + words[3::4][due]).tolist() and np.array_equal(np.asarray(reader.code)[~due], before[~due])
    assert reader.at.tolist() == (np.arange(3, 400, 4) + due).tolist()


def test_damage_is_noticed():
    body = tokens.pack([np.arange(500, dtype=np.uint16), np.arange(4096, dtype=np.uint16)])[12:]
    assert [len(b) for b in tokens.unpack(body)] == [500, 4096]
    r = random.Random(0)
    for at in [4, 8, 12, 28, 29, 30, 31, *(r.randrange(32, len(body)) for _ in range(60))]:
        with pytest.raises(ValueError):
            tokens.unpack(body[:at] + bytes([body[at] ^ 1 << r.randrange(8)]) + body[at + 1 :])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_encoded_as_in_the_whole_text(name):
    path = public_tokenizers.path(name)
    library, encode = Tokenizer.from_file(path), tokens.Encoder(path)
    assert encode.by_word == encode.by_model == (name == "word_bpe_49k.json")
    r = random.Random(4)
    pieces = ["Hello", "world's", "don't", "12", "x2y", "é", "É", "ΣΑΣ", "İ", "<|endoftext|>", "<|EndOfText|>", "...", "a,b", "THE.", "end!?", "(word)", "'sword", "a<|", " ", "\x1c", "日本", "ﬁ", "it'", "'s", "\u0301", "ß", "x\u0301."]
    for _ in range(60):
        texts = ["".join(r.choice(pieces) + r.choice(["", " ", "  ", "\n", "\t", "\r\n"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 8))] + [None]
        ids, many = encode.texts(pa.array(["left out", *texts]).slice(1))
        assert len(many) == len(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(many)[:-1]), strict=True):
            assert own.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_id_files(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["b text", None, "", LONG, "b text", "é ü", "tail"]
    ids = [5, 3, 3, 9, 7, None, 2]
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int").repartition(3)
    got = tokens.read(tokens.write(docs, path)).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    want = {}
    for i, t in zip(ids, texts, strict=True):
        own = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert [r.doc_id for r in got] == [None, 2, 3, 3, 5, 7, 9]
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    assert tokens.read(tokens.write(docs.limit(0), path)).count() == 0


def test_warc_sql(spark, tmp_path):
    """The query and its SQL agree on nulls, equal payloads of both lengths, repeated ids and unsafe URLs."""
    import duckdb

    from palaver.llm import queries

    long, short = "<p>ü</p>" * 200, "<p>short</p>"
    rows = [(1, "http://a/", long), (2, "http://b/ c\r\n\x7fü%", long), (2, None, long), (None, "http://n/", long), (3, "", short), (4, "http://d/\t", short), (5, "u", None), (6, "u", ""), (None, "v", "<i>" * 500), (None, "w", "<i>" * 500), (-7, "x", "y" * 999), (8, "x", "y" * 1000), (-9, "x", "y" * 1000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for folder, path in ((str(tmp_path), f"{tmp_path}/pages.parquet/*.parquet"), ("/root/testdata/sf0.001", "/root/testdata/sf0.001/pages.parquet")):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}')")
        got = queries.QUERIES["op1_warc"](spark, folder)
        want = duck.execute(queries.ORACLE_SQL["op1_warc"])
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_kept_words_are_trimmed(monkeypatch):
    """Words met once are forgotten when too many are kept; ids stay the library's."""
    monkeypatch.setattr(tokens, "MEMO", 60)
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioustrné") for _ in range(r.randint(1, 8)))
    common = [word() for _ in range(20)]
    for _ in range(12):
        texts = [" ".join([*r.choices(common, k=30), word() + "!", "x9 日本", word()]) for _ in range(10)]
        ids, many = encode.texts(pa.array(texts))
        want = [encode.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and many.tolist() == [len(w) for w in want]
        assert len(encode.cores) <= 60 + 20 + 40
