"""Phrases, shards and vector codes against brute force; nulls, ties, repeats, long texts, clashing names and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from palaver.llm import codes, phrases, shards
from palaver.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrases", "op12_shards", "op13_vector_codes"])
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    rows = lambda columns, found: sorted(repr([int(v) if isinstance(v, int) else v for v in (r[c] for c in columns)]) for r in found)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert sorted(names) == sorted(got.columns) and want
    assert rows(names, got.collect()) == rows(names, want)


# --- phrases ---
def brute_phrases(docs, max_n, least, share, top):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    out = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        if any(lang == other and len(q) > len(p) and f >= least and 100 * f >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), f in counts.items()):
            continue
        cut = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), a, cut[2], cut[3], totals[lang], cut[0]))
    return sorted((lang, i + 1, r[2].decode(), *r[3:]) for lang, rows in out.items() for i, r in enumerate(sorted(rows)[:top]))


DOCS = "lang string, text string, f int, phrase string, row long"


@pytest.mark.parametrize("max_n, least, share, top", [(3, 10, 50, 2000), (2, 3, 50, 20), (4, 3, 70, 15), (5, 2, 100, 2000)])
def test_phrases(spark, monkeypatch, max_n, least, share, top):
    monkeypatch.setattr(phrases, "PLACES", 37)
    monkeypatch.setattr(phrases, "BYTES", 200)
    r = random.Random(max_n)
    words = ["The", "cat", "É", "日本", "<a>", "x y", "sat", "on", "z" * 30, "é", "\U0001f600"]
    text = lambda n: "".join(r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "-", " "]) + r.choice(words[: r.choice([3, 6, 11])]) for _ in range(n))
    rows = [(r.choice(["en", "en", "en", "de", None, "und", ""]), r.choice([None, "", " \t ", "...", text(5), text(40), text(40), "the cat sat on the mat"]), 1, "p", 2) for _ in range(120)]
    rows += [("hot", "one two three four five", 1, "p", 2)] * 40 + [("en", "a b c " * 2000, 1, "p", 2)]
    got = phrases.collocations(spark.createDataFrame(rows, DOCS), max_n, least, share, top).collect()
    assert sorted(map(tuple, got)) == brute_phrases([(x[0], x[1]) for x in rows], max_n, least, share, top)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None, 1, "", 1), ("en", " .\n", 1, "", 1)], DOCS)).count() == 0


def test_scores_are_exact(spark):
    r = random.Random(5)
    rows = [(10**15 - 1,) * 3, (1, 1, 1)]
    for _ in range(200):
        left, right = (r.randrange(1, 10 ** r.randint(1, 15)) for _ in range(2))
        rows.append((r.randint(1, min(left, right)), left, right))
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"{phrases.SCORE} AS score").collect()
    assert [x.score for x in got] == [10**6 * a * a // (left * right) for a, left, right in rows]


def test_parts_that_share_bits_make_rows_but_no_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MASK", 7)  # nearly all bits are set
    rows = [("en", f"w{i % 7} v{i % 5} u{i % 3} t{i % 2}", 1, "", 1) for i in range(400)]
    got = phrases.collocations(spark.createDataFrame(rows, DOCS), 4, 20).collect()
    assert sorted(map(tuple, got)) == brute_phrases([(x[0], x[1]) for x in rows], 4, 20, 50, 2000)


# --- shards ---
def brute_shards(sized, n):
    """Shard of each row, of sizes in order."""
    total, before, out = sum(sized), 0, []
    for size in sized:
        out.append(min(n - 1, (2 * before + size) * n // (2 * total)))
        before += size
    return out


@pytest.mark.parametrize("n", [1, 8, 13])
def test_shards(spark, n):
    r = random.Random(n)
    text = lambda: r.choice([None, "", "é" * r.randint(0, 50), "w " * r.randint(0, 300), "copy"])
    rows = [(i * 3 - 40, text(), "s", 1, 7) for i in range(300)]
    rows += [(None, "no id", "s", 1, 7), (None, None, "s", 1, 7), (5, "equal ids", "s", 1, 7), (5, "of other texts", "s", 1, 7)]
    rows += [(77, "hot row " * 5, "s", 1, 7)] * 150
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, size int").repartition(7)
    out = shards.shard(docs, n).collect()
    assert len(out) == len(rows) and out[0].doc.asDict().keys() == {"doc_id", "text", "shard", "slot", "size"}
    for x in out:
        data = (x.doc.text or "").encode()
        assert (x.size, x.text_crc32, x.law) == (len(data) + 1, zlib.crc32(data), "bytes")
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x)
    order = [x for s in sorted(by) for x in sorted(by[s], key=lambda x: x.slot)]
    assert all(sorted(x.slot for x in rows_) == list(range(len(rows_))) for rows_ in by.values())
    ids = [(x.doc.doc_id is not None, x.doc.doc_id or 0) for x in order]
    assert ids == sorted(ids)  # contiguous
    assert [x.shard for x in order] == brute_shards([x.size for x in order], n)
    sums = [sum(x.size for x in by.get(s, [])) for s in range(n)]
    assert max(sums) - min(sums) <= 2 * max(x.size for x in out)


def test_shards_as_files(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9), "k") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    sharded = shards.shard(docs, 4)
    shards.write(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((x.doc_id, x.text, x.shard) for x in back.collect()) == sorted(rows)
    assert sorted((x.doc_id, x["_shard"], x.slot) for x in back.collect()) == sorted((x.doc.doc_id, x.shard, x.slot) for x in sharded.collect())


def test_shards_of_extremes(spark):
    schema = "doc_id long, text string"
    assert shards.shard(spark.createDataFrame([], schema)).count() == 0
    one = shards.shard(spark.createDataFrame([(1, "x" * 3_000_000), (2, "y"), (0, "z")], schema)).collect()
    assert [(x.doc.doc_id, x.shard, x.slot) for x in sorted(one, key=lambda x: (x.shard, x.slot))] == [(0, 0, 0), (1, 4, 0), (2, 7, 0)]


# --- vector codes ---
def brute_codes(rows, parts, entries, rounds):
    ok = [(i, label, [math.floor(x * 256) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, _, v in ok if len(v) % parts == 0)
    if not sizes:
        return []
    size = min(sizes, key=lambda s: (-sizes[s], s))
    ok = sorted((x for x in ok if len(x[2]) == size), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    step = size // parts
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, _, v in ok[:entries]), strict=True)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, c), i) for i, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, _, v in ok:
            for p, x in enumerate(cut(v)):
                held[p][near(p, x)[1]].append(x)
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else old for own, old in zip(held[p], books[p], strict=True)] for p in range(parts)]
    width = 2 if len(books[0]) <= 256 else 3  # as many digits as every index needs, two at least
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, label, "".join(f"{near(p, x)[1]:0{width}x}" for p, x in enumerate(cut(v))), min(sum(near(p, x)[0] for p, x in enumerate(cut(v))), 2**63 - 1)) for i, label, v in ok]
    by = Counter()
    for _, label, _, e in out:
        by[label] += e
    return [(*x, min(by[x[1]], 2**63 - 1), sha) for x in out]


VECTORS = "vec_id long, embedding array<double>, label int, v string, code int"


@pytest.mark.parametrize("parts, entries, rounds, places", [(16, 64, 2, 4), (4, 5, 3, 1), (2, 300, 1, 7)])
def test_codes(spark, parts, entries, rounds, places):
    r = random.Random(entries)
    vector = lambda: [r.choice([r.gauss(0, 1), r.choice([-0.5, 0.0, 0.25, -1 / 512, 1e-40, -1e-40])]) for _ in range(parts * places)]
    same = vector()
    rows = [(i * 2, vector(), r.choice([0, 0, 0, 1, None])) for i in range(350)] + [(None, vector(), 3), (11, same, 1), (11, same, 1), (11, vector(), 1)] + [(1000 + i, same, 0) for i in range(100)]
    rows += [(1, None, 0), (3, [], 0), (5, [*same[:-1], None], 0), (7, [*same[:-1], float("nan")], None), (9, [*same[:-1], float("-inf")], 0), (13, same[:-1], 0), (15, same * 2, 0)]
    r.shuffle(rows)
    got = codes.encode(spark.createDataFrame([(*x, "v", 1) for x in rows], VECTORS).repartition(5), parts, entries, rounds).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_codes(rows, parts, entries, rounds)))


def test_codes_of_few_and_of_none(spark):
    frame = lambda rows: codes.encode(spark.createDataFrame([(*x, "v", 1) for x in rows], VECTORS), 2, 4, 2).collect()
    assert frame([]) == [] and frame([(1, None, 1), (2, [float("inf")] * 4, 1), (3, [1.0] * 3, 1)]) == []
    assert [tuple(x)[:5] for x in frame([(4, [1.0, -1.0], None)])] == [(4, None, "0000", 0, 0)]


def test_codes_of_huge_numbers(spark):
    """Beyond 64 bits distances are exact in Python's numbers, and told as the largest long."""
    rows = [(i, [float(x) * 2.0 ** (4 * i) for x in (1, -1, 3, 5)], i % 2) for i in range(13)]
    got = codes.encode(spark.createDataFrame([(*x, "v", 1) for x in rows], VECTORS), 2, 3, 2).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_codes(rows, 2, 3, 2)))
    beyond = codes.encode(spark.createDataFrame([(1, [1e300, -1e300], 1, "", 1), (2, [0.0, 0.0], 1, "", 1), (3, [1.0, 2.0], 1, "", 1)], VECTORS), 1, 2, 1).collect()
    assert sorted(x.vec_id for x in beyond) == [1, 2, 3]


def test_nearest_drops_strictly_greater_only():
    r = np.random.default_rng(3)
    for k, d, high in itertools.product((1, 2, 17, 64), (1, 2, 5), (2, 50, 1 << 40)):
        x, book = r.integers(-high, high, (200, d)), r.integers(-high, high, (k, d))
        at, far = codes.nearest(x, book)
        every = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        assert [int(v) for v in far] == [int(v) for v in every.min(axis=1)] and at.tolist() == [row.index(min(row)) for row in every.tolist()]
