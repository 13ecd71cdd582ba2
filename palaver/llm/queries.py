"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, html, lines, media, mixing, phrases, quality, secrets, shards, simhash, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint's arrays, and as the feature a digest of them."""
    found = media.analyse(media.store(table(spark, sf_dir, "documents")))
    arrays = [F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("times", "codes")]
    feature = F.concat(F.size("codes").cast("string"), F.lit(":"), F.sha1(F.concat_ws(";", *arrays)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "times", "codes")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that goes, and the earlier line that stays for it."""
    return lines.repeats(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding that the forest takes for a secret."""
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).where(F.col("score") >= secrets.MIN_SCORE)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak: doc_id, item_id and score."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score")


def op8_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return tokens.read(tokens.write(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their expected grade and tail probability."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("tail_probability") >= quality.MIN_TAIL)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings")).drop("label")


def vector_codes_sql(rounds: int = codes.ROUNDS) -> str:
    """A codebook row for each part and entry; each round compares all parts with all entries."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        "parts AS (SELECT vec_id, label, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS p FROM kept, range(16) AS r(part))",
        "first_ AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry FROM kept QUALIFY entry < 64)",
        "book0 AS (SELECT part, entry, p AS c FROM parts JOIN first_ USING (vec_id))",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"near{k} AS (SELECT vec_id, label, part, p, min({{'d': d, 'entry': entry}}) AS best FROM (SELECT vec_id, label, part, p, entry, {distance} AS d FROM parts JOIN book{k} USING (part)) GROUP BY ALL)")
        if k < rounds:
            each = f"SELECT part, best.entry AS entry, unnest(p) AS x, unnest(range(len(p))) AS place FROM near{k}"
            mean = "(sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*)"
            moved = f"SELECT part, entry, list(m ORDER BY place) AS c FROM (SELECT part, entry, place, {mean} AS m FROM ({each}) GROUP BY part, entry, place) GROUP BY part, entry"
            steps.append(f"book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN ({moved}) m ON m.part = b.part AND m.entry = b.entry)")
    digest = f"SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}"
    coded = f"SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, ({digest}) AS codebooks_sha256 FROM ({coded})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_mix_sources": op2_mix_sources,
    "op3_media": op3_media,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_html": op6_html,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_ids": op8_token_ids,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_shards": op12_shards,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH rows AS (
    SELECT page_id::BIGINT AS page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), equal AS (
    SELECT payload_digest, max(page_id) AS keeper FROM rows WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
), kept AS (
    SELECT rows.*, keeper, keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS revisit FROM rows LEFT JOIN equal USING (payload_digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN keeper END AS refers_to,
    CASE WHEN url IS NULL OR NOT regexp_matches(url, '[\\x00-\\x20\\x7f]') THEN url ELSE array_to_string(list_transform(range(1, length(url) + 1),
        lambda i: CASE WHEN unicode(substr(url, i, 1)) <= 32 OR unicode(substr(url, i, 1)) = 127 THEN printf('%%%02X', unicode(substr(url, i, 1))) ELSE substr(url, i, 1) END), '') END AS url
FROM kept""",
    "op11_phrases": """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM words, range(1, 4) AS s(size) WHERE len(w) >= size
), counts AS (
    SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 10
), cuts AS (
    SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM candidates, range(1, 3) AS c(k) WHERE k < size
), scored AS (
    SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
    SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE b.lang = s.lang AND b.size > s.size AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 50 * s.a)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_shards": """
WITH table_ AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), rows AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
), checked AS (
    SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM rows, table_
), summed AS (
    SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before FROM checked
), cut AS (
    SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM summed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut""",
    "op13_vector_codes": vector_codes_sql(),
}
