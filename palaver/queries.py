"""Driver queries for the conversation engine, and SQL for the same rows.

Conversations carry no noise of their own, so most queries run on an overlay that adds it by a rule; the rule is one SQL
expression that Spark and DuckDB share. ``documents`` serve as long conversations of one assistant each language.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import patterns as P
from palaver.functions import text as T
from palaver.operators import rules as R
from palaver.operators import turns as O
from palaver.plans import prune as plans
from palaver.sinks import outputs
from palaver.sources import transcripts
from palaver.streaming import sessions

VERBATIM = 2
NL = "chr(10)"
REPEATED = "The reviewed plan keeps every region and nation in the output and must not change the totals."
M = "((conv_id * 7 + turn) % 10)"
OVERLAY = f"""CASE WHEN role = 'assistant' THEN
  CASE {M} WHEN 0 THEN '<thinking>plan step</thinking>' || {NL} WHEN 1 THEN 'Certainly! Here is the plan.' || {NL} || {NL}
    WHEN 2 THEN 'Summarised the request' || {NL} || 'Summarised the request' || {NL} WHEN 3 THEN 'I understand.' || {NL} || {NL}
    WHEN 4 THEN 'Show more' || {NL} ELSE '' END
  || text || CASE WHEN {M} % 2 = 1 THEN {NL} || {NL} || '{REPEATED}' ELSE '' END
  || CASE {M} WHEN 5 THEN {NL} || {NL} || 'Let me know if anything is unclear.' WHEN 6 THEN {NL} || '<system-reminder>stay on task</system-reminder>'
    WHEN 8 THEN {NL} || {NL} || '```sql' || {NL} || 'SELECT 1' || {NL} || {NL} || 'FROM t' || {NL} || '```' || {NL} || {NL} || 'The result is set. You must run it again with the filter.' ELSE '' END
WHEN role = 'user' THEN
  CASE WHEN {M} IN (0, 2, 4) THEN 'Please continue with the same plan.'
    WHEN {M} IN (1, 3, 5) THEN text || {NL} || 'Never drop the header row of table ' || CAST(conv_id AS {{string}}) || '.'
    WHEN {M} = 6 THEN text || {NL} || 'Sorry, I meant the second region.' ELSE text END
ELSE text END"""
STORE = ("Never drop the header row of table 1.", "Always keep the header row of the table.", "Sorry, I meant the second region.", "Never use the old plan.")


# --- inputs ---
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", F.col("turn").cast("long").alias("pos"), F.col("turn").cast("long").alias("idx"), "role", F.col("text").alias("content"))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", F.col("turn").cast("long").alias("pos"), F.col("turn").cast("long").alias("idx"), "role", F.expr(OVERLAY.format(string="STRING")).alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("idx"), F.lit("assistant").alias("role"), F.col("text").alias("content"))


def known_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, i + 1) for i, r in enumerate(STORE)], "rule string, first_seen_seq long")


# --- SQL building blocks; every table has conv_id, pos, role, content ---
CONVERSATIONS_SQL = "SELECT conv_id, turn::BIGINT AS pos, role, text AS content FROM conversations"
OVERLAY_SQL = f"SELECT conv_id, turn::BIGINT AS pos, role, {OVERLAY.format(string='VARCHAR')} AS content FROM conversations"
DOCUMENTS_SQL = "SELECT lang AS conv_id, doc_id AS pos, 'assistant' AS role, text AS content FROM documents"


# --- the SQL's patterns, written for RE2 ---
WHITE = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
# fixed values, as the patterns of the engine hold them; tests with input and output by hand are what tells them right
S_THINKING = r"(?is)<thinking>.*?</thinking>|<think>.*?</think>"
S_TAGS = r"(?s)<system-reminder>.*?</system-reminder>|<local-command(-caveat|-stdout|-stderr)?>.*?</local-command(-caveat|-stdout|-stderr)?>|<command-(name|message|args)>.*?</command-(name|message|args)>"
S_OPENERS = (
    r"(?i)\A\s*(Of course|Certainly|Sure|Absolutely|Great( +question)?)[!,]?[ \t]+[^\n]*\n\n?",
    r"(?i)\A\s*(I'?('ll|'d)( be)? (happy|glad|delighted)( to)? (help|analyze|review|look at|work through)"
    r"|Let me (carefully |thoroughly |systematically )?(analyze|review|work through|look at|help|walk you through)"
    r"|I'?('ve)? (carefully |thoroughly )?(reviewed|analyzed|evaluated|gone through|looked at))[^\n]*\n\n?",
)
S_CLOSER = (
    r"(?im)\n+((Let|Please let) me know( if| what| how)|(Feel|Please feel) free to (ask|let me know|reach out|share)|(I )?hope this (helps?|(has been|was) helpful|gives?|provides?)"
    r"|I'?('m|'ll) (here|happy|available|glad)( to)? (help|assist|answer|make|revisit|adjust)|happy to (help|assist|elaborate|dive|explore|clarify|discuss|revisit|adjust)"
    r"|would you like (me to|to)|is there anything (else|more|other)|want me to)[^\n]*[.!?]?\s*$"
)
S_AGREED = r"(?i)\A\s*(Yes(,| -)? (you('re| are) right|absolutely|exactly|that('s| is) (correct|a good point|fair))|I( fully)? understand|That('s| is)( a)? (great|good|fair|excellent|valid)|You('re| are)( absolutely| totally)? right)[^\n]*\n\n?"
S_CORRECTION = r"(?i)\b(don'?t|do not|please don'?t|never|always|stop\s+\w+ing|from now on|remember to|remember that|make sure to|make sure you|you shouldn'?t|use .{1,30} instead)\b"
S_IMPLICIT = r"(?i)\b(actually[,.]|that's not right\b|that's incorrect\b|no[, ]+that's\b|wait[, ]+no\b|I meant\b|I said\b|sorry[, ]+but\b|actually[, ]+I\b)"
S_SIGNAL = r"(?i)\b(error|result|output|fixed|fix|note|warning|important|must|should|resolved|completed|configured|installed|returns?|raises?|set|use|run|add|remove|decided|conclusion)\b"


def duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def cut(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {duck(pattern)}, {by}, 'g')"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WHITE})"


def sql_tokens(x: str) -> str:
    return f"greatest(1, floor(length({x}) / 3.1::DOUBLE))::BIGINT"


def sql_ui(source: str) -> str:
    """Rows of ``source`` without doubled lines and labels; by runs of equal lines."""
    return f"""SELECT conv_id, pos, any_value(role) AS role, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE s <> 'Show more' AND k % 2 = 1), '') AS content
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, pos, run ORDER BY i) AS k
        FROM (SELECT *, sum(CASE WHEN s = prev AND s <> '' AND length(s) <= {P.DUPLICATE_LINE_LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, pos ORDER BY i) AS run
          FROM (SELECT *, lag(s) OVER (PARTITION BY conv_id, pos ORDER BY i) AS prev
            FROM (SELECT *, {sql_strip('line')} AS s
              FROM (SELECT conv_id, pos, role, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i FROM ({source})))))) GROUP BY conv_id, pos"""


def sql_clean(source: str) -> str:
    thinking = sql_strip(cut("content", S_THINKING))
    bare = f"SELECT conv_id, pos, role, {sql_strip(cut('c', S_TAGS))} AS content FROM (SELECT conv_id, pos, role, {thinking} AS c FROM ({source}))"
    return f"SELECT conv_id, pos, role, {sql_strip(cut('content', chr(10) + '{3,}', 'chr(10) || chr(10)'))} AS content FROM ({sql_ui(bare)})"


def sql_unless_empty(source: str, *patterns: str) -> str:
    new = "content"
    for p in patterns:
        new = cut(new, p)
    return f"SELECT conv_id, pos, role, CASE WHEN role = 'assistant' AND n <> '' THEN n ELSE content END AS content FROM (SELECT *, {sql_strip(new)} AS n FROM ({source}))"


def sql_boilerplate(source: str) -> str:
    return sql_unless_empty(source, *S_OPENERS, S_CLOSER)


def sql_ack(source: str) -> str:
    return sql_unless_empty(source, S_AGREED)


def sql_dedup(source: str) -> str:
    return f"SELECT conv_id, pos, role, content FROM ({source}) QUALIFY row_number() OVER (PARTITION BY conv_id, md5(substring(content, 1, {P.HASH_PREFIX})) ORDER BY pos DESC) = 1"


def sql_chunks(source: str) -> str:
    marked = r"regexp_replace(content, '([.!?])(\s+)([A-Z])|(\n{2,})', '\1' || chr(1) || '\2\4' || chr(1) || '\3', 'g')"
    return f"SELECT conv_id, pos, role, unnest(string_split({marked}, chr(1))) AS chunk, unnest(range(len(string_split({marked}, chr(1))))) AS part FROM ({source})"


def sql_collapse(source: str) -> str:
    key = f"regexp_replace({sql_strip('chunk')}, '\\s+', ' ', 'g')"
    marker = rf"""regexp_extract(chunk, '\A\s*') || '[Repeated, unchanged: "' || regexp_replace(substring(key, 1, 50), '\s+\z', '') || '..."]' || regexp_extract(chunk, '\s*\z')"""
    return f"""SELECT conv_id, pos, any_value(role) AS role, string_agg(CASE WHEN part % 2 = 0 AND length(key) >= {P.COLLAPSE_LENGTH} AND role = 'assistant' AND k > 1 THEN {marker} ELSE chunk END, '' ORDER BY part) AS content
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'assistant', part % 2, key ORDER BY pos, part) AS k FROM (SELECT *, {key} AS key FROM ({sql_chunks(source)}))) GROUP BY conv_id, pos"""


def sql_flagged(source: str, verbatim: int = VERBATIM) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= {verbatim} AS is_recent FROM ({source})"


def sql_prune(source: str, prescription: str) -> str:
    old = sql_boilerplate(sql_clean(f"SELECT conv_id, pos, role, content FROM ({sql_flagged(source)}) WHERE NOT is_recent"))
    if prescription != "gentle":
        old = sql_collapse(sql_dedup(sql_ack(old)))
    if prescription == "aggressive":
        old = sql_compress(old)
    recent = sql_clean(f"SELECT conv_id, pos, role, content FROM ({sql_flagged(source)}) WHERE is_recent")
    return f"SELECT conv_id, pos, role, content FROM ({old}) WHERE regexp_matches(content, '\\S') UNION ALL SELECT conv_id, pos, role, content FROM ({recent}) WHERE regexp_matches(content, '\\S')"


def sql_compress(source: str) -> str:
    """First paragraph, paragraphs with a fence, and up to four telling sentences of each other one; step by step."""
    code = r"'```[\s\S]*?```|`[^`\n]+`'"
    restored = lambda x: f"array_to_string(list_transform(string_split({x}, chr(1)), lambda y, j: CASE WHEN j = 1 THEN y ELSE blocks[split_part(y, chr(2), 1)::INT + 1] || substring(y, strpos(y, chr(2)) + 1) END), '')"
    sentences = f"list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3)), lambda x: {sql_strip('x')})"
    telling = f"list_transform(list_filter({sentences}, lambda x: length(x) >= 20 AND regexp_matches(x, {duck(S_SIGNAL)}))[1:4], lambda x: '- ' || x)"
    held = sql_strip(cut(sql_strip(cut("numbered", S_THINKING)), S_TAGS))
    short = "array_to_string(flatten(list_transform(parts, lambda p, i: CASE WHEN i = 1 OR contains(p, '```') THEN [p] ELSE " + telling + " END)), chr(10) || chr(10))"
    return f"""SELECT conv_id, pos, role, CASE WHEN len(parts) <= 2 THEN {sql_strip(restored('held'))} WHEN {sql_tokens('content')} > floor(length(short) / 3.1::DOUBLE) + 30
        THEN '[~' || {sql_tokens('content')} || 'to' || floor(length(short) / 3.1::DOUBLE)::BIGINT || 't]' || chr(10) || short ELSE short END AS content
      FROM (SELECT *, {short} AS short FROM (SELECT *, list_transform(list_filter(list_transform(string_split_regex(held, '\\n{{2,}}'), lambda x: {sql_strip('x')}), lambda x: x <> ''), lambda x: {restored('x')}) AS parts
        FROM (SELECT *, {held} AS held FROM (SELECT *, array_to_string(list_transform(string_split_regex(content, {code}), lambda x, i: CASE WHEN i = 1 THEN x ELSE chr(1) || (i - 2) || chr(2) || x END), '') AS numbered,
          regexp_extract_all(content, {code}) AS blocks FROM ({source})))))"""


def sql_sentences(source: str) -> str:
    split = "string_split(replace(replace(content, '.', '.' || chr(1)), chr(10), chr(1)), chr(1))"
    closing = "'\\A[" + re.escape(P.CLOSERS).replace("'", "''") + "]{0,5}'"
    sentence = sql_strip(f"CASE WHEN unit LIKE '%.' THEN unit || regexp_extract(coalesce(following, ''), {closing}) ELSE unit END")
    return f"""SELECT conv_id, pos, kind, unit_no, {sentence} AS rule FROM (
      SELECT *, CASE WHEN regexp_matches(unit, {duck(S_CORRECTION)}) THEN 0 WHEN regexp_matches(unit, {duck(S_IMPLICIT)}) THEN 1 END AS kind, lead(unit) OVER (PARTITION BY conv_id, pos ORDER BY unit_no) AS following
      FROM (SELECT conv_id, pos, unnest({split}) AS unit, unnest(range(len({split}))) AS unit_no FROM ({source}) WHERE role = 'user')) WHERE kind IS NOT NULL"""


def sql_rules(source: str, most: int = P.MAX_RULES) -> str:
    key = f"regexp_replace({sql_strip('lower(rule)')}, '\\s+', ' ', 'g')"
    return f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, kind, unit_no)::BIGINT AS rule_pos, rule, rule_key FROM (
      SELECT *, {key} AS rule_key FROM ({sql_sentences(source)}) WHERE length(rule) BETWEEN {P.MIN_RULE_LENGTH} AND {P.MAX_RULE_LENGTH}
      QUALIFY row_number() OVER (PARTITION BY conv_id, {key} ORDER BY pos, kind, unit_no) = 1) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos, kind, unit_no) <= {most}"""


def sql_pct(before: str, after: str) -> str:
    return f"CASE WHEN {before} > 0 THEN round(({before} - {after})::DOUBLE / {before} * 100, 1) ELSE 0.0 END"


def sql_stats(source: str, prescription: str) -> str:
    return f"""SELECT b.conv_id, '{prescription}' AS prescription, b.n AS orig_turns, coalesce(a.n, 0)::BIGINT AS final_turns, b.t AS orig_tokens, coalesce(a.t, 0)::BIGINT AS final_tokens,
      (b.t - coalesce(a.t, 0))::BIGINT AS saved_tokens, {sql_pct('b.t', 'coalesce(a.t, 0)')} AS saved_pct, least({VERBATIM}, b.n)::BIGINT AS verbatim, coalesce(r.n, 0)::BIGINT AS rules_found
    FROM (SELECT conv_id, count(*)::BIGINT AS n, sum({sql_tokens('content')})::BIGINT AS t FROM ({source}) GROUP BY conv_id) b
    LEFT JOIN (SELECT conv_id, count(*)::BIGINT AS n, sum({sql_tokens('content')})::BIGINT AS t FROM ({sql_prune(source, prescription)}) GROUP BY conv_id) a ON a.conv_id = b.conv_id
    LEFT JOIN (SELECT conv_id, count(*)::BIGINT AS n FROM ({sql_rules(source)}) GROUP BY conv_id) r ON r.conv_id = b.conv_id"""


def sql_savings(source: str) -> str:
    each = " UNION ALL ".join(f"SELECT prescription, sum(orig_tokens)::BIGINT AS orig_tokens, sum(saved_tokens)::BIGINT AS saved_tokens FROM ({sql_stats(source, p)}) GROUP BY prescription" for p in P.PRESCRIPTIONS)
    return f"SELECT *, {sql_pct('orig_tokens', '(orig_tokens - saved_tokens)')} AS saved_pct FROM ({each})"


def sql_diagnosis(source: str) -> str:
    tokens = sql_tokens("content")
    base = f"""SELECT conv_id, count(*) AS n_turns, sum(length(content))::BIGINT AS n_chars, sum({tokens})::BIGINT AS n_tokens, count(*) FILTER (WHERE regexp_matches(content, {duck(S_THINKING)})) AS thinking,
      count(*) FILTER (WHERE regexp_matches(content, {duck(S_TAGS)})) AS tags FROM ({source}) GROUP BY conv_id"""
    doubled = f"SELECT conv_id, count(*) FILTER (WHERE n > 1) AS n FROM (SELECT conv_id, substring(content, 1, 2000) AS c, count(*) AS n FROM ({source}) GROUP BY ALL) GROUP BY conv_id"
    top = f"""SELECT conv_id, string_agg('  ' || repeat('#', least(24, t // 200)) || printf(' Turn %3d (%-9s): ~%s tokens', pos, role, format('{{:,}}', t)), chr(10) ORDER BY t DESC, pos) AS lines
      FROM (SELECT conv_id, pos, role, {tokens} AS t FROM ({source}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {tokens} DESC, pos) <= 5) GROUP BY conv_id"""
    saved = " || chr(10) || ".join(f"rpad('  {p}', 14, ' ') || ' ~' || format('{{:,}}', {p[0]}.saved_tokens) || ' tokens saved (' || {p[0]}.saved_pct || '%)'" for p in P.PRESCRIPTIONS)
    line = lambda name, value: f"rpad('{name}', 20, ' ') || {value}"
    lines = [
        line("Turns:", "n_turns"), line("Characters:", "format('{:,}', n_chars)"), line("Tokens (est.):", "format('{:,}', n_tokens)"), line("Context fill:", "printf('%.1f%%', n_tokens / 200000::DOUBLE * 100)"), "''", "'Noise detected:'",
        line("  Thinking blocks:", "thinking"), line("  Tagged turns:", "tags"), line("  Duplicate turns:", "d.n"), line("  Correction rules:", "s.rules_found"), "''", "'Largest turns:'", "lines", "''", "'Estimated savings:'", saved,
    ]
    joins = " ".join(f"JOIN ({sql_stats(source, p)}) {p[0]} ON {p[0]}.conv_id = b.conv_id" for p in P.PRESCRIPTIONS)
    return f"SELECT b.conv_id, {' || chr(10) || '.join(lines)} AS report FROM ({base}) b JOIN ({doubled}) d ON d.conv_id = b.conv_id JOIN ({top}) t ON t.conv_id = b.conv_id {joins}"


def sql_briefing(source: str, prescription: str = "aggressive") -> str:
    history = f"SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**User**' ELSE '**Assistant**' END || ': ' || content, chr(10) || chr(10) ORDER BY pos) AS history FROM ({sql_prune(source, prescription)}) GROUP BY conv_id"
    rules = f"SELECT conv_id, string_agg('- ' || rule, chr(10) ORDER BY rule_pos) AS rules FROM ({sql_rules(source)}) GROUP BY conv_id"
    lines = [
        "'# CONVERSATION BRIEFING'", "''", "'*Original: ' || orig_turns || ' turns, ~' || format('{:,}', orig_tokens) || ' tokens*'", "'*Compressed: ' || final_turns || ' turns, ~' || format('{:,}', final_tokens) || ' tokens*'",
        "'*Saved: ' || saved_pct || '% | Last ' || verbatim || ' turns verbatim*'", "CASE WHEN rules_found >= 24 THEN '**WARNING:** ' || rules_found || ' of 30 rules are in use.' END", "''",
        "'> **How to use**: paste this document as the first message of a new conversation.'", "''",
        "CASE WHEN rules IS NOT NULL THEN concat_ws(chr(10), '---', '', '## BEHAVIORAL RULES', '*Stated by the user in the original conversation; they hold from here on.*', '', rules, '') END", "'---'", "''", "'## CONVERSATION HISTORY'", "''", "coalesce(history, '')",
    ]
    return f"SELECT s.conv_id, concat_ws(chr(10), {', '.join(lines)}) AS document FROM ({sql_stats(source, prescription)}) s LEFT JOIN ({history}) h ON h.conv_id = s.conv_id LEFT JOIN ({rules}) r ON r.conv_id = s.conv_id"


STORE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i + 1})" for i, r in enumerate(STORE)) + ") AS s(rule, first_seen_seq)"
BIGRAMS = r"list_distinct(list_transform(range(1, len(regexp_extract_all(lower({0}), '\w+'))), lambda i: regexp_extract_all(lower({0}), '\w+')[i] || ' ' || regexp_extract_all(lower({0}), '\w+')[i + 1]))"
NEAR_SQL = f"""SELECT new_rule, rule, round(overlap, 2) AS overlap FROM (SELECT a.rule AS new_rule, b.rule AS rule, len(list_intersect(a.b, b.b))::DOUBLE / greatest(len(a.b), len(b.b)) AS overlap
  FROM (SELECT rule, {BIGRAMS.format('rule')} AS b FROM (SELECT DISTINCT rule FROM ({sql_rules(OVERLAY_SQL)}))) a JOIN (SELECT rule, {BIGRAMS.format('rule')} AS b FROM ({STORE_SQL})) b ON a.rule <> b.rule) WHERE overlap >= {P.NEAR_DUPLICATE}"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


KEEP = ("conv_id", "pos", "role", "content")


@query(f"SELECT conv_id, pos, {sql_tokens('content')} AS tokens FROM ({CONVERSATIONS_SQL})")
def token_estimate_per_turn(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "pos", T.tokens(F.col("content")).alias("tokens"))


@query(f"SELECT conv_id, count(*)::BIGINT AS n_turns, sum(length(content))::BIGINT AS n_chars, sum({sql_tokens('content')})::BIGINT AS n_tokens, (sum({sql_tokens('content')})::DOUBLE / 200000 * 100)::DOUBLE AS context_pct FROM ({CONVERSATIONS_SQL}) GROUP BY conv_id")
def conversation_summary(spark, sf_dir):
    return O.conversation_summary(conversations(spark, sf_dir))


LABEL = "CASE turn % 5 WHEN 0 THEN ' Human ' WHEN 1 THEN 'Claude Sonnet 4.6' WHEN 2 THEN 'AI' WHEN 3 THEN 'You' ELSE 'tool' END"


@query(f"SELECT conv_id, turn::BIGINT AS pos, role FROM (SELECT conv_id, turn, CASE WHEN l LIKE 'claude%' OR l IN ('assistant', 'ai') THEN 'assistant' WHEN l IN ('human', 'user', 'you') THEN 'user' ELSE l END AS role FROM (SELECT *, lower(trim({LABEL})) AS l FROM conversations)) WHERE role IN ('user', 'assistant', 'system')")
def role_filter_normalize(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", F.col("turn").cast("long").alias("pos"), T.normal_role(F.expr(LABEL)).alias("role")).where(F.col("role").isin("user", "assistant", "system"))


@query(f"SELECT conv_id, pos, role, {sql_strip(cut('content', S_THINKING))} AS content FROM ({OVERLAY_SQL})")
def strip_thinking(spark, sf_dir):
    return overlay(spark, sf_dir).withColumn("content", T.strip_thinking(F.col("content"))).select(*KEEP)


@query(f"SELECT conv_id, pos, role, {sql_strip(cut('content', S_TAGS))} AS content FROM ({OVERLAY_SQL})")
def strip_tags(spark, sf_dir):
    return overlay(spark, sf_dir).withColumn("content", T.strip_tags(F.col("content"))).select(*KEEP)


@query(f"SELECT conv_id, pos, {sql_strip(cut('replace(content, chr(32), chr(10))', chr(10) + '{3,}', 'chr(10) || chr(10)'))} AS content FROM ({OVERLAY_SQL})")
def collapse_blank_lines(spark, sf_dir):
    spaced = F.replace(F.col("content"), F.lit(" "), F.lit("\n"))
    return overlay(spark, sf_dir).select("conv_id", "pos", T.collapse_blank_lines(spaced).alias("content"))


@query(f"SELECT conv_id, pos, role, content FROM ({sql_ui(OVERLAY_SQL)})")
def ui_artifacts(spark, sf_dir):
    return overlay(spark, sf_dir).withColumn("content", T.strip_ui_artifacts(F.col("content"))).select(*KEEP)


@query(f"SELECT pos AS doc_id, content FROM ({sql_ui(DOCUMENTS_SQL)})")
def ui_artifacts_documents(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("pos").alias("doc_id"), T.strip_ui_artifacts(F.col("content")).alias("content"))


@query(sql_clean(OVERLAY_SQL))
def clean_turns(spark, sf_dir):
    return overlay(spark, sf_dir).withColumn("content", T.clean(F.col("content"))).select(*KEEP)


@query(sql_boilerplate(sql_clean(OVERLAY_SQL)))
def strip_boilerplate(spark, sf_dir):
    c = T.clean(F.col("content"))
    rows = overlay(spark, sf_dir).withColumn("content", c)
    return rows.withColumn("content", T.unless_empty(F.col("role"), F.col("content"), T.strip_boilerplate)).select(*KEEP)


@query(sql_ack(sql_clean(OVERLAY_SQL)))
def strip_ack(spark, sf_dir):
    rows = overlay(spark, sf_dir).withColumn("content", T.clean(F.col("content")))
    return rows.withColumn("content", T.unless_empty(F.col("role"), F.col("content"), T.strip_acknowledgement)).select(*KEEP)


@query(f"SELECT conv_id, count(*) FILTER (WHERE regexp_matches(content, {duck(S_THINKING)}))::BIGINT AS thinking_turns, count(*) FILTER (WHERE regexp_matches(content, {duck(S_TAGS)}))::BIGINT AS tag_turns FROM ({OVERLAY_SQL}) GROUP BY conv_id")
def noise_counts(spark, sf_dir):
    return O.noise_counts(overlay(spark, sf_dir))


@query(f"SELECT conv_id, count(*) FILTER (WHERE n > 1)::BIGINT AS duplicate_groups FROM (SELECT conv_id, md5(substring(content, 1, 2000)) AS h, count(*) AS n FROM ({DOCUMENTS_SQL}) GROUP BY ALL) GROUP BY conv_id")
def duplicate_groups(spark, sf_dir):
    return O.duplicate_groups(documents(spark, sf_dir))


@query(f"SELECT conv_id, pos, content FROM ({sql_dedup(DOCUMENTS_SQL)})")
def dedup_keep_last(spark, sf_dir):
    return O.dedup_keep_last(documents(spark, sf_dir)).select("conv_id", "pos", "content")


@query(f"SELECT conv_id, pos, is_recent FROM ({sql_flagged(CONVERSATIONS_SQL)})")
def recent_split(spark, sf_dir):
    return O.flag_recent(conversations(spark, sf_dir), VERBATIM).select("conv_id", "pos", "is_recent")


@query(f"SELECT conv_id, pos, role, tokens, rank FROM (SELECT conv_id, pos, role, {sql_tokens('content')} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY {sql_tokens('content')} DESC, pos)::INTEGER AS rank FROM ({CONVERSATIONS_SQL})) WHERE rank <= 5")
def top5_turns(spark, sf_dir):
    return O.largest_turns(conversations(spark, sf_dir)).select("conv_id", "pos", "role", "tokens", "rank")


@query(f"SELECT pos AS doc_id, part::BIGINT AS part, chunk FROM ({sql_chunks(DOCUMENTS_SQL)})")
def chunk_split(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("pos").alias("doc_id"), F.posexplode(T.chunks(F.col("content"))).alias("part", "chunk")).withColumn("part", F.col("part").cast("long"))


@query(f"SELECT conv_id, pos, role, content FROM ({sql_collapse(OVERLAY_SQL)})")
def collapse_repeats(spark, sf_dir):
    return O.collapse_repeats(overlay(spark, sf_dir)).select(*KEEP)


@query(f"SELECT conv_id, pos, content FROM ({sql_collapse(DOCUMENTS_SQL)})")
def collapse_repeats_documents(spark, sf_dir):
    return O.collapse_repeats(documents(spark, sf_dir)).select("conv_id", "pos", "content")


@query(f"SELECT conv_id, pos, kind, unit_no::INTEGER AS unit_no, rule FROM ({sql_sentences(OVERLAY_SQL)})")
def rule_sentences(spark, sf_dir):
    return R.rule_sentences(overlay(spark, sf_dir))


@query(sql_rules(OVERLAY_SQL))
def extract_rules(spark, sf_dir):
    return R.extract_rules(overlay(spark, sf_dir)).withColumn("rule_pos", F.col("rule_pos").cast("long"))


TERMS = ("same plan", "header row", "second region")


@query(f"""WITH users AS (SELECT conv_id, pos, content, CASE WHEN lower(content) LIKE '%same plan%' THEN 'same plan' WHEN lower(content) LIKE '%header row%' THEN 'header row' WHEN lower(content) LIKE '%second region%' THEN 'second region' END AS term FROM ({OVERLAY_SQL}) WHERE role = 'user'),
  pieces AS (SELECT conv_id, pos, term, {sql_strip("list_filter(string_split(content, '.'), lambda s: contains(lower(s), term) AND length(s) > 30)[1]")} || '.' AS rule FROM users WHERE term IS NOT NULL),
  firsts AS (SELECT * FROM pieces WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, term ORDER BY pos) = 1), rules AS ({sql_rules(OVERLAY_SQL)})
  SELECT conv_id, rule FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.conv_id = f.conv_id AND contains(lower(r.rule), f.term))""")
def protected_rules(spark, sf_dir):
    turns = overlay(spark, sf_dir)
    return R.forced_rules(turns, R.extract_rules(turns), TERMS)


@query(f"SELECT DISTINCT rule FROM ({sql_rules(OVERLAY_SQL)}) WHERE rule NOT IN (SELECT rule FROM ({STORE_SQL}))")
def rule_merge_anti(spark, sf_dir):
    return R.new_rules(R.extract_rules(overlay(spark, sf_dir)), known_rules(spark))


@query(f"""SELECT rule, row_number() OVER (ORDER BY seq, rule)::BIGINT AS first_seen_seq FROM (SELECT rule, min(seq) AS seq FROM (SELECT rule, first_seen_seq AS seq FROM ({STORE_SQL})
  UNION ALL SELECT rule, conv_id * 100 + rule_pos + 1099511627776 FROM ({sql_rules(OVERLAY_SQL)})) GROUP BY rule) QUALIFY row_number() OVER (ORDER BY seq, rule) <= {P.STORE_RULES}""")
def rule_store_merge(spark, sf_dir):
    rules = R.extract_rules(overlay(spark, sf_dir)).select("rule", (F.col("conv_id") * 100 + F.col("rule_pos")).alias("seq"))
    return R.merge_rules(rules, known_rules(spark))


@query(NEAR_SQL)
def rule_near_dups(spark, sf_dir):
    return R.near_duplicates(R.extract_rules(overlay(spark, sf_dir)), known_rules(spark))


@query(f"SELECT substring(new_rule, 1, 80) AS new_rule, n, substring(rule, 1, 80) AS rule, overlap FROM (SELECT *, row_number() OVER (PARTITION BY new_rule ORDER BY overlap DESC, rule)::BIGINT AS n FROM ({NEAR_SQL})) WHERE n <= 3")
def review_flags(spark, sf_dir):
    flags = R.review_flags(rule_near_dups(spark, sf_dir))
    each = flags.select("new_rule", F.posexplode("near_duplicates").alias("n", "f"))
    return each.select("new_rule", (F.col("n") + 1).cast("long").alias("n"), "f.rule", "f.overlap")


@query(f"SELECT count(*)::BIGINT AS n_rules, round(count(*)::DOUBLE / {P.STORE_RULES} * 100, 1) AS capacity_pct, CASE WHEN count(*) >= {P.STORE_RULES} THEN 'FULL' WHEN count(*) >= {int(P.STORE_RULES * 0.8)} THEN 'APPROACHING' ELSE 'OK' END AS status FROM (SELECT DISTINCT rule FROM ({sql_rules(OVERLAY_SQL)}))")
def rules_status(spark, sf_dir):
    return R.rules_status(R.extract_rules(overlay(spark, sf_dir)).select("rule").distinct())


@query(sql_compress(sql_clean(OVERLAY_SQL)))
def compress_turns(spark, sf_dir):
    return overlay(spark, sf_dir).withColumn("content", T.compress(T.clean(F.col("content")))).select(*KEEP)


@query(sql_stats(OVERLAY_SQL, "gentle"))
def prune_gentle_stats(spark, sf_dir):
    return plans.prune_stats(overlay(spark, sf_dir), VERBATIM, "gentle")


@query(sql_stats(OVERLAY_SQL, "standard"))
def prune_standard_stats(spark, sf_dir):
    return plans.prune_stats(overlay(spark, sf_dir), VERBATIM, "standard")


@query(sql_prune(OVERLAY_SQL, "standard"))
def prune_standard_turns(spark, sf_dir):
    return plans.prune(overlay(spark, sf_dir), VERBATIM, "standard").select(*KEEP)


@query(sql_stats(OVERLAY_SQL, "aggressive"))
def prune_aggressive_stats(spark, sf_dir):
    return plans.prune_stats(overlay(spark, sf_dir), VERBATIM, "aggressive")


@query(sql_savings(OVERLAY_SQL))
def savings_by_prescription(spark, sf_dir):
    return plans.savings(overlay(spark, sf_dir), VERBATIM)


@query(sql_diagnosis(OVERLAY_SQL))
def diagnose(spark, sf_dir):
    return plans.diagnosis_text(overlay(spark, sf_dir), VERBATIM)


@query(sql_briefing(OVERLAY_SQL))
def briefing_document(spark, sf_dir):
    return plans.briefing(overlay(spark, sf_dir), VERBATIM)


def rendered(turns: DataFrame, line) -> DataFrame:
    """conv_id and value: a conversation's turns as one text."""
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("t"))
    return lines.select("conv_id", line(F.col("t")).alias("value"))


TALK = f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::BIGINT AS pos, role, {sql_strip('content')} AS content FROM ({CONVERSATIONS_SQL}) WHERE role <> 'system' AND regexp_matches(content, '\\S')"


@query(f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::BIGINT AS pos, role, content || chr(10) || '<thinking>why</thinking>' AS content FROM ({CONVERSATIONS_SQL})")
def parse_json_blocks(spark, sf_dir):
    blocks = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("thinking")), F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("why").alias("thinking")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("thinking")))
    message = lambda t: F.struct(t["role"].alias("role"), blocks(t["content"]).alias("content"))
    raw = rendered(conversations(spark, sf_dir), lambda t: F.to_json(F.struct(F.transform(t, message).alias("messages"))))
    return transcripts.parse(raw).select(*KEEP)


@query(f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::BIGINT AS pos, role, content FROM ({CONVERSATIONS_SQL}) WHERE role <> 'system'")
def parse_jsonl(spark, sf_dir):
    line = lambda t: F.to_json(F.struct(t["role"].alias("type"), F.struct(t["content"].alias("content")).alias("message")))
    raw = rendered(conversations(spark, sf_dir), lambda t: F.array_join(F.transform(t, line), "\nnot json\n"))
    return transcripts.parse(raw).select(*KEEP)


@query(TALK)
def parse_colon_labels(spark, sf_dir):
    label = lambda t: F.concat(F.when(t["role"] == "user", "**User**: ").otherwise("[2:30 PM] Claude Sonnet 4.6: "), t["content"])
    raw = rendered(conversations(spark, sf_dir).where("role != 'system'"), lambda t: F.array_join(F.transform(t, label), "\n\n"))
    return transcripts.parse(raw).select(*KEEP)


@query(TALK)
def parse_solo_labels(spark, sf_dir):
    label = lambda t: F.concat(F.when(t["role"] == "user", "You\n").otherwise("Claude\n"), t["content"])
    raw = rendered(conversations(spark, sf_dir).where("role != 'system'"), lambda t: F.array_join(F.transform(t, label), "\n"))
    return transcripts.parse(raw).select(*KEEP)


@query(f"""SELECT conv_id, pos, CASE WHEN pos = 0 OR n = 1 OR regexp_matches(content, '(?i)\\A(?:\\?|I need|Can you|Please|I want)') OR regexp_matches(lower(substring(content, 1, 100)), ' i |i''m|i''ve|i''ll|can you|please|\\?') THEN 'user' ELSE 'assistant' END AS role, content
  FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM ({TALK}))""")
def parse_date_lines(spark, sf_dir):
    raw = rendered(conversations(spark, sf_dir).where("role != 'system'"), lambda t: F.array_join(F.transform(t, lambda x: x["content"]), "\nMay 16\n"))
    return transcripts.parse(raw).select(*KEEP)


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY c, pos) - 1)::BIGINT AS pos, role, content FROM (
  SELECT conv_id % 5 AS conv_id, conv_id AS c, turn AS pos, role, text AS content FROM conversations WHERE role <> 'system' AND regexp_matches(text, '\\S'))""")
def parse_log_lines(spark, sf_dir):
    """Session logs of many conversations each, read by lines whatever their size."""
    rows = conversations(spark, sf_dir).withColumn("c", F.col("conv_id"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("content")).alias("message"))).alias("value")
    path = outputs.scratch(spark, "logs")
    logs = rows.select((F.col("conv_id") % 5).alias("log"), "c", "pos", line).repartition("log").sortWithinPartitions("log", "c", "pos")
    logs.select("log", "value").write.partitionBy("log").text(path)
    turns = transcripts.log_turns(transcripts.read_lines(spark, path))
    return turns.select(F.regexp_extract("conv_id", "log=([^/]+)", 1).cast("long").alias("conv_id"), "pos", "role", "content")


@query(f"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::BIGINT AS pos, role, 'top' || chr(10) || '[result: ' || substring(
  'a' || chr(10) || '[result: b' || chr(10) || '[result: [result: [result: ' || content || chr(10) || 'z' || ']]]]', 1, 300) || ']' AS content FROM ({CONVERSATIONS_SQL})""")
def parse_nested_results(spark, sf_dir):
    """Results five deep."""
    quoted = lambda c: F.to_json(F.array(c))
    text = lambda c: F.concat(F.lit('{"type":"text","text":'), F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2), F.lit("}"))
    result = lambda *blocks: F.concat(F.lit('{"type":"tool_result","content":['), F.concat_ws(",", *blocks), F.lit("]}"))
    nested = lambda c: result(text(F.lit("a")), result(text(F.lit("b")), result(result(result(text(c), text(F.lit("")), text(F.lit("z")))))))
    message = lambda t: F.concat(F.lit('{"role":"'), t["role"], F.lit('","content":['), text(F.lit("top")), F.lit(","), nested(t["content"]), F.lit("]}"))
    raw = rendered(conversations(spark, sf_dir), lambda t: F.concat(F.lit("["), F.array_join(F.transform(t, message), ","), F.lit("]")))
    return transcripts.parse(raw).select(*KEEP)


@query("""SELECT conv_id, reason, count(*)::BIGINT AS n, min(idx)::BIGINT AS first_idx FROM (
  SELECT conv_id, turn AS idx, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no message' WHEN 2 THEN 'other role' ELSE 'blank' END AS reason FROM conversations
  UNION ALL SELECT conv_id, NULL, 'no turns' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE turn % 4 = 0) = 0) GROUP BY ALL""")
def parse_outcomes(spark, sf_dir):
    """Turns and rejects, counted by reason."""
    message = lambda t: F.when(t["pos"] % 4 == 1, F.lit("7")).otherwise(F.to_json(F.struct(F.when(t["pos"] % 4 == 2, "tool").otherwise(t["role"]).alias("role"), F.when(t["pos"] % 4 == 3, " ").otherwise(t["content"]).alias("content"))))
    raw = rendered(conversations(spark, sf_dir), lambda t: F.concat(F.lit("["), F.array_join(F.transform(t, message), ","), F.lit("]")))
    return transcripts.outcomes(raw).groupBy("conv_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))


@query(sql_prune(OVERLAY_SQL, "standard"))
def written_output(spark, sf_dir):
    """A result that replaced another one as a whole."""
    path, turns = outputs.scratch(spark, "output"), overlay(spark, sf_dir)
    for prescription in ("gentle", "standard"):
        outputs.write_output(plans.prune(turns, VERBATIM, prescription).select(*KEEP), path)
    return outputs.read_output(spark, path)


PART_CHARS = 100_000


def sql_briefing_parts(source: str, prescription: str, most: int) -> str:
    blocks = f"SELECT conv_id, pos // 64 AS block, sum(length(content)) AS n FROM ({source}) GROUP BY ALL"
    parts = f"SELECT conv_id, block, ((sum(n) OVER (PARTITION BY conv_id ORDER BY block) - n) // {most})::BIGINT AS part FROM ({blocks})"
    texts = f"SELECT p.conv_id, p.part, string_agg(CASE WHEN role = 'user' THEN '**User**' ELSE '**Assistant**' END || ': ' || content, chr(10) || chr(10) ORDER BY pos) AS text FROM ({sql_prune(source, prescription)}) t JOIN ({parts}) p ON p.conv_id = t.conv_id AND p.block = t.pos // 64 GROUP BY ALL"
    heads = f"SELECT conv_id, 0::BIGINT AS part, substring(document, 1, strpos(document, '## CONVERSATION HISTORY') + 24) AS text FROM ({sql_briefing(source, prescription)})"
    return f"{heads} UNION ALL SELECT conv_id, part + 1, CASE WHEN part > min(part) OVER (PARTITION BY conv_id) THEN chr(10) || chr(10) ELSE '' END || text FROM ({texts})"


@query(sql_briefing_parts(DOCUMENTS_SQL, "standard", PART_CHARS))
def briefing_parts(spark, sf_dir):
    """Briefings of long conversations, in parts."""
    path = outputs.scratch(spark, "briefings")
    plans.write_briefings(documents(spark, sf_dir), path, VERBATIM, "standard", part_chars=PART_CHARS)
    return outputs.read_output(spark, path)


@query(sql_rules(OVERLAY_SQL))
def stream_rules(spark, sf_dir):
    """Rules from conversations that come in three batches, each cut somewhere."""
    turns = overlay(spark, sf_dir).select("conv_id", F.col("pos").alias("seq"), "role", "content")
    arrived, found, checkpoint = (outputs.scratch(spark, f"stream-{name}") for name in ("in", "out", "checkpoint"))
    before = spark.conf.get(sessions.STATE_STORE[0], None)
    spark.conf.set(*sessions.STATE_STORE)
    try:
        for k in range(3):
            turns.where(F.least(F.lit(2), F.floor(F.col("seq") / (2 + F.col("conv_id") % 3))) == k).write.mode("append").parquet(arrived)
            rules = sessions.found_rules(spark.readStream.schema(turns.schema).parquet(arrived), verbatim=VERBATIM)
            rules.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(found).awaitTermination()
    finally:
        spark.conf.set(sessions.STATE_STORE[0], before) if before else spark.conf.unset(sessions.STATE_STORE[0])
    return spark.read.schema(rules.schema).parquet(found).where("rule IS NOT NULL").select("conv_id", "rule_pos", "rule", "rule_key")


LONG_RULES = f"""SELECT conv_id, turn::BIGINT AS pos, 'user' AS role, CASE (conv_id + turn) % 5 WHEN 0 THEN 'never ' || repeat('word ', 200) || 'endangered' || ' ' || text WHEN 1 THEN 'Never ' || repeat('some ', 30) || replace(text, '.', ',') || repeat(' more', 200)
  WHEN 2 THEN repeat('filler ', 130) || 'always keep it ' || replace(text, '.', ',') ELSE text END AS content FROM conversations WHERE text IS NOT NULL"""


def sql_trimmed(source: str, most: int = P.MAX_RULE_LENGTH) -> str:
    """Sentences of over 800 characters: whole with a safety term, else from half of it before the trigger if that would be lost, cut at a late blank."""
    trigger = f"regexp_extract(rule, {duck('(?i)(' + S_CORRECTION[4:] + '|' + S_IMPLICIT[4:] + ')')})"
    moved = f"CASE WHEN place + n <= {most} THEN rule ELSE {sql_strip('substring(rule, word + 1)')} END"
    return f"""SELECT conv_id, pos, kind, unit_no, CASE WHEN length(rule) <= {most} OR regexp_matches(lower(rule), 'hate crime|physical safety|jeopardy|endangered|anti-trans') THEN rule WHEN length(moved) <= {most} THEN moved
        WHEN length(tail) < 40 THEN substring(head, 1, length(head) - length(tail) - 1) || '…' ELSE head || '…' END AS rule
      FROM (SELECT *, substring(moved, 1, {most - 1}) AS head, list_last(string_split(substring(moved, 1, {most - 1}), ' ')) AS tail FROM (SELECT *, {moved} AS moved
        FROM (SELECT *, CASE WHEN start = 0 OR substring(rule, start, 1) = ' ' THEN start ELSE start - length(list_last(string_split(substring(rule, 1, start), ' '))) END AS word
          FROM (SELECT *, greatest(0, strpos(rule, found) - 1) AS place, length(found) AS n, greatest(0, strpos(rule, found) - 1 - {most // 2}) AS start FROM (SELECT *, {trigger} AS found FROM ({sql_sentences(source)}))))))"""


@query(f"SELECT conv_id, pos, kind, unit_no::INTEGER AS unit_no, rule FROM ({sql_trimmed(LONG_RULES)})")
def trimmed_rules(spark, sf_dir):
    """Sentences with a trigger at either end that are longer than a rule may be."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows.createOrReplaceTempView("palaver_long_rules")
    return R.rule_sentences(spark.sql(LONG_RULES.replace("FROM conversations", "FROM palaver_long_rules").replace("::BIGINT", "")).withColumn("pos", F.col("pos").cast("long")))


FALLBACK = f"""CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'Assistant: ' || text WHEN 2 THEN 'You' || {NL} || text
  ELSE 'Front matter of a report.' || {NL} || '## Conversation History (all)' || {NL} || '**User**: ' || text || {NL} || {NL} || '**Assistant**: Noted.' END"""


@query(f"""SELECT conv_id, pos, role, {sql_strip('content')} AS content FROM (
  SELECT conv_id * 1000 + turn AS conv_id, 0::BIGINT AS pos, CASE turn % 4 WHEN 1 THEN 'assistant' ELSE 'user' END AS role, text AS content FROM conversations
  UNION ALL SELECT conv_id * 1000 + turn, 1, 'assistant', 'Noted.' FROM conversations WHERE turn % 4 = 3) WHERE regexp_matches(content, '\\S')""")
def parse_fallbacks(spark, sf_dir):
    """Texts with one label or none, and front matter before the history."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return transcripts.parse(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), F.expr(FALLBACK).alias("value"))).select(*KEEP)


ACROSS = f"text || {NL} || 'Please use plan ' || CAST(conv_id AS {{string}}) || '. row ' || CAST(turn AS {{string}}) || ' instead of it. Done'"
ACROSS_SQL = f"SELECT conv_id, turn::BIGINT AS pos, role, {ACROSS.format(string='VARCHAR')} AS content, text FROM conversations WHERE text IS NOT NULL"


@query(f"""SELECT conv_id, pos, kind, unit_no::INTEGER AS unit_no, rule FROM ({sql_sentences(f"SELECT conv_id, pos, role, content FROM ({ACROSS_SQL})")}) WHERE length(rule) <= {P.MAX_RULE_LENGTH}
  UNION ALL SELECT conv_id, pos, 0, (length(text) - length(replace(replace(text, '.', ''), chr(10), '')) + 1)::INTEGER, 'Please use plan ' || conv_id || '. row ' || pos || ' instead of it.' FROM ({ACROSS_SQL}) WHERE role = 'user'""")
def rules_across_full_stops(spark, sf_dir):
    """A trigger that goes across a full stop, behind each turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("pos"), "role", F.expr(ACROSS.format(string="STRING")).alias("content"))
    return R.rule_sentences(turns).where(F.length("rule") <= P.MAX_RULE_LENGTH)
