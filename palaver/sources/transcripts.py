"""Transcripts in JSON, JSONL or pasted text, to turns(conv_id, pos, idx, role, content).

A null or blank input gives no turns; equal inputs give turns each. Text before the first label is left out.

``pos`` is a turn's place in its conversation, counted from 0 over kept turns; ``idx`` is the same except for JSON messages, where it is the place in the raw array.
A transcript is one row, and becomes rows of turns by ``explode``; a session log that is too large for that is read by lines, of which every task has some (``log_turns``).
Whatever is no turn can be had with the reason (``outcomes``): each input, message, line and piece of text is a turn or a reject.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import patterns as P
from palaver.functions import text as T

ROLES = ("user", "assistant", "system")
#: Characters of a tool's result that are kept, and what stands before them.
RESULT_CHARS, RESULT = 300, "[result: "
#: Bytes of a file from which on it isn't read as one row.
WHOLE_BYTES = 64 << 20
#: Characters of a reject that are told.
TOLD = 80


def read_files(spark: SparkSession, paths: str | list[str], most_bytes: int | None = None) -> DataFrame:
    """conv_id (the file's path) and value (its whole text) of files of ``most_bytes`` at most; ``-`` is what comes in on the driver's standard input."""
    if paths == "-" or paths == ["-"]:
        return spark.createDataFrame([("-", sys.stdin.read())], "conv_id string, value string")
    files = spark.read.text(paths, wholetext=True)
    if most_bytes is not None:  # tells which files are opened
        files = files.where(F.col("_metadata.file_size") <= most_bytes)
    return files.select(F.col("_metadata.file_path").alias("conv_id"), "value")


def read_lines(spark: SparkSession, paths: str | list[str], more_bytes: int | None = None) -> DataFrame:
    """conv_id (the file's path), split (where the part of the file begins that a task reads) and value of the lines of files of over ``more_bytes``."""
    lines = spark.read.text(paths, lineSep="\n")
    if more_bytes is not None:
        lines = lines.where(F.col("_metadata.file_size") > more_bytes)
    return lines.select(F.col("_metadata.file_path").alias("conv_id"), F.col("_metadata.file_block_start").alias("split"), T.strip(F.col("value")).alias("value"))


def sizes(raw: DataFrame, observation: Observation, most: int = P.WARN_INPUT_CHARS) -> DataFrame:
    """``raw``, and what an action over it tells ``observation``: inputs, characters, inputs of over ``most`` characters, and the largest one. No pass of its own."""
    n = F.length("value")
    return raw.observe(
        observation, F.count(F.lit(1)).alias("inputs"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.count_if(n > most).alias("oversize"),
        F.max(n).alias("largest_chars"), F.max_by("conv_id", n).alias("largest"),
    )


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _plain(v: Column) -> Column:
    """The text of a content value that is no array."""
    return F.when(v.isNull() | (_kind(v) == "VOID"), "").when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(F.to_json(v), F.lit("")))


def _block(b: Column, result: Column) -> Column:
    """The text of a block, null if blocks of its kind hold none."""
    kind = F.try_variant_get(b, "$.type", "string")
    arguments = F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}"))
    return (
        F.when(kind == "text", _text(b, "$.text"))
        .when(kind == "thinking", F.concat(F.lit("<thinking>"), _text(b, "$.thinking"), F.lit("</thinking>")))
        .when(kind == "tool_use", F.concat(F.lit("[tool:"), _text(b, "$.name"), F.lit(" "), F.substring(arguments, 1, 200), F.lit("]")))
        .when(kind == "tool_result", F.concat(F.lit(RESULT), F.substring(result, 1, RESULT_CHARS), F.lit("]")))
    )


def _unfolded(v: Column) -> Column:
    """The text of an array of blocks within a result, however deep results hold results; as much of it as the outermost result keeps.

    A list of texts and of arrays still to unfold, in order, from which each round unfolds one level. What is ``RESULT_CHARS`` in isn't kept, and each level is ``RESULT``
    further in than the one around it: that is how many rounds can matter, and for the same reason cuts within a cut don't. Every text has a character at least,
    and every array has one before it, so that twice ``RESULT_CHARS`` items hold what is kept.
    """
    nothing, no_text = F.lit(None).cast("variant"), F.lit(None).cast("string")
    item = lambda text, array: F.struct(text.alias("t"), array.alias("v"))

    def found(b: Column) -> Column:
        inner = F.try_variant_get(b, "$.content", "variant")
        array = (F.try_variant_get(b, "$.type", "string") == "tool_result") & _list(inner).isNotNull()
        return F.when(array, item(no_text, inner)).otherwise(item(F.substring(_block(b, _plain(inner)), 1, RESULT_CHARS + 1), nothing))

    def placed(x: Column, i: Column) -> Column:
        line = F.when(i > 0, "\n").otherwise("")
        whole = F.array(item(F.concat(line, F.lit(RESULT)), nothing), item(no_text, x["v"]), item(F.lit("]"), nothing))
        return F.when(x["v"].isNotNull(), whole).otherwise(F.array(item(F.concat(line, x["t"]), nothing)))

    def unfold(x: Column) -> Column:
        blocks = F.filter(F.transform(_list(x["v"]), found), lambda y: y["v"].isNotNull() | (y["t"] != ""))
        return F.when(x["v"].isNull(), F.array(x)).otherwise(F.flatten(F.transform(blocks, placed)))

    round_ = lambda items, _: F.slice(F.flatten(F.transform(items, unfold)), 1, 2 * RESULT_CHARS)
    joined = lambda items: F.array_join(F.transform(items, lambda x: x["t"]), "")
    rounds = F.array_repeat(F.lit(0), -(-RESULT_CHARS // len(RESULT)))
    return F.aggregate(rounds, F.array(item(no_text, v)), round_, joined)


def content_text(v: Column) -> Column:
    """The text of a content value: a string, or blocks of text, thinking, tool calls and tool results; results hold content again, of any depth."""

    def block(b: Column) -> Column:
        inner = F.try_variant_get(b, "$.content", "variant")
        return _block(b, F.when(_list(inner).isNotNull(), _unfolded(inner)).otherwise(_plain(inner)))

    blocks = F.array_join(F.filter(F.transform(_list(v), block), lambda t: t.isNotNull() & (t != "")), "\n")
    return F.when(_list(v).isNotNull(), blocks).otherwise(_plain(v))


def _messages(v: Column) -> Column:
    """The messages of a document, or null if it has none."""
    keyed = F.coalesce(*[F.when(_kind(F.try_variant_get(v, f"$.{k}", "variant")).startswith("ARRAY"), _list(v, f"$.{k}")) for k in P.CONTAINER_KEYS])
    single = F.try_variant_get(v, "$.role", "variant").isNotNull() | F.try_variant_get(v, "$.type", "variant").isNotNull()
    session = F.try_variant_get(v, "$.message", "variant").isNotNull() & F.try_variant_get(v, "$.content", "variant").isNull()
    return F.when(_kind(v).startswith("ARRAY"), _list(v)).when(keyed.isNotNull(), keyed).when(single & ~session, F.array(v))


def _item(idx: Column, role: Column, content: Column, reason: Column) -> Column:
    return F.struct(idx.cast("long").alias("idx"), role.alias("role"), content.alias("content"), reason.alias("reason"))


def _rows(raw: DataFrame, items: Column, rejects: bool, dense: bool = True) -> DataFrame:
    """Rows of the items (idx, role, content, reason) of each input: kept ones with their place, and if asked for the others with the reason and what they begin with."""
    place = lambda x, i: F.struct(i.cast("long").alias("pos"), (i.cast("long") if dense else x["idx"]).alias("idx"), x["role"].alias("role"), x["content"].alias("content"), F.lit(None).cast("string").alias("reason"))
    refused = lambda x: F.struct(F.lit(None).cast("long").alias("pos"), x["idx"].alias("idx"), x["role"].alias("role"), F.substring(x["content"], 1, TOLD).alias("content"), x["reason"].alias("reason"))
    found = raw.select("conv_id", items.alias("t"))
    turns = F.transform(F.filter("t", lambda x: x["reason"].isNull()), place)
    if not rejects:
        return found.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.pos", "t.idx", "t.role", "t.content")
    none = F.when(F.size(turns) == 0, F.array(refused(_item(F.lit(None), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("no turns"))))).otherwise(F.array())
    others = F.transform(F.filter("t", lambda x: x["reason"].isNotNull()), refused)
    return found.select("conv_id", F.explode(F.concat(turns, others, none)).alias("t")).select("conv_id", "t.*")


def _blank(content: Column) -> Column:
    return ~F.coalesce(content.rlike(r"\S"), F.lit(False))


def _json_items() -> Column:
    role = lambda x: T.normal_role(F.coalesce(F.nullif(F.try_variant_get(x, "$.role", "string"), F.lit("")), F.nullif(F.try_variant_get(x, "$.type", "string"), F.lit("")), F.lit("unknown")))
    content = lambda x: content_text(F.try_variant_get(x, "$.content", "variant"))
    reason = lambda x, text: F.when(~_kind(x).startswith("OBJECT"), "no message").when(~role(x).isin(*ROLES), "other role").when(_blank(text), "blank")
    item = lambda x, i: T.let(content(x), lambda text: _item(i, role(x), F.when(_kind(x).startswith("OBJECT"), text).otherwise(F.to_json(x)), reason(x, text)))
    return F.transform(_messages(F.try_parse_json("value")), item)


def json_turns(raw: DataFrame, rejects: bool = False) -> DataFrame:
    """Turns of JSON documents: an array of messages, one under a known key, or one message. Other documents give none."""
    return _rows(raw, _json_items(), rejects, dense=False)


def _log_reason(v: Column, role: Column, content: Column) -> Column:
    return F.when(v.isNull(), "no JSON").when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), "other type").when(_blank(content), "blank")


def _log_role(v: Column) -> Column:
    return F.try_variant_get(v, "$.type", "string")


def _log_text(v: Column) -> Column:
    return content_text(F.try_variant_get(v, "$.message.content", "variant"))


def jsonl_turns(raw: DataFrame, rejects: bool = False) -> DataFrame:
    """Turns of session logs: lines with type user or assistant and a message; lines that can't be decoded are passed over."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"\S"))
    of = lambda x, i: T.let(F.struct(F.try_parse_json(x).alias("v")), lambda y: T.let(_log_text(y["v"]), lambda text: _item(i, _log_role(y["v"]), F.when(y["v"].isNull(), x).otherwise(text), _log_reason(y["v"], _log_role(y["v"]), text))))
    return _rows(raw, F.transform(lines, of), rejects)


def log_turns(lines: DataFrame) -> DataFrame:
    """Turns of session logs read by lines (conv_id, split, value), as ``jsonl_turns`` gives them; no row holds more than a line, and no text is moved.

    Kept lines are numbered where they are read. A split's first number and its count are one row, and the sum of the counts of a file's splits before it says where its turns begin.
    """
    parsed = lines.where("value != ''").select("conv_id", "split", F.try_parse_json("value").alias("v"))
    read = parsed.select("conv_id", "split", _log_role(F.col("v")).alias("role"), _log_text(F.col("v")).alias("content"))
    kept = read.where(F.col("role").isin("user", "assistant") & F.col("content").rlike(r"\S")).withColumn("n", F.monotonically_increasing_id())
    splits = kept.groupBy("conv_id", "split").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("turns"))
    before = F.coalesce(F.sum("turns").over(Window.partitionBy("conv_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.join(splits.withColumn("before", before).drop("turns"), ["conv_id", "split"])
    pos = F.col("before") + F.col("n") - F.col("first")
    return placed.select("conv_id", pos.alias("pos"), pos.alias("idx"), "role", "content")


def log_rejects(lines: DataFrame) -> DataFrame:
    """conv_id, split, reason and beginning of the lines that ``log_turns`` passes over."""
    parsed = lines.where("value != ''").withColumn("v", F.try_parse_json("value"))
    reason = T.let(_log_text(F.col("v")), lambda text: _log_reason(F.col("v"), _log_role(F.col("v")), text))
    return parsed.withColumn("reason", reason).where("reason IS NOT NULL").select("conv_id", "split", "reason", F.substring("value", 1, TOLD).alias("content"))


def log_files(lines: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id and is_log of each file, which tells whether ``parse`` would take it for a session log: its first line is an object, it has others, every line of JSON is an object,
    all bytes are UTF-8, and there are ``most`` characters at most."""
    kind = _kind(F.try_parse_json("value"))
    of = kind.startswith("OBJECT").alias("object"), F.is_valid_utf8("value").alias("valid"), (F.length("value") + 1).alias("chars")
    numbered = lines.where("value != ''").select("conv_id", "split", F.monotonically_increasing_id().alias("n"), *of)
    first = F.min_by(F.coalesce("object", F.lit(False)), F.struct("split", "n"))
    right = first & (F.count(F.lit(1)) > 1) & F.min(F.coalesce("object", F.lit(True))) & F.min("valid")
    return numbered.groupBy("conv_id").agg((right if most is None else right & (F.sum("chars") <= most + 1)).alias("is_log"))


def _labelled(value: Column, pattern: str) -> Column:
    parts = F.slice(F.split(F.regexp_replace(value, pattern, f"{T.MARKS[0]}$1{T.MARKS[1]}"), T.MARKS[0]), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(T.normal_role(F.substring_index(p, T.MARKS[1], 1)).alias("role"), T.strip(F.substring(p, F.instr(p, T.MARKS[1]) + 1, F.length(p))).alias("content")))


def _dated(value: Column) -> Column:
    """Chunks between date lines; text before the first is the user's, later chunks by whether they ask something."""
    parts = F.split(value, P.DATE_LINE)
    asks = lambda c: c.rlike(P.ASKS) | F.lower(F.substring(c, 1, 100)).rlike(P.ASKS_EARLY)
    return F.transform(parts, lambda p, i: F.struct(F.when((i == 0) | asks(T.strip(p)), "user").otherwise("assistant").alias("role"), T.strip(p).alias("content")))


def text_turns(raw: DataFrame, rejects: bool = False) -> DataFrame:
    """Turns of pasted text: labels with colons, labels on lines of their own, or date lines; else one turn of the user."""
    rows = raw.select("conv_id", F.regexp_replace(T.unmarked(F.col("value")), P.HISTORY, "").alias("value"))
    v = F.col("value")
    n_colon, n_solo, n_date = (F.regexp_count(v, F.lit(p)) for p in (P.COLON_LABEL, P.SOLO_LABEL, P.DATE_LINE))
    dated = F.size(F.filter(_dated(v), lambda t: t["content"] != ""))
    chosen = (
        F.when(n_colon >= 2, _labelled(v, P.COLON_LABEL)).when(n_solo >= 2, _labelled(v, P.SOLO_LABEL)).when((n_date >= 1) & (dated >= 2), _dated(v))
        .when(n_colon == 1, _labelled(v, P.COLON_LABEL)).when(n_solo == 1, _labelled(v, P.SOLO_LABEL))
        .otherwise(F.array(F.struct(F.lit("user").alias("role"), T.strip(v).alias("content"))))
    )
    return _rows(rows, F.transform(chosen, lambda t, i: _item(i, t["role"], t["content"], F.when(t["content"] == "", "blank"))), rejects)


def _formed(raw: DataFrame) -> DataFrame:
    """Stripped inputs that aren't blank, with their form.

    JSON if it parses to messages, session lines if the first line begins like an object, else text. Session lines without any turn give none; a line that is JSON but no object makes
    the input text.
    """
    stripped = raw.select("conv_id", T.strip(F.col("value")).alias("value")).where("value != ''")
    messages = F.col("value").rlike(r"\A[\[{]") & _messages(F.try_parse_json("value")).isNotNull()
    lines = F.transform(F.split("value", r"\r?\n"), F.try_parse_json)
    session = F.col("value").startswith("{") & ~F.exists(lines, lambda x: x.isNotNull() & ~_kind(x).startswith("OBJECT"))
    return stripped.withColumn("form", F.when(messages, "json").when(session, "jsonl").otherwise("text"))


def _parsed(raw: DataFrame, rejects: bool) -> DataFrame:
    marked = _formed(raw)
    parts = [turns(marked.where(F.col("form") == form), rejects) for form, turns in (("json", json_turns), ("jsonl", jsonl_turns), ("text", text_turns))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parse(raw: DataFrame) -> DataFrame:
    """Turns of every input (conv_id, value), by its form."""
    return _parsed(raw, rejects=False)


def refusal(most: int | None = None) -> Column:
    """Why an input isn't read, or null: bytes that are no UTF-8, blank, or more than ``most`` characters."""
    valid = F.is_valid_utf8("value")
    out = F.when(F.col("value").isNull(), "blank").when(~valid, "not UTF-8").when(T.strip(F.col("value")) == "", "blank")
    return out if most is None else out.when(F.length("value") > most, "too long")


def parse_checked(raw: DataFrame, most: int | None = None) -> DataFrame:
    """Turns of the inputs that can be read, of ``most`` characters at most."""
    return parse(raw.where(refusal(most).isNull()))


def outcomes(raw: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, pos, idx, role, content and reason: every turn, with a null reason, and every reject.

    Rejects are inputs that can't be read or have no turns (without idx), messages and lines that are no turns, and blank pieces of text; content is what they begin with.
    """
    marked = raw.withColumn("reason", refusal(most))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "long"), ("idx", "long"), ("role", "string"))]
    told = F.when(F.col("reason") == "too long", F.substring("value", 1, TOLD)).alias("content")
    refused = marked.where("reason IS NOT NULL").select("conv_id", *nothing, told, "reason")
    return _parsed(marked.where("reason IS NULL"), rejects=True).unionByName(refused)


def load(spark: SparkSession, paths: str | list[str], most: int | None = None, whole_bytes: int = WHOLE_BYTES, observation: Observation | None = None, warn: int = P.WARN_INPUT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Turns of files, and rejects (conv_id, idx, role, content, reason): files of over ``whole_bytes`` are read by lines if they are session logs, and refused otherwise.

    Inputs of over ``most`` characters are refused. An action over the turns tells ``observation`` the ``sizes`` of the inputs that are read whole.
    """
    small = read_files(spark, paths, whole_bytes)
    seen = small if observation is None else sizes(small, observation, warn)
    turns, rejects = parse_checked(seen, most), rejects_of(outcomes(small, most))
    if paths == "-" or paths == ["-"]:
        return turns, rejects
    lines = read_lines(spark, paths, whole_bytes)
    known = log_files(lines, most)
    logs = known.where("is_log").select("conv_id")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("idx", "long"), ("role", "string"))]
    large = known.where("NOT is_log").select("conv_id", *nothing, F.lit(None).cast("string").alias("content"), F.lit("too long").alias("reason"))
    passed = log_rejects(lines).join(logs, "conv_id", "left_semi").select("conv_id", *nothing, "content", "reason")
    # lines are numbered where they are read, so the join comes after that
    return turns.unionByName(log_turns(lines).join(logs, "conv_id", "left_semi")), rejects.unionByName(large).unionByName(passed)


def rejects_of(found: DataFrame) -> DataFrame:
    return found.where("reason IS NOT NULL").drop("pos")
