"""Prune, diagnose and brief: plans over many conversations at once.

All strengths come from one relation, ``shortened``: each turn with its cleaned content, whether it is recent, whether a later turn has the same
content, and the places of repeated chunks. A strength is an expression over these columns, so statistics of all strengths are one aggregation, and
columns that aren't asked for are never computed. An executed plan scans texts three times for this (the rows, hashes for the duplicates, chunks for the repeats;
exchanges are used again), and places once; gentle pruning scans texts once.

Defined results are those of ``operators.turns``; a conversation whose turns have no tokens saves 0 %; one without rules has an empty list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import patterns as P
from palaver.functions import text as T
from palaver.operators import rules as R
from palaver.operators import turns as O
from palaver.sinks import outputs


def of(prescription: str) -> set[str]:
    """What a prescription does; an unknown one is ``standard``."""
    return P.PRESCRIPTIONS.get(prescription, P.PRESCRIPTIONS["standard"])


def shortened(turns: DataFrame, verbatim: int | None, does: set[str]) -> DataFrame:
    """Turns with ``is_recent`` (which they have already if ``verbatim`` is None), ``cleaned`` (and freed of filler if old), ``gone`` (a later old turn is equal) and ``repeats``, as far as ``does`` needs them.

    ``mild`` is what is left by cleaning and by freeing old turns of boilerplate alone; the other strengths go on from there.
    """
    role, old = F.col("role"), ~F.col("is_recent")
    freed = lambda c, step, strip: F.when(old, T.unless_empty(role, c, strip)).otherwise(c) if step in does else c
    flagged = turns if verbatim is None else O.flag_recent(turns, verbatim)
    rows = flagged.withColumn("mild", freed(T.clean(F.col("content")), "boilerplate", T.strip_boilerplate))
    rows = rows.withColumn("cleaned", freed(F.col("mild"), "acknowledgement", T.strip_acknowledgement))
    earlier = rows.where(old)
    if "dedup" in does:
        last = O.last_places(earlier, F.col("cleaned"))
        mark = lambda df: O.beside(df.withColumn("hash", F.when(~F.col("is_recent"), T.content_hash(F.col("cleaned")))), last, "conv_id", "hash").drop("hash")
        gone = ~F.col("is_recent") & F.coalesce(F.col("pos") < F.col("last_pos"), F.lit(False))
        rows = mark(rows).withColumn("gone", gone).drop("last_pos")
        earlier = rows.where(old & ~F.col("gone"))
    else:
        rows = rows.withColumn("gone", F.lit(False))
    if "collapse" in does:
        places = O.repeated_parts(earlier.where("role = 'assistant'"), F.col("cleaned")).select("*", F.lit("assistant").alias("role"), F.lit(False).alias("is_recent"), F.lit(False).alias("gone"))
        rows = O.beside(rows, places, "conv_id", "pos", "role", "is_recent", "gone")
    else:
        rows = rows.withColumn("repeats", F.lit(None).cast("array<int>"))
    return rows


def content_of(does: set[str]) -> Column:
    """The content that a turn is left with, null if it goes."""
    if does <= {"boilerplate"}:
        return F.when(F.col("mild").rlike(r"\S"), F.col("mild"))
    short = O.collapsed(F.col("cleaned"), F.col("repeats")) if "collapse" in does else F.col("cleaned")
    if "compress" in does:
        short = F.when(F.col("is_recent"), short).otherwise(T.compress(short))
    return F.when(~F.col("gone"), T.let(short, lambda c: F.when(c.rlike(r"\S"), c)))


def prune(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS, prescription: str = "standard") -> DataFrame:
    """The turns that stay, with ``is_recent``. Recent turns are cleaned only; an unknown prescription is ``standard``."""
    does = of(prescription)
    rows = shortened(turns, verbatim, does).withColumn("content", content_of(does)).where("content IS NOT NULL")
    return rows.select(*turns.columns, "is_recent")


def rules_of(turns: DataFrame) -> DataFrame:
    """conv_id and the rules of each conversation, in order; there are ``MAX_RULES`` of them at most."""
    ordered = F.array_sort(F.collect_list(F.struct("rule_pos", "rule")))
    return R.extract_rules(turns).groupBy("conv_id").agg(F.transform(ordered, lambda x: x["rule"]).alias("rules"))


def measured(turns: DataFrame, verbatim: int | None, prescriptions: list[str], *more: Column, by: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row per conversation (or what else ``by`` says): turns and tokens before, and for each prescription p ``turns_p`` and ``tokens_p`` after; ``more`` aggregates of the same rows.

    Prescriptions share their rows if they take the same steps before compressing, or nothing but boilerplate.
    """
    steps = set().union(*(of(p) for p in prescriptions))
    if any(not of(p) <= {"boilerplate"} and of(p) - {"compress"} != steps - {"compress"} for p in prescriptions):
        raise ValueError("these prescriptions don't share their rows")
    rows = shortened(turns.withColumn("tokens_before", T.tokens(F.col("content"))), verbatim, steps)  # so that the text before need not travel
    for p in prescriptions:
        rows = rows.withColumn(f"left_{p}", content_of(of(p)))
    after = [c for p in prescriptions for c in (F.count(f"left_{p}").alias(f"turns_{p}"), F.coalesce(F.sum(T.tokens(F.col(f"left_{p}")) * F.when(F.col(f"left_{p}").isNotNull(), 1)), F.lit(0)).cast("long").alias(f"tokens_{p}"))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("orig_turns"), F.sum("tokens_before").alias("orig_tokens"), *after, *more)


def stats_columns(prescription: str, verbatim: int) -> list[Column]:
    """The statistics of one prescription, from ``measured`` and a column of rules."""
    final = F.col(f"tokens_{prescription}")
    zero = F.lit(0).cast("long")
    return [
        F.lit(prescription).alias("prescription"), F.col("orig_turns"), F.col(f"turns_{prescription}").alias("final_turns"), F.col("orig_tokens"), final.alias("final_tokens"),
        (F.col("orig_tokens") - final).alias("saved_tokens"), T.saved_pct(F.col("orig_tokens"), final).alias("saved_pct"),
        F.greatest(zero, F.least(F.lit(verbatim).cast("long"), F.col("orig_turns"))).alias("verbatim"), F.coalesce(F.size("rules").cast("long"), zero).alias("rules_found"),
    ]


def prune_stats(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS, prescription: str = "standard") -> DataFrame:
    """One row per conversation: turns and tokens before and after, saved tokens and percent, verbatim turns, rules found."""
    rows = O.beside(measured(turns, verbatim, [prescription]), rules_of(turns), "conv_id")
    return rows.select("conv_id", *stats_columns(prescription, verbatim))


def prune_summary(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS, prescription: str = "standard") -> DataFrame:
    """conv_id and what a console says of a pruning: counts, the first rules, and a warning if a long conversation gave few rules."""
    rows = O.beside(measured(turns, verbatim, [prescription]), rules_of(turns), "conv_id").select("conv_id", "rules", *stats_columns(prescription, verbatim))
    number = lambda c: F.format_number(c, 0)
    shown = F.transform(F.slice("rules", 1, P.SHOWN_RULES), lambda r: F.concat(F.lit("         -> "), F.substring(r, 1, P.SHOWN_RULE_LENGTH)))
    few = (F.col("rules_found") < P.FEW_RULES) & (F.col("orig_turns") > P.FEW_RULES_TURNS)
    lines = [
        F.concat(F.lit("Turns:   "), F.col("orig_turns").cast("string"), F.lit(" -> "), F.col("final_turns").cast("string")),
        F.concat(F.lit("Tokens:  ~"), number("orig_tokens"), F.lit(" -> ~"), number("final_tokens")),
        F.concat(F.lit("Saved:   ~"), number("saved_tokens"), F.lit(" tokens  ("), F.col("saved_pct").cast("string"), F.lit("%)")),
        F.concat(F.lit("Rules:   "), F.col("rules_found").cast("string"), F.lit(" kept")),
        F.when(few, F.lit("WARNING: very few rules were found; the conversation's form may not have been understood.")),
        F.when(F.size("rules") > 0, F.array_join(shown, "\n")),
    ]
    return rows.select("conv_id", F.concat_ws("\n", *lines).alias("summary"))


EVERY = ["gentle", "standard", "aggressive"]


def savings(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS) -> DataFrame:
    """Tokens saved by each prescription, over all conversations."""
    totals = measured(turns, verbatim, EVERY).agg(F.sum("orig_tokens").alias("orig_tokens"), *[F.sum(f"tokens_{p}").alias(p) for p in EVERY])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("prescription"), F.col(p).alias("final")) for p in EVERY])).alias("x")
    saved = totals.where("orig_tokens IS NOT NULL").select("orig_tokens", each).select("x.prescription", "orig_tokens", (F.col("orig_tokens") - F.col("x.final")).alias("saved_tokens"))
    return saved.withColumn("saved_pct", T.saved_pct(F.col("orig_tokens"), F.col("orig_tokens") - F.col("saved_tokens")))


def diagnose(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS) -> DataFrame:
    """One row per conversation: sizes, noise, duplicates, rules, the largest turns, and what each prescription saves."""
    top = O.largest_turns(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "role", "tokens"))).alias("largest"))
    content = F.col("content")
    out = measured(turns, verbatim, EVERY, *O.summary_columns(content), *O.noise_columns(content))
    for more in (O.duplicate_groups(turns), rules_of(turns), top):
        out = O.beside(out, more, "conv_id")
    saved = [c for p in P.PRESCRIPTIONS for c in ((F.col("orig_tokens") - F.col(f"tokens_{p}")).alias(f"saved_{p}"), T.saved_pct(F.col("orig_tokens"), F.col(f"tokens_{p}")).alias(f"saved_pct_{p}"))]
    n_rules = F.coalesce(F.size("rules").cast("long"), F.lit(0).cast("long")).alias("n_rules")
    return out.select("conv_id", "n_turns", "n_chars", "n_tokens", "context_pct", "thinking_turns", "tag_turns", "duplicate_groups", n_rules, "largest", *saved)


def diagnosis_text(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS) -> DataFrame:
    """conv_id and a report to read."""
    bar = lambda t: F.repeat(F.lit("#"), F.least(F.lit(24), F.floor(t / 200)).cast("int"))
    line = lambda x: F.concat(F.lit("  "), bar(x["tokens"]), F.format_string(" Turn %3d (%-9s): ~%s tokens", x["pos"], x["role"], F.format_number(x["tokens"], 0)))
    d = diagnose(turns, verbatim)
    label = lambda name, value: F.concat(F.rpad(F.lit(name), 20, " "), value)
    lines = [
        label("Turns:", F.col("n_turns").cast("string")), label("Characters:", F.format_number("n_chars", 0)), label("Tokens (est.):", F.format_number("n_tokens", 0)),
        label("Context fill:", F.concat(T.one_digit(F.col("context_pct")), F.lit("%"))), F.lit(""), F.lit("Noise detected:"), label("  Thinking blocks:", F.col("thinking_turns").cast("string")),
        label("  Tagged turns:", F.col("tag_turns").cast("string")), label("  Duplicate turns:", F.col("duplicate_groups").cast("string")), label("  Correction rules:", F.col("n_rules").cast("string")),
        F.lit(""), F.lit("Largest turns:"), F.array_join(F.transform("largest", line), "\n"), F.lit(""), F.lit("Estimated savings:"),
        *[F.concat(F.rpad(F.lit(f"  {p}"), 14, " "), F.format_string(" ~%s tokens saved (%s%%)", F.format_number(f"saved_{p}", 0), F.col(f"saved_pct_{p}").cast("string"))) for p in P.PRESCRIPTIONS],
    ]
    return d.select("conv_id", F.concat_ws("\n", *lines).alias("report"))


#: Characters of original text from which on the history of a briefing gets another part, and places that stay in one part.
PART_CHARS, PART_BLOCK = 1 << 20, 64


def labelled(prescription: str) -> Column:
    """A turn's place and its line of the history, null if it goes."""
    label, left = F.when(F.col("role") == "user", "**User**").otherwise("**Assistant**"), F.col(f"left_{prescription}")
    return F.when(left.isNotNull(), F.struct("pos", F.concat(label, F.lit(": "), left).alias("line")))


def history_parts(turns: DataFrame, verbatim: int, prescription: str, part_chars: int = PART_CHARS, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """conv_id, part (from 0), text and the statistics of ``measured`` for consecutive turns of a conversation; a part is about ``part_chars`` of the original.

    What a row holds is bounded by a part, however long the conversation. Texts of the parts, joined by a blank line where they aren't null, are the history. ``kept`` may
    write the table of blocks: as its size is known then, texts don't travel to it if it is small.
    """
    blocks = O.running_parts(turns, F.coalesce(F.length("content"), F.lit(0)), part_chars, PART_BLOCK)
    recent = O.recent_from(turns, max(verbatim, 1)).withColumn("recent_from", F.col("recent_from") if verbatim > 0 else F.lit(None).cast("long"))
    numbered = O.beside(turns.withColumn("block", O.block_of(PART_BLOCK)), kept(O.beside(blocks, recent, "conv_id")), "conv_id", "block")
    numbered = numbered.withColumn("is_recent", O.is_recent()).drop("block", "recent_from")
    line = labelled(prescription)
    text = F.when(F.count(line) > 0, F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n\n")).alias("text")
    return measured(numbered, None, [prescription], text, by=("conv_id", "part"))


def totals(parts: DataFrame, prescription: str, *more: Column) -> DataFrame:
    """The statistics of each conversation from those of its parts."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("orig_turns", "orig_tokens", f"turns_{prescription}", f"tokens_{prescription}")]
    return parts.groupBy("conv_id").agg(*sums, *more)


def heading(stats: DataFrame, rules: DataFrame, verbatim: int, prescription: str, stamp: str | None, *more: str) -> DataFrame:
    """conv_id, heading, and columns ``more`` of ``stats``: what comes before the history of a briefing."""
    d = O.beside(stats, rules, "conv_id").select("conv_id", *more, "rules", *stats_columns(prescription, verbatim))
    number = lambda c: F.format_number(c, 0)
    n = F.col("rules_found")
    listed = F.array_join(F.transform("rules", lambda r: F.concat(F.lit("- "), r)), "\n")
    rule_lines = F.when(n > 0, F.concat_ws("\n", F.lit("---"), F.lit(""), F.lit("## BEHAVIORAL RULES"), F.lit("*Stated by the user in the original conversation; they hold from here on.*"), F.lit(""), listed, F.lit("")))
    warning = F.when(n >= int(P.STORE_RULES * 0.8), F.concat(F.lit("**WARNING:** "), n.cast("string"), F.lit(f" of {P.STORE_RULES} rules are in use.")))
    text = F.concat_ws(
        "\n", F.lit("# CONVERSATION BRIEFING"), *([F.lit(f"*Made on {stamp}*")] if stamp else []), F.lit(""), F.concat(F.lit("*Original: "), F.col("orig_turns").cast("string"), F.lit(" turns, ~"), number("orig_tokens"), F.lit(" tokens*")),
        F.concat(F.lit("*Compressed: "), F.col("final_turns").cast("string"), F.lit(" turns, ~"), number("final_tokens"), F.lit(" tokens*")),
        F.concat(F.lit("*Saved: "), F.col("saved_pct").cast("string"), F.lit("% | Last "), F.col("verbatim").cast("string"), F.lit(" turns verbatim*")),
        warning, F.lit(""), F.lit("> **How to use**: paste this document as the first message of a new conversation."), F.lit(""), rule_lines, F.lit("---"), F.lit(""), F.lit("## CONVERSATION HISTORY"), F.lit(""), F.lit(""),
    )
    return d.select("conv_id", text.alias("heading"), *more)


def briefing_parts(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS, prescription: str = "aggressive", stamp: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part and text: the heading (part 0) and the parts of the history; one after the other, they are the briefing."""
    parts = history_parts(turns, verbatim, prescription, part_chars)
    heads = heading(totals(parts, prescription), rules_of(turns), verbatim, prescription, stamp)
    return heads.select("conv_id", F.lit(0).cast("long").alias("part"), F.col("heading").alias("text")).unionByName(_history(parts))


def _history(parts: DataFrame, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """conv_id, part (from 1) and text of the parts that have one, from the second on after a blank line."""
    held = parts.where("text IS NOT NULL")
    begins = kept(held.groupBy("conv_id").agg(F.min("part").alias("begin")))  # the text stays where it is
    text = F.when(F.col("part") > F.col("begin"), F.concat(F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    return O.beside(held, begins, "conv_id").select("conv_id", (F.col("part") + 1).alias("part"), text.alias("text"))


#: Whether what a query has shuffled goes when it is done, and not only when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_briefings(turns: DataFrame, path: str, verbatim: int = P.VERBATIM_TURNS, prescription: str = "aggressive", stamp: str | None = None, part_chars: int = PART_CHARS) -> None:
    """Write what ``briefing_parts`` gives as the current result at ``path``, sorted; the parts are written first, and the headings come from what was written."""
    spark = turns.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        with outputs.staged(spark, path) as out:

            def kept(name: str) -> Callable[[DataFrame], DataFrame]:
                def write(df: DataFrame) -> DataFrame:
                    df.write.parquet(out.side(name))
                    return spark.read.schema(df.schema).parquet(out.side(name))

                return write

            parts = kept("parts")(history_parts(turns, verbatim, prescription, part_chars, kept("blocks")))
            in_order = lambda df: df.repartitionByRange("conv_id", "part").sortWithinPartitions("conv_id", "part")
            in_order(_history(parts, kept("begins"))).write.mode("append").parquet(out.folder)
            heads = heading(totals(parts, prescription), rules_of(turns), verbatim, prescription, stamp)
            heads.select("conv_id", F.lit(0).cast("long").alias("part"), F.col("heading").alias("text")).write.mode("append").parquet(out.folder)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def briefing(turns: DataFrame, verbatim: int = P.VERBATIM_TURNS, prescription: str = "aggressive", stamp: str | None = None) -> DataFrame:
    """conv_id and document: statistics, rules, and the pruned history with labels. A document is one row, as large as its conversation's history; ``briefing_parts`` has no such rows."""
    history = F.array_join(F.transform(F.array_sort(F.collect_list(labelled(prescription))), lambda x: x["line"]), "\n\n").alias("history")
    heads = heading(measured(turns, verbatim, [prescription], history), rules_of(turns), verbatim, prescription, stamp, "history")
    return heads.select("conv_id", F.concat("heading", "history").alias("document"))
