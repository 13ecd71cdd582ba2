"""Operators over turns(conv_id, pos, idx, role, content); ``pos`` is a conversation's order.

Per-key extremes are partial aggregates joined back, not windows over a key's rows, so a key with a third of all rows is split. Only keys and places
travel; texts stay where they are but for the join that brings places back to them.

Defined results: a null conversation is a conversation of its own; a turn with a null place is in no order: it is never recent, never gives way to
another turn, and never repeats one; a null content is a content of its own for duplicates, without chunks, of null length; an
empty one is a text like any other; an unknown or null role is no assistant's; turns that share place and conversation are judged alike, and none of them gives way to
the other; an empty table gives an empty result; further columns are kept by the operators that return turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import patterns as P
from palaver.functions import text as T


def beside(turns: DataFrame, found: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """``turns`` with the other columns of ``found``, joined on keys of which nulls are equal."""
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    own = [F.col(f"t.{c}") for c in turns.columns]
    more = [] if how in ("left_semi", "left_anti") else [F.col(f"f.{c}") for c in found.columns if c not in keys]
    return turns.alias("t").join(found.alias("f"), on, how).select(*own, *more)


def last_places(turns: DataFrame, content: Column) -> DataFrame:
    """conv_id, hash and the last place of each content, by its first 2000 characters."""
    hashed = turns.select("conv_id", "pos", T.content_hash(content).alias("hash"))
    return hashed.groupBy("conv_id", "hash").agg(F.max("pos").alias("last_pos"))


def dedup_keep_last(turns: DataFrame) -> DataFrame:
    """Of a conversation's turns whose first 2000 characters are equal, the last."""
    content = F.col("content")
    marked = beside(turns.withColumn("hash", T.content_hash(content)), last_places(turns, content), "conv_id", "hash")
    return marked.where(F.coalesce(F.col("pos") >= F.col("last_pos"), F.lit(True))).select(*turns.columns)


def duplicate_groups(turns: DataFrame) -> DataFrame:
    """conv_id, and the number of contents that occur more than once."""
    sizes = turns.groupBy("conv_id", T.content_hash(F.col("content")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("conv_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def recent_from(turns: DataFrame, verbatim: int) -> DataFrame:
    """conv_id and the place from which on its turns are recent: the last ``verbatim`` ones, 1 at least; only those reach the exchange."""
    latest = Window.partitionBy("conv_id").orderBy(F.col("pos").desc())
    last = turns.select("conv_id", "pos").where("pos IS NOT NULL").withColumn("n", F.row_number().over(latest)).where(F.col("n") <= verbatim)
    return last.groupBy("conv_id").agg(F.min("pos").alias("recent_from"))


def is_recent() -> Column:
    return F.coalesce(F.col("pos") >= F.col("recent_from"), F.lit(False))


def flag_recent(turns: DataFrame, verbatim: int) -> DataFrame:
    """With ``is_recent`` for the last ``verbatim`` turns of each conversation."""
    if verbatim <= 0:
        return turns.withColumn("is_recent", F.lit(False))
    return beside(turns, recent_from(turns, verbatim), "conv_id").withColumn("is_recent", is_recent()).drop("recent_from")


def largest_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest turns of each conversation by tokens, earlier first among equals."""
    order = Window.partitionBy("conv_id").orderBy(F.col("tokens").desc(), "pos")
    sized = turns.select("conv_id", "pos", "role", T.tokens(F.col("content")).alias("tokens"))
    return sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def running_parts(turns: DataFrame, size: Column, most: int, block: int = 64, region: int = 4096) -> DataFrame:
    """conv_id, block and part: consecutive turns, by blocks of places, in parts of about ``most`` of ``size`` each.

    Sums run over blocks within a region and over regions, so that no task holds more than a region's blocks or a conversation's regions; texts don't travel.
    """
    at = block_of(block)
    blocks = turns.groupBy("conv_id", at.alias("block")).agg(F.sum(size).alias("n")).withColumn("region", F.floor(F.col("block") / region))
    regions = blocks.groupBy("conv_id", "region").agg(F.sum("n").alias("m"))
    up_to = lambda *keys: Window.partitionBy("conv_id", *keys[:-1]).orderBy(F.col(keys[-1]).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    regions = regions.withColumn("start", F.coalesce(F.sum("m").over(up_to("region")), F.lit(0))).drop("m")
    own = blocks.withColumn("own", F.coalesce(F.sum("n").over(up_to("region", "block")), F.lit(0)))
    return beside(own, regions, "conv_id", "region").select("conv_id", "block", F.floor((F.col("start") + F.col("own")) / most).alias("part"))


def block_of(block: int) -> Column:
    return F.floor(F.col("pos") / block)


def repeated_parts(turns: DataFrame, content: Column) -> DataFrame:
    """conv_id, pos and, in order, the places of long chunks that occurred before: earlier in the turn or in an earlier turn of the conversation.

    A chunk is hashed where it stands; hashes and places travel. Within a turn, sorting tells which of equal chunks is the first.
    """
    chunk = lambda c, i: F.when((i % 2 == 0) & (F.length(T.space_key(c)) >= P.COLLAPSE_LENGTH), F.struct(F.unhex(F.md5(T.space_key(c).cast("binary"))).alias("key"), i.cast("int").alias("part")))
    ordered = F.sort_array(F.filter(F.transform(T.chunks(content), chunk), lambda x: x.isNotNull()))
    again = lambda s: F.transform(s, lambda x, i: F.struct(x["key"].alias("key"), x["part"].alias("part"), ((i > 0) & (F.get(s, i - 1)["key"] == x["key"])).alias("again")))
    keyed = turns.select("conv_id", "pos", F.explode(T.let(ordered, again)).alias("c")).select("conv_id", "pos", "c.key", "c.part", "c.again")
    first = keyed.groupBy("conv_id", "key").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = beside(keyed, first, "conv_id", "key", how="inner").where(F.col("again") | (F.col("pos") > F.col("first_pos")))
    return later.groupBy("conv_id", "pos").agg(F.sort_array(F.collect_set("part")).alias("repeats"))


def collapsed(content: Column, repeats: Column) -> Column:
    """The text with markers for the chunks at the places ``repeats``, which are in order."""
    # true at each of the places, so that a chunk's own is found without search
    before = lambda i: F.coalesce(F.get(repeats, i - 1), F.lit(-1))
    flags = F.flatten(F.transform(repeats, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True)))))
    rebuilt = lambda f: F.transform(T.chunks(content), lambda c, i: F.when(F.get(f, i), T.repeat_marker(c)).otherwise(c))
    return F.when(repeats.isNull(), content).otherwise(F.array_join(T.let(flags, rebuilt), ""))


def collapse_repeats(turns: DataFrame) -> DataFrame:
    """Long chunks of assistants that occurred before in the conversation become markers; turns of others stay as they are."""
    places = repeated_parts(turns.where("role = 'assistant'"), F.col("content")).withColumn("role", F.lit("assistant"))
    joined = beside(turns, places, "conv_id", "pos", "role")
    return joined.withColumn("content", collapsed(F.col("content"), F.col("repeats"))).select(*turns.columns)


def summary_columns(content: Column) -> list[Column]:
    """Aggregates of a conversation: turns, characters, tokens and the share of the context window."""
    tokens = F.sum(T.tokens(content))
    return [
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.length(content)).cast("long").alias("n_chars"), tokens.cast("long").alias("n_tokens"),
        (tokens / F.lit(P.CONTEXT_WINDOW) * 100).cast("double").alias("context_pct"),
    ]


def noise_columns(content: Column) -> list[Column]:
    return [F.count_if(T.holds(content, P.THINKING_KINDS)).alias("thinking_turns"), F.count_if(T.holds(content, P.TAG_KINDS)).alias("tag_turns")]


def conversation_summary(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(*summary_columns(F.col("content")))


def noise_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(*noise_columns(F.col("content")))
