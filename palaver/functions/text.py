"""Column expressions over message texts. All are built-in functions, so plans stay in the JVM.

A null text gives a null, or an empty array; an empty one is a text like any other. Where pieces of a text have to be told from the text itself, Unicode's
noncharacters U+FDD0 to U+FDD2, which no text may hold, stand between them; ``compress`` and the parser of pasted text drop them from their input, and ``without``
behind a "<".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Between pieces.
MARKS = ("\ufdd0", "\ufdd1", "\ufdd2")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(P.SPACE))


def unmarked(c: Column) -> Column:
    return F.translate(c, "".join(MARKS), "")


def without(c: Column, pattern: str, kinds: tuple[str, tuple[str, ...]]) -> Column:
    """Text without what the pattern finds: blocks from a start tag to the next end tag of its kind.

    A start tag behind the last end tag of its kind is held back first. So every start that the pattern tries has an end, which it goes to once: the time is
    linear, whatever tags there are and however they are mixed.
    """
    flags, names = kinds

    def held(name: str) -> Callable[[Column], Column]:
        last = rf"(?s{flags})\A.*</{name}>"
        behind = lambda t, h: F.regexp_replace(F.substring(t, F.length(h) + 1, F.length(t)), rf"(?{flags or 's'})<(?={name}>)", f"<{MARKS[0]}")
        return lambda t: let(F.regexp_extract(t, last, 0), lambda h: F.concat(h, behind(t, h)))

    marked = c
    for name in names:
        marked = let(marked, held(name))
    return F.when(F.contains(c, F.lit("</")), F.replace(F.regexp_replace(marked, pattern, ""), F.lit(f"<{MARKS[0]}"), F.lit("<"))).otherwise(c)


def holds(c: Column, kinds: tuple[str, tuple[str, ...]]) -> Column:
    """Whether a text has a block from a start tag to an end tag of its kind; in linear time."""
    flags, names = kinds
    out = F.lit(False)
    for name in names:
        out = out | F.regexp_extract(c, rf"(?s{flags})\A.*</{name}>", 0).rlike(rf"(?{flags or 's'})<{name}>")
    return out


def tokens(c: Column) -> Column:
    """Estimated tokens, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(c) / F.lit(P.CHARS_PER_TOKEN)))


def normal_role(raw: Column) -> Column:
    r = F.lower(strip(raw))
    return F.when(r.isin("human", "user", "you"), "user").when(r.isin("assistant", "ai") | r.startswith("claude"), "assistant").otherwise(r)


def strip_thinking(c: Column) -> Column:
    return strip(without(c, P.THINKING, P.THINKING_KINDS))


def strip_tags(c: Column) -> Column:
    return strip(without(c, P.TAGS, P.TAG_KINDS))


def strip_ui_artifacts(c: Column) -> Column:
    """One pass for doubled lines, then the labels, which therefore never bring lines together."""
    once = F.regexp_replace(c, P.LINE_PAIR, "$1$2$3")
    return F.regexp_replace(F.regexp_replace(once, P.MORE_FIRST, ""), P.MORE_LATER, "")


def collapse_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean(c: Column) -> Column:
    return collapse_blank_lines(strip_ui_artifacts(strip_tags(strip_thinking(c))))


def strip_boilerplate(c: Column) -> Column:
    for pattern in (P.OPENER_A, P.OPENER_B, P.CLOSER):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def strip_acknowledgement(c: Column) -> Column:
    return strip(F.regexp_replace(c, P.ACKNOWLEDGEMENT, ""))


def unless_empty(role: Column, content: Column, change: Callable[[Column], Column]) -> Column:
    """Changed content for assistants, if anything is left."""
    return F.when(role == "assistant", let(content, lambda c: F.coalesce(F.nullif(change(c), F.lit("")), c))).otherwise(content)


def space_key(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def content_hash(c: Column) -> Column:
    return F.md5(F.substring(c, 1, P.HASH_PREFIX).cast("binary"))


def chunks(c: Column) -> Column:
    """Chunks at even and separators at odd places; joined, they are the text."""
    pieces, breaks = F.split(c, P.CHUNK_BREAK), F.regexp_extract_all(c, F.lit(P.CHUNK_BREAK), F.lit(0))
    return F.flatten(F.zip_with(pieces, breaks, lambda p, b: F.when(b.isNull(), F.array(p)).otherwise(F.array(p, b))))


def repeat_marker(part: Column) -> Column:
    space = F.lit(P.SPACE)
    lead = F.substring(part, F.lit(1), F.length(part) - F.length(F.ltrim(part, space)))
    trail = F.substring(part, F.length(F.rtrim(part, space)) + 1, F.length(part))
    preview = F.rtrim(F.substring(space_key(part), 1, 50), space)
    return F.concat(lead, F.lit('[Repeated, unchanged: "'), preview, F.lit('..."]'), trail)


def sentence_units(c: Column) -> Column:
    """Pieces up to and with a full stop, or up to a line's end."""
    units = F.regexp_extract_all(c, F.lit(r"[^.\n]*+\.|[^.\n]*+\n|[^.\n]++\z|(?<=[.\n])\z|\A\z"), F.lit(0))
    return F.transform(units, lambda u: F.rtrim(u, F.lit("\n")))


def unit_sentences(c: Column) -> Column:
    """Sentences of the units; one that ends in a full stop takes closing punctuation from the start of the next."""
    closing = r"\A[" + "".join("\\" + x for x in P.CLOSERS) + r"]{0,5}"

    def sentences(units: Column) -> Column:
        after = lambda i: F.regexp_extract(F.coalesce(F.try_element_at(units, (i + 2).cast("int")), F.lit("")), closing, 0)
        return F.transform(units, lambda u, i: strip(F.when(u.endswith("."), F.concat(u, after(i))).otherwise(u)))

    return let(sentence_units(c), sentences)


def protected(c: Column, terms: tuple[str, ...] = P.SAFETY_TERMS) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(F.lower(c), F.lit(term.lower()))
    return out


def trim_rule(sentence: Column, terms: tuple[str, ...] = P.SAFETY_TERMS, most: int = P.MAX_RULE_LENGTH) -> Column:
    """A sentence that is too long is cut at a word, near the trigger if that would be lost; the ellipsis counts. Protected ones stay whole."""

    def around(s: Column) -> Column:
        first = F.regexp_extract(s, rf"{P.CORRECTION}|{P.IMPLICIT_CORRECTION}", 0)

        def from_word(m: Column) -> Column:
            start = F.greatest(F.lit(0), m["at"] - most // 2)
            before = F.substring(s, F.lit(1), start)
            word = F.when((start == 0) | before.endswith(" "), start).otherwise(F.length(before) - F.length(F.substring_index(before, " ", -1)))
            return F.when(m["at"] + m["n"] > most, strip(F.substring(s, word + 1, F.length(s)))).otherwise(s)

        return let(F.struct(F.greatest(F.lit(0), F.instr(s, first) - 1).alias("at"), F.length(first).alias("n")), from_word)

    def shortened(moved: Column) -> Column:
        head = F.substring(moved, 1, most - 1)
        tail = F.length(F.substring_index(head, " ", -1))
        cut = F.when(tail < 40, F.substring(head, F.lit(1), F.length(head) - tail - 1)).otherwise(head)
        return F.when(F.length(moved) <= most, moved).otherwise(F.concat(cut, F.lit("…")))

    return let(sentence, lambda s: F.when((F.length(s) <= most) | protected(s, terms), s).otherwise(let(around(s), shortened)))


def bigrams(c: Column) -> Column:
    def pairs(words: Column) -> Column:
        joined = F.transform(words, lambda w, i: F.when(i > 0, F.concat(F.try_element_at(words, i.cast("int")), F.lit(" "), w)))
        return F.array_distinct(F.filter(joined, lambda p: p.isNotNull()))

    return let(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)), pairs)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda p: p != "")


def _numbered(bare: Column) -> Column:
    """Text with code replaced by its number between marks."""
    pieces = F.split(bare, P.CODE)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(MARKS[0]), (i - 1).cast("string"), F.lit(MARKS[1]), p))), "")


def _restored(text: Column, blocks: Column) -> Column:
    block = lambda x: F.element_at(blocks, F.substring_index(x, MARKS[1], 1).cast("int") + 1)
    rest = lambda x: F.substring(x, F.instr(x, MARKS[1]) + 1, F.length(x))
    return F.array_join(F.transform(F.split(text, MARKS[0]), lambda x, i: F.when(i == 0, x).otherwise(F.concat(block(x), rest(x)))), "")


def _reduced(para: Column) -> Column:
    """The paragraph with fenced code, or up to four telling sentences of one without."""
    sentences = F.transform(F.split(para, r"(?<=[.!?])\s+"), strip)
    telling = F.filter(sentences, lambda s: (F.length(s) >= 20) & s.rlike(P.SIGNAL))
    return F.when(F.contains(para, F.lit("```")), F.array(para)).otherwise(F.transform(F.slice(telling, 1, 4), lambda s: F.concat(F.lit("- "), s)))


def compress(content: Column) -> Column:
    """First paragraph, fenced code, and up to four telling sentences of each other paragraph; a header if much was saved."""

    def headed(short: Column, before: Column) -> Column:
        after = F.floor(F.length(short) / F.lit(P.CHARS_PER_TOKEN))
        header = F.concat(F.lit("[~"), before.cast("string"), F.lit("to"), after.cast("string"), F.lit("t]\n"))
        return F.when(before > after + P.HEADER_SLACK, F.concat(header, short)).otherwise(short)

    def shortened(c: Column) -> Column:
        bare = unmarked(c)

        def of(x: Column) -> Column:
            parts = F.transform(x["paragraphs"], lambda p: _restored(p, x["blocks"]))
            kept = F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, F.array(p)).otherwise(_reduced(p))))
            return F.when(F.size(x["paragraphs"]) <= 2, strip(_restored(x["held"], x["blocks"]))).otherwise(let(F.array_join(kept, "\n\n"), lambda s: headed(s, tokens(c))))

        whole = lambda h: F.struct(F.regexp_extract_all(bare, F.lit(P.CODE), F.lit(0)).alias("blocks"), h.alias("held"), paragraphs(h).alias("paragraphs"))
        return let(let(strip_tags(strip_thinking(_numbered(bare))), whole), of)

    return let(content, shortened)


def saved_pct(before: Column, after: Column) -> Column:
    """Percent saved, to one digit as SQL rounds it: ten times the number goes to the nearest whole one, halves away from zero, and what is below zero keeps its sign."""
    tenths = lambda x: F.round(F.abs(x)) * F.when(x < 0, -1.0).otherwise(1.0) / 10
    return F.when(before > 0, let((before - after) / before * 100 * 10, tenths)).otherwise(F.lit(0.0))


def one_digit(number: Column) -> Column:
    """A number of 0 or more with one digit, as C's ``%.1f`` writes it: by its binary value, and an exact half to the even digit. ``format_string`` goes by the shortest decimal, so that 0.15 is 0.2."""

    def written(x: Column) -> Column:
        whole = F.floor(x)
        # what is behind the point, in parts of 2 ** 59: exact, as a power of two only moves it
        tenths = lambda part: F.shiftright(part, 59) + F.when((part.bitwiseAND(F.lit((1 << 59) - 1)) > 1 << 58) | (part.bitwiseAND(F.lit((1 << 60) - 1)) == 3 << 58), 1).otherwise(0)
        return (let(((x - whole) * float(1 << 59)).cast("long") * 10, tenths) + whole * 10).cast("decimal(19,0)") / 10

    return let(number, written).cast("decimal(20,1)").cast("string")
