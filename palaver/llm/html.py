"""Main text of web pages by equivalence-class template deduction.

Pages of a host are made from templates. A page is read as tokens. An element's token is its role: its tag and names, its number among
brothers of the same kind, and the role of the element around it. Text tokens are short text nodes word by word, long ones whole, with the kinds of
the elements around them. A token's occurrence vector holds how often it occurs in each page of its host; tokens with equal vectors form an equivalence
class. A class is valid if it has ``CLASS_TOKENS`` tokens at least and most of the host's different pages (``SUPPORT``; ``MIN_PAGES`` of them). Valid
classes, nested by the roles around their tokens and ordered by their places in a page that has them all, are the host's template.

The template's text tokens are constants of the site and are removed, unless they are nearly all of the host's text (then its pages are copies of each
other), and never from an article. Each role with what stands in it, down to the next roles of the template, is a slot. Slots are judged once
for all pages of the host: those of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are dropped. Where only an element's names speak for that, the slot must hold less than half of the host's text, and so must forms and elements whose end tag is missing, which must hold no
article either; reader comments go whatever their size. A slot outside articles whose text
is nearly all links is a menu whatever its names are. All that remains is extracted. Elements that the template doesn't have are judged on
the page itself, and so are pages of hosts without a template and pages where its roles come in another order. Where articles, or else a main element, hold enough of what is left
(``IN_MAIN`` of a main element's text, ``IN_PAGE`` of the page's), their text is the main text, otherwise all that is left.

Vectors are never gathered: a task sums two 32-bit hashes of (page, count) for each token, and sums of tasks are summed again, so a host with a third of
all pages is many tasks' work. Different pages are dealt to 64 parts by a digest, and a class must be in most of the parts that the host has, so the text
of a page's copies isn't taken for a template. Templates are one small row per host; pages meet them in a join that Spark broadcasts if the
written table is small and splits where a host is hot.

Defined results: a null or empty html gives an empty text; a null url is a host of its own; a page that is cut off is read as far as it
goes; an element that is never closed ends with the one around it, and links in it are a menu; repeated rows are returned each; an empty table gives an empty result; other columns are ignored. A very long
page is read as a whole, which takes some ten times its size in a task; its template's tokens are summed as others are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

CLASS_TOKENS, SUPPORT, MIN_PAGES = 3, 0.9, 5
#: Text nodes up to so many words are read word by word; share of linked text that makes a slot a menu; share of constants that makes pages copies; tokens that a task holds.
SHORT, LINKED, COPIES, HELD = 12, 0.8, 0.9, 100_000
#: Share of the text of a main element, and of a page, from which on an article holds the main text.
IN_MAIN, IN_PAGE = 0.5, 0.25
MARK = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# fixed values of HTML: elements without content, elements whose content is no markup, elements within a block
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# elements that end no line, or hold none of their own
UNBROKEN = INLINE | {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "video", "audio", "picture", "map", "area", "button", "select", "option", "optgroup", "datalist", "textarea", "input", "output", "progress", "meter", "link", "meta", "slot"}
UNBROKEN_WITHIN = {"svg", "math", "select", "button", "object", "video", "audio", "canvas"}
HEAD_CONTENT = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
# elements that hold no main text, and names (class, id, role) that say so or say the contrary
ASIDE = {"nav", "footer", "aside", "script", "style", "noscript", "iframe", "template", "head", "title", "button", "select", "option", "textarea", "svg", "canvas", "object", "dialog", "menu", "video", "audio", "math"}
ASIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "disqus", "reply", "replies", "respond", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "widget", "pagination", "pager", "login", "signup", "search", "form", "skip", "copyright", "contentinfo", "complementary"}
HEAD_WORDS = {"header", "masthead", "topbar", "toolbar"}  # outside articles only
CONTENT_WORDS = {"article", "post", "entry", "content", "main", "story", "body", "text", "result", "results", "title", "headline"}
COMMENT_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
TAG_ASIDE, NAME_ASIDE, ARTICLE, MAIN, HOLDS, ROLE = 1, 2, 4, 8, 16, 32
#: Dropped if small and without an article; one whose end tag is missing; reader comments; links.
SOFT, OPEN, COMMENT, LINK = 64, 128, 256, 512


def names_of(attributes: str) -> list[list[str]]:
    """Each name that an element is given, as its words."""
    given = (n for m in ATTRIBUTE.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").split())
    return [[w.lower() for w in WORDS.findall(n)] for n in given]


def named(names: list[list[str]], words: set[str]) -> bool:
    """Whether names say one of the words: by their last word, or by the first if the last doesn't say that there is main text."""
    if any(len(n) == 1 and n[0] in words for n in names):
        return True
    if any(len(n) == 1 and n[0] in CONTENT_WORDS for n in names):
        return False
    return any(n and (n[-1] in words or n[0] in words and n[-1] not in CONTENT_WORDS) for n in names)


def aside(flags: int) -> bool:
    """Whether an element holds no main text, however much text it has."""
    return flags & TAG_ASIDE > 0 or flags & COMMENT > 0 and not flags & HOLDS


@dataclass(slots=True)
class Page:
    """Elements in the order of the page, the first around all others, and text nodes."""

    role: list[int]
    parent: list[int]  # index of the element around
    flags: list[int]
    chars: list[int]  # of the text in the element, but for blanks and what is in elements that hold no main text
    linked: list[int]  # of these, in links
    texts: list[tuple[int, int, int, str]]  # element, hash of the kinds around, block, text

    def summed(self) -> Page:
        """Characters and what an element holds, with those of the elements in it."""
        parent, flags, chars, linked = self.parent, self.flags, self.chars, self.linked
        for i in range(len(parent) - 1, 0, -1):
            if not aside(flags[i]):
                chars[parent[i]] += chars[i]
                linked[parent[i]] += linked[i]
                if flags[i] & (ARTICLE | HOLDS):
                    flags[parent[i]] |= HOLDS
        return self


def _hash(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def parse(html: str) -> Page:
    page = Page([0], [0], [ROLE], [0], [0], [])
    # of each open element: tag, index, hash of kinds, whether in an article, whether in a link, kinds of children so far
    stack: list[tuple[str, int, int, bool, bool, dict[bytes, int]]] = [("", 0, 0, False, False, {})]
    at, block, raw, unbroken = 0, 0, "", 0

    def text(value: str, block: int) -> None:
        _, own, kinds, _, link, _ = stack[-1]
        size = len(value) - value.count(" ") - value.count("\n")
        page.chars[own] += size
        page.linked[own] += size if link else 0
        page.texts.append((own, kinds, block, value))

    def unclosed(low: int) -> None:
        for tag, i, *_ in stack[low:]:
            if page.flags[i] & TAG_ASIDE and tag not in RAW and tag not in ("head", "noscript", "template"):
                page.flags[i] += SOFT + OPEN - TAG_ASIDE

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        nonlocal unbroken
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                unclosed(k + 1)
                unbroken -= sum(x[0] in UNBROKEN_WITHIN for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    while at < len(html):
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = m.end() if m else len(html)
            raw = ""
            unbroken -= stack.pop()[0] in UNBROKEN_WITHIN
            continue
        m = MARK.search(html, at)
        value = html[at : m.start() if m else len(html)]
        if not m and (cut := re.search(r"<[!/?a-zA-Z][^>]*\Z", value)):
            value = value[: cut.start()]
        if value:
            text(value, block)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in UNBROKEN and not unbroken:
            block += 1
        elif tag == "br":
            text(" ", block)
        if m[1] or m[4]:
            close((tag,), ())
            continue
        if stack[-1][0] == "head" and tag not in HEAD_CONTENT:
            close(("head",), ())
        if tag in ("p", "li", "tr", "td"):  # ends one that is open
            close((tag,), ("article", "section", "div", "ul", "ol", "table", "body", "main", "td", "blockquote"))
        attributes = m[3] or ""
        names = names_of(attributes) if attributes else []
        kind = (f"{tag}.{'.'.join(sorted({w for n in names for w in n}))}" if names else tag).encode("utf-8", "surrogatepass")
        _, up, kinds, in_article, link, children = stack[-1]
        children[kind] = n = children.get(kind, 0) + 1
        flags = 0
        if tag == "article" or tag == "main" or "role=\"main\"" in attributes:
            flags = ARTICLE if tag == "article" else MAIN
        speak = names and tag not in ("html", "body", "main", "h1")
        if speak and named(names, COMMENT_WORDS):
            flags = flags & ~ARTICLE | COMMENT
        if tag in ASIDE or tag == "header" and not in_article:
            flags |= TAG_ASIDE
        elif speak and named(names, ASIDE_WORDS if in_article or flags & ARTICLE else ASIDE_WORDS | HEAD_WORDS):
            flags |= NAME_ASIDE
        if tag == "form":
            flags |= SOFT
        elif tag == "a":
            flags |= LINK
        page.role.append(_hash(b"%s %d" % (kind, n), page.role[up]))
        page.parent.append(up)
        page.flags.append(flags | ROLE)
        page.chars.append(0)
        page.linked.append(0)
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.append((tag, len(page.role) - 1, _hash(kind, kinds), in_article or flags & ARTICLE > 0, link or tag == "a", {}))
        unbroken += tag in UNBROKEN_WITHIN
        if tag in RAW:
            raw = tag
    unclosed(1)
    return page.summed()


def text_tokens(kinds: int, text: str) -> list[tuple[int, int]]:
    """The tokens of a text node, with their characters."""
    words = text.split()
    return [(_hash(w.encode("utf-8", "surrogatepass"), kinds), len(w) - w.count(" ")) for w in ([" ".join(words)] if len(words) > SHORT else words)]


def dropped(parent: list[int], flags: list[int], chars: list[int], linked: list[int], menus: bool) -> list[bool]:
    """Which elements (parents first) hold no main text, by their flags and by how much text they have; ``menus``: link lists, too."""
    n = len(parent)
    out, within = [False] * n, [False] * n
    for i in range(1, n):
        within[i] = within[parent[i]] or flags[i] & ARTICLE > 0
        small = 2 * chars[i] < chars[0]
        link_list = menus and chars[i] > 0 and linked[i] >= LINKED * chars[i] and not within[i] and not flags[i] & HOLDS
        soft = flags[i] & NAME_ASIDE > 0 or flags[i] & SOFT > 0 and not flags[i] & HOLDS
        out[i] = out[parent[i]] or aside(flags[i]) or small and (soft or link_list)
    return out


@dataclass
class Template:
    """Whether each role's slot is dropped and where the role stands (-1: more than once a page), and constant text tokens."""

    slots: dict[int, tuple[bool, int]]
    constants: frozenset[int]

    def packed(self) -> bytes:
        roles = np.array(list(self.slots), np.uint64)
        state = np.array([(int(d), p) for d, p in self.slots.values()], np.int64).reshape(-1, 2)
        return b"".join((np.int64(len(roles)).tobytes(), roles.tobytes(), state.tobytes(), np.array(sorted(self.constants), np.uint64).tobytes()))

    @staticmethod
    def of(data: bytes | None) -> Template | None:
        if data is None:
            return None
        n = int(np.frombuffer(data, np.int64, 1)[0])
        roles, state = np.frombuffer(data, np.uint64, n, 8).tolist(), np.frombuffer(data, np.int64, 2 * n, 8 + 8 * n).tolist()
        constants = np.frombuffer(data, np.uint64, -1, 8 + 24 * n).tolist()
        return Template({r: (bool(d), p) for r, d, p in zip(roles, state[::2], state[1::2], strict=True)}, frozenset(constants))


def template(rows: list[dict]) -> Template:
    """The template of a host, from the tokens of its valid classes: token, parent, flags, chars, linked, place, once."""
    roles = {r["token"]: r for r in rows if r["flags"] & ROLE}
    order = {t: i for i, (t, _) in enumerate(sorted(((t, r["place"]) for t, r in roles.items() if r["once"]), key=lambda x: x[1]))}
    # nest: each role within the nearest one around it that the template has
    inner: dict[int, list[int]] = {}
    for t, r in roles.items():
        if t != ROOT:
            inner.setdefault(r["parent"] if r["parent"] in roles else ROOT, []).append(t)
    listed, parent, stack = [ROOT], [0], [(t, 0) for t in inner.get(ROOT, [])]
    while stack:
        t, up = stack.pop()
        listed.append(t)
        parent.append(up)
        stack += [(c, len(listed) - 1) for c in inner.get(t, [])]
    flags, chars, linked = ([roles[t][name] if t in roles else 0 for t in listed] for name in ("flags", "chars", "linked"))
    out = dropped(parent, flags, chars, linked, True)
    constants = [r for r in rows if not r["flags"] & ROLE]
    copies = sum(r["chars"] for r in constants) > COPIES * chars[0]
    return Template({t: (d, order.get(t, -1)) for t, d in zip(listed, out, strict=True)}, frozenset() if copies else frozenset(r["token"] for r in constants))


def host_of(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else url


def host_key(url: str | None) -> int:
    """The host as a signed 64-bit number."""
    host = host_of(url)
    return _signed(0 if host is None else _hash(host.encode("utf-8", "surrogatepass"), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrences(page: Page) -> dict[int, list[int]]:
    """Of each token: how often it occurs, its first place, the role around it, flags, characters, and those in links."""
    out: dict[int, list[int]] = {}
    for i in range(len(page.role)):
        out[page.role[i]] = [1, i, page.role[page.parent[i]], page.flags[i], page.chars[i], page.linked[i]]
    inside = [False] * len(page.role)
    for i in range(1, len(page.role)):
        inside[i] = inside[page.parent[i]] or page.flags[i] & (TAG_ASIDE | NAME_ASIDE | SOFT | COMMENT | ARTICLE) > 0
    for own, kinds, _, text in page.texts:
        if inside[own]:  # never removed as a constant, or dropped whatever it says
            continue
        for t, size in text_tokens(kinds, text):
            if held := out.get(t):
                held[0] += 1
                held[4] += size
            else:
                out[t] = [1, 0, 0, 0, size, 0]
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of a task's pages: sums of what ``occurrences`` gives and of two hashes of (page, count), and which of 64 parts of all pages they are in."""
    seen: dict[tuple[int, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = [[k[0] for k in seen], [_signed(k[1]) for k in seen], *zip(*seen.values(), strict=True)] if seen else [[]] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(map(_signed, c) if n in ("spread", "parent") else c, pa.int64()) for n, c in zip(COLUMNS, columns, strict=True)], list(COLUMNS))

    for b in batches:
        for digest, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
            host, bit = host_key(url), 1 << (digest & 63)
            mixed: dict[int, tuple[int, int]] = {}
            for t, (n, at, parent, flags, chars, linked) in occurrences(parse(html or "")).items():
                if n not in mixed:
                    h = _hash(b"%d" % n, digest & 0xFFFFFFFFFFFFFFFF)
                    mixed[n] = h & 0xFFFFFFFF, h >> 32
                va, vb = mixed[n]
                place = (digest & 0x7FFFFFFFFF) << 24 | min(at, 0xFFFFFF)
                if own := seen.get((host, t)):
                    own[0] += 1
                    own[1] += n
                    own[2] += va
                    own[3] += vb
                    own[4] |= bit
                    own[5] = min(own[5], place)
                    own[7] |= flags
                    own[8] += chars
                    own[9] += linked
                else:
                    seen[host, t] = [1, n, va, vb, bit, place, parent, flags, chars, linked]
        if len(seen) > HELD:
            yield out()
            seen.clear()
    yield out()


ROOT = 0
#: Columns of the vectors: pages and occurrences, hash sums, parts, the least (digest, place), the role around, flags and characters.
COLUMNS = ("host", "token", "pages", "times", "va", "vb", "spread", "place", "parent", "flags", "chars", "linked")


def classes(pages: DataFrame) -> DataFrame:
    """host and one valid equivalence class of its tokens in each row."""
    # a page's digest stands for the page, so copies of it add to the same place of every vector
    keyed = pages.select(F.xxhash64(F.coalesce("html", F.lit(""))).alias("digest"), "url", "html")
    vectors = keyed.mapInArrow(_vectors, ", ".join(f"{c} long" for c in COLUMNS))
    by = {"spread": F.bit_or, "flags": F.bit_or, "place": F.min, "parent": F.min}
    sums = [by.get(c, F.sum)(c).alias(c) for c in COLUMNS[2:]]
    totals = save(vectors.groupBy("host", "token").agg(*sums).where(F.bit_count("spread") >= MIN_PAGES), "html-vectors")
    # some token, such as the root element, is in all of a host's pages
    most = totals.groupBy("host").agg(F.max("pages").alias("host_pages"), F.bit_count(F.bit_or("spread")).alias("host_spread"))
    enough = (F.col("pages") >= F.ceil(F.col("host_pages") * SUPPORT)) & (F.bit_count("spread") >= F.ceil(F.col("host_spread") * SUPPORT))
    common = totals.join(most, "host").where(enough)
    token = F.struct("token", "parent", "flags", "chars", "linked", "place", (F.col("times") == F.col("pages")).alias("once"))
    return common.groupBy("host", "pages", "va", "vb").agg(F.collect_list(token).alias("tokens")).where(F.size("tokens") >= CLASS_TOKENS)


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for nested in b.column(1).to_pylist():
            rows = [r | {"token": r["token"] & 0xFFFFFFFFFFFFFFFF, "parent": r["parent"] & 0xFFFFFFFFFFFFFFFF} for own in nested for r in own]
            made.append(template(rows).packed())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """host and its packed template."""
    nested = classes(pages).groupBy("host").agg(F.collect_list("tokens").alias("classes"))
    return save(nested.mapInArrow(_templates, "host long, template binary"), "html-templates")


def main_text(html: str, own: Template | None) -> str:
    """Blocks of the slots that hold main text, one to a line."""
    page = parse(html)
    n = len(page.role)
    if own is not None:
        places = [own.slots[r][1] for r in page.role if r in own.slots and own.slots[r][1] >= 0]
        if any(a > b for a, b in zip(places, places[1:], strict=False)):
            own = None
    out = alone = dropped(page.parent, page.flags, page.chars, page.linked, False)
    if own is not None:
        out = [False] * n
        for i in range(1, n):
            slot = own.slots.get(page.role[i])
            # an element that the template hasn't falls by itself, not by what is around it
            out[i] = out[page.parent[i]] or (slot[0] if slot else alone[i] and not alone[page.parent[i]])
    article, main, menu, link = ([False] * n for _ in range(4))
    for i in range(1, n):
        up, flags = page.parent[i], page.flags[i]
        article[i], main[i] = article[up] or flags & ARTICLE > 0, main[up] or flags & MAIN > 0
        menu[i], link[i] = menu[up] or flags & OPEN > 0, link[up] or flags & LINK > 0
    kept: list[tuple[int, int, str]] = []
    for at, kinds, block, text in page.texts:
        if out[at] or menu[at] and link[at] and not article[at]:
            continue
        if own is not None and own.constants and not article[at] and not text.isspace() and all(t in own.constants for t, _ in text_tokens(kinds, text)):
            continue
        kept.append((at, block, unescape(text) if "&" in text else text))
    size = lambda within: sum(len(t) - sum(map(str.isspace, t)) for at, _, t in kept if within(at))
    whole, in_main, in_both = size(lambda at: True), size(lambda at: main[at]), size(lambda at: main[at] and article[at])
    in_article = size(lambda at: article[at])
    if in_main and in_main >= IN_PAGE * whole:
        within = article if in_both >= IN_MAIN * in_main or in_article - in_both > in_main else main
    else:
        within = article if in_article and in_article >= IN_PAGE * whole else None
    if within is not None:
        kept = [k for k in kept if within[k[0]]]
    lines, last, held = [], None, []
    for _, block, text in [*kept, (0, -1, "")]:
        if block != last and held:
            lines.append(" ".join("".join(held).split()))
            held = []
        last = block
        held.append(text)
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Template | None] = {}
    for b in batches:
        texts = []
        for host, html, data in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
            if host not in held:
                if len(held) > 10_000:
                    held.clear()
                held[host] = Template.of(data.as_py())
            texts.append(main_text(html.as_py() or "", held[host]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(host_key, b.column(1).to_pylist()), pa.int64())], ["page_id", "url", "html", "host"])


def extract(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; templates are deduced from the same pages unless given."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    found = templates(rows) if found is None else found
    hosted = rows.mapInArrow(_hosted, "page_id long, url string, html string, host long")
    joined = hosted.join(found, "host", "left").select("page_id", "url", "host", "html", "template")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
