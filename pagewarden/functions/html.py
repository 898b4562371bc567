"""HTML Columns: tags, attributes, text and entities by regular expression.

Patterns use possessive quantifiers, and every match of an open-ended one runs to its end
or the page's, so broken markup does not make a scan start over.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden import constants as C
from pagewarden.functions.numbers import let
from pagewarden.functions.urls import strip_space

# inside of a tag, up to but without '>': quoted values may hold '<' and '>', stray quotes end nothing
INSIDE = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TAG = rf"<[/a-zA-Z!?]{INSIDE}>"

# fixed values: entities common enough for a direct replacement; '&amp;' has to come last
_COMMON = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"),
]
_MARKUP = {34: "&quot;", 38: "&amp;", 39: "&#39;", 60: "&lt;", 62: "&gt;"}


def tags(html: Column, names: list[str]) -> Column:
    """All opening tags of the given names, in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{'|'.join(names)})(?=[\s/>]){INSIDE}>"), F.lit(0))


def has_tag(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)^<{name}[\s/>]")


def attribute(tag: Column, name: str) -> Column:
    """Raw attribute value, NULL when the attribute is absent."""
    value = F.regexp_extract(
        tag, rf"""(?i)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1
    )
    return unescape(F.regexp_replace(F.nullif(value, F.lit("")), r"""^["']|["']$""", ""))


def parsed_metas(metas: Column) -> Column:
    """Lower-case ``name`` and ``property`` and the raw ``content`` of meta tags: each tag is
    taken apart once, whatever is asked about it later."""
    return F.transform(
        metas,
        lambda t: F.struct(
            F.lower(attribute(t, "name")).alias("name"), F.lower(attribute(t, "property")).alias("property"),
            attribute(t, "content").alias("content"),
        ),
    )


def meta_content(metas: Column, key: str, value: str) -> Column:
    """Content of the first of the parsed metas whose ``key`` equals ``value``, trimmed."""
    hits = F.filter(metas, lambda m: m[key] == value)
    return F.coalesce(strip_space(F.try_element_at(hits, F.lit(1))["content"]), F.lit(""))


def _decoded(name: Column, table: Column) -> Column:
    """Character of one entity name; markup characters stay entities."""
    number = F.coalesce(
        F.regexp_extract(name, r"^#(\d+)$", 1).try_cast("bigint"),
        F.conv(F.nullif(F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]+)$", 1), F.lit("")), 16, 10).try_cast("bigint"),
    )

    def character(n: Column) -> Column:
        known = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        markup = F.try_element_at(F.create_map(*[F.lit(x) for kv in _MARKUP.items() for x in kv]), n.cast("int"))
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(n.isNull(), F.try_element_at(table, name)).otherwise(
            F.coalesce(markup, F.when(known, plain).otherwise("\ufffd"))
        )

    return let(number, character)


def decode_uncommon(html: Column) -> Column:
    """Replace numeric entities and rarer names by their characters, once per document.

    Markup characters keep a named entity, so tags can still be told from text.
    """
    names = {n: chr(p) for n, p in name2codepoint.items() if p not in _MARKUP}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    common = "|".join(e[1:] for e, _ in _COMMON)
    uncommon = rf"&(?!{common})(?:#\d|#[xX][0-9a-fA-F]|[A-Za-z][A-Za-z0-9]+;)"
    entity = r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

    def piece(s: Column) -> Column:
        name = F.regexp_extract(s, entity, 1)
        value = _decoded(name, table)
        return F.coalesce(
            F.concat(value, F.regexp_replace(s, entity, "")), F.concat(F.lit("&"), s)
        )

    def decoded(page: Column) -> Column:
        # the first piece has no '&' before it
        pieces = F.transform(F.split(page, "&", -1), lambda s, i: F.when(i == 0, s).otherwise(piece(s)))
        return F.when(page.rlike(uncommon), F.array_join(pieces, "")).otherwise(page)

    return let(html, decoded)


def unescape(text: Column) -> Column:
    """Decode the common entities; ``decode_uncommon`` has dealt with the others."""
    out = text
    for entity, char in _COMMON:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def text_of(fragment: Column, joined_by: str = " ") -> Column:
    """Text of a fragment: each text node trimmed, nodes joined, entities decoded."""
    parts = F.regexp_replace(fragment, rf"\s*(?:{TAG}\s*+)++", joined_by)
    return strip_space(unescape(parts))


# the first look at '<' and its neighbour lets a scan pass all other places cheaply
_RAW = r"(?=<s)(<(script|style)(?=[\s/>])" + INSIDE + r">)(.*?)(</\2(?=[\s/>])|\z)"


def without_comments(html: Column) -> Column:
    """Comments out, script and style text as it is: what comes first, a comment or such an
    element, hides the start of the other. Every match runs to its end or the page's, so
    the scan is linear."""
    return F.regexp_replace(html, rf"(?is)(?=<[!s])(?:<!--.*?(?:-->|\z)|{_RAW})", " $1$3$4")


def without_raw_text(html: Column) -> Column:
    """Script and style elements emptied: their text is no markup. Needs ``without_comments``."""
    return F.regexp_replace(html, rf"(?is){_RAW}", "$1$4")


def headings(html: Column) -> Column:
    """Texts of h1-h6 by level, one scan for all six. A heading without an end runs to the
    next heading or the end of the page."""
    found = F.regexp_extract_all(
        html, F.lit(rf"(?is)<h([1-6])(?=[\s>]){INSIDE}>.*?(?:</h\1\s*>|(?=<h[1-6][\s>])|\z)"), F.lit(0)
    )

    def level(elements: Column, n: int) -> Column:
        hits = F.filter(elements, lambda e: F.substring(e, 3, 1) == str(n))
        return F.transform(hits, lambda e: text_of(e)).alias(f"h{n}")

    return let(found, lambda elements: F.struct(*[level(elements, n) for n in range(1, 7)]))


_EMPTY, _OPENS, _HIDES, _CLOSES, _TEXT = range(5)
_LETTER = r"a-zA-Z0-9_\p{L}\p{N}"


def _is_hidden(tag: Column) -> Column:
    return F.lower(attribute(tag, "style")).rlike("display: none|visibility: hidden")


def _parsed(token: Column) -> Column:
    """Kind of a token, the name of a tag and the words of a text. Done once per token: a
    lambda evaluates an expression again wherever the fold names it."""

    excluded = F.lit(f" {' '.join(C.EXCLUDED_TAGS)} ")  # a name holds no white space

    def tag(name: Column) -> Column:
        empty = name.isin("", *C.VOID_TAGS) | token.endswith("/>")
        styled = F.lower(token).contains("style") & _is_hidden(token)
        kind = (
            F.when(empty, _EMPTY).when(token.startswith("</"), _CLOSES)
            .when(excluded.contains(F.concat(F.lit(" "), name, F.lit(" "))) | styled, _HIDES).otherwise(_OPENS)
        )
        return F.struct(kind.alias("kind"), name.alias("name"), F.lit(0).alias("words"))

    text = F.struct(F.lit(_TEXT).alias("kind"), F.lit("").alias("name"), count_words(token, unescaped=False).alias("words"))
    is_tag = token.startswith("<") & (token != "<")
    return F.when(is_tag, let(F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1)), tag)).otherwise(text)


def visible_words(html: Column) -> Column:
    """Words outside excluded and inline-hidden elements.

    One fold over tags and texts: ``name`` is the element that hides, ``same`` how many of
    that name are open, ``inner`` how many elements are open inside. An end tag that fits
    none of those ends an element around it, and the hiding with it.
    """
    tokens = F.transform(F.regexp_extract_all(html, F.lit(rf"(?s){TAG}|[^<]++|<"), F.lit(0)), _parsed)
    zero = F.struct(F.lit("").alias("name"), F.lit(0).alias("same"), F.lit(0).alias("inner"), F.lit(0).alias("n"))

    def state(name: Column, same: Column, inner: Column, n: Column) -> Column:
        return F.struct(name.alias("name"), same.alias("same"), inner.alias("inner"), n.alias("n"))

    def step(acc: Column, token: Column) -> Column:
        kind, name, none = token["kind"], token["name"], F.lit(0)
        shown, fits = acc["name"] == "", name == acc["name"]
        return (
            F.when(kind == _EMPTY, acc)
            .when(kind == _TEXT, F.when(shown, state(acc["name"], acc["same"], acc["inner"], acc["n"] + token["words"])).otherwise(acc))
            .when(shown, F.when(kind == _HIDES, state(name, F.lit(1), none, acc["n"])).otherwise(acc))
            .when(kind != _CLOSES, state(acc["name"], acc["same"] + F.when(fits, 1).otherwise(0), acc["inner"] + 1, acc["n"]))
            .when(fits & (acc["same"] > 1), state(acc["name"], acc["same"] - 1, acc["inner"] - 1, acc["n"]))
            .when(fits | (acc["inner"] <= 0), state(F.lit(""), none, none, acc["n"]))
            .otherwise(state(acc["name"], acc["same"], acc["inner"] - 1, acc["n"]))
        )

    return F.aggregate(tokens, zero, step, lambda acc: acc["n"])


def body_text(html: Column) -> Column:
    """All body text except scripts and styles; the fallback when nothing is visible."""
    shown = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")
    shown = F.regexp_replace(shown, r"(?is)<(script|style|template)(?=[\s>])[^>]*>.*?(?:</\1\s*>|\z)", " ")
    return unescape(F.regexp_replace(shown, TAG, " "))


def count_words(text: Column, unescaped: bool = True) -> Column:
    """Number of words. A run of word characters, hyphens and apostrophes is one word as soon
    as it has a word character, so no end has to be looked for. One pass keeps the first
    character of every word, which makes no string per word. Where the text is not unescaped
    yet, the common entities count as their characters."""
    if unescaped:
        pattern = rf"[^{_LETTER}]*+(?:([{_LETTER}])[{_LETTER}'\-]*+)?+"
    else:
        entity = f"&(?:{'|'.join(e[1:-1] for e, _ in _COMMON)});"
        between = rf"[^{_LETTER}&]*+(?:(?:{entity}|&)[^{_LETTER}&]*+)*+"
        pattern = rf"{between}(?:([{_LETTER}])[{_LETTER}'\-]*+(?:&(?:apos|#39);[{_LETTER}'\-]*+)*+)?+"
    return F.length(F.regexp_replace(text, pattern, "$1"))


def word_count(html: Column) -> Column:
    def or_body(n: Column) -> Column:
        empty = (n == 0) & html.rlike(r"(?i)<body[\s>]")
        return F.when(empty, count_words(body_text(html))).otherwise(n)

    return let(visible_words(html), or_body)
