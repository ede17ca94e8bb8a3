"""HTML read with column expressions: tokens, tags, attributes, character references.

A page is an array of tokens, each a tag, comment, script or style element with the text behind it
up to the next token. Quoted attribute values, comments and scripts may hold any markup; the
expressions use possessive quantifiers only, so a page costs linear time and no stack.
"""

from html.entities import html5, name2codepoint

from pyspark.sql import Column, functions as F

from .text import given

_TAG = r"""</?+[a-z][^\s/>]*+(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_HIDDEN = r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)|<(script|style)\b[^>]*+>(?:[^<]++|<(?!/\1\b))*+(?:</\1[^>]*+>|\z)|<[!?][^>]*+>"
_TEXT = r"[^<]*+(?:<(?![a-z/!?])[^<]*+)*+"
TOKEN = f"(?is)(?:{_HIDDEN}|{_TAG}){_TEXT}"
_ATTRIBUTE = r"""(?s)([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?"""
_REFERENCE = "(?s)&#?[a-zA-Z0-9]++;?|[^&]++|&"

#: Named references: the usual ones, of which the oldest also stand without a semicolon.
NAMED = {f"{name};": chr(code) for name, code in {**name2codepoint, "apos": 39}.items()} | {
    name: text for name, text in html5.items() if not name.endswith(";")
}
#: Numbers that pages use for the characters of an old single-byte set.
OLD_NUMBERS = {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}


def _constant_map(items: dict) -> Column:
    """A map of constants as one literal, which keeps plans small."""
    text = "\u0001".join(f"{key}\u0002{value}" for key, value in items.items())
    return F.str_to_map(F.lit(text), F.lit("\u0001"), F.lit("\u0002"))


def tokens(html: Column) -> Column:
    """The tokens of a page, in order; text in front of the first tag is none."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    """Lower-case name of a tag, with a slash in front if it ends an element; empty for other tokens."""
    return F.lower(F.regexp_extract(token, r"(?i)^<(/?+[a-z][^\s/>]*+)", 1))


def tag_of(token: Column) -> Column:
    """A token's tag without the text behind it."""
    return F.regexp_extract(token, f"(?is)^{_TAG}", 0)


def text_behind(token: Column) -> Column:
    return unescaped(F.regexp_replace(token, f"(?is)^(?:{_HIDDEN}|{_TAG})", ""))


def attribute(token: Column, name: str) -> Column:
    """Value of a tag's attribute, decoded; empty if it has none. Of repeated ones the last counts."""
    inside = F.regexp_replace(tag_of(token), r"(?is)^</?+[a-z][^\s/>]*+|/?>$", "")

    def named(text):
        names = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
        values = F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(2))
        return F.try_element_at(F.filter(values, lambda v, i: F.get(names, i) == name), F.lit(-1))

    def bare(value):
        quoted = F.left(value, F.lit(1)).isin('"', "'") & (F.length(value) > 1)
        return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    return unescaped(given(F.coalesce(given(inside, named), F.lit("")), bare))


def _character(number: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    wrong = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF) | (number == 0)
    old = _constant_map(OLD_NUMBERS)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(wrong, "�").when(number.between(0x80, 0x9F), F.element_at(old, number.cast("string"))).otherwise(plain)


def _referred(part: Column) -> Column:
    named = _constant_map(NAMED)
    hexadecimal = F.conv(F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]+);?$", 1), 16, 10).cast("bigint")
    return (
        F.when(~F.startswith(part, F.lit("&")), part)
        .when(part.rlike("^&#[0-9]{1,9};?$"), _character(F.regexp_extract(part, "([0-9]+)", 1).cast("bigint")))
        .when(part.rlike("^&#[xX][0-9a-fA-F]{1,8};?$"), _character(hexadecimal))
        .otherwise(F.coalesce(F.try_element_at(named, F.substring(part, 2, 40)), part))
    )


def unescaped(text: Column) -> Column:
    """Text with its character references decoded."""
    def decoded(whole):
        parts = F.regexp_extract_all(whole, F.lit(_REFERENCE), F.lit(0))
        return F.when(F.contains(whole, F.lit("&")), F.array_join(F.transform(parts, _referred), "")).otherwise(whole)

    return given(text, decoded)
