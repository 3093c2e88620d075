"""Cutting query texts into pieces of text and constants, in built-in expressions only.

One alternation of possessive patterns (they need no stack in Java, however long a literal is) finds
the tokens; array functions part the prologue from the body and the constants from the text. The
concatenated tokens are the input again. ``decompose_text`` says the same in plain Python and is
what the tests hold the expressions against.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENT = r"#[^\n\r]*+"
_BLANK = r"\s++"
_SKIP = rf"(?:{_BLANK}|{_COMMENT})*+"
_IRI = r"<[^<>\"{}|^`\\\x00-\x20]*+>"
_STRING = (
    r"(?:\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''"
    r"|\"(?:[^\"\\\n\r]++|\\.)*+\"|'(?:[^'\\\n\r]++|\\.)*+')"
)
_LANG = r"@[A-Za-z]++(?:-[A-Za-z0-9]++)*+"
_VARIABLE = r"[?$]\w++"
_BLANK_NODE = r"_:[\w-](?:[\w-]|\.(?=\.*+[\w-]))*+"
_NUMBER = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?[eE][+-]?[0-9]++|\.[0-9]++[eE][+-]?[0-9]++|[0-9]*\.[0-9]++|[0-9]++)(?![\w:])"
_PREFIX = r"(?:[^\W\d_](?:[\w-]|\.(?=\.*+[\w-]))*+)?"
_LOCAL = r"(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?#@%]|\.(?=\.*+[\w:%\\-]))"
_NAME = rf"{_PREFIX}:{_LOCAL}*+"
_FULL_NAME = rf"{_PREFIX}:{_LOCAL}++"
_OPAQUE = rf"{_STRING}|{_IRI}|{_COMMENT}"
#: VALUES up to its brace, and the braces (to the end of the text if they are never closed).
_VALUES_HEAD = rf"(?i:VALUES)(?![\w:])(?:[^{{\"'<#]++|{_OPAQUE}|[\"'<#])*+"
_VALUES_BODY = rf"\{{(?:[^}}\"'<#]++|{_OPAQUE}|[\"'<#])*+(?:\}}|\Z)"
_TAIL = rf"(?:{_SKIP}(?:{_LANG}|\^\^{_SKIP}(?:{_IRI}|{_FULL_NAME})))?+"
_QUERY_WORDS = ("SELECT", "CONSTRUCT", "ASK", "DESCRIBE")


@dataclass(frozen=True)
class TokenOptions:
    """``sparql_parameters``: a literal with its language tag or datatype is one constant.
    ``max_tokens``: text after so many tokens is dropped (0: none is)."""

    exclude_preamble: bool = True
    sparql_parameters: bool = True
    max_tokens: int = 0


def _pattern(options: TokenOptions) -> str:
    literal = _STRING + (_TAIL if options.sparql_parameters else "")
    return "|".join(
        [_COMMENT, _BLANK, _IRI, literal, r"\^\^", _LANG, _VARIABLE, _BLANK_NODE, _NUMBER, _VALUES_HEAD + _VALUES_BODY, _NAME, r"\w++", r"&&|\|\||!=|<=|>=", r"."]
    )


_CONSTANT = rf"(?:{_IRI}|{_STRING}{_TAIL}|{_NUMBER}|(?!_:){_FULL_NAME})"
_VALUES = rf"({_VALUES_HEAD})({_VALUES_BODY})"
_SPACED_TAIL = rf"^({_STRING}){_SKIP}(\^\^)?+{_SKIP}"


def _java(pattern: str) -> str:
    return "(?sU)" + pattern.replace(r"\Z", r"\z")


def tokens(text: Column, options: TokenOptions = TokenOptions()) -> Column:
    """All tokens of a text, blanks and comments too."""
    return F.regexp_extract_all(text, F.lit(_java(f"(?:{_pattern(options)})")), F.lit(0))


def decompose(text: Column, options: TokenOptions = TokenOptions()) -> Column:
    """struct(pieces, constants, preamble): one piece more than constants; null texts give null.

    The preamble is all text before the first SELECT, CONSTRUCT, ASK or DESCRIBE; if it is no
    prologue it goes back in front of the first piece, once.
    """
    mark = "\x01"
    found = tokens(text, options)
    if options.max_tokens:
        found = F.slice(found, 1, options.max_tokens)
    is_query_word = lambda t: F.length(t).between(3, 9) & F.upper(t).isin(*_QUERY_WORDS)
    first = F.coalesce(F.array_position(F.transform(found, is_query_word), True), F.lit(0)).cast("int")

    def parts(all_tokens: Column, begin: Column) -> Column:
        cut = F.when(begin > 0, begin - 1).otherwise(F.size(all_tokens))
        preamble = F.array_join(F.slice(all_tokens, F.lit(1), cut), "")
        body = F.slice(all_tokens, cut + 1, F.size(all_tokens))
        constant = _java(rf"^{_CONSTANT}\z")
        values = _java(rf"^{_VALUES}\z")

        # most tokens are words and blanks: only those that may be a constant are matched
        maybe = lambda t: F.substring(t, 1, 1).isin(*"<\"'+-.0123456789") | t.contains(":")

        def classed(t: Column) -> Column:
            """struct(text, constant): the text comes before the constant; one of them is empty or null but for VALUES."""
            tidy = F.regexp_replace(t, _java(_SPACED_TAIL), "$1$2") if options.sparql_parameters else t
            one = lambda x, c: F.struct(x.alias("text"), c.alias("constant"))
            return (
                F.when(t.contains("{") & t.rlike(values), one(F.regexp_extract(t, values, 1), F.regexp_extract(t, values, 2)))
                .when(maybe(t) & t.rlike(constant), one(F.lit(""), tidy))
                .otherwise(one(t, F.lit(None).cast("string")))
            )

        return F.struct(preamble.alias("preamble"), is_prologue(preamble).alias("proper"), F.transform(body, classed).alias("flat"))

    # each step is computed once: bound as the argument of a one-element transform
    bound = F.transform(F.array(F.struct(found.alias("t"), first.alias("f"))), lambda s: parts(s["t"], s["f"]))[0]

    without_mark = lambda x: F.when(x.contains(mark), F.translate(x, mark, "")).otherwise(x)

    def assemble(s: Column) -> Column:
        body = F.array_join(F.transform(s["flat"], lambda x: F.when(x["constant"].isNull(), without_mark(x["text"])).otherwise(F.concat(without_mark(x["text"]), F.lit(mark)))), "")
        keep = F.lit("") if options.exclude_preamble else s["preamble"]
        head = F.when(s["proper"], keep).otherwise(s["preamble"])
        return F.struct(
            F.split(F.concat(without_mark(head), body), mark, -1).alias("pieces"),
            F.transform(F.filter(s["flat"], lambda x: x["constant"].isNotNull()), lambda x: x["constant"]).alias("constants"),
            F.when(s["proper"], s["preamble"]).otherwise(F.lit("")).alias("preamble"),
        )

    return F.when(text.isNotNull(), F.transform(F.array(bound), assemble)[0])


_DECLARATION = rf"(?i:BASE){_SKIP}{_IRI}|(?i:PREFIX){_SKIP}{_PREFIX}:{_SKIP}{_IRI}"


def is_prologue(preamble: Column) -> Column:
    """Whether nothing but declarations, blanks and comments is in it."""
    return preamble.rlike(_java(rf"\A(?:{_DECLARATION}|{_BLANK}|{_COMMENT})*+\Z"))


def prologue_prefixes(preamble: Column) -> Column:
    """array<struct<name, iri>> of the PREFIX declarations in order."""
    rx = _java(rf"(?i:PREFIX){_SKIP}({_PREFIX}):{_SKIP}<([^<>]*+)>")
    return F.zip_with(
        F.regexp_extract_all(preamble, F.lit(rx), F.lit(1)), F.regexp_extract_all(preamble, F.lit(rx), F.lit(2)), lambda n, i: F.struct(n.alias("name"), i.alias("iri"))
    )


def prologue_base(preamble: Column) -> Column:
    """The last BASE, null if there is none."""
    found = F.regexp_extract_all(preamble, F.lit(_java(rf"(?i:BASE){_SKIP}<([^<>]*+)>")), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def decompose_text(text: str, options: TokenOptions = TokenOptions()) -> tuple[list[str], list[str], str]:
    """Pieces, constants and preamble of one text, token by token."""
    found = [m[0] for m in re.finditer(_pattern(options), text, re.S)]
    if options.max_tokens:
        found = found[: options.max_tokens]
    first = next((i for i, t in enumerate(found) if t.upper() in _QUERY_WORDS), len(found))
    preamble, pieces, constants = "".join(found[:first]), [""], []
    for t in found[first:]:
        values = re.fullmatch(_VALUES, t, re.S)
        if values:
            pieces[-1] += values[1]
            t = values[2]
        if values or re.fullmatch(_CONSTANT, t, re.S):
            if options.sparql_parameters and not values:
                t = re.sub(_SPACED_TAIL, lambda m: m[1] + (m[2] or ""), t, flags=re.S)
            constants.append(t)
            pieces.append("")
        else:
            pieces[-1] += t
    proper = not re.sub(f"{_DECLARATION}|{_BLANK}|{_COMMENT}", "", preamble, flags=re.S)
    if not proper or not options.exclude_preamble:
        pieces[0] = preamble + pieces[0]
    return pieces, constants, preamble if proper else ""
