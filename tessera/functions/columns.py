"""Scalar and aggregate column functions of the query log's domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the log.
LSQV = "http://lsq.aksw.org/vocab#"
PROV = "http://www.w3.org/ns/prov#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
DATASETS = "http://lsq.aksw.org/datasets/"
SERVICE = "http://www.w3.org/ns/sparql-service-description#"


def parameter_label(index: Column, sparql: bool = True) -> Column:
    """$__PARAM_i, or <PARAM_i> in the older notation."""
    return F.concat(F.lit("$__PARAM_"), index.cast("string")) if sparql else F.concat(F.lit("<PARAM_"), index.cast("string"), F.lit(">"))


def template_text(pieces: Column, parameter_by_position: Column) -> Column:
    """Pieces with the labels of their parameters in between."""
    labelled = F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces)), parameter_by_position, lambda piece, p: F.concat(parameter_label(p), piece))
    return F.concat(F.element_at(pieces, 1), F.array_join(labelled, ""))


def identity_parameters(constants: Column) -> Column:
    """Each position its own parameter."""
    return F.when(F.size(constants) > 0, F.sequence(F.lit(0), F.size(constants) - 1)).otherwise(F.array().cast("array<int>"))


def cast_term(value: Column, datatype: Column, to: str) -> Column:
    """A literal's value as ``to`` where its datatype allows that, else null; booleans by their spelling."""
    kinds = {"bigint": ["integer", "int", "long", "nonNegativeInteger"], "double": ["decimal", "double", "float", "integer", "int", "long"], "boolean": ["boolean"], "timestamp_ntz": ["dateTime"], "date": ["date"]}
    return F.when(datatype.isin(*[XSD + k for k in kinds[to]]), value.try_cast(to))


def entropy(weight: Column) -> Column:
    """Aggregate: Shannon entropy in bits of the shares of ``weight``; 0 if there is none."""
    total = F.sum(weight)
    parts = F.sum(F.when(weight > 0, weight * F.ln(weight)))
    return F.when(total > 0, (F.ln(total) - parts / total) / F.ln(F.lit(2.0))).otherwise(F.lit(0.0))


def information_gain(executions: Column, instances: Column, sum_log2: Column) -> Column:
    """Aggregate: bits that the instances of a template tell beyond the template, weighted by executions."""
    return F.sum(executions * (instances * F.log2(executions) - sum_log2)) / F.sum(executions)


def query_type(text: Column, exact: bool = False) -> Column:
    """C, A, D or S: by a search for the words in this order, or with ``exact`` by the first of them as a word."""
    if exact:
        word = F.upper(F.regexp_extract(text, r"(?i)\b(SELECT|CONSTRUCT|ASK|DESCRIBE)\b", 1))
        return F.when(word != "", F.substring(word, 1, 1))
    up = F.upper(text)
    return F.when(up.contains("CONSTRUCT"), "C").when(up.contains("ASK"), "A").when(up.contains("DESCRIBE"), "D").when(up.contains("SELECT"), "S")


def escape_literal(value: Column) -> Column:
    """A Turtle literal: backslash, quote, newline, carriage return and tab escaped, in quotes."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return F.concat(F.lit('"'), out, F.lit('"'))


def unescape_literal(value: Column) -> Column:
    """The inverse, on the text between the quotes; \\u and \\U escapes stay as they are."""
    hold = "\x02"
    out = F.replace(value, F.lit("\\\\"), F.lit(hold))
    for raw, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return F.replace(out, F.lit(hold), F.lit("\\"))


def escape_iri_fragment(value: Column) -> Column:
    """Characters that an IRI cannot hold, percent-encoded."""
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))


def safe_id(value: Column) -> Column:
    """Hyphens as underscores."""
    return F.replace(value, F.lit("-"), F.lit("_"))


#: Scheme, authority, path, query and fragment of a reference, with the marks that tell whether a part is there.
_REFERENCE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _without_dots(path: Column) -> Column:
    """The path without '.' and '..' segments."""
    rooted = path.startswith("/")
    segments = F.split(F.when(rooted, F.substr(path, F.lit(2))).otherwise(path), "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda held, s: F.when(s == ".", held).when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(s))),
    )
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def resolve_reference(reference: Column, base: Column) -> Column:
    """A reference resolved against a base as RFC 3986 (5.2) says; without a base only absolute ones are known, others null."""
    part = lambda x, k: F.regexp_extract(x, _REFERENCE, k)
    scheme, authority, path, query, fragment = (part(reference, k) for k in range(1, 6))
    base_path = part(base, 3)
    merged = F.when((part(base, 2) != "") & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(base_path, r"(?s)^(.*/)?[^/]*$", 1), path))
    same = (scheme == "") & (authority == "")
    return F.concat(
        F.when(scheme != "", scheme).otherwise(part(base, 1)),
        F.when(same, part(base, 2)).otherwise(authority),
        F.when(~same | path.startswith("/"), _without_dots(path)).when(path == "", base_path).otherwise(_without_dots(merged)),
        F.when(same & (path == "") & (query == ""), part(base, 4)).otherwise(query),
        fragment,
    )


def rebase_term(term: Column, prefixes: Column, base: Column | None = None) -> Column:
    """A prefixed name, relative or full IRI or literal as a full RDF term; null for an unknown prefix, and for a relative IRI without a base."""
    name = F.regexp_extract(term, r"^([^:<\"']*):", 1)
    known = F.element_at(F.filter(prefixes, lambda p: p["name"] == name), -1)["iri"]
    local = F.regexp_replace(F.regexp_extract(term, r"(?s)^[^:]*:(.*)$", 1), r"\\(.)", "$1")
    relative = F.concat(F.lit("<"), resolve_reference(F.regexp_extract(term, r"(?s)^<(.*)>$", 1), base if base is not None else F.lit(None).cast("string")), F.lit(">"))
    some = F.exists(prefixes, lambda p: p["name"] == name)
    return (
        F.when(term.rlike(r"^<[A-Za-z][A-Za-z0-9+.-]*:"), term)
        .when(term.startswith("<"), relative)
        .when(term.rlike("^[\"'+\\-0-9.]"), term)
        .when(some, F.concat(F.lit("<"), known, local, F.lit(">")))
    )


def patch_parameters(text: Column) -> Column:
    """A query with parameters in LIMIT, OFFSET and VALUES made parseable: numbers and an empty block in their place."""
    number = F.regexp_replace(text, r"(?i)\b(LIMIT|OFFSET)(\s+)\$\w+", "$1$2 1")
    return F.regexp_replace(number, r"(?i)(VALUES\s+(?:[?$]\w+|\([^)]*\))\s*)\$\w+", "$1{}")
