"""RDF and log files as DataFrames: N-Triples and N-Quads (plain, bz2, gz), CSV, JSON prefix maps, TriG catalogs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import RDF_TYPE, SERVICE, XSD, unescape_literal

_TERM = r"(<[^>]*>|_:[^\s]+)"
_OBJECT = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"(?s)^\s*{_TERM}\s+(<[^>]*>)\s+{_OBJECT}(?:\s+{_TERM})?\s*\.\s*(?:#.*)?$"
QUERIES_CSV = "id string, text string, numOfExecutions bigint, timeOfFirstExecution timestamp, timeOfLastExecution timestamp"
EXECUTIONS_CSV = "queryId string, time timestamp, host string"
DATASETS_CSV = "dataset string, datasetId string, endpoint string, prefixesJson string"
CLUSTERS_CSV = "groupId int, query string"
CLUSTERS_URI_CSV = "groupId int, queryURI string, query string"
LAYOUT_CSV = "dataset string, level int, label string"


def _iri(term, base):
    """An IRI without its brackets; one that is not absolute is replaced by the base."""
    bare = F.regexp_extract(term, "^<(.*)>$", 1)
    return F.when(term.startswith("_:"), term).when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$"), bare).otherwise(base)


def parse_lines(lines: DataFrame, base: str | None = None, graph: str | None = None) -> DataFrame:
    """g, s, p, o_kind, o_value, o_datatype, o_lang, bad of each statement among the lines (column ``value``).

    Comments and blank lines are left out; a line that cannot be read has ``bad`` true and nulls.
    Further columns of ``lines`` stay.
    """
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    o, fallback = F.col("_o"), F.lit(base)
    read = rows.select(*lines.columns, part(1).alias("_s"), part(2).alias("_p"), part(3).alias("_o"), part(4).alias("_g"))
    literal = o.startswith('"')
    text = F.regexp_extract(o, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    lang = F.regexp_extract(o, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1)
    datatype = F.regexp_extract(o, r'(?s)^".*"\^\^<([^>]*)>$', 1)
    return read.select(
        *[c for c in lines.columns if c != "value"],
        F.when(F.col("_g") != "", _iri(F.col("_g"), fallback)).otherwise(F.lit(graph)).alias("g"),
        F.when(F.col("_s") != "", _iri(F.col("_s"), fallback)).alias("s"),
        F.when(F.col("_p") != "", _iri(F.col("_p"), fallback)).alias("p"),
        F.when(literal, "literal").when(o.startswith("_:"), "bnode").when(o != "", "iri").alias("o_kind"),
        F.when(literal, unescape_literal(text)).when(o != "", _iri(o, fallback)).alias("o_value"),
        F.when(literal, F.when(datatype != "", datatype).when(lang != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.lit(XSD + "string"))).alias("o_datatype"),
        F.when(lang != "", lang).alias("o_lang"),
        (o == "").alias("bad"),
    )


def read_triples(spark: SparkSession, path: str, base: str | None = None, graph: str | None = None) -> DataFrame:
    """Statements of N-Triples or N-Quads files, compressed or not, with ``file`` and ``line``.

    ``line`` grows in the order of a file (within a file it is ordered, not dense).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return parse_lines(lines, base, graph)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with quoted newlines, commas and doubled quotes, under a fixed schema. With ``multi_line`` a file is one task; a
    large dump without newlines in its fields is read in many without it."""
    return spark.read.schema(schema).option("header", header).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)


def read_directory(spark: SparkSession, path: str, schema: str, suffix: str, header: bool = True, multi_line: bool = True) -> DataFrame:
    """All files below ``path`` that end in ``suffix``, with ``name``: the file's name without it."""
    glob = re.sub(r"[\[\]{}*?\\]", "?", suffix)
    rows = spark.read.schema(schema).option("header", header).option("multiLine", multi_line).option("escape", '"').option("pathGlobFilter", f"*{glob}").csv(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), f"^(.*){re.escape(suffix)}$", 1).alias("name"))


def lines_without(lines: DataFrame, *marks: str) -> DataFrame:
    """Lines (column ``value``) that hold none of the marks; null lines stay."""
    held = F.lit(False)
    for mark in marks:
        held = held | F.coalesce(F.contains(F.col("value"), F.lit(mark)), F.lit(False))
    return lines.filter(~held)


def _quoted(text: str) -> str:
    """Text as a pattern of itself, in Java."""
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


def catalog_of_files(spark: SparkSession, path: str, graph: str, base: str, suffix: str = ".nt") -> DataFrame:
    """g, s, p, o: the catalog ``graph`` lists each file in ``path`` that ends in ``suffix`` as a named graph.

    A dataset's IRI is ``base`` and the file's name without the suffix. A folder of that name is one file too, as tables are that
    were written in parts; the names of its parts are not looked at. Files are listed, not read.
    """
    folder = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", re.sub("(?<![:/])/+", "/", path)).rstrip("/")
    above = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" if folder.startswith("/") or not folder else r"^.*?/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))
    files = listed.select(F.regexp_extract("path", f"{above}{_quoted(folder)}/([^/]+)", 1).alias("name")).distinct()
    iri = F.concat(F.lit(base), F.regexp_extract("name", f"^(.*){re.escape(suffix)}$", 1))
    row = lambda s, p, o: F.struct(F.lit(graph).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    both = F.array(row(F.lit(base), SERVICE + "namedGraph", iri), row(iri, RDF_TYPE, F.lit(SERVICE + "NamedGraph")))
    return files.filter(F.endswith("name", F.lit(suffix))).select(F.explode(both).alias("t")).select("t.*")


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """name, iri of a JSON object of prefixes."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("name", "iri"))


def prefixes_of_json(column):
    """A JSON object column as map<string, string>; null for what is none."""
    return F.from_json(column, "map<string,string>")


def parse_trig(text: str, graph: str | None = None) -> list[tuple[str | None, str, str, str]]:
    """(g, s, p, o) of a small TriG catalog: prefixes, graph blocks, ; and , lists, IRIs, names, plain literals."""
    token = re.compile(r'#[^\n]*|\s+|<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^\S+?(?=[\s;,.\]]))?|@?[A-Za-z][\w-]*:(?:[\w/.-]*[\w/-])?|:[\w/.-]*[\w/-]|@?[A-Za-z]+|[{}.;,]')
    found = [t for t in token.findall(text) if t.strip() and not t.startswith("#")]
    prefixes: dict[str, str] = {}
    out: list[tuple[str | None, str, str, str]] = []

    def term(t: str) -> str:
        if t == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        if t.startswith("<"):
            return t[1:-1]
        if t.startswith('"'):
            return json.loads(re.match(r'"(?:[^"\\]|\\.)*"', t)[0])
        name, _, local = t.partition(":")
        return prefixes.get(name, name + ":") + local

    i, s, p = 0, None, None
    while i < len(found):
        t = found[i]
        if t.lower() in ("@prefix", "prefix"):
            prefixes[found[i + 1].rstrip(":")] = found[i + 2][1:-1]
            i += 3 + (i + 3 < len(found) and found[i + 3] == ".")
        elif t.lower() == "graph":
            i += 1
        elif t == "{":
            graph, s, p = (s if s is not None else graph), None, None
            i += 1
        elif t == "}":
            graph, s, p = None, None, None
            i += 1
        elif t == ".":
            s = p = None
            i += 1
        elif t == ";":
            p = None
            i += 1
        elif t == ",":
            i += 1
        elif s is None:
            s = term(t)
            i += 1
        elif p is None:
            p = term(t)
            i += 1
        else:
            out.append((graph, s, p, term(t)))
            i += 1
    return out


def read_trig(spark: SparkSession, path: str) -> DataFrame:
    """g, s, p, o of TriG files; each is small and parsed whole."""

    @F.udf("array<struct<g:string,s:string,p:string,o:string>>")
    def parsed(text: str):
        return parse_trig(text or "")

    return spark.read.text(path, wholetext=True).select(F.explode(parsed("value")).alias("t")).select("t.*")
