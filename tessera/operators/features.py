"""Features of query texts: type, clauses, triple patterns and terms by place, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import patch_parameters, query_type
from tessera.operators.graph import stored
from tessera.operators.tokenizer import TokenOptions, tokens

# Clause words of the query language.
CLAUSES = ("OPTIONAL", "FILTER", "UNION", "MINUS", "GRAPH", "SERVICE", "BIND", "VALUES", "DISTINCT", "REDUCED", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "FROM", "EXISTS")

# The vocabulary of collections.
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_FIRST_OF, _REST_OF, _NIL = f"<{_RDF}first>", f"<{_RDF}rest>", f"<{_RDF}nil>"


def query_features(text: Column) -> Column:
    """struct(type, clauses, iris, prefixed, literals, numbers, variables, n_triples).

    Sets are sorted and distinct. ``n_triples`` counts the ends of patterns: '.', ';' and ',' outside
    of parentheses between braces, and patterns that a brace ends.
    """
    found = tokens(patch_parameters(text), TokenOptions(sparql_parameters=False))
    solid = F.filter(found, lambda t: ~t.rlike(r"(?s)^(\s|#).*"))
    pick = lambda rx: F.array_sort(F.array_distinct(F.filter(solid, lambda t: t.rlike(rx))))
    words = F.transform(solid, lambda t: F.when(t.rlike(r"(?is)^VALUES\b.*"), F.lit("VALUES")).otherwise(F.upper(t)))
    ends = F.size(F.filter(solid, lambda t: t.isin(".", ";", ",")))
    open_ends = F.regexp_count(F.array_join(F.filter(solid, lambda t: ~t.rlike("^$")), " "), F.lit(r"[^\s.;,{}]\s+\}"))
    return F.struct(
        query_type(text, exact=True).alias("type"),
        F.array_sort(F.array_distinct(F.filter(words, lambda t: t.isin(*CLAUSES)))).alias("clauses"),
        pick(r"^<[^\s]*>$").alias("iris"),
        pick(r"^(?!_:)[^\s<\"'?$]*:.+").alias("prefixed"),
        pick(r"(?s)^[\"'].*").alias("literals"),
        pick(r"^[+-]?\.?[0-9]").alias("numbers"),
        pick(r"^[?$].").alias("variables"),
        (ends + open_ends).cast("long").alias("n_triples"),
    )


_PATTERN = "struct<subject:string,predicate:string,object:string>"
#: An open bracket: its kind (g group, b property list, c collection, x skipped, r the text itself), its subject, its
#: predicate (of a collection: whether it has an element), and what is expected in it.
_FRAME = "struct<kind:string,s:string,p:string,at:int>"
_SUBJECT, _VERB, _OBJECT, _DONE = 0, 1, 2, 3


def _classed(t: Column) -> Column:
    """struct(t, c): the token, and its class: a bracket or stop itself, path, term, or a word in capitals."""
    return F.struct(
        t.alias("t"),
        F.when(t.isin(*"{}[]().;,") | (t == "()"), t).when(t.isin(*"/|^!*+?"), F.lit("path")).when(t.rlike(r"^[A-Za-z]+$") & ~t.isin("a", "true", "false"), F.upper(t)).otherwise(F.lit("term")).alias("c"),
    )


def _next(x: Column, t: Column, c: Column) -> Column:
    """What a token does: struct(do, s, p, at, mode, push, told, used): ``do`` is push, pop or stay; s, p, at and mode are the top
    bracket's from then on, ``push`` the new bracket, ``told`` the patterns that it tells, ``used`` the blank nodes that it makes."""
    kind, s, p, at, mode = (x[k] for k in ("kind", "s", "p", "at", "mode"))
    label = lambda k: F.concat(F.lit("_:g"), (x["made"] + k).cast("string"))
    pattern = lambda a, b, o: F.struct(a.alias("subject"), b.alias("predicate"), o.alias("object"))
    frame = lambda k, subject=None, state=_SUBJECT: F.struct(F.lit(k).alias("kind"), (F.lit(None).cast("string") if subject is None else subject).alias("s"), F.lit(None).cast("string").alias("p"), F.lit(state).alias("at"))
    nothing, no_text = F.array().cast(f"array<{_PATTERN}>"), F.lit(None).cast("string")

    def to(do="stay", s=s, p=p, at=at, mode=mode, push=None, told=nothing, used=F.lit(0)):
        return F.struct(
            F.lit(do).alias("do"), s.alias("s"), p.alias("p"), (F.lit(at) if isinstance(at, int) else at).alias("at"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode"),
            (F.lit(None).cast(_FRAME) if push is None else push).alias("push"), told.alias("told"), used.alias("used"),
        )

    def element(e, push=None, made=0):
        """``e`` is the next element of a collection; all but the first get a cell of their own."""
        cell = label(made)
        first = to("push" if push is not None else "stay", p=F.lit("1"), push=push, told=F.array(pattern(s, F.lit(_FIRST_OF), e)), used=F.lit(made))
        more = to("push" if push is not None else "stay", s=cell, push=push, told=F.array(pattern(s, F.lit(_REST_OF), cell), pattern(cell, F.lit(_FIRST_OF), e)), used=F.lit(made + 1))
        return F.when(p.isNull(), first).otherwise(more)

    def opened(push):
        """A bracket in the place of a term: a new blank node."""
        e = label(0)
        return (
            F.when(kind == "c", element(e, push, 1))
            .when(at == _OBJECT, to("push", at=_DONE, push=push, told=F.array(pattern(s, p, e)), used=F.lit(1)))
            .otherwise(to("push", s=e, p=no_text, at=_VERB, push=push, used=F.lit(1)))
        )

    def term(e):
        return (
            F.when(kind == "c", element(e))
            .when(at == _VERB, to(p=e, at=_OBJECT))
            .when((at == _OBJECT) & p.rlike("[/|^!]$"), to(p=F.concat(p, e)))
            .when(at == _OBJECT, to(at=_DONE, told=F.array(pattern(s, p, e))))
            .otherwise(to(s=e, p=no_text, at=_VERB))
        )

    skip = frame("x")
    path_opens = (kind != "c") & ((at == _VERB) | ((at == _OBJECT) & p.rlike("[/|^!]$")))
    plain = (
        F.when(c == "{", to("push", at=_SUBJECT, push=frame("g")))
        .when(c == "}", to("pop"))
        .when(c == "[", opened(frame("b", label(0), _VERB)))
        .when(c == "]", F.when(kind == "b", to("pop")).otherwise(to()))
        .when((c == "(") & path_opens, to("push", p=F.concat(F.coalesce(p, F.lit("")), F.lit("()")), at=_OBJECT, push=skip))
        .when(c == "(", opened(frame("c", label(0))))
        .when(c == ")", F.when(kind == "c", to("pop", told=F.array(pattern(s, F.lit(_REST_OF), F.lit(_NIL))))).otherwise(to()))
        .when(c == "()", term(F.lit(_NIL)))
        .when(c == ".", to(s=no_text, p=no_text, at=_SUBJECT))
        .when(c == ";", F.when(at > _SUBJECT, to(p=no_text, at=_VERB)).otherwise(to()))
        .when(c == ",", F.when(at == _DONE, to(at=_OBJECT)).otherwise(to()))
        .when(c == "path", F.when(at.isin(_VERB, _OBJECT), to(p=F.concat(F.coalesce(p, F.lit("")), t), at=_OBJECT)).otherwise(to()))
        .when(c == "term", term(t))
        .when(c.isin("FILTER", "BIND"), to(at=_SUBJECT, mode="expression"))
        .when(c.isin("GRAPH", "SERVICE"), to(at=_SUBJECT, mode="name"))
        .when(c == "SELECT", to(at=_SUBJECT, mode="head"))
        .when(c.isin("GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET"), to(at=_SUBJECT, mode="tail"))
        .otherwise(to(at=_SUBJECT))
    )
    return (
        F.when(kind == "x", F.when(c.isin("(", "{"), to("push", push=skip)).when(c.isin(")", "}"), to("pop")).otherwise(to()))
        .when(mode == "head", F.when(c == "{", to("push", mode="", push=frame("g"))).when(c == "(", to("push", push=skip)).otherwise(to()))
        .when(mode == "tail", F.when(c == "}", to("pop", mode="")).when(c == "(", to("push", push=skip)).otherwise(to()))
        .when(mode == "expression", F.when(c.isin("(", "{"), to("push", mode="", push=skip)).when(c == "()", to(mode="")).otherwise(to()))
        .when((mode == "name") & (c != "{"), F.when(c == "SILENT", to()).otherwise(to(mode="")))
        .otherwise(plain)
    )


def _step(x: Column, token: Column) -> Column:
    def moved(n: Column) -> Column:
        own = F.struct(x["kind"].alias("kind"), n["s"].alias("s"), n["p"].alias("p"), n["at"].alias("at"))
        depth = F.size(x["stack"])
        popped = (n["do"] == "pop") & (depth > 0)
        top = F.when(n["do"] == "push", n["push"]).when(popped, F.get(x["stack"], depth - 1)).otherwise(own)
        stack = F.when(n["do"] == "push", F.concat(x["stack"], F.array(own))).when(popped, F.slice(x["stack"], F.lit(1), depth - 1)).otherwise(x["stack"])
        return F.struct(*[top[k].alias(k) for k in ("kind", "s", "p", "at")], n["mode"].alias("mode"), (x["made"] + n["used"]).alias("made"), stack.alias("stack"), F.concat(x["told"], n["told"]).alias("told"))

    return F.get(F.transform(F.array(_next(x, token["t"], token["c"])), moved), F.lit(0))


def triple_patterns(text: Column) -> Column:
    """array<struct<subject, predicate, object>> of the patterns in a query's WHERE part, in order; null texts give null.

    The tokens are folded over with a stack of open brackets, so groups, property lists of blank nodes and
    collections nest as deep as they like. Terms are as the text has them; a blank node without a label is _:g and
    its number in the text, and a collection is a chain of such nodes under rdf:first and rdf:rest. Path operators stay with
    their predicate, a path in parentheses is '()'. What stands in FILTER (EXISTS too), BIND, VALUES and the
    solution modifiers makes no pattern, nor does the template of a CONSTRUCT.
    """
    return _folded(F.transform(_solid_body(text), _classed))


def _solid_body(text: Column) -> Column:
    """The tokens from the WHERE part on, without blanks, comments and VALUES; an empty pair of parentheses is one token."""
    solid = F.filter(tokens(patch_parameters(text)), lambda t: ~t.rlike(r"^[\s#]") & ~(t.contains("{") & t.rlike(r"(?is)^VALUES\b.*\{")))

    # the template of a CONSTRUCT and the head of any query end at WHERE or at the first brace
    def body(found: Column) -> Column:
        where, brace = F.array_position(F.transform(found, F.upper), "WHERE"), F.array_position(found, "{")
        begin = F.coalesce(F.when(query_type(text, exact=True) == "C", F.nullif(where, F.lit(0))), brace).cast("int")
        return F.when(begin > 0, F.slice(found, begin, F.size(found))).otherwise(F.slice(found, F.lit(1), F.lit(0)))

    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    pairs = lambda b: F.filter(F.transform(b, lambda t, i: F.when((t == "(") & (F.get(b, i + 1) == ")"), "()").when((t == ")") & (i > 0) & (F.get(b, i - 1) == "("), "").otherwise(t)), lambda t: t != "")
    return F.when(text.isNotNull(), bound(bound(solid, body), pairs))


def _folded(classed: Column) -> Column:
    """The patterns that classed tokens tell."""
    start = F.struct(
        F.lit("r").alias("kind"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("p"), F.lit(_SUBJECT).alias("at"), F.lit("").alias("mode"), F.lit(0).alias("made"),
        F.array().cast(f"array<{_FRAME}>").alias("stack"), F.array().cast(f"array<{_PATTERN}>").alias("told"),
    )
    return F.aggregate(classed, start, _step, lambda x: x["told"])


# Marks of a shape: a term, and a term that ends as an open path does. The k-th token's term is _AT k _END (or k /) in a pattern.
_TERM, _OPEN, _AT, _END = "\x01", "\x02", "\x01", "\x02"
#: Characters of shapes that are broadcast at most.
SHAPE_CHARACTERS = 4_000_000


def _marked(text: Column) -> Column:
    """struct(shape, terms): the tokens with all terms as marks, in a row, and the terms in their places (null elsewhere)."""

    def mark(t: Column) -> Column:
        x = _classed(t)
        return F.struct(t.alias("t"), F.when(x["c"] == "term", F.when(t.rlike(r"[/|^!]$"), _OPEN).otherwise(_TERM)).when(x["c"] == "path", t).otherwise(x["c"]).alias("m"))

    both = lambda found: F.struct(
        F.array_join(F.transform(found, lambda x: x["m"]), " ").alias("shape"), F.transform(found, lambda x: F.when(x["m"].isin(_TERM, _OPEN), x["t"])).alias("terms")
    )
    return F.get(F.transform(F.array(F.transform(_solid_body(text), mark)), both), F.lit(0))


def _shape_patterns(shape: Column) -> Column:
    """The patterns of a shape; each part is a term's place (``at``), a text of its own, or several of these (``parts``)."""
    marks = F.filter(F.split(shape, " "), lambda m: m != "")
    place = lambda i, end: F.concat(F.lit(_AT), i.cast("string"), F.lit(end))
    classed = F.transform(marks, lambda m, i: F.when(m == _TERM, F.struct(place(i, _END).alias("t"), F.lit("term").alias("c"))).when(m == _OPEN, F.struct(place(i, "/").alias("t"), F.lit("term").alias("c"))).otherwise(_classed(m)))
    number = rf"^([0-9]+)[{_END}/]"

    def part(s: Column) -> Column:
        cut = F.transform(F.split(s, _AT), lambda x, i: F.struct(F.when(i > 0, F.regexp_extract(x, number, 1).cast("int")).alias("at"), F.when(i > 0, F.regexp_replace(x, number, "")).otherwise(x).alias("text")))
        one = s.rlike(rf"^{_AT}[0-9]+[{_END}/]\z")
        return F.struct(F.when(one, F.get(cut, F.lit(1))["at"]).alias("at"), F.when(~s.contains(_AT), s).alias("text"), F.when(~one & s.contains(_AT), cut).alias("parts"))

    return F.transform(_folded(classed), lambda p: F.struct(*[part(p[c]).alias(c) for c in ("subject", "predicate", "object")]))


def patterns_by_shape(queries: DataFrame) -> DataFrame:
    """The queries (column ``text``) with ``patterns`` in its place: as :func:`triple_patterns` gives them.

    What the fold does depends on the kinds of the tokens only, so texts that differ in their terms share one: each distinct
    shape is folded once, and its patterns are filled with the terms of each of its texts. Texts whose shapes are all different are
    folded one by one, as there. Null texts are left out.
    """
    others = [c for c in queries.columns if c != "text"]
    marked = stored(queries.filter("text is not null").select(*others, _marked(F.col("text")).alias("_m")).select(*others, "_m.*"))
    shapes = marked.groupBy("shape").agg(F.count("*").alias("_n")).select("shape")
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = stored(shapes.repartition(n, F.xxhash64("shape")).select("shape", _shape_patterns(F.col("shape")).alias("_told")))
    small = known.agg(F.coalesce(F.sum(F.length("shape")), F.lit(0))).first()[0] <= SHAPE_CHARACTERS
    term = lambda x: F.coalesce(F.get("terms", x["at"]), x["text"])
    fill = lambda x: F.coalesce(term(x), F.array_join(F.transform(x["parts"], lambda y: F.concat(F.coalesce(F.get("terms", y["at"]), F.lit("")), y["text"])), ""))
    filled = F.transform("_told", lambda p: F.struct(*[fill(p[c]).alias(c) for c in ("subject", "predicate", "object")]))
    return marked.join(F.broadcast(known) if small else known, "shape").select(*others, filled.alias("patterns"))


def term_kind(term: Column) -> Column:
    """variable, literal, blank, path or iri."""
    return (
        F.when(term.rlike(r"^[?$]"), "variable")
        .when(term.rlike(r"(?is)^([\"']|[+-]?\.?[0-9]|(true|false)$)"), "literal")
        .when(term.rlike(r"^(_:|\[)"), "blank")
        .when(term.rlike(r"^(<[^>]*>|a|[^\s<>/|^!*+?()]*:[^\s/|^!*+?()]*)$"), "iri")
        .otherwise("path")
    )


def spread(queries: DataFrame) -> DataFrame:
    """``queries`` dealt to as many tasks as the session's shuffles have: texts are small but dear to read, and adaptive
    planning, which counts bytes, would give them to a few."""
    return queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("text"))  # a hash: dealing by the text itself again is planned away after a grouping by it


def terms_by_place(queries: DataFrame, *keys: str) -> DataFrame:
    """keys, place (subject_object or predicate), kind, term, num_queries: the union of the terms of all
    queries (column ``text``, one row a query) in each group of ``keys``."""
    placed = lambda place, term: F.struct(F.lit(place).alias("place"), term.alias("term"))
    of_pattern = lambda t: F.array(placed("subject_object", t["subject"]), placed("predicate", t["predicate"]), placed("subject_object", t["object"]))
    # a query's repeats go within its row, so that one grouping with partial counts is all that moves
    each = F.array_distinct(F.flatten(F.transform("patterns", of_pattern)))
    rows = patterns_by_shape(spread(queries.select(*keys, "text"))).select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
    return rows.groupBy(*keys, "place", "term").agg(F.count("*").alias("num_queries")).select(*keys, "place", term_kind(F.col("term")).alias("kind"), "term", "num_queries")
