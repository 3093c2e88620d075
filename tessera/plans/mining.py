"""The drivers: template mining end to end, generalization over the lattice, and by cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import rebase_term
from tessera.operators import lattice, templates
from tessera.operators.graph import few, join_by, stored
from tessera.operators.specialize import Forest, grow_forest
from tessera.operators.tokenizer import TokenOptions, prologue_base, prologue_prefixes


@dataclass(frozen=True)
class MiningOptions:
    exclude_preamble: bool = True
    sparql_parameters: bool = True
    max_tokens: int = 0
    min_instances: int = 0
    min_executions: int = 0
    include_simple_queries: bool = False
    min_executions_for_simple_queries: int = 0
    generalization_tree: bool = False
    min_instances_in_subclass: int | None = None
    min_executions_in_subclass: int | None = None
    max_levels: int | None = None
    max_vars: int = 3
    min_binding_divergence_ratio: float | None = None

    @property
    def tokens(self) -> TokenOptions:
        return TokenOptions(self.exclude_preamble, self.sparql_parameters, self.max_tokens)


@dataclass(frozen=True)
class Mined:
    """``templates``: one row each; ``instances``: with reduced bindings; ``simple``: ids of queries without a
    template of their own kept, or None; ``forest`` of specializations, or None; ``keys``: what templates are told apart by."""

    templates: DataFrame
    instances: DataFrame
    simple: DataFrame | None
    forest: Forest | None
    keys: tuple[str, ...] = ()

    @property
    def nodes(self) -> DataFrame | None:
        return self.forest and self.forest.nodes

    @property
    def edges(self) -> DataFrame | None:
        return self.forest and self.forest.edges


def mine_templates(usage: DataFrame, options: MiningOptions = MiningOptions(), keys: tuple[str, ...] = ("dataset",)) -> Mined:
    """Queries (id, text, num_exec, t_first, t_last and ``keys``) to templates, all keys in one job.

    Each text is cut into tokens once, into a table of instances that all later steps read.
    """
    inst = stored(templates.generalize(usage, options.tokens, keys))
    of = [*keys, "template"]
    rolled = templates.above_thresholds(templates.roll_up(inst, keys), options.min_instances, options.min_executions)
    below = options.min_instances > 1 or options.min_executions > 0
    kept = join_by(inst, rolled.select(*of), of, "left_semi") if below else inst
    texts = templates.simplified_templates(kept, keys).withColumnRenamed("text", "body")
    preambles = templates.merged_preambles(kept, "id", keys)
    out = join_by(join_by(rolled, texts, of), preambles, of)
    prologue = templates.prologue_text(F.col("base"), F.col("prefixes"))
    out = out.withColumn("text", F.concat(prologue, F.lit("\n"), F.col("body"))).withColumn("template_id", F.xxhash64(*of))
    simple = None
    if options.include_simple_queries:
        simple = templates.simple_queries(inst, options.min_instances, options.min_executions, options.min_executions_for_simple_queries, keys)
    forest = None
    if options.generalization_tree:
        forest = grow_forest(
            kept,
            options.min_instances_in_subclass or max(options.min_instances, 1),
            options.min_executions_in_subclass or max(options.min_executions, 1),
            options.max_levels,
            keys,
        )
    return Mined(out, templates.simplify(kept, keys), simple, forest, keys)


def mine_by_cluster(rows: DataFrame, options: MiningOptions = MiningOptions(), start_from: int = 0) -> Mined:
    """groupId, query: each cluster mined by itself, a query counting as one execution; clusters from ``start_from`` on."""
    usage = rows.filter(F.col("groupId") >= start_from).select(
        "groupId", F.md5(F.col("query").cast("binary")).alias("id"), F.col("query").alias("text"), F.lit(1).cast("long").alias("num_exec"), F.lit(None).cast("timestamp_ntz").alias("t_first"), F.lit(None).cast("timestamp_ntz").alias("t_last")
    )
    return mine_templates(usage, options, ("groupId",))


def generalize_and_aggregate(usage: DataFrame, options: MiningOptions = MiningOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates of the generalization lattice that diverge and pass the thresholds, the edges between them (child,
    parent) and the roots."""
    texts, general = lattice.supported_generalizations(usage, options.tokens, options.max_vars, options.min_instances, options.min_executions, options.include_simple_queries)
    if options.min_binding_divergence_ratio:  # without a ratio all diverge: no parameter of theirs has one value
        of = general.join(texts.select("k1", "k2", "vector"), ["k1", "k2"])
        bound = of.select(F.struct("k1", "k2").alias("template"), lattice.bound_values(F.col("vector"), F.col("constants")).alias("bindings"))
        passing = templates.divergent(bound, options.min_binding_divergence_ratio).select("template.k1", "template.k2")
        texts = texts.join(passing, ["k1", "k2"], "left_semi")
    text = lattice.general_text(F.col("pieces"), F.col("constants"), F.col("vector"), options.sparql_parameters)
    kept = stored(templates.above_thresholds(texts, options.min_instances, options.min_executions).withColumn("template", text))
    edges, roots = lattice.supported_edges(general, kept)
    return kept.select("template", "num_instances", "num_exec"), edges, roots


#: Subject, predicate, kind and value of the object of a statement.
Fact = tuple[Column, str, str, Column]


def _facts(df: DataFrame, carried: list[str], *facts: Fact) -> DataFrame:
    """The statements of each row, all in one pass over ``df``; those without a value fall away."""
    each = [F.struct(s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), o.cast("string").alias("o_value")) for s, p, kind, o in facts]
    return df.select(*carried, F.explode(F.array(*each)).alias("t")).select(*carried, "t.*").filter("o_value is not null")


def forest_triples(
    mined: Mined, dataset_iri: str | Column, base: str = "http://example.org/", cluster_iri: str | Column | None = None, preambles: DataFrame | None = None, default_preamble: str = "", with_keys: bool = False
) -> DataFrame:
    """s, p, o_kind, o_value: the templates and, of a mined forest, all specializations as statements.

    Each node has its identifier, text, executions and parameters, and a link to its parents; a root belongs to the
    dataset or, if one is given, to the cluster. Each instance of each node has a generation by which its query
    was made, with a binding for each parameter: its text, and its full term where the prologue tells it. What the
    query's own prologue does not declare is looked up in that of its dataset (``preambles``: the columns of
    ``mined.keys`` and preamble), then in ``default_preamble``; relative IRIs are resolved against the base found so.
    The dataset or cluster may be a column of the keys. With ``with_keys`` the statements have the keys before them, and what
    two keys share is told under both.
    """
    rdf, dct, lsqv = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/dc/terms/", "http://lsq.aksw.org/vocab#"
    prvt, prv, prov = "http://purl.org/net/provenance/types#", "http://purl.org/net/provenance/ns#", "http://www.w3.org/ns/prov#"
    sh, wf = "http://www.w3.org/ns/shacl#", "http://purl.org/wf4ever/wfprov#"
    keys, of = mined.keys, [*mined.keys, "template"]
    head = mined.templates.select(*of, "base", "prefixes", F.col("body").alias("_root"), F.hex("template_id").alias("_id"))
    # a root is known as its template; texts of different templates differ in their pieces
    below = F.hex(F.xxhash64(*of, "node"))
    if mined.forest is None:
        n = join_by(mined.templates.select(*of, F.col("body").alias("node"), "num_exec", "n_params"), head, of)
        up = n.limit(0).select(*keys, F.col("_id").alias("_above"), "_id")
        told_by = mined.instances.withColumn("pre", F.xxhash64("preamble"))
        m = join_by(told_by.select(*of, "pre", "id", "bindings"), head.select(*of, "_id"), of)
    else:
        forest = mined.forest
        n = join_by(forest.nodes.select(*of, "node", "num_exec", "n_params"), head, of).withColumn("_id", F.when(F.col("node") == F.col("_root"), F.col("_id")).otherwise(below))
        root_id = F.hex(F.xxhash64(*of))
        ids = forest.named.select(*keys, "n1", "n2", F.when(F.col("depth") == 0, root_id).otherwise(below).alias("_id"))
        up = forest.reduced.join(ids.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("_id").alias("_above")), ["p1", "p2"]).join(ids, ["n1", "n2"])
        # a member's node is named from its own constants, so that members are not dealt by node
        roots = stored(forest.named.filter("depth = 0").select("t", *of, "pieces"))
        m = forest.rows.join(few(roots, roots.count()), "t").withColumn("node", lattice.general_text(F.col("pieces"), F.col("bindings"), F.col("slots")))
        m = m.select(*keys, F.when(F.col("depth") == 0, root_id).otherwise(below).alias("_id"), "id", "pre", lattice.bound_values(F.col("slots"), F.col("bindings")).alias("bindings"))
        told_by = forest.base
    iri_of = lambda c: F.concat(F.lit(base + "templates/"), c)
    n = n.withColumn("s", iri_of(F.col("_id")))
    text = F.concat(templates.prologue_text(F.col("base"), F.col("prefixes")), F.lit("\n"), F.col("node"))
    up = up.select(*keys, iri_of(F.col("_id")).alias("s"), iri_of(F.col("_above")).alias("_up"))
    param = lambda pos: F.concat(F.lit(base + "params/"), "_id", F.lit("_"), pos.cast("string"))
    p = n.filter("n_params > 0").select(*keys, "s", "_id", F.explode(F.sequence(F.lit(0), F.col("n_params") - 1)).alias("pos")).withColumn("_p", param(F.col("pos")))
    label = F.concat(F.lit("__PARAM_"), F.col("pos").cast("string"))
    # each distinct prologue is read once
    prologues = told_by.select(*keys, "pre", "preamble").distinct()
    if preambles is not None:
        prologues = join_by(prologues, preambles.select(*keys, F.col("preamble").alias("_shared")), list(keys), "left")
    # of several declarations the last counts
    shared = [F.col("_shared")] if preambles is not None else []
    prologues = prologues.withColumn("preamble", F.concat_ws("\n", F.lit(default_preamble), *shared, "preamble"))
    prologues = stored(prologues.select(*keys, "pre", prologue_prefixes(F.col("preamble")).alias("_prefixes"), prologue_base(F.col("preamble")).alias("_base")))
    m = m.withColumn("s", F.concat(F.lit(base + "queryGenerations/"), "_id", F.lit("_"), "id")).withColumn("_q", F.concat(F.lit("http://lsq.aksw.org/lsqQuery-"), "id"))
    b = join_by(m, few(prologues, prologues.count()), [*keys, "pre"]).select(*keys, "s", "_id", "id", "_prefixes", "_base", F.posexplode("bindings").alias("pos", "value"))
    b = b.withColumn("_b", F.concat(F.lit(base + "bindings/"), "_id", F.lit("_"), "id", F.lit("_"), F.col("pos").cast("string")))
    b = b.withColumn("_value", rebase_term(F.col("value"), F.col("_prefixes"), F.col("_base")))
    s, iri, told = F.col("s"), lambda x: F.lit(x), list(keys) if with_keys else []
    part_of = (dct + "isPartOf", "iri", iri(dataset_iri)) if cluster_iri is None else (prov + "specializationOf", "iri", iri(cluster_iri))
    of_nodes = _facts(
        n,
        told,
        (s, rdf + "type", "iri", iri(prvt + "QueryTemplate")),
        (s, rdf + "type", "iri", iri(sh + "Parametrizable")),
        (s, dct + "identifier", "literal", F.col("_id")),
        (s, lsqv + "text", "literal", text),
        (s, lsqv + "numOfExecutions", "literal", F.col("num_exec")),
        (s, part_of[0], part_of[1], F.when(F.col("node") == F.col("_root"), part_of[2])),
    )
    of_parents = _facts(up, told, (s, prov + "specializationOf", "iri", F.col("_up")))
    of_parameters = _facts(
        p,
        told,
        (s, sh + "parameter", "iri", F.col("_p")),
        (F.col("_p"), rdf + "type", "iri", iri(sh + "Parameter")),
        (F.col("_p"), sh + "path", "iri", F.concat(F.lit(base + "paramPaths/"), label)),
        (F.col("_p"), sh + "description", "literal", label),
    )
    of_members = _facts(
        m,
        told,
        (s, rdf + "type", "iri", iri(prvt + "DataCreation")),
        (s, prv + "usedGuideline", "iri", iri_of(F.col("_id"))),
        (F.col("_q"), prv + "createdBy", "iri", s),
    )
    # every instance is a member of its root
    every = told_by.select(*told, F.concat(F.lit("http://lsq.aksw.org/lsqQuery-"), "id").alias("_q"))
    of_queries = _facts(every.distinct(), told, (F.col("_q"), rdf + "type", "iri", iri(prvt + "SPARQLQuery")))
    of_bindings = _facts(
        b,
        told,
        (s, prv + "usedData", "iri", F.col("_b")),
        (F.col("_b"), rdf + "type", "iri", iri(wf + "Artifact")),
        (F.col("_b"), wf + "describedByParameter", "iri", param(F.col("pos"))),
        (F.col("_b"), rdf + "value", "term", F.col("_value")),
        (F.col("_b"), lsqv + "text", "literal", F.col("value")),
    )
    return of_nodes.unionByName(of_parents).unionByName(of_parameters).unionByName(of_members).unionByName(of_queries).unionByName(of_bindings)


def single_query_triples(
    mined: Mined, action_iri: str, dataset_iri: str | Column | None = None, cluster_iri: str | Column | None = None, with_keys: bool = False
) -> DataFrame:
    """s, p, o_kind, o_value: the queries that got no template, each a result of the run and a member of its cluster or
    dataset (one of them may be a column of the keys). With ``with_keys`` the keys come before them."""
    q, whole = F.concat(F.lit("http://lsq.aksw.org/lsqQuery-"), "id"), cluster_iri if cluster_iri is not None else dataset_iri
    facts = [
        (F.lit(action_iri), "http://schema.org/result", "iri", q),
        (q, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", F.lit("http://purl.org/net/provenance/types#SPARQLQuery")),
    ]
    if whole is not None:
        facts.append((F.lit(whole), "http://www.w3.org/2000/01/rdf-schema#member", "iri", q))
    return _facts(mined.simple, list(mined.keys) if with_keys else [], *facts)


def stats_table(mined: Mined, by_key: bool = False) -> DataFrame:
    """A row of totals with query_id 0, then the templates by executions; with ``by_key`` so for each key, the keys before it.

    ``num_specializations`` counts a template's children in a mined forest; in a row of totals, the queries without a template.
    """
    from tessera.operators.stats import numbered

    cols, told = ["num_instances", "num_exec", "t_first", "t_last", "sum_log2_exec", "n_terms", "n_params"], list(mined.keys) if by_key else []
    of = [*mined.keys, "body"]
    rows = mined.templates
    if mined.forest is None:
        rows = rows.withColumn("num_specializations", F.lit(0).cast("long"))
    else:
        below = mined.edges.groupBy(*mined.keys, F.col("parent").alias("body")).agg(F.count("*").alias("num_specializations"))
        rows = join_by(rows, below, of, "left").withColumn("num_specializations", F.coalesce("num_specializations", F.lit(0)))
    rows = numbered(rows, [*[F.asc(k) for k in told], F.desc("num_exec"), F.col("template_id")])
    if told:
        first = rows.groupBy(*told).agg((F.min("query_id") - 1).alias("_before"))
        rows = join_by(rows, first, told).withColumn("query_id", F.col("query_id") - F.col("_before"))
    rows = rows.select(*told, "query_id", "text", *cols, "num_specializations")
    sums = [F.lit(0).cast("long").alias("query_id"), F.lit("").alias("text"), *[f(c).alias(c) for c, f in zip(cols, (F.sum, F.sum, F.min, F.max, F.sum, F.max, F.max))]]
    if told:
        total = mined.templates.groupBy(*told).agg(*sums).withColumn("num_specializations", F.lit(0).cast("long"))
        if mined.simple is not None:
            # keys whose templates all fell below the thresholds have a row of totals too
            without = mined.simple.groupBy(*told).agg(F.count("*").alias("_simple"))
            every = total.select(*told).unionByName(without.select(*told)).distinct()
            total = join_by(join_by(every, total, told, "left"), without, told, "left").withColumn("num_specializations", F.coalesce("_simple", F.lit(0))).drop("_simple")
            total = total.withColumns({"query_id": F.lit(0).cast("long"), "text": F.lit("")})
    elif mined.simple is None:
        total = mined.templates.agg(*sums).withColumn("num_specializations", F.lit(0).cast("long"))
    else:
        total = mined.templates.agg(*sums).crossJoin(mined.simple.agg(F.count("*").alias("num_specializations")))  # one row each
    return total.unionByName(rows)
