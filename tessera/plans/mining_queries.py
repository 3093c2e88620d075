"""The mining queries: whole-log runs of the drivers, over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import ingest, lattice, templates
from tessera.operators.features import patterns_by_shape, query_features, spread, terms_by_place
from tessera.operators.graph import shared_folder
from tessera.operators.nested import nested_forest
from tessera.operators.specialize import grow_forest, specialization_forest
from tessera.operators.tokenizer import TokenOptions, decompose
from tessera.plans.log_queries import _INST, _LOG, _SIMPLE, _USAGE, _USAGE_DS, _instances, _table
from tessera.plans.mining import MiningOptions, forest_triples, generalize_and_aggregate, mine_by_cluster, mine_templates, stats_table
from tessera.plans.runs import RunOptions, committed, run_datasets
from tessera.sources.querylog import bracket_texts, executions, query_usage
from tessera.sources.rdf import parse_lines

_SHAPES = f"""{_SIMPLE}, shapes AS (
  SELECT template, list(coalesce(constant, '$__PARAM_' || CAST(parameter AS VARCHAR)) ORDER BY pos) AS slots, CAST(count(DISTINCT parameter) AS INTEGER) AS n_params FROM params GROUP BY template
), heads AS (
  SELECT template, any_value(pieces) AS pieces, count(*) AS num_instances, CAST(sum(num_exec) AS BIGINT) AS num_exec, min(t_first) AS t_first, max(t_last) AS t_last, round(sum(log2(num_exec)), 6) AS sum_log2_exec, CAST(max(n_terms) AS INTEGER) AS n_terms FROM inst GROUP BY template
), mined AS (
  SELECT CASE WHEN h.template LIKE 'SELECT ?s%' THEN 'PREFIX ex: <http://ex.org/>' ELSE '' END || chr(10) ||
    array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(slots[i], '')), '') AS text, n_params, num_instances, num_exec, t_first, t_last, sum_log2_exec, n_terms
  FROM heads h JOIN shapes s ON h.template = s.template
)"""


def mined_templates(spark, sf_dir):
    """The flagship: tokenise, group, simplify, roll up, merge prologues."""
    done = mine_templates(query_usage(executions(spark, sf_dir)), keys=()).templates
    return done.select("text", "n_params", "num_instances", "num_exec", "t_first", "t_last", F.round("sum_log2_exec", 6).alias("sum_log2_exec"), "n_terms")


def mined_by_run(spark, sf_dir):
    """The driver over a catalog of the log's datasets, two of them a wave: templates that the statistics list too, and the statistics' totals."""
    usage = query_usage(executions(spark, sf_dir), "dataset")
    catalog = usage.select("dataset").distinct().withColumns({"endpoint": F.lit(None).cast("string"), "prefixesJson": F.lit('{"ex": "http://ex.org/"}')})
    out = os.path.join(shared_folder(spark.sparkContext), f"run-{uuid.uuid4().hex}")
    run_datasets(usage, catalog, out, "log", RunOptions(MiningOptions(), wave=2))
    mined, stats = committed(spark, out, "templates"), committed(spark, out, "stats")
    columns = ["num_instances", "num_exec", "n_params"]
    return mined.join(stats.select("dataset", "text"), ["dataset", "text"]).select("dataset", F.col("body").alias("node"), *columns).unionByName(stats.filter("query_id = 0").select("dataset", F.lit("total").alias("node"), *columns))


def mined_stats_table(spark, sf_dir):
    """With a first row of totals; numbered by executions."""
    done = stats_table(mine_templates(query_usage(executions(spark, sf_dir)), keys=()))
    return done.select((F.col("query_id") == 0).alias("is_total"), "text", "num_instances", "num_exec", "t_first", "t_last", F.round("sum_log2_exec", 3).alias("sum_log2_exec"), "n_terms", "n_params")


def mined_by_cluster(spark, sf_dir):
    """Event types as clusters, each query once in a cluster."""
    e = executions(spark, sf_dir).select("text").distinct()
    kind = C.query_type(F.col("text"))
    rows = e.select(F.when(kind == "S", 1).when(kind == "C", 2).when(kind == "A", 3).otherwise(4).alias("groupId"), F.col("text").alias("query"))
    return mine_by_cluster(rows).templates.select("groupId", "text", "num_instances", "num_exec", "n_params")


def mined_forest_triples(spark, sf_dir):
    """With the specializations of all templates, down to single instances."""
    mined = mine_templates(query_usage(executions(spark, sf_dir)), MiningOptions(generalization_tree=True), keys=())
    return forest_triples(mined, C.DATASETS + "events").groupBy("p", "o_kind").agg(F.count("*").alias("n"))


_NODE = ("template", "node", "depth", "num_instances", "num_exec", "n_params", "t_first", "t_last")


def specialization_nodes(spark, sf_dir):
    """Nodes of the specialization forest, of 15 instances at least."""
    return grow_forest(_instances(spark, sf_dir), 15, 15).nodes.select(*_NODE, F.round("sum_log2_exec", 3).alias("sum_log2_exec"))


def specialization_nodes_by_dataset(spark, sf_dir):
    """A forest for each dataset, in one job; of 5 instances at least."""
    return grow_forest(_instances(spark, sf_dir, "dataset"), 5, 5, keys=("dataset",)).nodes.select("dataset", *_NODE, F.round("sum_log2_exec", 3).alias("sum_log2_exec"))


def specialization_edges_by_dataset(spark, sf_dir):
    return grow_forest(_instances(spark, sf_dir, "dataset"), 5, 5, keys=("dataset",)).edges.select("dataset", "parent", "node")


def specialization_edges(spark, sf_dir):
    return grow_forest(_instances(spark, sf_dir), 15, 15).edges.select("parent", "node")


def nested_specializations(spark, sf_dir):
    """Children in the nested values of each dataset's forest (5 instances at least); a root without children has one row."""
    nodes, edges = specialization_forest(_instances(spark, sf_dir, "dataset"), 5, 5, keys=("dataset",))
    rows = nested_forest(nodes, edges, ("dataset",)).withColumn("child", F.explode_outer(F.expr("variant_get(value, '$.specializations', 'array<variant>')")))
    number = lambda v, name: F.variant_get(v, f"$.{name}", "bigint").alias(name)
    return rows.select(
        "dataset", "node", "n_nodes", number("value", "num_exec"), F.variant_get("child", "$.node", "string").alias("child"), F.variant_get("child", "$.num_instances", "bigint").alias("child_instances")
    )


def generalization_lattice(spark, sf_dir):
    """All generalizations with at most two parameters that diverge and have 50 instances."""
    kept, _, _ = generalize_and_aggregate(query_usage(executions(spark, sf_dir)), MiningOptions(max_vars=2, min_instances=50))
    return kept.select("template", "num_instances", "num_exec")


def generalization_edges(spark, sf_dir):
    _, edges, _ = generalize_and_aggregate(query_usage(executions(spark, sf_dir)), MiningOptions(max_vars=2, min_instances=50))
    return edges


def generalization_roots(spark, sf_dir):
    return generalize_and_aggregate(query_usage(executions(spark, sf_dir)), MiningOptions(max_vars=2, min_instances=50))[2]


def query_feature_counts(spark, sf_dir):
    """Per query type and clause list: queries, and averages of the features' sizes."""
    usage = query_usage(executions(spark, sf_dir)).withColumn("f", query_features(F.col("text")))
    return usage.groupBy(F.col("f.type").alias("type"), F.array_join("f.clauses", ",").alias("clauses")).agg(
        F.count("*").alias("num_queries"), F.sum(F.size("f.variables")).alias("variables"), F.sum(F.size("f.iris")).alias("iris"), F.sum(F.size("f.literals")).alias("literals"), F.sum(F.size("f.prefixed")).alias("prefixed")
    )


def query_terms_by_place(spark, sf_dir):
    """Terms of all queries' patterns by dataset and place, with the number of queries that have them."""
    return terms_by_place(query_usage(executions(spark, sf_dir), "dataset"), "dataset")


def query_nested_patterns(spark, sf_dir):
    """Patterns of a log whose queries nest property lists, collections, groups and inner queries, with their executions."""
    texts = bracket_texts(spark, sf_dir).groupBy("text").agg(F.count("*").alias("n"))  # each text is read once
    found = patterns_by_shape(spread(texts)).select("n", F.explode("patterns").alias("t"))
    return found.groupBy("t.subject", "t.predicate", "t.object").agg(F.sum("n").alias("num_exec"))


def document_tokens(spark, sf_dir):
    """Whole document texts through the tokenizer: pieces and constants hold the text again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", decompose(F.col("text"), TokenOptions(exclude_preamble=False, sparql_parameters=False)).alias("d"))
    again = F.concat(F.element_at("d.pieces", 1), F.array_join(F.zip_with("d.constants", F.slice("d.pieces", F.lit(2), F.size("d.pieces")), lambda a, b: F.concat(a, b)), ""))
    return docs.select("doc_id", (again == F.col("text")).alias("lossless"))


def merged_preambles(spark, sf_dir):
    done = templates.merged_preambles(_instances(spark, sf_dir), "id")
    return done.select("template", "base", templates.prologue_text(F.col("base"), F.col("prefixes")).alias("prologue"))


def rebased_terms(spark, sf_dir):
    """Constants of all queries as full terms under their own prologue; null where the prefix is unknown."""
    from tessera.operators.tokenizer import prologue_prefixes

    inst = _instances(spark, sf_dir).select("id", "preamble", F.posexplode("bindings").alias("pos", "term"))
    return inst.select("id", F.col("pos").cast("long").alias("pos"), C.rebase_term(F.col("term"), prologue_prefixes(F.col("preamble"))).alias("rdf_term"))


def _event_statements(spark, sf_dir):
    """Events as statements in file order: host, time and query of each execution, and the query's text."""
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 97).alias("x"), "user_id")
    line = lambda k, s: F.struct((F.col("event_id") * 4 + k).alias("line"), s.alias("value"))
    exec_iri, q = F.concat(F.lit("<http://lsq.aksw.org/re-"), F.col("x").cast("string"), F.lit(">")), F.concat(F.lit("<http://lsq.aksw.org/lsqQuery-"), F.col("user_id").cast("string"), F.lit(">"))
    lines = F.array(
        line(0, F.concat(exec_iri, F.lit(' <http://lsq.aksw.org/vocab#hostHash> "h'), (F.col("user_id") % 7).cast("string"), F.lit('" .'))),
        line(1, F.concat(exec_iri, F.lit(' <http://www.w3.org/ns/prov#atTime> "t'), F.col("event_id").cast("string"), F.lit('" .'))),
        line(2, F.concat(q, F.lit(" <http://lsq.aksw.org/vocab#hasRemoteExec> "), exec_iri, F.lit(" ."))),
        line(3, F.concat(q, F.lit(' <http://lsq.aksw.org/vocab#text> "ASK { '), F.col("user_id").cast("string"), F.lit(' }" .'))),
    )
    # a small table makes few tasks by its bytes, but each event is four lines to parse
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("event_id"))
    rows = e.select(F.explode(lines).alias("l")).select("l.*", F.lit("f").alias("file"))
    return parse_lines(rows)


def assembled_executions(spark, sf_dir):
    """The events' statements put together again to executions of queries."""
    queries_, execs = ingest.assemble(_event_statements(spark, sf_dir), "http://ds")
    return execs.join(queries_, "query_iri").select("id", "text", "ts", "host")


def numbered_executions(spark, sf_dir):
    """With IRIs that number the executions through their dataset."""
    _, execs = ingest.assemble(_event_statements(spark, sf_dir), "http://ds", by_dataset=True)
    return execs.select("exec_iri", "query_iri", "ts", "host")


def _forest_sql(usage: str, key: str, least: int) -> str:
    """CTEs roots and groups of the log's forest: its templates have at most two parameters and no two of its queries
    share both, so what two queries or more have in common lies one level below a root."""
    k = f"{key}, " if key else ""
    same = lambda a, b: f"{a}.template = {b}.template" + (f" AND {a}.{key} = {b}.{key}" if key else "")
    shape = "list({} ORDER BY pos)"
    text = "array_to_string(list_transform(range(1, len(h.pieces) + 1), lambda i: h.pieces[i] || coalesce(slots[i], '')), '')"
    sums = "count(*) AS num_instances, CAST(sum(num_exec) AS BIGINT) AS num_exec, min(t_first) AS t_first, max(t_last) AS t_last, round(sum(log2(num_exec)), 3) AS sum_log2_exec"
    return f"""{_LOG}, {usage}, {_INST}, pos AS (
  SELECT {k}template, id, u.i AS pos, bindings[u.i + 1] AS value FROM inst, unnest(range(0, len(bindings))) AS u(i)
), vec AS (
  SELECT {k}template, pos, CASE WHEN min(value) = max(value) THEN min(value) END AS constant, md5(string_agg(id || '=' || value, ',' ORDER BY id)) AS v FROM pos GROUP BY {k}template, pos
), firsts AS (
  SELECT *, CASE WHEN constant IS NULL THEN min(pos) OVER (PARTITION BY {k}template, constant IS NULL, v) ELSE pos END AS first FROM vec
), params AS (
  SELECT *, CASE WHEN constant IS NULL THEN CAST(dense_rank() OVER (PARTITION BY {k}template, constant IS NULL ORDER BY first) - 1 AS INTEGER) END AS parameter FROM firsts
), heads AS (SELECT {k}template, any_value(pieces) AS pieces, {sums} FROM inst GROUP BY {k}template
), shapes AS (SELECT {k}template, {shape.format("coalesce(constant, '$__PARAM_' || parameter)")} AS slots, CAST(count(DISTINCT parameter) AS INTEGER) AS n_params FROM params GROUP BY {k}template
), roots AS (SELECT h.*, {text} AS node, n_params FROM heads h JOIN shapes s ON {same("h", "s")}
), kinds AS (
  SELECT {", ".join(f"i.{c}" for c in [*([key] if key else []), "template"])}, p.parameter, i.bindings[p.pos + 1] AS value, {sums}
  FROM inst i JOIN params p ON {same("i", "p")} WHERE p.constant IS NULL AND p.pos = p.first GROUP BY ALL HAVING count(*) >= {least} AND sum(num_exec) >= {least}
), filled AS (
  SELECT {", ".join(f"g.{c}" for c in [*([key] if key else []), "template"])}, g.parameter, g.value,
    {shape.format("CASE WHEN p.constant IS NOT NULL THEN p.constant WHEN p.parameter = g.parameter THEN g.value ELSE '$__PARAM_' || (p.parameter - CASE WHEN p.parameter > g.parameter THEN 1 ELSE 0 END) END")} AS slots
  FROM kinds g JOIN params p ON {same("g", "p")} GROUP BY ALL
), groups AS (
  SELECT g.*, h.node AS parent, h.n_params - 1 AS n_params, {text} AS node
  FROM kinds g JOIN filled f ON {same("g", "f")} AND g.parameter = f.parameter AND g.value = f.value JOIN roots h ON {same("g", "h")}
)"""


def _nodes_sql(usage: str, key: str, least: int) -> str:
    cols = f"{key + ', ' if key else ''}template, node, {{}} AS depth, num_instances, num_exec, n_params, t_first, t_last, sum_log2_exec"
    return f"{_forest_sql(usage, key, least)} SELECT {cols.format(0)} FROM roots UNION ALL SELECT {cols.format(1)} FROM groups"


#: Counts of statements by kind: below groups of two or more come single queries, under their groups or else the root.
_TRIPLES_SQL = f"""{_forest_sql(_USAGE, "", 2)}, leaves AS (
  SELECT i.id, (SELECT count(*) FROM groups g WHERE g.template = i.template AND g.n_params = 1 AND g.value = i.bindings[(SELECT min(p.pos) FROM params p WHERE p.template = i.template AND p.parameter = g.parameter) + 1]) AS above
  FROM inst i JOIN roots r ON i.template = r.template WHERE r.n_params > 0
), pairs AS (SELECT * FROM groups WHERE n_params = 1
), n AS (SELECT
  (SELECT count(*) FROM roots) + (SELECT count(*) FROM pairs) + (SELECT count(*) FROM leaves) AS nodes,
  (SELECT count(*) FROM roots) AS roots,
  (SELECT count(*) FROM pairs) + (SELECT coalesce(sum(greatest(above, 1)), 0) FROM leaves) AS edges,
  (SELECT sum(n_params) FROM roots) + (SELECT count(*) FROM pairs) AS params,
  (SELECT sum(num_instances) FROM roots) + (SELECT coalesce(sum(num_instances), 0) FROM pairs) + (SELECT count(*) FROM leaves) AS members,
  (SELECT sum(num_instances * n_params) FROM roots) + (SELECT coalesce(sum(num_instances), 0) FROM pairs) AS bindings,
  (SELECT count(*) FROM inst) AS queries
) SELECT p, o_kind, CAST(n AS BIGINT) AS n FROM (
  SELECT unnest([
    {{'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'o_kind': 'iri', 'n': 2 * nodes + params + members + queries + bindings}},
    {{'p': 'http://purl.org/dc/terms/identifier', 'o_kind': 'literal', 'n': nodes}},
    {{'p': 'http://lsq.aksw.org/vocab#text', 'o_kind': 'literal', 'n': nodes + bindings}},
    {{'p': 'http://lsq.aksw.org/vocab#numOfExecutions', 'o_kind': 'literal', 'n': nodes}},
    {{'p': 'http://purl.org/dc/terms/isPartOf', 'o_kind': 'iri', 'n': roots}},
    {{'p': 'http://www.w3.org/ns/prov#specializationOf', 'o_kind': 'iri', 'n': edges}},
    {{'p': 'http://www.w3.org/ns/shacl#parameter', 'o_kind': 'iri', 'n': params}},
    {{'p': 'http://www.w3.org/ns/shacl#path', 'o_kind': 'iri', 'n': params}},
    {{'p': 'http://www.w3.org/ns/shacl#description', 'o_kind': 'literal', 'n': params}},
    {{'p': 'http://purl.org/net/provenance/ns#usedGuideline', 'o_kind': 'iri', 'n': members}},
    {{'p': 'http://purl.org/net/provenance/ns#createdBy', 'o_kind': 'iri', 'n': members}},
    {{'p': 'http://purl.org/net/provenance/ns#usedData', 'o_kind': 'iri', 'n': bindings}},
    {{'p': 'http://purl.org/wf4ever/wfprov#describedByParameter', 'o_kind': 'iri', 'n': bindings}},
    {{'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#value', 'o_kind': 'term', 'n': bindings}}
  ], recursive := true) FROM n) t"""

#: Generalizations by vectors: for each constant its parameter (0 or 1, in order of first use) or -1.
_LATTICE_SQL = f"""{_LOG.replace("WITH", "WITH RECURSIVE", 1)}, {_USAGE}, {_INST}, vectors AS (
  SELECT 0 AS n, CAST([] AS INTEGER[]) AS a, 0 AS m
  UNION ALL SELECT n + 1, list_append(a, CAST(x.b AS INTEGER)), greatest(m, CAST(x.b + 1 AS INTEGER)) FROM vectors, range(-1, 2) AS x(b) WHERE n < 6 AND x.b <= m
), general AS (
  SELECT i.id, i.num_exec, v.a, v.m, i.bindings,
    array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || CASE WHEN i > len(bindings) THEN '' WHEN a[i] < 0 THEN bindings[i] ELSE '$__PARAM_' || a[i] END), '') AS template
  FROM inst i JOIN vectors v ON v.n = len(i.bindings)
  WHERE v.m > 0 AND len(list_filter(range(1, v.n + 1), lambda i: a[i] >= 0 AND bindings[i] <> bindings[list_position(a, a[i])])) = 0
), counted AS (SELECT template, count(*) AS num_instances, CAST(sum(num_exec) AS BIGINT) AS num_exec FROM general GROUP BY template
), bound AS (SELECT template, b.i AS block, bindings[list_position(a, b.i)] AS value, count(*) AS num FROM general, unnest([0, 1]) AS b(i) WHERE b.i < m GROUP BY ALL
), fixed AS (SELECT DISTINCT b.template FROM bound b JOIN counted c ON b.template = c.template WHERE b.num = c.num_instances
), kept AS (SELECT * FROM counted WHERE num_instances >= 50 AND template NOT IN (SELECT template FROM fixed)
), steps AS (
  SELECT x.a, y.a AS b FROM vectors x JOIN vectors y ON x.n = y.n WHERE x.m > 0
    AND len(list_filter(range(1, x.n + 1), lambda i: x.a[i] >= 0 AND y.a[i] < 0)) = 0
    AND (len(list_filter(y.a, lambda v: v >= 0)) = len(list_filter(x.a, lambda v: v >= 0)) + 1
           AND len(list_filter(range(1, x.n + 1), lambda i: x.a[i] >= 0 AND (y.a[list_position(x.a, x.a[i])] <> y.a[i]))) = 0
           AND (x.m = 1 OR y.a[list_position(x.a, 0)] <> y.a[list_position(x.a, 1)])
      OR len(list_filter(y.a, lambda v: v >= 0)) = len(list_filter(x.a, lambda v: v >= 0)) AND x.m = 1 AND y.m = 2)
), known AS (SELECT g.id, g.a, g.template FROM general g JOIN kept k ON g.template = k.template
), edges AS (SELECT DISTINCT c.template AS child, p.template AS parent FROM known c JOIN steps s ON c.a = s.a JOIN known p ON p.id = c.id AND p.a = s.b)"""

_ORACLES = {
    "mined_by_cluster": f"""{_SHAPES} SELECT CASE WHEN text LIKE '%SELECT%' THEN 1 WHEN text LIKE '%CONSTRUCT%' THEN 2 WHEN text LIKE '%ASK%' THEN 3 ELSE 4 END AS groupId, text, num_instances, num_instances AS num_exec, n_params FROM mined""",
    "specialization_nodes": _nodes_sql(_USAGE, "", 15),
    "specialization_edges": f"{_forest_sql(_USAGE, '', 15)} SELECT parent, node FROM groups",
    "specialization_nodes_by_dataset": _nodes_sql(_USAGE_DS, "dataset", 5),
    "specialization_edges_by_dataset": f"{_forest_sql(_USAGE_DS, 'dataset', 5)} SELECT dataset, parent, node FROM groups",
    "mined_by_run": f"""{_forest_sql(_USAGE_DS, "dataset", 5)} SELECT dataset, node, num_instances, num_exec, n_params FROM roots
UNION ALL SELECT dataset, 'total', CAST(sum(num_instances) AS BIGINT), CAST(sum(num_exec) AS BIGINT), max(n_params) FROM roots GROUP BY dataset""",
    "nested_specializations": f"""{_forest_sql(_USAGE_DS, "dataset", 5)} SELECT r.dataset, r.node, 1 + count(g.node) OVER (PARTITION BY r.dataset, r.node) AS n_nodes, r.num_exec, g.node AS child, g.num_instances AS child_instances
FROM roots r LEFT JOIN groups g ON g.dataset = r.dataset AND g.parent = r.node""",
    "mined_forest_triples": _TRIPLES_SQL,
    "generalization_lattice": f"{_LATTICE_SQL} SELECT * FROM kept",
    "generalization_edges": f"{_LATTICE_SQL} SELECT * FROM edges",
    "generalization_roots": f"{_LATTICE_SQL} SELECT template AS general FROM kept WHERE template NOT IN (SELECT child FROM edges)",
    "query_feature_counts": f"""{_LOG}, {_USAGE}, kinds AS (
  SELECT CASE WHEN text LIKE '%SELECT%' THEN 'S' WHEN text LIKE '%CONSTRUCT%' THEN 'C' WHEN text LIKE '%ASK%' THEN 'A' ELSE 'D' END AS type,
    CASE WHEN text LIKE '%LIMIT%' THEN 'LIMIT' ELSE '' END AS clauses, len(list_distinct(regexp_extract_all(text, '[?][a-z]+'))) AS variables, len(list_distinct(regexp_extract_all(text, '<[^>]*>'))) AS iris,
    len(list_distinct(regexp_extract_all(text, '"[^"]*"'))) AS literals, len(list_distinct(regexp_extract_all(text, 'ex:[a-z0-9]+'))) AS prefixed FROM usage)
SELECT type, clauses, count(*) AS num_queries, CAST(sum(variables) AS BIGINT) AS variables, CAST(sum(iris) AS BIGINT) AS iris, CAST(sum(literals) AS BIGINT) AS literals, CAST(sum(prefixed) AS BIGINT) AS prefixed FROM kinds GROUP BY type, clauses""",
    "query_terms_by_place": f"""{_LOG}, {_USAGE_DS}, seen AS (
  SELECT dataset, id, regexp_extract(text, 'ex:p[0-9]+') AS pred, unnest(['?s', regexp_extract(text, '([0-9]+) }} LIMIT', 1)]) AS term FROM usage WHERE text LIKE '%LIMIT%'
  UNION ALL SELECT dataset, id, 'ex:k', unnest([regexp_extract(text, '<[^>]*>'), regexp_extract(text, '([0-9]+) }}', 1)]) FROM usage WHERE text LIKE 'ASK%'
  UNION ALL SELECT dataset, id, unnest(['ex:b', 'ex:b', 'ex:u']), unnest(['?s', regexp_extract(text, 'ex:b ([0-9]+)', 1), regexp_extract(text, '"[^"]*"@en')]) FROM usage WHERE text LIKE 'CONSTRUCT%'
  UNION ALL SELECT dataset, id, 'ex:e', unnest(['?a', '?b', regexp_extract(text, '([0-9]+) }}', 1)]) FROM usage WHERE text LIKE 'SELECT *%'
), placed AS (SELECT DISTINCT dataset, id, 'predicate' AS place, pred AS term FROM seen UNION SELECT DISTINCT dataset, id, 'subject_object', term FROM seen)
SELECT dataset, place, CASE WHEN term LIKE '?%' THEN 'variable' WHEN term LIKE 'ex:%' OR term LIKE '<%' THEN 'iri' ELSE 'literal' END AS kind, term, count(*) AS num_queries FROM placed GROUP BY dataset, place, term""",
    "mined_templates": f"{_SHAPES} SELECT * FROM mined",
    "mined_stats_table": f"""{_SHAPES} SELECT false AS is_total, text, num_instances, num_exec, t_first, t_last, round(sum_log2_exec, 3) AS sum_log2_exec, n_terms, n_params FROM mined
UNION ALL SELECT true, '', CAST(sum(num_instances) AS BIGINT), CAST(sum(num_exec) AS BIGINT), min(t_first), max(t_last), round(sum(sum_log2_exec), 3), max(n_terms), max(n_params) FROM mined""",
    "query_nested_patterns": """WITH e AS (SELECT event_type, CAST(user_id AS VARCHAR) AS u, json_extract_string(props, '$.k') AS k FROM events
), r AS (SELECT *, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>' AS f, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>' AS n, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#nil>' AS nil FROM e
), t AS (SELECT unnest(CASE event_type
  WHEN 'click' THEN [['?s', 'ex:p' || u, '_:g0'], ['_:g0', 'ex:q', k], ['_:g0', 'ex:r', '?z'], ['_:g0', 'ex:r', '_:g1'], ['_:g1', f, k], ['_:g1', n, '_:g2'], ['_:g2', f, '"u' || u || '"'], ['_:g2', n, nil], ['_:g3', 'ex:t', '?s']]
  WHEN 'view' THEN [['<http://ex.org/u' || u || '>', 'ex:in', '_:g0'], ['_:g0', f, '_:g1'], ['_:g1', 'ex:k', k], ['_:g0', n, '_:g2'], ['_:g2', f, nil], ['_:g2', n, nil], ['?a', 'ex:x/()*', '?b']]
  ELSE [['?x', 'ex:d' || k, '_:g0'], ['_:g0', 'ex:e', '_:g1'], ['_:g1', 'ex:f', u], ['?x', 'a', 'ex:T']] END) AS p FROM r)
SELECT p[1] AS subject, p[2] AS predicate, p[3] AS object, count(*) AS num_exec FROM t GROUP BY ALL""",
    "document_tokens": "SELECT doc_id, true AS lossless FROM documents",
    "assembled_executions": "SELECT CAST(user_id AS VARCHAR) AS id, 'ASK { ' || user_id || ' }' AS text, 't' || event_id AS ts, 'h' || (user_id % 7) AS host FROM events",
    "numbered_executions": """SELECT 'http://ds/executions/' || row_number() OVER (ORDER BY event_id) AS exec_iri, 'http://lsq.aksw.org/lsqQuery-' || user_id AS query_iri, 't' || event_id AS ts, 'h' || (user_id % 7) AS host FROM events""",
    "merged_preambles": f"""{_SIMPLE} SELECT DISTINCT template, CAST(NULL AS VARCHAR) AS base, CASE WHEN template LIKE 'SELECT ?s%' THEN 'PREFIX ex: <http://ex.org/>' ELSE '' END AS prologue FROM inst""",
    "rebased_terms": f"""{_SIMPLE} SELECT id, pos, CASE WHEN value LIKE 'ex:%' THEN CASE WHEN text LIKE 'PREFIX%' THEN '<http://ex.org/' || substr(value, 4) || '>' END ELSE value END AS rdf_term
FROM (SELECT p.id, p.pos, p.value, i.text FROM pos p JOIN inst i ON p.id = i.id) x""",
}


def queries() -> dict:
    fs = (nested_specializations, mined_by_run, specialization_nodes_by_dataset, specialization_edges_by_dataset, mined_templates, mined_stats_table, mined_by_cluster, mined_forest_triples, specialization_nodes, specialization_edges, generalization_lattice, generalization_edges, generalization_roots)
    fs += (query_feature_counts, query_terms_by_place, query_nested_patterns, document_tokens, merged_preambles, rebased_terms, assembled_executions, numbered_executions)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
