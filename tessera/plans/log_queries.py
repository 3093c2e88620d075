"""The relational queries of the log engine, each over whole tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import graph, ingest, stats, templates
from tessera.operators.tokenizer import TokenOptions
from tessera.plans import statements
from tessera.sources.querylog import LOG_SQL, executions, query_usage
from tessera.sources.rdf import catalog_of_files as catalog_of_table_files
from tessera.sources.rdf import lines_without, parse_lines

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with its oracle."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _generalized(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return templates.generalize(query_usage(executions(spark, sf_dir), *keys), TokenOptions(), keys)


def _instances(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Each distinct text is cut into tokens once, whatever is done with the instances."""
    return graph.stored(_generalized(spark, sf_dir, *keys))


# --- oracles' common parts ---------------------------------------------------------------------

_CONST = r"""<[^<>]*>|"[^"]*"@en|ex:[a-z0-9]+|[0-9]+"""
_USAGE = "usage AS (SELECT id, text, count(*) AS num_exec, min(ts) AS t_first, max(ts) AS t_last FROM log GROUP BY id, text)"
_USAGE_DS = "usage AS (SELECT dataset, id, text, count(*) AS num_exec, min(ts) AS t_first, max(ts) AS t_last FROM log GROUP BY dataset, id, text)"
_INST = f"""
cuts AS (
  SELECT *, regexp_extract_all(body, '{_CONST}') AS bindings, regexp_split_to_array(body, '{_CONST}') AS pieces
  FROM (SELECT *, replace(text, 'PREFIX ex: <http://ex.org/> ', '') AS body FROM usage) b
), inst AS (
  SELECT *, len(bindings) AS n_terms,
    array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || CASE WHEN i < len(pieces) THEN '$__PARAM_' || CAST(i - 1 AS VARCHAR) ELSE '' END), '') AS template
  FROM cuts
)"""
_LOG = "WITH " + LOG_SQL
_WITH_INST = f"{_LOG}, {_USAGE}, {_INST}"
_WITH_INST_DS = f"{_LOG}, {_USAGE_DS}, {_INST}"
_EXEC_TEMPLATE = "et AS (SELECT l.exec_id, l.ts, l.host, l.id, i.template FROM log l JOIN inst i ON l.id = i.id)"


def _executions_of_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exec_id, ts, host, id, template."""
    inst = graph.stored(templates.generalize(query_usage(executions(spark, sf_dir))).select("id", "template"))
    return executions(spark, sf_dir).select("exec_id", "ts", "host", "id").join(inst, "id")


def _entropy_sql(x: str) -> str:
    return f"round((ln(sum({x})) - sum({x} * ln({x})) / sum({x})) / ln(2), 6)"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# --- usage ---------------------------------------------------------------------------------------


@query(f"{_LOG} SELECT id, text, count(*) AS num_exec, min(ts) AS t_first, max(ts) AS t_last FROM log GROUP BY id, text")
def query_usage_stats(spark, sf_dir):
    return query_usage(executions(spark, sf_dir))


@query(f"{_LOG} SELECT id, count(*) AS num_exec, count(DISTINCT host) AS num_hosts, min(ts) AS t_first, max(ts) AS t_last FROM log GROUP BY id")
def query_stats(spark, sf_dir):
    return stats.query_stats(executions(spark, sf_dir))


@query(f"{_LOG} SELECT host, count(*) AS num_exec, count(DISTINCT id) AS num_queries, min(ts) AS t_first, max(ts) AS t_last FROM log WHERE host IS NOT NULL GROUP BY host")
def host_stats(spark, sf_dir):
    return stats.host_stats(executions(spark, sf_dir))


@query(
    f"{_LOG} SELECT CAST(ts AS DATE) AS date, count(*) AS num_exec, count(DISTINCT id) AS num_queries, count(DISTINCT host) AS num_hosts, "
    "min(ts) AS t_first, max(ts) AS t_last FROM log WHERE host IS NOT NULL GROUP BY 1"
)
def day_stats(spark, sf_dir):
    return stats.day_stats(executions(spark, sf_dir))


def _by_dataset_sql(key: str, counted: dict[str, str], where: str = "") -> str:
    counts = ", ".join(f"count(DISTINCT {c}) AS {name}" for name, c in counted.items())
    return f"{_LOG} SELECT dataset, {key}, count(*) AS num_exec, {counts}, min(ts) AS t_first, max(ts) AS t_last FROM log {where} GROUP BY ALL"


@query(_by_dataset_sql("host", {"num_queries": "id"}, "WHERE host IS NOT NULL"))
def host_statement(spark, sf_dir):
    """By an SQL text with parameters, for all datasets."""
    return statements.told_by(statements.HOSTS, executions(spark, sf_dir))


@query(_by_dataset_sql("id", {"num_hosts": "host"}))
def query_statement(spark, sf_dir):
    return statements.told_by(statements.QUERIES, executions(spark, sf_dir))


@query(_by_dataset_sql("CAST(ts AS DATE) AS date", {"num_queries": "id", "num_hosts": "host"}, "WHERE host IS NOT NULL"))
def day_statement(spark, sf_dir):
    return statements.told_by(statements.DAYS, executions(spark, sf_dir))


@query(
    f"{_LOG} SELECT dataset, count(DISTINCT id) AS num_queries, count(DISTINCT exec_id) AS num_exec, count(DISTINCT host) AS num_hosts, min(ts) AS \"begin\", max(ts) AS \"end\" FROM log GROUP BY dataset"
)
def dataset_stats(spark, sf_dir):
    return stats.dataset_stats(executions(spark, sf_dir))


@query(
    f"""{_LOG}, q AS (
  SELECT dataset, id, count(DISTINCT exec_id) AS q_exec, count(DISTINCT host) AS q_hosts,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS i
  FROM log GROUP BY dataset, id)
SELECT l.dataset, count(DISTINCT l.id) AS num_queries, count(DISTINCT l.exec_id) AS num_exec, round(max(i), 6) AS max_interval, round(avg(i), 3) AS avg_interval,
       max(q_hosts) AS max_hosts, round(avg(q_hosts), 6) AS avg_hosts, max(q_exec) AS max_exec, round(avg(q_exec), 6) AS avg_exec
FROM log l JOIN q ON l.dataset = q.dataset AND l.id = q.id GROUP BY l.dataset"""
)
def dataset_query_stats(spark, sf_dir):
    df = _rounded(stats.dataset_query_stats(executions(spark, sf_dir)), "max_interval", "avg_hosts", "avg_exec")
    return df.withColumn("avg_interval", F.round("avg_interval", 3))


@query(f"{_LOG} SELECT id, ts, host FROM log")
def executions_dump(spark, sf_dir):
    return executions(spark, sf_dir).select("id", "ts", "host")


@query(
    f"""{_LOG} SELECT * FROM (
  SELECT 'q:' || id AS s, 'hash' AS p, id AS o FROM log
  UNION SELECT 'q:' || id, 'hasRemoteExec', 'e:' || exec_id FROM log
  UNION SELECT 'e:' || exec_id, 'atTime', CAST(epoch_us(ts) AS VARCHAR) FROM log
  UNION SELECT 'e:' || exec_id, 'hostHash', host FROM log WHERE host IS NOT NULL) t"""
)
def filter_construct(spark, sf_dir):
    log = executions(spark, sf_dir)
    q, e = F.concat(F.lit("q:"), "id"), F.concat(F.lit("e:"), F.col("exec_id").cast("string"))
    return graph.construct(log, (q, "hash", F.col("id")), (q, "hasRemoteExec", e), (e, "atTime", F.unix_micros(F.col("ts").cast("timestamp"))), (e, "hostHash", F.col("host")))


# --- catalog -------------------------------------------------------------------------------------


def _catalog(spark, sf_dir) -> DataFrame:
    """dataset, endpoint, prefixes_json: two nested optional parts."""
    data, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    endpoint = region.filter("r_regionkey <> 2").select("r_regionkey", F.concat(F.lit("http://"), "r_name").alias("endpoint"))
    declared = region.filter("r_regionkey % 2 = 1").select(F.col("r_regionkey").alias("_k"), F.to_json(F.struct(F.col("r_name").alias("ex"))).alias("prefixes_json"))
    optional = endpoint.join(declared, endpoint["r_regionkey"] == declared["_k"], "left")
    return data.join(optional, data["n_regionkey"] == optional["r_regionkey"], "left").select(
        F.concat(F.lit(C.DATASETS), "n_name").alias("dataset"), "endpoint", "prefixes_json", F.substring(F.concat(F.lit(C.DATASETS), "n_name"), F.lit(len(C.DATASETS) + 1), F.length("n_name")).alias("dataset_id")
    )


_CATALOG_SQL = f"""SELECT '{C.DATASETS}' || n_name AS dataset, e.endpoint, e.prefixes_json, n_name AS dataset_id
FROM nation LEFT JOIN (
  SELECT a.r_regionkey, 'http://' || a.r_name AS endpoint, b.prefixes_json
  FROM (SELECT * FROM region WHERE r_regionkey <> 2) a
  LEFT JOIN (SELECT r_regionkey, '{{"ex":"' || r_name || '"}}' AS prefixes_json FROM region WHERE r_regionkey % 2 = 1) b USING (r_regionkey)
) e ON n_regionkey = e.r_regionkey"""


@query(_CATALOG_SQL)
def dataset_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir).orderBy("dataset")


@query(f"SELECT * FROM ({_CATALOG_SQL}) c WHERE dataset >= '{C.DATASETS}J'")
def dataset_from(spark, sf_dir):
    return _catalog(spark, sf_dir).filter(F.col("dataset") >= C.DATASETS + "J").orderBy("dataset")


@query(f"SELECT dataset_id, json_extract_string(prefixes_json, '$.ex') AS iri FROM ({_CATALOG_SQL}) c WHERE prefixes_json IS NOT NULL")
def catalog_prefixes(spark, sf_dir):
    from tessera.sources.rdf import prefixes_of_json

    return _catalog(spark, sf_dir).select("dataset_id", F.explode(prefixes_of_json(F.col("prefixes_json"))).alias("name", "iri")).select("dataset_id", "iri")


@query(f"SELECT dataset_id FROM ({_CATALOG_SQL}) c WHERE dataset_id NOT IN ('CHINA', 'PERU') AND dataset_id LIKE '%A%'")
def exclude_and_substring(spark, sf_dir):
    return _catalog(spark, sf_dir).filter(~F.col("dataset_id").isin("CHINA", "PERU") & F.col("dataset_id").contains("A")).select("dataset_id")


@query("SELECT DISTINCT o_orderpriority AS cluster, c_name AS query FROM orders JOIN customer ON o_custkey = c_custkey")
def cluster_queries(spark, sf_dir):
    member = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cluster"), F.col("o_custkey").alias("c_custkey"))
    return member.join(_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("query")), "c_custkey").select("cluster", "query").distinct()


# --- ingest --------------------------------------------------------------------------------------


@query("SELECT md5(text) AS id, min(doc_id) AS doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id) GROUP BY 1")
def query_semi_exec(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("id")).agg(F.min("doc_id").alias("doc_id"))


@query(
    """SELECT a.k AS user_id, a.o_orderkey, b.event_id FROM
  (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) a
  JOIN (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) b ON a.k = b.k AND a.rn = b.rn"""
)
def exec_fifo_pairing(spark, sf_dir):
    left = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_orderkey").alias("line"))
    right = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("line"))
    return ingest.pair_in_order(left, right, "user_id", "line")


@query(
    """SELECT count(*) FILTER (WHERE value > 50) AS detoured, count(*) FILTER (WHERE value IS NULL OR NOT value > 50) AS passed,
  round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS detoured_sum FROM events"""
)
def route_detour(spark, sf_dir):
    hit, rest = ingest.route(_table(spark, sf_dir, "events"), F.col("value") > 50)
    both = hit.select(F.lit(1).alias("hit"), "value").unionByName(rest.select(F.lit(0).alias("hit"), "value"))
    hits = F.when(F.col("hit") == 1, F.col("value"))
    return both.agg(F.sum("hit").alias("detoured"), F.sum(1 - F.col("hit")).alias("passed"), F.round(F.coalesce(F.sum(hits), F.lit(0.0)), 4).alias("detoured_sum"))


@query(
    """SELECT run, event_type, count(*) AS n, min(event_id) AS first_id FROM (
  SELECT *, CAST(sum(CASE WHEN event_type IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS BIGINT) AS run
  FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events) a) b GROUP BY run, event_type"""
)
def run_groups(spark, sf_dir):
    rows = ingest.run_groups(_table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")
    return rows.groupBy("run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    """SELECT 'q:' || o_orderkey AS s, 'text' AS p, 'literal' AS o_kind, o_orderpriority || chr(10) || '"' || o_orderstatus AS o_value FROM orders
UNION ALL SELECT 'q:' || o_orderkey, 'by', 'iri', 'c:' || o_custkey FROM orders"""
)
def ntriples_round_trip(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    s = F.concat(F.lit("<q:"), F.col("o_orderkey").cast("string"), F.lit("> "))
    text = F.concat(s, F.lit("<p:text> "), C.escape_literal(F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus")), F.lit(" ."))
    by = F.concat(s, F.lit("<p:by> <c:"), F.col("o_custkey").cast("string"), F.lit("> ."))
    read = parse_lines(orders.select(F.explode(F.array(text, by)).alias("value")))
    return read.select("s", F.expr("substr(p, 3)").alias("p"), "o_kind", "o_value")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS v, CAST(ts AS DATE) AS d, event_id % 2 = 0 AS b FROM events")
def term_casts(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    typed = lambda t: F.lit(C.XSD + t)
    return e.select(
        "event_id",
        C.cast_term(F.get_json_object("props", "$.k"), typed("integer"), "bigint").alias("k"),
        C.cast_term(F.col("value").cast("string"), typed("double"), "double").alias("v"),
        F.to_date(C.cast_term(F.col("ts").cast("string"), typed("dateTime"), "timestamp_ntz")).alias("d"),
        C.cast_term((F.col("event_id") % 2 == 0).cast("string"), typed("boolean"), "boolean").alias("b"),
    )


# --- templates -----------------------------------------------------------------------------------


@query(f"{_WITH_INST} SELECT id, template, n_terms, array_to_string(bindings, '|') AS bindings FROM inst")
def template_instances(spark, sf_dir):
    return _generalized(spark, sf_dir).select("id", "template", F.col("n_terms").cast("long").alias("n_terms"), F.array_join("bindings", "|").alias("bindings"))


@query(f"{_WITH_INST} SELECT template, count(*) AS num_instances, CAST(sum(num_exec) AS BIGINT) AS num_exec FROM inst GROUP BY template")
def template_group(spark, sf_dir):
    return templates.roll_up(_instances(spark, sf_dir)).select("template", "num_instances", "num_exec")


@query(
    f"{_WITH_INST} SELECT template, count(*) AS num_instances, CAST(sum(num_exec) AS BIGINT) AS num_exec, min(t_first) AS t_first, max(t_last) AS t_last, "
    "round(sum(log2(num_exec)), 6) AS sum_log2_exec, CAST(max(n_terms) AS INTEGER) AS n_terms FROM inst GROUP BY template"
)
def template_rollup(spark, sf_dir):
    return _rounded(templates.roll_up(_generalized(spark, sf_dir)), "sum_log2_exec")


@query(
    f"{_WITH_INST} SELECT template, count(*) AS num_instances, CAST(sum(num_exec) AS BIGINT) AS num_exec FROM inst GROUP BY template HAVING count(*) >= 100 AND sum(num_exec) >= 150"
)
def template_threshold(spark, sf_dir):
    return templates.above_thresholds(templates.roll_up(_generalized(spark, sf_dir)), 100, 150).select("template", "num_instances", "num_exec")


@query(
    f"""{_LOG}, usage AS (SELECT dataset, id, text, count(*) AS num_exec, min(ts) AS t_first, max(ts) AS t_last FROM (SELECT *  REPLACE (text || ' #' || md5(id) AS text) FROM log) x GROUP BY dataset, id, text)
SELECT dataset, id, num_exec FROM usage WHERE num_exec >= 1"""
)
def simple_queries(spark, sf_dir):
    # a comment of its own makes each text a template of its own
    log = executions(spark, sf_dir)
    usage = query_usage(log.withColumn("text", F.concat("text", F.lit(" #"), F.md5(F.col("id").cast("binary")))), "dataset")
    return templates.simple_queries(templates.generalize(usage, keys=("dataset",)), 2, 1, 1, ("dataset",))


@query(
    f"""{_LOG}, usage AS (SELECT id, text, count(*) AS num_exec, min(ts) AS t_first, max(ts) AS t_last FROM (SELECT * REPLACE (text || ' #' || md5(id) AS text) FROM log) x GROUP BY id, text)
SELECT id, num_exec FROM usage WHERE num_exec >= 1"""
)
def simple_queries_all(spark, sf_dir):
    """As simple_queries, over the whole log."""
    log = executions(spark, sf_dir)
    usage = query_usage(log.withColumn("text", F.concat("text", F.lit(" #"), F.md5(F.col("id").cast("binary")))))
    return templates.simple_queries(templates.generalize(usage), 2, 1, 1)


_SIMPLE = f"""{_WITH_INST}, pos AS (
  SELECT template, id, u.i AS pos, bindings[u.i + 1] AS value FROM inst, unnest(range(0, len(bindings))) AS u(i)
), vec AS (
  SELECT template, pos, CASE WHEN min(value) = max(value) THEN min(value) END AS constant, md5(string_agg(id || '=' || value, ',' ORDER BY id)) AS v FROM pos GROUP BY template, pos
), firsts AS (
  SELECT *, CASE WHEN constant IS NULL THEN min(pos) OVER (PARTITION BY template, constant IS NULL, v) ELSE pos END AS first FROM vec
), params AS (
  SELECT *, CASE WHEN constant IS NULL THEN dense_rank() OVER (PARTITION BY template, constant IS NULL ORDER BY first) - 1 END AS parameter FROM firsts
)"""


@query(f"{_SIMPLE} SELECT template, CAST(pos AS INTEGER) AS pos, constant, CAST(first AS INTEGER) AS first, CAST(parameter AS INTEGER) AS parameter FROM params")
def template_simplify(spark, sf_dir):
    return templates.simplified_positions(_instances(spark, sf_dir)).withColumn("parameter", F.col("parameter").cast("int"))


@query(
    f"""{_SIMPLE}, shapes AS (
  SELECT template, list(coalesce(constant, '$__PARAM_' || CAST(parameter AS VARCHAR)) ORDER BY pos) AS slots, CAST(count(DISTINCT parameter) AS INTEGER) AS n_params FROM params GROUP BY template
), heads AS (SELECT template, any_value(pieces) AS pieces, count(*) AS num_instances FROM inst GROUP BY template)
SELECT h.template, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(slots[i], '')), '') AS text, n_params, num_instances
FROM heads h JOIN shapes s ON h.template = s.template"""
)
def template_simplified_text(spark, sf_dir):
    inst = _instances(spark, sf_dir)
    return templates.simplified_templates(inst).join(inst.groupBy("template").agg(F.count("*").alias("num_instances")), "template")


@query(f"{_WITH_INST} SELECT template, CAST(u.i AS INTEGER) AS pos, bindings[u.i + 1] AS value, count(*) AS num FROM inst, unnest(range(0, len(bindings))) AS u(i) GROUP BY 1, 2, 3")
def binding_distribution(spark, sf_dir):
    return templates.binding_counts(_instances(spark, sf_dir))


@query(
    f"""{_WITH_INST}, c AS (SELECT template, u.i AS pos, bindings[u.i + 1] AS value, count(*) AS num FROM inst, unnest(range(0, len(bindings))) AS u(i) GROUP BY 1, 2, 3),
n AS (SELECT template, count(*) AS num_instances FROM inst GROUP BY template), m AS (SELECT template, max(num) AS most FROM c GROUP BY template)
SELECT n.template, num_instances, most FROM n LEFT JOIN m ON n.template = m.template WHERE most IS NULL OR most <= num_instances * (1.0 - 0.3)"""
)
def binding_divergence(spark, sf_dir):
    return templates.divergent(_instances(spark, sf_dir), 0.3)


@query(f"{_WITH_INST} SELECT id FROM inst WHERE bindings[2] = '10' OR bindings[2] = bindings[4]")
def select_by_parameters(spark, sf_dir):
    inst = _instances(spark, sf_dir)
    wide = inst.filter(F.size("bindings") > 3)
    return templates.select_by_value(inst.filter(F.size("bindings") > 1), 1, "10").select("id").union(templates.select_by_equal(wide, 1, 3).select("id")).distinct()


@query(f"{_WITH_INST} SELECT DISTINCT template FROM inst WHERE template NOT IN (SELECT template FROM inst WHERE n_terms = 2)")
def queries_except(spark, sf_dir):
    inst = _instances(spark, sf_dir)
    return templates.except_texts(inst, inst.filter("n_terms = 2"), "template")


@query(
    f"""{_WITH_INST}, {_EXEC_TEMPLATE} SELECT template, count(*) AS n FROM et GROUP BY template UNION ALL SELECT '' AS template, count(*) AS n FROM et"""
)
def template_stats_total(spark, sf_dir):
    et = _executions_of_templates(spark, sf_dir)
    per = et.groupBy("template").agg(F.count("*").alias("n"))
    return stats.with_total(per, per.agg(F.lit("").alias("template"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


@query(
    f"{_WITH_INST}, {_EXEC_TEMPLATE} SELECT template, count(DISTINCT id) AS num_instances, count(*) AS num_exec, count(DISTINCT host) AS num_hosts FROM et GROUP BY template ORDER BY num_exec DESC, template LIMIT 10"
)
def template_top10(spark, sf_dir):
    et = _executions_of_templates(spark, sf_dir)
    per = et.groupBy("template").agg(F.count_distinct("id").alias("num_instances"), F.count("*").alias("num_exec"), F.count_distinct("host").alias("num_hosts"))
    return per.orderBy(F.desc("num_exec"), "template").limit(10)


@query(f"{_WITH_INST}, {_EXEC_TEMPLATE} SELECT template, host, count(DISTINCT id) AS num_instances FROM et GROUP BY template, host")
def template_hosts(spark, sf_dir):
    return _executions_of_templates(spark, sf_dir).groupBy("template", "host").agg(F.count_distinct("id").alias("num_instances"))


@query(
    f"{_WITH_INST}, {_EXEC_TEMPLATE} SELECT template, host, ts, count(DISTINCT id) AS num_instances, count(*) AS num_exec FROM et WHERE template LIKE 'ASK%' OR template LIKE 'DESCRIBE%' GROUP BY template, host, ts"
)
def template_timing(spark, sf_dir):
    et = _executions_of_templates(spark, sf_dir)
    wanted = et.filter(F.col("template").startswith("ASK") | F.col("template").startswith("DESCRIBE"))
    return wanted.groupBy("template", "host", "ts").agg(F.count_distinct("id").alias("num_instances"), F.count("*").alias("num_exec"))


@query(
    f"""{_WITH_INST}, {_EXEC_TEMPLATE} SELECT a.host, a.template AS template1, b.template AS template2, a.ts AS ts1, b.ts AS ts2
FROM et a JOIN et b ON a.host = b.host AND b.exec_id > a.exec_id AND b.id > a.id AND a.template <> b.template
  AND b.ts - a.ts BETWEEN INTERVAL '-1 hour' AND INTERVAL '1 hour'"""
)
def co_occurrence(spark, sf_dir):
    # numbers are compared, ids by their rank; texts go along with the executions: looked up afterwards, they would be joined to every pair
    inst = stats.numbered(graph.stored(_generalized(spark, sf_dir).select("id", "template")), [F.col("id")])
    log = executions(spark, sf_dir).select("exec_id", "ts", "host", "id").join(inst, "id")
    log = log.select("exec_id", "ts", "host", F.col("query_id").alias("id"), F.xxhash64("template").alias("template"), F.col("template").alias("text"))
    return stats.co_occurrences(log, shown="text")


# --- reports -------------------------------------------------------------------------------------

_HOST_ROLL = f"SELECT dataset, count(*) AS num_hosts, CAST(sum(n) AS BIGINT) AS num_exec, min(a) AS \"begin\", max(b) AS \"end\", {_entropy_sql('n')} AS entropy_hosts FROM (SELECT dataset, host, count(*) AS n, min(ts) AS a, max(ts) AS b FROM log WHERE host IS NOT NULL GROUP BY dataset, host) h GROUP BY dataset"
_QUERY_ROLL = f"SELECT dataset, count(*) AS num_queries, CAST(sum(n) AS BIGINT) AS num_exec, min(a) AS \"begin\", max(b) AS \"end\", {_entropy_sql('n')} AS entropy_queries FROM (SELECT dataset, id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM log GROUP BY dataset, id) q GROUP BY dataset"


@query(f"{_LOG} {_HOST_ROLL}")
def host_rollup_entropy(spark, sf_dir):
    return _rounded(stats.host_roll_up(stats.host_stats(executions(spark, sf_dir), "dataset")), "entropy_hosts")


@query(f"{_LOG} {_QUERY_ROLL}")
def query_rollup_entropy(spark, sf_dir):
    return _rounded(stats.query_roll_up(stats.query_stats(executions(spark, sf_dir), "dataset")), "entropy_queries")


def _template_stats(spark, sf_dir) -> DataFrame:
    """Roll-up of the simplified templates of each dataset."""
    inst = _instances(spark, sf_dir, "dataset")
    n_params = templates.simplified_positions(inst, ("dataset",)).groupBy("dataset", "template").agg((F.coalesce(F.max("parameter"), F.lit(-1)) + 1).alias("n_params"))
    rolled = templates.roll_up(inst, ("dataset",))
    return rolled.join(n_params, ["dataset", "template"], "left").withColumn("n_params", F.coalesce("n_params", F.lit(0))).withColumnRenamed("template", "text")


_TEMPLATE_DS = f"""{_WITH_INST_DS}, pos AS (
  SELECT dataset, template, id, u.i AS pos, bindings[u.i + 1] AS value FROM inst, unnest(range(0, len(bindings))) AS u(i)
), vec AS (
  SELECT dataset, template, pos, min(value) = max(value) AS fixed, md5(string_agg(id || '=' || value, ',' ORDER BY id)) AS v FROM pos GROUP BY dataset, template, pos
), np AS (SELECT dataset, template, count(DISTINCT v) FILTER (WHERE NOT fixed) AS n_params FROM vec GROUP BY dataset, template),
ts AS (
  SELECT i.dataset, i.template AS text, count(*) AS ni, sum(num_exec) AS ne, min(t_first) AS a, max(t_last) AS b, sum(log2(num_exec)) AS sl, max(n_terms) AS nt, coalesce(max(n_params), 0) AS np,
    CASE WHEN upper(i.template) LIKE '%CONSTRUCT%' THEN 'C' WHEN upper(i.template) LIKE '%ASK%' THEN 'A' WHEN upper(i.template) LIKE '%DESCRIBE%' THEN 'D' WHEN upper(i.template) LIKE '%SELECT%' THEN 'S' END AS ty
  FROM inst i LEFT JOIN np ON i.dataset = np.dataset AND i.template = np.template GROUP BY i.dataset, i.template
)"""


def _type_columns(kind: str) -> str:
    names = {"exec": "ne", "queries": "ni", "templates": "1"}
    if kind == "count":
        return ", ".join(f"CAST(sum(CASE WHEN ty = '{t}' THEN {x} ELSE 0 END) AS BIGINT) AS {n}_{t}" for n, x in names.items() for t in stats.TYPES)
    return ", ".join(f"round(sum(CASE WHEN ty = '{t}' THEN {x} ELSE 0 END) * 100.0 / sum({x}), 6) AS pct_{n}_{t}" for n, x in names.items() for t in stats.TYPES)


_TEMPLATE_ROLL = f"""SELECT dataset, count(*) AS num_templates, CAST(sum(ni) AS BIGINT) AS num_queries, CAST(sum(ne) AS BIGINT) AS num_exec, min(a) AS "begin", max(b) AS "end",
  {_entropy_sql('ne')} AS entropy_templates, round(sum(ne * (ni * log2(ne) - sl)) / sum(ne), 4) AS info_gain,
  CAST(max(nt) AS INTEGER) AS max_n_terms, round(CAST(sum(nt * ni) AS DOUBLE) / sum(ni), 6) AS avg_n_terms_by_query, round(avg(nt), 6) AS avg_n_terms_by_template,
  CAST(max(np) AS INTEGER) AS max_n_params, round(CAST(sum(np * ni) AS DOUBLE) / sum(ni), 6) AS avg_n_params_by_query, round(avg(np), 6) AS avg_n_params_by_template FROM ts GROUP BY dataset"""
_TERM_COLUMNS = ("max_n_terms", "avg_n_terms_by_query", "avg_n_terms_by_template", "max_n_params", "avg_n_params_by_query", "avg_n_params_by_template")


def _template_roll(spark, sf_dir) -> DataFrame:
    df = stats.template_roll_up(_template_stats(spark, sf_dir))
    df = _rounded(df, *[c for c in df.columns if c.startswith(("avg_", "pct_", "entropy"))])
    return df.withColumn("info_gain", F.round("info_gain", 4))


@query(f"{_TEMPLATE_DS} {_TEMPLATE_ROLL}")
def template_rollup_entropy(spark, sf_dir):
    df = _template_roll(spark, sf_dir)
    return df.select("dataset", "num_templates", "num_queries", "num_exec", "begin", "end", "entropy_templates", "info_gain", *_TERM_COLUMNS)


@query(f"{_TEMPLATE_DS} SELECT dataset, {_type_columns('count')}, {_type_columns('share')} FROM ts GROUP BY dataset")
def query_type_share(spark, sf_dir):
    df = _template_roll(spark, sf_dir)
    return df.select("dataset", *[c for c in df.columns if c.startswith(("exec_", "queries_", "templates_", "pct_"))])


def _layout(spark, sf_dir) -> DataFrame:
    """nr, dataset, level, label of the datasets that the report shows."""
    regions = _table(spark, sf_dir, "region").filter("r_regionkey < 3")
    return regions.select(F.col("r_regionkey").alias("nr"), F.concat(F.lit("ds"), F.col("r_regionkey").cast("string")).alias("dataset"), F.when(F.col("r_regionkey") == 1, 2).otherwise(1).alias("level"), F.col("r_name").alias("label"))


_LAYOUT = "layout AS (SELECT r_regionkey AS nr, 'ds' || r_regionkey AS dataset, CASE WHEN r_regionkey = 1 THEN 2 ELSE 1 END AS level, r_name AS label FROM region WHERE r_regionkey < 3)"
_REPORT = f"""SELECT nr, layout.dataset, level, label, q.num_queries, q.num_exec, q."begin", q."end", q.entropy_queries, h.num_hosts, h.entropy_hosts, t.num_templates, t.entropy_templates
FROM layout JOIN ({_QUERY_ROLL}) q ON layout.dataset = q.dataset JOIN ({_HOST_ROLL}) h ON layout.dataset = h.dataset JOIN ({_TEMPLATE_ROLL}) t ON layout.dataset = t.dataset"""


def _report(spark, sf_dir) -> DataFrame:
    log = executions(spark, sf_dir)
    hosts = stats.host_roll_up(stats.host_stats(log, "dataset"))
    queries_ = stats.query_roll_up(stats.query_stats(log, "dataset"))
    df = stats.report_table(_layout(spark, sf_dir), hosts, queries_, _template_roll(spark, sf_dir))
    return _rounded(df, "entropy_queries", "entropy_hosts").select(
        "nr", "dataset", "level", "label", "num_queries", "num_exec", "begin", "end", "entropy_queries", "num_hosts", "entropy_hosts", "num_templates", "entropy_templates"
    )


@query(f"{_TEMPLATE_DS}, {_LAYOUT} {_REPORT}")
def report_table(spark, sf_dir):
    return _report(spark, sf_dir)


@query(
    f"{_TEMPLATE_DS}, {_LAYOUT} SELECT nr, layout.dataset, level, label, t.num_queries, t.num_templates, {', '.join(_TERM_COLUMNS)} "
    f"FROM layout JOIN ({_TEMPLATE_ROLL}) t ON layout.dataset = t.dataset WHERE level = 1"
)
def report_terms(spark, sf_dir):
    return stats.terms_table(_layout(spark, sf_dir), _template_roll(spark, sf_dir))


@query(
    f"""{_TEMPLATE_DS}, {_LAYOUT} SELECT nr, CASE WHEN level = 1 THEN '\\primaryDataset{{' ELSE '\\secondaryDataset{{' END || label || '}} & ' || num_queries || ' & ' || num_templates || ' & ' || printf('%.2f', entropy_templates) || ' \\\\' AS line
FROM ({_REPORT}) r"""
)
def report_latex(spark, sf_dir):
    return stats.latex_rows(_report(spark, sf_dir), ["num_queries", "num_templates", "entropy_templates"])


# --- graphs --------------------------------------------------------------------------------------


def _links(spark, sf_dir) -> DataFrame:
    """Each part points at the part whose key is its size: a graph with cycles."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("src"), F.col("p_size").cast("long").alias("dst")).distinct()


_LINKS = "links AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS src, CAST(p_size AS BIGINT) AS dst FROM part)"


@query(f"WITH RECURSIVE {_LINKS}, c AS (SELECT src, dst FROM links UNION SELECT c.src, l.dst FROM c JOIN links l ON c.dst = l.src) SELECT src, dst FROM c")
def closure_descendants(spark, sf_dir):
    return graph.closure(_links(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_LINKS}, n AS (SELECT src AS x FROM links UNION SELECT dst FROM links), c AS (SELECT x AS src, x AS dst FROM n UNION SELECT c.src, l.dst FROM c JOIN links l ON c.dst = l.src) SELECT src, dst FROM c"
)
def closure_reflexive(spark, sf_dir):
    return graph.closure(_links(spark, sf_dir), reflexive=True)


@query(
    f"WITH RECURSIVE {_LINKS}, r AS (SELECT CAST(5 AS BIGINT) AS x UNION SELECT l.dst FROM r JOIN links l ON r.x = l.src) SELECT src AS s, 'p' AS p, dst AS o FROM links WHERE src NOT IN (SELECT x FROM r)"
)
def remove_subtree(spark, sf_dir):
    triples = _links(spark, sf_dir).select(F.col("src").alias("s"), F.lit("p").alias("p"), F.col("dst").alias("o"))
    return graph.remove_subtree(triples, triples.select("s").filter("s = 5").distinct())


def _all_links(spark, sf_dir) -> DataFrame:
    """Whole tables as one forest: region to nation to customer to order to line; each key is a node of its own."""
    key = lambda kind, *parts: F.concat_ws(".", F.lit(kind), *[F.col(c).cast("string") for c in parts])
    levels = (
        ("nation", key("r", "n_regionkey"), key("n", "n_nationkey")),
        ("customer", key("n", "c_nationkey"), key("c", "c_custkey")),
        ("orders", key("c", "o_custkey"), key("o", "o_orderkey")),
        ("lineitem", key("o", "l_orderkey"), key("l", "l_orderkey", "l_linenumber")),
    )
    out = None
    for name, src, dst in levels:
        part = _table(spark, sf_dir, name).select(src.alias("src"), dst.alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


_ALL_LINKS = """links AS (SELECT DISTINCT 'r.' || n_regionkey AS src, 'n.' || n_nationkey AS dst FROM nation
UNION SELECT 'n.' || c_nationkey, 'c.' || c_custkey FROM customer UNION SELECT 'c.' || o_custkey, 'o.' || o_orderkey FROM orders
UNION SELECT 'o.' || l_orderkey, 'l.' || l_orderkey || '.' || l_linenumber FROM lineitem)"""


@query(f"WITH RECURSIVE {_ALL_LINKS}, c AS (SELECT src, dst FROM links UNION SELECT c.src, l.dst FROM c JOIN links l ON c.dst = l.src) SELECT src, dst FROM c")
def closure_descendants_all(spark, sf_dir):
    return graph.closure(_all_links(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_ALL_LINKS}, n AS (SELECT src AS x FROM links UNION SELECT dst FROM links), c AS (SELECT x AS src, x AS dst FROM n UNION SELECT c.src, l.dst FROM c JOIN links l ON c.dst = l.src) SELECT src, dst FROM c"
)
def closure_reflexive_all(spark, sf_dir):
    return graph.closure(_all_links(spark, sf_dir), reflexive=True)


@query(
    f"WITH RECURSIVE {_ALL_LINKS}, r AS (SELECT 'n.5' AS x UNION SELECT l.dst FROM r JOIN links l ON r.x = l.src) SELECT src AS s, 'p' AS p, dst AS o FROM links WHERE src NOT IN (SELECT x FROM r)"
)
def remove_subtree_all(spark, sf_dir):
    triples = _all_links(spark, sf_dir).select(F.col("src").alias("s"), F.lit("p").alias("p"), F.col("dst").alias("o"))
    return graph.remove_subtree(triples, triples.select("s").filter("s = 'n.5'").distinct())


@query("SELECT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sequence_path(spark, sf_dir):
    first = _table(spark, sf_dir, "supplier").select("s_name", F.col("s_nationkey").alias("a"))
    second = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b"), "n_regionkey")
    third = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("c"), "r_name")
    return graph.path(graph.path(first, second, "a", "b"), third, "n_regionkey", "c")


@query(
    """SELECT DISTINCT s, p, o FROM (SELECT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'endpoint', 'http://' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey) t WHERE o <> 'r3'"""
)
def insert_and_delete(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    s = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    base = nation.select(s.alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("o"))
    found = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(s.alias("s"), F.lit("endpoint").alias("p"), F.concat(F.lit("http://"), "r_name").alias("o"))
    full = graph.insert_where(base, found)
    return graph.delete_where(full, full.filter("o = 'r3'"))


@query("SELECT DISTINCT l_suppkey AS s, 'part' AS p, l_partkey AS o FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def union_load(spark, sf_dir):
    triples = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("s"), F.lit("part").alias("p"), F.col("l_partkey").alias("o"))
    return graph.graph_merge(triples, "A", "R")


@query(
    """SELECT g, s, p, o FROM (SELECT 'http://ex.org/catalog' AS g, 'http://ex.org/' || unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS iri) f,
  LATERAL (SELECT 'http://ex.org/' AS s, 'http://www.w3.org/ns/sparql-service-description#namedGraph' AS p, iri AS o
  UNION ALL SELECT iri, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/ns/sparql-service-description#NamedGraph') t"""
)
def catalog_of_files(spark, sf_dir):
    """The tables' files as named graphs of a catalog."""
    return catalog_of_table_files(spark, sf_dir, "http://ex.org/catalog", "http://ex.org/", ".parquet")


@query("""SELECT doc_id, count(*) AS num_lines FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS line FROM documents) l WHERE line NOT LIKE '%the%' GROUP BY doc_id""")
def lines_left(spark, sf_dir):
    """Sentences of all documents as lines; those that hold a mark are dropped."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[.] ")).alias("value"))
    return lines_without(lines, "the").groupBy("doc_id").agg(F.count("*").alias("num_lines"))


@query(
    f"""WITH {LOG_SQL} SELECT dataset AS dataset_id, count(DISTINCT id) AS num_queries, count(*) AS num_exec, count(DISTINCT host) AS num_hosts, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS begin, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end" FROM log WHERE dataset <> 'ds2' GROUP BY dataset"""
)
def execution_graphs(spark, sf_dir):
    """The log as statements in a graph for each dataset; two of three datasets, and one without a graph, are in the catalog."""
    log = executions(spark, sf_dir).select(F.concat(F.lit(C.DATASETS), "dataset", F.lit("/execs")).alias("g"), F.concat(F.lit("e"), F.col("exec_id").cast("string")).alias("e"), "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "host")
    row = lambda s, p, o: F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"))
    quads = log.select("g", F.explode(F.array(row("id", C.LSQV + "hasRemoteExec", "e"), row("e", C.PROV + "atTime", "t"), row("e", C.LSQV + "hostHash", "host"))).alias("t")).select("g", "t.*").filter("o is not null")
    catalog = spark.createDataFrame([(C.DATASETS + n, C.RDF_TYPE, C.SERVICE + "NamedGraph") for n in ("ds0", "ds1", "ds9")], "s string, p string, o string")
    return stats.execution_graph_stats(catalog, quads)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
