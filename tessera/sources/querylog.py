"""The query log as DataFrames: views of the driver's ``events`` as executions of synthetic queries.

Each event is an execution of a query whose text depends on the event's type, user and number, so
that the log has queries of all four types, shared templates and constants that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same log in SQL, for the oracles.
LOG_SQL = """
log AS (
  SELECT event_id AS exec_id, ts,
         'ds' || CAST(event_id % 3 AS VARCHAR) AS dataset,
         CASE WHEN user_id % 7 <> 0 THEN 'h' || CAST(user_id % 7 AS VARCHAR) END AS host,
         text, md5(text) AS id
  FROM (
    SELECT *, CASE event_type
      WHEN 'click' THEN 'PREFIX ex: <http://ex.org/> SELECT ?s WHERE { ?s ex:p' || u || ' ' || k || ' } LIMIT 10'
      WHEN 'view' THEN 'ASK { <http://ex.org/u' || u || '> ex:k ' || k || ' }'
      WHEN 'purchase' THEN 'CONSTRUCT { ?s ex:b ' || k || ' } WHERE { ?s ex:b ' || k || ' ; ex:u "u' || u || '"@en }'
      WHEN 'signup' THEN 'DESCRIBE <http://ex.org/u' || u || '>'
      ELSE 'SELECT * WHERE { ?a ex:e ' || k || ' . ?b ex:e ' || k || ' }' END AS text
    FROM (SELECT *, CAST(user_id AS VARCHAR) AS u, json_extract_string(props, '$.k') AS k FROM events) e
  ) t
)"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exec_id, ts, dataset, host (null for some), text, id of every execution."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(F.col("event_type") == "click", c("PREFIX ex: <http://ex.org/> SELECT ?s WHERE { ?s ex:p", u, " ", k, " } LIMIT 10"))
        .when(F.col("event_type") == "view", c("ASK { <http://ex.org/u", u, "> ex:k ", k, " }"))
        .when(F.col("event_type") == "purchase", c("CONSTRUCT { ?s ex:b ", k, " } WHERE { ?s ex:b ", k, ' ; ex:u "u', u, '"@en }'))
        .when(F.col("event_type") == "signup", c("DESCRIBE <http://ex.org/u", u, ">"))
        .otherwise(c("SELECT * WHERE { ?a ex:e ", k, " . ?b ex:e ", k, " }"))
    )
    return e.select(
        F.col("event_id").alias("exec_id"),
        "ts",
        F.concat(F.lit("ds"), (F.col("event_id") % 3).cast("string")).alias("dataset"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string"))).alias("host"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("id"),
    )


#: Texts with nested brackets by event type (null: all others), and their patterns; {u} and {k} as in the log.
BRACKETS = {
    "click": 'SELECT * WHERE { ?s ex:p{u} [ ex:q {k} ; ex:r ?z , ( {k} "u{u}" ) ] . [] ex:t ?s }',
    "view": "ASK { GRAPH ?g { <http://ex.org/u{u}> ex:in ( [ ex:k {k} ] () ) } OPTIONAL { ?a ex:x / ( ex:y | ex:z )* ?b } FILTER NOT EXISTS { ?a ex:no [ ex:no 1 ] } }",
    None: "SELECT ?x { { SELECT ?x WHERE { ?x ex:d{k} [ ex:e [ ex:f {u} ] ] } GROUP BY ?x LIMIT 5 } MINUS { ?x a ex:T } }",
}


def bracket_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, text: a query with nested property lists and collections for every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shape = F.lit(BRACKETS[None])
    for kind, text in BRACKETS.items():
        if kind:
            shape = F.when(F.col("event_type") == kind, text).otherwise(shape)
    filled = F.replace(F.replace(shape, F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{k}"), F.get_json_object("props", "$.k"))
    return e.select("event_id", filled.alias("text"))


def query_usage(log: DataFrame, *keys: str) -> DataFrame:
    """id, text with num_exec, t_first, t_last (within ``keys``)."""
    return log.groupBy(*keys, "id", "text").agg(F.count("*").alias("num_exec"), F.min("ts").alias("t_first"), F.max("ts").alias("t_last"))
