"""Usage statistics as SQL texts with named parameters: one text each, run for any log and choice of datasets.

``:log`` names the log's view (dataset, exec_id, id, ts, host), ``:datasets`` is an array of the datasets that are told, or
null for all of them. Both are parameters of :func:`told_by`, never pasted into a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHOSEN = "(:datasets IS NULL OR array_contains(CAST(:datasets AS ARRAY<STRING>), dataset))"

HOSTS = f"""
SELECT dataset, host, count(*) AS num_exec, count(DISTINCT id) AS num_queries, min(ts) AS t_first, max(ts) AS t_last
FROM IDENTIFIER(:log) WHERE host IS NOT NULL AND {_CHOSEN} GROUP BY dataset, host
"""

QUERIES = f"""
SELECT dataset, id, count(*) AS num_exec, count(DISTINCT host) AS num_hosts, min(ts) AS t_first, max(ts) AS t_last
FROM IDENTIFIER(:log) WHERE {_CHOSEN} GROUP BY dataset, id
"""

DAYS = f"""
SELECT dataset, CAST(ts AS DATE) AS date, count(*) AS num_exec, count(DISTINCT id) AS num_queries, count(DISTINCT host) AS num_hosts, min(ts) AS t_first, max(ts) AS t_last
FROM IDENTIFIER(:log) WHERE host IS NOT NULL AND {_CHOSEN} GROUP BY dataset, CAST(ts AS DATE)
"""


def told_by(text: str, log: DataFrame, datasets: Iterable[str] | None = None) -> DataFrame:
    """The rows of a statement over ``log`` for these datasets (none: no rows; None: all, executions without a dataset too)."""
    spark, name = log.sparkSession, f"log_{uuid.uuid4().hex}"
    chosen = None if datasets is None else F.array(*[F.lit(d) for d in datasets])
    log.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args={"log": name, "datasets": chosen})
    finally:
        spark.catalog.dropTempView(name)  # the plan has been made; the view's name is not left to the session
