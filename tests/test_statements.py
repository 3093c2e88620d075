from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.plans import statements


def _log(spark):
    rows = [(None if i % 5 == 0 else f"d'{i % 3}", i, f"q{i % 4}", f"2020-01-0{1 + i % 3} 10:00:00", None if i % 7 == 0 else f"h{i % 2}") for i in range(40)]
    return spark.createDataFrame(rows, "dataset string, exec_id int, id string, ts string, host string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_texts_like_the_columns_for_every_choice_of_datasets(spark):
    log = _log(spark)
    for text, plain in ((statements.HOSTS, stats.host_stats), (statements.QUERIES, stats.query_stats), (statements.DAYS, stats.day_stats)):
        for chosen in (None, [], ["d'1"], ["d'0", "d'2", "none"]):
            want = plain(log if chosen is None else log.filter(F.col("dataset").isin(chosen)), "dataset")
            got = statements.told_by(text, log, chosen).select(*want.columns)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_view_stays_behind(spark):
    statements.told_by(statements.HOSTS, _log(spark)).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("log_")]
