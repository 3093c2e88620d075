from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import rdf
from tessera.sources.rolling import write_rolling


def read(folder):
    out = {}
    for name in sorted(os.listdir(folder)):
        opened = gzip.open if name.endswith(".gz") else open
        with opened(os.path.join(folder, name), "rt", encoding="utf-8", newline="") as f:
            out[name] = f.read()
    return out


@pytest.mark.parametrize("suffix", [".nt.gz", ".txt"])
def test_files_roll_by_characters(spark, tmp_path, suffix):
    lines = spark.range(0, 3000, 1, 3).select(F.concat(F.lit("<http://é/"), F.repeat(F.lit("🙂x"), (F.col("id") % 40).cast("int")), F.lit("> .")).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("y" * 5000,), (None,), ("",)], "value string"))
    write_rolling(lines, str(tmp_path / "out"), 1000, suffix)
    found = read(tmp_path / "out")
    assert len(found) > 100 and all(len(t) <= 1000 or t == "y" * 5000 + "\n" for t in found.values())
    assert sum(len(t) > 900 for t in found.values()) > 0.9 * (len(found) - 8)
    got = sorted(x for t in found.values() for x in t.split("\n")[:-1])
    assert got == sorted(r.value or "" for r in lines.collect())
    # more files, then others in their place
    write_rolling(lines.limit(5), str(tmp_path / "out"), 1000, suffix, append=True)
    assert len(read(tmp_path / "out")) > len(found)
    write_rolling(lines.limit(0), str(tmp_path / "out"), 1000, suffix)
    assert read(tmp_path / "out") == {}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    lines = spark.range(0, 100, 1, 2).select(F.col("id").cast("string").alias("value"))
    write_rolling(lines, str(folder), 50)
    before = read(folder)
    failing = lines.select(F.when(F.col("value") == "99", F.raise_error(F.lit("stop"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="stop"):
        write_rolling(failing, str(folder), 50)
    assert read(folder) == before


def test_statements_round_trip(spark, tmp_path):
    lines = spark.range(500).select(F.format_string('<http://s/%d> <http://p> "text \\\\n %d" .', "id", "id").alias("value"))
    write_rolling(lines, str(tmp_path / "out"), 2000)
    again = rdf.read_triples(spark, str(tmp_path / "out"))
    assert again.count() == 500 and again.filter("bad").count() == 0 and again.select("s").distinct().count() == 500
