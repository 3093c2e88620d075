from __future__ import annotations

import random

from tessera.functions import columns as C
from tessera.operators import ingest
from tessera.streaming.ingest import OpenSets, Pairs, Queries, assembled_stream

SCHEMA = "file string, line long, s string, p string, o_value string"


def statements(seed, files=5):
    """Sets of one to three properties, names before or after them, executions that come again, queries without executions."""
    r = random.Random(seed)
    out = []
    for f in range(files):
        rows = []
        for n in range(25):
            exec_iri, query = f"{ingest.REMOTE_EXEC}{f}-{n % 6}", f"{ingest.QUERY_PREFIX}{r.randrange(9)}"
            group = [(exec_iri, C.LSQV + "hostHash", f"h{r.randrange(4)}") for _ in range(r.randrange(3))] + [(exec_iri, C.PROV + "atTime", f"t{f}-{n}")]
            name = (query, C.LSQV + "hasRemoteExec", exec_iri)
            rows += [name, *group] if r.random() < 0.5 else [*group, name]
            if r.random() < 0.2:
                rows.append((f"{ingest.REMOTE_EXEC}{f}-lone{n}", C.PROV + "atTime", "never named"))
        out += [(f"f{f}", 1000 * f + i, *x) for i, x in enumerate(rows)]
    return out + [("texts", 90000 + q, f"{ingest.QUERY_PREFIX}{q}", C.LSQV + "text", f"ASK {{ {q} }}") for q in range(12)]


def run(spark, source, sink, checkpoint, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = assembled_stream(stream, "http://ds", **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def test_stream_like_a_batch_with_a_restart(spark, tmp_path):
    rows = statements(3, files=3)
    files = sorted({r[0] for r in rows})
    random.Random(2).shuffle(files)
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    halves = ([], [])
    for k, f in enumerate(files):  # each file comes in two pieces, but for one that comes whole in the end
        own = [r for r in rows if r[0] == f]
        size = 0 if k == 1 else len(own) // 2
        halves[0].extend(own[:size])
        halves[1].extend(own[size:])
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for half in halves:  # the second run goes on from the first one's state
            spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            run(spark, source, sink, checkpoint, wait_ms=None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    out = spark.read.parquet(sink)
    queries, execs = ingest.assemble(spark.createDataFrame(rows, SCHEMA), "http://ds")
    pick = lambda df, *c: sorted(map(repr, (tuple(r) for r in df.select(*c).collect())))
    assert pick(out.filter("kind = 'execution'"), "dataset", "query_iri", "ts", "host") == pick(execs, "dataset", "query_iri", "ts", "host")
    assert pick(out.filter("kind = 'execution'"), "exec_iri") == pick(execs, "exec_iri")
    assert pick(out.filter("kind = 'query'"), "dataset", "query_iri", "id", "text") == pick(queries, "dataset", "query_iri", "id", "text")


class _Value:
    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, x):
        self.held = x

    put = update

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    getListState = getValueState

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class _Now:
    getCurrentProcessingTimeInMs = lambda self: 5000


def test_state_is_freed():
    from pyspark.sql import Row

    handle, pairs = _Handle(), Pairs(100)
    pairs.init(handle)
    event = lambda line, query=None, ts=None: Row(line=line, query_iri=query, ts=ts, hosts=["h"])
    assert list(pairs.handleInputRows(("f", "e"), iter([event(2, ts="t2"), event(1, ts="t1")]), _Now())) == []
    assert handle.timers == [5100] and handle.states["sets"].held is not None
    assert [(r.query_iri, r.ts) for r in pairs.handleInputRows(("f", "e"), iter([event(4, "q2"), event(3, "q1")]), _Now())] == [("q1", "t1"), ("q2", "t2")]
    assert handle.timers == [] and all(s.held is None for s in handle.states.values())
    list(pairs.handleInputRows(("f", "e"), iter([event(9, ts="t9")]), _Now()))
    assert list(pairs.handleExpiredTimer(("f", "e"), _Now(), None)) == [] and all(s.held is None for s in handle.states.values())

    handle, sets = _Handle(), OpenSets()
    sets.init(handle)
    row = lambda line, p, o: Row(line=line, s="e", p=p, o_value=o)
    assert list(sets.handleInputRows(("f",), iter([row(1, C.LSQV + "hostHash", "h")]), None)) == [] and handle.states["open"].held
    assert [r.hosts for r in sets.handleInputRows(("f",), iter([row(2, C.PROV + "atTime", "t")]), None)] == [["h"]] and handle.states["open"].held is None

    handle, queries = _Handle(), Queries("http://ds")
    queries.init(handle)
    assert list(queries.handleInputRows(("q",), iter([Row(ts=None, host=None, text="ASK {}")]), None)) == [] and handle.states["text"].held
    assert [r.kind for r in queries.handleInputRows(("q",), iter([Row(ts="t", host="h", text=None)]), None)] == ["execution", "query"] and handle.states["text"].held is None
