"""Ingest as a stream: statements of dump files become queries and executions as they come.

Three stateful operators, each with keyed state that is freed as soon as it has served:

* by file, the execution set that is still open at the end of a batch;
* by file and execution, the queues of sets that no query has named yet and of names without a set; the k-th
  of either are a pair, and what stays alone for too long is dropped by a timer;
* by query, its text until an execution has named it, and the number of its executions.

Files may come in any order and in pieces; the statements of one file come in the order of its lines. Queries and
executions are those of :func:`tessera.operators.ingest.assemble`, but that a query's executions are numbered as
they come.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.columns import LSQV, PROV
from tessera.operators.ingest import QUERY_PREFIX, REMOTE_EXEC

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "file string, exec_iri string, line long, query_iri string, ts string, hosts array<string>"
#: How long a set waits for its query, or a name for its set, in milliseconds, in a stream that goes on.
WAIT_MS = 3_600_000


class OpenSets(StatefulProcessor):
    """By file: a set of execution properties ends at its time; what follows belongs to the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "name string, hosts array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else None
        name, hosts = (held[0], list(held[1])) if held else (None, [])
        for r in sorted(rows, key=lambda r: r.line):
            name = name or r.s
            if r.p == PROV + "atTime":
                yield Row(file=key[0], exec_iri=name, line=r.line, query_iri=None, ts=r.o_value, hosts=hosts)
                name, hosts = None, []
            elif r.p == LSQV + "hostHash":
                hosts.append(r.o_value)
        if name is None:
            self.open.clear()
        else:
            self.open.update((name, hosts))

    def close(self) -> None:
        pass


class Pairs(StatefulProcessor):
    """By file and execution: the k-th set with the k-th query that names it. Without ``wait_ms`` nothing is ever dropped."""

    def __init__(self, wait_ms: int | None = WAIT_MS):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getListState("names", "query_iri string")
        self.sets = handle.getListState("sets", "ts string, hosts array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names, sets = ([tuple(x) for x in state.get()] if state.exists() else [] for state in (self.names, self.sets))
        for r in sorted(rows, key=lambda r: r.line):
            if r.query_iri is None:
                sets.append((r.ts, list(r.hosts)))
            else:
                names.append((r.query_iri,))
        paired = min(len(names), len(sets))
        for (query_iri,), (ts, hosts) in zip(names[:paired], sets[:paired]):
            for host in hosts or [None]:
                yield Row(query_iri=query_iri, ts=ts, host=host, text=None)
        for state, left in ((self.names, names[paired:]), (self.sets, sets[paired:])):
            if left:
                state.put(left)
            else:
                state.clear()
        if self.wait_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(names) != len(sets):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.names.clear()
        self.sets.clear()
        return iter([])

    def close(self) -> None:
        pass


class Queries(StatefulProcessor):
    """By query: an execution for each pair, numbered, and the text once, when a first execution has named the query."""

    def __init__(self, dataset: str):
        self.dataset = dataset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", "text string")
        self.count = handle.getValueState("count", "n long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        import hashlib

        n, told = tuple(self.count.get()) if self.count.exists() else (0, False)
        text = self.text.get()[0] if self.text.exists() else None
        for r in rows:
            if r.ts is None:
                text = r.text if text is None else text
                continue
            n += 1
            digest = hashlib.md5(key[0].encode()).hexdigest()
            yield Row(dataset=self.dataset, kind="execution", query_iri=key[0], exec_iri=f"{self.dataset}/executions/{digest}-{n}", ts=r.ts, host=r.host, text=None)
        if n and text is not None and not told:
            yield Row(dataset=self.dataset, kind="query", query_iri=key[0], exec_iri=None, ts=None, host=None, text=text)
            told = True
        # the text is not needed again once it is told
        if told or text is None:
            self.text.clear()
        else:
            self.text.update((text,))
        self.count.update((n, told))

    def close(self) -> None:
        pass


def assembled_stream(triples: DataFrame, dataset: str, wait_ms: int | None = WAIT_MS) -> DataFrame:
    """dataset, kind (query or execution), query_iri, id, exec_iri, ts, host, text of a stream of statements (file, line, s, p,
    o_value). State is kept by RocksDB, so it need not fit into the executors' memory.

    Timers run on processing time, for which Spark starts batches without data too: a run over what is available
    now (``trigger(availableNow=True)``) ends only with ``wait_ms=None``.
    """
    spark: SparkSession = triples.sparkSession
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    own = triples.filter(F.col("s").startswith(REMOTE_EXEC)).select("file", "line", "s", "p", "o_value")
    sets = own.groupBy("file").transformWithState(OpenSets(), _EVENT, "Append", "None")
    named = triples.filter(F.col("p") == LSQV + "hasRemoteExec").select("file", F.col("o_value").alias("exec_iri"), "line", F.col("s").alias("query_iri"), F.lit(None).cast("string").alias("ts"), F.array().cast("array<string>").alias("hosts"))
    pairs = sets.unionByName(named).groupBy("file", "exec_iri").transformWithState(Pairs(wait_ms), "query_iri string, ts string, host string, text string", "Append", "None" if wait_ms is None else "ProcessingTime")
    texts = triples.filter(F.col("p") == LSQV + "text").select(F.col("s").alias("query_iri"), F.lit(None).cast("string").alias("ts"), F.lit(None).cast("string").alias("host"), F.col("o_value").alias("text"))
    out = pairs.unionByName(texts).groupBy("query_iri").transformWithState(Queries(dataset), "dataset string, kind string, query_iri string, exec_iri string, ts string, host string, text string", "Append", "None")
    return out.select("dataset", "kind", "query_iri", F.expr(f"substr(query_iri, {len(QUERY_PREFIX) + 1})").alias("id"), "exec_iri", "ts", "host", "text")
