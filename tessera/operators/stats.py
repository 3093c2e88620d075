"""Usage statistics of a log and the report tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.columns import entropy, information_gain, query_type
from tessera.operators.graph import stored


def _usage(grouped, *more):
    return grouped.agg(F.count("*").alias("num_exec"), *more, F.min("ts").alias("t_first"), F.max("ts").alias("t_last"))


def query_stats(log: DataFrame, *keys: str) -> DataFrame:
    """Per query id; executions without a host count, but add no host."""
    return _usage(log.groupBy(*keys, "id"), F.count_distinct("host").alias("num_hosts"))


def host_stats(log: DataFrame, *keys: str) -> DataFrame:
    """Per host; executions without one are left out."""
    return _usage(log.filter("host is not null").groupBy(*keys, "host"), F.count_distinct("id").alias("num_queries"))


def day_stats(log: DataFrame, *keys: str) -> DataFrame:
    """Per calendar day, of executions with a host."""
    days = log.filter("host is not null").groupBy(*keys, F.to_date("ts").alias("date"))
    return _usage(days, F.count_distinct("id").alias("num_queries"), F.count_distinct("host").alias("num_hosts"))


def dataset_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("dataset").agg(
        F.count_distinct("id").alias("num_queries"), F.count_distinct("exec_id").alias("num_exec"), F.count_distinct("host").alias("num_hosts"), F.min("ts").alias("begin"), F.max("ts").alias("end")
    )


def dataset_query_stats(log: DataFrame) -> DataFrame:
    """Per dataset: largest and average usage interval (seconds), hosts and executions of its queries.

    Averages are over executions: each execution brings its query's figures.
    """
    per_query = log.groupBy("dataset", "id").agg(
        F.count_distinct("exec_id").alias("q_exec"),
        F.count_distinct("host").alias("q_hosts"),
        F.count("*").alias("rows"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    seconds = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6
    per_query = per_query.withColumn("interval", seconds)
    average = lambda c: F.sum(F.col(c) * F.col("rows")) / F.sum("rows")
    return per_query.groupBy("dataset").agg(
        F.count("*").alias("num_queries"),
        F.sum("q_exec").alias("num_exec"),
        F.max("interval").alias("max_interval"),
        average("interval").alias("avg_interval"),
        F.max("q_hosts").alias("max_hosts"),
        average("q_hosts").alias("avg_hosts"),
        F.max("q_exec").alias("max_exec"),
        average("q_exec").alias("avg_exec"),
    )


def execution_graph_stats(catalog: DataFrame, quads: DataFrame, base: str = C.DATASETS) -> DataFrame:
    """dataset_id, num_queries, num_exec, num_hosts, begin, end of each named graph of the catalog (s, p, o) whose
    executions are in the graph (quads: g, s, p, o) of its name and '/execs'.

    All counts are distinct; a query without an execution, and an execution without a time, count
    nowhere. Everything is added up by graph before the catalog is joined, so the quads move by execution only.
    """
    part = lambda p, s, o: quads.filter(F.col("p") == p).select("g", F.col("s").alias(s), F.col("o").alias(o))
    rows = part(C.LSQV + "hasRemoteExec", "query", "exec").join(part(C.PROV + "atTime", "exec", "ts"), ["g", "exec"]).join(part(C.LSQV + "hostHash", "exec", "host"), ["g", "exec"], "left")
    sums = rows.groupBy("g").agg(
        F.count_distinct("query").alias("num_queries"), F.count_distinct("exec").alias("num_exec"), F.count_distinct("host").alias("num_hosts"), F.min("ts").alias("begin"), F.max("ts").alias("end")
    )
    graphs = catalog.filter((F.col("p") == C.RDF_TYPE) & (F.col("o") == C.SERVICE + "NamedGraph")).select(F.col("s").alias("dataset")).distinct()
    named = graphs.select(F.expr(f"substr(dataset, {len(base) + 1})").alias("dataset_id"), F.concat("dataset", F.lit("/execs")).alias("g"))
    return named.join(sums, "g").drop("g")


#: Executions of one host in one stretch of time that a task takes from either side.
CELL_ROWS = 20_000
#: Cells over that bound that are broadcast at most.
HEAVY_CELLS = 200_000
#: Parts that a stretch of time is cut into: the rows of a block are of one part.
PARTS = 8
#: Rows of a block, which are met or passed over together.
BLOCK_ROWS = 32
#: Rows that are put in order at once to be cut into blocks.
PACK_ROWS = 2_000


def _few_cells(cells: DataFrame) -> tuple[DataFrame, int]:
    """Stored, and hinted for a broadcast if they are few; and their number."""
    heavy = stored(cells)
    n = heavy.count()
    return (F.broadcast(heavy) if n <= HEAVY_CELLS else heavy), n


def _grid(left: DataFrame, right: DataFrame, cell: tuple[str, ...], left_id: str, right_id: str, right_rows: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_row`` and ``_column``: a cell with more than ``CELL_ROWS`` rows on a side is a grid of parts, as
    many rows and columns as its left and right rows need; left rows are dealt to its rows and repeated along the columns,
    right rows the other way round. All others are one part. Both come dealt by part, in a number of tasks of their own, as few
    bytes may be many pairs; not by the constants of an unsplit grid, which joins leave out and so would shuffle again.
    The column ``right_rows`` says for how many rows a right row stands, if not for itself.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = lambda df, n, rows=F.lit(1): df.groupBy(*cell).agg(F.sum(rows).alias("_n")).filter(F.col("_n") > CELL_ROWS).select(*cell, F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias(n))
    sizes = size(left, "_rows").unionByName(size(right, "_columns", F.col(right_rows) if right_rows else F.lit(1)), allowMissingColumns=True)
    side, n = _few_cells(sizes.groupBy(*cell).agg(*[F.coalesce(F.max(c), F.lit(1)).alias(c) for c in ("_rows", "_columns")]))
    if not n:
        return tuple(df.repartition(tasks, *cell).withColumns({"_row": F.lit(0), "_column": F.lit(0)}) for df in (left, right))

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        parts = lambda c: F.coalesce(f"{c}s", F.lit(1))
        met = df.join(side, list(cell), "left").withColumn(own, F.pmod(F.xxhash64(by), parts(own)).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), parts(other) - 1))).drop("_rows", "_columns").repartition(tasks, *cell, "_row", "_column")

    return dealt(left, left_id, "_row", "_column"), dealt(right, right_id, "_column", "_row")


def _blocks(rows: DataFrame, cell: list[str], by: str, then: str, bounded: list[str], row_id: str) -> DataFrame:
    """The rows of each cell in blocks of ``BLOCK_ROWS`` at most: the cell, ``rows`` (an array), ``n_rows``, ``first`` (the id of one row) and bounds,
    ``min_`` and ``max_``. A cell, or one of several shares where it has more than ``PACK_ROWS`` rows, is cut into slabs by the order of
    ``by`` and a slab into blocks by the order of ``then``, about as many slabs as blocks of a slab. ``by`` has the bounds of its slab, ``then`` those
    of its block, and the columns ``bounded`` those of their cell or share.
    """
    fields, share = [c for c in rows.columns if c not in cell], F.lit(0)
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n")).filter(F.col("_n") > PACK_ROWS)
    side, n = _few_cells(sizes.select(*cell, F.ceil(F.col("_n") / PACK_ROWS).alias("_shares")))
    if n:
        rows, share = rows.join(side, cell, "left"), F.pmod(F.xxhash64(row_id), F.coalesce("_shares", F.lit(1)))
    ends = [f(c).alias(f"{name}_{c}") for c in bounded for name, f in (("min", F.min), ("max", F.max))]
    led = lambda c: [c, *[x for x in fields if x != c]]
    packed = rows.groupBy(*cell, share.alias("_share")).agg(F.sort_array(F.collect_list(F.struct(*led(by)))).alias("_whole"), *ends)
    bounds = [f"{name}_{c}" for c in bounded for name in ("min", "max")]

    def cut(df: DataFrame, whole: str, size: Column, part: str, c: str) -> DataFrame:
        """``whole``, which is in the order of ``c``, in pieces of ``size``."""
        pieces = df.withColumn("_start", F.explode(F.sequence(F.lit(1), F.size(whole), size))).withColumn(part, F.slice(whole, F.col("_start"), size))
        return pieces.withColumns({f"min_{c}": F.element_at(part, 1)[c], f"max_{c}": F.element_at(part, -1)[c]}).drop("_start", whole)

    width = F.ceil(F.sqrt(F.size("_whole") * F.lit(float(BLOCK_ROWS)))).cast("int")
    slabs = cut(packed, "_whole", width, "_slab", by)
    slabs = slabs.select(*cell, *bounds, f"min_{by}", f"max_{by}", F.sort_array(F.transform("_slab", lambda r: F.struct(*[r[c].alias(c) for c in led(then)]))).alias("_slab"))
    return cut(slabs, "_slab", F.lit(BLOCK_ROWS), "rows", then).withColumns({"n_rows": F.size("rows"), "first": F.element_at("rows", 1)[row_id]})


def co_occurrences(events: DataFrame, seconds: int = 3600, shown: str = "template") -> DataFrame:
    """host, template1, template2, ts1, ts2 of executions of different templates by one host within ``seconds``.

    ``events`` has host, ts, exec_id, id, template; numbers are compared several times faster than texts, and the column ``shown``
    is what pairs show of a template. Pairs are ordered by execution and by query. Time is cut into stretches of ``seconds``; right
    rows are packed into blocks, and each block is dealt to its own stretch and both neighbours, so the join's key is host and
    stretch and no host meets itself over all time. Stretches in which a host has very many executions are found first and split
    over many tasks. A left row meets blocks: one whose bounds rule out all its rows costs one comparison.
    """
    at = F.col("ts").cast("timestamp_ntz")
    span = F.make_dt_interval(secs=F.lit(seconds))
    second = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at)
    usable = " and ".join(f"{c} is not null" for c in ("host", "ts", "exec_id", "id", "template"))
    rows = stored(events.filter(usable).select("host", "ts", "exec_id", "id", F.col("template").alias("kind"), F.col(shown).alias("template"), second.alias("second")))
    side = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("ts", "exec_id", "id", "kind", "template")]
    stretch = F.floor(F.col("second") / seconds).alias("stretch")
    left = rows.select("host", stretch, *side(1), (at - span).alias("since"), (at + span).alias("until"))
    right = rows.select("host", stretch, F.floor(F.col("second") * PARTS / seconds).alias("part"), *side(2), at.alias("at"))
    blocks = stored(_blocks(right, ["host", "stretch", "part"], "id2", "exec_id2", ["at"], "exec_id2"))
    blocks = blocks.withColumn("stretch", F.explode(F.sequence(F.col("stretch") - 1, F.col("stretch") + 1))).drop("part")
    left, blocks = _grid(left, blocks, ("host", "stretch"), "exec_id1", "first", "n_rows")
    some = (F.col("max_exec_id2") > F.col("exec_id1")) & (F.col("max_id2") > F.col("id1")) & (F.col("max_at") >= F.col("since")) & (F.col("min_at") <= F.col("until"))
    met = left.join(blocks, ["host", "stretch", "_row", "_column"]).filter(some)
    met = met.select("host", *[f"{c}1" for c in ("ts", "exec_id", "id", "kind", "template")], "since", "until", F.inline("rows"))
    pair = (F.col("kind1") != F.col("kind2")) & (F.col("exec_id2") > F.col("exec_id1")) & (F.col("id2") > F.col("id1")) & F.col("at").between(F.col("since"), F.col("until"))
    return met.filter(pair).select("host", "template1", "template2", "ts1", "ts2")


def host_roll_up(hosts: DataFrame) -> DataFrame:
    return hosts.groupBy("dataset").agg(F.count("*").alias("num_hosts"), F.sum("num_exec").alias("num_exec"), F.min("t_first").alias("begin"), F.max("t_last").alias("end"), entropy(F.col("num_exec")).alias("entropy_hosts"))


def query_roll_up(queries: DataFrame) -> DataFrame:
    return queries.groupBy("dataset").agg(F.count("*").alias("num_queries"), F.sum("num_exec").alias("num_exec"), F.min("t_first").alias("begin"), F.max("t_last").alias("end"), entropy(F.col("num_exec")).alias("entropy_queries"))


TYPES = ("S", "C", "A", "D")


def template_roll_up(templates: DataFrame, exact_types: bool = False) -> DataFrame:
    """Per dataset: totals, entropy, information gain, counts and shares by query type, terms and parameters.

    ``templates`` has dataset, text, num_instances, num_exec, t_first, t_last, sum_log2_exec, n_terms, n_params.
    """
    kind = query_type(F.col("text"), exact_types)
    rows = templates.withColumn("_type", kind)
    sums = [F.count("*").alias("num_templates"), F.sum("num_instances").alias("num_queries"), F.sum("num_exec").alias("num_exec")]
    out = [*sums, F.min("t_first").alias("begin"), F.max("t_last").alias("end"), entropy(F.col("num_exec")).alias("entropy_templates")]
    out.append(information_gain(F.col("num_exec"), F.col("num_instances"), F.col("sum_log2_exec")).alias("info_gain"))
    measures = {"exec": F.col("num_exec"), "queries": F.col("num_instances"), "templates": F.lit(1).cast("long")}
    for name, x in measures.items():
        out += [F.sum(F.when(F.col("_type") == t, x).otherwise(0)).alias(f"{name}_{t}") for t in TYPES]
    for name, x in measures.items():
        out += [(F.sum(F.when(F.col("_type") == t, x).otherwise(0)) * 100 / F.sum(x)).alias(f"pct_{name}_{t}") for t in TYPES]
    for c in ("n_terms", "n_params"):
        out += [F.max(c).alias(f"max_{c}"), (F.sum(F.col(c) * F.col("num_instances")) / F.sum("num_instances")).alias(f"avg_{c}_by_query"), F.avg(c).alias(f"avg_{c}_by_template")]
    return rows.groupBy("dataset").agg(*out)


def report_table(layout: DataFrame, hosts: DataFrame, queries: DataFrame, templates: DataFrame) -> DataFrame:
    """One row for each dataset of the layout, in its order (``nr``)."""
    q = queries.select("dataset", "num_queries", "num_exec", "begin", "end", "entropy_queries")
    t = templates.select("dataset", "num_templates", "entropy_templates", *[c for c in templates.columns if c.startswith("pct_exec_")])
    return layout.join(q, "dataset").join(hosts.select("dataset", "num_hosts", "entropy_hosts"), "dataset").join(t, "dataset").orderBy("nr")


def terms_table(layout: DataFrame, templates: DataFrame) -> DataFrame:
    """Terms and parameters of the primary datasets (level 1)."""
    terms = [c for c in templates.columns if "n_terms" in c or "n_params" in c]
    return layout.filter("level = 1").join(templates.select("dataset", "num_queries", "num_templates", *terms), "dataset").orderBy("nr")


def latex_rows(report: DataFrame, columns: list[str]) -> DataFrame:
    """nr, line: a table row in LaTeX; the label under a macro by level, fractions with two digits."""
    label = F.concat(F.when(F.col("level") == 1, F.lit("\\primaryDataset{")).otherwise(F.lit("\\secondaryDataset{")), "label", F.lit("}"))
    cells = [F.format_string("%.2f", F.col(c)) if dict(report.dtypes)[c] == "double" else F.col(c).cast("string") for c in columns]
    return report.select("nr", F.concat(F.concat_ws(" & ", label, *cells), F.lit(" \\\\")).alias("line"))


def with_total(stats: DataFrame, total: DataFrame) -> DataFrame:
    """A first row of totals with id 0."""
    return total.unionByName(stats)


def numbered(stats: DataFrame, order) -> DataFrame:
    """Rank by ``order``, from 1, as ``query_id``: a range shuffle sorts the rows, each partition numbers its own, and
    what the partitions before it hold is added (one row per partition)."""
    spark = stats.sparkSession
    at = F.monotonically_increasing_id()
    ranged = stored(stats.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before = [(part, sum(n for p, n in sizes.items() if p < part)) for part in sorted(sizes)]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn("query_id", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
