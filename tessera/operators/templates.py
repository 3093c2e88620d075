"""Templates: query texts with their constants replaced by parameters, grouped and simplified.

Instances stay rows throughout. Nothing gathers the instances of a template: what a template needs
of them are counts, extremes and fingerprints, all combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import identity_parameters, parameter_label, template_text
from tessera.operators.graph import join_by
from tessera.operators.tokenizer import TokenOptions, decompose, prologue_base, prologue_prefixes


def generalize(queries: DataFrame, options: TokenOptions = TokenOptions(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Instances: the query's columns with ``template``, ``pieces``, ``bindings``, ``n_terms``, ``preamble`` and ``instance``.

    ``template`` is the generalized text, the grouping key within ``keys`` (dataset, cluster, ...).
    ``instance`` tells rows apart (equal rows share it). Null texts are left out.
    """
    found = queries.filter("text is not null").withColumn("_d", decompose(F.col("text"), options))
    return found.select(
        *queries.columns,
        template_text(F.col("_d.pieces"), identity_parameters(F.col("_d.constants"))).alias("template"),
        F.col("_d.pieces").alias("pieces"),
        F.col("_d.constants").alias("bindings"),
        F.size("_d.constants").alias("n_terms"),
        F.col("_d.preamble").alias("preamble"),
        F.xxhash64(*[F.col(c) for c in queries.columns]).alias("instance"),
    )


def roll_up(instances: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per template: instances, executions, first and last time, sum of log2 of executions, original terms."""
    return instances.groupBy(*keys, "template").agg(
        F.count("*").alias("num_instances"),
        F.coalesce(F.sum("num_exec"), F.lit(0)).alias("num_exec"),
        F.min("t_first").alias("t_first"),
        F.max("t_last").alias("t_last"),
        F.sum(F.when(F.col("num_exec") > 0, F.log2("num_exec"))).alias("sum_log2_exec"),
        F.max("n_terms").alias("n_terms"),
    )


def above_thresholds(stats: DataFrame, min_instances: int = 0, min_executions: int = 0) -> DataFrame:
    return stats.filter((F.col("num_instances") >= min_instances) & (F.col("num_exec") >= min_executions))


def simple_queries(instances: DataFrame, min_instances: int, min_executions: int, min_simple_executions: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ids of queries whose template fails the thresholds and has this one instance; other failing templates vanish."""
    stats = instances.groupBy(*keys, "template").agg(
        F.count("*").alias("num_instances"), F.coalesce(F.sum("num_exec"), F.lit(0)).alias("num_exec"), F.min("id").alias("id")
    )
    failing = (F.col("num_instances") < min_instances) | (F.col("num_exec") < min_executions)
    return stats.filter(failing & (F.col("num_instances") == 1) & (F.col("num_exec") >= min_simple_executions)).select(*keys, "id", "num_exec")


def positions(instances: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per template and position: constant value if all instances agree, else the fingerprint of the value vector."""
    exploded = instances.select(*keys, "template", "instance", F.posexplode("bindings").alias("pos", "value"))
    vector = F.xxhash64("instance", "value")
    return exploded.groupBy(*keys, "template", "pos").agg(
        F.when(F.min("value") == F.max("value"), F.min("value")).alias("constant"),
        F.sum(vector.cast("decimal(20,0)")).alias("_sum"),
        F.bit_xor(F.xxhash64("value", "instance")).alias("_xor"),
    )


def simplified_positions(instances: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, template, pos, constant, first (lowest position with the same values), parameter (0-based; null if constant)."""
    of_template = [*keys, "template"]
    pos = positions(instances, keys)
    same = Window.partitionBy(*of_template, F.col("constant").isNull(), "_sum", "_xor")
    in_order = Window.partitionBy(*of_template, F.col("constant").isNull()).orderBy("first")
    return (
        pos.withColumn("first", F.when(F.col("constant").isNull(), F.min("pos").over(same)).otherwise(F.col("pos")))
        .withColumn("parameter", F.when(F.col("constant").isNull(), F.dense_rank().over(in_order) - 1))
        .select(*of_template, "pos", "constant", "first", "parameter")
    )


def _shape(simplified: DataFrame, of_template: list[str]) -> DataFrame:
    """The positions of a template in order; their number is bounded by the text's length."""
    return simplified.groupBy(*of_template).agg(F.array_sort(F.collect_list(F.struct("pos", "constant", "first", "parameter"))).alias("shape"))


def simplified_text(pieces: Column, shape: Column) -> Column:
    """Constants inlined, parameters renumbered."""
    slots = F.transform(shape, lambda s: F.coalesce(s["constant"], parameter_label(s["parameter"])))
    tail = F.zip_with(slots, F.slice(pieces, F.lit(2), F.size(pieces)), lambda slot, piece: F.concat(slot, piece))
    return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))


def simplified_templates(instances: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, template, text, n_params: the simplified text of each template, made once and not for each instance."""
    of_template = [*keys, "template"]
    shapes = _shape(simplified_positions(instances, keys), of_template)
    heads = instances.groupBy(*of_template).agg(F.first("pieces").alias("pieces"))
    joined = join_by(heads, shapes, of_template, "left").withColumn("shape", F.coalesce("shape", F.array().cast(shapes.schema["shape"].dataType)))
    kept = F.filter("shape", lambda s: s["constant"].isNull() & (s["first"] == s["pos"]))
    return joined.select(*of_template, simplified_text(F.col("pieces"), F.col("shape")).alias("text"), F.size(kept).alias("n_params"))


def simplify(instances: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The instances with ``text`` (of the simplified template), ``parameters`` (their number) and reduced ``bindings``.

    A parameter that is the same in all instances is inlined; parameters that are equal in every
    instance become the lowest of them. Vectors of values are compared by two 64-bit fingerprints.
    """
    of_template = [*keys, "template"]
    shapes = _shape(simplified_positions(instances, keys), of_template)
    joined = join_by(instances, shapes, of_template, "left").withColumn("shape", F.coalesce("shape", F.array().cast(shapes.schema["shape"].dataType)))
    kept = F.filter("shape", lambda s: s["constant"].isNull() & (s["first"] == s["pos"]))
    original = "text" in instances.columns
    return joined.select(
        *[c for c in instances.columns if c not in ("bindings", "text")],
        *([F.col("text").alias("original_text")] if original else []),
        simplified_text(F.col("pieces"), F.col("shape")).alias("text"),
        F.size(kept).alias("n_params"),
        F.transform(kept, lambda s: F.element_at(F.col("bindings"), s["pos"] + 1)).alias("bindings"),
    )


def merged_preambles(instances: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per template: base of the first instance that has one, and its prefixes, the last definition of a name counting."""
    base = instances.groupBy(*keys, "template").agg(F.min_by(prologue_base(F.col("preamble")), F.when(prologue_base(F.col("preamble")).isNotNull(), F.col(order))).alias("base"))
    names = instances.select(*keys, "template", F.col(order).alias("_order"), F.posexplode(prologue_prefixes(F.col("preamble"))).alias("_at", "p"))
    last = names.groupBy(*keys, "template", F.col("p.name").alias("name")).agg(F.max_by("p.iri", F.struct("_order", "_at")).alias("iri"))
    prefixes = last.groupBy(*keys, "template").agg(F.array_sort(F.collect_list(F.struct("name", "iri"))).alias("prefixes"))
    return join_by(base, prefixes, [*keys, "template"], "left").withColumn("prefixes", F.coalesce("prefixes", F.array().cast(prefixes.schema["prefixes"].dataType)))


def prologue_text(base: Column, prefixes: Column) -> Column:
    """Declarations in the order of their names, a line each."""
    lines = F.transform(prefixes, lambda p: F.concat(F.lit("PREFIX "), p["name"], F.lit(": <"), p["iri"], F.lit(">")))
    return F.array_join(F.concat(F.when(base.isNotNull(), F.array(F.concat(F.lit("BASE <"), base, F.lit(">")))).otherwise(F.array().cast("array<string>")), lines), "\n")


def binding_counts(instances: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each value is bound at each position of each template."""
    return instances.select(*keys, "template", F.posexplode("bindings").alias("pos", "value")).groupBy(*keys, "template", "pos", "value").agg(F.count("*").alias("num"))


def divergent(instances: DataFrame, min_ratio: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Templates where no value of a position is bound in more than (1 - ratio) of the instances (without a ratio: in
    all of them); templates without parameters pass."""
    of_template = [*keys, "template"]
    n = instances.groupBy(*of_template).agg(F.count("*").alias("num_instances"))
    most = binding_counts(instances, keys).groupBy(*of_template).agg(F.max("num").alias("most"))
    limit = F.col("num_instances") * F.lit(1.0 - min_ratio) if min_ratio else F.col("num_instances") - 1
    return join_by(n, most, of_template, "left").filter(F.col("most").isNull() | (F.col("most") <= limit)).select(*of_template, "num_instances", "most")


def select_by_value(instances: DataFrame, pos: int, value: str) -> DataFrame:
    """Instances with this value at a position; its constant inlined by :func:`simplify`."""
    return instances.filter(F.element_at("bindings", pos + 1) == value)


def select_by_equal(instances: DataFrame, pos: int, other: int) -> DataFrame:
    """Instances that have the same value at two positions."""
    return instances.filter(F.element_at("bindings", pos + 1) == F.element_at("bindings", other + 1))


def except_texts(queries: DataFrame, minus: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts that ``minus`` does not have."""
    return queries.select(text).distinct().join(minus.select(text).distinct(), text, "left_anti")
