"""The conformance checks as plans over a PropertyGraph."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pellucid.errors import CheckError
from pellucid.functions.canonical import canonical, canonical_of, digest
from pellucid.functions.sampling import bottom_k, decide
from pellucid.functions.types import DECLARED, family, has_type
from pellucid.graph import PropertyGraph
from pellucid.plans.base import CheckPlan, node_evidence, predicate_plan, rel_evidence
from pellucid.plans.degrees import DegreeAsk, check_direction, degrees, histogram, mean_and_deviation, moments


def _invalid(message: str) -> CheckError:
    return CheckError("engine.invalid_check", message)


def _named(**values) -> None:
    for k, v in values.items():
        if not isinstance(v, str) or not v.strip():
            raise _invalid(f"{k} must be a non-blank string")


@dataclass
class _Scan:
    """Nodes of a label with the properties of its own tables: unused ones are pruned, and every check of the label shares the base.

    labelled has the labels too, which only evidence needs; what stands beside a table is joined for those alone that ask for it.
    """

    base: DataFrame
    key: tuple
    labelled: DataFrame
    repeats: int

    def plan(self, name: str, population: Column, violation: Column) -> CheckPlan:
        return predicate_plan(name, self.base, self.key, population, violation, node_evidence, repeats=self.repeats, labelled=self.labelled)


def _scan(graph: PropertyGraph, label: str, columns: list[str]) -> _Scan:
    graph.require((label,), (), columns)
    own = [s for s in graph.node_sets if label in s.labels or label in s.optional]
    props = sorted({p for s in own for p in s.properties if p not in s.beside_columns} | set(columns))
    beside = {p for s in own for p in s.beside_columns} & set(columns)
    key = ("nodes", label, tuple(c for c in columns if c in beside or not any(c in s.properties for s in own)))
    return _Scan(graph.nodes(label, props), key, graph.nodes(label, props, with_labels=True), graph.copies(label))


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def completeness(graph: PropertyGraph, label: str, property: str, threshold: float = 1.0) -> CheckPlan:
    """Nodes of the label without the property; coverage is 1 where there are no nodes. Passes iff coverage >= threshold."""
    _named(label=label, property=property)
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 < threshold <= 1:
        raise _invalid("threshold must be over 0 and at most 1")
    plan = _scan(graph, label, [property]).plan("completeness", F.lit(True), _col(property).isNull())
    conforming = F.col("population") - F.col("violation_count")
    coverage = F.when(F.col("population") == 0, F.lit(1.0)).otherwise(conforming / F.col("population"))
    plan.summary = plan.summary.withColumn("conforming_count", conforming).withColumn("coverage", coverage)
    plan.measured = {"threshold": threshold}
    plan.derived = lambda c: {"conforming_count": c["population"] - c["violation_count"], "coverage": (c["population"] - c["violation_count"]) / c["population"] if c["population"] else 1.0}
    return plan


def with_degrees(graph: PropertyGraph, label: str, type_: str | None, direction: str, other: str | None = None) -> DataFrame:
    """Nodes of a label (id, labels) with their degree, 0 included."""
    nodes = graph.nodes(label, with_labels=True)
    return nodes.join(degrees(graph, type_, direction, other), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def cardinality(graph: PropertyGraph, from_label: str, rel_type: str, to_label: str, direction: str = "out", exactly: int = 1) -> CheckPlan:
    """Nodes whose number of relationships of the type to the other label is not exactly the given one."""
    _named(from_label=from_label, rel_type=rel_type, to_label=to_label)
    if isinstance(exactly, bool) or not isinstance(exactly, int) or exactly < 0:
        raise _invalid("exactly must be a whole number of 0 or more")
    graph.require((from_label, to_label), (rel_type,))
    check_direction(direction)
    base = with_degrees(graph, from_label, rel_type, direction, to_label)
    plan = predicate_plan("cardinality", base, ("degree", from_label, rel_type, direction, to_label), F.lit(True), F.col("degree") != exactly, node_evidence, repeats=graph.copies(from_label))
    plan.degrees = DegreeAsk(from_label, rel_type, direction, to_label, lambda degree, mean, deviation: degree != exactly)
    return plan


def no_orphans(graph: PropertyGraph, label: str, rel_type: str | None = None, direction: str = "any") -> CheckPlan:
    """Nodes of the label without a relationship: an anti-join on the endpoints, no counting of degrees."""
    _named(label=label, **({"rel_type": rel_type} if rel_type is not None else {}))
    check_direction(direction)
    graph.require((label,), (rel_type,))
    rels = graph.rels(rel_type)
    ends = {"out": rels.select("src"), "in": rels.select("dst"), "any": rels.select("src").union(rels.select("dst"))}[direction].toDF("id")
    alone = graph.nodes(label, with_labels=True).join(ends, "id", "left_anti")
    population = graph.nodes(label).agg(F.count("*").alias("population"))
    summary = population.crossJoin(alone.agg(F.count("*").alias("violation_count")))  # one row by one row
    ask = DegreeAsk(label, rel_type, direction, None, lambda degree, mean, deviation: degree == 0)
    return CheckPlan("no_orphans", summary, node_evidence(alone), repeats=graph.copies(label), degrees=ask)


def dangling_rels(graph: PropertyGraph, rel_type: str | None = None) -> CheckPlan:
    """Relationships whose start or end is no node. Needs the capability store_consistency."""
    if not graph.capabilities.get("store_consistency"):
        raise CheckError("engine.check_unobservable", "dangling relationships need the capability store_consistency")
    graph.require((), (rel_type,))
    rels, nodes = graph.rels(rel_type), graph.nodes().select("id").distinct()
    for end in ("src", "dst"):
        rels = rels.join(nodes.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    base = rels.select("id", "type", "has_src", "has_dst")
    return predicate_plan("dangling_rels", base, ("dangling", rel_type), F.lit(True), F.col("has_src").isNull() | F.col("has_dst").isNull(), rel_evidence)


def property_type(graph: PropertyGraph, label: str, property: str, type: str) -> CheckPlan:
    """Nodes whose property is there but not of the declared type."""
    _named(label=label, property=property)
    if type not in DECLARED:
        raise _invalid(f"type must be one of {', '.join(DECLARED)}")
    scan, col = _scan(graph, label, [property]), _col(property)
    return scan.plan("property_type", col.isNotNull(), ~has_type(col, scan.base.schema[property].dataType, type))


def whole_match(col: Column, regex: str) -> Column:
    """The pattern matches the whole string, line ends included."""
    return col.rlike(rf"\A(?:{regex})\z")


def check_regex(graph: PropertyGraph, regex: str) -> None:
    """A pattern must compile both for Python and for the JVM."""
    try:
        re.compile(regex)
        graph.spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
    except Exception as e:
        raise _invalid(f"regex does not compile: {str(e).splitlines()[0]}") from None


def property_format(graph: PropertyGraph, label: str, property: str, regex: str) -> CheckPlan:
    """Nodes whose property is there but no string, or a string that the pattern doesn't match as a whole."""
    _named(label=label, property=property, regex=regex)
    check_regex(graph, regex)
    scan, col = _scan(graph, label, [property]), _col(property)
    kind = family(scan.base.schema[property].dataType)
    text = F.try_variant_get(col, "$", "string") if kind == "variant" else col
    if kind == "variant":
        violation = (F.schema_of_variant(col) != "STRING") | ~whole_match(text, regex)
    else:
        violation = ~whole_match(text, regex) if kind == "string" else F.lit(True)
    return scan.plan("property_format", col.isNotNull(), violation)


def value_in_set(graph: PropertyGraph, label: str, property: str, values: list) -> CheckPlan:
    """Nodes whose property is there but none of the values; values of another type never match, numbers match whatever their width. A property of mixed types is looked at value by value."""
    _named(label=label, property=property)
    if not isinstance(values, (list, tuple)) or not values:
        raise _invalid("values must be a non-empty list")
    scan, col = _scan(graph, label, [property]), _col(property)
    kind = family(scan.base.schema[property].dataType)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind == "variant":
        found = canonical(col, T.VariantType()).isin([canonical_of(v) for v in values])
    else:
        fits = [v for v in values if (kind == "string" and isinstance(v, str)) or (kind == "boolean" and isinstance(v, bool)) or (kind in ("integer", "float") and number(v))]
        found = col.isin(fits) if fits else F.lit(False)
    return scan.plan("value_in_set", col.isNotNull(), ~found)


def uniqueness(graph: PropertyGraph, label: str, property: str) -> CheckPlan:
    """Nodes that share the property's value with another: all members of a group count, not the extra ones."""
    _named(label=label, property=property)
    scan, col = _scan(graph, label, [property]), _col(property)
    rows, kind = scan.base.where(col.isNotNull()), scan.base.schema[property].dataType
    # long values travel as 256-bit digests: what is shuffled does not grow with the texts; of mixed types 1 and 1.0 are one value
    key = digest(col, kind) if isinstance(kind, T.VariantType) else F.unhex(F.sha2(col.cast("binary"), 256)) if isinstance(kind, (T.StringType, T.BinaryType)) else col
    groups = rows.groupBy(key.alias("value")).agg(F.count("*").alias("n"))
    summary = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("population"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violation_count"))
    twins = scan.labelled.where(col.isNotNull()).select("id", "labels", key.alias("value")).join(groups.where("n > 1").select("value"), "value", "left_semi")
    return CheckPlan("uniqueness", summary, node_evidence(twins), repeats=graph.copies(label))


def hub_outlier(graph: PropertyGraph, label: str, rel_type: str | None = None, direction: str = "any", z_threshold: float = 3.0, sample_size: int | None = None, exhaustive_limit: int = 100_000, seed: int = 0, key: Column | None = None) -> CheckPlan:
    """Nodes whose degree is over mean + z * population standard deviation of the sampled nodes.

    All nodes count where the label has at most exhaustive_limit of them, else the sample_size nodes of the
    smallest hash rank (behind the gate, where there are many); degrees are then computed for those alone. The
    population comes from the table's metadata where it is stored plainly. key: a BIGINT column of the node table that
    the ranks hash (default: a digest of the id).
    """
    _named(label=label, **({"rel_type": rel_type} if rel_type is not None else {}))
    if isinstance(z_threshold, bool) or not isinstance(z_threshold, (int, float)) or not 0 < z_threshold < float("inf"):
        raise _invalid("z_threshold must be a finite number over 0")
    if sample_size is not None and (isinstance(sample_size, bool) or not isinstance(sample_size, int) or sample_size < 1):
        raise _invalid("sample_size must be 1 or more")
    check_direction(direction)
    graph.require((label,), (rel_type,))
    population = None if sample_size is None else graph.population(label)
    sampled = population is not None and decide(population, sample_size, exhaustive_limit) == "sampled"
    nodes = graph.nodes(label, with_labels=True)
    if sampled:
        rows = nodes if key is None else _scan(graph, label, []).labelled
        nodes = bottom_k(rows, F.xxhash64("id") if key is None else key, sample_size, seed, population=population).select("id", "labels")
    found = degrees(graph, rel_type, direction)
    if sampled:
        found = found.join(nodes.select("id"), "id", "left_semi")
    rows = nodes.join(found, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # one histogram gives the moments and, once they are known, the violations; its shuffle is used twice
    counts = histogram(rows)
    mean, deviation = mean_and_deviation()
    stats = counts.agg(*moments(F.col("n"), F.col("degree"))).select(F.col("m0").alias("sample_size"), mean.alias("mean_degree"), deviation.alias("degree_stddev"))
    over = lambda degree, mean, deviation: (deviation > 0) & (degree > mean + F.lit(float(z_threshold)) * deviation)
    hub = over(F.col("degree"), F.col("mean_degree"), F.col("degree_stddev"))
    bad = counts.crossJoin(F.broadcast(stats)).agg(F.coalesce(F.sum(F.when(hub, F.col("n"))), F.lit(0)).alias("violation_count"))  # stats is one row
    size = F.lit(population) if sampled else F.col("sample_size")
    summary = stats.crossJoin(bad).select(size.cast("long").alias("population"), "sample_size", "violation_count", "mean_degree", "degree_stddev")
    hubs = rows.crossJoin(F.broadcast(stats)).where(hub)
    ask = None if sampled else DegreeAsk(label, rel_type, direction, None, over, full=True)
    return CheckPlan("hub_outlier", summary, node_evidence(hubs), {"z_threshold": z_threshold}, repeats=graph.copies(label), degrees=ask)


def label_cooccurrence(graph: PropertyGraph, label_a: str, label_b: str) -> CheckPlan:
    """Nodes with either label that have both."""
    _named(label_a=label_a, label_b=label_b)
    if label_a == label_b:
        raise _invalid("the two labels must differ")
    graph.require((label_a, label_b))
    has = lambda x: F.array_contains("labels", x)
    base = graph.nodes_of_any(label_a, label_b)
    return predicate_plan("label_cooccurrence", base, ("any", label_a, label_b), has(label_a) | has(label_b), has(label_a) & has(label_b), node_evidence, repeats=graph.copies(label_a, label_b))


def rel_direction(graph: PropertyGraph, from_label: str, to_label: str, rel_type: str) -> CheckPlan:
    """Relationships of the type between the labels that run from to_label to from_label."""
    _named(from_label=from_label, to_label=to_label, rel_type=rel_type)
    if from_label == to_label:
        raise _invalid("the two labels must differ")
    graph.require((from_label, to_label), (rel_type,))
    rels = graph.rels(rel_type).select("id", "type", "src", "dst")
    side = lambda end: graph.nodes_of_any(from_label, to_label).select(F.col("id").alias(end), F.array_contains("labels", from_label).alias(f"{end}_from"), F.array_contains("labels", to_label).alias(f"{end}_to"))
    base = rels.join(side("src"), "src").join(side("dst"), "dst")
    right, wrong = F.col("src_from") & F.col("dst_to"), F.col("src_to") & F.col("dst_from")
    return predicate_plan("rel_direction", base, ("direction", from_label, to_label, rel_type), right | wrong, wrong, rel_evidence, repeats=graph.copies(from_label, to_label) ** 2)


def temporal_sanity(graph: PropertyGraph, label: str, start_property: str, end_property: str) -> CheckPlan:
    """Nodes with both properties whose end lies before its start; values of different families never compare."""
    _named(label=label, start_property=start_property, end_property=end_property)
    if start_property == end_property:
        raise _invalid("the two properties must differ")
    scan = _scan(graph, label, [start_property, end_property])
    start, end = _col(start_property), _col(end_property)
    kinds = [scan.base.schema[p].dataType for p in (start_property, end_property)]
    return scan.plan("temporal_sanity", start.isNotNull() & end.isNotNull(), _before(end, kinds[1], start, kinds[0]))


#: How values of mixed types are read so that they compare: the schemas that Spark names, and the type for them.
_COMPARED = {"double": ("DOUBLE", "FLOAT", "DECIMAL", "BIGINT", "INT", "SMALLINT", "TINYINT"), "date": ("DATE",), "timestamp": ("TIMESTAMP",), "timestamp_ntz": ("TIMESTAMP_NTZ",), "string": ("STRING",)}


def _before(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """a < b where both are of one family; a NaN lies neither before nor behind anything."""
    if isinstance(a_kind, T.VariantType) and isinstance(b_kind, T.VariantType):
        out = F.lit(False)
        for kind, names in _COMPARED.items():
            own = lambda x, names=names: F.regexp_extract(F.schema_of_variant(x), r"^\w+", 0).isin(*names)
            x, y = (F.try_variant_get(v, "$", kind) for v in (a, b))
            less = (x < y) & ~F.isnan(x) & ~F.isnan(y) if kind == "double" else x < y
            out = F.when(own(a) & own(b), less).otherwise(out)
        return out
    if a_kind != b_kind and not {family(a_kind), family(b_kind)} <= {"integer", "float"}:
        return F.lit(False)
    less = a < b
    for x, kind in ((a, a_kind), (b, b_kind)):
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            less = less & ~F.isnan(x)
    return less
