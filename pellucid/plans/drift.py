"""Drift metrics: one number each, from counts without reading more than one column; many at once from one aggregation for each table."""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.errors import CheckError
from pellucid.graph import NodeSet, PropertyGraph
from pellucid.plans.base import CheckPlan

METRICS = ("node_count", "relationship_count", "property_coverage")
_TARGETS = {"node_count": {"label"}, "relationship_count": {"type"}, "property_coverage": {"label", "type", "property"}}


def check_target(graph: PropertyGraph, metric: str, target: dict) -> None:
    """Unknown metrics, keys that a metric does not take and names that the graph does not have are errors."""
    if metric not in METRICS:
        raise CheckError("engine.metric_unsupported", f"unknown metric {metric}")
    if extra := set(target) - _TARGETS[metric]:
        raise CheckError("engine.invalid_target", f"{metric} does not take {', '.join(sorted(extra))}")
    if any(not isinstance(v, str) or not v.strip() for v in target.values()):
        raise CheckError("engine.invalid_target", "targets are non-blank strings")
    label, type_ = target.get("label"), target.get("type")
    if metric == "property_coverage" and ("property" not in target or (label is None) == (type_ is None)):
        raise CheckError("engine.invalid_target", "property_coverage takes a property and either a label or a type")
    graph.require((label,), (type_,), (target["property"],) if "property" in target else ())


def drift_metric(graph: PropertyGraph, metric: str, target: dict | None = None) -> CheckPlan:
    """Summary: current (counts as BIGINT, coverage in percent, 100 where nothing has the owner) and population."""
    target = dict(target or {})
    check_target(graph, metric, target)
    label, type_ = target.get("label"), target.get("type")
    if metric == "node_count":
        return CheckPlan(metric, graph.nodes(label).agg(F.count("*").alias("current")).withColumn("population", F.col("current")), None)
    if metric == "relationship_count":
        return CheckPlan(metric, graph.rels(type_).agg(F.count("*").alias("current")).withColumn("population", F.col("current")), None)
    name = target["property"]
    rows = graph.nodes(label, [name]) if label else graph.rels(type_, [name])
    counts = rows.agg(F.count("*").alias("population"), F.count(F.col(f"`{name}`")).alias("present"))
    current = F.when(F.col("population") == 0, F.lit(100.0)).otherwise(100.0 * F.col("present") / F.col("population"))
    return CheckPlan(metric, counts.select(current.alias("current"), "population"), None)


def measure(graph: PropertyGraph, asks: dict) -> DataFrame:
    """number, current, population for each of many metrics ({any key: (metric, target)}, numbered in order).

    Every table is aggregated once, whatever the number of metrics over it, and tables that none asks for are not opened; all in
    one job. A metric over several tables is summed over them.
    """
    parts = []
    for s in (*graph.node_sets, *graph.rel_sets):
        is_node, sums, cells = isinstance(s, NodeSet), [], []
        names = (*s.labels, *s.optional) if is_node else (s.type,)
        asked, labelled = set(), False
        for number, (metric, target) in enumerate(asks.values()):
            about_nodes = metric == "node_count" or "label" in target
            owner = target.get("label" if about_nodes else "type")
            if about_nodes is not is_node or owner is not None and owner not in names:
                continue
            carries = F.array_contains("labels", owner) if is_node and owner is not None and owner not in s.labels else None
            labelled |= carries is not None
            name = target.get("property")
            total = F.count("*") if carries is None else F.count_if(carries)
            there = F.lit(0)
            if name is not None and name in s.properties:
                asked.add(name)
                there = F.count(F.col(f"`{name}`") if carries is None else F.when(carries, F.col(f"`{name}`")))
            sums += [total.alias(f"t{number}"), there.alias(f"p{number}")] if name is not None and name in s.properties else [total.alias(f"t{number}")]
            present = F.col(f"p{number}") if name is not None and name in s.properties else F.lit(0)
            cells.append(F.struct(F.lit(number).alias("number"), F.col(f"t{number}").cast("long").alias("total"), present.cast("long").alias("present")))
        if cells:
            rows = s.rows(asked, labelled) if is_node else s.df
            parts.append(rows.agg(*sums).select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    if not parts:
        return graph.spark.createDataFrame([], "number int, current double, population long")
    share = F.array_contains(F.array(*[F.lit(i) for i, (metric, _) in enumerate(asks.values()) if metric == "property_coverage"] or [F.lit(-1)]), F.col("number"))
    total = reduce(DataFrame.unionByName, parts).groupBy("number").agg(F.sum("total").alias("population"), F.sum("present").alias("present"))
    percent = F.when(F.col("population") == 0, F.lit(100.0)).otherwise(100.0 * F.col("present") / F.col("population"))
    return total.select("number", F.when(share, percent).otherwise(F.col("population").cast("double")).alias("current"), "population")


def against(measured: DataFrame, before: list) -> DataFrame:
    """Measures beside their baseline values (in the order of the metrics; null: none): number, current, population, baseline, delta, change_pct."""
    known = measured.sparkSession.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(before)], "number int, baseline double")
    delta = F.col("current") - F.col("baseline")
    change = F.when(F.col("baseline") != 0, 100.0 * delta / F.abs("baseline"))
    return known.join(measured, "number", "left").select("number", "current", "population", "baseline", delta.alias("delta"), change.alias("change_pct"))


class SharedDrift:
    """All drift measures of a run, taken together when the first is asked for."""

    def __init__(self, graph: PropertyGraph, asks: dict):
        self.graph, self.asks, self.rows, self.lock = graph, asks, None, threading.Lock()

    def row(self, key) -> dict | None:
        """current and population of a check; None where it must see for itself."""
        with self.lock:
            if self.rows is None:
                valid = {}
                for k, (metric, target) in self.asks.items():
                    try:
                        check_target(self.graph, metric, target)
                        valid[k] = metric, target
                    except CheckError:  # the check says so itself
                        continue
                try:
                    found = {r["number"]: r for r in measure(self.graph, valid).collect()}  # a row for each check
                    whole = lambda metric, x: x if metric == "property_coverage" else int(x)
                    self.rows = {k: {"current": whole(m, found[i]["current"]), "population": found[i]["population"]} for i, (k, (m, _)) in enumerate(valid.items()) if i in found}
                except Exception:  # one faulty table must not take the other checks with it
                    self.rows = {}
            return self.rows.get(key)
