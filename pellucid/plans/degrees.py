"""Degrees of nodes, and the checks that are read off one histogram of them."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pellucid.errors import CheckError
from pellucid.graph import PropertyGraph

DIRECTIONS = ("out", "in", "any")


def check_direction(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise CheckError("engine.invalid_check", "direction must be out, in or any")


def ends(graph: PropertyGraph, type_: str | None, direction: str) -> DataFrame:
    """id and far (the other end) of every end that counts, from one scan; a self-loop counts once where both ends do."""
    check_direction(direction)
    rels = graph.rels(type_).select("src", "dst")
    if direction == "out":
        return rels.select(F.col("src").alias("id"), F.col("dst").alias("far"))
    if direction == "in":
        return rels.select(F.col("dst").alias("id"), F.col("src").alias("far"))
    end = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("far"))
    both = F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(end("src", "dst"))).otherwise(F.array(end("src", "dst"), end("dst", "src")))
    return rels.select(F.explode(both).alias("x")).select("x.*")


def degrees(graph: PropertyGraph, type_: str | None, direction: str, other: str | None = None) -> DataFrame:
    """id, degree of every node with at least one relationship (to a node of the other label, if one is given)."""
    rows = ends(graph, type_, direction)
    if other is not None:
        rows = rows.join(graph.nodes(other).select(F.col("id").alias("far")), "far", "left_semi")
    return rows.groupBy("id").agg(F.count("*").alias("degree"))


def histogram(rows: DataFrame) -> DataFrame:
    """degree, n: how many rows have each degree. Never more rows than different degrees."""
    return rows.groupBy("degree").agg(F.count("*").alias("n"))


def moments(n: Column, degree: Column) -> list[Column]:
    """m0, m1, m2: nodes, their degrees and the squares of these, summed. Whole numbers, so no order of adding matters."""
    wide = degree.cast("decimal(38,0)")
    return [F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in ((n, "m0"), (n * degree, "m1"), ((n.cast("decimal(38,0)") * wide * wide).cast("decimal(38,0)"), "m2"))]


def mean_and_deviation() -> tuple[Column, Column]:
    """Mean and population standard deviation from m0, m1, m2; 0 where there are no nodes."""
    n, s = F.col("m0").cast("decimal(38,0)"), F.col("m1").cast("decimal(38,0)")
    spread = (n * F.col("m2")).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
    some = F.col("m0") > 0
    return F.when(some, F.col("m1") / F.col("m0")).otherwise(0.0), F.when(some, F.sqrt(spread.cast("double")) / F.col("m0")).otherwise(0.0)


@dataclass(frozen=True)
class DegreeAsk:
    """What a check needs of the degrees of a label: over which relationships, and how many nodes count as violations.

    violation: a condition over degree, mean and deviation (the latter two of all nodes of the label). full: whether the
    summary has sample_size, mean_degree and degree_stddev too.
    """

    label: str
    type: str | None
    direction: str
    other: str | None
    violation: Callable[[Column, Column, Column], Column]
    full: bool = False

    @property
    def key(self) -> tuple:
        return "degrees", self.type, self.direction


class SharedDegrees:
    """Checks that ask for degrees over one relationship type and direction, answered together when the first is asked for.

    The relationships are scanned once: an end counts for a check with another label if the far node has it. The
    nodes of all labels meet that one table of degrees, and what goes on is its histogram for each label.
    """

    def __init__(self, graph: PropertyGraph, asks: dict):
        self.graph, self.asks, self.rows, self.lock = graph, asks, None, threading.Lock()

    def frame(self) -> DataFrame:
        """A row for each check: number, population, violation_count, mean_degree, degree_stddev."""
        asks = list(self.asks.values())
        first, others = asks[0], sorted({a.other for a in asks if a.other is not None})
        rows = ends(self.graph, first.type, first.direction)
        for i, other in enumerate(others):
            rows = rows.join(self.graph.nodes(other).select(F.col("id").alias("far"), F.lit(1).alias(f"o{i}")).distinct(), "far", "left")
        names = ["all", *[f"o{i}" for i in range(len(others))]]
        counts = rows.groupBy("id").agg(F.count("*").alias("all"), *[F.count(c).alias(c) for c in names[1:]])
        labels = sorted({a.label for a in asks})
        nodes = reduce(DataFrame.unionByName, [self.graph.nodes(x).select("id", F.lit(i).alias("label")) for i, x in enumerate(labels)])
        met = nodes.join(counts, "id", "left").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
        found = met.groupBy("label", *names).agg(F.count("*").alias("n"))
        sums = found.groupBy("label").agg(*moments(F.col("n"), F.col("all")))
        mean, deviation = mean_and_deviation()
        joined = found.join(F.broadcast(sums.select("label", "m0", mean.alias("mean"), deviation.alias("deviation"))), "label")  # a row for each label that a suite names
        cells = []
        for number, a in enumerate(asks):
            degree = F.col("all" if a.other is None else f"o{others.index(a.other)}")
            bad = a.violation(degree, F.col("mean"), F.col("deviation"))
            cells.append(F.when(F.col("label") == labels.index(a.label), F.struct(F.lit(number).alias("number"), F.when(bad, F.col("n")).otherwise(0).alias("bad"))))
        each = joined.select("m0", "mean", "deviation", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x"))
        return each.groupBy("x.number").agg(F.first("m0").alias("population"), F.sum("x.bad").alias("violation_count"), F.first("mean").alias("mean_degree"), F.first("deviation").alias("degree_stddev"))

    def row(self, key) -> dict | None:
        """The summary of a check; None if the common plan failed and each must see for itself."""
        with self.lock:
            if self.rows is None:
                try:
                    found = {r["number"]: r for r in self.frame().collect()}  # a row for each check
                    self.rows = {k: self._summary(a, found.get(i)) for i, (k, a) in enumerate(self.asks.items())}
                except Exception:  # a faulty table fails each check by itself
                    self.rows = {}
            return self.rows.get(key)

    @staticmethod
    def _summary(ask: DegreeAsk, row) -> dict:
        n, bad = (row["population"], row["violation_count"]) if row else (0, 0)
        more = {"sample_size": n, "mean_degree": row["mean_degree"] if row else 0.0, "degree_stddev": row["degree_stddev"] if row else 0.0} if ask.full else {}
        return {"population": n, "violation_count": bad} | more
