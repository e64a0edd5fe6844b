"""What a check compiles to, and how checks over one table share a scan."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class CheckPlan:
    """A one-row summary (population, violation_count, ...) and, apart from it, the evidence.

    evidence: kind, id, labels, type of the violating elements, unordered and unlimited; capped() bounds it.
    It is only run for a check that fails. base and aggregates stand for the summary where other checks may
    share its scan. repeats: how often an element may come at most, where several tables or properties give it.
    """

    name: str
    summary: DataFrame
    evidence: DataFrame | None
    measured: dict = field(default_factory=dict)
    base: DataFrame | None = None
    base_key: tuple | None = None
    aggregates: list[Column] = field(default_factory=list)
    columns: dict[str, Column] = field(default_factory=dict)
    repeats: int = 1
    #: What a table of degrees must answer, where this check can be read off one that others share.
    degrees: object | None = None
    #: What the summary has besides the two counts, from them.
    derived: Callable[[dict], dict] | None = None

    def row(self, counts: dict | None = None) -> dict:
        """The summary; with counts from a shared scan nothing is run."""
        return self.summary.first().asDict() if counts is None else counts | (self.derived(counts) if self.derived else {})

    def capped(self, cap: int) -> DataFrame:
        """The first `cap` elements by id: a heap of that size in each partition, no sort or shuffle of the rest.

        Where an element may come several times, so many more are taken first; the few that are left are made distinct.
        """
        first = self.evidence.orderBy("id").limit(cap * self.repeats)
        return first if self.repeats == 1 else first.dropDuplicates(["kind", "id"]).orderBy("id").limit(cap)


def node_evidence(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("node").alias("kind"), "id", "labels", F.lit(None).cast("string").alias("type"))


def rel_evidence(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("rel").alias("kind"), "id", F.lit(None).cast("array<string>").alias("labels"), "type")


def predicate_plan(name: str, base: DataFrame, base_key: tuple, population: Column, violation: Column, evidence: Callable[[DataFrame], DataFrame], extra: list[Column] = (), repeats: int = 1, labelled: DataFrame | None = None) -> CheckPlan:
    """Counts rows in the population and violations among them in one scan of the base. labelled: the same rows with what only evidence needs."""
    bad = F.coalesce(population & violation, F.lit(False))
    aggregates = [F.count_if(F.coalesce(population, F.lit(False))).alias("population"), F.count_if(bad).alias("violation_count"), *extra]
    return CheckPlan(name, base.agg(*aggregates), evidence((base if labelled is None else labelled).where(bad)), base=base, base_key=base_key, aggregates=aggregates, repeats=repeats)


class SharedScan:
    """Summaries of several predicate checks over one base, computed together when the first of them is asked for."""

    def __init__(self, plans: dict):
        self.plans, self.rows, self.lock = plans, None, threading.Lock()

    def row(self, key) -> dict | None:
        """population and violation_count of a check; None if the common scan failed and each must see for itself."""
        with self.lock:
            if self.rows is None:
                names = {f"c{i}": k for i, k in enumerate(self.plans)}
                try:
                    found = fuse({n: self.plans[k] for n, k in names.items()}).collect()  # a row for each check
                    self.rows = {names[r["check"]]: {"population": r["population"], "violation_count": r["violation_count"]} for r in found}
                except Exception:  # one faulty check must not take the others with it: they run alone, and it fails alone
                    self.rows = {}
            return self.rows.get(key)


def fuse(plans: dict[str, CheckPlan]) -> DataFrame:
    """One row for each check (check, population, violation_count); checks over one base share one scan.

    The aggregates of all predicate checks of a base become a single aggregation, whose row is then turned
    into a row for each check; plans without a base are appended as they are.
    """
    groups: dict[tuple, list[tuple[str, CheckPlan]]] = {}
    single = []
    for key, plan in plans.items():
        if plan.base_key is None:
            single.append((key, plan))
        else:
            groups.setdefault(plan.base_key, []).append((key, plan))
    parts = []
    for members in groups.values():
        columns = []
        for i, (_, plan) in enumerate(members):
            columns += [a.alias(f"{n}{i}") for a, n in zip(plan.aggregates[:2], ("p", "v"))]
        row = members[0][1].base.agg(*columns)
        out = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"p{i}").alias("population"), F.col(f"v{i}").alias("violation_count")) for i, (k, _) in enumerate(members)])
        parts.append(row.select(F.explode(out).alias("x")).select("x.*"))
    parts += [p.summary.select(F.lit(k).alias("check"), "population", "violation_count") for k, p in single]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
