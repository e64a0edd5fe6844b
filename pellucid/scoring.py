"""Scores of check results, on the driver for one run and as frames for a history of runs."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.functions.sampling import half_even

WEIGHTS = MappingProxyType({"error": 3, "warn": 1})
VERDICTS = ("pass", "fail", "warn", "errored", "skipped")


@dataclass(frozen=True)
class Score:
    """earned of possible weight among executed checks; value None where none was executed."""

    value: int | None
    earned: int
    possible: int
    executed: int
    skipped: int

    @property
    def coverage_percent(self) -> int | None:
        n = self.executed + self.skipped
        return half_even(100 * self.executed, n) if n else None


def _weight(check: dict) -> int:
    if check["severity"] not in WEIGHTS or check["verdict"] not in VERDICTS:
        raise ValueError(f"no such severity or verdict: {check['severity']!r}, {check['verdict']!r}")
    return WEIGHTS[check["severity"]]


def score(checks: list[dict]) -> Score:
    ran = [c for c in checks if _weight(c) and c["verdict"] != "skipped"]
    possible, earned = sum(map(_weight, ran)), sum(_weight(c) for c in ran if c["verdict"] == "pass")
    return Score(half_even(100 * earned, possible) if possible else None, earned, possible, len(ran), len(checks) - len(ran))


def by_suite(checks: list[dict]) -> dict[str, Score]:
    return {s: score([c for c in checks if c["suite_id"] == s]) for s in sorted({c["suite_id"] for c in checks})}


def deductions(checks: list[dict]) -> list[dict]:
    """The points that the rounded score lost, dealt out to the failed checks in proportion to their weights.

    Each check gets the whole part of its share; the points that are left go to the largest remainders (ties by
    suite and check), so the parts always sum to 100 less the score. Two checks of one suite and id are an error.
    """
    total = score(checks)
    if len({(c["suite_id"], c["id"]) for c in checks}) < len(checks):
        raise ValueError("a check stands twice")
    bad = sorted((c for c in checks if c["verdict"] not in ("pass", "skipped")), key=lambda c: (c["suite_id"], c["id"]))
    if total.value is None or not bad:
        return []
    lost, whole = 100 - total.value, sum(map(_weight, bad))
    points = [lost * _weight(c) // whole for c in bad]
    for i in sorted(range(len(bad)), key=lambda i: (-(lost * _weight(bad[i]) % whole), i))[: lost - sum(points)]:
        points[i] += 1
    return [{"suite_id": c["suite_id"], "check_id": c["id"], "points": p} for c, p in zip(bad, points)]


def totals(checks: list[dict]) -> dict[str, int]:
    count = Counter(c["verdict"] for c in checks)
    return {"checks": len(checks)} | {v: count[v] for v in VERDICTS}


def exit_code(checks: list[dict], status: str = "complete") -> int:
    """3 for a failed run; 1 if a check failed, or errored with severity error (a timeout of a partial run aside);
    2 for a partial run, for nothing executed and for warnings; else 0."""
    if status == "failed":
        return 3
    late = lambda c: status == "partial" and (c.get("error") or {}).get("code") == "engine.timeout"
    if any(c["verdict"] == "fail" or c["verdict"] == "errored" and c["severity"] == "error" and not late(c) for c in checks):
        return 1
    ran = [c for c in checks if c["verdict"] != "skipped"]
    return 2 if status == "partial" or not ran or any(c["verdict"] in ("warn", "errored") for c in ran) else 0


def _points(df: DataFrame) -> DataFrame:
    weight = F.when(F.col("severity") == "error", 3).otherwise(1)
    return df.withColumn("weight", F.when(F.col("verdict") != "skipped", weight).otherwise(0)).withColumn("earned", F.when(F.col("verdict") == "pass", F.col("weight")).otherwise(0))


def half_even_column(numerator, denominator):
    """Exact integer quotient, halves to even, for non-negative BIGINTs."""
    q, r = F.floor(numerator / denominator).cast("long"), (numerator % denominator).cast("long")
    q = ((numerator - r) / denominator).cast("long")
    return q + F.when((2 * r > denominator) | ((2 * r == denominator) & (q % 2 == 1)), 1).otherwise(0)


def score_frame(results: DataFrame, *by: str) -> DataFrame:
    """Score, weights and verdict counts for each group of a frame of check results (suite_id, id, severity, verdict)."""
    sums = _points(results).groupBy(*by).agg(
        F.sum("earned").cast("long").alias("earned"), F.sum("weight").cast("long").alias("possible"), F.count("*").alias("checks"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    )
    return sums.withColumn("score", F.when(F.col("possible") > 0, half_even_column(100 * F.col("earned"), F.col("possible"))))


def deduction_frame(results: DataFrame, run: str = "run_id") -> DataFrame:
    """deductions() for every run of a history: windows over a run's checks, no row leaves the executors."""
    whole = Window.partitionBy(run)
    rows = _points(results).withColumn("possible", F.sum("weight").over(whole)).withColumn("total", F.sum("earned").over(whole))
    bad = rows.where(~F.col("verdict").isin("pass", "skipped") & (F.col("possible") > 0))
    bad = bad.withColumn("lost", 100 - half_even_column((100 * F.col("total")).cast("long"), F.col("possible").cast("long"))).withColumn("failed", F.sum("weight").over(whole))
    bad = bad.withColumn("part", F.expr("lost * weight div failed")).withColumn("rest", F.expr("lost * weight % failed"))
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("rest"), "suite_id", "id"))
    extra = F.when(place <= F.col("lost") - F.sum("part").over(whole), 1).otherwise(0)
    return bad.select(run, "suite_id", F.col("id").alias("check_id"), (F.col("part") + extra).cast("long").alias("points"))
