"""Reports of one run: a static page without scripts, and the tables behind it."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid import scoring
from pellucid.history import rank

FAILURES = ("fail", "warn", "errored")


def ordered(checks: list[dict], verdicts=None) -> list[dict]:
    """Worst first, then by severity, suite and id; only the given verdicts."""
    return sorted((c for c in checks if verdicts is None or c["verdict"] in verdicts), key=lambda c: (-rank(c), c["severity"] != "error", c["suite_id"], c["id"]))


def ordered_frame(results: DataFrame, verdicts=None, run: str = "run_id") -> DataFrame:
    """ordered() for every run of a history: `place` counts the checks of a run from the worst on."""
    from pellucid.history import rank_column

    kept = results if verdicts is None else results.where(F.col("verdict").isin(*verdicts))
    order = Window.partitionBy(run).orderBy(F.desc(rank_column()), F.col("severity") != "error", "suite_id", "id")
    return kept.withColumn("place", F.row_number().over(order).cast("long"))


def not_evaluated(results: dict) -> list[dict]:
    return [{"suite_id": c["suite_id"], "id": c["id"], "reason": c["skip_reason"]} for c in sorted(results["checks"], key=lambda c: (c["suite_id"], c["id"])) if c["verdict"] == "skipped"]


def suite_table(results: dict) -> list[dict]:
    out = []
    for s in results["suites"]:
        t = s["totals"]
        out.append({"suite": s["id"], "score": s["score"], "evaluated": t["checks"] - t["skipped"], "selected": t["checks"]} | {v: t[v] for v in scoring.VERDICTS})
    return out


def suite_frame(results: DataFrame, run: str = "run_id") -> DataFrame:
    """suite_table() for every run of a history: score, checks that were evaluated of those selected, and verdicts of each suite."""
    found = scoring.score_frame(results, run, "suite_id")
    return found.select(run, F.col("suite_id").alias("suite"), "score", (F.col("checks") - F.col("skipped")).alias("evaluated"), F.col("checks").alias("selected"), *scoring.VERDICTS)


def not_evaluated_frame(results: DataFrame, run: str = "run_id") -> DataFrame:
    """not_evaluated() for every run: skipped checks and why, in the order of a report (`place`)."""
    skipped = results.where("verdict = 'skipped'")
    return skipped.select(run, "suite_id", "id", F.col("skip_reason").alias("reason"), F.row_number().over(Window.partitionBy(run).orderBy("suite_id", "id")).cast("long").alias("place"))


def headline(results: dict) -> str:
    t, total = results["totals"], scoring.score(results["checks"])
    if total.value is None:
        return f"No check was evaluated ({t['skipped']} skipped)."
    return f"Score {total.value} of 100: {t['pass']} of {total.executed} checks pass, {t['fail']} fail, {t['warn']} warn, {t['errored']} errored; {total.coverage_percent} % of the selected checks were evaluated."


def html(results: dict, verdicts=None) -> str:
    """One self-contained page."""
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    table = lambda head, rows: "<table>" + row(head, "th") + "".join(map(row, rows)) + "</table>"
    suites = suite_table(results)
    checks = [(c["verdict"], c["severity"], c["suite_id"], c["id"], c["name"], (c["evidence"] or {}).get("message") or (c["error"] or {}).get("message") or c["skip_reason"]) for c in ordered(results["checks"], verdicts)]
    lost = [(d["suite_id"], d["check_id"], d["points"]) for d in scoring.deductions(results["checks"])]
    parts = [f"<h1>Run {escape(results['run']['id'])}</h1><p>{escape(headline(results))}</p>", table(list(suites[0]) if suites else ["suite"], [list(s.values()) for s in suites]), table(["verdict", "severity", "suite", "check", "name", "why"], checks), table(["suite", "check", "points lost"], lost)]
    if skipped := not_evaluated(results):
        parts.append(table(["suite", "check", "reason"], [list(s.values()) for s in skipped]))
    return "<!doctype html><meta charset=utf-8><title>Graph checks</title><style>body{font:15px sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}table{border-collapse:collapse;margin:1em 0}</style>" + "".join(parts)


def summary(results: dict) -> dict:
    """The few figures that a caller polls."""
    return {"id": results["run"]["id"], "status": results["run"]["status"], "exit_code": results["run"]["exit_code"], "score": results["score"]["value"], "totals": results["totals"]}
